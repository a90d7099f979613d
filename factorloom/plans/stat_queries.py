"""Queries of statistics, scorecard, backtest, samples, models, store and stream, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest, expressions, ic, linalg, models, sampling, scorecard, views
from ..sources import bars, reports, store
from ..streaming import bars as stream
from . import frames, workflows
from .base_queries import OP_SQL, RA, RB, ZA, ZB, D, REGIMES
from .frames import PANEL_NAMES, day, r6
from .sqlbase import MINUTE, PANEL, WS, cosine, pearson, xrank, xz
from .sqlbase import r6 as q6

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def panel(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    return frames.panel(spark, sf_dir, list(names) or PANEL_NAMES)


def union_all(parts: list[str]) -> str:
    return " UNION ALL ".join(f"({p})" for p in parts)


IS = ("1995-01", "1998-12")
OOS = ("1999-01", "2001-12")
CONF = store.Config(is_start=IS[0], is_end=IS[1], oos_start=OOS[0], oos_end=OOS[1])
CSZ = f", cz AS (SELECT *, {xz('mom_5')} AS csz FROM panel)"


@query("ic_monthly_momentum", f"{PANEL}{CSZ} SELECT month, count(*) FILTER (WHERE csz IS NOT NULL AND label IS NOT NULL) AS n, {q6(cosine('csz', 'label'), 'ic')} FROM cz GROUP BY month")
def monthly_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.add_views(panel(spark, sf_dir, "mom_5"), csz_of=["mom_5"])
    return df.groupBy("month").agg(F.count_if(F.col("csz_mom_5").isNotNull() & F.col("label").isNotNull()).alias("n"), r6(ic.cosine_ic("csz_mom_5", "label"), "ic"))


@query("a01_cosine_ic", f"{PANEL} SELECT symbol, {q6(cosine('mom_5', 'label'), 'ic')} FROM panel GROUP BY symbol")
def cosine_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir, "mom_5").groupBy("symbol").agg(r6(ic.cosine_ic("mom_5", "label"), "ic"))


STATS = ["mom_5", "rv_5", "volz_6", "cpos"]


def sums(by: str, source: str = "panel", names=STATS, label: str = "label") -> str:
    ok = lambda f: f"FILTER (WHERE {f} IS NOT NULL AND {label} IS NOT NULL)"
    return union_all([f"SELECT {by}, '{f}' AS factor, sum({f} * {label}) {ok(f)} AS xy, sum({f} * {f}) {ok(f)} AS xx, sum({label} * {label}) {ok(f)} AS yy, count(*) {ok(f)} AS count FROM {source} GROUP BY {by}" for f in names])


SUMS = f"{PANEL}, st AS ({sums('month')})"
ROUND_SUMS = ", ".join(q6(x, x, 5) for x in ("xy", "xx", "yy"))


@query("a02_a03_month_sufficient_stats", f"{SUMS} SELECT month, factor, {ROUND_SUMS}, count FROM st")
def month_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ic.sufficient_stats(panel(spark, sf_dir, *STATS), STATS)
    return s.select("month", "factor", *(r6(F.col(x), x, 5) for x in ("xy", "xx", "yy")), "count")


def merged(prefix: str, where: str = "true", source: str = "st", by: str = "factor") -> str:
    return f"SELECT {by}, xy / sqrt(greatest(xx * yy, 1e-30)) AS {prefix}ic, n AS {prefix}n, n / max(n) OVER () AS {prefix}coverage_proxy FROM (SELECT {by}, coalesce(sum(xy), 0) AS xy, coalesce(sum(xx), 0) AS xx, coalesce(sum(yy), 0) AS yy, sum(count)::BIGINT AS n FROM {source} WHERE {where} GROUP BY {by})"


@query("a04_merge_stats", f"{SUMS}, m AS ({merged('')}) SELECT factor, {q6('ic', 'ic')}, n, {q6('coverage_proxy', 'coverage_proxy')} FROM m")
def merge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ic.merge_stats(ic.sufficient_stats(panel(spark, sf_dir, *STATS), STATS))
    return m.select("factor", r6(F.col("ic"), "ic"), "n", r6(F.col("coverage_proxy"), "coverage_proxy"))


IS_WHERE, OOS_WHERE = (f"month BETWEEN '{a}' AND '{b}'" for a, b in (IS, OOS))


@query("a05_factor_ic_range", f"{SUMS}, m AS ({merged('is_', IS_WHERE)}) SELECT factor, {q6('is_ic', 'is_ic')}, is_n FROM m")
def factor_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ic.factor_ic(panel(spark, sf_dir, *STATS), STATS, *IS, "is_").select("factor", r6(F.col("is_ic"), "is_ic"), "is_n")


SCORES = (
    f"{SUMS}, i AS ({merged('is_', IS_WHERE)}), o AS ({merged('oos_', OOS_WHERE)}), sc AS (SELECT *, sign(is_ic) = sign(oos_ic) AS same_sign, abs(is_ic) AS abs_is_ic, abs(oos_ic) AS abs_oos_ic, "
    "coalesce(sign(is_ic) = sign(oos_ic) AND abs(is_ic) >= 0.002 AND abs(oos_ic) >= 0.001 AND least(is_coverage_proxy, oos_coverage_proxy) >= 0.7, false) AS effective FROM i JOIN o USING (factor))"
)
FAMILY = "regexp_replace(factor, '(_[0-9]+)+(_lag[0-9]+)?$', '')"


@query("a06_mine_effective_factors", f"{SCORES} SELECT factor, {q6('is_ic', 'is_ic')}, {q6('oos_ic', 'oos_ic')}, is_n, oos_n, same_sign, effective, {FAMILY} AS family, 'raw' AS view FROM sc")
def mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = workflows.mine_factors(panel(spark, sf_dir, *STATS), STATS, CONF)
    return s.select("factor", r6(F.col("is_ic"), "is_ic"), r6(F.col("oos_ic"), "oos_ic"), "is_n", "oos_n", "same_sign", "effective", "family", "view")


CATALOG = "(VALUES ('mom_5', 'momentum', 'raw'), ('cpos', 'shape', 'raw')) c(factor, family, view)"


@query("j02_catalog_join", f"{SCORES} SELECT factor, {q6('is_ic', 'is_ic')}, family, view FROM sc LEFT JOIN {CATALOG} USING (factor)")
def catalog_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.createDataFrame([("mom_5", "momentum", "raw"), ("cpos", "shape", "raw")], "factor string, family string, view string")
    return workflows.mine_factors(panel(spark, sf_dir, *STATS), STATS, CONF, c).select("factor", r6(F.col("is_ic"), "is_ic"), "family", "view")


EXPR = f"{PANEL}, x AS (SELECT *, {RA} AS ra, {RB} AS rb, {ZA} AS za, {ZB} AS zb FROM panel), ex AS (SELECT month, datetime, symbol, label, {', '.join(f'{v} AS {k}' for k, v in OP_SQL.items())} FROM x)"


@query("a07_expression_stats", f"{EXPR}, st AS ({sums('month', 'ex', list(OP_SQL))}) SELECT month, factor, {ROUND_SUMS}, count FROM st")
def expression_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [expressions.make_expression(op, "mom_5", "volz_6") | {"name": op} for op in OP_SQL]
    s = ic.sufficient_stats(expressions.evaluate(panel(spark, sf_dir, "mom_5", "volz_6"), exprs), list(OP_SQL))
    return s.select("month", "factor", *(r6(F.col(x), x, 5) for x in ("xy", "xx", "yy")), "count")


BLOCK = union_all([f"SELECT '{f}' AS factor, {pearson(f, 'label')} AS ic, count({f}) AS n, count({f}) / count(*)::DOUBLE AS coverage, stddev_pop({f}) AS std FROM ex" for f in OP_SQL])
BLOCK_COLS = f"{q6('ic', 'ic')}, n, {q6('coverage', 'coverage')}, {q6('std', 'std')}"


def _expr_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expressions.evaluate(panel(spark, sf_dir, "mom_5", "volz_6"), [expressions.make_expression(op, "mom_5", "volz_6") | {"name": op} for op in OP_SQL])


@query("a08_block_stats", f"{EXPR}, b AS ({BLOCK}) SELECT factor, {BLOCK_COLS} FROM b")
def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ic.block_stats(_expr_frame(spark, sf_dir), list(OP_SQL)).select("factor", r6(F.col("ic"), "ic"), "n", r6(F.col("coverage"), "coverage"), r6(F.col("std"), "std"))


@query("o05_f08_j06_prefilter", f"{EXPR}, b AS ({BLOCK}) SELECT factor AS name, factor AS op, {q6('ic', 'is_ic')}, n FROM b WHERE coverage >= 0.7 AND std > 1e-8 AND ic IS NOT NULL ORDER BY abs(ic) DESC, factor LIMIT 3")
def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _expr_frame(spark, sf_dir)
    table = spark.createDataFrame([(op, op) for op in OP_SQL], "name string, op string")
    return ic.prefilter(ic.block_stats(df, list(OP_SQL)), table, 3).select("name", "op", r6(F.col("is_ic"), "is_ic"), "n")


for _p, _fmt in (("M", "%Y-%m"), ("Y", "%Y")):

    def _period(p):
        return lambda spark, sf_dir: ic.ic_by_period(panel(spark, sf_dir, "mom_5"), "mom_5", period=p).select("period", r6(F.col("ic"), "ic"))

    QUERIES[f"a09_ic_by_period_{_p}"] = _period(_p)
    ORACLES[f"a09_ic_by_period_{_p}"] = f"{PANEL} SELECT strftime(datetime, '{_fmt}') AS period, {q6(cosine('mom_5', 'label'), 'ic')} FROM panel WHERE mom_5 IS NOT NULL AND label IS NOT NULL GROUP BY 1"

PREDS = ["pred", "pred_xsz", "pred_xrank"]
PRED = f"{PANEL}, pv AS (SELECT symbol, datetime, month, label, mom_5 AS pred, {xz('mom_5', '1e-9')} AS pred_xsz, {xrank('mom_5')} AS pred_xrank FROM panel)"


def _preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.prediction_views(panel(spark, sf_dir, "mom_5").select("symbol", "datetime", "month", "label", F.col("mom_5").alias("pred")))


ROLL = f"st0 AS ({sums('month', 'pv', PREDS)}), cnt AS (SELECT month, count(*) AS nrows FROM pv GROUP BY month), st1 AS (SELECT *, CASE WHEN count >= 2 THEN xy / sqrt(greatest(xx * yy, 1e-30)) END AS ic FROM st0 JOIN cnt USING (month)), " + (
    "ro AS (SELECT factor AS pred_col, sum(xy) / sqrt(greatest(sum(xx) * sum(yy), 1e-30)) AS ic_total_range, sum(count)::BIGINT AS n, sum(count) / sum(nrows)::DOUBLE AS coverage, avg(ic) AS monthly_mean, stddev_samp(ic) AS monthly_std, count(ic) AS months FROM st1 GROUP BY 1)"
)
ROLL_COLS = f"pred_col, {q6('ic_total_range', 'ic_total_range')}, n, {q6('coverage', 'coverage')}, {q6('monthly_mean', 'monthly_mean')}, {q6('monthly_std', 'monthly_std')}, {q6('CASE WHEN monthly_std > 0 THEN monthly_mean / monthly_std END', 'monthly_ir', 5)}, months"


def _rolled(df: DataFrame) -> DataFrame:
    return df.select("pred_col", *(r6(F.col(x), x) for x in ("ic_total_range",)), "n", *(r6(F.col(x), x) for x in ("coverage", "monthly_mean", "monthly_std")), r6(F.col("monthly_ir"), "monthly_ir", 5), "months")


@query("a11_a12_a13_roll_up", f"{PRED}, {ROLL} SELECT {ROLL_COLS} FROM ro")
def roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(ic.roll_up(ic.prediction_stats(_preds(spark, sf_dir), PREDS)))


YEAR = "datetime >= TIMESTAMP '1997-01-01' AND datetime < TIMESTAMP '1998-01-01'"
YEARLY = union_all([f"SELECT '{p}' AS pred_col, {cosine(p, 'label')} AS v FROM pv WHERE {YEAR}" for p in PREDS])


@query("a10_summarize_predictions", f"{PRED}, {ROLL}, y AS ({YEARLY}) SELECT {ROLL_COLS}, {q6('v', 'ic_1997')} FROM ro JOIN y USING (pred_col)")
def summarize_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ic.summarize_predictions(_preds(spark, sf_dir), PREDS)
    return _rolled(s).join(s.select("pred_col", r6(F.col("ic_1997"), "ic_1997")), "pred_col")


# Scorecard, on the whole panel as the sample.
CANDS, LIB = ["mom_5", "volz_6", "rsi_8"], ["rv_5", "px_sma_6", "oi_vol_ratio"]
CARD = f"{PANEL}, {REGIMES.format('panel')}, lg AS ({union_all([f"SELECT '{n}' AS name, symbol, datetime, month, liquidity, volatility, label, {n} AS value, rv_5, px_sma_6, oi_vol_ratio FROM rg" for n in CANDS])})"


def _cards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    frame = scorecard.sample_frame(panel(spark, sf_dir, *CANDS, *LIB))
    return frame, scorecard.long(frame, CANDS)


@query("a18_coverage_outliers", f"{CARD}, m AS (SELECT name, avg(value) AS mean, stddev_pop(value) AS std, count(value) / count(*)::DOUBLE AS coverage FROM lg GROUP BY name) SELECT name, {q6('any_value(coverage)', 'coverage')}, {q6('any_value(mean)', 'mean')}, {q6('any_value(std)', 'std')}, {q6('CASE WHEN any_value(std) > 1e-12 THEN coalesce(avg((abs((value - mean) / std) > 8)::INT), 0) ELSE 1.0 END', 'outlier_ratio')} FROM lg JOIN m USING (name) GROUP BY name")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.coverage(_cards(spark, sf_dir)[1]).select("name", *(r6(F.col(x), x) for x in ("coverage", "mean", "std", "outlier_ratio")))


@query("a14_pearson_ic", f"{CARD} SELECT name, {q6(pearson('value', 'label'), 'pearson_ic')} FROM lg GROUP BY name")
def pearson_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.pearson_ic(_cards(spark, sf_dir)[1]).select("name", r6(F.col("pearson_ic"), "pearson_ic"))


@query("a15_rank_ic", f"{CARD}, ok AS (SELECT * FROM lg WHERE value IS NOT NULL AND label IS NOT NULL), rk AS (SELECT name, {xrank('value', 'name')} AS a, {xrank('label', 'name')} AS b FROM ok) SELECT name, {q6(pearson('a', 'b'), 'rank_ic')} FROM rk GROUP BY name")
def rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.rank_ic(_cards(spark, sf_dir)[1]).select("name", r6(F.col("rank_ic"), "rank_ic"))


HIT = "coalesce(CASE WHEN avg(ic) < 0 THEN sum((ic < 0)::INT) ELSE sum((ic > 0)::INT) END / count(ic)::DOUBLE, 0)"


@query("a16_monthly_ic", f"{CARD}, pm AS (SELECT name, month, {pearson('value', 'label')} AS ic FROM lg GROUP BY 1, 2) SELECT name, {q6('avg(ic)', 'monthly_ic_mean')}, {q6('CASE WHEN count(ic) = 1 THEN 0 ELSE stddev_samp(ic) END', 'monthly_ic_std')}, {q6(HIT, 'monthly_ic_hit_rate')}, {q6('arg_min(ic, abs(ic))', 'monthly_ic_worst')}, count(ic) AS monthly_ic_count FROM pm GROUP BY name")
def monthly_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scorecard.monthly_ic(_cards(spark, sf_dir)[1])
    return m.select("name", *(r6(F.col(f"monthly_ic_{x}"), f"monthly_ic_{x}") for x in ("mean", "std", "hit_rate", "worst")), "monthly_ic_count")


DIMS = {"product": "'S'", "liquidity_regime": "liquidity", "volatility_regime": "volatility"}
GROUPED = union_all([f"SELECT name, '{p}' AS dim, {k} AS key, {pearson('value', 'label')} AS ic FROM lg GROUP BY 1, 2, 3" for p, k in DIMS.items()])


@query("a17_grouped_ic", f"{CARD}, g AS ({GROUPED}), gd AS (SELECT name, dim, avg(ic) AS m, min(abs(ic)) AS l, {HIT} AS h, count(ic) AS n FROM g GROUP BY 1, 2) SELECT name, " + ", ".join(f"{q6(f'max(m) FILTER (WHERE dim = {p!r})', f'{p}_ic_mean')}, {q6(f'max(l) FILTER (WHERE dim = {p!r})', f'{p}_ic_min_abs')}, {q6(f'max(h) FILTER (WHERE dim = {p!r})', f'{p}_ic_hit_rate')}, max(n) FILTER (WHERE dim = {p!r}) AS {p}_count" for p in DIMS) + " FROM gd GROUP BY name")
def grouped_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scorecard.grouped_ic(_cards(spark, sf_dir)[1])
    return g.select("name", *(c for p in DIMS for c in (*(r6(F.col(f"{p}_ic_{x}"), f"{p}_ic_{x}") for x in ("mean", "min_abs", "hit_rate")), F.col(f"{p}_count"))))


BUCKETS = f"bk AS (SELECT name, least(floor(({xrank('value', 'name, datetime')} + 0.5) * 5 + 1e-12), 4)::INT AS b, label FROM (SELECT * FROM lg WHERE value IS NOT NULL AND label IS NOT NULL)), bm AS (SELECT name, b, avg(label) AS m, count(*) AS k FROM bk GROUP BY 1, 2)"


FULL = "CASE WHEN sum(k) >= 100 AND count(*) = 5 THEN {} END"
BUCKET_COLS = {
    "top_bottom_spread": "max(m) FILTER (WHERE b = 4) - max(m) FILTER (WHERE b = 0)",
    "monotonicity": pearson("b", "m"),
    "extreme_contribution": "greatest(abs(max(m) FILTER (WHERE b = 4)), abs(max(m) FILTER (WHERE b = 0))) / (sum(abs(m)) + 1e-18)",
}


@query("a19_bucket_stats", f"{CARD}, {BUCKETS} SELECT name, {', '.join(q6(FULL.format(e), 'bucket_' + n) for n, e in BUCKET_COLS.items())} FROM bm GROUP BY name")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = scorecard.buckets(_cards(spark, sf_dir)[1])
    return b.select("name", *(r6(F.col(f"bucket_{x}"), f"bucket_{x}") for x in ("top_bottom_spread", "monotonicity", "extreme_contribution")))


@query("v12_candidate_turnover", f"{CARD}, t0 AS (SELECT name, symbol, datetime, {xrank('value', 'name, datetime')} + 0.5 AS pct FROM lg WHERE value IS NOT NULL), t1 AS (SELECT name, abs(s - lag(s) OVER (PARTITION BY name, symbol ORDER BY datetime)) AS d FROM (SELECT *, CASE WHEN pct >= 0.8 THEN 1 WHEN pct <= 0.2 THEN -1 ELSE 0 END AS s FROM t0)) SELECT name, {q6('CASE WHEN count(*) >= 100 THEN avg(d) END', 'turnover_proxy')} FROM t1 GROUP BY name")
def candidate_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.turnover(_cards(spark, sf_dir)[1]).select("name", r6(F.col("turnover_proxy"), "turnover_proxy"))


def zed(x: str) -> str:
    return f"coalesce(({x} - avg({x}) OVER ()) / (CASE WHEN stddev_pop({x}) OVER () > 1e-8 THEN stddev_pop({x}) OVER () END), 0)"


ZED = "zd AS (SELECT " + ", ".join(f"{zed(x)} AS {x}" for x in [*CANDS, *LIB]) + " FROM panel)"
CORRS = "cr AS (" + union_all([f"SELECT '{a}' AS name, '{b}' AS lib, {j} AS j, avg({a} * {b}) AS c FROM zd" for a in CANDS for j, b in enumerate(LIB)]) + ")"


@query("a20_standardize", f"{PANEL}, zp AS (SELECT symbol, datetime, {zed('mom_5')} AS mom_5, {zed('volz_6')} AS volz_6 FROM panel) SELECT symbol, {D}, {q6('mom_5', 'mom_5')}, {q6('volz_6', 'volz_6')} FROM zp")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = linalg.standardised(panel(spark, sf_dir, "mom_5", "volz_6"), ["mom_5", "volz_6"])
    return df.select("symbol", day().alias("d"), r6(F.col("mom_5"), "mom_5"), r6(F.col("volz_6"), "volz_6"))


@query("a21_j11_closest_library_factor", f"{PANEL}, {ZED}, {CORRS} SELECT name, {q6('max(abs(c))', 'max_abs_corr')}, {q6('arg_max(c, abs(c))', 'max_corr')}, arg_max(lib, abs(c)) AS closest, count(*)::INT AS compared FROM cr GROUP BY name")
def closest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = scorecard.closest(panel(spark, sf_dir, *CANDS, *LIB), CANDS, LIB)
    return n.select("name", r6(F.col("max_abs_corr_to_library"), "max_abs_corr"), r6(F.col("max_corr_to_library"), "max_corr"), F.col("closest_library_factor").alias("closest"), F.col("library_factors_compared").alias("compared"))


RESID = (
    f"{CARD}, {ZED}, {CORRS}, nr AS (SELECT name, arg_max(lib, abs(c)) AS lib FROM cr GROUP BY name), v AS (SELECT name, value AS x, label AS y, CASE lib WHEN 'rv_5' THEN rv_5 WHEN 'px_sma_6' THEN px_sma_6 ELSE oi_vol_ratio END AS z FROM lg JOIN nr USING (name)), "
    "ok AS (SELECT * FROM v WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL), b AS (SELECT name, covar_pop(x, z) / var_pop(z) AS beta, avg(x) AS mx, avg(z) AS mz FROM ok GROUP BY name), rs AS (SELECT name, (x - mx) - beta * (z - mz) AS r, y FROM ok JOIN b USING (name))"
)


@query("a22_residual_ic", f"{RESID} SELECT name, {q6('CASE WHEN count(*) >= 10 THEN ' + pearson('r', 'y') + ' END', 'residual_ic')} FROM rs GROUP BY name")
def residual_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir, *CANDS, *LIB)
    return scorecard.residual_ic(df, CANDS, scorecard.closest(df, CANDS, LIB), LIB).select("name", r6(F.col("residual_ic"), "residual_ic"))


@query("scorecard")
def whole_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.scorecard(panel(spark, sf_dir, *CANDS, *LIB), CANDS, LIB)


# Gates, grades and scores over a table of made-up cards, one a customer.
CARD_COLS = {
    "selection_ic": "(c_custkey % 41 - 20) / 2000.0", "rank_ic": "(c_custkey % 37 - 18) / 3000.0", "coverage": "0.6 + (c_custkey % 9) / 20.0", "outlier_ratio": "CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE (c_custkey % 6) / 200.0 END", "std": "CASE WHEN c_custkey % 29 = 0 THEN 0.0 ELSE 0.5 END",
    "monthly_ic_hit_rate": "0.4 + (c_custkey % 7) / 20.0", "monthly_ic_count": "(4 + c_custkey % 11)::DOUBLE", "bucket_top_bottom_spread": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey % 41 - 20) / 900.0 END", "bucket_monotonicity": "(c_custkey % 19 - 9) / 10.0",
    "product_ic_hit_rate": "0.3 + (c_custkey % 5) / 8.0", "liquidity_regime_ic_hit_rate": "0.3 + (c_custkey % 4) / 8.0", "volatility_regime_ic_hit_rate": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 0.35 + (c_custkey % 3) / 8.0 END",
    "turnover_proxy": "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE (c_custkey % 10) / 10.0 END", "max_abs_corr_to_library": "CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE (c_custkey % 21) / 20.0 END", "candidate_peer_max_abs_corr": "(c_custkey % 20) / 20.0", "residual_ic": "(c_custkey % 9 - 4) / 2000.0",
}
CARDS = f"WITH cd AS (SELECT c_custkey AS id, c_custkey % 3 <> 0 AS same_sign, {', '.join(f'{e} AS {n}' for n, e in CARD_COLS.items())} FROM customer)"


def flags_sql(compat: bool) -> str:
    v = lambda x, d="0.0": f"coalesce(nullif({x}, 0), {d})" if compat else f"coalesce({x}, {d})"
    spread = "coalesce(bucket_top_bottom_spread, 0)" if compat else "bucket_top_bottom_spread"
    return f"""fl AS (SELECT *, {v('coverage')} >= 0.7 AND {v('outlier_ratio', '1.0')} <= 0.02 AND {v('std')} > 1e-8 AS pass_data_quality,
  same_sign AND abs({v('selection_ic')}) >= 0.001 AND abs({v('rank_ic')}) >= 0.0005 AND {v('monthly_ic_hit_rate')} >= 0.5 AND {v('monthly_ic_count')} >= 6 AS pass_ic,
  coalesce(sign({spread}) = sign({v('selection_ic')}), false) AND abs({v('bucket_monotonicity')}) >= 0.25 AS pass_bucket,
  {v('product_ic_hit_rate')} >= 0.45 AND {v('liquidity_regime_ic_hit_rate')} >= 0.4 AND {v('volatility_regime_ic_hit_rate')} >= 0.4 AS pass_regime,
  coalesce(turnover_proxy <= 0.85, true) AS pass_trading,
  ({v('max_abs_corr_to_library', '1.0')} <= 0.9 AND {v('candidate_peer_max_abs_corr')} <= 0.9) OR abs({v('residual_ic')}) >= 0.001 AS pass_incremental FROM cd),
fr AS (SELECT *, pass_ic AND pass_incremental AS pass_robustness FROM fl),
fs AS (SELECT *, coalesce(nullif(concat_ws(',', CASE WHEN NOT pass_data_quality THEN 'fail_data' END, CASE WHEN NOT pass_ic THEN 'fail_ic' END, CASE WHEN NOT pass_bucket THEN 'fail_bucket' END, CASE WHEN NOT pass_regime THEN 'fail_regime' END,
  CASE WHEN NOT pass_trading THEN 'fail_trading' END, CASE WHEN NOT pass_incremental THEN 'fail_incremental' END, CASE WHEN NOT pass_robustness THEN 'fail_robustness' END), ''), 'pass_all') AS decision_reason,
  CASE WHEN NOT pass_data_quality THEN 'E' WHEN pass_ic AND pass_bucket AND pass_regime AND pass_trading AND pass_incremental THEN CASE WHEN abs({v('selection_ic')}) >= 0.002 AND {v('monthly_ic_hit_rate')} >= 0.58 THEN 'A' ELSE 'B' END
       WHEN pass_ic AND pass_incremental AND (pass_bucket OR pass_regime) THEN 'B' WHEN pass_ic AND pass_incremental THEN 'C' WHEN same_sign AND abs({v('selection_ic')}) >= 0.0005 THEN 'D' ELSE 'E' END AS final_grade FROM fr)"""


def score_sql(compat: bool) -> str:
    v = lambda x, d="0.0": f"coalesce(nullif({x}, 0), {d})" if compat else f"coalesce({x}, {d})"
    c = lambda e: f"greatest(0, least(1, {e}))"
    return f"""(0.10 * {c(f"({v('coverage')} - 0.7) / 0.30")} + 0.05 * {c(f"1 - {v('outlier_ratio', '1.0')} / 0.02")} + 0.16 * {c(f"abs({v('selection_ic')}) / 0.005")} + 0.10 * {c(f"abs({v('rank_ic')}) / 0.005")}
  + 0.14 * {c(v('monthly_ic_hit_rate'))} + 0.12 * {c(v('product_ic_hit_rate'))} + 0.12 * {c(f"abs({v('bucket_monotonicity')})")} + 0.13 * greatest({c(f"1 - {v('max_abs_corr_to_library', '1.0')} / 0.9")}, {c(f"abs({v('residual_ic')}) / 0.005")})
  + 0.08 * CASE WHEN turnover_proxy IS NULL THEN 0.5 ELSE {c('1 - turnover_proxy')} END + CASE WHEN same_sign THEN 0.05 ELSE -0.10 END) * CASE WHEN final_grade = 'E' THEN 0.25 ELSE 1 END"""


GATE_COLS = ["same_sign", *(f"pass_{g}" for g in scorecard.GATES), "decision_reason", "final_grade"]


def _made_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [f"cast({re.sub(r'([0-9]+[.][0-9]+)', r'\1D', e).replace('::DOUBLE', '')} as double) AS {n}" for n, e in CARD_COLS.items()]
    return frames.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_custkey % 3 <> 0 AS same_sign", *exprs)


for _name, _compat in (("f10_f11_f12_gates_grade_score", False), ("q10_gates_strict_compat", True)):

    def _judge(compat):
        return lambda spark, sf_dir: scorecard.judged(_made_cards(spark, sf_dir), strict_compat=compat).select("id", *GATE_COLS, r6(F.col("composite_score"), "composite_score"))

    QUERIES[_name] = _judge(_compat)
    ORACLES[_name] = f"{CARDS}, {flags_sql(_compat)} SELECT id, {', '.join(GATE_COLS)}, {q6(score_sql(_compat), 'composite_score')} FROM fs"


@query("a28_value_counts", f"{CARDS}, {flags_sql(False)} SELECT final_grade, count(*) AS n, sum((decision_reason = 'pass_all')::INT)::BIGINT AS pass_all FROM fs GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scorecard.judged(_made_cards(spark, sf_dir)).groupBy("final_grade").agg(F.count("*").alias("n"), F.sum((F.col("decision_reason") == "pass_all").cast("long")).alias("pass_all"))


@query("f09_o02_o03_top_passing", f"{CARDS}, {flags_sql(False)} SELECT id, {q6(score_sql(False), 'composite_score')} FROM fs WHERE decision_reason = 'pass_all' ORDER BY composite_score DESC, id LIMIT 10")
def top_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scorecard.judged(_made_cards(spark, sf_dir)).where("decision_reason = 'pass_all'").select("id", r6(F.col("composite_score"), "composite_score"))
    return df.orderBy(F.desc("composite_score"), "id").limit(10)


@query("o06_select_unlike")
def select_unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy pick over real candidates with gates wide open, so that correlation alone decides."""
    df = _expr_frame(spark, sf_dir).persist()
    wide = scorecard.Thresholds(-1, 0, 0, 0, 0, 0, 0, -1, 0.9, 1, 2, -1)
    s = ic.block_stats(df, list(OP_SQL))
    cards = s.select(F.col("factor").alias("name"), F.col("ic").alias("selection_ic"), F.lit(True).alias("same_sign"), "coverage", "std", F.lit(0.0).alias("outlier_ratio"), F.col("ic").alias("bucket_top_bottom_spread"))
    missing = [x for x in ("rank_ic", "monthly_ic_hit_rate", "monthly_ic_count", "bucket_monotonicity", "product_ic_hit_rate", "liquidity_regime_ic_hit_rate", "volatility_regime_ic_hit_rate", "turnover_proxy", "max_abs_corr_to_library", "residual_ic")]
    cards = cards.withColumns({x: F.lit(0.0) for x in missing})
    out = scorecard.select_unlike(scorecard.judged(cards, wide), df, {n: n.partition("_")[0] for n in OP_SQL}, 5, wide, max_per_op=3)
    return out.select("name", r6(F.col("candidate_peer_max_abs_corr"), "peer"), "selected")


# Backtest.
@query("a23_j09_long_short_rank", f"{PRED}, b AS (SELECT datetime, avg(label) FILTER (WHERE pred_xrank >= 0.3) - avg(label) FILTER (WHERE pred_xrank <= -0.3) AS ls_return, count(*) AS n FROM pv WHERE pred_xrank IS NOT NULL AND label IS NOT NULL GROUP BY datetime) SELECT {D}, {q6('ls_return', 'ls_return')}, n FROM b WHERE ls_return IS NOT NULL")
def long_short_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.long_short(_preds(spark, sf_dir)).select(day().alias("d"), r6(F.col("ls_return"), "ls_return"), "n")


@query("a23_long_short_raw", f"{PRED}, ok AS (SELECT * FROM pv WHERE pred IS NOT NULL AND label IS NOT NULL), cu AS (SELECT datetime, quantile_cont(pred, 0.2) AS lo, quantile_cont(pred, 0.8) AS hi, count(*) AS n FROM ok GROUP BY datetime HAVING count(*) >= 10), b AS (SELECT datetime, n, avg(label) FILTER (WHERE pred >= hi) - avg(label) FILTER (WHERE pred <= lo) AS ls_return FROM ok JOIN cu USING (datetime) GROUP BY 1, 2) SELECT {D}, {q6('ls_return', 'ls_return')}, n FROM b")
def long_short_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.long_short(_preds(spark, sf_dir), "pred").select(day().alias("d"), r6(F.col("ls_return"), "ls_return"), "n")


@query("a24_backtest_summary", f"{PRED}, b AS (SELECT datetime, avg(label) FILTER (WHERE pred_xrank >= 0.3) - avg(label) FILTER (WHERE pred_xrank <= -0.3) AS r FROM pv WHERE pred_xrank IS NOT NULL AND label IS NOT NULL GROUP BY datetime) SELECT count(*) AS rows, {q6('avg(r)', 'mean')}, {q6('stddev_samp(r)', 'std')}, {q6('avg(r) / (stddev_samp(r) / sqrt(count(*)))', 'tstat', 5)}, {q6('avg((r > 0)::INT)', 'hit_rate')}, {q6('sum(r)', 'cum_return', 5)} FROM b WHERE r IS NOT NULL")
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = backtest.summarize(backtest.long_short(_preds(spark, sf_dir)))
    return s.select("rows", r6(F.col("mean"), "mean"), r6(F.col("std"), "std"), r6(F.col("tstat"), "tstat", 5), r6(F.col("hit_rate"), "hit_rate"), r6(F.col("cum_return"), "cum_return", 5))


def xsz_sql(preds: list[str], source: str) -> str:
    return union_all([f"SELECT '{p}' AS pred_col, sum(zx * y) / sqrt(sum(zx * zx) * sum(y * y)) AS ic, count(*) AS n FROM (SELECT label AS y, count(*) OVER g AS k, stddev_samp({p}) OVER g AS sd, ({p} - avg({p}) OVER g) / (stddev_samp({p}) OVER g + 1e-9) AS zx FROM {source} WHERE {p} IS NOT NULL AND label IS NOT NULL WINDOW g AS (PARTITION BY datetime)) WHERE k >= 2 AND sd > 1e-12 HAVING count(*) > 0" for p in preds])


@query("a25_a26_pred_xsz_ic", f"{PANEL}, i AS ({xsz_sql(['mom_5', 'rv_5', 'cpos'], 'panel')}) SELECT pred_col, {q6('ic', 'ic')}, n::BIGINT AS n FROM i")
def pred_xsz_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.pred_xsz_ic(panel(spark, sf_dir, "mom_5", "rv_5", "cpos"), ["mom_5", "rv_5", "cpos"]).select("pred_col", r6(F.col("ic"), "ic"), "n")


# Sampling and weights.
def lot_sql(seed: int, key: str = "symbol || '|' || strftime(datetime, '%Y-%m-%d %H:%M:%S')") -> str:
    return f"md5({key} || '|{seed}')"


LAB = f"{PANEL}, lb AS (SELECT *, {lot_sql(7)} AS lot, {xrank('label')} AS label_xrank FROM panel)"


@query("p01_p04_sample_rows", f"{LAB} SELECT symbol, {D}, month FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY lot) AS k FROM lb WHERE label IS NOT NULL) WHERE k <= 20")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_rows(panel(spark, sf_dir, "cpos"), 20, seed=7).select("symbol", day().alias("d"), "month")


TIMES = f"tm AS (SELECT month, datetime, count(*) AS n FROM panel GROUP BY 1, 2), nd AS (SELECT month, ceil(60.0 / greatest(quantile_cont(n, 0.5), 1)) AS need FROM tm GROUP BY 1), ch AS (SELECT datetime FROM (SELECT datetime, need, row_number() OVER (PARTITION BY month ORDER BY md5(strftime(datetime, '%Y-%m-%d %H:%M:%S') || '|7')) AS k FROM tm JOIN nd USING (month)) WHERE k <= need)"


@query("p02_p03_sample_times", f"{PANEL}, {TIMES} SELECT symbol, {D}, month, regexp_replace(upper(symbol), '[0-9]+$', '') AS product FROM panel WHERE datetime IN (SELECT datetime FROM ch)")
def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_times(panel(spark, sf_dir, "cpos"), 60, seed=7).select("symbol", day().alias("d"), "month", views.product_code("symbol").alias("product"))


@query("p06_stratified", f"{LAB} SELECT symbol, {D} FROM (SELECT *, row_number() OVER (PARTITION BY greatest(0, least(7, floor((label_xrank + 0.5) * 8))) ORDER BY lot) > 50 AS more FROM lb WHERE label IS NOT NULL AND label_xrank IS NOT NULL) ORDER BY more, lot LIMIT 400")
def stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.label_views(panel(spark, sf_dir, "cpos"))
    return sampling.sample_training(df, 400, "stratified", 7).select("symbol", day().alias("d"))


@query("p07_random", f"{LAB} SELECT symbol, {D} FROM lb WHERE label IS NOT NULL AND label_xrank IS NOT NULL ORDER BY lot LIMIT 400")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_training(views.label_views(panel(spark, sf_dir, "cpos")), 400, "random", 7).select("symbol", day().alias("d"))


@query("p05_p07_event_sample")
def event_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_training(views.event_scores(panel(spark, sf_dir, "cpos")), 400, "event35", 7).select("symbol", day().alias("d"))


@query("m07_recency_weights", f"{PANEL} SELECT symbol, {D}, {q6('pow(2.0, -greatest(0, (2001 * 12 + 6) - (year(datetime) * 12 + month(datetime))) / 12.0)', 'w')} FROM panel".replace("month(datetime)", "date_part('month', datetime)"))
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.day_bars(spark, sf_dir).select("symbol", day().alias("d"), r6(sampling.recency_weight("2001-06", 12), "w"))


@query("a27_weighted_mean_scale", "WITH w AS (SELECT value, (user_id % 5)::DOUBLE AS w FROM events) SELECT 'value' AS \"column\", round(sum(w * value) / sum(w), 6) + 0.0 AS mean, round(greatest(sqrt(sum(w * value * value) / sum(w) - pow(sum(w * value) / sum(w), 2)), 1e-6), 5) + 0.0 AS scale FROM w")
def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.weighted_mean_scale(frames.table(spark, sf_dir, "events"), ["value"], (F.col("user_id") % 5).cast("double")).select("column", r6(F.col("mean"), "mean"), r6(F.col("scale"), "scale", 5))


# Models.
RF = ["mom_5", "volz_6"]
ALPHA = 0.5
RIDGE = (
    f"{PANEL}, tr AS (SELECT coalesce(mom_5, 0) AS a, coalesce(volz_6, 0) AS b, label AS y FROM panel WHERE label IS NOT NULL), "
    "mo AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(y) AS my, greatest(stddev_pop(a), 1e-6) AS sa, greatest(stddev_pop(b), 1e-6) AS sb, covar_pop(a, y) / greatest(stddev_pop(a), 1e-6) AS ca, covar_pop(b, y) / greatest(stddev_pop(b), 1e-6) AS cb, "
    f"covar_pop(a, b) / (greatest(stddev_pop(a), 1e-6) * greatest(stddev_pop(b), 1e-6)) AS r, 1.0 + {ALPHA} AS k FROM tr), "
    "wt AS (SELECT *, (k * ca - r * cb) / (k * k - r * r) AS wa, (k * cb - r * ca) / (k * k - r * r) AS wb FROM mo)"
)


@query("m01_o04_ridge_fit", f"{RIDGE} SELECT 'mom_5' AS feature, {q6('wa', 'weight', 7)}, {q6('ma', 'mean')}, {q6('sa', 'std')} FROM wt UNION ALL SELECT 'volz_6', round(wb, 7) + 0.0, round(mb, 6) + 0.0, round(sb, 6) + 0.0 FROM wt")
def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = models.fit_ridge(panel(spark, sf_dir, *RF), RF, ALPHA)
    rows = [(f, float(w), float(a), float(s)) for f, w, a, s in zip(m.features, m.weights, m.mean, m.std)]
    df = spark.createDataFrame(rows, "feature string, weight double, mean double, std double")
    return df.select("feature", r6(F.col("weight"), "weight", 7), r6(F.col("mean"), "mean"), r6(F.col("std"), "std"))


RIDGE_PRED = "my + wa * (coalesce(mom_5, 0) - ma) / sa + wb * (coalesce(volz_6, 0) - mb) / sb"


@query("m02_m12_ridge_predict", f"{RIDGE} SELECT symbol, {D}, {q6(RIDGE_PRED, 'pred')} FROM panel, wt")
def ridge_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir, *RF).persist()
    return df.select("symbol", day().alias("d"), r6(models.fit_ridge(df, RF, ALPHA).predict(), "pred"))


LOO = f"{RIDGE}, pr AS (SELECT datetime, label, {RIDGE_PRED} AS base, my + cb / k * (coalesce(volz_6, 0) - mb) / sb AS d0, my + ca / k * (coalesce(mom_5, 0) - ma) / sa AS d1 FROM panel, wt), i AS ({xsz_sql(['base', 'd0', 'd1'], 'pr')})"


@query("m09_leave_one_out", f"{LOO} SELECT CASE x.pred_col WHEN 'd0' THEN 'mom_5' ELSE 'volz_6' END AS factor, {q6('b.ic', 'base_ic')}, {q6('x.ic', 'drop_ic')} FROM i x, i b WHERE b.pred_col = 'base' AND x.pred_col <> 'base'")
def loo(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir, *RF).persist()
    return models.leave_one_out(df, models.fit_ridge(df, RF, ALPHA)).select("factor", r6(F.col("base_ic"), "base_ic"), r6(F.col("drop_ic"), "drop_ic"))


@query("a30_k09_validation_summary", f"{LOO}, e AS (SELECT x.pred_col, b.ic - x.ic AS delta FROM i x, i b WHERE b.pred_col = 'base' AND x.pred_col <> 'base') SELECT 'ridge' AS model, count(*) AS factors, sum((delta > 0)::INT)::BIGINT AS retained, sum((delta <= 0)::INT)::BIGINT AS removed, sum((delta > 0 AND pred_col = 'd0')::INT)::BIGINT AS new_retained FROM e")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir, *RF).persist()
    new = spark.createDataFrame([("mom_5",)], "factor string")
    return workflows.validation_summary(models.leave_one_out(df, models.fit_ridge(df, RF, ALPHA)), "ridge", new).select("model", "factors", "retained", "removed", "new_retained")


@query("m03_trees")
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir, *RF)
    train = sampling.sample_rows(df, 100, seed=7)
    return models.Trees(RF, trees=5, depth=3).fit(train).transform(df).select("symbol", day().alias("d"), r6(F.col("pred"), "pred"))


@query("m10_replacement_test")
def replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = panel(spark, sf_dir, *RF)
    return models.replacement_test(df, models.Trees(RF, trees=3, depth=3).fit(sampling.sample_rows(df, 100, seed=7)), RF, RF)


@query("m04_m05_m06_m08_network")
def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.label_views(panel(spark, sf_dir, *RF))
    net = models.Net(RF, models.NetConfig(hidden=8, epochs=2, loss="corr_mse")).fit(sampling.sample_training(df, 2000, "stratified", 7), weight=sampling.recency_weight("2001-12", 24))
    return net.transform(df.select("symbol", "datetime", *RF)).select("symbol", day().alias("d"), r6(F.col("pred"), "pred"))


@query("m11_network_replacement")
def network_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.label_views(panel(spark, sf_dir, *RF))
    net = models.Net(RF, models.NetConfig(hidden=8, epochs=2)).fit(sampling.sample_training(df, 2000, "random", 7))
    return models.replacement_test(df, net, RF, RF, raw=False)


@query("m13_baseline")
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.baseline(panel(spark, sf_dir, *RF), RF, CONF, ["ridge"], 200)["summary"].select("model", "pred_col", "n", "ic_total_range", "monthly_mean", "monthly_ir")


@query("m14_a29_incremental")
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = workflows.incremental(panel(spark, sf_dir, *RF, "rsi_8"), {"two": RF, "three": [*RF, "rsi_8"]}, CONF, rows_per_month=200)
    return workflows.deltas(s, "two", "three")


# Candidates, sets and joins.
SEEDS = f"{SCORES}, gr AS (SELECT *, {FAMILY} || ':raw' AS grp, row_number() OVER (PARTITION BY {FAMILY} ORDER BY same_sign DESC, abs_is_ic DESC, factor) AS k FROM sc)"


@query("e13_diverse_seeds", f"{SEEDS} SELECT factor, grp, row_number() OVER (ORDER BY k, same_sign DESC, abs_is_ic DESC, factor)::INT AS place FROM gr ORDER BY place LIMIT 3")
def diverse_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = expressions.seeds(workflows.mine_factors(panel(spark, sf_dir, *STATS), STATS, CONF), 3)
    return s.select("factor", F.col("group").alias("grp"), "place")


@query("e14_e15_e16_candidates", f"{SEEDS}, se AS (SELECT factor, row_number() OVER (ORDER BY k, same_sign DESC, abs_is_ic DESC, factor) AS p FROM gr) SELECT 'nf_' || op || '_' || substr(sha1(op || ':' || a.factor || ':' || b.factor), 1, 10) AS name, op, a.factor AS lname, b.factor AS rname FROM se a JOIN se b ON b.p > a.p AND b.p <= a.p + 17 CROSS JOIN (VALUES {', '.join(f"('{o}')" for o in OP_SQL)}) o(op)")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = expressions.candidates(workflows.mine_factors(panel(spark, sf_dir, *STATS), STATS, CONF), 80, 500)
    return t.select("name", "op", F.col("left").alias("lname"), F.col("right").alias("rname"))


@query("mine_expressions")
def mine_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mining loop from seeds to scorecard evidence, judged; the pick itself is o06."""
    df = panel(spark, sf_dir, *CANDS, *LIB).persist()
    scores = workflows.mine_factors(df, [*CANDS, *LIB], CONF)
    table = expressions.candidates(scores, 4, 4)
    exprs = [r.asDict() for r in table.collect()]
    train = sampling.sample_times(df.where(F.col("month").between(*IS)), 60, 7)
    made = expressions.evaluate(train, exprs).persist()
    best = ic.prefilter(ic.block_stats(made, [e["name"] for e in exprs]), table, 6)
    names = [r["name"] for r in best.select("name").orderBy("name").collect()]
    cards = scorecard.scorecard(made, names, LIB).join(best.select("name", "op", "is_ic"), "name")
    cards = cards.withColumns({"selection_ic": F.col("is_ic"), "same_sign": F.coalesce(F.signum("pearson_ic") == F.signum("is_ic"), F.lit(False))})
    return scorecard.judged(cards).select("name", "op", r6(F.col("is_ic"), "is_ic"), "decision_reason", "final_grade", r6(F.col("composite_score"), "composite_score"))


@query("j01_j03_j04_j05_score_joins", f"{SCORES} SELECT c.name, c.op, round(s.is_ic, 6) + 0.0 AS is_ic, round(s.oos_ic, 6) + 0.0 AS oos_ic FROM (VALUES ('mom_5', 'a'), ('none', 'b'), ('cpos', 'c')) c(name, op) LEFT JOIN sc s ON s.factor = c.name")
def score_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = workflows.mine_factors(panel(spark, sf_dir, *STATS), STATS, CONF).withColumnRenamed("factor", "name")
    table = spark.createDataFrame([("mom_5", "a", 9.0), ("none", "b", 9.0), ("cpos", "c", 9.0)], "name string, op string, is_ic double")
    return table.drop(*set(table.columns) & set(scores.columns) - {"name"}).join(scores, "name", "left").select("name", "op", r6(F.col("is_ic"), "is_ic"), r6(F.col("oos_ic"), "oos_ic"))


@query("j10_o10_o11_membership", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 30), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_discount < 0.03) SELECT k, 'both' AS kind FROM a WHERE k IN (SELECT k FROM b) UNION ALL SELECT k, 'only_a' FROM a WHERE k NOT IN (SELECT k FROM b)")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = frames.table(spark, sf_dir, "lineitem")
    a, b = (li.where(c).select(F.col("l_partkey").alias("k")).distinct() for c in ("l_quantity > 30", "l_discount < 0.03"))
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.join(b, "k", "left_anti").withColumn("kind", F.lit("only_a")))


@query("a31_o08_o09_first_rows", f"WITH {MINUTE}, u AS (SELECT symbol, datetime, close, 0 AS part FROM bars UNION ALL SELECT symbol, datetime, -close, 1 FROM bars) SELECT symbol, strftime(datetime, '%Y-%m-%d %H:%M') AS t, {q6('close', 'close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, datetime ORDER BY part) AS k FROM u) WHERE k = 1")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = frames.minute_bars(spark, sf_dir).select("symbol", "datetime", "close")
    u = b.withColumn("part", F.lit(0)).unionByName(b.withColumn("close", -F.col("close")).withColumn("part", F.lit(1)))
    k = F.row_number().over(Window.partitionBy("symbol", "datetime").orderBy("part"))
    return u.withColumn("k", k).where("k = 1").select("symbol", frames.minute().alias("t"), r6(F.col("close"), "close"))


TOP = "SELECT *, row_number() OVER (ORDER BY abs_is_ic DESC, factor) AS k FROM"
NEW = "(SELECT factor, abs_is_ic FROM sc UNION ALL SELECT 'nf_x', 0.9)"


@query("o12_feature_sets", f"{SCORES}, o1 AS ({TOP} sc), n1 AS ({TOP} {NEW}) " + " UNION ALL ".join([
    "SELECT 'orig_top2' AS feature_set, factor FROM o1 WHERE k <= 2", "SELECT 'orig_effective', factor FROM sc WHERE effective", "SELECT 'orig_all', factor FROM sc",
    "SELECT 'new_top2', factor FROM n1 WHERE k <= 2", "SELECT 'new_effective', factor FROM sc WHERE effective", "SELECT 'new_effective', 'nf_x'", "SELECT 'new_all', factor FROM sc", "SELECT 'new_all', 'nf_x'",
]))
def feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = workflows.mine_factors(panel(spark, sf_dir, *STATS), STATS, CONF)
    sets = workflows.feature_sets(scores, [2], STATS, spark.createDataFrame([("nf_x", 0.9)], "factor string, abs_is_ic double"))
    return spark.createDataFrame([(k, f) for k, v in sets.items() for f in v], "feature_set string, factor string")


@query("k04_s23_ic_parts", f"{SUMS} SELECT month, factor, {ROUND_SUMS}, count FROM st WHERE {IS_WHERE}")
def ic_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of half the range, then of all of it: the second call adds only what is missing."""
    df, path = panel(spark, sf_dir, *STATS), store.scratch(spark, "parts")
    workflows.ic_parts(df, STATS, path, "is", IS[0], "1996-12")
    s = workflows.ic_parts(df, STATS, path, "is", *IS)
    return s.select("month", "factor", *(r6(F.col(x), x, 5) for x in ("xy", "xx", "yy")), "count")


EXPR_SCORES = f"{EXPR}, st AS ({sums('month', 'ex', list(OP_SQL))}), i AS ({merged('is_', IS_WHERE)}), o AS ({merged('oos_', OOS_WHERE)})"


@query("a07_j03_expression_scores", f"{EXPR_SCORES} SELECT factor AS name, factor AS op, {q6('is_ic', 'is_ic')}, {q6('oos_ic', 'oos_ic')}, coalesce(sign(is_ic) = sign(oos_ic) AND abs(is_ic) >= 0.002 AND abs(oos_ic) >= 0.001 AND is_coverage_proxy >= 0.5 AND oos_coverage_proxy >= 0.5, false) AS effective FROM i JOIN o USING (factor)")
def expression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, path = _expr_frame(spark, sf_dir), store.scratch(spark, "expression-parts")
    workflows.ic_parts(df, list(OP_SQL), path, "is", *IS)
    workflows.ic_parts(df, list(OP_SQL), path, "oos", *OOS)
    parts = spark.read.parquet(path).withColumn("prefix", F.col("prefix").cast("string"))
    table = spark.createDataFrame([(op, op) for op in OP_SQL], "name string, op string")
    return workflows.aggregate_expressions(parts, table).select("name", "op", r6(F.col("is_ic"), "is_ic"), r6(F.col("oos_ic"), "oos_ic"), "effective")


# Store and stream.
SPEC = store.FactorSpec.of(["mom_5", "tsz_mom_5", "csz_px_sma_6", "csr_cpos"])


def _store(spark: SparkSession, sf_dir: str) -> store.FactorStore:
    path = store.scratch(spark, "panel")
    df = frames.panel(spark, sf_dir, ["mom_5", "px_sma_6", "cpos"])
    df = views.add_views(df, tsz_of=["mom_5"])
    meta = [x for x in bars.META if x in df.columns]
    store.write_panel(df.select(*meta, "mom_5", "px_sma_6", "cpos", "tsz_mom_5"), path)
    return store.FactorStore(spark, path, SPEC)


@query("s04_s05_s11_months", f"{PANEL} SELECT DISTINCT month FROM panel WHERE month BETWEEN '1996-03' AND '1997-02'")
def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(m,) for m in _store(spark, sf_dir).months("1996-03", "1997-02")], "month string")


@query("s06_s07_s15_read_months", f"{PANEL}, v AS (SELECT *, {xz('px_sma_6')} AS csz, {xrank('cpos')} AS csr FROM panel) SELECT symbol, {D}, month, {q6('mom_5', 'mom_5')}, {q6('csz', 'csz_px_sma_6')}, {q6('csr', 'csr_cpos')} FROM v WHERE month BETWEEN '1996-03' AND '1997-02' AND symbol IN ('S1', 'S2')")
def read_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _store(spark, sf_dir).read("1996-03", "1997-02", ["mom_5", "csz_px_sma_6", "csr_cpos", "unknown"], ["S1", "S2"])
    return df.select("symbol", day().alias("d"), "month", *(r6(F.col(x), x) for x in ("mom_5", "csz_px_sma_6", "csr_cpos")))


@query("s08_s09_s10_final_panel", f"{PANEL} SELECT month, count(*) AS n, {q6('sum(mom_5)', 'total', 5)} FROM panel WHERE month BETWEEN '1996-03' AND '1996-05' GROUP BY month")
def final_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, path = _store(spark, sf_dir), store.scratch(spark, "final")
    store.write_final(st.read(), path)
    final = store.FactorStore(spark, path, store.FactorSpec.of(["mom_5"]))
    return final.read("1996-03", "1996-05").groupBy("month").agg(F.count("*").alias("n"), r6(F.sum("mom_5"), "total", 5))


@query("s12_s13_audit", f"{PANEL} SELECT count(DISTINCT month) AS months, min(month) AS first_month, max(month) AS last_month, count(DISTINCT symbol) AS symbols, count(*) AS rows, count(label) AS labelled_rows, count(DISTINCT month) FILTER (WHERE {IS_WHERE})::INT AS is_months, count(DISTINCT month) FILTER (WHERE {OOS_WHERE})::INT AS oos_months, 1 AS n_csz FROM panel")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflows.audit_data(_store(spark, sf_dir), CONF).select("months", "first_month", "last_month", "symbols", "rows", "labelled_rows", "is_months", "oos_months", "n_csz")


@query("s18_s19_feature_matrix", f"{PANEL}, x AS (SELECT *, {xrank('mom_5')} AS ra, {xrank('cpos')} AS rb FROM panel) SELECT symbol, {D}, {q6('mom_5', 'mom_5')}, {q6('ra - rb', 'spread')} FROM x")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, e = _store(spark, sf_dir), expressions.make_expression("rank_spread", "mom_5", "cpos")
    st = store.FactorStore(spark, st.path, store.FactorSpec.of(["mom_5", "cpos"]))
    return st.features(["mom_5", e["name"]], [e]).select("symbol", day().alias("d"), r6(F.col("mom_5"), "mom_5"), r6(F.col(e["name"]), "spread"))


@query("k01_k03_build_panel", f"{PANEL}, ts AS (SELECT *, CASE WHEN count(mom_5) OVER ({WS} ROWS 119 PRECEDING) >= 30 THEN (mom_5 - avg(mom_5) OVER ({WS} ROWS 119 PRECEDING)) / (stddev_samp(mom_5) OVER ({WS} ROWS 119 PRECEDING) + 1e-8) END AS t FROM panel WHERE datetime >= TIMESTAMP '1996-01-01') SELECT symbol, {D}, round(mom_5::FLOAT::DOUBLE, 4) + 0.0 AS mom_5, round(t::FLOAT::DOUBLE, 4) + 0.0 AS tsz_mom_5 FROM ts")
def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = workflows.build_panel(frames.day_bars(spark, sf_dir), store.FactorSpec.of(["mom_5", "tsz_mom_5"]), start="1996-01-01", gap_minutes=frames.DAY_GAP, horizon=frames.DAY_HORIZON, blank=frames.DAY_BLANK)
    return df.select("symbol", day().alias("d"), r6(F.col("mom_5").cast("double"), "mom_5", 4), r6(F.col("tsz_mom_5").cast("double"), "tsz_mom_5", 4))


@query("k06_predictions_by_month", f"{PANEL} SELECT month, 'mom' AS model, count(*) AS n, {q6('sum(mom_5)', 'total', 5)} FROM panel GROUP BY month")
def predictions_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.scratch(spark, "predictions")
    reports.write_predictions(panel(spark, sf_dir, "mom_5").select("symbol", "datetime", "label", F.col("mom_5").alias("pred"), F.lit("mom").alias("model")), path)
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month"), "model").agg(F.count("*").alias("n"), r6(F.sum("pred"), "total", 5))


@query("stream_minute_bars", f"WITH {MINUTE} SELECT symbol, strftime(datetime, '%Y-%m-%d %H:%M') AS t, {q6('open', 'open')}, {q6('close', 'close')}, volume FROM bars")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's bars over the whole table, run until its end."""
    events = frames.table(spark, sf_dir, "events")
    src = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return _run(spark, stream.minute_bars(src), "bars").select("symbol", frames.minute().alias("t"), r6(F.col("open"), "open"), r6(F.col("close"), "close"), "volume")


GAPS = "g AS (SELECT *, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY event_type ORDER BY ts)), 0) >= 3600 AS brk FROM events), s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY event_type ORDER BY ts) AS sid FROM g)"


@query("stream_sessions", f"WITH {GAPS} SELECT event_type AS symbol, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last, count(*) AS events FROM s GROUP BY event_type, sid")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frames.table(spark, sf_dir, "events")
    src = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    at = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss").alias(x)
    return _run(spark, stream.sessions(src), "sessions").select("symbol", at("first"), at("last"), "events")


def _run(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what there is and returns its complete result."""
    path = store.scratch(spark, name)
    q = df.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{path}/out")).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")

