"""Queries of sources, sessions, labels, views and expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import at_least, finite, number, zero
from ..operators import expressions, factors, rolling, sessions, views
from ..sources import bars
from . import frames
from .frames import day, minute, r6
from .sqlbase import DAY, DAY_FRAME, DAY_LABELS, DAY_SESSIONS, MINUTE, MINUTE_SESSIONS, PANEL, WS, frame, xrank, xz
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


OHLC = ["open", "high", "low", "close", "volume", "amount", "oi"]
BAR_SQL = ", ".join(q6(x, x, 8) for x in OHLC)
D = "strftime(datetime, '%Y-%m-%d') AS d"
M = "strftime(datetime, '%Y-%m-%d %H:%M') AS t"


@query("s02_minute_bars", f"WITH {MINUTE} SELECT symbol, {M}, {BAR_SQL} FROM bars")
def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.minute_bars(spark, sf_dir).select("symbol", minute().alias("t"), *(r6(F.col(x), x, 8) for x in OHLC))


@query("s02_daily_bars", f"WITH {DAY} SELECT symbol, {D}, {BAR_SQL} FROM bars")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.day_bars(spark, sf_dir).select("symbol", day().alias("d"), *(r6(F.col(x), x, 8) for x in OHLC))


@query("s01_symbols", f"WITH {DAY} SELECT DISTINCT symbol FROM bars WHERE symbol NOT IN ('S0', 'S3')")
def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.symbols(frames.day_bars(spark, sf_dir), ["S0", "S3"])


@query(
    "s02_raw_normalise",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('minute', ts) ORDER BY ts, event_id) AS k FROM events)
SELECT event_type AS symbol, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS t, round(value, 6) + 0.0 AS close, event_id::DOUBLE AS volume,
       CASE WHEN event_id % 7 <> 0 THEN round(user_id, 6) + 0.0 END AS oi, round(value * event_id, 4) + 0.0 AS amount
FROM r WHERE k = 1 AND event_type <> 'click'""",
)
def raw_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of odd names and bad numbers, as files have them, through the same normalisation as read_csv()."""
    e = frames.table(spark, sf_dir, "events")
    text = lambda x: F.col(x).cast("string")
    raw = e.select(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Trade Time"), *(text("value").alias(x) for x in (" Open", "High", "Low ", "Close")), text("event_id").alias("VOLUME"), F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(text("user_id")).alias("open_interest"), F.struct("ts", "event_id").alias("_order"))
    out = bars.normalise(raw, ["click"])
    return out.select("symbol", minute().alias("t"), r6(F.col("close"), "close"), "volume", r6(F.col("oi"), "oi"), r6(F.col("amount"), "amount", 4))


@query(
    "s03_numeric_coercion",
    "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'x' || event_id ELSE event_id || '.5' END AS DOUBLE) AS a, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 6) + 0.0 END AS b FROM events",
)
def coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = frames.table(spark, sf_dir, "events")
    s = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".5")))
    x = F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.col("value"))
    return e.select("event_id", s.alias("s"), x.alias("x")).select("event_id", number("s").alias("a"), r6(finite("x"), "b"))


SESSION_COLS = "round(gap_min, 6) + 0.0 AS gap_min, brk AS is_long_break_before, session_id, bars_to_next::INT AS bars_to_next_long_break, bss::INT AS bss"


def _session_rows(df: DataFrame, when) -> DataFrame:
    return df.select("symbol", when, r6(F.col("gap_min"), "gap_min"), "is_long_break_before", "session_id", "bars_to_next_long_break", "bss")


@query("w01_to_w08_minute_sessions", f"{MINUTE_SESSIONS} SELECT symbol, {M}, {SESSION_COLS} FROM sess")
def minute_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_rows(sessions.sessions(frames.minute_bars(spark, sf_dir)), minute().alias("t"))


@query("w01_to_w08_daily_sessions", f"{DAY_SESSIONS} SELECT symbol, {D}, {SESSION_COLS} FROM sess")
def daily_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_rows(frames.day_sessions(spark, sf_dir), day().alias("d"))


@query("w03_session_summary", f"{DAY_SESSIONS} SELECT symbol, session_id, count(*) AS bars, min(strftime(datetime, '%Y-%m-%d')) AS first_day, max(strftime(datetime, '%Y-%m-%d')) AS last_day FROM sess GROUP BY 1, 2")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.day_sessions(spark, sf_dir).groupBy("symbol", "session_id").agg(F.count("*").alias("bars"), F.min(day()).alias("first_day"), F.max(day()).alias("last_day"))


@query("w06_w07_labels", f"{DAY_LABELS} SELECT symbol, {D}, {q6('label', 'label')} FROM lab")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.day_labels(spark, sf_dir).select("symbol", day().alias("d"), r6(F.col("label"), "label"))


#: Prices are decimals over small integers, so some stand right between two rounded values.
OFF_TIE = 1.3e-9
SERIES = ["lr", "logv", "loga", "typ", "hl", "tr", "up", "dn", "vwap", "dloi", *factors.SHAPES]


@query("base_series", f"{DAY_FRAME} SELECT symbol, {D}, {', '.join(q6(f'{x} + {OFF_TIE}', x) for x in SERIES)} FROM f")
def base_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.day_frame(spark, sf_dir).select("symbol", day().alias("d"), *(r6(F.col(f"s_{x}") + OFF_TIE, x) for x in SERIES))


LONG = 89
_f = frame(LONG)
_n = f"CASE WHEN count(lr) OVER {_f} = {LONG} THEN"


@query(
    "rolling_long_windows",
    f"{DAY_FRAME} SELECT symbol, {D}, {q6(f'{_n} avg(lr) OVER {_f} END', 'mean')}, {q6(f'{_n} stddev_samp(lr) OVER {_f} END', 'std')}, {q6(f'{_n} covar_samp(lr, logv) OVER {_f} END', 'cov')}, "
    f"{q6(f'{_n} max(close) OVER {_f} END', 'top')}, {q6(f'{_n} min(close) OVER {_f} END', 'low')} FROM f",
)
def long_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 89 rows put together from blocks of powers of two."""
    m = ["mean:s_lr", "mean:s_logv", "co:s_lr,s_lr", "co:s_lr,s_logv", "max:s_c", "min:s_c"]
    df = rolling.long_windows(frames.day_frame(spark, sf_dir), [LONG], m)
    w, k = f"_{LONG}", LONG - 1
    return df.select(
        "symbol", day().alias("d"), r6(F.col("mean_s_lr" + w), "mean"), r6(F.sqrt(at_least(F.col("co_s_lr_s_lr" + w) / k, 0)), "std"),
        r6(F.col("co_s_lr_s_logv" + w) / k, "cov"), r6(F.col("max_s_c" + w), "top"), r6(F.col("min_s_c" + w), "low"),
    )


CHUNKED = ["mom_21", "sharpe_21", "rv_55", "bollz_21", "pvcorr_21", "drawdn_55", "volz_21"]


def _chunks(spark: SparkSession, sf_dir: str, rows: int = 500, halo: int = 120) -> DataFrame:
    keys = ("symbol", "chunk")
    df = bars.in_chunks(frames.day_bars(spark, sf_dir), rows, halo)
    return factors.base_series(sessions.sessions(df, frames.DAY_GAP, keys), keys)


from .factor_queries import BY_WINDOW  # noqa: E402
from .sqlbase import masked  # noqa: E402

_formula = {f: e for f, _, e in BY_WINDOW.values()}
_chunk_sql = ", ".join(q6(masked(_formula[n.rpartition("_")[0]](int(n.rpartition("_")[2])), int(n.rpartition("_")[2])), n) for n in CHUNKED)


@query("panel_in_chunks", f"{DAY_FRAME} SELECT symbol, {D}, {_chunk_sql} FROM f")
def panel_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same factors with every symbol cut into chunks, so no task holds a whole series."""
    df = factors.add_factors(_chunks(spark, sf_dir), CHUNKED, ("symbol", "chunk")).where(~F.col("is_halo"))
    return df.select("symbol", day().alias("d"), *(r6(F.col(n), n) for n in CHUNKED))


@query("wide_panel", f"{DAY_FRAME} SELECT symbol, {D}, {_chunk_sql} FROM f")
def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide panel's one-pass windows, for the same factors."""
    return factors.wide_panel(_chunks(spark, sf_dir), CHUNKED).select("symbol", day().alias("d"), *(r6(F.col(n), n) for n in CHUNKED))


from .sqlbase import ema  # noqa: E402


@query("w09_ema", f"{DAY_FRAME} SELECT symbol, {D}, {q6(ema('close', 21), 'ema_21', 5)} FROM f")
def ema_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factors.with_emas(frames.day_frame(spark, sf_dir), [("s_c", 21)]).select("symbol", day().alias("d"), r6(F.col("_ema_s_c_21"), "ema_21", 5))


@query("w09_ema_in_chunks", f"{DAY_FRAME} SELECT symbol, {D}, {q6(ema('close', 21), 'ema_21', 5)} FROM f")
def ema_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = bars.in_chunks(frames.day_bars(spark, sf_dir), 400, 1).withColumn("s_c", finite("close"))
    return factors.ema_in_chunks(df, "s_c", 21, "ema_21").select("symbol", day().alias("d"), r6(F.col("ema_21"), "ema_21", 5))


# Views.
_tsz = f"CASE WHEN count(mom_5) OVER ({WS} ROWS 119 PRECEDING) >= 30 THEN (mom_5 - avg(mom_5) OVER ({WS} ROWS 119 PRECEDING)) / (stddev_samp(mom_5) OVER ({WS} ROWS 119 PRECEDING) + 1e-8) END"


@query("v01_tsz", f"{PANEL} SELECT symbol, {D}, {q6(_tsz, 'tsz_mom_5')} FROM panel")
def tsz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.add_views(frames.panel(spark, sf_dir, ["mom_5"]), tsz_of=["mom_5"]).select("symbol", day().alias("d"), r6(F.col("tsz_mom_5"), "tsz_mom_5"))


@query("v03_csz", f"{PANEL} SELECT symbol, {D}, {q6(xz('mom_5'), 'csz_mom_5')}, {q6(xz('volz_6'), 'csz_volz_6')} FROM panel")
def csz(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.add_views(frames.panel(spark, sf_dir, ["mom_5", "volz_6"]), csz_of=["mom_5", "volz_6"])
    return df.select("symbol", day().alias("d"), *(r6(F.col(x), x) for x in ("csz_mom_5", "csz_volz_6")))


@query("v04_csr", f"{PANEL} SELECT symbol, {D}, {q6(xrank('mom_5'), 'csr_mom_5')}, {q6(xrank('cpos'), 'csr_cpos')} FROM panel")
def csr(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.add_views(frames.panel(spark, sf_dir, ["mom_5", "cpos"]), csr_of=["mom_5", "cpos"])
    return df.select("symbol", day().alias("d"), *(r6(F.col(x), x) for x in ("csr_mom_5", "csr_cpos")))


@query("v05_v06_v07_expression_inputs", f"{PANEL} SELECT symbol, {D}, {q6(xrank('rv_5'), 'xrank_rv_5')}, {q6(xz('rsi_8'), 'xz_rsi_8')} FROM panel")
def expression_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [expressions.make_expression("rank_add", "rv_5", "rv_5"), expressions.make_expression("z_add", "rsi_8", "rsi_8")]
    df = expressions.precompute(frames.panel(spark, sf_dir, ["rv_5", "rsi_8"]), exprs)
    return df.select("symbol", day().alias("d"), r6(F.col("_xrank_rv_5"), "xrank_rv_5"), r6(F.col("_xz_rsi_8"), "xz_rsi_8"))


@query("v08_prediction_views", f"{PANEL} SELECT symbol, {D}, {q6(xz('rv_5', '1e-9'), 'pred_xsz')}, {q6(xrank('rv_5'), 'pred_xrank')} FROM panel")
def prediction_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.prediction_views(frames.panel(spark, sf_dir, ["rv_5"]).withColumnRenamed("rv_5", "pred"))
    return df.select("symbol", day().alias("d"), r6(F.col("pred_xsz"), "pred_xsz"), r6(F.col("pred_xrank"), "pred_xrank"))


LABEL_XSZ = f"(CASE WHEN {xz('label', '1e-9')} IS NOT NULL THEN greatest(-8, least(8, {xz('label', '1e-9')})) END)"


@query("v09_label_views", f"{DAY_LABELS} SELECT symbol, {D}, {q6(LABEL_XSZ, 'label_xsz')}, {q6(xrank('label'), 'label_xrank')} FROM lab")
def label_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.label_views(frames.day_labels(spark, sf_dir)).select("symbol", day().alias("d"), r6(F.col("label_xsz"), "label_xsz"), r6(F.col("label_xrank"), "label_xrank"))


EVENTS = (
    f", e0 AS (SELECT *, coalesce(ln(abs(close) / abs(open)), 0) AS mv, coalesce((high - low) / nullif(abs(close), 0), 0) AS rg, ln(1 + greatest(amount, 0)) AS la, strftime(datetime, '%Y-%m') AS month FROM lab), "
    f"e1 AS (SELECT *, {' + '.join(f'{k} * CASE WHEN abs({xz(x, repr(1e-9))}) > 8 THEN 8 ELSE abs({xz(x, repr(1e-9))}) END' for x, k in (('mv', '1'), ('rg', '1'), ('la', '0.5')))} AS event_score, "
    "count(*) OVER (PARTITION BY symbol, month) - row_number() OVER (PARTITION BY symbol, month ORDER BY datetime) AS left_bars FROM e0)"
)


@query("v10_v11_event_score", f"{DAY_LABELS}{EVENTS} SELECT symbol, {D}, {q6('event_score', 'event_score')}, left_bars::INT AS bars_to_month_end FROM e1")
def event_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.event_scores(frames.day_labels(spark, sf_dir).withColumn("month", F.date_format("datetime", "yyyy-MM")))
    return df.select("symbol", day().alias("d"), r6(F.col("event_score"), "event_score"), "bars_to_month_end")


TURN = f", t0 AS (SELECT symbol, datetime, {xrank('mom_5')} + 0.5 AS pct FROM panel WHERE mom_5 IS NOT NULL), t1 AS (SELECT symbol, datetime, CASE WHEN pct >= 0.8 THEN 1 WHEN pct <= 0.2 THEN -1 ELSE 0 END AS s FROM t0), t2 AS (SELECT abs(s - lag(s) OVER ({WS})) AS d FROM t1)"


@query("v12_turnover_proxy", f"{PANEL}{TURN} SELECT {q6('CASE WHEN count(*) >= 100 THEN avg(d) END', 'turnover_proxy')} FROM t2")
def turnover_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.turnover(frames.panel(spark, sf_dir, ["mom_5"]), "mom_5").select(r6(F.col("turnover_proxy"), "turnover_proxy"))


def tercile(x: str, words: tuple[str, str, str]) -> str:
    r = f"(row_number() OVER (PARTITION BY {x} IS NULL ORDER BY {x}, datetime, symbol) - 1)"
    m = f"count({x}) OVER ()"
    return f"CASE WHEN {x} IS NULL THEN 'nan' WHEN 3 * {r} < {m} - 1 THEN '{words[0]}' WHEN 3 * {r} < 2 * ({m} - 1) THEN '{words[1]}' ELSE '{words[2]}' END"


REGIMES = f"rg0 AS (SELECT *, abs(high - low) / nullif(abs(close), 0) AS spread FROM {{}}), rg AS (SELECT *, {tercile('volume', ('low_liq', 'mid_liq', 'high_liq'))} AS liquidity, {tercile('spread', ('low_vol', 'mid_vol', 'high_vol'))} AS volatility FROM rg0)"


@query("v13_regimes", f"{DAY_LABELS}, {REGIMES.format('lab')} SELECT symbol, {D}, liquidity, volatility FROM rg")
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.regimes(frames.day_labels(spark, sf_dir)).select("symbol", day().alias("d"), "liquidity", "volatility")


@query("v14_product_code", "SELECT DISTINCT p_brand AS s, CASE WHEN regexp_extract(p_brand, '^([A-Za-z]+)', 1) <> '' THEN upper(regexp_extract(p_brand, '^([A-Za-z]+)', 1)) ELSE upper(p_brand) END AS product FROM part UNION SELECT DISTINCT (l_suppkey % 20) || 'x', upper((l_suppkey % 20) || 'x') FROM lineitem")
def product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = frames.table(spark, sf_dir, "part").select(F.col("p_brand").alias("s"))
    b = frames.table(spark, sf_dir, "lineitem").select(F.concat((F.col("l_suppkey") % 20).cast("string"), F.lit("x")).alias("s"))
    return a.union(b).distinct().select("s", views.product_code("s").alias("product"))


# Predicates and projections.
@query("f01_f02_date_symbol_filter", f"{DAY_LABELS} SELECT symbol, {D}, {q6('close', 'close')} FROM lab WHERE datetime >= TIMESTAMP '1996-01-01' AND datetime < TIMESTAMP '1996-07-01' AND symbol IN ('S1', 'S2', 'S5')")
def date_symbol_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames.day_labels(spark, sf_dir)
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return df.where((F.col("datetime") >= at("1996-01-01")) & (F.col("datetime") < at("1996-07-01")) & F.col("symbol").isin("S1", "S2", "S5")).select("symbol", day().alias("d"), r6(F.col("close"), "close"))


@query("f03_f04_labelled_finite", f"{PANEL} SELECT month, count(*) AS n, {q6('avg(mom_5)', 'mean')} FROM panel WHERE label IS NOT NULL AND mom_5 IS NOT NULL GROUP BY month")
def labelled_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = frames.panel(spark, sf_dir, ["mom_5"]).where(finite("label").isNotNull() & finite("mom_5").isNotNull())
    return df.groupBy("month").agg(F.count("*").alias("n"), r6(F.avg("mom_5"), "mean"))


@query("f05_session_mask", f"{PANEL} SELECT symbol, count(*) AS n, count(mom_5) AS known, count(*) FILTER (WHERE bss < 5 AND mom_5 IS NOT NULL) AS leaks FROM panel GROUP BY symbol")
def session_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.panel(spark, sf_dir, ["mom_5"]).groupBy("symbol").agg(F.count("*").alias("n"), F.count("mom_5").alias("known"), F.count_if((F.col("bss") < 5) & F.col("mom_5").isNotNull()).alias("leaks"))


@query("f06_scrub", f"{PANEL} SELECT symbol, {D}, {q6('coalesce(mom_5, 0)', 'mom_5')}, {q6('coalesce(volz_6, 0)', 'volz_6')} FROM panel")
def scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.panel(spark, sf_dir, ["mom_5", "volz_6"]).select("symbol", day().alias("d"), r6(zero("mom_5"), "mom_5"), r6(zero("volz_6"), "volz_6"))


@query("f14_float32", f"{PANEL} SELECT symbol, {D}, round(mom_5::FLOAT::DOUBLE, 5) + 0.0 AS mom_5 FROM panel")
def float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.panel(spark, sf_dir, ["mom_5"]).select("symbol", day().alias("d"), r6(F.col("mom_5").cast("float").cast("double"), "mom_5", 5))


# Expressions over the panel.
A, B = "mom_5", "volz_6"
RA, RB, ZA, ZB = xrank(A), xrank(B), xz(A), xz(B)
OP_SQL = {
    "rank_add": "ra + rb", "rank_spread": "ra - rb", "rank_product": "ra * rb", "rank_gate_pos": "CASE WHEN rb > 0 THEN ra ELSE 0 END", "rank_gate_neg": "CASE WHEN rb < 0 THEN ra ELSE 0 END",
    "z_add": "za + zb", "z_spread": "za - zb", "z_product": "za * zb",
}


def _expression(op: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = expressions.make_expression(op, A, B)
        return expressions.evaluate(frames.panel(spark, sf_dir, [A, B]), [e]).select("symbol", day().alias("d"), r6(F.col(e["name"]), "value"))

    return run


for _i, (_op, _sql) in enumerate(OP_SQL.items(), 1):
    QUERIES[f"e{_i:02d}_{_op}"] = _expression(_op)
    ORACLES[f"e{_i:02d}_{_op}"] = f"{PANEL}, x AS (SELECT symbol, datetime, {RA} AS ra, {RB} AS rb, {ZA} AS za, {ZB} AS zb FROM panel) SELECT symbol, {D}, {q6(_sql, 'value')} FROM x"


@query("e09_safe_name", "SELECT o.op, r.r_name AS lname, n.n_name AS rname, 'nf_' || o.op || '_' || substr(sha1(o.op || ':' || r.r_name || ':' || n.n_name), 1, 10) AS name FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey CROSS JOIN (VALUES ('rank_add'), ('z_add')) o(op)")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = frames.table(spark, sf_dir, "region"), frames.table(spark, sf_dir, "nation")
    df = r.join(n, r.r_regionkey == n.n_regionkey).select(F.explode(F.array(F.lit("rank_add"), F.lit("z_add"))).alias("op"), F.col("r_name").alias("left"), F.col("n_name").alias("right"))
    return df.withColumn("name", expressions.name_column()).withColumnsRenamed({"left": "lname", "right": "rname"})


@query("e11_expression_block", f"{PANEL}, x AS (SELECT symbol, datetime, {RA} AS ra, {RB} AS rb, {ZA} AS za, {ZB} AS zb FROM panel) SELECT symbol, {D}, {', '.join(q6(v, k) for k, v in OP_SQL.items())} FROM x")
def expression_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = [expressions.make_expression(op, A, B) for op in OP_SQL]
    df = expressions.evaluate(frames.panel(spark, sf_dir, [A, B]), exprs)
    return df.select("symbol", day().alias("d"), *(r6(F.col(e["name"]), e["op"]) for e in exprs))


