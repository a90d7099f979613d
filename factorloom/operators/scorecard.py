"""The scorecard of candidate factors on a sample: evidence, gates, grade, score and the pick of unlike ones.

Evidence is gathered in long form (one row per candidate and sample row), grouped by candidate name: candidates are
spread over the tasks, and a sample's rows are bounded by how it is drawn.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, finite, is_finite, sdiv
from .ic import TINY, pearson
from .linalg import correlations
from .views import product_code, regimes, xrank


@dataclass(frozen=True)
class Thresholds:
    """What the gates ask for by default."""

    min_coverage: float = 0.70
    min_abs_ic: float = 0.001
    min_abs_rank_ic: float = 0.0005
    min_monthly_hit_rate: float = 0.50
    min_monthly_ic_count: int = 6
    min_product_hit_rate: float = 0.45
    min_regime_hit_rate: float = 0.40
    min_bucket_monotonicity: float = 0.25
    max_abs_corr: float = 0.90
    max_outlier_ratio: float = 0.02
    max_turnover_proxy: float = 0.85
    min_abs_residual_ic: float = 0.001


KEYS = ["symbol", "datetime", "month", "product", "liquidity", "volatility", "label"]


def sample_frame(sample: DataFrame) -> DataFrame:
    """Adds month, product and the two regimes to sampled rows."""
    return regimes(sample.withColumns({"month": F.date_format("datetime", "yyyy-MM"), "product": product_code("symbol")}))


def long(frame: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    return frame.select(*(keys or KEYS), *(F.col(n).cast("double").alias(n) for n in names)).unpivot(keys or KEYS, names, "name", "value")


def coverage(rows: DataFrame, far: float = 8.0) -> DataFrame:
    """name, coverage, mean, std (population), outlier_ratio: the share beyond far spreads, 1 where there is no spread."""
    x = finite("value")
    s = rows.groupBy("name").agg(F.count("*").alias("_n"), F.count(x).alias("_k"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    out = rows.join(s, "name").groupBy("name").agg(F.avg((F.abs((x - F.col("mean")) / F.col("std")) > far).cast("double")).alias("_out")) if rows.columns else s
    s = s.join(out, "name")
    ratio = F.when(F.col("std") > 1e-12, F.coalesce("_out", F.lit(0.0))).otherwise(1.0)
    return s.select("name", sdiv(F.col("_k").cast("double"), F.col("_n").cast("double")).alias("coverage"), "mean", "std", ratio.alias("outlier_ratio"))


def pearson_ic(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(pearson("value", "label").alias("pearson_ic"))


def rank_ic(rows: DataFrame) -> DataFrame:
    """Spearman's: Pearson's of average ranks over all pairs of a candidate's sample."""
    both = rows.where(is_finite("value") & is_finite("label")).select("name", "value", "label")
    ranked = both.select("name", xrank("value", ("name",)).alias("a"), xrank("label", ("name",)).alias("b"))
    return ranked.groupBy("name").agg(pearson("a", "b").alias("rank_ic"))


def _hit_rate(ic: str) -> Column:
    """Share of ICs with the sign of their mean; a mean of zero counts as positive."""
    mean = F.avg(ic)
    up, down, n = F.sum((F.col(ic) > 0).cast("int")), F.sum((F.col(ic) < 0).cast("int")), F.count(ic)
    return F.coalesce(F.when(mean < 0, down).otherwise(up) / n, F.lit(0.0))


def monthly_ic(rows: DataFrame) -> DataFrame:
    """monthly_ic_worst is the IC of the least size, not the most adverse one."""
    per = rows.groupBy("name", "month").agg(pearson("value", "label").alias("ic"))
    one = F.when(F.count("ic") > 1, F.stddev_samp("ic")).when(F.count("ic") == 1, 0.0)
    return per.groupBy("name").agg(
        F.avg("ic").alias("monthly_ic_mean"), one.alias("monthly_ic_std"), _hit_rate("ic").alias("monthly_ic_hit_rate"),
        F.min_by("ic", F.when(F.col("ic").isNotNull(), F.struct(F.abs("ic"), F.col("month")))).alias("monthly_ic_worst"), F.count("ic").alias("monthly_ic_count"),
    )


GROUPS = {"product": "product", "liquidity": "liquidity_regime", "volatility": "volatility_regime"}


def grouped_ic(rows: DataFrame) -> DataFrame:
    """ICs within products and regimes, all dimensions in one pass: <prefix>_ic_mean, _ic_min_abs, _ic_hit_rate, _count."""
    each = rows.select("name", "value", "label", F.explode(F.array(*(F.struct(F.lit(p).alias("dim"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("key")) for c, p in GROUPS.items()))).alias("g"))
    per = each.groupBy("name", "g.dim", "g.key").agg(pearson("value", "label").alias("ic"))
    s = per.groupBy("name", "dim").agg(F.avg("ic").alias("mean"), F.min(F.abs("ic")).alias("least"), _hit_rate("ic").alias("hit"), F.count("ic").alias("n"))
    pick = lambda p, k: F.first(F.when(F.col("dim") == p, F.col(k)), ignorenulls=True)
    return s.groupBy("name").agg(*(e for p in GROUPS.values() for e in (pick(p, "mean").alias(f"{p}_ic_mean"), pick(p, "least").alias(f"{p}_ic_min_abs"), F.coalesce(pick(p, "hit"), F.lit(0.0)).alias(f"{p}_ic_hit_rate"), F.coalesce(pick(p, "n"), F.lit(0)).alias(f"{p}_count"))))


def buckets(rows: DataFrame, n: int = 5) -> DataFrame:
    """Mean label of rank buckets across each time: spread of top over bottom, monotonicity, share of the extremes."""
    ok = rows.where(is_finite("value") & is_finite("label")).select("name", "datetime", "value", "label")
    pct = xrank("value", ("name", "datetime")) + 0.5
    b = F.least(F.floor(pct * n + 1e-12).cast("int"), F.lit(n - 1))
    means = ok.withColumn("b", b).groupBy("name", "b").agg(F.avg("label").alias("m"), F.count("*").alias("k"))
    at = lambda i: F.max(F.when(F.col("b") == i, F.col("m")))
    s = means.groupBy("name").agg(F.sum("k").alias("rows"), F.count("*").alias("have"), (at(n - 1) - at(0)).alias("spread"), pearson(F.col("b").cast("double"), "m").alias("mono"), sdiv(F.greatest(F.abs(at(0)), F.abs(at(n - 1))), F.sum(F.abs("m")) + TINY).alias("extreme"))
    full = (F.col("rows") >= n * 20) & (F.col("have") == n)
    return s.select("name", F.when(full, F.col("spread")).alias("bucket_top_bottom_spread"), F.when(full, F.col("mono")).alias("bucket_monotonicity"), F.when(full, F.col("extreme")).alias("bucket_extreme_contribution"))


def turnover(rows: DataFrame, quantile: float = 0.2, least: int = 100) -> DataFrame:
    """Mean change of the -1/0/1 signal between a symbol's sampled rows, which need not be adjacent bars."""
    ok = rows.where(is_finite("value")).select("name", "symbol", "datetime", "value")
    pct = xrank("value", ("name", "datetime")) + 0.5
    ok = ok.withColumn("s", F.when(pct >= 1 - quantile, 1.0).when(pct <= quantile, -1.0).otherwise(0.0))
    step = F.abs(F.col("s") - F.lag("s").over(Window.partitionBy("name", "symbol").orderBy("datetime")))
    return ok.withColumn("d", step).groupBy("name").agg(F.when(F.count("*") >= least, F.avg("d")).alias("turnover_proxy"))


def closest(frame: DataFrame, names: list[str], library: list[str], spark: SparkSession | None = None) -> DataFrame:
    """name, max_abs_corr_to_library, max_corr_to_library, closest_library_factor, library_factors_compared."""
    spark = spark or frame.sparkSession
    schema = "name string, max_abs_corr_to_library double, max_corr_to_library double, closest_library_factor string, library_factors_compared int"
    if not library:
        return spark.createDataFrame([(n, 0.0, 0.0, "", 0) for n in names], schema)
    m = correlations(frame, names, library)
    best = abs(m).argmax(axis=1)
    return spark.createDataFrame([(n, float(abs(m[i, j])), float(m[i, j]), library[j], len(library)) for i, (n, j) in enumerate(zip(names, best))], schema)


def residual_ic(frame: DataFrame, names: list[str], near: DataFrame, library: list[str]) -> DataFrame:
    """The IC of what one regression on the closest library factor leaves; the plain IC where there is none."""
    lib = F.map_from_arrays(F.array(*map(F.lit, library)), F.array(*(F.col(x).cast("double") for x in library))) if library else F.lit(None).cast("map<string,double>")
    rows = frame.withColumn("_lib", lib)
    rows = rows.select("label", "_lib", *(F.col(n).cast("double").alias(n) for n in names)).unpivot(["label", "_lib"], names, "name", "value") if names else rows
    rows = rows.join(F.broadcast(near.select("name", "closest_library_factor")), "name")  # one row a candidate
    x, y = finite("value"), finite("label")
    z = finite(F.try_element_at("_lib", F.col("closest_library_factor")))
    ok = x.isNotNull() & y.isNotNull() & z.isNotNull()
    a, b, c = (F.when(ok, v) for v in (x, z, y))
    n, szz = F.count(a), F.var_pop(b)
    beta = sdiv(F.covar_pop(a, b), szz)
    left = F.var_pop(a) - beta * F.covar_pop(a, b)
    resid = sdiv(F.covar_pop(a, c) - beta * F.covar_pop(b, c), F.sqrt(F.greatest(left, F.lit(0.0)) * F.var_pop(c)))
    none = F.max("closest_library_factor") == ""
    value = F.when(none, pearson("value", "label")).when(n < 10, None).when(szz * n <= TINY, pearson("value", "label")).otherwise(F.when(left > 1e-12 * F.var_pop(a), resid))
    return rows.groupBy("name").agg(value.alias("residual_ic"))


def scorecard(sample: DataFrame, names: list[str], library: list[str]) -> DataFrame:
    """One row per candidate with all evidence. sample: rows of bars with label, candidates and library factors."""
    need = dict.fromkeys(["symbol", "datetime", "label", "volume", "high", "low", "close", *names, *library])
    frame = sample_frame(sample.select(*need).persist()).persist()  # a bounded sample; regimes look at it more than once
    rows = long(frame, names)
    near = closest(frame, names, library)
    parts = [coverage(rows), pearson_ic(rows), rank_ic(rows), turnover(rows), near, residual_ic(frame, names, near, library), monthly_ic(rows), grouped_ic(rows), buckets(rows)]
    return reduce(lambda a, b: a.join(b, "name", "left"), parts)


def _or(name: str, missing: float, compat: bool) -> Column:
    """A value with a stand-in where it is missing; in compat also where it is 0, as the gates once had it."""
    x = finite(name)
    return F.coalesce(F.when(x != 0, x) if compat else x, F.lit(float(missing)))


GATES = ["data_quality", "ic", "bucket", "regime", "trading", "incremental", "robustness"]
REASONS = ["data", *GATES[1:]]


def flags(cards: DataFrame, t: Thresholds = Thresholds(), strict_compat: bool = False) -> DataFrame:  # noqa: B008
    """Adds pass_* for the seven gates and decision_reason. cards has selection_ic, same_sign and the scorecard's columns;
    candidate_peer_max_abs_corr counts as 0 where it is missing."""
    for x in ("candidate_peer_max_abs_corr",):
        cards = cards if x in cards.columns else cards.withColumn(x, F.lit(0.0))
    v = lambda name, missing=0.0: _or(name, missing, strict_compat)
    ic, same = v("selection_ic"), F.coalesce("same_sign", F.lit(False))
    data = (v("coverage") >= t.min_coverage) & (v("outlier_ratio", 1.0) <= t.max_outlier_ratio) & (v("std") > 1e-8)
    hit = (F.abs(ic) >= t.min_abs_ic) & (F.abs(v("rank_ic")) >= t.min_abs_rank_ic) & (v("monthly_ic_hit_rate") >= t.min_monthly_hit_rate) & (v("monthly_ic_count") >= t.min_monthly_ic_count)
    spread = finite("bucket_top_bottom_spread")
    bucket = F.coalesce(F.signum(F.coalesce(spread, F.lit(0.0) if strict_compat else F.lit(None))) == F.signum(ic), F.lit(False)) & (F.abs(v("bucket_monotonicity")) >= t.min_bucket_monotonicity)
    regime = (v("product_ic_hit_rate") >= t.min_product_hit_rate) & (v("liquidity_regime_ic_hit_rate") >= t.min_regime_hit_rate) & (v("volatility_regime_ic_hit_rate") >= t.min_regime_hit_rate)
    trading = F.coalesce(finite("turnover_proxy") <= t.max_turnover_proxy, F.lit(True))
    unlike = (v("max_abs_corr_to_library", 1.0) <= t.max_abs_corr) & (v("candidate_peer_max_abs_corr") <= t.max_abs_corr)
    incremental = unlike | (F.abs(v("residual_ic")) >= t.min_abs_residual_ic)
    gates = dict(zip(GATES, (data, same & hit, bucket, regime, trading, incremental)))
    out = cards.withColumns({f"pass_{k}": g for k, g in gates.items()})
    out = out.withColumn("pass_robustness", F.col("pass_ic") & F.col("pass_incremental"))
    why = F.concat_ws(",", *(F.when(~F.col(f"pass_{g}"), f"fail_{r}") for g, r in zip(GATES, REASONS)))
    return out.withColumn("decision_reason", F.when(why == "", "pass_all").otherwise(why))


def grade(t: Thresholds = Thresholds(), strict_compat: bool = False) -> Column:  # noqa: B008
    """A to E from the flags."""
    ic, hit = F.abs(_or("selection_ic", 0, strict_compat)), _or("monthly_ic_hit_rate", 0, strict_compat)
    rest = reduce(lambda a, b: a & b, (F.col(f"pass_{g}") for g in GATES[1:]))
    core = F.col("pass_ic") & F.col("pass_incremental")
    return (
        F.when(~F.col("pass_data_quality"), "E").when(rest, F.when((ic >= 2 * t.min_abs_ic) & (hit >= 0.58), "A").otherwise("B"))
        .when(core & F.col("pass_robustness") & (F.col("pass_bucket") | F.col("pass_regime")), "B").when(core, "C")
        .when(F.coalesce("same_sign", F.lit(False)) & (ic >= 0.5 * t.min_abs_ic), "D").otherwise("E")
    )


def score(t: Thresholds = Thresholds(), strict_compat: bool = False) -> Column:  # noqa: B008
    """The weighted score of a graded row (final_grade), from its parts within 0 and 1."""
    v = lambda name, missing=0.0: _or(name, missing, strict_compat)
    strong = lambda name: clamp01(F.abs(v(name)) / max(5 * t.min_abs_ic, 1e-9))
    calm = F.when(finite("turnover_proxy").isNull(), 0.5).otherwise(clamp01(1 - finite("turnover_proxy")))
    corr = clamp01(1 - v("max_abs_corr_to_library", 1.0) / max(t.max_abs_corr, 1e-9))
    parts = [
        (0.10, clamp01((v("coverage") - t.min_coverage) / 0.30)), (0.05, clamp01(1 - v("outlier_ratio", 1.0) / max(t.max_outlier_ratio, 1e-9))), (0.16, strong("selection_ic")), (0.10, strong("rank_ic")),
        (0.14, clamp01(v("monthly_ic_hit_rate"))), (0.12, clamp01(v("product_ic_hit_rate"))), (0.12, clamp01(F.abs(v("bucket_monotonicity")))), (0.13, F.greatest(corr, strong("residual_ic"))), (0.08, calm),
    ]
    total = sum((w * x for w, x in parts), F.when(F.coalesce("same_sign", F.lit(False)), 0.05).otherwise(-0.10))
    return total * F.when(F.col("final_grade") == "E", 0.25).otherwise(1.0)


def judged(cards: DataFrame, t: Thresholds = Thresholds(), strict_compat: bool = False) -> DataFrame:  # noqa: B008
    """flags(), final_grade and composite_score."""
    out = flags(cards, t, strict_compat).withColumn("final_grade", grade(t, strict_compat))
    return out.withColumn("composite_score", score(t, strict_compat))


def select_unlike(cards: DataFrame, frame: DataFrame, ops: dict[str, str], target: int, t: Thresholds = Thresholds(), pool: int = 800, max_per_op: int = 20) -> DataFrame:  # noqa: B008
    """Adds selected and candidate_peer_max_abs_corr: candidates that pass all gates, best first, each unlike those before.

    Correlations of the pool are one distributed matrix product; the greedy pick needs each verdict before the next, so
    it runs on the driver over a pool of bounded size. A rejected candidate's flags are then worked out anew.
    """
    ranked = cards.where("decision_reason = 'pass_all'").orderBy(F.desc("composite_score"), F.desc(F.abs("selection_ic")), "name").limit(pool)
    names = [r["name"] for r in ranked.select("name").collect()]
    m = correlations(frame, names, names) if names else None
    chosen, used, peer = [], {}, {}
    for i, n in enumerate(names):
        if len(chosen) >= target:
            break
        op = ops.get(n, "")
        if max_per_op and used.get(op, 0) >= max_per_op:
            continue
        peer[n] = float(max((abs(m[i, j]) for j in chosen), default=0.0))
        if peer[n] <= t.max_abs_corr:
            chosen.append(i)
            used[op] = used.get(op, 0) + 1
    picked = {names[i] for i in chosen}
    spark = cards.sparkSession
    told = spark.createDataFrame([(n, x, n in picked) for n, x in peer.items()], "name string, _peer double, _sel boolean")
    base = cards.drop(*(c for c in cards.columns if c.startswith("pass_")), "decision_reason", "candidate_peer_max_abs_corr", "final_grade", "composite_score")
    out = base.join(F.broadcast(told), "name", "left").withColumn("candidate_peer_max_abs_corr", F.col("_peer")).withColumn("selected", F.coalesce("_sel", F.lit(False))).drop("_peer", "_sel")
    return judged(out, t)
