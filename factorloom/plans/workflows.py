"""The commands of the engine as functions on a SparkSession: one application, no process or file between the stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import backtest, expressions, factors, ic, models, sampling, scorecard, sessions, views
from ..sources import bars, reports, store
from ..sources.store import Config, FactorSpec, FactorStore


#: Rows of a symbol's series that one task works on, and rows before them that its windows look back on.
CHUNK_ROWS, HALO = 50_000, 400
#: From so many factors on those that wide_panel() makes come from it.
WIDE_FROM = 100


def with_factors(labelled: DataFrame, wanted: list[str], chunk_rows: int = CHUNK_ROWS, wide_from: int = WIDE_FROM) -> DataFrame:
    """Adds the factors to labelled bars. Series are cut into chunks, so a symbol of any share of the rows is spread over tasks;
    exponential means are carried over chunks; many factors at once are made in Arrow batches."""
    keys, cut = ("symbol", "chunk"), lambda df: bars.in_chunks(df, chunk_rows, HALO)
    df = factors.base_series(cut(labelled), keys)
    if spans := factors.ema_spans(wanted):
        own = factors.emas_in_chunks(df, spans).drop("chunk", "is_halo", "idx")
        df = cut(own)
    can = set(factors.wide_names())
    many = [x for x in wanted if x in can]
    many = many if len(many) >= wide_from else []
    out = factors.add_factors(df, [x for x in wanted if x not in set(many)], keys).where(~F.col("is_halo"))
    if many:
        out = out.join(factors.wide_panel(df, many), ["symbol", "datetime"])
    return out.drop("chunk", "is_halo", "idx")


def build_panel(
    rows: DataFrame, spec: FactorSpec, start: str | None = None, end: str | None = None, gap_minutes: float = sessions.LONG_BREAK, horizon: int = sessions.HORIZON, blank: int = sessions.BLANK_BARS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sessions, labels, factors and trailing views of bars; the half-open date range is cut after the factors and before
    the trailing views, which so warm up within it."""
    known = set(factors.names())
    wanted = [b for b in dict.fromkeys([*spec.raw, *spec.tsz, *spec.csz, *spec.csr]) if b in known]
    df = with_factors(sessions.labels(sessions.sessions(rows, gap_minutes), horizon, blank), wanted, chunk_rows)
    if start:
        df = df.where(F.col("datetime") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col("datetime") < F.lit(end).cast("timestamp_ntz"))
    meta = [x for x in store.META if x in df.columns]
    tsz = {f"tsz_{x}": views.tsz(x) for x in spec.tsz if x in known}
    return df.select(*meta, *(F.col(x).cast("float").alias(x) for x in wanted), *(v.cast("float").alias(k) for k, v in tsz.items()))


def build_partitions(spark: SparkSession, rows: DataFrame, conf: Config, spec: FactorSpec, overwrite: bool = True, **kw) -> None:
    """Without overwrite, months that are there stay and the build goes on with the others."""
    store.write_panel(build_panel(rows.where(~F.col("symbol").isin(list(conf.excluded))), spec, horizon=conf.horizon, **kw), conf.panel, overwrite)


def materialize_final(spark: SparkSession, conf: Config, spec: FactorSpec, path: str, start: str | None = None, end: str | None = None) -> None:
    store.write_final(FactorStore(spark, conf.panel, spec).read(start, end), path)


def audit_data(st: FactorStore, conf: Config) -> DataFrame:
    """The store's audit with the number of months in each range."""
    count = lambda a, b: F.lit(len(st.months(a, b)))
    return st.audit().withColumns({"is_months": count(conf.is_start, conf.is_end), "oos_months": count(conf.oos_start, conf.oos_end)})


def mine_factors(panel: DataFrame, names: list[str], conf: Config, catalog: DataFrame | None = None, **least) -> DataFrame:
    """Both ranges' ICs from one pass of monthly sums, joined, judged and catalogued."""
    sums = ic.sufficient_stats(panel, names).persist()
    parts = [ic.merge_stats(sums.where(F.col("month").between(a, b)), p) for a, b, p in ((conf.is_start, conf.is_end, "is_"), (conf.oos_start, conf.oos_end, "oos_"))]
    return ic.attach_catalog(ic.effective_factors(*parts, **least), catalog)


def fit_models(train: DataFrame, features: list[str], kinds: list[str], label: str = "label") -> dict:
    made = {}
    for k in kinds:
        if k == "ridge":
            made[k] = models.fit_ridge(train, features, label=label)
        elif k == "trees":
            made[k] = models.Trees(features).fit(train, label)
        elif k == "net":
            made[k] = models.Net(features).fit(train, label)
        else:
            raise ValueError(f"no such model: {k}")
    return made


def predict(df: DataFrame, made: dict) -> DataFrame:
    """symbol, datetime, label, model, pred, pred_xsz, pred_xrank of all models."""
    out = None
    for k, m in made.items():
        rows = df.withColumn("pred", m.predict()) if isinstance(m, models.Ridge) else m.transform(df)
        rows = views.prediction_views(rows.select("symbol", "datetime", "label", F.lit(k).alias("model"), "pred"))
        out = rows if out is None else out.unionByName(rows)
    return out


def summarize(preds: DataFrame, kinds: list[str]) -> DataFrame:
    """One row per model and view of the prediction: ICs in total, by month and by year."""
    out = None
    for k in kinds:
        s = ic.summarize_predictions(preds.where(F.col("model") == k), ["pred", "pred_xsz", "pred_xrank"]).withColumn("model", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def baseline(panel: DataFrame, features: list[str], conf: Config, kinds: list[str] = ["ridge"], rows_per_month: int = 3000) -> dict[str, DataFrame]:  # noqa: B006
    """Sample the training range, fit, predict the test range, summarise and backtest."""
    train = sampling.sample_rows(panel.where(F.col("month").between(conf.is_start, conf.is_end)), rows_per_month, seed=conf.seed)
    preds = predict(panel.where(F.col("month").between(conf.oos_start, conf.oos_end)), fit_models(train, features, kinds)).persist()
    bts = None
    for k in kinds:
        b = backtest.summarize(backtest.long_short(preds.where(F.col("model") == k))).withColumn("model", F.lit(k))
        bts = b if bts is None else bts.unionByName(b)
    return {"predictions": preds, "summary": summarize(preds, kinds), "backtest": bts}


def feature_sets(scores: DataFrame, sizes: list[int], everything: list[str], new: DataFrame | None = None) -> dict[str, list[str]]:
    """orig_top<n> by |IC| in sample, orig_effective and orig_all; with new factors (factor, abs_is_ic) also new_top<n> of both
    ranked together, and the other two with the new ones added once."""
    pick = ["factor", "abs_is_ic"]
    ranked = lambda df: [r.factor for r in df.orderBy(F.desc_nulls_last("abs_is_ic"), "factor").select("factor").collect()]  # noqa: E731  a factor list
    effective = ranked(scores.where("effective"))
    top = ranked(scores)
    sets = {f"orig_top{n}": top[:n] for n in sizes} | {"orig_effective": effective, "orig_all": list(everything)}
    if new is None:
        return sets
    both, names = ranked(scores.select(*pick).unionByName(new.select(*pick))), ranked(new)
    return sets | {f"new_top{n}": both[:n] for n in sizes} | {"new_effective": list(dict.fromkeys(effective + names)), "new_all": list(dict.fromkeys([*everything, *names]))}


def ic_parts(panel: DataFrame, names: list[str], path: str, prefix: str, start: str, end: str, force: bool = False) -> DataFrame:
    """Monthly IC sums kept as a table by prefix and month: months that are there are read, the rest are added in one job."""
    spark, rows = panel.sparkSession, panel.where(F.col("month").between(start, end))
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)
    schema = "factor string, xy double, xx double, yy double, count long, prefix string, month string"
    have = spark.read.schema(schema).parquet(path).where(F.col("prefix") == prefix) if there else None
    done = [] if have is None or force else [r.month for r in have.select("month").distinct().collect()]
    todo = rows.where(~F.col("month").isin(done)) if done else rows
    made = ic.sufficient_stats(todo, names).withColumn("prefix", F.lit(prefix)).select("factor", "xy", "xx", "yy", "count", "prefix", "month")
    with_mode = made.write.option("partitionOverwriteMode", "dynamic").mode("overwrite")
    with_mode.partitionBy("prefix", "month").parquet(path)
    return spark.read.schema(schema).parquet(path).where((F.col("prefix") == prefix) & F.col("month").between(start, end))


def aggregate_expressions(parts: DataFrame, candidates: DataFrame, min_is: float = 0.002, min_oos: float = 0.001, min_coverage: float = 0.5, top: int | None = None) -> DataFrame:
    """Scores of expressions from parts with prefixes is and oos, with their formulas, best first."""
    sides = [ic.merge_stats(parts.where(F.col("prefix") == p), f"{p}_") for p in ("is", "oos")]
    scores = ic.effective_factors(*sides, min_is, min_oos, min_coverage, ordered=False).withColumnRenamed("factor", "name")
    out = scores.join(candidates, "name", "left").orderBy(F.desc("effective"), F.desc_nulls_last("abs_is_ic"), "name")
    return out.limit(top) if top else out


def incremental(panel: DataFrame, sets: dict[str, list[str]], conf: Config, **kw) -> DataFrame:
    """The baseline's summary for each feature set."""
    out = None
    for name, features in sets.items():
        if features:
            s = baseline(panel, features, conf, **kw)["summary"].withColumn("feature_set", F.lit(name))
            out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def prefilter_size(target: int) -> int:
    return max(30_000, 40 * target)


def scorecard_size(target: int, prefiltered: int) -> int:
    return min(prefiltered, max(3_000, 25 * target))


def mine_expressions(panel: DataFrame, scores: DataFrame, library: list[str], conf: Config, target: int = 100, rows_per_month: int = 1200, max_seeds: int = 80, max_pairs: int = 500, rounds: int = 6, scorecard_rows: int = 3000) -> DataFrame:
    """Candidates from seeds, prefiltered on a sample of whole cross-sections of the training range and scored on a larger one,
    then the unlike best of them. Seeds and pairs grow from round to round until there are target factors; too few after the last is an error."""
    rows = panel.where(F.col("month").between(conf.is_start, conf.is_end))
    train, more = (sampling.sample_times(rows, n, conf.seed).persist() for n in (rows_per_month, scorecard_rows))
    t = scorecard.Thresholds()
    for k in range(rounds):
        table = expressions.candidates(scores, max_seeds + 20 * k, max_pairs + 250 * k)
        exprs = [r.asDict() for r in table.collect()]
        names = [e["name"] for e in exprs]
        made = expressions.evaluate(train, exprs)
        top = prefilter_size(target)
        best = ic.prefilter(ic.block_stats(made, names), table, top).orderBy(F.desc("abs_is_ic"), "name").limit(scorecard_size(target, top))
        kept = [r["name"] for r in best.select("name").collect()]
        if kept:
            scored = expressions.evaluate(more, [e for e in exprs if e["name"] in set(kept)])
            frame = scorecard.sample_frame(scored)
            cards = scorecard.scorecard(scored, kept, library).join(best.select("name", "op", "left", "right", "formula", "is_ic", "oos_ic", "same_sign"), "name")
            cards = cards.withColumns({"selection_ic": F.col("is_ic"), "same_sign": F.coalesce(F.signum("pearson_ic") == F.signum("is_ic"), F.lit(False))})
            judged = scorecard.select_unlike(scorecard.judged(cards, t).persist(), frame, {e["name"]: e["op"] for e in exprs}, target, t, pool=max(800, scorecard_size(target, top)), max_per_op=max(50, target)).persist()
            if judged.where("selected").count() >= target:
                return judged.where("selected")
    raise RuntimeError(f"fewer than {target} factors pass after {rounds} rounds")


def validation_summary(effects: DataFrame, model: str, new: DataFrame | None = None) -> DataFrame:
    """model, factors, retained, removed, new_retained, mean_delta of a leave-one-out or replacement test; retained: delta above 0."""
    rows = effects if new is None else effects.join(new.select("factor", F.lit(True).alias("_new")), "factor", "left")
    rows = rows if new is not None else rows.withColumn("_new", F.lit(False))
    keep = F.col("delta") > 0
    return rows.agg(F.count("*").alias("factors"), F.count_if(keep).alias("retained"), F.count_if(~keep).alias("removed"), F.count_if(keep & F.coalesce("_new", F.lit(False))).alias("new_retained"), F.avg("delta").alias("mean_delta")).withColumn("model", F.lit(model))


def retained_by_all(effects: list[DataFrame]) -> DataFrame:
    """Factors that every test retains."""
    out = None
    for e in effects:
        names = e.where("delta > 0").select("factor")
        out = names if out is None else out.intersect(names)
    return out


def deltas(summary: DataFrame, base: str, other: str) -> DataFrame:
    """Per model and view: the total IC of two feature sets and their difference."""
    wide = summary.groupBy("model", "pred_col").pivot("feature_set", [base, other]).agg(F.first("ic_total_range"))
    return wide.withColumn("delta", F.col(other) - F.col(base))


#: Result tables that a report reads, in its order.
RESULTS = ("audit", "factor_scores", "baseline_summary", "baseline_backtest", "incremental", "expressions")


def stored_results(spark: SparkSession, conf: Config) -> dict[str, DataFrame]:
    """What commands have written under the output, without computing any of it again, and the numbers of the report's figures:
    monthly ICs of the stored predictions, the cumulated long-short return, ICs by model and by feature set."""
    read = lambda name: spark.read.csv(f"{conf.output}/{name}", header=True, inferSchema=True)
    out = {k: read(k) for k in RESULTS if store.exists(spark, f"{conf.output}/{k}")}
    if not out:
        raise ValueError(f"no results under {conf.output}")
    path = f"{conf.output}/baseline_predictions"
    if store.exists(spark, path):
        preds = spark.read.parquet(path)
        out["figure_monthly_ic"] = preds.groupBy("model", F.col("month").cast("string").alias("month")).agg(ic.cosine_ic("pred", "label").alias("ic")).orderBy("model", "month")
        months = []
        for m in sorted(r.model for r in preds.select("model").distinct().collect()):
            legs = backtest.long_short(preds.where(F.col("model") == m), "pred").groupBy(ic.month().alias("month")).agg(F.sum("ls_return").alias("ls_return")).withColumn("model", F.lit(m))
            months.append(legs)
        if months:
            legs = reduce(DataFrame.unionByName, months)
            upto = Window.partitionBy("model").orderBy("month")  # a row a month
            out["figure_cumulated_return"] = legs.select("model", "month", "ls_return", F.sum("ls_return").over(upto).alias("cum_return")).orderBy("model", "month")
    for name, table, by in (("figure_ic_by_model", "baseline_summary", ["model"]), ("figure_ic_by_feature_set", "incremental", ["feature_set", "model"])):
        if table in out:
            out[name] = out[table].select(*by, "pred_col", "ic_total_range").orderBy(*by, "pred_col")
    return out


def run_report(parts: dict[str, DataFrame], title: str = "Factor research") -> str:
    return reports.report(title, parts)
