"""python -m factorloom --config FILE COMMAND: the engine's commands on one Spark session."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from .operators import backtest
from .plans import workflows
from .sources import bars, reports, store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factorloom")
    p.add_argument("--config", required=True, help="settings as YAML or JSON")
    p.add_argument("--factors", help="a file of factor names, one a line")
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build-partitions")
    build.add_argument("--raw", required=True, help="a folder of CSV files, one a symbol")
    build.add_argument("--columns", default="datetime,open,high,low,close,volume,amount,oi")
    build.add_argument("--start")
    build.add_argument("--end-exclusive")
    build.add_argument("--overwrite", action="store_true", help="build all months anew; else those that are there stay")
    final = sub.add_parser("materialize-final")
    final.add_argument("--path", required=True)
    final.add_argument("--start", help="the first month")
    final.add_argument("--end", help="the last month")
    sub.add_parser("audit-data")
    mine = sub.add_parser("mine-factors")
    mine.add_argument("--min-is-ic", type=float, default=0.002)
    mine.add_argument("--min-oos-ic", type=float, default=0.001)
    base = sub.add_parser("baseline")
    base.add_argument("--models", default="ridge")
    base.add_argument("--feature-file", help="features, one a line, in place of all factors")
    base.add_argument("--name", default="baseline", help="what the results are called")
    sub.add_parser("incremental").add_argument("--sets", default="100,300")
    bt = sub.add_parser("backtest")
    bt.add_argument("--predictions", required=True)
    bt.add_argument("--pred-col", default="pred_xrank")
    bt.add_argument("--quantile", type=float, default=0.2)
    expr = sub.add_parser("mine-expressions")
    expr.add_argument("--target", type=int, default=100)
    sub.add_parser("report", help="from the results under the configured output")
    sub.add_parser("run-all").add_argument("--skip-trees", action="store_true", help="ridge only")
    return p


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The named results of a command, also written under the configured output."""
    conf = store.Config.load("\n".join(r.value for r in spark.read.text(args.config, wholetext=True).collect()))
    spec = store.FactorSpec.of(store.read_list(spark, args.factors) if args.factors else [])
    if args.command == "build-partitions":
        workflows.build_partitions(spark, bars.read_csv(spark, args.raw, args.columns.split(","), list(conf.excluded)), conf, spec, args.overwrite, start=args.start, end=args.end_exclusive)
        return {}
    if args.command == "materialize-final":
        workflows.materialize_final(spark, conf, spec, args.path, args.start, args.end)
        return {}
    if args.command == "backtest":
        return {"backtest": backtest.summarize(backtest.long_short(spark.read.parquet(args.predictions), args.pred_col, quantile=args.quantile))}
    if args.command == "report":
        return workflows.stored_results(spark, conf)
    st = store.FactorStore(spark, conf.panel, spec, conf.filter_first)
    panel, names = st.read(), list(spec.names)
    least = {"min_is": getattr(args, "min_is_ic", 0.002), "min_oos": getattr(args, "min_oos_ic", 0.001)}
    out: dict[str, DataFrame] = {}
    whole = args.command == "run-all"
    if args.command == "audit-data" or whole:
        out["audit"] = workflows.audit_data(st, conf)
    if args.command in ("mine-factors", "incremental", "mine-expressions") or whole:
        out["factor_scores"] = workflows.mine_factors(panel, names, conf, **least).persist()
    if args.command == "baseline" or whole:
        kinds = args.models.split(",") if args.command == "baseline" else ["ridge"] if args.skip_trees else ["ridge", "trees"]
        file, title = getattr(args, "feature_file", None), getattr(args, "name", "baseline")
        features = store.read_list(spark, file) if file else names
        out |= {f"{title}_{k}": v for k, v in workflows.baseline(panel, features, conf, kinds).items()}
    if args.command == "incremental" or whole:
        sizes = [int(x) for x in getattr(args, "sets", "100,300").split(",") if x != "all"]
        out["incremental"] = workflows.incremental(panel, workflows.feature_sets(out["factor_scores"], sizes, names), conf)
    if args.command == "mine-expressions":
        out["expressions"] = workflows.mine_expressions(panel, out["factor_scores"], names, conf, args.target)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("factorloom").getOrCreate()
    conf = store.Config.load("\n".join(r.value for r in spark.read.text(args.config, wholetext=True).collect()))
    out = run(spark, args)
    tables = {k: v for k, v in out.items() if not k.endswith("_predictions")}
    for k in set(out) - set(tables):
        reports.write_predictions(out[k], f"{conf.output}/{k}")
    for k, v in tables.items():
        if args.command != "report":
            reports.write_csv(v, f"{conf.output}/{k}")
    print(workflows.run_report(tables))


if __name__ == "__main__":
    main()
