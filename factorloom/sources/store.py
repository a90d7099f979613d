"""The factor store: configuration, factor lists, the month-partitioned panel and its readers and writers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expressions import OPS, evaluate
from ..operators.views import xrank, xzscore
from .bars import META

VIEWS = ("raw", "tsz", "csz", "csr")


@dataclass(frozen=True)
class Config:
    """Where the panel is and which ranges it is split into. filter_first: take symbols before the cross-section."""

    panel: str = "panel"
    output: str = "out"
    is_start: str = "2017-01"
    is_end: str = "2019-12"
    oos_start: str = "2020-01"
    oos_end: str = "2020-12"
    horizon: int = 30
    excluded: tuple[str, ...] = ()
    filter_first: bool = False
    seed: int = 7

    @staticmethod
    def from_mapping(raw: dict) -> Config:
        """Unknown keys are errors; lists become tuples."""
        known = {f.name for f in fields(Config)}
        if extra := set(raw) - known:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})

    @staticmethod
    def load(text: str) -> Config:
        """From YAML where a parser is installed, else from JSON, which YAML contains."""
        try:
            import yaml

            raw = yaml.safe_load(text)
        except ImportError:
            raw = json.loads(text)
        return Config.from_mapping(raw or {})


@dataclass(frozen=True)
class FactorSpec:
    """An ordered factor list, split into views by the names' prefixes."""

    names: tuple[str, ...]
    raw: tuple[str, ...] = field(default=())
    tsz: tuple[str, ...] = field(default=())
    csz: tuple[str, ...] = field(default=())
    csr: tuple[str, ...] = field(default=())

    @staticmethod
    def of(names) -> FactorSpec:
        views: dict[str, list] = {v: [] for v in VIEWS}
        kept = tuple(n for n in (x.strip() for x in names) if n)
        for n in kept:
            view = n[:3] if n[:4] in ("tsz_", "csz_", "csr_") else "raw"
            views[view].append(n if view == "raw" else n[4:])
        return FactorSpec(kept, **{k: tuple(v) for k, v in views.items()})

    def subset(self, columns) -> FactorSpec:
        """None is all, an empty list none; unknown names are left out without a word."""
        return self if columns is None else FactorSpec.of(n for n in self.names if n in set(columns))

    def bases(self) -> list[str]:
        """Columns of the stored panel these factors are read from."""
        return list(dict.fromkeys([*self.raw, *(f"tsz_{x}" for x in self.tsz), *self.csz, *self.csr]))


def read_list(spark: SparkSession, path: str) -> list[str]:
    """One name a line."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def write_list(spark: SparkSession, path: str, names: list[str]) -> None:
    spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_panel(panel: DataFrame, path: str, overwrite: bool = True) -> None:
    """Month partitions; the rows of a month are dealt to files by symbol, so no task writes a whole month.

    Without overwrite, months that the panel has already stay as they are and only the others are added."""
    rows = panel.withColumn("month", F.date_format("datetime", "yyyy-MM"))
    if not overwrite and exists(panel.sparkSession, path):
        there = [str(r.month) for r in panel.sparkSession.read.parquet(path).select(F.col("month").cast("string").alias("month")).distinct().collect()]
        rows = rows.where(~F.col("month").isin(there))
    rows.repartition("month", "symbol").write.mode("overwrite" if overwrite else "append").partitionBy("month").option("compression", "zstd").parquet(path)


def write_final(panel: DataFrame, path: str) -> None:
    """One table ordered by time, whose row groups readers prune by datetime."""
    panel.repartitionByRange("datetime", "symbol").sortWithinPartitions("datetime", "symbol").write.mode("overwrite").option("compression", "zstd").parquet(path)


class FactorStore:
    """Reads a panel by months, views and symbols. Either layout: month partitions, or one table ordered by time."""

    def __init__(self, spark: SparkSession, path: str, spec: FactorSpec, filter_first: bool = False):
        self.spark, self.path, self.spec, self.filter_first = spark, path, spec, filter_first

    def scan(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Whole months from start to end: a filter on the partition column, or half-open bounds of datetime in the other
        layout, which reach the scan and prune its row groups."""
        df = self.spark.read.parquet(self.path)
        if "month" in df.columns:
            return self._between(df.withColumn("month", F.col("month").cast("string")), start, end)
        first = lambda m, k: F.lit(f"{int(m[:4]) + (int(m[5:7]) - 1 + k) // 12:04d}-{(int(m[5:7]) - 1 + k) % 12 + 1:02d}-01").cast(df.schema["datetime"].dataType)
        if start:
            df = df.where(F.col("datetime") >= first(start, 0))
        if end:
            df = df.where(F.col("datetime") < first(end, 1))
        return df.withColumn("month", F.date_format("datetime", "yyyy-MM"))

    def months(self, start: str | None = None, end: str | None = None) -> list[str]:
        return sorted(r.month for r in self.scan(start, end).select("month").distinct().collect())

    def _between(self, df: DataFrame, start: str | None, end: str | None) -> DataFrame:
        if start:
            df = df.where(F.col("month") >= start[:7])
        return df.where(F.col("month") <= end[:7]) if end else df

    def read(self, start: str | None = None, end: str | None = None, columns=None, symbols=None) -> DataFrame:
        """META, month and the wanted factors, views across symbols worked out on the way. Symbols are taken after the
        cross-section, or before it with filter_first, which changes the cross-section."""
        spec = self.spec.subset(columns)
        df = self.scan(start, end)
        meta = [x for x in META if x in df.columns]
        have = [b for b in spec.bases() if b in df.columns]
        df = df.select(*meta, "month", *(b for b in have if b not in meta))
        pick = df.where(F.col("symbol").isin(list(symbols))) if symbols is not None and self.filter_first else df
        at = lambda b: F.col(b) if b in have else F.lit(None).cast("double")
        made = {n: at(n) for n in (*spec.raw, *(f"tsz_{x}" for x in spec.tsz))}
        made |= {f"csz_{b}": xzscore(b) if b in have else at(b) for b in spec.csz} | {f"csr_{b}": xrank(b) if b in have else at(b) for b in spec.csr}
        out = pick.select(*meta, "month", *(made[n].alias(n) for n in spec.names if n not in meta))
        return out.where(F.col("symbol").isin(list(symbols))) if symbols is not None and not self.filter_first else out

    def audit(self) -> DataFrame:
        """months, first_month, last_month, symbols, rows, labelled_rows, columns, and the factors of each view."""
        df = self.scan()
        n = {f"n_{v}": F.lit(len(getattr(self.spec, v))) for v in VIEWS}
        return df.agg(
            F.countDistinct("month").alias("months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"), F.countDistinct("symbol").alias("symbols"),
            F.count("*").alias("rows"), F.count("label").alias("labelled_rows"),
        ).withColumns({"columns": F.lit(len(df.columns)), **n})

    def features(self, names: list[str], exprs: list[dict] = (), start: str | None = None, end: str | None = None) -> DataFrame:
        """META, month and features, stored or made by expressions. Catalyst drops what no feature needs."""
        made = {e["name"]: e for e in exprs}
        used = [made[n] for n in names if n in made]
        plain = [n for n in names if n not in made]
        need = list(dict.fromkeys([*plain, *(x for e in used for x in (e["left"], e["right"]))]))
        df = self.read(start, end, need)
        meta = [x for x in df.columns if x in META or x == "month"]
        return evaluate(df, used).select(*meta, *names) if used else df.select(*meta, *names)


def dependencies(names: list[str], exprs: list[dict]) -> list[str]:
    """Stored columns that the features are made of, in order and once."""
    made = {e["name"]: e for e in exprs if e["op"] in OPS}
    return list(dict.fromkeys(x for n in names for x in ((made[n]["left"], made[n]["right"]) if n in made else (n,))))


def as_json(conf: Config) -> str:
    return json.dumps(asdict(conf), sort_keys=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share, under spark.checkpoint.dir. Only a master on one machine may leave it unset."""
    import uuid

    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = root or "file:///tmp/checkpoints/factorloom"
    return f"{root.rstrip('/')}/factorloom-{name}-{uuid.uuid4().hex[:12]}"


def load_manifest(spark: SparkSession, path: str) -> list[dict]:
    """The feature sets of a suite: a CSV with set and path at least."""
    df = spark.read.csv(path, header=True)
    if lost := {"set", "path"} - set(df.columns):
        raise ValueError(f"the manifest lacks {sorted(lost)}")
    return [r.asDict() for r in df.collect()]  # a list of files


def load_ic_scores(spark: SparkSession, path: str) -> DataFrame:
    """A score table with name, is_ic, oos_ic and what follows from them; factor is another word for name."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    if "factor" in df.columns and "name" not in df.columns:
        df = df.withColumnRenamed("factor", "name")
    df = df.withColumns({c: F.expr(f"try_cast({c} as double)") if c in df.columns else F.lit(None).cast("double") for c in ("is_ic", "oos_ic")})
    given = lambda c, made, kind: F.expr(f"try_cast({c} as {kind})") if c in df.columns else made
    same = F.coalesce(F.signum("is_ic") == F.signum("oos_ic"), F.lit(False))
    return df.withColumns({"same_sign": given("same_sign", same, "boolean"), "abs_is_ic": given("abs_is_ic", F.abs("is_ic"), "double"), "abs_oos_ic": given("abs_oos_ic", F.abs("oos_ic"), "double")})


def load_backtests(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Backtest summaries written as JSON, one row a name; names without a file are left out."""
    out = None
    for name, path in paths.items():
        if exists(spark, path):
            one = spark.read.json(path).withColumn("name", F.lit(name))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "name string")
