"""What the operators of this subpackage share: reading, staging and worker state."""

from __future__ import annotations

import gc
import sys
import types
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Where a session on one machine names no checkpoint folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/factorloom"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by spark.checkpoint.dir. Only a master on one machine may leave it unset."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return f"file://{FALLBACK_DIR}"
    raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")


@contextmanager
def conf(spark: SparkSession, pairs: dict[str, str]):
    """Settings that hold inside the block only."""
    old = {k: spark.conf.get(k, None) for k in pairs}
    try:
        for k, v in pairs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = 500, size: str = "16m") -> None:
    """Arrow batches of whole texts: few rows and few bytes, so a worker holds two batches however long the texts are.

    The session keeps the setting, as results are lazy and batches are cut when they are read."""
    spark.conf.set(ARROW_ROWS, str(rows))
    spark.conf.set(ARROW_BYTES, size)


#: Folders of tables that this driver wrote and that may still be read.
_folders: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def folders() -> list[str]:
    return list(_folders)


def clean(spark: SparkSession, keep: list[str] = ()) -> None:
    """Deletes the tables that operators staged, but for the folders to keep. Frames that read them are of no use after it."""
    for path in [x for x in _folders if x not in set(keep)]:
        _delete(spark, path)
        _folders.remove(path)


class Staged:
    """Tables written to the shared folder, each read again as a plain scan: this cuts lineage, and a lost executor loses nothing.

    What an operator needs no more it drops; what its result reads stays until clean()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/factorloom-{name}-{uuid.uuid4().hex[:12]}"
        _folders.append(self.root)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with conf(self.spark, {CLEANUP: "true"}):  # shuffle files go as soon as the table stands
            df.write.mode("overwrite").parquet(path)
        gc.collect()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        _delete(self.spark, f"{self.root}/{name}")


def worker_state(key: str, make: Callable):
    """A value kept by the Python worker over its tasks, such as a loaded tokenizer."""
    kept = sys.modules.setdefault("_factorloom_worker", types.ModuleType("_factorloom_worker"))
    if not hasattr(kept, key):
        setattr(kept, key, make())
    return getattr(kept, key)
