"""A corpus pipeline over `documents`: STAGES are applied in order, each to all its predecessor kept.

Every stage but the last returns the columns of `documents`; each is written as Parquet to the shared
folder and read again, so a stage never recomputes what came before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import decontaminate, langid, near_copies, packing, secrets
from factorloom.llm.common import Staged, clean, folders, table
from factorloom.llm.queries import tokenizer_path
from factorloom.llm.spans import let

#: Language ID rejects texts without a letter and those whose best language is less likely than this. Short notes and
#: texts in two languages come near one half, so the bound is lower: what no language explains.
LEAST_SCORE = 0.35
#: Parts of texts that a worker's encoder keeps: few, as its memory stays while other stages run.
CACHE = 200_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have no language: no letter in the text (or no text), or no language of LEAST_SCORE.

    The classifier learns from the stage's own labelled input; verdicts are applied as rows pass, without a join.
    """
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.accept(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: five-word shingles, likeness 0.8 or more, exact (see near_copies).

    Groups are of rows, by their texts, so neither a repeated doc_id nor a missing one loses a text that has no copy.
    The row of the smallest doc_id stays, one without an id only where no row of the group has one; ties go by hashes of
    the text, then of the whole row. Null and empty texts are one group.
    """
    roots = near_copies.groups(docs)
    node, place = near_copies.text_key(F.col("text")).alias("node"), F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    grouped = roots.union(roots.select("root", "root").distinct())
    firsts = docs.select(node, place.alias("place")).groupBy("node").agg(F.min("place").alias("place"))
    best = firsts.join(grouped, "node").groupBy("root").agg(F.min(F.struct("place", "node")).alias("x")).select("x.node")
    others = grouped.select("node").join(best, "node", "left_anti")
    rows = docs.select(node, F.struct(place, F.xxhash64(*docs.columns)).alias("place"), F.struct(*docs.columns).alias("row"))
    return rows.groupBy("node").agg(F.min_by("row", "place").alias("row")).join(others, "node", "left_anti").select("row.*")


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the text by a mark; all documents stay, n_chars follows the text."""
    def marked(text):
        return let(secrets.found(text), lambda x: secrets.redact(text, F.array_sort(F.concat(x["assign"], x["access"], x["hex"], x["entropy"]))))

    text = F.when(F.col("text").isNotNull(), let(F.coalesce(F.col("text"), F.lit("")), marked))
    changed = docs.withColumn("text", text)
    return changed.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.lit(0).cast("long"))).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences."""
    return packing.best_fit_pack(docs, tokenizer_path(), cache=CACHE)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("secret_scan", without_secrets),
    ("best_fit_packing", packed),
]

#: Trained classifiers, XXH64 fingerprints, banded alignment and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, staged = table(spark, sf_dir, "documents"), Staged(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        kept = folders()
        docs = staged.put(stage(spark, docs, sf_dir), f"{k}_{name}")
        clean(spark, keep=kept)  # what the stage wrote for itself
        if k:
            staged.drop(f"{k - 1}_{STAGES[k - 1][0]}")
    return docs
