"""Secret scanning in DataFrame functions only: patterns, and sliding-window entropy of candidate strings.

A candidate is a maximal run of one character class. A window slides over it; counts of its signs are
kept up to date by the sign that enters and the one that leaves, and with them the sum of c*log2(c),
from which the Shannon entropy follows. The span runs from the first to the last window whose entropy
reaches the class's threshold. An allow list suppresses candidates that are plain by their form.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import let, listing, matches, spans

#: The kinds every scan reports, with what a match must have beyond the pattern.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12


class CharClass(NamedTuple):
    """alphabet: the signs counted, in order; pattern: candidate strings; bits: entropy a window must reach."""

    name: str
    alphabet: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass("hex", "0123456789abcdefABCDEF", r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])", 20, 3.0),
    CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]{24,}+", 24, 3.9),
)
#: Forms that are not secrets: words and slugs, plain numbers, UUIDs, one class of sign only, placeholders.
ALLOW = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))*[-_/=+]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[-_]",
)
KINDS = ["assign", "access", "hex", *(f"entropy_{c.name}" for c in CLASSES)]


def hot_windows(candidate: Column, c: CharClass) -> Column:
    """struct<first, last>: starts of the first and last window that reach c.bits, or -1."""
    w = c.window
    plogp = F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(w + 1)))
    most = w * (math.log2(w) - c.bits) + 1e-9  # entropy = log2(w) - sum / w
    signs = F.transform(F.split(candidate, ""), lambda x: F.instr(F.lit(c.alphabet), x))
    signs = F.filter(signs, lambda x: x > 0)

    def bump(counts: Column, sign: Column, by: int) -> Column:
        return F.transform(counts, lambda n, i: F.when(i == sign, n + by).otherwise(n))

    def scan(s: Column) -> Column:
        zero = F.struct(F.array_repeat(F.lit(0), len(c.alphabet) + 1).alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

        def step(a: Column, i: Column) -> Column:
            came, gone = F.get(s, i), F.get(s, i - w)
            kept = F.when(i >= w, bump(a["counts"], gone, -1)).otherwise(a["counts"])
            less = F.when(i >= w, let(F.get(a["counts"], gone), lambda n: F.get(plogp, n - 1) - F.get(plogp, n))).otherwise(0.0)

            def enter(k: Column) -> Column:
                n = F.get(k, came)
                total = a["sum"] + less + F.get(plogp, n + 1) - F.get(plogp, n)
                return let(total, lambda t: let((i >= w - 1) & (t <= most), lambda hot: F.struct(bump(k, came, 1).alias("counts"), t.alias("sum"), F.when(hot & (a["first"] < 0), i - w + 1).otherwise(a["first"]).alias("first"), F.when(hot, i - w + 1).otherwise(a["last"]).alias("last"))))

            return let(kept, enter)

        return F.aggregate(F.sequence(F.lit(0), F.size(s) - 1), zero, step, lambda a: F.struct(a["first"], a["last"]))

    return let(signs, scan)


def entropy_spans(text: Column, c: CharClass, rank: int) -> Column:
    """array<struct<start, rank, end>> of the hot parts of candidates that the allow list lets through."""
    allowed = [lambda x, p=p: x["match"].rlike(p) for p in ALLOW]
    some = F.filter(matches(text, c.pattern), lambda x: ~(allowed[0](x) | allowed[1](x) | allowed[2](x) | allowed[3](x) | allowed[4](x)))
    hot = F.transform(some, lambda x: F.struct(x["start"].alias("at"), hot_windows(x["match"], c).alias("hot")))
    hot = F.filter(hot, lambda x: x["hot"]["first"] >= 0)
    return F.transform(hot, lambda x: F.struct((x["at"] + x["hot"]["first"]).alias("start"), F.lit(rank).alias("rank"), (x["at"] + x["hot"]["last"] + c.window).alias("end")))


def found(text: Column) -> Column:
    """struct of the spans of a text by group: assign, access, hex, entropy."""
    assign = F.filter(matches(text, ASSIGN, 2), lambda x: F.char_length(x["part"]) >= ASSIGN_VALUE)
    entropy = F.array_sort(F.concat(*(entropy_spans(text, c, 3 + i) for i, c in enumerate(CLASSES))))
    return F.struct(spans(assign, 0).alias("assign"), spans(matches(text, ACCESS), 1).alias("access"), spans(matches(text, HEX), 2).alias("hex"), entropy.alias("entropy"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, text, assign, access, hex, entropy: arrays of struct<start, rank, end> in
    order of start; rank gives the kind in KINDS.

    Null texts are empty and have no spans. Every row is scanned for itself, so ties and repeated rows give equal
    spans, and an empty table none; columns other than the id and the text are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("found", found(F.col("text"))).select("doc_id", "text", "found.*")


def digests(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    base = F.array_sort(F.concat("assign", "access", "hex"))
    return scanned.select("doc_id", "assign", "access", "hex", "entropy", base.alias("base")).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(listing(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        listing(F.array_sort(F.concat("base", "entropy")), KINDS).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"),
    )


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or touching spans (sorted by start) replaced by mark."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = (x["start"] > a["at"]) | (F.size(a["out"]) == 0)
        more = F.concat(a["out"], F.array(F.substr(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)))
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, more).otherwise(a["out"]).alias("out"))

    done = F.aggregate(found, zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    return F.when(F.size(found) > 0, done).otherwise(text)
