"""Document fingerprints by winnowing, in DataFrame functions only.

A text's units are its words, and the single signs of scripts that write words without spaces. Units are hashed; a rolling
hash (a polynomial modulo the prime 2**31 - 1, the unit that leaves taken out and the one that enters put in) covers each run of
K units, and of every WINDOW such hashes the least is kept with its position, the rightmost of ties. So any run
of WINDOW + K - 1 units that two texts share puts the same hash into both fingerprints. A text of fewer hashes than
a window has no such run to promise, and keeps them all.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import let

K = 3
WINDOW = 4  # a power of two: minima are taken over doubled spans
PRIME = (1 << 31) - 1
_BASE = 1_000_003
_LAST = (1 << 31) - 1
#: Hashes that roll one from the other; each block starts anew.
BLOCK = 32
#: Code points of scripts written without spaces (Thai and Lao, Myanmar, Khmer, kana, Han).
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"
UNIT = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"


def word_hash(word: Column) -> Column:
    """28 bits of the word's MD5."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 7), 16, 10).cast("bigint")


def gram_hashes(text: Column, k: int = K) -> Column:
    """array<long>: hashes below PRIME of all runs of k units; one of all units where they are fewer; empty without units."""
    power = [pow(_BASE, j, PRIME) for j in range(k)]

    def term(h: Column, i, n: int) -> Column:
        """The polynomial of n hashes from place i; products stay under 2**59, so each is reduced before the sum."""
        return sum((F.get(h, i + j) * power[n - 1 - j] % PRIME for j in range(1, n)), F.get(h, i) * power[n - 1] % PRIME) % PRIME

    def roll(h: Column) -> Column:
        n = F.size(h)
        last = n - k  # place of the last run

        def block(at: Column) -> Column:
            first = F.array(term(h, at, k))
            step = lambda out, i: F.concat(out, F.array(((F.element_at(out, -1) + PRIME - F.get(h, i - 1) * power[k - 1] % PRIME) % PRIME * _BASE + F.get(h, i + k - 1)) % PRIME))
            return F.when(at == last, first).otherwise(F.aggregate(F.sequence(at + 1, F.least(at + BLOCK - 1, last)), first, step))

        out = F.when(n == 0, F.array().cast("array<bigint>"))
        for m in range(1, k):
            out = out.when(n == m, F.array(term(h, F.lit(0), m)))
        return out.otherwise(F.flatten(F.transform(F.sequence(F.lit(0), last, F.lit(BLOCK)), block)))

    return let(F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), word_hash), roll)


def winnow(grams: Column, window: int = WINDOW) -> Column:
    """array<long> in order of position: hash * 2**31 + (2**31 - 1 - position) of the minimum of each window; all where they are fewer."""
    packed = F.transform(grams, lambda h, i: F.shiftleft(h, 31) + (F.lit(_LAST) - i).cast("bigint"))

    def doubled(span: Column, step: int) -> Column:
        def pair(s: Column) -> Column:
            n = F.greatest(F.size(s) - step, F.lit(0))
            return F.zip_with(F.slice(s, 1, n), F.slice(s, step + 1, n), lambda a, b: F.least(a, b))

        return let(span, pair)

    def least(x: Column) -> Column:
        span, width = x, 1
        while width < window:  # minima over twice the width from two neighbours
            span, width = doubled(span, width), 2 * width
        return F.when(F.size(x) < window, x).otherwise(F.array_distinct(span))

    return let(packed, least)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    return winnow(gram_hashes(F.coalesce(text, F.lit("")), k), window)


def hashes(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: F.shiftright(x, 31)))


def written(prints: Column) -> Column:
    """hash@position of each print, hash in hexadecimal, joined by blanks."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(F.shiftright(x, 31))), F.lit("@"), (F.lit(_LAST) - x.bitwiseAND(_LAST)).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both.cast("double") / F.when(union == 0, 1).otherwise(union))


def _bucket_of(x: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at or below x, by two steps over about sqrt(cuts) numbers each."""
    if not cuts:
        return x * 0
    size = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    below = lambda some: F.size(F.filter(some, lambda c: c <= x))
    coarse = below(F.lit([g[0] for g in groups]))
    fine = let(coarse, lambda k: F.when(k == 0, 0).otherwise((k - 1) * size + below(F.get(F.array(*map(F.lit, groups)), k - 1))))
    return F.when(x.isNotNull(), fine)


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str], parts: int | None = None, made: dict[str, Column] | None = None) -> DataFrame:
    """Adds next_<column>: the value in the row that follows by descending key, then MD5 of tie; the first row's for the last one.

    No task sees all rows. Ranges of the key, cut at its quantiles, are windows of their own; a key (or the lack of one) that fills
    ranges by itself is cut into as many of MD5. The head of each range, one row a range and found by its key alone,
    closes the gap after the range before. Null keys come last. Columns to be made of a row alone, which may be among `columns`,
    are made once the rows are dealt and sorted, so only what they come from is shuffled.
    """
    spark = rows.sparkSession
    tasks = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = 4 * tasks
    none = -(1 << 63)
    number = F.coalesce(F.col(key), F.lit(none))
    quantiles = rows.agg(F.percentile_approx(number, [i / n for i in range(1, n)], 4 * n)).first()[0] or []  # n - 1 numbers
    hot = {c: m for c, m in Counter(quantiles).items() if m > 1}
    cuts = sorted({*quantiles, *(c + 1 for c in hot if c < -(none + 1))})
    share = F.conv(F.substring(F.md5(F.col(tie).cast("binary")), 1, 7), 16, 10).cast("double") / (1 << 28)
    pieces = F.lit(0)
    for c, m in hot.items():  # few: each fills two ranges at least
        piece = (share * m).cast("int")
        pieces = F.when(number == c, F.when(F.col(key).isNull(), piece).otherwise(m) if c == none else piece).otherwise(pieces)
    bucket = (_bucket_of(number, cuts).cast("int") * n + pieces).alias("_bucket")
    tops = rows.select(key, tie).groupBy(bucket).agg(F.max(number).alias("top")) if hot else rows.select(key).groupBy(bucket).agg(F.max(number).alias("top"))
    tops = tops.orderBy(F.desc("_bucket")).collect()  # 3 n rows at most
    after = {b._bucket: tops[(i + 1) % len(tops)]._bucket for i, b in enumerate(tops)}
    order = F.struct(F.col(key).isNotNull(), number, F.md5(F.col(tie).cast("binary")))
    dealt = rows.withColumns({"_bucket": bucket, "_tie": F.md5(F.col(tie).cast("binary"))})
    falling = [F.col(key).desc_nulls_last(), F.col("_tie").desc()]
    sorted_ = dealt.repartition(tasks, "_bucket").sortWithinPartitions("_bucket", *falling).withColumns(made or {})
    found = sorted_.withColumn("_next", F.lead(F.struct(*columns)).over(Window.partitionBy("_bucket").orderBy(*falling)))
    head = dealt.where(number.isin([b.top for b in tops])).withColumns(made or {}).groupBy("_bucket").agg(F.max_by(F.struct(*columns), order).alias("_head"))
    before = {a: b for b, a in after.items()}
    if before:
        closes = F.element_at(F.map_from_arrays(F.lit(list(before)), F.lit(list(before.values()))), F.col("_bucket"))
        head = head.select(closes.alias("_bucket"), "_head")
    named = F.coalesce("_next", "_head")
    return found.join(head, "_bucket", "left").select(*rows.columns, *(made or {}), *(named[c].alias(f"next_{c}") for c in columns))


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends with the beginning of the next document in place of its own second half. Null texts are
    empty; texts without words have an empty fingerprint, and two empty ones have likeness 1. Repeated ids follow
    each other by descending MD5 of the text. A null doc_id comes last. The only row of a table is its own next document.
    An empty table gives no rows; columns other than the id and the text are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    x = with_next(rows, "doc_id", "text", ["text", "prints"], made={"prints": fingerprint(F.col("text"), k, window)})
    n = F.char_length("text")
    half = (n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    x = x.select("doc_id", n.cast("long").alias("n_chars"), "prints", "next_prints", edited.alias("edited"))
    x = x.withColumn("edited_prints", fingerprint(F.col("edited"), k, window))
    own = hashes(F.col("prints"))
    return x.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), written(F.col("prints")).alias("fingerprint"), written(F.col("edited_prints")).alias("edited_fingerprint"),
        likeness(own, hashes(F.col("edited_prints"))).alias("near_edited"), likeness(own, hashes(F.col("next_prints"))).alias("near_next"),
    )
