"""Near-duplicate groups by exact similarity, as the pipeline takes them: all pairs of texts whose sets of five-word
shingles have Jaccard likeness 0.8 or more.

The index of simhash.py proposes pairs, by fingerprints of five-word shingles. Three bits of 64 are too few for likeness 0.8,
though, where about ten bits differ, and no number of shared bytes is sure at ten bits. So a prefix filter adds the rest:
texts of n shingles that reach the likeness share one of their n - ceil(0.8 n) + 1 rarest (any order that
is the same for all texts will do). Shingles are counted over all rows, by 32 bits within a part: a collision costs a look.
A text keeps an entry only for those of its rarest shingles that a second row has, so most texts have none. Entries of
one shingle make a list; pairs, of the index or a list, are verified on their whole sets, and only verified pairs are links.

A large group of near copies would give all its pairs. So each text carries a bitmap of the parities of its shingles: two sets
differ in as many shingles at least as their bitmaps in bits, and likeness 0.8 allows a ninth of both sizes. Pairs beyond
that are out for sure. Of those that are left a long list gives a spanning forest only; once it is verified and groups are
known, pairs of a list that the bitmaps allow and whose members are still apart are verified too, whatever its length.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, small_batches
from .simhash import components, links, majority, side_by_side

SEED = 42
SHINGLE = 5
#: Likeness of at least NUM / DEN.
NUM, DEN = 4, 5
#: Up to here all pairs of a list that can reach the likeness are verified at once; longer ones begin with a forest.
SHORT = 8
#: Words of 64 bits of a bitmap: sharp up to about 2,000 shingles.
WORDS = 16
#: Bytes of text whose shingles are counted in one part.
PART_BYTES = 16 << 20
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingles(raw: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of all runs of k lowercased words, by Unicode; one of all words where they are fewer."""
    words = " ".join((raw or b"").decode(errors="replace").lower().split()).encode().split(b" ")
    grams = [b" ".join(words)] if len(words) <= k else map(b" ".join, zip(*(words[i:] for i in range(k))))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=">u8").astype(np.uint64))


def text_key(text: Column) -> Column:
    """64 bits of the text; null and empty texts are one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _runs(batches, columns: int):
    """The rows of each value of the first column, as lists of columns; rows come sorted by it."""
    at, held = None, []
    for b in batches:
        rows = list(zip(*(b.column(i).to_pylist() for i in range(columns))))
        for r in rows:
            if held and r[0] != at:
                yield at, held
                held = []
            at = r[0]
            held.append(r)
    if held:
        yield at, held


def _deal(batches, parts: int):
    """part, batch, row, hash: packed shingles of a batch for each part. One row without row numbers has keys and sizes of its texts."""
    first = TaskContext.get().partitionId() << 32
    for k, b in enumerate(batches):
        sets = [shingles(x) for x in b.column(1).to_pylist()]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        if not len(sizes):
            continue
        every, row = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        part = (every >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        low, row, part = every[order].astype(np.uint32), row[order], part[order].astype(np.int32)
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        out = [(int(part[s]), first + k, row[s:e].tobytes(), low[s:e].tobytes()) for s, e in zip(cut, cut[1:])]
        nodes = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out.append(((first + k) % parts, first + k, None, np.concatenate([nodes, sizes]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "batch", "row", "hash"])


def _shared(batches):
    """batch, part, row, hash, rows: what more than one row has, and how many have it."""
    for part, held in _runs(batches, 4):
        own = [r for r in held if r[2] is not None]
        out = [(r[1], part, None, r[3], None) for r in held if r[2] is None]
        low = np.concatenate([np.frombuffer(r[3], np.uint32) for r in own]) if own else np.array([], np.uint32)
        _, inverse, n = np.unique(low, return_inverse=True, return_counts=True)
        n, start = n[inverse].astype(np.uint32), 0
        for _, batch, row, packed in own:
            m = n[start : start + len(packed) // 4]
            start += len(m)
            many = m > 1
            if many.any():
                out.append((batch, part, np.frombuffer(row, np.uint16)[many].tobytes(), np.frombuffer(packed, np.uint32)[many].tobytes(), m[many].tobytes()))
        for i in range(0, len(out), 200):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 200]), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["batch", "part", "row", "hash", "rows"])


def _rarest(batches):
    """key, node, n: entries of the texts of each batch."""
    for _, held in _runs(batches, 5):
        about = np.frombuffer(next(r[3] for r in held if r[2] is None), np.int64)
        node, size = about[: len(about) // 2], about[len(about) // 2 :]
        own = [r for r in held if r[2] is not None]
        if not own:
            continue
        row = np.concatenate([np.frombuffer(r[2], np.uint16) for r in own]).astype(np.int64)
        key = np.concatenate([np.frombuffer(r[3], np.uint32).astype(np.int64) + (r[1] << 32) for r in own])
        rows = np.concatenate([np.frombuffer(r[4], np.uint32) for r in own])
        order = np.lexsort((key, rows, row))
        row, key = row[order], key[order]
        count = np.bincount(row, minlength=len(node))
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (size - count)[row]
        kept = place < (size - (NUM * size + DEN - 1) // DEN + 1)[row]
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[row[kept]]), pa.array(size[row[kept]])], names=["key", "node", "n"])


def entries(docs: DataFrame) -> DataFrame:
    """docs: node, raw. Returns key, node, n: every pair of nodes of the likeness shares a key."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))  # a task holds one part at a time
    small_batches(docs.sparkSession)
    dealt = docs.mapInArrow(partial(_deal, parts=parts), "part int, batch long, row binary, hash binary")
    shared = dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_shared, "batch long, part int, row binary, hash binary, rows binary")
    return shared.repartition(parts, "batch").sortWithinPartitions("batch").mapInArrow(_rarest, "key long, node long, n long").distinct()


def bitmap(grams: np.ndarray) -> bytes:
    """For each bit whether the number of shingles that fall on it is odd: common shingles of two sets cancel out."""
    n = np.bincount(((grams >> np.uint64(7)) % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS)
    return np.packbits((n & 1).astype(bool)).tobytes()


def possible(n: np.ndarray, bits: np.ndarray, m, more) -> np.ndarray:
    """Whether sets of sizes n and m can reach the likeness, by their sizes and bitmaps."""
    ok = DEN * np.minimum(n, m) >= NUM * np.maximum(n, m)
    return ok & ((DEN + NUM) * np.bitwise_count(bits ^ more).sum(axis=1, dtype=np.int64) <= (DEN - NUM) * (n + m))


def _blocks(batches):
    """Columns key, node, n, group and bitmaps of whole lists, one after the other; rows come sorted by key."""

    def out(held):
        return [np.concatenate(c) for c in zip(*held)]

    held: list = []
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] + [np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint64).reshape(-1, WORDS)]
        key = cols[0]
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1][0][-1] != key[0]):
            yield out([*held, [c[:last] for c in cols]])
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield out(held)


def _forest(n: np.ndarray, bits: np.ndarray):
    """Places (one, many) of a spanning forest of the possible pairs of a list."""
    left = np.arange(len(n))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            close = possible(n[left], bits[left], n[at], bits[at])
            if close.any():
                yield at, left[close]
                queue += left[close].tolist()
                left = left[~close]


def _pairs(batches, whole: bool):
    """Possible pairs a > b of each list whose groups differ; of a long list only a forest, unless whole."""

    def out(some):
        x, y = (np.concatenate(c) for c in zip(*some))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], schema=PAIRS)

    some, held = [], 0
    for key, node, n, group, bits in _blocks(batches):
        start = np.flatnonzero(np.insert(key[1:] != key[:-1], 0, True))
        size = np.diff(np.append(start, len(key)))
        for i, j in side_by_side(start, size, SHORT):
            ok = (group[i] != group[j]) & possible(n[i], bits[i], n[j], bits[j])
            some.append((node[i[ok]], node[j[ok]]))
            held += int(ok.sum())
        for s, m in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist()):
            x, y, g, of = n[s : s + m], bits[s : s + m], group[s : s + m], node[s : s + m]
            if not whole:
                pairs = _forest(x, y)
            elif (g == g[0]).all():
                continue
            else:
                pairs = ((i, i + 1 + np.flatnonzero((g[i + 1 :] != g[i]) & possible(x[i + 1 :], y[i + 1 :], x[i], y[i]))) for i in range(m - 1))
            for i, many in pairs:
                if len(many):
                    some.append((np.full(len(many), of[i]), of[many]))
                    held += len(many)
                if held > 1 << 16:
                    yield out(some)
                    some, held = [], 0
        if held > 1 << 16:
            yield out(some)
            some, held = [], 0
    if held:
        yield out(some)


def pairs(lists: DataFrame, bits: DataFrame, whole: bool) -> DataFrame:
    """lists: key, node, n, group; bits: node, bits."""
    dealt = lists.join(bits, "node").select("key", "node", "n", "group", "bits").repartition("key").sortWithinPartitions("key", "node")
    small_batches(lists.sparkSession, 10_000)
    return dealt.mapInArrow(partial(_pairs, whole=whole), "a long, b long").distinct()


def verified(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose whole sets reach the likeness. sets: node, grams."""
    x = found.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("of_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("grams").alias("of_a")), "a")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return x.where(DEN * both >= NUM * (F.size("of_a") + F.size("of_b") - both)).select("a", "b")


def _sets(batches):
    """node, grams, fp, bits: the shingles of each text, their fingerprint and bitmap."""
    for b in batches:
        grams = [shingles(x) for x in b.column(1).to_pylist()]
        fp = np.array([majority(g.astype(">u8").view(np.uint8)) for g in grams], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.view(np.int64) for g in grams], pa.list_(pa.int64())), pa.array(fp), pa.array([bitmap(g) for g in grams], pa.binary())], names=["node", "grams", "fp", "bits"])


def proposed(sets: DataFrame, staged: Staged) -> DataFrame:
    """Pairs a > b of one node for each fingerprint, as the index of fingerprints links them, and of all with an equal one."""
    firsts = sets.groupBy("fp").agg(F.min("node").alias("first"))
    equal = sets.join(firsts, "fp").where("node > first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    of = lambda x: firsts.select(F.col("fp").alias(x), F.col("first").alias(f"first_{x}"))
    linked = links(firsts.select("fp"), staged=staged).join(of("a"), "a").join(of("b"), "b")
    return equal.union(linked.select(F.greatest("first_a", "first_b"), F.least("first_a", "first_b")))


def groups(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """node, root: for each text (by text_key) that has near copies of other wording, the least key of its group."""
    staged = Staged(docs.sparkSession, "near_copies")
    texts = docs.select(text_key(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    posts = staged.put(entries(texts.select("node", F.col("text").cast("binary").alias("raw"))), "posts")
    many = posts.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    lists = staged.put(posts.join(many, "key"), "lists")
    staged.drop("posts")
    needed = lists.select("node").distinct()
    one = texts.groupBy("node").agg(F.first("text").alias("text")).join(needed, "node", "left_semi")
    small_batches(docs.sparkSession)
    sets = staged.put(one.select("node", F.col("text").cast("binary").alias("raw")).mapInArrow(_sets, "node long, grams array<long>, fp long, bits binary"), "sets")

    bits = sets.select("node", "bits")
    found = pairs(lists.withColumn("group", F.col("node")), bits, whole=False)
    tried = staged.put(proposed(sets.select("node", "fp"), staged).union(found).distinct(), "tried")
    linked = staged.put(verified(tried, sets), "links")
    roots = staged.put(components(linked, staged), "roots")
    grouped = staged.put(lists.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("group")), "grouped")
    apart = grouped.groupBy("key").agg(F.min("group").alias("x"), F.max("group").alias("y"), F.count("*").alias("m")).where(f"x <> y AND m > {SHORT}").select("key")
    rest = staged.put(pairs(grouped.join(apart, "key"), bits, whole=True).join(tried, ["a", "b"], "left_anti"), "rest")
    more = staged.put(verified(rest, sets), "more")
    if not more.isEmpty():
        roots = staged.put(components(linked.union(more), staged), "all_roots")
    for name in ("lists", "sets", "tried", "tallied", "grouped", "rest"):
        staged.drop(name)
    return roots
