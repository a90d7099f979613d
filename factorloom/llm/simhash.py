"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Two 64-bit fingerprints at 3 or fewer differing bits differ in at most 3 of their 8 bytes, so they share at least
5 positional bytes. Any 5 of the 8 positions hold one of the 14 quadruples of positions whose numbers XOR to zero. So the
index posts each distinct fingerprint under its bytes at those quadruples; within a posting list the shared
positional bytes of each pair are tallied, pairs of 5 or more stay and are verified by their Hamming distance.

A list agrees in 32 bits, so chance fills it slowly. A list of more than LONG members is dealt out again under one
byte more, which every pair that counts shares too; the lists then agree in 40 bits, 2**24 members at most.
Only links of a spanning forest of a longer list leave the task, never all pairs of a group.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, small_batches

SEED = 42
MAX_BITS = 3
POSITIONS = 8
#: Up to here all pairs of a posting list are tallied side by side; beyond it a forest grows from member to member.
SHORT = 64
#: Up to here a posting list is tallied row against row; beyond it each member probes its neighbourhood.
DENSE = 2048
#: A list of more members is dealt out again.
LONG = 1 << 15


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one text; zero for a null text or one without words."""
    words = (raw or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return majority(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), dtype=np.uint8))


def majority(digests: np.ndarray) -> int:
    """Each bit that is set in over half of the hashes, given as big-endian bytes."""
    hashes = digests.reshape(-1, 8)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long). Null texts have fingerprint zero."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, "doc_id long, fp long")


def cover(matches: int = POSITIONS - MAX_BITS) -> list[tuple[int, ...]]:
    """Sets of positions such that any so many positions hold one of them: quadruples of XOR zero for 5 or more."""
    if matches < 5:
        return list(combinations(range(POSITIONS), matches))
    return [c for c in combinations(range(POSITIONS), 4) if not c[0] ^ c[1] ^ c[2] ^ c[3]]


def mask_of(positions: tuple[int, ...]) -> int:
    """The bytes at these positions, as a signed 64-bit mask."""
    m = sum(0xFF << (8 * i) for i in positions)
    return m - (1 << 64) if m >> 63 else m


def near(a: np.ndarray, b, max_bits: int) -> np.ndarray:
    """Which pairs share enough positional bytes (8 less one a differing bit) and differ in max_bits or fewer."""
    x = a ^ b
    ok = (x.view(np.uint8).reshape(-1, POSITIONS) == 0).sum(axis=1) >= POSITIONS - max_bits
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the fingerprints (distinct, uint64) that link at max_bits or fewer."""
    n = len(fp)
    if n <= DENSE:
        out, left = [], np.arange(n)
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                at = queue.pop()
                close = near(fp[left], fp[at], max_bits)
                found = left[close]
                out += [(at, int(x)) for x in found]
                queue += found.tolist()
                left = left[~close]
        return out
    # A neighbourhood probe: only the bits outside the shared bytes can differ.
    free = [i for i in range(64) if (int(np.bitwise_or.reduce(fp ^ fp[0])) >> i) & 1]
    order = np.argsort(fp)
    fp_sorted, parent, out = fp[order], list(range(n)), []

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(1, max_bits + 1):
        for bits in combinations(free, k):
            other = fp_sorted ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(fp_sorted, other), n - 1)
            for i in np.flatnonzero((fp_sorted[at] == other) & (at > np.arange(n))):
                a, b = find(int(i)), find(int(at[i]))
                if a != b:
                    parent[a] = b
                    out.append((int(order[i]), int(order[at[i]])))
    return out


def side_by_side(start: np.ndarray, size: np.ndarray, most: int):
    """All pairs of places within each of the runs of at most so many, a distance at a time: arrays of the first and the second."""
    short = (size > 1) & (size <= most)
    left = np.repeat(size[short], size[short]) - 1  # members of the run after each one
    place = np.arange(len(left)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])
    at, left = np.repeat(start[short], size[short]) + place, left - place
    for lag in range(1, int(size[short].max()) if short.any() else 0):
        some = at[left >= lag]
        yield some, some + lag


def _within(slot: np.ndarray, key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked fingerprints of whole posting lists that stand one after the other."""
    new = np.ones(len(fp), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(fp)))
    a, b = [], []
    for s, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist()):
        pairs = np.array(_forest(fp[s : s + n], max_bits), dtype=np.int64).reshape(-1, 2) + s
        a.append(fp[pairs[:, 0]])
        b.append(fp[pairs[:, 1]])
    for i, j in side_by_side(start, size, SHORT):
        ok = near(fp[i], fp[j], max_bits)
        a.append(fp[i[ok]])
        b.append(fp[j[ok]])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


LINKS = pa.schema([("slot", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _tallied(batches, max_bits: int, most: int | None):
    """Rows (slot, key, fp) sorted by slot and key -> links (null, a, b), a > b. A list of more than most members is
    passed on row by row as (slot, fp, null)."""

    def out(rows):
        slot, key, fp = (np.concatenate(c) for c in zip(*rows))
        a, b = (x.view(np.int64) for x in _within(slot, key, fp.view(np.uint64), max_bits))
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int32()), pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], schema=LINKS)

    def on(rows):
        slot, _, fp = rows
        return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(fp), pa.nulls(len(fp), pa.int64())], schema=LINKS)

    held: list = []  # the list that may go on in the next batch
    size, passing = 0, None
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
        slot, key, _ = cols
        if not len(slot):
            continue
        if passing is not None:  # the long list of before
            n = int(((slot == passing[0]) & (key == passing[1])).argmin()) if (slot[-1], key[-1]) != passing else len(slot)
            if n:
                yield on([c[:n] for c in cols])
            cols = [c[n:] for c in cols]
            slot, key, _ = cols
            if not len(slot):
                continue
            passing = None
        last = len(slot) - int(((slot == slot[-1]) & (key == key[-1]))[::-1].argmin()) if (slot[0], key[0]) != (slot[-1], key[-1]) else 0
        if held and (last or (held[-1][0][-1], held[-1][1][-1]) != (slot[0], key[0])):
            # What is held ends in this batch: whole lists up to the last one.
            yield out([*held, [c[:last] for c in cols]]) if last else out(held)
            held, size = [], 0
        elif last:
            yield out([[c[:last] for c in cols]])
        held.append([c[last:].copy() for c in cols])
        size += len(slot) - last
        if most is not None and size > most:
            for rows in held:
                yield on(rows)
            passing, held, size = (slot[-1], key[-1]), [], 0
    if held:
        yield out(held)


def links(nodes: DataFrame, max_bits: int = MAX_BITS, staged: Staged | None = None) -> DataFrame:
    """nodes: fp (distinct). Returns links a > b between fingerprints, enough to connect what links at max_bits."""
    staged = staged or Staged(nodes.sparkSession, "links")
    slots = cover(POSITIONS - max_bits)
    deeper = all(len(c) < POSITIONS - max_bits for c in slots)

    def dealt(posts: DataFrame) -> DataFrame:
        return posts.select("slot", "bits", "fp").withColumn("key", F.col("bits").bitwiseAND(F.col("fp"))).select("slot", "key", "fp").repartition("slot", "key").sortWithinPartitions("slot", "key")

    small_batches(nodes.sparkSession, 20_000)
    posts = nodes.select(F.posexplode(F.array(*(F.lit(mask_of(c)) for c in slots))).alias("slot", "bits"), "fp")
    first = dealt(posts).mapInArrow(partial(_tallied, max_bits=max_bits, most=LONG if deeper else None), "slot int, a long, b long")
    if not deeper:
        return first.select("a", "b").distinct()
    first = staged.put(first, "tallied")
    found = first.where("slot is null").select("a", "b")
    again = first.where("slot is not null").select("slot", F.col("a").alias("fp"))
    if not again.isEmpty():
        more = F.array(*(F.array(*(F.lit(mask_of((*c, i))) for i in range(POSITIONS) if i not in c)) for c in slots))
        again = again.select(F.col("slot").alias("quad"), "fp", F.posexplode(F.get(more, F.col("slot"))).alias("k", "bits")).select((F.col("quad") * POSITIONS + F.col("k")).alias("slot"), "bits", "fp")
        found = found.union(dealt(again).mapInArrow(partial(_tallied, max_bits=max_bits, most=None), "slot int, a long, b long").select("a", "b"))
    return found.distinct()


def components(edges: DataFrame, staged: Staged) -> DataFrame:
    """Connected components of links a > b by alternating large and small stars: node, root (the smallest node).

    Each round is staged, so lineage stays short; rounds grow with the logarithm of the longest chain.
    """
    edges, before, k = staged.put(edges, "edges0"), None, 0
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        k += 1
        edges = staged.put(small, f"edges{k}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        staged.drop(f"edges{k - 1}")
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, fingerprint (hex), component_id.

    component_id is the smallest doc_id reachable over fingerprints at max_bits or fewer differing bits.
    Equal fingerprints, so also repeated rows, link. Null and empty texts have fingerprint zero and link
    like any other. A row without doc_id keeps a null doc_id and links like any other by its fingerprint;
    component_id is null only where no row of the component has an id. An empty table gives no rows; columns
    other than the id and the text are not read.
    """
    staged = Staged(docs.sparkSession, "simhash")
    fps = staged.put(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(nodes.select("fp"), max_bits, staged), staged)
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = staged.put(linked.select("fp", F.min("rep").over(Window.partitionBy("root")).alias("component_id")), "components")
    staged.drop("tallied")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
