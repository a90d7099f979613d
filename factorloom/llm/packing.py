"""Best-fit packing by a grouping genetic algorithm over the histogram of piece lengths.

A packing is a multiset of bin patterns (the lengths in one bin), so its size follows the number of
distinct lengths and not the number of documents. Islands evolve packings of the whole histogram on
the executors: crossover injects whole well-filled bins of one parent into the other, bins that hold
pieces twice lose, and displaced pieces go where they fit best. After each epoch every island passes
its best packing to the next one. The winner's bins are then dealt out to the pieces by rank.
"""

from __future__ import annotations

import bisect
import functools
import json
import operator
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Staged, small_batches, worker_state

CAPACITY = 2048
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Parts of texts kept per worker, also while it idles; the cache is emptied when it is full. A sixth of it takes 170 MB less a worker
#: and more time; results do not depend on it.
CACHE = 1_200_000
#: Signs that never join the letters before them in one token.
SIGNS = ".,;:!?#$%&*()[]"
WORD_END = "</w>"


class Encoder:
    """Texts -> little-endian unsigned 32-bit ids. A vocabulary without word ends encodes whole texts.

    With word ends, which drop white space: no token and no normalisation of such a vocabulary reaches across a space or a line end, so each
    part between these is encoded once. A part of letters and signs is its word and its signs; new words are encoded many at once and told
    apart by their word ends. Any other part goes to the tokenizer by itself.
    """

    def __init__(self, path: str, cache_size: int = CACHE):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.tokenizer, self.size = Tokenizer.from_file(path), cache_size
        self.known: dict[str, bytes] = {}  # of parts; grows past the limit by one call at most
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        self.whole = not self._ends_words()

    def _ends_words(self) -> bool:
        """Whether the vocabulary lower-cases, ends words and drops white space, so that parts can be encoded by themselves."""
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        said = ["Ab", "naïve", "x.", "12-3", "(It's)"]
        parts = [ids(x) for x in said]
        return all(x and self.ends[x[-1]] for x in parts) and ids("  ".join(said)) == sum(parts, []) == ids("\n".join(x.lower() for x in said))

    def _words(self, words: list[str]) -> None:
        """Words of letters only."""
        groups = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        for some, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype="<u4")
            cut = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cut) != len(some):  # a letter whose lower case is no single letter
                self._parts(some)
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, cut):
                self.known[w] = raw[at:end]
                at = end

    def _parts(self, parts: list[str]) -> None:
        for p, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.known[p] = np.array(e.ids, dtype="<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        known, words, parts, made = self.known, [], [], []
        for p in new:
            if p.isalpha() and (p.isascii() or p.lower().isalpha()):  # a lower case with marks would join signs
                words.append(p)
                continue
            core = p.rstrip(SIGNS)
            if core != p and core.isalpha() and (core.isascii() or core.lower().isalpha()):
                made.append((p, core, p[len(core) :]))
            else:
                parts.append(p)
        if made:
            words = list({*words, *(c for _, c, _ in made if c not in known)})
            parts = list({*parts, *(s for *_, s in made if s not in known)})
        self._words(words)
        self._parts(parts)
        for p, core, sign in made:
            known[p] = known[core] + known[sign]

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if len(self.known) > self.size:
            self.known.clear()
        get = self.known.get
        # Lower case first leaves fewer parts; not where the tokenizer would see other letters or a special token.
        split = [(t if "\u03a3" in t or "<|" in t else t.lower()).replace("\n", " ").split(" ") for t in texts]
        found = [[*map(get, x)] for x in split]
        gaps = [[i for i, v in enumerate(f) if v is None] if None in f else () for f in found]
        new = {x[i] for x, g in zip(split, gaps) for i in g}
        if new:
            self._learn(new)
            for x, f, g in zip(split, found, gaps):
                for i in g:
                    f[i] = get(x[i])
        return [*map(b"".join, found)]


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """The worker's encoder, kept over its tasks."""
    return worker_state(f"encoder_{zlib.crc32(path.encode())}_{cache}", lambda: Encoder(path, cache))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", cache: int = CACHE) -> DataFrame:
    """One row per piece of a document: its ids, then end_id, cut at capacity where they are more."""

    def run(batches):
        encode, end = encoder(tokenizer_path, cache), int(end_id).to_bytes(4, "little")
        for b in batches:
            out = []
            ids = b.column(0).to_pylist()
            texts = [x or "" for x in b.column(1).to_pylist()]
            for at in range(0, len(texts), 100):
                for doc, raw in zip(ids[at : at + 100], encode(texts[at : at + 100])):
                    raw += end
                    for k, s in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[s : s + 4 * capacity]
                        out.append((doc, k, s // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECE)


Packing = dict[tuple[int, ...], int]


@functools.lru_cache(1 << 16)
def shape(pattern: tuple[int, ...]) -> tuple[int, tuple[tuple[int, int], ...]]:
    """The length of a bin's pieces, and how often it holds each; most patterns outlive many generations."""
    return sum(pattern), tuple(Counter(pattern).items())


def fullest_first(x: Packing) -> list[tuple[int, ...]]:
    return sorted(x, key=lambda p: (-shape(p)[0], p))


def best_fit(left: dict[int, int], capacity: int, bins: Packing | None = None) -> Packing:
    """Places the counted lengths, longest first, each in the open bin with the least room that holds it.

    Equal bins are handled together: the cost follows distinct lengths and patterns, not pieces.
    """
    out: Counter = Counter()
    open_: dict[int, list] = {}
    for p, m in (bins or {}).items():
        room = capacity - shape(p)[0]
        if room:
            open_.setdefault(room, []).append([p, m])
        else:
            out[p] += m
    rooms = sorted(open_)

    def add(p, m, room):
        if not room:
            out[p] += m
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append([p, m])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    add((length,) * each, full, capacity - each * length)
                if rest:
                    add((length,) * rest, 1, capacity - rest * length)
                break
            room = rooms[at]
            group = open_[room]
            p, m = group.pop()
            if not group:
                del open_[room]
                rooms.pop(at)
            q = min(n, m)
            n -= q
            if m > q:
                add(p, m - q, room)
            add(tuple(sorted((*p, length), reverse=True)), q, room - length)
    for group in open_.values():
        for p, m in group:
            out[p] += m
    return dict(out)


def fitness(x: Packing, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled unevenly, which leaves large gaps to use."""
    return -sum(x.values()), sum(m * (shape(p)[0] / capacity) ** 2 for p, m in x.items())


def crossover(a: Packing, b: Packing, hist: dict[int, int], capacity: int, rng: np.random.Generator) -> Packing:
    """A child of a with whole well-filled bins of b."""
    left, child = dict(hist), Counter()

    def take(p, m):
        need = shape(p)[1]
        q = min([m, *(left.get(x, 0) // c for x, c in need)])
        if q > 0:
            child[p] += q
            for x, c in need:
                left[x] -= q * c

    best = fullest_first(b)
    for p in best[: max(1, len(best) // 2)]:
        if rng.random() < 0.5:
            take(p, int(rng.integers(1, b[p] + 1)))
    kept = fullest_first(a)
    for p in kept[: max(1, int(len(kept) * rng.uniform(0.6, 0.98)))]:
        take(p, a[p])
    return best_fit({x: n for x, n in left.items() if n > 0}, capacity, dict(child))


def bins(x: Packing) -> int:
    return sum(x.values())


def least_bins(hist: dict[int, int], capacity: int) -> int:
    """No packing has fewer."""
    return -(-sum(x * n for x, n in hist.items()) // capacity)


def evolve(hist: dict[int, int], capacity: int, seed: int, elites: list[Packing], population: int, generations: int) -> Packing:
    """One epoch of one island: from packings of random order, children by crossover until one has the least bins that any
    packing can have. The plain best fit takes part only at the end, as what the island must not fall short of."""
    rng, least = np.random.default_rng(seed), least_bins(hist, capacity)
    ranked = lambda x: (fitness(x, capacity), x)
    first_of = operator.itemgetter(0)
    people = list(elites)
    while len(people) < population:
        some = {x: int(rng.integers(0, n + 1)) for x, n in hist.items()}
        first = best_fit({x: n for x, n in some.items() if n}, capacity)
        people.append(best_fit({x: n - some[x] for x, n in hist.items() if n > some[x]}, capacity, first))
    people = [*map(ranked, people)]  # a packing is measured once
    for _ in range(generations):
        people.sort(key=first_of, reverse=True)
        i = int(rng.integers(0, max(1, population // 2)))
        j = (i + 1 + int(rng.integers(0, population - 1))) % population if population > 1 else i
        a, b = people[i][1], people[j][1]
        people[-1] = max(ranked(crossover(a, b, hist, capacity, rng)), ranked(crossover(b, a, hist, capacity, rng)), key=first_of)
        if bins(people[-1][1]) <= least:
            break
    return max([*people, ranked(best_fit(hist, capacity))], key=first_of)[1]


def pack(spark: SparkSession, hist: dict[int, int], capacity: int, islands: int = 4, epochs: int = 4, population: int = 12, generations: int = 30, seed: int = 7) -> Packing:
    """The islands: one task each and epoch; in between the elites, of bounded size, move on in a ring. No epoch follows one
    that reached the least bins that any packing can have."""
    elites: list[list] = [[] for _ in range(islands)]
    if not hist:
        return {}

    def run(rows):
        for pdf in rows:
            out = []
            for island, epoch, text in zip(pdf.island, pdf.epoch, pdf.elites):
                came = [{tuple(p): m for p, m in json.loads(text)}] if text != "[]" else []
                best = evolve(hist, capacity, seed + 1000 * int(epoch) + int(island), came, population, generations)
                out.append((island, json.dumps([[p, m] for p, m in sorted(best.items())])))
            yield pd.DataFrame(out, columns=["island", "best"])

    for epoch in range(epochs):
        rows = [(i, epoch, json.dumps(elites[i])) for i in range(islands)]
        task = spark.createDataFrame(rows, "island int, epoch int, elites string").repartitionByRange(islands, "island")
        best = {r.island: json.loads(r.best) for r in task.mapInPandas(run, "island int, best string").collect()}
        elites = [best[(i - 1) % islands] for i in range(islands)]
        if min(sum(m for _, m in e) for e in elites) <= least_bins(hist, capacity):
            break
    return max(({tuple(p): m for p, m in e} for e in elites), key=lambda x: (fitness(x, capacity), sorted(x.items())))


def slots(packing: Packing) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, places a sequence, offset of the first place), by first rank.

    A sequence holds its pieces longest first, so equal lengths stand next to each other.
    """
    out: dict[int, list] = {}
    used: Counter = Counter()
    base = 0
    for p, m in sorted(packing.items(), key=lambda x: (-sum(x[0]), x[0])):
        offset = 0
        for length, c in sorted(Counter(p).items(), reverse=True):
            out.setdefault(length, []).append((used[length], base, c, offset))
            used[length] += m * c
            offset += length * c
        base += m
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def assign(parts: DataFrame, packing: Packing, chunk_rows: int = 20_000) -> DataFrame:
    """Deals the packing's places out: the pieces of one length take them by rank. Ranks are counted in chunks
    of hashed row numbers, and shifted by the counts of the chunks before, so no length, id or text meets in one task."""
    spark = parts.sparkSession
    n = sum(m * len(p) for p, m in packing.items())
    chunks = max(1, n // chunk_rows)
    places = spark.sparkContext.broadcast(slots(packing))  # bounded by distinct lengths and patterns
    parts = parts.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.groupBy("length", "chunk").agg(F.count("*").alias("n")).select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rank = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("row"))
    ranked = parts.withColumn("rank", rank).join(shift, ["length", "chunk"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("shift") + F.col("rank") - 1).alias("at"))

    def run(batches):
        table = places.value
        for b in batches:
            length, at = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            for x in np.unique(length):
                mine, t = length == x, table[int(x)]
                row = t[np.searchsorted(t[:, 0], at[mine], side="right") - 1]
                k = at[mine] - row[:, 0]
                seq[mine], off[mine] = row[:, 1] + k // row[:, 2], row[:, 3] + (k % row[:, 2]) * x
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PIECE + ", sequence_id long, offset long")


def best_fit_pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, cache: int = CACHE, **ga) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece that holds end_id alone. A row without doc_id keeps the null.
    Repeated rows are packed each by itself; pieces of one length take their places in no order that means anything. An
    empty table gives no rows; columns other than the id and the text are not read.
    """
    staged = Staged(docs.sparkSession, "packing")
    parts = staged.put(pieces(docs, tokenizer_path, capacity, end_id, cache=cache).withColumn("row", F.monotonically_increasing_id()), "pieces")
    hist = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    return assign(parts, pack(docs.sparkSession, hist, capacity, **ga))
