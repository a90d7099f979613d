"""Benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with e edits shares at least m + 1 - q(e + 1) of its
q-grams with it, and their diagonals (place in the text less place in the item) span e at most.
So q-gram hits are counted in overlapping bands of diagonals, 2(e + 1) wide and e + 1 apart: some band
holds all hits of a true region. Bands that meet the bound are verified by an alignment of the whole item
that is restricted to the diagonals of the band and e more on either side, which no path of e edits leaves.
Items too short for shared q-grams are found whole, between word ends. The benchmark is the stated query set: it goes to
the workers in parts whose index has a bounded size, and the texts are read once for each part.
"""

from __future__ import annotations

import uuid
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_state

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: q for items of at least so many characters; shorter ones are sought exactly, between word ends.
GRAMS = ((48, 12), (12, 4))
SHORTEST = GRAMS[-1][0]
#: Characters of items in one part: a gram each, of 16 bytes in the index, and a bit table of 64 MB at most beside it.
PART_CHARS = 8 << 20
#: Characters of texts and hits of grams that are held at once.
CHUNK_CHARS, CHUNK_HITS = 1 << 20, 1 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
_FAR = 1 << 20


def normalise(text: str | None) -> str:
    """Lower case, one space for each run of white space: what detection compares."""
    return " ".join((text or "").lower().split())


def edit_budget(m: int, q: int, chars_per_edit: int = CHARS_PER_EDIT) -> int:
    """Edits allowed for m characters; fewer where the lemma would guarantee no shared q-gram."""
    return max(0, min(m // chars_per_edit, m // q - 1, (m + 1) // q - 2 if q > 1 else 0))


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams of code points, put together from powers of two."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size, b = None, 0, codes.astype(np.uint64), 1, int(_B)
    while True:
        if q & size:
            if out is None:
                out = power[:n].copy()
            else:
                out = out * np.uint64(b) + power[done : done + n]
            done += size
        if 2 * size > q:
            break
        power = power[:-size] * np.uint64(b) + power[size:]
        b, size = b * b % (1 << 64), 2 * size
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


class Index:
    """The q-grams of all items of one class, sorted by hash, behind a bit table that most text positions fail."""

    def __init__(self, items: list[tuple[int, str]], q: int, chars_per_edit: int):
        self.q = q
        self.texts = [_codes(t) for _, t in items]
        self.ids = [i for i, _ in items]
        self.edits = np.array([edit_budget(len(t), q, chars_per_edit) for t in self.texts], np.int64)
        self.least = np.array([max(1, len(t) + 1 - q * (int(e) + 1)) for t, e in zip(self.texts, self.edits)], np.int64)
        grams = [gram_hashes(t, q) for t in self.texts]
        h = np.concatenate(grams)
        order = np.argsort(h, kind="stable")
        self.hash = h[order]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(g) for g in grams])[order]
        self.at = np.concatenate([np.arange(len(g), dtype=np.int32) for g in grams])[order]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.bits = max(16, min(26, int(len(h)).bit_length() + 8))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[h >> np.uint64(64 - self.bits)] = True

    def hits(self, codes: np.ndarray, bounds: np.ndarray):
        """(place in the text, item, place in the item) of each shared q-gram of the documents, some at a time."""
        h = gram_hashes(codes, self.q)
        pos = np.flatnonzero(self.table[h >> np.uint64(64 - self.bits)])
        pos = pos[pos + self.q <= bounds[np.searchsorted(bounds, pos, "right")]]
        lo, hi = np.searchsorted(self.hash, h[pos], "left"), np.searchsorted(self.hash, h[pos], "right")
        n = hi - lo
        pos, lo, n = pos[n > 0], lo[n > 0], n[n > 0]
        part = np.cumsum(n) // CHUNK_HITS
        for s, e in zip(*(x.tolist() for x in _runs(part))):
            p, few, m = pos[s:e], lo[s:e], n[s:e]
            k = np.repeat(few, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            yield np.repeat(p, m), self.item[k].astype(np.int64), self.at[k].astype(np.int64)

    def bands(self, codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
        """(document, item, band) of the bands that meet the bound. A gram of the item counts once in a band and part of the hits."""
        found = []
        longest = int(np.diff(bounds).max(initial=0)) + int(self.size.max(initial=0)) + 2  # bands of a document and item
        widest = int(self.size.max(initial=0)) + 1
        packs = (len(bounds) * len(self.ids) * longest * widest).bit_length() < 63
        for pos, item, at in self.hits(codes, bounds):
            doc = np.searchsorted(bounds, pos, "right") - 1
            step = self.edits[item] + 1
            band = (pos - bounds[doc] - at + self.size[item]) // step  # diagonals, shifted so that none is negative
            key = (doc * len(self.ids) + item) * longest + band + 1
            key = np.concatenate([key, key - 1])  # two bands hold a diagonal
            if packs:  # else a repeated gram counts again, which costs a look
                key = np.unique(key * widest + np.tile(at, 2)) // widest
            found.append(np.unique(key, return_counts=True))
        if not found:
            return []
        key, count = (np.concatenate(x) for x in zip(*found))
        key, place = np.unique(key, return_inverse=True)
        count = np.bincount(place, weights=count)
        (doc, item), band = np.divmod(key // longest, len(self.ids)), key % longest - 1
        keep = count >= self.least[item]
        return list(zip(doc[keep].tolist(), item[keep].tolist(), band[keep].tolist()))

    def regions(self, codes: np.ndarray, bounds: np.ndarray):
        """(document, item_id, start, end, edits, shared): of regions of an item that overlap, the one of fewest edits, the earliest end of ties."""
        of: dict = {}
        for d, i, b in self.bands(codes, bounds):
            e, t, some = int(self.edits[i]), self.texts[i], of.setdefault((d, i), [])
            low = b * (e + 1) - len(t)
            if any(x[0] == 0 and low <= x[2] <= low + 2 * e + 1 for x in some):
                continue  # the band before has it whole
            text = codes[bounds[d] : bounds[d + 1]]
            exact = next((k for k in range(max(0, low), low + 2 * e + 2) if k + len(t) <= len(text) and np.array_equal(text[k : k + len(t)], t)), None)
            x = banded(t, text, low - e, low + 3 * e + 1, e) if exact is None else (0, exact, exact + len(t))
            if x:
                some.append((x[0], x[2], x[1]))
        for (d, i), some in of.items():
            taken: list = []
            for e, end, start in sorted(set(some)):
                if all(end <= s or x <= start for s, x in taken):
                    taken.append((start, end))
                    own = np.isin(gram_hashes(self.texts[i], self.q), gram_hashes(codes[bounds[d] + start : bounds[d] + end], self.q))
                    yield d, self.ids[i], start, end, e, int(own.sum())


def _runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal rows."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(columns[0]))


class ShortIndex:
    """Items of fewer than SHORTEST characters, by their length and the hash of the whole."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.of: dict[int, dict[str, list]] = {}
        for i, t in items:
            self.of.setdefault(len(t), {}).setdefault(t, []).append(i)
        self.hash = {m: np.unique(np.concatenate([gram_hashes(_codes(t), m) for t in x])) for m, x in self.of.items()}

    def regions(self, codes: np.ndarray, bounds: np.ndarray):
        """(document, item_id, start, end, 0, 0): between word ends, each occurrence."""
        kinds, place = np.unique(codes, return_inverse=True)
        inside = np.array([chr(c).isalnum() for c in kinds.tolist()], bool)[place] if len(codes) else np.zeros(0, bool)
        ends = np.zeros(len(codes) + 1, bool)  # no word goes on over this place
        ends[bounds] = True
        ends[1:-1] |= ~(inside[1:] & inside[:-1])
        for m, items in self.of.items():
            some = np.flatnonzero(ends[: max(0, len(codes) + 1 - m)] & ends[m:])
            some = some[some + m <= bounds[np.searchsorted(bounds, some, "right").clip(max=len(bounds) - 1)]]
            some = some[np.isin(gram_hashes(codes, m)[some], self.hash[m])] if len(some) else some
            for s in some.tolist():
                d = int(np.searchsorted(bounds, s, "right")) - 1
                for i in items.get(codes[s : s + m].tobytes().decode("utf-32-le", "surrogatepass"), ()):
                    yield d, i, s - int(bounds[d]), s - int(bounds[d]) + m, 0, 0


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, limit: int) -> tuple[int, int, int] | None:
    """Least edits to find the whole item in text on diagonals low to high, if limit at most: (edits, start, end in text).
    The earliest end wins ties, then the latest start."""
    m, width = len(item), high - low + 1
    cut = min(max(0, low), len(text))
    text, low = text[cut : max(cut, high + m)], low - cut
    n = len(text)
    ar = np.arange(width)
    left = max(0, -low)
    padded = np.full(left + max(n, low + width + m) + 1, -1, np.int64)
    padded[left : left + n] = text
    start = ar + low
    cost = np.where((start >= 0) & (start <= n), 0, _FAR)
    for i, c in enumerate(item.tolist(), 1):  # row i of the item, place k is i + k + low of the text
        at = left + low + i - 1
        new = cost + (padded[at : at + width] != c)
        skip = cost[1:] + 1  # a character of the item that the text lacks
        better = skip < new[:-1]
        new[:-1][better] = skip[better]
        begin = start.copy()
        begin[:-1][better] = start[1:][better]
        new[max(0, n - i - low + 1) :] = _FAR
        slope = (new - ar) * width + (width - 1 - ar)  # a step along the text costs one: the best place before, the nearest of ties
        src = width - 1 - np.minimum.accumulate(slope) % width
        cost, start = new[src] + (ar - src), begin[src]
        cost[max(0, n - i - low + 1) :] = _FAR
        if cost.min() > limit:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]) + cut, end + m + low + cut


def indexes(items: list[tuple[int | None, str]], chars_per_edit: int) -> list:
    """One for each class of item lengths that occurs."""
    out, top = [], 1 << 62
    for least, q in GRAMS:
        some = [(i, t) for i, t in items if least <= len(t) < top]
        top = least
        if some:
            out.append(Index(some, q, chars_per_edit))
    short = [(i, t) for i, t in items if len(t) < SHORTEST]
    return out + ([ShortIndex(short)] if short else [])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def leaks_in(texts: list[str | None], given: list):
    """(place in texts, item_id, start, end, edits, shared) of each region."""
    texts = [normalise(x) for x in texts]
    size = np.cumsum([len(t) for t in texts])
    for s, e in zip(*(x.tolist() for x in _runs(size // CHUNK_CHARS))):
        codes = _codes("".join(texts[s:e]))
        bounds = np.cumsum([0, *map(len, texts[s:e])])
        for x in given:
            for d, *rest in x.regions(codes, bounds):
                yield s + d, *rest


def benchmark_parts(benchmark: DataFrame, least: int = 1, part_chars: int = PART_CHARS):
    """Lists of (item_id, normalised text) of all items with text of at least so many characters. Each list, and so its
    index, is bounded: a part has about part_chars characters, whatever the size of the benchmark."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = -(-(b.agg(F.sum(F.char_length("text"))).first()[0] or 0) // part_chars)
    for k in range(parts):
        some = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()  # bounded by the count of parts
        items = sorted(((r.item_id, normalise(r.text)) for r in some), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if items := [(i, t) for i, t in items if len(t) >= max(1, least)]:
            yield items


class _Shared:
    """Items as a broadcast; their indexes are built once a worker and kept until it meets other items."""

    def __init__(self, spark, items: list, chars_per_edit: int):
        self.items, self.chars_per_edit, self.key = spark.sparkContext.broadcast(items), chars_per_edit, uuid.uuid4().hex

    def indexes(self) -> list:
        kept = worker_state("benchmark", dict)
        if self.key not in kept:
            kept.clear()
            kept[self.key] = indexes(self.items.value, self.chars_per_edit)
        return kept[self.key]


LEAKS = "doc_id long, item_id long, start long, end long, edits int, shared int"


def find_leaks(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, id_col: str = "doc_id", text_col: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """One row per region of a document that holds a whole benchmark item: doc_id, item_id, start, end (code points of
    the normalised text, end exclusive), edits, shared (places of the item whose q-gram the region has).

    Null and empty texts and items give no region. A row without doc_id reports a null doc_id, an item without item_id
    a null item_id. Repeated rows report each, and so do items of equal text. Of overlapping regions of one item the one of fewest edits
    is reported. Items under 48 characters take smaller grams; under 12 only exact matches between word ends count, with shared 0.
    Empty tables give no rows; columns other than the ids and the texts are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches, given):
        for b in batches:
            ids = b.column(0).to_pylist()
            out = [(ids[d], *rest) for d, *rest in leaks_in(b.column(1).to_pylist(), given.indexes())]
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "start", "end", "edits", "shared"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = [rows.mapInArrow(partial(run, given=_Shared(spark, items, chars_per_edit)), LEAKS) for items in benchmark_parts(benchmark, part_chars=part_chars)]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], LEAKS)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, text_col: str = "text", least: int = SHORTEST, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of docs, all columns, whose text holds no benchmark item of at least so many characters: a shorter one
    ("yes") stands in clean texts too."""
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches, given):
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            ok[[d for d, *_ in leaks_in(b.column(text_col).to_pylist(), given.indexes())]] = False
            yield b.filter(pa.array(ok))

    for items in benchmark_parts(benchmark, least, part_chars):
        docs = docs.mapInArrow(partial(run, given=_Shared(spark, items, chars_per_edit)), docs.schema)
    return docs
