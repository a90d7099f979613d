"""Exact substring dedup by difference-cover anchors.

A window of 13 words holds 7 starts of windows of 7 words. {1, 2, 4} modulo 7 is a difference cover:
for any two places i and j there is a shift below 7 at which both are in the cover. So wherever two
documents share 13 words they share an anchor, a window of 7 words that starts at a cover position,
with the same place in the match. Anchors are hashed at 3 of 7 positions only; those of a single
document drop out. The rest extend: each window of 13 words around a shared anchor is keyed by 128
bits, and the smallest doc_id of a key decides who keeps the words.

Entries travel packed, one row for each batch of documents and part of the hashes, and meet in their
part as sorted arrays. The number of parts follows the bytes of text, and a task holds one part at a time, so its memory
does not grow with the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, small_batches

PERIOD = 7
COVER = (1, 2, 4)
WINDOW = 13
ANCHOR = WINDOW - PERIOD + 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes], cache: dict, seed: int = 0) -> np.ndarray:
    """64-bit hashes of words; cache: kept over the documents of a batch."""
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w, seed)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def window_hashes(h: np.ndarray, size: int, odd: np.uint64 = _ODD) -> np.ndarray:
    """Hash of each run of size word hashes, by its polynomial modulo 2**64, mixed."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * odd + h[k : k + n]
    return _mix(out)


def _hashed(b: pa.RecordBatch, cache: dict, cache_size: int = 300_000):
    """A batch (doc, v, raw), its words by document, hashes of all words, first word of each document."""
    docs = [(x or b"").split() for x in b.column(2).to_pylist()]
    if len(cache) > cache_size:
        cache.clear()
    h = word_hashes([w for d in docs for w in d], cache)
    return b, docs, h, np.cumsum([0, *map(len, docs)])


def _places(b, docs, bounds):
    """For each word of the batch: its document's row, its place there, words of that document."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(docs)), n)
    return row, np.arange(bounds[-1]) - bounds[:-1][row], n[row]


def _packed(key: list[np.ndarray], docs: np.ndarray, v: np.ndarray, row: np.ndarray, at: np.ndarray, known: np.ndarray) -> bytes:
    """Entries of one batch and part, few bytes each: ids go once, entries name them by their place."""
    used, place = np.unique(row, return_inverse=True)
    wide = len(at) and at.max() > 0xFFFF
    some = v[used]
    head = np.array([len(used), len(at), len(key), bool(wide), bool(some.any())], np.int64)
    cols = [head, docs[used], some if some.any() else some[:0], *key, place.astype(np.uint16), (at & 0xFFFF).astype(np.uint16), (at >> 16).astype(np.uint16) if wide else at[:0], np.packbits(known)]
    return b"".join(np.ascontiguousarray(c).tobytes() for c in cols)


def _unpacked(data: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, doc, v, at, known) of each entry."""
    k, n, keys, wide, some = np.frombuffer(data, np.int64, 5).tolist()
    pos = 40

    def take(kind, count):
        nonlocal pos
        out = np.frombuffer(data, kind, count, pos)
        pos += out.nbytes
        return out

    docs = take(np.int64, k)
    v = take(np.int64, k) if some else np.zeros(k, np.int64)
    key = [take(np.uint32, n) for _ in range(keys)]
    place, at = take(np.uint16, n), take(np.uint16, n).astype(np.int64)
    at = at + (take(np.uint16, n).astype(np.int64) << 16) if wide else at
    return key, docs[place], v[place], at, np.unpackbits(take(np.uint8, -(-n // 8)), count=n).astype(bool)


def _extremes(key: list[np.ndarray], doc: np.ndarray):
    """Order by key, and for each entry in it the least and largest doc of its key, and where each key starts."""
    order = np.argsort(key[0], kind="stable") if len(key) == 1 else np.lexsort(key[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in key])
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(order)))
    lo, hi = (np.repeat(f.reduceat(doc[order], starts), n) for f in (np.minimum, np.maximum)) if len(order) else (doc, doc)
    return order, lo, hi, new


_ROW = pa.schema([("p", pa.int32()), ("home", pa.int64()), ("data", pa.binary())])
ROW = "p int, home long, data binary"
#: Bytes of text whose entries meet in one part.
PART_BYTES = 16 << 20
#: Places found that a task keeps before it packs them by home, beyond those of one part.
PLACES = 1 << 20
#: Documents whose places travel in one row.
HOME = 64


def home_of(doc: np.ndarray, homes: int) -> np.ndarray:
    return (doc ^ (doc.view(np.uint64) >> np.uint64(23)).view(np.int64)) % homes


def home_column(homes: int) -> Column:
    """home_of() in the plan; rows without an id are spread by their texts."""
    mixed = F.col("doc").bitwiseXOR(F.shiftrightunsigned("doc", 23))
    return F.pmod(F.coalesce(mixed, F.xxhash64("raw")), F.lit(homes).cast("long")).alias("home")


def _homes(doc: np.ndarray, v: np.ndarray, at: np.ndarray, homes: int) -> tuple[list[int], list[bytes]]:
    """Places packed by home: documents, their numbers of places, the places."""
    home = home_of(doc, homes)
    order = np.lexsort((at, v, doc, home))
    home, doc, v, at = home[order], doc[order], v[order], at[order].astype(np.int32)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(doc)))
    ids, out = [], []
    cut = np.flatnonzero(np.diff(home[first], prepend=-1, append=-1)) if len(first) else []
    for i, j in zip(cut[:-1], cut[1:]):
        f = first[i:j]
        ids.append(int(home[f[0]]))
        out.append(b"".join(x.tobytes() for x in (np.int64(j - i), doc[f], v[f], n[i:j], at[f[0] : f[0] + n[i:j].sum()])))
    return ids, out


def _placed(data: bytes):
    """((doc, v), places) of each document of a row."""
    k = int(np.frombuffer(data, np.int64, 1)[0])
    doc, v, n = np.frombuffer(data, np.int64, 3 * k, 8).reshape(3, k)
    at = np.frombuffer(data, np.int32, -1, 8 + 24 * k)
    return zip(zip(doc.tolist(), v.tolist()), np.split(at, np.cumsum(n)[:-1]))


def _rows(p: list[int], data: list[bytes], homes: list[int], placed: list[bytes]) -> pa.RecordBatch:
    """Entries for the parts, and settled places for their homes, which pass through any part."""
    none = len(p)
    cols = [pa.array([*p, *(h % 4096 for h in homes)], pa.int32()), pa.array([*[None] * none, *homes], pa.int64()), pa.array([*data, *placed], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, schema=_ROW)


def _deal(key: list[np.ndarray], part: np.ndarray, parts: int, homes: int, ids, v, row, at, settle: bool) -> pa.RecordBatch:
    """One batch's share: what it can settle itself, and one packed row for each part.

    settle: anchors that the batch has in two documents are shared, all their places known, and one entry speaks for
    them. Otherwise (windows) all but the least document of a key are to be cut, and its entries speak for them. So
    a hash that a third of all documents share sends as many entries as there are batches.
    """
    order, lo, hi, new = _extremes([part, *key], ids[row])
    key, part, row, at = [k[order] for k in key], part[order], row[order], at[order]
    if settle:
        done = lo < hi
        sent, known = ~done | new, done
    else:
        done = ids[row] > lo
        sent, known = ~done, np.zeros(len(row), bool)
    cut = np.searchsorted(part[sent], np.arange(parts + 1))
    cols = [x[sent] for x in (*key, row, at, known)]
    p, data = [], []
    for i in np.flatnonzero(np.diff(cut)).tolist():
        *k, r, a, f = (x[cut[i] : cut[i + 1]] for x in cols)
        p.append(i)
        data.append(_packed(k, ids, v, r, a, f))
    return _rows(p, data, *_homes(ids[row[done]], v[row[done]], at[done], homes))


def _meet(batches, settle: bool, homes: int):
    """Entries of a part meet, one part after the other: places of shared anchors, or of windows to cut, by home; settled rows pass."""
    at_part, got, made = None, [], []
    for b in batches:
        entries = b.column(1).is_null()
        some = b.filter(entries)
        for p, data in zip(some.column(0).to_pylist(), some.column(2).to_pylist()):
            if p != at_part and got:
                made.append(_met(got, settle))
                got = []
                if sum(len(x[0]) for x in made) > PLACES:
                    yield _by_home(made, homes)
                    made = []
            at_part = p
            got.append(_unpacked(data))
        if some.num_rows < b.num_rows:
            yield b.filter(pa.compute.invert(entries)).select(["home", "data"])
    if got:
        made.append(_met(got, settle))
    if made:
        yield _by_home(made, homes)


def _by_home(made: list, homes: int) -> pa.RecordBatch:
    """The places of several parts, one row a home."""
    return _rows([], [], *_homes(*(np.concatenate(x) for x in zip(*made)), homes)).select(["home", "data"])


def _met(got: list, settle: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = [np.concatenate(x) for x in zip(*(g[0] for g in got))]
    doc, v, at, known = (np.concatenate(x) for x in list(zip(*got))[1:])
    got.clear()
    order, lo, hi, new = _extremes(key, doc)
    if settle:
        group = np.cumsum(new) - 1
        any_known = np.bincount(group, weights=known[order]) > 0
        take = ((lo < hi) | any_known[group]) & ~known[order]
    else:
        take = doc[order] > lo
    order = order[take]
    return doc[order], v[order], at[order]


def _with_places(batches):
    """Rows (home, doc, v, raw, data) sorted by home, those with data first -> batches of documents and their places."""
    places: dict = {}
    for b in batches:
        told = b.column(4).is_valid()
        homes = b.column(0).to_pylist()
        for h, data in zip(b.filter(told).column(0).to_pylist(), b.filter(told).column(4).to_pylist()):
            for key, at in _placed(data):
                places.setdefault((h, *key), []).append(at)
        rows = b.filter(pa.compute.invert(told))
        if rows.num_rows:
            keys = zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist())
            none = [np.zeros(0, np.int32)]
            yield rows.select(["doc", "v", "raw"]), [np.concatenate(places.get(k, none)) for k in keys]
        places = {k: x for k, x in places.items() if k[0] == homes[-1]}  # a home may go on in the next batch


def _anchors(batches, parts: int, homes: int):
    """Anchors of all documents, by 32 bits of their hash beyond the part: a chance collision only costs a look later."""
    cache: dict = {}
    for b in batches:
        b, docs, h, bounds = _hashed(b, cache)
        ids, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        a = window_hashes(h, ANCHOR)
        row, at, n = _places(b, docs, bounds)
        row, at, n = row[: len(a)], at[: len(a)], n[: len(a)]
        ok = np.isin(at % PERIOD, COVER) & (at + ANCHOR <= n) & (n >= WINDOW)
        a = a[ok]
        yield _deal([(a >> np.uint64(32)).astype(np.uint32)], ((a & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32), parts, homes, ids, v, row[ok], at[ok], True)


def _windows(batches, parts: int, homes: int):
    """Each window of 13 words around a shared anchor, by 128 bits of two hashes."""
    cache: dict = {}
    for rows, places in _with_places(batches):
        some = np.array([len(x) > 0 for x in places])
        if not some.any():
            continue
        places = [x for x in places if len(x)]
        b, docs, h, bounds = _hashed(rows.filter(pa.array(some)), cache)
        ids, v = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        k1, k2 = window_hashes(h, WINDOW), window_hashes(_mix(h + _ODD), WINDOW, np.uint64(0xD1342543DE82EF95))
        want = np.zeros(len(h) + 1, bool)
        for s, anchors in zip(bounds, places):
            want[s + anchors] = True
        near = np.zeros(len(k1), bool)
        for d in range(PERIOD):
            near |= want[d : d + len(k1)]
        row, at, n = _places(b, docs, bounds)
        row, at, n = row[: len(k1)], at[: len(k1)], n[: len(k1)]
        ok = near & (at + WINDOW <= n)
        k1, k2 = k1[ok], k2[ok]
        low = np.uint64(0xFFFFFFFF)
        key = [(k1 >> np.uint64(32)).astype(np.uint32), (k1 & low).astype(np.uint32), (k2 >> np.uint64(32)).astype(np.uint32)]
        yield _deal(key, ((k2 & low) % np.uint64(parts)).astype(np.int32), parts, homes, ids, v, row[ok], at[ok], False)


def _result(batches):
    """The rows of the result from documents and the starts of their windows to cut."""
    for b, places in _with_places(batches):
        out = []
        for doc, raw, starts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), places):
            words = (raw or b"").split()
            kept, gone = words, 0
            if len(starts):
                edge = np.zeros(len(words) + 1, np.int64)
                s = np.unique(starts)
                edge[s] += 1
                edge[s + WINDOW] -= 1
                out_of = np.cumsum(edge[:-1]) > 0
                kept, gone = [w for w, x in zip(words, out_of.tolist()) if not x], int(out_of.sum())
            text = b" ".join(kept)
            out.append((doc, len(words), gone, hashlib.sha256(text).hexdigest(), text))
        cols = list(zip(*out)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_removed, kept_sha256, kept (the words kept, as UTF-8).

    Null texts have no words. Rows with the same doc_id are one document for the comparison: they never
    remove from each other, but each is cut by smaller ids (their texts may differ: v tells them apart). A row without doc_id is returned whole and is not
    compared. An empty table gives no rows; columns other than the id and the text are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    staged = Staged(spark, "substring")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("raw"))
    repeated = not rows.groupBy("doc").count().where("count > 1").isEmpty()
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()
    rows = rows.select("doc", (F.xxhash64("raw") if repeated else F.lit(0).cast("long")).alias("v"), "raw")
    named = rows.where("doc is not null")
    parts, homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES)), (n // HOME) | 1  # odd: ids in even steps spread too

    def meet(dealt: DataFrame, settle: bool, name: str) -> DataFrame:
        return staged.put(dealt.repartition(parts, "p").sortWithinPartitions("p").mapInArrow(lambda bs: _meet(bs, settle, homes), "home long, data binary"), name)

    def beside(docs: DataFrame, places: DataFrame) -> DataFrame:
        """Documents and the rows with their places, sorted so that places come first within a home."""
        spread = docs.select(home_column(homes), "doc", "v", "raw", F.lit(None).cast("binary").alias("data"))
        told = places.select("home", *(F.lit(None).cast(t).alias(c) for c, t in (("doc", "long"), ("v", "long"), ("raw", "binary"))), "data")
        return spread.union(told).repartition("home").sortWithinPartitions("home", F.col("data").isNull())

    places = meet(named.mapInArrow(lambda bs: _anchors(bs, parts, homes), ROW), True, "places")
    gone = meet(beside(named, places).mapInArrow(lambda bs: _windows(bs, parts, homes), ROW), False, "gone")
    staged.drop("places")
    return beside(rows, gone).mapInArrow(_result, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
