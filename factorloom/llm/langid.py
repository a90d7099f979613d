"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams (1 to 3 code points of the lower-cased text, digits and other
signs folded) with term frequency relative to the text's length. Weights are learned by
follow-the-regularised-leader with an elastic-net penalty, whose l1 part leaves most of them zero;
a temperature fitted on labelled rows kept from training calibrates the probabilities. As tf is a
share, the score of a text of any length is a mean of table entries over its n-grams: whole texts
are scored by one gather, with no per-document feature list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Labelled texts that train the classifier, as expected from the share of hashes taken, dealt out by the languages' counts. They
#: are used as whole texts. A language has its FLOOR-th part of an equal share at least, or all its texts.
SAMPLE = 6_000
FLOOR = 4
UNKNOWN = "und"
#: Term frequencies are shares; times this, steps of the learner have a useful size.
SCALE = 30.0


def fold(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each between two spaces, with everything below the letters folded
    to a space; and the texts' bounds."""
    joined = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 97, np.uint32(32), codes)
    return codes, np.cumsum([0, *map(len, joined)])


def grams(codes: np.ndarray, orders=ORDERS, buckets: int = BUCKETS):
    """For each order: the bucket of the n-gram that starts at each place (n - 1 fewer places)."""
    power = codes.astype(np.uint32) * np.uint32(0x9E3779B1)
    h = power
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ power[n - 1 :]
        if n in orders:
            x = h ^ (h >> np.uint32(15))
            yield n, ((x * np.uint32(0x2C1B3C6D) + np.uint32(n)) >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, term frequencies) of one text: each n-gram's share of them all."""
    codes, _ = fold([text])
    b = np.concatenate([g for _, g in grams(codes)])
    at, n = np.unique(b, return_counts=True)
    return at, n / len(b)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all given texts each bucket occurs, and how many texts there are; summed on the executors."""

    def run(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                codes, _ = fold([text or ""])
                seen = np.zeros(BUCKETS, bool)
                for _, g in grams(codes):
                    seen[g] = True
                df[np.flatnonzero(seen)] += 1
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int32()), pa.array([*df[at], n], pa.int64())], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS + 1 rows at most
    at, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    df = np.zeros(BUCKETS)
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


class Ftrl:
    """Per-coordinate FTRL-proximal for softmax regression; a row of weights per bucket."""

    def __init__(self, classes: int, alpha=0.5, beta=1.0, l1=0.002, l2=0.01):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, v: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(v @ w)
        p[y] -= 1
        g = np.outer(v, p)
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()

    lo, hi, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    """classes; table: idf times weight for each bucket and class; bias; heat: the temperature."""

    def __init__(self, classes: list[str], table: np.ndarray, heat: float):
        self.classes, self.table, self.heat = classes, np.ascontiguousarray(table.T, np.float32), heat

    def parts(self) -> tuple:
        """What a broadcast carries: plain values, so that workers need no import to read them."""
        return self.classes, self.table.T, self.heat

    def logits(self, texts: list[str]) -> np.ndarray:
        codes, bounds = fold(texts)
        total, count = np.zeros((len(texts), len(self.classes))), np.zeros(len(texts))
        for n, g in grams(codes):
            inside = np.maximum(bounds[1:] - bounds[:-1] - n + 1, 0)
            count += inside
            for c in range(len(self.classes)):
                run = np.concatenate([[0.0], np.cumsum(self.table[c][g], dtype=np.float64)])
                total[:, c] += run[np.minimum(bounds[:-1] + inside, len(g))] - run[np.minimum(bounds[:-1], len(g))]
        return total / np.maximum(count, 1)[:, None]

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        p = softmax(self.logits(texts) / self.heat)
        best = p.argmax(axis=1)
        return [self.classes[i] for i in best], p[np.arange(len(best)), best]


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], df: np.ndarray, n_docs: int, epochs: int = 3, kept: int = 5, seed: int = 11) -> Model:
    """rows: (buckets, term frequencies, language). One row in kept calibrates and does not train."""
    classes = sorted({y for *_, y in rows})
    if not classes:
        return Model([UNKNOWN], np.zeros((BUCKETS, 1)), 1.0)
    idf = SCALE * (np.log((1 + n_docs) / (1 + df)) + 1)
    short = idf.astype(np.float32)  # half the bytes: the sample is what the driver holds most of
    made = [(at, v * short[at], classes.index(y)) for at, v, y in rows]
    train, rest = [x for k, x in enumerate(made) if k % kept], [x for k, x in enumerate(made) if not k % kept]
    learner, rng = Ftrl(len(classes)), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            learner.learn(*train[k])
    w = learner.weights()
    logits = np.array([v @ w[at] for at, v, _ in rest]).reshape(-1, len(classes))
    return Model(classes, idf[:, None] * w, temperature(logits, np.array([y for *_, y in rest], int)))


def shares(counts: dict[str, int], sample: int = SAMPLE) -> dict[str, float]:
    """The share of each language's texts to learn from: sample * (1 + 1 / FLOOR) texts at most, in expectation."""
    total, least = sum(counts.values()), max(1.0, sample / (FLOOR * max(1, len(counts))))
    return {k: min(1.0, max(sample * n / total, least) / n) for k, n in counts.items()}


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """labelled: text, lang, all rows to learn from. Document frequencies cover them all; weights come from a sample, bounded
    by the languages' shares in expectation: the texts of the least hashes, each once however often it is copied, of which
    features of fixed size come to the driver."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    df, n = document_frequency(labelled)
    share = shares({r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}, sample)  # a row a language
    top = {k: min(max(int((x - 0.5) * 2**64), -(2**63)), 2**63 - 1) for k, x in share.items()}
    h = F.xxhash64("text", "lang")
    bound = F.element_at(F.map_from_arrays(F.lit(list(top)), F.lit(list(top.values()))), F.col("lang")) if top else F.lit(0)
    some = labelled.where(h <= bound).groupBy(h.alias("h"), "lang").agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            made = [features(x) for x in b.column(1).to_pylist()]
            cols = [pa.array([x.astype(np.int32) for x, _ in made], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, b.column(2)], names=["h", "at", "tf", "lang"])

    rows = some.select("h", "text", "lang").mapInArrow(run, "h long, at array<int>, tf array<float>, lang string").toArrow().sort_by("h")
    at, tf = (rows.column(c).combine_chunks() for c in ("at", "tf"))
    model = fit([(x.values.to_numpy(), v.values.to_numpy(), y) for x, v, y in zip(at, tf, rows.column("lang").to_pylist())], df, n)
    del rows, at, tf
    pa.default_memory_pool().release_unused()
    return model


def held_out(doc_id: Column) -> Column:
    """The fold that is kept from learning, by the id's digits."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, lang_pred, score.

    Texts that are null, empty or without a letter are `und` with score 0. A row without doc_id keeps the null. Repeated rows
    are scored each; an empty table gives no rows. Ties go to the first language in order of name. The score is
    the calibrated probability of lang_pred. Columns other than the id and the text are not read.
    """
    given = docs.sparkSession.sparkContext.broadcast(model.parts())  # BUCKETS x languages

    def run(batches):
        m = Model(*given.value)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            known = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            langs, scores = [], []
            for at in range(0, len(texts), 50):
                x, s = m.predict(texts[at : at + 50])
                langs += x
                scores.append(s)
            score = np.where(known, np.concatenate(scores) if scores else np.zeros(0), 0.0)
            lang = [x if k else UNKNOWN for x, k in zip(langs, known)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("known"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a letter and a language of probability least or more."""
    given = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches):
        m = Model(*given.value)
        for b in batches:
            texts = [x or "" for x in b.column(text_col).to_pylist()]
            ok = [False] * len(texts)
            for at in range(0, len(texts), 50):
                some = texts[at : at + 50]
                for i, (t, s) in enumerate(zip(some, m.predict(some)[1]), at):
                    ok[i] = bool(s >= least) and any(map(str.isalpha, t))
            yield b.filter(pa.array(ok, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
