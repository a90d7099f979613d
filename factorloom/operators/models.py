"""Models of the label: ridge by its normal equations, boosted trees by MLlib, a small network, and tests of single factors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.numeric import EPS, finite, sdiv, zero
from .backtest import pred_xsz_ic
from .linalg import gram
from .sampling import lot, uniform

LEAST_STD = 1e-6


def total(terms: list[Column]) -> Column:
    """Their sum as a balanced tree: a thousand terms are ten deep."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + (terms[-1:] if len(terms) % 2 else [])
    return terms[0]


@dataclass
class Ridge:
    """Weights of standardised features; missing values count as 0 before they are standardised."""

    features: list[str]
    mean: np.ndarray
    std: np.ndarray
    weights: np.ndarray
    intercept: float
    inverse: np.ndarray = field(repr=False, default=None)

    def predict(self) -> Column:
        """The prediction as a plain column, so scoring stays in the JVM."""
        w = self.weights / self.std
        return total([F.lit(float(self.intercept - (w * self.mean).sum())), *(zero(f) * F.lit(float(x)) for f, x in zip(self.features, w))])


def fit_ridge(df: DataFrame, features: list[str], alpha: float = 10.0, top_k: int | None = None, label: str = "label") -> Ridge:
    """(G / n + alpha I) w = c / n on labelled rows; with top_k only the features of the largest |covariance| with the label.

    The rows are summed into one small matrix by the executors; the driver solves for as many numbers as features.
    """
    rows = df.where(F.col(label).isNotNull()).select(*(zero(f).alias(f) for f in features), zero(label).alias("_y"))
    g, s, n = gram(rows, [*features, "_y"])
    k = len(features)
    if not n:
        return Ridge(features, np.zeros(k), np.ones(k), np.zeros(k), 0.0, np.eye(k))
    mean, ymean = s[:k] / n, s[k] / n
    std = np.maximum(np.sqrt(np.maximum(np.diag(g)[:k] / n - mean**2, 0)), LEAST_STD)
    cov = (g[:k, k] / n - mean * ymean) / std
    pick = np.arange(k) if top_k is None or top_k >= k else np.sort(np.lexsort((np.arange(k), -np.abs(cov)))[:top_k])
    c = (g[np.ix_(pick, pick)] / n - np.outer(mean[pick], mean[pick])) / np.outer(std[pick], std[pick])
    inverse = np.linalg.inv(c + alpha * np.eye(len(pick)))
    return Ridge([features[i] for i in pick], mean[pick], std[pick], inverse @ cov[pick], float(ymean), inverse)


def leave_one_out(df: DataFrame, model: Ridge, label: str = "label") -> DataFrame:
    """factor, base_ic, drop_ic, delta: the cross-sectional IC of the model refitted without one factor, for each factor.

    A refit without factor j moves the prediction by (x K^-1)_j w_j / K^-1_jj, so all refits of a batch of rows are one
    matrix product. Rows are dealt by time; a task adds up its times and hands on one row of sums for each factor.
    """
    k, given = len(model.features), df.sparkSession.sparkContext.broadcast((model.mean, model.std, model.weights, model.intercept, model.inverse))  # features x features

    def sums(time: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """4 x (k + 1): xy, xx, yy and rows of whole times in order."""
        mean, std, weights, intercept, inverse = given.value
        z = (x - mean) / std
        base = intercept + z @ weights
        p = np.column_stack([base, base[:, None] - (z @ inverse) * (weights / np.diag(inverse))])
        start = np.flatnonzero(np.insert(time[1:] != time[:-1], 0, True))
        n = np.diff(np.append(start, len(time)))
        p = p - np.repeat(np.add.reduceat(p, start) / n[:, None], n, axis=0)
        ss, sxy = np.add.reduceat(p * p, start), np.add.reduceat(p * y[:, None], start)
        sd = np.sqrt(ss / np.maximum(n - 1, 1)[:, None])
        ok = (n >= 2)[:, None] & (sd > 1e-12)
        scale = sd + EPS
        return np.stack([np.where(ok, v, 0).sum(axis=0) for v in (sxy / scale, ss / scale**2, np.add.reduceat(y * y, start)[:, None] + 0 * sd, n[:, None] + 0 * sd)])

    def run(batches):
        out, held = np.zeros((4, k + 1)), []
        for b in batches:
            cols = [b.column(0).cast(pa.int64()).to_numpy(), b.column(1).to_numpy(), np.column_stack([c.to_numpy() for c in b.columns[2:]])]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last or (held and held[-1][0][-1] != cols[0][0]):
                out += sums(*(np.concatenate(c) for c in zip(*held, [c[:last] for c in cols])))
                held = []
            held.append([c[last:] for c in cols])
        if held:
            out += sums(*(np.concatenate(c) for c in zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1), pa.int32()), *map(pa.array, out)], names=["j", "xy", "xx", "yy", "n"])

    rows = df.where(finite(label).isNotNull()).select("datetime", finite(label).alias("_y"), *(zero(f).alias(f) for f in model.features))
    parts = rows.repartition("datetime").sortWithinPartitions("datetime").mapInArrow(run, "j int, xy double, xx double, yy double, n double")
    ics = parts.groupBy("j").agg(*(F.sum(c).alias(c) for c in ("xy", "xx", "yy"))).select("j", sdiv(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("ic"))
    base = ics.where("j = 0").select(F.col("ic").alias("base_ic"))
    each = ics.where("j > 0").select(F.get(F.array(*map(F.lit, model.features)), F.col("j") - 1).alias("factor"), F.col("ic").alias("drop_ic"))
    return each.join(F.broadcast(base)).withColumn("delta", F.col("base_ic") - F.col("drop_ic"))  # one row by one row a factor


def _effects(df: DataFrame, features: list[str], label: str) -> DataFrame:
    ics = pred_xsz_ic(df, ["_base", *(f"_drop_{j}" for j in range(len(features)))], label)
    base = ics.where("pred_col = '_base'").select(F.col("ic").alias("base_ic"))
    names = F.array(*map(F.lit, features))
    each = ics.where("pred_col <> '_base'").select(F.get(names, F.substring("pred_col", 7, 9).cast("int")).alias("factor"), F.col("ic").alias("drop_ic"))
    return each.join(F.broadcast(base)).withColumn("delta", F.col("base_ic") - F.col("drop_ic"))  # one row by one row a factor


def normal(*key: str, seed: int = 0) -> Column:
    """A standard normal number of a row, by Box and Muller from its lots."""
    u, v = uniform(lot(*key, seed=2 * seed)), uniform(lot(*key, seed=2 * seed + 1))
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * np.pi * v)


def replacement_test(df: DataFrame, model, features: list[str], targets: list[str], label: str = "label", key=("symbol", "datetime"), raw: bool = True) -> DataFrame:
    """factor, base_ic, drop_ic, delta with each target in turn replaced by noise, seeded by the factor's place so that a
    part of the targets gives the same rows as all of them. raw: noise in place of the raw value, else of the standardised one."""
    out = model.transform(df, "_base")
    for j, t in enumerate(targets):
        noise = normal(*key, seed=1 + features.index(t))
        if not raw:
            i = features.index(t)
            noise = noise * F.lit(float(model.std[i])) + F.lit(float(model.mean[i]))
        swapped = model.transform(out.withColumn("_kept", F.col(t)).withColumn(t, noise), f"_drop_{j}")
        out = swapped.withColumn(t, F.col("_kept")).drop("_kept")
    return _effects(out, targets, label)


class Trees:
    """Boosted regression trees of MLlib: like the leaf-wise library they stand for in use, not in numbers."""

    def __init__(self, features: list[str], trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 7):
        self.features, self.model = features, None
        self.conf = {"maxIter": trees, "maxDepth": depth, "stepSize": rate, "seed": seed, "subsamplingRate": 0.8}

    def _assembled(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return df.withColumn("_features", array_to_vector(F.array(*(zero(f) for f in self.features))))

    def fit(self, df: DataFrame, label: str = "label") -> Trees:
        from pyspark.ml.regression import GBTRegressor

        rows = self._assembled(df.where(F.col(label).isNotNull()).orderBy("datetime", "symbol")).select("_features", F.col(label).alias("_y"))
        self.model = GBTRegressor(featuresCol="_features", labelCol="_y", **self.conf).fit(rows)
        return self

    def transform(self, df: DataFrame, pred: str = "pred") -> DataFrame:
        return self.model.setPredictionCol(pred).transform(self._assembled(df)).drop("_features")


@dataclass(frozen=True)
class NetConfig:
    hidden: int = 32
    epochs: int = 8
    batch: int = 512
    rate: float = 1e-3
    decay: float = 1e-4
    dropout: float = 0.1
    clip: float = 5.0
    target_clip: float = 8.0
    loss: str = "mse"  # mse, huber or corr_mse
    seed: int = 7


class Net:
    """features -> hidden -> hidden / 2 -> 1 with layer norm and SiLU, trained by AdamW on a bounded sample; numpy throughout."""

    def __init__(self, features: list[str], conf: NetConfig = NetConfig()):  # noqa: B008
        self.features, self.conf = features, conf
        r, d, h = np.random.default_rng(conf.seed), len(features), conf.hidden
        size = [(d, h), (h, h // 2), (h // 2, 1)]
        self.p = {f"w{i}": r.normal(0, np.sqrt(2 / a), (a, b)) for i, (a, b) in enumerate(size)}
        self.p |= {f"b{i}": np.zeros(b) for i, (_, b) in enumerate(size)} | {f"g{i}": np.ones(b) for i, (_, b) in enumerate(size[:2])} | {f"s{i}": np.zeros(b) for i, (_, b) in enumerate(size[:2])}
        self.mean, self.std = np.zeros(d), np.ones(d)

    @staticmethod
    def of(features: list[str], conf: dict, p: dict, mean: np.ndarray, std: np.ndarray) -> Net:
        net = Net(features, NetConfig(**conf))
        net.p, net.mean, net.std = p, mean, std
        return net

    def forward(self, x: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
        kept = []
        for i in range(2):
            u = x @ self.p[f"w{i}"] + self.p[f"b{i}"]
            m, s = u.mean(1, keepdims=True), np.sqrt(u.var(1, keepdims=True) + 1e-5)
            n = (u - m) / s
            v = n * self.p[f"g{i}"] + self.p[f"s{i}"]
            gate = 1 / (1 + np.exp(-np.clip(v, -40, 40)))
            drop = (rng.random(v.shape) >= self.conf.dropout) / (1 - self.conf.dropout) if rng is not None else 1.0
            kept.append((x, n, s, v, gate, drop))
            x = v * gate * drop
        return (x @ self.p["w2"] + self.p["b2"])[:, 0], [*kept, x]

    def backward(self, kept: list, d: np.ndarray) -> dict[str, np.ndarray]:
        d = d[:, None]
        g = {"w2": kept[2].T @ d, "b2": d.sum(0)}
        d = d @ self.p["w2"].T
        for i in (1, 0):
            x, n, s, v, gate, drop = kept[i]
            d = d * drop * (gate * (1 + v * (1 - gate)))
            g[f"g{i}"], g[f"s{i}"] = (d * n).sum(0), d.sum(0)
            d = d * self.p[f"g{i}"]
            d = (d - d.mean(1, keepdims=True) - n * (d * n).mean(1, keepdims=True)) / s
            g[f"w{i}"], g[f"b{i}"] = x.T @ d, d.sum(0)
            d = d @ self.p[f"w{i}"].T
        return g

    def train(self, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> Net:
        c, rng = self.conf, np.random.default_rng(self.conf.seed + 1)
        w = np.ones(len(y)) if w is None else w
        share = w / max(w.sum(), 1e-12)
        self.mean = share @ x
        self.std = np.maximum(np.sqrt(share @ (x - self.mean) ** 2), LEAST_STD)
        z, y = (x - self.mean) / self.std, np.clip(y, -c.target_clip, c.target_clip)
        m, v, t = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(c.epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), c.batch):
                i = order[at : at + c.batch]
                pred, kept = self.forward(z[i], rng)
                g = self.backward(kept, loss_gradient(pred, y[i], w[i], c.loss))
                norm = np.sqrt(sum((x * x).sum() for x in g.values()))
                t += 1
                for k in self.p:
                    x = g[k] * min(1.0, c.clip / (norm + 1e-12))
                    m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                    step = m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    self.p[k] = self.p[k] * (1 - c.rate * c.decay * (k[0] == "w")) - c.rate * step
        return self

    def fit(self, df: DataFrame, label: str = "label_xsz", weight: Column | None = None, most: int = 200_000) -> Net:
        """df: a training sample, as sample_training() bounds it; more than most rows are an error, not a silent cut."""
        rows = df.where(F.col(label).isNotNull()).select(*(zero(f).alias(f) for f in self.features), F.col(label).alias("_y"), (F.lit(1.0) if weight is None else weight).alias("_w"), lot("symbol", "datetime").alias("_o")).limit(most + 1).toPandas()
        if len(rows) > most:
            raise ValueError(f"more than {most} training rows; draw a sample first")
        rows = rows.sort_values("_o")
        return self.train(rows[self.features].to_numpy(float), rows["_y"].to_numpy(float), rows["_w"].to_numpy(float))

    def transform(self, df: DataFrame, pred: str = "pred") -> DataFrame:
        given = df.sparkSession.sparkContext.broadcast((self.features, self.conf.__dict__, self.p, self.mean, self.std))  # a few thousand plain numbers

        def run(batches):
            n = Net.of(*given.value)
            for pdf in batches:
                x = pdf[n.features].to_numpy(float)
                x = (np.where(np.isfinite(x), x, 0.0) - n.mean) / n.std
                yield pd.concat([pdf, pd.Series(n.forward(x)[0], pdf.index, name=pred)], axis=1)

        return df.mapInPandas(run, StructType(list(df.schema.fields)).add(pred, "double"))


def loss_gradient(pred: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str = "mse") -> np.ndarray:
    """Gradient of the weighted loss by the predictions: mse, huber (delta 1) or .65 (1 - corr) + .35 mse."""
    share = w / max(w.sum(), 1e-12)
    e = pred - y
    if kind == "huber":
        return share * np.clip(e, -1, 1)
    if kind == "mse":
        return 2 * share * e
    if kind != "corr_mse":
        raise ValueError(f"no such loss: {kind}")
    a, b = pred - share @ pred, y - share @ y
    saa, sbb, sab = share @ (a * a) + 1e-12, share @ (b * b) + 1e-12, share @ (a * b)
    return 0.35 * 2 * share * e - 0.65 * share * (b / np.sqrt(saa * sbb) - a * sab / (saa * np.sqrt(saa * sbb)))


def loss(pred: np.ndarray, y: np.ndarray, w: np.ndarray, kind: str = "mse") -> float:
    share = w / max(w.sum(), 1e-12)
    e = pred - y
    if kind == "huber":
        return float(share @ np.where(np.abs(e) <= 1, 0.5 * e * e, np.abs(e) - 0.5))
    mse = float(share @ (e * e))
    if kind == "mse":
        return mse
    a, b = pred - share @ pred, y - share @ y
    corr = (share @ (a * b)) / np.sqrt((share @ (a * a) + 1e-12) * (share @ (b * b) + 1e-12))
    return float(0.65 * (1 - corr) + 0.35 * mse)
