"""Quality classifier by positive-unlabelled learning.

A small network scores byte statistics of whole texts. It is trained with the
non-negative unbiased risk estimator: trusted positives, unlabelled text and
the class prior stand in for negatives, and a batch whose estimated negative
risk falls below zero is stepped back. The prior is estimated from the same two
samples: among thresholds of a first classifier of positives against
unlabelled text, the least ratio of the shares above it is the prior, as some
region holds hardly anything but positives.

Labels of 0 are never used. Both samples are bounded by a parameter and drawn
by a hash of the id; scoring reads every row.

Defined cases: null texts are empty and are scored like any text; texts of any
length are read whole; without any positive every score is 0.5; with fewer than
four rows in a sample the prior is 0.5, as nothing can be estimated; labels repeated for one id count once, positive
only if all say so; repeated documents are scored each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, table, utf8

#: Byte classes for transitions: lower, upper, digit, space, line end, full stop, comma, further marks one by one, other ASCII, above ASCII.
_CLASS = np.full(256, 14, np.uint8)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[128:] = 0, 1, 2, 15
for _n, _marks in enumerate((b" \t", b"\r\n", b".", b",", b"!?", b"|", b"#$%&*", b"'\"`", b"-_", b"()[]{}", b"<>=/\\"), start=3):
    _CLASS[list(_marks)] = _n
WIDTH = 256 + 256 + 6


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row a text: roots of byte and class-pair shares; shares of repeated lines, of words that repeat the last one, of distinct words and word pairs; length, mean line length."""
    out = np.zeros((len(at) - 1, WIDTH), np.float32)
    for row, i, j in zip(out, at[:-1], at[1:], strict=True):
        text, n = data[i:j], j - i
        if not n:
            continue
        row[:256] = np.sqrt(np.bincount(text, minlength=256) / n)
        kind = _CLASS[text]
        row[256:512] = np.sqrt(np.bincount((kind[:-1] << 4) | kind[1:], minlength=256) / n)
        raw = text.tobytes()
        lines, words = raw.split(b"\n"), raw.split()
        k = max(1, len(words))
        row[512:] = (
            1 - len(set(lines)) / len(lines), sum(map(eq, words, words[1:])) / k, len(set(words)) / k, len(set(zip(words, words[1:], strict=False))) / k, np.log1p(n) / 10, np.log1p(n / len(lines)) / 10,
        )
    return out


class Network:
    """One hidden layer; forward and the gradient step (Adam) in numpy."""

    def __init__(self, width: int, hidden: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.p = [rng.normal(0, width**-0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(x) for x in self.p], [np.zeros_like(x) for x in self.p], 0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w, b, u, c = self.p
        return np.maximum(x @ w + b, 0) @ u + c

    def step(self, x: np.ndarray, slope: np.ndarray, rate: float = 3e-3, decay: float = 1e-4) -> None:
        """slope: the derivative of the risk by each output."""
        w, b, u, c = self.p
        h = np.maximum(x @ w + b, 0)
        back = np.outer(slope, u) * (h > 0)
        self.t += 1
        for k, g in enumerate((x.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()]))):
            g = g + decay * self.p[k]
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.p[k] = self.p[k] - rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _epochs(pos, unl, epochs, size, seed):
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(unl))
        for i in range(0, len(unl), size):
            yield pos[rng.integers(0, len(pos), size)], unl[order[i : i + size]]


def estimate_prior(pos: np.ndarray, unl: np.ndarray, seed: int = 7) -> float:
    """Share of positives in unl, on halves that the first classifier has not seen."""
    a, b = pos[::2], pos[1::2]
    c, d = unl[::2], unl[1::2]
    if min(map(len, (a, b, c, d))) < 2:
        return 0.5
    net = Network(pos.shape[1], 16, seed)
    for p, u in _epochs(a, c, 20, 256, seed):
        net.step(np.concatenate([p, u]), np.concatenate([(sigmoid(net(p)) - 1) / len(p), sigmoid(net(u)) / len(u)]))
    sp, su = np.sort(net(b)), np.sort(net(d))
    at = np.quantile(sp, np.linspace(0, 0.9, 91))
    fp, fu = 1 - np.searchsorted(sp, at) / len(sp), 1 - np.searchsorted(su, at) / len(su)
    slack = np.sqrt(np.log(40) / (2 * len(sp))) + np.sqrt(np.log(40) / (2 * len(su)))
    best = np.argmin((fu + slack) / fp)
    return float(np.clip(fu[best] / fp[best], 0.02, 0.98))


def train(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, hidden: int = 32, epochs: int = 60, size: int = 256, seed: int = 7) -> tuple[Network, float]:
    """Minimise prior*R+(P) + max(0, R-(U) - prior*R-(P)) with the sigmoid loss."""
    prior = estimate_prior(pos, unl, seed) if prior is None else prior
    net = Network(pos.shape[1], hidden, seed)
    for p, u in _epochs(pos, unl, epochs, size, seed):
        sp, su = sigmoid(net(p)), sigmoid(net(u))
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        if su.mean() - prior * sp.mean() >= 0:
            net.step(np.concatenate([p, u]), np.concatenate([-2 * prior * dp, du]))
        else:
            net.step(np.concatenate([p, u]), np.concatenate([prior * dp, -du]))
    return net, prior


def _collect(df: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and flags of a table (text, in_p), of `most` rows at most, drawn by hash; what is sorted is the features, some KB a row."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = features(*utf8(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1)], names=["x", "in_p"])

    rows = df.mapInArrow(run, "x binary, in_p boolean").orderBy(F.xxhash64("x"), "x", "in_p").limit(most).collect()
    x = np.array([np.frombuffer(r[0], np.float32) for r in rows], np.float64).reshape(-1, WIDTH)
    return x, np.array([r[1] for r in rows], bool)


def fit(docs: DataFrame, positives: DataFrame, train_rows, sample: int = 6000) -> tuple[Network | None, float]:
    """docs(id, text), positives(id); train_rows: the condition on id that rows to learn from meet.

    sample: rows drawn of each of the two sets at most.
    """
    order = F.xxhash64("id", F.lit("quality"))
    chosen = lambda d: d.where(train_rows & F.col("id").isNotNull()).select("id").distinct().orderBy(order, "id").limit(sample)
    ids = chosen(positives).withColumn("in_p", F.lit(True)).union(chosen(docs).withColumn("in_p", F.lit(False)))
    # at most twice `sample` ids; repeated documents of one id are not let through either
    x, in_p = _collect(docs.select("id", "text").join(F.broadcast(ids), "id").select("text", "in_p"), 2 * sample)
    if not in_p.any() or in_p.all():
        return None, 0.5
    return train(x[in_p], x[~in_p])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs(id, text) to (id, score)."""
    weights = None if net is None else [p.astype(np.float32) for p in net.p]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if weights is None:
                s = np.full(b.num_rows, 0.5)
            else:
                w, c, u, d = weights
                s = sigmoid((np.maximum(features(*utf8(b.column(1))) @ w + c, 0) @ u + d).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"id {dict(docs.dtypes)['id']}, score double")


def op3_pu_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    positives = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("q")).where("q = 1")
    net, _ = fit(docs, positives, fold("id", 3) != 1)
    return score(docs, net).select(
        F.col("id").alias("doc_id"), (fold("id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
