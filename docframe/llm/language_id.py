"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over windows of fixed
length, each filter's largest response is kept and a softmax names the
language. The network is trained in numpy on windows of labelled text; a text
is judged by the mean log probability over all its windows, weighted by their
bytes, so every byte of it counts.

For scoring, embedding and filters are folded into tables indexed by byte
pairs: a filter of width two to four is the sum of two look-ups.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any labelled row everything is ``und``; rows with a null label are not
learned from; repeated rows are judged each; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, released, table, utf8

WINDOW, WIDTHS, FILTERS, EMBED = 160, (2, 3, 4), 16, 12
#: Windows a scoring step holds at once.
BLOCK = 1024


class ByteConv:
    def __init__(self, langs: list[str], seed: int = 11):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.embed[0] = 0
        self.filters = [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, n**-0.5, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def params(self):
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]

    def train(self, windows: np.ndarray, target: np.ndarray, epochs: int = 12, size: int = 128, rate: float = 4e-3, seed: int = 11) -> None:
        """windows: uint8 (n, WINDOW), zero past a text's end; target: indices into langs."""
        rng = np.random.default_rng(seed)
        m, v, t = [np.zeros_like(p) for p in self.params()], [np.zeros_like(p) for p in self.params()], 0
        share = np.bincount(target, minlength=len(self.langs)) / len(target)
        weight = (1 / np.maximum(share, 1e-9) / len(self.langs)).astype(np.float32)[target] ** 0.5
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), size):
                pick = order[i : i + size]
                grads = self.gradients(windows[pick], target[pick], weight[pick])
                t += 1
                now = rate * (1 - epoch / epochs)
                for k, (p, g) in enumerate(zip(self.params(), grads, strict=True)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def gradients(self, x, y, weight):
        e, pooled, best = self.embed[x], [], []
        flat = e.reshape(len(x), -1)
        for w, f in zip(WIDTHS, self.filters, strict=True):
            n = x.shape[1] - w + 1
            cols = np.lib.stride_tricks.as_strided(flat, (len(x), n, w * EMBED), (flat.strides[0], EMBED * flat.itemsize, flat.itemsize))
            r = np.ascontiguousarray(cols).reshape(-1, w * EMBED) @ f
            r = r.reshape(len(x), n, FILTERS)
            best.append(r.argmax(axis=1))
            pooled.append(r.max(axis=1))
        z = np.concatenate(pooled, axis=1) + self.bias
        a = np.maximum(z, 0)
        logit = a @ self.out + self.out_bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= weight[:, None] / len(y)
        gz = (p @ self.out.T) * (z > 0)
        g_embed, g_filters = np.zeros_like(self.embed), []
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = gz[:, k * FILTERS : (k + 1) * FILTERS]
            at = best[k][:, :, None] + np.arange(w)  # rows, filters, width
            seen = x[np.arange(len(x))[:, None, None], at]
            g_filters.append(np.einsum("rf,rfwe->wef", g, self.embed[seen]).reshape(w * EMBED, FILTERS))
            back = np.einsum("rf,wef->rfwe", g, f.reshape(w, EMBED, FILTERS))
            np.add.at(g_embed, seen.reshape(-1), back.reshape(-1, EMBED))
        g_embed[0] = 0
        return [g_embed, *g_filters, gz.sum(0), a.T @ p, p.sum(0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses by byte pair: to the first two bytes of each filter, and to its third and fourth."""
        n = FILTERS * len(WIDTHS)
        one = np.zeros((4, 256, n), np.float32)
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            for j in range(w):
                one[j][:, k * FILTERS : (k + 1) * FILTERS] = self.embed @ f[j * EMBED : (j + 1) * EMBED]
        # the index is that of a little-endian pair: second byte high
        return tuple((one[j + 1][:, None, :] + one[j][None, :, :]).reshape(65536, n) for j in (0, 2))


class Scorer:
    """Log probabilities of texts; made in each worker from the parameters."""

    def __init__(self, net: ByteConv):
        self.net, (self.head, self.tail) = net, net.tables()

    def windows(self, x: np.ndarray) -> np.ndarray:
        """Log softmax of windows (n, WINDOW + 3), zero past a text's end.

        Positions are taken where a filter of the greatest width starts inside
        the window; the three bytes beyond it belong to the next one.
        """
        pairs = x[:, :-1].astype(np.uint16) | (x[:, 1:].astype(np.uint16) << 8)
        pairs = np.ascontiguousarray(pairs.T).astype(np.intp)  # position first
        best, a, b = None, np.empty((len(x), self.head.shape[1]), np.float32), np.empty((len(x), self.head.shape[1]), np.float32)
        for i in range(WINDOW):
            np.take(self.head, pairs[i], axis=0, out=a, mode="clip")
            np.take(self.tail, pairs[i + 2], axis=0, out=b, mode="clip")
            a += b
            best = a.copy() if best is None else np.maximum(best, a, out=best)
        z = np.maximum(best + self.net.bias, 0) @ self.net.out + self.net.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def texts(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean log probabilities, a row a text; empty texts have zeros."""
        size = np.diff(at)
        count = -(-size // WINDOW)
        of = np.repeat(np.arange(len(size)), count)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * WINDOW
        total = np.zeros((len(size), len(self.net.langs)))
        padded = np.concatenate([data, np.zeros(WINDOW + 3, np.uint8)])
        inside = np.arange(WINDOW + 3)
        for i in range(0, len(of), BLOCK):
            o, s = of[i : i + BLOCK], start[i : i + BLOCK]
            left = size[o] - s
            x = padded[(at[o] + s)[:, None] + inside]
            x[inside >= left[:, None]] = 0
            np.add.at(total, o, self.windows(x) * np.minimum(left, WINDOW)[:, None])
        return total / np.maximum(size, 1)[:, None]


def sample_windows(docs: DataFrame, train_rows, per_lang: int, each: int = 2, most_langs: int = 400) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most about per_lang rows of each label (drawn by hash), `each` windows a row at hashed places; of the most_langs commonest labels."""
    labelled = docs.where(train_rows & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, int)
    rates = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, per_lang / n) * (1 << 30)))))
    h = F.pmod(F.xxhash64("id", "text", F.lit("lang")), F.lit(1 << 30))
    picked = labelled.where(h < F.try_element_at(rates, F.col("lang"))).select("text", "lang")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, at = utf8(b.column(0))
            lang, xs, ys = b.column(1).to_pylist(), [], []
            for k, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True)):
                rng = np.random.default_rng(int(j - i) * 1_000_003 + int(data[i:j][:64].sum()) if j > i else 0)
                for _ in range(each if j - i > WINDOW else 1):
                    s = i + int(rng.integers(0, max(1, j - i - WINDOW + 1)))
                    part = data[s : min(s + WINDOW, j)]
                    if len(part):
                        xs.append(part.tobytes())
                        ys.append(lang[k])
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.string())], names=["x", "lang"])

    # ordered, so that a cut (many copies of one drawn row) is the same each time
    rows = picked.mapInArrow(run, "x binary, lang string").orderBy(F.xxhash64("x", "lang"), "x", "lang").limit(2 * each * per_lang * len(langs)).collect()
    rows.sort(key=lambda r: (r[1], bytes(r[0])))
    x = np.zeros((len(rows), WINDOW), np.uint8)
    for k, r in enumerate(rows):
        x[k, : len(r[0])] = np.frombuffer(r[0], np.uint8)
    return langs, x, np.array([langs.index(r[1]) for r in rows], int)


def fit(docs: DataFrame, train_rows, per_lang: int = 1200, most_langs: int = 400) -> ByteConv | None:
    """docs(id, text, lang). per_lang bounds the rows learned from of each label, most_langs the labels."""
    langs, x, y = sample_windows(docs, train_rows, per_lang, most_langs=most_langs)
    if not len(x):
        return None
    net = ByteConv(langs)
    net.train(x, y)
    return net


def predict(df: DataFrame, net: ByteConv | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The kept columns of every row, and ``_lang`` and ``_score``."""

    def run(batches):
        import pyarrow as pa

        scorer = None if net is None else Scorer(net)
        for b in batches:
            letters = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            if scorer is None or not len(letters):
                names, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            else:
                logp = scorer.texts(*utf8(b.column(0)))
                p = np.exp(logp - logp.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                names = [net.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[2:], "_lang", "_score"])

    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    fields = [T.StructField(f"_k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("_lang", T.StringType()), T.StructField("_score", T.DoubleType())])
    found = df.select(F.col(text_col).alias("_text"), letter.alias("_letter"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep))).mapInArrow(lambda b: released(run(b)), schema)
    return found.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "_lang", "_score")


def op1_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    net = fit(docs, fold("id", 5) != 0)
    return predict(docs, net, ["id"]).select(F.col("id").alias("doc_id"), (fold("id", 5) == 0).alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
