"""Language identification with a byte convolutional network.

The network reads fixed windows of bytes: an embedding, filters of several widths, max pooling over the window and
softmax.  It is trained in numpy on a bounded sample of labelled windows.  For prediction the embedding is folded
into the filters, so that a filter's output is a sum of table rows for byte pairs; each text is cut into windows
that overlap by the widest filter less one byte, and its score is the mean over all its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, free_name, maybe_broadcast, text_chunks, with_text_struct

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
STEP = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fixed-length windows of all texts, zero-padded, and the text each is of.  An empty text has none."""
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW + STEP) // STEP)), 0)
    owner = np.repeat(np.arange(len(size)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[owner] + nth * STEP
    padded = np.zeros(len(data) + WINDOW, np.uint8)
    padded[: len(data)] = LOWER[data]
    view = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)
    out = view[begin]
    left = offsets[owner + 1] - begin
    last = np.flatnonzero(left < WINDOW)
    out[last] *= np.arange(WINDOW) < left[last, None]
    return out, owner


class ByteNet:
    def __init__(self, labels: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.labels = labels
        self.e = r.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.k = [r.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.w = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.c = np.zeros(len(labels), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 4e-3, seed: int = 11) -> None:
        """Adam on cross entropy, classes weighted alike."""
        r = np.random.default_rng(seed)
        params = [self.e, *self.k, *self.b, self.w, self.c]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        counts = np.bincount(y, minlength=len(self.labels)).clip(1)
        weight = (len(y) / len(self.labels) / counts).astype(np.float32)
        for _ in range(epochs):
            for batch in np.array_split(r.permutation(len(x)), max(1, len(x) // 64)):
                grads = self._gradients(x[batch], y[batch], weight[y[batch]])
                t += 1
                for p, g, a, s in zip(params, grads, m, v, strict=True):
                    a += 0.1 * (g - a)
                    s += 0.001 * (g * g - s)
                    p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        e = self.e[x]
        pooled, where = [], []
        for w, k, b in zip(WIDTHS, self.k, self.b, strict=True):
            out = sum(e[:, j : WINDOW - w + 1 + j] @ k[j] for j in range(w)) + b
            at = out.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(out, at[:, None], 1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        a = np.maximum(h, 0)
        z = a @ self.w + self.c
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p *= weight[:, None] / n
        dw, dc = a.T @ p, p.sum(axis=0)
        dh = (p @ self.w.T) * (h > 0)
        de, dk, db = np.zeros_like(self.e), [], []
        rows = np.arange(n)[:, None]
        for i, (w, k) in enumerate(zip(WIDTHS, self.k, strict=True)):
            g = dh[:, i * FILTERS : (i + 1) * FILTERS]
            d = np.zeros_like(k)
            for j in range(w):
                bytes_ = x[rows, where[i] + j]
                d[j] = np.einsum("nf,nfe->ef", g, self.e[bytes_])
                np.add.at(de, bytes_.ravel(), (g[:, :, None] * k[j].T[None]).reshape(-1, EMBED))
            dk.append(d)
            db.append(g.sum(axis=0))
        return [de, *dk, *db, dw, dc]

    def folded(self) -> dict:
        """Filter outputs as sums of table rows: pairs of bytes, and a single byte for odd widths."""
        one = [[self.e @ k[j] for j in range(len(k))] for k in self.k]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).astype(np.float32)
        tables = [[(j, pair(t[j], t[j + 1]), True) if j + 1 < len(t) else (j, t[j].astype(np.float32), False) for j in range(0, len(t), 2)] for t in one]
        return {"tables": tables, "b": self.b, "w": self.w, "c": self.c, "labels": self.labels}


def probabilities(net: dict, x: np.ndarray) -> np.ndarray:
    """Softmax of each window, a few hundred at a time so that filter outputs stay in cache."""
    out = np.empty((len(x), len(net["labels"])), np.float32)
    for s in range(0, len(x), 64):
        some = x[s : s + 64]
        pairs = some[:, :-1].astype(np.int32) * 256 + some[:, 1:]
        pooled = []
        for w, parts, b in zip(WIDTHS, net["tables"], net["b"], strict=True):
            n, total = WINDOW - w + 1, None
            for j, table, double in parts:
                got = np.take(table, pairs[:, j : j + n] if double else some[:, j : j + n], axis=0, mode="clip")
                if total is None:
                    total = got
                else:
                    total += got
            pooled.append(total.max(axis=1) + b)
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ net["w"] + net["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out[s : s + 64] = z / z.sum(axis=1, keepdims=True)
    return out


def train(docs: DataFrame, *, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = 600, per_text: int = 4) -> dict | None:
    """A network for the languages of ``docs`` (rows with text and label), or None without any.

    Fitted on a bounded sample: about ``per_language`` texts of each language, chosen by a hash of ``key``, and
    ``per_text`` windows from anywhere in each.
    """
    rows = docs.select(F.col(lang).cast("string").alias("y"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.lit(3)).alias("h")).where("y IS NOT NULL AND length(t) > 0")
    counts = rows.groupBy("y").agg(F.count("*").alias("n")).withColumn("most", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("n")) * 1e6).select("y", "most")
    taken = rows.join(maybe_broadcast(counts, 64), "y").where(F.pmod("h", F.lit(1_000_000)) < F.col("most"))
    starts = F.array(*(F.pmod(F.xxhash64("h", F.lit(j)), F.greatest(F.length("t") - WINDOW // 2, F.lit(1)).cast("bigint")) for j in range(per_text)))
    cuts = taken.select("y", F.explode(F.array_distinct(F.transform(starts, lambda s: F.substring(F.col("t"), (s + 1).cast("int"), F.lit(WINDOW))))).alias("t"))
    sample = sorted((r.y, r.t) for r in cuts.collect())
    if not sample:
        return None
    labels = sorted({y for y, _ in sample})
    texts = pa.array([t for _, t in sample], pa.string())
    xs, ys, n = [], [], 0
    for first, data, offsets in text_chunks(texts):
        x, owner = windows(data, offsets)
        xs.append(x)
        ys.append(owner + first)
    owner = np.concatenate(ys)
    x, keep = np.concatenate(xs), np.unique(owner, return_index=True)[1]
    index = {y: i for i, y in enumerate(labels)}
    y = np.array([index[y] for y, _ in sample])
    net = ByteNet(labels)
    net.fit(x[keep], y[owner[keep]])
    return net.folded()


def _predict(texts: pa.Array, net: dict) -> dict:
    label = np.full(len(texts), -1)
    score = np.zeros(len(texts))
    for first, data, offsets in text_chunks(texts, 1 << 20):
        x, owner = windows(data, offsets)
        if not len(x):
            continue
        p = probabilities(net, x).astype(np.float64)
        total = np.zeros((len(offsets) - 1, p.shape[1]))
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total[owner[at]] = np.add.reduceat(p, at, axis=0)
        count = np.bincount(owner, minlength=len(total)).clip(1)
        total /= count[:, None]
        label[first : first + len(total)] = total.argmax(axis=1)
        score[first : first + len(total)] = total.max(axis=1)
    names = net["labels"]
    return {"lang_pred": pa.array([names[i] if i >= 0 else UNKNOWN for i in label.tolist()], pa.string()), "score": pa.array(np.minimum(score, 1.0))}


def identify(docs: DataFrame, net: dict | None, *, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with one struct column added, and its name: ``lang_pred, score``.

    ``und`` with score 0 where the text is null or has no letter (a Unicode letter), or if there is no network.
    Rows are kept, repeated ones too; other columns pass through whatever their names.
    """
    name = free_name(docs, "language")
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return docs.withColumn(name, none), name
    shared = docs.sparkSession.sparkContext.broadcast(net)
    docs = with_text_struct(docs, text, name, "lang_pred string, score double", lambda: lambda texts: _predict(texts, shared.value))
    return docs.withColumn(name, F.when(F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)), F.col(name)).otherwise(none)), name


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4
