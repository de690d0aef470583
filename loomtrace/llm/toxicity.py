"""Toxicity by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney models, of toxic and of ordinary text, give the likelihood of each word with the one before
it and back off to the word alone, to its first six and its first four bytes (so that inflected forms share evidence),
and at last to one distribution that both classes share.  Every level counts the different things it was seen with, not
occurrences: a pair and a word the different words before them, a prefix the different words that begin with it, and the
shared distribution the classes that know a prefix at all; what a level leaves to the next is dealt by counts that both
classes share.  A rare expression thus weighs next to nothing, one that a class
has seen in many contexts a lot.  Discounts are estimated from the counts of counts of each class and level.

A text's evidence is the difference of its length-normalised log-likelihoods under both models, of the whole text and of
its most toxic windows of a few lengths, so that an insult isn't thinned out by the text around it.  A logistic function
fitted on texts that the models did not see turns these into a score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, GOLDEN, MIX_A, MIX_B, U64, cut, free_name, hash_spans, maybe_broadcast, mix, text_chunks, with_text_struct, words

START = U64(1)
#: Bytes of the prefixes that words back off to.
PREFIXES = (6, 4)
#: Levels of the models: pairs, words, prefixes.
LEVELS = 2 + len(PREFIXES)
#: Words of the windows, and parts of the sample for calibration.
WINDOWS, FOLDS = (1, 2, 4, 8), 4
#: Most that one word weighs, so that a memorised copy doesn't outweigh everything else.
MOST = 8.0
#: The estimated discounts predict text best; stretched by this they told held-out classes apart best (of 1, 1.5, 2, 3, 4 and 8).
STRETCH = 1.5


def units(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> list[np.ndarray]:
    """Each word's unit at every level: itself, then its prefixes."""
    return [h, *(hash_spans(low, starts, np.minimum(ends, starts + n)) for n in PREFIXES)]


def discounts(count: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney: what counts of one, of two and of more give up, from the numbers of counts of one to four."""
    n = np.bincount(np.minimum(count.astype(np.int64), 5), minlength=6)[1:5].astype(float)
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    off = np.zeros(4)
    for k in range(3):
        off[k + 1] = k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else y * (k + 1)
        off[k + 1] = np.clip(off[k + 1], 0.1, 0.95 * (k + 1))
    return np.minimum(count, STRETCH * off[np.minimum(count.astype(np.int64), 3)])


def pairs(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The hash of each word and its predecessor (START at the beginning of a text)."""
    u = np.empty_like(h)
    u[1:] = h[:-1]
    u[first[:-1][np.diff(first) > 0]] = START
    return mix(u * MIX_A + h + GOLDEN)


def smoothed(counts: np.ndarray, parent: np.ndarray | None, above: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Interpolated probabilities of a level's units in both classes, and what each class leaves to the level below.

    What is discounted goes to a unit by its parent's probability in the class, dealt among the parent's units by the
    counts of both classes together; without parents, by the number of classes that know a unit.
    """
    both = (counts > 0).sum(axis=0) if parent is None else counts.sum(axis=0)
    off, total = np.stack([discounts(c) for c in counts]), counts.sum(axis=1, keepdims=True)
    leave = np.where(total > 0, off.sum(axis=1, keepdims=True) / np.maximum(total, 1), 1.0)
    shared = both / both.sum() if parent is None else above * (both / np.bincount(parent, both)[parent])
    return (counts - off) / np.maximum(total, 1) + leave * shared, leave[:, 0]


def _look_up(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are among the sorted ids, and where these are."""
    if not len(ids):
        return np.zeros(len(x), bool), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
    known = ids[k] == x
    return known, k[known]


class ClassModels:
    def __init__(self, texts: list[pa.Array]):
        """``texts``: ordinary and toxic ones."""
        sides = []
        for some in texts:
            columns: list[list[np.ndarray]] = [[] for _ in range(1 + LEVELS)]
            for _, data, offsets in text_chunks(some.unique()):
                low, starts, ends, h, first = words(data, offsets, ALNUM)
                pair = pairs(h, first)
                before = np.empty_like(pair)
                before[1:] = pair[:-1]
                before[first[:-1][np.diff(first) > 0]] = START
                for column, x in zip(columns, (mix(before * MIX_B + h), pair, *units(low, starts, ends, h)), strict=True):
                    column.append(x)
            seen, *level = (np.concatenate(c) if c else np.zeros(0, np.uint64) for c in columns)
            # a pair counts by the different words before it, every other level by the different units of the level before
            chain = []
            for k in range(LEVELS):
                once = np.unique(seen, return_index=True)[1]
                level = [x[once] for x in level]
                seen = level[k]
                chain.append((seen, level[k + 1] if k + 1 < LEVELS else seen))
            sides.append(chain)
        #: Per level, its units and each one's log-likelihood ratio; and what units that only later levels know add.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        leaves: list[float] = []
        below: tuple[np.ndarray, np.ndarray] | None = None
        for k in range(LEVELS - 1, -1, -1):
            ids, at = np.unique(np.concatenate([chain[k][0] for chain in sides]), return_index=True)
            parents = np.concatenate([chain[k][1] for chain in sides])[at]
            counts = np.stack([np.bincount(np.searchsorted(ids, chain[k][0]), minlength=len(ids)) for chain in sides])
            above = None if below is None else below[1][:, np.searchsorted(below[0], parents)]
            probability, leave = smoothed(counts, None if below is None else np.searchsorted(below[0], parents), above)
            self.levels.insert(0, (ids, np.clip(np.log(probability[1] / probability[0]), -MOST, MOST).astype(np.float32)))
            leaves.insert(0, float(np.log(leave[1] / leave[0])))
            below = (ids, probability)
        self.left = np.concatenate([[0.0], np.cumsum(leaves)]).astype(np.float32)
        self.weights = np.zeros(2 + len(WINDOWS))

    def ratios(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each word's log-likelihood ratio, toxic to ordinary, at the first level that knows it."""
        # words of a shard repeat: each is looked up once below the level of pairs
        distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        word, wait = np.full(len(distinct), self.left[-1], np.float32), np.arange(len(distinct))
        for (ids, ratios), left, unit in zip(self.levels[1:], self.left[1:-1], units(low, starts[at], ends[at], distinct), strict=True):
            known, found = _look_up(ids, unit[wait])
            word[wait[known]] = ratios[found] + left
            wait = wait[~known]
        out = word[inverse]
        known, found = _look_up(self.levels[0][0], pairs(h, first))
        out[known] = self.levels[0][1][found]
        return out

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Per text: mean log-likelihood ratio of its words, and of its most toxic window of each length; a text shorter
        than that is one window, filled up with words that say nothing."""
        out = np.zeros((len(texts), 1 + len(WINDOWS)))
        for begin, data, offsets in text_chunks(texts):
            low, starts, ends, h, first = words(data, offsets, ALNUM)
            if not len(h):
                continue
            total = np.concatenate([[0.0], np.cumsum(self.ratios(low, starts, ends, h, first), dtype=np.float64)])
            n = np.diff(first)
            full = np.flatnonzero(n > 0)
            a, b = first[:-1][full], first[1:][full]
            out[begin + full, 0] = (total[b] - total[a]) / n[full]
            stop, least = np.repeat(b, n[full]), np.repeat(a, n[full])
            for k, window in enumerate(WINDOWS, 1):
                # windows from each word on; those that would leave their text begin earlier instead
                end = np.minimum(np.arange(len(h)) + window, stop)
                start = np.maximum(end - window, least)
                out[begin + full, k] = np.maximum.reduceat((total[end] - total[start]) / window, a)
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression with a ridge, by Newton steps that are halved until they help."""
        z = np.column_stack([np.ones(len(x)), x])
        ridge = np.array([1e-3, *[1.0] * x.shape[1]])

        def loss(w: np.ndarray) -> float:
            m = z @ w
            return float(np.logaddexp(0, m).sum() - y @ m + (ridge * w * w).sum() / 2)

        w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
            size = 1.0
            while size > 1e-4 and loss(w - size * step) > loss(w):
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-6:
                break
        self.weights = w

    def score(self, texts: pa.Array) -> np.ndarray:
        e = self.evidence(texts)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + e @ self.weights[1:], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample_chars: int = 4_000_000) -> ClassModels | None:
    """Models from labelled documents, or None if a class has none.

    Fitted on a bounded sample: of each class about ``sample_chars`` characters, or as many as the smaller class has,
    in whole texts chosen by a hash of the id.  The score is calibrated on evidence that models of the other parts of
    the sample give for each part.  Conflicting labels of one document count as toxic; null labels and ids are left
    out.
    """
    marks = labels.select(F.col(doc_id).alias("k"), F.col(toxic).cast("int").alias("y")).where("k IS NOT NULL AND y IN (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).where("length(t) > 0").join(maybe_broadcast(cut(marks), 24), "k")
    sizes = {r.y: (r.n, r.docs) for r in rows.groupBy("y").agg(F.sum(F.length("t").cast("bigint")).alias("n"), F.count("*").alias("docs")).collect()}
    if len(sizes) < 2:
        return None
    most = min(sample_chars, *(n for n, _ in sizes.values()))
    rates = F.when(F.col("y") == 1, most / sizes[1][0]).otherwise(most / sizes[0][0]) * 1e6
    sample = rows.where(F.pmod(F.xxhash64("k", F.lit(5)), F.lit(1_000_000)) < rates).select("y", "t", F.pmod(F.xxhash64("k", F.lit(9)), F.lit(FOLDS)).alias("part")).collect()
    sample = sorted((r.y, r.part, r.t) for r in sample)
    pick = lambda y, keep: pa.array([t for c, p, t in sample if c == y and keep(p)], pa.string())
    x, y = [], []
    for part in range(FOLDS):
        others = ClassModels([pick(c, lambda p, part=part: p != part) for c in (0, 1)])
        for c in (0, 1):
            x.append(others.evidence(pick(c, lambda p, part=part: p == part)))
            y += [float(c)] * len(x[-1])
    models = ClassModels([pick(c, lambda p: True) for c in (0, 1)])
    models.calibrate(np.concatenate(x), np.array(y))
    # the sample holds the classes in other shares than the corpus
    share = max(sum(y), 1) / max(len(y) - sum(y), 1)
    models.weights[0] += np.log(sizes[1][1] / sizes[0][1]) - np.log(share)
    return models


def score(docs: DataFrame, models: ClassModels | None, *, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with one struct column added, and its name: ``score`` (0 to 1).

    Null and empty texts score as a text without evidence does; without models every score is 0.  Rows are kept,
    repeated ones too; other columns pass through whatever their names.
    """
    name = free_name(docs, "toxicity")
    if models is None:
        return docs.withColumn(name, F.struct(F.lit(0.0).alias("score"))), name
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return with_text_struct(docs, text, name, "score double", lambda: lambda texts: {"score": pa.array(shared.value.score(texts))}), name
