"""Benchmark decontamination with suffix arrays over the training texts.

Each task turns its share of the documents into shards of at most about two megabytes, sorts every word suffix of
a shard (a suffix array) and binary-searches every benchmark suffix in it.  The benchmark is read in blocks of a
fixed number of words, so what is broadcast has a proven bound; documents never move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, U64, cut, free_name, text_chunks, with_text_struct, words

#: Bits of a word in a suffix's sort key; three words and a position share 64 bits.
BITS, POS_BITS = U64(15), U64(19)
LEAKS = "n_words bigint, runs array<bigint>, items array<string>, longest bigint, longest_at bigint"


class Block:
    """Word hashes of one block of benchmark items, with the suffixes that begin a window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids = [i for i, _ in items]
        _, _, _, self.hashes, first = _tokens(pa.array([t for _, t in items], pa.string()))
        n = np.diff(first)
        short = np.flatnonzero((n > 0) & (n < window))
        long_items = np.flatnonzero(n >= window)
        at = [first[i] + np.arange(n[i] - window + 1) for i in long_items]
        self.start = np.concatenate([first[short], *at]).astype(np.int64)
        self.length = np.concatenate([n[short], *(np.full(len(a), window) for a in at)]).astype(np.int64)
        self.item = np.concatenate([short, *(np.full(len(a), i) for i, a in zip(long_items, at, strict=True))]).astype(np.int64)
        self.end = first[self.item + 1] if len(self.item) else np.zeros(0, np.int64)
        self.deepest = int(n.max()) if len(n) else 0


def _tokens(texts: pa.Array):
    chunks = list(text_chunks(texts, 1 << 62))
    if not chunks:
        return None, None, None, np.zeros(0, np.uint64), np.zeros(1, np.int64)
    _, data, offsets = chunks[0]
    return words(data, offsets, ALNUM)


class SuffixArray:
    """All word suffixes of a shard in order, to the depth of the longest benchmark item.

    Words are ordered by 15 bits of their hash (0 stands for the end of a text); every hit is verified with the
    whole hashes afterwards.  Ties are sorted further by rank doubling.
    """

    def __init__(self, hashes: np.ndarray, first: np.ndarray, depth: int):
        n = len(hashes)
        self.hashes, self.first = hashes, first
        self.end = np.repeat(first[1:], np.diff(first))
        code = np.maximum(hashes >> (U64(64) - BITS), U64(1))
        self.key = key = np.zeros(n + 1, np.uint64)
        at = np.arange(n)
        for k in range(3):
            inside = at + k < self.end
            key[:n] = (key[:n] << BITS) | np.where(inside, code[np.minimum(at + k, max(n - 1, 0))], U64(0))
        if n < 1 << int(POS_BITS):
            self.order = (np.sort((key[:n] << POS_BITS) | at.astype(np.uint64)) & ((U64(1) << POS_BITS) - U64(1))).astype(np.int64)
        else:
            self.order = np.argsort(key[:n], kind="stable")
        self._settle_ties(depth)
        self.sorted_key = key[self.order]

    def _settle_ties(self, depth: int) -> None:
        n, order = len(self.order), self.order
        if not n:
            return
        fresh = np.ones(n, bool)
        fresh[1:] = self.key[order[1:]] != self.key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        h = 3
        while h < depth:
            tied = ~fresh
            tied[:-1] |= ~fresh[1:]
            slots = np.flatnonzero(tied)
            if not len(slots):
                return
            pos = order[slots]
            follow = np.where(pos + h < self.end[pos], rank[np.minimum(pos + h, n - 1)] + 1, 0)
            by = np.lexsort((follow, rank[pos]))
            pos, follow = pos[by], follow[by]
            order[slots] = pos
            new = np.ones(len(slots), bool)
            new[1:] = (follow[1:] != follow[:-1]) | (rank[pos[1:]] != rank[pos[:-1]])
            fresh[slots] = new
            rank[pos] = np.maximum.accumulate(np.where(new, slots, 0))
            h *= 2

    def _bound(self, low: np.ndarray, high: np.ndarray, want: np.ndarray, d: int) -> np.ndarray:
        """The first suffix of [low, high) whose words from the d-th on are not below ``want``."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            p = self.order[np.minimum(mid, len(self.order) - 1)]
            value = np.where(p + d < self.end[p], self.key[np.minimum(p + d, len(self.key) - 1)], U64(0))
            less = open_ & (value < want)
            low = np.where(less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        return low

    def search(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Verified (shard position, index of the block's window) of every occurrence of every window."""
        none = np.zeros(0, np.int64)
        if not len(self.order) or not len(block.start):
            return none, none
        code = np.maximum(block.hashes >> (U64(64) - BITS), U64(1))
        live = np.arange(len(block.start))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(self.order), np.int64)
        d, deepest = 0, int(block.length.max())
        while d < deepest and len(live):
            more = block.length[live] > d
            want, rest = np.zeros(len(live), np.uint64), np.zeros(len(live), np.uint64)
            for k in range(3):
                has = block.length[live] > d + k
                c = code[np.minimum(block.start[live] + d + k, len(code) - 1)]
                want = (want << BITS) | np.where(has, c, U64(0))
                rest = (rest << BITS) | np.where(has, U64(0), (U64(1) << BITS) - U64(1))
            if d == 0:
                a, b = np.searchsorted(self.sorted_key, want), np.searchsorted(self.sorted_key, want | rest, side="right")
            else:
                a = self._bound(low, high, want, d)
                b = self._bound(low, high, (want | rest) + U64(1), d)
            low, high = np.where(more, a, low), np.where(more, b, high)
            keep = high > low
            live, low, high = live[keep], low[keep], high[keep]
            d += 3
        if not len(live):
            return none, none
        count = high - low
        win = np.repeat(live, count)
        pos = self.order[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        good = pos + block.length[win] <= self.end[pos]
        for k in range(deepest):
            good &= (block.length[win] <= k) | (self.hashes[np.minimum(pos + k, len(self.hashes) - 1)] == block.hashes[np.minimum(block.start[win] + k, len(block.hashes) - 1)])
        return pos[good], win[good]

    def longest(self, block: Block, pos: np.ndarray, win: np.ndarray) -> np.ndarray:
        """How many words each occurrence goes on to match verbatim, to the end of its item or text."""
        size = block.length[win].copy()
        open_ = np.arange(len(pos))
        while len(open_):
            p, b = pos[open_] + size[open_], block.start[win[open_]] + size[open_]
            inside = (p < self.end[pos[open_]]) & (b < block.end[win[open_]])
            open_, p, b = open_[inside], p[inside], b[inside]
            same = self.hashes[p] == block.hashes[b]
            open_ = open_[same]
            size[open_] += 1
        return size


def _scan(texts: pa.Array, block: Block) -> dict:
    n_words, runs, items, longest, where = [], [], [], [], []
    for _, data, offsets in text_chunks(texts):
        _, _, _, hashes, first = words(data, offsets, ALNUM)
        n_words.extend(np.diff(first).tolist())
        size = len(first) - 1
        runs.extend([] for _ in range(size))
        items.extend([] for _ in range(size))
        longest.extend([0] * size)
        where.extend([None] * size)
        base = len(runs) - size
        array = SuffixArray(hashes, first, block.deepest)
        pos, win = array.search(block)
        if not len(pos):
            continue
        far = array.longest(block, pos, win)
        delta = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(delta, pos, 1)
        np.add.at(delta, pos + block.length[win], -1)
        hit = np.cumsum(delta)[:-1] > 0
        doc = np.searchsorted(first, pos, side="right") - 1
        by = np.lexsort((pos, -far, doc))
        for k in by[np.unique(doc[by], return_index=True)[1]]:
            d = int(doc[k])
            longest[base + d], where[base + d] = int(far[k]), int(pos[k] - first[d])
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[first[d] : first[d + 1]], [False]]).astype(np.int8)))
            runs[base + d] = edge.tolist()
        for d, i in np.unique(np.stack([doc, block.item[win]], axis=1), axis=0).tolist():
            if block.ids[i] is not None:
                items[base + d].append(block.ids[i])
    return {"n_words": pa.array(n_words, pa.int64()), "runs": pa.array(runs, pa.list_(pa.int64())), "items": pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), "longest": pa.array(longest, pa.int64()), "longest_at": pa.array(where, pa.int64())}


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 2_000_000) -> tuple[DataFrame, str]:
    """The documents with one struct column of benchmark matches added, and that column's name.

    Fields: ``n_words``; ``runs``, the word ranges covered by occurrences of a window as start, end, start, end ...;
    ``items``, the sorted distinct ids of the items found (a null id is left out, its words still count);
    ``longest``, the words of the longest verbatim match that holds a window (0: none), and ``longest_at``, its
    first word.

    Null and empty texts have no words.  Rows are kept as they are, repeated ones too; other columns pass through
    whatever their names.  An item without words matches nothing; repeated items count once by id.  A benchmark
    that exceeds ``block_words`` is searched block by block, with a checkpoint between the passes.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    n = (items.agg(F.sum(F.length("t"))).first()[0] or 0) // 2 + 1
    blocks = -(-n // block_words)
    parts = [items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) for k in range(blocks)] if blocks > 1 else [items]
    name = free_name(docs, "leaks")
    for k, part in enumerate(parts):
        shared = docs.sparkSession.sparkContext.broadcast(Block([(r.i, r.t) for r in part.collect()], window))
        new = name if k == 0 else free_name(docs, "more_leaks")
        docs = with_text_struct(docs, text, new, LEAKS, lambda shared=shared: lambda texts: _scan(texts, shared.value))
        if k:
            docs = docs.withColumn(name, _merged(F.col(name), F.col(new))).drop(new)
        if len(parts) > 1:
            docs = cut(docs)
    return docs, name


def _merged(a, b):
    def covered(x):
        ends = F.filter(F.transform(x, lambda v, i: F.struct(v.alias("a"), F.get(x, i + 1).alias("b"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
        return F.flatten(F.transform(ends, lambda s: F.sequence(s["a"], s["b"] - 1)))

    at = F.array_sort(F.array_distinct(F.concat(covered(a["runs"]), covered(b["runs"]))))
    starts = F.filter(at, lambda i: ~F.array_contains(at, i - 1))
    ends = F.filter(at, lambda i: ~F.array_contains(at, i + 1))
    runs = F.flatten(F.zip_with(starts, ends, lambda x, y: F.array(x, y + 1)))
    better = b["longest"] > a["longest"]
    return F.struct(a["n_words"].alias("n_words"), runs.alias("runs"), F.array_sort(F.array_union(a["items"], b["items"])).alias("items"), F.greatest(a["longest"], b["longest"]).alias("longest"), F.when(better, b["longest_at"]).otherwise(a["longest_at"]).alias("longest_at"))


def hit_words(leaks):
    """Number of words that the runs of a ``leaks`` column cover."""
    return F.aggregate(F.transform(leaks["runs"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda s, x: s + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns."""
    found, name = find_leaks(docs, benchmark, **options)
    return found.where(F.size(F.col(name)["runs"]) == 0).drop(name)
