"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2-2c.  A fixed rotation spreads that distance over the
coordinates, which are split into blocks; if the whole squared distance is within budget, at least one block's is
within its proportional share.  Each block is range-joined on a grid of its first coordinates, whose cells are as wide
as the block's radius: a vector is at home in one cell and a probe in those later ones that its ball reaches.
Cells that hold too many vectors are parted by the block's next coordinates, again by reach.  The vectors of a label are
dealt to chunks, a file each in the shared folder, and a task joins two chunks in all blocks: each vector is written
once, however many cells it reaches or chunks its label has.  A pair is taken in the first block that qualifies, so nothing is counted twice, and the union of the candidates is verified by the cosine of
the vectors as they were given, in double precision.

Vectors without any structure fill so few cells of a block that most pairs of a label meet in some cell; there the
join costs one small matrix product a block, and it is the block's budget that leaves few pairs to verify.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, components, cut, in_batches, maybe_broadcast
from .warc import opened

#: Blocks of a vector, coordinates of a block that one level of its grid takes, and slack for rounding.
BLOCKS, GRID, SLACK = 4, 2, 1e-9
#: Vectors of a chunk on average at most; a label of more than SHARE vectors is dealt to up to SPREAD chunks even so, for
#: more tasks. Cells of more than half a chunk are parted by the block's next coordinates.
CELL, SHARE, SPREAD = 16384, 1024, 8
#: Rows of a matrix of distances that are looked at together.
ROWS = 512


@lru_cache
def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def split(d: int) -> list[slice]:
    edges = np.linspace(0, d, min(BLOCKS, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no cosine, so that no square over- or underflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def rotated(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def pack(v: list[float]) -> bytes:
    """A vector's bytes, in single precision where that loses nothing."""
    x = np.asarray(v, np.float64)
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return b"\x04" + small.tobytes() if np.array_equal(small, x) else b"\x08" + x.tobytes()


def unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float32 if b[0] == 4 else np.float64, offset=1).astype(np.float64)


def _parted(y: np.ndarray, block: slice, level: int, width: float, home: np.ndarray, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cells, home, squared distance from each row to the cell) of one level of a block's grid: the own cell and
    the neighbours that a row's ball reaches, for a row at home only later ones."""
    part = y[:, block][:, level * GRID : (level + 1) * GRID] / width
    own = np.floor(part).astype(np.int64)
    below = part - own
    zero = (0,) * own.shape[1]
    for off in product((-1, 0, 1), repeat=own.shape[1]):
        gap = sum((np.square((below if o < 0 else 1 - below)[:, k]) for k, o in enumerate(off) if o), np.zeros(len(y))) * width * width + used
        ok = gap <= width * width
        if off < zero:
            ok &= ~home
        at = np.flatnonzero(ok)
        if len(at):
            yield at, own[at] + off, home[at] & (off == zero), gap[at]


def radius(threshold: float, block: slice, d: int) -> float:
    return float(np.sqrt((2 - 2 * threshold) * (block.stop - block.start) / d) * (1 + 1e-6) + 1e-6)


def _met(y: np.ndarray, block: slice, level: int, width: float, crowd: int, at: np.ndarray, home: np.ndarray, used: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, home) of each cell of a block; crowded cells are parted by the next coordinates, as far as the block has any."""
    found = [*_parted(y[at], block, level, width, home, used)]
    rows, own, gap = (np.concatenate([f[k] for f in found]) for k in (0, 2, 3))
    cell = np.unique(np.concatenate([f[1] for f in found]), axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(cell, kind="stable")
    deeper = (level + 1) * GRID < block.stop - block.start
    for one in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
        if not own[one].any():
            continue
        if deeper and len(one) > crowd:
            yield from _met(y, block, level + 1, width, crowd, at[rows[one]], own[one], gap[one])
        else:
            yield at[rows[one]], own[one]


def _merge(low: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Components, as the least member of each, after u and v are joined."""
    while len(u):
        least = np.minimum(low[u], low[v])
        new = low.copy()
        for at in (low[u], low[v], u, v):
            np.minimum.at(new, at, least)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
        apart = low[u] != low[v]
        u, v = u[apart], v[apart]
    return low


class Cell:
    """The vectors of a cell, and its pairs that are within the block's budget."""

    def __init__(self, x: np.ndarray, block: int, threshold: float, y: np.ndarray | None = None):
        self.x, y, d = scaled(x), rotated(x) if y is None else y, x.shape[1]
        self.norm = np.linalg.norm(self.x, axis=1)
        self.threshold = threshold
        self.parts = [(np.ascontiguousarray(y[:, s]), (2 - 2 * threshold) * (s.stop - s.start) / d + SLACK) for s in split(d)[: block + 1]]
        self.small = self.parts[-1][0].astype(np.float32)
        self.square = np.square(self.small).sum(axis=1)
        self.met = self.candidates = 0

    def pairs(self, rows: np.ndarray, others: np.ndarray, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links between ``rows`` and ``others``; with ``upper``, rows are the first of others and come once each."""
        share, small, square = self.parts[-1][1], self.small, self.square
        for a in range(0, len(rows), ROWS):
            i = rows[a : a + ROWS]
            j = others[a:] if upper else others
            near = small[i] @ small[j].T
            near *= -2
            near += square[i, None]
            near += square[None, j]
            # single precision finds all that may be within budget
            p, q = np.nonzero(near <= np.float32(share + 1e-5))
            self.met += len(i) * len(j) - (len(i) * (len(i) + 1) // 2 if upper else 0)
            if upper:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 1 << 16):
                u, v = i[p[k : k + (1 << 16)]], j[q[k : k + (1 << 16)]]
                # a pair is taken in the first block that is within budget
                for n, (z, most) in enumerate(reversed(self.parts)):
                    within = np.square(z[u] - z[v]).sum(axis=1) <= most
                    u, v = (u[within], v[within]) if n == 0 else (u[~within], v[~within])
                self.candidates += len(u)
                link = np.einsum("ij,ij->i", self.x[u], self.x[v]) / (self.norm[u] * self.norm[v]) >= self.threshold
                if link.any():
                    yield u[link], v[link]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, label, vec``: vectors as bytes, with one zero only."""
    for batch in batches:
        vec = pa.array([pack(np.asarray(v, np.float64) + 0.0) for v in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), vec], ["node", "label", "vec"])


def _links(threshold: float, crowd: int):
    """Links of pairs of chunks ``a, b`` (paths): what each node links with in number, and what ties nodes together."""

    def read(path: str) -> pa.Table:
        with opened(path) as f:
            return pq.read_table(f, columns=["node", "copies", "label", "vec"])

    def joined(x: np.ndarray, first: np.ndarray, copies: np.ndarray, upper: bool) -> tuple[np.ndarray, np.ndarray]:
        y, d, at = rotated(x), x.shape[1], np.arange(len(x))
        got, low = np.zeros(len(x), np.int64), at
        for b, s in enumerate(split(d)):
            cell = Cell(x, b, threshold, y)
            for rows, home in _met(y, s, 0, radius(threshold, s, d), crowd, at, np.ones(len(x), bool), np.zeros(len(x))):
                own, probe = rows[home], rows[~home]
                if upper:
                    found = [(own, np.concatenate([own, probe]), True)]
                else:
                    one, other = first[own], first[probe]
                    found = [(own[one], np.concatenate([own[~one], probe[~other]]), False), (own[~one], probe[other], False)]
                for u, v in (pair for f in found for pair in cell.pairs(*f)):
                    got += np.bincount(u, copies[v], len(got)).astype(np.int64) + np.bincount(v, copies[u], len(got)).astype(np.int64)
                    low = _merge(low, u, v)
        return got, low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = [read(p) for p in ([a] if a == b else [a, b])]
                table = pa.concat_tables(held)
                node, copies, label = table.column("node").to_numpy(), table.column("copies").to_numpy(), table.column("label").combine_chunks().dictionary_encode()
                label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
                first = np.arange(len(node)) < len(held[0])
                vec = table.column("vec").to_pylist()
                sort = np.stack([label, [(len(v) - 1) // v[0] for v in vec]], axis=1)
                for one in np.unique(sort, axis=0):
                    here = np.flatnonzero((sort == one).all(axis=1))
                    if len(here) < 2 or (a != b and first[here].all() | ~first[here].any()):
                        continue
                    got, low = joined(np.stack([unpack(vec[k]) for k in here.tolist()]), first[here], copies[here], a == b)
                    ids = node[here]
                    linked, tied = np.flatnonzero(got), np.flatnonzero(low != np.arange(len(ids)))
                    if len(linked):
                        column = lambda x, y: pa.concat_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())])
                        yield pa.RecordBatch.from_arrays([column(ids[linked], ids[tied]), column(got[linked], [None] * len(tied)), column([None] * len(linked), ids[low[tied]])], ["node", "links", "other"])

    return run


def _chunks(reps: DataFrame, counts: DataFrame) -> list[str]:
    """Files of a chunk each in the shared folder, of distinct vectors dealt by a hash; a label of up to SHARE vectors is
    whole in a bundle with others.  ``counts``: label, n (copies counted, so that chunks are rather too small)."""
    spark, cell, share, spread = reps.sparkSession, CELL, min(SHARE, CELL), SPREAD
    small = counts.where(F.col("n") <= share).agg(F.sum("n")).first()[0] or 0
    bundles = -(-small // share) or 1
    sizes = cut(counts.where(F.col("n") > share).withColumn("s", F.greatest(F.ceil(F.col("n") / cell), F.least(F.lit(spread), F.ceil(F.col("n") / share))).cast("int")).select("label", "s"))
    dealt = reps.join(maybe_broadcast(sizes, 96), "label", "left")
    key = F.when(F.col("s").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("label"), F.lit(bundles)))).otherwise(F.concat(F.lit("l"), F.hex(F.xxhash64("label")), F.lit("c"), F.pmod(F.xxhash64("node"), "s")))
    folder = f"{checkpoint_dir(spark)}/vectors-{uuid4().hex}"
    # by a hash of the chunk, so that the exchange is never left out and a chunk is one file
    dealt.select("node", "copies", "label", "vec", key.alias("chunk")).repartition(F.xxhash64("chunk")).sortWithinPartitions("chunk").write.partitionBy("chunk").option("maxRecordsPerFile", 0).parquet(folder)
    return sorted(spark.read.schema("node bigint, chunk string").parquet(folder).inputFiles())


def _pairs(spark: SparkSession, files: list[str]) -> DataFrame:
    """Pairs ``a, b`` of chunks of one label, and each bundle with itself."""
    named = [(p, *re.search(r"/chunk=(b\d+|l[0-9A-F]+)c?(\d*)/", p).groups()) for p in files]
    one = spark.createDataFrame([(g, p) for p, g, _ in named], "g string, a string")
    pairs = one.join(one.withColumnRenamed("a", "b"), "g").where("a <= b").select("a", "b")
    n = Counter(g for _, g, _ in named)
    return pairs.repartition(max(1, min(4096, sum(k * (k + 1) // 2 for k in n.values()) // 4)))


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors of equal, non-null label and equal length link when their cosine is at least ``threshold``.  Vectors that
    are null, empty, zero, or hold null or non-finite components link with nothing and stand alone, as do those
    without label.  Equal vectors are joined as one, with their number; a repeated vec_id counts as another vector.
    A null vec_id never names a component and isn't kept.  Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    node = F.when(usable, F.xxhash64("label", "v"))
    rows = rows.withColumn("node", node)
    packed = in_batches(rows.where("node IS NOT NULL").select("node", "label", "v"), _packed, "node bigint, label string, vec binary")
    counts = cut(rows.where("node IS NOT NULL").groupBy("label").agg(F.count("*").alias("n")))
    files = _chunks(packed.groupBy("node", "label", "vec").agg(F.count("*").alias("copies")), counts)
    found = cut(_pairs(vectors.sparkSession, files).mapInArrow(_links(threshold, CELL // 2), "node bigint, links bigint, other bigint"))
    tied = components(found.where("other IS NOT NULL"), "node", "other")
    links = found.where("links IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    # ids of each component, by way of the smallest id and the number of copies of each distinct vector
    ids = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    named = ids.join(tied, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    facts = named.join(least, "c").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    alone = rows.where("node IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("node IS NOT NULL").join(facts, "node").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
