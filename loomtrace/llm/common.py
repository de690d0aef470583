"""Shared pieces: checkpoints, byte-level tokenisation in numpy, distributed components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
GOLDEN = U64(0x9E3779B97F4A7C15)
TOO_BIG_TO_BROADCAST = 32 << 20


# --------------------------------------------------------------------------- lineage
def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Where none is set, a local master gets a temporary one; a cluster is an error,
    as its machines share no temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="loomtrace-")
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def bounded(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows and about ``size`` bytes (one row may be longer)."""
    for batch in batches:
        step = rows if batch.nbytes <= size else max(1, min(rows, int(batch.num_rows * size / batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def in_batches(df: DataFrame, fn, schema, rows: int = 1024, size: int = 16 << 20) -> DataFrame:
    """``mapInArrow`` whose function sees batches of bounded size, whatever later plans set in the session: the bound
    is part of the function.  The session's own bound (64 MB a batch by default) limits what is sent at once."""
    return df.mapInArrow(lambda batches: fn(bounded(batches, rows, size)), schema)


# --------------------------------------------------------------------------- tokens
def _byte_class(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased; bytes of other code points are all >= 0x80.
ALNUM = _byte_class(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or b >= 128)
#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = _byte_class(lambda b: b != 32 and not 9 <= b <= 13)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise and without overflow checks."""
    x = x ^ (x >> U64(30))
    x = x * MIX_A
    x = x ^ (x >> U64(27))
    x = x * MIX_B
    return x ^ (x >> U64(31))


def text_chunks(texts: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of an Arrow string array as (first row, bytes, row offsets); a slice holds whole texts,
    at most ``max_bytes`` of them unless a single text is longer.  A null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case A-Z and find the words of all texts at once.

    Returns (lowered bytes, word starts, word ends, 64-bit word hashes, first word of each text plus the total).
    """
    low = LOWER[data]
    is_word = kind[low]
    before = np.zeros(len(low) + 1, dtype=bool)
    before[1:] = is_word
    before[offsets] = False  # a text never continues the text before it
    starts = np.flatnonzero(is_word & ~before[:-1])
    after = np.ones(len(low) + 1, dtype=bool)
    after[:-1] = ~is_word
    after[offsets] = True
    ends = np.flatnonzero(is_word & after[1:]) + 1
    first = np.searchsorted(starts, offsets)
    return low, starts, ends, hash_spans(low, starts, ends), first


def hash_spans(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time."""
    padded = np.zeros(len(low) + 16, dtype=np.uint8)
    padded[: len(low)] = low
    eights = np.ndarray((len(low) + 9,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = ends - starts
    h = mix((eights[starts] & _KEEP[np.minimum(length, 8)]) + GOLDEN * length.astype(np.uint64))
    more, at = np.flatnonzero(length > 8), 8
    while len(more):
        part = eights[starts[more] + at] & _KEEP[np.minimum(length[more] - at, 8)]
        h[more] = mix(h[more] * MIX_A + part + GOLDEN)
        at += 8
        more = more[length[more] > at]
    return h


def hash_words(items: list[str]) -> np.ndarray:
    """The same hashes for words held as strings."""
    raw = [x.encode() for x in items]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(x) for x in raw], dtype=np.int64)
    return hash_spans(np.frombuffer(b"".join(raw), dtype=np.uint8), starts, ends)


# --------------------------------------------------------------------------- sizes
def fits_broadcast(df: DataFrame, row_bytes: int, limit: int = TOO_BIG_TO_BROADCAST) -> bool:
    """Whether a (checkpointed) table is proven small: counts at most one row over the bound."""
    most = max(1, limit // row_bytes)
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, row_bytes) else df


# --------------------------------------------------------------------------- components
class Forest:
    """Union-find over the members of one bounded block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], dtype=np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components as (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps; every step is one minimum per node (combined before the
    shuffle) and one join back, so a hub is never gathered in a task.  Only a fingerprint of the edge set, one
    row, reaches the driver; each round cuts its lineage in the shared folder.
    """
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
            .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    was = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: every larger neighbour of u now hangs on the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: the smaller neighbours of u, and u itself, hang on the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# --------------------------------------------------------------------------- text mapping
def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text_struct(df: DataFrame, text: str, name: str, ddl: str, make) -> DataFrame:
    """Append one struct column computed from whole texts, one Arrow batch at a time.

    ``make()`` runs once per task and returns a function from an Arrow array to one dict of arrays;
    the fields follow ``ddl``.
    """
    from pyspark.sql.types import StructField, StructType

    fields = StructType.fromDDL(ddl)
    names = fields.fieldNames()
    at = df.columns.index(text)
    out = StructType([*df.schema.fields, StructField(name, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            got = fn(batch.column(at))
            cols = [x if isinstance(x, pa.Array) else pa.array(x) for x in (got[n] for n in names)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays(cols, names)], [*batch.schema.names, name])

    return in_batches(df, run, out)
