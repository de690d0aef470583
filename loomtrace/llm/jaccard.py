"""Near-duplicate join on word shingles: signature trees with a dual traversal.

1. Every document becomes the set of its shingles' hashes.  Documents with equal sets are one vertex from here on,
   so copies cost nothing.  A prefix of each set (its smallest hashes, half as many again as two similar sets may
   differ in) is packed into blobs and dealt out by hash, to as many tasks as the counted keys need; a key that several
   vertices of fitting size share makes a list.  A vertex that shares fewer keys than similar sets must is out: a shared
   passage is not enough.  A long list is dealt as pairs of parts, by size band and salt, before anything else travels.
2. The vertices left in lists get a token bitmap.  Each task builds signature trees over its lists, whose nodes hold the
   OR of the bitmaps below and the range of set sizes, and walks pairs of nodes, dropping a pair when the sizes are
   incompatible or the largest possible overlap is too small.  What is left joins vertices into clusters.
3. Clusters, split by size band and salt where large, get the sets themselves; the same walk, now with an exact
   check of every surviving pair, gives the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, MIX_A, NOT_SPACE, U64, Forest, components, cut, in_batches, maybe_broadcast, mix, text_chunks, words

FANOUT = 8
#: Keys that a task gathers before it hands them on, keys that one task of step 1 sorts, vertices of a list that stay
#: together, and vertices and shingles that one task of step 3 compares at once with as many others.
FLUSH_KEYS, TASK_KEYS, LIST, CLUSTER, SHINGLES = 1 << 18, 1 << 22, 512, 2048, 1 << 22
#: Places per task that lists are dealt to.
HOMES = 8


# --------------------------------------------------------------------------- sets
def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order of the rows."""
    none = np.zeros(0, np.uint64)
    for _, data, offsets in text_chunks(texts):
        _, _, _, h, first = words(data, offsets, NOT_SPACE)
        g = np.zeros(max(0, len(h) - k + 1), np.uint64)
        if len(g):
            for j in range(k):
                g = g * MIX_A + h[j : len(h) - k + 1 + j]
            g = mix(g + GOLDEN)
        for a, b in pairwise(first.tolist()):
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                whole = U64(b - a)
                for x in h[a:b]:
                    whole = U64((int(whole) * int(MIX_A) + int(x)) & (2**64 - 1))
                yield mix(np.array([whole], np.uint64) + U64(1))
            else:
                yield none


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of a set."""
    if not len(s):
        return 0
    total = np.array([np.add.reduce(mix(s ^ MIX_A))], np.uint64)
    return int(mix(total * GOLDEN + U64(len(s))).view(np.int64)[0])


class Similarity:
    """Jaccard similarity of at least num/den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def spare(self, n):
        """Elements of a set of n that a similar set may lack at most."""
        return n + (-self.num * n) // self.den

    def prefix(self, n):
        """How many smallest hashes of a set of n are compared."""
        return 3 * self.spare(n) // 2 + 1

    def least_shared(self, n):
        """How many of these a similar set shares at least.  Of two similar sets, all that the prefix which ends first
        shares with the other set is in the other's prefix; the smaller set of the two may be num/den of n."""
        small = -((-self.num * n) // self.den)
        return self.prefix(small) - self.spare(small)

    def overlap(self, a, b):
        """Least overlap of sets of a and b."""
        return -((-self.num * (a + b)) // (self.num + self.den))

    def fits(self, small, large):
        return self.num * large <= self.den * small

    def band(self, n: np.ndarray) -> np.ndarray:
        """Sizes that fit are in the same band or in neighbouring ones."""
        return np.floor(np.log(n) / np.log(self.den / self.num) + 1e-9).astype(np.int64)


# --------------------------------------------------------------------------- step 1
def _sizes(k: int):
    """Per document: its set's size and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(len(s), set_id(s) if len(s) else None) for s in shingle_sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in sets], pa.int64()), pa.array([v for _, v in sets], pa.int64())], ["doc_id", "n", "v"])

    return run


def _sketch(k: int, sim: Similarity, buckets: int):
    """Per bucket: a blob of prefix keys, their vertices, and the vertices' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        seen: dict[int, int] = {}
        sizes: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            key, own = np.concatenate(keys), np.concatenate(owners)
            bucket = (key % U64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            key, own, bucket = key[by], own[by], bucket[by]
            at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ids, n = np.array(list(seen), np.int64), np.array(sizes, np.int64)
            blobs = []
            for a, b in zip(at, [*at[1:], len(key)], strict=True):
                used, count = np.unique(own[a:b], return_counts=True)  # keys of one vertex stand together
                blobs.append(np.array([b - a, len(used)], np.int64).tobytes() + key[a:b].tobytes() + ids[used].tobytes() + np.stack([n[used], count]).astype(np.int32).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                n, v = len(s), set_id(s)
                if n and v not in seen:
                    seen[v] = len(sizes)
                    sizes.append(n)
                    keys.append(s[: sim.prefix(n)])
                    owners.append(np.full(len(keys[-1]), seen[v], np.int64))
                    held += len(keys[-1])
            if held >= FLUSH_KEYS:
                yield flush()
                keys, owners, seen, sizes, held = [], [], {}, [], 0
        if held:
            yield flush()

    return run


LISTS = "part bigint, v bigint, n bigint, keys bigint, need bigint, blob binary"


def _list_rows(part: int, v=None, n=None, keys=None, need=None, blob=None) -> pa.RecordBatch:
    size = len(v if v is not None else blob)
    column = lambda x, t: pa.nulls(size, t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array([part] * size, pa.int64()), column(v, pa.int64()), column(n, pa.int64()), column(keys, pa.int64()), column(need, pa.int64()), column(blob, pa.binary())], ["part", "v", "n", "keys", "need", "blob"])


def pieces(sim: Similarity, ids: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(name, vertices) of the pieces of a list: the list itself, or for a long one pairs of its parts by size band and
    salt, such that any two vertices whose sizes fit meet in a piece.  Lists of one group name theirs alike."""
    hub = int(ids.min())
    if len(ids) <= LIST:
        yield hub, ids
        return
    band = sim.band(n)
    parts: dict[int, list[np.ndarray]] = {}
    for b in np.unique(band).tolist():
        some = ids[band == b]
        # powers of two, so that lists of like length are parted alike
        salts = 1 << int(np.ceil(np.log2(max(1, len(some) / LIST))))
        salt = (mix(some.astype(np.uint64)) & U64(salts - 1)).astype(np.int64)
        parts[b] = [some[salt == k] for k in range(salts)]
    for b, own in parts.items():
        for i, one in enumerate(own):
            for other, d in ((own[i:], 0), (parts.get(b + 1, []), 1)):
                for j, two in enumerate(other):
                    both = one if d == 0 and j == 0 else np.concatenate([one, two])
                    if len(both) > 1:
                        yield hash((hub, b, len(own), i, d, len(other), j + i * (1 - d))), both


def _lists(sim: Similarity, homes: int):
    """Of a task's keys, those that several vertices of fitting size share: per vertex how many, and the lists, equal
    ones once, by the home of a list's smallest vertex (and part); there the lists of one group meet again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, v, n = [], [], []
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                m, u = np.frombuffer(blob, np.int64, 2)
                facts = np.frombuffer(blob, np.int32, 2 * u, 16 + 8 * (m + u))
                key.append(np.frombuffer(blob, np.uint64, m, 16))
                v.append(np.repeat(np.frombuffer(blob, np.int64, u, 16 + 8 * m), facts[u:]))
                n.append(np.repeat(facts[:u], facts[u:]))
        if not key:
            return
        key, v, n = map(np.concatenate, (key, v, n))
        # only keys that occur twice are of use
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        use = np.zeros(len(key), bool)
        use[by[1:]] |= same
        use[by[:-1]] |= same
        key, v, n = key[use], v[use], n[use]
        by = np.lexsort((v, n, key))
        key, v, n = key[by], v[by], n[by]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (v[1:] != v[:-1])]) if len(key) else np.zeros(0, bool)
        key, v, n = key[fresh], v[fresh], n[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(key))
        out_v, out_n = [], []
        blobs: dict[int, dict[bytes, None]] = {}
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a < 2:
                continue
            # sizes ascend: a vertex stays if a neighbour in size fits it
            near = sim.fits(n[a : b - 1].astype(np.int64), n[a + 1 : b].astype(np.int64))
            keep = np.zeros(b - a, bool)
            keep[1:] |= near
            keep[:-1] |= near
            if not keep.any():
                continue
            ids = v[a:b][keep]
            out_v.append(ids)
            out_n.append(n[a:b][keep])
            for name, some in pieces(sim, ids, n[a:b][keep]):
                blobs.setdefault(int(mix(np.array([name], np.int64).view(np.uint64))[0] % U64(homes)), {})[some.tobytes()] = None
        if not blobs:
            return
        ids, first, count = np.unique(np.concatenate(out_v), return_index=True, return_counts=True)
        sizes = np.concatenate(out_n)[first]
        sizes = sizes.astype(np.int64)
        yield _list_rows(0, v=ids, n=sizes, keys=count, need=sim.least_shared(sizes))
        for home, some in blobs.items():
            yield _list_rows(home, blob=[_pack(list(some))])

    return run


def packed_lists(blob: bytes) -> Iterator[np.ndarray]:
    raw = np.frombuffer(blob, np.int64)
    ends = np.cumsum(raw[1 : 1 + raw[0]])
    body = raw[1 + raw[0] :]
    for a, b in pairwise([0, *ends.tolist()]):
        yield body[a:b]


def _pack(lists: list[bytes]) -> bytes:
    return np.array([len(lists), *(len(x) // 8 for x in lists)], np.int64).tobytes() + b"".join(lists)


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per home: its lists, equal ones once, and the vertices that they name."""
    homes: dict[int, dict[bytes, None]] = {}
    for batch in batches:
        for home, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            homes.setdefault(home, {}).update((x.tobytes(), None) for x in packed_lists(blob))
    for home, lists in homes.items():
        yield _list_rows(home, v=np.unique(np.frombuffer(b"".join(lists), np.int64)))
        yield _list_rows(home, blob=[_pack(list(lists))])


# --------------------------------------------------------------------------- trees
def bitmap_width(n: int) -> int:
    """Bits for sets of n: a power of two, at least 128."""
    return max(128, 1 << int(np.ceil(np.log2(8 * n))))


def bitmap(s: np.ndarray) -> np.ndarray:
    width = bitmap_width(len(s))
    bits = np.zeros(width, np.uint8)
    bits[(s & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words_: int) -> np.ndarray:
    """A narrower bitmap of the same set; widths are powers of two."""
    return np.bitwise_or.reduce(bits.reshape(-1, words_), axis=0) if len(bits) != words_ else bits


class SignatureTree:
    """Levels of nodes from single sets up; a node holds the OR of its sets' bitmaps, the fewest bits that one of
    them has, and its range of sizes."""

    def __init__(self, member: np.ndarray, bits: np.ndarray, n: np.ndarray):
        by = np.lexsort((*(bits[:, j] for j in range(min(3, bits.shape[1]))), n))
        # sets alike in their first words of bitmap and in size stand together
        by = by[np.argsort(bits[by, 0], kind="stable")]
        self.member, b, n = member[by], bits[by], n[by]
        self.levels = [(b, np.bitwise_count(b).sum(axis=1).astype(np.int64), n, n)]
        while len(self.levels[-1][0]) > 1:
            b, few, low, high = self.levels[-1]
            at = np.arange(0, len(b), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(few, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)))

    def uniform(self, forest: Forest) -> list[np.ndarray]:
        """For each level, the component that all sets below a node are in, else -1."""
        out = [np.array([forest.find(x) for x in self.member.tolist()], np.int64)]
        while len(out) < len(self.levels):
            x, at = out[-1], np.arange(0, len(out[-1]), FANOUT)
            low, high = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
            out.append(np.where(low == high, low, -1))
        return out


def _possible(sim: Similarity, one, other, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets below nodes i and j can be similar: sizes first, then the largest possible overlap."""
    (b1, few1, low1, high1), (b2, few2, low2, high2) = one, other
    ok = (sim.num * low1[i] <= sim.den * high2[j]) & (sim.num * low2[j] <= sim.den * high1[i])
    at = np.flatnonzero(ok)
    for s in range(0, len(at), 1 << 14):
        p = at[s : s + (1 << 14)]
        shared = np.bitwise_count(b1[i[p]] & b2[j[p]]).sum(axis=1).astype(np.int64)
        most = np.minimum(high1[i[p]] - np.maximum(0, few1[i[p]] - shared), high2[j[p]] - np.maximum(0, few2[j[p]] - shared))
        ok[p] = most >= sim.overlap(low1[i[p]], low2[j[p]])
    return ok


def dual_walk(sim: Similarity, one: SignatureTree, other: SignatureTree, forest: Forest, accept) -> None:
    """Walk pairs of nodes from the roots down, joining in ``forest`` the pairs of sets that ``accept`` takes.
    Pairs whose sets are joined already are passed over; nodes wait on a stack, so few pairs are held at once."""
    same = one is other
    depth = max(len(one.levels), len(other.levels)) - 1
    u1 = one.uniform(forest)
    u2 = u1 if same else other.uniform(forest)
    joined = 0
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        l1, l2 = min(level, len(one.levels) - 1), min(level, len(other.levels) - 1)
        if joined > 64:
            joined, u1 = 0, one.uniform(forest)
            u2 = u1 if same else other.uniform(forest)
        keep = (u1[l1][i] < 0) | (u1[l1][i] != u2[l2][j])
        i, j = i[keep], j[keep]
        ok = _possible(sim, one.levels[l1], other.levels[l2], i, j)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            if same:
                i, j = i[i < j], j[i < j]
            for a, b in zip(one.member[i].tolist(), other.member[j].tolist(), strict=True):
                if forest.find(a) != forest.find(b) and accept(a, b):
                    forest.join(a, b)
                    joined += 1
            continue
        # children of both nodes, of the deeper tree only while the other is at its root
        c1 = i[:, None] * FANOUT + np.arange(FANOUT) if level <= len(one.levels) - 1 else i[:, None]
        c2 = j[:, None] * FANOUT + np.arange(FANOUT) if level <= len(other.levels) - 1 else j[:, None]
        size1, size2 = len(one.levels[min(level - 1, len(one.levels) - 1)][0]), len(other.levels[min(level - 1, len(other.levels) - 1)][0])
        x, y = np.repeat(c1, c2.shape[1], axis=1).ravel(), np.tile(c2, (1, c1.shape[1])).ravel()
        real = (x < size1) & (y < size2)
        if same:
            real &= x <= y
        x, y = x[real], y[real]
        for s in range(0, len(x), 1 << 15):
            stack.append((level - 1, x[s : s + (1 << 15)], y[s : s + (1 << 15)]))


def join_members(sim: Similarity, members: np.ndarray, n: np.ndarray, bits: list[np.ndarray], forest: Forest, accept) -> None:
    """All similar pairs among members: a tree for each band of sizes, walked with itself and with the next band's."""
    if len(members) == 2:
        a, b = members.tolist()
        small, large = sorted((int(n[a]), int(n[b])))
        if forest.find(a) != forest.find(b) and sim.fits(small, large):
            w = min(len(bits[a]), len(bits[b]))
            x, y = folded(bits[a], w), folded(bits[b], w)
            shared = int(np.bitwise_count(x & y).sum())
            most = min(int(n[a]) - int(np.bitwise_count(x).sum()) + shared, int(n[b]) - int(np.bitwise_count(y).sum()) + shared)
            if most >= sim.overlap(int(n[a]), int(n[b])) and accept(a, b):
                forest.join(a, b)
        return
    if len({forest.find(x) for x in members.tolist()}) == 1:
        return
    band = sim.band(n[members])
    trees: dict[int, SignatureTree] = {}

    def tree(b: int, narrow: int) -> SignatureTree:
        at = members[band == b]
        return SignatureTree(at, np.stack([folded(bits[x], narrow) for x in at.tolist()]), n[at])

    for b in np.unique(band).tolist():
        here = members[band == b]
        own = min(len(bits[x]) for x in here.tolist())
        trees[b] = tree(b, own)
        t = trees[b]
        for x, y in pairwise(t.member.tolist()):  # neighbours first: a group of near copies is joined at once
            if forest.find(x) != forest.find(y):
                w = min(len(bits[x]), len(bits[y]))
                p, q = folded(bits[x], w), folded(bits[y], w)
                shared = int(np.bitwise_count(p & q).sum())
                most = min(int(n[x]) - int(np.bitwise_count(p).sum()) + shared, int(n[y]) - int(np.bitwise_count(q).sum()) + shared)
                if sim.fits(*sorted((int(n[x]), int(n[y])))) and most >= sim.overlap(int(n[x]), int(n[y])) and accept(x, y):
                    forest.join(x, y)
        if len(t.member) > 2:
            dual_walk(sim, t, t, forest, accept)
        if b - 1 in trees:
            below = trees[b - 1]
            w = min(below.levels[0][0].shape[1], t.levels[0][0].shape[1])
            dual_walk(sim, below if below.levels[0][0].shape[1] == w else tree(b - 1, w), t if t.levels[0][0].shape[1] == w else tree(b, w), forest, accept)


# --------------------------------------------------------------------------- steps 2 and 3
def _edges(ids: np.ndarray, forest: Forest) -> pa.RecordBatch:
    roots = forest.roots()
    at = np.flatnonzero(roots != np.arange(len(roots)))
    a, b = ids[at], ids[roots[at]]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _candidates(sim: Similarity):
    """Per task of lists: vertices with bitmaps, and packed lists; gives a spanning forest of what bitmaps allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for part, v, n, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                p = parts.setdefault(part, [[], [], [], []])
                if v is None:
                    p[3].append(blob)
                else:
                    p[0].append(v)
                    p[1].append(n)
                    p[2].append(np.frombuffer(blob, np.uint64))
        for v, n, bits, blobs in parts.values():
            if not v:
                continue
            ids, by = np.unique(np.array(v, np.int64), return_index=True)
            n, bits = np.array(n, np.int64)[by], [bits[k] for k in by.tolist()]
            forest = Forest(len(ids))
            for blob in blobs:
                for some in packed_lists(blob):
                    at = np.minimum(np.searchsorted(ids, some), len(ids) - 1)
                    at = at[ids[at] == some]
                    if len(at) > 1:
                        join_members(sim, at, n, bits, forest, lambda x, y: True)
            yield _edges(ids, forest)

    return run


def _verified(sim: Similarity):
    """Per group of a cluster: the links between its sets, as a spanning forest."""

    def group(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("v").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("s").to_pylist()]
        n, bits = np.array([len(s) for s in sets], np.int64), [bitmap(s) for s in sets]

        def similar(a: int, b: int) -> bool:
            x, y = sets[a], sets[b]
            both = np.concatenate([x, y])
            both.sort()
            overlap = int((both[1:] == both[:-1]).sum())
            return sim.den * overlap >= sim.num * (len(both) - overlap)

        forest = Forest(len(ids))
        join_members(sim, np.arange(len(ids)), n, bits, forest, similar)
        return _edges(ids, forest)

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([group(table)])

    return run


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id``: sets of k-word shingles (words are runs of non-space,
    A-Z lower-cased; fewer than k words make one shingle) link at Jaccard similarity of num/den or more, and
    ``component_id`` is the smallest doc_id reachable.

    Null and empty texts have no shingles and stand alone.  Repeated rows are kept, each with its component; a
    null doc_id joins its component but is never its name.  Other columns are ignored.  Sets are told apart by
    64-bit hashes of shingles and of sets.
    """
    sim = Similarity(*similarity)
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    per_doc = cut(in_batches(base, _sizes(k), "doc_id bigint, n bigint, v bigint"))
    keys = per_doc.where("n > 0").agg(F.sum(F.floor(F.col("n") * F.lit(1.5 * (1 - sim.num / sim.den))) + 2)).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-keys // TASK_KEYS))
    blobs = in_batches(base.select("text"), _sketch(k, sim, 2 * parts), "bucket bigint, blob binary")
    lists = cut(blobs.repartition(parts, "bucket").mapInArrow(_lists(sim, HOMES * parts), LISTS))
    listed = lists.where("v IS NOT NULL").groupBy("v").agg(F.sum("keys").alias("keys"), F.min("need").alias("need"))
    active = cut(listed.where("keys >= need").select("v"))
    # one document stands for each vertex left; its text is read again for the bitmap and the set
    reps = per_doc.where("n > 0").groupBy("v").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count("*").alias("copies"))
    chosen = cut(reps.join(maybe_broadcast(active, 24), "v").select("v", "rep"))
    nameless = not chosen.where("rep IS NULL").isEmpty()

    def again(base, wanted, fn, ddl):
        rows = base.join(maybe_broadcast(wanted, 32), base.doc_id == wanted.rep).select("v", "text")
        out = in_batches(rows, fn, ddl)
        if nameless:
            # vertices whose documents have no id are found by their sets
            none = in_batches(base.where("doc_id IS NULL").select(F.lit(None).cast("bigint").alias("v"), "text"), fn, ddl)
            out = out.unionByName(none.join(maybe_broadcast(wanted.where("rep IS NULL").select("v"), 16), "v", "left_semi"))
        return out.dropDuplicates(["v"])

    def with_bits(batches):
        for batch in batches:
            v, n, b = [], [], []
            for x, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if len(s) and (own := set_id(s)) == (own if x is None else x):
                    v.append(own)
                    n.append(len(s))
                    b.append(bitmap(s).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.binary())], ["v", "n", "bits"])

    bits = again(base, chosen, with_bits, "v bigint, n bigint, bits binary")
    homes = cut(lists.where("v IS NULL").select("part", "blob").repartition(parts, "part").mapInArrow(_needs, LISTS))
    need = homes.where("v IS NOT NULL").select("part", "v").join(bits, "v").select("part", "v", "n", F.col("bits").alias("blob"))
    tasks = need.unionByName(homes.where("v IS NULL").select("part", "v", "n", "blob")).repartition(parts, "part")
    clusters = components(tasks.mapInArrow(_candidates(sim), "a bigint, b bigint"))
    clusters = cut(clusters.join(chosen, clusters.node == chosen.v).select("v", "rep", "component"))
    bands = np.log(sim.den / sim.num)
    sized = cut(clusters.join(reps.select("v", "n"), "v").withColumn("band", F.floor(F.log("n") / F.lit(float(bands)) + 1e-9).cast("int")))
    total = sized.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    salts = sized.groupBy("component", "band").agg(F.greatest(F.ceil(F.count("*") / F.lit(CLUSTER)), F.ceil(F.sum("n") / F.lit(SHINGLES))).cast("int").alias("salts"))
    around = lambda d: salts.select("component", (F.col("band") + d).alias("band"), F.col("salts").alias(f"s{d + 1}"))
    big = total.where((F.col("members") > CLUSTER) | (F.col("shingles") > SHINGLES)).select("component")
    split = sized.join(big, "component").join(around(0), ["component", "band"]).join(around(1), ["component", "band"], "left").join(around(-1), ["component", "band"], "left")
    i = F.pmod(F.xxhash64("v"), F.col("s1")).cast("int")
    name = lambda b1, x, b2, y: F.concat_ws(":", F.col("component"), b1, x, b2, y)
    span = lambda s: F.when(F.coalesce(s, F.lit(0)) > 0, F.sequence(F.lit(0), s - 1)).otherwise(F.array().cast("array<int>"))
    b = F.col("band")
    split = split.withColumn("i", i).select("v", "rep", F.explode(F.concat(
        F.transform(span(F.col("s1")), lambda j: name(b, F.least(F.col("i"), j), b, F.greatest(F.col("i"), j))),
        F.transform(span(F.col("s0")), lambda j: name(b, F.col("i"), b + 1, j)),
        F.transform(span(F.col("s2")), lambda j: name(b - 1, j, b, F.col("i"))))).alias("g"))
    whole = sized.join(big, "component", "left_anti").select("v", "rep", F.col("component").cast("string").alias("g"))
    groups = cut(whole.unionByName(split))

    def with_sets(batches):
        for batch in batches:
            v, b = [], []
            for x, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), k), strict=True):
                if len(s) and (own := set_id(s)) == (own if x is None else x):
                    v.append(own)
                    b.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(b, pa.binary())], ["v", "s"])

    sets = again(base, groups.select("v", "rep").distinct(), with_sets, "v bigint, s binary")
    links = groups.select("g", "v").join(sets, "v").groupBy("g").applyInArrow(_verified(sim), "a bigint, b bigint")
    linked = components(links)
    named = reps.join(linked.withColumnRenamed("node", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("c"), "rep")
    names = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    known = named.join(names, "c").select("v", "component_id")
    # a set that very many documents share is looked up where they are: there are at most 4 * parts such sets
    often = reps.where(F.col("copies") * F.lit(4 * parts) > per_doc.count()).select("v")
    hot = F.broadcast(cut(known.join(often, "v")))
    out = per_doc.join(hot, "v").unionByName(per_doc.join(hot, "v", "left_anti").join(known, "v", "left"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
