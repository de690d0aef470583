"""Recursion and graph traversal: families, descendants, reachability, tree paths, most probable paths."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut


def closure(start: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """``node`` of everything reachable from ``start`` (node) along ``edges`` (a, b), start included.

    Breadth first with set semantics, so cycles end; each level joins only the nodes that are new."""
    seen = front = cut(start.select("node").distinct())
    for _ in range(most):
        front = cut(front.join(edges, front.node == edges.a).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    raise RuntimeError("the graph is deeper than allowed")


def parent_links(runs: DataFrame) -> DataFrame:
    """``node, up``: threads and their parents, where those are known."""
    links = runs.where("parent_run_id IS NOT NULL").select(F.col("id").alias("node"), F.col("parent_run_id").alias("up")).distinct()
    return cut(links.join(runs.select(F.col("id").alias("up")), "up", "left_semi").select("node", "up"))


def tops(links: DataFrame) -> DataFrame | None:
    """``node, root`` of all threads below a root, or None where a thread has several parents.

    Every thread points to its parent, then to what that points to, and so on: each round doubles the height, so that
    rounds grow with the logarithm of the depth.  A round that ends at no further root leaves cycles only; what hangs on
    them has no root."""
    if not links.groupBy("node").count().where("count > 1").isEmpty():
        return None
    inner = links.select(F.col("node").alias("up"), F.lit(False).alias("top"))
    at = cut(links.join(inner, "up", "left").select("node", "up", F.coalesce("top", F.lit(True)).alias("top")))
    left = at.where("NOT top").count()
    while left:
        far = at.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("top").alias("ends"))
        at = cut(at.where("top").unionByName(at.where("NOT top").select("node", "up").join(far, "up").select("node", F.col("far").alias("up"), F.col("ends").alias("top"))))
        before, left = left, at.where("NOT top").count()
        if left == before:
            break
    return at.where("top").select("node", F.col("up").alias("root"))


def family_threads(runs: DataFrame, sessions: DataFrame, reference: str, links: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """``id`` of the threads of a family: from any thread or session named (id or prefix, or a session's native id),
    up the parent links to the root, across sessions, then down every link.  ``links`` and ``roots`` are those of
    ``parent_links`` and ``tops`` where several families of the same threads are asked for."""
    from ..plans.compiler import prefix

    named = runs.select("id", "session_id").join(sessions.select(F.col("id").alias("session_id"), "native_id"), "session_id")
    start = named.where(prefix(F.col("id"), reference) | prefix(F.col("session_id"), reference) | F.coalesce(F.col("native_id") == reference, F.lit(False))).select(F.col("id").alias("node"))
    if links is None:
        links = parent_links(runs)
        roots = tops(links)
    if roots is None:
        above = closure(start, links.select(F.col("node").alias("a"), F.col("up").alias("b")))
        highest = above.join(links.select("node"), "node", "left_anti")
        return closure(highest, links.select(F.col("up").alias("a"), F.col("node").alias("b"))).withColumnRenamed("node", "id")
    start = cut(start.distinct())
    highest = cut(start.join(links.select("node"), "node", "left_anti").select(F.col("node").alias("root")).unionByName(roots.join(start, "node", "left_semi").select("root")).distinct())
    return highest.select(F.col("root").alias("id")).unionByName(roots.join(highest, "root", "left_semi").select(F.col("node").alias("id")))


def descendants(edges: DataFrame, root: DataFrame) -> DataFrame:
    """``node, depth`` below each start, by a recursive query; a forest only (``closure`` for graphs with cycles)."""
    spark = edges.sparkSession
    return spark.sql("""WITH RECURSIVE down(node, depth) AS (
        SELECT node, 0 FROM {roots} UNION ALL
        SELECT e.b, depth + 1 FROM {arcs} e JOIN down ON e.a = down.node) SELECT node, depth FROM down""", roots=root, arcs=edges)


def reaches(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that at least one edge leads to from a source, directly or on."""
    first = edges.join(sources.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
    return closure(first, edges).join(targets, "node", "left_semi")


def happy_path(edges: DataFrame, start: str = "START", end: str = "END:completed") -> tuple[list[str], float]:
    """The most probable path of a state graph (source, target, probability), and its probability.

    The graph of states is small by construction; it is read to the driver and searched by Dijkstra on -log p."""
    out: dict[str, list[tuple[str, float]]] = {}
    for r in edges.where("probability > 0").select("source", "target", "probability").toLocalIterator():
        out.setdefault(r.source, []).append((r.target, -math.log(r.probability)))
    heap, done = [(0.0, start, [start])], set()
    while heap:
        cost, node, path = heapq.heappop(heap)
        if node == end:
            return path, math.exp(-cost)
        if node not in done:
            done.add(node)
            for target, c in sorted(out.get(node, ())):
                if target not in done:
                    heapq.heappush(heap, (cost + c, target, [*path, target]))
    return [], 0.0


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of each group's tree: rows ``group, id, parent, ord`` to ``group, leaf, last, path``.

    A node whose parent is unknown is a root.  ``last``: the path ends in the group's last node.  A node takes part in
    every path through it, so the rows of one group are walked together."""
    import pandas as pd

    def walk(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("ord")
        up, parents = dict(zip(df["id"], df["parent"], strict=True)), set()
        for child, parent in up.items():
            if parent in up and parent != child:
                parents.add(parent)
        rows, final = [], df["id"].iloc[-1]
        for leaf in df["id"]:
            if leaf in parents:
                continue
            path, seen, at = [], set(), leaf
            while at in up and at not in seen:
                seen.add(at)
                path.append(at)
                at = up[at]
            rows.append((df["group"].iloc[0], leaf, leaf == final, path[::-1]))
        return pd.DataFrame(rows, columns=["group", "leaf", "last", "path"])

    return nodes.select("group", "id", "parent", "ord").groupBy("group").applyInPandas(walk, "group string, leaf string, last boolean, path array<string>")
