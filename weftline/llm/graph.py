"""Connected components of a large edge list by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import dealt_join, steady


#: edges to a task: a round has several shuffles, which should not have more tasks than the edges ask for; so many at most are one task's work
PART = 250_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges (u, v), and for each the smallest node reachable."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, up := root[root]):
            root = up
    return nodes, nodes[root]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of the task."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, roots = smallest_reachable(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["node", "root"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``edges`` (u, v), the root being the smallest id reachable.

    Each round hangs every neighbour above a node on the smallest neighbour, then every neighbour below;
    the number of edges never grows and the depth shrinks by about half.  Rounds go on until nothing changes, about
    the logarithm of the longest path.  No group is collected: the minima are map-side aggregates joined back, the edges
    of a hub being dealt over tasks.  At most PART edges are gone through in one task instead, with the same result: the
    rounds' many plans would take more of the driver than of the executors.  Nulls, self links and repeated links are ignored; an
    empty input gives an empty result.
    """
    now = steady(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before, state = None, _state(now)
    if state[0] <= PART:
        return steady(now.coalesce(1).mapInArrow(_roots, "node long, root long"))
    parts = max(1, -(-state[0] // PART))  # the edges never grow in number
    while state != before:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        least = steady(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")).coalesce(parts))
        hung = dealt_join(both.where("v > u"), least.select("u", "m"), ["u"], "v", hubs=least).coalesce(parts)
        large = hung.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts)
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "u").coalesce(parts)
        now = steady(
            small.select("u", F.col("m").alias("v"))
            .unionAll(small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .coalesce(parts)
            .distinct()
            .coalesce(parts)
        )
        before, state = state, _state(now)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionAll(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, root) of ``components`` after further ``links`` (u, v): only the roots that they tie together are gone through again."""
    at = {c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "uv"}
    tied = links.join(at["u"], "u", "left").join(at["v"], "v", "left")
    over = steady(components(tied.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))))
    moved = over.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = dealt_join(roots, moved, ["root"], "node", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = over.join(roots, "node", "left_anti").select("node", "root")
    return old.unionAll(fresh)
