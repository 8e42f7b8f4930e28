"""Connected components of an edge table by repeated contraction.

Each round points every node at its smallest neighbour, shortens the pointers
by two jumps and replaces the edges by edges between the pointers' ends; edge
and node counts fall geometrically.  State is a Parquet table in the shared
folder, so no round repeats an earlier one and a lost executor costs a task.
Edge tables of up to ``HELD_EDGES`` counted rows are contracted in the same way
in arrays on the driver, which saves the jobs and files of all rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.storage import Scratch

#: Distinct edges that the driver holds as arrays; up to 115 bytes an edge while they are contracted.
HELD_EDGES = 500_000


def smallest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges (u, v), sorted, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    top, a, b = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(a):
        up = np.arange(len(nodes))
        np.minimum.at(up, a, b)
        np.minimum.at(up, b, a)
        while not np.array_equal(up, further := up[up]):
            up = further
        top, a, b = up[top], up[a], up[b]
        a, b = a[a != b], b[a != b]
    return nodes, nodes[top]


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", scratch: Scratch | None = None, held: int = HELD_EDGES) -> DataFrame:
    """(node, component) for each node with an edge; component is the smallest node of its component.

    Null ends and loops are dropped; an empty edge table gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    e = scratch.save(
        edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u is not null and v is not null and u < v").distinct(), "edges"
    )
    if dict(e.dtypes) == {"u": "bigint", "v": "bigint"} and 0 < e.count() <= held:
        import pyarrow as pa

        got = e.toArrow()
        nodes, tops = smallest_reachable(got["u"].to_numpy(), got["v"].to_numpy())
        mapping = scratch.save(e.sparkSession.createDataFrame(pa.table({"node": nodes, "component": tops})), "mapping")
        scratch.drop(e)
        return mapping
    mapping = None
    while not e.isEmpty():
        both = e.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("to")))
        near = scratch.save(both.groupBy("node").agg(F.least("node", F.min("to")).alias("up")), "near")
        up = near
        for _ in range(2):
            up = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left").select("node", F.coalesce("top", "up").alias("up"))
        up = scratch.save(up, "up")
        ends = e.join(up.select(F.col("node").alias("u"), F.col("up").alias("a")), "u").join(up.select(F.col("node").alias("v"), F.col("up").alias("b")), "v")
        after = scratch.save(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        if mapping is None:
            moved = up.select("node", F.col("up").alias("component"))
        else:
            moved = mapping.join(up.select(F.col("node").alias("component"), "up"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        moved = scratch.save(moved, "mapping")
        scratch.drop(e, near, up, *([mapping] if mapping is not None else []))
        e, mapping = after, moved
    if mapping is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return mapping
