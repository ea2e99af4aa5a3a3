"""Connected components of an edge table by alternating large-star and small-star steps.

Every round is a few shuffles with partial aggregation and is written to the shared folder; nothing
but three numbers per round reaches the driver. A node with many edges, the centre of a star, isn't one
join key: the few nodes that have more than a share of the edges are sent to the edges instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialize

EDGES_PER_FILE = 500_000
#: Edges from which on a round's shuffle files are deleted before the next.
RELEASE_EDGES = 1_000_000


def _state(e: DataFrame) -> tuple[int, int, int]:
    """Edges, a sum that tells edge tables apart, and the most edges of one node."""
    each = e.select(F.explode(F.array("u", "v")).alias("x"), F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF).alias("h"))
    row = each.groupBy("x").agg(F.count("*").alias("n"), F.sum("h").alias("h")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("h"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return row[0] // 2, row[1], row[2]


def _files(rows: int) -> int:
    """Files for a table of about so many rows: a round of a small graph shouldn't write hundreds."""
    return max(8, rows // EDGES_PER_FILE)


def _with_least(edges: DataFrame, rows: int, largest: int) -> DataFrame:
    """edges (u, v), rows of them and largest of one u at most, with m, the least v of each u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    return join_hot(edges, least, "u", "_n", rows, largest=largest)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, the least node of its component, for each node that has an edge to another.

    edges is read twice, so it should be a written table. No edges give no rows; repeated edges and
    edges from a node to itself change nothing.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    n = edges.count()
    e = materialize(e.coalesce(_files(n)), "edges", release=n >= RELEASE_EDGES)
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: each larger neighbour of u meets the least of u and its neighbours.
        to = F.least("u", "m")
        large = _with_least(both, 2 * before[0], before[2]).where((F.col("v") > F.col("u")) & (F.col("v") != to)).select(F.col("v").alias("u"), to.alias("v")).distinct()
        # Small star: u and its smaller neighbours meet the least of them.
        small = _with_least(large, 2 * before[0], before[2])
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(small.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = materialize(new.coalesce(_files(before[0])), "edges", release=before[0] >= RELEASE_EDGES)
        after = _state(new)
        discard(e)
        e = new
        if after == before:
            break
        before = after
    out = e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
    out._cellgauge_path = e._cellgauge_path
    return out
