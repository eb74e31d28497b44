"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and an equi-join that adaptive execution can split, so
a vertex that holds a third of all edges is never gathered into one task. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import drop_saved, join_grouped, saved


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> (id long, component_id long) for each vertex that has an edge to another one.

    component_id is the smallest reachable id. Self-loops and repeated edges don't matter; no edges give no rows.
    """
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(e)
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = join_grouped(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            join_grouped(large, small_low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        after_edges = saved(small, "edges")
        drop_saved(e)
        e, after = after_edges, _state(after_edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    member = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return member.union(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
