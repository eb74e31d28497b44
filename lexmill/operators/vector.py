"""Vector provider: cosine against stored vectors, with a floor relative to the best."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FLOOR = 0.34
#: Rows of a block of vectors, about.
BLOCK = 2048
_SLICE = 256


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similar(vectors: DataFrame, queries: DataFrame, floor: float = FLOOR) -> DataFrame:
    """vectors(id, v) and queries(q, qv, few and counted by the caller) -> (q, id, score): positive and near the best."""
    scored = vectors.crossJoin(queries).withColumn("score", cosine(F.col("v"), F.col("qv"))).where(F.col("score") > 0)
    best = scored.groupBy("q").agg(F.max("score").alias("best"))
    return scored.join(F.broadcast(best), "q").where(F.col("score") >= floor * F.col("best")).select("q", "id", "score")


def above_floor(scored: DataFrame, floor: float = FLOOR) -> DataFrame:
    """scored(q, id, score) kept where positive and at least floor of its query's best."""
    best = F.max("score").over(Window.partitionBy("q"))
    return scored.where(F.col("score") > 0).withColumn("best", best).where(F.col("score") >= floor * F.col("best")).drop("best")


def _directions(values: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose cosine is defined, their unit vectors), of arrays of one length."""
    x = pa.concat_arrays([c.flatten() for c in values.chunks]).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    length = np.sqrt((x * x).sum(axis=1))
    at = np.flatnonzero(np.isfinite(length) & (length > 0))
    return at, x[at] / length[at, None]


def similar_in_blocks(vectors: DataFrame, queries: DataFrame, floor: float = FLOOR, block: int = BLOCK) -> DataFrame:
    """vectors(id long, v) and queries(q long, v), arrays of numbers, both sides of any size -> (q, id, score) as similar().

    Both sides are dealt evenly into blocks; each pair of blocks is a group that is scored by itself, in doubles: first
    for the best of each query, then for what reaches the floor. Null and empty vectors, and those with a null, NaN,
    infinite or zero length, are near nothing; vectors of different lengths are not compared. Rows that repeat an id
    are rows of their own, but queries that repeat one share their best.
    """
    whole = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull())
    vectors, queries = vectors.where(whole).select("id", F.col("v").alias("x")), queries.where(whole).select("q", F.col("v").alias("y"))
    n_v, n_q = (max(1, -(-x.count() // block)) for x in (vectors, queries))

    def pairs(rows: DataFrame, values: str, own: str, n_own: int, other: str, n_other: int):
        # both sides' keys need the same types, as cogroup deals each side by the hash of its own
        d = rows.withColumn("dim", F.size(values)).withColumn(own, F.pmod(F.monotonically_increasing_id(), F.lit(n_own)).cast("int"))
        return d.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).groupBy("dim", "i", "j")

    def score(x: pa.Table, y: pa.Table, every: bool) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("score", pa.float64())] if every else [("q", pa.int64()), ("best", pa.float64())])
        if not x.num_rows or not y.num_rows:
            return schema.empty_table()
        (at, u), (to, w) = _directions(x["x"]), _directions(y["y"])
        ids, qs, out = x["id"].combine_chunks().take(pa.array(at)), y["q"].combine_chunks().take(pa.array(to)), []
        least = floor * y["best"].to_numpy()[to] if every else None
        for k in range(0, len(to), _SLICE) if len(at) else ():
            s, own = w[k : k + _SLICE] @ u.T, qs.slice(k, _SLICE)
            if every:
                a, b = np.nonzero((s > 0) & (s >= least[k : k + _SLICE, None]))
                columns = [own.take(pa.array(a)), ids.take(pa.array(b)), pa.array(s[a, b])]
            else:
                columns = [own, pa.array(s.max(axis=1))]
            out.append(pa.Table.from_arrays(columns, schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    left = pairs(vectors, "x", "i", n_v, "j", n_q)
    best = left.cogroup(pairs(queries, "y", "j", n_q, "i", n_v)).applyInArrow(lambda x, y: score(x, y, False), "q long, best double").groupBy("q").agg(F.max("best").alias("best"))
    told = queries.join(best.where("best > 0"), "q")
    return left.cogroup(pairs(told, "y", "j", n_q, "i", n_v)).applyInArrow(lambda x, y: score(x, y, True), "q long, id long, score double")
