"""Embedding near-duplicates: Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised to unit length and projected on Gaussian directions; each table's key is k projections,
shifted and quantised in steps of WIDTH. Two unit vectors of cosine 0.9 are sqrt(0.2) apart, which fixes the chance p1
that a quantised projection agrees; unrelated unit vectors are about sqrt(2) apart, with chance p2. k grows with the
logarithm of the row count so that a bucket is expected to hold LOAD unrelated vectors, and the number of tables makes
1 - (1 - p1**k)**tables reach RECALL for a pair right at the threshold (closer pairs are found more often).

Equal vectors are collapsed to a class before hashing and each class counts with its size. Buckets are compared in
blocks (bucket_pairs); a pair that meets in several tables counts in the first one only, so links are counted
exactly once without emitting pairs; blocks emit link counts and a spanning forest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bucket_pairs import compare_units, forest
from lexmill.llm.common import join_grouped, own_columns, saved, table
from lexmill.llm.components import connected_components

THRESHOLD = 0.9
WIDTH = 2.0
LOAD = 64
RECALL = 0.97
BLOCK = 512
SEED = 20


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection agrees for two points at this distance."""
    r = width / distance
    phi = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * phi - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float = THRESHOLD, load: int = LOAD, recall: float = RECALL) -> tuple[int, int]:
    """(projections a table, tables) for so many vectors."""
    p1, p2 = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(rows, 1) / load) / math.log(1 / p2))) if rows > load else 2
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p1**k)))


def table_keys(unit: np.ndarray, k: int, tables: int, seed: int = SEED) -> np.ndarray:
    """(rows, tables) int32 keys of unit vectors (rows, dim); a chance clash only adds pairs to look at."""
    dim = unit.shape[1]
    rng = np.random.default_rng([seed, dim])
    directions, shift = rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables)
    cell = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    key = np.full(cell.shape[:2], dim, np.int64) + np.arange(tables) * np.int64(1_000_003)
    with np.errstate(over="ignore"):
        for i in range(k):
            key = (key ^ (cell[:, :, i] + 512)) * np.int64(-7046029254386353131)
            key ^= (key >> 29) & np.int64((1 << 35) - 1)
    return (key >> 32).astype(np.int32)


def _hashed(reps: DataFrame, k: int, tables: int) -> DataFrame:
    """reps(id, size, v array of float or double) -> a row for each table: key, id, size, v (bytes), codes (the tables' keys up to t), t."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("v", pa.binary()), ("codes", pa.binary()), ("t", pa.int32())])

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 2048):
                b = big.slice(at, 2048)
                ids, sizes, vs = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
                offsets = vs.offsets.to_numpy()
                flat, dims = vs.values.to_numpy(zero_copy_only=False), np.diff(offsets)
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    x = flat[offsets[own][:, None] + np.arange(dim)]
                    y = x.astype(np.float64)
                    y /= np.abs(y).max(axis=1, keepdims=True)
                    keys = table_keys(y / np.linalg.norm(y, axis=1, keepdims=True), k, tables)
                    raw = [r.tobytes() for r in x]
                    for t in range(tables):
                        codes = [r.tobytes() for r in keys[:, :t]]
                        yield pa.RecordBatch.from_arrays([pa.array((keys[:, t].astype(np.int64) << 16) + t), pa.array(ids[own]), pa.array(sizes[own]), pa.array(raw, pa.binary()), pa.array(codes, pa.binary()), pa.array(np.full(len(own), t, np.int32))], schema=schema)

    return reps.select("id", "size", "v").mapInArrow(run, "key long, id long, size long, v binary, codes binary, t int")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of vectors.

    Rows whose vector is null, empty, zero or holds a null or non-finite component have no links and stay on their
    own. Vectors of different lengths never link. Rows of one id are rows of their own, and so are rows with a null id:
    they are linked and counted like others, a component goes by its smallest id that is not null, and a row with a null
    id is kept only if its component has no other id. An empty table gives an empty table.
    """
    v = own_columns(vectors, id_col, vector_col).toDF("id", "raw")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = v.withColumn("v", F.col("raw") if single else F.col("raw").cast("array<double>"))
    fine = F.coalesce(
        (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    v = v.select("id", F.when(fine, F.col("v")).alias("v"))
    v = v.withColumn("h", F.when(F.col("v").isNotNull(), F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))))
    classes = v.where("v is not null").groupBy("h", "v").agg(F.min("id").alias("low"), F.count("*").alias("size"))
    classes = saved(classes.withColumn("id", F.monotonically_increasing_id()), "vector-classes")  # a class goes by a number of its own
    k, tables = plan(classes.count(), threshold)
    kind = np.float32 if single else np.float64

    out_schema = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def compare(c: dict, same: bool):
        raw = c["v"].to_pylist()
        lengths = np.array([len(x) for x in raw])
        found = [own(c, np.flatnonzero(lengths == n), raw, same) for n in np.unique(lengths)]  # several only by a chance clash of keys
        found = [f for f in found if f is not None]
        return {name: np.concatenate([f[name] for f in found]) for name in ("id", "root", "links")} if found else None

    def own(c: dict, at: np.ndarray, raw: list[bytes], same: bool):
        ids, size, t = c["id"].to_numpy()[at], c["size"].to_numpy()[at], c["t"][0].as_py()
        x = np.frombuffer(b"".join([raw[i] for i in at]), kind).reshape(len(at), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        codes = np.frombuffer(b"".join([c["codes"][int(i)].as_py() for i in at]), np.int32).reshape(len(at), t)
        if same:
            a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
        else:
            m = int(np.count_nonzero(c["first"].to_numpy(zero_copy_only=False)[at]))
            a, b = np.nonzero(x[:m] @ x[m:].T >= threshold)
            b = b + m
        if not len(a):
            return None
        n = len(ids)
        links = np.zeros(n, np.int64)
        for i in range(0, len(a), 1 << 16):
            p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            new = ~(codes[p] == codes[q]).any(axis=1) if t else np.ones(len(p), bool)
            np.add.at(links, p[new], size[q[new]])
            np.add.at(links, q[new], size[p[new]])
        u, root = forest(n, a, b)
        tied = np.arange(n)
        tied[u] = root
        told = np.flatnonzero((links > 0) | (tied != np.arange(n)))
        return {"id": ids[told], "root": ids[tied[told]], "links": links[told]}

    found = saved(compare_units(_hashed(classes, k, tables), BLOCK, compare, "id long, root long, links long", out_schema), "vector-links")
    member = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    told = classes.join(counts, "id", "left").join(member, "id", "left").withColumn("group", F.coalesce("component_id", "id"))
    told = saved(told.select("h", F.col("v").alias("cv"), "group", "low", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links")), "vector-classes-told")
    lows = told.groupBy("group").agg(F.min("low").alias("component"))
    told = saved(join_grouped(told.drop("low"), lows, "group").drop("group"), "vector-components")  # a table, so that the join on a hot vector can be split
    out = v.join(told, (v.h == told.h) & (v.v == told.cv), "left")
    component = F.coalesce(F.col("component"), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_embedding_near_dedup": query}
SQL = {
    "op1_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept
FROM embeddings e
LEFT JOIN (SELECT u, count(*) AS n_links FROM links GROUP BY u) n ON n.u = e.vec_id
LEFT JOIN (SELECT u, min(v) AS low FROM reach GROUP BY u) c ON c.u = e.vec_id
"""
}
