"""Comparing the rows of each hash bucket with one another, in blocks, without emitting the pairs.

Rows (key, id, ...) are grouped by key. A bucket of more than block rows is cut into blocks by a hash of the id, and
each pair of blocks becomes a unit of work of at most two blocks, so that no task holds a whole hot bucket. A unit is
handed to a function of numpy arrays that returns what it found in rows linear in the unit's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import checked_broadcast, saved, shuffle_partitions


def units(rows: DataFrame, block: int) -> DataFrame:
    """rows(key, id, ...) with unit (long) and first (boolean: of the unit's first block; within one block all are).

    lo == hi marks a block against itself.
    """
    hot = saved(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "hot-buckets")
    n_blocks = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / block).cast("long")
    dealt = rows.join(checked_broadcast(hot), "key", "left").withColumn("nb", n_blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return dealt.withColumn("lo", lo).withColumn("hi", hi).withColumn("first", F.col("own") == F.col("lo")).drop("n", "nb", "own", "other")


def compare_units(rows: DataFrame, block: int, compare: Callable[[dict, bool], dict | None], schema: str, out_schema: pa.Schema) -> DataFrame:
    """Apply compare to every unit of rows.

    compare(columns, same): columns maps names to arrow arrays of the unit's rows, first block first; same says that
    the unit is one block against itself, else columns["first"] tells the two apart. Returns arrays by name, or None.
    """
    return compare_dealt(units(rows, block), compare, schema, out_schema)


def compare_dealt(dealt: DataFrame, compare: Callable[[dict, bool], dict | None], schema: str, out_schema: pa.Schema) -> DataFrame:
    """Apply compare to rows that are already dealt to units, as units() does."""
    spark = dealt.sparkSession
    dealt = dealt.repartition(shuffle_partitions(spark), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", F.desc("first"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def groups(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table | None]:
            k, lo, hi = (t.column(c).to_numpy() for c in ("key", "lo", "hi"))
            cut = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            at = [0, *cut.tolist(), len(k)]
            done = [t.slice(a, b - a) for a, b in zip(at[:-1], at[1:]) if b - a > 1 or (b == len(k) and not last)]
            if last:
                return done, None
            return done[:-1], done[-1]

        def emit(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            for t in parts:
                if t.num_rows < 2:
                    continue
                t = t.combine_chunks()
                same = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
                found = compare({c: t.column(c).chunk(0) for c in t.column_names}, same)
                if found is not None and len(next(iter(found.values()))):
                    yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in out_schema], schema=out_schema)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            done, rest = groups(t, False)
            yield from emit(done)
        if rest is not None:
            yield from emit(groups(rest, True)[0])

    return dealt.mapInArrow(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph on 0..n-1 with edges a-b: each vertex with its component's first vertex."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    v = np.flatnonzero(label != np.arange(n))
    return v, label[v]
