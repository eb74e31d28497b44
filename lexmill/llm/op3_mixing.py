"""Mixing sources to target weights along a curriculum.

A source's target share of all words follows from its weight, capped at MAX_REPEATS times its size. Its schedule says
how its demand is spread over the training run: piecewise-linear in time, it is integrated into cumulative demand.
Documents of a source are laid end to end in a fixed pseudo-random order, epoch after epoch; the word offset at which
a copy stands is inverted through the cumulative demand into a training position in [0, 1), and documents are
range-sorted by position. A copy is taken if its middle lies within the target, so a source's taken words differ from
its target by at most half of one document, and no document is taken more than MAX_REPEATS times.

Offsets are prefix sums at two levels: sums of (source, bucket), where buckets are ranges of the order's hash, as many as
the rows ask for, then rows within a bucket. A source with a third of all rows is spread over all its buckets. The order's
hash is of id and text, so rows without an id, or with one id, are spread as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import SPACE_CLASS, saved, shuffle_partitions, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Schedules by weight class: (time, relative demand) knots from 0 to 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
#: A bucket is the first hex digits of the order's hash, at least so many; more where it would hold over BUCKET_ROWS rows.
BUCKET_DIGITS = 3
BUCKET_ROWS = 4_096


def word_count(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(bare, SPACE_CLASS + "+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes(source, source_size) -> with rank (from 0, sources by code point, null last), weight and target.

    Sources over their cap are fixed at it and what is left is shared by weight among the others, until none is over.
    The totals of a round are one row. A table of sources, one row each, is ranked in one task.
    """
    s = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = saved(s.withColumn("weight", weight.cast("long")).withColumn("cap", max_repeats * F.col("source_size")), "sources")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("cap") < F.col("weight") * F.lit(level)
        n, cap, weight_sum = s.agg(F.sum(over.cast("long")), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight")))).first()
        if not weight_sum or n == capped:
            break
        capped, level = n, float(total - (cap or 0)) / float(weight_sum)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)) if level is not None else F.lit(0.0)
    return s.withColumn("target", target).drop("cap")


def position(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which a schedule's integral reaches share (0 to 1) of its whole."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    whole, before, out = sum(area), 0.0, None
    for (t0, w0), (t1, w1), part in zip(knots, knots[1:], area):
        need, slope = share * whole - before, (w1 - w0) / (t1 - t0)
        step = need / w0 if slope == 0 else 2 * need / (w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)))
        here = F.least(F.lit(t1), t0 + step)
        before += part
        out = F.when(share <= before / whole, here) if out is None else out.when(share <= before / whole, here)
    return out.otherwise(F.lit(knots[-1][0]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """docs with size, source_size, target, copies, taken, positions (array of double, one for each copy) and order_key.

    Columns of these names in docs are replaced. A null text has size 0; a null source is a source of its own, last in
    order; null ids and repeated ids are rows like any other. Documents without words are in the mix with no words. An
    empty table gives an empty table.
    """
    docs = docs.drop("size", "source_size", "target", "copies", "taken", "positions", "order_key")
    text, ident, source = F.col(f"`{text_col}`"), F.col(f"`{id_col}`"), F.col(f"`{source_col}`")
    digits = max(BUCKET_DIGITS, math.ceil(math.log(max(docs.count(), 1) / BUCKET_ROWS, 16)))
    own = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    d = docs.withColumns({"size": word_count(text), "__source": F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), "order_key": own})  # never null
    d = d.withColumn("__bucket", F.substring("order_key", 1, digits))
    buckets = saved(d.groupBy("__source", "__bucket").agg(F.sum("size").alias("b_size")), "mix-buckets")
    named = F.when(F.col("__source") != "n", F.expr("substring(__source, 2)"))
    targets = source_targets(buckets.groupBy("__source").agg(F.sum("b_size").alias("source_size")).select(named.alias("source"), "source_size"), weights, max_repeats)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("__source"), "source_size", "target", F.col("rank").alias("__rank"))
    running = Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = buckets.withColumn("__b_start", F.coalesce(F.sum("b_size").over(running), F.lit(0))).drop("b_size")
    starts = saved(b.join(targets, "__source"), "mix-starts")
    rows = Window.partitionBy("__source", "__bucket").orderBy("order_key", ident, "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__start", F.coalesce(F.sum("size").over(rows), F.lit(0)))
    d = d.join(starts, ["__source", "__bucket"], "left")  # rows stand by these keys already
    start = F.col("__b_start") + F.col("__start")
    left = (F.col("target") - start - F.col("size") / 2) / F.greatest("source_size", F.lit(1))
    d = d.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.lit(max_repeats), F.greatest(F.lit(0), F.ceil(left)))).cast("long"))
    d = d.withColumn("taken", F.col("copies") * F.col("size"))
    share = lambda k: F.least(F.lit(1.0), (k * F.col("source_size") + start + F.col("size") / 2) / F.greatest("target", F.lit(1.0)))

    def placed(k: Column) -> Column:
        out = None
        for i, knots in enumerate(schedules):
            mine = F.col("__rank") % len(schedules) == i
            out = F.when(mine, position(share(k), knots)) if out is None else out.when(mine, position(share(k), knots))
        return out

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1), placed)).otherwise(F.array().cast("array<double>"))
    columns = [f"`{c}`" for c in docs.columns]
    return d.withColumn("positions", positions).select(*columns, "size", "source_size", "target", "copies", "taken", "positions", "order_key")


def training_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each taken copy, in training order: columns and __position, in billionths of the run.

    Copies are range-partitioned and sorted by position, then by the order's hash, then by copy, so many copies at one
    position are split over tasks like any others, and reruns agree.
    """
    parts = shuffle_partitions(mixed.sparkSession)
    out = mixed.select(*[F.col(f"`{c}`") for c in columns], F.col("order_key").alias("__order"), F.posexplode("positions").alias("__copy", "__at"))
    out = out.withColumn("__position", F.floor(F.col("__at") * 1e9)).drop("__at")
    by = ("__position", "__order", "__copy")
    return out.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__order", "__copy")


def with_ranks(mixed: DataFrame) -> DataFrame:
    """mixed with ranks: the places from 0 that a document's copies take in the training order, ascending.

    The places follow from the range-sorted rows: those in the partitions before, and those before in the partition. A
    document that is not taken has none.
    """
    rows = saved(mixed.withColumn("__row", F.monotonically_increasing_id()), "mix-rows")
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = saved(training_order(rows, ["__row"]).select("__row", F.spark_partition_id().alias("__part"), nth.alias("__nth")), "mix-order")
    counts = placed.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row a partition
    before, starts = 0, []
    for r in counts:
        starts.append((r["__part"], before))
        before += r["n"]
    starts = F.broadcast(mixed.sparkSession.createDataFrame(starts, "__part int, __before long"))
    ranks = placed.join(starts, "__part").groupBy("__row").agg(F.array_sort(F.collect_list(F.col("__before") + F.col("__nth"))).alias("ranks"))
    return rows.join(ranks, "__row", "left").withColumn("ranks", F.coalesce("ranks", F.array().cast("array<long>"))).drop("__row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    out = with_ranks(out.select("doc_id", "size", "source_size", "target", "taken", "positions", "order_key"))
    first = (F.floor(F.array_min("positions") * 1e9) / 1e9).alias("first_position")
    return out.select("doc_id", "size", "source_size", "target", "taken", first, F.coalesce(F.array_min("ranks"), F.lit(-1)).alias("first_rank"))  # null and -1: not taken


QUERIES = {"op3_mixing": query}
SQL = {
    "op3_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
    (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS class,
    [5, 2, 1][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight
  FROM d GROUP BY source
), share AS (
  SELECT 0 AS round, (SELECT sum(source_size) FROM s)::DOUBLE / (SELECT sum(weight) FROM s)::DOUBLE AS level
  UNION ALL
  SELECT round + 1, ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(cap), 0) FROM s WHERE cap < weight * level))::DOUBLE
    / (SELECT sum(weight) FROM s WHERE cap >= weight * level)::DOUBLE
  FROM share WHERE round < 60
), t AS (
  SELECT *, least(cap::DOUBLE, weight * (SELECT level FROM share ORDER BY round DESC LIMIT 1)) AS target FROM s
), p AS (
  SELECT *, row_number() OVER () AS r, sum(size) OVER (PARTITION BY source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start FROM d
), m AS (
  SELECT p.*, source_size, target, class,
    CASE WHEN size = 0 THEN 1 ELSE least(3, greatest(0, ceil((target - start - size / 2) / greatest(source_size, 1)))) END::BIGINT AS copies
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT r, o, k, least(1.0::DOUBLE, (k * source_size + start + size / 2)::DOUBLE / greatest(target, 1.0::DOUBLE)) AS share, class
  FROM m, unnest(range(copies)) AS u(k)
), a AS (
  SELECT r, o, k, floor(1e9::DOUBLE * CASE
    WHEN class = 0 THEN least(1.0::DOUBLE, 2 * share / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2 * share))))
    WHEN class = 1 THEN least(1.0::DOUBLE, share)
    WHEN share <= 0.3125::DOUBLE THEN least(0.5::DOUBLE, 2 * share / (0.5::DOUBLE + sqrt(0.25::DOUBLE + share)))
    ELSE least(1.0::DOUBLE, 0.5::DOUBLE + 2 * (share - 0.3125::DOUBLE) / (0.75::DOUBLE + sqrt(0.5625::DOUBLE + 5 * (share - 0.3125::DOUBLE)))) END) AS e9
  FROM c
), f AS (
  SELECT r, min(e9) AS e9, min(place) AS place FROM (SELECT r, e9, row_number() OVER (ORDER BY e9, o, k) - 1 AS place FROM a) GROUP BY r
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, f.e9 / 1e9::DOUBLE AS first_position, coalesce(f.place, -1)::BIGINT AS first_rank
FROM m LEFT JOIN f USING (r)
"""
}
