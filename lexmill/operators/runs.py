"""Event-log distillation: presence strips, gaps and islands, recoveries, two-sample tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.numeric import rank_test_p


def longest_run(rows: DataFrame, cell: str, turn: str, flag: str) -> DataFrame:
    """(cell, longest): the most consecutive rows with flag; gaps and islands over one window."""
    w = Window.partitionBy(cell).orderBy(turn)
    r = rows.withColumn("island", F.row_number().over(w) - F.sum(F.col(flag).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = r.groupBy(cell, "island").agg(F.sum(F.col(flag).cast("int")).alias("n"))
    return runs.groupBy(cell).agg(F.max("n").alias("longest"))


def presence_strip(rows: DataFrame, cell: str, turn: str, flag: str, width: int = 60) -> DataFrame:
    """(cell, strip): '1' where flag, '0' where not, a blank for a missing turn; width turns from 1."""
    m = rows.groupBy(cell).agg(F.map_from_entries(F.collect_list(F.struct(turn, F.when(F.col(flag), "1").otherwise("0")))).alias("m"))
    return m.select(cell, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda t: F.coalesce(F.element_at("m", t.cast("long")), F.lit(" "))), "").alias("strip"))


def after_first_event(rows: DataFrame, cell: str, turn: str, event: str, flag: str) -> DataFrame:
    """(cell, first_event, n_after, fraction): share of flag on turns after the first event; null where there is none."""
    first = F.min(F.when(F.col(event), F.col(turn))).over(Window.partitionBy(cell))
    r = rows.withColumn("first_event", first)
    late = F.col(turn) > F.col("first_event")
    return r.groupBy(cell).agg(
        F.max("first_event").alias("first_event"), F.sum(F.when(late, 1).otherwise(0)).alias("n_after"), F.avg(F.when(late, F.col(flag).cast("int"))).alias("fraction")
    )


def next_turn_recovery(rows: DataFrame, cell: str, turn: str, present: str) -> DataFrame:
    """(cell, empties, recovered): empty turns, and those whose next turn is present; the last turn never recovers."""
    nxt = F.lead(present).over(Window.partitionBy(cell).orderBy(turn))
    r = rows.withColumn("nxt", nxt)
    gap = ~F.col(present)
    return r.groupBy(cell).agg(F.sum(gap.cast("int")).alias("empties"), F.sum((gap & F.coalesce("nxt", F.lit(False))).cast("int")).alias("recovered"))


RANK_BUCKETS = 200


def rank_test(values: DataFrame, value: str, first: str) -> DataFrame:
    """(m, n, u, p): Mann-Whitney of value where first is true against the rest, mid-ranks for ties.

    Ranks are prefix sums at two levels: approximate quantiles cut the values into RANK_BUCKETS ranges, whose totals
    are a table of that many rows; within a range a window runs over its distinct values. No task sees all values.
    """
    v = values.where(F.col(value).isNotNull() & F.col(first).isNotNull())
    marks = [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)]
    cuts = v.agg(F.percentile_approx(F.col(value).cast("double"), marks, 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    g = v.groupBy(value).agg(F.sum(F.col(first).cast("long")).alias("x"), F.count("*").alias("t"))
    g = g.withColumn("bucket", F.size(F.filter(bounds, lambda c: c < F.col(value))))
    totals = g.groupBy("bucket").agg(F.sum("t").alias("bt"))
    totals = totals.select("bucket", F.coalesce(F.sum("bt").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = Window.partitionBy("bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("before", F.coalesce(F.sum("t").over(within), F.lit(0))).join(F.broadcast(totals), "bucket")  # totals: RANK_BUCKETS rows
    g = g.withColumn("mid", F.col("offset") + F.col("before") + (F.col("t") + 1) / 2.0)
    s = g.agg(F.sum("x").alias("m"), F.sum(F.col("t") - F.col("x")).alias("n"), F.sum(F.col("x") * F.col("mid")).alias("r"))
    s = s.withColumn("u", F.col("r") - F.col("m") * (F.col("m") + 1) / 2.0)
    return s.select("m", "n", "u", rank_test_p(F.col("u"), F.col("m"), F.col("n")).alias("p"))


def median_pick(cells: DataFrame, group: str, order: list) -> DataFrame:
    """The upper-median cell of each group in an order with ties broken."""
    w = Window.partitionBy(group)
    r = cells.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("size", F.count("*").over(w))
    return r.where(F.col("rank") == F.floor(F.col("size") / 2) + 1).drop("rank", "size")
