"""Reports over a collection: series, timelines, links, citations, degrees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series_neighbours(posts: DataFrame, series: str, order: str, key: str) -> DataFrame:
    """posts with ordinal (from 1), previous and next of its series."""
    w = Window.partitionBy(series).orderBy(order, key)
    return posts.withColumns({"ordinal": F.row_number().over(w), "previous": F.lag(key).over(w), "next": F.lead(key).over(w)})


def day_groups(posts: DataFrame, date: str, order: str) -> DataFrame:
    """(day, n, items): posts by day, newest day first, later posts first within a day."""
    g = posts.groupBy(F.to_date(date).alias("day")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(order), asc=False).alias("items"))
    return g.orderBy(F.desc("day"))


def link_matrix(edges: DataFrame, source: str, target: str, keys: list[str]) -> DataFrame:
    """Counts of edges from each key (rows) to each key (columns), zeros kept."""
    return edges.groupBy(source).pivot(target, keys).count().na.fill(0)


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, out_degree, in_degree, degree) of distinct directed edges; one shuffle for both ends."""
    ends = edges.select(source, target).distinct().select(
        F.explode(F.array(F.struct(F.col(source).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(target).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")
    )
    d = ends.groupBy("x.node").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))
    return d.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def mutual_pairs(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(a, b), a < b, linked both ways: pairs are put in one order and counted, without a self-join."""
    e = edges.select(source, target).distinct().where(F.col(source) != F.col(target))
    pair = e.groupBy(F.least(source, target).alias("a"), F.greatest(source, target).alias("b")).agg(F.count("*").alias("n"))
    return pair.where("n = 2").select("a", "b")


def circular_mean(angle: Column) -> Column:
    return F.atan2(F.sum(F.sin(angle)), F.sum(F.cos(angle)))


def cited_works(cites: DataFrame, least: int = 2) -> DataFrame:
    """(work, n): works cited by at least so many documents, most cited first."""
    return cites.groupBy("work").agg(F.countDistinct("doc").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "work")


def changed_rows(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose composite key is not among the stored ones."""
    return now.join(before.select(*keys).distinct(), keys, "left_anti")
