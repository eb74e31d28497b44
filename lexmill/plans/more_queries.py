"""Registered queries of the smaller operators: histories, links, shares, footnote order, output scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index as I
from lexmill.plans.registry import query, table
from lexmill.plans.retrieval_queries import TOK


def common_prefix(low, high):
    """The longest common prefix of two strings; of a whole set, given its least and its greatest."""
    n = F.least(F.length(low), F.length(high))
    return F.aggregate(F.sequence(F.lit(0), n), F.lit(""), lambda acc, k: F.when(F.left(low, k) == F.left(high, k), F.left(low, k)).otherwise(acc))


@query("common_prefix", f"WITH {TOK}, m AS (SELECT min(term) AS a, max(term) AS b FROM vocab WHERE starts_with(term, 'thereo')) SELECT list_last(list_filter(list_transform(range(0, least(length(a), length(b)) + 1), lambda k: left(a, k)), lambda p: left(b, length(p)) = p)) AS prefix FROM m")
def common_prefix_query(spark, d):
    v = I.vocabulary(table(spark, d, "documents")).where(F.col("term").startswith("thereo")).agg(F.min("term").alias("a"), F.max("term").alias("b"))
    return v.select(common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query("history_tail", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 50")
def history_tail(spark, d):
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("rank", rank).where("rank <= 50").select("event_type", "event_id")


@query("result_links", "SELECT page_id, '/' || regexp_extract(url, '//([^/?#]+)', 1) || '/?q=love%20of%20it' AS link FROM pages")
def result_links(spark, d):
    slug = F.regexp_extract("url", "//([^/?#]+)", 1)
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("/"), slug, F.lit("/?q="), T.url_component(F.lit("love of it"))).alias("link"))


@query("url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+', 0) AS scheme, regexp_extract(url, '//([^/?#]+)', 1) AS host FROM pages")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"))


@query("group_shares", "WITH g AS (SELECT role, count(*) AS n FROM conversations GROUP BY role) SELECT role, n, round(n / max(n) OVER (), 6) AS of_max, round(n / sum(n) OVER (), 6) AS share FROM g")
def group_shares(spark, d):
    g = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    t = g.agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(t)).select("role", "n", F.round(F.col("n") / F.when(F.col("top") <= 0, 1).otherwise(F.col("top")), 6).alias("of_max"), F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("bright_quartile", "WITH r AS (SELECT l_returnflag AS k, l_extendedprice AS v, ntile(4) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS q FROM lineitem) SELECT k, round(avg(v) FILTER (q = 1), 2) AS top_mean, round(avg(CASE WHEN v > 50000 THEN 100.0 ELSE 0 END), 4) AS over_percent FROM r GROUP BY k")
def bright_quartile(spark, d):
    q = F.ntile(4).over(Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    r = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("k"), F.col("l_extendedprice").alias("v"), q.alias("q"))
    return r.groupBy("k").agg(F.round(F.avg(F.when(F.col("q") == 1, F.col("v"))), 2).alias("top_mean"), F.round(F.avg(F.when(F.col("v") > 50000, 100.0).otherwise(0.0)), 4).alias("over_percent"))


@query("array_domain", "SELECT DISTINCT array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id")
def array_domain(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles")).select("roles").distinct()


@query("note_order", "SELECT * FROM (VALUES ('b', 1), ('a', 2), ('c', 3)) t(key, number)")
def note_order(spark, d):
    """Footnotes renumbered by their first reference."""
    text = F.lit("one[^b] two[^a] three[^b] four[^c]")
    r = spark.range(1).select(F.posexplode(F.regexp_extract_all(text, F.lit(r"\[\^([A-Za-z0-9]+)\]"), F.lit(1))).alias("pos", "key"))
    first = r.groupBy("key").agg(F.min("pos").alias("first"))
    return first.select("key", F.dense_rank().over(Window.orderBy("first")).alias("number"))


@query("gate_escapes", r"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '\\u[0-9a-fA-F]{4}')")
def gate_escapes(spark, d):
    return table(spark, d, "documents").where(F.coalesce("text", F.lit("")).rlike(r"\\u[0-9a-fA-F]{4}")).select("doc_id")


@query("first_in_series", "SELECT source AS series, min(doc_id) AS first, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def first_in_series(spark, d):
    return table(spark, d, "documents").where("source is not null").groupBy(F.col("source").alias("series")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))


@query("lane_strip_next", "WITH l AS (SELECT conv_id, turn, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT conv_id, count(*) FILTER (nxt = 'assistant') AS before_answer FROM l GROUP BY conv_id")
def lane_strip_next(spark, d):
    nxt = F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", nxt.alias("nxt")).groupBy("conv_id").agg(F.count_if(F.col("nxt") == "assistant").alias("before_answer"))
