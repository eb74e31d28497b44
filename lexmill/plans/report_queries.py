"""Registered queries of the graph, the reports, event-log distillation, gates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import numeric as N
from lexmill.functions import text as T
from lexmill.operators import datalog as D
from lexmill.operators import gates as G
from lexmill.operators import index as I
from lexmill.operators import relational as R
from lexmill.operators import runs as U
from lexmill.plans.registry import query, table

# The test bed's graph: customers' nations order from suppliers' nations; pieces are nations, series are regions.
_LINK = """link AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_discount >= 0.1 AND l.l_quantity >= 48 AND c.c_nationkey <> s.s_nationkey)"""
_CITES = "cites AS (SELECT DISTINCT d.doc_id AS doc, b.item_id AS work FROM documents d JOIN benchmark b ON contains(d.text, b.text))"
_SEEDS = "(0, 3, 7, 11)"


def nation_links(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_discount >= 0.1 and l_quantity >= 48").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    return j.where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


def citations(spark: SparkSession, d: str) -> DataFrame:
    """(doc, work): documents that hold a benchmark passage.

    Found by an equi-join on the passage's first five words rather than by trying each pair of texts; contains() decides.
    """
    five = 5
    # first complete word onwards, as passages may begin inside a word of the document
    cleaned = lambda t: F.split(F.coalesce(t, F.lit("")), r"[ \n]")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("work"), F.col("text").alias("passage"))
    key = F.array_join(F.slice(cleaned(F.col("passage")), 2, five), " ")
    b = b.withColumn("key", F.xxhash64(key)).where(F.size(cleaned(F.col("passage"))) > five + 1)
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    w = cleaned(F.col("text"))
    keys = F.transform(F.array(w), lambda ws: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ws) - five + 1)), lambda i: F.xxhash64(F.array_join(F.slice(ws, i, five), " "))))[0]
    near = doc.select("doc", F.explode(F.array_distinct(keys)).alias("key"))
    found = near.join(F.broadcast(b.select("work", "key")) if b.count() <= 100_000 else b.select("work", "key"), "key").select("doc", "work").distinct()
    return found.join(doc, "doc").join(b.select("work", "passage"), "work").where(F.contains("text", F.col("passage"))).select("doc", "work").distinct()


def facts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    nations = table(spark, d, "nation")
    return {
        "seed": nations.where("n_nationkey in (0, 3, 7, 11)").select("n_nationkey"),
        "link": nation_links(spark, d),
        "series_of": nations.select("n_nationkey", "n_regionkey"),
        "cites": nations.select("n_nationkey", (F.col("n_nationkey") % 4).alias("work")),
    }


_FACTS = f"""WITH {_LINK}, hit AS (SELECT n_nationkey AS p FROM nation WHERE n_nationkey IN {_SEEDS}), cited AS (SELECT n_nationkey AS doc, n_nationkey % 4 AS work FROM nation),
related AS (SELECT DISTINCT a.doc AS p, b.doc AS q, a.work AS s FROM cited a JOIN cited b ON a.work = b.work AND a.doc <> b.doc WHERE a.doc IN (SELECT p FROM hit) AND b.doc IN (SELECT p FROM hit)),
same_series AS (SELECT a.n_nationkey AS p, b.n_nationkey AS q FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey WHERE a.n_nationkey IN (SELECT p FROM hit)),
points_at AS (SELECT src AS p, dst AS q FROM link WHERE src IN (SELECT p FROM hit)),
path2 AS (SELECT DISTINCT a.src AS p, b.dst AS q FROM link a JOIN link b ON a.dst = b.src),
near AS (SELECT p, q FROM path2 WHERE p IN (SELECT p FROM hit) AND p <> q)"""
for _name, _cols in (("hit", "p"), ("related", "p, q, s"), ("same_series", "p, q"), ("points_at", "p, q"), ("path2", "p, q"), ("near", "p, q")):

    def _relation(spark, d, name=_name, cols=_cols):
        return D.evaluate(spark, facts(spark, d)).relations[name].toDF(*cols.split(", "))

    query(f"dl_{_name}", f"{_FACTS} SELECT {_cols} FROM {_name}")(_relation)

_GRAPH = f"""{_FACTS}, g AS (SELECT q AS doc, 0.34 AS s FROM related UNION ALL SELECT q, 0.26 FROM points_at UNION ALL SELECT q, 0.20 FROM same_series UNION ALL SELECT q, 0.14 FROM near)"""


@query("graph_scores", f"{_GRAPH} SELECT doc, max(s)::DOUBLE AS score FROM g GROUP BY doc")
def graph_scores(spark, d):
    return D.graph_scores(D.evaluate(spark, facts(spark, d))).select("doc", "score")


@query("graph_cap", f"{_GRAPH}, m AS (SELECT doc, max(s)::DOUBLE AS score FROM g WHERE doc NOT IN (SELECT p FROM hit) GROUP BY doc), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS rn FROM m) SELECT doc, score, (SELECT count(*) FROM r WHERE rn > 12) AS dropped FROM r WHERE rn <= 12")
def graph_cap(spark, d):
    only = graph_scores(spark, d).join(facts(spark, d)["seed"].select(F.col("n_nationkey").alias("doc")), "doc", "left_anti")
    top = only.orderBy(F.desc("score"), "doc").limit(12)
    total = only.agg(F.greatest(F.count("*") - 12, F.lit(0)).alias("dropped"))
    return top.crossJoin(F.broadcast(total))


@query("dl_transitive", "WITH RECURSIVE " + _LINK + ", reach(p, q) AS (SELECT src, dst FROM link UNION SELECT r.p, l.dst FROM reach r JOIN link l ON r.q = l.src) SELECT p, q FROM reach")
def dl_transitive(spark, d):
    rules = (D.rule(("reach", "P", "Q"), ("link", "P", "Q")), D.rule(("reach", "P", "Q"), ("reach", "P", "R"), ("link", "R", "Q")))
    return D.evaluate(spark, {"link": nation_links(spark, d)}, rules, rounds=30).relations["reach"].toDF("p", "q")


@query("citations", f"WITH {_CITES} SELECT doc, work FROM cites")
def citations_query(spark, d):
    return citations(spark, d)


@query("shared_works", f"WITH {_CITES} SELECT work, count(*) AS n FROM cites GROUP BY work HAVING count(*) >= 2 ORDER BY n DESC, work LIMIT 10")
def shared_works(spark, d):
    return R.cited_works(citations(spark, d)).limit(10)


@query("works_by_kind", f"WITH {_CITES}, c AS (SELECT work, count(*) AS n FROM cites GROUP BY work) SELECT CASE WHEN c.n IS NULL THEN 'uncited' WHEN c.n = 1 THEN 'single' ELSE 'shared' END AS kind, count(*) AS works FROM benchmark b LEFT JOIN c ON b.item_id = c.work GROUP BY 1")
def works_by_kind(spark, d):
    n = citations(spark, d).groupBy("work").agg(F.count("*").alias("n"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("work")).join(n, "work", "left")
    return b.groupBy(F.when(F.col("n").isNull(), "uncited").when(F.col("n") == 1, "single").otherwise("shared").alias("kind")).agg(F.count("*").alias("works"))


_REGION = f"{_LINK}, re AS (SELECT a.n_regionkey AS f, b.n_regionkey AS t FROM link JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey)"


@query("link_matrix", f"WITH {_REGION} SELECT f, " + ", ".join(f"count(*) FILTER (t = {k}) AS to_{k}" for k in range(5)) + " FROM re GROUP BY f")
def link_matrix(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    e = nation_links(spark, d).join(F.broadcast(n.toDF("src", "f")), "src").join(F.broadcast(n.toDF("dst", "t")), "dst")  # 25 nations
    return R.link_matrix(e, "f", "t", [0, 1, 2, 3, 4]).toDF("f", *[f"to_{k}" for k in range(5)])


@query("degree_hubs", f"WITH {_LINK}, e AS (SELECT src AS node, 1 AS o, 0 AS i FROM link UNION ALL SELECT dst, 0, 1 FROM link) SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(o + i)::BIGINT AS degree FROM e GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def degree_hubs(spark, d):
    return R.degrees(nation_links(spark, d), "src", "dst").orderBy(F.desc("degree"), "node").limit(10)


@query("mutual_pairs", f"WITH {_LINK} SELECT a.src AS a, a.dst AS b FROM link a JOIN link b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst")
def mutual_pairs(spark, d):
    return R.mutual_pairs(nation_links(spark, d), "src", "dst")


@query("neighbourhood", f"WITH {_REGION} SELECT f, count(*) AS links, count(*) FILTER (f <> t) AS crossing FROM re GROUP BY f")
def neighbourhood(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    e = nation_links(spark, d).join(F.broadcast(n.toDF("src", "f")), "src").join(F.broadcast(n.toDF("dst", "t")), "dst")
    return e.groupBy("f").agg(F.count("*").alias("links"), F.count_if(F.col("f") != F.col("t")).alias("crossing"))


@query("circular_mean", "SELECT n_regionkey AS k, round(atan2(sum(sin(n_nationkey * 0.25)), sum(cos(n_nationkey * 0.25))), 6) AS angle FROM nation GROUP BY 1")
def circular_mean(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.round(R.circular_mean(F.col("n_nationkey") * 0.25), 6).alias("angle"))


# Orders stand in for dated pieces: priority is the series, status the kind.
@query("newest_first", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 24")
def newest_first(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(24).select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("timeline_days", "SELECT o_orderdate::DATE AS day, count(*) AS n, array_to_string(list(o_orderkey ORDER BY o_orderkey DESC), ' ') AS items FROM orders GROUP BY 1")
def timeline_days(spark, d):
    return R.day_groups(table(spark, d, "orders"), "o_orderdate", "o_orderkey").select("day", "n", F.array_join(F.transform("items", lambda x: x.cast("string")), " ").alias("items"))


@query("recent_8", "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders ORDER BY day DESC, o_orderkey DESC LIMIT 8")
def recent_8(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")).orderBy(F.desc("day"), F.desc("o_orderkey")).limit(8)


@query("timeline_header", "SELECT count(*) AS posts, count(DISTINCT o_orderdate::DATE) AS days, max(o_orderdate::DATE) AS last_day FROM orders")
def timeline_header(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").agg(F.count("*").alias("posts"), F.countDistinct(day).alias("days"), F.max(day).alias("last_day"))


@query("prev_next", "SELECT o_orderkey, row_number() OVER w AS ordinal, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def prev_next(spark, d):
    return R.series_neighbours(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", F.col("ordinal").cast("long").alias("ordinal"), "previous", "next")


@query("series_counts", "SELECT o_orderpriority AS series, count(*) FILTER (o_orderstatus = 'F') AS shown, count(*) AS total FROM orders GROUP BY 1")
def series_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("shown"), F.count("*").alias("total"))


@query("series_cards", "SELECT o_orderpriority AS series, count(*) AS n, arg_min(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS first_order FROM orders GROUP BY 1")
def series_cards(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("series")).agg(F.count("*").alias("n"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


@query("series_listing", "SELECT o_orderpriority AS series, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n FROM orders QUALIFY n <= 5")
def series_listing(spark, d):
    n = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("series"), "o_orderkey", n.cast("long").alias("n")).where("n <= 5")


@query("feed_items", """SELECT o_orderkey, '<item><title>Order ' || o_orderkey || ' &amp; ' || o_orderstatus || '</title><pubDate>' || strftime(o_orderdate, '%a, %d %b %Y') || ' 00:00:00 GMT</pubDate><category>' || o_orderpriority || '</category></item>' AS item FROM orders""")
def feed_items(spark, d):
    head = T.escape_markup(F.concat(F.lit("Order "), F.col("o_orderkey"), F.lit(" & "), F.col("o_orderstatus")))
    item = F.concat(F.lit("<item><title>"), head, F.lit("</title><pubDate>"), T.rfc822(F.to_date("o_orderdate")), F.lit("</pubDate><category>"), T.escape_markup(F.col("o_orderpriority")), F.lit("</category></item>"))
    return table(spark, d, "orders").select("o_orderkey", item.alias("item"))


@query("sitemap_rows", """SELECT '/' AS loc, NULL::DATE AS lastmod UNION ALL SELECT '/about/', max(o_orderdate::DATE) FROM orders UNION ALL SELECT '/timeline/', max(o_orderdate::DATE) FROM orders
UNION ALL SELECT '/' || o_orderkey || '/', o_orderdate::DATE FROM orders""")
def sitemap_rows(spark, d):
    o = table(spark, d, "orders").select(F.concat(F.lit("/"), F.col("o_orderkey"), F.lit("/")).alias("loc"), F.to_date("o_orderdate").alias("lastmod"))
    last = o.agg(F.max("lastmod").alias("lastmod"))
    fixed = last.select(F.explode(F.array(F.struct(F.lit("/").alias("loc"), F.lit(None).cast("date").alias("lastmod")), F.struct(F.lit("/about/").alias("loc"), F.col("lastmod")), F.struct(F.lit("/timeline/").alias("loc"), F.col("lastmod")))).alias("x")).select("x.*")
    return fixed.unionByName(o)


@query("link_extract", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1))) AS target FROM pages")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)))).alias("target"))


@query("page_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1 FROM pages")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"))


_MD = "# Alpha Title\n\n*Status.* intro words here.\n\n---\n\nThe love of wisdom begins.\nIt ends here[^n].\n\n## Second heading\n\nbegins again: [linked text](/b-slug/) and more.\n\n[^n]: A note about wisdom.\n"


def _markdown(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, _MD)], "doc_id long, text string")


@query("md_fields", "SELECT 'Alpha Title' AS title, 'Second heading' AS heads, 'b-slug' AS links, 'intro words here. --- The love of wisdom begins. It ends here . begins again: linked text and more.' AS lede")
def md_fields(spark, d):
    t = F.col("text")
    return _markdown(spark).select(T.title(t).alias("title"), F.array_join(T.headings(t), "|").alias("heads"), F.array_join(T.link_targets(t), "|").alias("links"), T.lede(t).alias("lede"))


@query("md_passages", "SELECT * FROM (VALUES (0, 0::BIGINT, 'The love of wisdom begins. It ends here .'), (1, 8::BIGINT, 'Second heading'), (2, 10::BIGINT, 'begins again: linked text and more.')) t(passage, start, body)")
def md_passages(spark, d):
    return I.markdown_passages(_markdown(spark)).select("passage", "start", "body")


@query("footnote_defs", "SELECT 0::BIGINT AS doc, 'n' AS key, 'A note about wisdom.' AS note")
def footnote_defs(spark, d):
    return I.footnotes(_markdown(spark))


# Conversations stand in for runs: a system turn is the event, a short text an empty turn.
_RUNS = "r AS (SELECT conv_id, turn + 1 AS turn, role = 'system' AS event, length(text) >= 60 AS present FROM conversations)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), (F.col("role") == "system").alias("event"), (F.length("text") >= 60).alias("present"))


@query("strip60", f"WITH {_RUNS}, t AS (SELECT unnest(range(1, 61)) AS turn), c AS (SELECT DISTINCT conv_id FROM r) SELECT conv_id, string_agg(coalesce(CASE WHEN present THEN '1' WHEN NOT present THEN '0' END, ' '), '' ORDER BY t.turn) AS strip FROM c CROSS JOIN t LEFT JOIN (SELECT DISTINCT ON (conv_id, turn) * FROM r) r USING (conv_id, turn) GROUP BY conv_id")
def strip60(spark, d):
    return U.presence_strip(runs(spark, d).dropDuplicates(["conv_id", "turn"]), "conv_id", "turn", "present")


@query("first_event", f"WITH {_RUNS} SELECT conv_id, min(turn) FILTER (event) AS first_event FROM r GROUP BY conv_id")
def first_event(spark, d):
    return U.after_first_event(runs(spark, d), "conv_id", "turn", "event", "present").select("conv_id", "first_event")


@query("fraction_after", f"WITH {_RUNS}, f AS (SELECT conv_id, min(turn) FILTER (event) AS fe FROM r GROUP BY conv_id) SELECT conv_id, fe AS first_event, count(*) FILTER (turn > fe) AS n_after, round(avg(CASE WHEN turn > fe THEN present::INT END), 6) AS fraction FROM r JOIN f USING (conv_id) GROUP BY conv_id, fe")
def fraction_after(spark, d):
    return U.after_first_event(runs(spark, d), "conv_id", "turn", "event", "present").withColumn("fraction", F.round("fraction", 6))


@query("max_run", f"WITH {_RUNS}, i AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - sum(present::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM r) SELECT conv_id, max(n)::BIGINT AS longest FROM (SELECT conv_id, g, sum(present::INT) AS n FROM i GROUP BY ALL) GROUP BY conv_id")
def max_run(spark, d):
    return U.longest_run(runs(spark, d), "conv_id", "turn", "present")


@query("next_turn_recovery", f"WITH {_RUNS}, l AS (SELECT *, lead(present) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM r) SELECT conv_id, sum((NOT present)::INT)::BIGINT AS empties, sum((NOT present AND coalesce(nx, false))::INT)::BIGINT AS recovered FROM l GROUP BY conv_id")
def next_turn_recovery(spark, d):
    return U.next_turn_recovery(runs(spark, d), "conv_id", "turn", "present")


@query("route_hist", "SELECT role AS route, count(*) AS n FROM conversations GROUP BY role UNION ALL SELECT 'tool', 0")
def route_hist(spark, d):
    seeded = spark.createDataFrame([("tool",), ("system",)], "route string")
    n = table(spark, d, "conversations").groupBy(F.col("role").alias("route")).agg(F.count("*").alias("n"))
    return n.join(seeded, "route", "full_outer").select("route", F.coalesce("n", F.lit(0)).alias("n"))


@query("strip_totals", f"WITH {_RUNS} SELECT count(*) AS turns, sum((NOT present)::INT)::BIGINT AS empty, sum((event AND NOT present)::INT)::BIGINT AS empty_on_event, max(turn) AS last_turn, min(turn) FILTER (event) AS earliest_event FROM r")
def strip_totals(spark, d):
    gap = ~F.col("present")
    return runs(spark, d).agg(F.count("*").alias("turns"), F.sum(gap.cast("int")).alias("empty"), F.sum((gap & F.col("event")).cast("int")).alias("empty_on_event"), F.max("turn").alias("last_turn"), F.min(F.when(F.col("event"), F.col("turn"))).alias("earliest_event"))


@query("cursor_state", f"WITH {_RUNS}, c AS (SELECT DISTINCT conv_id FROM r) SELECT conv_id, coalesce(bool_or(present), true) AS present, coalesce(bool_or(event), false) AS event FROM c LEFT JOIN r USING (conv_id) WHERE turn = 3 OR turn IS NULL OR conv_id NOT IN (SELECT conv_id FROM r WHERE turn = 3) AND false GROUP BY conv_id UNION ALL SELECT conv_id, true, false FROM c WHERE conv_id NOT IN (SELECT conv_id FROM r WHERE turn = 3)")
def cursor_state(spark, d):
    at = F.col("turn") == 3
    return runs(spark, d).groupBy("conv_id").agg(F.coalesce(F.bool_or(F.when(at, F.col("present"))), F.lit(True)).alias("present"), F.coalesce(F.bool_or(F.when(at, F.col("event"))), F.lit(False)).alias("event"))


@query("replay_pick", f"WITH {_RUNS}, c AS (SELECT conv_id, conv_id % 2 AS arm, sum((NOT present)::INT)::BIGINT AS empties, min(turn) FILTER (NOT present) AS first FROM r GROUP BY conv_id) SELECT arm, conv_id, empties FROM c QUALIFY row_number() OVER (PARTITION BY arm ORDER BY empties, first NULLS FIRST, conv_id) = count(*) OVER (PARTITION BY arm) // 2 + 1")
def replay_pick(spark, d):
    c = runs(spark, d).groupBy("conv_id").agg(F.sum((~F.col("present")).cast("int")).alias("empties"), F.min(F.when(~F.col("present"), F.col("turn"))).alias("first"))
    c = c.withColumn("arm", F.col("conv_id") % 2)
    return U.median_pick(c, "arm", ["empties", F.col("first").asc_nulls_first(), "conv_id"]).select("arm", "conv_id", "empties")


@query("median_sd_range", "SELECT l_returnflag AS arm, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS sd, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def median_sd_range(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.round(F.avg(q), 6).alias("mean"), F.median(q).alias("median"), F.round(F.coalesce(F.stddev_samp(q), F.lit(0.0)), 6).alias("sd"), F.min(q).alias("low"), F.max(q).alias("high"))


_ERF = "(1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))"


@query("mann_whitney", f"""WITH v AS (SELECT n_chars AS v, quality = 1 AS a FROM documents JOIN labels USING (doc_id)), k AS (SELECT a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM v),
s AS (SELECT count(*) FILTER (a) AS m, count(*) FILTER (NOT a) AS n, sum(r) FILTER (a) AS r FROM k), u AS (SELECT m, n, r - m * (m + 1) / 2.0 AS u FROM s),
z AS (SELECT *, greatest(0, abs(u - m * n / 2.0) - 0.5) / sqrt(m::DOUBLE * n * (m + n + 1) / 12.0) / sqrt(2.0) AS x FROM u), t AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM z)
SELECT m, n, u::DOUBLE AS u, round(greatest(0, 1 - {_ERF}), 6) AS p FROM t""")
def mann_whitney(spark, d):
    v = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id").select("n_chars", (F.col("quality") == 1).alias("good"))
    return U.rank_test(v, "n_chars", "good").withColumns({"u": F.col("u").cast("double"), "p": F.round("p", 6)})


@query("gate_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate IS NULL")
def gate_dates(spark, d):
    return G.bad_dates(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate").cast("string")), "day").select("o_orderkey")


@query("gate_leaks", r"""WITH h AS (SELECT doc_id AS id, unnest([{'rule': 'address', 'n': len(regexp_extract_all(coalesce(text, ''), '[a-z0-9.]+@[a-z0-9.]+'))}, {'rule': 'number', 'n': len(regexp_extract_all(coalesce(text, ''), '[0-9]{9,}'))},
{'rule': 'licence', 'n': len(regexp_extract_all(coalesce(text, ''), 'All rights reserved'))}]) AS x FROM documents) SELECT id, x.rule AS rule, x.n AS n FROM h WHERE x.n > 0""")
def gate_leaks(spark, d):
    return G.leaks(table(spark, d, "documents"), "doc_id", "text", [("address", "[a-z0-9.]+@[a-z0-9.]+"), ("number", "[0-9]{9,}"), ("licence", "All rights reserved")])


@query("gate_draft_links", "SELECT page_id, t AS draft FROM pages, (VALUES ('/The'), ('/und'), ('/les')) v(t) WHERE contains(html, 'href=\"' || t || '\"')")
def gate_draft_links(spark, d):
    drafts = F.array(*[F.lit(x) for x in ("/The", "/und", "/les")])
    return table(spark, d, "pages").select("page_id", F.explode(F.filter(drafts, lambda t: F.contains(F.col("html"), F.concat(F.lit('href="'), t, F.lit('"'))))).alias("draft"))


@query("gate_stray", f"WITH {_RUNS} SELECT conv_id, turn FROM r WHERE NOT present AND NOT event")
def gate_stray(spark, d):
    return runs(spark, d).where(~F.col("present") & ~F.col("event")).select("conv_id", "turn")


@query("gate_expected", "SELECT l_returnflag AS arm, avg(l_quantity) > 25.6 OR avg(l_quantity) < 25.4 AS off FROM lineitem GROUP BY 1 HAVING off")
def gate_expected(spark, d):
    got = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.avg("l_quantity").alias("value"))
    want = spark.createDataFrame([(x, 25.5, 0.1) for x in "ANR"], "arm string, want double, tol double")
    return G.off_target(got, want, "arm").select("arm", F.lit(True).alias("off"))


@query("gate_footnotes", "SELECT 0::BIGINT AS doc, 'z' AS key, 'no definition' AS side")
def gate_footnotes(spark, d):
    return G.footnote_mismatches(spark.createDataFrame([(0, _MD + "\nstray[^z] mark\n")], "doc_id long, text string"), "doc_id", "text")


@query(
    "gate_footnotes_documents",
    """SELECT doc_id AS doc, 'k' || (doc_id % 5) AS key, 'no reference' AS side FROM documents WHERE doc_id % 5 <> doc_id % 7
UNION ALL SELECT doc_id, 'k' || (doc_id % 7), 'no definition' FROM documents WHERE doc_id % 5 <> doc_id % 7""",
)
def gate_footnotes_documents(spark, d):
    """The footnote gate over the documents, each with a reference before a colon and an indented definition put in."""
    mark = lambda m: F.concat(F.lit("[^k"), (F.col("doc_id") % m).cast("string"), F.lit("]"))
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"\[\^", "(^")
    text = F.concat(bare, F.lit("\nended on a claim"), mark(7), F.lit(": more\n \t"), mark(5), F.lit(": a note"))
    return G.footnote_mismatches(table(spark, d, "documents").select("doc_id", text.alias("text")), "doc_id", "text")


@query(
    "gate_text_dates",
    """SELECT doc_id AS doc, d FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '2024-02-30' WHEN 2 THEN '2024-2-3' WHEN 3 THEN '2023-13-01' ELSE strftime(DATE '2020-01-01' + (doc_id % 900)::INT, '%Y-%m-%d') END AS d FROM documents)
WHERE d IS NULL OR NOT regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') OR try_cast(d AS DATE) IS NULL""",
)
def gate_text_dates(spark, d):
    """The date gate over dates as texts, bad ones among them."""
    k = F.col("doc_id") % 6
    good = F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int")), "yyyy-MM-dd")
    text = F.when(k == 0, F.lit(None)).when(k == 1, "2024-02-30").when(k == 2, "2024-2-3").when(k == 3, "2023-13-01").otherwise(good)
    return G.bad_dates(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), text.alias("d")), "d")


@query("edit_distance", "SELECT a.p_partkey, levenshtein(a.p_name, 'almond anvil')::INT AS plain FROM part a")
def edit_distance(spark, d):
    return table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", F.lit("almond anvil")).alias("plain"))


@query("osa_pairs", "SELECT * FROM (VALUES ('proculs', 'proclus', 1), ('ca', 'abc', 3), ('prokluss', 'proclus', 2), ('proclas', 'proclus', 1), ('proclu', 'proclus', 1), ('w', 'w', 0)) t(a, b, distance)")
def osa_pairs(spark, d):
    pairs = spark.createDataFrame([("proculs", "proclus"), ("ca", "abc"), ("prokluss", "proclus"), ("proclas", "proclus"), ("proclu", "proclus"), ("w", "w")], "a string, b string")
    return pairs.select("a", "b", T.osa(F.col("a"), F.col("b")).cast("int").alias("distance"))


@query("fnv1a", "SELECT * FROM (VALUES ('proclus', 1610865999::BIGINT, 79, 1), ('wetiko', 1151964628, 148, 1), ('theurgy', 1611046615, 55, 1), ('a-coming', 76143304, 104, 1)) t(term, hash, dim, sign)")
def fnv1a(spark, d):
    t = F.col("term")
    return spark.createDataFrame([(x,) for x in ("proclus", "wetiko", "theurgy", "a-coming")], "term string").select("term", T.fnv1a(t).alias("hash"), T.dimension(t).alias("dim"), T.sign(t).alias("sign"))


@query("erf", f"WITH g AS (SELECT k / 10.0 AS x, 1 / (1 + 0.3275911 * (k / 10.0)) AS t FROM range(0, 40) r(k)) SELECT x::DOUBLE AS x, round({_ERF}, 6) AS y FROM g")
def erf(spark, d):
    g = spark.range(40).select((F.col("id") / 10.0).alias("x"))
    return g.select(F.col("x"), F.round(N.erf(F.col("x")), 6).alias("y"))


@query("rfc822", "SELECT DISTINCT o_orderdate::DATE AS day, strftime(o_orderdate, '%a, %d %b %Y') || ' 00:00:00 GMT' AS text FROM orders")
def rfc822(spark, d):
    return table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().select("day", T.rfc822(F.col("day")).alias("text"))


@query("model_runaway", """WITH g AS (SELECT k * 5.0 AS x, a, hold FROM range(0, 31) r(k), (VALUES (0.5), (0.7), (0.9)) t(a), (VALUES (20.0), (66.3), (80.0)) u(hold)),
p AS (SELECT *, 0.886 - (a - 0.5992) / (1 - 0.5992) * (0.886 - 0.049) * 0.3 * (hold / 66.3) AS target FROM g)
SELECT x::DOUBLE AS x, a::DOUBLE AS a, hold::DOUBLE AS hold, round((CASE WHEN a < 0.5992 THEN 0.886 WHEN hold / 66.3 >= 1 THEN CASE WHEN x <= 66.3 THEN 0.886 ELSE 0.049 + 0.837 * exp(-(x - 66.3) / ((73 - 66.3) / ln(0.837 / 0.051))) END
WHEN x <= hold THEN 0.886 + (target - 0.886) * (1 - exp(-x / 22.0)) ELSE (0.886 + (target - 0.886) * (1 - exp(-hold / 22.0))) + (0.886 - (0.886 + (target - 0.886) * (1 - exp(-hold / 22.0)))) * (1 - exp(-(x - hold) / 22.0)) END)::DOUBLE, 6) AS g FROM p""")
def model_runaway(spark, d):
    g = spark.range(31).select((F.col("id") * 5.0).alias("x"), F.explode(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9))).alias("a")).select("*", F.explode(F.array(F.lit(20.0), F.lit(66.3), F.lit(80.0))).alias("hold"))
    return g.select("x", "a", "hold", F.round(N.runaway(F.col("x"), F.col("a"), F.col("hold")), 6).alias("g"))


@query("model_damping", "SELECT z::DOUBLE AS z, t::DOUBLE AS t, round((CASE WHEN z >= 1 THEN t * exp(-t) ELSE exp(-z * t) * sin(sqrt(1 - z * z) * t) END)::DOUBLE, 6) AS y FROM (VALUES (0.1), (0.5), (1.0)) v(z), (SELECT k * 0.5 AS t FROM range(0, 40) r(k))")
def model_damping(spark, d):
    g = spark.range(40).select((F.col("id") * 0.5).alias("t"), F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(1.0))).alias("z"))
    return g.select("z", "t", F.round(N.damped(F.col("t"), F.col("z")), 6).alias("y"))


@query("model_floor", "SELECT k::DOUBLE AS t, round(CASE WHEN k >= 22 THEN 1.0 ELSE (1 - exp(-k / 5.5)) / (1 - exp(-4.0)) END::DOUBLE, 6) AS y FROM range(0, 60) r(k)")
def model_floor(spark, d):
    t = F.col("id").cast("double")
    return spark.range(60).select(t.alias("t"), F.round(N.escape_ramp(t), 6).alias("y"))


@query("model_setpoint", "SELECT k / 10.0::DOUBLE AS u, round(CASE WHEN k >= 10 THEN 1.0 WHEN k <= 0 THEN 0.0 ELSE (1 - exp(-(k / 10.0::DOUBLE) / 0.9)) / (1 - exp(-1 / 0.9)) END::DOUBLE, 6) AS y FROM range(-2, 14) r(k)")
def model_setpoint(spark, d):
    u = F.col("id") / 10.0
    return spark.range(-2, 14).select(u.alias("u"), F.round(N.unit_ramp(u), 6).alias("y"))


@query("model_switch", """WITH RECURSIVE s(i, lo, hi) AS (SELECT 0, 1e-3::DOUBLE, 1e6::DOUBLE UNION ALL
SELECT i + 1, CASE WHEN (1 - exp(-66.3::DOUBLE / ((lo + hi) / 2))) / (1 - exp(-150.0::DOUBLE / ((lo + hi) / 2))) > 0.6 THEN (lo + hi) / 2 ELSE lo END,
CASE WHEN (1 - exp(-66.3::DOUBLE / ((lo + hi) / 2))) / (1 - exp(-150.0::DOUBLE / ((lo + hi) / 2))) > 0.6 THEN hi ELSE (lo + hi) / 2 END FROM s WHERE i < 100)
SELECT round((lo + hi) / 2, 6) AS tau FROM s WHERE i = 100""")
def model_switch(spark, d):
    return spark.range(1).select(F.round(N.bisect_shape(0.6, 66.3, 150.0), 6).alias("tau"))


@query("latch", "SELECT conv_id, turn, bool_or(length(text) >= 200 AND turn >= 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS collapsed FROM conversations")
def latch(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.bool_or((F.length("text") >= 200) & (F.col("turn") >= 1)).over(w).alias("collapsed"))


@query("small_models", "SELECT k / 10.0::DOUBLE AS x, round(greatest(0, least(1, (k / 10.0 - 0.35) / 0.55)) * (0.6 + 0.4 * 0.62), 6)::DOUBLE AS expression, least(1.0, k / 8.0)::DOUBLE AS evidence, round(pow(10, -k / 10.0) * 800, 6)::DOUBLE AS curve FROM range(0, 12) r(k)")
def small_models(spark, d):
    x = F.col("id") / 10.0
    return spark.range(12).select(x.alias("x"), F.round(N.expression_level(x), 6).alias("expression"), N.evidence(F.col("id")).alias("evidence"), F.round(N.log_distance(x), 6).alias("curve"))


@query("ticks", "SELECT * FROM (VALUES (0.0::DOUBLE, 10.0::DOUBLE, '0.0 2.0 4.0 6.0 8.0 10.0'), (0.0, 1.0, '0.0 0.2 0.4 0.6 0.8 1.0')) t(lo, hi, marks)")
def ticks(spark, d):
    g = spark.createDataFrame([(0.0, 10.0), (0.0, 1.0)], "lo double, hi double")
    return g.select("lo", "hi", F.array_join(F.transform(N.ticks(F.col("lo"), F.col("hi")), lambda v: v.cast("string")), " ").alias("marks"))


@query("fmt", "SELECT * FROM (VALUES (1.5::DOUBLE, '1.5'), (2.0, '2'), (-0.001, '0'), (1234.5678, '1234.57')) t(x, text)")
def fmt(spark, d):
    return spark.createDataFrame([(1.5,), (2.0,), (-0.001,), (1234.5678,)], "x double").select("x", N.trimmed_number(F.col("x"), 2).alias("text"))


@query("url_state", "SELECT o_orderpriority AS q, '?q=' || replace(o_orderpriority, ' ', '%20') || '&series=s1&sort=new' AS url FROM (SELECT DISTINCT o_orderpriority FROM orders)")
def url_state(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderpriority").alias("q")).distinct()
    return q.select("q", T.query_url(F.col("q"), F.lit("s1"), F.lit(""), F.lit("new")).alias("url"))


@query("fused_search")
def fused_search(spark, d):
    """The whole search plan on the documents table, with benchmark passages as works."""
    from lexmill.plans.search import Engine

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", F.col("source").alias("series"), F.col("lang").alias("kind"))
    found = Engine(docs, cites=citations(spark, d)).search('bleing ~ailele "eriner thanea"')
    return found.withColumn("why", F.array_join("why", "; "))
