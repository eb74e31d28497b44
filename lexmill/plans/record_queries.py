"""Registered queries of run records, notes, map, ring, gates over sets, and text and number functions of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import numeric as N
from lexmill.functions import text as T
from lexmill.operators import datalog as D
from lexmill.operators import gates as G
from lexmill.operators import index as I
from lexmill.operators import records as P
from lexmill.operators import runs as U
from lexmill.plans.registry import query, table
from lexmill.plans.report_queries import _CITES, _FACTS, _RUNS, citations, facts, runs
from lexmill.plans.retrieval_queries import POS, QUERY_WORDS, TERM_SQL, TOK, docs

_HITS = ", ".join(f"'{w}'" for w in QUERY_WORDS)


@query("run_outcomes", """WITH c AS (SELECT DISTINCT conv_id FROM conversations), o AS (SELECT *, conv_id % 3 <> 0 AS judged FROM conversations)
SELECT c.conv_id, c.conv_id % 3 <> 0 AS usable, count(o.turn) AS calls, coalesce(sum(length(o.text)), 0)::BIGINT AS thinking, coalesce(sum(o.turn), 0)::BIGINT AS tokens
FROM c LEFT JOIN o ON c.conv_id = o.conv_id AND (NOT judged OR o.role = 'assistant') GROUP BY c.conv_id""")
def run_outcomes(spark, d):
    t = table(spark, d, "conversations")
    one = F.struct(F.length("text").alias("thinking"), F.col("turn").alias("tokens"))
    kept = t.groupBy("conv_id").agg(F.collect_list(one).alias("outcomes"))
    told = t.where("conv_id % 3 <> 0").groupBy("conv_id").agg(F.collect_list(F.when(F.col("role") == "assistant", one)).alias("outcomes"))
    return P.outcomes(t.select("conv_id").distinct(), told, kept, "conv_id")


@query("first_probe", "SELECT user_id, event_id, event_type FROM events WHERE value > 10 AND event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_probe(spark, d):
    return P.first_probe(table(spark, d, "events"), "user_id", ["ts", "event_id"], (F.col("value") > 10) & F.col("event_type").isNotNull(), ["event_id", "event_type"])


@query("last_reached", f"WITH {_RUNS}, o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM r) SELECT conv_id, count(*) FILTER (turn = k) AS reached, CASE WHEN count(*) FILTER (turn = k) BETWEEN 1 AND 5 THEN count(*) FILTER (turn = k) END AS stopped FROM o GROUP BY conv_id")
def last_reached(spark, d):
    s = U.presence_strip(runs(spark, d), "conv_id", "turn", "present", 60)
    return s.select("conv_id", P.last_reached(F.col("strip")).cast("long").alias("reached"), P.stopped_at(F.col("strip"), 6).cast("long").alias("stopped"))


_NOTES = """notes AS (SELECT conv_id AS doc, turn AS key, turn AS pos, role || '  ' || (turn % 2) AS content FROM conversations),
refs AS (SELECT conv_id AS doc, 100 - turn AS at, (turn * 3) % 7 AS key FROM conversations)"""


def _page_notes(spark, d):
    t = table(spark, d, "conversations")
    notes = t.select(F.col("conv_id").alias("doc"), F.col("turn").alias("key"), F.col("turn").alias("pos"), F.concat("role", F.lit("  "), (F.col("turn") % 2).cast("string")).alias("content"))
    return notes, t.select(F.col("conv_id").alias("doc"), (100 - F.col("turn")).alias("at"), ((F.col("turn") * 3) % 7).alias("key"))


@query("merged_footnotes", f"WITH {_NOTES}, f AS (SELECT doc, key, min(refs.at) AS a FROM refs GROUP BY doc, key), j AS (SELECT n.doc, n.key, first_value(n.key) OVER (PARTITION BY n.doc, content ORDER BY pos) AS kept, min(f.a) OVER (PARTITION BY n.doc, content) AS a FROM notes n LEFT JOIN f ON n.doc = f.doc AND n.key = f.key) SELECT doc, key, kept, CASE WHEN a IS NOT NULL THEN dense_rank() OVER (PARTITION BY doc ORDER BY a NULLS LAST) END AS number FROM j")
def merged_footnotes(spark, d):
    return P.merged_footnotes(*_page_notes(spark, d)).withColumn("number", F.col("number").cast("long"))


@query("sidenotes", f"WITH {_NOTES} SELECT r.doc, r.at, r.key, n.content FROM refs r JOIN notes n ON r.doc = n.doc AND r.key = n.key WHERE NOT EXISTS (SELECT 1 FROM conversations t WHERE t.conv_id = r.doc AND t.role = 'user' AND r.at >= 100 - t.turn - 1 AND r.at < 100 - t.turn)")
def sidenotes(spark, d):
    notes, refs = _page_notes(spark, d)
    tables = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("doc"), (99 - F.col("turn")).alias("start"), (100 - F.col("turn")).alias("stop"))
    return P.sidenotes(refs, notes, tables)


_POSTS = "posts AS (SELECT doc_id, lang = 'en' AS published, source FROM documents), chosen AS (SELECT item_id AS pos, item_id * 29 AS doc_id FROM benchmark)"


def _posts(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").alias("published"), "source"), table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), (F.col("item_id") * 29).alias("doc_id"))


@query("gate_featured", f"WITH {_POSTS} SELECT DISTINCT c.doc_id, CASE WHEN p.doc_id IS NULL THEN 'no post' ELSE 'not published' END AS fault FROM chosen c LEFT JOIN posts p ON c.doc_id = p.doc_id WHERE p.doc_id IS NULL OR NOT coalesce(published, false)")
def gate_featured(spark, d):
    posts, chosen = _posts(spark, d)
    return G.featured_faults(chosen, posts, "doc_id")


@query("featured_posts", f"WITH {_POSTS} SELECT c.pos, c.doc_id, p.source FROM chosen c JOIN posts p ON c.doc_id = p.doc_id")
def featured_posts(spark, d):
    posts, chosen = _posts(spark, d)
    return P.featured(chosen, posts, "doc_id").select("pos", "doc_id", "source")


@query("gate_sets", "SELECT doc_id, 'missing' AS fault FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'unexpected' FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def gate_sets(spark, d):
    return G.set_faults(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


@query("gate_scope", r"SELECT url AS path, 'file' AS fault FROM pages WHERE regexp_matches(coalesce(url, ''), '/[0-9]*7$') UNION ALL SELECT url, 'text' FROM pages WHERE regexp_matches(coalesce(html, ''), '<aside|[0-9]{4}-[0-9]{2}')")
def gate_scope(spark, d):
    return G.scope_faults(table(spark, d, "pages"), "url", "html", r"/[0-9]*7$", r"<aside|[0-9]{4}-[0-9]{2}")


_PARTS = """WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN replace(html, '<h1', '<p') WHEN page_id % 5 = 0 THEN html || '<a class="footnote-ref">1</a>' WHEN page_id % 3 = 0 THEN html || '<a class="footnote-ref">1</a><section id="x" class="footnotes">' ELSE html END AS html FROM pages)
SELECT page_id AS id, 'no heading' AS fault FROM p WHERE NOT regexp_matches(coalesce(html, ''), '(?i)<h1[ >]') UNION ALL SELECT page_id, 'no notes' FROM p WHERE contains(html, 'class="footnote-ref"') AND NOT regexp_matches(html, '<section[^>]*class="footnotes"')"""


@query("gate_parts", _PARTS)
def gate_parts(spark, d):
    ref, end = '<a class="footnote-ref">1</a>', '<section id="x" class="footnotes">'
    k = F.col("page_id")
    html = F.when(k % 7 == 0, F.replace("html", F.lit("<h1"), F.lit("<p"))).when(k % 5 == 0, F.concat("html", F.lit(ref))).when(k % 3 == 0, F.concat("html", F.lit(ref + end))).otherwise(F.col("html"))
    return G.missing_parts(table(spark, d, "pages").select("page_id", html.alias("html")), "page_id", "html")


_ALL_LINKS = "link AS (SELECT DISTINCT c.c_nationkey AS src, s.s_nationkey AS dst FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE c.c_nationkey <> s.s_nationkey)"


def all_links(spark, d):
    """(src, dst) over every row of lineitem; suppliers become nations and rows distinct before the larger joins."""
    li, o = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.select("o_custkey", F.col("s_nationkey").alias("dst")).distinct().join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.where("c_nationkey <> dst").select(F.col("c_nationkey").alias("src"), "dst").distinct()


@query("map_links", f"WITH {_ALL_LINKS}, j AS (SELECT src, dst, a.n_regionkey AS ar, b.n_regionkey AS br FROM link JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey) SELECT 'all' AS keep, src, dst FROM j UNION ALL SELECT 'crossing', src, dst FROM j WHERE ar <> br UNION ALL SELECT 'book', src, dst FROM j WHERE src % 5 = 0 OR dst % 5 = 0")
def map_links(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("series"), F.when(F.col("n_nationkey") % 5 == 0, "book").alias("kind"))
    links = all_links(spark, d)
    parts = [P.filter_links(links, nodes, k).select(F.lit(k).alias("keep"), "src", "dst") for k in ("all", "crossing", "book")]
    return parts[0].union(parts[1]).union(parts[2])


@query("shown_works", f"WITH {_CITES}, c AS (SELECT work, count(*) AS n FROM cites GROUP BY work) SELECT layer, work, n FROM c, (VALUES ('all'), ('books')) t(layer) WHERE n >= 2 AND (layer = 'all' OR work % 2 = 0)")
def shown_works(spark, d):
    works = citations(spark, d).groupBy("work").agg(F.count("*").alias("n")).withColumn("kind", F.when(F.col("work") % 2 == 0, "book").otherwise("paper"))
    parts = [P.shown_works(works, layer).select(F.lit(layer).alias("layer"), "work", "n") for layer in ("all", "books", "none")]
    return parts[0].union(parts[1]).union(parts[2])


@query("drawn_or_alone", f"WITH {_CITES}, c AS (SELECT *, count(*) OVER (PARTITION BY work) AS n FROM cites) SELECT doc, count(*) FILTER (n >= 2) AS drawn, count(*) FILTER (n < 2) AS alone FROM c GROUP BY doc")
def drawn_or_alone(spark, d):
    return P.drawn_or_alone(citations(spark, d))


@query("ring_layout", "WITH g AS (SELECT n_nationkey, n_regionkey, 2 * dense_rank() OVER (ORDER BY n_regionkey) + row_number() OVER (ORDER BY n_regionkey, n_nationkey) - 1 AS slot, count(*) OVER () + 2 * ((SELECT count(DISTINCT n_regionkey) FROM nation) + 1) AS total FROM nation) SELECT n_nationkey, slot, round(-pi() / 2 + (slot + 0.5) / total * 2 * pi(), 6) AS angle FROM g")
def ring_layout(spark, d):
    r = P.ring(table(spark, d, "nation"), "n_regionkey", "n_nationkey")
    return r.select("n_nationkey", F.col("slot").cast("long").alias("slot"), F.round("angle", 6).alias("angle"))


@query("graph_reasons", f"""{_FACTS} SELECT q AS doc, 'graph: also cites "' || s || '", like ' || p AS reason FROM related UNION ALL SELECT q, 'graph: linked from ' || p FROM points_at
UNION ALL SELECT q, CASE WHEN count(*) = 1 THEN 'graph: one neighbour in its series' ELSE 'graph: ' || count(*) || ' of its neighbours are in its series' END FROM same_series GROUP BY q UNION ALL SELECT DISTINCT q, 'graph: reached by two hops' FROM near""")
def graph_reasons(spark, d):
    return D.graph_reasons(D.evaluate(spark, facts(spark, d))).select("doc", "reason")


@query("hit_at", f"WITH {POS} SELECT doc_id AS doc, min(pos)::INT AS hit_at FROM posn WHERE w IN ({_HITS}) GROUP BY doc_id")
def hit_at(spark, d):
    return I.first_hits(docs(spark, d), QUERY_WORDS)


@query("known_hints", f"WITH {TOK} SELECT term FROM vocab WHERE term IN ({_HITS}, 'notaword')")
def known_hints(spark, d):
    return P.known_hints([*QUERY_WORDS, "notaword"], I.vocabulary(docs(spark, d)))


_ARRIVAL = "regexp_extract_all(lower('~\"' || text || '\" ~' || text), '[a-z][a-z''-]+')"


@query("arrival_words", f"SELECT item_id, array_to_string(list_transform(list_sort(list_distinct(list_filter({_ARRIVAL}, lambda w: {TERM_SQL}))), lambda w: w), ' ') AS words FROM benchmark")
def arrival_words(spark, d):
    q = F.concat(F.lit('~"'), "text", F.lit('" ~'), "text")
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.array_sort(T.arrival_words(q)), " ").alias("words"))


@query("command_args", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || '.md x' END AS arg FROM part")
def command_args(spark, d):
    even = F.col("p_partkey") % 2 == 0
    typed = F.when(even, F.concat(F.lit('-l  "'), F.regexp_replace("p_name", " ", "  "), F.lit('" --all'))).otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(".md  x.md")))
    return table(spark, d, "part").select("p_partkey", T.normalize_argument(typed).alias("arg"))


@query("loose_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def loose_json(spark, d):
    bare = F.regexp_replace(F.regexp_replace("props", '"k"', "k"), r"\}", ", }")
    shape = F.element_at(F.array(F.col("props"), F.regexp_replace("props", r"\}", ",}"), bare), (F.col("event_id") % 3 + 1).cast("int"))
    reply = F.concat(F.lit("Here it is:\n"), shape, F.lit("\nDone."))
    return table(spark, d, "events").select("event_id", F.get_json_object(T.loose_json(reply), "$.k").alias("k"))


@query("opening_paragraphs", r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,\n]', 'x', 'g'), '\n', e'\n\n', 'g'), e'\n\n') AS ps FROM documents),
l AS (SELECT doc_id, unnest(list_filter(ps, lambda x: length(trim(x)) > 20)) AS x, generate_subscripts(list_filter(ps, lambda x: length(trim(x)) > 20), 1) AS i FROM p),
s AS (SELECT doc_id, i, length(x) AS n, sum(length(x) + 2) OVER (PARTITION BY doc_id ORDER BY i) - 2 AS upto FROM l),
f AS (SELECT doc_id, coalesce(min(i) FILTER (upto > 400), max(i) + 1) - 1 AS n FROM s GROUP BY doc_id)
SELECT doc_id, n FROM f WHERE n > 0""")
def opening_paragraphs(spark, d):
    """How many paragraphs open each text, where any does."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 .,\n]", "x"), "\n", "\n\n")
    o = table(spark, d, "documents").select("doc_id", text.alias("text")).where(F.exists(F.split("text", "\n\n"), lambda p: F.length(F.trim(p)) > 20))
    n = F.size(F.split(T.opening_paragraphs(F.col("text"), 20, 400), "\n\n")).cast("long")
    fits = F.length(F.filter(F.split(T.plain_markdown(F.col("text")), r"\n\s*\n"), lambda p: F.length(F.trim(p)) > 20)[0]) <= 400
    return o.where(fits).select("doc_id", n.alias("n"))


@query("fragments", "SELECT n_nationkey, 'viz=w' || n_regionkey || '&k=' || n_nationkey || '&n=' || n_regionkey || '&map.zoom=' || n_nationkey AS fragment FROM nation WHERE n_nationkey % 2 = 0")
def fragments(spark, d):
    n = F.col("n_nationkey").cast("string")
    own = F.create_map(F.lit("n"), F.col("n_regionkey").cast("string"), F.lit("k"), n)
    now = T.fragment(F.concat(F.lit("w"), F.col("n_regionkey").cast("string")), own, F.create_map(F.lit("map.zoom"), n))
    before = F.when(F.col("n_nationkey") % 2 == 1, now)
    return table(spark, d, "nation").select("n_nationkey", T.changed_fragment(now, before).alias("fragment")).where("fragment is not null")


_SUP = "translate((e)::VARCHAR, '-0123456789', '⁻⁰¹²³⁴⁵⁶⁷⁸⁹')"


@query("distance_labels", f"WITH v AS (SELECT s_suppkey, (s_suppkey % 10)::INT AS m, (-(s_suppkey % 7) - 1)::INT AS e FROM supplier) SELECT s_suppkey, CASE WHEN m = 0 THEN '0' ELSE m || '.5×10' || {_SUP} END AS label FROM v")
def distance_labels(spark, d):
    m = F.col("s_suppkey") % 10
    x = F.when(m == 0, 0.0).otherwise(F.concat(m.cast("string"), F.lit(".5e-"), (F.col("s_suppkey") % 7 + 1).cast("string")).cast("double"))
    return table(spark, d, "supplier").select("s_suppkey", N.distance_label(x).alias("label"))


@query("gauges", "SELECT DISTINCT l_discount AS d, round(least(1, l_discount * 12), 6) AS authority, round(greatest(0, 1 - l_discount * 12), 6) AS scrutiny FROM lineitem")
def gauges(spark, d):
    g = N.gauges(F.col("d") * 12)
    return table(spark, d, "lineitem").select(F.col("l_discount").alias("d")).distinct().select("d", F.round(g[2], 6).alias("authority"), F.round(g[3], 6).alias("scrutiny"))


@query("remaining_share", "SELECT o_custkey, round((count(*) FILTER (o_orderstatus <> 'F') + 3) / (count(*) + 3), 6) AS share FROM orders GROUP BY o_custkey")
def remaining_share(spark, d):
    items = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct((F.col("o_orderstatus") == "F").alias("on"))).alias("items"))
    return items.select("o_custkey", F.round(N.remaining_share(F.col("items"), 3), 6).alias("share"))
