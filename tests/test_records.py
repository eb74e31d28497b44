import math

from pyspark.sql import functions as F

from lexmill.functions import numeric as N
from lexmill.functions import text as T
from lexmill.operators import gates as G
from lexmill.operators import records as P
from lexmill.plans.search import EMPTY, Engine


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_outcomes_and_probes(spark):
    cells = spark.createDataFrame([(1,), (2,), (3,), (4,)], "cell long")
    shape = "cell long, outcomes array<struct<thinking:int,tokens:int>>"
    told = spark.createDataFrame([(1, [(5, 2), (None, 3)]), (4, None)], shape)
    kept = spark.createDataFrame([(1, [(9, 9)]), (2, [(7, 1)]), (4, [(8, 8)])], shape)
    got = {tuple(r) for r in P.outcomes(cells, told, kept, "cell").collect()}
    assert got == {(1, True, 2, 5, 5), (2, False, 1, 7, 1), (3, False, 0, 0, 0), (4, True, 0, 0, 0)}
    rows = spark.createDataFrame([(1, 0, 4, None), (1, 1, 4, 0.5), (1, 2, 4, 0.9), (2, 0, 3, 0.1)], "cell long, n long, turn long, fidelity double")
    probed = (F.col("turn") == 4) & F.col("fidelity").isNotNull()
    assert [tuple(r) for r in P.first_probe(rows, "cell", ["n"], probed, ["fidelity", "turn"]).collect()] == [(1, 0.5, 4)]
    assert [one(spark, P.last_reached(F.lit(s))) for s in ("110 10", "", " 1", "11")] == [3, 0, 0, 2]
    assert [one(spark, P.stopped_at(F.lit(s), 2)) for s in ("1 ", "11", "  ")] == [1, None, None]


def test_notes(spark):
    notes = spark.createDataFrame([(1, "a", 0, "x  y"), (1, "b", 1, "z"), (1, "c", 2, " x y"), (1, "d", 3, "unused"), (2, "a", 0, "z")], "doc long, key string, pos long, content string")
    refs = spark.createDataFrame([(1, 10, "b"), (1, 20, "c"), (1, 30, "a"), (2, 5, "a"), (2, 9, "none")], "doc long, at long, key string")
    got = {tuple(r) for r in P.merged_footnotes(notes, refs).collect()}
    assert got == {(1, "a", "a", 2), (1, "c", "a", 2), (1, "b", "b", 1), (1, "d", "d", None), (2, "a", "a", 1)}
    tables = spark.createDataFrame([(1, 20, 30), (2, 0, 5)], "doc long, start long, stop long")
    assert {(r["doc"], r["at"]) for r in P.sidenotes(refs, notes, tables).collect()} == {(1, 10), (1, 30), (2, 5)}


def test_sets_and_scope(spark):
    posts = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "slug string, published boolean")
    chosen = spark.createDataFrame([(1, "c"), (0, "a"), (2, "b"), (3, "gone")], "pos long, slug string")
    assert {tuple(r) for r in G.featured_faults(chosen, posts, "slug").collect()} == {("b", "not published"), ("c", "not published"), ("gone", "no post")}
    assert {tuple(r) for r in G.featured_faults(chosen, posts, "slug", drafts=True).collect()} == {("gone", "no post")}
    assert [r["slug"] for r in P.featured(chosen, posts, "slug").collect()] == ["a", "c", "b"]
    assert {tuple(r) for r in G.set_faults(chosen, posts.unionAll(spark.createDataFrame([("z", True)], posts.schema)), "slug").collect()} == {("gone", "missing"), ("z", "unexpected")}
    files = [("a/b.JSONL", "ok"), ("content/paper-2.md", "a transcription"), ("x/exp12.txt", "transcripts here"), ("y.md", "0000-0001-2345-678X"), ("z.md", None), (None, "fine")]
    got = {tuple(r) for r in G.scope_faults(spark.createDataFrame(files, "path string, body string"), "path", "body").collect()}
    assert got == {("a/b.JSONL", "file"), ("content/paper-2.md", "file"), ("x/exp12.txt", "file"), ("x/exp12.txt", "text"), ("y.md", "text")}


def test_map_and_ring(spark):
    nodes = spark.createDataFrame([(1, "A", "book"), (2, "A", None), (3, None, "note")], "node long, series string, kind string")
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 3)], "src long, dst long")
    kept = lambda k: {tuple(r) for r in P.filter_links(links, nodes, k).collect()}
    assert kept("crossing") == {(2, 3), (3, 1)} and kept("book") == {(1, 2), (3, 1)} and len(kept("all")) == 4
    cites = spark.createDataFrame([(1, "w"), (2, "w"), (2, "w"), (2, "v")], "doc long, work string")
    assert {tuple(r) for r in P.drawn_or_alone(cites).collect()} == {(1, 1, 0), (2, 1, 1)}
    r = {x["node"]: (x["slot"], x["angle"]) for x in P.ring(nodes.na.fill("B", ["series"]), "series", "node").collect()}
    assert {k: v[0] for k, v in r.items()} == {1: 2, 2: 3, 3: 6}
    assert math.isclose(r[1][1], -math.pi / 2 + 2.5 / 9 * 2 * math.pi)


def test_text_functions(spark):
    assert one(spark, T.arrival_words(F.lit('~Wisdom of "love wisdom"'))) == ["wisdom", "love"]
    args = ['-l  "my  post" --all', " a.md ", "'x.md'", None, "-x"]
    assert [one(spark, T.normalize_argument(F.lit(a))) for a in args] == ["my post", "a", "x.md", "", ""]
    texts = ['so {"a": 1} ok', "{a: 1,}", '{"a": [1, 2, ], }', "none", "{a b}", '{"s": ", }"}']
    assert [one(spark, F.get_json_object(T.loose_json(F.lit(t)), "$.a")) for t in texts] == ["1", "1", "[1,2]", None, None, None]
    assert one(spark, F.get_json_object(T.loose_json(F.lit(texts[5])), "$.s")) == ", }"
    long = "A paragraph of **bold** words and [a link](x) in it[^1]."
    body = f"# Head\n\n{long}\n\nshort\n\n> {long}\n\n{long}"
    plain = "A paragraph of bold words and a link in it ."
    # the mark of a quotation goes with the white space before it, line breaks too: "short" and the quotation are one paragraph
    assert one(spark, T.opening_paragraphs(F.lit(body), 20, 95)) == plain
    assert one(spark, T.opening_paragraphs(F.lit(body), 20, 96)) == f"{plain}\n\nshort\n{plain}"
    assert one(spark, T.opening_paragraphs(F.lit("tiny *text*"), 20, 6)) == "tiny t"
    assert one(spark, T.opening_paragraphs(F.lit(None).cast("string"))) == ""
    f = T.fragment(F.lit("w"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")), F.create_map(F.lit("m.z"), F.lit("3")))
    assert one(spark, f) == "viz=w&a=1&b=2&m.z=3" and one(spark, T.changed_fragment(f, f)) is None
    assert one(spark, T.fragment_state(f))["state"] == {"w.a": 1.0, "w.b": 2.0, "m.z": 3.0}


def test_number_functions(spark):
    assert [one(spark, N.distance_label(F.lit(x))) for x in (0.001, 3.2e-4, 2e-6, 0.0, -1.0, 7.0)] == ["1×10⁻³", "3.2×10⁻⁴", "2×10⁻⁶", "0", "0", "1"]
    assert one(spark, N.gauges(F.lit(1.25))) == [1.0, 0.0, 1.0, 0.0]
    items = F.array(F.struct(F.lit(True).alias("on")), F.struct(F.lit(False).alias("on")))
    assert one(spark, N.remaining_share(items, 2)) == 0.75


def test_engine_reasons_and_summary(spark):
    rows = [(0, "wisdom first\nlove begins", "A", "x"), (1, "love of words", "A", "y"), (2, "other words", "A", "x"), (3, "unlike anything", "B", "y")]
    docs = spark.createDataFrame(rows, "doc long, text string, series string, kind string")
    e = Engine(docs, link=spark.createDataFrame([(0, 3), (1, 3)], "src long, dst long"), cites=spark.createDataFrame([(0, "Book"), (1, "Book")], "doc long, work string"))
    found = e.search("love")
    found = spark.createDataFrame(found.collect(), found.schema)  # searched once
    got = {r["doc"]: r for r in found.collect()}
    assert got[0]["hit_at"] == 2 and got[1]["hit_at"] == 0 and got[2]["hit_at"] is None
    assert 'graph: also cites "Book", like 1' in got[0]["why"]
    assert {"graph: linked from 0", "graph: linked from 1"} <= set(got[3]["why"])
    assert any(w.endswith("of its neighbours are in its series") for w in got[2]["why"])
    s = e.summary("love", found).first()
    assert (s["named"], s["related"], s["folded"], s["message"]) == (2, 2, True, None)
    assert not e.summary("love", found, sort="new").first()["folded"]
    assert e.summary("qqqq", found.limit(0)).first()["message"] == EMPTY["words"]
    told = {r["doc"]: r["snippet"] for r in e.snippets(found).collect()}
    assert told == {0: "love begins", 1: "love of words", 2: "other words", 3: "unlike anything"}
