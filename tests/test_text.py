from pyspark.sql import functions as F

from lexmill.functions import numeric as N
from lexmill.functions import text as T
from lexmill.operators import index as I
from lexmill.operators import lexical as L

MD = "# Alpha Title\n\n*Status.* intro words here.\n\n---\n\nThe love of wisdom begins.\nIt ends here[^n].\n\n## Second heading\n\nbegins again: [linked text](/b-slug/) and more.\n\n[^n]: A note about wisdom.\n"


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def test_stop_list():
    assert len(T.STOP_WORDS) == 89 == len(set(T.STOP_WORDS))


def test_index_tokens(spark):
    want = "alpha title status intro words here love wisdom begins ends here second heading begins again linked text note about wisdom"
    assert one(spark, T.terms(T.markdown_text(F.lit(MD)))) == want.split()


def test_passages_positions_and_phrases(spark):
    d = spark.createDataFrame([(0, MD)], "doc_id long, text string")
    got = [(r["start"], r["body"]) for r in I.markdown_passages(d).orderBy("passage").collect()]
    assert got == [(0, "The love of wisdom begins. It ends here ."), (8, "Second heading"), (10, "begins again: linked text and more.")]
    stream = spark.createDataFrame([(0, " ".join(b for _, b in got))], "doc_id long, text string")
    pos = {}
    for r in I.positions(stream).collect():
        pos.setdefault(r["term"], []).append(r["pos"])
    assert {k: sorted(v) for k, v in pos.items()} == {"love": [1], "wisdom": [3], "begins": [4, 10], "ends": [6], "here": [7], "second": [8], "heading": [9], "again": [11], "linked": [12], "text": [13]}
    hit = lambda t: [r["place"] for r in L.phrase_hits(stream, L.phrase_of(t)).collect()]
    assert hit("love of wisdom") == [1] and hit("love wisdom") == [] and hit("heading begins") == [9]


def test_delta_round_trip(spark):
    p = I.positions(spark.createDataFrame([(0, "word other word other word")], "doc_id long, text string"))
    back = I.delta_decoded(I.delta_encoded(p))
    assert sorted(map(tuple, back.select("doc", "term", "pos").collect())) == sorted(map(tuple, p.select("doc", "term", "pos").collect()))


def test_footnotes_headings_links(spark):
    d = spark.createDataFrame([(0, MD)], "doc_id long, text string")
    assert [tuple(r) for r in I.footnotes(d).collect()] == [(0, "n", "A note about wisdom.")]
    assert one(spark, T.headings(F.lit(MD))) == ["Second heading"]
    assert one(spark, T.link_targets(F.lit(MD))) == ["b-slug"]


def test_fnv(spark):
    for w, h, dim, sg in (("proclus", 1610865999, 79, 1), ("abamon'", 3211709390, 110, -1)):
        assert (one(spark, T.fnv1a(F.lit(w))), one(spark, T.dimension(F.lit(w))), one(spark, T.sign(F.lit(w)))) == (h, dim, sg)


def test_osa(spark):
    for a, b, n in (("proculs", "proclus", 1), ("ca", "abc", 3), ("prokluss", "proclus", 2), ("w", "w", 0), ("", "abc", 3)):
        assert one(spark, T.osa(F.lit(a), F.lit(b))) == n


def test_url_and_state(spark):
    assert one(spark, T.url_component(F.lit("a b~c(d)"))) == "a%20b~c(d)"
    s = one(spark, T.fragment_state(F.lit("#viz=w&k=1.5&other.k=2&bad=x")))
    assert s["primary"] == "w" and s["state"] == {"w.k": 1.5, "other.k": 2.0}
    assert one(spark, T.query_url(F.lit("a b"), F.lit("s"), F.lit(""), F.lit("rel"))) == "?q=a%20b&series=s"


def test_escaping_and_numbers(spark):
    assert one(spark, T.escape_markup(F.lit("a<b & \"c\""))) == "a&lt;b &amp; &quot;c&quot;"
    assert one(spark, T.rfc822(F.lit("2026-09-24").cast("date"))) == "Thu, 24 Sep 2026 00:00:00 GMT"
    assert one(spark, N.trimmed_number(F.lit(2.50), 3)) == "2.5"
    assert one(spark, N.ticks(F.lit(0.0), F.lit(7.0))) == [0.0, 2.0, 4.0, 6.0]


def test_cursor_and_marks(spark):
    assert one(spark, T.cursor_word(F.lit("open theurgy now"), F.lit(12))) == "theurgy"
    assert one(spark, T.mark(F.lit("Theurgy and the"), ["theurg"])) == "<mark>Theurgy</mark> and the"


def test_gates_ticks_and_caps(spark):
    from pyspark.sql import functions as F

    from lexmill.functions import numeric
    from lexmill.operators import datalog, gates, index

    text = "It ended on a claim[^x]: text, and[^q].\n  [^x]: a note\n[^y]: unused\nmore [^z] here"
    got = {tuple(r) for r in gates.footnote_mismatches(spark.createDataFrame([(1, text)], "doc long, text string"), "doc", "text").collect()}
    assert got == {(1, "y", "no reference"), (1, "q", "no definition"), (1, "z", "no definition")}
    dates = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("2024-1-1",), (None,)], "d string")
    assert gates.bad_dates(dates, "d").count() == 3
    t = spark.createDataFrame([(2.0, 2.0), (0.0, 10.0)], "a double, b double").select(numeric.ticks(F.col("a"), F.col("b"))).collect()
    assert t[0][0] == [2.0] and t[1][0] == [0.0, 2.0, 4.0, 6.0, 8.0, 10.0]
    runs = spark.createDataFrame([(1, "w", [3, 4, 1]), (1, "v", [0])], "doc long, term string, runs array<int>")
    assert sorted((r["term"], r["pos"]) for r in index.delta_decoded(runs).collect()) == [("v", 0), ("w", 3), ("w", 7), ("w", 8)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    A, R = datalog.Atom, datalog.Rule
    rules = [R(A("reach", ("X", "Y")), (A("link", ("X", "Y")),)), R(A("reach", ("X", "Z")), (A("reach", ("X", "Y")), A("link", ("Y", "Z"))))]
    assert datalog.evaluate(spark, {"link": chain}, rules, rounds=3).capped and not datalog.evaluate(spark, {"link": chain}, rules, rounds=20).capped
