import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import datalog as D
from lexmill.operators import lexical as L
from lexmill.operators import runs as U
from lexmill.operators import vector as V
from lexmill.plans import retrieval_queries
from lexmill.plans.search import Engine, label, parse


@pytest.mark.parametrize("body,good,bad", [("^a|b", ["ab", "bx"], ["xb" + "c"][:0] + ["ca"]), ("urgy", ["liturgy", "theurgy"], ["urge"]), ("colou?r", ["color", "colour"], ["colr"])])
def test_patterns(spark, body, good, bad):
    v = spark.createDataFrame([(w,) for w in good + bad], "term string")
    assert sorted(r[0] for r in L.pattern_terms(v, body).collect()) == sorted(good)


@pytest.mark.parametrize("body", ["a\\d", "(ab", "a{2}", "*a", "^a^", "a$b", "[]", "{2}", "x[", "", "[z-a]", "a)"])
def test_refused_patterns(body):
    with pytest.raises(L.PatternError):
        L.translate_pattern(body)


def test_parse():
    s = parse('love "of wisdom begins" ~proculs ~~prokluss wisdomx')
    assert s.tokens == ("love", "wisdomx") and s.fuzzy == (("proculs", 1), ("prokluss", 2))
    assert s.phrases[0].seq == (("wisdom", 1), ("begins", 2)) and label(s).startswith("love wisdomx")
    assert parse("/ab+/").pattern == "ab+" and parse("the of").empty


def _facts(spark):
    one = lambda rows, c: spark.createDataFrame(rows, c)
    return {
        "seed": one([(0,), (1,)], "a long"),
        "series_of": one([(0, "A"), (1, "A"), (2, "A"), (3, "B")], "a long, s string"),
        "link": one([(0, 2), (2, 3), (3, 0)], "a long, b long"),
        "cites": one([(0, "w"), (1, "w"), (2, "w")], "a long, w string"),
    }


def test_rules(spark):
    r = D.evaluate(spark, _facts(spark)).relations
    rows = lambda p: sorted(tuple(x) for x in r[p].collect())
    assert rows("hit") == [(0,), (1,)] and rows("related") == [(0, 1, "w"), (1, 0, "w")]
    assert rows("same_series") == [(0, 1), (0, 2), (1, 0), (1, 2)] and rows("points_at") == [(0, 2)]
    assert rows("path2") == [(0, 3), (2, 0), (3, 2)] and rows("near") == [(0, 3)]
    g = {x["doc"]: x["score"] for x in D.graph_scores(D.evaluate(spark, _facts(spark))).collect()}
    assert g == {0: 0.34, 1: 0.34, 2: 0.26, 3: 0.14}


def test_recursion(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rules = (D.rule(("reach", "P", "Q"), ("link", "P", "Q")), D.rule(("reach", "P", "Q"), ("reach", "P", "R"), ("link", "R", "Q")))
    got = D.evaluate(spark, {"link": spark.createDataFrame([(i, i + 1) for i in range(5)], "a long, b long")}, rules, rounds=30)
    assert sorted(map(tuple, got.relations["reach"].collect())) == [(i, j) for i in range(6) for j in range(i + 1, 6)] and not got.capped


def test_rank_test(spark):
    v = spark.createDataFrame([(float(x), True) for x in (5, 7, 8, 9)] + [(float(x), False) for x in (1, 2, 3, 7)], "v double, a boolean")
    r = U.rank_test(v, "v", "a").first()
    assert r["u"] == 14.5 and math.isclose(r["p"], 0.0832644, abs_tol=2e-7)


def test_runs(spark):
    rows = [(0, 1, False, True), (0, 2, True, True), (0, 3, False, False), (0, 4, False, False), (0, 5, False, True), (0, 6, True, False)]
    d = spark.createDataFrame(rows, "cell long, turn long, event boolean, present boolean")
    assert U.presence_strip(d, "cell", "turn", "present").first()["strip"] == "110010".ljust(60)
    a = U.after_first_event(d.withColumn("gap", ~F.col("present")), "cell", "turn", "event", "gap").first()
    assert (a["first_event"], a["fraction"]) == (2, 0.75)
    assert U.longest_run(d.withColumn("gap", ~F.col("present")), "cell", "turn", "gap").first()["longest"] == 2
    r = U.next_turn_recovery(d, "cell", "turn", "present").first()
    assert (r["empties"], r["recovered"]) == (3, 1)


def test_engine(spark):
    rows = [(0, "wisdom of love begins", "A", "x"), (1, "wisdom begins and love of wisdom ends", "A", "y"), (2, "other words", "B", "x"), (3, "unlike anything", "B", "y")]
    docs = spark.createDataFrame(rows, "doc long, text string, series string, kind string")
    e = Engine(docs, link=spark.createDataFrame([(0, 2)], "src long, dst long"))
    got = e.search("love").collect()
    assert {r["doc"] for r in got if r["named"]} == {0, 1} and [r["named"] for r in got] == sorted((r["named"] for r in got), reverse=True)
    assert 2 in {r["doc"] for r in got}  # through a link from a hit
    assert {r["doc"] for r in e.search('"love of wisdom"').collect()} == {1}
    assert {r["doc"] for r in e.search("love", series="A", kind="y").collect()} == {1}
    found, corrected = e.search_or_corrected("loev")
    assert corrected == "love" and {r["doc"] for r in found.collect() if r["named"]} == {0, 1}
    assert e.search("the of").count() == 0


def test_vector_search_in_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((130, 6))
    x[100:110] = x[0] + 0.1 * rng.standard_normal((10, 6))
    rows = [(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(200, None), (220, []), (240, [0.0] * 6), (260, [float("nan")] * 6), (280, [None] * 6), (300, [1.0, 2.0]), (None, [2.0, 4.0])]
    e = spark.createDataFrame(rows, "id long, v array<double>")
    q = e.where("id % 20 = 0").withColumnRenamed("id", "q")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u[::20] @ u.T
    want = {(20 * a, b): s[a, b] for a, b in zip(*np.nonzero((s > 0) & (s >= 0.34 * s.max(axis=1)[:, None])))} | {(300, 300): 1.0, (300, None): 1.0}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or all groups meet in one partition
    for block in (2, 16, 4096):
        got = V.similar_in_blocks(e, q, block=block).collect()
        assert len(got) == len(want) and all(r["score"] == pytest.approx(want[r["q"], r["id"]]) for r in got)
    assert V.similar_in_blocks(e, q.limit(0)).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_vector_search_takes_every_twentieth_row(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = retrieval_queries.vec_cosine_floor_all(spark, str(tmp_path)).collect()
    assert {r["q"] for r in got} == {0, 20, 40, 60, 80} and {(r["q"], r["id"]) for r in got} >= {(i, i) for i in range(0, 100, 20)}
