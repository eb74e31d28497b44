import json

from pyspark.sql import functions as F

from lexmill.operators import gates as G
from lexmill.sources import files, sinks
from lexmill.streaming.incremental import upkeep


def test_manifest_and_pieces(spark, tmp_path):
    posts = [{"slug": "a", "file": "a.md", "kind": "k", "summary": "s & t", "date": "2026-09-24", "published": True, "series": "x"}, {"slug": "b", "file": "b.md", "published": False}, {"slug": "c", "file": "none.md", "date": "2026-09-25", "published": True}]
    (tmp_path / "posts.json").write_text(json.dumps({"home": {"file": "h.md"}, "featured": ["a"], "posts": posts}))
    (tmp_path / "a.md").write_text("# A\n\nbody")
    p = files.pieces(spark, str(tmp_path / "posts.json"), str(tmp_path)).orderBy("ord").collect()
    assert [(r["slug"], r["text"][:3]) for r in p] == [("a", "# A"), ("c", "")]
    assert files.catalogue(spark, str(tmp_path / "absent.json")).count() == 0
    d = files.manifest(spark, str(tmp_path / "posts.json")).withColumn("title", F.col("slug"))
    items = [r["item"] for r in sinks.feed_items(d, "https://site.example").orderBy("ord").collect()]
    assert "<pubDate>Thu, 24 Sep 2026 00:00:00 GMT</pubDate>" in items[0] and "s &amp; t" in items[0]
    assert sinks.sitemap_urls(d, "https://site.example").where("lastmod is null").count() == 1


def test_run_rows(spark, tmp_path):
    f = tmp_path / "runs/s1/D1-r2/cell-0/rows"
    f.mkdir(parents=True)
    (f / "x.jsonl").write_text('{"turn": 1, "compaction": true, "G": 0.5}\n\n{"turn": 2}\n')
    r = files.run_rows(spark, str(tmp_path / "runs")).orderBy("turn").collect()
    assert [(x["set"], x["arm"], x["repeat"], x["turn"]) for x in r] == [("s1", "D1", 2, 1), ("s1", "D1", 2, 2)]


def test_index_sink_and_stream(spark, tmp_path):
    docs = spark.createDataFrame([(0, "alpha beta beta"), (1, "beta gamma")], "doc_id long, text string")
    sinks.write_index(docs, str(tmp_path / "ix"))
    assert files.stored_index(spark, str(tmp_path / "ix"), "vocabulary").count() == 3
    assert files.stored_index(spark, str(tmp_path / "ix"), "nothing") is None
    docs.write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(upkeep(str(tmp_path / "live"))).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    upkeep(str(tmp_path / "live"))(docs, 7)
    assert spark.read.parquet(str(tmp_path / "live/postings")).count() == 4


def test_gates(spark):
    d = spark.createDataFrame([("2026-09-24",), ("2026-13-01",), (None,), ("24-09-2026",)], "day string")
    assert G.bad_dates(d, "day").count() == 3
    docs = spark.createDataFrame([(0, "x[^a] y[^b]\n\n[^a]: note\n[^c]: note\n")], "i long, t string")
    assert sorted(map(tuple, G.footnote_mismatches(docs, "i", "t").collect())) == [(0, "b", "no definition"), (0, "c", "no reference")]
