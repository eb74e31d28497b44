"""Small tests of the operators: brute force, nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import re
import types

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm import op1_embeddings as o1
from lexmill.llm import op2_lines as o2
from lexmill.llm import op3_mixing as o3
from lexmill.llm import op4_simhash as o4
from lexmill.llm import op5_substrings as o5
from lexmill.llm import op7_html as o7
from lexmill.llm import op8_language as o8
from lexmill.llm import op9_quality as o9
from lexmill.llm import op10_sentencepiece as o10

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LINE = "This line is long enough to be counted"
PASSAGE = " ".join(f"word{i}" for i in range(30))


def frame(spark, texts, extra=()):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + list(extra)
    return spark.createDataFrame(rows, DOCS)


def texts():
    long = " ".join(f"w{i % 997}x{i}" for i in range(20_000))
    return [
        None, "", " \t\n ", "one two", f"a {PASSAGE} b", f"c {PASSAGE} d {PASSAGE}", f"{LINE}\nshort\n  {LINE.upper()} \n", f"x\n{LINE}", f"{LINE}\ny\n{LINE}",
        "same text here for copies", "same text here for copies", "Same  TEXT here for copies", long, "é ß 😀\x00 weird", "\n" * 50,
    ]


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 8))
    near = base[:20] + 0.05 * rng.standard_normal((20, 8))
    edge = base[0] + np.linspace(0, 1.2, 30)[:, None] * base[1]
    x = np.concatenate([base, near, edge, base[:5], base[:5]])
    rows = [(i, [float(v) for v in r], "x") for i, r in enumerate(x)]
    n = len(rows)
    odd = [None, [], [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + i, v, "x") for i, v in enumerate(odd)] + [(None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component_id string")
    got = {r["vec_id"]: r for r in o1.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    sim = u @ u.T >= 0.9
    label = np.arange(n)
    for _ in range(n):
        label = np.array([label[sim[i]].min() for i in range(n)])
    for i in range(n):
        assert got[i]["component_id"] == label[i] and got[i]["n_links"] == sim[i].sum() - 1 and got[i]["kept"] == (label[i] == i)
    for i in range(n, n + 6):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert got[n + 7]["component_id"] == n + 6
    assert got[None]["n_links"] == 0 and got[None]["component_id"] is None and got[None]["kept"]
    assert o1.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_on_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.standard_normal((600, 64))
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * o
    k, tables = o1.plan(50_000)
    met = (o1.table_keys(a, k, tables) == o1.table_keys(b, k, tables)).any(axis=1)
    assert met.mean() >= 0.93


def brute_lines(rows):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and i != max(held[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_against_brute_force(spark, tmp_path):
    frame(spark, texts()).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in o2.query(spark, str(tmp_path)).collect()}
    assert got == brute_lines(list(enumerate(texts()))) and sum(x[1] for x in got.values()) == 3


def test_lines_of_repeated_and_null_ids(spark):
    rows = [(None, LINE), (7, LINE), (7, LINE), (8, LINE + "\nz")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("x"))
    got = sorted((r["doc_id"] or -1, r["text"], r["n_dropped"]) for r in o2.dedup_lines(d).collect())
    assert got == [(-1, "", 1), (7, "", 1), (7, "", 1), (8, LINE + "\nz", 0)]
    assert o2.dedup_lines(d.limit(0)).count() == 0


def test_line_runs_compact(spark):
    runs = o2.LineRuns(spark, fan=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(k, k, 1, b) for k in range(b, b + 3)], "h1 long, h2 long, n_docs long, top_doc long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["h1"], r["top_doc"]) for r in runs.repeated(3).collect()} == {(2, 2), (3, 3), (4, 4)}


def test_mixing(spark):
    extra = [(100, "a b c", None, None, 0), (None, "d e", None, "s0", 0), (100, "a b c", None, None, 0)]
    d = frame(spark, texts(), extra).withColumn("rank", F.lit(1)).withColumn("target", F.lit("t"))
    m = o3.mix(d)
    rows = m.collect()
    assert len(rows) == len(texts()) + 3 and all(r["taken"] <= 3 * r["size"] and len(r["positions"]) == r["copies"] for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        by[r["source"]].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(v[0]["target"] for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) / 2 + 1
        assert v[0]["source_size"] == sum(r["size"] for r in v) and v[0]["target"] <= 3 * v[0]["source_size"]
    assert sorted(map(str, rows)) == sorted(map(str, o3.mix(d.repartition(7)).collect()))
    order = [r["__position"] for r in o3.training_order(m, ["doc_id"]).collect()]
    assert max(order) < 10**9 + 1
    assert order == sorted(order) and len(order) == sum(r["copies"] for r in rows)
    assert o3.mix(d.limit(0)).count() == 0


def test_schedules_invert(spark):
    for knots in o3.SCHEDULES:
        t = [r[0] for r in spark.range(11).select(o3.position(F.col("id") / 10, knots)).collect()]
        assert t == sorted(t) and t[0] == pytest.approx(0) and t[-1] == pytest.approx(1)


def test_simhash_against_brute_force(spark):
    d = frame(spark, texts(), [(None, "one two", None, None, 0)])
    got = {r["doc_id"]: r for r in o4.near_duplicates(d).collect()}
    import xxhash

    fps = {}
    for i, t in enumerate(texts()):
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0
    for i, f in fps.items():
        assert got[i]["fingerprint"] == f"{f:016x}"
        assert got[i]["component_id"] == min(j for j in fps if (fps[j] ^ f).bit_count() <= 2)
    assert got[None]["component_id"] == 3
    assert o4.near_duplicates(d.limit(0)).count() == 0


def test_simhash_links_lose_nothing(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = list(base)
    for f in base:
        for _ in range(4):
            a, b = rng.integers(0, 64, 2)
            fps.append(f ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)))
    fps = np.unique(np.array(fps, np.uint64))
    c = spark.createDataFrame([(i, int(f.view(np.int64))) for i, f in enumerate(fps)], "id long, fp long")
    from lexmill.llm.components import connected_components

    got = {r["id"]: r["component_id"] for r in connected_components(o4.link_fingerprints(c)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    for _ in range(20):
        label = np.array([label[n].min() for n in near])
    assert all(got.get(i, i) == label[i] for i in range(len(fps)))


def test_wide_groups_keep_one(spark):
    base = " ".join(f"token{i}" for i in range(200))
    near = base.replace("token50 ", "other ")
    far = " ".join(f"thing{i}" for i in range(200))
    d = frame(spark, [base, far, near, base, None, "", ""], [(3, base, None, None, 0), (None, base, None, None, 0)])
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in o4.keep_one_of_each_group(d).collect())
    assert kept == [-1, 0, 1, 4, 5, 6]


def test_substrings_against_brute_force(spark, tmp_path):
    frame(spark, texts()).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in o5.query(spark, str(tmp_path)).collect()}
    assert got == o5.brute_force(list(enumerate(texts()))) and got[5][1] == 60


def test_substrings_of_salted_nodes(spark, monkeypatch):
    rows = [(i, f"u{i} {PASSAGE} v{i}") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in o5.dedup_substrings(d).collect()}
    assert got == {i: 0 if i == 0 else 30 for i in range(3000)}
    e = spark.createDataFrame([(None, PASSAGE), (5, PASSAGE), (5, PASSAGE), (5, "x " + PASSAGE)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in o5.dedup_substrings(e).collect()) == [0, 30, 30, 30]
    assert o5.dedup_substrings(d.limit(0)).count() == 0


def test_html_on_fresh_layouts():
    rng, trees = np.random.default_rng(4242), o7.trained()
    same = 0
    for _ in range(120):
        s = o7.synthetic_page(rng)
        want = " ".join(t.replace(o7._MARK, "") for t in o7.Page(s).text if o7._MARK in t)
        same += o7.extract([s.replace(o7._MARK, "")], trees)[0] == want
    assert same >= 0.85 * 120


def test_html_edges(spark):
    page = '<html><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>First  para\ngraph, with text.<p>Second &lt;one&gt; here, long enough.</article><footer>&copy; x</footer>'
    d = spark.createDataFrame([(0, "u", None), (1, "u", ""), (2, "u", page), (3, "u", "<div" * 300), (4, "u", "<p>" * 3000)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in o7.main_text(d).collect()}
    assert got[0] == got[1] == ("", 0) and got[4] == ("", 0)
    assert got[2][0] == "A & B First para graph, with text. Second <one> here, long enough."


def test_decoding_never_contradicts():
    rng = np.random.default_rng(3)
    parent = [-1] + [int(rng.integers(0, i)) for i in range(1, 60)]
    keep = o7.decode(parent, rng.standard_normal(60) * 3)
    assert all(keep[p] for i, p in enumerate(parent) if i and keep[i])


def test_language(spark):
    en, fr = "the quick brown fox and the lazy dog ", "le renard brun et le chien paresseux "
    d = spark.createDataFrame([(i, (en if i % 2 else fr) * (1 + i % 4), "en" if i % 2 else "fr") for i in range(60)], "id long, text string, lang string")
    m = o8.fit(d)
    assert o8.identify([None, "", "12 !", en, fr], m)[:3] == [("und", 0.0)] * 3
    assert [x[0] for x in o8.identify([en, fr, en * 3000], m)] == ["en", "fr", "en"]
    assert [x[0] for x in o8.spans(en * 3 + fr * 3, m)] == ["en", "fr"]
    empty = o8.fit(d.limit(0))
    assert o8.predict(d.select("id", "text").limit(0), m).count() == 0 and o8.identify([en], empty)[0][0] == "und"
    got = o8.predict(d.withColumn("score", F.lit("x")).select("id", "text", "score"), m).collect()
    assert all(r["lang_pred"] == ("en" if r["id"] % 2 else "fr") and 0 <= r["score"] <= 1 for r in got)


def test_viterbi_matches_plain():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 1, 9, 3])
    s = rng.standard_normal((18, 3)) * 4
    got = o8.viterbi(s, lengths, 3.0)
    at = 0
    for n in lengths:
        import itertools

        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(s[at + i, x] for i, x in enumerate(p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[at : at + n]) == best
        at += n


def test_quality_statistics_against_brute_force(spark):
    many = [*texts(), "a b c d e a b c d e a b c d e f", "x " * 40, "# * $ %\nrow one\nrow one\n\nrow one"]
    d = frame(spark, many).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    for r in o9.judge(d, []).collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + j for i in range(len(w) - 4) for j in range(5) if c[tuple(w[i : i + 5])] > 1}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) == (not r["kept"])
    assert o9.judge(d.limit(0), []).count() == 0


def test_decision_list_learns():
    rng = np.random.default_rng(0)
    rows = [({f: float(rng.random()) for f in o9.FEATURES}, False) for _ in range(600)]
    rows = [(x, x["symbol_share"] > 0.8 and x["upper_share"] > 0.5) for x, _ in rows]
    rules = o9.learn(rows)
    caught = [any(r.covers(x) for r in rules) for x, _ in rows]
    assert sum(a and bad for a, (_, bad) in zip(caught, rows)) >= 0.8 * sum(bad for _, bad in rows)
    assert sum(a and not bad for a, (_, bad) in zip(caught, rows)) <= 0.05 * sum(caught)
    assert o9.learn([]) == []


def test_sentencepiece_parity_and_round_trip(spark):
    odd = [x for x in texts() if x is not None] + ["  a  b ", "日本語 テスト", "<s> </s> <0x41>", " " * 70 + "x", "a\r\nb", " nbsp", "ﬁ"]
    assert o10.sentencepiece_parity(odd) == []
    d = frame(spark, [None, *odd]).withColumn("ids", F.lit("clash"))
    rows = o10.encode(d).collect()
    assert all(r["decoded"] == r["text"] and r["n_tokens"] == len(r["ids"]) for r in rows if r["text"] is not None)
    assert [r["n_tokens"] for r in rows if r["text"] is None] == [None] and o10.encode(d.limit(0)).count() == 0


def test_unigram_models_are_rebuilt():
    def msg(n, body):
        return bytes([n << 3 | 2]) + bytes([len(body)]) + body

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("▁ab", -1.0, 1), ("a", -4.0, 1), ("b", -4.0, 1)]
    data = b"".join(msg(1, msg(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in pieces) + msg(2, bytes([0x18, 1]))
    m = o10.parse_model(data)
    assert m.kind == o10.UNIGRAM and [p[0] for p in m.pieces] == [p[0] for p in pieces]
    assert o10.build_tokenizer(m).encode("ab ab").ids == [2, 2]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    words = [f"plain{i % 37}word{i}" for i in range(4000)]
    clean = [" ".join(words[i * 40 : i * 40 + 40]) + "." for i in range(60)]
    junk = [" ".join(f"{w}###" for w in words[i * 20 : i * 20 + 30]) for i in range(60)]
    rows = [*clean, *junk, clean[0], None, "few words"]
    d = frame(spark, rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = d, {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = [r["doc_id"] for r in docs.collect()]
        assert docs.columns == cp.COLUMNS
    assert set(seen["quality_rules"]) == {*range(60), 120}
    assert set(seen["simhash_near_dedup"]) == set(range(60)) and set(seen["mixing"]) <= set(range(60))
    assert collections.Counter(seen["mixing"]) == collections.Counter(r["doc_id"] for r in cp.run(spark, str(tmp_path)).collect())


def test_mixing_query_returns_the_curriculum(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (1 + i % 7)), f"s{i % 3}") for i in range(200)] + [(7, "w", "s0"), (7, "w", "s0"), (None, "w w", None), (900, None, "s1"), (901, "", "s1"), (902, "", "s1")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = o3.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken", "first_position", "first_rank"]
    mixed = o3.mix(d)
    ranked = o3.with_ranks(mixed).collect()
    first = lambda r, p, k: str([r["doc_id"], r["size"], r["taken"], p, k])
    want = [first(r, int(min(r["positions"]) * 1e9) / 1e9 if r["positions"] else None, min(r["ranks"], default=-1)) for r in ranked]
    assert sorted(want) == sorted(first(r, r["first_position"], r["first_rank"]) for r in got.collect())
    order = sorted((k, int(p * 1e9), r["order_key"]) for r in ranked for k, p in zip(r["ranks"], r["positions"]))
    assert [k for k, _, _ in order] == list(range(len(order))) and [x[1:] for x in order] == sorted(x[1:] for x in order)
    assert all(len(r["ranks"]) == len(r["positions"]) for r in ranked) and any(not r["ranks"] for r in ranked)


def test_mixing_spreads_ties_and_null_ids(spark):
    rows = [(None, f"w{i}", "s") for i in range(3000)] + [(5, f"v{i}", "s") for i in range(1000)] + [(i, "", "t") for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = o3.mix(d, schedules=(((0.0, 1.0), (1.0, 1.0)),))
    assert m.where("doc_id is null").select(F.substring("order_key", 1, o3.BUCKET_DIGITS)).distinct().count() > 1000
    tied = m.withColumn("positions", F.array(F.lit(0.5)))
    sizes = [r["n"] for r in o3.training_order(tied, ["doc_id"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * 4500 / 4


def test_wide_groups_keep_one_of_repeated_rows(spark):
    base, far, alone = (" ".join(f"{w}{i}" for i in range(200)) for w in ("token", "thing", "single"))
    near = base.replace("token50 ", "other ")
    rows = [(0, base, "a"), (0, base, "a"), (0, base, "b"), (0, near, "a"), (1, base, "a"), (2, alone, "a"), (2, alone, "a"), (3, far, "a"), (0, far, "a"), (5, "", "a"), (5, "", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.create_map(F.lit("k"), F.col("source")))
    kept = o4.keep_one_of_each_group(d)
    assert kept.columns == d.columns
    group = {base: "base", near: "base", alone: "alone", far: "far", "": ""}
    got = sorted((group[r["text"]], r["doc_id"]) for r in kept.collect())
    assert got == [("", 5), ("", 5), ("alone", 2), ("base", 0), ("far", 0)]


def test_substrings_compare_words_not_hashes(spark):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a  # words whose polynomial hashes modulo 2**64 are equal
    rest = " ".join(f"r{i}" for i in range(12))
    rows = [(0, f"{a} {rest}"), (1, f"{b} {rest}"), (2, f"{b} {rest}"), (3, f"{rest} {a}")]
    got = {r["doc_id"]: r["n_removed"] for r in o5.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 13, 3: 0}


def test_suffix_codes_are_prefix_free():
    codes = o5.word_codes([b"w%d" % i for i in range(o5.CODED + 5)])
    assert len(codes) == o5.CODED and len(set(codes.values())) == o5.CODED and all(c[0] < 254 for c in codes.values())
    assert {len(c) for c in codes.values()} == {1, 2, 3} and all((len(c) == 1) == (c[0] < 200) and (len(c) == 3) == (c[0] >= 250) for c in codes.values())
    rng = np.random.default_rng(0)
    words = [b"w%d" % i for i in rng.integers(0, 3, 400)] + [b"unseen\xfe", b"unseen"] * 20
    s = o5.Suffixes([b" ".join(words), b"", b" ".join(words[100:200])])
    same = collections.defaultdict(set)
    for x, d, p in zip(s.written({b"w0": b"\x00", b"w1": b"\xc8\x00"}).to_pylist(), s.doc, s.pos):
        own = words if d == 0 else words[100:200]
        same[tuple(own[p : p + 13])].add(x)
    assert all(len(v) == 1 for v in same.values()) and len({x for v in same.values() for x in v}) == len(same)


def test_maximal_repeats_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 2, 60))) for i in range(25)]
    rows += [(i, f"{PASSAGE} own{i} {PASSAGE} " + " ".join(f"z{i}{k}" for k in range(20))) for i in range(30, 36)] + [(40, None), (41, "")]
    got = [tuple(r) for r in o5.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(got) == len(set(got)) and set(got) == o5.brute_force_passages(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in o5.dedup_substrings(d).collect()}
    assert cut == {i: x[:2] for i, x in o5.brute_force(rows).items()}
    assert o5.repeated_passages(d.limit(0)).count() == 0


def planted_pairs(rng, n, lo, hi):
    """(texts, pairs of places): pairs of texts whose shingle sets share between lo and hi."""
    out, pairs = [], []
    while len(pairs) < n:
        words = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(60, 400)))]
        other = list(words)
        for k in rng.choice(len(words), max(1, int(rng.uniform(0, 0.08) * len(words))), replace=False):
            other[k] = f"v{rng.integers(10**6)}"
        a, b = " ".join(words), " ".join(other)
        if lo <= o4.jaccard(o4.shingle_set(a.encode()), o4.shingle_set(b.encode())) < hi:
            pairs.append((len(out), len(out) + 1))
            out += [a, b]
    return out, pairs


def test_groups_are_verified_and_found(spark):
    rng = np.random.default_rng(12)
    near, near_pairs = planted_pairs(rng, 150, 0.8, 0.95)
    far, _ = planted_pairs(rng, 100, 0.55, 0.8)
    rows = list(enumerate(near + far))
    kept = {r["doc_id"] for r in o4.keep_one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(range(len(near), len(rows))) <= kept and {a for a, _ in near_pairs} <= kept
    assert sum(b not in kept for _, b in near_pairs) >= 0.9 * len(near_pairs)


def test_verified_links_connect_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(o4, "VERIFY_ROWS", 7)
    rng = np.random.default_rng(2)
    chain = [f"w{x}" for x in range(120)]
    sets = [o4.shingle_set(" ".join(chain[3 * (i % 20) : 3 * (i % 20) + 60 + i // 20]).encode()) for i in range(60)]
    sets += [o4.shingle_set(" ".join(f"u{x}" for x in rng.integers(0, 9, 40)).encode()) for _ in range(10)]
    rows = [(i, 0 if i < 55 else 1, len(x), bytearray(x.tobytes())) for i, x in enumerate(sets)]
    d = spark.createDataFrame(rows, "id long, component long, size long, shingles binary")
    near = np.array([[o4.jaccard(a, b) >= 0.8 and (i < 55) == (j < 55) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    label = np.arange(len(sets))
    for _ in range(len(sets)):
        label = np.array([label[x].min() for x in near])
    from lexmill.llm.components import connected_components

    links = o4.verified_links(d)
    got = {r["id"]: r["component_id"] for r in connected_components(links).collect()}
    assert [got.get(i, i) for i in range(len(sets))] == label.tolist()
    assert all(label[r["u"]] == label[r["v"]] for r in links.collect()) and len(set(label)) > 3
    assert o4.verified_links(d.limit(0)).count() == 0


def test_html_loses_nothing_by_lists():
    trees = o7.trained()
    para = "The storm came in over the hills on Tuesday and left by the evening, said the keeper of the light."
    more = "Nobody was hurt, but the road to the harbour was closed for two days while the crews cleared it."
    pages = [
        (f"<html><head><title>T</title><article><h1>Storm</h1><p>{para}</p><p>{more}</p></article>", f"Storm {para} {more}"),
        (f"<title>T</title><article><h1>Storm</h1><p>{para}<p>{more}", f"Storm {para} {more}"),
        (f"<html><body><article><p>{para} <button>here <p>{more}</p></article></body></html>", None),
        (f"<html><body><article><p>{para} so <math><mi>x</mi>+<mn>1</mn></math> it was.</p><p>{more}</p></article>", f"{para} so x+1 it was. {more}"),
        (f"<html><body><article><p>{para}</p><select><option>a<option>b<p>{more}</p></article>", None),
        (f"<html><head><meta charset=utf-8><article><p>{para}</p><p>{more}</p></article>", f"{para} {more}"),
        ("<article>" + "<div>" * 3000 + f"<p>{para}</p>" + "</div>" * 3000 + f"<p>{more}</p></article>", None),
    ]
    for page, want in pages:
        got = o7.extract([page], trees)[0]
        assert got == want if want else para in got and more in got, page
    for page in ("<xmp>a <b> c</xmp>", "a<textarea>b<i>c", "<svg><text>t</text></svg>", "<object>o", "<head>x"):
        shown = "".join("".join(o7.Page(page).text).split())
        assert shown == "".join(re.sub(r"<(?!b>)[^>]*>", "", page).split())
    assert o7.extract(["<p>x</p><script>no</script><style>no"], trees)[0] in ("", "x")


def test_html_of_other_styles():
    """Pages written by hand, in styles that the training layouts do not have."""
    trees = o7.trained()
    one = "In the spring of that year the council voted to rebuild the old bridge, which had stood unused since the flood."
    two = "Engineers surveyed both banks, and their report, published in May, recommended a single span of steel and stone."
    three = "Work began in June and went on, with few pauses, until the first frost; the bridge opened on the ninth of December."
    body = f"<p>{one}</p>\n<p>{two}</p>\n<p>{three}</p>"
    links = "".join(f'<li><a href="/{x}">{x.title()}</a></li>' for x in ("home", "news", "sport", "weather", "contact"))
    pages = [
        f'<body><div id="wrapper"><div id="top-nav"><ul>{links}</ul></div><div id="page-content">{body}</div><div id="foot">Copyright 2019 The Gazette. All rights reserved.</div></div>',
        f'<body><nav class="navbar navbar-dark"><ul>{links}</ul></nav><main role="main"><div class="container"><div class="col-md-8">{body}</div><div class="col-md-4 sidebar"><h4>Related</h4><ul>{links}</ul></div></div></main><footer class="mt-auto">&copy; Gazette</footer>',
        f'<body><header role="banner"><a href="/">The Gazette</a></header><section class="story-body">{body}</section><section class="comments-area"><h2>Comments</h2><div class="comment">First! Great read.</div></section>',
        f'<body bgcolor=white><table width=100%><tr><td class=leftnav><ul>{links}</ul></td><td class=maincol>{body}</td></tr></table>',
    ]
    exact = 0
    for page in pages:
        got = o7.extract([page], trees)[0]
        assert one in got and two in got and three in got and "Sport" not in got
        exact += got == f"{one} {two} {three}"
    assert exact >= 3


def test_decoding_is_the_optimum():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 9))
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        z = rng.standard_normal(n) * 3
        worth = lambda keep: sum(-np.logaddexp(0, -x if k else x) for x, k in zip(z, keep))  # noqa: B023, E731
        allowed = [k for k in itertools.product((False, True), repeat=n) if all(k[parent[i]] or not k[i] for i in range(1, n))]
        assert worth(o7.decode(parent, z)) == pytest.approx(max(map(worth, allowed)))


def test_html_tables(spark):
    d = spark.createDataFrame([(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (None, None, None)], "page_id long, url string, html string")
    assert [r["n_chars"] == len(r["text"]) for r in o7.main_text(d).collect()] == [True] * 3 and o7.main_text(d.limit(0)).count() == 0


def test_runs_are_joined_where_they_lie(spark):
    runs = o2.LineRuns(spark, fan=4)
    keys = "h1 long, h2 long, n_docs long, top_doc long"
    for b in range(3):
        runs.add(spark.createDataFrame([(k, k, 1, b) for k in range(10 * b, 10 * b + 20)], keys))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = runs.told(spark.createDataFrame([(k, k, 1, 9) for k in range(60)], keys))
        assert sorted((r["h1"], r["held"]) for r in fresh.collect()) == [(k, k < 40) for k in range(60)]
        plan = fresh._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = [(len(x) - len(x.lstrip(" :+-*")), x) for x in plan.splitlines()]
    scans = [i for i, (_, x) in enumerate(lines) if "FileScan" in x and "line_run" in x]
    for i in scans:  # what lies between a run's scan and the join above it
        depth = lines[i][0]
        for d, x in reversed(lines[:i]):
            if d < depth:
                depth = d
                assert "Exchange" not in x
                if "Join" in x:
                    break
    assert "SortMergeJoin" in plan and len(scans) >= 3
    homes = [r.where("not held").count() for r in runs.runs()]
    assert homes == [20, 10, 10]


def test_runs_outlive_a_call(spark):
    rows = [(i, f"{LINE} {i % 3}\nown line of document {i}") for i in range(12)]
    whole = {r["doc_id"]: r["n_dropped"] for r in o2.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    runs = o2.LineRuns(spark, buckets=3)
    first = o2.dedup_lines(spark.createDataFrame(rows[:6], "doc_id long, text string"), runs=runs).collect()
    assert sum(r["n_dropped"] for r in first) == 0
    runs = o2.LineRuns.restore(spark, runs.state())
    later = {r["doc_id"]: r["n_dropped"] for r in o2.dedup_lines(spark.createDataFrame(rows[6:], "doc_id long, text string"), runs=runs).collect()}
    assert later == {i: whole[i] for i in range(6, 12)}
    assert {(r["top_doc"]) for r in runs.repeated(4).collect()} == {9, 10, 11}
    runs.drop()


def test_lines_of_many_rows_with_a_null_id(spark):
    rows = [(None, f"{LINE} {i % 40}\nx{i}") for i in range(400)] + [(1, f"{LINE} {i}") for i in range(40)] + [(2, f"{LINE} 3")]
    got = o2.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_dropped"] for r in got if r["doc_id"] is None) == 10 and sum(r["n_dropped"] for r in got if r["doc_id"] == 1) == 1


def test_embeddings_of_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [1.0, 0.01, 0.0, 0.0]
    rows = [(5, a), (5, b), (6, c), (None, b), (None, a), (None, [0.0, 0.0, 0.0, 1.0])]
    for kind in ("float", "double"):
        d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
        got = sorted((tuple(r) for r in o1.near_duplicates(d).collect()), key=str)
        want = [(5, 2, 5, True), (5, 1, 5, True), (6, 2, 5, False), (None, 1, 5, False), (None, 2, 5, False), (None, 0, None, True)]
        assert got == sorted(want, key=str)


def test_language_of_marks_and_rare_languages(spark):
    en, fr, xx = "the quick brown fox and the lazy dog", "le renard brun et le chien paresseux", "zqo vuk wrizq oqav"
    d = spark.createDataFrame([(i, en if i % 2 else fr, "en" if i % 2 else "fr") for i in range(4000)] + [(9000 + i, xx, "xx") for i in range(3)], "id long, text string, lang string")
    m = o8.fit(d, max_train=50)
    assert m.langs == ["en", "fr", "xx"]
    assert [x[0] for x in o8.identify(["\u0301\u0302", "\u0301 \u0300 1", en + " \u0301", xx, "e\u0301te\u0301"], m)][:4] == ["und", "und", "en", "xx"]
    w = o8.words_of(["\u0301a\u0301\u0302b \u0301"])
    assert w.letters.tolist() == [4]


def test_rules_of_repeated_ids_and_empty_labels(spark):
    rng = np.random.default_rng(0)
    clean = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 40)) for _ in range(120)]
    rows = [(i, t if i % 2 else " ".join(w + "###" for w in t.split())) for i, t in enumerate(clean)]
    d = spark.createDataFrame(rows + rows * 2 + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 0), (7, None)], "doc_id long, quality int")
    once = o9.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert once and [str(r) for r in o9.fit(d, labels, max_rows=200)] == [str(r) for r in once]
    assert o9.fit(d, labels.limit(0)) == [] == o9.fit(d.limit(0), labels)
    kept = {r["doc_id"]: r["kept"] for r in o9.judge(d.where("text is not null"), once).collect()}
    assert all(kept[i] == bool(i % 2) for i in range(120))


def unigram_model(pieces):
    """A unigram model with byte fallback as the sentencepiece library reads it, of (piece, score)."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    msg = lambda n, body: varint(n << 3 | 2) + varint(len(body)) + body
    flag = lambda n, x: varint(n << 3) + varint(x)
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in pieces)]
    body = b"".join(msg(1, msg(1, p.encode()) + b"\x15" + struct.pack("<f", s) + flag(3, k)) for p, s, k in rows)
    trainer = flag(3, 1) + flag(4, len(rows)) + flag(35, 1)
    return body + msg(2, trainer) + msg(3, msg(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))


def test_unigram_of_thousands_of_pieces_equals_the_library(tmp_path):
    counts = collections.Counter()
    rng = np.random.default_rng(6)
    syllables = ["ka", "to", "mi", "ser", "an", "é", "que", "th", "ing", "o", "ä", "sch"]
    words = ["".join(rng.choice(syllables, int(rng.integers(1, 5)))) for _ in range(3000)]
    for w in words:
        w = "▁" + w
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + 9) + 1):
                counts[w[i:j]] += 1
    top = counts.most_common(4000)
    total = sum(n for _, n in top)
    path = tmp_path / "unigram.model"
    path.write_bytes(unigram_model([(p, float(np.log(n / total)) - 1e-4 * i) for i, (p, n) in enumerate(top)]))
    odd = [" ".join(rng.choice(words, 60)) for _ in range(200)] + ["", " ", "kato  misering ", "日本語 ka😀to", "x\ny", "\u0000ka", *[t for t in texts() if t]]
    m = o10.parse_model(path.read_bytes())
    assert m.kind == o10.UNIGRAM and m.byte_fallback and len(m.pieces) == 4259
    assert o10.sentencepiece_parity(odd, str(path)) == []
    ids = o10.encode_batch(path.read_bytes(), odd)
    assert o10.decode_batch(path.read_bytes(), ids) == odd


def test_tokens_query(spark, tmp_path):
    d = frame(spark, texts() + texts())
    d.write.parquet(f"{tmp_path}/documents.parquet")
    data = o10.read_model(o10.default_model_path())
    for r in o10.query(spark, str(tmp_path)).collect():
        t = (texts() + texts())[r["doc_id"]] or ""
        ids = o10.encode_batch(data, [t])[0]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["round_trip"]) == (len(ids), o10.digest(ids), hashlib.sha256(t.encode()).hexdigest(), True)
        assert r["parity"] in (None, True)
    checked = [r["parity"] for r in o10.encode(d, verify_every=1).collect() if r["text"] is not None]
    assert checked and all(checked)


def test_tokens_query_checks_every_text(spark, tmp_path):
    frame(spark, texts()).write.parquet(f"{tmp_path}/documents.parquet")
    parity = {r["doc_id"]: r["parity"] for r in o10.query(spark, str(tmp_path)).collect()}
    assert parity == {i: None if t is None else True for i, t in enumerate(texts())}


def test_words_go_to_the_library_once_and_ids_are_those_of_whole_texts(monkeypatch):
    data = o10.read_model(o10.default_model_path())
    odd = [x or "" for x in texts()] + ["", " ", "  a  b ", "a▁b ▁ c", "日本語 テスト", " " * 70 + "x", "a\r\nb\n\nc", "\u0000ka 😀 a\u0301", "x" * 300]
    limits = (o10.WORDS_CHARS, 50)
    for model in (data, data + bytes([3 << 3 | 2, 2, 4 << 3, 1])):  # the second drops extra white space
        t, words, sent = o10._tokenizer(model), o10.Words(model), []
        library = words.model.encode_batch_fast
        monkeypatch.setattr(words, "model", types.SimpleNamespace(encode_batch_fast=lambda x, **k: sent.extend(x) or library(x, **k)))
        whole = [t.encode(x, add_special_tokens=False).ids if x else [] for x in odd]
        for limit in limits:
            monkeypatch.setattr(o10, "WORDS_CHARS", limit)
            for part in (odd, odd[::-1], odd[:3]):
                ids, ends = words.encode(part)
                assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [whole[odd.index(x)] for x in part]
            assert limit == 50 or len(sent) == len(set(sent)) == len(words.number)
        assert max(map(len, sent)) >= 300 and len(sent) > len(set(sent))
    byte, mark = {b: o10._library(data).piece_to_id(f"<0x{b:02X}>") for b in range(256)}, o10._library(data).piece_to_id(o10.MARK)
    assert o10.decode_batch(data, [[mark, mark, byte[65]], [byte[b] for b in "▁a".encode()], [byte[0xE2], mark], []]) == [" A", "▁a", "\ufffd ", ""]
    ids, ends = o10.Words(data).encode(["", ""])
    assert len(ids) == 0 and ends.tolist() == [0, 0, 0] and o10.encode_batch(data, []) == []


def test_packed_leaves_keep_order_and_numbers():
    rng = np.random.default_rng(3)
    doc = np.array([-(1 << 63), -5, -1, 0, 1, 255, 256, 1 << 40, (1 << 63) - 1])
    pos = np.array([0, 63, 64, 16_383, 16_384, (1 << 22) - 1, 1 << 22, (1 << 30) - 1])
    rows = [(int(t), s, int(d), int(h), int(p)) for t, s in ((2, b"\x00" * 13), (3, b"\x00" * 13), (2, b"\xc8\x00" * 13)) for d in doc for h in (-(1 << 63), 0, 7) for p in pos]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    t, s, d, h, p = zip(*rows)
    for th in (np.array(h), None):
        packed = o5.packed_leaves(np.array(t, np.uint64), pa.array(s, pa.binary()), np.array(d), th, np.array(p))
        key, odd, d2, h2, p2 = o5.unpacked_leaves(packed.slice(5), th is not None)
        assert [k[o5.TAG :] for k in key.to_pylist()] == list(s[5:]) and odd.tolist() == [x == 3 for x in t[5:]]
        assert o5.without_tag(key, np.arange(3, len(key), 2)).to_pylist() == list(s[8::2]) and len(o5.without_tag(key, np.zeros(0, np.int64))) == 0
        assert d2.tolist() == list(d[5:]) and p2.tolist() == list(p[5:]) and (h2 is None or h2.tolist() == list(h[5:]))
        whole = rows if th is not None else [(a, b, c, 0, e) for a, b, c, _, e in rows]
        assert [whole[i] for i in np.argsort(np.array(packed.to_pylist(), object), kind="stable")] == sorted(whole)
    assert len(o5.packed_leaves(np.zeros(1, np.uint64), pa.array([b"x" * 24], pa.binary()), np.array([200_000]), None, np.array([300]))[0].as_py()) == 34
    assert len(o5.packed_leaves(np.zeros(0, np.uint64), pa.array([], pa.binary()), np.zeros(0, np.int64), None, np.zeros(0, np.int64))) == 0


def test_substrings_leave_no_shuffles_of_suffixes(spark):
    rows = [(i, " ".join(f"own{i}x{k}" for k in range(400)) + f" {PASSAGE}") for i in range(300)]
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    sizes = lambda: sum(f.length() for f in (x for x in (manager.getAllFiles().apply(i) for i in range(manager.getAllFiles().size()))) if "shuffle_" in f.getName())
    d = spark.createDataFrame(rows, "doc_id long, text string")
    before = sizes()
    assert d.count() == 300 and o5.repeated_windows(o5._keyed(d, "doc_id", "text"), one_text_a_doc=True).count() == 299 * 18
    assert sizes() - before < 100_000
