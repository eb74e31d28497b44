"""Registered queries of the index and the term, phrase and vector providers, over the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index as I
from lexmill.operators import lexical as L
from lexmill.operators import snippets as S
from lexmill.operators import vector as V
from lexmill.plans.registry import query, table

_STOPS = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
WORDS_SQL = "regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z''-]+')"
TERM_SQL = f"length(w) >= 3 AND w NOT IN ({_STOPS})"
TOK = f"""tok AS (SELECT doc_id, list_filter({WORDS_SQL}, lambda w: {TERM_SQL}) AS ts FROM documents),
occ AS (SELECT doc_id, unnest(ts) AS term FROM tok),
vocab AS (SELECT term, count(DISTINCT doc_id) AS df FROM occ GROUP BY term),
n AS (SELECT count(*) AS n FROM documents)"""
POS = f"""posn AS (SELECT doc_id, unnest(range(len({WORDS_SQL}))) AS pos, unnest({WORDS_SQL}) AS w FROM documents)"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
QUERY_WORDS = ["bleing", "eaesth"]
PHRASE = L.phrase_of("eriner thanea")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("vocab_stats", f"WITH {TOK} SELECT count(*) AS terms, sum(CASE WHEN df = 1 THEN 1 ELSE 0 END)::BIGINT AS singletons, sum(df)::BIGINT AS postings, max(df) AS max_df FROM vocab")
def vocab_stats(spark, d):
    v = I.document_frequency(docs(spark, d))
    return v.agg(F.count("*").alias("terms"), F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).alias("singletons"), F.sum("df").alias("postings"), F.max("df").alias("max_df"))


@query("vocabulary", f"WITH {TOK} SELECT term, df FROM vocab")
def vocabulary(spark, d):
    return I.document_frequency(docs(spark, d))


@query("postings", f"WITH {TOK} SELECT doc_id AS doc, term, count(*) AS tf FROM occ GROUP BY ALL")
def postings(spark, d):
    return I.postings(docs(spark, d))


@query("term_positions", f"WITH {POS} SELECT doc_id AS doc, pos::INT AS pos, w AS term FROM posn WHERE {TERM_SQL}")
def term_positions(spark, d):
    return I.positions(docs(spark, d))


@query("delta_positions", f"""WITH {POS}, g AS (SELECT doc_id AS doc, w AS term, list(pos ORDER BY pos) AS ps FROM posn WHERE {TERM_SQL} GROUP BY ALL)
SELECT doc, term, array_to_string(list_transform(ps, lambda x, i: CASE WHEN i = 1 THEN x ELSE x - ps[i - 1] END), ' ') AS runs FROM g""")
def delta_positions(spark, d):
    return I.delta_encoded(I.positions(docs(spark, d))).select("doc", "term", F.array_join("runs", " ").alias("runs"))


@query("doc_lengths", f"SELECT doc_id AS doc, len({WORDS_SQL}) AS dl FROM documents")
def doc_lengths(spark, d):
    return I.lengths(docs(spark, d))


_PASSAGES = """line AS (SELECT doc_id AS doc, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
pass AS (SELECT doc, unnest(range(len(ls)))::INT AS passage, unnest(ls) AS body FROM line),
counted AS (SELECT *, len(regexp_extract_all(lower(body), '[a-z][a-z''-]+')) AS n_words FROM pass),
started AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY doc ORDER BY passage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM counted)"""


@query("passages_lines", f"WITH {_PASSAGES} SELECT doc, passage, body, n_words, start FROM started")
def passages_lines(spark, d):
    return I.line_passages(docs(spark, d)).select("doc", "passage", "body", "n_words", "start")


def _score_sql(extra: str = "") -> str:
    return f"""WITH {TOK}, q AS (SELECT unnest(['bleing', 'eaesth']) AS token),
m AS (SELECT token, term, df, term = token AS exact, row_number() OVER (PARTITION BY token ORDER BY term) AS rk FROM q JOIN vocab ON starts_with(term, token) QUALIFY rk <= 120),
h AS (SELECT DISTINCT doc_id AS doc, token, o.term, exact, ln(1 + n.n / greatest(df, 1)) * CASE WHEN exact THEN 1.0 ELSE 0.55 END AS s FROM occ o JOIN m USING (term), n),
r AS (SELECT doc, round(sum(s), 6) AS score, bool_or(exact) AS named FROM h GROUP BY doc) {extra}"""


@query("lex_tfidf", _score_sql("SELECT * FROM r"))
def lex_tfidf(spark, d):
    return L.lexical(docs(spark, d), QUERY_WORDS).groupBy("doc").agg(F.round(F.sum("score"), 6).alias("score"), F.bool_or("exact").alias("named"))


@query("lex_named_tier", _score_sql("SELECT * FROM r ORDER BY named DESC, score DESC, doc LIMIT 24"))
def lex_named_tier(spark, d):
    return lex_tfidf(spark, d).orderBy(F.desc("named"), F.desc("score"), "doc").limit(24)


@query("lex_reasons", _score_sql("""SELECT doc, array_to_string(list_slice(list(DISTINCT CASE WHEN exact THEN 'term: "' ELSE 'prefix: "' END || token || '"'
 ORDER BY CASE WHEN exact THEN 'term: "' ELSE 'prefix: "' END || token || '"'), 1, 6), ', ') AS why FROM h GROUP BY doc"""))
def lex_reasons(spark, d):
    label = F.concat(F.when(F.col("exact"), F.lit('term: "')).otherwise(F.lit('prefix: "')), F.col("token"), F.lit('"'))
    g = L.lexical(docs(spark, d), QUERY_WORDS).select("doc", label.alias("label")).groupBy("doc").agg(F.collect_set(F.struct(F.col("label").alias("ord"), "label")).alias("ls"))
    return g.select("doc", F.array_join(S.reasons(F.col("ls")), ", ").alias("why"))


@query("lex_prefix_capped", f"""WITH {TOK}, q AS (SELECT unnest(['ther', 'ation']) AS token)
SELECT token, term, df, term = token AS exact, count(*) OVER (PARTITION BY token) > 120 AS capped FROM q JOIN vocab ON starts_with(term, token)
QUALIFY row_number() OVER (PARTITION BY token ORDER BY term) <= 120""")
def lex_prefix_capped(spark, d):
    return L.prefix_matches(I.document_frequency(docs(spark, d)), ["ther", "ation"])


_PAGES_STRONG = f"""SELECT page_id, list_distinct(list_filter(regexp_extract_all(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[a-z][a-z''-]+'), lambda w: {TERM_SQL})) AS st,
list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '[a-z][a-z''-]+'), lambda w: {TERM_SQL})) AS ts FROM pages"""


@query("lex_strong_boost", f"""WITH p AS ({_PAGES_STRONG}), o AS (SELECT page_id, st, unnest(ts) AS term FROM p), v AS (SELECT term, count(*) AS df FROM o GROUP BY term), n AS (SELECT count(*) AS n FROM pages)
SELECT page_id AS doc, round(sum(ln(1 + n.n / greatest(df, 1)) * CASE WHEN list_contains(st, term) THEN 2.6 ELSE 1.0 END), 6) AS score
FROM o JOIN v USING (term), n WHERE term IN ('thereou', 'tionhave', 'enheit', 'article', 'menttion') OR starts_with(term, 'thenan') GROUP BY page_id""")
def lex_strong_boost(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    strong = p.select(F.col("page_id").alias("doc"), F.explode(T.distinct_terms(F.col("title"))).alias("term"))
    own = p.select(F.col("page_id").alias("doc"), F.explode(T.distinct_terms(F.col("text"))).alias("term")).where(F.col("term").isin("thereou", "tionhave", "enheit", "article", "menttion") | F.col("term").startswith("thenan"))
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    n = p.agg(F.count("*").alias("n"))
    h = own.join(df, "term").join(strong.withColumn("strong", F.lit(True)), ["doc", "term"], "left").crossJoin(F.broadcast(n))
    return h.groupBy("doc").agg(F.round(F.sum(L.idf(F.col("n"), F.col("df")) * F.when(F.col("strong"), L.STRONG_BOOST).otherwise(1.0)), 6).alias("score"))


_BM25 = f"""WITH {TOK}, len AS (SELECT doc_id, len({WORDS_SQL}) AS dl FROM documents), avgl AS (SELECT avg(dl) AS a FROM len),
t AS (SELECT doc_id, term, least(count(*), 64) AS tf FROM occ WHERE term IN ('bleing', 'eaesth') GROUP BY ALL),
s AS (SELECT t.doc_id AS doc, sum(ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (CASE WHEN dl = 0 THEN a ELSE dl END) / a))) AS s
FROM t JOIN vocab USING (term) JOIN len USING (doc_id), n, avgl GROUP BY t.doc_id) SELECT doc, round(s, 6) AS score FROM s"""


@query("lex_bm25", _BM25)
def lex_bm25(spark, d):
    return L.bm25(docs(spark, d), QUERY_WORDS).groupBy("doc").agg(F.round(F.sum("score"), 6).alias("score"))


@query("bm25_ranked", _BM25 + " ORDER BY score DESC, doc LIMIT 24")
def bm25_ranked(spark, d):
    return lex_bm25(spark, d).orderBy(F.desc("score"), "doc").limit(24)


@query("facet_filter", "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'")
def facet_filter(spark, d):
    return docs(spark, d).where((F.col("source") == "src3") & (F.col("lang") == "en")).select("doc_id", "source", "lang")


@query("facet_values", "SELECT source, min(doc_id) AS first_doc, count(*) AS n, count(DISTINCT lang) AS kinds FROM documents GROUP BY source")
def facet_values(spark, d):
    return docs(spark, d).groupBy("source").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.countDistinct("lang").alias("kinds"))


_PHRASE_SQL = f"{POS}, hits AS (SELECT a.doc_id AS doc, min(a.pos)::INT AS place FROM posn a JOIN posn b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.w = 'eriner' AND b.w = 'thanea' GROUP BY a.doc_id)"


@query("phrase_match", f"WITH {_PHRASE_SQL} SELECT doc, place FROM hits")
def phrase_match(spark, d):
    return L.phrase_hits(docs(spark, d), PHRASE)


@query("phrase_filter_score", f"""WITH {_PHRASE_SQL}, {TOK}
SELECT doc, place, round((SELECT sum(ln(1 + n.n / greatest(df, 1))) FROM vocab, n WHERE term IN ('eriner', 'thanea')), 6) AS score, 'phrase: "eriner thanea"' AS why FROM hits""")
def phrase_filter_score(spark, d):
    df = I.document_frequency(docs(spark, d)).where(F.col("term").isin(list(PHRASE.words)))
    n = docs(spark, d).agg(F.count("*").alias("n"))
    total = df.crossJoin(F.broadcast(n)).agg(F.round(F.sum(L.idf(F.col("n"), F.col("df"))), 6).alias("score"))
    return L.phrase_hits(docs(spark, d), PHRASE).crossJoin(F.broadcast(total)).withColumn("why", F.lit('phrase: "eriner thanea"'))


@query("passage_asof", f"""WITH {_PHRASE_SQL}, {_PASSAGES}
SELECT h.doc, h.place, s.start, s.passage FROM hits h JOIN started s ON h.doc = s.doc AND s.start <= h.place
QUALIFY row_number() OVER (PARTITION BY h.doc ORDER BY s.start DESC, s.passage DESC) = 1""")
def passage_asof(spark, d):
    return S.passage_at(I.line_passages(docs(spark, d)), phrase_match(spark, d)).select("doc", "place", "start", "passage")


@query("snippet_window", """WITH f AS (SELECT doc_id, coalesce(text, '') AS t, instr(lower(coalesce(text, '')), 'bleing') AS p FROM documents), w AS (SELECT *, greatest(1, p - 110) AS s FROM f)
SELECT doc_id, CASE WHEN length(t) <= 300 THEN t ELSE (CASE WHEN s > 1 THEN '…' ELSE '' END) || substring(t, s, 280) || (CASE WHEN s + 279 < length(t) THEN '…' ELSE '' END) END AS snippet FROM w WHERE p > 0""")
def snippet_window(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    at = S.first_place(t, "bleing")
    return docs(spark, d).where(at > 0).select("doc_id", S.window(t, at).alias("snippet"))


@query("snippet_fallback", """WITH f AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS head, coalesce(text, '') AS t FROM documents), b AS (SELECT doc_id, CASE WHEN contains(lower(head), 'bleing') THEN head ELSE t END AS t FROM f),
w AS (SELECT *, greatest(1, instr(lower(t), 'bleing') - 90) AS s FROM b)
SELECT doc_id, CASE WHEN length(t) <= 260 THEN t ELSE (CASE WHEN s > 1 THEN '…' ELSE '' END) || substring(t, s, 250) || (CASE WHEN s + 249 < length(t) THEN '…' ELSE '' END) END AS snippet FROM w""")
def snippet_fallback(spark, d):
    head = F.split(F.coalesce("text", F.lit("")), "\n")[0]
    body = F.when(F.contains(F.lower(head), F.lit("bleing")), head).otherwise(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", body.alias("t")).select("doc_id", S.window(F.col("t"), S.first_place(F.col("t"), "bleing"), S.FALLBACK_LONG, S.FALLBACK_LEAD, S.FALLBACK_WINDOW).alias("snippet"))


@query("mark_words", r"SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '\b((?:eaesth|bleing)[a-z''-]*)', '<mark>\1</mark>', 'gi')) AS marked FROM documents")
def mark_words(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.mark(F.coalesce("text", F.lit("")), QUERY_WORDS).cast("binary"), 256).alias("marked"))


@query("match_count", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '(?i)\b(?:eaesth|bleing)[a-z''-]*')) AS n FROM documents")
def match_count(spark, d):
    return docs(spark, d).select("doc_id", T.mark_count(F.coalesce("text", F.lit("")), QUERY_WORDS).cast("long").alias("n"))


@query("complete_prefix", f"""WITH {TOK}, c AS (SELECT term, row_number() OVER (ORDER BY term) AS rank FROM vocab WHERE starts_with(term, 'ther'))
SELECT term, rank::INT AS rank, (SELECT count(*) FROM c) > 8 AS capped FROM c WHERE rank <= 8""")
def complete_prefix(spark, d):
    return L.completions(I.vocabulary(docs(spark, d)), "ther")


@query("fuzzy_osa_k1", f"WITH {TOK} SELECT 'ailele' AS q, 1 AS k, term, damerau_levenshtein('ailele', term)::INT AS distance FROM vocab WHERE abs(length(term) - 6) <= 1 AND damerau_levenshtein('ailele', term) <= 1")
def fuzzy_osa_k1(spark, d):
    return L.fuzzy_terms(I.vocabulary(docs(spark, d)), [("ailele", 1)])


@query("fuzzy_osa_k2")
def fuzzy_osa_k2(spark, d):
    return L.fuzzy_terms(I.document_frequency(docs(spark, d)), [("ailele", 2), ("aiemnt", 2)])


@query("fuzzy_scores", f"""WITH {TOK}, m AS (SELECT term, df, damerau_levenshtein('ailele', term) AS dist FROM vocab WHERE abs(length(term) - 6) <= 1 AND damerau_levenshtein('ailele', term) <= 1)
SELECT doc_id AS doc, round(sum(ln(1 + n.n / greatest(df, 1)) * (1 - dist / 7.0)), 6) AS score FROM (SELECT DISTINCT doc_id, term FROM occ) JOIN m USING (term), n GROUP BY doc_id""")
def fuzzy_scores(spark, d):
    m = L.fuzzy_terms(I.document_frequency(docs(spark, d)), [("ailele", 1)])
    n = docs(spark, d).agg(F.count("*").alias("n"))
    own = docs(spark, d).select(F.col("doc_id").alias("doc"), F.explode(T.distinct_terms(F.col("text"))).alias("term"))
    h = own.join(F.broadcast(m), "term").crossJoin(F.broadcast(n))  # m: FUZZY_CAP rows at most
    return h.groupBy("doc").agg(F.round(F.sum(L.idf(F.col("n"), F.col("df")) * (1 - F.col("distance") / (F.length("q") + 1))), 6).alias("score"))


@query("suggest", f"""WITH {TOK}, q AS (SELECT unnest(['blieng', 'eaestx']) AS q)
SELECT q, arg_min(term, {{'d': damerau_levenshtein(q, term), 't': term}}) AS term, min(damerau_levenshtein(q, term))::INT AS distance FROM q, vocab WHERE damerau_levenshtein(q, term) <= 1 GROUP BY q""")
def suggest(spark, d):
    return L.suggestion(I.vocabulary(docs(spark, d)), ["blieng", "eaestx"])


@query("pattern_match", f"WITH {TOK} SELECT term, df FROM vocab WHERE regexp_matches(term, '^(?:ble(?:in|an)+g?|ther.*ing)$') ORDER BY term LIMIT 120")
def pattern_match(spark, d):
    return L.pattern_terms(I.document_frequency(docs(spark, d)), "^ble(in|an)+g?|ther.*ing$")


@query("nearest_slug", """WITH q AS (SELECT unnest(['gren', 'alomnd', 'blue']) AS q), n AS (SELECT DISTINCT lower(p_name) AS name FROM part),
m AS (SELECT q, name, list_min(list_transform(range(greatest(1, length(q) - 2), greatest(1, least(length(name), length(q) + 2)) + 1), lambda k: levenshtein(q, left(name, k)))) AS d FROM q, n)
SELECT q, arg_min(name, {'d': d, 'n': name}) AS name, min(d)::INT AS distance FROM m GROUP BY q HAVING min(d) <= greatest(1, length(q) // 3)""")
def nearest_slug(spark, d):
    return L.nearest_prefix(table(spark, d, "part"), "p_name", ["gren", "alomnd", "blue"])


@query("nearest_command", "WITH c AS (SELECT unnest(['search','list','open','help','clear','theme','home','back','series','works','random']) AS name), q AS (SELECT unnest(['serch','hlep','lst']) AS q) SELECT q, arg_min(name, {'d': levenshtein(q, name), 'n': name}) AS name, min(levenshtein(q, name))::INT AS distance FROM q, c GROUP BY q")
def nearest_command(spark, d):
    names = spark.createDataFrame([(x,) for x in ("search", "list", "open", "help", "clear", "theme", "home", "back", "series", "works", "random")], "name string")
    j = names.withColumn("q", F.explode(L.literal_rows(["serch", "hlep", "lst"]))).withColumn("distance", F.levenshtein("q", "name"))
    return j.groupBy("q").agg(F.min(F.struct("distance", "name")).alias("m")).select("q", "m.name", "m.distance")


@query("vec_project", f"WITH {TOK}, h AS (SELECT term, {FNV} AS hash FROM vocab) SELECT term, hash, (hash % 160)::INT AS dim, CASE WHEN hash >= 2147483648 THEN -1 ELSE 1 END AS sign FROM h")
def vec_project(spark, d):
    t = F.col("term")
    return I.vocabulary(docs(spark, d)).select("term", T.fnv1a(t).alias("hash"), T.dimension(t).alias("dim"), T.sign(t).alias("sign"))


_VEC = f"""{TOK}, tfs AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL), hs AS (SELECT term, df, {FNV} AS hash FROM vocab),
v AS (SELECT doc_id AS doc, (hash % 160)::INT AS dim, sum((CASE WHEN hash >= 2147483648 THEN -1 ELSE 1 END) * (1 + ln(tf)) * ln(1 + n.n / greatest(df, 1))) AS v FROM tfs JOIN hs USING (term), n GROUP BY ALL)"""


@query("vec_tfidf", f"WITH {_VEC} SELECT doc, dim, round(v, 6) AS v FROM v")
def vec_tfidf(spark, d):
    return I.vectors(docs(spark, d)).select("doc", "dim", F.round("v", 6).alias("v"))


@query("vec_quantise", f"WITH {_VEC}, l AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY doc)) AS len FROM v) SELECT doc, dim, greatest(-127, least(127, floor(v / (CASE WHEN len = 0 THEN 1 ELSE len END) * 127 + 0.5)))::INT AS q FROM l")
def vec_quantise(spark, d):
    return I.quantised(I.vectors(docs(spark, d)))


@query("vec_cosine_floor", """WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id IN (0, 1, 2)), s AS (SELECT q, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv) AS s FROM embeddings, q)
SELECT q, id, round(s, 6) AS score FROM s WHERE s > 0 QUALIFY s >= 0.34 * max(s) OVER (PARTITION BY q)""")
def vec_cosine_floor(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    q = e.where(F.col("id").isin(0, 1, 2)).select(F.col("id").alias("q"), F.col("v").alias("qv"))
    return V.similar(e, F.broadcast(q)).select("q", "id", F.round("score", 6).alias("score"))  # three stated query vectors


@query("vec_cosine_floor_all", """WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q, vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], qv) AS s FROM embeddings, q)
SELECT q, id, round(s, 6) AS score FROM s WHERE s > 0 QUALIFY s >= 0.34 * max(s) OVER (PARTITION BY q)""")
def vec_cosine_floor_all(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = e.where(F.col("id") % 20 == 0).select(F.col("id").alias("q"), "v")
    return V.similar_in_blocks(e, q).select("q", "id", F.round("score", 6).alias("score"))


@query("preview_hits", """WITH p AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) || ' ' || lower(url) AS hay FROM pages)
SELECT page_id, contains(hay, 'the')::INT + contains(hay, 'ing')::INT + contains(hay, 'example')::INT AS n FROM p ORDER BY n DESC, page_id LIMIT 3""")
def preview_hits(spark, d):
    hay = F.concat_ws(" ", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lower("url"))
    p = table(spark, d, "pages").select("page_id", hay.alias("hay"))
    return p.select("page_id", F.size(F.filter(L.literal_rows(["the", "ing", "example"]), lambda w: F.contains(F.col("hay"), w))).alias("n")).orderBy(F.desc("n"), "page_id").limit(3)


@query("page_resolve", """WITH p AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS slug, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages), q AS (SELECT unnest(['m.ththth.example.net', 'thth', 'thereal']) AS q),
r AS (SELECT q, page_id, slug, CASE WHEN slug = q THEN 1 WHEN starts_with(slug, q) THEN 2 WHEN contains(title, q) THEN 3 END AS rule FROM p, q)
SELECT q, rule, page_id, slug FROM r WHERE rule IS NOT NULL QUALIFY row_number() OVER (PARTITION BY q ORDER BY rule, page_id) = 1""")
def page_resolve(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)", 1).alias("slug"), F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))
    r = p.withColumn("q", F.explode(L.literal_rows(["m.ththth.example.net", "thth", "thereal"])))
    r = r.withColumn("rule", F.when(F.col("slug") == F.col("q"), 1).when(F.startswith("slug", "q"), 2).when(F.contains("title", F.col("q")), 3)).where("rule is not null")
    return r.groupBy("q").agg(F.min(F.struct("rule", "page_id", "slug")).alias("m")).select("q", "m.rule", "m.page_id", "m.slug")


@query("incremental_anti", "SELECT doc_id, left(sha256(coalesce(source, '') || chr(0) || coalesce(text, '')), 16) AS key FROM documents WHERE doc_id % 10 = 3 OR source IS NULL")
def incremental_anti(spark, d):
    """Rows whose stored key differs: as if the run before had held all but the ids that end in 3."""
    now = docs(spark, d).select("doc_id", "source", T.content_key(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("key"))
    before = now.select("doc_id", F.when((F.col("doc_id") % 10 == 3) | F.col("source").isNull(), "").otherwise(F.col("key")).alias("key"))
    return now.join(before, ["doc_id", "key"], "left_anti").select("doc_id", "key")
