"""The search plan: a query string parsed on the driver, then one lazy plan that fuses three providers and explains.

Words, prefixes, "phrases", ~approximate words (one tilde an edit) and a whole query in /slashes/ as a pattern; facets
filter documents before seeding and at the end. Lexical and vector scores are normalised by their maxima and weighed,
the best seeds feed the rules of the graph, and rows are ranked named first, then by score, then by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import datalog as D
from lexmill.operators import index as I
from lexmill.operators import lexical as L
from lexmill.operators import snippets as S

# Fixed values of fusion and caps.
W_LEX, W_VEC, W_GRAPH = 0.62, 0.38, 0.35
SEEDS, RESULTS, GRAPH_ONLY, THIN = 6, 24, 12, 2

#: What a query without rows is told, by its leading part.
EMPTY = {
    "pattern": "No word matches this pattern, or no document holds one that does.",
    "phrase": "No document has these words side by side in this order.",
    "words": "No document answers to these words.",
    "approximate": "No known word is near a marked one; a second tilde allows two edits.",
    "empty": "Type a word to search for.",
}


@dataclass(frozen=True)
class Spec:
    """A parsed query."""

    tokens: tuple[str, ...] = ()
    phrases: tuple[L.Phrase, ...] = ()
    fuzzy: tuple[tuple[str, int], ...] = ()
    pattern: str | None = None

    @property
    def empty(self) -> bool:
        return not (self.tokens or self.phrases or self.fuzzy or self.pattern)


def parse(q: str) -> Spec:
    """Phrases, approximate words and words of a query; a query wholly in slashes is one pattern.

    The text of a phrase is taken out wherever it stands, with letters that adjoin it, before words are read.
    """
    bare = q.strip()
    if len(bare) > 1 and bare.startswith("/") and bare.endswith("/"):
        L.translate_pattern(bare[1:-1])
        return Spec(pattern=bare[1:-1])
    quoted = [L.phrase_of(t) for t in re.findall(r'"([^"]+)"', q)]
    rest = q.lower()
    for p in quoted:
        rest = re.sub(r"[a-z'-]*" + re.escape(p.text.lower()) + r"[a-z'-]*", " ", rest)
    rest = rest.replace('"', " ")
    keep = lambda w: len(w) >= T.MIN_TERM and w not in T.STOP_WORDS
    fuzzy = tuple((w, len(t)) for t, w in re.findall(r"(~{1,2})([a-z][a-z'-]*)", rest) if keep(w))
    words = re.findall(T.TOKEN, re.sub(r"~{1,2}[a-z][a-z'-]*", " ", rest))
    return Spec(tuple(dict.fromkeys(w for w in words if keep(w))), tuple(p for p in quoted if p.seq), fuzzy)


def label(spec: Spec, most: int = 6, long: int = 46) -> str:
    """What a result page calls the query: its words and phrases."""
    if spec.pattern is not None:
        return f"/{spec.pattern}/"
    return " ".join([*spec.tokens, *(p.text for p in spec.phrases)][:most])[:long]


@dataclass
class Engine:
    """Search over documents(doc, text, series, kind) with optional strong(doc, term), link(src, dst), cites(doc, work)."""

    docs: DataFrame
    strong: DataFrame | None = None
    link: DataFrame | None = None
    cites: DataFrame | None = None
    rules: tuple[D.Rule, ...] = field(default_factory=lambda: D.RULES)
    known: L.Totals | None = None

    def __post_init__(self) -> None:
        if self.known is None:
            self.known = L.totals(self.docs)

    def _allowed(self, series: str | None, kind: str | None) -> DataFrame:
        d = self.docs.select("doc", "series", "kind")
        d = d.where(F.col("series") == series) if series else d
        return d.where(F.col("kind") == kind) if kind else d

    def lexical(self, spec: Spec) -> DataFrame:
        """(doc, score, named, why: array of ord and label, hit_at), summed over all term hits.

        hit_at is the first position of an exact word, null where none stands in the text.
        """
        parts = []
        shape = lambda d, score, named, ord_, text: d.select("doc", score.alias("score"), named.alias("named"), F.struct(F.lit(ord_).alias("ord"), text.alias("label")).alias("why"))
        df = I.document_frequency(self.docs, "doc", "text")
        n = F.lit(self.known.n_docs)

        def boosted(h: DataFrame) -> DataFrame:
            if self.strong is None:
                return h.withColumn("boost", F.lit(1.0))
            return h.join(self.strong.select("doc", "term").distinct().withColumn("boost", F.lit(L.STRONG_BOOST)), ["doc", "term"], "left").withColumn("boost", F.coalesce("boost", F.lit(1.0)))

        own = self.docs.select("doc", F.explode(T.distinct_terms(F.col("text"))).alias("term"))
        if spec.tokens:
            exact = boosted(L.bm25(self.docs, list(spec.tokens), "doc", "text", self.known))
            parts.append(shape(exact, F.col("score") * F.col("boost"), F.lit(True), 0, F.concat(F.lit('term: "'), F.col("term"), F.lit('"'))))
            begun = L.lexical(self.docs, list(spec.tokens), self.strong, "doc", "text", self.known).where(~F.col("exact"))
            parts.append(shape(begun, F.col("score"), F.lit(False), 1, F.concat(F.lit('prefix: "'), F.col("token"), F.lit('"'))))
        if spec.fuzzy:
            m = L.fuzzy_terms(df, list(spec.fuzzy))
            h = boosted(own.join(F.broadcast(m), "term"))  # m: FUZZY_CAP rows a query word
            text = F.concat(F.lit('fuzzy: "'), F.col("q"), F.lit('" → '), F.col("term"), F.lit(" ("), F.col("distance").cast("string"), F.when(F.col("distance") == 1, " edit)").otherwise(" edits)"))
            parts.append(shape(h, L.idf(n, F.col("df")) * (1 - F.col("distance") / (F.length("q") + 1)) * F.col("boost"), F.lit(False), 2, text))
        if spec.pattern is not None:
            h = boosted(own.join(F.broadcast(L.pattern_terms(df, spec.pattern)), "term"))
            parts.append(shape(h, L.idf(n, F.col("df")) * F.col("boost"), F.lit(True), 3, F.lit(f"re: /{spec.pattern}/")))
        for p in spec.phrases:
            weight = df.where(F.col("term").isin(list(p.words))).agg(F.sum(L.idf(n, F.col("df"))).alias("w"))
            h = L.phrase_hits(self.docs, p, "doc", "text").crossJoin(F.broadcast(weight))
            parts.append(shape(h, F.col("w"), F.lit(True), 4, F.lit(f'phrase: "{p.text}"')))
        if not parts:
            return self.docs.select("doc", F.lit(0.0).alias("score"), F.lit(False).alias("named"), F.array().cast("array<struct<ord:int,label:string>>").alias("why"), F.lit(None).cast("int").alias("hit_at")).limit(0)
        out = parts[0]
        for x in parts[1:]:
            out = out.union(x)
        out = out.groupBy("doc").agg(F.sum("score").alias("score"), F.bool_or("named").alias("named"), F.collect_set("why").alias("why"))
        if not spec.tokens:
            return out.withColumn("hit_at", F.lit(None).cast("int"))
        return out.join(I.first_hits(self.docs, list(spec.tokens), "doc", "text"), "doc", "left")

    def vector(self, spec: Spec) -> DataFrame:
        """(doc, score): cosine of the words' signed hashed idf against quantised document vectors, above the floor."""
        if not spec.tokens or spec.pattern is not None:
            return self.docs.select("doc", F.lit(0.0).alias("score")).limit(0)
        known = I.document_frequency(self.docs, "doc", "text").where(F.col("term").isin(list(spec.tokens)))
        q = known.groupBy(T.dimension(F.col("term")).alias("dim")).agg(F.sum(T.sign(F.col("term")) * L.idf(F.lit(self.known.n_docs), F.col("df"))).alias("qv"))
        v = I.quantised(I.vectors(self.docs, "doc", "text"))
        length = q.agg(F.sqrt(F.sum(F.col("qv") * F.col("qv"))).alias("ql"))
        s = v.join(F.broadcast(q), "dim", "left").groupBy("doc").agg(F.sum(F.col("q") * F.coalesce("qv", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("dl"))  # q: VECTOR_DIM rows at most
        s = s.crossJoin(F.broadcast(length)).select("doc", (F.col("dot") / F.nullif(F.col("dl") * F.col("ql"), F.lit(0.0))).alias("score")).where("score > 0")
        best = s.agg(F.max("score").alias("best"))
        return s.crossJoin(F.broadcast(best)).where(F.col("score") >= 0.34 * F.col("best")).select("doc", "score")

    def graph(self, seeds: DataFrame) -> DataFrame | None:
        """(doc, g, notes) by the rules, from seeds(doc)."""
        empty = lambda cols: self.docs.select(*[F.col("doc").alias(c) for c in cols]).limit(0)
        facts = {
            "seed": seeds.select("doc"),
            "link": self.link if self.link is not None else empty(["src", "dst"]),
            "cites": self.cites if self.cites is not None else empty(["doc", "work"]),
            "series_of": self.docs.select("doc", "series"),
        }
        told = D.evaluate(self.docs.sparkSession, facts, self.rules)
        return D.graph_reasons(told).groupBy("doc").agg(F.max("score").alias("g"), F.array_sort(F.collect_list("reason")).alias("notes"))  # a few reasons a seed

    def search(self, q: str, series: str | None = None, kind: str | None = None, sort: str = "rel", limit: int = RESULTS) -> DataFrame:
        """(doc, named, score, why, hit_at) of a query, ranked; sort="new" puts the newest first, by a date column of docs.

        A phrase none of whose words is known filters nothing.
        """
        spec = parse(q)
        lex, vec, allowed = self.lexical(spec), self.vector(spec), self._allowed(series, kind)
        tops = lex.agg(F.max("score").alias("top_l")).crossJoin(vec.agg(F.max("score").alias("top_v")))
        m = lex.select("doc", F.col("score").alias("l"), "named", "why", "hit_at").join(vec.select("doc", F.col("score").alias("v")), "doc", "full_outer").crossJoin(F.broadcast(tops))
        share = lambda x, top: F.coalesce(F.col(x) / F.nullif(F.col(top), F.lit(0.0)), F.lit(0.0))
        why = F.concat(F.coalesce("why", F.array().cast("array<struct<ord:int,label:string>>")), F.when(F.col("v").isNotNull(), F.array(F.struct(F.lit(5).alias("ord"), F.lit("similar").alias("label")))).otherwise(F.array().cast("array<struct<ord:int,label:string>>")))
        m = m.select("doc", (W_LEX * share("l", "top_l") + W_VEC * share("v", "top_v")).alias("m"), F.coalesce("named", F.lit(False)).alias("named"), why.alias("why"), "hit_at").join(allowed, "doc")
        m = m.persist()  # matched documents only; read four times below
        seeds = m.orderBy(F.desc("named"), F.desc("m"), "doc").limit(SEEDS)
        g = self.graph(seeds)
        both = m.join(g, "doc", "left").select("doc", "named", (F.col("m") + F.coalesce(W_GRAPH * F.col("g"), F.lit(0.0))).alias("score"), "why", "hit_at", "notes")
        only = g.join(m.select("doc"), "doc", "left_anti").join(allowed, "doc").orderBy(F.desc("g"), "doc").limit(GRAPH_ONLY)
        only = only.select("doc", F.lit(False).alias("named"), F.col("g").alias("score"), F.array().cast("array<struct<ord:int,label:string>>").alias("why"), F.lit(None).cast("int").alias("hit_at"), "notes")
        out = both.unionByName(only)
        for p in self._known_phrases(spec):
            out = out.join(L.phrase_hits(self.docs, p, "doc", "text").select("doc"), "doc", "left_semi")
        noted = F.transform(F.coalesce("notes", F.array().cast("array<string>")), lambda x: F.struct(F.lit(6).alias("ord"), x.alias("label")))
        out = out.select("doc", "named", F.round("score", 6).alias("score"), S.reasons(F.concat("why", noted)).alias("why"), "hit_at")
        if sort == "new":
            dated = out.join(self.docs.select("doc", "date"), "doc")
            return dated.orderBy(F.desc_nulls_last("date"), F.desc("named"), F.desc("score"), "doc").limit(limit).drop("date")
        return out.orderBy(F.desc("named"), F.desc("score"), "doc").limit(limit)

    def summary(self, q: str, found: DataFrame, sort: str = "rel") -> DataFrame:
        """One row on search(q)'s rows: named, related, folded, message.

        folded: related rows stand behind a row that counts them, where some are named and the order is by rank.
        message says why there are no rows; null where there are.
        """
        spec = parse(q)
        n = found.agg(F.count_if("named").alias("named"), F.count_if(~F.col("named")).alias("related"))
        why = "pattern" if spec.pattern is not None else "phrase" if spec.phrases else "words" if spec.tokens else "approximate" if spec.fuzzy else "empty"
        folded = (F.col("named") > 0) & (F.col("related") > 0) & F.lit(sort != "new")
        return n.select("named", "related", folded.alias("folded"), F.when(F.col("named") + F.col("related") == 0, EMPTY[why]).alias("message"))

    def snippets(self, found: DataFrame) -> DataFrame:
        """found with snippet: the line that holds hit_at, else the text's first line. The as-of line is chosen within a document."""
        lines = I.line_passages(self.docs.join(found.select("doc"), "doc", "left_semi"), "doc", "text")
        j = found.join(lines.select("doc", "start", "n_words", "body"), "doc", "left")
        holds = (F.col("hit_at") >= F.col("start")) & (F.col("hit_at") < F.col("start") + F.col("n_words"))
        best = j.groupBy("doc").agg(F.min_by("body", F.struct(~F.coalesce(holds, F.lit(False)), F.col("start"))).alias("snippet"))
        return found.join(best, "doc", "left")

    def _known_phrases(self, spec: Spec) -> list[L.Phrase]:
        """The phrases that have a word of the vocabulary."""
        words = sorted({w for p in spec.phrases for w in p.words})
        if not words:
            return []
        known = {r[0] for r in I.vocabulary(self.docs, "doc", "text").where(F.col("term").isin(words)).collect()}  # a row a query word at most
        return [p for p in spec.phrases if known & set(p.words)]

    def thin_suggestion(self, q: str, found: DataFrame) -> str | None:
        """The nearest known word of an unknown one, where a query found THIN rows or fewer."""
        spec = parse(q)
        if spec.pattern is not None or len(found.head(THIN + 1)) > THIN:
            return None
        vocab = I.vocabulary(self.docs, "doc", "text")
        known = {r[0] for r in vocab.where(F.col("term").isin(list(spec.tokens))).collect()}  # a row a query word at most
        unknown = [t for t in spec.tokens if t not in known]
        best = L.suggestion(vocab, unknown).orderBy("distance", "term").first() if unknown else None
        return best["term"] if best is not None else None

    def search_or_corrected(self, q: str, **facets) -> tuple[DataFrame, str | None]:
        """search(q); where that is empty, and an unknown word has a neighbour within one edit, the corrected query's rows."""
        first = self.search(q, **facets)
        spec = parse(q)
        if spec.pattern is not None or not first.isEmpty():
            return first, None
        vocab = I.vocabulary(self.docs, "doc", "text")
        known = {r[0] for r in vocab.where(F.col("term").isin(list(spec.tokens))).collect()}  # a row a query word at most
        unknown = [t for t in spec.tokens if t not in known]
        best = L.suggestion(vocab, unknown).orderBy("distance", "term").first() if unknown else None
        if best is None:
            return first, None
        corrected = re.sub(rf"\b{re.escape(best['q'])}\b", best["term"], q, count=1, flags=re.I)
        return self.search(corrected, **facets), corrected
