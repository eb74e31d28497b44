"""Term providers: exact and prefix words, BM25, phrases, approximate words, patterns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index as I

# Fixed values of scoring and caps.
PREFIX_WEIGHT, STRONG_BOOST = 0.55, 2.6
PREFIX_CAP, FUZZY_CAP, PATTERN_CAP, COMPLETE_CAP, SUGGEST_CAP = 120, 200, 120, 8, 24
K1, B, TF_CAP = 1.2, 0.75, 64


def literal_rows(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + n / F.greatest(df, F.lit(1)))


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def prefix_matches(df: DataFrame, tokens: list[str], cap: int = PREFIX_CAP) -> DataFrame:
    """df(term, df) -> (token, term, df, exact, capped): the first cap terms of each prefix in term order.

    The tokens come with the query, so they go into the plan as literals: a filter on the terms, no join.
    """
    hit = df.withColumn("token", F.explode(F.filter(literal_rows(tokens), lambda t: F.startswith(F.col("term"), t))))
    rank = F.row_number().over(Window.partitionBy("token").orderBy("term"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= cap + 1).withColumn("capped", F.max(F.col("rank") > cap).over(Window.partitionBy("token"))).where(F.col("rank") <= cap).select("token", "term", "df", (F.col("term") == F.col("token")).alias("exact"), "capped")


@dataclass(frozen=True)
class Totals:
    """A collection's number of documents and mean length, where a caller has them; they then enter plans as literals."""

    n_docs: int
    avg_dl: float


def totals(docs: DataFrame, text_col: str = I.TEXT) -> Totals:
    n, a = docs.agg(F.count("*"), F.avg(F.size(T.words(F.col(text_col))))).first()
    return Totals(n, a or 1.0)


def with_totals(hits: DataFrame, docs: DataFrame, known: Totals | None, id_col: str, text_col: str) -> DataFrame:
    if known is not None:
        return hits.withColumns({"n_docs": F.lit(known.n_docs), "avg_dl": F.lit(known.avg_dl)})
    return hits.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs"), F.avg(F.size(T.words(F.col(text_col)))).alias("avg_dl"))))


def lexical(docs: DataFrame, tokens: list[str], strong: DataFrame | None = None, id_col: str = I.ID, text_col: str = I.TEXT, known: Totals | None = None) -> DataFrame:
    """(doc, token, term, exact, score): tf-idf hits of exact words and prefixes; strong(doc, term) hits count more."""
    matched = prefix_matches(I.document_frequency(docs, id_col, text_col), tokens)
    any_prefix = F.exists(literal_rows(tokens), lambda t: F.startswith(F.col("term"), t))
    own = docs.select(F.col(id_col).alias("doc"), F.explode(T.distinct_terms(F.col(text_col))).alias("term")).where(any_prefix)
    hits = with_totals(own.join(matched, "term"), docs, known, id_col, text_col)
    score = idf(F.col("n_docs"), F.col("df")) * F.when(F.col("exact"), 1.0).otherwise(PREFIX_WEIGHT)
    if strong is not None:
        hits = hits.join(strong.select("doc", "term").distinct().withColumn("strong", F.lit(True)), ["doc", "term"], "left")
        score = score * F.when(F.col("strong"), STRONG_BOOST).otherwise(1.0)
    return hits.select("doc", "token", "term", "exact", score.alias("score"))


def bm25(docs: DataFrame, tokens: list[str], id_col: str = I.ID, text_col: str = I.TEXT, known: Totals | None = None) -> DataFrame:
    """(doc, term, tf, score) of exact words; a document's length counts all of its words.

    A document's own words are counted in its row, so that neither occurrences nor lengths are shuffled.
    """
    w = T.words(F.col(text_col))
    counted = F.transform(literal_rows(tokens), lambda t: F.struct(t.alias("term"), F.size(F.filter(w, lambda x: x == t)).cast("long").alias("n")))
    own = docs.select(F.col(id_col).alias("doc"), F.size(w).cast("long").alias("dl"), F.explode(F.filter(counted, lambda x: x["n"] > 0)).alias("x")).select("doc", "dl", "x.term", "x.n")
    df = own.groupBy("term").agg(F.count("*").alias("df"))
    hits = with_totals(own.join(F.broadcast(df), "term"), docs, known, id_col, text_col)  # df: a row for each query word
    tf = F.least(F.col("n"), F.lit(TF_CAP))
    dl = F.when(F.col("dl") == 0, F.col("avg_dl")).otherwise(F.col("dl"))
    score = bm25_idf(F.col("n_docs"), F.col("df")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avg_dl")))
    return hits.select("doc", "term", tf.alias("tf"), score.alias("score"))


@dataclass(frozen=True)
class Phrase:
    """A quoted phrase: its text and its recordable words with their offsets."""

    text: str
    seq: tuple[tuple[str, int], ...]

    @property
    def words(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(w for w, _ in self.seq))


def phrase_of(text: str) -> Phrase:
    found = re.findall(T.TOKEN, text.lower())
    return Phrase(text, tuple((w, i) for i, w in enumerate(found) if len(w) >= T.MIN_TERM and w not in T.STOP_WORDS))


def phrase_hits(docs: DataFrame, phrase: Phrase, id_col: str = I.ID, text_col: str = I.TEXT) -> DataFrame:
    """(doc, place): documents where the phrase's words stand at its offsets, with the first place.

    Each word's position less its offset is where the phrase would begin; a beginning that every word names is a match.
    """
    offsets = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(o - phrase.seq[0][1]).alias("off")) for w, o in phrase.seq])
    p = I.positions(docs, id_col, text_col).where(F.col("term").isin(list(phrase.words)))
    begins = p.select("doc", "pos", F.explode(F.filter(offsets, lambda x: x["w"] == F.col("term"))).alias("x")).select("doc", (F.col("pos") - F.col("x.off")).alias("place"), "x.off")
    whole = begins.groupBy("doc", "place").agg(F.count("*").alias("n")).where(F.col("n") == len(phrase.seq))
    return whole.groupBy("doc").agg(F.min("place").alias("place"))


def fuzzy_terms(vocab: DataFrame, queries: list[tuple[str, int]], cap: int = FUZZY_CAP) -> DataFrame:
    """vocab(term, ...) -> (q, k, term, distance): terms within k edits (swaps count one), the first cap in term order."""
    lits = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(k).alias("k")) for q, k in queries])
    near = vocab.withColumn("x", F.explode(lits)).select("*", "x.q", "x.k").drop("x")
    near = near.where((F.abs(F.length("term") - F.length("q")) <= F.col("k")) & (F.levenshtein("term", "q", 2 * max(k for _, k in queries)) >= 0))
    near = near.withColumn("distance", T.osa(F.col("q"), F.col("term")).cast("int")).where(F.col("distance") <= F.col("k"))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("q", "k").orderBy("term"))).where(F.col("rank") <= cap).drop("rank")


class PatternError(ValueError):
    """A pattern outside the dialect, with the reason."""


def translate_pattern(body: str) -> str:
    """A pattern of the dialect as a Java regular expression.

    Literals, . [classes] | ( ) and stackable * + ?; ^ and $ only at the ends, where they hold for all alternatives.
    Backslashes, counted repeats and anything unfinished are refused.
    """
    if not body:
        raise PatternError("empty pattern")
    front, back = body.startswith("^"), body.endswith("$") and len(body) > 1
    s = body[1 if front else 0 : len(body) - 1 if back else len(body)]
    at = 0

    def esc(c: str) -> str:
        return c if c.isalnum() or c == " " else "\\" + c

    def klass() -> str:
        nonlocal at
        negated = at < len(s) and s[at] == "^"
        at += negated
        out = []
        while at < len(s) and s[at] != "]":
            a = s[at]
            if a == "\\":
                raise PatternError("backslash escapes are not part of the dialect")
            if at + 2 < len(s) and s[at + 1] == "-" and s[at + 2] != "]":
                if s[at + 2] < a:
                    raise PatternError("a range runs backwards")
                out.append(f"{esc(a)}-{esc(s[at + 2])}")
                at += 3
            else:
                out.append(esc(a))
                at += 1
        if at >= len(s):
            raise PatternError("unclosed class")
        if not out:
            raise PatternError("empty class")
        at += 1
        return f"[{'^' if negated else ''}{''.join(out)}]"

    def atom() -> str:
        nonlocal at
        c = s[at]
        at += 1
        if c == "(":
            inner = alternatives()
            if at >= len(s) or s[at] != ")":
                raise PatternError("unclosed group")
            at += 1
            return f"(?:{inner})"
        if c == "[":
            return klass()
        if c == ".":
            return "."
        if c in "^$":
            raise PatternError("an anchor stands only at an end")
        if c in "*+?":
            raise PatternError("nothing to repeat")
        if c in "{}":
            raise PatternError("counted repeats are not part of the dialect")
        if c == "\\":
            raise PatternError("backslash escapes are not part of the dialect")
        if not " " <= c <= "~":
            raise PatternError("only printable ASCII")
        return esc(c)

    def alternatives() -> str:
        nonlocal at
        out = [""]
        while at < len(s) and s[at] != ")":
            if s[at] == "|":
                at += 1
                out.append("")
                continue
            x = atom()
            while at < len(s) and s[at] in "*+?":
                x = f"(?:{x}){s[at]}"
                at += 1
            out[-1] += x
        return "|".join(out)

    inner = alternatives()
    if at < len(s):
        raise PatternError("unmatched )")
    return f"{'^' if front else ''}(?:{inner}){'$' if back else ''}"


def pattern_terms(vocab: DataFrame, body: str, cap: int = PATTERN_CAP) -> DataFrame:
    """Terms that a pattern reaches (anywhere in the word unless anchored), the first cap in term order."""
    return vocab.where(F.col("term").rlike(translate_pattern(body))).orderBy("term").limit(cap)


def completions(vocab: DataFrame, prefix: str, cap: int = COMPLETE_CAP) -> DataFrame:
    """(term, rank, capped): the first terms with a prefix, and whether there are more."""
    w = Window.orderBy("term")
    top = vocab.where(F.col("term").startswith(prefix)).orderBy("term").limit(cap + 1)
    return top.withColumn("rank", F.row_number().over(w)).withColumn("capped", F.max("rank").over(Window.partitionBy()) > cap).where(F.col("rank") <= cap)


def suggestion(vocab: DataFrame, unknown: list[str], cap: int = SUGGEST_CAP) -> DataFrame:
    """(q, term, distance): for each unknown word its nearest term within one edit, ties by term."""
    near = fuzzy_terms(vocab, [(u, 1) for u in unknown], cap)
    return near.groupBy("q").agg(F.min(F.struct("distance", "term")).alias("m")).select("q", "m.term", "m.distance")


def nearest_prefix(names: DataFrame, col: str, queries: list[str]) -> DataFrame:
    """(q, name, distance): plain edit distance to prefixes of a name of length q +- 2; at most a third of q, 3 letters or more."""
    asked = [q for q in queries if len(q) >= 3]
    n = names.withColumn("q", F.explode(literal_rows(asked))).withColumn("name", F.lower(col))
    spans = F.sequence(F.greatest(F.lit(1), F.length("q") - 2), F.greatest(F.lit(1), F.least(F.length("name"), F.length("q") + 2)))
    n = n.withColumn("distance", F.array_min(F.transform(spans, lambda k: F.levenshtein(F.col("q"), F.left(F.col("name"), k)))))
    best = n.groupBy("q").agg(F.min(F.struct("distance", "name")).alias("m")).select("q", "m.name", "m.distance")
    return best.where(F.col("distance") <= F.greatest(F.lit(1), F.floor(F.length("q") / 3)))
