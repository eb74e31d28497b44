"""Quality rules: decision lists learned by sequential covering, applied as ordered Spark conditional expressions.

Statistics of whole texts are DataFrame functions. learn() covers the class to reject rule by rule: a rule grows by the
threshold condition that gains most information on growing rows (FOIL gain), is pruned from its end by its precision
on pruning rows, and is kept only if it is precise there; rows that it covers are then taken away. The list becomes one
chained CASE expression. It learns from a sample of labelled rows bounded by max_rows (the smallest hashes of their ids).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import checked_broadcast, own_columns, saved, table, words_of

SYMBOLS = r"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

#: Bound on the labelled rows that rules are learned from.
MAX_ROWS = 20_000
MIN_PRECISION = 0.95
MIN_COVER = 10
MAX_CONDITIONS = 4
MAX_RULES = 12
CUTS = 32

FEATURES = ("symbol_share", "punct_share", "upper_share", "repeat_share", "dup_line_share", "distinct_share", "mean_word", "log_words")


def _repeat_words(words: Column) -> Column:
    """Words that stand in windows of WINDOW words found twice or more."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at(w, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            near = F.filter(
                F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"])),
                lambda x: x.isNotNull(),
            )
            return F.aggregate(
                F.array_sort(near),
                F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(x - a["last"], F.lit(WINDOW))).alias("n")),
                lambda a: a["n"],
            )

        return F.transform(F.array(order), flagged)[0]

    def judged(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))

    def counted(w: Column) -> Column:  # the words are bound once, whatever the optimizer does with their expression
        return F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(F.transform(F.array(hashes(w)), judged)[0])

    return F.transform(F.array(words), counted)[0].cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and FEATURES.

    Columns of these names in docs are replaced. A null or blank text has no words and fails the base rules.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES)
    d = docs.withColumn("__words", words_of(text))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("__lines", lines)
    d = d.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, rf"[^{SYMBOLS}]+", "")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": _repeat_words(F.col("__words")),
            "__punct": F.length(F.regexp_replace(text, r"[^!?;:.,]+", "")),
            "__upper": F.length(F.regexp_replace(text, r"[^A-Z]+", "")),
            "__distinct": F.size(F.array_distinct("__words")),
            "__n_lines": F.size("__lines"),
        }
    )
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    d = d.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_share": F.col("n_symbols") / words,
            "punct_share": F.col("__punct") / words,
            "upper_share": F.col("__upper") / chars,
            "repeat_share": F.col("n_repeat_words") / words,
            "dup_line_share": F.col("n_dup_lines") / F.greatest("__n_lines", F.lit(1)),
            "distinct_share": F.col("__distinct") / words,
            "mean_word": F.col("word_chars") / words,
            "log_words": F.log1p(F.col("n_words").cast("double")),
        }
    )
    return d.drop("__words", "__lines", "__punct", "__upper", "__distinct", "__n_lines")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, op, threshold); op is <= or >. Texts it covers are rejected."""

    conditions: tuple[tuple[str, str, float], ...]
    precision: float
    cover: int

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t:.6g}" for f, op, t in self.conditions)

    def covers(self, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.conditions)

    def expression(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            out = out & (F.col(f) <= t if op == "<=" else F.col(f) > t)
        return out


def _best(rows: list[tuple[dict, bool]], features: tuple[str, ...]) -> tuple[float, tuple | None]:
    p0 = sum(bad for _, bad in rows)
    base = math.log2(p0 / len(rows)) if p0 else 0.0
    best: tuple[float, tuple | None] = (0.0, None)
    for f in features:
        order = sorted((r[f], bad) for r, bad in rows)
        total, seen, p = len(order), 0, 0
        bads = [x for x, bad in order if bad]
        cuts = {bads[i * len(bads) // CUTS] for i in range(CUTS)} | {bads[-1]} if bads else set()
        values = sorted({x for x, _ in order})
        place = {v: i for i, v in enumerate(values)}
        limits = sorted({(v + values[place[v] + s]) / 2 for v in cuts for s in (-1, 1) if 0 <= place[v] + s < len(values)})
        at = 0
        for t in limits:
            while at < total and order[at][0] <= t:
                p += order[at][1]
                at += 1
            seen = at
            for op, n, k in (("<=", seen, p), (">", total - seen, p0 - p)):
                if k and n < total:
                    gain = k * (math.log2(k / n) - base)
                    if gain > best[0]:
                        best = (gain, (f, op, t))
    return best


def learn(rows: list[tuple[dict, bool]], features: tuple[str, ...] = FEATURES, min_precision: float = MIN_PRECISION, min_cover: int = MIN_COVER, max_rules: int = MAX_RULES) -> list[Rule]:
    """Rules for rows ({feature: value}, reject). Every third row prunes, the others grow."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[Rule] = []
    while len(rules) < max_rules and any(bad for _, bad in grow):
        conditions: list[tuple[str, str, float]] = []
        covered = grow
        while len(conditions) < MAX_CONDITIONS and not all(bad for _, bad in covered):
            _, c = _best(covered, features)
            if c is None:
                break
            conditions.append(c)
            covered = [r for r in covered if Rule((c,), 0, 0).covers(r[0])]
        if not conditions:
            break

        def worth(k: int) -> tuple[float, float, int]:
            rule = Rule(tuple(conditions[:k]), 0, 0)
            hit = [bad for r, bad in prune if rule.covers(r)]
            return ((sum(hit) + 1) / (len(hit) + 2), -k, len(hit))

        k = max(range(1, len(conditions) + 1), key=worth)
        rule = Rule(tuple(conditions[:k]), 0, 0)
        hit = [bad for r, bad in grow + prune if rule.covers(r)]
        tried = [bad for r, bad in prune if rule.covers(r)]
        if len(hit) < min_cover or sum(hit) < min_precision * len(hit) or not tried or sum(tried) < min_precision * len(tried):
            break
        rules.append(Rule(rule.conditions, sum(hit) / len(hit), len(hit)))
        grow, prune = [r for r in grow if not rule.covers(r[0])], [r for r in prune if not rule.covers(r[0])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> list[Rule]:
    """Rules learned from docs that labels marks 0 (reject) or 1; at most max_rows rows reach the driver.

    An id that stands on several rows is learned from once, by the smallest hash of its texts; null ids and null labels
    are passed by. Without labelled rows there are no rules.
    """
    told = own_columns(labels, id_col, label_col).toDF("id", "label").where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    told = told.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    told = checked_broadcast(saved(told, "labelled"), max_rows)  # bounded by max_rows; the texts stay where they are
    d = own_columns(docs, id_col, text_col).toDF("id", "text").join(told, "id")
    one = F.min(F.struct(F.xxhash64("text").alias("t"), "label", "base_failed", *FEATURES)).alias("x")  # of the texts of one id, one is learned from
    rows = statistics(d, "text").groupBy("id").agg(one).select(F.xxhash64("id").alias("o"), "x.label", "x.base_failed", *[f"x.{f}" for f in FEATURES]).collect()
    rows.sort(key=lambda r: tuple(r))
    return learn([({f: r[f] for f in FEATURES}, r["label"] == 0) for r in rows if not r["base_failed"]])


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """statistics(docs) with rule (int, the first rule that covers the text; 0 for the base rules, null for none) and kept."""
    d = statistics(docs.drop("rule", "kept"), text_col)
    chain = F.when(F.col("base_failed"), F.lit(0))
    for i, r in enumerate(rules, 1):
        chain = chain.when(r.expression(), F.lit(i))
    return d.withColumn("rule", chain).withColumn("kept", F.col("rule").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    out = judge(docs.select("doc_id", "text"), rules)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op9_quality_rules": query}
SQL: dict[str, str] = {}
