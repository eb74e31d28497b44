"""Semi-naive Datalog over DataFrames: rules are data, bodies compile to equi-joins."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROUND_CAP, TUPLE_CAP = 8, 1_000_000
NEQ = "neq"


@dataclass(frozen=True)
class Atom:
    """pred(args): an argument is a variable if it begins with a capital, nameless if it is _, else a constant."""

    pred: str
    args: tuple[str, ...]

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(a for a in self.args if a[:1].isupper()))


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom, ...]


def rule(head: Sequence[str], *body: Sequence[str]) -> Rule:
    return Rule(Atom(head[0], tuple(head[1:])), tuple(Atom(b[0], tuple(b[1:])) for b in body))


# The graph's rules.
RULES = (
    rule(("hit", "P"), ("seed", "P")),
    rule(("related", "P", "Q", "S"), ("hit", "P"), ("cites", "P", "S"), ("cites", "Q", "S"), ("hit", "Q"), (NEQ, "P", "Q")),
    rule(("same_series", "P", "Q"), ("hit", "P"), ("series_of", "P", "S"), ("series_of", "Q", "S"), (NEQ, "P", "Q")),
    rule(("points_at", "P", "Q"), ("hit", "P"), ("link", "P", "Q"), (NEQ, "P", "Q")),
    rule(("path2", "P", "Q"), ("link", "P", "R"), ("link", "R", "Q")),
    rule(("near", "P", "Q"), ("hit", "P"), ("path2", "P", "Q"), (NEQ, "P", "Q")),
)
WEIGHTS = {"related": 0.34, "points_at": 0.26, "same_series": 0.20, "near": 0.14}


@dataclass
class Result:
    relations: dict[str, DataFrame]
    rounds: int
    derived: int
    capped: bool


def _bound(df: DataFrame, atom: Atom) -> DataFrame | None:
    """The atom's relation with its variables for columns; None if the arity differs."""
    if len(df.columns) != len(atom.args):
        return None
    d = df.toDF(*[f"_{i}" for i in range(len(atom.args))])
    seen: dict[str, str] = {}
    for i, a in enumerate(atom.args):
        if a == "_":
            continue
        if a[:1].isupper():
            if a in seen:
                d = d.where(F.col(f"_{i}") == F.col(seen[a]))
            else:
                seen[a] = f"_{i}"
        else:
            d = d.where(F.col(f"_{i}").cast("string") == a)
    return d.select(*[F.col(c).alias(v) for v, c in seen.items()])


def solve(body: Sequence[Atom], relations: dict[str, DataFrame], delta: tuple[int, DataFrame] | None = None) -> DataFrame | None:
    """Join a body from left to right on shared variables; delta puts another relation at one place."""
    out: DataFrame | None = None
    pending = []
    for i, atom in enumerate(body):
        if atom.pred == NEQ:
            pending.append(atom.args)
        else:
            df = delta[1] if delta and delta[0] == i else relations.get(atom.pred)
            d = _bound(df, atom) if df is not None else None
            if d is None:
                return None
            shared = [v for v in atom.variables if out is not None and v in out.columns]
            out = d if out is None else out.join(d, shared) if shared else out.crossJoin(d)
        for a, b in list(pending):
            if out is not None and a in out.columns and b in out.columns:
                out = out.where(F.col(a) != F.col(b))
                pending.remove((a, b))
    return out


def _emit(r: Rule, solved: DataFrame) -> DataFrame:
    return solved.select(*[F.col(a).alias(f"c{i}") if a[:1].isupper() else F.lit(a).alias(f"c{i}") for i, a in enumerate(r.head.args)]).distinct()


def strata(rules: Sequence[Rule]) -> list[list[Rule]] | None:
    """The rules in an order in which no body needs a later head; None for a recursive program."""
    left, done, out = list(rules), set(), []
    heads = {r.head.pred for r in rules}
    while left:
        ready = [r for r in left if all(b.pred not in heads or b.pred in done for b in r.body)]
        ready = [r for r in ready if all(o in ready for o in left if o.head.pred == r.head.pred)]
        if not ready:
            return None
        out.append(ready)
        done |= {r.head.pred for r in ready}
        left = [r for r in left if r not in ready]
    return out


def _checkpoint_folder(spark: SparkSession) -> None:
    """Make sure that there is one: what the session names, or in a local session that names none, one in the warehouse."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.lexmill-checkpoints")


def evaluate(spark: SparkSession, facts: dict[str, DataFrame], rules: Sequence[Rule] = RULES, rounds: int = ROUND_CAP, tuples: int = TUPLE_CAP) -> Result:
    """Derive all relations. A program without recursion is one lazy plan; else rounds of deltas, each checkpointed."""
    relations = {k: v.distinct() for k, v in facts.items()}
    order = strata(rules)
    if order is not None:
        for group in order:
            by_head: dict[str, list[DataFrame]] = {}
            for r in group:
                solved = solve(r.body, relations)
                if solved is not None:
                    by_head.setdefault(r.head.pred, []).append(_emit(r, solved))
            for pred, parts in by_head.items():
                relations[pred] = reduce(DataFrame.union, parts).distinct() if len(parts) > 1 else parts[0]
        return Result(relations, len(order), -1, False)
    _checkpoint_folder(spark)
    heads = {r.head.pred for r in rules}
    delta: dict[str, DataFrame] = {}
    derived, capped, n = 0, False, 0
    for n in range(1, rounds + 1):
        fresh: dict[str, list[DataFrame]] = {}
        for r in rules:
            recursive = [i for i, b in enumerate(r.body) if b.pred in heads]
            if not recursive:
                if n == 1 and (s := solve(r.body, relations)) is not None:
                    fresh.setdefault(r.head.pred, []).append(_emit(r, s))
            else:
                for i in recursive:
                    d = delta.get(r.body[i].pred)
                    if d is not None and (s := solve(r.body, relations, (i, d))) is not None:
                        fresh.setdefault(r.head.pred, []).append(_emit(r, s))
        delta = {}
        for pred, parts in fresh.items():
            new = reduce(DataFrame.union, parts).distinct()
            if pred in relations:
                new = new.join(relations[pred].toDF(*new.columns), new.columns, "left_anti")
            new = new.checkpoint()
            count = new.count()
            if count:
                delta[pred] = new
                derived += count
                relations[pred] = relations[pred].toDF(*new.columns).union(new) if pred in relations else new  # its parts are checkpointed
        if derived > tuples:
            capped = True
            break
        if not delta:
            break
    return Result(relations, n, derived, capped or bool(delta))  # rounds ran out with something left to derive


def graph_scores(result: Result, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(doc, score, rule): the greatest weight of the relations that reach a document."""
    at = {"related": 1, "points_at": 1, "same_series": 1, "near": 1}
    parts = [result.relations[p].select(F.col(result.relations[p].columns[at[p]]).alias("doc"), F.lit(w).alias("score"), F.lit(p).alias("rule")) for p, w in weights.items() if p in result.relations]
    return reduce(DataFrame.union, parts).groupBy("doc").agg(F.max("score").alias("score"), F.max_by("rule", "score").alias("rule"))


def graph_reasons(result: Result, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(doc, reason, score): works cited and links one by one; neighbours of a series as one count, two hops as one reason."""
    told = result.relations
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    parts = []
    if "related" in told:
        r = told["related"].toDF("p", "q", "s").distinct()
        parts.append(r.select(F.col("q").alias("doc"), text('graph: also cites "', F.col("s"), '", like ', F.col("p")).alias("reason"), F.lit(weights["related"]).alias("score")))
    if "points_at" in told:
        r = told["points_at"].toDF("p", "q").distinct()
        parts.append(r.select(F.col("q").alias("doc"), text("graph: linked from ", F.col("p")).alias("reason"), F.lit(weights["points_at"]).alias("score")))
    if "same_series" in told:
        n = told["same_series"].toDF("p", "q").distinct().groupBy(F.col("q").alias("doc")).agg(F.count("*").alias("n"))
        parts.append(n.select("doc", F.when(F.col("n") == 1, "graph: one neighbour in its series").otherwise(text("graph: ", F.col("n"), " of its neighbours are in its series")).alias("reason"), F.lit(weights["same_series"]).alias("score")))
    if "near" in told:
        r = told["near"].toDF("p", "q")
        parts.append(r.select(F.col("q").alias("doc")).distinct().select("doc", F.lit("graph: reached by two hops").alias("reason"), F.lit(weights["near"]).alias("score")))
    return reduce(DataFrame.union, parts)
