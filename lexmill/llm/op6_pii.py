"""Personal data by weak supervision, with DataFrame functions only.

Candidate spans come from the four base patterns and from looser ones: spelled-out e-mail addresses, IPv6, card-shaped
numbers that fail the check digit, phone numbers without +, and further kinds (account and identity numbers, names,
street addresses, secrets such as keys and passwords). Labelers vote 1, -1 or 0 on each: a strict rule of its kind
(check digits, known prefixes, valid ranges), its shape, a gazetteer (domains, networks, issuers, dialling codes, account
lengths, given names, street words), context words before it, words that speak against it, its borders, and the variety
of its characters. Expectation-maximisation over the counts of vote patterns, which are of a fixed number, estimates each
labeler's reliability for each kind. Its posteriors are the soft labels of a logistic span classifier, which sees hashed
features of the span, its shape and its neighbours besides the votes, and learns from at most MAX_SPANS spans. Base spans
always stay; another one is added where the classifier says so and it does not overlap a base span.

Offsets are running sums of the lengths of matches and of the text between them, over one row a match, so a text with
very many matches takes linear time. Patterns use possessive or bounded repeats for the same reason.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import own_columns, saved, table

#: Kinds of base spans, as listed by the contract, and kinds that only the method finds.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "id", "name", "address", "secret")
RANKS = KINDS + ADDED
LABELERS = ("strict", "shape", "gazetteer", "context", "against", "border", "variety")

#: Fixed values of the contract (card: a match of fewer than 12 digits never counts, so only longer ones are looked for).
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Gazetteers: public, fixed values.
DOMAINS = "com org net edu gov mil int info biz name pro museum coop aero io ai app dev cloud online site shop store blog tech xyz club agency email news live media"
NETWORKS_NOT_PERSONAL = r"0\.|127\.|255\.|22[4-9]\.|23[0-9]\.|169\.254\."
ISSUERS = r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|30[0-5]|36|38|6011|64[4-9]|65|35(?:2[89]|[3-8])|62|50|5[6-9]|6[37]"
DIALLING = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
ACCOUNT_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 "
    "IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
)
GIVEN_NAMES = (
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Lisa Daniel Nancy Matthew "
    "Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Emily Emma Olivia Hannah Laura Anna Julia Sophie Claire "
    "Jean Pierre Marie Jacques Michel Philippe Isabelle Nathalie Nicolas Camille Hans Peter Klaus Wolfgang Jürgen Ursula Sabine Andreas Stefan Monika Carlos José Juan María Luis Carmen Ana "
    "Javier Miguel Antonio Manuel Francisco Pedro Elena Mohammed Fatima Ahmed Ali Wei Yuki Hiroshi Ivan Olga Sergei Natalia Giovanni Marco Giulia Luca Paolo Sofia"
)
HONORIFICS = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sr|Sra)\.?"
STREETS = "Street St Avenue Ave Road Rd Lane Ln Boulevard Blvd Drive Dr Court Ct Place Pl Square Sq Terrace Way Close Crescent Highway Parkway"
SECRET_PREFIXES = r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64}|xox[abprs]-[A-Za-z0-9-]{10,72}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,2000}\.[A-Za-z0-9_-]{10,2000}\.[A-Za-z0-9_-]{10,2000}"
SECRET_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|passphrase|bearer"

LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.(-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "id": r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": rf"(?=[\p{{Lu}}])(?<![\p{{L}}0-9])(?:{HONORIFICS} (?:\p{{Lu}}[\p{{Ll}}'-]{{1,30}})(?: \p{{Lu}}[\p{{Ll}}'-]{{1,30}})?|(?:{'|'.join(GIVEN_NAMES.split())}) \p{{Lu}}[\p{{Ll}}'-]{{1,30}})(?![\p{{L}}0-9])",
    "address": rf"(?<![\p{{L}}0-9])[0-9]{{1,5}} \p{{Lu}}[\p{{Ll}}']{{1,30}}(?: \p{{Lu}}[\p{{Ll}}']{{1,30}}){{0,2}} (?:{'|'.join(STREETS.split())})(?![\p{{L}}0-9])|(?<![\p{{L}}0-9])\p{{Lu}}\p{{Ll}}{{1,30}}(?:straße|strasse|weg|platz|gasse) [0-9]{{1,4}}[a-z]?(?![\p{{L}}0-9])",
    "secret": rf"(?<![A-Za-z0-9_-])(?:{SECRET_PREFIXES})(?![A-Za-z0-9_-])|(?i:(?<![A-Za-z0-9])(?:{SECRET_NAMES}))\s?[=:]\s?[\"']?[^\s\"'<>,;]{{6,200}}",
}
CONTEXT = {
    "email": "mail|contact|write|reach|correo|courriel|adresse",
    "ip": "ip|host|server|address|adresse|login|client|network",
    "card": "card|visa|mastercard|amex|pay|credit|carte|karte|tarjeta",
    "phone": "call|tel|phone|fax|mobile|cell|whatsapp|appel|anruf|llama|contact",
    "iban": "iban|account|konto|compte|cuenta|bank|transfer",
    "id": "ssn|social|security|identity|taxpayer|identification",
    "name": "name|dear|from|by|signed|contact|regards|nom|nombre",
    "address": "address|lives|at|adresse|street|office|wohnt|habite",
    "secret": "key|secret|token|password|credential|auth|login",
}
AGAINST = "version|section|isbn|issn|order|invoice|figure|chapter|page|serial|ticket|example|placeholder"
NEAR = 40
THRESHOLD = 0.5
ROUNDS = 60
#: Bound on the spans that the classifier learns from (those of the smallest hashes), and the cells of its features.
MAX_SPANS = 10_000
CELLS = 2048

_PATTERNS = [(k, True, p) for k, p in BASE.items()] + [(k, False, p) for k, p in LOOSE.items()]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(account: Column) -> Column:
    """The remainder by 97 of an account number (letters and digits): its first four characters go last, letters count from 10."""
    moved = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))
    values = F.transform(F.split(moved, ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _holds(kind: str, match: Column, digits: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "ip":
        bare = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))  # a zero part is left empty
        return ~F.exists(bare, lambda p: (F.length(p) > 3) | ((F.length(p) == 3) & (p > "255")))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _gate(text: Column, kind: str, base: bool) -> Column:
    """A cheap test that every text with a match passes."""
    has = lambda *xs: reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in xs])
    if base:
        return {"email": lambda: has("@"), "phone": lambda: has("+"), "ip": lambda: text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "card": lambda: text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]")}[kind]()
    return {
        "email": lambda: has("(at)", "[at]"), "ip": lambda: has(":") & text.rlike("(?::[0-9A-Fa-f]{1,4}){7}"), "card": lambda: text.rlike("[0-9]{4}[ -][0-9]{4}[ -]"), "phone": lambda: text.rlike("[0-9][ .-][0-9]{4}"),
        "iban": lambda: text.rlike("[A-Z]{2}[0-9]{2}[ 0-9A-Z]{9}"), "id": lambda: text.rlike("[0-9]-[0-9]{2}-[0-9]"),
        "name": lambda: text.rlike(rf"(?=[A-Z])(?<![\p{{L}}0-9])(?:{HONORIFICS}|{'|'.join(GIVEN_NAMES.split())}) \p{{Lu}}"),
        "address": lambda: text.rlike(r"[0-9] \p{Lu}|(?:str|weg|platz|gasse)[a-zß]* [0-9]"),
        "secret": lambda: has("=", ":") & text.rlike(f"(?i:{SECRET_NAMES})") | has("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "AIza", "eyJ"),
    }[kind]()


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, base: bool, hit: Column, digits: Column, before: Column, after: Column) -> list[Column]:
    """The labelers' votes (1, -1 or 0) on a span, in the order of LABELERS."""
    never, always = F.lit(False), F.lit(True)
    n, chars = F.length(digits), F.length(hit)
    bare = F.regexp_replace(hit, " ", "")
    rules = {
        "email": lambda: never, "card": lambda: never, "ip": lambda: ~hit.rlike("^[0:]+$"), "phone": lambda: hit.rlike(r"^\(?[2-9][0-8][0-9]\)?[ .-]?[2-9][0-9]{2}"), "iban": lambda: mod97(bare) == 1,
        "id": lambda: ~hit.rlike("^(?:000|666|9)|-00-|-0000$"), "name": lambda: hit.rlike(f"^{HONORIFICS} "), "address": lambda: hit.rlike(r"^[1-9]|[1-9][0-9]*[a-z]?$"), "secret": lambda: hit.rlike(f"^(?:{SECRET_PREFIXES})$"),
    }
    strict = F.lit(1) if base else _vote(rules[kind](), F.lit(kind in ("card", "iban", "id")))
    shape = {
        "email": lambda: _vote(chars.between(6, 60), chars > 120), "ip": lambda: _vote((n >= 6) | hit.contains(":"), n < 5), "card": lambda: _vote(n.between(15, 16), n < 13), "phone": lambda: _vote(n.between(10, 13), n < 10),
        "iban": lambda: _vote(chars >= 15, never), "id": lambda: _vote(always, never), "name": lambda: _vote(hit.rlike(" .+ ") | (chars >= 9), chars < 6), "address": lambda: _vote(chars >= 10, never), "secret": lambda: _vote(chars >= 16, chars < 10),
    }[kind]()
    known = {
        "email": lambda: hit.rlike(rf"(?i)[.)\] ](?:{'|'.join(DOMAINS.split())}|[a-z]{{2}})$"), "ip": lambda: ~hit.rlike(f"^(?:{NETWORKS_NOT_PERSONAL})"), "card": lambda: digits.rlike(f"^(?:{ISSUERS})"),
        "phone": lambda: hit.rlike(rf"^(?:{DIALLING}|\(?[2-9][0-9]{{2}}\)?[ .-]?[2-9])"), "iban": lambda: F.contains(F.lit(f" {ACCOUNT_LENGTHS} "), F.concat(F.lit(" "), F.substring(bare, 1, 2), F.length(bare).cast("string"), F.lit(" "))),
        "id": lambda: ~hit.rlike("^(?:078-05-1120|219-09-9999)$"), "name": lambda: hit.rlike(rf"(?:^| )(?:{'|'.join(GIVEN_NAMES.split())})(?: |$)"),
        "address": lambda: hit.rlike(rf"(?:{'|'.join(STREETS.split())}|stra(?:ß|ss)e [0-9]+[a-z]?)$"), "secret": lambda: hit.rlike(f"^(?:{SECRET_PREFIXES})$|^(?i:{SECRET_NAMES})"),
    }[kind]()
    context = _vote(before.rlike(rf"\b(?:{CONTEXT[kind]})") | (F.lit(kind == "secret") & hit.rlike(f"^(?i:{SECRET_NAMES})")), never)
    against = _vote(never, before.rlike(rf"\b(?:{AGAINST})"))
    clean = (before == "") | F.right(before, F.lit(1)).rlike(r"[\s,;:(\[<\"'=]")
    ends = (after == "") | F.substring(after, 1, 1).rlike(r"[\s,;:.)\]>\"'!?|#*%&$]")
    distinct = F.size(F.array_distinct(F.split(F.when(F.lit(kind in ("email", "name", "address", "secret")), hit).otherwise(digits), "")))
    variety = _vote(distinct >= (6 if kind == "secret" else 4), distinct <= 2)
    return [strict, shape, _vote(known, ~F.coalesce(known, F.lit(False))), context, against, _vote(clean & ends, ~clean & ~ends), variety]


def _features(kind: Column, hit: Column, digits: Column, before: Column, after: Column) -> Column:
    """Hashed features of a span: its votes, shape, ends and neighbours."""
    shape = hit
    for pattern, to in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), ("[0-9]+", "9"), (r"\s+", "_")):
        shape = F.regexp_replace(shape, pattern, to)
    last = r"([\p{L}0-9]+)[^\p{L}0-9]*$"
    parts = {
        "bias": F.lit(""), "shape": F.left(shape, F.lit(24)), "length": F.floor(F.log2(F.length(hit).cast("double") + 1)).cast("string"), "digits": F.length(digits).cast("string"), "first": F.left(digits, F.lit(2)),
        "last": F.lower(F.right(hit, F.lit(3))), "word": F.regexp_extract(before, last, 1), "word2": F.regexp_extract(before, r"([\p{L}0-9]+)[^\p{L}0-9]+" + last, 1), "mark": F.right(before, F.lit(1)),
        "next": F.substring(after, 1, 1), "after": F.regexp_extract(after, r"^[^\p{L}0-9]*([\p{L}0-9]+)", 1),
    }
    parts |= {name: F.get("votes", j).cast("string") for j, name in enumerate(LABELERS)}
    return F.array(*[F.pmod(F.xxhash64(kind, F.lit(name), v), F.lit(CELLS)).cast("int") for name, v in parts.items()])


_HIT = "array<struct<p:int,i:int,gap:int,hit:string,before:string,after:string>>"


def _hits(text: Column, p: int) -> Column:
    """Leftmost matches of a pattern that do not overlap, in order, with the length of the text before each (gap) and its ends."""
    kind, base, pattern = _PATTERNS[p]

    def told(m: Column, i: Column, between: Column) -> Column:
        gap = F.get(between, i)
        return F.struct(F.lit(p).alias("p"), i.alias("i"), F.length(gap).alias("gap"), m.alias("hit"), F.right(gap, F.lit(NEAR)).alias("before"), F.left(F.get(between, i + 1), F.lit(NEAR)).alias("after"))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))
    found = F.transform(F.array(both), lambda x: F.transform(x["m"], lambda m, i: told(m, i, x["b"])))[0]  # bound once
    return F.when(_gate(text, kind, base), found).otherwise(F.array().cast(_HIT))


def _by_pattern(value) -> Column:
    """value(kind, base) of the row's pattern p."""
    out = None
    for p, (kind, base, _) in enumerate(_PATTERNS):
        out = F.when(F.col("p") == p, value(kind, base)) if out is None else out.when(F.col("p") == p, value(kind, base))
    return out


def candidates(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs without text_col but with __row, spans): spans has a row for each candidate of a text.

    spans: __row, kind, rank, base, start, end (code points, end exclusive), votes, cells; base matches that fail their
    check are left out, and so are looser ones that overlap a base span.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    numeric = [p for p, (k, b, _) in enumerate(_PATTERNS) if k in ("card", "phone", "iban", "id", "address") or (k == "ip" and b)]  # these hold a digit
    hits = F.concat(F.when(text.rlike("[0-9]"), F.concat(*[_hits(text, p) for p in numeric])).otherwise(F.array().cast(_HIT)), *[_hits(text, p) for p in range(len(_PATTERNS)) if p not in numeric])
    found = saved(docs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__hits", hits).drop(text_col), "pii-hits")
    rows = found.where(F.size("__hits") > 0).select("__row", F.explode("__hits").alias("h")).select("__row", "h.*").repartition("__row")
    upto = Window.partitionBy("__row", "p").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.length("hit")).over(upto).cast("int"))
    rows = rows.withColumn("digits", F.regexp_replace("hit", "[^0-9]", "")).withColumn("before", F.lower("before"))
    hit, digits, before, after = (F.col(c) for c in ("hit", "digits", "before", "after"))
    rows = rows.where(_by_pattern(lambda kind, base: _holds(kind, hit, digits) if base else F.lit(True)))
    rows = rows.withColumn("votes", _by_pattern(lambda kind, base: F.array(*_votes(kind, base, hit, digits, before, after))))
    kind, rank, base = (_by_pattern(f) for f in (lambda k, b: F.lit(k), lambda k, b: F.lit(RANKS.index(k)), lambda k, b: F.lit(b)))
    rows = rows.select("__row", kind.alias("kind"), rank.alias("rank"), base.alias("base"), (F.col("end") - F.length("hit")).alias("start"), "end", "votes", _features(kind, hit, digits, before, after).alias("cells"))
    ahead = Window.partitionBy("__row").orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("__row").orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__upto", F.max(F.when(F.col("base"), F.col("end"))).over(ahead)).withColumn("__from", F.min(F.when(F.col("base"), F.col("start"))).over(behind))
    free = (F.coalesce("__upto", F.lit(-1)) <= F.col("start")) & (F.coalesce(F.col("__from") >= F.col("end"), F.lit(True)))
    return found.drop("__hits"), saved(rows.where(F.col("base") | free).drop("__upto", "__from"), "pii-spans")


def estimate(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) by expectation-maximisation over labeler reliabilities.

    Each labeler has, for each kind, a chance of each vote given a true or a false span; weak priors (a labeler is
    right more often than wrong) settle which class is which.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    prior = {(True, 1): 7.0, (True, 0): 3.0, (True, -1): 1.0, (False, 1): 2.0, (False, 0): 3.0, (False, -1): 5.0}
    for kind in dict.fromkeys(k for k, _ in counts):
        own = {v: n for (k, v), n in counts.items() if k == kind}
        labelers = range(len(next(iter(own))))
        chance = {(j, t, x): prior[t, x] / sum(prior[t, y] for y in (-1, 0, 1)) for j in labelers for t in (True, False) for x in (-1, 0, 1)}
        share, post = 0.5, {}
        for _ in range(rounds):
            for v in own:
                yes, no = math.log(share), math.log(1 - share)
                for j, x in enumerate(v):
                    yes += math.log(chance[j, True, x])
                    no += math.log(chance[j, False, x])
                post[v] = 1 / (1 + math.exp(min(50, max(-50, no - yes))))
            total = sum(own.values())
            true = sum(n * post[v] for v, n in own.items())
            share = (true + 2) / (total + 4)
            for j, t in product(labelers, (True, False)):
                mass = {x: 4 * prior[t, x] + sum(n * (post[v] if t else 1 - post[v]) for v, n in own.items() if v[j] == x) for x in (-1, 0, 1)}
                for x in mass:
                    chance[j, t, x] = mass[x] / sum(mass.values())
        out |= {(kind, v): p for v, p in post.items()}
    return out


def train(cells: np.ndarray, soft: np.ndarray, steps: int = 300, rate: float = 4.0, decay: float = 1e-3) -> np.ndarray:
    """CELLS weights of a logistic classifier; cells (spans, features) are places of ones, soft the labels' chances."""
    w = np.zeros(CELLS)
    if not len(cells):
        return w
    seen = np.maximum(np.bincount(cells.ravel(), minlength=CELLS), 1)
    for _ in range(steps):
        g = soft - 1 / (1 + np.exp(-np.clip(w[cells].sum(axis=1), -30, 30)))
        grad = np.bincount(cells.ravel(), weights=np.repeat(g, cells.shape[1]), minlength=CELLS)
        w += rate / cells.shape[1] * (grad / np.sqrt(seen * len(cells)) - decay * w)
    return w


def _score(cells: Column, weights: np.ndarray) -> Column:
    table_ = F.split(F.lit(",".join(f"{x:.6g}" for x in weights)), ",").cast("array<double>")  # folded into one literal
    z = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.get(table_, c))
    return 1 / (1 + F.exp(-z))


def find_personal_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text_col, with base and spans: arrays of (start, rank, kind, end), in order of start, then kind.

    Offsets count code points, ends are exclusive. Null and empty texts have no spans; columns named base, spans or
    __row are replaced. Rows that repeat are rows of their own. An empty table trains nothing and gives an empty table.
    """
    found, spans = candidates(docs.drop("base", "spans", "__row"), text_col)
    told = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()  # at most len(RANKS) * 3**len(LABELERS) rows
    posterior = estimate(dict(sorted(((r["kind"], tuple(r["votes"])), r["n"]) for r in told)))
    order = F.xxhash64("kind", "start", "votes", "cells")  # ties are alike to the classifier
    sample = spans.select(order.alias("o"), "kind", "votes", "cells").orderBy("o", "kind").limit(MAX_SPANS).collect()
    cells = np.array([r["cells"] for r in sample], np.int64).reshape(len(sample), -1 if sample else len(LABELERS))
    weights = train(cells, np.array([posterior[r["kind"], tuple(r["votes"])] for r in sample]))
    chosen = spans.where(F.col("base") | (_score(F.col("cells"), weights) >= THRESHOLD))
    one = F.struct("start", "rank", "kind", "end")
    arrays = chosen.groupBy("__row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), one))).alias("base"), F.array_sort(F.collect_list(one)).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    out = found.join(arrays, "__row", "left")
    return out.withColumns({"base": F.coalesce("base", none), "spans": F.coalesce("spans", none)}).drop("__row")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(own_columns(table(spark, sf_dir, "documents"), "doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op6_pii": query}
SQL: dict[str, str] = {}
