"""Text functions as column expressions: tokens, hashes, edit distances, Markdown, escaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list, the token pattern and the hash's constants.
STOP_WORDS = (
    "a an and are as at be been but by can could did do does for from had has have he her him his how "
    "if in into is it its just like may might more most no not of on one only or other our out over own "
    "said same she should so some such than that the their them then there these they this those to too "
    "two under up very was we were what when where which while who why will with without would you your"
).split()
TOKEN = r"[a-z][a-z'-]+"
MIN_TERM = 3
FNV_OFFSET, FNV_PRIME, MASK32 = 2166136261, 16777619, 4294967295
VECTOR_DIM = 160

#: White space in the Unicode sense, which Java's \s alone is not.
UNICODE_SPACE = r"[\s\x{a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def words(text: Column) -> Column:
    """Every match of TOKEN in the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def is_term(word: Column) -> Column:
    return (F.length(word) >= MIN_TERM) & ~word.isin(STOP_WORDS)


def terms(text: Column) -> Column:
    """Index terms, repeats kept: words of MIN_TERM letters or more that are no stop words."""
    return F.filter(words(text), is_term)


def distinct_terms(text: Column) -> Column:
    return F.array_distinct(terms(text))


def fnv1a(word: Column) -> Column:
    """32-bit FNV-1a of an ASCII word, as a long."""
    return F.aggregate(F.split(word, ""), F.lit(FNV_OFFSET).cast("long"), lambda h, c: h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(FNV_PRIME).cast("long") % F.lit(MASK32 + 1).cast("long"))


def dimension(word: Column, dim: int = VECTOR_DIM) -> Column:
    return (fnv1a(word) % dim).cast("int")


def sign(word: Column) -> Column:
    return F.when(fnv1a(word) >= 2147483648, F.lit(-1)).otherwise(F.lit(1))


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: insert, delete, substitute, swap of neighbours."""
    ca, cb = F.split(a, ""), F.split(b, "")
    first = F.sequence(F.lit(0), F.length(b))

    def row(state: Column, i: Column) -> Column:
        one = state["one"]
        x = F.element_at(ca, i)

        def cell(acc: Column, j: Column) -> Column:
            y = F.element_at(cb, j)
            up, diagonal, left = F.element_at(one, j + 1), F.element_at(one, j), F.element_at(acc, -1)
            best = F.least(up + 1, left + 1, diagonal + F.when(x == y, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (x == F.get(cb, j - 2)) & (F.get(ca, i - 2) == y)
            return F.array_append(acc, F.when(swap, F.least(best, F.get(state["two"], j - 2) + 1)).otherwise(best))

        return F.struct(one.alias("two"), F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell).alias("one"))

    walked = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(first.alias("two"), first.alias("one")), row, lambda s: F.element_at(s["one"], -1))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(walked)


def within_osa(a: Column, b: Column, k: int) -> Column:
    """osa(a, b) where it is at most k, else null. A cheap bound goes first: a swap costs two plain edits at most."""
    near = (F.abs(F.length(a) - F.length(b)) <= k) & (F.levenshtein(a, b, 2 * k) >= 0)
    return F.when(near, F.when(osa(a, b) <= k, osa(a, b)))


def _chain(col: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, col)


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, UNICODE_SPACE + "+", " "))


def markdown_text(source: Column) -> Column:
    """Markdown without its marks; each mark leaves a space, so words never run together."""
    bare = _chain(
        source,
        (r"(?s)```.*?```", " "),
        (r"(?m)^\s{0,3}#{1,6}\s+", ""),
        (r"!\[[^\]]*\]\([^)]*\)", " "),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[\^[^\]]+\]", " "),
        (r"(?m)^[ \t]*>[ \t]?", ""),
        (r"[*_`|]", " "),
    )
    return collapse_space(bare)


def headings(source: Column, most: int = 12) -> Column:
    """Texts of level 2 and 3 headings, distinct, in order, the first of them."""
    found = F.regexp_extract_all(source, F.lit(r"(?m)^\s{0,3}#{2,3}\s+(.+)$"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(F.transform(found, markdown_text), lambda t: t != "")), 1, most)


def title(source: Column) -> Column:
    """The first level 1 heading."""
    return markdown_text(F.regexp_extract(source, r"(?m)^#\s+(.+)$", 1))


def lede(source: Column, most: int = 420) -> Column:
    """The opening prose, after a status line if there is one, cut at a word."""
    prose = F.filter(F.split(source, "\n"), lambda x: ~x.rlike(r"^\s{0,3}#{1,6}\s|^\s*\[\^|^\s*\||^\s*>"))
    text = markdown_text(F.array_join(prose, "\n"))
    at = F.instr(text, "Status.")
    body = F.trim(F.when(at > 0, F.substring(text, at + 7, F.length(text))).otherwise(text))
    cut = F.substring(body, 1, most)
    space = F.length(cut) - F.instr(F.reverse(cut), " ")
    short = F.when((F.instr(cut, " ") > 0) & (space > most * 0.6), F.substring(cut, F.lit(1), space)).otherwise(cut)
    return F.when(F.length(body) <= most, body).otherwise(F.concat(short, F.lit("…")))


def body_after_rule(source: Column) -> Column:
    """What follows the first line of three hyphens; the whole where there is none."""
    return F.when(source.rlike(r"(?m)^---\s*$"), F.regexp_replace(source, r"(?s)\A.*?(?m:^---[ \t]*$)\n?", "")).otherwise(source)


def link_targets(source: Column) -> Column:
    """Slugs of links of the form ](/slug/."""
    return F.regexp_extract_all(source, F.lit(r"\]\(/([a-z0-9-]+)/"), F.lit(1))


def widget_slots(body: Column) -> Column:
    """Distinct values of data-viz attributes, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(body, F.lit("data-viz=(?:\"|')([^\"']+)(?:\"|')"), F.lit(1)))


def contents_list(body: Column, least: int = 5) -> Column:
    """Ids of level 2 headings where a page has at least so many; else null."""
    ids = F.regexp_extract_all(body, F.lit("<h2[^>]*\\sid=\"([^\"]+)\""), F.lit(1))
    return F.when(F.size(ids) >= least, ids)


def strip_comments(source: Column) -> Column:
    return _chain(source, (r"(?s)/\*.*?\*/", ""), (r"(?m)(^|\s)//.*$", "$1"))


def escape_markup(text: Column) -> Column:
    """Text for HTML or XML: & first, then < > \" '."""
    steps = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def url_component(text: Column) -> Column:
    """Percent-encoding that leaves ~!*'() and writes a space as %20."""
    steps = (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, F.url_encode(text))


def url_parameters(query: Column) -> Column:
    """Map of a query string; values are decoded, malformed escapes give null."""
    return F.transform_values(F.str_to_map(F.regexp_replace(query, r"^[?#]", ""), F.lit("&"), F.lit("=")), lambda k, v: F.try_url_decode(v))


def fragment_state(fragment: Column) -> Column:
    """Numeric widget state of #viz=w&k=v&other.k=v: (primary, map of widget.key to double)."""
    pairs = F.map_entries(url_parameters(fragment))
    primary = F.get(F.filter(pairs, lambda e: e["key"] == "viz"), F.lit(0))["value"]
    kept = F.filter(
        F.transform(pairs, lambda e: F.struct(F.when(F.instr(e["key"], ".") > 0, e["key"]).otherwise(F.concat_ws(".", primary, e["key"])).alias("key"), e["value"].try_cast("double").alias("value"))),
        lambda e: e["value"].isNotNull(),
    )
    return F.struct(primary.alias("primary"), F.map_from_entries(kept).alias("state"))


def query_url(q: Column, series: Column, kind: Column, sort: Column) -> Column:
    """?q=...&series=...&kind=...&sort=...; empty parts and the default sort are left out."""
    part = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(name + "="), url_component(c)))
    return F.concat(F.lit("?"), F.concat_ws("&", part("q", q), part("series", series), part("kind", kind), F.when(sort != "rel", part("sort", sort))))


def rfc822(date: Column) -> Column:
    """Midnight UTC of a date."""
    return F.date_format(date.cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def content_key(*parts: Column, digits: int = 16) -> Column:
    """Leading hex digits of SHA-256 over the parts, separated by a zero character."""
    return F.left(F.sha2(F.concat_ws("\x00", *parts).cast("binary"), 256), F.lit(digits))


def cursor_word(line: Column, at: Column) -> Column:
    """The letters before a caret, else the last word of the line."""
    before = F.regexp_extract(F.lower(F.left(line, at)), r"[a-z][a-z'-]*$", 0)
    return F.when(before != "", before).otherwise(F.regexp_extract(F.lower(line), r"([a-z][a-z'-]*)[^a-z]*$", 1))


def mark(text: Column, stems: list[str]) -> Column:
    """Wrap every word that begins with one of the stems (letters only), longer stems first."""
    alternatives = "|".join(sorted(stems, key=lambda s: (-len(s), s)))
    return F.regexp_replace(text, rf"(?i)\b(?:{alternatives})[a-z'-]*", "<mark>$0</mark>")


def mark_count(text: Column, stems: list[str]) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(rf"(?i)\b(?:{'|'.join(sorted(stems, key=lambda s: (-len(s), s)))})[a-z'-]*"), F.lit(0)))


def arrival_words(q: Column) -> Column:
    """Distinct index terms of a query by which a reader arrived: quotes part words, a marked word stays a word."""
    return F.array_distinct(terms(F.translate(q, '"“”', "   ")))


def normalize_argument(arg: Column) -> Column:
    """A command's argument: options go, one blank between parts, then a final .md, then the quotes around it."""
    parts = F.filter(F.split(F.coalesce(arg, F.lit("")), r"\s+"), lambda p: (p != "") & ~p.startswith("-"))
    bare = F.regexp_replace(F.array_join(parts, " "), r"\.md$", "")
    return F.regexp_replace(bare, r"""^["'](.*)["']$""", "$1")


def loose_json(text: Column) -> Column:
    """The object in a text as valid JSON: as it stands, else without trailing commas, else with bare names quoted too; null if none."""
    body = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    no_commas = F.regexp_replace(body, r",\s*([}\]])", "$1")
    quoted = F.regexp_replace(no_commas, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (body, no_commas, quoted)])


def opening_paragraphs(source: Column, least: int = 80, most: int = 6000) -> Column:
    """The leading paragraphs of a Markdown text that are longer than least, as many as fit into most characters.

    A paragraph counts with the break behind it. Without any such paragraph, the first characters of the plain text.
    """
    text = plain_markdown(source)
    long = F.filter(F.split(text, r"\n\s*\n"), lambda p: F.length(trim_space(p)) > least)
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("n"), F.lit(False).alias("full"))

    def take(s: Column, p: Column) -> Column:
        full = s["full"] | (s["chars"] + F.length(p) > most)
        more = lambda a, b: F.when(full, a).otherwise(b)
        return F.struct(more(s["chars"], s["chars"] + F.length(p) + 2).alias("chars"), more(s["n"], s["n"] + 1).alias("n"), full.alias("full"))

    n = F.aggregate(long, start, take, lambda s: s["n"])
    taken = trim_space(F.array_join(F.slice(long, F.lit(1), n), "\n\n"))
    return F.when(taken != "", taken).otherwise(F.left(text, F.lit(most)))


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: Fixed patterns of marks that a reader does not see, and what stands in their place.
MARKS = (
    (r"(?m)^---$", " "),
    (r"(?s)```.*?```", " "),
    (r"`([^`]*)`", "$1"),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?m)^\s{0,3}#{1,6}\s+", ""),
    (r"(?m)^\s{0,3}>\s?", ""),
    (r"(?m)^\s{0,3}[-*+]\s+", ""),
    (r"\*\*([^*]*)\*\*", "$1"),
    (r"\*([^*]*)\*", "$1"),
    (r"\[\^[^\]]*\]", " "),
    (r"\n{3,}", "\n\n"),
)


def plain_markdown(source: Column) -> Column:
    return trim_space(_chain(F.coalesce(source, F.lit("")), *MARKS))


def fragment(primary: Column, own: Column, others: Column) -> Column:
    """viz=w&k=v&other.k=v of a widget's own map and a map of widget.key, keys in order; what fragment_state reads."""
    parts = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), url_component(e["value"])))
    return F.array_join(F.concat(F.array(F.concat(F.lit("viz="), primary)), parts(own), parts(others)), "&")


def changed_fragment(now: Column, before: Column) -> Column:
    """The fragment to write: null where it is what is there already."""
    return F.when(~now.eqNullSafe(before), now)
