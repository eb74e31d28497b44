"""Language identification: scripts narrow the candidates, then Viterbi labels the words of mixed-language text.

A word is a run of letters, with the marks that combine with them. Its score for a language is the sum of log-probabilities of its character 1- to 3-grams
(with its borders), which are hashed into BUCKETS cells an order; only languages that the training texts show in the
word's script stay candidates. Viterbi over a text's words pays SWITCH for each change of language; the text's language
is the one whose labelled words have most letters, and its score is their share of all letters.

Training counts n-grams on about MAX_TRAIN labelled texts a language (by a hash of the id), so that rare languages are
learned as well as frequent ones, and collects one table of fixed size a language. Whole texts are scored, several of them at once in numpy.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import checked_broadcast, own_columns, saved, table

ORDERS = 3
BUCKETS = 1 << 16
SWITCH = 12.0
SMOOTHING = 0.1
#: Labelled texts that are learned from, about, for each language.
MAX_TRAIN = 1_500
#: A language is a candidate in a script that holds at least this share of its training letters.
SCRIPT_SHARE = 0.01
OUT_OF_SCRIPT = 60.0
_CHARS = 1 << 20

#: First and last code points of scripts; letters elsewhere are of one further script.
SCRIPTS = (
    ("latin", ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F))),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))),
    ("devanagari", ((0x900, 0x97F),)),
    ("bengali", ((0x980, 0x9FF),)),
    ("tamil", ((0xB80, 0xBFF),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF), (0x31F0, 0x31FF))),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))),
)
N_SCRIPTS = len(SCRIPTS) + 1


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: letter?, combining mark?, script, lower-case form."""
    letter, mark, low = np.zeros(0x110000, bool), np.zeros(0x110000, bool), np.arange(0x110000, dtype=np.int32)
    for i in range(0x110000):
        if 0xD800 <= i < 0xE000 or 0x40000 <= i:
            continue
        c = chr(i)
        mark[i] = unicodedata.category(c) in ("Mn", "Mc")
        if c.isalpha():
            letter[i] = True
            x = c.lower()
            if len(x) == 1:
                low[i] = ord(x)
    script = np.full(0x110000, len(SCRIPTS), np.int8)
    for k, (_, ranges) in enumerate(SCRIPTS):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, mark, script, low


@dataclass
class Words:
    """Words of several texts: doc, letters and script of each, and the cells of its n-grams."""

    doc: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray  # of each word, the row of cells where its n-grams begin
    cells: np.ndarray  # (n-gram places, ORDERS)


def words_of(texts: list[str]) -> Words:
    letter, mark, script, low = _tables()
    code = np.frombuffer(("\x00" + "\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    doc_of = np.cumsum(code == 0, dtype=np.int32) - 1 if not any("\x00" in t for t in texts) else np.concatenate([[0], np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])])
    is_letter, is_mark = letter[code], mark[code]
    host = np.maximum.accumulate(np.where(is_mark, 0, np.arange(len(code))))  # what a mark combines with
    is_letter |= is_mark & is_letter[host]
    c = np.where(is_letter, low[code], 32).astype(np.uint32)
    before = np.concatenate([[False], is_letter[:-1]])
    begins = np.flatnonzero(is_letter & ~before)
    place = np.flatnonzero(is_letter | before)  # a word's letters and the border behind it
    one = c[place]
    two = np.concatenate([[32], c[:-1]]).astype(np.uint32)[place]
    three = np.concatenate([[32, 32], c[:-2]]).astype(np.uint32)[place]
    three = np.where(two == 32, 32, three)
    h = one * np.uint32(0x9E3779B1)
    cells = np.empty((len(place), ORDERS), np.int32)
    cells[:, 0] = (h >> 16) % BUCKETS
    h = (h ^ two) * np.uint32(0x85EBCA77)
    cells[:, 1] = (h >> 16) % BUCKETS + BUCKETS
    h = (h ^ three) * np.uint32(0xC2B2AE3D)
    cells[:, 2] = (h >> 16) % BUCKETS + 2 * BUCKETS
    first = np.searchsorted(place, begins)
    letters = np.diff(np.append(first, len(place))) - 1
    return Words(doc_of[begins], letters, script[code[begins]], first, cells)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (ORDERS * BUCKETS, languages)
    allowed: np.ndarray  # (scripts, languages)


def word_scores(w: Words, model: Model) -> np.ndarray:
    """(words, languages) scores, out-of-script candidates held down."""
    if not len(w.doc):
        return np.zeros((0, len(model.langs)), np.float32)
    s = model.logp[w.cells[:, 0]]
    for k in range(1, ORDERS):
        s += model.logp[w.cells[:, k]]
    out = np.add.reduceat(s, w.first, axis=0)
    fits = model.allowed[w.script]
    fits |= ~fits.any(axis=1, keepdims=True)
    return out - np.where(fits, 0, OUT_OF_SCRIPT).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best labels of texts whose words' scores stand one after another; all texts advance together."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    starts, lens = starts[order], lengths[order]
    label = np.zeros(len(scores), np.int16)
    back = np.zeros(scores.shape, np.int16)
    if not len(scores):
        return label
    own = np.arange(scores.shape[1], dtype=np.int16)
    active = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right")  # texts that have a word at each step
    best = scores[starts[: active[0]]].astype(np.float64)
    ends = np.empty((len(lens), scores.shape[1]))
    for t in range(1, lens[0]):
        n = active[t]
        if n < len(best):
            ends[n : len(best)] = best[n:]
            best = best[:n]
        top = best.argmax(axis=1)
        moved = best[np.arange(n), top] - switch
        stay = best >= moved[:, None]
        at = starts[:n] + t
        back[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, moved[:, None]) + scores[at]
    ends[: len(best)] = best
    now = np.zeros(len(lens), np.int64)
    for t in range(lens[0] - 1, -1, -1):
        n = active[t]
        fresh = slice(active[t + 1] if t + 1 < lens[0] else 0, n)
        now[fresh] = ends[fresh].argmax(axis=1)
        at = starts[:n] + t
        label[at] = now[:n]
        now[:n] = back[at, now[:n]]
    return label


def identify(texts: list[str | None], model: Model) -> list[tuple[str, float]]:
    """(language, score) of each text; ("und", 0.0) where it is null or has no letters."""
    return [x[:2] for x in _labelled(texts, model)[0]]


def _labelled(texts: list[str | None], model: Model):
    w = words_of([x or "" for x in texts])
    counts = np.bincount(w.doc, minlength=len(texts))
    has = np.flatnonzero(counts)
    label = viterbi(word_scores(w, model), counts[has])
    n = len(model.langs)
    votes = np.bincount(w.doc * n + label, weights=w.letters, minlength=len(texts) * n).reshape(len(texts), n)
    total = votes.sum(axis=1)
    learned = model.langs != ["und"]
    out = [(model.langs[int(v.argmax())], float(v.max() / t)) if t > 0 and learned else ("und", 0.0) for v, t in zip(votes, total)]
    return out, w, label


def spans(text: str, model: Model) -> list[tuple[str, int]]:
    """(language, words) of the consecutive words of one language in a text."""
    _, _, label = _labelled([text], model)
    cut = np.flatnonzero(np.diff(label)) + 1
    return [(model.langs[int(p[0])], len(p)) for p in np.split(label, cut) if len(p)]


def _sliced(b: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in b.column(col)]
    at = 0
    while at < b.num_rows:
        to, chars = at, 0
        while to < b.num_rows and (to == at or chars + sizes[to] <= _CHARS):
            chars += sizes[to]
            to += 1
        yield b.slice(at, to - at)
        at = to


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from labelled(id, text, lang), of which about max_train rows a language are used; no rows give a model of "und"."""
    rows = labelled.where("text is not null and lang is not null")
    told = saved(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages").withColumnRenamed("lang", "of")
    share = F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.lit(1_000_000)) * F.col("n") < 1_000_000 * max_train
    rows = rows.join(checked_broadcast(told), F.col("lang") == F.col("of")).where(share)
    schema = pa.schema([("lang", pa.string()), ("cell", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = ORDERS * BUCKETS
        counts: dict[str, np.ndarray] = {}
        for big in batches:
            for b in _sliced(big, 0):
                texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
                for lang in sorted(set(langs)):
                    w = words_of([t for t, x in zip(texts, langs) if x == lang])
                    own = counts.setdefault(lang, np.zeros(width + N_SCRIPTS, np.int64))
                    own[:width] += np.bincount(w.cells.ravel(), minlength=width)
                    own[width:] += np.bincount(w.script, weights=w.letters, minlength=N_SCRIPTS).astype(np.int64)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(own[at])], schema=schema)

    got = rows.select("text", "lang").mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist())) or ["und"]
    width = ORDERS * BUCKETS
    counts = np.zeros((width + N_SCRIPTS, len(langs)))
    if got.num_rows:
        counts[got.column("cell").to_numpy(), np.searchsorted(np.array(langs, dtype=object), got.column("lang").to_numpy())] = got.column("n").to_numpy()
    grams = counts[:width].reshape(ORDERS, BUCKETS, len(langs)) + SMOOTHING
    logp = np.log(grams / grams.sum(axis=1, keepdims=True)).reshape(width, len(langs)).astype(np.float32)
    seen = counts[width:]
    return Model(langs, logp, seen >= SCRIPT_SHARE * np.maximum(seen.sum(axis=0), 1))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score in place of text_col; columns of these names are replaced.

    A null text, and one without letters, is "und" with score 0.
    """
    from pyspark.sql import types as T

    docs = docs.drop("lang_pred", "score")
    rest = [f for f in docs.schema.fields if f.name != text_col]
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # ORDERS * BUCKETS cells a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _sliced(big, big.schema.get_field_index(text_col)):
                found = identify(b.column(text_col).to_pylist(), shipped.value)
                keep = [b.column(f.name) for f in rest]
                yield pa.RecordBatch.from_arrays([*keep, pa.array([x for x, _ in found]), pa.array([s for _, s in found], pa.float64())], names=[*(f.name for f in rest), "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType(rest + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(id_col: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = own_columns(docs, "doc_id", "text", "lang").toDF("id", "text", "lang").where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    out = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(train))
    return out.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_language_id": query}
SQL: dict[str, str] = {}
