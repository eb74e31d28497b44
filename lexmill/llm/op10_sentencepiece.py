"""SentencePiece models run by the tokenizers library: rebuilt from the model's protobuf, and checked for parity.

The model file is read by a small wire-format reader: pieces with scores and types, the trainer's model type and byte
fallback, and the normaliser's flags and character map. A unigram model keeps its scores; a BPE model's merges follow
from its scores (a piece that two pieces make is a merge, better scores first). White space becomes the metaspace
marker. Where no piece has a marker behind other characters, a text is cut before markers, as no merge crosses there;
the library then encodes each distinct word once, and a text's ids are those of its words. Whole texts are encoded in
batches, bounded by characters.
"""

from __future__ import annotations

import hashlib
import importlib.util
import os
import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import table

NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"

#: A word: markers and what follows them up to the next marker.
WORD = f"{MARK}+[^{MARK}]*|[^{MARK}]+"

#: Characters a batch may hold (a longer text is a batch of its own), and the library's threads in a task.
BATCH_CHARS = 2_000_000
THREADS = 1
#: Words are forgotten once they hold more characters than this; a later batch encodes its own anew.
WORDS_CHARS = 8_000_000


def default_model_path() -> str:
    """The public 32k model of the box; pass another path to use another model."""
    spec = importlib.util.find_spec("public_tokenizers")
    folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "piece_bpe_32k.model")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message: ints, 4- or 8-byte strings, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield tag >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    char_map: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> Model:
    m = Model()
    for n, v in _fields(data):
        if n == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, x in _fields(v):
                if k == 1:
                    text = x.decode()
                elif k == 2:
                    score = struct.unpack("<f", x)[0]
                elif k == 3:
                    kind = x
            m.pieces.append((text, score, kind))
        elif n == 2:
            for k, x in _fields(v):
                if k == 3:
                    m.kind = x
                elif k == 35:
                    m.byte_fallback = bool(x)
        elif n == 3:
            for k, x in _fields(v):
                if k == 2:
                    m.char_map = x
                elif k == 3:
                    m.add_dummy_prefix = bool(x)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(x)
                elif k == 5:
                    m.escape_whitespaces = bool(x)
    return m


def build_tokenizer(m: Model):
    """A tokenizers.Tokenizer with the model's normaliser, marker, scores or merges, and byte fallback."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
        scores = [s for _, s, _ in m.pieces]
        merges = []
        for p, i in ids.items():
            cuts = [(p[:k], p[k:]) for k in range(1, len(p))]
            merges += [(-scores[i], i, ids[a], ids[b], a, b) for a, b in cuts if a in ids and b in ids]
        merges.sort()
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, [x[4:] for x in merges], unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError("neither a unigram nor a BPE model")
    t = Tokenizer(model)
    steps = []
    if m.char_map:
        steps.append(normalizers.Precompiled(m.char_map))
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p, _, _ in m.pieces):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    tail = [decoders.ByteFallback(), decoders.Fuse()]
    tail += [decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Metaspace(MARK, "never", False), *tail])
    return t


@lru_cache(maxsize=2)
def _tokenizer(data: bytes):
    os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if THREADS > 1 else "false"
    return build_tokenizer(parse_model(data))


class Words:
    """Encodes texts by their words, as the library's own cut makes them; it gets each distinct word once, until forgotten."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        m, t = parse_model(data), _tokenizer(data)
        self.model = Tokenizer(t.model)
        self.normalise = t.normalizer.normalize_str
        if not m.char_map and not m.remove_extra_whitespaces:
            self.normalise = lambda x: (" " * m.add_dummy_prefix + x).replace(" ", MARK if m.escape_whitespaces else " ")
        self.find = re.compile(WORD).findall
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.chars = 0
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, known: int) -> None:
        words = list(islice(reversed(self.number), len(self.number) - known))[::-1]
        ids = [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.chars += sum(map(len, words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.chars > WORDS_CHARS:
            self.forget()
        words = [self.find(self.normalise(x)) if x else [] for x in texts]
        n_words = np.fromiter(map(len, words), np.int64, len(words))
        known = len(self.number)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(n_words.sum()))
        if len(self.number) > known:
            self._learn(known)
        begins, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(n_words)])]


@lru_cache(maxsize=2)
def _words(data: bytes) -> Words | None:
    """None where the model's pieces join words."""
    return Words(data) if _tokenizer(data).pre_tokenizer else None


def encode_flat(data: bytes, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text's begin, with the end; an empty text has none."""
    words = _words(data)
    if words:
        return words.encode(texts)
    ids = [e.ids if x else [] for x, e in zip(texts, _tokenizer(data).encode_batch_fast(texts, add_special_tokens=False))]
    ends = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64)])
    return np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1])), ends


def encode_batch(data: bytes, texts: list[str]) -> list[list[int]]:
    """Ids of each text; an empty text has none."""
    ids, ends = encode_flat(data, texts)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def decode_batch(data: bytes, ids: list[list[int]]) -> list[str]:
    return _tokenizer(data).decode_batch(ids, skip_special_tokens=False)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def _library(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def encode(docs: DataFrame, text_col: str = "text", model_path: str | None = None, round_trip: bool = True, verify_every: int = 0) -> DataFrame:
    """docs with ids (array of int, null for a null text), n_tokens (long) and, if asked, decoded (string) and parity.

    parity (boolean, null for a null text) tells whether the sentencepiece library's own ids are the same: of every text
    with verify_every = 1, as the query asks for; of those whose hash leaves 0 when divided by a larger number, others
    having null; 0 leaves the column out. The driver reads the model and ships it (its size is fixed). Columns of these
    names in docs are replaced; empty texts have no ids and decode to an empty text.
    """
    from pyspark.sql import types as T

    data = read_model(model_path or default_model_path())
    docs = docs.drop("ids", "n_tokens", "decoded", "parity")
    schema = T.StructType(docs.schema.fields + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())] + ([T.StructField("decoded", T.StringType())] if round_trip else []) + ([T.StructField("parity", T.BooleanType())] if verify_every else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in b.column(text_col)]
            at = 0
            while at < b.num_rows:
                to, chars = at, 0
                while to < b.num_rows and (to == at or chars + sizes[to] <= BATCH_CHARS):
                    chars += sizes[to]
                    to += 1
                part = b.slice(at, to - at)
                texts = part.column(text_col).to_pylist()
                flat, ends = encode_flat(data, [x or "" for x in texts])
                ids = [flat[a:b] for a, b in zip(ends, ends[1:])]
                null = np.array([x is None for x in texts], bool)
                cols = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()), mask=pa.array(null)), pa.array(np.diff(ends), pa.int64(), mask=null)]
                names = ["ids", "n_tokens"]
                if round_trip:
                    cols.append(pa.array([None if x is None else d for x, d in zip(texts, decode_batch(data, [i.tolist() for i in ids]))], pa.string()))
                    names.append("decoded")
                if verify_every:
                    chosen = [x is not None and (verify_every == 1 or xxhash.xxh64_intdigest(x.encode()) % verify_every == 0) for x in texts]
                    cols.append(pa.array([np.array_equal(_library(data).encode_as_numpy(x), i) if c else None for x, i, c in zip(texts, ids, chosen)], pa.bool_()))
                    names.append("parity")
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *names])
                at = to

    return docs.mapInArrow(run, schema)


def sentencepiece_parity(texts: list[str], model_path: str | None = None) -> list[int]:
    """Positions of texts whose ids differ from the sentencepiece library's own."""
    import sentencepiece

    path = model_path or default_model_path()
    own = encode_batch(read_model(path), texts)
    told = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts, num_threads=1)
    return [i for i, (a, b) in enumerate(zip(own, told)) if a != b]


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), verify_every=1)
    return out.select(
        "doc_id",
        F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.coalesce("decoded", F.lit("")).cast("binary"), 256).alias("decoded_sha256"),
        (F.coalesce("decoded", F.lit("")) == F.coalesce("text", F.lit(""))).alias("round_trip"),
        "parity",
    )


QUERIES = {"op10_sentencepiece": query}
SQL: dict[str, str] = {}
