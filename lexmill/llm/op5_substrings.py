"""Substring de-duplication with prefix-partitioned suffix trees over words, cut at the depth of a window.

A repeat of WINDOW words is an internal node of that depth in the suffix tree of all documents. The tree is never
built whole:

1. Statistics. Every window is summarised by the least of its word GRAM-grams, which equal windows share; a gram value
   met in one text only cannot lie on a repeat of different texts. The same pass counts suffixes by prefixes of DEPTHS
   words in hashed counters of a fixed number, and words for the code table.
2. Suffixes whose gram value is shared (kept as a bitmap of bounded size that may let others through, but drops none)
   are dealt to subtrees by prefixes of variable length: the shortest of DEPTHS whose counter shows a group of a size
   that suits one task. Where the whole window is still too frequent, its suffixes are salted.
3. A subtree is built from its sorted suffixes. A suffix is written down to the window's depth as its words themselves,
   frequent ones by a prefix-free code of one to three bytes, others in full; so suffixes compare as their words do, and
   no hash decides. Runs of equal suffixes are the nodes of that depth; leaves of a node in other documents than its
   first are repeats. Salted parts report their first leaves, and a last step settles these across the parts. A suffix
   is dealt and sorted as one string of bytes (subtree, words, leaf), whose order is that of its words and leaves.
4. Covered words are marked by document and the rest is put together. Texts that equal one of a smaller document need no
   tree: all their windows are repeats.

repeated_passages() chains the leaves of deep nodes into maximal repeats: passages that cannot be extended on either side.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import drop_saved, own_columns, saved, shuffle_partitions, table

WINDOW = 13
GRAM = 5
DEPTHS = (1, 2, 4, WINDOW)
#: Bits of the bitmap of shared gram values: 16 for each, between these bounds (at most 16 MB are broadcast).
BITS_MIN, BITS_MAX = 1 << 16, 1 << 27
#: Words that have a code, at most (the table is broadcast); words without one are written in full.
CODED = 65_000
#: Bytes that name a suffix's subtree, and part of it if it is salted: a hash, and whether it is.
TAG = 3
_NO_ID = -(1 << 63)
_CHARS = 1 << 21
_WORDS_HELD = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RNG = np.random.default_rng(5)
_A = _RNG.integers(1, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def split_words(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts, one after another, and how many each text has."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    space = _SPACE[raw]
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    lens = np.flatnonzero(~space[:-1] & space[1:]) + 1 - begins
    bounds = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([[0], np.searchsorted(begins, bounds, side="right")]))
    offsets = np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lens), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[~space]))]), counts


def _pieces(x: pa.BinaryArray) -> list[bytes]:
    """x.to_pylist(), sooner."""
    if not len(x):
        return []
    at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].tolist()
    raw = x.buffers()[2].to_pybytes()
    return [raw[a:b] for a, b in zip(at, at[1:])]


class Suffixes:
    """The windows of several texts: the text and place of each, and where it starts among all words."""

    def __init__(self, texts: list[bytes]):
        words, counts = split_words(texts)
        coded = words.dictionary_encode()
        self.word, self.distinct = coded.indices.to_numpy(), _pieces(coded.dictionary)
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct), np.uint64, len(self.distinct))[self.word] if len(self.word) else np.zeros(0, np.uint64)
        ends = np.cumsum(counts)
        n = np.maximum(counts - WINDOW + 1, 0)
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.pos = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        self.at = np.repeat(ends - counts, n) + self.pos

    def _combined(self, depth: int) -> np.ndarray:
        m = len(self.hash) - depth + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        out = self.hash[:m] * _A[0]
        for j in range(1, depth):
            out = out + self.hash[j : j + m] * _A[j]
        return _mix(out + np.uint64(depth))

    def prefix(self, depth: int) -> np.ndarray:
        """A hash of each suffix's first words; it only deals suffixes to subtrees."""
        return self._combined(depth)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def least_gram(self) -> np.ndarray:
        if not len(self.at):
            return np.zeros(0, np.uint64)
        low, have, span = self._combined(GRAM), 1, WINDOW - GRAM + 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        return low[self.at]

    def only(self, on: np.ndarray) -> None:
        self.doc, self.pos, self.at = self.doc[on], self.pos[on], self.at[on]

    def written(self, codes: dict[bytes, bytes]) -> pa.BinaryArray:
        """Each suffix down to the window's depth, in codes."""
        of = [codes.get(w) or b"\xfe" + w + b" " for w in self.distinct]
        lens = np.fromiter(map(len, of), np.int64, len(of))
        flat, starts = np.frombuffer(b"".join(of), np.uint8), np.cumsum(lens) - lens
        n = len(self.word) + 1
        mark = np.bincount(self.at, minlength=n) - np.bincount(self.at + WINDOW, minlength=n)
        used = np.cumsum(mark[:-1]) > 0  # only words on windows that are asked for are laid out
        own = np.where(used, lens[self.word], 0)
        stream = flat[np.repeat(starts[self.word], own) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)]
        upto = np.concatenate([[0], np.cumsum(own)])
        begin, size = upto[self.at], upto[self.at + WINDOW] - upto[self.at]
        return _gathered(stream, begin, size)


def _gathered(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.BinaryArray:
    """These stretches of raw, each of more than 12 bytes, as views do not hold them themselves."""
    views = np.zeros((len(size), 4), np.int32)
    views[:, 0], views[:, 3] = size, begin
    return pa.Array.from_buffers(pa.binary_view(), len(size), [None, pa.py_buffer(views), pa.py_buffer(raw)]).cast(pa.binary())


def without_tag(key: pa.BinaryArray, at: np.ndarray) -> pa.BinaryArray:
    """The words alone of the strings that stand at these places of what unpacked_leaves() gave."""
    offsets = np.frombuffer(key.buffers()[1], np.int32).astype(np.int64)
    return _gathered(np.frombuffer(key.buffers()[2], np.uint8), offsets[at] + TAG, offsets[at + 1] - offsets[at] - TAG)


def packed_leaves(tag: np.ndarray, suffix: pa.BinaryArray, doc: np.ndarray, th: np.ndarray | None, pos: np.ndarray) -> pa.BinaryArray:
    """A string of bytes for each suffix: TAG bytes of tag, its words, doc, th unless it is None, pos, and how long what follows the words is.

    Words are prefix-free, so strings are in the order of tag, words, doc, th and pos. Numbers have leading zeros left
    out: doc begins with 8 and its number of bytes, or with 0 if it is negative; pos with its number of bytes in two bits.
    """
    n = len(suffix)
    big = lambda x: np.ascontiguousarray(x.astype(">u8")).view(np.uint8).reshape(n, 8)
    size = lambda x, bits: sum(((x >> np.uint64(b)) > 0).astype(np.int64) for b in bits)
    above, p = doc >= 0, pos.astype(np.uint64)
    docs = big(np.where(above, doc, doc ^ _NO_ID).view(np.uint64))
    doc_size = np.where(above, size(doc.view(np.uint64), range(0, 64, 8)), 8)
    pos_size = 1 + size(p, (6, 14, 22))
    places = big(p | (pos_size - 1).astype(np.uint64) << (8 * pos_size - 2).astype(np.uint64))
    th_size = 0 if th is None else 8
    tail = 2 + doc_size + th_size + pos_size
    words = np.diff(np.frombuffer(suffix.buffers()[1], np.int32)[: n + 1]).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(TAG + words + tail)])
    out = np.empty(offsets[-1], np.uint8)
    tags, at = big(tag.astype(np.uint64)), offsets[:-1]
    for j in range(TAG):
        out[at + j] = tags[:, 8 - TAG + j]
    spread = np.zeros(len(out) + 1, np.int8)
    spread[at + TAG] = 1
    spread[at + TAG + words] = -1
    data = suffix.buffers()[2]
    out[np.cumsum(spread[:-1], dtype=np.int8).view(bool)] = np.frombuffer(data, np.uint8)[: words.sum()] if n else []
    at = at + TAG + words
    out[at] = np.where(above, 8 + doc_size, 0)
    at = at + 1
    for j in range(8):
        on = doc_size > j
        out[at[on] + j] = docs[on, 8 - doc_size[on] + j]
    at = at + doc_size
    if th is not None:
        told = big((th ^ _NO_ID).view(np.uint64))
        for j in range(8):
            out[at + j] = told[:, j]
        at = at + 8
    for j in range(4):
        on = pos_size > j
        out[at[on] + j] = places[on, 8 - pos_size[on] + j]
    out[at + pos_size] = tail
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])


def unpacked_leaves(rows: pa.BinaryArray, with_th: bool) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(tag and words, whether the tag is odd, doc, th, pos) of what packed_leaves() has made."""
    n = len(rows)
    offsets = np.frombuffer(rows.buffers()[1], np.int32)[rows.offset : rows.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(rows.buffers()[2], np.uint8)
    tail = raw[offsets[1:] - 1].astype(np.int64)
    at = offsets[1:] - tail
    size = at - offsets[:-1]
    key = _gathered(raw, offsets[:-1], size)

    def number(at: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        for j in range(most):
            on = size > j
            out[on] = out[on] << np.uint64(8) | raw[at[on] + j].astype(np.uint64)
        return out

    head = raw[at].astype(np.int64)
    doc_size = np.where(head > 0, head - 8, 8)
    doc = number(at + 1, doc_size, 8).view(np.int64)
    doc = np.where(head > 0, doc, doc ^ _NO_ID)
    at = at + 1 + doc_size
    th = number(at, np.full(n, 8), 8).view(np.int64) ^ _NO_ID if with_th else None
    pos_size = tail - 2 - doc_size - (8 if with_th else 0)
    pos = number(at + (8 if with_th else 0), pos_size, 4) & ((np.uint64(1) << (8 * pos_size - 2).astype(np.uint64)) - np.uint64(1))
    return key, raw[offsets[:-1] + TAG - 1] & 1 == 1, doc, th, pos.astype(np.int32)


def word_codes(words: list[bytes]) -> dict[bytes, bytes]:
    """Prefix-free codes, short ones first: 200 of one byte, 12,800 of two, the rest of three. 0xFE begins a word in full."""
    out = {}
    for r, w in enumerate(words[:CODED]):
        if r < 200:
            out[w] = bytes([r])
        elif r < 13_000:
            out[w] = bytes([200 + (r - 200) // 256, (r - 200) % 256])
        else:
            out[w] = bytes([250 + (r - 13_000) // 65_536, (r - 13_000) // 256 % 256, (r - 13_000) % 256])
    return out


def _sliced(big: pa.RecordBatch, col: int) -> Iterator[pa.RecordBatch]:
    sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in big.column(col)]
    at = 0
    while at < big.num_rows:
        to, chars = at, 0
        while to < big.num_rows and (to == at or chars + sizes[to] <= _CHARS):
            chars += sizes[to]
            to += 1
        yield big.slice(at, to - at)
        at = to


def _bytes(col: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in col]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _statistics(docs: DataFrame, counters: int) -> DataFrame:
    """docs(doc, th, text) -> (kind, key, word, lo, hi, n): kind 0 has gram values met in several texts, -1 words that are frequent in a task, others a depth's counters."""
    schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("word", pa.binary()), ("v", pa.int64())])

    def rows(kind: int, key: pa.Array, v: pa.Array, word: pa.Array | None = None) -> pa.RecordBatch:
        n = len(key)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), key, word if word is not None else pa.nulls(n, pa.binary()), v], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words, total = np.zeros((len(DEPTHS), counters), np.int64), Counter(), 0
        for big in batches:
            for b in _sliced(big, 1):
                s = Suffixes(_bytes(b.column(1)))
                total += len(s.word)
                words.update(dict(zip(s.distinct, np.bincount(s.word, minlength=len(s.distinct)).tolist())))
                if len(words) > _WORDS_HELD:
                    words = Counter({w: n for w, n in words.items() if n > total >> 16})
                for k, d in enumerate(DEPTHS):
                    counts[k] += np.bincount((s.prefix(d) % np.uint64(counters)).astype(np.int64), minlength=counters)
                g, text = s.least_gram(), b.column(0).to_numpy()[s.doc]
                if len(g):
                    new = np.concatenate([[True], (g[1:] != g[:-1]) | (text[1:] != text[:-1])])
                    yield rows(0, _long(g[new]), pa.array(text[new]))
        for k in range(len(DEPTHS)):
            at = np.flatnonzero(counts[k])
            yield rows(k + 1, pa.array(at), pa.array(counts[k][at]))
        told = [(w, n) for w, n in words.items() if n > max(1, total >> 16)]
        yield rows(-1, pa.array(np.zeros(len(told), np.int64)), pa.array([n for _, n in told], pa.int64()), pa.array([w for w, _ in told], pa.binary()))

    found = docs.select("th", "text").mapInArrow(run, "kind int, key long, word binary, v long")
    found = found.groupBy("kind", "key", "word").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.when(F.col("kind") != 0, F.col("v"))).alias("n"))
    return saved(found.where((F.col("kind") != 0) | (F.col("lo") < F.col("hi"))).select("kind", "key", "word", "n"), "suffix-statistics", release=True)


def _bitmap(shared: DataFrame) -> np.ndarray:
    """Bits of the shared gram values; its size is bounded, and a full one only lets more suffixes through."""
    n = shared.count()
    bits = BITS_MIN
    while bits < min(BITS_MAX, 16 * n):
        bits *= 2
    segment = 1 << 16
    schema = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            at = (b.column(0).to_numpy().view(np.uint64) % np.uint64(bits)).astype(np.int64)
            for s in np.unique(at // segment):
                own = held.setdefault(int(s), np.zeros(segment, bool))
                own[at[at // segment == s] % segment] = True
        for s, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], schema=schema)

    unsigned = F.pmod(F.shiftrightunsigned("key", 1) % (bits // 2) * 2 + F.col("key").bitwiseAND(1), F.lit(bits))
    dealt = shared.select("key").repartition(min(shuffle_partitions(shared.sparkSession), bits // segment), F.floor(unsigned / segment))
    out = np.zeros((bits // segment, segment // 8), np.uint8)
    for r in dealt.mapInArrow(run, "segment int, bits binary").collect():
        out[r["segment"]] |= np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def repeated_windows(docs: DataFrame, with_first: bool = False, one_text_a_doc: bool = False) -> DataFrame:
    """docs(doc long, th long, text) -> (doc, th, pos int): windows whose words also start in a document of a smaller doc.

    with_first adds first (doc, th, pos), where the words start first. Windows that only stand in equal texts (of one
    th) are left out. Where each doc has one text, as one_text_a_doc says, th is null, as rows need not carry it.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    counters = 1 << max(12, min(20, (16 * parts - 1).bit_length()))
    stats = _statistics(docs, counters)
    counts = np.zeros((len(DEPTHS), counters), np.int64)
    told = stats.where("kind > 0").select("kind", "key", "n").toArrow()  # len(DEPTHS) * counters rows at most
    if told.num_rows:
        counts[told.column("kind").to_numpy() - 1, told.column("key").to_numpy()] = told.column("n").to_numpy()
    room = max(1000, int(counts[0].sum()) // (4 * parts))
    codes = word_codes([bytes(r["word"]) for r in stats.where("kind = -1").orderBy(F.desc("n"), "word").limit(CODED).select("word").collect()])
    bitmap = _bitmap(stats.where("kind = 0"))
    shipped = spark.sparkContext.broadcast((bitmap, counts > room, np.minimum(counts[-1] // room + 1, 1 << 14).astype(np.int64), codes))
    drop_saved(stats)
    schema = pa.schema([("leaf", pa.binary())])

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, large, salts, codes = shipped.value
        for big in batches:
            for b in _sliced(big, 2):
                s = Suffixes(_bytes(b.column(2)))
                at = s.least_gram() % np.uint64(len(bits) * 8)
                on = np.flatnonzero((bits[(at >> np.uint64(3)).astype(np.int64)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1)
                if not len(on):
                    continue
                s.only(on)
                whole = s.prefix(WINDOW)
                subtree, todo = whole.copy(), np.ones(len(on), bool)
                for k, d in enumerate(DEPTHS[:-1]):
                    p = s.prefix(d)
                    fits = todo & ~large[k][(p % np.uint64(counters)).astype(np.int64)]
                    subtree[fits] = p[fits]
                    todo &= ~fits
                doc, th = b.column(0).to_numpy()[s.doc], None if one_text_a_doc else b.column(1).fill_null(0).to_numpy()[s.doc]
                n = np.where(todo, salts[(whole % np.uint64(counters)).astype(np.int64)], 1)
                salt = np.where(n > 1, (_mix(doc.view(np.uint64)) % n.astype(np.uint64)).astype(np.int64) + 1, 0)
                tag = _mix(subtree + salt.astype(np.uint64)) >> np.uint64(65 - 8 * TAG) << np.uint64(1) | (salt > 0).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([packed_leaves(tag, s.written(codes), doc, th, s.pos)], schema=schema)

    dealt = docs.select("doc", F.lit(None).cast("long").alias("th") if one_text_a_doc else "th", "text").mapInArrow(suffixes, "leaf binary")
    dealt = dealt.repartition(parts, F.substring("leaf", 1, TAG)).sortWithinPartitions("leaf")
    leaf = ["doc", "th", "pos"]
    first_leaf = ["fdoc", "fth", "fpos"] if with_first else []
    types = {"suffix": pa.binary(), "doc": pa.int64(), "th": pa.int64(), "pos": pa.int32(), "fdoc": pa.int64(), "fth": pa.int64(), "fpos": pa.int32()}
    found_schema = pa.schema([(c, types[c]) for c in ["suffix", *leaf, *first_leaf]])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: bytes | None = None  # tag and words of the node that the last batch ended in, and its first leaf
        first: list = []
        for b in batches:
            if not b.num_rows:
                continue
            key, salted, doc, th, pos = unpacked_leaves(b.column(0), not one_text_a_doc)
            every = [doc, np.zeros(len(doc), np.int64) if th is None else th, pos]
            leaves = every if with_first else every[:1]
            same = pc.equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
            new = np.concatenate([[last != key[0].as_py()], ~same])
            heads = np.flatnonzero(new)
            own = np.cumsum(new) - 1  # -1 goes on with the last batch's node
            low = [np.where(own >= 0, x[heads[np.maximum(own, 0)]] if len(heads) else 0, first[i] if first else 0) for i, x in enumerate(leaves)]
            last, first = key[-1].as_py(), [x[-1] for x in low]
            settled = leaves[0] > low[0]
            told = np.flatnonzero(settled | salted)
            if len(told):
                own_leaves = [pa.nulls(len(told), types[c]) if c == "th" and th is None else pa.array(x[told], types[c]) for c, x in zip(leaf, every)]
                over = settled[told]
                words = without_tag(key, told[~over]).take(pa.array(np.cumsum(~over) - 1, mask=over))  # only with an open leaf
                firsts = [pa.array(x[told], types[c]) for c, x in zip(first_leaf, low)]
                yield pa.RecordBatch.from_arrays([words, *own_leaves, *firsts], schema=found_schema)

    spelled = {pa.binary(): "binary", pa.int64(): "long", pa.int32(): "int"}
    found = saved(dealt.mapInArrow(nodes, ", ".join(f"{f.name} {spelled[f.type]}" for f in found_schema)), "repeat-leaves", release=True)
    first = [F.struct(*[F.col(f).alias(c) for f, c in zip(first_leaf, leaf)]).alias("first")] if with_first else []
    settled = found.where("suffix is null").select(*leaf, *first)
    open_leaves = found.where("suffix is not null").select("suffix", *leaf)
    low = saved(open_leaves.groupBy("suffix").agg(F.min(F.struct(*leaf)).alias("first")), "salted-nodes")  # a table, so that the join on a hot node can be split
    return settled.union(open_leaves.join(low, "suffix").where("doc > first.doc").select(*leaf, *(["first"] if with_first else [])))


def text_key(text: Column) -> Column:
    """What tells texts of one document apart: 64 bits of their SHA-256, mixed."""
    return F.xxhash64(F.sha2(text.cast("binary"), 256))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = own_columns(docs, id_col, text_col).toDF("id", "text")
    return d.select(F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID)).alias("doc"), "text").withColumn("th", text_key(F.col("text")))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats: (doc, start, n_words, first_doc, first_start), words counted from 0.

    Each row is a passage of at least WINDOW words of a document that stands, word by word, at first_start of first_doc,
    where its windows start first; it can't be extended on either side with that. Texts that equal another one are
    taken once, in their smallest document. Rows of one id are one document, all null ids one below all others.
    """
    d = _keyed(docs, id_col, text_col).where("text is not null").groupBy("th").agg(F.min(F.struct("doc", "text")).alias("x")).select("x.doc", "th", "x.text")
    leaves = repeated_windows(saved(d, "distinct-texts"), with_first=True)
    shift = (F.col("pos") - F.col("first.pos")).alias("shift")
    leaves = leaves.select("doc", "th", "pos", F.col("first.doc").alias("first_doc"), F.col("first.th").alias("fth"), shift)
    nth = F.row_number().over(Window.partitionBy("doc", "th", "first_doc", "fth", "shift").orderBy("pos"))
    runs = leaves.withColumn("run", F.col("pos") - nth).groupBy("doc", "th", "first_doc", "fth", "shift", "run").agg(F.min("pos").alias("start"), (F.count("*") + WINDOW - 1).alias("n_words"))
    return runs.select("doc", "start", "n_words", "first_doc", (F.col("start") - F.col("shift")).alias("first_start"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col cut down to its kept words, joined by one space, and n_words, n_removed (long).

    Only texts that lose words are rewritten. A null text has no words and stays null. Rows of one id are one document
    (they never take words from one another); all null ids are one, below all others. Columns called n_words or
    n_removed are replaced. An empty table gives an empty table.
    """
    docs = docs.drop("n_words", "n_removed")
    text = F.col(f"`{text_col}`")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID))
    keyed = docs.withColumns({"__doc": ident, "__th": text_key(text)})
    plain = _keyed(docs, id_col, text_col)
    rows = saved(plain.where("text is not null").select("doc", "th").distinct(), "text-keys")
    alone = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    starts = repeated_windows(plain, one_text_a_doc=alone).groupBy("doc", "th").agg(F.collect_set("pos").alias("starts"))
    if alone:
        starts = starts.drop("th").join(rows, "doc")
    first = rows.groupBy("th").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = rows.join(saved(first, "copied-texts"), "th").where("doc > first").select("doc", "th", F.lit(True).alias("copy"))
    cut = starts.join(copies, ["doc", "th"], "full").select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("starts").alias("__starts"), F.col("copy").alias("__copy"))
    joined = keyed.join(cut, ["__doc", "__th"], "left").drop("__doc", "__th")
    schema = T.StructType(docs.schema.fields + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    names = list(docs.columns)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in _sliced(big, big.schema.get_field_index(text_col)):
                texts, n_words, n_removed = [], [], []
                for t, starts, copy in zip(b.column(text_col), b.column("__starts"), b.column("__copy")):
                    raw = t.as_buffer().to_pybytes() if t.is_valid else None
                    words = raw.split() if raw else []
                    n_words.append(len(words))
                    gone = 0
                    if copy.is_valid and len(words) >= WINDOW:
                        raw, gone = b"", len(words)
                    elif starts.is_valid and not copy.is_valid:
                        mark = np.zeros(len(words) + 1, np.int64)
                        at = starts.values.to_numpy()
                        np.add.at(mark, at, 1)
                        np.add.at(mark, at + WINDOW, -1)
                        keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()
                        raw, gone = b" ".join([words[i] for i in keep]), len(words) - len(keep)
                    n_removed.append(gone)
                    texts.append(raw)
                new = {text_col: pa.array(texts, pa.binary()).cast(pa.string())}
                cols = [new.get(x, b.column(x)) for x in names]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    return joined.mapInArrow(rewrite, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    bare = F.regexp_replace(F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r")), r"[\x20\x09-\x0D]+", " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(bare.cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": query}
SQL = {
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 12, 0) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM p),
f AS (SELECT win, min(doc_id) AS first FROM k GROUP BY win),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM k JOIN f USING (win) WHERE doc_id > first),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
y AS (SELECT x.doc_id, x.pos, x.word, g.pos IS NOT NULL AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.pos = x.pos)
SELECT w.doc_id, count(y.pos) AS n_words, count(y.pos) FILTER (gone) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM w LEFT JOIN y ON y.doc_id = w.doc_id GROUP BY w.doc_id
"""
}


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """What the query has to return for rows of distinct ids; for tests."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first: dict[tuple, int] = {}
    for i, w in words.items():
        for k in range(len(w) - WINDOW + 1):
            key = tuple(w[k : k + WINDOW])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - WINDOW + 1) if first[tuple(w[k : k + WINDOW])] < i for j in range(WINDOW)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def brute_force_passages(rows: list[tuple[int, str | None]]) -> set[tuple[int, int, int, int, int]]:
    """What repeated_passages() has to return for rows of distinct ids and texts; for tests."""
    words = {i: (t or "").encode().split() for i, t in rows}
    first: dict[tuple, tuple[int, int]] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - WINDOW + 1):
            first.setdefault(tuple(words[i][k : k + WINDOW]), (i, k))
    out, n = set(), lambda i: len(words[i]) - WINDOW + 1
    for i, w in words.items():
        at = [first[tuple(w[k : k + WINDOW])] for k in range(n(i))]
        for k in range(n(i)):
            f, p = at[k]
            if f < i and not (k and at[k - 1] == (f, p - 1)):
                m = 1
                while k + m < n(i) and at[k + m] == (f, p + m):
                    m += 1
                out.add((i, k, m + WINDOW - 1, f, p))
    return out
