"""SimHash near-duplicates through pivot distance tables.

A fingerprint has a bit for each of 64 positions, set where over half of the shingle hashes have it set. Reference
fingerprints (pivots) are an all-zero base and PER_RANGE seeded patterns within each of RANGES bit ranges. Every
fingerprint gets its Hamming distances to all of them, once, in a stored table. By the triangle inequality, fingerprints
that differ in d bits differ by at most d in each of these coordinates, so pairs are discarded by their maximum
coordinate difference, from the stored distances, before the survivors' bits are compared.

Pairs to look at come from the same distance tables: the distance to a pivot less the distance to the base depends on
that pivot's range alone, and d <= LIMIT differing bits leave at least RANGES - LIMIT ranges untouched. So two linked
fingerprints agree on all relative distances of at least one choice of RANGES - LIMIT ranges; each choice is an
equi-join key, and no link is lost. Equal fingerprints are collapsed first; buckets are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bucket_pairs import compare_dealt, compare_units, forest
from lexmill.llm.common import checked_broadcast, join_grouped, own_columns, saved, table
from lexmill.llm.components import connected_components

LIMIT = 2
SHINGLE = 3
RANGES = 4
PER_RANGE = 12
BLOCK = 1024
SEED = 4
_SLICE = 1 << 15


def pivots(ranges: int = RANGES, per_range: int = PER_RANGE, seed: int = SEED) -> np.ndarray:
    """uint64 reference fingerprints: the base, then per_range patterns for each bit range."""
    width = 64 // ranges
    rng = np.random.default_rng(seed)
    out = [0]
    for r in range(ranges):
        out += [int(x) << (r * width) for x in rng.integers(1, 1 << width, per_range, dtype=np.uint64)]
    return np.array(out, np.uint64)


PIVOTS = pivots()


def distances(fp: np.ndarray, refs: np.ndarray = PIVOTS) -> np.ndarray:
    """(rows, pivots) Hamming distances, one byte each."""
    return np.bitwise_count(fp[:, None] ^ refs[None, :]).astype(np.int8)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles: A-Z lowered, XXH64 with seed 42; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if n <= 1:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + _SLICE], stops[at : at + _SLICE])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep_text_hash: bool = False) -> DataFrame:
    """docs(id, text) -> (id, fp long: the fingerprint's bits). A null text is one without words."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col("id"), F.col("text")).mapInArrow(run, "id long, fp long")


def distance_table(classes: DataFrame, refs: np.ndarray = PIVOTS) -> DataFrame:
    """classes(id long, fp long) -> (id, fp, distances binary: one byte a reference fingerprint), stored."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("distances", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(b.column(1).to_numpy().view(np.uint64), refs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in d], pa.binary())], schema=schema)

    return saved(classes.select("id", "fp").mapInArrow(run, "id long, fp long, distances binary"), "pivot-distances")


def _unpacked(col: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.int8).reshape(len(col), width)


def link_fingerprints(classes: DataFrame, limit: int = LIMIT, ranges: int = RANGES) -> DataFrame:
    """classes(id long, fp long), fingerprints distinct -> edges(u, v): a spanning forest of each unit's links."""
    refs = pivots(ranges)
    per = (len(refs) - 1) // ranges
    choices = list(combinations(range(ranges), ranges - limit))
    keyed_schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("fp", pa.int64()), ("distances", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = _unpacked(b.column(2), len(refs))
            relative = d[:, 1:] - d[:, :1]
            for c, own in enumerate(choices):
                cols = np.concatenate([np.arange(r * per, (r + 1) * per) for r in own])
                raw = np.ascontiguousarray(relative[:, cols])
                key = np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), c) for r in raw), np.uint64, len(raw))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], schema=keyed_schema)

    def compare(c: dict, same: bool):
        ids, fp, d = c["id"].to_numpy(), c["fp"].to_numpy().view(np.uint64), _unpacked(c["distances"], len(refs))
        m = 0 if same else int(np.count_nonzero(c["first"].to_numpy(zero_copy_only=False)))
        left, right = (np.arange(len(ids)), 0) if same else (np.arange(m), m)
        near = np.ones((len(left), len(ids) - right), bool)
        for j in range(d.shape[1]):  # maximum coordinate difference, pivot by pivot
            near &= np.abs(d[left, j][:, None] - d[right:, j][None, :]) <= limit
        a, b = np.nonzero(np.triu(near, 1) if same else near)
        b = b + right
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= limit
        if not ok.any():
            return None
        v, root = forest(len(ids), a[ok], b[ok])
        return {"u": ids[v], "v": ids[root]}

    keyed = distance_table(classes, refs).mapInArrow(run, "key long, id long, fp long, distances binary")
    return compare_units(keyed, BLOCK, compare, "u long, v long", pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of docs.

    Null and blank texts have fingerprint zero and link like any other. Rows that repeat an id are rows of their own
    in the result; as classes go by id, texts of one id link through it. A null id stays null and is given its class's
    component where other rows have one. An empty table gives an empty table.
    """
    d = own_columns(docs, id_col, text_col).toDF("id", "text")
    fps = saved(fingerprints(d, shingle), "fingerprints")
    classes = saved(fps.groupBy("fp").agg(F.min("id").alias("id")).where("id is not null"), "fingerprint-classes")
    edges = saved(link_fingerprints(classes, limit), "fingerprint-links")
    shared = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("id")
    via_id = fps.join(shared, "id").select("id", "fp").distinct().join(classes.withColumnRenamed("id", "rep"), "fp").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    member = connected_components(edges.union(via_id))
    told = classes.join(member, "id", "left").select("fp", F.coalesce("component_id", "id").alias("component_id"))
    return fps.join(told, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id"))


#: Wide fingerprints, for documents that share much rather than nearly all: 64-bit lanes, shingle words, similarity.
LANES = 4
WIDE_SHINGLE = 5
SIMILARITY = 0.8
#: Bits that may differ in a candidate pair. Sets of Jaccard similarity 0.8 have a cosine of 8/9, so arccos(8/9) / pi of
#: the bits (15 %, 38 of 256, deviation 5.7) are expected to; the limit stands 2.5 deviations above. Candidates are verified.
WIDE_LIMIT = 53
WIDE_RECALL = 0.97
#: Rows, and bytes of shingle sets, that a block of the exact comparison is expected to hold.
VERIFY_ROWS, VERIFY_BYTES = 256, 1 << 24
_LANE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_set(text: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The sorted XXH64 hashes of a text's distinct word shingles (fewer words: the whole sequence; none: empty)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, stops = (ends - lens)[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, n))


def wide_fingerprint(h: np.ndarray) -> bytes:
    """LANES * 64 bits of SimHash over a set of shingle hashes."""
    ones = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(h), _SLICE):
        x = h[at : at + _SLICE, None] * _LANE
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8).reshape(-1, 8 * LANES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").tobytes()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def wide_plan(rows: int, recall: float = WIDE_RECALL) -> tuple[int, int]:
    """(bits a table's key covers, tables): keys sharpen with the logarithm of the rows, tables keep the recall."""
    bits = max(8, min(40, int(np.ceil(np.log2(max(rows, 2)))) - 4))
    same = (1 - np.arccos(8 / 9) / np.pi) ** bits
    return bits, int(np.ceil(np.log(1 - recall) / np.log(1 - same)))


def shared(sets: pa.Array, left: slice, right: slice) -> np.ndarray:
    """(left, right) counts of the shingles that two sets share, exact; only shingles of several sets are multiplied."""
    lens = np.array([len(x.as_buffer()) // 8 for x in sets])
    value, code, n = np.unique(np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in sets), np.uint64), return_inverse=True, return_counts=True)
    row, often = np.repeat(np.arange(len(lens)), lens), np.flatnonzero(n > 1)
    place = np.full(len(value), -1)
    place[often] = np.arange(len(often))
    col = place[code]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(range(*left.indices(len(lens)))), len(range(*right.indices(len(lens))))))
    for at in range(0, len(often), 1 << 13):
        i, j = np.searchsorted(col, [at, at + (1 << 13)])
        held = np.zeros((len(lens), min(1 << 13, len(often) - at)), np.float32)
        held[row[i:j], col[i:j] - at] = 1
        out += held[left] @ held[right].T
    return out


def link_wide(classes: DataFrame, limit: int = WIDE_LIMIT) -> DataFrame:
    """classes(id long, size long, fp binary) -> candidates (u, v), a spanning forest of each unit's near fingerprints.

    The reference fingerprints of a table are a base and the patterns over its own choice of bits; equal distances to
    them, less the base's, make the key. Within a bucket, pairs are discarded by the difference of their distances to
    pivots over the whole width, then by their bits and set sizes.
    """
    bits, tables = wide_plan(classes.count())
    rng = np.random.default_rng(SEED)
    width = 64 * LANES
    chosen = np.stack([rng.choice(width, bits, replace=False) for _ in range(tables)])
    patterns = rng.integers(0, 2, (tables, 2 * bits, bits), dtype=np.int8)  # each table's pivots, on its own bits
    pivots_full = np.packbits(rng.integers(0, 2, (16, width), dtype=np.uint8), axis=1, bitorder="little").view(np.uint64)
    keyed_schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("size", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                b = big.slice(at, 4096)
                fp = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, width // 8)
                ones = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
                for t in range(tables):
                    own = ones[:, chosen[t]]
                    relative = patterns[t].sum(axis=1) - 2 * (own @ patterns[t].T.astype(np.float32)).astype(np.int8)  # distance to each pivot less that to the base
                    raw = np.ascontiguousarray(relative.astype(np.int8))
                    key = np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), t) for r in raw), np.uint64, len(raw))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *b.columns], schema=keyed_schema)

    def compare(c: dict, same: bool):
        ids, size = c["id"].to_numpy(), c["size"].to_numpy()
        fp = np.frombuffer(b"".join(c["fp"].to_pylist()), np.uint64).reshape(len(ids), LANES)
        d = np.stack([np.bitwise_count(fp ^ p).sum(axis=1, dtype=np.int16) for p in pivots_full], axis=1)
        m = len(ids) if same else int(np.count_nonzero(c["first"].to_numpy(zero_copy_only=False)))
        right = 0 if same else m
        near = np.minimum(size[:m, None], size[None, right:]) >= SIMILARITY * np.maximum(size[:m, None], size[None, right:])
        for j in range(d.shape[1]):
            near &= np.abs(d[:m, j][:, None] - d[right:, j][None, :]) <= limit
        a, b = np.nonzero(np.triu(near, 1) if same else near)
        b = b + right
        ok = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 18):
            s = slice(at, at + (1 << 18))
            ok[s] = np.bitwise_count(fp[a[s]] ^ fp[b[s]]).sum(axis=1, dtype=np.int16) <= limit
        if not ok.any():
            return None
        v, root = forest(len(ids), a[ok], b[ok])
        return {"u": ids[v], "v": ids[root]}

    keyed = classes.select("id", "size", "fp").mapInArrow(run, "key long, id long, size long, fp binary")
    return compare_units(keyed, 512, compare, "u long, v long", pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def verified_links(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """members(id, component, size, shingles binary) -> edges (u, v) of members whose shingle sets share similarity or more.

    Only pairs of one component are looked at; the edges connect what all such pairs connect. Each member is compared
    with its component's first one. Members that are not similar to it are then compared with all others of the
    component, in blocks of bounded size, as pairs of blocks. So a large group of copies costs one comparison a member.
    """
    members = saved(members, "shingle-sets")
    first = saved(members.groupBy("component").agg(F.min("id").alias("low")).select("component", "low"), "first-members")
    lead = members.select("component", F.col("id").alias("low"), F.col("shingles").alias("own")).join(first, ["component", "low"])
    lead = saved(lead.withColumn("key", F.bitwise_not("component")).drop("component"), "first-sets")

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(b.column("shingles"), b.column("own"))
            near = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similarity for x, y in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("low"), b.column("component"), pa.array(near)], names=["id", "low", "component", "near"])

    compared = members.withColumn("key", F.bitwise_not("component")).join(lead, "key").where("id <> low").select("id", "low", "component", "shingles", "own")
    compared = saved(compared.mapInArrow(star, "id long, low long, component long, near boolean"), "compared-with-first")
    direct = compared.where("near").select(F.col("id").alias("u"), F.col("low").alias("v"))
    rest = compared.where("not near").select("id", F.lit(True).alias("rest"))
    told = members.join(rest, "id", "left").withColumn("rest", F.coalesce("rest", F.lit(False)))
    told = saved(told, "members-told")
    blocks = lambda of: F.greatest(F.ceil(F.sum(of.cast("int")) / VERIFY_ROWS), F.ceil(F.sum(F.when(of, F.col("size"))) * 8 / VERIFY_BYTES)).cast("long")
    counts = told.groupBy("component").agg(blocks(F.col("rest")).alias("n_rest"), blocks(~F.col("rest")).alias("n_other")).where("n_rest > 0")
    counts = saved(counts.select(F.bitwise_not("component").alias("key"), "n_rest", "n_other"), "component-blocks")
    dealt = told.withColumn("key", F.bitwise_not("component")).join(checked_broadcast(counts), "key")
    own = F.when(F.col("rest"), F.pmod(F.xxhash64("id"), F.col("n_rest"))).otherwise(F.col("n_rest") + F.pmod(F.xxhash64("id"), F.col("n_other")))
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("rest"), F.col("n_rest") + F.col("n_other") - 1).otherwise(F.col("n_rest") - 1))))
    dealt = dealt.select("key", "id", "size", "shingles", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") <= F.col("other")).alias("first"))

    def compare(c: dict, same: bool):
        ids, size = c["id"].to_numpy(), c["size"].to_numpy()
        m = int(np.count_nonzero(c["first"].to_numpy(zero_copy_only=False)))
        right = 0 if same else m
        near = shared(c["shingles"], slice(0, m), slice(right, len(ids))) * (1 + similarity) >= similarity * (size[:m, None] + size[None, right:])
        p, q = np.nonzero(np.triu(near, 1) if same else near)  # both / (x + y - both) >= similarity
        if not len(p):
            return None
        v, root = forest(len(ids), p, q + right)
        return {"u": ids[v], "v": ids[root]}

    more = compare_dealt(dealt, compare, "u long, v long", pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    return direct.union(more)


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id (then text hash); all columns stay.

    Groups are the components of the links between texts whose five-word shingle sets share 0.8 or more. Candidates come
    from wide fingerprints; every link is verified on the sets of 64-bit shingle hashes. Texts without words are of no
    group and stay, and so do rows with a null id. Rows equal in id and text are in one group, of which one stays, chosen
    by a hash of its columns. An empty table gives an empty table.
    """
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("set_key", pa.binary()), ("size", pa.int64()), ("fp", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes()) if x.is_valid else np.zeros(0, np.uint64) for x in b.column(2)]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            fps = [wide_fingerprint(x) if len(x) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(fps, pa.binary())], schema=schema)

    d = own_columns(docs, id_col, text_col).toDF("id", "text").where("id is not null").withColumn("th", F.xxhash64("text"))
    fps = saved(d.select("id", "th", "text").mapInArrow(run, "id long, th long, set_key binary, size long, fp binary").where("size > 0"), "wide-fingerprints")
    # a class is of texts with one shingle set, as one id may stand on texts of several groups
    classes = fps.groupBy("set_key", "size", "fp").agg(F.min(F.struct("id", "th")).alias("first"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("id"), "set_key", "size", "fp", "first"), "wide-classes")
    component = saved(connected_components(link_wide(classes)).withColumnRenamed("component_id", "component"), "wide-candidates")
    reps = classes.join(component, "id").select("id", "component", "size", F.col("first.id").alias("doc"), F.col("first.th").alias("th"))
    reps = saved(reps, "wide-members")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([shingle_set(x.as_buffer().to_pybytes()).tobytes() for x in b.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "component", "size")), made], names=["id", "component", "size", "shingles"])

    texts = d.select(F.col("id").alias("doc"), "th", "text").join(checked_broadcast(reps), ["doc", "th"]).dropDuplicates(["id"])
    members = texts.select("id", "component", "size", "text").mapInArrow(sets, "id long, component long, size long, shingles binary")
    links = saved(verified_links(members), "wide-links")
    member = connected_components(links)
    group = saved(classes.join(member, "id", "left").select("set_key", "first", F.coalesce("component_id", "id").alias("group")), "wide-groups")
    told = saved(join_grouped(group, group.groupBy("group").agg(F.min("first").alias("keep")), "group").select("set_key", "keep"), "wide-kept")
    gone = (F.col("id") != F.col("keep.id")) | (F.col("th") != F.col("keep.th"))
    marks = fps.join(told, "set_key").groupBy(F.col("id").alias("__gone"), F.col("th").alias("__th")).agg(F.max(gone).alias("gone"), F.count("*").alias("n"))
    marks = saved(marks.where("gone or n > 1"), "wide-marks")
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    same = (ident == F.col("__gone")) & (F.xxhash64(text) == F.col("__th"))
    left = docs.join(marks, same, "left_anti")
    again = saved(marks.where("not gone").select("__gone", "__th"), "wide-again")
    if again.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    order = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = docs.join(checked_broadcast(again), same).groupBy("__gone", "__th").agg(F.min_by(row, order).alias("__one")).select("__one.*")
    return left.union(one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash_near_dedup": query}
SQL: dict[str, str] = {}
