"""Line de-duplication over levelled sorted runs of line hashes, with DataFrame functions only.

Texts are cut at \\n; a line's key is the line without ASCII white space at both ends and with A-Z lowered, held as two
64-bit hashes (lines are compared by these 128 bits, not as texts). LineRuns keeps what has been seen as runs: tables
bucketed by the hashes and sorted by them, one file a bucket. A batch of documents is reduced to its own keys, dealt to the
same buckets once, and merge-anti-joined with each run in place, without another shuffle. Keys that no run holds are the
batch's own and stand in its run alone, with the documents that held them; keys that are held already are tallied
beside it. So each key has one home among the runs, and its documents are counted from its home and its tallies. When a
level has FAN runs they are merged into one of the next level, so a key is rewritten a logarithmic number of times.

Batches are cut by a hash of the document id, so a document is never in two of them. Runs outlive a call: they take
further batches later, also in another session (state(), restore()).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import ASCII_SPACE, app_path, checked_broadcast, drop_saved, lower_ascii, own_columns, saved, shuffle_partitions, table

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FAN = 2
_NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(ASCII_SPACE)))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(17), key).alias("h2"))


def _long_line_hashes(text: Column, min_chars: int) -> Column:
    """The hashes of each long line in line order, null for a short one."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.length(x) >= min_chars, F.transform(F.array(line_key(x)), lambda k: F.when(F.length(k) >= min_chars, _hashes(k)))[0]))


class LineRuns:
    """The line keys seen so far, as levelled runs: bucketed, sorted tables (h1, h2, n_docs, top_doc, held).

    A run's rows with held = false are the keys whose home it is; those with held = true tally keys of other homes.
    """

    COLUMNS = "h1 LONG, h2 LONG, n_docs LONG, top_doc LONG, held BOOLEAN"

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan, self.buckets = spark, fan, buckets or shuffle_partitions(spark)
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", app_path(self.spark, "line-run")
        df = df.select("h1", "h2", F.col("n_docs").cast("long").alias("n_docs"), "top_doc", "held").repartition(self.buckets, "h1", "h2")
        df.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        files = self.spark.table(name)
        drop_saved(files)
        self.spark.sql(f"DROP TABLE {name}")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(r) for level in self.levels for r in level]

    def told(self, batch: DataFrame) -> DataFrame:
        """batch (h1, h2, n_docs, top_doc, each key once) with held: whether a run is the key's home already."""
        batch = batch.repartition(self.buckets, "h1", "h2")
        out = batch
        for r in self.runs():
            out = out.join(r.where("not held").select("h1", "h2"), ["h1", "h2"], "left_anti")
        fresh = out.withColumn("held", F.lit(False))
        if not self.levels:
            return fresh
        homes = [batch.join(r.where("not held").select("h1", "h2"), ["h1", "h2"], "left_semi") for r in self.runs()]  # each key has one home at most
        return reduce(DataFrame.union, [fresh, *(h.withColumn("held", F.lit(True)) for h in homes)])

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n_docs, top_doc), each key once, of documents that no earlier batch had."""
        new, level = self._write(self.told(batch)), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fan:
                return
            old, self.levels[level] = self.levels[level], []
            rows = reduce(DataFrame.union, [self.spark.table(r) for r in old])
            tallies = rows.where("held").groupBy("h1", "h2", "held").agg(F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"))
            new = self._write(rows.where("not held").unionByName(tallies))
            for r in old:
                self._drop(r)
            level += 1

    def repeated(self, min_docs: int) -> DataFrame:
        """(h1, h2, top_doc) of the keys that stand in at least min_docs documents."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, top_doc long")
        tallies = reduce(DataFrame.union, runs).where("held").groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("top_doc").alias("later"))
        tallies = saved(tallies.repartition(self.buckets, "h1", "h2"), "line-tallies")
        out = [r.where("not held").join(tallies, ["h1", "h2"], "left") for r in runs]
        n, top = F.col("n_docs") + F.coalesce("more", F.lit(0)), F.greatest("top_doc", "later")
        return reduce(DataFrame.union, [x.where(n >= min_docs).select("h1", "h2", top.alias("top_doc")) for x in out])

    def state(self) -> dict:
        """What restore() needs: the bucket count and the folders of all runs by level."""
        place = lambda r: self.spark.sql(f"DESCRIBE FORMATTED {r}").where("col_name = 'Location'").first()["data_type"]
        return {"fan": self.fan, "buckets": self.buckets, "levels": [[place(r) for r in level] for level in self.levels]}

    @classmethod
    def restore(cls, spark: SparkSession, state: dict) -> LineRuns:
        """Runs whose files an earlier session wrote."""
        out = cls(spark, state["fan"], state["buckets"])
        for level in state["levels"]:
            out.levels.append([])
            for path in level:
                name = f"line_run_{uuid.uuid4().hex}"
                spark.sql(f"CREATE TABLE {name} ({cls.COLUMNS}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {out.buckets} BUCKETS LOCATION '{path}'")
                out.levels[-1].append(name)
        return out

    def drop(self) -> None:
        """Delete all runs."""
        for level in self.levels:
            for r in level:
                self._drop(r)
        self.levels = []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, runs: LineRuns | None = None) -> DataFrame:
    """docs with text_col cut down to the kept lines, and two more columns, n_lines and n_dropped (long).

    With runs, docs are further documents (of ids that runs have not seen): their lines are added to the runs, and they
    are judged by all that was seen so far; without, docs are all there is. A null or empty text is one empty line. Rows
    with one id are one document; all rows with a null id are one too, below all others. Other columns pass through;
    where one of them is called n_lines or n_dropped it is replaced. An empty table gives an empty table.
    """
    d = own_columns(docs, id_col, text_col).toDF("id", "text")
    ident = F.coalesce(F.col("id").cast("long"), F.lit(_NO_ID))
    text = F.coalesce("text", F.lit(""))
    held = d.select(ident.alias("doc"), F.xxhash64(text).alias("th"), F.explode(F.array_distinct(F.filter(_long_line_hashes(text, min_chars), lambda x: x.isNotNull()))).alias("h"))
    held = saved(held.select("doc", "th", "h.h1", "h.h2", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch")), "line-hashes")
    own = runs or LineRuns(docs.sparkSession)
    repeats = d.select(ident.alias("doc")).groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    alone = repeats.isEmpty()  # where each document is one row, its keys are distinct already
    for b in range(batches):
        keys = held.where(F.col("batch") == b).select("h1", "h2", "doc")
        own.add((keys if alone else keys.distinct()).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("top_doc")))
    repeated = saved(own.repeated(min_docs), "repeated-lines")  # a table, so that adaptive execution can split the join on a hot key
    if runs is None:
        own.drop()
    gone = held.join(checked_broadcast(repeated), ["h1", "h2"]).where("doc < top_doc")
    # by text as well: rows of one id may be many, and what their sets have in common goes in all of them
    gone = saved(gone.groupBy("doc", "th").agg(F.collect_set(F.struct("h1", "h2")).alias("gone")), "dropped-lines")
    drop_saved(held)
    drop_saved(repeated)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.arrays_zip(F.split(text, "\n", -1).alias("l"), _long_line_hashes(text, min_chars).alias("h"))
    key = f"__{id_col}_line_doc"
    keys = {key: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)), key + "_text": F.xxhash64(text)}
    out = docs.withColumns(keys).join(gone.select(F.col("doc").alias(key), F.col("th").alias(key + "_text"), F.col("gone").alias(key + "s")), list(keys), "left")
    cut = F.transform(F.filter(lines, lambda x: x["h"].isNull() | ~F.array_contains(F.col(key + "s"), x["h"])), lambda x: x["l"])
    n = F.size(F.split(text, "\n", -1)).cast("long")
    out = out.withColumn(key + "_kept", F.when(F.col(key + "s").isNotNull(), cut))
    out = out.withColumns({"n_lines": n, "n_dropped": F.coalesce(n - F.size(key + "_kept"), F.lit(0)).cast("long")})
    out = out.withColumn(text_col, F.when(F.col(key + "_kept").isNotNull(), F.array_join(key + "_kept", "\n")).otherwise(F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op2_line_dedup": query}
SQL = {
    "op2_line_dedup": """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, r.top IS NOT NULL AND k.doc_id <> r.top AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
}
