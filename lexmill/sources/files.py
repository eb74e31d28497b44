"""Sources: manifests, text files, logs in partitioned folders, stored indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POST = T.StructType([T.StructField(n, T.StringType()) for n in ("slug", "file", "navLabel", "kind", "summary", "date")] + [T.StructField("published", T.BooleanType()), T.StructField("series", T.StringType())])
MANIFEST = T.StructType([T.StructField("home", T.StructType([T.StructField("file", T.StringType())])), T.StructField("featured", T.ArrayType(T.StringType())), T.StructField("posts", T.ArrayType(POST))])
WORK = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "short", "title", "kind", "author", "match")])
RUN_ROW = T.StructType(
    [T.StructField("turn", T.IntegerType()), T.StructField("compaction", T.BooleanType()), T.StructField("self_steps", T.ArrayType(T.IntegerType()))]
    + [T.StructField("recon_route", T.StringType()), T.StructField("recon_status", T.StringType()), T.StructField("G", T.DoubleType())]
    + [T.StructField("probe_turn", T.IntegerType()), T.StructField("probe_fidelity", T.DoubleType()), T.StructField("probe_steps", T.IntegerType()), T.StructField("probe_chars", T.IntegerType())]
)


def manifest(spark: SparkSession, path: str, preview: bool = False) -> DataFrame:
    """Posts in manifest order, with ord; unpublished ones only in a preview."""
    p = spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.posexplode("posts").alias("ord", "p")).select("ord", "p.*")
    return p if preview else p.where("published")


def text_files(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(file, text): whole files of a folder."""
    t = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return t.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), F.col("value").alias("text"))


def pieces(spark: SparkSession, manifest_path: str, folder: str) -> DataFrame:
    """Published posts with their texts; a missing file is an empty text."""
    return manifest(spark, manifest_path).join(text_files(spark, folder), "file", "left").withColumn("text", F.coalesce("text", F.lit("")))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Works to cite; an absent file is an empty table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], WORK)
    return spark.read.schema(T.StructType([T.StructField("sources", T.ArrayType(WORK))])).json(path, multiLine=True).select(F.explode("sources").alias("w")).select("w.*")


def run_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of SET/ARM-rN/cell-*/rows/*.jsonl, with set, arm and repeat from the path; blank lines are skipped."""
    r = spark.read.schema(RUN_ROW).json(f"{root}/*/*-r*/cell-*/rows/*.jsonl")
    path = F.col("_metadata.file_path")
    at = lambda k: F.regexp_extract(path, r"([^/]+)/([^/]+)-r(\d+)/cell-[^/]+/rows/[^/]+$", k)
    return r.withColumns({"set": at(1), "arm": at(2), "repeat": at(3).cast("int")})


def run_side_files(spark: SparkSession, root: str, schema: T.StructType, name: str = "evaluation.json") -> DataFrame:
    """One JSON record for each run, with set, arm and repeat; a run without the file has no row."""
    r = spark.read.schema(schema).json(f"{root}/*/*-r*/cell-*/{name}", multiLine=True)
    path = F.col("_metadata.file_path")
    at = lambda k: F.regexp_extract(path, r"([^/]+)/([^/]+)-r(\d+)/cell-[^/]+/[^/]+$", k)
    return r.withColumns({"set": at(1), "arm": at(2), "repeat": at(3).cast("int")})


def stored_index(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """A table of a stored index, or None where it was not written."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(f"{folder}/{name}")
