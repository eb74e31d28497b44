"""Helpers that the operators share: shared-folder tables, text normalisation, guarded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a materialised side of a join may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 20_000

#: ASCII white space as the operators' contracts define it: [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if spark.sparkContext.master.startswith("local"):  # driver and executors are one process
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.lexmill-checkpoints"
        spark.sparkContext.setCheckpointDir(path)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")


def app_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under the application's own folder, which may be deleted once it has ended."""
    return f"{shared_dir(spark)}/lexmill-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df as a Parquet table into the shared folder and read it back: cuts lineage, survives lost executors.

    With release, shuffle files go as soon as the table is written, not when the driver's collector comes by.
    """
    path = app_path(df.sparkSession, name)
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    if release:
        conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        if release:
            conf.set(key, before) if before is not None else conf.unset(key)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a table made by saved(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/lexmill-{spark.sparkContext.applicationId}/" in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checked_broadcast(small: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """small with a broadcast hint if its counted rows are at most limit; unchanged (a shuffled join) beyond.

    small should be a materialised table, as it is counted.
    """
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that extra columns of the input cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null or blank gives an empty array."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(ASCII_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+", -1))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII text takes the fast built-in path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) that keeps the condition above the columns it uses, so that costly ones are computed once."""
    row = "__row_barrier"
    return df.withColumn(row, F.monotonically_increasing_id()).where(condition & (F.col(row) >= 0)).drop(row)


def join_grouped(rows: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a table that was grouped by the same long key, such that a hot key's rows can be split.

    Grouping leaves a table partitioned by its key, the join would take it as it is, and adaptive execution does not
    split a side that isn't read from an exchange. Joining on the key's complement puts an exchange on both sides.
    """
    other = "__" + key + "_complement"
    return rows.withColumn(other, F.bitwise_not(key)).join(grouped.withColumn(other, F.bitwise_not(key)).drop(key), other).drop(other)
