"""Incremental upkeep of index tables from a stream of document batches, keyed by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import index as I


def changed(batch: DataFrame, keys: DataFrame | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of a batch whose content key is not stored yet."""
    b = batch.withColumn("key", T.content_key(F.coalesce(F.col(text_col), F.lit(""))))
    return b if keys is None else b.join(keys.select(id_col, "key"), [id_col, "key"], "left_anti")


def upkeep(folder: str, id_col: str = "doc_id", text_col: str = "text"):
    """A foreachBatch function that appends postings of changed documents and their keys under folder.

    A batch that is run again finds its keys stored and adds nothing.
    """
    from lexmill.sources.files import stored_index

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = changed(batch.dropDuplicates([id_col]), stored_index(spark, folder, "keys"), id_col, text_col).persist()
        try:
            I.postings(new, id_col, text_col).withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{folder}/postings")
            new.select(id_col, "key").write.mode("append").parquet(f"{folder}/keys")
        finally:
            new.unpersist()

    return run
