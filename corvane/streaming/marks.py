"""Marks that reviewers set and take back, as a stream of patches: the last patch of a field counts.

A patch sets or deletes one field of one key. State holds, for each key and field, the patch that is last by time, ties by
its number, so that patches may come late, twice or in any order. Deleted fields stay as a note of when, or a late patch
would bring them back. Each micro-batch writes the fields that it changed to a folder of its number, written anew if the
batch runs again after a failure; the stream goes on from its checkpoint when started again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["field", "value", "deleted", "at", "number"]


def patches(events: DataFrame, keys: list[str], field: Column, value: Column, deleted: Column, at: Column, number: Column) -> DataFrame:
    """``keys, field, value, deleted, at, number`` of every event whose field isn't null."""
    columns = [field.alias("field"), value.cast("string").alias("value"), deleted.alias("deleted"), at.alias("at"), number.alias("number")]
    return events.select(*keys, *columns).filter("field IS NOT NULL")


def last_patches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last patch of every key and field, of a table or, as state that is updated, of a stream."""
    last = F.max(F.struct("at", "number", "deleted", "value")).alias("last")
    return rows.groupBy(*keys, "field").agg(last).select(*keys, "field", "last.value", "last.deleted", "last.at", "last.number")


def follow(rows: DataFrame, keys: list[str], target: str, checkpoint: str):
    """Start a query that takes all patches of the stream that are there, and then ends; state is kept in ``checkpoint``.

    Both folders are to be shared by driver and executors.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.select(*keys, *FIELDS).write.mode("overwrite").parquet(f"{target}/batch={n}")

    stream = last_patches(rows, keys).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).foreachBatch(write).start()


def current(spark: SparkSession, target: str, schema, keys: list[str]) -> DataFrame:
    """``keys, field, value``: what the batches written so far leave set."""
    written = spark.read.schema(schema).parquet(f"{target}/batch=*")
    return last_patches(written, keys).filter("NOT deleted").select(*keys, "field", "value")


def effective(marks: DataFrame, prints: DataFrame, keys: list[str], item: list[str]) -> DataFrame:
    """``keys, status``: seen, or stale where the mark's print isn't the item's print of now; marks without either print are seen.

    ``prints`` has ``item, print``, one row per item.
    """
    seen = marks.filter("field = 'seen'").join(prints, item, "left")
    changed = (F.col("value") != "") & F.col("print").isNotNull() & (F.col("value") != F.col("print"))
    return seen.select(*keys, F.when(changed, "stale").otherwise("seen").alias("status"))
