"""Ranked choices per key: keep the best row, the best k, neighbours, runs, running sums, as-of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in ``order``, which must end in a unique column."""
    return top_k(df, keys, order, 1).drop("rank")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with their ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``run``: the number, from 1, of the stretch of equal neighbouring values that a row is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def as_of(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the latest non-null ``value`` of an earlier row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def select_spans(df: DataFrame, keys: list[str], start: str, end: str, ties: list[str]) -> DataFrame:
    """Spans that overlap none chosen before them, taken by their start, longer ones first, then by ``ties``; empty ones go.

    The choice of one span depends on all before it, so the spans of a key are folded in one row: keys are to be texts, orders
    and the like, whose spans fit into one.
    """
    rows = df.filter(F.col(end) > F.col(start))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start).cast("long").alias("s"), (-F.col(end)).cast("long").alias("e"), *ties))).alias("spans"))
    begin = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(acc: Column, s: Column) -> Column:
        taken = acc["last"].isNull() | (s["s"] >= acc["last"])
        kept = F.when(taken, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"])
        return F.struct(F.when(taken, -s["e"]).otherwise(acc["last"]).alias("last"), kept.alias("kept"), (acc["i"] + 1).alias("i"))

    chosen = listed.select(*keys, "spans", F.explode(F.aggregate("spans", begin, step)["kept"]).alias("i")).select(*keys, F.get("spans", F.col("i")).alias("x"))
    return chosen.select(*keys, *[F.col(f"x.{t}").alias(t) for t in ties], F.col("x.s").alias(start), (-F.col("x.e")).alias(end))
