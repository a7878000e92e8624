"""Running sums over ordered rows, places and cuts under a cap, without a task that sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.scratch import materialise


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of a key up to each row, in ascending ``order``.

    The order must tell all rows of a key apart. Rows are dealt to tasks by ranges of key and order, so that one key may have
    any number of tasks. Sums inside of a range are taken first; what the ranges before it hold of its key is then added, from
    one number per key and range.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_value", value.cast("long")).repartitionByRange(tasks, *keys, *order)
    ranges = materialise(dealt.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranges.groupBy("_range", *keys).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    sums = ranges.withColumn("_sum", F.sum("_value").over(inside)).join(before, same)
    return sums.select(*df.columns, (F.col("_sum") + F.col("_before")).alias(name))


def places(df: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Adds each row's place from 1 among all rows, in ascending ``order``, which must tell all rows apart."""
    return running_sum(df, [], order, F.lit(1), name)


def next_starts(units: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """``keys, pos, next``: from a part that begins at a unit, where the next part begins: the first unit that goes beyond the cap.

    ``units`` have ``pos`` from 1, ``weight`` of at least 1 and ``total``, the weights up to them. Units and the places that they
    can reach are laid in one order, where a running count of units tells how many lie within reach.
    """
    reach = F.col("total") - F.col("weight") + cap
    event = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"))
    events = units.select(*keys, "pos", F.explode(F.array(event(F.col("total"), 0), event(reach, 1))).alias("e")).select(*keys, "pos", "e.at", "e.kind")
    counted = running_sum(events, keys, ["at", "kind", "pos"], 1 - F.col("kind"), "within")
    return counted.filter("kind = 1").select(*keys, "pos", (F.greatest("within", "pos") + 1).alias("next"))


def starts_from_first(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, pos``: the positions met from position 1 along ``next``, by pointer doubling.

    Tables of jumps of 1, 2, 4 steps and so on are written until no jump stays among the positions; their joins grow with the
    logarithm of the number of parts. From the longest down, each jump then doubles the positions that are known.
    """
    inner = steps.join(steps.select(*keys, F.col("pos").alias("next")), [*keys, "next"], "left_semi").select(*keys, "pos", "next")
    jumps = [materialise(inner)]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        onward = last.select(*keys, F.col("pos").alias("next"), F.col("next").alias("_then"))
        jumps.append(materialise(last.join(onward, [*keys, "next"]).select(*keys, "pos", F.col("_then").alias("next"))))
    met = steps.filter("pos = 1").select(*keys, "pos")
    for jump in reversed(jumps[:-1]):
        met = materialise(met.unionByName(met.join(jump, [*keys, "pos"]).select(*keys, F.col("next").alias("pos"))))
    return met


def parts_under_cap(rows: DataFrame, keys: list[str], unit: str, order: list[str], cap: int) -> DataFrame:
    """Adds ``part`` and ``parts``: a key's rows cut in parts of at most ``cap``, units in ascending order, no unit cut needlessly.

    A part takes whole units until the next would go beyond the cap. A unit of more rows than the cap has parts of its own, its
    rows in ``order``, which must tell them apart.
    """
    weights = rows.groupBy(*keys, unit).agg(F.count("*").alias("weight"))
    numbered = running_sum(running_sum(weights, keys, [unit], F.lit(1), "pos"), keys, [unit], F.col("weight"), "total")
    units = materialise(numbered)
    starts = starts_from_first(next_starts(units, keys, cap), keys).withColumn("opens", F.lit(1))
    opened = units.join(starts, [*keys, "pos"], "left").withColumn("opens", F.when(F.col("opens").isNull(), 0).otherwise(F.ceil(F.col("weight") / cap)))
    last = materialise(running_sum(opened, keys, ["pos"], F.col("opens"), "last"))
    all_parts = last.groupBy(*keys).agg(F.max("last").alias("parts"))
    ranked = running_sum(rows, [*keys, unit], order, F.lit(1), "_place")
    first = last.select(*keys, unit, (F.col("last") - F.greatest("opens", F.lit(1)) + 1).alias("_first"))
    return ranked.join(first, [*keys, unit]).join(all_parts, keys).select(*rows.columns, (F.col("_first") + F.floor((F.col("_place") - 1) / cap)).alias("part"), "parts")
