"""Fingerprints of multisets of lines that follow additions and removals without a look at the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def line_number(line: Column) -> Column:
    """A line as a number below 2^32, from its MD5 hash."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def fingerprint(lines: Column) -> Column:
    """The sum of the lines' numbers: the order of lines plays no part, their number does. A long holds 2^31 lines."""
    return F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + line_number(x))


def changes(texts: DataFrame, keys: list[str], order: list[str], lines: str) -> DataFrame:
    """``keys, order, line, d``: how often each text of a key has a line more, or less, than the text before it.

    Lines that both have as often are left out. Both texts' lines meet in one aggregation, without a join.
    """
    before = F.lag(lines).over(Window.partitionBy(*keys).orderBy(*order))
    own = [*keys, *order]
    sides = texts.select(*own, F.array(F.struct(F.col(lines).alias("l"), F.lit(1).alias("d")), F.struct(before.alias("l"), F.lit(-1).alias("d"))).alias("s")).select(*own, F.explode("s").alias("s"))
    each = sides.select(*own, F.col("s.d").alias("d"), F.explode("s.l").alias("line"))
    return each.groupBy(*own, "line").agg(F.sum("d").alias("d")).filter("d <> 0")


def moved_by(changed: DataFrame, own: list[str]) -> DataFrame:
    """``own, by``: what additions and removals of lines add to a fingerprint."""
    return changed.groupBy(*own).agg(F.sum(F.col("d") * line_number(F.col("line"))).alias("by"))
