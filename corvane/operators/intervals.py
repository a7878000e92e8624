"""Points in intervals by nested bins: the innermost interval around each point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, point: list[str], span: list[str]) -> DataFrame:
    """Of the spans of a point's key around it the innermost: ``point, span, depth``; points outside of all are left out.

    Spans are closed, of whole numbers, and may nest or overlap; the shortest is innermost, of equals the one that begins
    last, then the least ``span``. ``depth`` is how many lie around the point. ``point`` and ``span`` are columns that tell rows
    apart. Spans of nulls, or that end before they begin, hold nothing.

    A span lies in the one or two bins, of the least power of two above its length, that it touches. A point lies in one bin
    of each size that spans have, of which there are at most 64, so the join is of equal key, size and bin. Its work grows with the spans
    around a point and those near by of about their length, never with all spans of a key. Points keep what they met by an
    aggregation, which begins before the shuffle.
    """
    size = F.length(F.bin(F.col(end) - F.col(start)))
    shift = lambda value, by: F.call_function("shiftright", value, by)
    real = spans.filter(F.col(start) <= F.col(end)).select(*keys, F.col(start).cast("long").alias("_s"), F.col(end).cast("long").alias("_e"), F.struct(*span).alias("_span"), size.alias("_size"))
    sizes = sorted(r[0] for r in real.select("_size").distinct().collect())
    binned = real.withColumn("_bin", F.explode(F.array_distinct(F.array(shift(F.col("_s"), F.col("_size")), shift(F.col("_e"), F.col("_size"))))))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("_size"), shift(F.col("_at"), F.lit(n)).alias("_bin")) for n in sizes))) if sizes else F.explode(F.array().cast("array<struct<_size:int,_bin:long>>"))
    looked = points.select(*keys, F.col(at).cast("long").alias("_at"), F.struct(*point).alias("_point")).withColumn("_b", each).select(*keys, "_at", "_point", "_b._size", "_b._bin")
    met = looked.join(binned, [*keys, "_size", "_bin"]).filter("_s <= _at AND _at <= _e")
    best = F.min(F.struct((F.col("_e") - F.col("_s")).alias("length"), (-F.col("_s")).alias("s"), F.col("_span").alias("span"))).alias("best")
    return met.groupBy("_point").agg(best, F.count("*").alias("depth")).select("_point.*", "best.span.*", "depth")
