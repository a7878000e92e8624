"""Mixing sources to target weights (operator 4), in DataFrame functions only: entropy balancing.

Each source has a target of tokens. Document rates stay as close to 1 as they can, in relative entropy, while each source's
rates times sizes sum to its target and no rate passes ``MAX_RATE``: the solution is r = min(MAX_RATE, exp(lambda * x)),
x being the document's size over its source's mean. The convex dual has one lambda per source. Newton's iterations run on all
sources at once, over counts of documents by source and size (documents of one size in one source have one rate, so this
loses nothing); each is a small aggregation. Steps
are taken on the logarithm of the tokens, and one that leaves its bracket
is replaced by bisection; tokens at points inside the bracket, summed by the same pass, narrow it.

Rates become whole copies by systematic rounding: over sizes in order, a running sum of expected copies is cut at whole
numbers. Tokens then miss the target by up to a large document; what is missing or too much is made up by copies of the
largest size that fits into it, then of smaller ones, so that in the end a source misses by less than the smallest of its
documents that can still give or take a copy. A size's copies are dealt to hash buckets in the same way, through as many
levels of at most ``FAN_OUT`` buckets as leave about ``BUCKET_ROWS`` rows in the last, however many documents share a source
and a size; inside a bucket the documents with the lowest hash take what is left over. Copies are 0 to MAX_RATE, reruns agree.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, the last; repeated ids are mixed
each for itself, ties in their hash by text; very long texts are counted whole; an empty table gives no rows; columns of other
names are kept or ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import SPACE_CLASS, SPACES, materialise, row_text, table, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_RATE = 2.0
#: Newton's iterations at most, and the relative error of a source's tokens at which they end.
ITERATIONS, PRECISION = 60, 1e-5
#: Points at which each iteration also looks for the sign of the gap, to narrow the bracket around the solution.
POINTS = 15
BUCKET_ROWS, FAN_OUT = 128, 4096


def word_count(text: Column) -> Column:
    """Number of words of a non-null text: places where a word begins."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", 0).otherwise(F.regexp_count(trimmed, F.lit(f"[{SPACE_CLASS}]+")) + 1).cast("long")


def source_key() -> Column:
    """A name for every source, also the null one, which sorts last."""
    return F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source")))


def targets(sources: DataFrame) -> DataFrame:
    """From ``key, source_size``: each source's ``target`` of tokens.

    Weights are dealt to sources in order. All share SHARE times all tokens by weight; a target stops at MAX_RATE times its
    source's size and the excess goes to the others by weight. The fixed point is a common level L with
    target = min(cap, L * weight): sources sorted by cap / weight, L follows from running sums.
    """
    kinds = F.array(*map(F.lit, WEIGHTS))
    place = F.pmod(F.row_number().over(Window.orderBy("key")) - 1, F.lit(len(WEIGHTS))) + 1
    rows = sources.withColumn("weight", F.element_at(kinds, place.cast("int")))
    rows = rows.withColumn("cap", MAX_RATE * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("all", F.lit(SHARE) * F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    capped, gone = F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (F.col("all") - capped) / (F.col("all_weight") - gone))
    # The level is that of the first source which its own level leaves under its cap; later sources' levels don't count.
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"]
    return rows.withColumn("target", F.least("cap", F.coalesce(first * F.col("weight"), F.col("cap")))).select("key", "source_size", "target")


def tilts(sizes: DataFrame) -> DataFrame:
    """From ``key, size, n, mean, target`` (n documents): each source's ``tilt``, the lambda of its documents."""
    part = F.col("target") < MAX_RATE * F.col("source_size")  # the others are taken whole
    rows = materialise(sizes.filter((F.col("size") > 0) & part).select("key", (F.col("size") / F.col("mean")).alias("x"), (F.col("n") * F.col("size")).cast("double").alias("mass"), "target"))
    ends = {"tilt": F.lit(0.0), "low": F.lit(-64.0), "high": F.lit(64.0), "done": F.lit(False)}
    state = materialise(rows.groupBy("key").agg(F.first("target").alias("target")).withColumns(ends))
    point = lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / (POINTS + 1)
    for _ in range(ITERATIONS):
        open_ = state.filter(~F.col("done"))
        if open_.isEmpty():
            break
        rate = F.exp(F.least(F.lit(50.0), F.col("tilt") * F.col("x")))
        sums = rows.select("key", "x", "mass").join(open_, "key").groupBy("key").agg(
            F.sum(F.col("mass") * F.least(rate, F.lit(MAX_RATE))).alias("tokens"),
            F.sum(F.when(rate < MAX_RATE, F.col("mass") * F.col("x") * rate).otherwise(0.0)).alias("slope"),
            *[F.first(c).alias(c) for c in ("target", "tilt", "low", "high")],
            F.array(*[F.sum(F.col("mass") * F.least(F.exp(F.least(F.lit(50.0), point(k) * F.col("x"))), F.lit(MAX_RATE))) for k in range(1, POINTS + 1)]).alias("at_points"),
        )
        gap = F.col("tokens") - F.col("target")
        below = F.size(F.filter("at_points", lambda t: t < F.col("target")))
        low, high = F.when(gap < 0, F.greatest("tilt", point(below))).otherwise(point(below)), F.when(gap > 0, F.least("tilt", point(below + 1))).otherwise(point(below + 1))
        moved = sums.select("target", "key", "tokens", "slope", "tilt", low.alias("low"), high.alias("high"))
        newton = F.col("tilt") - F.try_divide(F.col("tokens"), F.col("slope")) * F.log(F.col("tokens") / F.col("target"))
        inside = newton.isNotNull() & (newton > F.col("low")) & (newton < F.col("high"))
        done = (F.abs(gap) <= PRECISION * F.col("target")) | (F.col("high") - F.col("low") < 1e-12)
        after = moved.select("key", "target", F.when(done, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", done.alias("done"))
        state = materialise(after.unionByName(state.filter("done").select(*after.columns)))
    return state.select("key", "tilt")


def made_up(sizes: DataFrame) -> DataFrame:
    """From ``key, size, n, target, size_copies``: ``key, size, more``, the copies by which sizes make up for rounding.

    A source's sizes are folded from the largest down. A source has at most as many as its longest document has words, and the
    fold keeps the few sizes that change.
    """
    top = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "size", F.col("size_copies").alias("has"), (MAX_RATE * F.col("n")).cast("long").alias("most"))))
    gap = F.first("target") - F.sum(F.col("size") * F.col("size_copies"))
    rows = sizes.filter("size > 0").groupBy("key").agg(gap.alias("gap"), top.alias("sizes"))
    start = F.struct(F.col("gap"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("moved"))

    def step(acc: Column, s: Column) -> Column:
        whole = F.floor(F.abs(acc["gap"]) / s["size"])
        more = F.when(acc["gap"] >= 0, F.least(whole, s["most"] - s["has"])).otherwise(-F.least(whole, s["has"]))
        return F.when(more == 0, acc).otherwise(F.struct((acc["gap"] - more * s["size"]).alias("gap"), F.concat(acc["moved"], F.array(F.struct(s["size"].alias("size"), more.alias("more")))).alias("moved")))

    return rows.select("key", F.explode(F.aggregate("sizes", start, step)["moved"]).alias("m")).select("key", "m.size", "m.more")


def mix_sizes(sized: DataFrame) -> DataFrame:
    """From rows with ``doc_id, key, size, tie``: the same rows with ``source_size, target, copies``.

    ``sized`` must be a table that reads the same every time.
    """
    histogram = materialise(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    sources = histogram.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("docs"))
    aims = materialise(targets(sources).join(sources.select("key", (F.col("source_size") / F.col("docs")).alias("mean")), "key"))
    sizes = histogram.join(aims, "key")
    tilted = sizes.join(tilts(sizes), "key", "left")
    rate = F.exp(F.least(F.lit(50.0), F.coalesce("tilt", F.lit(0.0)) * F.col("size") / F.col("mean")))
    full = F.col("target") >= MAX_RATE * F.col("source_size")
    rated = tilted.withColumn("rate", F.when(F.col("size") == 0, 0.0).when(full, MAX_RATE).otherwise(F.least(F.lit(MAX_RATE), rate)))

    def cut(rows: DataFrame, expected: Column, order: Window, name: str) -> DataFrame:
        """Whole numbers with the running sums of ``expected``: each differs from it by less than 1, their sums too."""
        upto = F.sum(expected).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        rows = rows.withColumn("_upto", F.floor(upto + 0.5))
        return rows.withColumn(name, F.col("_upto") - F.coalesce(F.lag("_upto").over(order), F.lit(0))).drop("_upto")

    by_size = cut(rated, F.col("rate") * F.col("n"), Window.partitionBy("key").orderBy("size"), "size_copies")
    by_size = materialise(by_size.select("key", "size", "n", "source_size", "target", "size_copies"))
    fixed = by_size.join(made_up(by_size), ["key", "size"], "left")
    parts = materialise(fixed.select("key", "size", "source_size", "target", F.col("n").alias("rows"), (F.col("size_copies") + F.coalesce("more", F.lit(0))).alias("share")))
    buckets, levels = max(1, sized.count() // BUCKET_ROWS), 1
    while FAN_OUT**levels < buckets:
        levels += 1
    fan_out = ceil(buckets ** (1 / levels))
    place = lambda k: F.pmod(F.shiftrightunsigned(F.xxhash64("draw", F.lit(k)), 1), F.lit(fan_out))
    drawn = sized.withColumn("draw", F.xxhash64("doc_id", F.lit("mix"))).withColumns({f"bucket{k}": place(k) for k in range(levels)})
    by = ["key", "size"]
    for k in range(levels):
        # Parts grow with the documents, so they are never broadcast.
        counted = drawn.groupBy(*by, f"bucket{k}").agg(F.count("*").alias("m")).join(parts.hint("merge"), by)
        dealt = cut(counted, F.col("share") * F.col("m") / F.col("rows"), Window.partitionBy(*by).orderBy(f"bucket{k}"), "part")
        by = [*by, f"bucket{k}"]
        parts = dealt.select(*by, "source_size", "target", F.col("m").alias("rows"), F.col("part").alias("share"))
    rows = drawn.join(parts.hint("merge"), by)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("draw", "doc_id", "tie"))
    each = F.floor(F.col("share") / F.col("rows"))
    copies = each + F.when(rank <= F.col("share") - each * F.col("rows"), 1).otherwise(0)
    return rows.select(*sized.columns, "source_size", "target", copies.cast("long").alias("copies"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = materialise(docs.select("doc_id", source_key().alias("key"), word_count(text_of()).alias("size"), F.xxhash64("text").alias("tie")))
    return mix_sizes(sized).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))


def take_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, each as often as the mix takes it. Documents alike in id, source and text share their copies, in the order of
    their rows as text.

    A row's own columns travel in one struct, so none of their names can clash.
    """
    by = ["_key", "_doc", "_tie"]
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = docs.select(F.struct("*").alias("_row"), source_key().alias("_key"), doc.alias("_doc"), F.xxhash64("text", "doc_id").alias("_tie"))
    sized = materialise(docs.select("doc_id", source_key().alias("key"), word_count(text_of()).alias("size"), F.xxhash64("text", "doc_id").alias("tie"), doc.alias("_doc")))
    mixed = mix_sizes(sized).groupBy(F.col("key").alias("_key"), "_doc", F.col("tie").alias("_tie")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    rows = keyed.join(mixed.hint("merge"), by)
    many = rows.filter("_rows > 1").withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(row_text())))
    each = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_k") <= F.pmod("_copies", "_rows"), 1).otherwise(0)
    shared = rows.filter("_rows = 1").select("_row", "_copies").unionByName(many.select("_row", each.alias("_copies")))
    return shared.filter("_copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
