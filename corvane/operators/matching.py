"""Similarity of token bags, and snapshots against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.scratch import RELEASE, discard, materialise, settings


def _grams(words: str) -> Column:
    """Hashes of an array's neighbouring words; a single word stands for itself."""
    many = F.greatest(F.size(words) - 1, F.lit(0))
    return F.when(F.size(words) == 1, F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.zip_with(F.slice(words, 1, many), F.slice(words, 2, many), lambda a, b: F.xxhash64(a, b)))


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda w: w != "")


def bigrams(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, gram``: 64-bit hashes of a text's word bigrams as they occur; a single word stands for itself."""
    return df.select(*keys, _words(text).alias("w")).select(*keys, F.explode(_grams("w")).alias("gram"))


def bigram_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, tokens``: the multiset of a text's word bigrams as a set, of each bigram its first occurrence, its second and so on.

    What two multisets share is then what two sets share. A row's set is made where the row lies; texts without words have none.
    """
    rows = df.select(key, _words(text).alias("w")).select(key, F.sort_array(_grams("w")).alias("s")).filter(F.size("s") > 0)
    firsts = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: ~F.get("s", i).eqNullSafe(F.get("s", i - 1)))
    places = F.transform("firsts", lambda f, j: F.sequence(f, F.coalesce(F.get("firsts", j + 1), F.size("s")) - 1))
    tokens = F.flatten(F.transform("places", lambda p: F.transform(p, lambda i: F.xxhash64(F.get("s", i), i - F.get(p, F.lit(0))))))
    return rows.select(key, "s", firsts.alias("firsts")).select(key, "s", places.alias("places")).select(key, tokens.alias("tokens"))


def distinct_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``id, content, first, text``, written: a numbered row for each different text (null is empty) with the least key of its rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    texts = df.groupBy(F.md5(body).alias("content")).agg(F.min(key).alias("first"), F.any_value(body).alias("text"))
    return materialise(texts.withColumn("id", F.monotonically_increasing_id()))


def _prefixes(sets: DataFrame, key: str, counts: DataFrame, share: float) -> DataFrame:
    """``t, key, n, place``: of a set of n tokens in order of rarity, those of the first n - ceil(n * share) + 1 that others have too.

    Tokens that no other set has come first and join nothing, so they are counted and not kept; ``place`` is from 0.
    """
    known = _tokens(sets, key).join(counts, "t").groupBy(key).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "t"))).alias("known"))
    size = F.size("known")
    first = F.slice("known", 1, F.greatest(size - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1, F.lit(0)))
    placed = known.select(key, "n", (F.col("n") - size).alias("_alone"), F.posexplode(first).alias("_at", "_token"))
    return materialise(placed.select(F.col("_token.t").alias("t"), key, "n", (F.col("_alone") + F.col("_at")).alias("place")))


def _tokens(sets: DataFrame, key: str) -> DataFrame:
    return sets.select(key, F.size("tokens").alias("n"), F.explode("tokens").alias("t"))


def dice_pairs(left: DataFrame, right: DataFrame | None, a: str, b: str, least: float) -> DataFrame:
    """Pairs with Dice similarity, 2 * tokens in common / sum of sizes, of ``least`` or more.

    ``left`` has ``a, tokens`` and ``right`` has ``b, tokens``, both written tables of one row a key, tokens without repeats
    (``bigram_sets``); without ``right``, pairs a < b of ``left``. Sets meet on their rarest tokens only: two that reach the bound
    share one of the first size - ceil(size * p) + 1 in order of rarity, p = least / (2 - least), so frequent tokens join
    nothing. What a pair shares after the last token it met on is at most what the shorter rest holds; pairs that can't
    reach the bound so are dropped before any set is read, the others compare two arrays. Joins are of written tables, so
    that a hot token can be split.
    """
    share = least / (2 - least)
    every = _tokens(left, a).select("t")
    every = every if right is None else every.union(_tokens(right, b).select("t"))
    counts = materialise(every.groupBy("t").agg(F.count("*").alias("f")).filter("f > 1"))
    l = _prefixes(left, a, counts, share)
    r = l.withColumnRenamed(a, b) if right is None else _prefixes(right, b, counts, share)
    other = left.withColumnRenamed(a, b) if right is None else right
    l, r = l.withColumnsRenamed({"n": "n1", "place": "p1"}), r.withColumnsRenamed({"n": "n2", "place": "p2"})
    needed = least * (F.col("n1") + F.col("n2")) - 1e-6
    met = l.join(r, "t").filter(2 * F.least("n1", "n2") >= needed)
    met = (met.filter(F.col(a) < F.col(b)) if right is None else met).groupBy(a, b, "n1", "n2").agg(F.count("*").alias("_met"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    most = F.col("_met") + F.least(F.col("n1") - 1 - F.col("p1"), F.col("n2") - 1 - F.col("p2"))
    met = materialise(met.filter(2 * most >= needed).select(a, b, "n1", "n2"))
    common = met.join(left.select(a, F.col("tokens").alias("_l")), a).join(other.select(b, F.col("tokens").alias("_r")), b)
    dice = 2 * F.size(F.array_intersect("_l", "_r")) / (F.col("n1") + F.col("n2"))
    return common.select(a, b, dice.alias("dice")).filter(F.col("dice") >= least).select(a, b, F.round("dice", 6).alias("dice"))


def contained_bags(docs: DataFrame, items: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """``a, b, share`` where a document has ``least`` or more of an item's occurrences: sum of least counts / item's size.

    ``docs`` has ``a, gram, c`` and ``items`` has ``b, gram, c``. An item's rarest size - ceil(size * least) + 1 occurrences
    can't all be missing, so pairs meet on those only and are then summed exactly; a document's length plays no part.
    """
    w = Window.partitionBy(b)
    rows = items.join(docs.groupBy("gram").agg(F.count("*").alias("f")), "gram", "left").fillna(0, ["f"]).withColumn("n", F.sum("c").over(w))
    before = F.coalesce(F.sum("c").over(w.orderBy("f", "gram").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    prefix = rows.filter(F.col("n") > 0).withColumn("before", before).filter(F.col("before") < F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    met = docs.select(a, "gram").join(prefix.select("gram", b, "n"), "gram").select(a, b, "n").distinct()
    common = met.join(docs.withColumnRenamed("c", "c1"), a).join(items.withColumnRenamed("c", "c2"), [b, "gram"]).groupBy(a, b, "n").agg(F.sum(F.least("c1", "c2")).alias("m"))
    return common.withColumn("share", F.col("m") / F.col("n")).filter(F.col("share") >= least).select(a, b, F.round("share", 6).alias("share"))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``key, status``: added, removed, modified or unchanged between two snapshots with one row per key."""
    o, n = old.select(key, F.struct(*values).alias("o")), new.select(key, F.struct(*values).alias("n"))
    status: Column = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified").otherwise("unchanged")
    return o.join(n, key, "full").select(key, status.alias("status"))


def greedy_pairs(scored: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """One-to-one pairs by falling score, ties by ``a`` then ``b``, each side used once.

    A pair that is the best of both its sides is what the greedy order takes, whatever else there is; so each round takes
    all of those and drops the pairs that touch them, until none is left. Only the pairs taken stay in the shared folder.
    """
    spark, taken = scored.sparkSession, []
    order = F.struct((-F.col(score)).alias("s"), F.col(a).alias("a"), F.col(b).alias("b"))
    best = lambda of: left.groupBy(of).agg(F.min(order).alias("k")).select(F.col("k.a").alias(a), F.col("k.b").alias(b), (-F.col("k.s")).alias(score))
    with settings(spark, RELEASE):
        left = materialise(scored.select(a, b, score).filter(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {score} IS NOT NULL").distinct())
        while not left.isEmpty():
            both = materialise(best(a).join(best(b), [a, b, score]))
            taken.append(both.scratch_path)
            rest = materialise(left.join(both.select(a), a, "left_anti").join(both.select(b), b, "left_anti").select(a, b, score))
            discard(left)
            left = rest
    return spark.read.schema(left.schema).parquet(*taken) if taken else left
