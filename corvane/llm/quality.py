"""Quality rules (operator 3), in DataFrame functions only: base counts, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into buckets. One multinomial is fitted to the whole raw corpus, one to trusted
documents (those labelled quality 1; at most ``TRUSTED_DOCUMENTS`` of them, those with the smallest hash of their id).
A document's score is the sum of ln p_trusted - ln p_raw over its n-grams, in whole thousandths so that sums do not depend
on their order, per n-gram. Every document is kept or rejected by the same fixed threshold.

Cases: a null text has no words and is rejected, as any text under ``min_words`` words; without trusted documents both
models are alike, every score is 0 and only the base rules decide; repeated rows are scored one by one; an empty table gives
no rows; very long texts are counted whole in one row; columns of other names are kept or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SPACE_CLASS, SPACES, table, text_of, words_of

BUCKETS = 1 << 16
TRUSTED_DOCUMENTS = 20_000
MIN_WORDS = 50
#: A document whose mean score, in thousandths of a nat per n-gram, is below this is rejected.
THRESHOLD = -82
#: Added to each bucket's trusted count and to what the raw corpus lets expect of it, so that rare n-grams weigh little.
SMOOTHING = 16.0
SYMBOLS = "#*$%&|<>"


#: More different repeated windows than this are found by sorting their places, fewer by looking each window up.
FEW = 24


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def joined(hashes: Column, following: Column, n: int) -> Column:
    """Hashes of n-grams from those of (n-1)-grams and of words: one for each place where n words begin."""
    size = F.greatest(F.size(following) - (n - 1), F.lit(0))
    return F.zip_with(F.slice(hashes, 1, size), F.slice(following, n, size), lambda a, b: F.xxhash64(a, b))


def covered_words(places: Column) -> Column:
    """Words in the 3-word windows that begin at these ascending places."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).alias("last"))
    return F.aggregate(places, start, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])


def neighbours(ordered: Column) -> Column:
    """For every element of a sorted array of structs (h, i) whose h has an equal neighbour, its i; null for the others."""
    same = F.zip_with(ordered, F.slice(ordered, 2, F.size(ordered)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    either = F.zip_with(same, F.concat(F.array(F.lit(False)), same), lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)))
    return F.filter(F.zip_with(ordered, either, lambda a, hit: F.when(hit, a["i"])), lambda x: x.isNotNull())


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, and the n-grams' hashes, beside the columns kept.

    Arrays that are used more than once are columns of their own, so that each is computed once. Repeated windows: windows'
    hashes are sorted and equal neighbours give the repeated ones; their places are looked up where those are few, else
    found by sorting windows with their places, so that the work for a text of n words stays near n log n.
    """
    text = F.col("_text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    step = docs.select(*keep, text_of().alias("_text")).withColumn("_words", words_of(text)).withColumn("_lines", lines)
    step = step.withColumn("_one", word_hashes(F.col("_words"))).withColumn("_two", joined(F.col("_one"), F.col("_one"), 2))
    step = step.withColumn("_three", joined(F.col("_two"), F.col("_one"), 3)).withColumn("_sorted", F.sort_array("_three"))
    equal = F.zip_with("_sorted", F.slice("_sorted", 2, F.size("_sorted")), lambda a, b: F.when(a == b, a))
    step = step.withColumn("_again", F.array_distinct(F.filter(equal, lambda x: x.isNotNull())))
    with_place = F.when(F.size("_again") > FEW, F.sort_array(F.transform("_three", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("_ordered", with_place)
    looked_up = F.filter(F.transform("_three", lambda h, i: F.when(F.array_contains(F.col("_again"), h), i)), lambda x: x.isNotNull())
    places = F.when(F.size("_again") > FEW, F.sort_array(neighbours(F.col("_ordered")))).otherwise(looked_up)
    return step.select(
        *keep,
        F.size("_one").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_again") == 0, F.lit(0).cast("long")).otherwise(covered_words(places)).alias("n_repeat_words"),
        F.concat("_one", "_two").alias("ngrams"),
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of trusted documents: a bounded sample, small enough to broadcast whatever the corpus holds."""
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_DOCUMENTS).withColumn("trusted", F.lit(1))


def weight_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with the array of all buckets' weights, in thousandths of a nat: as many numbers as there are buckets."""
    def buckets(rows: DataFrame) -> DataFrame:
        hashed = rows.select(words_of(text_of()).alias("w")).select(word_hashes(F.col("w")).alias("one"))
        every = hashed.select(F.explode(F.concat("one", joined(F.col("one"), F.col("one"), 2))).alias("h"))
        return every.select(F.pmod("h", F.lit(BUCKETS)).cast("int").alias("bucket"))

    raw = buckets(docs).groupBy("bucket").agg(F.count("*").alias("n"))
    trusted = buckets(docs.join(F.broadcast(trusted_ids(labels)), "doc_id", "left_semi")).groupBy("bucket").agg(F.count("*").alias("t"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(raw, "bucket", "left").join(trusted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t", F.lit(0)).alias("t"))
    totals = counts.agg(F.collect_list(F.struct("bucket", "n", "t")).alias("all"), F.sum("n").alias("sum_n"), F.sum("t").alias("sum_t"))

    def weight(c: Column) -> Column:
        expected = c["n"] * F.col("sum_t") / F.col("sum_n")
        return F.when(F.col("sum_t") == 0, F.lit(0)).otherwise(F.round(1000 * F.log((c["t"] + SMOOTHING) / (expected + SMOOTHING)))).cast("int")

    return totals.select(F.transform(F.array_sort("all"), weight).alias("weights"))


def model_literal(weights: DataFrame) -> Column:
    """The array of a one-row model table as a constant. Its size is fixed by ``BUCKETS``, whatever the corpus holds."""
    numbers = weights.first()[0]
    return F.split(F.lit(",".join(map(str, numbers))), ",", -1).cast("array<int>")


def score(ngrams: Column, weights: Column) -> Column:
    """Sum of the weights of a document's n-grams, in whole thousandths of a nat."""
    return F.aggregate(ngrams, F.lit(0).cast("long"), lambda acc, h: acc + F.get(weights, F.pmod(h, F.lit(BUCKETS)).cast("int")))


def judge(docs: DataFrame, labels: DataFrame, *keep: str, threshold: int = THRESHOLD) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the score of every document, beside the columns kept."""
    weights = model_literal(weight_table(docs, labels))
    rows = base_counts(docs, *keep).withColumn("score", score(F.col("ngrams"), weights))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold * n_grams)).drop("ngrams")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass, with their own columns, which travel in one struct, so that none of their names can clash.

    Rejected rows go by an explode of none or one element: a filter would be pushed below the columns that ``kept`` comes from
    and compute each of them again wherever it is named.
    """
    judged = judge(docs.select(F.struct("*").alias("_row"), "doc_id", "text"), table(spark, sf_dir, "labels"), "_row")
    once = F.explode(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return judged.select("_row", once.alias("_once")).select("_row.*")
