"""Filter interaction audit (operator 11): what each filter removes, in every order of the filters.

Filters A to E fail documents of few words, of repeated words, of many capitals, with signs, and copies of a smaller doc_id.
A and B come from a sparse document-term matrix. Tasks cut their documents into shards of some million characters and write
each as rows of a compressed sparse matrix over the shard's own words. The words are then encoded globally: shards send their
words in buckets by hash, each bucket ranks its distinct words, and a bucket's ids begin where those of the buckets before it
end. Ids go back to their shards and replace the shards' own. Row sums are numbers of words, nonzero entries distinct words.

Copies and labels meet as counts: rows alike in text, id and part are one row with a number, so a large group of copies is
small before it meets anything. What is left are numbers of documents by part and set of failed filters, at most 128 a part;
orders are worked out on those.

Cases: a null text is empty and fails A alone, unless it is a copy; a null lang is the part of the empty string; a null doc_id is neither
smaller than another nor larger, so E never fails it; repeated rows have one doc_id, so E fails none of them for the other; a
document has the labels of all rows of its doc_id; very long texts are one shard; an empty table gives no rows; columns of
other names are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import materialise, table, text_of
from .hashing import text_bytes, word_hashes
from .tokens import slices

#: The filters' bounds.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, "#$%&*|"
#: Characters of a shard; one text may have more.
SHARD_CHARS = 3_000_000
#: Bytes that go to a Python task at once, or one shard.
BATCH_BYTES = 8 << 20


def _shards_of(batches, most: int):
    """Record batches of about as many characters as a shard may have, joined and cut from those that come."""
    waiting, total = [], 0
    for batch in slices(batches, "_text", most):
        n = int(pc.sum(pc.binary_length(batch.column("_text"))).as_py() or 0)
        if waiting and total + n > most:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, total = [], 0
        waiting.append(batch)
        total += n
    if waiting and sum(b.num_rows for b in waiting):
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def sparse_rows(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and their matrix: where each text's entries begin, entries' words and counts."""
    split = pc.ascii_split_whitespace(texts)
    flat, parent = pc.list_flatten(split), pc.list_parent_indices(split)
    real = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(real).dictionary_encode()
    row, code, width = np.asarray(parent.filter(real), np.int64), np.asarray(coded.indices, np.int64), max(len(coded.dictionary), 1)
    entries, counts = np.unique(row * width + code, return_counts=True)
    return coded.dictionary, np.searchsorted(entries, np.arange(len(texts) + 1) * width), entries % width, counts


def sign_flags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text has too many capitals, and whether it has a sign."""
    data, offsets = text_bytes(texts)
    upto = lambda hit: np.concatenate([[0], np.cumsum(hit)])[offsets]
    sign = np.zeros(256, bool)
    sign[list(SIGNS.encode())] = True
    capitals, points = np.diff(upto((data >= 65) & (data <= 90))), np.diff(upto((data & 0xC0) != 0x80))
    return 100 * capitals > CAPITAL_PERCENT * points, np.diff(upto(sign[data])) > 0


def _one(values, kind: pa.DataType) -> pa.Array:
    """A list array whose only entry holds all the values."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def term_shards(docs: DataFrame, keep: list[str], buckets: int, text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """Written shards: a row of matrix and documents for each, and a row of words for each of its buckets.

    ``shard, bucket, words`` and ``shard, indptr, codes, counts, rows``; rows hold the columns kept and the signs' flags. The
    number of a word in its shard is its place in the shard's buckets laid end to end.
    """

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for batch in _shards_of(batches, shard_chars):
            texts = batch.column("_text")
            words, indptr, codes, counts = sparse_rows(texts)
            bucket = (word_hashes(words)[0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            new = np.empty(len(order), np.int32)
            new[order] = np.arange(len(order), dtype=np.int32)
            used, begin = np.unique(bucket[order], return_index=True)
            shard = task << 32 | made
            made += 1
            lists = pa.ListArray.from_arrays(pa.array([*begin, len(order)], pa.int32()), words.take(pa.array(order)))
            yield _as(schema, len(used), shard=pa.array(np.full(len(used), shard), pa.int64()), bucket=pa.array(used, pa.int32()), words=lists)
            capitals, signs = sign_flags(texts)
            own = batch.column("_row")
            rows = pa.StructArray.from_arrays([*own.flatten(), pa.array(capitals), pa.array(signs)], [*(f.name for f in own.type), "_capitals", "_signs"])
            matrix = {"indptr": _one(indptr, pa.int32()), "codes": _one(new[codes] if len(codes) else [], pa.int32()), "counts": _one(counts, pa.int32()), "rows": _one(rows, rows.type)}
            yield _as(schema, 1, shard=pa.array([shard], pa.int64()), **matrix)
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.struct(*keep).alias("_row"), text_of(text).alias("_text"))
    fields = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in rows.schema["_row"].dataType)
    ddl = f"shard long, bucket int, words array<string>, indptr array<int>, codes array<int>, counts array<int>, rows array<struct<{fields}, _capitals: boolean, _signs: boolean>>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return materialise(rows.mapInArrow(run, ddl))


def _as(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A record batch of a schema, null where nothing is given."""
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def term_ids(shards: DataFrame, buckets: int) -> DataFrame:
    """``shard, ids``: the global number of each of a shard's words, in the shard's order; all words are numbered without gaps.

    Lists of words travel to their bucket whole, and a bucket numbers its words as they come. A task holds its bucket's
    distinct words, so buckets are to grow with the vocabulary. Numbers are written before they are used: a task that runs
    again may number otherwise.
    """

    def run(batches):
        known: dict[int, dict[str, int]] = {}
        for batch in batches:
            bucket, words, numbers, tops = batch.column("bucket").to_pylist(), batch.column("words"), [], []
            for i, k in enumerate(bucket):
                own = known.setdefault(k, {})
                numbers.append(np.array([own.setdefault(w, len(own)) for w in words[i].values.to_pylist()], np.int32))
                tops.append(len(own))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, numbers)]), pa.int32()), pa.array(np.concatenate(numbers) if numbers else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("shard"), lists, pa.array(tops, pa.int32())], ["bucket", "shard", "numbers", "top"])

    words = shards.filter("bucket IS NOT NULL").select("bucket", "shard", "words").repartition(buckets, "bucket")
    lists = materialise(words.mapInArrow(run, "bucket int, shard long, numbers array<int>, top int"))
    # As many rows as there are buckets, a parameter.
    sizes = lists.groupBy("bucket").agg(F.max("top").cast("long").alias("size"))
    bases = sizes.select("bucket", (F.sum("size").over(Window.orderBy("bucket")) - F.col("size")).alias("base"))
    based = lists.join(F.broadcast(bases), "bucket").select("shard", F.struct("bucket", "base", "numbers").alias("part"))
    parts = based.groupBy("shard").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return parts.select("shard", F.flatten(F.transform("parts", lambda p: F.transform(p["numbers"], lambda k: p["base"] + k))).alias("ids"))


def _encoded(docs: DataFrame, keep: list[str], text: str, shard_chars: int) -> DataFrame:
    """Shards' matrices beside the global numbers of their words."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = term_shards(docs, keep, buckets, text, shard_chars)
    matrix = shards.filter("bucket IS NULL").select("shard", "indptr", "codes", "counts", "rows")
    return matrix.join(term_ids(shards, buckets).hint("merge"), "shard", "left")


def _sparse(batches):
    """Of each shard: its number, where its rows begin, entries' global terms and counts, its documents."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = batch.slice(i, 1)
            ids, codes = (pc.list_flatten(one.column(c)) for c in ("ids", "codes"))
            yield one, (ids.take(codes) if len(ids) else pa.array([], pa.int64()))
        pa.default_memory_pool().release_unused()


def term_matrix(docs: DataFrame, keep: list[str], text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """The document-term matrix in compressed sparse rows: ``shard, indptr, terms, counts, rows``, a row for each shard.

    Entries indptr[i] to indptr[i + 1] are those of document rows[i]; terms number words globally.
    """
    joined = _encoded(docs, keep, text, shard_chars)

    def run(batches):
        for one, terms in _sparse(batches):
            yield pa.RecordBatch.from_arrays([one.column("shard"), one.column("indptr"), _one(terms, pa.int64()), one.column("counts"), one.column("rows")], ["shard", "indptr", "terms", "counts", "rows"])

    return joined.mapInArrow(run, f"shard long, indptr array<int>, terms array<long>, counts array<int>, rows {joined.schema['rows'].dataType.simpleString()}")


def row_counts(docs: DataFrame, keep: list[str], text: str = "text", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """A row for each document of the matrix: ``row``, its sum ``n_words`` and its nonzero entries ``n_distinct``.

    Taken in the tasks that encode the matrix, so that it isn't handed on.
    """
    joined = _encoded(docs, keep, text, shard_chars)

    def run(batches):
        for one, terms in _sparse(batches):
            indptr, counts, rows = (pc.list_flatten(one.column(c)) for c in ("indptr", "counts", "rows"))
            at, n = np.asarray(indptr, np.int64), np.asarray(counts, np.int64)
            # Entries that count, and their sums, between the rows' bounds.
            real = np.asarray(terms, np.int64) >= 0
            found, total = (np.concatenate([[0], np.cumsum(x)]) for x in (real & (n > 0), n * real))
            yield pa.RecordBatch.from_arrays([rows, pa.array(np.diff(total[at]), pa.int64()), pa.array(np.diff(found[at]), pa.int64())], ["row", "n_words", "n_distinct"])

    return joined.mapInArrow(run, f"row {joined.schema['rows'].dataType.elementType.simpleString()}, n_words long, n_distinct long")


@contextmanager
def batches_of(spark: SparkSession, size: int):
    """Jobs that are run inside hand rows to Python in batches of some ``size`` bytes: shards are long rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def failed_filters(docs: DataFrame) -> DataFrame:
    """``doc_id, part, content, failed``: bits of the filters A to D that a document fails, and a digest of its text; written."""
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return materialise(_failed(docs))


def _failed(docs: DataFrame) -> DataFrame:
    named = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text_of(), 256)).alias("content"), "text")
    counted = row_counts(named, ["doc_id", "part", "content"])
    fails = [F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words"), F.col("row._capitals"), F.col("row._signs")]
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return counted.select("row.doc_id", "row.part", "row.content", bits.alias("failed"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, good, toxic, n``: how many documents of a part fail exactly which filters, E included."""
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    # Written, so that the join is of plain exchanges, and an id of many rows can be split.
    known = materialise(labels.groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic")))
    rows = failed_filters(docs).groupBy("content", "doc_id", "part", "failed").agg(F.count("*").alias("n"))
    told = rows.join(known.hint("merge"), "doc_id", "left").fillna(False, ["good", "toxic"])
    own = ["content", "part", "failed", "good", "toxic"]
    has_id = F.col("doc_id").isNotNull()
    groups = told.groupBy(*own).agg(F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(has_id, 0).otherwise(F.col("n"))).alias("unnamed"))
    groups = groups.withColumn("lowest", F.min("least.doc_id").over(Window.partitionBy("content")))
    free = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("lowest"), F.col("least.n")).otherwise(0)
    copies = F.col("n") + F.col("unnamed") - free
    both = F.array(F.struct(F.col("failed"), free.alias("n")), F.struct((F.col("failed") + (1 << 4)).alias("failed"), copies.alias("n")))
    return groups.select("part", "good", "toxic", F.explode(both).alias("x")).filter("x.n > 0").groupBy("part", F.col("x.failed").alias("failed"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def in_every_order(counts: DataFrame) -> DataFrame:
    """The audit of every order of the filters from numbers of documents by what they fail."""
    n, failed = F.col("n"), F.col("failed")
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    steps = (f"{''.join(o)}:{k + 1}:{bits[o[k]]}:{sum(bits[x] for x in o[:k])}" for o in permutations(FILTERS) for k in range(len(o)))
    step = F.split(F.col("s"), ":")
    bit, before = step[2].cast("int"), step[3].cast("int")
    fails, alive = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(before) == 0
    of = lambda holds: F.sum(F.when(holds, n).otherwise(0)).cast("long")
    # Of the orders, as many remove a document by each of the filters that it fails.
    share = F.when(fails, n * (F.lit(120) / F.bit_count(failed)).cast("long")).otherwise(0)
    every = F.explode(F.split(F.lit(",".join(steps)), ",")).alias("s")
    return counts.select("part", "failed", "good", "toxic", "n", every).groupBy("part", step[0].alias("filter_order"), step[1].cast("int").alias("step")).agg(
        of(alive & ~fails).alias("kept"), of(alive & fails).alias("removed"), of(~alive & fails).alias("redundant"), of(failed == bit).alias("unique_fails"),
        of(alive & fails & F.col("good")).alias("good_lost"), of(alive & fails & F.col("toxic")).alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_every_order(failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
  f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CAST(len(w) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INTEGER) + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
      + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS m FROM d LEFT JOIN l USING (doc_id)),
  c AS (SELECT part, good, toxic, m, count(*) AS n FROM f GROUP BY ALL),
  o AS (SELECT a.n || b.n || c.n || d.n || e.n AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM {_LETTERS} a(n, b), {_LETTERS} b(n, b), {_LETTERS} c(n, b), {_LETTERS} d(n, b), {_LETTERS} e(n, b) WHERE a.b + b.b + c.b + d.b + e.b = 31 AND (a.b | b.b | c.b | d.b | e.b) = 31),
  s AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM o, range(1, 6) r(step)),
  x AS (SELECT part, filter_order, step, bit, sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
      sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN m & before = 0 AND m & bit <> 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN m & before = 0 AND m & bit <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM x"""
