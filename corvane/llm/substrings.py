"""Substring dedup (operator 10): passages of ``WINDOW`` words that occur elsewhere, found with FM-indexes of shards.

The least hash of 8-word anchors in a window is a function of the window's words alone, so equal windows have equal anchors;
consecutive windows with one anchor form a segment of some 50 words. Only anchors that occur twice can hold repeats.

1. Anchors are counted; segments of anchors that occur once go. What is left is small where the corpus repeats little.
2. Segments of equal content collapse into one, weighed by how often it occurs (2 stands for any more).
3. Segments are sharded by anchor. Each shard builds a compressed FM-index of all its distinct segments and streams them
   through it: backward search tells where the matching statistic, among occurrences of total weight 2 or more, reaches
   ``WINDOW``, and reports those stretches.
4. An anchor with over ``MOST_KINDS`` distinct segments (a line that many documents share, each time with other words around
   it) would fill a shard by itself. Its segments are parted again by longer anchors (``ANCHORS``), each part with the weight of
   its segment: words beside the line then take part in the anchor, so that parts spread over shards or occur once and go. The
   last anchor is the whole window, of which no anchor has two kinds; so no window is left out, and all go through an index.
5. Every document loses the words of its repeated windows.

Texts pass one shuffle whole, and those with candidates a second time. Joins on anchors and contents are of written tables, so
that Spark can split a hot one. Rows go to Python in batches of ``ARROW_BYTES``.
Result of ``drop_repeats``: ``doc_id, n_words, n_removed, kept_sha256, kept_text``. Cases: a
null text has no words; texts under ``WINDOW`` words lose nothing; rows alike in id and text are two documents and repeat each
other; very long texts are one row and a long list of stretches; an empty table gives no rows; other columns are ignored.
Words are compared as 64-bit hashes, windows thus by 35 of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, table, text_of
from .filter_audit import batches_of
from .fm_index import FMIndex, repeated_windows
from .hashing import _BASE, _tables, mix64, window_hashes, word_hashes
from .tokens import slices

WINDOW = 35
#: Words of an anchor, and of the longer ones by which segments of hot anchors are parted again.
ANCHORS = (8, 20, 30, WINDOW)
#: Distinct segments of one anchor that a shard takes, and of all its anchors on average.
MOST_KINDS, SHARD_SEGMENTS = 256, 1024
#: Bytes of text that a task takes at a time, and of the batches in which Spark hands it rows.
BATCH_BYTES, ARROW_BYTES = 500_000, 4_000_000
SEGMENT = "start:int,size:int,anchor:long,content:long,weight:int,hot:boolean"
STRETCHES = "anchor long, content long, start int, end int"
PARTS = "whole_anchor long, whole long, weight int, first int, anchor long, content long, words binary"


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every ``width`` values in a row, the leftmost of equal ones, by stretches of doubled length."""
    place, length = np.arange(len(values)), 1
    while length < width:
        step = min(length, width - length)
        right = values[step:] < values[:-step]
        place = np.where(right, place[step:], place[:-step])
        values = np.where(right, values[step:], values[:-step])
        length += step
    return place


def segments(words: np.ndarray, at: np.ndarray, window: int = WINDOW, anchor: int = ANCHORS[0]) -> tuple[np.ndarray, ...]:
    """From words' hashes and texts' first words: text number, first word in the text, size, anchor and content of segments."""
    hashes = window_hashes(words, anchor)
    n = len(words) - window + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    valid = np.arange(n) + window <= at[text + 1]
    place = least_places(hashes, window - anchor + 1)
    fresh = valid.copy()
    fresh[1:] &= ~(valid[:-1] & (place[1:] == place[:-1]) & (text[1:] == text[:-1]))
    first = np.flatnonzero(fresh)
    closes = valid.copy()
    closes[:-1] &= ~(valid[1:] & (place[1:] == place[:-1]) & (text[1:] == text[:-1]))
    end = np.flatnonzero(closes) + window
    up, down = _tables(len(words) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
    content = mix64((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64) * _BASE)
    return text[first], first - at[text[first]], end - first, hashes[place[first]].view(np.int64), content.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.xxhash64("doc_id", text_of()).alias("key"), "doc_id", text_of().alias("text"))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        _, _, _, anchor, _ = segments(*word_hashes(batch.column("text")))
        yield pa.RecordBatch.from_arrays([pa.array(anchor)], names=["anchor"])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        text, start, size, anchor, content = segments(*word_hashes(batch.column("text")))
        keys = np.asarray(batch.column("key"))[text]
        columns = (anchor, content, keys, start.astype(np.int32), size.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "key", "start", "size"])


def found_segments(docs: DataFrame) -> DataFrame:
    """``anchor, content, key, start, size`` of every segment whose anchor occurs twice or more. ``docs``: ``key, doc_id, text``."""
    anchors = docs.select("text").mapInArrow(_anchors, "anchor long").groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = materialise(anchors.select("anchor"))
    rows = docs.select("key", "text").mapInArrow(_segments, "anchor long, content long, key long, start int, size int")
    return materialise(rows.join(repeated.hint("merge"), "anchor"))


def kinds_of(found: DataFrame) -> tuple[DataFrame, int, int]:
    """One row for each distinct segment, with its weight and a place of it; how many belong to usual and to hot anchors."""
    one = F.min(F.struct("key", "start", "size"))
    kinds = materialise(found.groupBy("anchor", "content").agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("weight"), one.alias("one")))
    hot = materialise(kinds.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_KINDS).withColumn("hot", F.lit(True)))
    n_hot = hot.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    told = kinds.join(hot.select("anchor", "hot").hint("merge"), "anchor", "left") if n_hot else kinds.withColumn("hot", F.lit(None).cast("boolean"))
    return told.select("anchor", "content", "weight", F.coalesce("hot", F.lit(False)).alias("hot"), "one.*"), kinds.count() - n_hot, n_hot


def _cut(text: bytes, covered: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Number of words, of words removed, and the words kept, joined by spaces; bytes.split() parts at the same white space."""
    words = text.split()
    if not covered:
        return len(words), 0, b" ".join(words)
    keep = np.ones(len(words), bool)
    for a, b in covered:
        keep[a:b] = False
    kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
    return len(words), len(words) - len(kept), b" ".join(kept)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _finish(with_text: bool):
    """Arrow function: texts and their covered stretches to results; ``covered`` is null where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            stretches = batch.column("covered").to_pylist()
            made = [_cut(t, [(x["start"], x["end"]) for x in s or ()]) for t, s in zip(texts, stretches, strict=True)]
            columns = [batch.column("doc_id"), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64()), pa.array([hashlib.sha256(m[2]).hexdigest() for m in made])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array([m[2].decode() for m in made], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _rows(columns: dict[str, tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in columns.values()], names=list(columns))


def _contents(hot: bool):
    """Arrow function: the words of the segments listed with a text, of hot anchors or of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            words, at = word_hashes(batch.column("text"))
            some = [(at[i] + s["start"], s) for i, listed in enumerate(batch.column("segments").to_pylist()) for s in listed if s["hot"] == hot]
            column = lambda name: [s[name] for _, s in some]
            yield _rows({"anchor": (column("anchor"), pa.int64()), "content": (column("content"), pa.int64()), "weight": (column("weight"), pa.int32()), "words": ([words[a : a + s["size"]].tobytes() for a, s in some], pa.binary())})

    return run


def _parts(anchor: int):
    """Arrow function: segments, given by their words, parted by longer anchors; ``first`` is a part's place in its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = [np.frombuffer(w, np.uint64) for w in batch.column("words").to_pylist()]
            if not pieces:
                continue
            words, at = np.concatenate(pieces), np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
            number, first, size, anchors, contents = segments(words, at, WINDOW, anchor)
            begin = at[number] + first
            whole = {name: (np.asarray(batch.column(old))[number], kind) for name, old, kind in (("whole_anchor", "anchor", pa.int64()), ("whole", "content", pa.int64()), ("weight", "weight", pa.int32()))}
            yield _rows(whole | {"first": (first, pa.int32()), "anchor": (anchors, pa.int64()), "content": (contents, pa.int64()), "words": ([words[a : a + n].tobytes() for a, n in zip(begin, size, strict=True)], pa.binary())})

    return run


def search_shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Index a shard's segments (``anchor, content, weight, words``), stream them through, and give the stretches found."""
    pieces = [np.frombuffer(w, np.uint64) for w in frame["words"]]
    sizes = np.array([len(p) for p in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    index = FMIndex(np.concatenate(pieces), ends, frame["weight"].to_numpy())
    found = repeated_windows(index, index.texts, begins, sizes, WINDOW)
    number = np.repeat(np.arange(len(sizes)), sizes)
    first, final = found.copy(), found.copy()
    first[1:] &= ~(found[:-1] & (number[1:] == number[:-1]))
    final[:-1] &= ~(found[1:] & (number[1:] == number[:-1]))
    a, b = np.flatnonzero(first), np.flatnonzero(final)
    text = number[a]
    return pd.DataFrame({"anchor": frame["anchor"].to_numpy()[text], "content": frame["content"].to_numpy()[text], "start": (a - begins[text]).astype("int32"), "end": (b - begins[text] + WINDOW).astype("int32")})


def search(kinds: DataFrame, n: int) -> DataFrame:
    """``anchor, content, start, end``: repeated stretches of n distinct segments, given with their words."""
    shards = max(1, -(-n // SHARD_SEGMENTS))
    return kinds.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(search_shard, STRETCHES)


def search_parts(parts: DataFrame, anchors: tuple[int, ...]) -> DataFrame:
    """As ``search``, for ``PARTS`` of segments of hot anchors: those of anchors still hot are parted again by ``anchors``."""
    parts = materialise(parts)
    alike = materialise(parts.groupBy("anchor", "content").agg(F.least(F.sum("weight"), F.lit(2)).cast("int").alias("weight"), F.first("words").alias("words")))
    live = alike.groupBy("anchor").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).filter("w > 1")
    live = materialise(live.select("anchor", "n", (F.col("n") > MOST_KINDS).alias("hot")))
    counts = {r.hot: r.n for r in live.groupBy("hot").agg(F.sum("n").alias("n")).collect()}
    told = alike.join(live.select("anchor", "hot").hint("merge"), "anchor").select("anchor", "content", "weight", "words", "hot")
    found = search(told.filter("NOT hot").drop("hot"), counts.get(False, 0))
    if counts.get(True):
        found = found.unionByName(search_parts(told.filter("hot").drop("hot").mapInArrow(_parts(anchors[0]), PARTS), anchors[1:]))
    back = parts.drop("words").join(found.hint("merge"), ["anchor", "content"])
    return back.select(F.col("whole_anchor").alias("anchor"), F.col("whole").alias("content"), (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))


def drop_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Every document without the words of repeated windows; written, so that batches are small in every job with Python."""
    with batches_of(docs.sparkSession, ARROW_BYTES):
        return _drop_repeats(docs, with_text)


def _drop_repeats(docs: DataFrame, with_text: bool) -> DataFrame:
    result = RESULT + (", kept_text string" if with_text else "")
    keyed = _keyed(docs)
    found = found_segments(keyed)
    kinds, n_usual, n_hot = kinds_of(found)
    # Every document with a segment waits; those that stand for a distinct segment also list it.
    listed = found.select("key").distinct().withColumn("s", F.lit(None).cast(f"struct<{SEGMENT}>")).unionByName(kinds.select("key", F.struct("start", "size", "anchor", "content", "weight", "hot").alias("s")))
    joined = keyed.join(listed.groupBy("key").agg(F.collect_list("s").alias("segments")).hint("merge"), "key", "left")
    state = f"key long, doc_id long, text string, segments array<struct<{SEGMENT}>>, " + RESULT.split(", ", 1)[1] + (", kept_text string" if with_text else "")
    finish = _finish(with_text)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without candidates are finished here; the others go on with their texts."""
        for batch in batches:
            waits = batch.column("segments").is_valid()
            done, rest = batch.filter(pc.invert(waits)), batch.filter(waits)
            for part in finish([pa.RecordBatch.from_arrays([done.column("doc_id"), done.column("text"), pa.nulls(done.num_rows, pa.null())], names=["doc_id", "text", "covered"])]):
                columns = {n: part.column(n) for n in part.schema.names}
                yield pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(part.num_rows, kinds[n])) for n in kinds], schema=pa.schema(kinds))
            if rest.num_rows:
                yield pa.RecordBatch.from_arrays([rest.column(n).cast(kinds[n]) if n in rest.schema.names else pa.nulls(rest.num_rows, kinds[n]) for n in kinds], schema=pa.schema(kinds))

    segment = pa.struct([("start", pa.int32()), ("size", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()), ("weight", pa.int32()), ("hot", pa.bool_())])
    kinds = {"key": pa.int64(), "doc_id": pa.int64(), "text": pa.string(), "segments": pa.list_(segment), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()} | ({"kept_text": pa.string()} if with_text else {})
    passed = materialise(joined.select("key", "doc_id", "text", "segments").mapInArrow(first_pass, state))
    waiting = passed.filter("segments IS NOT NULL")
    lists = lambda hot: waiting.filter(F.exists("segments", lambda s: s["hot"] == hot)).select("text", "segments")
    stretches = search(lists(False).mapInArrow(_contents(False), "anchor long, content long, weight int, words binary"), n_usual)
    if n_hot:
        contents, part = _contents(True), _parts(ANCHORS[1])
        # One function, not one on the other: each would hold a worker of its own in every task.
        stretches = stretches.unionByName(search_parts(lists(True).mapInArrow(lambda batches: part(contents(batches)), PARTS), ANCHORS[2:]))
    placed = found.select("anchor", "content", "key", F.col("start").alias("at")).join(stretches.hint("merge"), ["anchor", "content"])
    covered = placed.groupBy("key").agg(F.collect_set(F.struct((F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"))).alias("covered"))
    last = waiting.select("key", "doc_id", "text").join(covered.hint("merge"), "key", "left").select("doc_id", "text", "covered")
    names = [c.split()[0] for c in result.split(", ")]
    return passed.filter("segments IS NULL").select(*names).unionByName(materialise(last.mapInArrow(finish, result)))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
     s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
     g AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM s),
     r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM g) WHERE n > 1),
     c AS (SELECT DISTINCT doc_id, i + j AS i FROM r, range(0, 35) t(j)),
     k AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id),
     m AS (SELECT w.doc_id, words, coalesce(gone, []) AS gone FROM w LEFT JOIN k USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(words, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM m
"""
