"""MinHash near-dedup (operator 9): ProbMinHash of weighted word shingles, banding, verification.

A document is its 5-word shingles, weighted by how often they occur. Two are near copies if their probability Jaccard,
sum over i of 1 / sum over j of max(v_j / v_i, w_j / w_i), is 0.8 or more (for texts without repeated shingles this is plain
Jaccard). Steps, each a Spark stage over all documents:

1. Exact copies: documents of equal text share one row from here on, under a number of its own; ids play no part until the
   end, so neither null ids nor ids with several texts join or lose anything. Signatures: each shingle is a
   Poisson process whose rate is its weight; an arrival falls into a random one of ``REGISTERS`` and a register keeps its
   first. Arrivals are drawn in rounds, shingles leaving once their next one is later than the latest register.
2. Bands of ``ROWS`` registers; texts that share a band with the least one there are joined into coarse clusters, by
   connected components. A band holds near copies with probability 1 - (1 - 0.8^4)^16 > 0.999 in all.
3. Each cluster is verified whole, so links within it don't depend on bands: small ones in one task, larger ones cut into
   blocks of bounded size and all pairs of blocks, each in a task. In a task, matrix products over the blocks' shingles give
   an upper bound for every pair, and pairs that may reach 0.8 and aren't connected yet are compared exactly. A task returns a
   spanning forest of its links, not the links.
4. Connected components of the forests are the classes.

Result: ``doc_id, class_id`` (the least id in the class, null if it has none) for every document. Cases: a null text is
empty; texts of under five words have no shingles and match equal texts only; rows alike in id stay rows, and their texts
are classed apart unless they are alike; very long texts are signed and compared whole; an empty table gives no rows; other
columns are kept or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.graph import connected_components

from .base import materialise, row_text, table, text_of
from .hashing import mix64, window_hashes, word_hashes
from .tokens import slices

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS, ROWS = 64, 4
#: A block of a cluster that needs several has about this many texts, and this many shingles, at most.
BLOCK_TEXTS, BLOCK_SHINGLES = 128, 1_000_000
#: Shingles in a matrix product at once.
COLUMNS = 1 << 15


def shingles(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes of each text, ascending, and how often each occurs."""
    words, at = word_hashes(texts)
    windows = window_hashes(words, SHINGLE)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a < SHINGLE:
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
        else:
            yield np.unique(windows[a : b - SHINGLE + 1], return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash: for each bag, the element that each register saw first (0 throughout for an empty bag)."""
    first = np.full(len(bags) * registers, np.inf)
    who = np.zeros(len(bags) * registers, np.uint64)
    sizes = np.array([len(h) for h, _ in bags])
    bag = np.repeat(np.arange(len(bags)), sizes)
    element = np.concatenate([h for h, _ in bags]) if len(bags) else np.zeros(0, np.uint64)
    rate = np.concatenate([c for _, c in bags]).astype(float) if len(bags) else np.zeros(0)
    time = np.zeros(len(element))
    stream = element
    while len(element):
        stream = mix64(stream + np.uint64(0x9E3779B97F4A7C15))
        uniform = ((stream >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
        time = time - np.log(uniform) / rate
        place = bag * registers + (mix64(stream) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, place, time)
        won = time == first[place]
        who[place[won]] = element[won]
        latest = first.reshape(-1, registers).max(axis=1)
        open_ = time < latest[bag]
        bag, element, rate, time, stream = bag[open_], element[open_], rate[open_], time[open_], stream[open_]
    return who.reshape(-1, registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two bags (ascending elements, weights): O(n log n) by sorting common elements by the ratio of their weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    v, w = a[1][i].astype(float), b[1][j].astype(float)
    order = np.argsort(v / w, kind="stable")
    v, w = v[order], w[order]
    only_a, only_b = a[1].sum() - v.sum(), b[1].sum() - w.sum()
    # sum_j max(v_j / v_i, w_j / w_i): where v_j / w_j is above v_i / w_i the first is larger, else the second.
    after = v.sum() - np.cumsum(v) + only_a
    upto = np.cumsum(w) + only_b
    return float(np.sum(1.0 / (after / v + upto / w)))


def reaches(left: list, right: list, least: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of bags whose probability Jaccard may reach ``least``.

    It is at most the share of a's weight on common elements, and of b's: two matrix products, over slices of the elements.
    """
    every = np.unique(np.concatenate([h for h, _ in left] + [h for h, _ in right]))
    of_a, of_b = np.zeros((len(left), len(right)), np.float32), np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, len(every), COLUMNS):
        part = every[begin : begin + COLUMNS]
        sides = []
        for bags in (left, right):
            has, share = np.zeros((len(bags), len(part)), np.float32), np.zeros((len(bags), len(part)), np.float32)
            for r, (h, c) in enumerate(bags):
                lo, hi = np.searchsorted(h, part[0]), np.searchsorted(h, part[-1], "right")
                at = np.searchsorted(part, h[lo:hi])
                has[r, at] = 1
                share[r, at] = c[lo:hi] / c.sum()
            sides.append((has, share))
        (has_a, share_a), (has_b, share_b) = sides
        of_a += share_a @ has_b.T
        of_b += has_a @ share_b.T
    return zip(*(x.tolist() for x in np.nonzero(np.minimum(of_a, of_b) >= least - 1e-4)), strict=True)


def forest(ids: list[int], bags: list, split: int, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that connect what similarity connects: among all bags if ``split`` is 0, else between those before and after it."""
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    step = BLOCK_TEXTS
    left = range(0, split or len(ids), step)
    for a in left:
        for b in range(split if split else a, len(ids), step):
            rows, columns = bags[a : min(a + step, split or len(ids))], bags[b : b + step]
            for i, j in reaches(rows, columns, least):
                x, y = a + i, b + j
                if x < y and find(x) != find(y) and probability_jaccard(bags[x], bags[y]) >= least - 1e-12:
                    root[find(x)] = find(y)
                    links.append((ids[x], ids[y]))
    return links


def sign(docs: DataFrame) -> DataFrame:
    """``doc_id, content`` (a hash of the whole text), ``n_shingles``, and ``bands``: a hash for each, none without shingles."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.string()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2_000_000):
            bags = list(shingles(batch.column("text")))
            who = signatures(bags)
            bands = window_hashes_by_rows(who)
            listed = [b.tolist() if len(h) else [] for b, (h, _) in zip(bands, bags, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("content"), pa.array([len(h) for h, _ in bags], pa.int64()), pa.array(listed, pa.list_(pa.int64()))], schema=schema)

    return docs.select("doc_id", F.md5(text_of()).alias("content"), text_of().alias("text")).mapInArrow(run, "doc_id long, content string, n_shingles long, bands array<long>")


def window_hashes_by_rows(who: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One signed 64-bit hash for each band of a signature; bands differ in their number too."""
    n = who.shape[1] // rows
    out = np.zeros((len(who), n), np.uint64) + np.arange(1, n + 1, dtype=np.uint64)
    for r in range(rows):
        out = mix64(out * np.uint64(0xD6E8FEB86659FD93) + who[:, r::rows])
    return out.view(np.int64)


def clusters(texts: DataFrame) -> DataFrame:
    """``id, cluster``: texts connected by shared bands, from ``id, bands``."""
    banded = texts.select("id", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("band", "least")
    edges = banded.join(least, "band").filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    return connected_components(edges).withColumnRenamed("component", "cluster")


def links(docs: DataFrame, members: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Links ``a, b`` that connect each cluster's near copies; ``members``: ``id, content, cluster, n_shingles`` of distinct texts."""
    members = materialise(members)
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("m"))
    blocks = F.greatest(F.when(F.col("n") <= 2 * BLOCK_TEXTS, 1).otherwise(F.ceil(F.col("n") / BLOCK_TEXTS)), F.when(F.col("m") <= 2 * BLOCK_SHINGLES, 1).otherwise(F.ceil(F.col("m") / BLOCK_SHINGLES)))
    placed = members.join(sizes.select("cluster", blocks.cast("int").alias("blocks")), "cluster")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(9)), "blocks").cast("int"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "cluster", "block", "blocks"]
        for batch in slices(batches, "text", 2_000_000):
            bags = list(shingles(batch.column("text")))
            columns = [pa.array([x.astype(kind).tobytes() for x in col], pa.binary()) for col, kind in ((tuple(h for h, _ in bags), "<u8"), (tuple(c for _, c in bags), "<u4"))]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + columns, names=[*names, "hashes", "counts"])

    # Copies collapse before they are shuffled, and the join finds the texts dealt by content already.
    texts = docs.select(F.md5(text_of()).alias("content"), text_of().alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    # Members grow with the corpus, so they are never broadcast: the plan is one and the same at every size.
    bags = texts.join(placed.hint("merge"), "content").select("id", "cluster", "block", "blocks", "text").mapInArrow(cut, "id long, cluster long, block int, blocks int, hashes binary, counts binary")
    # Block x of a cluster takes part in the tasks (x, y) and (y, x) for every y; the task of a pair is (less, more).
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = bags.select("*", other).select("id", "cluster", "block", "hashes", "counts", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def verify(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, low, high = key
        frame = frame.sort_values(["block", "id"], kind="stable")
        bags = [(np.frombuffer(h, "<u8"), np.frombuffer(c, "<u4").astype(np.int64)) for h, c in zip(frame["hashes"], frame["counts"], strict=True)]
        split = int((frame["block"] == low).sum()) if low != high else 0
        if low != high and split in (0, len(bags)):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        found = forest(frame["id"].tolist(), bags, split, least)
        return pd.DataFrame({"a": pd.Series([a for a, _ in found], dtype="int64"), "b": pd.Series([b for _, b in found], dtype="int64")})

    return tasks.groupBy("cluster", "low", "high").applyInPandas(verify, "a long, b long")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, content, component, class_id`` of every document; a class is a component, whatever ids its rows have."""
    signed = materialise(sign(docs))
    texts = signed.groupBy("content").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    # Written once, so that each content keeps its number.
    texts = materialise(texts.withColumn("id", F.monotonically_increasing_id()))
    members = clusters(texts.select("id", "bands").filter(F.size("bands") > 0)).join(texts.select("id", "content", "n_shingles"), "id")
    classes = connected_components(links(docs, members, least))
    named = materialise(texts.select("content", "id", "least_id").join(classes, "id", "left").select("content", "least_id", F.coalesce("component", "id").alias("component")))
    ids = named.groupBy("component").agg(F.min("least_id").alias("class_id"))
    return signed.select("doc_id", "content").join(named.join(ids, "component").select("content", "component", "class_id"), "content")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without near copies: of each class one row, the first by id (null last), then by text, then by the row as text."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "content")).alias("f")
    least = near_duplicates(docs).groupBy("component").agg(first).select(F.col("f.id").alias("_id"), F.col("f.content").alias("_content"))
    # A row's own columns travel in one struct, so none of their names can clash.
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_doc"), F.md5(text_of()).alias("_text"))
    # Ids take part in the join, so that the copies of a text are dealt out.
    kept = rows.join(least, (F.col("_text") == F.col("_content")) & F.col("_doc").eqNullSafe(F.col("_id"))).select("_row", "_text")
    return kept.groupBy("_text").agg(F.min_by("_row", row_text()).alias("_row")).select("_row.*")
