"""Exact top-k search (operator 6): norm-sorted inner products with rotated partial sums and Cauchy-Schwarz bounds.

Vectors become whole numbers floor(256 x). Candidates are range partitioned by descending length (ties by id, so equal
vectors spread) and cut into blocks; blocks fall into at most ``LEVELS`` levels of length, and each level into runs of about
``RUN_BLOCKS`` blocks. Blocks of queries first meet the block of the longest vectors: from then on each query has a threshold,
its k-th best score so far, and a query block is dealt only the levels whose length times a query's own can reach it. Each
query block and run is one task's group, so that its memory is bounded however many vectors there are. Inside, blocks come
longest first; one whose length can't reach any threshold ends the run; else vectors rotated by the corpus's singular vectors
give partial sums over the leading dimensions, and a pair survives only if its partial sum plus the product of the residual
lengths reaches the threshold. Survivors are computed exactly in whole numbers, runs' results merged by k rows a run and query.

The rotation comes from sums of products of components over all vectors, d x d numbers however many vectors there are; it
only prunes, with a margin for rounding, so results don't depend on it. Vectors of one length leave nothing to prune by
levels: each query block then reads all candidates.

Cases: vectors that are null, empty or hold null or non-finite components take no part; shorter vectors are as if filled up
with zeros; ties go to the smaller id; ids may repeat, each row is a query or candidate by itself and a query never meets its
own row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import materialise, table

TOP, STEP = 5, 256
BLOCK, QUERY_BLOCK = 2048, 4096
#: Levels of length, blocks in a run, and candidates that meet a block of queries at once.
LEVELS, RUN_BLOCKS, AT_ONCE = 64, 32, 512
#: Shares of the dimensions after which partial sums are tested.
STAGES = (0.25, 0.5)
BLOCKS = pa.schema([("longest", pa.float64()), ("rows", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary()), ("data", pa.binary())])
SHAPE = "longest double, rows int, ids binary, numbers binary, data binary"


def quantise(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, _query, v`` (array of whole numbers) of the rows that take part."""
    x = F.col(column)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return rows.filter(good).select("vec_id", F.coalesce("_query", F.lit(False)).alias("_query"), F.transform(x, lambda c: F.floor(STEP * c.cast("double")).cast("long")).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lists = column.to_pylist() if len(set(pc.list_value_length(column).to_pylist())) > 1 else None
    if lists is None:
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return np.pad(flat, ((0, 0), (0, width - flat.shape[1])))
    return np.array([v + [0] * (width - len(v)) for v in lists], np.int64)


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Singular vectors of all rows as columns, by falling singular value, from sums of products added up in Spark."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("v"), width).astype(float)
                total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "s"])

    cells = vectors.select("v").mapInArrow(sums, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toPandas()
    gram = np.zeros(width * width)
    gram[cells["cell"].to_numpy()] = cells["s"].to_numpy()
    _, axes = np.linalg.eigh(gram.reshape(width, width))
    return np.ascontiguousarray(axes[:, ::-1])


def _pack(size: int, width: int) -> Callable:
    """Arrow function: consecutive rows as blocks: ids, rows' numbers and components as bytes, and the greatest length."""

    def block(ids: np.ndarray, numbers: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        norm = np.sqrt((m.astype(float) ** 2).sum(axis=1))
        return pa.RecordBatch.from_pylist([{"longest": float(norm.max()), "rows": len(ids), "ids": ids.tobytes(), "numbers": numbers.tobytes(), "data": m.astype("<i8" if np.abs(m).max() >= 2**15 else "<i2").tobytes()}], schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, m = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = np.concatenate((ids, batch.column("vec_id").to_numpy()))
            numbers = np.concatenate((numbers, batch.column("number").to_numpy()))
            m = np.concatenate((m, _matrix(batch.column("v"), width)))
            while len(ids) >= size:
                yield block(ids[:size], numbers[:size], m[:size])
                ids, numbers, m = ids[size:], numbers[size:], m[size:]
        if len(ids):
            yield block(ids, numbers, m)

    return run


def _unpack(row: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row["rows"]
    kind = "<i2" if len(row["data"]) == 2 * n * width else "<i8"
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["numbers"], np.int64), np.frombuffer(row["data"], kind).reshape(n, width).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows: by floating point where no partial sum can pass 2^53."""
    if not (len(a) and len(b)):
        return np.zeros((len(a), len(b)), np.int64)
    limit = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if limit < 2**53 else a @ b.T


class Searcher:
    """A block of queries on its way through candidate blocks; ``least`` has scores that a query has five of already."""

    def __init__(self, numbers: np.ndarray, vectors: np.ndarray, axes: np.ndarray, top: int, least: np.ndarray | None = None):
        self.numbers, self.vectors, self.axes, self.top = numbers, vectors, axes, top
        self.turned = vectors.astype(float) @ axes
        self.norm = np.sqrt((self.turned**2).sum(axis=1))
        self.best = np.full(len(numbers), -np.inf) if least is None else least.copy()
        self.query, self.other, self.row, self.score = (np.zeros(0, np.int64) for _ in range(4))
        self.cuts = sorted({max(1, int(axes.shape[0] * s)) for s in STAGES} - {axes.shape[0]})

    def reach(self) -> float:
        """The least length of a vector that can still count for any of the queries."""
        if np.isinf(self.best).any() or (self.norm == 0).any():
            return -np.inf
        return float(((self.best - 1e-9) / (self.norm * (1 + 1e-9))).min())

    def _survivors(self, live: np.ndarray, turned: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = 1e-9 * (1 + self.norm[live].max() * norm.max())
        alive = None
        partial, begin = np.zeros((len(live), len(norm))), 0
        for cut in self.cuts:
            partial += self.turned[live, begin:cut] @ turned[:, begin:cut].T
            rest_q = np.sqrt((self.turned[live, cut:] ** 2).sum(axis=1))
            rest_c = np.sqrt((turned[:, cut:] ** 2).sum(axis=1))
            alive = partial + rest_q[:, None] * rest_c + margin >= self.best[live][:, None]
            begin = cut
            if alive.mean() < 0.02:
                break
        return np.nonzero(alive)

    def meet(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray, longest: float) -> bool:
        """Take in a block whose vectors aren't longer than ``longest``; whether later, shorter ones can still count."""
        if not (self.norm * longest * (1 + 1e-9) + 1e-9 >= self.best).any():
            return False
        for k in range(0, len(ids), AT_ONCE):
            self._part(ids[k : k + AT_ONCE], numbers[k : k + AT_ONCE], vectors[k : k + AT_ONCE])
        return True

    def _part(self, ids: np.ndarray, numbers: np.ndarray, vectors: np.ndarray) -> None:
        turned = vectors.astype(float) @ self.axes
        norm = np.sqrt((turned**2).sum(axis=1))
        live = np.flatnonzero(self.norm * norm.max() * (1 + 1e-9) + 1e-9 >= self.best)
        if not len(live):
            return
        if np.isinf(self.best[live]).any() or not self.cuts:
            q, c = np.nonzero(np.ones((len(live), len(ids)), bool))
            score = products(self.vectors[live], vectors).ravel()
        else:
            q, c = self._survivors(live, turned, norm)
            if len(q) > 0.3 * len(live) * len(ids):
                score = products(self.vectors[live], vectors)[q, c]
            else:
                score = np.concatenate([np.einsum("ij,ij->i", self.vectors[live[q[k : k + 65536]]], vectors[c[k : k + 65536]]) for k in range(0, len(q), 65536)] or [np.zeros(0, np.int64)])
        q = live[q]
        keep = (score >= self.best[q]) & (numbers[c] != self.numbers[q])
        query, other, row, score = (np.concatenate(x) for x in ((self.query, q[keep]), (self.other, ids[c[keep]]), (self.row, numbers[c[keep]]), (self.score, score[keep])))
        order = np.lexsort((row, other, -score, query))
        query, other, row, score = query[order], other[order], row[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        chosen = rank < self.top
        self.query, self.other, self.row, self.score = query[chosen], other[chosen], row[chosen], score[chosen]
        last = rank[chosen] == self.top - 1
        self.best[self.query[last]] = np.maximum(self.best[self.query[last]], self.score[last])


def levels_of(blocks: DataFrame) -> tuple[Column, Column, list[float], list[int]]:
    """The level of a block by its greatest length (0 the longest) and its run; each level's greatest length and first run.

    Quantiles of the blocks' lengths part the levels, so what comes to the driver is ``LEVELS`` numbers at most.
    """
    cuts = blocks.agg(F.percentile_approx("longest", [k / LEVELS for k in range(1, LEVELS)], 10_000)).first()[0] or []
    level = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c > F.col("longest"))) if cuts else F.lit(0)
    told = {r.level: r for r in blocks.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.max("longest").alias("most")).collect()}
    n = max(told, default=-1) + 1
    runs = [-(-told[k].n // RUN_BLOCKS) if k in told else 0 for k in range(n)]
    first = [sum(runs[:k]) for k in range(n + 1)]
    # Neighbours in order of length go to different runs of a level: blocks are numbered by partition (high bits) and place in it.
    turn = F.shiftright("block", 33) + F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    of = lambda values: F.element_at(F.array(*map(F.lit, values or [0])), level + 1)
    return level, of(first[:-1]) + F.pmod(turn, F.greatest(of(runs), F.lit(1))), [told[k].most if k in told else -np.inf for k in range(n)], first


def top_k(rows: DataFrame, is_query: Column, column: str = "embedding", top: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: the highest inner products of every query row against all other rows."""
    spark = rows.sparkSession
    vectors = materialise(quantise(rows.withColumn("_query", is_query), column).withColumn("number", F.monotonically_increasing_id()))
    width = vectors.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0]
    axes = rotation(vectors, width)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    length = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    by_length = vectors.withColumn("length", -length).repartitionByRange(n, "length", "vec_id", "number").sortWithinPartitions("length", "vec_id", "number")
    candidates = materialise(by_length.select("vec_id", "number", "v").mapInArrow(_pack(BLOCK, width), SHAPE).withColumn("block", F.monotonically_increasing_id()))
    _, run, most, first = levels_of(candidates)
    packed = vectors.filter("_query").select("vec_id", "number", "v").mapInArrow(_pack(QUERY_BLOCK, width), SHAPE).withColumn("query_block", F.monotonically_increasing_id())
    # The block of the longest vectors: one row of BLOCK vectors.
    longest = candidates.orderBy(F.desc("longest"), "block").limit(1).toPandas()

    def seed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Thresholds of a query block after the longest vectors, and how many runs it has to meet."""
        for frame in frames:
            for _, row in frame.iterrows():
                _, numbers, own = _unpack(row, width)
                searcher = Searcher(numbers, own, axes, top)
                for _, block in longest.iterrows():
                    searcher.meet(*_unpack(block, width), block["longest"])
                reach = searcher.reach()
                runs = max([first[k + 1] for k, m in enumerate(most) if m >= reach], default=0)
                yield pd.DataFrame([{**row.to_dict(), "least": searcher.best.tobytes(), "runs": runs}])

    queries = materialise(packed.mapInPandas(seed, f"{SHAPE}, query_block long, least binary, runs int"))
    met = queries.filter("runs > 0").withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)))
    left = met.select(F.col("query_block").alias("by"), F.col("run").alias("in_run")).join(candidates.withColumn("in_run", run.cast("int")), "in_run")

    def search(key: tuple, blocks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(own):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query", "query_id", "vec_id", "number", "score")})
        ids, numbers, data = _unpack(own.iloc[0], width)
        searcher = Searcher(numbers, data, axes, top, np.frombuffer(own.iloc[0]["least"]))
        for _, row in blocks.sort_values(["longest", "block"], ascending=[False, True]).iterrows():
            if not searcher.meet(*_unpack(row, width), row["longest"]):
                break
        return pd.DataFrame({"query": numbers[searcher.query], "query_id": ids[searcher.query], "vec_id": searcher.other, "number": searcher.row, "score": searcher.score})

    found = left.groupBy("by", "in_run").cogroup(met.groupBy("query_block", "run")).applyInPandas(search, "query long, query_id long, vec_id long, number long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, c.n AS m, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
           FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id, m) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
