"""Alike texts among many: bigrams are counted and ranked in packed lists, so that few of them become rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.scratch import RELEASE, discard, materialise, settings

#: Words in a chunk of texts, parts at least that tokens are dealt to, texts compared in one group, bytes of a batch for Python.
CHUNK, PARTS, GROUP, ARROW_BYTES = 1 << 20, 256, 256, 8 << 20

_PACKED = "chunk long, part int, low binary, owner binary, f binary, ids array<binary>, sizes binary"
_PREFIX = "t long, before long, id binary, n int, place int"


#: What Spark's xxhash64 makes of an empty word.
EMPTY = np.uint64(-7444071767201028348 & (1 << 64) - 1)


def word_hashes(text: str) -> Column:
    """64-bit hashes of a text's words between single spaces, empty ones included."""
    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), " "), lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def tokens(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``owner, token``, by owner: each text's word bigrams as a set, of each its first occurrence, its second and so on.

    ``words`` has the hashes of all texts' words, ``sizes`` how many are each text's. A single word stands for itself.
    """
    of = np.repeat(np.arange(len(sizes)), sizes)
    single, last = sizes[of] == 1, np.append(of[1:] != of[:-1], True)[: len(of)]
    gram = np.where(single, _mix(~words), _mix(_mix(words) * np.uint64(0x9E3779B97F4A7C15) + np.append(words[1:], words[:1])))
    kept = single | ~last
    gram, owner = gram[kept], of[kept]
    _sort_by(gram, np.where(sizes == 1, 1, np.maximum(sizes - 1, 0)))
    first = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1]))[: len(gram)])
    nth = np.arange(len(gram)) - np.repeat(first, np.diff(np.append(first, len(gram))))
    return owner, _mix(gram + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sort_by(values: np.ndarray, sizes: np.ndarray) -> None:
    """Each owner's stretch of values in order, in place; much faster than one sort by two keys."""
    for part in np.split(values, np.cumsum(sizes)[:-1]):
        part.sort()


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all rows' words without the empty ones, and how many are each row's."""
    words, sizes = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), column.value_lengths().to_numpy(zero_copy_only=False)
    kept = words != EMPTY
    return words[kept], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about ``most`` words, and few enough rows that two bytes number them."""
    turn = np.cumsum(sizes) // most
    cuts = np.flatnonzero((turn[1:] != turn[:-1]) | (np.arange(1, len(sizes)) % 60_000 == 0)) + 1
    yield from zip([0, *cuts], [*cuts, len(sizes)], strict=True)


def _packed(parts: int, chunk_words: int):
    """Chunks of texts as a row for each part of the tokens' values; ids and sizes go with the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            words, sizes = _lists(batch.column("words"))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for i, j in _slices(sizes, chunk_words) if len(sizes) else ():
                owner, token = tokens(words[ends[i] : ends[j]], sizes[i:j])
                if not len(token):
                    continue
                part = ((token >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16)
                order = np.argsort(part, kind="stable")
                low, owner, part = token[order].astype(np.uint32), owner[order].astype(np.uint16), part[order]
                at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                to, n = [*at[1:], len(part)], len(at)
                cut = lambda x: [x[p:q].tobytes() for p, q in zip(at, to, strict=True)]  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [chunk] * n, "part": part[at].astype(np.int32), "low": cut(low), "owner": [_shorter(x) for x in cut(owner)], "f": [None] * n,
                     "ids": [batch.column("id")[i:j].to_pylist(), *[None] * (n - 1)], "sizes": [np.bincount(owner, minlength=j - i).astype(np.int32).tobytes(), *[None] * (n - 1)]},
                    schema=_arrow_packed(),
                )
                chunk += 1

    return run


def _arrow_packed() -> pa.Schema:
    b = pa.binary()
    return pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("low", b), ("owner", b), ("f", b), ("ids", pa.list_(b)), ("sizes", b)])


def _shorter(numbers: bytes) -> bytes:
    """Compressed: two-byte numbers of texts rise, and counts are mostly small. Tokens are as good as random and stay as they are."""
    return pa.compress(numbers, codec="zstd", asbytes=True) if numbers else b""


def _whole(blob: bytes, size: int) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _numbers(blobs: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All blobs' numbers, and where each blob begins and the last ends."""
    return np.frombuffer(b"".join(blobs), kind), np.cumsum([0, *(len(b) // np.dtype(kind).itemsize for b in blobs)])


def _counted(table: pa.Table) -> pa.Table:
    """One part of all chunks: tokens that occur once are dropped, the others get a byte for how often they do.

    The byte grows with the count; it only ranks tokens, and whatever ranks them alike in all texts is right.
    """
    rows = table.to_pylist()
    low, at = _numbers([r["low"] for r in rows], np.uint32)
    ordered = np.sort((low.astype(np.uint64) << np.uint64(32)) | np.arange(len(low), dtype=np.uint64))
    order, value = (ordered & np.uint64(0xFFFFFFFF)).astype(np.int64), ordered >> np.uint64(32)
    first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    often = np.diff(np.append(first, len(low)))
    f = np.empty(len(low), np.int64)
    f[order] = np.repeat(often, often)
    code = np.where(f < 128, f, np.minimum(127 + 8 * np.log2(np.maximum(f, 128) / 127), 255)).astype(np.uint8)
    out = []
    for r, i, j in zip(rows, at[:-1], at[1:], strict=True):
        kept = f[i:j] > 1
        if kept.any() or r["ids"] is not None:
            owner = np.frombuffer(_whole(r["owner"], 2 * (j - i)), np.uint16)
            out.append(r | {"low": low[i:j][kept].tobytes(), "owner": _shorter(owner[kept].tobytes()), "f": _shorter(code[i:j][kept].tobytes())})
    return pa.Table.from_pylist(out, schema=_arrow_packed())


def _prefixes(share: float):
    """One chunk with all its parts: of each text's n tokens, rarest first, those of the first n - ceil(n * share) + 1 that occur elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        whole = next(r for r in rows if r["ids"] is not None)
        n = np.frombuffer(whole["sizes"], np.int32).astype(np.int64)
        low, at = _numbers([r["low"] for r in rows], np.uint32)
        of = [len(r["low"]) // 4 for r in rows]
        owner = _numbers([_whole(r["owner"], 2 * k) for r, k in zip(rows, of, strict=True)], np.uint16)[0]
        f = _numbers([_whole(r["f"], k) for r, k in zip(rows, of, strict=True)], np.uint8)[0]
        ranked = (f.astype(np.int64) << 48) | (np.repeat([r["part"] for r in rows], np.diff(at)).astype(np.int64) << 32) | low
        order = np.argsort(owner, kind="stable")
        ranked, owner = ranked[order], owner[order].astype(np.int64)
        known = np.bincount(owner, minlength=len(n))
        _sort_by(ranked, known)
        place = np.arange(len(ranked)) - (np.cumsum(known) - known)[owner] + (n - known)[owner]
        kept = place < (n - np.ceil(n * share - 1e-9) + 1)[owner]
        token = ranked & ((1 << 48) - 1)
        before = np.where(np.append(-1, owner[:-1])[: len(owner)] == owner, np.append(-1, token[:-1])[: len(owner)], -1)
        owner = owner[kept]
        return pa.table({"t": token[kept], "before": before[kept], "id": pa.array(whole["ids"], pa.binary()).take(owner), "n": n[owner].astype(np.int32), "place": place[kept].astype(np.int32)})

    return run


def _common(pairs: pa.Table, texts: pa.Table) -> pa.Table:
    """``a, b, m, n``: of two texts the tokens in common, and those of both together; a group's texts are numbered once each."""
    words, sizes = _lists(texts["words"].combine_chunks())
    owner, token = tokens(words, sizes)
    n = np.bincount(owner, minlength=len(sizes))
    at, number = np.cumsum(n) - n, {k: i for i, k in enumerate(texts["id"].to_pylist())}
    ends = np.array([[number[a], number[b]] for a, b in zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True)])
    both, m = n[ends].sum(axis=1), []
    for i, j in _slices(both, CHUNK):
        side = ends[i:j].ravel()
        end = np.cumsum(n[side])
        met, of = token[np.repeat(at[side] - end + n[side], n[side]) + np.arange(end[-1])], np.repeat(np.arange(j - i), both[i:j])
        _sort_by(met, both[i:j])
        m.append(np.bincount(of[1:][(met[1:] == met[:-1]) & (of[1:] == of[:-1])], minlength=j - i))
    return pa.table({"a": pairs["a"], "b": pairs["b"], "m": np.concatenate(m).astype(np.int64), "n": both.astype(np.int64)})


def _groups(met: DataFrame, size: int) -> DataFrame:
    """``g, x, y, a, b``, written: pairs in groups of some ``size`` texts, such that a text is in few of them.

    A pair goes where the least text alike with its ``a`` does, so a cluster of which each is alike with each stays together.
    Where more than ``size`` texts go to one, they are dealt to blocks, and each pair of blocks is a group.
    """
    one, other = F.col("a").alias("id"), F.col("b").alias("with")
    edges = met.select(one, other).union(met.select(F.col("b"), F.col("a")))
    least = edges.groupBy("id").agg(F.min("with").alias("with")).select(F.col("id").alias("a"), F.least("id", "with").alias("lead"))
    least = materialise(least)  # joins of written tables, so that a hot key can be split
    led = materialise(met.join(least, "a"))
    members = led.select("lead", "a").union(led.select("lead", "b")).distinct()
    blocks = materialise(members.groupBy("lead").agg(F.ceil(F.count("*") / size).alias("blocks")))
    groups = max(1, led.select("a").union(led.select("b")).distinct().count() // size)
    block = lambda k: F.pmod(F.xxhash64(k), F.col("blocks"))
    dealt = led.join(blocks, "lead").select(F.pmod(F.xxhash64("lead"), F.lit(groups)).alias("g"), block("a").alias("_x"), block("b").alias("_y"), "a", "b")
    out = materialise(dealt.select("g", F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"), "a", "b"))
    for done in (least, led, blocks):
        discard(done)
    return out


def rare_tokens(texts: DataFrame, key: str, text: str, share: float, parts: int | None = None, chunk_words: int = CHUNK) -> DataFrame:
    """``t, before, id, n, place``: for each text its rarest tokens, as ``_prefixes`` has them, each with the one before it.

    Texts are read in chunks. A chunk's tokens are dealt to parts by their values in packed lists, four bytes a token and two
    for its text at most, and come back with their counts where they occur more than once; texts that repeat count as often,
    and their rows repeat. Tokens that fall on one number only add meetings.
    """
    parts = parts or min(max(PARTS, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1 << 16)
    hashed = texts.select(F.col(key).alias("id"), word_hashes(text).alias("words"))
    counted = hashed.mapInArrow(_packed(parts, chunk_words), _PACKED).groupBy("part").applyInArrow(_counted, _PACKED)
    return counted.groupBy("chunk").applyInArrow(_prefixes(share), _PREFIX)


def alike_texts(texts: DataFrame, key: str, text: str, least: float, parts: int | None = None, chunk_words: int = CHUNK, group: int = GROUP) -> DataFrame:
    """``a, b, m, n``, written: pairs a < b of keys whose texts' bigrams have a Dice similarity 2 * m / n of ``least`` or more.

    A text has one key, which may occur in many rows. Two sets that reach the bound share one of each one's first
    size - ceil(size * p) + 1 tokens in any order that both follow, p = least / (2 - least): here the rarest first. On the first
    that they share, what follows must suffice to reach the bound; pairs of which none does so are dropped. Where two texts
    share the token before as well, they have met there already. Pairs left are compared by their words, in groups to which
    each text goes once. Shuffled files go with each written table.
    """
    needed = least * (F.col("n1") + F.col("n2")) - 1e-6
    most = 1 + F.least(F.col("n1") - 1 - F.col("p1"), F.col("n2") - 1 - F.col("p2"))
    with settings(texts.sparkSession, RELEASE | {"spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES)}):
        each = materialise(rare_tokens(texts, key, text, least / (2 - least), parts, chunk_words))
        rare = materialise(each.distinct())
        discard(each)
        side = lambda end, i: rare.select("t", F.col("before").alias(f"_{i}"), F.col("id").alias(end), F.col("n").alias(f"n{i}"), F.col("place").alias(f"p{i}"))
        anew = (F.col("_1") != F.col("_2")) | (F.col("_1") == -1)
        met = materialise(side("a", 1).join(side("b", 2), "t").filter(F.col("a") < F.col("b")).filter(anew & (2 * most >= needed)).select("a", "b").distinct())
        pairs = _groups(met, group)
        keys = [F.col(k).alias(f"_{k}") for k in "gxy"]
        members = pairs.select(*keys, F.col("a").alias("id")).union(pairs.select(*keys, F.col("b"))).distinct()
        wanted = members.select(F.col("id").alias(key)).distinct()
        words = texts.select(key, text).join(wanted.hint("merge"), key, "left_semi").dropDuplicates([key]).select(F.col(key).alias("id"), word_hashes(text).alias("words"))
        compared = pairs.groupBy("g", "x", "y").cogroup(members.join(words, "id").groupBy("_g", "_x", "_y")).applyInArrow(_common, "a binary, b binary, m long, n long")
        out = materialise(compared.filter(2 * F.col("m") / F.col("n") >= least))
        for done in (rare, met, pairs):
            discard(done)
        return out
