"""Best-fit packing (operator 2): bin completion, branch and bound, inside groups of pieces.

A document's ids (with its end id) are cut into pieces of at most ``capacity`` tokens. Pieces are dealt to groups by a hash
that their number in the table takes part in, so that rows alike are dealt out too; so many that a group holds about ``GROUP_SEQUENCES`` sequences' worth of tokens and ``GROUP_ROWS`` rows at most on average;
each group is packed by one task, and wastes less than one sequence against its own bound.

In a group, best-fit decreasing gives the first incumbent. If it uses more sequences than total size allows, bin completion
searches for fewer: take the largest piece left, enumerate the undominated fillings of the room beside it (a filling is
dominated if another one's pieces can hold its pieces), fullest first, and cut a branch once its waste exceeds what one
sequence fewer than the incumbent would leave over. The search stops at the bound or after ``NODES`` nodes and then keeps its
best incumbent; it tries ``FAN_OUT`` fillings a node, of which it searches ``DEPTH`` pieces and fills the rest by best fit. So
groups above their bound need not be packed as well as can be: ``gap`` tells by how many sequences a group is above it.

Cases: null texts are empty, so their one piece is the end id; repeated ids are packed as separate documents; very long texts
are cut into as many pieces as they need; an empty table gives no rows; columns of other names are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, table, text_of
from .tokens import END_ID, crc32, encoder, slices, vocabulary_path

CAPACITY = 4096
GROUP_SEQUENCES = 512
GROUP_ROWS = 8192
NODES = 5000
#: Fillings tried at a node, and pieces in a filling that are chosen by search rather than by best fit.
FAN_OUT, DEPTH = 6, 3

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, gap int"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the document's id, the piece's number, its place in the document, length and crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(vocabulary).encode, np.array([END_ID], "<u4").tobytes(), capacity * 4
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for batch in slices(batches, "text"):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes where the least room is left; lists of sizes."""
    rooms: list[int] = []  # ascending
    bins: dict[int, list[list[int]]] = {}
    from bisect import bisect_left, insort

    for s in sorted(sizes, reverse=True):
        k = bisect_left(rooms, s)
        if k == len(rooms):
            content, room = [], capacity
        else:
            room = rooms.pop(k)
            content = bins[room].pop()
        content.append(s)
        insort(rooms, room - s)
        bins.setdefault(room - s, []).append(content)
    return [b for many in bins.values() for b in many]


def _holds(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b fit into the pieces of a as boxes (both descending)."""
    if not b:
        return True
    tried = set()
    for i, box in enumerate(a):
        if box >= b[0] and box not in tried:
            tried.add(box)
            rest = tuple(sorted((*a[:i], *a[i + 1 :], box - b[0]), reverse=True))
            if _holds(rest, b[1:]):
                return True
    return False


def fillings(sizes: list[int], counts: Counter, room: int, fan_out: int = FAN_OUT) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room`` from the pieces left (``sizes`` ascending, distinct), fullest first."""
    found: set[tuple[int, ...]] = set()

    def extend(chosen: tuple[int, ...], left: int, depth: int) -> None:
        k, tried = bisect_right(sizes, min(left, chosen[-1] if chosen else left)) - 1, 0
        while k >= 0 and tried < (fan_out if depth else 1):
            s = sizes[k]
            if counts[s] > chosen.count(s):
                tried += 1
                extend((*chosen, s), left - s, max(0, depth - 1))
                if s == left:  # nothing beats an exact fit by one piece
                    break
            k -= 1
        if not tried:
            found.add(chosen)

    extend((), room, DEPTH)
    kept: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (-sum(f), len(f), [-s for s in f])):
        if len(kept) == fan_out:
            break
        if not any(len(f) <= 6 and len(g) <= 6 and _holds(g, f) for g in kept):
            kept.append(f)
    return kept


def least_sequences(sizes: list[int], capacity: int = CAPACITY) -> int:
    """No packing has fewer: by their total, and by the pieces of which no two fit together."""
    return max(-(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))


def pack_sizes(sizes: list[int], capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Sizes by sequence, as few sequences as the search finds."""
    whole = [[s] for s in sizes if s == capacity]
    rest = [s for s in sizes if s < capacity]
    incumbent = best_fit(rest, capacity)
    total = sum(rest)
    bound = least_sequences(rest, capacity)
    if len(incumbent) > bound:
        counts = Counter(rest)
        ascending = sorted(counts)
        # One entry per open node: the fillings not tried yet, the pieces in use there, and the waste before it.
        path: list[tuple[list[tuple[int, ...]], tuple[int, ...], int]] = []
        waste, spent, left = 0, 0, len(rest)

        def take(content: tuple[int, ...], sign: int) -> None:
            for s in content:
                counts[s] -= sign

        def options() -> list[tuple[int, ...]]:
            while ascending and not counts[ascending[-1]]:
                ascending.pop()
            live = [s for s in ascending if counts[s]] if len(ascending) > 2 * sum(1 for s in ascending if counts[s]) else ascending
            big = live[-1]
            counts[big] -= 1
            out = [(big, *f) for f in fillings(live, counts, capacity - big)]
            counts[big] += 1
            return out[::-1]

        path.append((options(), (), 0))
        while path and spent < nodes + len(rest) and len(incumbent) > bound:
            todo, used, before = path[-1]
            if used:
                take(used, -1)
                left += len(used)
                for s in used:
                    if not ascending or s > ascending[-1]:
                        ascending = sorted(counts)
                        break
            if not todo:
                path.pop()
                continue
            content = todo.pop()
            spent += 1
            waste = before + capacity - sum(content)
            allowed = (len(incumbent) - 1) * capacity - total
            if waste > allowed:
                path[-1] = ([], (), before)
                continue
            take(content, 1)
            left -= len(content)
            path[-1] = (todo, content, before)
            if left:
                path.append((options(), (), waste))
            else:
                incumbent = [list(used) for _, used, _ in path]
    return whole + incumbent


def pack_group(frame: pd.DataFrame, capacity: int = CAPACITY) -> pd.DataFrame:
    """Give every piece of a group its sequence and place. Pieces of one size are taken in order of id and number."""
    frame = frame.sort_values(["length", "doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
    lengths = frame["length"].to_numpy()
    order = {int(s): iter(np.flatnonzero(lengths == s)) for s in np.unique(lengths)}
    sequence, offset = np.empty(len(frame), "int64"), np.empty(len(frame), "int64")
    first = int(frame["group_id"].iloc[0]) << 32
    packed = pack_sizes(lengths.tolist(), capacity)
    for k, content in enumerate(packed):
        at = 0
        for s in content:
            row = next(order[s])
            sequence[row], offset[row] = first + k, at
            at += s
    gap = len(packed) - least_sequences(lengths.tolist(), capacity)
    return frame.drop(columns="group_id").assign(sequence_id=sequence, offset=offset, gap=np.int32(gap))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Assign ``sequence_id`` and ``offset`` to rows with ``doc_id, piece, start, length, ids_crc32``."""
    rows = materialise(pieces)
    total, n = rows.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    groups = max(1, -(-total // (capacity * GROUP_SEQUENCES)), -(-n // GROUP_ROWS))
    dealt = rows.withColumn("group_id", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group_id").applyInPandas(lambda frame: pack_group(frame, capacity), PACKED)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), vocabulary_path()))
