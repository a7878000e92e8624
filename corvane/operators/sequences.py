"""Sequences against each other: edit scripts by longest common subsequence, word by word differences, changed stretches with context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.operators.ranking import runs
from corvane.scratch import materialise

SCRIPT = "pos int, kind string, old_no int, new_no int, value string"
#: A token of a line, which is white space, a word, or one other character; lines less alike aren't compared by word.
TOKEN = r"(?U)\s+|[\p{L}\p{N}_$]+|[^\s\p{L}\p{N}_$]"
LEAST_ALIKE = 0.35
_SPACE = r"(?U)\s+"


def _rows_below(a: np.ndarray, b: np.ndarray, top: int, bottom: int, last: np.ndarray) -> list[np.ndarray]:
    """Rows top .. bottom of the table of common lengths, of what follows each place in a and b, from the row at ``bottom``."""
    rows = [last]
    for r in range(bottom - 1, top - 1, -1):
        best = np.where(b == a[r], rows[-1][1:] + 1, rows[-1][:-1])
        rows.append(np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32))
    return rows[::-1]


def edit_script(old: list, new: list) -> Iterator[tuple]:
    """(kind, old place, new place, value) of every step from one list to the other; where both do, deletions come first.

    Time grows with the product of the sizes that differ, memory with the root of one times the other: of the table of common
    lengths only every so many rows are kept, and the rows between two of them are made again when the script gets there.
    """
    number = {v: k for k, v in enumerate(dict.fromkeys([*old, *new]))}
    a, b = np.array([number[v] for v in old], np.int64), np.array([number[v] for v in new], np.int64)
    stop = min(len(a), len(b))
    differ = np.flatnonzero(a[:stop] != b[:stop])
    head = int(differ[0]) if len(differ) else stop
    differ = np.flatnonzero(a[len(a) - stop + head :] != b[len(b) - stop + head :])
    tail = stop - head - 1 - int(differ[-1]) if len(differ) else stop - head
    yield from (("same", i, i, old[i]) for i in range(head))
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    n, step = len(left), max(1, int(len(left) ** 0.5))
    saved = {n: np.zeros(len(right) + 1, np.int32)}
    for top in range((n - 1) // step * step, -1, -step) if n else ():
        bottom = min(n, top + step)
        saved[top] = _rows_below(left, right, top, bottom, saved[bottom])[0]
    i = j = 0
    rows, top = [], 0
    while i < n and j < len(right):
        if i == top + len(rows) - 1 or not rows:
            top = i
            bottom = min(n, (top // step + 1) * step)
            rows = _rows_below(left, right, top, bottom, saved[bottom])
        if left[i] == right[j]:
            yield "same", head + i, head + j, old[head + i]
            i, j = i + 1, j + 1
        elif rows[i + 1 - top][j] >= rows[i - top][j + 1]:
            yield "del", head + i, None, old[head + i]
            i += 1
        else:
            yield "add", None, head + j, new[head + j]
            j += 1
    yield from (("del", head + k, None, old[head + k]) for k in range(i, n))
    yield from (("add", None, head + k, new[head + k]) for k in range(j, len(right)))
    yield from (("same", len(old) - k, len(new) - k, old[-k]) for k in range(tail, 0, -1))


def word_diffs(pairs: DataFrame, keys: dict[str, str], old: str, new: str, least: float = LEAST_ALIKE) -> DataFrame:
    """``keys, similarity, old_parts, new_parts`` of every row's two lines; parts are null for lines less alike than ``least``.

    A part is a stretch of text and whether it changed; changed stretches of white space alone count as unchanged. Lines are as
    alike as the share of their characters, white space left out, that both have in common; two lines without such characters
    are the same. Null lines are empty. ``keys`` must tell rows apart, and not be named as columns of scripts are: a shuffle by
    them brings the steps of a line together again.
    """
    tokens = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0))
    named = list(keys)
    steps = materialise(edit_scripts(pairs.select(*named, tokens(F.col(old)).alias("_a"), tokens(F.col(new)).alias("_b")), keys, "_a", "_b"))

    solid = F.length(F.regexp_replace("value", _SPACE, ""))
    weight = lambda kinds: F.sum(F.when(F.col("kind").isin(kinds), solid).otherwise(0))
    alike = steps.groupBy(*named).agg(weight(["same"]).alias("_both"), weight(["del", "add"]).alias("_one"))

    sides = F.explode(F.filter(F.array(*(F.struct(F.lit(s).alias("side"), (F.col("kind") != other).alias("on")) for s, other in (("old", "add"), ("new", "del")))), lambda x: x["on"])).alias("s")
    tokens_of = steps.select(*named, "pos", F.col("value").alias("text"), (F.col("kind") != "same").alias("changed"), sides).select(*named, "s.side", "pos", "text", "changed")
    stretches = _joined(tokens_of, [*named, "side"])
    real = F.col("changed") & (F.regexp_replace("text", _SPACE, "") != "")
    parts = _joined(stretches.withColumn("changed", real), [*named, "side"])
    of = lambda side: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "text", "changed")))), lambda p: F.struct(p["text"].alias("text"), p["changed"].alias("changed")))
    both = parts.groupBy(*named).agg(of("old").alias("_old"), of("new").alias("_new"))

    told = pairs.select(*named).join(alike, named, "left").join(both, named, "left")
    none = F.array().cast("array<struct<text:string,changed:boolean>>")
    total = 2 * F.col("_both") + F.col("_one")
    rated = told.withColumn("similarity", F.coalesce(F.when(total > 0, 2 * F.col("_both") / total), F.lit(1.0)))
    close = lambda c: F.when(F.col("similarity") >= least, F.coalesce(F.col(c), none))
    return rated.select(*named, "similarity", close("_old").alias("old_parts"), close("_new").alias("new_parts"))


def _joined(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbours that are both changed or both not, as one: ``keys, pos, text, changed``."""
    numbered = runs(tokens, keys, ["pos"], "changed")
    texts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return numbered.groupBy(*keys, "run", "changed").agg(F.min("pos").alias("pos"), F.array_join(texts, "").alias("text")).drop("run")


def replaced_lines(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, old_no, new_no, old, new``: of each stretch of deletions and the additions right after it, the k-th with the k-th.

    ``steps`` are edit scripts of lines. What a stretch has more than the other stays alone.
    """
    numbered = runs(steps.select(*keys, "pos", "kind", "old_no", "new_no", "value"), keys, ["pos"], "kind").filter("kind <> 'same'")
    placed = numbered.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "run").orderBy("pos")))
    gone = placed.filter("kind = 'del'").select(*keys, (F.col("run") + 1).alias("run"), "_nth", "old_no", F.col("value").alias("old"))
    come = placed.filter("kind = 'add'").select(*keys, "run", "_nth", "new_no", F.col("value").alias("new"))
    return gone.join(come, [*keys, "run", "_nth"]).select(*keys, "old_no", "new_no", "old", "new")


def edit_scripts(pairs: DataFrame, keys: dict[str, str], old: str, new: str) -> DataFrame:
    """One row per step between the string arrays ``old`` and ``new`` of every row; ``keys``: columns kept and their types.

    Null arrays are empty. Rows are compared one by one where they lie: no shuffle.
    """
    names = [*keys, *(c.split()[0] for c in SCRIPT.split(", "))]

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for *key, a, b in frame[[*keys, "_old", "_new"]].itertuples(index=False):
                steps = edit_script([] if a is None else list(a), [] if b is None else list(b))
                rows += [(*key, pos, *step) for pos, step in enumerate(steps)]
            yield pd.DataFrame(rows, columns=names).astype({"pos": "int32", "old_no": "Int32", "new_no": "Int32"})

    empty = F.array().cast("array<string>")
    rows = pairs.select(*keys, F.coalesce(old, empty).alias("_old"), F.coalesce(new, empty).alias("_new"))
    return rows.mapInPandas(run, ", ".join(f"{k} {t}" for k, t in keys.items()) + ", " + SCRIPT)


def hunks(rows: DataFrame, keys: list[str], pos: str, changed: Column, context: int = 3) -> DataFrame:
    """Changed rows with ``context`` places around them, joined where they touch: ``keys, hunk, first, last, changes``.

    Places are whole numbers from 1 in each key; ``last`` may lie ``context`` beyond the key's end.
    """
    order = Window.partitionBy(*keys).orderBy(pos)
    at = rows.filter(changed).select(*keys, F.col(pos).alias("_at"))
    fresh = F.coalesce(F.col("_at") - context > F.lag("_at").over(order.orderBy("_at")) + context + 1, F.lit(True))
    numbered = at.withColumn("_new", fresh.cast("long")).withColumn("hunk", F.sum("_new").over(order.orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)))
    ends = (F.greatest(F.lit(1), F.min("_at") - context).cast("long").alias("first"), (F.max("_at") + context).cast("long").alias("last"))
    return numbered.groupBy(*keys, "hunk").agg(*ends, F.count("*").alias("changes"))
