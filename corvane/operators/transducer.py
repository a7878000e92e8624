"""Texts through finite machines, without Python: maps of states for each chunk, composed over a text; counters that stop at zero."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.scratch import materialise

#: Characters of a chunk, and chunks of a block; both only deal out work, results don't depend on them.
CHUNK, BLOCK = 1024, 256


@dataclass(frozen=True)
class Machine:
    """States by one character each, the first of which a text starts in.

    ``steps`` has, for each character that matters, what the states become, in the order of ``states``; ``other`` has that for
    all other characters. Two others in a row must do what one does, so that a run of them is one step.
    """

    states: str
    steps: dict[str, str]
    other: str

    def __post_init__(self):
        maps = [*self.steps.values(), self.other]
        if len(set(self.states)) != len(self.states) or any(len(m) != len(self.states) or not set(m) <= set(self.states) for m in maps):
            raise ValueError("a step names one known state for each state")
        if any(len(c) != 1 for c in self.steps):
            raise ValueError("steps are of single characters")
        if self.other != self.other.translate(str.maketrans(self.states, self.other)):
            raise ValueError("other characters must do nothing more the second time")

    def tokens(self, text: Column) -> Column:
        """The characters that matter, one by one, and the runs between them."""
        named = "".join(re.escape(c) for c in self.steps)
        return F.regexp_extract_all(text, F.lit(f"(?s)[{named}]|[^{named}]+"), F.lit(0))

    def becomes(self, token: Column) -> Column:
        return self._named(token, self.steps)

    def whole(self, text: Column) -> Column:
        """The map of a text: that of its characters that matter, each with the run behind it, composed."""
        named = "".join(re.escape(c) for c in self.steps)
        parts = F.regexp_extract_all(text, F.lit(f"(?s)[{named}][^{named}]*|[^{named}]+"), F.lit(0))
        behind = {c: m.translate(str.maketrans(self.states, self.other)) for c, m in self.steps.items()}
        step = lambda t: F.when(F.length(t) == 1, self._named(t, self.steps)).otherwise(self._named(F.left(t, F.lit(1)), behind))
        return F.aggregate(parts, F.lit(self.states), lambda acc, t: self.composed(acc, step(t)))

    def _named(self, token: Column, steps: dict[str, str]) -> Column:
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for step in steps.items() for x in step)), token), F.lit(self.other))

    def after(self, state: Column, step: Column) -> Column:
        """The state after a step: what stands in the step at the place of the state."""
        return F.substring(step, F.instr(F.lit(self.states), state), F.lit(1))

    def composed(self, first: Column, then: Column) -> Column:
        """One map of states, a string like a step, after another."""
        return F.concat(*(self.after(F.substring(first, k + 1, 1), then) for k in range(len(self.states))))


def _starts(maps: DataFrame, machine: Machine) -> DataFrame:
    """``_row, _no, _start``: the state in front of every chunk, from ``_row, _no, _map``.

    Chunks compose to blocks, blocks are folded in order, and each block then deals its start to its chunks, so that one task
    holds a block's maps, or one row's blocks, which are a quarter of a million times fewer than its characters.
    """
    # The states before each item of a list of maps, as one string.
    before = lambda start, items: F.aggregate(items, start, lambda acc, m: F.concat(acc, machine.after(F.right(acc, F.lit(1)), m)))
    inside = F.transform(F.array_sort(F.collect_list(F.struct("_no", "_map"))), lambda x: x["_map"])
    blocks = maps.groupBy("_row", F.floor(F.col("_no") / BLOCK).cast("int").alias("_block")).agg(inside.alias("_maps"))
    blocks = blocks.withColumn("_whole", F.aggregate("_maps", F.lit(machine.states), machine.composed))
    order = F.array_sort(F.collect_list(F.struct("_block", "_whole")))
    rows = blocks.groupBy("_row").agg(order.alias("_b"))
    rows = rows.select("_row", "_b", before(F.lit(machine.states[0]), F.transform("_b", lambda x: x["_whole"])).alias("_s"))
    heads = rows.select("_row", F.posexplode("_b").alias("_k", "_x"), "_s").select("_row", F.col("_x._block").alias("_block"), F.substring("_s", F.col("_k") + 1, F.lit(1)).alias("_head"))
    each = blocks.join(heads, ["_row", "_block"]).select("_row", "_block", F.split(before(F.col("_head"), F.col("_maps")), "").alias("_s"), F.size("_maps").alias("_n"))
    dealt = each.select("_row", "_block", "_n", F.posexplode("_s").alias("_k", "_start")).filter("_k < _n")
    return dealt.select("_row", (F.col("_block") * BLOCK + F.col("_k")).alias("_no"), "_start")


def traces(rows: DataFrame, keys: list[str], text: str, machine: Machine, chunk: int = CHUNK) -> DataFrame:
    """``keys, _row, _no, tokens, states``: the tokens of every chunk of a text and the states around them, one more than tokens.

    Null and empty texts have one chunk without tokens. Rows are numbered, so null or repeated keys do no harm. Chunks are written
    with their maps, of which the starts are read without the texts; texts are shuffled once, by chunk, so that the second pass
    over a very long one is spread over tasks.
    """
    numbered = rows.select(F.monotonically_increasing_id().alias("_row"), *keys, F.coalesce(text, F.lit("")).alias("_text"))
    pieces = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    chunks = numbered.select("_row", *keys, F.posexplode_outer(pieces).alias("_no", "_chunk"))
    whole = F.coalesce("_chunk", F.lit(""))
    chunks = materialise(chunks.select("_row", *keys, F.coalesce("_no", F.lit(0)).alias("_no"), machine.tokens(whole).alias("tokens"), machine.whole(whole).alias("_map")))
    told = chunks.drop("_map").join(_starts(chunks.select("_row", "_no", "_map"), machine), ["_row", "_no"])
    walk = F.aggregate("tokens", F.col("_start"), lambda acc, t: F.concat(acc, machine.after(F.right(acc, F.lit(1)), machine.becomes(t))))
    return told.select(*keys, "_row", "_no", "tokens", F.split(walk, "").alias("states"))


def each_step(f) -> Column:
    """An array of ``f(token, before, after)`` over the tokens of ``traces``."""
    return F.transform("tokens", lambda t, i: f(t, F.get("states", i), F.get("states", i + 1)))


def counter(steps: Column) -> Column:
    """What a list of steps does to a counter that stops at zero: enough to know its end and its peak from any start.

    ``sum`` of the steps, the ``low`` and the ``high`` of their running sums, and the most that they ``rise`` from any earlier low.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(*(zero.alias(n) for n in ("sum", "low", "high", "rise")))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x
        low = F.least(acc["low"], total)
        return F.struct(total.alias("sum"), low.alias("low"), F.greatest(acc["high"], total).alias("high"), F.greatest(acc["rise"], total - low).alias("rise"))

    return F.aggregate(steps, start, step)


def depths(counted: DataFrame, keys: list[str], order: list[str], of: str) -> DataFrame:
    """Rows with ``depth``, after them, and ``peak``, the most inside them, of one counter that runs over each key's rows in order.

    The counter is the running sum less its least value so far, if that is below zero, so windows give it. A window holds a
    key's rows, so they should be few and small: a row of ``counter`` stands for a chunk.
    """
    c, done = F.col(of), Window.partitionBy(*keys).orderBy(*order)
    so_far = done.rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("_before", F.sum(c["sum"]).over(so_far) - c["sum"])
    lows = summed.withColumn("_low", F.least(F.lit(0), F.min(F.col("_before") + c["low"]).over(so_far)))
    earlier = F.coalesce(F.lag("_low").over(done), F.lit(0))
    peaks = lows.withColumn("peak", F.greatest(F.col("_before") - earlier + c["high"], c["rise"]))
    return peaks.withColumn("depth", F.col("_before") + c["sum"] - F.col("_low")).drop("_before", "_low")


#: Markup: text, after <, <!, <!-, in a comment, after one - and two of them there, in a tag, in its double and single quotes.
MARKUP = Machine(
    "0123456789",
    {
        "<": "1777444789",
        "!": "0277444789",
        "-": "0734566789",
        "/": "0777444789",
        ">": "0000440089",
        '"': "0888444879",
        "'": "0999444987",
    },
    "0777444789",
)


def markup(pages: DataFrame, keys: list[str], text: str, chunk: int = CHUNK) -> DataFrame:
    """Of every text: ``n_marks, n_comments, n_masked, depth, peak, text``: what is left outside of tags and comments, and how deep tags nest.

    A mark starts at each < outside of another; quotes hide > in tags, and comments end at -->, or with the text. ``n_masked``
    counts the characters in marks. Tags that start with / count down, never below zero, those with ! not, and others up.
    """
    plain = lambda t, s, e: F.when((s == "0") & (e == "0"), t).otherwise("")
    turn = lambda t, s, e: F.when(s != "1", 0).when(t == "/", -1).when(t.isin("!", ">"), 0).otherwise(1).cast("long")
    count = lambda which: F.size(F.filter(each_step(which), lambda x: x)).cast("long")
    chunks = traces(pages, keys, text, MARKUP, chunk).select(
        *keys, "_row", "_no", F.array_join(each_step(plain), "").alias("_text"), counter(each_step(turn)).alias("_c"), F.length(F.array_join("tokens", "")).cast("long").alias("_n"),
        count(lambda t, s, e: (s == "0") & (e == "1")).alias("_marks"), count(lambda t, s, e: (s == "3") & (e == "4")).alias("_comments"),
    )
    deep = depths(chunks, ["_row"], ["_no"], "_c")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_text"))), lambda x: x["_text"]), "")
    out = deep.groupBy("_row").agg(
        *(F.first(k).alias(k) for k in keys), F.sum("_marks").alias("n_marks"), F.sum("_comments").alias("n_comments"), F.sum("_n").alias("_all"), F.max_by("depth", "_no").alias("depth"), F.max("peak").alias("peak"), said.alias("text"),
    )
    return out.select(*keys, "n_marks", "n_comments", (F.col("_all") - F.length("text")).alias("n_masked"), "depth", "peak", "text")
