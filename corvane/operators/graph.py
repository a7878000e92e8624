"""Graph operators over edge tables: components, cycles, levels, closures with depth, inherited properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corvane.scratch import discard, materialise


def _told(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written, with their number and a checksum that doesn't depend on their order, both taken by the same job."""
    seen = Observation()
    table = materialise(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")))
    return table, (seen.get["n"], seen.get["x"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every vertex of an undirected edge table with the least vertex of its component: ``id, component``.

    Alternates large-star and small-star steps: each points a vertex's neighbours to the least vertex it knows, by one
    aggregation and one join, until no edge changes; every round at least halves the way to the least vertex or so, so rounds
    grow with the logarithm of the longest chain. Edges are written after each round, so lineage stays short, and the job that
    writes them also tells whether they changed; the round before is then deleted.
    """
    pairs, state = _told(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written, so that the join is of two exchanges and a vertex of many links can be split.
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        after, now = _told(moved.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct())
        discard(pairs)
        discard(least)
        pairs = after
        if now == state:
            break
        state = now
    roots = pairs.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def closure(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, reached, depth``: every vertex that can be reached along edges, with the fewest steps; safe on cycles.

    Breadth first: each round joins the last round's pairs with the edges and leaves out pairs known already, which ends when
    nothing new is reached. Rounds are written one by one, and what is known is read from all of them.
    """
    steps = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct())
    last = materialise(steps.select(F.col("a").alias("id"), F.col("b").alias("reached")).filter("id <> reached").withColumn("depth", F.lit(1)))
    spark, paths, depth = edges.sparkSession, [last.scratch_path], 1
    while not last.isEmpty():
        depth += 1
        known = spark.read.schema(last.schema).parquet(*paths)
        further = last.join(steps, F.col("reached") == F.col("a")).select("id", F.col("b").alias("reached")).filter("id <> reached").distinct()
        last = materialise(further.join(known, ["id", "reached"], "left_anti").withColumn("depth", F.lit(depth)))
        paths.append(last.scratch_path)
    return spark.read.schema(last.schema).parquet(*paths)


def _counted(df: DataFrame, which: str = "true") -> tuple[DataFrame, int]:
    """A table, written, and how many of its rows ``which`` holds for, by the same job."""
    seen = Observation()
    table = materialise(df.observe(seen, F.count_if(F.expr(which)).alias("n")))
    return table, seen.get["n"]


def _peeled(edges: DataFrame, source: str, target: str) -> tuple[list[DataFrame], int]:
    """The edges ``source, target`` left after each round that drops those from vertices which no edge leads to, and how many are last.

    The first table is all edges; rounds end when they drop nothing, so what is last lies on cycles or behind them. A round is
    one job.
    """
    left, n = _counted(edges)
    rounds, before = [left], None
    while n and n != before:
        left, before = rounds[-1], n
        met = left.select(F.col(target).alias(source)).distinct()
        after, n = _counted(left.join(met, source, "left_semi").select(source, target))
        rounds.append(after)
    return rounds, n


def _core(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges ``u, v`` that lie on cycles or between them, and their number; the rest can't be part of a component of two vertices."""
    forth, _ = _peeled(edges, "u", "v")
    back, n = _peeled(forth[-1], "v", "u")
    for old in (*forth, *back[:-1]):
        discard(old)
    return back[-1].select("u", "v"), n


def strong_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component``: of each vertex on an edge the least vertex of its strongly connected component.

    Edges outside of cycles are peeled off. Each round then colours every vertex with the greatest vertex that reaches it; a
    vertex of its own colour is a pivot, and those of its colour that reach it back are its component. Colours part components,
    so edges between colours go, as do the components found, until no edge is left; all pivots of a round work at once. Waves
    and peeling run as many steps as their longest way, a job each; tables that are done with are deleted.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL")
    vertices = materialise(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    left, n = _core(pairs.filter("u <> v").distinct())
    found = []
    while n:
        left = materialise(left)
        colour = _spread(left, left.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("c", F.col("id")))
        alike = left.join(colour.withColumnsRenamed({"id": "u", "c": "cu"}), "u").join(colour.withColumnsRenamed({"id": "v", "c": "cv"}), "v")
        inside = materialise(alike.filter("cu = cv").select("u", "v", "cu"))
        wave, met = _counted(colour.filter("id = c").select("id", "c"))
        waves = [wave]
        while met:
            known = spark.read.schema(wave.schema).parquet(*(w.scratch_path for w in waves))
            step = inside.join(wave.select(F.col("id").alias("v"), F.col("c").alias("cu")), ["v", "cu"]).select(F.col("u").alias("id"), F.col("cu").alias("c")).distinct()
            wave, met = _counted(step.join(known, "id", "left_anti"))
            waves.append(wave)
        done = materialise(spark.read.schema(wave.schema).parquet(*(w.scratch_path for w in waves)))
        found.append(done)
        rest = inside.join(done.select(F.col("id").alias("u")), "u", "left_anti").join(done.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v")
        after, n = _core(rest)
        for old in (left, colour, inside, *waves):
            discard(old)
        left = after
    if not found:
        return vertices.select("id", F.col("id").alias("component"))
    roots = spark.read.schema(found[0].schema).parquet(*(f.scratch_path for f in found))
    least = roots.groupBy("c").agg(F.min("id").alias("component"))
    named = roots.join(least, "c").select("id", F.col("component").alias("_least"))
    return vertices.join(named, "id", "left").select("id", F.coalesce("_least", "id").alias("component"))


def _spread(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``id, c``: the greatest ``c`` of the vertices that reach each vertex, its own included. Only vertices that rose go on."""
    colour = materialise(start.withColumn("rose", F.lit(True)))
    rose = 1
    while rose:
        offered = edges.join(colour.filter("rose").select(F.col("id").alias("u"), "c"), "u").groupBy(F.col("v").alias("id")).agg(F.max("c").alias("new"))
        higher = F.coalesce(F.col("new") > F.col("c"), F.lit(False))
        after, rose = _counted(colour.join(offered, "id", "left").select("id", F.greatest("c", "new").alias("c"), higher.alias("rose")), "rose")
        discard(colour)
        colour = after
    return colour


def levels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, level``: the most edges on a way that ends at each vertex of an acyclic edge table, by rounds of Kahn's algorithm.

    Each round drops the edges from vertices that no edge leads to any more; a vertex is of the level of the last round in which
    an edge led to it. Raises if edges form a cycle.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u IS NOT NULL AND v IS NOT NULL").distinct()
    rounds, n = _peeled(pairs, "u", "v")
    if n:
        raise ValueError("the edges form a cycle")
    spark, paths = edges.sparkSession, [r.scratch_path for r in rounds]
    # The number of a round is where its path stands in the list.
    numbers = F.create_map(*(F.lit(x) for k, p in enumerate(paths) for x in (p.rsplit("/", 1)[-1], k + 1)))
    name = F.element_at(F.split(F.input_file_name(), "/"), -2)
    every = spark.read.schema(rounds[0].schema).parquet(*paths).select("u", "v", F.element_at(numbers, name).alias("n"))
    ends = every.select(F.col("v").alias("id"), F.col("n").alias("level")).union(every.filter("n = 1").select(F.col("u").alias("id"), F.lit(0).alias("level")))
    out = materialise(ends.groupBy("id").agg(F.max("level").alias("level")))
    for old in rounds:
        discard(old)
    return out


def levels_of_cyclic(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component, level``: cycles count as one vertex, named by its least member; levels are those between them."""
    named = materialise(strong_components(edges, a, b))
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    of = lambda end, name: named.select(F.col("id").alias(end), F.col("component").alias(name))
    between = ends.join(of("u", "cu"), "u").join(of("v", "cv"), "v").filter("cu <> cv").select("cu", "cv").distinct()
    ranked = levels(between, "cu", "cv").select(F.col("id").alias("component"), "level")
    return named.join(ranked, "component", "left").select("id", "component", F.coalesce("level", F.lit(0)).alias("level"))


def nearest_above(parents: DataFrame, holds: DataFrame, barriers: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """``id, found, depth``: of each vertex the nearest ancestor that ``holds``, unless a barrier lies on every way before it.

    ``holds`` and ``barriers`` have a column ``id``. An ancestor that holds ends the search, itself no matter whether it is a barrier; a barrier that
    doesn't hold is a dead end. Of several at one depth the least is taken. A way goes up level by level, all vertices at once;
    vertices already passed for a start aren't passed again, so cycles end.
    """
    spark = parents.sparkSession
    up = materialise(parents.select(F.col(child).alias("at"), F.col(parent).alias("above")).filter("at IS NOT NULL AND above IS NOT NULL").distinct())
    goal, wall = (materialise(t.select("id").filter("id IS NOT NULL").distinct()) for t in (holds, barriers))
    wave = materialise(up.select(F.col("at").alias("id"), "at").distinct())
    passed, answers, depth = [wave.scratch_path], [], 0
    seen_schema = wave.schema
    while not wave.isEmpty():
        depth += 1
        met = materialise(wave.join(up, "at").select("id", F.col("above").alias("at")).distinct())
        hit = met.join(goal.withColumnRenamed("id", "at"), "at", "left_semi").groupBy("id").agg(F.min("at").alias("found"))
        answers.append(materialise(hit.withColumn("depth", F.lit(depth))))
        known = spark.read.schema(seen_schema).parquet(*passed)
        on = met.join(answers[-1].select("id"), "id", "left_anti").join(wall.withColumnRenamed("id", "at"), "at", "left_anti").select("id", "at")
        wave = materialise(on.join(known, ["id", "at"], "left_anti"))
        passed.append(wave.scratch_path)
    if not answers:
        return up.select(F.col("at").alias("id"), F.col("above").alias("found"), F.lit(1).alias("depth")).limit(0)
    return spark.read.schema(answers[0].schema).parquet(*(t.scratch_path for t in answers))


def nearest_sources(edges: DataFrame, sources: DataFrame, hops: int, kinds: list[str] | None = None) -> DataFrame:
    """``id, source, score, hops``: every vertex within ``hops`` steps of a source, with the nearest; of several the one of the greatest score, then the least id.

    ``edges`` are ``kind, a, b``, taken both ways, of the given kinds alone, or all; ``sources`` are ``id, score``, and those without
    either take no part. All sources start at once: a round takes the last round's vertices one step on, keeps the best offer of each new vertex, by an aggregation
    with partial sums, and writes those. A vertex passes on its own best alone, which is enough, as every way through it adds as much.
    """
    spark = edges.sparkSession
    taken = edges if kinds is None else edges.filter(F.col("kind").isin(kinds))
    pairs = taken.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    steps = materialise(pairs.union(pairs.select("b", "a")).distinct())
    start = sources.filter("id IS NOT NULL AND score IS NOT NULL").groupBy("id").agg(F.max("score").alias("score")).select("id", F.col("id").alias("source"), "score")
    wave, met = _counted(start.withColumn("hops", F.lit(0)))
    waves = [wave]
    for hop in range(1, hops + 1):
        if not met:
            break
        known = spark.read.schema(wave.schema).parquet(*(w.scratch_path for w in waves))
        offers = wave.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id"), "source", "score")
        # Of one score the least source, then of all scores the greatest.
        per_score = offers.groupBy("id", "score").agg(F.min("source").alias("source"))
        won = per_score.groupBy("id").agg(F.max_by("source", "score").alias("source"), F.max("score").alias("score"))
        wave, met = _counted(won.join(known.select("id"), "id", "left_anti").select("id", "source", "score", F.lit(hop).alias("hops")))
        waves.append(wave)
    discard(steps)
    return spark.read.schema(waves[0].schema).parquet(*(w.scratch_path for w in waves))


def best_of(vertices: DataFrame, order: list, most: int) -> DataFrame:
    """The first ``most`` vertices in an order: the cap of what is shown, whose size is that of its parameter whatever the graph's."""
    return materialise(vertices.orderBy(*order).limit(most))


def induced(edges: DataFrame, vertices: DataFrame, few: bool = False) -> DataFrame:
    """The edges ``kind, a, b`` of which both ends are among ``vertices``; ``few`` says that those are capped, so they are broadcast."""
    ids = vertices.select("id").distinct()
    ids = F.broadcast(ids) if few else ids
    return edges.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("kind", "a", "b")
