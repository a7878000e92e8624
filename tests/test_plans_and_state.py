"""Levels, barriers, running sums, cuts, intervals, streams of marks, rules and fingerprints against brute force."""

import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.operators.fingerprints import changes, fingerprint, moved_by
from corvane.operators.graph import levels, levels_of_cyclic, nearest_above, strong_components
from corvane.operators.intervals import innermost
from corvane.operators.ordered import parts_under_cap, places, running_sum
from corvane.operators.ranking import select_spans
from corvane.operators.scoring import Rule, assessed
from corvane.plans.plan_queries import mark_patches, nested_spans
from corvane.streaming.marks import current, effective, follow, last_patches

DATA = "/root/testdata/sf0.001"


def reach_of(edges):
    ids = {x for e in edges for x in e if None not in e}
    reach = {i: {v for u, v in edges if u == i and v is not None} for i in ids}
    grown = True
    while grown:
        grown = False
        for i in ids:
            more = set().union(reach[i], *(reach[j] for j in reach[i]))
            grown |= more != reach[i]
            reach[i] = more
    return ids, reach


def components_by_hand(edges):
    ids, reach = reach_of(edges)
    return {i: min([i, *(j for j in reach[i] if i in reach[j])]) for i in ids}


def levels_by_hand(edges):
    comp = components_by_hand(edges)
    between = {(comp[u], comp[v]) for u, v in edges if None not in (u, v) and comp[u] != comp[v]}
    level = dict.fromkeys(comp.values(), 0)
    for _ in level:
        for u, v in between:
            level[v] = max(level[v], level[u] + 1)
    return {(i, c, level[c]) for i, c in comp.items()}


GRAPHS = [
    [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (None, 4), (6, 6), (1, 2)],
    [(k, k + 1) for k in range(12)],
    [(k, (k + 1) % 9) for k in range(9)] + [(20, 0), (3, 30), (30, 31)],
    [(1, None)],
    *[[(random.Random(seed).randrange(16), random.Random(seed * 31 + k).randrange(16)) for k in range(22)] for seed in (1, 2)],
]


@pytest.mark.parametrize("edges", GRAPHS)
def test_cyclic_graphs(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {tuple(r) for r in strong_components(frame).collect()} == set(components_by_hand([e for e in edges if None not in e]).items())
    assert {tuple(r) for r in levels_of_cyclic(frame).collect()} == levels_by_hand([e for e in edges if None not in e])


def test_levels_refuse_cycles(spark):
    with pytest.raises(ValueError):
        levels(spark.createDataFrame([(1, 2), (2, 1), (0, 1)], "a long, b long"))
    assert levels(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nearest_above(spark):
    """Several parents, cycles, a barrier that holds, and a way around a barrier."""
    up = [(1, 2), (2, 3), (3, 4), (1, 5), (5, 6), (6, 4), (7, 8), (8, 7), (9, 10), (10, 9), (11, 12), (None, 3)]
    holds, walls = [4, 9, 12], [2, 12, 3]
    got = {tuple(r) for r in nearest_above(spark.createDataFrame(up, "child long, parent long"), spark.createDataFrame([(x,) for x in holds], "id long"), spark.createDataFrame([(x,) for x in walls], "id long")).collect()}
    # 1 goes by 5 and 6, as 2 is a barrier; 2 is stopped by 3; 9 comes back to itself.
    assert got == {(1, 4, 3), (3, 4, 1), (5, 4, 2), (6, 4, 1), (10, 9, 1), (9, 9, 2), (11, 12, 1)}


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(5)) for k in range(400)]
    rng.shuffle(rows)
    got = running_sum(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], ["o"], F.col("v"), "s").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.s == sum(v for k, o, v in rows if k == r.k and o <= r.o)
    numbered = places(spark.createDataFrame(rows, "k string, o long, v long"), ["v", "o"]).orderBy("place").collect()
    assert [(r.v, r.o) for r in numbered] == sorted((v, o) for _, o, v in rows) and numbered[-1].place == 400


def cut_by_hand(names, cap):
    """Parts of one key: names in order with their rows; a part's rows never beyond the cap."""
    out, part, held = {}, 0, cap
    for name in sorted(set(names)):
        n = names.count(name)
        if n > cap:
            for k in range(n):
                out[name, k] = part + 1 + k // cap
            part, held = part + -(-n // cap), cap
            continue
        if held + n > cap:
            part, held = part + 1, 0
        held += n
        out.update({(name, k): part for k in range(n)})
    return out, part


@pytest.mark.parametrize("cap", [1, 4, 7, 1000])
def test_parts_under_cap(spark, cap):
    rng = random.Random(cap)
    rows, n = [], 0
    for key, size in (("hot", 300), ("few", 3), (None, 20)):
        for _ in range(size):
            n += 1
            rows.append((key, f"n{min(int(rng.expovariate(0.08)), 60):02}", n))
    rng.shuffle(rows)
    got = parts_under_cap(spark.createDataFrame([r for r in rows if r[0]], "k string, name string, id long"), ["k"], "name", ["id"], cap).collect()
    assert len(got) == sum(1 for r in rows if r[0])
    for key in ("hot", "few"):
        mine = [r for r in rows if r[0] == key]
        want, last = cut_by_hand([r[1] for r in mine], cap)
        place = {x: sum(r[1] == name and r[2] < x for r in mine) for _, name, x in mine}
        assert {r.id: r.part for r in got if r.k == key} == {x: want[name, place[x]] for _, name, x in mine}
        assert {r.parts for r in got if r.k == key} == {last}


def test_innermost_spans(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), s := rng.randrange(-200, 200), s + rng.choice([0, 1, 2, 7, 31, 150, 399, -1]), k) for k in range(150)]
    spans += [("a", 5, None, 900), (None, -500, 500, 901), ("b", -(2**40), 2**40, 902), ("a", 10, 20, 903), ("a", 10, 20, 903)]
    points = [(k, rng.choice("abc"), rng.randrange(-220, 220)) for k in range(200)] + [(500, "a", None), (501, None, 3)]
    got = innermost(spark.createDataFrame(points, "p long, k string, at long"), spark.createDataFrame(spans, "k string, s long, e long, id long"), ["k"], "at", "s", "e", ["p"], ["id"])
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = {}
    for p, key, at in points:
        around = sorted((e - s, -s, i) for k, s, e, i in spans if None not in (k, e, key, at) and k == key and s <= at <= e)
        if around:
            want[p] = (around[0][2], len(around))
    assert {r.p: (r.id, r.depth) for r in got.collect()} == want
    assert "NestedLoop" not in nested_spans(spark, DATA)._jdf.queryExecution().toString()


def test_innermost_of_no_spans(spark):
    none = spark.createDataFrame([], "k string, s long, e long, id long")
    assert innermost(spark.createDataFrame([(1, "a", 2)], "p long, k string, at long"), none, ["k"], "at", "s", "e", ["p"], ["id"]).count() == 0


def test_spans_may_begin_below_zero(spark):
    rows = spark.createDataFrame([(1, -5, -2, 1), (1, -3, 4, 2), (1, -2, 0, 3), (1, 7, 7, 4)], "k long, s long, e long, t long")
    assert sorted((r.s, r.e, r.t) for r in select_spans(rows, ["k"], "s", "e", ["t"]).collect()) == [(-5, -2, 1), (-2, 0, 3)]


def test_marks_survive_a_stop(spark, tmp_path):
    """Late, repeated and unordered patches in several files; the stream is stopped, goes on, and a batch is written again."""
    rng, began = random.Random(9), datetime(2024, 1, 1)
    rows = [(k, began + timedelta(seconds=rng.randrange(50)), rng.randrange(3), rng.choice(["view", "click", "error", "purchase"]), float(rng.randrange(40)), f'{{"k": {rng.randrange(4)}}}') for k in range(300)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    source, target, state, keys = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ["user_id", "item"]
    stream = lambda: mark_patches(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    put = lambda part: spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)

    def result():
        out = current(spark, target, last_patches(mark_patches(spark.createDataFrame(rows, schema)), keys).schema, keys)
        return {(r.user_id, r["item"], r.field): r.value for r in out.collect()}

    def want(seen):
        last = {}
        for k, ts, user, kind, value, props in seen:
            key = user, int(props[6:-1]), "note" if kind == "purchase" else "seen"
            last[key] = max(last.get(key, (datetime.min, -1, None)), (ts, k, None if kind == "error" or (kind == "purchase" and value < 20) else str(int(value))))
        return {k: v[2] for k, v in last.items() if v[2] is not None}

    for part in (rows[:120], rows[60:150]):
        put(part)
    follow(stream(), keys, target, state).awaitTermination()
    assert result() == want(rows[:150])
    put(rows[150:])
    put(rows[:10])
    # As after a failure between writing a batch and noting that it is done: the last batch runs again.
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    follow(stream(), keys, target, state).awaitTermination()
    assert result() == want(rows)
    shutil.rmtree(source)


def test_effective_marks(spark):
    marks = spark.createDataFrame([(1, 1, "seen", "5"), (1, 2, "seen", "5"), (1, 3, "seen", ""), (1, 4, "seen", "5"), (2, 1, "note", "5")], "user_id long, item int, field string, value string")
    prints = spark.createDataFrame([(1, "5"), (2, "6"), (3, "7")], "item int, print string")
    got = {(r.user_id, r["item"]): r.status for r in effective(marks, prints, ["user_id", "item"], ["item"]).collect()}
    assert got == {(1, 1): "seen", (1, 2): "stale", (1, 3): "seen", (1, 4): "seen"}


def test_rules(spark):
    rules = [Rule("a", "'m'", "30", "x > 1", uncertain=True), Rule("a", "'m'", "90", "x > 2", uncertain=True), Rule("b", "concat('x', x)", "x * 30", "x > 2"), Rule("c", "'minus'", "-50", "x = 2")]
    rows = spark.createDataFrame([(1, False, False), (2, False, False), (3, False, False), (3, True, False), (3, False, True), (None, True, True)], "x int, test boolean, open boolean")
    got = [([tuple(x) for x in r.reasons], r.score, r.level) for r in assessed(rows, rules, "test", "open").collect()]
    assert got == [
        ([], 0, "low"), ([("a", "m", 30), ("c", "minus", -50)], 0, "low"), ([("a", "m", 30), ("b", "x3", 90)], 100, "critical"),
        ([("a", "m", 30), ("b", "x3", 90), ("test", "half of the risk, as for any test", -50)], 50, "high"), ([("a", "m (unverified)", 8), ("b", "x3", 90)], 98, "critical"), ([], 0, "low"),
    ]


def test_fingerprints_follow_edits(spark):
    rng = random.Random(6)
    lines, rows = [], []
    for turn in range(30):
        lines = [x for x in lines if rng.random() > 0.2] + [rng.choice("abcdefé") * rng.randrange(3) for _ in range(rng.randrange(5))]
        rng.shuffle(lines)
        rows.append((1, turn, list(lines)))
    rows.append((2, 0, []))
    texts = spark.createDataFrame(rows, "k long, t long, lines array<string>")
    by = {(r.k, r.t): r.by for r in moved_by(changes(texts, ["k"], ["t"], "lines"), ["k", "t"]).collect()}
    whole = {(r.k, r.t): r.f for r in texts.select("k", "t", fingerprint(F.col("lines")).alias("f")).collect()}
    at = 0
    for k, t, _ in rows[:30]:
        at += by.get((k, t), 0)
        assert whole[k, t] == at
    assert whole[2, 0] == 0
