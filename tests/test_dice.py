"""Pairs of alike texts against all pairs by hand."""

import random
from collections import Counter
from pathlib import Path

from corvane.operators.alike import alike_texts
from corvane.operators.matching import bigram_sets, dice_pairs, distinct_texts
from corvane.plans.queries import near_dup_bag_dice
from corvane.scratch import RELEASE, materialise


def bag(text):
    words = [w for w in (text or "").split(" ") if w]
    return Counter([(words[0],)] if len(words) == 1 else zip(words, words[1:]))


def dice(a, b):
    x, y = bag(a), bag(b)
    return 2 * sum((x & y).values()) / (x.total() + y.total()) if x and y else 0.0


def texts(rng, n):
    base = [" ".join(rng.choice("abcde") for _ in range(rng.randrange(12))) for _ in range(n)]
    near = [" ".join([*t.split(" "), rng.choice("abz")]) for t in base[: n // 2]]
    return [None, "", " ", "x", "x x x x", "x x x", "  x  x x x ", *base, *near, *near[:4]]


def test_dice_pairs_are_all_that_reach_the_bound(spark):
    rng = random.Random(6)
    rows = list(enumerate(texts(rng, 40)))
    sets = materialise(bigram_sets(spark.createDataFrame(rows, "k long, text string"), "k", "text"))
    for least in (0.5, 0.85, 1.0):
        want = {(i, j): round(dice(a, b), 6) for i, a in rows for j, b in rows if i < j and dice(a, b) >= least}
        assert {(r.a, r.b): r.dice for r in dice_pairs(sets.withColumnRenamed("k", "a"), None, "a", "b", least).collect()} == want
        both = dice_pairs(sets.filter("k < 30").withColumnRenamed("k", "a"), materialise(sets.filter("k >= 30").withColumnRenamed("k", "b")), "a", "b", least)
        assert {(r.a, r.b): r.dice for r in both.collect()} == {k: v for k, v in want.items() if k[0] < 30 <= k[1]}


def test_near_copies_of_null_and_repeated_ids(spark, tmp_path):
    """Texts are told apart by content: two texts of one id, and a text without any, still meet their like."""
    one, two, far = "a b c d e f g h i", "a b c d e f g h i j", "p q r s"
    rows = [(1, one, 5), (1, far, 5), (None, two, 5), (7, one, 5), (7, one, 5), (3, far, 5), (None, None, 5), (9, "", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, content int").write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter(map(tuple, near_dup_bag_dice(spark, str(tmp_path)).collect()))
    alike = round(dice(one, two), 6)
    assert sum(got.values()) == 4 and got[(1, 7, 1.0)] == 2 and got[(1, 3, 1.0)] == 1
    assert got[(1, None, alike)] + got[(None, 1, alike)] == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert near_dup_bag_dice(spark, str(tmp_path / "none")).count() == 0


def test_distinct_texts_keep_the_least_key(spark):
    rows = [(4, "t"), (2, "t"), (None, "t"), (None, None), (3, "")]
    assert sorted((r.first, r.text) for r in distinct_texts(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()) == [(2, "t"), (3, "")]


def test_alike_texts_in_small_chunks_are_all_that_reach_the_bound(spark):
    """Rows that repeat a text, texts without words, chunks of a few words and parts of a few tokens included."""
    rng = random.Random(8)
    some = dict(enumerate(texts(rng, 60)))
    first = {}
    rows = [(bytes([first.setdefault(t or "", i)]), t or "") for i, t in some.items()]
    by = {k[0]: t for k, t in rows}
    frame = spark.createDataFrame(rows + rows[:30], "k binary, text string").repartition(3)
    before = [spark.conf.get(k) for k in (*RELEASE, "spark.sql.execution.arrow.maxBytesPerBatch")]
    for least, parts, words, group in ((0.5, 3, 40, 3), (0.85, None, 1 << 20, 256), (0.85, 5, 1, 1), (1.0, 1, 100, 2)):
        want = {(i, j): round(dice(a, b), 6) for i, a in by.items() for j, b in by.items() if i < j and dice(a, b) >= least}
        got = alike_texts(frame, "k", "text", least, parts, words, group).collect()
        assert {(r.a[0], r.b[0]): round(2 * r.m / r.n, 6) for r in got} == want and len(got) == len(want)
    assert [spark.conf.get(k) for k in (*RELEASE, "spark.sql.execution.arrow.maxBytesPerBatch")] == before


def test_near_copies_write_neither_texts_nor_all_bigrams(spark, tmp_path):
    """400 texts of 500 words, four near copies: what the query writes to the shared folder is a small part of the texts."""
    rng = random.Random(9)
    many = [" ".join(f"{rng.getrandbits(32):08x}" for _ in range(500)) for _ in range(396)]
    many += [f"{t} end" for t in many[:4]]
    spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = held()
    assert sorted((r.doc_a, r.doc_b) for r in near_dup_bag_dice(spark, str(tmp_path)).collect()) == [(i, 396 + i) for i in range(4)]
    assert held() - before < sum(map(len, many)) / 10
