"""Edit scripts, greedy pairs and closures against brute force."""

import random
from functools import lru_cache
from itertools import groupby
from pathlib import Path

from corvane.operators.graph import closure
from corvane.operators.matching import greedy_pairs
from corvane.operators.sequences import edit_script, edit_scripts, replaced_lines, word_diffs


def common(a, b):
    @lru_cache(None)
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def test_edit_scripts_are_least_and_lead_from_old_to_new():
    rng = random.Random(3)
    for _ in range(200):
        old, new = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        steps = list(edit_script(old, new))
        assert [(i, v) for k, i, _, v in steps if k != "add"] == list(enumerate(old))
        assert [(j, v) for k, _, j, v in steps if k != "del"] == list(enumerate(new))
        assert sum(k == "same" for k, *_ in steps) == common(tuple(old), tuple(new))
    assert [k for k, *_ in edit_script(["x", "a"], ["a", "y"])] == ["del", "same", "add"]
    assert [(k, v) for k, _, _, v in edit_script(["a"], ["b"])] == [("del", "a"), ("add", "b")]


def by_whole_table(old, new):
    """The script by the definition: from the start, what both share, else a deletion where that keeps as much in common."""
    n, m = len(old), len(new)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            table[i][j] = table[i + 1][j + 1] + 1 if old[i] == new[j] else max(table[i + 1][j], table[i][j + 1])
    i, j, out = 0, 0, []
    while i < n or j < m:
        if i < n and j < m and old[i] == new[j]:
            out.append(("same", i, j, old[i]))
            i, j = i + 1, j + 1
        elif i < n and (j == m or table[i + 1][j] >= table[i][j + 1]):
            out.append(("del", i, None, old[i]))
            i += 1
        else:
            out.append(("add", None, j, new[j]))
            j += 1
    return out


def test_edit_scripts_choose_deletions_first():
    """Step by step: what both begin and end with is kept, and the rest between follows the definition."""
    rng = random.Random(8)
    for size in (1, 2, 3, 7, 40, 90):
        for _ in range(30):
            old, new = ([rng.choice("abcdefg") for _ in range(rng.randrange(size + 1))] for _ in range(2))
            head = next((k for k, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
            tail = next((k for k, (x, y) in enumerate(zip(old[head:][::-1], new[head:][::-1])) if x != y), min(len(old), len(new)) - head)
            middle = by_whole_table(old[head : len(old) - tail], new[head : len(new) - tail])
            want = [("same", k, k, old[k]) for k in range(head)]
            want += [(kind, None if i is None else i + head, None if j is None else j + head, v) for kind, i, j, v in middle]
            want += [("same", len(old) - k, len(new) - k, old[-k]) for k in range(tail, 0, -1)]
            assert list(edit_script(old, new)) == want


def test_long_texts_are_compared_as_short_ones():
    rng = random.Random(2)
    old = [rng.randrange(5000) for _ in range(3000)]
    new = [x for x in old if rng.random() > 0.02]
    for at in range(0, len(new), 97):
        new.insert(at, -1)
    steps = list(edit_script(old, new))
    assert sum(k == "same" for k, *_ in steps) == len(new) - new.count(-1) and [v for k, _, _, v in steps if k != "add"] == old


def words_by_hand(old, new):
    """Both sides' stretches and the share in common, from the script by the definition."""
    import regex

    cut = lambda t: regex.findall(r"\s+|[\p{L}\p{N}_$]+|[^\s\p{L}\p{N}_$]", t)
    steps = list(edit_script(cut(old), cut(new)))
    out = []
    for gone in ("add", "del"):
        flags = [(v, k != "same") for k, _, _, v in steps if k != gone]
        for _ in range(2):
            grouped = [(c, "".join(v for v, _ in g)) for c, g in groupby(flags, key=lambda x: x[1])]
            flags = [(t, c and not t.isspace()) for c, t in grouped]
        out.append([(t, c) for t, c in flags])
    size = lambda t: len("".join(t.split()))
    total = size(old) + size(new)
    return *out, 2 * sum(size(v) for k, _, _, v in steps if k == "same") / total if total else 1.0


def test_word_diffs(spark):
    rng = random.Random(4)
    rows = [("int a = 1;", "int b = 1;"), ("one two", "one three"), ("abc", "xyz"), (None, None), ("a  b", "a b"), ("aé", ""), (" ", "\t"), ("x y", "x  z y"), ("\u00a0a", "a")]
    rows += [tuple("".join(rng.choice(["a", "b1", " ", "  ", ";", "é_", "(", "\t"]) for _ in range(rng.randrange(14))) for _ in range(2)) for _ in range(60)]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, o string, n string")
    got = {r.k: r for r in word_diffs(frame, {"k": "long"}, "o", "n").collect()}
    assert len(got) == len(rows)
    for k, (o, n) in enumerate(rows):
        old, new, alike = words_by_hand(o or "", n or "")
        assert got[k].similarity == alike
        if alike >= 0.35:
            assert ([tuple(p) for p in got[k].old_parts], [tuple(p) for p in got[k].new_parts]) == (old, new)
        else:
            assert got[k].old_parts is None and got[k].new_parts is None
    assert [tuple(p) for p in got[0].old_parts] == [("int ", False), ("a", True), (" = 1;", False)]
    assert [tuple(p) for p in got[4].old_parts] == [("a  b", False)]
    assert word_diffs(frame.limit(0), {"k": "long"}, "o", "n").count() == 0


def test_replaced_lines_pair_in_order(spark):
    """The k-th deletion of a stretch with the k-th addition after it; what is left over has no partner."""
    rows = [(1, list("abcxd"), list("ABxyd")), (2, list("ab"), list("XYZ")), (3, list("ab"), list("b")), (4, list("a"), list("xa"))]
    steps = edit_scripts(spark.createDataFrame(rows, "k long, o array<string>, n array<string>"), {"k": "long"}, "o", "n")
    got = sorted((r.k, r.old_no, r.new_no, r.old, r.new) for r in replaced_lines(steps, ["k"]).collect())
    assert got == [(1, 0, 0, "a", "A"), (1, 1, 1, "b", "B"), (2, 0, 0, "a", "X"), (2, 1, 1, "b", "Y")]


def test_edit_scripts_of_rows(spark):
    rows = [(1, ["a", "b"], ["b", "c"]), (2, None, ["x"]), (3, [], None)]
    got = edit_scripts(spark.createDataFrame(rows, "k long, o array<string>, n array<string>"), {"k": "long"}, "o", "n")
    assert sorted((r.k, r.pos, r.kind, r.value) for r in got.collect()) == [(1, 0, "del", "a"), (1, 1, "same", "b"), (1, 2, "add", "c"), (2, 0, "add", "x")]


def test_greedy_pairs(spark):
    rng = random.Random(5)
    rows = list({(rng.randrange(8), rng.randrange(8)): rng.randrange(4) / 4 for _ in range(40)}.items())
    rows = [(a, b, s) for (a, b), s in rows]
    want, used_a, used_b = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            want.add((a, b, s))
            used_a.add(a)
            used_b.add(b)
    frame = spark.createDataFrame([*rows, (None, 1, 1.0), rows[0]], "a long, b long, s double")
    assert sorted(map(tuple, greedy_pairs(frame, "a", "b", "s").collect())) == sorted(want)
    assert greedy_pairs(frame.limit(0), "a", "b", "s").count() == 0


def test_closure_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 4)], "a long, b long")
    want = [(1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 2), (2, 3, 1), (2, 4, 2), (3, 1, 1), (3, 2, 2), (3, 4, 1)]
    assert sorted(map(tuple, closure(edges).collect())) == want


def test_greedy_rounds_leave_only_the_pairs_taken(spark):
    """A falling chain of scores takes a round for each pair; no round's remaining pairs stay in the shared folder."""
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")) / "corvane"
    rows = [(i, j, 1.0 - i / 10) for i in range(6) for j in (i, i - 1) if j >= 0]
    frame, before = spark.createDataFrame(rows, "a long, b long, s double"), set(folder.glob("*"))
    taken = sorted(map(tuple, greedy_pairs(frame, "a", "b", "s").collect()))
    assert taken == [(i, i, 1.0 - i / 10) for i in range(6)]
    assert sum(spark.read.parquet(str(p)).count() for p in set(folder.glob("*")) - before) == len(taken)
