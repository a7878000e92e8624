"""Folded rows and columns side by side against a plain reading of the script."""

import random

from corvane.operators.sequences import edit_script
from corvane.operators.shown import fold, side_by_side


def folded(steps, context, opened):
    """(pos, kind, old, new, value, hidden): a script as it is shown."""
    near = {p for p, (kind, *_) in enumerate(steps) if kind != "same" for p in range(p - context, p + context + 1)}
    out, at = [], 0
    while at < len(steps):
        end = at
        while end < len(steps) and end not in near:
            end += 1
        if end > at and steps[at][2] not in opened:
            out.append((at, "gap", steps[at][1], steps[at][2], None, end - at))
            at = end
        else:
            end = max(end, at + 1)
            out += [(p, *steps[p], None) for p in range(at, end)]
            at = end
    return out


def columns(rows):
    """(kind, left number, left, right number, right, hidden) of every row."""
    out, at = [], 0
    while at < len(rows):
        _, kind, old, new, value, hidden = rows[at]
        if kind in ("same", "gap"):
            out.append((kind, old, value, new, value, hidden))
            at += 1
            continue
        sides = {"del": [], "add": []}
        for side in sides:
            while at < len(rows) and rows[at][1] == side:
                sides[side].append(rows[at])
                at += 1
        for k in range(max(map(len, sides.values()))):
            left, right = (sides[s][k] if k < len(sides[s]) else None for s in ("del", "add"))
            kind = "changed" if left and right else "del" if left else "add"
            out.append((kind, left and left[2], left and left[4], right and right[3], right and right[4], None))
    return out


def test_scripts_as_they_are_shown(spark):
    rng = random.Random(9)
    scripts = {k: list(edit_script(*([rng.choice("abcdefghij") for _ in range(rng.randrange(30))] for _ in range(2)))) for k in range(30)}
    same = [str(x) for x in range(40)]
    scripts[30] = list(edit_script(same, [x for x in same if x != "20"]))
    scripts[31] = list(edit_script(same, same))
    scripts[None] = list(edit_script(same, ["new", *same]))
    rows = [(k, p, *s) for k, script in scripts.items() for p, s in enumerate(script)]
    steps = spark.createDataFrame(rows, "k long, pos int, kind string, old_no int, new_no int, value string")
    asked = [(k, rng.randrange(12)) for k in range(30) for _ in range(4)] + [(31, 0), (31, 0), (30, 5), (30, 23)]
    opened = spark.createDataFrame(asked, "k long, new_no int")
    for context, some in ((0, None), (3, None), (1, opened), (3, opened)):
        got = {}
        shown = fold(steps, ["k"], context, some)
        for r in shown.orderBy("pos").collect():
            got.setdefault(r.k, []).append(tuple(r)[1:])
        want = {k: folded(s, context, {n for j, n in asked if j == k} if some is not None else set()) for k, s in scripts.items() if s}
        assert got == want
        wide = {}
        for r in side_by_side(shown, ["k"]).orderBy("row").collect():
            assert r.row == len(wide.setdefault(r.k, [])) + 1
            wide[r.k].append(tuple(r)[2:])
        assert wide == {k: columns(v) for k, v in want.items()}
    assert side_by_side(fold(steps.limit(0), ["k"]), ["k"]).count() == 0
