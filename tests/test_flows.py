"""Machines over chunks, patch files and sources in graphs, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.graph import best_of, induced, nearest_sources
from corvane.operators.transducer import MARKUP, Machine, counter, depths, markup, traces
from corvane.sources.diff import change_files, parse_patch
from corvane.sources.patch_files import patch_text, read_patches, write_patches


def markup_by_hand(text):
    """Marks of a text one by one, by what they start with and where they end."""
    left, marks, i, depth, peak = "", [], 0, 0, 0
    while i < len(text):
        if text[i] != "<":
            left, i = left + text[i], i + 1
            continue
        if text.startswith("<!--", i):
            end = text.find("-->", i + 4)
            j = len(text) if end < 0 else end + 3
        else:
            j, quote = i + 1, ""
            while j < len(text) and (quote or text[j] != ">"):
                quote = "" if quote == text[j] else quote or (text[j] if text[j] in "\"'" else "")
                j += 1
            j = min(len(text), j + 1)
        mark = text[i:j]
        marks.append(mark)
        depth = max(0, depth + (-1 if mark.startswith("</") else 0 if mark.startswith("<!") or mark in ("<>", "<") else 1))
        peak, i = max(peak, depth), j
    return len(marks), sum(m.startswith("<!--") for m in marks), len(text) - len(left), depth, peak, left


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_markup_by_chunks_of_any_size(spark, chunk):
    rng = random.Random(chunk)
    texts = ["".join(rng.choice(["<", "!", "-", "--", "/", ">", ">", '"', "'", "a", "é", "\n", "😀", "<!--", "-->", "</p>", "<p>"]) for _ in range(rng.randrange(40))) for _ in range(60)]
    texts += ["", "<", "<!", "<!-", "<!--", "<!---->", "<!-->x", "a<b c='>'>d</b>", "</p></p><p>", "x" * 3000 + "<i>" * 700]
    rows = [(k % 7 if k % 5 else None, t) for k, t in enumerate(texts)] + [(None, None), (3, "<p>"), (3, "<p>")]
    got = markup(spark.createDataFrame(rows, "id long, html string"), ["id"], "html", chunk).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr((i, *markup_by_hand(t or ""))) for i, t in rows)


def test_markup_of_nothing(spark):
    assert markup(spark.createDataFrame([], "id long, html string"), ["id"], "html").count() == 0


def test_states_of_a_machine_over_blocks(spark):
    """More chunks than a block has: the states in each chunk are those of one pass over the text."""
    quotes = Machine("01", {'"': "10"}, "01")
    text = "".join(random.Random(5).choice('"ab') for _ in range(700))
    got = {r["_no"]: r for r in traces(spark.createDataFrame([(1, text)], "id long, t string"), ["id"], "t", quotes, 1).collect()}
    assert "".join("".join(got[k]["tokens"]) for k in range(len(text))) == text
    assert [got[k]["states"][0] for k in range(len(text))] == [str(text[:k].count('"') % 2) for k in range(len(text))]


@pytest.mark.parametrize("bad", [("00", {}, "00"), ("01", {"a": "0"}, "01"), ("01", {"a": "02"}, "01"), ("01", {"ab": "00"}, "01"), ("01", {}, "10")])
def test_machines_are_checked(bad):
    with pytest.raises(ValueError):
        Machine(*bad)
    assert MARKUP.states[0] == "0"


def test_counters_stop_at_zero(spark):
    rng = random.Random(3)
    lists = [[rng.choice([-2, -1, 1, 2]) for _ in range(rng.randrange(5))] for _ in range(30)]
    rows = spark.createDataFrame([(1, k, x) for k, x in enumerate(lists)] + [(2, 0, [-1]), (2, 1, [])], "g long, n int, steps array<long>")
    got = {(r["g"], r["n"]): (r["depth"], r["peak"]) for r in depths(rows.select("g", "n", counter(F.col("steps")).alias("c")), ["g"], ["n"], "c").collect()}
    at, hoped = 0, {}
    for k, x in enumerate(lists):
        peak = at
        for step in x:
            at = max(0, at + step)
            peak = max(peak, at)
        hoped[1, k] = (at, peak)
    assert got == {**hoped, (2, 0): (0, 0), (2, 1): (0, 0)}


def applied(old, rows):
    """The new lines that a patch's rows make of the old ones."""
    new, at = [], 1
    for _, _, _, _, _, kind, old_no, new_no, text in rows:
        if kind != "add":
            new += old[at - 1 : old_no - 1]
            assert old[old_no - 1] == text
            at = old_no + 1
        elif kind == "add":
            # Lines before an addition are copied up to where it lands.
            while len(new) < new_no - 1:
                new.append(old[at - 1])
                at += 1
        if kind != "del":
            assert new_no == len(new) + 1
            new.append(text)
    return new + old[at - 1 :]


@pytest.mark.parametrize("context", [0, 1, 3])
def test_patches_rebuild_the_new_side(context):
    rng = random.Random(context)
    for _ in range(200):
        old, new = ([rng.choice(["", "a", "b", "diff --git a/x b/x", "--- a", "@@ -1 +1 @@", "\\ c"]) for _ in range(rng.randrange(14))] for _ in range(2))
        text = patch_text("d é/x", old, new, context)
        if old == new:
            assert text is None
            continue
        rows = list(parse_patch(text))
        assert applied(old, rows) == new
        assert {(r[0], r[2]) for r in rows} == {("d é/x", "added" if not old else "deleted" if not new else "modified")}


@pytest.mark.parametrize("part_bytes", [1, 37, 1 << 20])
def test_patch_files_are_read_by_parts_of_any_size(spark, tmp_path, part_bytes):
    rng = random.Random(9)
    pairs = [(f"f{k}", *([rng.choice("abcdef") for _ in range(rng.randrange(8))] for _ in range(2))) for k in range(30)]
    pairs += [(None, ["a"], ["b"]), ("none", None, ["x", "y"]), ("gone", ["x"], None), ("both", None, None), ("twice", ["a"], ["b"]), ("twice", ["a"], ["b"])]
    target = str(tmp_path / "patches")
    write_patches(spark.createDataFrame(pairs, "name string, old array<string>, new array<string>").repartition(3), target)
    got = sorted(repr(tuple(r)[1:]) for r in read_patches(spark, target, part_bytes).collect())
    hoped = [row for n, a, b in pairs if n is not None and (t := patch_text(n, a or [], b or [])) for row in parse_patch(t)]
    assert got == sorted(map(repr, hoped))


def test_patch_files_without_rows_or_headers(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert read_patches(spark, str(tmp_path / "empty")).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        read_patches(spark, str(tmp_path / "nowhere")).count()
    plain = tmp_path / "plain.patch"
    plain.write_bytes(b"--- a/x\r\n+++ b/x\r\n@@ -1 +1,2 @@\r\n-one\r\n+two\r\n+\xff\r\n")
    for part in (4, 1 << 20):
        files = change_files(read_patches(spark, f"file://{plain}", part)).collect()
        assert [(r["path"], r["additions"], r["deletions"]) for r in files] == [("x", 2, 1)]


def sources_by_hand(edges, sources, hops, kinds):
    near = {}
    for v, s in sources:
        if v is not None and s is not None:
            near[v] = (v, max(s, near.get(v, (v, s))[1]), 0)
    for hop in range(1, hops + 1):
        offers = {}
        for k, a, b in edges:
            if (kinds is None or k in kinds) and None not in (a, b):
                for u, v in ((a, b), (b, a)):
                    if u in near and near[u][2] == hop - 1 and v not in near:
                        offers.setdefault(v, []).append(near[u])
        near |= {v: (*min(((s, x) for s, x, _ in o), key=lambda p: (-p[1], p[0])), hop) for v, o in offers.items()}
    return {(v, *n) for v, n in near.items()}


@pytest.mark.parametrize("seed", range(3))
def test_nearest_sources_and_induced_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.choice("xyz"), rng.randrange(25), rng.randrange(25)) for _ in range(40)] + [("x", None, 3), ("x", 4, 4), ("x", 1, 2), ("x", 1, 2)]
    sources = [(rng.randrange(25), float(rng.randrange(3))) for _ in range(4)] + [(None, 1.0), (24, None), (99, 5.0)]
    frame, seeds = spark.createDataFrame(edges, "kind string, a long, b long"), spark.createDataFrame(sources, "id long, score double")
    for hops, kinds in ((0, None), (2, ["x", "y"]), (9, None)):
        near = nearest_sources(frame, seeds, hops, kinds)
        hoped = sources_by_hand(edges, sources, hops, kinds)
        assert {tuple(r) for r in near.select("id", "source", "score", "hops").collect()} == hoped
    few = best_of(near, ["hops", F.desc("score"), "id"], 6)
    kept = {v for v, *_ in sorted(hoped, key=lambda r: (r[3], -r[2], r[0]))[:6]}
    assert {r["id"] for r in few.collect()} == kept
    for small in (True, False):
        assert sorted(tuple(r) for r in induced(frame, few, small).collect()) == sorted(e for e in edges if e[1] in kept and e[2] in kept)


def test_no_sources(spark):
    none = spark.createDataFrame([], "id long, score double")
    assert nearest_sources(spark.createDataFrame([("x", 1, 2)], "kind string, a long, b long"), none, 3).count() == 0
