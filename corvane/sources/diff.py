"""Unified diffs as tables: files, hunks and numbered lines, from whole patch texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES = "patch string, path string, old_path string, status string, hunk int, pos int, kind string, old_no int, new_no int, text string"
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_ESCAPE = re.compile(rb"\\([0-7]{3}|.)", re.S)
#: What follows a backslash in a quoted path, besides itself and octal numbers.
_LETTERS = {b"n": b"\n", b"t": b"\t", b"r": b"\r", b"a": b"\a", b"b": b"\b", b"f": b"\f", b"v": b"\v"}


def _name(raw: str) -> str | None:
    """A path as a diff has it: quoted ones with their bytes in octal, the rest up to a tab, without the sides' prefixes."""
    if raw.startswith('"') and raw.rstrip().endswith('"') and len(raw.rstrip()) > 1:
        inner = raw.rstrip()[1:-1].encode()
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if len(m[1]) == 3 else _LETTERS.get(m[1], m[1]), inner).decode("utf-8", "replace")
    else:
        raw = raw.split("\t")[0].strip()
    return None if raw == "/dev/null" else re.sub(r"^[ab]/", "", raw)


@dataclass
class _File:
    """What a file's header lines have said so far."""

    old: str | None = None
    new: str | None = None
    renamed: str | None = None
    copied: str | None = None
    made: bool = False
    gone: bool = False
    hunk: int = -1
    named: bool = False  # by --- and +++ lines

    def head(self) -> tuple:
        if self.renamed is not None or self.copied is not None:
            return self.new, self.renamed if self.renamed is not None else self.copied, "renamed" if self.renamed is not None else "copied"
        status = "added" if self.made or (self.named and self.old is None) else "deleted" if self.gone or (self.named and self.new is None) else "modified"
        return self.new if self.new is not None else self.old, None, status


def _both_names(rest: str) -> tuple[str | None, str | None]:
    """The two paths of a ``diff --git`` line: quoted, or alike on both sides, or parted at the last " b/"."""
    quoted = re.fullmatch(r'("(?:[^"\\]|\\.)*"|\S+) ("(?:[^"\\]|\\.)*"|\S+)', rest)
    if quoted:
        return _name(quoted[1]), _name(quoted[2])
    half = len(rest) // 2
    if rest[half : half + 1] == " " and _name(rest[:half]) == _name(rest[half + 1 :]):
        return _name(rest[:half]), _name(rest[half + 1 :])
    before, _, after = rest.rpartition(" b/")
    return _name(before), after


def parse_patch(text: str) -> Iterator[tuple]:
    """What ``parse_lines`` gives for the lines of a whole patch."""
    yield from parse_lines(text.replace("\r\n", "\n").split("\n"))


def parse_lines(lines: Iterable[str]) -> Iterator[tuple]:
    """(path, old_path, status, hunk, pos, kind, old_no, new_no, text) of every line in a patch; counters end each hunk.

    A file without hunks (renamed alone, another mode, binary) has one row of kind ``none``, without a hunk.
    """
    file: _File | None = None
    pos = left_old = left_new = at_old = at_new = 0

    def ended() -> Iterator[tuple]:
        if file is not None and file.hunk < 0 and file.head()[0] is not None:
            yield *file.head(), None, None, "none", None, None, None

    for line in lines:
        if left_old > 0 or left_new > 0:
            sign, body = line[:1], line[1:]
            if sign == "\\":
                continue
            kind = {"+": "add", "-": "del"}.get(sign, "context")
            yield *file.head(), file.hunk, pos, kind, at_old if kind != "add" else None, at_new if kind != "del" else None, body
            pos += 1
            if kind != "add":
                at_old, left_old = at_old + 1, left_old - 1
            if kind != "del":
                at_new, left_new = at_new + 1, left_new - 1
        elif line.startswith("diff --git "):
            yield from ended()
            file = _File(*_both_names(line[11:]))
        elif line.startswith("--- "):
            if file is None or file.named:
                yield from ended()
                file = _File()
            file.old, file.named = _name(line[4:]), True
        elif file is None:
            continue
        elif line.startswith("+++ "):
            file.new, file.named = _name(line[4:]), True
        elif line.startswith("rename from "):
            file.renamed = _name(line[12:])
        elif line.startswith("copy from "):
            file.copied = _name(line[10:])
        elif line.startswith(("rename to ", "copy to ")):
            file.new = _name(line.split(" to ", 1)[1])
        elif line.startswith("new file mode"):
            file.made = True
        elif line.startswith("deleted file mode"):
            file.gone = True
        elif m := _HUNK.match(line):
            file.hunk, pos = file.hunk + 1, 0
            at_old, at_new = int(m[1]), int(m[3])
            left_old, left_new = int(m[2] or 1), int(m[4] or 1)
    yield from ended()


def diff_lines(patches: DataFrame) -> DataFrame:
    """From ``patch, text``: one row per line of every hunk."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in LINES.split(", ")]
        for frame in batches:
            rows = [(p, *x) for p, t in zip(frame["patch"], frame["text"], strict=True) for x in parse_patch(t or "")]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"old_no": "Int32", "new_no": "Int32", "hunk": "Int32", "pos": "Int32"})

    return patches.select("patch", "text").mapInPandas(run, LINES)


def change_files(lines: DataFrame) -> DataFrame:
    """One row per changed file: status, additions, deletions, and whether each hunk changes white space only."""
    squeezed = F.regexp_replace("text", r"(?U)\s+", "")
    side = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", squeezed.alias("t"))))), lambda x: x["t"]), "")
    hunks = lines.groupBy("patch", "path", "old_path", "status", "hunk").agg(F.count_if(F.col("kind") == "add").alias("a"), F.count_if(F.col("kind") == "del").alias("d"), (F.col("hunk").isNotNull() & (side("del") == side("add"))).alias("white"))
    return hunks.groupBy("patch", "path", "old_path", "status").agg(F.sum("a").alias("additions"), F.sum("d").alias("deletions"), F.bool_and("white").alias("whitespace_only"))
