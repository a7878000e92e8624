"""Patch files: a Spark data source that reads their lines by parts of files, and patches written from edit scripts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corvane.operators.sequences import edit_script
from corvane.sources.diff import LINES, parse_lines

#: Bytes of a file that one task reads, unless the option ``partBytes`` says otherwise.
PART_BYTES = 32 << 20
#: Fixed value: how the lines of a file's part in a patch begin.
_HEADER = b"diff --git "


@dataclass
class _Part(InputPartition):
    path: str
    start: int
    end: int


def _at(path: str):
    """The file system that holds a path or URI, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def _sections(stream, start: int, end: int) -> Iterator[bytes]:
    """The lines, from the first header at or after ``start`` up to the first at or after ``end``; lines of hunks never look like headers."""
    at = max(0, start - 1)
    stream.seek(at)
    if start:
        at += len(stream.readline())  # the rest of a line that began before
    reading = start == 0
    while line := stream.readline():
        header = line.startswith(_HEADER)
        if header and at >= end:
            return
        if not reading and at >= end:
            return
        reading = reading or header
        at += len(line)
        if reading:
            yield line


class PatchReader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes

    def partitions(self) -> list[_Part]:
        """Parts of at most ``part_bytes``, whatever the files' sizes; hidden files say nothing."""
        from pyarrow import fs

        system, root = _at(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        shown = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))
        return [_Part(path, k, min(size, k + self.part_bytes)) for path, size in shown for k in range(0, size, self.part_bytes)] or [_Part("", 0, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        """A part's rows, read line by line: a task holds one line and what a file's header says."""
        if not partition.path:
            return
        from io import BufferedReader

        system, _ = _at(self.path)
        with system.open_input_file(partition.path) as raw, BufferedReader(raw) as stream:
            lines = (x.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace") for x in _sections(stream, partition.start, partition.end))
            for row in parse_lines(lines):
                yield (partition.path, *row)


class PatchSource(DataSource):
    """``spark.read.format("patches").load(path)``: a row for each line of every hunk in the patch files below a path.

    Files are cut at ``diff --git`` lines and read by many tasks; what has none is read by the task of its first part, right but
    not shared out. Paths are of the file systems that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return "patches"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> PatchReader:
        return PatchReader(self.options["path"], int(self.options.get("partBytes", PART_BYTES)))


def read_patches(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    spark.dataSource.register(PatchSource)
    return spark.read.format("patches").option("partBytes", part_bytes).load(path)


def _quoted(name: str) -> str:
    """A path as patches have it: between quotes, with bytes in octal, where it isn't plain."""
    if name.isascii() and name.isprintable() and not set(name) & set('"\\ '):
        return name
    return '"' + "".join(chr(b) if 32 <= b < 127 and b not in (34, 92) else f"\\{b:03o}" for b in name.encode()) + '"'


def patch_text(name: str, old: list[str], new: list[str], context: int = 3) -> str | None:
    """A patch from one list of lines to another; null where they are the same. An empty list is a file that isn't there."""
    steps = list(edit_script(old, new))
    changed = [k for k, s in enumerate(steps) if s[0] != "same"]
    if not changed:
        return None
    stretches = [[max(0, changed[0] - context), changed[0] + context + 1]]
    for k in changed[1:]:
        if k - context <= stretches[-1][1]:
            stretches[-1][1] = k + context + 1
        else:
            stretches.append([k - context, k + context + 1])
    a, b = _quoted("a/" + name), _quoted("b/" + name)
    said = [f"diff --git {a} {b}"]
    said += ["new file mode 100644"] if not old else ["deleted file mode 100644"] if not new else []
    said += [f"--- {a if old else '/dev/null'}", f"+++ {b if new else '/dev/null'}"]
    at_old = at_new = reached = 0
    for first, last in stretches:
        for step in steps[reached:first]:
            at_old, at_new = at_old + (step[0] != "add"), at_new + (step[0] != "del")
        part = steps[first:last]
        n_old, n_new = sum(s[0] != "add" for s in part), sum(s[0] != "del" for s in part)
        # A side without lines names the line before it.
        said.append(f"@@ -{at_old + (n_old > 0)},{n_old} +{at_new + (n_new > 0)},{n_new} @@")
        said += [{"same": " ", "del": "-", "add": "+"}[s[0]] + s[3] for s in part]
        at_old, at_new, reached = at_old + n_old, at_new + n_new, min(last, len(steps))
    return "\n".join(said)


def write_patches(pairs: DataFrame, path: str, context: int = 3) -> None:
    """Patches of ``name, old, new``, two arrays of lines without line breaks, as text files; null arrays are empty, rows without a name have no patch."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            lists = (([] if x is None else list(x) for x in frame[side]) for side in ("old", "new"))
            texts = [patch_text(n, a, b, context) for n, a, b in zip(frame["name"], *lists, strict=True)]
            yield pd.DataFrame({"value": [t for t in texts if t is not None]}, dtype=object)

    pairs.select("name", "old", "new").filter("name IS NOT NULL").mapInPandas(run, "value string").write.text(path)
