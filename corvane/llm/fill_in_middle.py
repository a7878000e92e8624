"""Fill-in-the-middle transformation (operator 12): documents as piece tables over immutable buffers.

A batch of documents has two buffers that never change: its texts end to end, and the sentinels. A document is a list of
descriptors (start, size) into them. Cutting at line ends splits its one descriptor in prefix, middle and suffix; a form is an
arrangement of those three and the three sentinels; the arrangement's inverse puts them back. Hashes read the descriptors'
bytes one after another, so that neither output nor restored text need exist as a whole.

Where a document is cut, and its form, follow from a hash of seed and doc_id alone, so reruns and repeated rows agree.

Cases: a null text is empty, and empty texts are plain, as are those that contain a sentinel; a text without a line end is one
unit; a null doc_id hashes as no digits; very long texts are one slice of a batch, held by its task once; repeated rows are
transformed one by one; an empty table gives no rows; columns of other names are kept or ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table, text_of
from .hashing import text_bytes
from .tokens import slices

#: Sentinels of prefix, suffix and middle; the seed; the share of documents transformed, and of those in form spm.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_SHARE = 7, 100, 50
#: Places of a document's descriptors: its three parts, then the sentinels as listed.
PREFIX, MIDDLE, SUFFIX, P, S, M = range(6)
ARRANGEMENTS = {"psm": (P, PREFIX, S, SUFFIX, M, MIDDLE), "spm": (S, SUFFIX, P, PREFIX, M, MIDDLE)}
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


class PieceTable:
    """The documents of a batch as descriptors: arrays ``start`` and ``size`` with a row per document.

    The first buffer holds the texts, and the sentinels follow it as if they stood at its end.
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.data, self.start, self.size = data, start, size

    @classmethod
    def of_texts(cls, texts: pa.Array) -> PieceTable:
        """Each document as one descriptor of its whole text."""
        data, offsets = text_bytes(texts)
        return cls(data, offsets[:-1, None], np.diff(offsets)[:, None])

    def cut(self, first: np.ndarray, last: np.ndarray) -> PieceTable:
        """Each document's one descriptor split at two places of the buffer, the sentinels' descriptors beside the parts."""
        begin, end = self.start[:, 0], self.start[:, 0] + self.size[:, 0]
        sizes = [len(s) for s in SENTINELS]
        at = len(self.data) + np.cumsum([0, *sizes[:-1]])
        start = np.column_stack([begin, first, last, *(np.full(len(begin), a) for a in at)])
        size = np.column_stack([first - begin, last - first, end - last, *(np.full(len(begin), n) for n in sizes)])
        return PieceTable(self.data, start, size)

    def take(self, rows: np.ndarray, order: tuple[int, ...] | np.ndarray) -> PieceTable:
        """Some documents, their descriptors in another order."""
        return PieceTable(self.data, self.start[rows][:, order], self.size[rows][:, order])

    def arrange(self, rows: np.ndarray, form: str) -> PieceTable:
        return self.take(rows, ARRANGEMENTS[form])

    def restore(self, form: str) -> PieceTable:
        """Arranged documents with their parts in the text's order again, without sentinels: the inverse permutation."""
        inverse = np.argsort(ARRANGEMENTS[form])
        return self.take(np.arange(len(self.start)), inverse[[PREFIX, MIDDLE, SUFFIX]])

    def pieces(self) -> Iterator[list[memoryview]]:
        """The bytes of each document's descriptors, in order, without copying them."""
        texts, signs, end = memoryview(np.ascontiguousarray(self.data)), memoryview("".join(SENTINELS).encode()), len(self.data)
        for starts, sizes in zip(self.start.tolist(), self.size.tolist()):
            yield [texts[a : a + n] if a + n <= end else signs[a - end : a - end + n] for a, n in zip(starts, sizes) if n]

    def hashes(self) -> list[str]:
        out = []
        for pieces in self.pieces():
            h = hashlib.sha256()
            for piece in pieces:
                h.update(piece)
            out.append(h.hexdigest())
        return out

    def texts(self) -> list[str]:
        return [b"".join(pieces).decode() for pieces in self.pieces()]


def draws(doc_ids: list, seed: int = SEED) -> np.ndarray:
    """The first four 32-bit numbers of each document's hash."""
    keys = (f"{seed}:{'' if i is None else i}".encode() for i in doc_ids)
    return np.array([struct.unpack(">4I", hashlib.sha256(k).digest()[:16]) for k in keys], np.int64).reshape(-1, 4)


def line_units(whole: PieceTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each document's lines, where all lines of the buffer end, and the number of its first such end."""
    ends = np.flatnonzero(whole.data == 10) + 1
    begin, stop = whole.start[:, 0], whole.start[:, 0] + whole.size[:, 0]
    first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, stop, "right")
    open_line = np.zeros(len(begin), bool)
    filled = np.flatnonzero(stop > begin)
    open_line[filled] = whole.data[stop[filled] - 1] != 10
    return last - first + open_line, ends, first


def transform_batch(doc_ids: pa.Array, texts: pa.Array, seed: int, rate: int, spm_share: int, with_text: bool) -> list[pa.Array]:
    whole = PieceTable.of_texts(texts)
    begin, stop = whole.start[:, 0], whole.start[:, 0] + whole.size[:, 0]
    n, ends, first = line_units(whole)
    h = draws(doc_ids.to_pylist(), seed)
    cuts = h[:, :2] % (n[:, None] + 1)

    def place(k: np.ndarray) -> np.ndarray:
        """Where the k-th unit of each document ends."""
        inner = np.minimum(first + k - 1, max(len(ends) - 1, 0))
        at = np.minimum(ends[inner] if len(ends) else stop, stop)
        return np.where(k == 0, begin, np.where(k == n, stop, at))

    has_sentinel = np.zeros(len(n), bool)
    for s in SENTINELS:
        has_sentinel |= np.asarray(pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False), bool)
    plain = (stop == begin) | has_sentinel | (h[:, 2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_share, "spm", "psm"))
    cut = whole.cut(place(cuts.min(axis=1)), place(cuts.max(axis=1)))
    points = np.concatenate([[0], np.cumsum((whole.data & 0xC0) != 0x80)])
    chars = points[cut.start[:, :3] + cut.size[:, :3]] - points[cut.start[:, :3]]

    output, restored, text = (np.empty(len(n), object) for _ in range(3))
    for name in ("plain", *ARRANGEMENTS):
        rows = np.flatnonzero(form == name)
        made = whole.take(rows, (0,)) if name == "plain" else cut.arrange(rows, name)
        back = made if name == "plain" else made.restore(name)
        output[rows], restored[rows] = made.hashes(), back.hashes()
        if with_text:
            text[rows] = made.texts()
    columns = [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), pa.array(chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 1], pa.int64(), mask=plain)]
    columns += [pa.array(output, pa.string()), pa.array(restored, pa.string())]
    return columns + ([pa.array(text, pa.string())] if with_text else [])


def fill_in_middle(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE, with_text: bool = True) -> DataFrame:
    """Beside the columns kept, in one struct ``row``: n, form, prefix_chars, middle_chars, the hashes of output and restored text, and the ``output``.

    ``rate`` of 100 documents are transformed, and ``spm_share`` of 100 of those are in form spm. Rows stay where they lie.
    """

    def run(batches):
        for batch in slices(batches, "_text"):
            made = transform_batch(batch.column("_id"), batch.column("_text"), seed, rate, spm_share, with_text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), *made], ["row", *names])

    names = [f.split()[0] for f in FIELDS.split(", ")] + (["output"] if with_text else [])
    rows = docs.select(F.struct(*keep).alias("row"), F.col(doc_id).alias("_id"), text_of(text).alias("_text"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {FIELDS}" + (", output string" if with_text else ""))


def restore_texts(made: DataFrame) -> DataFrame:
    """Adds ``restored``, the text that an ``output`` was made from, read from the output and its form alone."""
    parts = F.split("output", "|".join(SENTINELS), -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return made.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"), ["doc_id"], with_text=False)
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  u AS (SELECT *, regexp_extract_all(t, '[^\\n]*\\n|[^\\n]+') AS units, list_transform(range(4), lambda i: CAST('0x' || h[8 * i + 1:8 * i + 8] AS UBIGINT)) AS g FROM d),
  c AS (SELECT *, CAST(least(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) AS INTEGER) AS a, CAST(greatest(g[1] % (len(units) + 1), g[2] % (len(units) + 1)) AS INTEGER) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= {RATE} THEN 'plain' WHEN g[4] % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM u),
  p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(len(units) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
