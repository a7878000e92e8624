"""Token-ID output (operator 7): Arrow files whose batches hold fixed-size lists of ids and masks.

Documents are range partitioned and sorted by id; each task cuts its stream of ids (each document's, then the end id) into
rows of ``row_length`` ids and writes them as Arrow file batches, the last row padded and masked. A row's place in a file
follows from its number, so a reader maps the file and slices any sequence without copying. Ids take two bytes where the
vocabulary has no more than 65,536, else four; a mask takes a bit for each id. Beside each file lies an index of its documents. Only file names and counts return to Spark; a prefix sum over files gives every document its global start.

Cases: null texts are empty (they still hold the end id); equal ids are ordered by text; an empty table gives no file and no
row; other columns are ignored. A task that runs again writes a new file; names of files come from the task that succeeded.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import local_or_remote, materialise, scratch_dir, table, text_of
from .tokens import END_ID, encoder, slices, vocabulary_path

ROW_LENGTH = 2048
#: Rows of a batch (about 2 MB of ids), and ids after which a task begins another file (256 MB).
BATCH_ROWS = 256
FILE_IDS = 64_000_000
FILES = "shard int, part int, path string, n_docs long, n_ids long"
DOCS = "shard int, part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def file_schema(row_length: int, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.field("item", id_type, False), row_length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), row_length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class _File:
    """One data file and its index, written batch by batch."""

    def __init__(self, folder: str, stem: str, row_length: int, vocabulary_size: int):
        self.fs, inner = local_or_remote(folder)
        self.fs.create_dir(inner, recursive=True)
        self.path, self.inner, self.row = f"{folder}/{stem}.arrow", f"{inner}/{stem}.arrow", row_length
        self.kind = np.dtype("<u2" if vocabulary_size <= 1 << 16 else "<u4")
        self.schema = file_schema(row_length, pa.from_numpy_dtype(self.kind))
        self.sink = self.fs.open_output_stream(self.inner)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.buffer, self.ids, self.docs = bytearray(), 0, []

    def add(self, doc_id: int, ids: bytes) -> None:
        self.docs.append((doc_id, self.ids, len(ids) // 4))
        self.ids += len(ids) // 4
        self.buffer += np.frombuffer(ids, "<u4").astype(self.kind).tobytes()
        step = BATCH_ROWS * self.row * self.kind.itemsize
        while len(self.buffer) >= step:
            self._batch(bytes(self.buffer[:step]))
            del self.buffer[:step]

    def _batch(self, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        rows = -(-n // self.row)
        padded = np.zeros(rows * self.row, self.kind)
        padded[:n] = np.frombuffer(ids, self.kind)
        mask = np.arange(rows * self.row) < n
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=kind.type) for x, kind in zip((padded, mask), self.schema, strict=True)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> dict:
        if self.buffer:
            self._batch(bytes(self.buffer))
        self.writer.close()
        self.sink.close()
        with self.fs.open_output_stream(f"{self.inner}.index") as sink, pa.ipc.new_file(sink, INDEX) as writer:
            columns = list(zip(*self.docs, strict=True)) or [(), (), ()]
            writer.write_table(pa.table([pa.array(c, pa.int64()) for c in columns], schema=INDEX), max_chunksize=65_536)
        return {"path": self.path, "n_docs": len(self.docs), "n_ids": self.ids}


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, row_length: int = ROW_LENGTH) -> DataFrame:
    """Write the documents' ids in ascending doc_id order below ``folder``; one row per file, in that order by shard, part."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        known, end = encoder(vocabulary), np.array([END_ID], "<u4").tobytes()
        encode, kinds_of_ids = known.encode, known.tokenizer.get_vocab_size()
        file, part, done = None, 0, []
        for batch in slices(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if file is not None and file.ids >= FILE_IDS:
                    done.append(file.close() | {"shard": shard, "part": part})
                    file, part = None, part + 1
                file = file or _File(folder, f"{shard:06d}-{part:04d}-{uuid.uuid4().hex}", row_length, kinds_of_ids)
                file.add(doc_id, encode(text) + end)
        if file is not None:
            done.append(file.close() | {"shard": shard, "part": part})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select("doc_id", text_of().alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(ordered.mapInArrow(write, FILES))


class TokenFile:
    """A written file, mapped: ``slices(i)`` gives a sequence and its mask as Arrow slices of the map, ``row(i)`` as numpy arrays
    (the mask's bits unpacked), ``pieces`` a stretch of ids as slices of the map."""

    def __init__(self, path: str):
        fs, inner = local_or_remote(path)
        local = hasattr(fs, "type_name") and fs.type_name == "local"
        opened = pa.memory_map(inner) if local else fs.open_input_file(inner)
        self.reader = pa.ipc.open_file(opened)
        self.row_length = self.reader.schema.field("input_ids").type.list_size
        with fs.open_input_file(f"{inner}.index") as source:
            self.index = pa.ipc.open_file(source).read_all()
        self._batch = (-1, None)

    def _ids(self, number: int) -> np.ndarray:
        if self._batch[0] != number:
            self._batch = number, self.reader.get_batch(number)
        return self._batch[1].column(0).flatten().to_numpy(zero_copy_only=True)

    def slices(self, i: int) -> tuple[pa.Array, pa.Array]:
        batch = self.reader.get_batch(i // BATCH_ROWS)
        return tuple(c.flatten().slice((i % BATCH_ROWS) * self.row_length, self.row_length) for c in batch.columns)

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.slices(i)
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def pieces(self, start: int, length: int) -> Iterator[np.ndarray]:
        step = BATCH_ROWS * self.row_length
        while length:
            number, at = divmod(start, step)
            n = min(length, step - at)
            yield self._ids(number)[at : at + n]
            start, length = start + n, length - n

    def documents(self) -> Iterator[tuple[int, int, int]]:
        yield from zip(*(c.to_pylist() for c in self.index.columns), strict=True)


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document, from the files alone: place in its file, number of ids, crc32 of the ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, part, path in zip(*(batch.column(c).to_pylist() for c in ("shard", "part", "path")), strict=True):
                file = TokenFile(path)
                found = []
                for doc_id, start, n in file.documents():
                    crc = 0
                    for piece in file.pieces(start, n):
                        crc = zlib.crc32(piece.astype("<u4").view("u1"), crc)
                    found.append((doc_id, start, n, crc & 0xFFFFFFFF))
                names = ["shard", "part", "doc_id", "local_start", "n_tokens", "ids_crc32"]
                kinds = [pa.int32(), pa.int32()] + [pa.int64()] * 4
                columns = [(shard,) * len(found), (part,) * len(found), *zip(*found, strict=True)] if found else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    spread = files.select("shard", "part", "path").repartition(max(1, min(files.count(), 10_000)), "path")
    return spread.mapInArrow(read, DOCS)


def token_index(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; start counts the ids of all before it."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("file_start"))
    docs = read_token_files(files).join(starts, ["shard", "part"])
    return docs.select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark) + "-tokens"
    return token_index(write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary_path()))
