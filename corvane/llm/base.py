"""What the operators of this subpackage share: word splitting, scratch tables, table readers."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.scratch import materialise, scratch_dir

__all__ = ["SPACES", "SPACE_CLASS", "local_or_remote", "materialise", "row_text", "scratch_dir", "table", "text_of", "words_of"]

#: White space that separates words, as a Java character class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column = "text") -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_text(row: str = "_row") -> Column:
    """A row in a struct as text, to order rows by that have columns without an order, such as maps."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text as an array; empty for a text without words."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE_CLASS}]+", -1))


def local_or_remote(path: str):
    """A pyarrow file system and the path in it, for tasks that write or read files in the shared folder."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path.split(":", 1)[1].lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)
