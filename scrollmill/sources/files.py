"""Files as tables: Markdown folders, framed messages, clipboard items."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_populated, looks_like_markdown
from .store import exists

FRAME_LIMIT = 512 << 20


#: Files up to this number are opened by name; for more the folder is read, and what is not wanted is left out.
BY_NAME = 1000


def _markdown(spark: SparkSession, folder: str, recursive: bool) -> DataFrame | None:
    if not exists(spark, folder):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.[mM][dD]").load(folder)
    return files.where(~F.substring_index("path", folder.rstrip("/"), -1).rlike(r"/\."))


def _stated(files: DataFrame) -> DataFrame:
    return files.withColumns({"mtime": F.unix_micros("modificationTime") / 1e6, "byte_size": F.col("length")})


def _decoded(files: DataFrame) -> DataFrame:
    good = F.is_valid_utf8(F.col("content").cast("string"))
    return _stated(files).select("path", "mtime", "byte_size", F.when(good, F.col("content").cast("string")).alias("content"), (~good).alias("failed"))


def markdown_folder(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, mtime, byte_size, content, failed) of the .md files; hidden ones are left out, a missing folder is empty.

    content is null and failed true where the bytes are not UTF-8.
    """
    files = _markdown(spark, folder, recursive)
    return spark.createDataFrame([], "path string, mtime double, byte_size long, content string, failed boolean") if files is None else _decoded(files)


def listing(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame | None:
    """(path, mtime, byte_size) of the .md files, none of which is opened; None if the folder is missing."""
    files = _markdown(spark, folder, recursive)
    return None if files is None else _stated(files).select("path", "mtime", "byte_size")


def read_files(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``markdown_folder`` of the files in wanted(path). Few are opened by name, so a pass with few changes reads few files."""
    few = [r["path"] for r in wanted.select("path").limit(BY_NAME + 1).collect()]
    if not few:
        return spark.createDataFrame([], "path string, mtime double, byte_size long, content string, failed boolean")
    if len(few) <= BY_NAME:
        return _decoded(spark.read.format("binaryFile").load(few))
    return _decoded(_markdown(spark, folder, True).join(wanted.select("path"), "path", "left_semi"))


def frames(files: DataFrame) -> DataFrame:
    """(path, frame_no, message, error) from ``files(path, content binary)``: 4-byte little-endian lengths and JSON.

    A length of 0 or beyond the limit, or a frame cut short, ends a file with an error row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                at = number = 0
                while at < len(data):
                    n = struct.unpack_from("<I", data, at)[0] if at + 4 <= len(data) else -1
                    if n == 0 or n > FRAME_LIMIT or n < 0 or at + 4 + n > len(data):
                        out.append((path, number, None, "empty" if n == 0 else "too long" if n > FRAME_LIMIT else "cut short"))
                        break
                    out.append((path, number, bytes(data[at + 4 : at + 4 + n]).decode("utf-8", "replace"), None))
                    at, number = at + 4 + n, number + 1
            yield pd.DataFrame(out, columns=["path", "frame_no", "message", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, frame_no long, message string, error string")


def frame(json: Column) -> Column:
    """A message with its length in front."""
    n = F.octet_length(json)
    little = F.concat(*(F.substring(F.hex(F.pmod(F.floor(n / 256**k), F.lit(256)) + 256), 2, 2) for k in range(4)))
    return F.concat(F.unhex(little), F.encode(json, "UTF-8"))


def richest(plain: Column, html_markdown: Column, rtf_markdown: Column) -> Column:
    """Of a clipboard item: plain text if it is Markdown already, else converted HTML, else converted RTF, else the plain text."""
    pick = lambda c: F.when(is_populated(c), c)
    return F.coalesce(F.when(is_populated(plain) & looks_like_markdown(plain), plain), pick(html_markdown), pick(rtf_markdown), pick(plain))
