"""Whole files as rows of decoded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: windows-1252 where it differs from iso-8859-1; undefined bytes become U+FFFD.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = bytes(range(0x80, 0xA0)).decode("cp1252", "replace")


def decode_column(content: Column, encoding: str) -> Column:
    """Bytes to text without a leading byte order mark."""
    if encoding == "windows-1252":
        text = F.translate(F.decode(content, "iso-8859-1"), _C1, _CP1252)
    elif encoding == "iso-8859-1":
        text = F.decode(content, "iso-8859-1")
    else:
        text = content.cast("string")
    return F.regexp_replace(text, "^﻿", "")


def read_inputs(spark: SparkSession, paths: str | list[str], encoding: str = "utf-8") -> DataFrame:
    """(input_name, text) of files; a file is one row, so it is what runs in parallel."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("input_name"), decode_column(F.col("content"), encoding).alias("text"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(input_name, line) of UTF-8 files, split over tasks; for schemas of single lines."""
    return spark.read.text(paths).select(F.col("_metadata.file_name").alias("input_name"), F.col("value").alias("line"))
