"""File sources: listings, plain and delimited text, JSON, and the registry of parsers."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html as H

Parser = Callable[[DataFrame], DataFrame]


def object_listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, last_modified, size) of every file below a folder; empty names are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("modificationTime").alias("last_modified"), F.col("length").alias("size")).filter(
        ~F.col("path").endswith("/"))


def newer_than(listing: DataFrame, cursor: str | Column) -> DataFrame:
    """Objects modified after the cursor; the stream form is a file source whose checkpoint is the cursor."""
    at = F.lit(cursor).cast(listing.schema["last_modified"].dataType) if isinstance(cursor, str) else cursor
    return listing.filter(F.col("last_modified") > at)


def read_text(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): one row per file."""
    return spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_delimited(spark: SparkSession, folder: str, sep: str = "\t") -> DataFrame:
    """(path, text): one document per file, fields joined by a comma and a blank, rows by line ends.

    Works on the whole file as one value, so rows need no ordering across tasks. Quoted fields keep
    separators and line ends, and a doubled quote stands for one.
    """
    return read_text(spark, folder).withColumn("text", delimited_text(F.col("text"), sep))


def delimited_text(text: Column, sep: str) -> Column:
    s = "\\t" if sep == "\t" else f"\\{sep}"
    # A field: quoted with doubled quotes, or free of separator and line end; then what closes it.
    fields = F.regexp_extract_all(F.regexp_replace(text, "\r\n?", "\n"), F.lit(
        rf'(?s)("(?:[^"]++|"")*+"|[^"{s}\n][^{s}\n]*+|)({s}|\n|$)'), F.lit(0))
    clean = F.transform(fields, lambda f: F.concat(
        F.replace(F.regexp_replace(F.regexp_replace(f, rf"(?s)({s}|\n)$", ""), r'(?s)^"(.*)"$', "$1"), F.lit('""'), F.lit('"')),
        F.when(F.right(f, F.lit(1)) == sep, ", ").when(F.right(f, F.lit(1)) == "\n", "\n").otherwise("")))
    return F.regexp_replace(F.array_join(clean, ""), "\n+$", "")


def read_json(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    """(path, text): JSON documents rendered as text, with all their keys; null where a document can't be parsed.

    Documents may differ in their keys, so they are read as variants: no schema, no pass to infer one.
    """
    rows = spark.read.text(folder, wholetext=not lines, recursiveFileLookup=True)
    return rows.select(F.input_file_name().alias("path"), F.to_json(F.try_parse_json("value")).alias("text"))


def html_parser(policy: str = "lenient") -> Parser:
    return lambda df: df.withColumn("text", H.html_to_text(F.col("text"), policy))


class Parsers:
    """Parsers by file type and functions that add documents after parsing.

    A parser takes the rows of its type (doc_id, doc_type, text, ...) and returns the same columns; binary
    formats plug in with ``mapInPandas``. A post-processor returns extra rows.
    """

    def __init__(self) -> None:
        self._by_type: dict[str, Parser] = {}
        self._extra: list[Parser] = []

    def register(self, doc_type: str, parser: Parser, replace: bool = False) -> None:
        if doc_type in self._by_type and not replace:
            raise ValueError(f"parser already registered: {doc_type}")
        self._by_type[doc_type] = parser

    def unregister(self, doc_type: str) -> None:
        self._by_type.pop(doc_type, None)

    def add_post_processor(self, fn: Parser) -> None:
        self._extra.append(fn)

    def types(self) -> list[str]:
        return sorted(self._by_type)

    def parse(self, df: DataFrame) -> DataFrame:
        """All rows parsed by type (others unchanged), followed by the extra documents."""
        own = [fn(df.filter(F.col("doc_type") == t)) for t, fn in sorted(self._by_type.items())]
        rest = df.filter(~F.col("doc_type").isin(*self._by_type)) if self._by_type else df
        parsed = reduce(DataFrame.unionByName, [*own, rest])
        return reduce(DataFrame.unionByName, [fn(parsed) for fn in self._extra], parsed)
