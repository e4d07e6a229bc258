"""Numbered lines of text files, plain or compressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, _row, value): lines with their number from 0.

    A line's number is the count of lines in earlier blocks of its file plus its place in its own block, so a file of many
    blocks is numbered without passing through one task; only the block counts are summed in order.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select("file", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(F.broadcast(starts), ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("_row"), F.regexp_replace("value", "\r$", "").alias("value"))


#: Files up to this many bytes are read whole on the executors where only their head is wanted; of larger ones only the head
#: is read, through the file system of the driver.
WHOLE = 16 << 20


def open_file(spark: SparkSession, path: str):
    """A stream of the driver's file system, for whatever store Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)


def first_bytes(spark: SparkSession, path: str, n: int, at: int = 0) -> bytes:
    """At most n bytes of a file from a position on; nothing else of it is read."""
    stream = open_file(spark, path)
    try:
        if at:
            stream.seek(at)
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def heads(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(path, length, head): the first n bytes of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # the length is filtered before contents are read
    small = files.where(F.col("length") <= WHOLE).select("path", "length", F.substring("content", 1, n).alias("head"))
    large = [(r["path"], r["length"]) for r in files.where(F.col("length") > WHOLE).select("path", "length").collect()]
    if not large:
        return small
    rows = [(p, length, bytearray(first_bytes(spark, p, n))) for p, length in large]
    return small.unionByName(spark.createDataFrame(rows, "path string, length long, head binary"))


def head(spark: SparkSession, path: str, n: int = 30, size: int = 1 << 18) -> list[str]:
    """The first n raw lines, plain or compressed, from the first ``size`` bytes."""
    from .detect import compression, expand

    raw = first_bytes(spark, path, size)
    text = expand(raw, compression(raw)).decode("utf-8", "replace")
    return [x.rstrip("\r") for x in text.removesuffix("\n").split("\n")[:n]] if text else []


def sample(spark: SparkSession, path: str, max_chars: int = 1000) -> DataFrame:
    """(path, text) of each file: its beginning, with a mark where it was cut."""
    text = F.decode("head", "UTF-8")
    rows = heads(spark, path, 4 * max_chars + 4)
    cut = F.concat(F.substring(text, 1, max_chars), F.lit("... [truncated]"))
    return rows.select("path", F.when((F.length(text) > max_chars) | (F.col("length") > F.length("head")), cut).otherwise(text).alias("text"))


def preview(df: DataFrame, n: int = 5) -> dict:
    """Shape, columns and first rows of a table."""
    return {"shape": (df.count(), len(df.columns)), "columns": df.columns, "head": [tuple(r) for r in df.limit(n).collect()]}


def listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, length) of the files below a folder; contents are not read."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(path).select("path", "length")
