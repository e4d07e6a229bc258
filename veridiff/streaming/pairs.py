"""Streaming forms of keyed comparison: an addition of this library, for sides that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.alignments import blocks, concordant, qualifying


def concordant_reads(ref: DataFrame, cand: DataFrame, time: str, delay: str = "10 minutes", min_mapq: int = 20, overlap: float = 0.95) -> DataFrame:
    """Stream-stream join of reads on (name, mate); state older than the delay is dropped by watermark.

    Both sides carry an event time; a pair is compared once both reads have come.
    """
    cols = ("flag", "rname", "mapq", "blocks")

    def side(df: DataFrame, p: str) -> DataFrame:
        q = qualifying(df, min_mapq).withColumn("blocks", blocks(df)).withWatermark(time, delay)
        return q.select(F.col("qname").alias("q" + p), F.col("is_read2").alias("m" + p), F.col(time).alias("t" + p), *(F.col(c).alias(c + p) for c in cols))

    near = f"t2 between t1 - interval {delay} and t1 + interval {delay}"
    j = side(ref, "1").join(side(cand, "2"), (F.col("q1") == F.col("q2")) & (F.col("m1") == F.col("m2")) & F.expr(near))
    return j.select(F.col("q1").alias("qname"), F.col("m1").alias("is_read2"), F.greatest("t1", "t2").alias(time), concordant(overlap, min_mapq).alias("concordant"))


def windowed_scores(results: DataFrame, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Mean similarity of scored results by window."""
    scored = results.where("status in ('success', 'invalid')").withWatermark(time, delay)
    return scored.groupBy(F.window(time, window)).agg(F.avg("similarity").alias("avg_similarity"), F.count("*").alias("n"))
