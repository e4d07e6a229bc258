"""Sequence and read operators.  Sequences: id, seq, ord; reads also qual (array of int)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dist as D


def last_by_id(df: DataFrame) -> DataFrame:
    """Sequences by id; of a repeated id the last holds."""
    return df.groupBy("id").agg(*(F.max_by(c, "ord").alias(c) for c in df.columns if c not in ("id", "ord")), F.min("ord").alias("ord"))


def kmers(df: DataFrame, k: int) -> DataFrame:
    """(kmer) row by row; shorter sequences have none."""
    n = F.length("seq")
    return df.where(n >= k).select(F.explode(F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(F.col("seq"), i, F.lit(k)))).alias("kmer"))


def kmer_similarity(ref: DataFrame, cand: DataFrame, k: int) -> DataFrame:
    """1 - Hellinger distance of k-mer counts; 1 when neither side has any, 0 when one has none."""
    c = D.two_sided(kmers(ref, k), kmers(cand, k), F.col("kmer"))
    from ..functions.kernels import hellinger_agg

    p, q = F.coalesce(F.sum("p"), F.lit(0)), F.coalesce(F.sum("q"), F.lit(0))
    return c.agg(F.when((p == 0) & (q == 0), 1.0).when((p == 0) | (q == 0), 0.0).otherwise(1 - hellinger_agg(F.col("p"), F.col("q"))).alias("similarity"))


def length_stats(df: DataFrame) -> DataFrame:
    n = F.length("seq")
    return df.agg(F.count("*").alias("n"), F.sum(n).alias("total"), F.min(n).alias("min"), F.max(n).alias("max"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.percentile(n, 0.25).alias("q25"), F.percentile(n, 0.5).alias("median"), F.percentile(n, 0.75).alias("q75"))


def mean_quality(df: DataFrame) -> DataFrame:
    """Mean over reads of each read's mean quality."""
    each = F.aggregate("qual", F.lit(0).cast("long"), lambda s, x: s + x) / F.size("qual")
    return df.where(F.size("qual") > 0).agg(F.avg(each).alias("mean_quality"))


def trimmed_equal(a: Column, b: Column, tolerance: int) -> Column:
    """Whether the texts agree after cutting up to ``tolerance`` characters off either end of either."""
    n, t = (tolerance + 1) ** 4, tolerance + 1
    cut = lambda s, left, right: F.substr(s, left + 1, F.greatest(F.length(s) - left - right, F.lit(0)))
    i = lambda x, p: F.floor(x / t**p).cast("int") % t
    same = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: cut(a, i(x, 3), i(x, 2)) == cut(b, i(x, 1), i(x, 0)))
    return F.when(F.abs(F.length(a) - F.length(b)) > 2 * tolerance, False).when(a == b, True).otherwise(same)


def quality_close(a: Column, b: Column, tolerance: int) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= tolerance), lambda ok: ok)


def multiline_ids(lines: DataFrame) -> DataFrame:
    """Ids whose record has not exactly one non-blank body line; ``lines``: id, body lines one a row."""
    return lines.groupBy("id").agg(F.sum(F.when(F.trim("line") != "", 1).otherwise(0)).alias("n")).where("n <> 1").select("id")
