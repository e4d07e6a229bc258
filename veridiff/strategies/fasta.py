"""Sequence and read strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import dist as D
from ..operators import sequences as S


def _fold(df: DataFrame, ignore_case: bool) -> DataFrame:
    return df.withColumn("seq", F.upper("seq")) if ignore_case else df


def exact(ref: DataFrame, cand: DataFrame, by_name: bool = False, ignore_case: bool = True) -> DataFrame:
    """Matches over reference records: by name, ids of equal sequence; by content, the multiset intersection."""
    ref, cand = _fold(ref, ignore_case), _fold(cand, ignore_case)
    if by_name:
        a, b = S.last_by_id(ref).select("id", "seq"), S.last_by_id(cand).select("id", "seq")
        hits, n = a.join(b, ["id", "seq"]).agg(F.count("*").alias("n_match")), a
    else:
        c = D.two_sided(ref, cand, F.col("seq"))
        hits, n = c.agg(F.coalesce(F.sum(F.least("p", "q")), F.lit(0)).alias("n_match")), ref
    n = n.agg(F.count("*").alias("n_ref"))
    return n.crossJoin(hits).select(F.when(F.col("n_ref") > 0, F.col("n_match") / F.col("n_ref")).otherwise(0.0).alias("similarity"), "n_ref", "n_match")


def summary(ref: DataFrame, cand: DataFrame, k: int = 11, num_bins: int = 10, ignore_case: bool = True) -> DataFrame:
    """Mean of four parts: number, total length, length histogram, k-mers."""
    a, b = S.last_by_id(_fold(ref, ignore_case)), S.last_by_id(_fold(cand, ignore_case))
    n = F.length("seq")
    s = a.agg(F.count("*").alias("n1"), F.sum(n).alias("t1")).crossJoin(b.agg(F.count("*").alias("n2"), F.sum(n).alias("t2")))
    lengths = D.histogram_similarity(a.withColumn("n", n), b.withColumn("n", n), "n", num_bins).toDF("length_similarity")
    kmer = S.kmer_similarity(a, b, k).toDF("kmer_similarity")
    s = s.select(K.rae_similarity(F.col("n1"), F.col("n2")).alias("count_similarity"), K.rae_similarity(F.col("t1"), F.col("t2")).alias("total_similarity"))
    s = s.crossJoin(lengths).crossJoin(kmer)
    parts = [F.col(c) for c in ("count_similarity", "total_similarity", "length_similarity", "kmer_similarity")]
    return s.select((sum(parts, F.lit(0.0)) / 4).alias("similarity"), *parts)


def reads_exact(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Ids of equal sequence and quality over reference reads."""
    a, b = S.last_by_id(ref), S.last_by_id(cand)
    hits = a.select("id", "seq", "qual").join(b.select("id", F.col("seq").alias("s2"), F.col("qual").alias("q2")), "id").where("seq = s2 and qual = q2").agg(F.count("*").alias("n_match"))
    return a.agg(F.count("*").alias("n_ref")).crossJoin(hits).select(F.when(F.col("n_ref") > 0, F.col("n_match") / F.col("n_ref")).otherwise(0.0).alias("similarity"), "n_ref", "n_match")


def reads_approximate(ref: DataFrame, cand: DataFrame, trim_tolerance: int = 2, quality_tolerance: int = 2) -> DataFrame:
    a, b = S.last_by_id(ref), S.last_by_id(cand)
    j = a.select("id", "seq", "qual").join(b.select("id", F.col("seq").alias("s2"), F.col("qual").alias("q2")), "id")
    # the cheap test first: qualities must agree in any case
    hits = j.where(S.quality_close(F.col("qual"), F.col("q2"), quality_tolerance)).where(S.trimmed_equal(F.col("seq"), F.col("s2"), trim_tolerance)).agg(F.count("*").alias("n_match"))
    return a.agg(F.count("*").alias("n_ref")).crossJoin(hits).select(F.when(F.col("n_ref") > 0, F.col("n_match") / F.col("n_ref")).otherwise(0.0).alias("similarity"), "n_ref", "n_match")
