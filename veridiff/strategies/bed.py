"""Interval strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import dist as D
from ..operators import intervals as I
from ..operators.tables import spearman


def exact(ref: DataFrame, cand: DataFrame, ignore_order: bool = False) -> DataFrame:
    """1 when the regions agree one by one in order; without order: equal counts and every reference region is touched."""
    n = ref.agg(F.count("*").alias("n_ref")).crossJoin(cand.agg(F.count("*").alias("n_cand")))
    if ignore_order:
        hit = I.touching(ref, cand).agg(F.count("*").alias("n_match"))
    else:
        at = lambda df, p: D.numbered(df, "_k", ["ord"], ("chrom",)).select("chrom", "_k", F.col("ord").alias(p + "ord"), F.col("start").alias(p + "start"), F.col("end").alias(p + "end"))
        # equal places within each chromosome; with equal totals that is equality of the whole sorted sequence
        hit = at(ref, "a").join(at(cand, "b"), ["chrom", "_k"]).where("astart = bstart and aend = bend").agg(F.count("*").alias("n_match"))
    same = (F.col("n_ref") == F.col("n_cand")) & (F.col("n_match") == F.col("n_ref"))
    return n.crossJoin(hit).select(F.when(same, 1.0).otherwise(0.0).alias("similarity"), "n_ref", "n_cand", "n_match")


def approximate(ref: DataFrame, cand: DataFrame, tolerance: int = 0, overlap_threshold: float = 0.95) -> DataFrame:
    """Jaccard of region counts; matched regions are distinct coordinates.  An empty side gives NULL (an error status)."""
    pairs = I.matched(I.overlap_join(ref.select("chrom", "start", "end"), cand.select("chrom", "start", "end"), tolerance=tolerance), overlap_threshold)
    hits = pairs.agg(F.count_distinct("ref_chrom", "ref_start", "ref_end").alias("ref_matched"), F.count_distinct("cand_chrom", "cand_start", "cand_end").alias("cand_matched"))
    n = ref.agg(F.count("*").alias("n_ref")).crossJoin(cand.agg(F.count("*").alias("n_cand"))).crossJoin(hits)
    ok = (F.col("n_ref") > 0) & (F.col("n_cand") > 0)
    value = F.when(ok, K.jaccard(F.col("ref_matched"), F.col("n_ref"), F.col("n_cand")))
    return n.select(value.alias("similarity"), "n_ref", "n_cand", "ref_matched", "cand_matched", K.precision(F.col("cand_matched"), F.col("n_cand")).alias("precision"), K.recall(F.col("ref_matched"), F.col("n_ref")).alias("recall"))


def overlap(ref: DataFrame, cand: DataFrame, clip: bool = False, merge: bool = True) -> DataFrame:
    """Base-level Jaccard of merged sides (without ``merge``, of the regions as they are).  Overlapping bases are the full lengths of touched reference regions; with
    ``clip`` only the shared parts."""
    a, b = (I.merge(ref), I.merge(cand)) if merge else (I.valid(ref), I.valid(cand))
    size = F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))
    n = a.agg(size.alias("ref_bases")).crossJoin(b.agg(size.alias("cand_bases")))
    pairs = I.overlap_join(a, b, 4 * I.typical_width(ref, cand))  # merged intervals are longer than those they hold
    if clip:
        shared = pairs.agg(F.coalesce(F.sum("overlap"), F.lit(0)).alias("shared"))
    elif not merge:  # repeated regions count each
        shared = I.touching(a, b).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("shared"))
    else:
        touched = pairs.groupBy("ref_chrom", "ref_start", "ref_end").agg(F.lit(1))
        shared = touched.agg(F.coalesce(F.sum(F.col("ref_end") - F.col("ref_start")), F.lit(0)).alias("shared"))
    p, r = K.precision(F.col("shared"), F.col("cand_bases")), K.recall(F.col("shared"), F.col("ref_bases"))
    return n.crossJoin(shared).select(K.jaccard(F.col("shared"), F.col("ref_bases"), F.col("cand_bases")).alias("similarity"), "ref_bases", "cand_bases", "shared", p.alias("precision"), r.alias("recall"), K.f1(p, r).alias("f1"))


def correlation(ref: DataFrame, cand: DataFrame, overlap_threshold: float = 0.95, method: str = "pearson") -> DataFrame:
    """|correlation| of scores over matched pairs, times pairs / larger side; constant scores fall back to relative error."""
    pairs = I.matched(I.overlap_join(ref, cand), overlap_threshold).where("ref_score is not null and cand_score is not null")
    x, y = K.dbl("ref_score"), K.dbl("cand_score")
    m = pairs.agg(F.count("*").alias("n_pairs"), (F.corr(x, y) if method == "pearson" else F.lit(None)).alias("correlation"), F.avg(K.rae_similarity(x, y)).alias("rae"))
    if method == "spearman":
        m = m.drop("correlation").crossJoin(spearman(pairs, "ref_score", "cand_score").toDF("correlation"))
    n = ref.agg(F.count("*").alias("n_ref")).crossJoin(cand.agg(F.count("*").alias("n_cand"))).crossJoin(m)
    r = K.nan_to_null(F.col("correlation"))
    coverage = F.col("n_pairs") / F.greatest("n_ref", "n_cand")
    value = F.when(F.col("n_pairs") < 2, 0.0).otherwise(F.coalesce(F.abs(r), F.col("rae")) * coverage)
    return n.select(value.alias("similarity"), r.alias("correlation"), coverage.alias("coverage"), "n_pairs")


def summary(ref: DataFrame, cand: DataFrame, num_bins: int = 50) -> DataFrame:
    """1 - Hellinger distance of region lengths; counts, mean lengths and score histogram as details."""
    lengths = D.count_similarity(ref, cand, F.col("end") - F.col("start")).toDF("similarity")
    scores = D.histogram_similarity(ref, cand, "score", num_bins - 1).toDF("score_similarity")  # num_bins edges
    n = I.stats(ref).toDF("n1", "t1", "c1").crossJoin(I.stats(cand).toDF("n2", "t2", "c2"))
    parts = n.select(K.rae_similarity(F.col("n1"), F.col("n2")).alias("count_similarity"), K.rae_similarity(F.col("t1") / F.col("n1"), F.col("t2") / F.col("n2")).alias("length_similarity"))
    return lengths.crossJoin(parts).crossJoin(scores)
