"""Variant strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import variants as V
from ..operators.dist import numbered


def _keys(ref: DataFrame, cand: DataFrame) -> DataFrame:
    a = ref.select(*V.KEY, F.lit(1).alias("_l"))
    b = cand.select(*V.KEY, F.lit(1).alias("_r"))
    return a.join(b, list(V.KEY), "full_outer")


def approximate(ref_raw: DataFrame, cand_raw: DataFrame) -> DataFrame:
    """Jaccard of variant keys."""
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    n = _keys(V.flatten(ref_raw), V.flatten(cand_raw)).agg(F.count("_l").alias("n_ref"), F.count("_r").alias("n_cand"), F.count(F.when(both, 1)).alias("n_both"))
    p, r = K.precision(F.col("n_both"), F.col("n_cand")), K.recall(F.col("n_both"), F.col("n_ref"))
    return n.select(K.jaccard(F.col("n_both"), F.col("n_ref"), F.col("n_cand")).alias("similarity"), "n_ref", "n_cand", "n_both", p.alias("precision"), r.alias("recall"), K.f1(p, r).alias("f1"))


def exact(ref_raw: DataFrame, cand_raw: DataFrame) -> DataFrame:
    """1 when keys, their order, qualities and filters agree.

    Order is that of the whole: each key must have the same place among all keys of its side, across chromosomes too.  Keys at
    the same place are ordered by value.  Rows without a chromosome are no sites.
    """
    a, b = V.flatten(ref_raw), V.flatten(cand_raw)

    def placed(df: DataFrame, p: str) -> DataFrame:
        df = df.where("chrom is not null").select(*V.KEY, "qual", "filter", F.col("place.ord").alias("_ord"), F.col("place.k").alias("_k"))
        df = numbered(df, "_n", ["_ord", "_k", *V.KEY])
        return df.select(*V.KEY, F.col("qual").alias(p + "qual"), F.col("filter").alias(p + "filter"), F.col("_n").alias(p + "n"))

    j = placed(a, "a").withColumn("_l", F.lit(1)).join(placed(b, "b").withColumn("_r", F.lit(1)), list(V.KEY), "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    detail = F.col("aqual").eqNullSafe(F.col("bqual")) & F.col("afilter").eqNullSafe(F.col("bfilter"))
    n = j.agg(
        F.count("_l").alias("n_ref"), F.count("_r").alias("n_cand"), F.count(F.when(both, 1)).alias("n_both"),
        F.count(F.when(both & (F.col("an") == F.col("bn")), 1)).alias("in_order"), F.count(F.when(both & detail, 1)).alias("details_equal"),
    )
    same = (F.col("n_ref") == F.col("n_both")) & (F.col("n_cand") == F.col("n_both"))
    return n.select(F.when(same & (F.col("in_order") == F.col("n_both")) & (F.col("details_equal") == F.col("n_both")), 1.0).otherwise(0.0).alias("similarity"), "n_ref", "n_cand", "n_both", "details_equal")


def section_similarity(ref: DataFrame, cand: DataFrame, order: str, name: str) -> DataFrame:
    """One row: mean relative similarity of the cells of two sections, row by row in their order, absent rows as 0.

    Sections carry an id column of zeros, whose cells are equal.  Sections have a row a bin.  None on either side: 1; on one: 0.
    """
    cols = ref.columns

    def numbered(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.row_number().over(Window.orderBy(order)).alias("_n"), *(F.col(c).cast("double").alias(p + c) for c in cols))

    j = numbered(ref, "a_").join(numbered(cand, "b_"), "_n", "full_outer")
    s = sum((K.rae_similarity(F.coalesce("a_" + c, F.lit(0.0)), F.coalesce("b_" + c, F.lit(0.0))) for c in cols), F.lit(1.0))
    n = j.agg(F.sum(s).alias("s"), F.count("*").alias("k"), F.count("a_" + cols[1]).alias("n1"), F.count("b_" + cols[1]).alias("n2"))
    one_empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    return n.select(F.when(F.col("k") == 0, 1.0).when(one_empty, 0.0).otherwise(F.col("s") / (F.col("k") * (len(cols) + 1))).alias(name))


def summary(ref_raw: DataFrame, cand_raw: DataFrame) -> DataFrame:
    """Mean relative similarity of the summary section.

    The section's id column is a constant number on both sides and is averaged in, as a similarity of 1 a row; ``value_mean``
    is the mean without it.
    """
    j = V.stats_sn(ref_raw).toDF("key", "x").join(V.stats_sn(cand_raw).toDF("key", "y"), "key", "full_outer")
    s = K.rae_similarity(F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0)))
    out = j.agg(F.avg(s).alias("value_mean"))
    t = V.stats_tstv(ref_raw).crossJoin(V.stats_tstv(cand_raw).toDF("x1", "x2", "x3", "x4", "x5", "x6"))
    names = ("ts", "tv", "ts_tv", "ts_1stalt", "tv_1stalt", "ts_tv_1stalt")
    # the section's own id column again counts as one equal cell
    tstv = t.select(((sum((K.rae_similarity(F.col(c), F.col(f"x{i + 1}")) for i, c in enumerate(names)), F.lit(0.0)) + 1) / 7).alias("tstv_similarity"))
    qual = section_similarity(V.stats_qual(ref_raw).where("bin is not null"), V.stats_qual(cand_raw).where("bin is not null"), "bin", "qual_similarity")
    af = section_similarity(V.stats_af(ref_raw), V.stats_af(cand_raw), "af", "af_similarity")
    parts = out.crossJoin(tstv).crossJoin(qual).crossJoin(af)
    return parts.select(((F.col("value_mean") + 1) / 2).alias("similarity"), "value_mean", "tstv_similarity", "qual_similarity", "af_similarity")
