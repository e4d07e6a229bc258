"""Alignment strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import alignments as A
from ..operators import dist as D


def exact(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """1 when all records agree place by place; NULL (an error status) when counts or flag statistics differ, else 0."""
    gate = A.flagstat(ref).toDF("category", "p1", "f1", "r1").join(A.flagstat(cand).toDF("category", "p2", "f2", "r2"), "category", "full_outer")
    gate = gate.agg(F.avg(F.abs(F.coalesce("p1", F.lit(0)) - F.coalesce("p2", F.lit(0)))).alias("flagstat_difference"))
    n = ref.agg(F.count("*").alias("n_ref")).crossJoin(cand.agg(F.count("*").alias("n_cand")))
    data = [c for c in (*A.FIELDS, "tags") if c in ref.columns and c in cand.columns]
    x, y = ref.select("ord", F.struct(*data).alias("x")), cand.select("ord", F.struct(*data).alias("y"))
    same = x.join(y, "ord").where(A.records_equal(data)).agg(F.count("*").alias("n_same"))
    gated = (F.col("flagstat_difference") > 0) | (F.col("n_ref") != F.col("n_cand"))
    value = F.when(gated, None).when(F.col("n_same") == F.col("n_ref"), 1.0).otherwise(0.0).cast("double")
    return n.crossJoin(gate).crossJoin(same).select(value.alias("similarity"), "flagstat_difference", "n_ref", "n_cand", "n_same")


def approximate(ref: DataFrame, cand: DataFrame, min_mapq: int = 20, overlap_threshold: float = 0.95) -> DataFrame:
    """Jaccard of read counts with concordant reads as the intersection; reads join on (name, mate), the last of several."""
    def side(df: DataFrame, p: str) -> tuple[DataFrame, DataFrame]:
        q = A.qualifying(df, min_mapq)
        parts = ("flag", "rname", "mapq", "blocks")
        last = F.max_by(F.struct(*parts), "ord").alias("v")
        one = q.withColumn("blocks", A.blocks(df)).groupBy("qname", "is_read2").agg(last).select("qname", "is_read2", *(F.col("v." + c).alias(c + p) for c in parts))
        return q, one

    (qa, a), (qb, b) = side(ref, "1"), side(cand, "2")
    hits = a.join(b, ["qname", "is_read2"]).agg(F.count("*").alias("n_joined"), F.coalesce(F.sum(A.concordant(overlap_threshold, min_mapq).cast("long")), F.lit(0)).alias("n_concordant"))
    n = qa.agg(F.count("*").alias("n_ref")).crossJoin(qb.agg(F.count("*").alias("n_cand"))).crossJoin(hits)
    return n.select(K.jaccard(F.col("n_concordant"), F.col("n_ref"), F.col("n_cand")).alias("similarity"), "n_ref", "n_cand", "n_joined", "n_concordant")


def summary(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """1 - mean of the relative errors of the flag statistics (at most 1 each) and the distance of mapping qualities."""
    j = A.flagstat(ref).toDF("category", "p1", "f1", "r1").join(A.flagstat(cand).toDF("category", "p2", "f2", "r2"), "category", "full_outer")
    err = F.least(F.lit(1.0), K.relative_error(F.coalesce("p1", F.lit(0)), F.coalesce("p2", F.lit(0))))
    flags = j.agg(F.sum(err).alias("flag_error"), F.count("*").alias("k"))
    mapq = D.two_sided(ref, cand, F.col("mapq")).agg(K.hellinger_agg(F.col("p"), F.col("q")).alias("mapq_distance"))
    d = F.coalesce("mapq_distance", F.lit(0.0))
    terms = F.col("k") + F.when(F.col("mapq_distance").isNotNull(), 1).otherwise(0)
    return flags.crossJoin(mapq).select((1 - (F.col("flag_error") + d) / terms).alias("similarity"), "mapq_distance")


def coverage(ref_depth: DataFrame, cand_depth: DataFrame, depth0_similarity: float | None = None) -> DataFrame:
    """Mean of smaller over larger depth over the positions of either side; positions empty on both count as given.

    Depths are runs (chrom, start, end, depth) or single positions (chrom, pos, depth).  Both sides' changes are summed along
    each chromosome, so a stretch of constant depths is one row; nothing covered on either side counts as equal.
    """
    def steps(df: DataFrame, side: int) -> DataFrame:
        runs = df if "start" in df.columns else df.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "depth")
        d = F.col("depth").cast("long")
        ends = F.array(*(F.struct(F.col(at).cast("long").alias("at"), (d * k).alias("d"), F.lit(k).cast("long").alias("n")) for at, k in (("start", 1), ("end", -1))))
        x = runs.select("chrom", F.explode(ends).alias("v"))
        pick = lambda c, s: (F.col(c) if s == side else F.lit(0).cast("long"))
        return x.select("chrom", "v.at", pick("v.d", 0).alias("x"), pick("v.d", 1).alias("y"), F.col("v.n").alias("listed"))

    seg = A.levels(steps(ref_depth, 0).unionByName(steps(cand_depth, 1)), ["x", "y", "listed"]).where("listed > 0").withColumn("w", F.expr("`end` - start"))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    none = (x == 0) & (y == 0)
    s = F.when(none, F.lit(depth0_similarity).cast("double")).otherwise(F.least(x, y) / F.greatest(x, y))
    total = seg.agg(F.sum(s * w).alias("s"), F.sum(F.when(s.isNotNull(), w)).alias("k"), F.coalesce(F.sum(w), F.lit(0)).alias("n_positions"), F.coalesce(F.sum(F.when(none, w)), F.lit(0)).alias("n_depth0"), F.sum(x * w).alias("sx"), F.sum(y * w).alias("sy"))
    n = F.col("n_positions")
    return total.select(F.when(n == 0, 1.0).otherwise(F.expr("s / nullif(k, 0)")).alias("similarity"), "n_positions", "n_depth0", F.expr("sx / nullif(n_positions, 0)").alias("ref_average"), F.expr("sy / nullif(n_positions, 0)").alias("cand_average"))
