"""Signal-track, index and coverage strategies.

Tracks: runs of one value (chrom, start, end, value), half open and apart from each other, or single positions (chrom, pos,
value); ``size`` where the file states sizes.  Runs are never taken apart: measures weigh them by their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import dist as D
from ..operators import intervals as I
from ..operators.tables import average_ranks


def runs(track: DataFrame) -> DataFrame:
    """A track as runs (chrom, start, end, value, ...); single positions are runs of one."""
    return track if "start" in track.columns else track.withColumns({"start": F.col("pos"), "end": F.col("pos") + 1}).drop("pos")


def sizes_of(track: DataFrame) -> DataFrame:
    """Sizes as the file states them in ``size``, else one past the last position."""
    size = F.col("size") if "size" in track.columns else F.col("end")
    return runs(track).groupBy("chrom").agg(F.max(size).alias("size"))


def head(track: DataFrame, max_positions: int | None) -> DataFrame:
    if max_positions is None:
        return track
    if "start" not in track.columns:
        return track.where(F.col("pos") < max_positions)
    return track.where(F.col("start") < max_positions).withColumn("end", F.least("end", F.lit(max_positions).cast("long")))


def _common(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """(chrom, size, n_ref_chroms, n_common): chromosomes of both sides with the smaller size; a handful of rows."""
    a, b = sizes_of(ref), sizes_of(cand).withColumnRenamed("size", "size2")
    both = a.join(b, "chrom").select("chrom", F.least("size", "size2").alias("size"))
    return both.crossJoin(a.agg(F.count("*").alias("n_ref_chroms"))).crossJoin(both.agg(F.count("*").alias("n_common")))


def _meet(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """(chrom, x, y, w): values of both sides and the number of positions that have them."""
    if "start" not in ref.columns and "start" not in cand.columns:
        a, b = ref.select("chrom", "pos", F.col("value").alias("x")), cand.select("chrom", "pos", F.col("value").alias("y"))
        return a.join(b, ["chrom", "pos"]).withColumn("w", F.lit(1).cast("long"))
    j = I.overlap_join(*(runs(t).select("chrom", "start", "end", "value") for t in (ref, cand)))
    return j.select(F.col("ref_chrom").alias("chrom"), F.col("ref_value").alias("x"), F.col("cand_value").alias("y"), F.col("overlap").alias("w"))


def paired(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """(chrom, x, y, w) of positions with a value on both sides."""
    ok = lambda df: df.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).withColumn("value", F.col("value").cast("double"))
    return _meet(ok(ref), ok(cand))


def _weighted(per_chrom: DataFrame, common: DataFrame) -> DataFrame:
    j = per_chrom.join(common, "chrom").where("s is not null")
    mean = F.sum(F.col("s") * F.col("size")) / F.sum("size")
    cover = F.max(F.col("n_common") / F.col("n_ref_chroms"))
    return j.agg(F.coalesce(mean * cover, F.lit(0.0)).alias("similarity"), cover.alias("coverage"), F.count("*").alias("n_chroms"))


def exact(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """1 when sizes, positions and values agree; positions count, however long the runs that hold them."""
    s = sizes_of(ref).join(sizes_of(cand).withColumnRenamed("size", "size2"), "chrom", "full_outer").agg(F.bool_and(F.col("size").eqNullSafe(F.col("size2"))).alias("same_sizes"))
    met = _meet(ref, cand).agg(F.coalesce(F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), F.col("w"))), F.lit(0)).alias("n_equal"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_both"))
    length = lambda df, name: runs(df).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias(name))
    v = met.crossJoin(length(ref, "n1")).crossJoin(length(cand, "n2")).select("n_equal", F.expr("n1 + n2 - n_both").alias("n_positions"))
    ok = F.col("same_sizes") & (F.col("n_equal") == F.col("n_positions"))
    return s.crossJoin(v).select(F.when(ok, 1.0).otherwise(0.0).alias("similarity"), "same_sizes", "n_equal", "n_positions")


def approximate(ref: DataFrame, cand: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Size-weighted share of positions whose difference, relative to the larger magnitude, is within the tolerance."""
    m = F.greatest(F.abs("x"), F.abs("y"))
    rel = F.when(m > 0, F.abs(F.col("x") - F.col("y")) / m).otherwise(0.0)
    per = paired(ref, cand).groupBy("chrom").agg((F.sum(F.when(rel <= tolerance, F.col("w")).otherwise(0)) / F.sum("w")).alias("s"))
    return _weighted(per, _common(ref, cand))


def correlation(ref: DataFrame, cand: DataFrame, method: str = "pearson") -> DataFrame:
    p = paired(ref, cand)
    p = p.withColumns({"u": F.col("x"), "v": F.col("y")})
    if method == "spearman":
        for c, r in (("x", "u"), ("y", "v")):
            ranks = average_ranks(p.select("chrom", c, "w"), c, by=("chrom",), weight="w").withColumnRenamed("rank", r)
            p = p.drop(r).join(ranks, ["chrom", c])
    means = p.groupBy("chrom").agg((F.sum(F.col("u") * F.col("w")) / F.sum("w")).alias("mu"), (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mv"))
    p = p.join(means, "chrom").withColumns({"du": F.col("u") - F.col("mu"), "dv": F.col("v") - F.col("mv")})
    cov, su, sv = (F.sum(F.col(a) * F.col(b) * F.col("w")) for a, b in (("du", "dv"), ("du", "du"), ("dv", "dv")))
    constant = (F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))
    equal = F.max(F.abs(F.col("x") - F.col("y"))) <= 1e-8 + 1e-5 * F.max(F.abs("y"))
    s = F.when(F.sum("w") < 2, None).when(constant & equal, 1.0).when(constant, None).otherwise(F.least(F.lit(1.0), F.abs(cov) / F.sqrt(su * sv)))
    return _weighted(p.groupBy("chrom").agg(s.alias("s")), _common(ref, cand))


def summary(ref: DataFrame, cand: DataFrame, num_bins: int = 50) -> DataFrame:
    """Size-weighted similarity of value histograms over the common range; one single value overall gives 1."""
    common = _common(ref, cand)
    side = lambda df, k: runs(df).select("chrom", F.col("value").cast("double").alias("v"), F.lit(k).alias("side"), (F.col("end") - F.col("start")).alias("w"))
    rows = side(ref, 0).unionByName(side(cand, 1))
    rows = rows.where("v is not null and not isnan(v)").join(F.broadcast(common.select("chrom")), "chrom", "left_semi")
    counts = rows.groupBy("chrom", "v").agg(F.sum(F.when(F.col("side") == 0, F.col("w")).otherwise(0)).alias("p"), F.sum(F.when(F.col("side") == 1, F.col("w")).otherwise(0)).alias("q"))
    span = counts.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), K.histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), num_bins)).otherwise(0)
    binned = counts.crossJoin(F.broadcast(span)).groupBy("chrom", at.alias("bin")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    per = binned.groupBy("chrom").agg((1 - F.coalesce(K.hellinger_agg(F.col("p"), F.col("q")), F.lit(1.0))).alias("s"))
    out = _weighted(per, common).crossJoin(span)
    return out.select(F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(F.col("similarity")).alias("similarity"), "coverage", "n_chroms")


def value_stats(track: DataFrame) -> DataFrame:
    """(chrom, min, max, avg, n) over positions."""
    w = F.when(F.col("value").isNotNull(), F.col("end") - F.col("start"))
    return runs(track).groupBy("chrom").agg(F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * w) / F.sum(w)).alias("avg"), F.coalesce(F.sum(w), F.lit(0)).alias("n"))


# -- indexes -------------------------------------------------------------------------------------------------------------


def fai_exact(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """1 when both hold the same rows, in any order."""
    a = ref.groupBy(*ref.columns).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
    b = cand.groupBy(*cand.columns).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m"))
    return a.unionByName(b).groupBy(*ref.columns).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).agg(F.when(F.coalesce(F.sum(F.abs(F.col("n") - F.col("m"))), F.lit(0)) == 0, 1.0).otherwise(0.0).alias("similarity"), F.coalesce(F.sum(F.least("n", "m")), F.lit(0)).alias("n_equal"))


def fai_approximate(ref: DataFrame, cand: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Share of reference names whose length is within a relative error; names missing from the candidate are not."""
    j = ref.select("name", F.col("length").alias("x")).join(cand.select("name", F.col("length").alias("y")), "name", "left")
    ok = F.col("y").isNotNull() & (K.relative_error(F.col("x").cast("double"), F.col("y").cast("double")) <= tolerance)
    return j.agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("similarity"), F.sum(F.when(ok, 1).otherwise(0)).alias("n_match"), F.count("*").alias("n_ref"))


def fai_summary(ref: DataFrame, cand: DataFrame, num_bins: int = 10) -> DataFrame:
    s = ref.agg(F.count("*").alias("n1"), F.sum("length").alias("t1")).crossJoin(cand.agg(F.count("*").alias("n2"), F.sum("length").alias("t2")))
    h = D.histogram_similarity(ref, cand, "length", num_bins).toDF("length_similarity")
    s = s.select(K.rae_similarity(F.col("n1"), F.col("n2")).alias("count_similarity"), K.rae_similarity(F.col("t1"), F.col("t2")).alias("total_similarity")).crossJoin(h)
    parts = [F.col(c) for c in s.columns]
    return s.select((sum(parts, F.lit(0.0)) / 3).alias("similarity"), *parts)


def contigs_functional(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """1 - mean relative length error when the contig sets agree, else NULL (an error status); 1 without any length."""
    j = ref.select("reference", F.col("length").alias("x"), F.lit(1).alias("_l")).join(cand.select("reference", F.col("length").alias("y"), F.lit(1).alias("_r")), "reference", "full_outer")
    same = F.bool_and(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    err = F.when(F.col("x") > 0, F.abs(F.col("x") - F.col("y")) / F.col("x"))
    return j.agg(F.when(same, 1 - F.coalesce(F.avg(err), F.lit(0.0))).alias("similarity"), F.count("*").alias("n_contigs"))


def idxstats_functional(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """1 - mean over references of the summed differences of counts relative to the reference side's sum."""
    c = ("length", "mapped", "unmapped")
    j = ref.select("reference", *(F.col(x).alias(x + "1") for x in c)).join(cand.select("reference", *(F.col(x).alias(x + "2") for x in c)), "reference")
    diff = sum((F.abs(F.col(x + "1") - F.col(x + "2")) for x in c), F.lit(0))
    total: Column = sum((F.col(x + "1") for x in c), F.lit(0))
    return j.agg((1 - F.avg(F.when(total > 0, diff / total))).alias("similarity"), F.count("*").alias("n_references"))


def size_similarity(ref_bytes: Column, cand_bytes: Column) -> Column:
    """1 - difference over the larger of two file sizes."""
    return F.when(F.greatest(ref_bytes, cand_bytes) > 0, 1 - F.abs(ref_bytes - cand_bytes) / F.greatest(ref_bytes, cand_bytes)).otherwise(1.0)
