"""Interval operators: merge, overlap join, semi join, statistics.  Intervals are half-open; columns chrom, start, end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14


def valid(df: DataFrame) -> DataFrame:
    return df.where("chrom is not null and start is not null and end is not null")


def merge(df: DataFrame, width: int = BIN) -> DataFrame:
    """Union of overlapping or touching intervals.

    Running maxima are taken inside bins of each chromosome and once over the bins' own maxima, so that no task sorts a
    whole chromosome of intervals.
    """
    x = valid(df).groupBy("chrom", "start").agg(F.max("end").alias("end")).withColumn("bin", F.floor(F.col("start") / width))
    inside = Window.partitionBy("chrom", "bin").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("chrom").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = x.groupBy("chrom", "bin").agg(F.max("end").alias("m")).withColumn("carry", F.max("m").over(earlier)).drop("m")
    x = x.join(carry, ["chrom", "bin"]).withColumn("reach", F.greatest(F.max("end").over(inside), F.col("carry")))
    x = x.withColumn("head", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach")), F.col("start")))
    # the island of a row is the last head at or before it: inside its bin, or carried from earlier bins
    heads = x.groupBy("chrom", "bin").agg(F.max("head").alias("h")).withColumn("last", F.last("h", ignorenulls=True).over(earlier)).drop("h")
    upto = Window.partitionBy("chrom", "bin").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(heads, ["chrom", "bin"]).withColumn("island", F.coalesce(F.max("head").over(upto), F.col("last")))
    return x.groupBy("chrom", "island").agg(F.max("end").alias("end")).select("chrom", F.col("island").alias("start"), "end")


def typical_width(*sides: DataFrame) -> int:
    """A width that nearly all intervals fit into: bins of it give each interval one or two places."""
    n = [x.select((F.col("end") - F.col("start")).alias("n")) for x in sides]
    lengths = n[0]
    for x in n[1:]:
        lengths = lengths.unionByName(x)
    return max(1, int(lengths.agg(F.percentile_approx("n", 0.95, 1000)).first()[0] or 1))


def overlap_join(ref: DataFrame, cand: DataFrame, width: int | None = None, tolerance: int = 0) -> DataFrame:
    """All pairs that overlap: ref_* and cand_* columns and ``overlap`` (bases shared).

    Both sides are dealt to bins of ``width`` (default: about the longest typical interval); a pair is kept only in the bin
    where its overlap starts, so none appears twice.  ``tolerance`` widens candidate intervals on both ends, not below 0.
    """
    ref, cand = valid(ref), valid(cand)
    if tolerance:
        cand = cand.withColumn("start", F.greatest(F.col("start") - tolerance, F.lit(0))).withColumn("end", F.col("end") + tolerance)
    width = width or typical_width(ref, cand)
    a = ref.select(*(F.col(f"`{c}`").alias("ref_" + c) for c in ref.columns))
    b = cand.select(*(F.col(f"`{c}`").alias("cand_" + c) for c in cand.columns))

    def dealt(df: DataFrame, p: str) -> DataFrame:
        first, last = F.floor(F.col(p + "start") / width), F.floor((F.col(p + "end") - 1) / width)
        return df.withColumn("_bin", F.explode(F.sequence(first, F.greatest(first, last))))

    j = dealt(a, "ref_").join(dealt(b, "cand_").withColumnRenamed("_bin", "_bin2"), (F.col("ref_chrom") == F.col("cand_chrom")) & (F.col("_bin") == F.col("_bin2")))
    low, high = F.greatest("ref_start", "cand_start"), F.least("ref_end", "cand_end")
    return j.where((low < high) & (F.floor(low / width) == F.col("_bin"))).withColumn("overlap", high - low).drop("_bin", "_bin2")


def matched(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs of positive lengths whose overlap covers at least ``threshold`` of the reference interval."""
    a, b = F.col("ref_end") - F.col("ref_start"), F.col("cand_end") - F.col("cand_start")
    return pairs.where((a > 0) & (b > 0)).withColumn("ratio", F.col("overlap") / a).where(F.col("ratio") >= threshold)


def touching(ref: DataFrame, cand: DataFrame) -> DataFrame:
    """Reference intervals that overlap any candidate, each reported once.  Candidates are merged first."""
    keyed = valid(ref).withColumn("_id", F.monotonically_increasing_id())
    hit = overlap_join(valid(ref).select("chrom", "start", "end").distinct(), merge(cand)).select(F.col("ref_chrom").alias("chrom"), F.col("ref_start").alias("start"), F.col("ref_end").alias("end")).distinct()
    return keyed.join(hit, ["chrom", "start", "end"], "left_semi").drop("_id")


def is_sorted(df: DataFrame, order: str = "ord", reach: int = 100_000) -> DataFrame:
    """One row: whether starts never fall within a chromosome in the order given; ranges of places first, then their ends."""
    x = df.withColumn("_range", F.floor(F.col(order) / reach))
    prev = F.lag("start").over(Window.partitionBy("chrom", "_range").orderBy(order))
    x = x.select("chrom", "_range", F.col(order).alias("_at"), "start", (prev.isNull() | (prev <= F.col("start"))).alias("ok"))
    ranges = x.groupBy("chrom", "_range").agg(F.bool_and("ok").alias("ok"), F.min_by("start", "_at").alias("first"), F.max_by("start", "_at").alias("last"))
    before = F.lag("last").over(Window.partitionBy("chrom").orderBy("_range"))
    return ranges.select("ok", (before.isNull() | (before <= F.col("first"))).alias("joined")).agg(F.bool_and(F.col("ok") & F.col("joined")).alias("sorted"))


def stats(df: DataFrame) -> DataFrame:
    return valid(df).agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total_length"), F.count_distinct("chrom").alias("n_chroms"))
