"""Distributions: histograms of two sides, quantiles, rank correlations, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


def kendall_tau(df: DataFrame, x: str, y: str, span: int = 1 << 16) -> DataFrame:
    """One row: tau-b, from n log n rows.

    Two values of different rank in x part at one bit of their ranks: above it they agree.  So for each bit, rows with equal
    higher bits form a group, and within it every row with the bit set counts the rows without it that are lower and higher
    in y.  Groups are counted in ranges of ``span`` ranks of y, so no task holds a whole level.
    """
    from pyspark.sql import Window

    from .tables import average_ranks

    cells = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    for c in ("x", "y"):
        values = cells.select(F.col(c).alias("v")).distinct()
        # twice the average rank of each distinct value is a whole number
        cells = cells.join(average_ranks(values, "v").select(F.col("v").alias(c), (F.col("rank") * 2).cast("long").alias("r" + c)), c)
    cells = cells.select("rx", "ry", "n")
    bits = cells.agg(F.coalesce(F.ceil(F.log2(F.max("rx") + 1)), F.lit(1)).cast("int").alias("bits"))
    part = cells.crossJoin(F.broadcast(bits)).select("ry", "n", F.explode(F.expr("transform(sequence(0, bits - 1), b -> struct(b, shiftright(rx, b + 1) as up, shiftright(rx, b) % 2 as on))")).alias("l"))
    part = part.groupBy("l.b", "l.up", F.floor(F.col("ry") / span).alias("range"), "ry").agg(F.sum(F.expr("if(l.on = 0, n, 0)")).alias("off"), F.sum(F.expr("if(l.on = 1, n, 0)")).alias("on"))
    inside = Window.partitionBy("b", "up", "range").orderBy("ry")
    part = part.withColumn("upto", F.sum("off").over(inside))
    ranges = part.groupBy("b", "up", "range").agg(F.sum("off").alias("t"))
    level = Window.partitionBy("b", "up")
    ranges = ranges.select("b", "up", "range", (F.sum("t").over(level.orderBy("range")) - F.col("t")).alias("before"), F.sum("t").over(level).alias("all"))
    lower, higher = F.col("before") + F.col("upto") - F.col("off"), F.col("all") - F.col("before") - F.col("upto")
    s = part.where("on > 0").join(ranges, ["b", "up", "range"]).agg(F.coalesce(F.sum((F.col("on") * (lower - higher)).cast("double")), F.lit(0.0)).alias("s"))

    def ties(c: str) -> DataFrame:
        return cells.groupBy(c).agg(F.sum("n").cast("double").alias("k")).agg(F.coalesce(F.sum(F.expr("k * (k - 1) / 2")), F.lit(0.0)).alias("t" + c), F.coalesce(F.sum("k"), F.lit(0.0)).alias("n" + c))

    row = s.crossJoin(ties("rx")).crossJoin(ties("ry"))
    u, v = F.expr("nrx * (nrx - 1) / 2 - trx"), F.expr("nry * (nry - 1) / 2 - try")
    return row.select(F.when((u > 0) & (v > 0), F.col("s") / F.sqrt(u * v)).alias("kendall"))


def numbered(df: DataFrame, name: str, order: list[str], by: tuple[str, ...] = (), buckets: int = 1024) -> DataFrame:
    """``df`` with row numbers from 1 in ``order`` (its first column a number), within each group of ``by``.

    Rows are numbered inside equal ranges of the first column, and ranges by their counts, so no task orders a whole group.
    Rows without a value there come last.
    """
    from pyspark.sql import Window

    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    small = (lambda x: x) if by else F.broadcast  # a row, or a row a range
    at = F.col(order[0]).cast("double")
    span = rows.groupBy(*keys).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((at - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * (buckets - 1))).otherwise(0).cast("long")
    rows = rows.join(small(span), keys).withColumn("_range", F.coalesce(place, F.lit(buckets))).drop("_lo", "_hi")
    counts = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(*keys, "_range", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(F.col(order[0]).asc_nulls_last(), *order[1:]))
    out = rows.withColumn("_inside", inside).join(small(before), [*keys, "_range"])
    return out.withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before", "_all")


def two_sided(ref: DataFrame, cand: DataFrame, key: Column, by: list[str] | None = None) -> DataFrame:
    """(by..., key, p, q): counts of ``key`` on both sides in one aggregate."""
    by = by or []
    rows = ref.select(*by, key.alias("key"), F.lit(0).alias("side")).unionByName(cand.select(*by, key.alias("key"), F.lit(1).alias("side")))
    return rows.groupBy(*by, "key").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("p"), F.sum("side").alias("q"))


def count_similarity(ref: DataFrame, cand: DataFrame, key: Column) -> DataFrame:
    """One row: 1 - Hellinger distance of the counts of ``key``."""
    return two_sided(ref, cand, key).agg((1 - K.hellinger_agg(F.col("p"), F.col("q"))).alias("similarity"))


def histogram_similarity(ref: DataFrame, cand: DataFrame, value: str, bins: int) -> DataFrame:
    """One row: 1 - Hellinger distance of histograms over the common range; all values equal gives 1."""
    rows = ref.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("side")).unionByName(cand.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("side"))).where("v is not null")
    counted = rows.groupBy("v").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("p"), F.sum("side").alias("q"))
    span = counted.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), K.histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), bins)).otherwise(0)
    binned = counted.crossJoin(F.broadcast(span)).groupBy(at.alias("bin")).agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    return binned.agg((1 - K.hellinger_agg(F.col("p"), F.col("q"))).alias("similarity"))


def box_stats(value: Column) -> list[Column]:
    """Minimum, interpolated quartiles, maximum and mean."""
    return [F.min(value).alias("min"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q75"), F.max(value).alias("max"), F.avg(value).alias("avg")]


def discrete_percentile(counts: DataFrame, value: str, n: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each share the first value whose running count reaches it; ``counts`` has a row for each value."""
    from pyspark.sql import Window

    total = counts.agg(F.sum(n).alias("_t"))
    run = counts.withColumn("_c", F.sum(n).over(Window.orderBy(value))).crossJoin(F.broadcast(total))
    return run.agg(*(F.min(F.when(F.col("_c") >= F.col("_t") * p, F.col(value))).alias(name) for name, p in shares.items()))
