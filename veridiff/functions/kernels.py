"""Metric kernels as Column builders.  All work on doubles; NaN becomes NULL where data is read (``sources``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = float | int


def dbl(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def relative_error(x: Column, y: Column) -> Column:
    """|x-y|/|x|; 0 for two zeros, infinite for 0 against another value."""
    return F.when((x == 0) & (y == 0), 0.0).when(x == 0, F.lit(float("inf"))).otherwise(F.abs(x - y) / F.abs(x))


def rae_similarity(x: Column, y: Column) -> Column:
    """1 - relative error, clipped to [0, 1].  A missing side gives NULL, but a zero reference against a missing value 0."""
    x, y = dbl(x), dbl(y)
    return (
        F.when(x.isNull(), None)
        .when((x == 0) & (y == 0), 1.0)
        .when(x == 0, 0.0)
        .when(y.isNull(), None)
        .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(x - y) / F.abs(x))))
    )


def min_max_ratio(x: Column, y: Column) -> Column:
    """Smaller over larger; 1 for two zeros, 0 for one."""
    x, y = dbl(x), dbl(y)
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).otherwise(F.least(x, y) / F.greatest(x, y))


def normalized_difference(x: Column, y: Column) -> Column:
    """(x-y)/(x+y); NULL where the sum is 0 (count those rows with ``zero_sum``)."""
    return F.when(x + y != 0, (dbl(x) - dbl(y)) / (dbl(x) + dbl(y)))


def zero_sum(x: Column, y: Column) -> Column:
    return F.sum(F.when(x + y == 0, 1).otherwise(0))


def hellinger_agg(p: Column, q: Column) -> Column:
    """Aggregate: Hellinger distance of two non-negative vectors given row by row, NULL for an empty or negative one.

    sqrt(1 - sum sqrt(pq) / sqrt(sum p sum q)), so one pass with partial sums is enough.
    """
    p, q = F.coalesce(dbl(p), F.lit(0.0)), F.coalesce(dbl(q), F.lit(0.0))
    total = F.sum(p) * F.sum(q)
    ok = (F.sum(p) > 0) & (F.sum(q) > 0) & (F.min(p) >= 0) & (F.min(q) >= 0)
    return F.when(ok, F.sqrt(F.greatest(F.lit(0.0), 1 - F.sum(F.sqrt(F.greatest(p * q, F.lit(0.0)))) / F.sqrt(total))))


def jaccard(overlap: Column, x: Column, y: Column) -> Column:
    union = dbl(x) + dbl(y) - dbl(overlap)
    return F.when(union <= 0, 1.0).otherwise(dbl(overlap) / union)


def precision(overlap: Column, cand: Column) -> Column:
    return F.when(cand > 0, dbl(overlap) / dbl(cand)).otherwise(0.0)


def recall(overlap: Column, ref: Column) -> Column:
    return precision(overlap, ref)


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def histogram_bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number of equal-width bins; the last bin is closed on the right."""
    return F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")


def tokens(c: Column, delimiter: str) -> Column:
    """Set of trimmed, non-empty parts of a cell; empty for NULL."""
    quoted = "\\Q" + delimiter + "\\E"
    return F.coalesce(F.array_distinct(F.filter(F.transform(F.split(c.cast("string"), quoted), F.trim), lambda x: x != "")), F.array().cast("array<string>"))


def token_jaccard(x: Column, y: Column, delimiter: str) -> Column:
    a, b = tokens(x, delimiter), tokens(y, delimiter)
    na, nb = F.size(a), F.size(b)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def mean_of(*parts: Column) -> Column:
    """Mean of the parts that are not NULL; NULL if none is."""
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(n > 0, total / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is the zero vector."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
