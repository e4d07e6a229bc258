"""Text strategies, over pairs of whole texts (ref, cand) or of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import texts as T


def exact(ref: DataFrame, cand: DataFrame, ignore_whitespace: bool = False, ignore_case: bool = False) -> DataFrame:
    """Per document: 1 when all lines agree in order."""
    n = lambda c: T.normalise(c, ignore_whitespace, ignore_case)
    a = ref.select("doc", "line_no", n(F.col("line")).alias("x"), F.lit(1).alias("_l"))
    b = cand.select("doc", "line_no", n(F.col("line")).alias("y"), F.lit(1).alias("_r"))
    j = a.join(b, ["doc", "line_no"], "full_outer")
    same = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("x").eqNullSafe(F.col("y"))
    return j.groupBy("doc").agg(F.min(F.when(same, 1.0).otherwise(0.0)).alias("similarity"), F.sum(same.cast("long")).alias("n_equal"), F.count("*").alias("n_lines"))


def approximate(pairs: DataFrame, compare_by: str = "line", ignore_whitespace: bool = True, ignore_case: bool = True) -> DataFrame:
    """Matched size over reference size.  With blanks removed a text is one line, so line mode is all or nothing."""
    n = lambda c: T.normalise(F.col(c), ignore_whitespace, ignore_case)
    m = T.matched_share(pairs.withColumn("ref", n("ref")).withColumn("cand", n("cand")), compare_by)
    return m.drop("ref", "cand").withColumn("similarity", F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(F.when(F.col("matched") == 0, 1.0).otherwise(0.0)))


def summary(pairs: DataFrame) -> DataFrame:
    """Mean relative similarity of five counts."""
    a, b = T.stats(F.col("ref")), T.stats(F.col("cand"))
    parts = {k: K.rae_similarity(a[k], b[k]) for k in a}
    out = pairs.select(*[c for c in pairs.columns if c not in ("ref", "cand")], *(v.alias(k) for k, v in parts.items()))
    return out.withColumn("similarity", sum((F.col(k) for k in parts), F.lit(0.0)) / len(parts))


def numeric(ref: Column, cand: Column, tolerance: float | None = None) -> Column:
    """Relative similarity of two numbers given as text; with a tolerance 1 or 0; NULL (an error status) for other texts."""
    s = K.rae_similarity(F.trim(ref).try_cast("double"), F.trim(cand).try_cast("double"))
    return s if tolerance is None else F.when(s.isNull(), None).when(1 - s <= tolerance, 1.0).otherwise(0.0)
