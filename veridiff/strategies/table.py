"""Table strategies: exact, approximate and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import tables as O
from ..operators.tables import C, R, q
from ..plans.models import AlignPlan, ComparePlan


def aligned(ref: DataFrame, cand: DataFrame, plan: AlignPlan) -> tuple[DataFrame, DataFrame, list[str]]:
    """(joined table, reference side cut to common columns, data columns)."""
    if plan.transpose:
        cand = O.transpose(cand, cand.columns[0])
    ref, cand = O.align_columns(ref, cand, plan.column_map)
    cand, _ = O.cast_like(ref, cand)
    if plan.sort_by:
        ref, cand = (O.sort_rows(x, list(plan.sort_by), list(plan.ascending) or True) for x in (ref, cand))
    keys = list(plan.id_columns) if plan.id_columns is not None else O.find_id_columns(ref.drop("_row"), cand.drop("_row"))
    if not keys:  # by row number, which readers add as _row
        keys = ["_row"] if "_row" in ref.columns and "_row" in cand.columns else ref.columns[:1]
    if "_row" not in keys:  # a reader's row number is no data
        ref, cand = ref.drop("_row"), cand.drop("_row")
    if plan.fuzzy_ids and len(keys) == 1:
        k = keys[0]
        ids = lambda df: df.select(O.key_text(k).alias("id"))
        pairs = O.fuzzy_pairs(ids(ref), ids(cand))
        cand = cand.withColumn(k, O.key_text(k)).join(pairs, F.col(q(k)) == F.col("cand_id"), "left").withColumn(k, F.coalesce("ref_id", q(k))).drop("ref_id", "cand_id")
    return O.outer_align(ref, cand, keys, not plan.case_sensitive_ids), ref, [c for c in ref.columns if c not in keys]


def columns(ref: DataFrame, cand: DataFrame, align: AlignPlan = AlignPlan(), compare: ComparePlan | None = None) -> DataFrame:
    """Per column: strategy, similarity, matching, total."""
    joined, left, data = aligned(ref, cand, align)
    return O.column_measures(joined, O.plan_rules(left, data, compare))


def approximate(ref: DataFrame, cand: DataFrame, align: AlignPlan = AlignPlan(), compare: ComparePlan | None = None) -> DataFrame:
    return O.overall(columns(ref, cand, align, compare))


def exact(ref: DataFrame, cand: DataFrame, order: str) -> DataFrame:
    """1 if identical (columns, types, rows in ``order``), else matching over all cells of the common subtable."""
    same_schema = [(f.name, f.dataType) for f in ref.schema] == [(f.name, f.dataType) for f in cand.schema]
    a, b = O.align_columns(ref, cand)
    data = [c for c in a.columns if c != order]
    joined = O.outer_align(a, b, [order])
    both = F.col("_side") == "both"
    match = sum((F.when(both & F.col(q(c + R)).eqNullSafe(F.col(q(c + C))), 1).otherwise(0) for c in data), F.lit(0))
    n = joined.agg(F.sum(match).alias("matching_cells"), (F.sum(F.when(both, 1).otherwise(0)) * len(data)).alias("total_cells"), F.sum(F.when(both, 0).otherwise(1)).alias("unmatched_rows"))
    identical = F.lit(same_schema) & (F.col("matching_cells") == F.col("total_cells")) & (F.col("unmatched_rows") == 0)
    value = F.when(identical, 1.0).when(F.col("total_cells") > 0, F.col("matching_cells") / F.col("total_cells")).otherwise(0.0)
    return n.select(value.alias("similarity"), "matching_cells", "total_cells", identical.alias("identical"))


def summary(ref: DataFrame, cand: DataFrame, bins: int = 50) -> DataFrame:
    """Mean of the parts that exist: structure, missingness, pooled numbers, pooled categories.

    Each side is read once for its counts; the pooled histograms are two more aggregates over narrow cells.
    """
    def sizes(df: DataFrame, tag: str) -> DataFrame:
        return df.agg(F.count("*").alias("n" + tag), sum((F.sum(F.col(q(c)).isNull().cast("long")) for c in df.columns), F.lit(0)).alias("m" + tag))

    def cells(df: DataFrame, numeric: bool, side: int) -> DataFrame | None:
        cols = [c for c in df.columns if O.is_numeric(df, c) == numeric]
        if not cols:
            return None
        kind = "double" if numeric else "string"
        out = df.select(F.explode(F.array(*(F.col(q(c)).cast(kind) for c in cols))).alias("v")).where("v is not null")
        if numeric:
            out = out.where("not isnan(v) and abs(v) < double('infinity')")
        return out.groupBy("v").agg(F.count("*").alias("n")).select("v", F.lit(side).alias("side"), "n")

    names_r, names_c = set(ref.columns), set(cand.columns)
    both, union = len(names_r & names_c), len(names_r | names_c)
    s = sizes(ref, "r").crossJoin(sizes(cand, "c"))
    rate_r, rate_c = F.col("mr") / (F.col("nr") * len(names_r)), F.col("mc") / (F.col("nc") * len(names_c))
    rows = K.rae_similarity(F.col("nr"), F.col("nc"))
    cols = K.rae_similarity(F.lit(len(ref.columns)), F.lit(len(cand.columns)))
    structural = (rows + cols + F.lit(both / union if union else 1.0)) / 3
    missing = K.rae_similarity(F.coalesce(rate_r, F.lit(0.0)), F.coalesce(rate_c, F.lit(0.0)))
    out = s.select(structural.alias("structural"), missing.alias("missing"))

    def per_side(frame: DataFrame, key) -> DataFrame:
        pick = lambda side: F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0))
        return frame.groupBy(key).agg(pick(0).alias("p"), pick(1).alias("q")).agg((1 - K.hellinger_agg(F.col("p"), F.col("q"))).alias("s"))

    a, b = cells(ref, True, 0), cells(cand, True, 1)
    if a is not None and b is not None:
        pool = a.unionByName(b)
        span = pool.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
        at = F.when(F.col("hi") > F.col("lo"), K.histogram_bin(F.col("v"), F.col("lo"), F.col("hi"), bins)).otherwise(0)
        out = out.crossJoin(per_side(pool.crossJoin(F.broadcast(span)).withColumn("k", at), "k").toDF("numeric"))
    else:
        out = out.withColumn("numeric", F.lit(None).cast("double"))
    a, b = cells(ref, False, 0), cells(cand, False, 1)
    if a is not None and b is not None:
        out = out.crossJoin(per_side(a.unionByName(b), "v").toDF("categorical"))
    else:
        out = out.withColumn("categorical", F.lit(None).cast("double"))
    parts = [F.col(c) for c in ("structural", "missing", "numeric", "categorical")]
    return out.select(K.mean_of(*parts).alias("similarity"), *parts)
