"""Table operators: column, row and type alignment, per-column measures in one aggregate, set and permutation tests.

Aligned tables have the key columns, ``_side`` (both, ref, cand) and for each column c the pair ``c@r`` and ``c@c``.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from ..plans.models import ColumnRule, ComparePlan

R, C = "@r", "@c"


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def match_columns(ref: DataFrame, cand: DataFrame, mapping: dict[str, str] | None = None) -> dict[str, str]:
    """Reference name -> candidate name: the mapping where both exist, else equal names without case and blanks."""
    mapped = {r: c for r, c in (mapping or {}).items() if r in ref.columns and c in cand.columns}
    if mapped:
        return {r: mapped[r] for r in ref.columns if r in mapped}
    by_name = {}
    for c in cand.columns:
        by_name.setdefault(c.strip().lower(), c)
    return {r: by_name[r.strip().lower()] for r in ref.columns if r.strip().lower() in by_name}


def align_columns(ref: DataFrame, cand: DataFrame, mapping: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides cut to their common columns, in reference order and under reference names."""
    names = match_columns(ref, cand, mapping)
    return ref.select(*(q(r) for r in names)), cand.select(*(F.col(q(c)).alias(r) for r, c in names.items()))


def cast_like(ref: DataFrame, cand: DataFrame) -> tuple[DataFrame, list[str]]:
    """Candidate columns cast to reference types; a column with any value that fails keeps its type and is reported."""
    differ = [c for c in ref.columns if c in cand.columns and ref.schema[c].dataType != cand.schema[c].dataType]
    if not differ:
        return cand, []
    tries = {c: F.col(q(c)).try_cast(ref.schema[c].dataType) for c in differ}
    row = cand.agg(*(F.sum(F.when(F.col(q(c)).isNotNull() & t.isNull(), 1).otherwise(0)).alias(c) for c, t in tries.items())).first()
    failed = [c for c in differ if row[c]]
    return cand.withColumns({c: t for c, t in tries.items() if c not in failed}), failed


def sort_rows(df: DataFrame, columns: list[str], ascending: list[bool] | bool = True) -> DataFrame:
    """Sort by the columns that exist, missing values last; directions are padded with True and cut to length."""
    up = [ascending] * len(columns) if isinstance(ascending, bool) else [*ascending, *[True] * len(columns)][: len(columns)]
    order = [F.col(q(c)).asc_nulls_last() if a else F.col(q(c)).desc_nulls_last() for c, a in zip(columns, up) if c in df.columns]
    return df.orderBy(*order) if order else df


def key_text(c: str, fold: bool = True) -> Column:
    """Keys compare as text; a missing key is the text 'nan' and matches another one."""
    text = F.coalesce(F.col(q(c)).cast("string"), F.lit("nan"))
    return F.lower(text) if fold else text


def outer_align(ref: DataFrame, cand: DataFrame, keys: list[str], fold: bool = True) -> DataFrame:
    """Full outer join of two tables with equal column names on textual keys."""
    data = [c for c in ref.columns if c not in keys]
    left = ref.select(*(key_text(k, fold).alias(k) for k in keys), F.lit(1).alias("_l"), *(F.col(q(c)).alias(c + R) for c in data))
    right = cand.select(*(key_text(k, fold).alias(k) for k in keys), F.lit(1).alias("_r"), *(F.col(q(c)).alias(c + C) for c in data))
    side = F.when(F.col("_l").isNull(), "cand").when(F.col("_r").isNull(), "ref").otherwise("both")
    return left.join(right, keys, "full_outer").withColumn("_side", side).drop("_l", "_r")


def inner_align(ref: DataFrame, cand: DataFrame, keys: list[str], fold: bool = True) -> DataFrame:
    return outer_align(ref, cand, keys, fold).where("_side = 'both'")


def fuzzy_pairs(ref_ids: DataFrame, cand_ids: DataFrame) -> DataFrame:
    """(ref_id, cand_id): ids left unmatched paired by letters and digits alone; each used once, the first claim wins."""
    def folded(df: DataFrame, name: str) -> DataFrame:
        bare = F.regexp_replace(F.lower(F.col("id").cast("string")), "[^a-z0-9]", "")
        first = Window.partitionBy("bare").orderBy("id")
        return df.select("id").distinct().withColumn("bare", bare).withColumn("k", F.row_number().over(first)).select("bare", "k", F.col("id").alias(name))

    left, right = ref_ids.select("id").distinct(), cand_ids.select("id").distinct()
    only_left, only_right = left.join(right, "id", "left_anti"), right.join(left, "id", "left_anti")
    return folded(only_left, "ref_id").join(folded(only_right, "cand_id"), ["bare", "k"]).select("ref_id", "cand_id")


#: Key sets of one size are all tried up to this many; beyond, columns are added one by one.
KEY_SETS = 300


def find_id_columns(ref: DataFrame, cand: DataFrame, most: int | None = None) -> list[str]:
    """Common columns that together are unique on both sides, none of them needless; the smallest set where all can be tried.

    Sketches of distinct counts, all sets of one size in one aggregate, leave few candidates, which are then counted exactly
    one by one.  Where a size has more than ``KEY_SETS`` sets, the column that adds most distinct rows joins in turn and
    needless ones are dropped at the end, so the work grows with columns times key length.
    """
    common = [c for c in ref.columns if c in cand.columns]
    most = min(most or len(common), len(common))
    n, m = ref.count(), cand.count()
    if not n or not m or not common:
        return []

    def unique(columns: tuple[str, ...]) -> bool:
        return all(df.groupBy(*(q(c) for c in columns)).count().where("count > 1").limit(1).count() == 0 for df in (ref, cand))

    def sketched(sets: list[tuple[str, ...]]) -> list[float]:
        """Distinct rows of each set, as a share of all."""
        row = ref.agg(*(F.approx_count_distinct(F.xxhash64(*(q(c) for c in s)), 0.02).alias(f"d{i}") for i, s in enumerate(sets))).first()
        return [x / n for x in row]

    if len(set(common)) < len(common):
        return []
    held: tuple[str, ...] = ()
    for size in range(1, most + 1):
        sets = list(combinations(common, size)) if comb(len(common), size) <= KEY_SETS else [(*held, c) for c in common if c not in held]
        shares = sketched(sets)
        for s, share in zip(sets, shares):
            if share > 0.9 and unique(s):
                needless = [c for c in s if len(s) > 1 and unique(tuple(x for x in s if x != c))] if comb(len(common), size) > KEY_SETS else []
                while needless:
                    s = tuple(x for x in s if x != needless[0])
                    needless = [c for c in s if len(s) > 1 and unique(tuple(x for x in s if x != c))]
                return [c for c in common if c in s]
        held = max(zip(shares, [-i for i in range(len(sets))], sets))[2]
    return []


def default_rules(ref: DataFrame, columns: list[str]) -> list[ColumnRule]:
    return [ColumnRule(c, "rae" if is_numeric(ref, c) else "exact") for c in columns]


def column_measures(aligned: DataFrame, rules: list[ColumnRule]) -> DataFrame:
    """(column, strategy, similarity, matching, total): every column's counters in one aggregate, then unpivoted.

    Rows without a partner count as mismatches for exact comparison and drop out of relative error.
    """
    aggs, rows = [], []
    for i, r in enumerate(x for x in rules if x.strategy != "ignore"):
        a, b = F.col(q(r.column + R)), F.col(q(r.column + C))
        if r.strategy == "exact":
            sim, match = F.when(a.eqNullSafe(b), 1.0).otherwise(0.0), F.when(a.eqNullSafe(b), 1).otherwise(0)
            value, total = F.avg(sim), F.count("*")
        elif r.strategy == "rae":
            s = K.rae_similarity(a, b)
            value = F.when((F.count(a) == 0) & (F.count(b) == 0), 1.0).when((F.count(a) == 0) | (F.count(b) == 0), 0.0).otherwise(F.coalesce(F.avg(s), F.lit(0.0)))
            match, total = F.when(s >= 1 - r.cell_tolerance, 1).otherwise(0), F.count(s)
        elif r.strategy == "overlap":
            s = K.token_jaccard(a, b, r.delimiter)
            value, match, total = F.avg(s), F.when(s >= r.threshold, 1).otherwise(0), F.count("*")
        elif r.strategy in ("pearson", "spearman"):
            x, y = K.dbl(a), K.dbl(b)
            if r.strategy == "spearman":
                x, y = F.col(q(r.column + "@rr")), F.col(q(r.column + "@rc"))
            both = x.isNotNull() & y.isNotNull()
            value = F.coalesce((F.corr(F.when(both, x), F.when(both, y)) + 1) / 2, F.lit(0.0))
            match, total = F.when(both, 1).otherwise(0), F.count("*")
        else:
            raise ValueError(f"unknown column strategy {r.strategy}")
        aggs += [value.alias(f"s{i}"), F.sum(match).cast("long").alias(f"m{i}"), total.cast("long").alias(f"t{i}")]
        rows.append(f"'{r.column}', '{r.strategy}', s{i}, m{i}, t{i}")
    for r in rules:
        if r.strategy == "spearman":
            aligned = with_pair_ranks(aligned, r.column)
    return aligned.agg(*aggs).select(F.expr(f"stack({len(rows)}, {', '.join(rows)}) AS (column, strategy, similarity, matching, total)"))


def average_ranks(values: DataFrame, value: str, buckets: int = 1024, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(by..., value, rank): average rank of each distinct number, within each group of ``by``; ``weight``: rows a row stands for.

    Ranks come from counts of distinct values: a running sum inside equal-width buckets, and one over the bucket totals, so
    no task sees more than a bucket's distinct values.
    """
    by = list(by) or ["_all"]
    rows = values.where(F.col(value).isNotNull())
    rows = rows.withColumn("_all", F.lit(0)) if by == ["_all"] else rows
    counts = rows.groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    span = counts.groupBy(*by).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), K.histogram_bin(F.col(value).cast("double"), F.col("lo"), F.col("hi"), buckets)).otherwise(0)
    binned = counts.join(span, by).withColumn("b", at).drop("lo", "hi")
    totals = binned.groupBy(*by, "b").agg(F.sum("n").alias("t"))  # at most ``buckets`` rows a group
    before = totals.withColumn("before", F.sum("t").over(Window.partitionBy(*by).orderBy("b")) - F.col("t")).drop("t")
    running = F.sum("n").over(Window.partitionBy(*by, "b").orderBy(value)) - F.col("n")
    out = binned.withColumn("r", running).join(before, [*by, "b"])
    return out.select(*(c for c in by if c != "_all"), value, (F.col("before") + F.col("r") + (F.col("n") + 1) / 2).alias("rank"))


def with_pair_ranks(df: DataFrame, column: str) -> DataFrame:
    """Average ranks of both sides among rows where both are present, as column@rr and column@rc."""
    a, b = column + R, column + C
    valid = df.where(F.col(q(a)).isNotNull() & F.col(q(b)).isNotNull())
    for src, dst in ((a, column + "@rr"), (b, column + "@rc")):
        ranks = average_ranks(valid.select(F.col(q(src)).alias("_v")), "_v").select("_v", F.col("rank").alias(dst))
        df = df.join(ranks, F.col(q(src)).eqNullSafe(F.col("_v")), "left").drop("_v")
    return df


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: corr of average ranks over rows where both are present."""
    pair = with_pair_ranks(df.select(F.col(q(x)).alias("v" + R), F.col(q(y)).alias("v" + C)), "v")
    ok = F.col("`v@r`").isNotNull() & F.col("`v@c`").isNotNull()
    return pair.where(ok).agg(F.corr(F.col("`v@rr`"), F.col("`v@rc`")).alias("spearman"))


def overall(measures: DataFrame) -> DataFrame:
    """Unweighted mean over the columns that have a similarity."""
    return measures.agg(F.avg("similarity").alias("similarity"), F.count("similarity").alias("n_columns"))


def key_overlap(ref: DataFrame, cand: DataFrame, keys: list[str], fold: bool = True) -> DataFrame:
    """Counts, precision, recall, F1 and Jaccard of two sets of keys."""
    a = ref.select(*(key_text(k, fold).alias(k) for k in keys)).distinct().withColumn("_l", F.lit(1))
    b = cand.select(*(key_text(k, fold).alias(k) for k in keys)).distinct().withColumn("_r", F.lit(1))
    n = a.join(b, keys, "full_outer").agg(F.count("_l").alias("n_ref"), F.count("_r").alias("n_cand"), F.count(F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 1)).alias("n_both"))
    p, r = K.precision(F.col("n_both"), F.col("n_cand")), K.recall(F.col("n_both"), F.col("n_ref"))
    return n.select("*", p.alias("precision"), r.alias("recall"), K.f1(p, r).alias("f1"), K.jaccard(F.col("n_both"), F.col("n_ref"), F.col("n_cand")).alias("jaccard"))


def missing_pattern(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """Share of cells whose missingness agrees, and both missing rates."""
    cells = len(columns)
    same = sum((F.when(F.col(q(c + R)).isNull() == F.col(q(c + C)).isNull(), 1).otherwise(0) for c in columns), F.lit(0))
    left = sum((F.col(q(c + R)).isNull().cast("int") for c in columns), F.lit(0))
    right = sum((F.col(q(c + C)).isNull().cast("int") for c in columns), F.lit(0))
    total = F.count("*") * cells
    return aligned.agg((F.sum(same) / total).alias("pattern_similarity"), (F.sum(left) / total).alias("ref_missing"), (F.sum(right) / total).alias("cand_missing"))


def dtype_match(ref: DataFrame, cand: DataFrame) -> float:
    common = [c for c in ref.columns if c in cand.columns]
    return sum(ref.schema[c].dataType == cand.schema[c].dataType for c in common) / len(common) if common else 0.0


def is_permutation(ref: DataFrame, cand: DataFrame, order: str) -> DataFrame:
    """One row: whether the rows are equal as multisets, how many stand in another place, and both together.

    Multisets compare by counts per row; places by the row number in ``order``.
    """
    data = [c for c in ref.columns if c != order]
    a = ref.groupBy(data).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
    b = cand.groupBy(data).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m"))
    diff = a.unionByName(b).groupBy(data).agg(F.sum("n").alias("n"), F.sum("m").alias("m")).agg(F.coalesce(F.sum(F.abs(F.col("n") - F.col("m"))), F.lit(0)).alias("unequal"))
    x = ref.select(order, F.struct(data).alias("x")).join(cand.select(order, F.struct(data).alias("y")), order)
    moved = x.agg(F.sum(F.when(F.col("x").eqNullSafe(F.col("y")), 0).otherwise(1)).alias("moved"))
    return diff.crossJoin(moved).select((F.col("unequal") == 0).alias("same_rows"), F.col("moved"), ((F.col("unequal") == 0) & (F.col("moved") > 0)).alias("is_permutation"))


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Rows become columns (small tables: one column a row)."""
    return df.transpose(F.col(q(index)))


def plan_rules(ref: DataFrame, columns: list[str], plan: ComparePlan | None) -> list[ColumnRule]:
    if plan and plan.rules:
        chosen = [r for r in plan.rules if r.column in columns]
        if chosen:
            return chosen
    return default_rules(ref, columns)


def safe_name(name: str) -> str:
    return re.sub(r"\W+", "_", name).strip("_").lower()


def pearson_columns(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """(column, pearson) of each column's two sides over rows where both are present, and their mean as column NULL.

    Columns without variation have no correlation and stay out of the mean.
    """
    def corr(c: str) -> Column:
        a, b = F.col(q(c + R)).cast("double"), F.col(q(c + C)).cast("double")
        both = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
        r = F.corr(F.when(both, a), F.when(both, b))
        return F.when(~F.isnan(r), r)

    row = aligned.agg(*(corr(c).alias(f"p{i}") for i, c in enumerate(columns)))
    rows = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"p{i}").alias("pearson")) for i, c in enumerate(columns)))).alias("v")).select("v.*")
    return rows.unionByName(rows.agg(F.avg("pearson").alias("pearson")).select(F.lit(None).cast("string").alias("column"), "pearson"))


def align_labels(ref: DataFrame, cand: DataFrame, label: str = "_row") -> DataFrame:
    """Rows of both sides joined by their label as lower-case text, for tables without key columns; repeated labels: an error."""
    for df in (ref, cand):
        if df.groupBy(F.lower(F.col(q(label)).cast("string"))).count().where("count > 1").take(1):
            raise ValueError(f"labels in {label} repeat")
    text = lambda df: df.withColumn(label, F.lower(F.col(q(label)).cast("string")))
    return outer_align(text(ref), text(cand), [label])


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as doubles; text that is no number is missing."""
    return df.withColumns({c: F.col(q(c)).try_cast("double") for c in columns})
