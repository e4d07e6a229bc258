"""Reporting mart: per-file results become one row per (task, agent) with catalog, difficulty and cost, then aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.dist import numbered

EQUIVALENT = 0.5
#: Columns of the mart, in order.
COLUMNS = ("id", "domain", "field", "difficulty", "agent", "avg_similarity", "equivalent", "completion", "duration_seconds", "input_tokens", "output_tokens")


def read_table(spark, path: str) -> DataFrame:
    """A delimited table by suffix (.tsv and .txt: tab; else comma), every column as text."""
    bare = path[:-3] if path.endswith(".gz") else path
    return spark.read.csv(path, header=True, sep="\t" if bare.endswith((".tsv", ".txt")) else ",")


def pick(df: DataFrame, *names: str) -> str | None:
    """The first of the names that the table has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n.lower()] for n in names if n.lower() in have), None)


def per_task(agent_eval: DataFrame) -> DataFrame:
    """One row per (id, agent): first known similarity, whether all files have a candidate; first row number for order."""
    missing = [c for c in ("id", "agent", "avg_similarity", "candidate_path") if pick(agent_eval, c) is None]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    known = F.when(F.col("avg_similarity").isNotNull(), F.col("row_no"))
    out = agent_eval.groupBy(F.col("id").cast("string").alias("id"), "agent").agg(
        F.min_by("avg_similarity", known).alias("avg_similarity"),
        F.bool_and(F.col("candidate_path").isNotNull() & (F.col("candidate_path") != "")).alias("completion"),
        F.min("row_no").alias("row_no"),
    )
    return out.withColumn("equivalent", F.coalesce(F.col("avg_similarity") >= EQUIVALENT, F.lit(False)))


def last_cost(cost: DataFrame) -> DataFrame:
    """The last row of each (id, agent)."""
    last = F.max_by(F.struct("duration_seconds", "input_tokens", "output_tokens"), "row_no").alias("x")
    return cost.groupBy(F.col("id").cast("string").alias("id"), "agent").agg(last).select("id", "agent", "x.*")


def build(agent_eval: DataFrame, catalog: DataFrame | None = None, difficulty: DataFrame | None = None, cost: DataFrame | None = None, skip: DataFrame | None = None) -> DataFrame:
    """The mart.  Small dimension tables are broadcast by the optimizer when their size is known to allow it."""
    out = per_task(agent_eval)
    if skip is not None:
        out = out.join(skip.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_anti")
    if catalog is not None:
        out = out.join(catalog.select(F.col("id").cast("string").alias("id"), "domain", "field"), "id", "left")
    if difficulty is not None:
        out = out.join(difficulty.select(F.col("id").cast("string").alias("id"), "difficulty"), "id", "left")
    if cost is not None:
        out = out.join(last_cost(cost), ["id", "agent"], "left")
    kinds = {"duration_seconds": "double", "input_tokens": "long", "output_tokens": "long"}
    out = out.withColumns({c: F.lit(None).cast(kinds.get(c, "string")) for c in COLUMNS if c not in out.columns})
    return out.select(*COLUMNS, "row_no")


def write_csv(mart: DataFrame, path: str) -> None:
    mart.orderBy("row_no").select(*COLUMNS).write.mode("overwrite").csv(path, header=True)


def rate_by(mart: DataFrame, flag: str, *keys: str) -> DataFrame:
    rows = mart.where(" and ".join(f"{k} is not null" for k in keys))
    return rows.groupBy(*keys).agg(F.avg(F.col(flag).cast("int")).alias("rate"), F.count("*").alias("n"))


def box_by(mart: DataFrame, value: str, key: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges and the number of outliers."""
    v = F.col(value).cast("double")
    box = mart.where(v.isNotNull()).groupBy(key).agg(F.percentile(v, 0.25).alias("q1"), F.percentile(v, 0.5).alias("median"), F.percentile(v, 0.75).alias("q3"))
    j = mart.where(v.isNotNull()).join(box, key)
    inside = v.between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return j.groupBy(key, "q1", "median", "q3").agg(F.min(F.when(inside, v)).alias("low"), F.max(F.when(inside, v)).alias("high"), F.sum(F.when(inside, 0).otherwise(1)).alias("outliers"))


def tasks_by(mart: DataFrame, *keys: str) -> DataFrame:
    """Distinct tasks, each counted under the values of its first row."""
    first = mart.groupBy("id").agg(F.min_by(F.struct(*keys), "row_no").alias("x")).select("id", "x.*")
    return first.groupBy(*keys).agg(F.count("*").alias("n"))


def overview(mart: DataFrame) -> DataFrame:
    return mart.agg(F.count_distinct("id").alias("n_tasks"), F.count_distinct("agent").alias("n_agents"), F.bool_and(F.col("difficulty").isNull()).alias("no_difficulty"), F.bool_and(F.col("duration_seconds").isNull()).alias("no_cost"))


def task_scores(results: DataFrame) -> DataFrame:
    """Mean similarity over the scored files (success or invalid) of each task; NULL when none is scored."""
    scored = F.col("status").isin("success", "invalid")
    return results.groupBy("task_id").agg(F.avg(F.when(scored, F.col("similarity"))).alias("avg_similarity"), F.sum(scored.cast("int")).alias("n_scored"), F.count("*").alias("n_files"))


def first_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys in order of first appearance."""
    return numbered(df.groupBy(*keys).agg(F.min(order).alias("first")), "place", ["first"]).withColumn("place", F.col("place").cast("int"))
