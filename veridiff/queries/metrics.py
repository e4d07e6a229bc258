"""Metric kernels over the table pair (orders) and the signal pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..functions import kernels as K
from ..operators import tables as O
from ..operators.dist import kendall_tau
from .registry import query, rounded

PAIR = ("signal_ref", "signal_cand")
JOIN = "j AS (SELECT a.value AS x, b.value AS y FROM signal_ref a JOIN signal_cand b USING (chrom, pos))"


def _pair(spark, sf_dir):
    a, b = load(spark, sf_dir, *PAIR)
    return a.select("chrom", "pos", F.col("value").alias("x")).join(b.select("chrom", "pos", F.col("value").alias("y")), ["chrom", "pos"])


@query(f", {JOIN} SELECT round(avg(CASE WHEN x IS NULL THEN NULL WHEN x = 0 AND y = 0 THEN 1 WHEN x = 0 THEN 0 WHEN y IS NULL THEN NULL ELSE greatest(0, least(1, 1 - abs(x - y) / abs(x))) END), 6) AS rae, count(*) AS n FROM j", PAIR)
def metric_rae(spark, sf_dir):
    return rounded(_pair(spark, sf_dir).agg(F.avg(K.rae_similarity(F.col("x"), F.col("y"))).alias("rae"), F.count("*").alias("n")))


@query(f", {JOIN} SELECT round(avg(abs(x - y)), 6) AS mae, round(avg((x - y) * (x - y)), 6) AS mse FROM j", PAIR)
def metric_mae_mse(spark, sf_dir):
    return rounded(_pair(spark, sf_dir).agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae"), F.avg(F.pow(F.col("x") - F.col("y"), 2)).alias("mse")))


@query(f", {JOIN} SELECT round(avg(CASE WHEN x = 0 AND y = 0 THEN 1 WHEN x = 0 OR y = 0 THEN 0 ELSE least(x, y) / greatest(x, y) END), 6) AS minmax FROM j", PAIR)
def metric_minmax(spark, sf_dir):
    return rounded(_pair(spark, sf_dir).agg(F.avg(K.min_max_ratio(F.col("x"), F.col("y"))).alias("minmax")))


@query(f", {JOIN} SELECT round(avg(CASE WHEN x + y <> 0 THEN (x - y) / (x + y) END), 6) AS normdiff, sum(CASE WHEN x + y = 0 THEN 1 ELSE 0 END)::BIGINT AS zero_sums FROM j", PAIR)
def metric_normdiff(spark, sf_dir):
    x, y = F.col("x"), F.col("y")
    return rounded(_pair(spark, sf_dir).agg(F.avg(K.normalized_difference(x, y)).alias("normdiff"), K.zero_sum(x, y).alias("zero_sums")))


@query(f", {JOIN} SELECT round(corr(x, y), 6) AS pearson FROM j", PAIR)
def metric_pearson(spark, sf_dir):
    return rounded(_pair(spark, sf_dir).agg(F.corr("x", "y").alias("pearson")))


@query(f", {JOIN}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM j) SELECT round(corr(rx, ry), 6) AS spearman FROM r", PAIR)
def metric_spearman(spark, sf_dir):
    return rounded(O.spearman(_pair(spark, sf_dir), "x", "y"))


KENDALL = ("idx_ref", "idx_cand")


@query(
    """, j AS (SELECT a.reference AS k, a.mapped AS x, b.unmapped AS y FROM idx_ref a JOIN idx_cand b USING (reference)),
    p AS (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, CASE WHEN a.x = b.x THEN 1 ELSE 0 END AS tx, CASE WHEN a.y = b.y THEN 1 ELSE 0 END AS ty FROM j a JOIN j b ON a.k < b.k)
    SELECT round(sum(s) / sqrt((count(*) - sum(tx))::DOUBLE * (count(*) - sum(ty))::DOUBLE), 6) AS kendall FROM p""",
    KENDALL,
)
def metric_kendall(spark, sf_dir):
    a, b = load(spark, sf_dir, *KENDALL)
    j = a.select("reference", F.col("mapped").alias("x")).join(b.select("reference", F.col("unmapped").alias("y")), "reference")
    return rounded(kendall_tau(j, "x", "y"))


@query(
    """SELECT a.vec_id, round(CASE WHEN sqrt(list_sum(list_transform(a.embedding, lambda v: v::DOUBLE * v))) * sqrt(list_sum(list_transform(b.embedding, lambda v: v::DOUBLE * v))) > 0
      THEN list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(a.embedding, lambda v: v::DOUBLE * v))) * sqrt(list_sum(list_transform(b.embedding, lambda v: v::DOUBLE * v)))) ELSE 0 END, 6) AS cosine
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""
)
def metric_cosine(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(nxt, "vec_id").select("vec_id", K.cosine(F.col("embedding"), F.col("other")).alias("cosine")))


@query(
    """, a AS (SELECT "end" - "start" AS k, count(*) AS p FROM bed_ref GROUP BY 1), b AS (SELECT "end" - "start" + CASE WHEN ord % 10 = 0 THEN 1 ELSE 0 END AS k, count(*) AS q FROM bed_cand GROUP BY 1),
    f AS (SELECT coalesce(p, 0) / (SELECT sum(p) FROM a) AS x, coalesce(q, 0) / (SELECT sum(q) FROM b) AS y FROM a FULL JOIN b USING (k))
    SELECT round(sqrt(sum(pow(sqrt(x) - sqrt(y), 2)) / 2), 6) AS hellinger FROM f""",
    ("bed_ref", "bed_cand"),
)
def metric_hellinger(spark, sf_dir):
    a, b = load(spark, sf_dir, "bed_ref", "bed_cand")
    x = a.groupBy((F.col("end") - F.col("start")).alias("k")).agg(F.count("*").alias("p"))
    y = b.groupBy((F.col("end") - F.col("start") + F.when(F.col("ord") % 10 == 0, 1).otherwise(0)).alias("k")).agg(F.count("*").alias("q"))
    return rounded(x.join(y, "k", "full_outer").agg(K.hellinger_agg(F.col("p"), F.col("q")).alias("hellinger")))


@query(
    """, n AS (SELECT (SELECT count(*) FROM fai_ref) AS r, (SELECT count(*) FROM fai_cand) AS c, (SELECT count(*) FROM fai_ref a JOIN fai_cand b USING (name, length)) AS o)
    SELECT r AS n_ref, c AS n_cand, o AS n_both, round(o / c, 6) AS "precision", round(o / r, 6) AS recall, round(2 * (o / c) * (o / r) / (o / c + o / r), 6) AS f1, round(o / (r + c - o), 6) AS jaccard FROM n""",
    ("fai_ref", "fai_cand"),
)
def metric_prf_jaccard(spark, sf_dir):
    a, b = load(spark, sf_dir, "fai_ref", "fai_cand")
    return rounded(O.key_overlap(a, b, ["name", "length"]))
