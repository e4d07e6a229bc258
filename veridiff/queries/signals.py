"""Signal tracks over the line-item pair, indexes over the documents pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..strategies import signals as S
from .registry import query, rounded

PAIR, FAI, IDX = ("signal_ref", "signal_cand"), ("fai_ref", "fai_cand"), ("idx_ref", "idx_cand")
SIZE = ", z AS (SELECT chrom, least(a.s, b.s) AS size FROM (SELECT chrom, max(pos) + 1 AS s FROM signal_ref GROUP BY chrom) a JOIN (SELECT chrom, max(pos) + 1 AS s FROM signal_cand GROUP BY chrom) b USING (chrom)), cov AS (SELECT (SELECT count(*) FROM z) / (SELECT count(DISTINCT chrom) FROM signal_ref) AS c)"
JOIN = ", j AS (SELECT chrom, a.value AS x, b.value AS y FROM signal_ref a JOIN signal_cand b USING (chrom, pos))"
OUT = " SELECT round(sum(s * size) / sum(size) * (SELECT c FROM cov), 6) AS similarity, round((SELECT c FROM cov), 6) AS coverage, count(*) AS n_chroms FROM per JOIN z USING (chrom)"
HELL = "sqrt(sum(pow(sqrt(p / tp) - sqrt(q / tq), 2)) / 2)"


@query(", j AS (SELECT a.value AS x, b.value AS y FROM signal_ref a FULL JOIN signal_cand b USING (chrom, pos)) SELECT 0.0::DOUBLE AS similarity, (SELECT bool_and(a.s IS NOT DISTINCT FROM b.s) FROM (SELECT chrom, max(pos) + 1 AS s FROM signal_ref GROUP BY chrom) a FULL JOIN (SELECT chrom, max(pos) + 1 AS s FROM signal_cand GROUP BY chrom) b USING (chrom)) AS same_sizes, sum((x IS NOT DISTINCT FROM y)::INT)::BIGINT AS n_equal, count(*) AS n_positions FROM j", PAIR)
def bigwig_exact(spark, sf_dir):
    return S.exact(*load(spark, sf_dir, *PAIR))


@query(SIZE + JOIN + ", per AS (SELECT chrom, avg(CASE WHEN greatest(abs(x), abs(y)) = 0 OR abs(x - y) / greatest(abs(x), abs(y)) <= 0.02 THEN 1.0 ELSE 0.0 END) AS s FROM j GROUP BY chrom)" + OUT, PAIR)
def bigwig_approx(spark, sf_dir):
    return rounded(S.approximate(*load(spark, sf_dir, *PAIR), tolerance=0.02))


@query(SIZE + JOIN + ", per AS (SELECT chrom, abs(corr(x, y)) AS s FROM j GROUP BY chrom)" + OUT, PAIR)
def bigwig_correlation(spark, sf_dir):
    return rounded(S.correlation(*load(spark, sf_dir, *PAIR)))


@query(
    SIZE + JOIN + ", k AS (SELECT chrom, rank() OVER (PARTITION BY chrom ORDER BY x) + (count(*) OVER (PARTITION BY chrom, x) - 1) / 2.0 AS x, rank() OVER (PARTITION BY chrom ORDER BY y) + (count(*) OVER (PARTITION BY chrom, y) - 1) / 2.0 AS y FROM j), per AS (SELECT chrom, abs(corr(x, y)) AS s FROM k GROUP BY chrom)" + OUT,
    PAIR,
)
def bigwig_correlation_spearman(spark, sf_dir):
    return rounded(S.correlation(*load(spark, sf_dir, *PAIR), method="spearman"))


@query(
    SIZE + f""", v AS (SELECT chrom, value AS v, 1 AS p, 0 AS q FROM signal_ref UNION ALL SELECT chrom, value, 0, 1 FROM signal_cand), r AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
    h AS (SELECT chrom, least(floor((v - lo) / (hi - lo) * 50), 49) AS b, sum(p) AS p, sum(q) AS q FROM v, r GROUP BY ALL), t AS (SELECT chrom, sum(p) AS tp, sum(q) AS tq FROM h GROUP BY chrom),
    per AS (SELECT chrom, 1 - {HELL} AS s FROM h JOIN t USING (chrom) GROUP BY chrom)""" + OUT,
    PAIR,
)
def bigwig_summary(spark, sf_dir):
    return rounded(S.summary(*load(spark, sf_dir, *PAIR)))


@query(' SELECT chrom, round(min(value), 6) AS "min", round(max(value), 6) AS "max", round(avg(value), 6) AS "avg", count(value) AS n FROM signal_ref GROUP BY chrom', ("signal_ref",))
def bigwig_stats(spark, sf_dir):
    return rounded(S.value_stats(load(spark, sf_dir, "signal_ref")))


@query(' SELECT chrom, count(*) AS n, max(pos) AS last FROM signal_ref WHERE pos < 500 GROUP BY chrom', ("signal_ref",))
def bigwig_head(spark, sf_dir):
    """The operator that keeps the first positions of a track."""
    return S.head(load(spark, sf_dir, "signal_ref"), 500).groupBy("chrom").agg(F.count("*").alias("n"), F.max("pos").alias("last"))


@query(" SELECT 0.0::DOUBLE AS similarity, count(*) AS n_equal FROM fai_ref JOIN fai_cand USING (name, length, offset_, linebases, linewidth)", FAI)
def fai_exact(spark, sf_dir):
    return S.fai_exact(*load(spark, sf_dir, *FAI))


@query(", j AS (SELECT a.length AS x, b.length AS y FROM fai_ref a LEFT JOIN fai_cand b USING (name)) SELECT round(avg(CASE WHEN y IS NOT NULL AND (x = y OR abs(x - y) / nullif(x, 0) <= 0.001) THEN 1.0 ELSE 0.0 END), 6) AS similarity, sum((y IS NOT NULL AND (x = y OR abs(x - y) / nullif(x, 0) <= 0.001))::INT)::BIGINT AS n_match, count(*) AS n_ref FROM j", FAI)
def fai_approx(spark, sf_dir):
    return rounded(S.fai_approximate(*load(spark, sf_dir, *FAI), tolerance=0.001))


@query(
    """, v AS (SELECT length::DOUBLE AS v, 1 AS p, 0 AS q FROM fai_ref UNION ALL SELECT length, 0, 1 FROM fai_cand), r AS (SELECT min(v) AS lo, max(v) AS hi FROM v), h AS (SELECT least(floor((v - lo) / (hi - lo) * 10), 9) AS b, sum(p) AS p, sum(q) AS q FROM v, r GROUP BY 1),
    o AS (SELECT (SELECT greatest(0, 1 - abs(sum(p) - sum(q)) / sum(p)) FROM v) AS c, (SELECT greatest(0, 1 - abs(sum(v * p) - sum(v * q)) / sum(v * p)) FROM v) AS t, (SELECT 1 - sqrt(sum(pow(sqrt(p / (SELECT sum(p) FROM h)) - sqrt(q / (SELECT sum(q) FROM h)), 2)) / 2) FROM h) AS l)
    SELECT round((c + t + l) / 3, 6) AS similarity, round(c, 6) AS count_similarity, round(t, 6) AS total_similarity, round(l, 6) AS length_similarity FROM o""",
    FAI,
)
def fai_summary(spark, sf_dir):
    return rounded(S.fai_summary(*load(spark, sf_dir, *FAI)))


@query(" SELECT round(1 - avg(abs(a.length - b.length) / a.length), 6) AS similarity, count(*) AS n_contigs FROM idx_ref a JOIN idx_cand b USING (reference)", IDX)
def tbi_functional(spark, sf_dir):
    return rounded(S.contigs_functional(*load(spark, sf_dir, *IDX)))


@query(" SELECT round(1 - avg((abs(a.length - b.length) + abs(a.mapped - b.mapped) + abs(a.unmapped - b.unmapped)) / (a.length + a.mapped + a.unmapped)), 6) AS similarity, count(*) AS n_references FROM idx_ref a JOIN idx_cand b USING (reference)", IDX)
def bai_functional(spark, sf_dir):
    return rounded(S.idxstats_functional(*load(spark, sf_dir, *IDX)))


@query(" SELECT reference, round(1 - abs(a.length - b.length) / greatest(a.length, b.length), 6) AS similarity FROM idx_ref a JOIN idx_cand b USING (reference)", IDX)
def index_size_summary(spark, sf_dir):
    a, b = load(spark, sf_dir, *IDX)
    return rounded(a.select("reference", "length").join(b.select("reference", F.col("length").alias("l2")), "reference").select("reference", S.size_similarity(F.col("length"), F.col("l2")).alias("similarity")))
