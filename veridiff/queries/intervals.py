"""Interval comparison over the events pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import intervals as I
from ..strategies import bed as S
from .registry import query, rounded

PAIR = ("bed_ref", "bed_cand")
MERGED = """{0}_h AS (SELECT chrom, "start", "end", CASE WHEN "start" <= max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS h FROM {0}),
{0}_g AS (SELECT *, sum(h) OVER (PARTITION BY chrom ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM {0}_h),
{0}_m AS (SELECT chrom, min("start") AS "start", max("end") AS "end" FROM {0}_g GROUP BY chrom, g)"""
PAIRS = """, p AS (SELECT a.chrom, a."start" AS s1, a."end" AS e1, b."start" AS s2, b."end" AS e2, least(a."end", b."end") - greatest(a."start", b."start") AS o, a.score AS x, b.score AS y
  FROM bed_ref a JOIN bed_cand b ON a.chrom = b.chrom AND a."start" < b."end" AND b."start" < a."end")"""
JACC = "round({0} / ({1} + {2} - {0}), 6)"


def _pair(spark, sf_dir):
    return load(spark, sf_dir, *PAIR)


@query(", " + MERGED.format("bed_ref") + ' SELECT chrom, count(*) AS n, sum("end" - "start")::BIGINT AS bases, min("start") AS first, max("end") AS last FROM bed_ref_m GROUP BY chrom', ("bed_ref",))
def bed_merge(spark, sf_dir):
    m = I.merge(load(spark, sf_dir, "bed_ref"))
    return m.groupBy("chrom").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bases"), F.min("start").alias("first"), F.max("end").alias("last"))


@query(PAIRS + " SELECT chrom, count(*) AS pairs, sum(o)::BIGINT AS bases FROM p GROUP BY chrom", PAIR)
def bed_overlap_join(spark, sf_dir):
    return I.overlap_join(*_pair(spark, sf_dir)).groupBy(F.col("ref_chrom").alias("chrom")).agg(F.count("*").alias("pairs"), F.sum("overlap").alias("bases"))


@query(' SELECT chrom, count(*) AS n FROM bed_ref a WHERE EXISTS (SELECT 1 FROM bed_cand b WHERE b.chrom = a.chrom AND a."start" < b."end" AND b."start" < a."end") GROUP BY chrom', PAIR)
def bed_semi(spark, sf_dir):
    return I.touching(*_pair(spark, sf_dir)).groupBy("chrom").agg(F.count("*").alias("n"))


@query(
    """, a AS (SELECT chrom, "start", "end", row_number() OVER (PARTITION BY chrom ORDER BY ord) AS k FROM bed_ref), b AS (SELECT chrom, "start", "end", row_number() OVER (PARTITION BY chrom ORDER BY ord) AS k FROM bed_cand),
    n AS (SELECT (SELECT count(*) FROM a) AS n_ref, (SELECT count(*) FROM b) AS n_cand, (SELECT count(*) FROM a JOIN b USING (chrom, k, "start", "end")) AS n_match) SELECT CASE WHEN n_ref = n_cand AND n_match = n_ref THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity, * FROM n""",
    PAIR,
)
def bed_exact(spark, sf_dir):
    return S.exact(*_pair(spark, sf_dir))


@query(
    """, n AS (SELECT (SELECT count(*) FROM bed_ref) AS n_ref, (SELECT count(*) FROM bed_cand) AS n_cand, (SELECT count(*) FROM bed_ref a WHERE EXISTS (SELECT 1 FROM bed_cand b WHERE b.chrom = a.chrom AND a."start" < b."end" AND b."start" < a."end")) AS n_match)
    SELECT CASE WHEN n_ref = n_cand AND n_match = n_ref THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity, * FROM n""",
    PAIR,
)
def bed_exact_unordered(spark, sf_dir):
    return S.exact(*_pair(spark, sf_dir), ignore_order=True)


APPROX = """, n AS (SELECT (SELECT count(*) FROM bed_ref) AS n_ref, (SELECT count(*) FROM bed_cand) AS n_cand, (SELECT count(DISTINCT (chrom, s1, e1)) FROM p WHERE o / (e1 - s1) >= 0.95) AS ref_matched, (SELECT count(DISTINCT (chrom, s2, e2)) FROM p WHERE o / (e1 - s1) >= 0.95) AS cand_matched)
SELECT round(ref_matched / (n_ref + n_cand - ref_matched), 6) AS similarity, n_ref, n_cand, ref_matched, cand_matched, round(cand_matched / n_cand, 6) AS "precision", round(ref_matched / n_ref, 6) AS recall FROM n"""


@query(PAIRS + APPROX, PAIR)
def bed_approx(spark, sf_dir):
    return rounded(S.approximate(*_pair(spark, sf_dir)))


@query(
    PAIRS.replace("FROM bed_ref a JOIN bed_cand b", 'FROM bed_ref a JOIN (SELECT chrom, greatest("start" - 2, 0) AS "start", "end" + 2 AS "end", score FROM bed_cand) b') + APPROX,
    PAIR,
)
def bed_approx_tolerance(spark, sf_dir):
    return rounded(S.approximate(*_pair(spark, sf_dir), tolerance=2))


@query(
    ", " + MERGED.format("bed_ref") + ", " + MERGED.format("bed_cand")
    + """, n AS (SELECT (SELECT sum("end" - "start") FROM bed_ref_m) AS r, (SELECT sum("end" - "start") FROM bed_cand_m) AS c, (SELECT sum("end" - "start") FROM bed_ref_m a WHERE EXISTS (SELECT 1 FROM bed_cand_m b WHERE b.chrom = a.chrom AND a."start" < b."end" AND b."start" < a."end")) AS o)
    SELECT round(o / (r + c - o), 6) AS similarity, r::BIGINT AS ref_bases, c::BIGINT AS cand_bases, o::BIGINT AS shared, round(o / c, 6) AS "precision", round(o / r, 6) AS recall, round(2 * (o / c) * (o / r) / (o / c + o / r), 6) AS f1 FROM n""",
    PAIR,
)
def bed_overlap(spark, sf_dir):
    return rounded(S.overlap(*_pair(spark, sf_dir)))


@query(
    PAIRS + ", m AS (SELECT * FROM p WHERE o / (e1 - s1) >= 0.95), n AS (SELECT count(*) AS k, corr(x, y) AS c, greatest((SELECT count(*) FROM bed_ref), (SELECT count(*) FROM bed_cand)) AS w FROM m) SELECT round(abs(c) * k / w, 6) AS similarity, round(c, 6) AS correlation, round(k / w, 6) AS coverage, k AS n_pairs FROM n",
    PAIR,
)
def bed_correlation(spark, sf_dir):
    return rounded(S.correlation(*_pair(spark, sf_dir)))


@query(
    """, l AS (SELECT "end" - "start" AS k, sum(p) AS p, sum(q) AS q FROM (SELECT "start", "end", 1 AS p, 0 AS q FROM bed_ref UNION ALL SELECT "start", "end", 0, 1 FROM bed_cand) GROUP BY 1),
    r AS (SELECT min(score) AS lo, max(score) AS hi FROM (SELECT score FROM bed_ref UNION ALL SELECT score FROM bed_cand)),
    v AS (SELECT least(floor((score - lo) / (hi - lo) * 49), 48) AS b, sum(p) AS p, sum(q) AS q FROM (SELECT score, 1 AS p, 0 AS q FROM bed_ref UNION ALL SELECT score, 0, 1 FROM bed_cand), r GROUP BY 1),
    s AS (SELECT (SELECT count(*) FROM bed_ref) AS n1, (SELECT count(*) FROM bed_cand) AS n2, (SELECT avg("end" - "start") FROM bed_ref) AS t1, (SELECT avg("end" - "start") FROM bed_cand) AS t2)
    SELECT (SELECT round(1 - sqrt(sum(pow(sqrt(p / (SELECT sum(p) FROM l)) - sqrt(q / (SELECT sum(q) FROM l)), 2)) / 2), 6) FROM l) AS similarity, round(greatest(0, 1 - abs(n1 - n2) / n1), 6) AS count_similarity, round(greatest(0, 1 - abs(t1 - t2) / t1), 6) AS length_similarity,
    (SELECT round(1 - sqrt(sum(pow(sqrt(p / (SELECT sum(p) FROM v)) - sqrt(q / (SELECT sum(q) FROM v)), 2)) / 2), 6) FROM v) AS score_similarity FROM s""",
    PAIR,
)
def bed_summary(spark, sf_dir):
    return rounded(S.summary(*_pair(spark, sf_dir)))


@query(
    ' SELECT count(*) AS n, sum("end" - "start")::BIGINT AS total_length, count(DISTINCT chrom) AS n_chroms, round(min(score), 6) AS "min", round(quantile_cont(score, 0.25), 6) AS q25, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.75), 6) AS q75, round(max(score), 6) AS "max", round(avg(score), 6) AS "avg", (SELECT bool_and(ok) FROM (SELECT coalesce(lag("start") OVER (PARTITION BY chrom ORDER BY ord) <= "start", true) AS ok FROM bed_ref)) AS sorted FROM bed_ref',
    ("bed_ref",),
)
def bed_stats(spark, sf_dir):
    from ..operators.dist import box_stats

    ref = load(spark, sf_dir, "bed_ref")
    return rounded(I.stats(ref).crossJoin(ref.agg(*box_stats(F.col("score")))).crossJoin(I.is_sorted(ref)))
