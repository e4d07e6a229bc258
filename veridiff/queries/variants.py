"""Variant comparison over the line-item pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import variants as V
from ..strategies import vcf as S
from .registry import query, rounded

PAIR = ("vcf_raw", "vcf_raw_cand")
FLAT = """{1} AS (SELECT chrom, pos, ref, alt, last(q ORDER BY ord, k) AS qual, last(filter ORDER BY ord, k) AS filter, min((ord, k)) AS place
  FROM (SELECT chrom, pos, ref, CASE WHEN qual <> 0 THEN qual END AS q, filter, ord, unnest(string_split(alts, ',')) AS alt, generate_subscripts(string_split(alts, ','), 1) AS k FROM {0} WHERE alts <> '') GROUP BY chrom, pos, ref, alt)"""
BOTH = ", " + FLAT.format("vcf_raw", "a") + ", " + FLAT.format("vcf_raw_cand", "b")
TYPE = "CASE WHEN len(ref) = 1 AND len(alt) = 1 THEN 'snp' WHEN len(ref) = len(alt) THEN 'mnp' ELSE 'indel' END"
SN = """(SELECT unnest(['number of samples:', 'number of records:', 'number of no-ALTs:', 'number of SNPs:', 'number of MNPs:', 'number of indels:', 'number of others:', 'number of multiallelic sites:', 'number of multiallelic SNP sites:']) AS key,
  unnest([0, count(*), sum((alts = '')::INT), sum(list_contains(t, 'snp')::INT), sum(list_contains(t, 'mnp')::INT), sum(list_contains(t, 'indel')::INT), 0, sum((len(t) > 1)::INT), sum((len(t) > 1 AND len(list_filter(t, lambda x: x <> 'snp')) = 0)::INT)])::BIGINT AS value
  FROM (SELECT alts, CASE WHEN alts = '' THEN [] ELSE list_transform(string_split(alts, ','), lambda x: CASE WHEN len(ref) = 1 AND len(x) = 1 THEN 'snp' WHEN len(ref) = len(x) THEN 'mnp' ELSE 'indel' END) END AS t FROM {0}))"""
TSTV = """(SELECT sum((ts)::INT)::BIGINT AS ts, sum((NOT ts)::INT)::BIGINT AS tv, round(sum(ts::INT) / sum((NOT ts)::INT), 2) AS ts_tv, sum((ts AND k = 1)::INT)::BIGINT AS ts_1stalt, sum((NOT ts AND k = 1)::INT)::BIGINT AS tv_1stalt, round(sum((ts AND k = 1)::INT) / sum((NOT ts AND k = 1)::INT), 2) AS ts_tv_1stalt
  FROM (SELECT k, ref || alt IN ('AG', 'GA', 'CT', 'TC') AS ts FROM (SELECT ref, unnest(string_split(alts, ',')) AS alt, generate_subscripts(string_split(alts, ','), 1) AS k FROM {0} WHERE alts <> '') WHERE len(ref) = 1 AND len(alt) = 1))"""
RAE = "CASE WHEN {0} = 0 AND {1} = 0 THEN 1 WHEN {0} = 0 THEN 0 ELSE greatest(0, least(1, 1 - abs({0} - {1}) / abs({0}))) END"


QUAL = "(SELECT row_number() OVER (ORDER BY bin) AS k, * FROM (SELECT floor(qual)::BIGINT AS bin, sum(s::INT)::BIGINT AS snps, sum((s AND t)::INT)::BIGINT AS ts, sum((s AND NOT t)::INT)::BIGINT AS tv, sum((NOT s)::INT)::BIGINT AS indels FROM (SELECT qual, len(ref) = 1 AND len(alt) = 1 AS s, ref || alt IN ('AG', 'GA', 'CT', 'TC') AS t FROM (SELECT qual, ref, string_split(alts, ',')[1] AS alt FROM {0} WHERE alts <> '')) GROUP BY ALL))"
AF = "(SELECT sum(s::INT)::BIGINT AS snps, sum((s AND t)::INT)::BIGINT AS ts, sum((s AND NOT t)::INT)::BIGINT AS tv, sum(i::INT)::BIGINT AS indels FROM (SELECT len(ref) = 1 AND len(alt) = 1 AS s, ref || alt IN ('AG', 'GA', 'CT', 'TC') AS t, len(ref) <> len(alt) AS i FROM (SELECT ref, unnest(string_split(alts, ',')) AS alt FROM {0} WHERE alts <> '')))"


def _pair(spark, sf_dir):
    return load(spark, sf_dir, *PAIR)


@query(", " + FLAT.format("vcf_raw", "a") + f" SELECT chrom, {TYPE} AS type, count(*) AS n, count(qual) AS n_qual, round(sum(qual), 6) AS qual_sum FROM a GROUP BY ALL", ("vcf_raw",))
def vcf_flatten(spark, sf_dir):
    flat = V.flatten(load(spark, sf_dir, "vcf_raw"))
    return rounded(flat.groupBy("chrom", V.variant_type(F.col("ref"), F.col("alt")).alias("type")).agg(F.count("*").alias("n"), F.count("qual").alias("n_qual"), F.sum("qual").alias("qual_sum")))


@query(" SELECT * FROM " + SN.format("vcf_raw"), ("vcf_raw",))
def vcf_stats_sn(spark, sf_dir):
    return V.stats_sn(load(spark, sf_dir, "vcf_raw"))


@query(" SELECT * FROM " + TSTV.format("vcf_raw"), ("vcf_raw",))
def vcf_stats_tstv(spark, sf_dir):
    return rounded(V.stats_tstv(load(spark, sf_dir, "vcf_raw")))


@query(
    """, f AS (SELECT floor(qual)::BIGINT AS bin, ref, string_split(alts, ',')[1] AS alt FROM vcf_raw WHERE alts <> '') SELECT bin, sum((len(ref) = 1 AND len(alt) = 1)::INT)::BIGINT AS snps, sum((len(ref) = 1 AND len(alt) = 1 AND ref || alt IN ('AG', 'GA', 'CT', 'TC'))::INT)::BIGINT AS transitions,
    sum((len(ref) = 1 AND len(alt) = 1 AND ref || alt NOT IN ('AG', 'GA', 'CT', 'TC'))::INT)::BIGINT AS transversions, sum((NOT (len(ref) = 1 AND len(alt) = 1))::INT)::BIGINT AS indels FROM f GROUP BY bin""",
    ("vcf_raw",),
)
def vcf_stats_qual(spark, sf_dir):
    return V.stats_qual(load(spark, sf_dir, "vcf_raw"))


@query(" SELECT (len(alt) - len(ref))::INT AS length, count(*) AS n FROM (SELECT ref, unnest(string_split(alts, ',')) AS alt FROM vcf_raw WHERE alts <> '') WHERE len(alt) <> len(ref) GROUP BY 1", ("vcf_raw",))
def vcf_stats_indels(spark, sf_dir):
    return V.stats_indels(load(spark, sf_dir, "vcf_raw"))


@query(
    BOTH + """, j AS (SELECT a.qual AS q1, b.qual AS q2, a.filter AS f1, b.filter AS f2, a.chrom AS l, b.chrom AS r FROM a FULL JOIN b USING (chrom, pos, ref, alt))
    SELECT 0.0::DOUBLE AS similarity, count(l) AS n_ref, count(r) AS n_cand, count(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1 END) AS n_both, count(CASE WHEN l IS NOT NULL AND r IS NOT NULL AND q1 IS NOT DISTINCT FROM q2 AND f1 IS NOT DISTINCT FROM f2 THEN 1 END) AS details_equal FROM j""",
    PAIR,
)
def vcf_exact(spark, sf_dir):
    return S.exact(*_pair(spark, sf_dir))


@query(
    BOTH + """, n AS (SELECT (SELECT count(*) FROM a) AS r, (SELECT count(*) FROM b) AS c, (SELECT count(*) FROM a JOIN b USING (chrom, pos, ref, alt)) AS o)
    SELECT round(o / (r + c - o), 6) AS similarity, r AS n_ref, c AS n_cand, o AS n_both, round(o / c, 6) AS "precision", round(o / r, 6) AS recall, round(2 * (o / c) * (o / r) / (o / c + o / r), 6) AS f1 FROM n""",
    PAIR,
)
def vcf_approx(spark, sf_dir):
    return rounded(S.approximate(*_pair(spark, sf_dir)))


@query(
    f", m AS (SELECT avg({RAE.format('x.value', 'y.value')}) AS v FROM {SN.format('vcf_raw')} x JOIN {SN.format('vcf_raw_cand')} y USING (key)), t AS (SELECT ("
    + " + ".join(RAE.format(f"x.{c}", f"y.{c}") for c in ("ts", "tv", "ts_tv", "ts_1stalt", "tv_1stalt", "ts_tv_1stalt"))
    + f" + 1) / 7 AS s FROM {TSTV.format('vcf_raw')} x, {TSTV.format('vcf_raw_cand')} y), qj AS (SELECT "
    + ", ".join(f"coalesce(x.{c}, 0) AS x{c}, coalesce(y.{c}, 0) AS y{c}" for c in ("bin", "snps", "ts", "tv", "indels"))
    + f" FROM {QUAL.format('vcf_raw')} x FULL JOIN {QUAL.format('vcf_raw_cand')} y USING (k)), qs AS (SELECT avg((1 + "
    + " + ".join(RAE.format(f"x{c}", f"y{c}") for c in ("bin", "snps", "ts", "tv", "indels"))
    + ") / 6) AS q FROM qj), fs AS (SELECT (2 + "
    + " + ".join(RAE.format(f"x.{c}", f"y.{c}") for c in ("snps", "ts", "tv", "indels"))
    + f") / 6 AS f FROM {AF.format('vcf_raw')} x, {AF.format('vcf_raw_cand')} y) SELECT round((v + 1) / 2, 6) AS similarity, round(v, 6) AS value_mean, round(s, 6) AS tstv_similarity, round(q, 6) AS qual_similarity, round(f, 6) AS af_similarity FROM m, t, qs, fs",
    PAIR,
)
def vcf_summary(spark, sf_dir):
    return rounded(S.summary(*_pair(spark, sf_dir)))


@query(f" SELECT 0.0::DOUBLE AS af, snps, ts AS transitions, tv AS transversions, indels FROM {AF.format('vcf_raw')}", ("vcf_raw",))
def vcf_stats_af(spark, sf_dir):
    return V.stats_af(load(spark, sf_dir, "vcf_raw"))


@query(" SELECT NOT EXISTS (SELECT 1 FROM (SELECT pos < lag(pos) OVER (PARTITION BY chrom ORDER BY ord) AS falls FROM vcf_raw) WHERE falls) AND NOT EXISTS (SELECT 1 FROM (SELECT lag(l) OVER (ORDER BY f) > f AS o FROM (SELECT min(ord) AS f, max(ord) AS l FROM vcf_raw GROUP BY chrom)) WHERE o) AS sorted", ("vcf_raw",))
def vcf_sorted(spark, sf_dir):
    return V.is_sorted(load(spark, sf_dir, "vcf_raw"))


READ = "SELECT id::VARCHAR AS chrom, seq FROM seq_cand WHERE seq <> '' AND id < 100000"


@query(
    f""", r AS ({READ}), b AS (SELECT chrom, unnest(range(1, len(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS base FROM r), c AS (SELECT id::VARCHAR AS chrom, unnest(range(1, len(seq) + 1)) AS pos, unnest(string_split(seq, '')) AS ref FROM seq_ref)
    SELECT chrom, pos, ref, base AS alts, 20.0::DOUBLE AS qual FROM b JOIN c USING (chrom, pos) WHERE base <> ref AND base IN ('A', 'C', 'G', 'T') AND ref IN ('A', 'C', 'G', 'T')""".replace("seq FROM seq_cand", "CASE WHEN id % 4 = 0 THEN translate(seq, 'ACGT', 'CGTA') ELSE seq END AS seq FROM seq_cand"),
    ("seq_ref", "seq_cand"),
)
def bam_variant_call(spark, sf_dir):
    """The plain caller over one read a sequence; every fourth read has all its bases turned."""
    ref, cand = load(spark, sf_dir, "seq_ref", "seq_cand")
    reads = cand.where("seq <> '' and id < 100000").select(F.lit(0).alias("flag"), F.col("id").cast("string").alias("rname"), F.lit(0).alias("pos"), F.concat(F.length("seq"), F.lit("M")).alias("cigar"), F.expr("if(id % 4 = 0, translate(seq, 'ACGT', 'CGTA'), seq)").alias("seq"), F.lit("*").alias("qual"))
    return V.call(reads, ref, min_depth=1).select("chrom", "pos", "ref", "alts", "qual")
