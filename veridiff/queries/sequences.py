"""Sequence and read comparison over the benchmark pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import sequences as S
from ..strategies import fasta as X
from .registry import query, rounded

PAIR = ("seq_ref", "seq_cand")
READS = """, ra AS (SELECT id, seq, list_transform(string_split(seq, ''), lambda c: ascii(c) % 42) AS qual FROM seq_ref),
rc AS (SELECT id, CASE WHEN id % 4 = 0 THEN substr(seq, 2) ELSE seq END AS seq FROM seq_cand),
rb AS (SELECT id, seq, list_transform(string_split(seq, ''), lambda c: ascii(c) % 42 + CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END) AS qual FROM rc)"""
KM = "(SELECT id, unnest(list_transform(range(1, len(seq) - {k} + 2), lambda i: substr(seq, i, {k}))) AS kmer FROM {t} WHERE len(seq) >= {k})"
HELL = "sqrt(sum(pow(sqrt(p / (SELECT sum(p) FROM {0})) - sqrt(q / (SELECT sum(q) FROM {0})), 2)) / 2)"


def _counts(k: int, a: str = "seq_ref", b: str = "seq_cand") -> str:
    return f"(SELECT kmer, sum(p) AS p, sum(q) AS q FROM (SELECT kmer, 1 AS p, 0 AS q FROM {KM.format(k=k, t=a)} UNION ALL SELECT kmer, 0, 1 FROM {KM.format(k=k, t=b)}) GROUP BY kmer)"


def _summary(k: int, a: str, b: str) -> str:
    return f""", k AS {_counts(k, a, b)}, l AS (SELECT len(seq)::DOUBLE AS n, 1 AS p, 0 AS q FROM {a} UNION ALL SELECT len(seq), 0, 1 FROM {b}), r AS (SELECT min(n) AS lo, max(n) AS hi FROM l),
    h AS (SELECT CASE WHEN hi > lo THEN least(floor((n - lo) / (hi - lo) * 10), 9) ELSE 0 END AS b, sum(p) AS p, sum(q) AS q FROM l, r GROUP BY 1),
    s AS (SELECT (SELECT count(*) FROM {a}) AS n1, (SELECT count(*) FROM {b}) AS n2, (SELECT sum(len(seq)) FROM {a}) AS t1, (SELECT sum(len(seq)) FROM {b}) AS t2),
    o AS (SELECT greatest(0, 1 - abs(n1 - n2) / n1) AS c, greatest(0, 1 - abs(t1 - t2) / t1) AS t, (SELECT 1 - {HELL.format('h')} FROM h) AS l, (SELECT 1 - {HELL.format('k')} FROM k) AS k FROM s)
    SELECT round((c + t + l + k) / 4, 6) AS similarity, round(c, 6) AS count_similarity, round(t, 6) AS total_similarity, round(l, 6) AS length_similarity, round(k, 6) AS kmer_similarity FROM o"""


def _pair(spark, sf_dir):
    return load(spark, sf_dir, *PAIR)


def _reads(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    codes = lambda s, extra: F.transform(F.split(s, ""), lambda c: F.ascii(c) % 42 + extra)
    b = b.withColumn("seq", F.expr("if(id % 4 = 0, substring(seq, 2), seq)"))
    return a.withColumn("qual", codes(F.col("seq"), F.lit(0))), b.withColumn("qual", codes(F.col("seq"), F.when(F.col("id") % 3 == 0, 1).otherwise(0)))


@query(" , n AS (SELECT (SELECT count(*) FROM seq_ref) AS n_ref, (SELECT count(*) FROM seq_ref JOIN seq_cand USING (id, seq)) AS n_match) SELECT round(n_match / n_ref, 6) AS similarity, * FROM n", PAIR)
def fasta_exact_name(spark, sf_dir):
    return rounded(X.exact(*_pair(spark, sf_dir), by_name=True))


@query(
    ", c AS (SELECT seq, sum(p) AS p, sum(q) AS q FROM (SELECT seq, 1 AS p, 0 AS q FROM seq_ref UNION ALL SELECT seq, 0, 1 FROM seq_cand) GROUP BY seq), n AS (SELECT sum(p)::BIGINT AS n_ref, sum(least(p, q))::BIGINT AS n_match FROM c) SELECT round(n_match / n_ref, 6) AS similarity, * FROM n",
    PAIR,
)
def fasta_exact_content(spark, sf_dir):
    return rounded(X.exact(*_pair(spark, sf_dir)))


@query(_summary(11, "seq_ref", "seq_cand"), PAIR)
def fasta_summary(spark, sf_dir):
    return rounded(X.summary(*_pair(spark, sf_dir)))


@query(f" SELECT kmer, count(*) AS n FROM {KM.format(k=3, t='seq_ref')} GROUP BY kmer", ("seq_ref",))
def kmer_count(spark, sf_dir):
    return S.kmers(load(spark, sf_dir, "seq_ref"), 3).groupBy("kmer").agg(F.count("*").alias("n"))


@query(f", k AS {_counts(4)} SELECT round(1 - {HELL.format('k')}, 6) AS similarity FROM k", PAIR)
def kmer_similarity(spark, sf_dir):
    return rounded(S.kmer_similarity(*_pair(spark, sf_dir), 4))


@query(' SELECT count(*) AS n, sum(len(seq))::BIGINT AS total, min(len(seq))::INT AS "min", max(len(seq))::INT AS "max", round(avg(len(seq)), 6) AS mean, round(stddev_pop(len(seq)), 6) AS std, round(quantile_cont(len(seq), 0.25), 6) AS q25, round(quantile_cont(len(seq), 0.5), 6) AS median, round(quantile_cont(len(seq), 0.75), 6) AS q75 FROM seq_ref', ("seq_ref",))
def fasta_length_stats(spark, sf_dir):
    return rounded(S.length_stats(load(spark, sf_dir, "seq_ref")))


@query(READS + ", n AS (SELECT (SELECT count(*) FROM ra) AS n_ref, (SELECT count(*) FROM ra JOIN rb USING (id, seq, qual)) AS n_match) SELECT round(n_match / n_ref, 6) AS similarity, * FROM n", PAIR)
def fastq_exact(spark, sf_dir):
    return rounded(X.reads_exact(*_reads(spark, sf_dir)))


@query(
    READS
    + """, j AS (SELECT ra.seq AS s, rb.seq AS t FROM ra JOIN rb USING (id) WHERE len(ra.qual) = len(rb.qual) AND len(list_filter(list_zip(ra.qual, rb.qual), lambda z: abs(z[1] - z[2]) > 2)) = 0),
    n AS (SELECT (SELECT count(*) FROM ra) AS n_ref, (SELECT count(*) FROM j WHERE EXISTS (SELECT 1 FROM range(3) a(a), range(3) b(b), range(3) c(c), range(3) d(d) WHERE substr(s, a + 1, len(s) - a - b) = substr(t, c + 1, len(t) - c - d))) AS n_match) SELECT round(n_match / n_ref, 6) AS similarity, * FROM n""",
    PAIR,
)
def fastq_approx(spark, sf_dir):
    return rounded(X.reads_approximate(*_reads(spark, sf_dir)))


@query(READS + _summary(11, "ra", "rb"), PAIR)
def fastq_summary(spark, sf_dir):
    return rounded(X.summary(*_reads(spark, sf_dir), ignore_case=False))


@query(READS + " SELECT round(avg(list_sum(qual) / len(qual)), 6) AS mean_quality FROM ra", PAIR)
def fastq_mean_quality(spark, sf_dir):
    return rounded(S.mean_quality(_reads(spark, sf_dir)[0]))


@query(", b AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT id FROM b GROUP BY id HAVING sum((trim(line) <> '')::INT) <> 1".replace(", b AS", "WITH b AS", 1))
def fasta_multiline(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return S.multiline_ids(d.select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("line")))
