"""Structures made from embedding vectors (21 points each), and approximate sequence comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..strategies import pdb as S
from .registry import query, rounded

CODES = ("ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS")


def atoms(spark, sf_dir, changed: bool):
    """One chain per vector; every fifth candidate chain is shifted along x point by point, every ninth is missing."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.posexplode(F.slice("embedding", 1, 63)).alias("i", "v"))
    p = e.groupBy("vec_id", F.floor(F.col("i") / 3).cast("int").alias("res_ord")).agg(*(F.max(F.when(F.col("i") % 3 == k, F.col("v").cast("double"))).alias(c) for k, c in enumerate("xyz")))
    name = F.element_at(F.array(*map(F.lit, CODES)), ((F.col("vec_id") + F.col("res_ord")) % len(CODES) + 1).cast("int"))
    out = p.select(F.concat(F.lit("c"), "vec_id").alias("chain"), "vec_id", "res_ord", name.alias("resname"), F.lit(False).alias("hetero"), F.lit("CA").alias("atom"), "x", "y", "z")
    if changed:
        out = out.where("vec_id % 9 <> 0").withColumn("x", F.when(F.col("vec_id") % 5 == 0, F.col("x") + 0.01 * F.col("res_ord")).otherwise(F.col("x")))
        out = out.withColumn("resname", F.when((F.col("vec_id") % 7 == 0) & (F.col("res_ord") == 3), "TRP").otherwise(F.col("resname")))
    return out.drop("vec_id")


def _chains(spark, sf_dir):
    from ..operators.structures import chains

    return chains(atoms(spark, sf_dir, False)), chains(atoms(spark, sf_dir, True))


@query()
def pdb_exact(spark, sf_dir):
    return rounded(S.exact(*_chains(spark, sf_dir)))


@query()
def pdb_approx(spark, sf_dir):
    return rounded(S.approximate(*_chains(spark, sf_dir)))


@query(
    """, n AS (SELECT count(*) AS n1, count(*) FILTER (WHERE vec_id % 9 <> 0) AS n2 FROM embeddings),
    r AS (SELECT vec_id, unnest(range(21)) AS k FROM embeddings),
    c AS (SELECT (vec_id + k) % 12 AS code, 1 AS p, 0 AS q FROM r UNION ALL SELECT CASE WHEN vec_id % 7 = 0 AND k = 3 THEN 99 ELSE (vec_id + k) % 12 END, 0, 1 FROM r WHERE vec_id % 9 <> 0),
    h AS (SELECT code, sum(p) AS p, sum(q) AS q FROM c GROUP BY code),
    o AS (SELECT n2 / n1 AS s, (SELECT 1 - sqrt(sum(pow(sqrt(p / (SELECT sum(p) FROM h)) - sqrt(q / (SELECT sum(q) FROM h)), 2)) / 2) FROM h) AS comp FROM n)
    SELECT round((3 * s + 1 + comp) / 5, 6) AS similarity, round(s, 6) AS chain_similarity, round(s, 6) AS residue_similarity, round(s, 6) AS atom_similarity, 1.0::DOUBLE AS length_similarity, round(comp, 6) AS composition_similarity FROM o""".replace(", n AS", "WITH n AS", 1)
)
def pdb_summary(spark, sf_dir):
    return rounded(S.summary(atoms(spark, sf_dir, False), atoms(spark, sf_dir, True)))


@query()
def fasta_approx(spark, sf_dir):
    """Best one-to-one alignment of distinct sequences (unmatched ones within a length ratio of one half)."""
    return rounded(S.sequences_approximate(*load(spark, sf_dir, "seq_ref", "seq_cand"), by_name=False))


@query()
def fasta_approx_by_name(spark, sf_dir):
    return rounded(S.sequences_approximate(*load(spark, sf_dir, "seq_ref", "seq_cand"), by_name=True))
