"""Structure strategies, over chains (chain, seq, points), and approximate sequence comparison."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import dist as D
from ..operators import structures as S


def _pairs(ref: DataFrame, cand: DataFrame, by_name: bool) -> DataFrame:
    a = ref.select(F.col("chain").alias("ref_chain"), F.col("seq").alias("ref_seq"), F.col("points").alias("ref_points"))
    b = cand.select(F.col("chain").alias("cand_chain"), F.col("seq").alias("cand_seq"), F.col("points").alias("cand_points"))
    if by_name:
        return a.join(b, F.col("ref_chain") == F.col("cand_chain"))
    m = S.greedy_pairs(ref.select(F.col("chain").alias("id"), "seq"), cand.select(F.col("chain").alias("id"), "seq"))
    return m.join(a, m["ref_id"] == a["ref_chain"]).join(b, m["cand_id"] == b["cand_chain"]).drop("ref_id", "cand_id", "score")


def exact(ref: DataFrame, cand: DataFrame, by_name: bool = True, tolerance: float = 0.001) -> DataFrame:
    """Chains of equal sequence that superpose within the tolerance, over reference chains."""
    p = _pairs(ref, cand, by_name).where("ref_seq = cand_seq")
    hits = S.chain_scores(p).where(F.col("rmsd") < tolerance).agg(F.count("*").alias("n_match"))
    return ref.agg(F.count("*").alias("n_ref")).crossJoin(hits).select(F.when(F.col("n_ref") > 0, F.col("n_match") / F.col("n_ref")).otherwise(0.0).alias("similarity"), "n_ref", "n_match")


def approximate(ref: DataFrame, cand: DataFrame, by_name: bool = True, sequence_weight: float = 0.5, structure_weight: float = 0.5, rmsd_threshold: float = 2.0) -> DataFrame:
    s = S.chain_scores(_pairs(ref, cand, by_name), rmsd_threshold)
    total = s.agg(F.coalesce(F.sum(sequence_weight * F.col("seq_similarity") + structure_weight * F.col("structure_similarity")), F.lit(0.0)).alias("total"), F.count("*").alias("n_pairs"))
    return ref.agg(F.count("*").alias("n_ref")).crossJoin(total).select(F.when(F.col("n_ref") > 0, F.col("total") / F.col("n_ref")).otherwise(0.0).alias("similarity"), "n_ref", "n_pairs")


def summary(ref_atoms: DataFrame, cand_atoms: DataFrame, num_bins: int = 10) -> DataFrame:
    """Mean of chains, residues, atoms, chain-length histogram and residue composition."""
    def counts(df: DataFrame, tag: str) -> DataFrame:
        plain = df.where("not hetero")
        return plain.agg(F.count_distinct("chain").alias("c" + tag), F.count_distinct("chain", "res_ord").alias("r" + tag), F.count("*").alias("a" + tag))

    lengths = lambda df: df.where("not hetero").groupBy("chain").agg(F.count_distinct("res_ord").alias("n"))
    residues = lambda df: df.where("not hetero").select("chain", "res_ord", "resname").distinct()
    s = counts(ref_atoms, "1").crossJoin(counts(cand_atoms, "2"))
    s = s.select(*(K.rae_similarity(F.col(x + "1"), F.col(x + "2")).alias(name) for x, name in (("c", "chain_similarity"), ("r", "residue_similarity"), ("a", "atom_similarity"))))
    s = s.crossJoin(D.histogram_similarity(lengths(ref_atoms), lengths(cand_atoms), "n", num_bins).toDF("length_similarity"))
    s = s.crossJoin(D.count_similarity(residues(ref_atoms), residues(cand_atoms), F.col("resname")).toDF("composition_similarity"))
    parts = [F.col(c) for c in s.columns]
    return s.select((sum(parts, F.lit(0.0)) / 5).alias("similarity"), *parts)


def sequences_approximate(ref: DataFrame, cand: DataFrame, by_name: bool = False, ignore_case: bool = True) -> DataFrame:
    """Sum of alignment similarities over reference sequences: by id, or of best one-to-one pairs of distinct sequences."""
    if ignore_case:
        ref, cand = ref.withColumn("seq", F.upper("seq")), cand.withColumn("seq", F.upper("seq"))
    if by_name:
        pairs = ref.select("id", F.col("seq").alias("s1")).join(cand.select("id", F.col("seq").alias("s2")), "id")
        @F.pandas_udf("double")
        def score(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([S.alignment_similarity(x, y) for x, y in zip(a, b)])

        hits, n = pairs.withColumn("score", F.when(F.col("s1") == F.col("s2"), 1.0).otherwise(score("s1", "s2"))), ref
    else:
        one = lambda df: df.groupBy("seq").agg(F.min("id").alias("id"))
        hits, n = S.greedy_pairs(one(ref), one(cand)), one(ref)
    total = hits.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.count("*").alias("n_pairs"))
    return n.agg(F.count("*").alias("n_ref")).crossJoin(total).select(F.when(F.col("n_ref") > 0, F.col("total") / F.col("n_ref")).otherwise(0.0).alias("similarity"), "n_ref", "n_pairs")
