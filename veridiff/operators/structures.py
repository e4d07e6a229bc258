"""Kernels that SQL cannot express: local alignment, superposition, and greedy one-to-one matching of the leftovers.

They run on Arrow batches or on groups; what built-ins can decide (exact matches, length ratios) is decided before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def local_score(a: str, b: str, match: float = 1.0, mismatch: float = 0.0, gap: float = 0.0) -> float:
    """Best local alignment score; with the default weights the length of the longest common subsequence.

    Rows are computed at once: along a row a gap of fixed cost is a running maximum of score plus distance.
    """
    if not a or not b:
        return 0.0
    y = np.frombuffer(b.encode("utf-32-le"), np.uint32)
    steps = gap * np.arange(len(y) + 1)
    row, best = np.zeros(len(y) + 1), 0.0
    for c in np.frombuffer(a.encode("utf-32-le"), np.uint32):
        diagonal = row[:-1] + np.where(y == c, match, mismatch)
        new = np.maximum(0.0, np.maximum(row, np.concatenate([[0.0], diagonal])) - np.concatenate([[gap], np.where(diagonal >= row[1:], 0.0, gap)]) if gap else np.maximum(row, np.concatenate([[0.0], diagonal])))
        row = np.maximum.accumulate(new + steps) - steps
        best = max(best, float(row.max()))
    return best


def alignment_similarity(a: str, b: str, match: float = 1.0, mismatch: float = 0.0, gap: float = 0.0) -> float:
    """Score over what a full match of the shorter text would score, clipped to [0, 1]."""
    short = min(len(a), len(b))
    return min(1.0, max(0.0, local_score(a, b, match, mismatch, gap) / (short * match))) if short else 0.0


def rmsd(x: np.ndarray, y: np.ndarray, align: bool = True) -> float:
    """Root mean square distance of matched points, after the best rotation and shift if asked."""
    n = min(len(x), len(y))
    if not n:
        return float("nan")
    x, y = x[:n], y[:n]
    if align:
        x, y = x - x.mean(0), y - y.mean(0)
        u, _, vt = np.linalg.svd(x.T @ y)
        flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
        x = x @ (vt.T @ flip @ u.T).T
    return float(np.sqrt(((x - y) ** 2).sum(1).mean()))


def tm_score(x: np.ndarray, y: np.ndarray) -> float:
    """Mean of 1 / (1 + (d/d0)^2) over matched points after superposition; d0 grows with the reference length."""
    n = min(len(x), len(y))
    if not n:
        return 0.0
    d0 = max(0.5, 1.24 * np.cbrt(len(x) - 15) - 1.8)
    a, b = x[:n] - x[:n].mean(0), y[:n] - y[:n].mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    d = np.sqrt((((a @ (vt.T @ flip @ u.T).T) - b) ** 2).sum(1))
    return float((1 / (1 + (d / d0) ** 2)).sum() / len(x))


def structure_similarity(x: np.ndarray, y: np.ndarray, threshold: float = 2.0) -> float:
    """Mean of the template score and exp(-rmsd / threshold)."""
    n = min(len(x), len(y))
    return (tm_score(x[:n], y[:n]) + float(np.exp(-rmsd(x[:n], y[:n]) / threshold))) / 2 if n else 0.0


#: One-letter codes of residues.
RESIDUES = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def chains(atoms: DataFrame) -> DataFrame:
    """(chain, seq, points) of atoms (chain, res_ord, resname, hetero, atom, x, y, z): residues and alpha carbons in order."""
    codes = F.create_map(*(F.lit(v) for kv in RESIDUES.items() for v in kv))
    ca = atoms.where("atom = 'CA' and not hetero").select("chain", F.struct("res_ord", F.coalesce(codes[F.col("resname")], F.lit("X")).alias("r"), F.array("x", "y", "z").alias("p")).alias("v"))
    one = ca.groupBy("chain").agg(F.sort_array(F.collect_list("v")).alias("v"))
    return one.select("chain", F.array_join(F.transform("v", lambda a: a["r"]), "").alias("seq"), F.transform("v", lambda a: a["p"]).alias("points"))


def chain_scores(pairs: DataFrame, threshold: float = 2.0) -> DataFrame:
    """``pairs`` (ref_seq, ref_points, cand_seq, cand_points, ...) with seq_similarity, structure_similarity and rmsd."""
    @F.pandas_udf("seq_similarity double, structure_similarity double, rmsd double")
    def run(s1: pd.Series, p1: pd.Series, s2: pd.Series, p2: pd.Series) -> pd.DataFrame:
        out = []
        for a, x, b, y in zip(s1, p1, s2, p2):
            x, y = (np.array([list(p) for p in v], float).reshape(-1, 3) for v in (x, y))
            out.append((alignment_similarity(a, b), structure_similarity(x, y, threshold), rmsd(x, y)))
        return pd.DataFrame(out, columns=["seq_similarity", "structure_similarity", "rmsd"])

    return pairs.withColumn("_s", run("ref_seq", "ref_points", "cand_seq", "cand_points")).select(*pairs.columns, "_s.*")


def greedy_pairs(ref: DataFrame, cand: DataFrame, min_ratio: float = 0.5, block: str | None = None) -> DataFrame:
    """(ref_id, cand_id, score): best-first one-to-one pairs of sequences (id, seq) left over by exact matching.

    Equal sequences pair first, by built-ins.  Of the rest only pairs whose lengths are in proportion are scored, on Arrow
    batches; assignment is sequential by nature and runs inside each group of ``block`` (without one, all in one group).
    """
    from pyspark.sql import Window

    by = F.row_number().over(Window.partitionBy("seq").orderBy("id"))
    cols = [block] if block else []
    a, b = ref.withColumn("_k", by), cand.withColumn("_k", by)
    same = a.select(*cols, "seq", "_k", F.col("id").alias("ref_id")).join(b.select(*cols, "seq", "_k", F.col("id").alias("cand_id")), [*cols, "seq", "_k"])
    left = a.join(same.select(F.col("ref_id").alias("id")), "id", "left_anti").select(*cols, F.col("id").alias("ref_id"), F.col("seq").alias("s1"))
    right = b.join(same.select(F.col("cand_id").alias("id")), "id", "left_anti").select(*cols, F.col("id").alias("cand_id"), F.col("seq").alias("s2"))
    near = (F.least(F.length("s1"), F.length("s2")) >= min_ratio * F.greatest(F.length("s1"), F.length("s2"))) & (F.length("s1") > 0) & (F.length("s2") > 0)
    pairs = left.join(right, cols).where(near) if cols else left.join(right, near)

    @F.pandas_udf("double")
    def score(s1: pd.Series, s2: pd.Series) -> pd.Series:
        return pd.Series([alignment_similarity(a, b) for a, b in zip(s1, s2)])

    scored = pairs.withColumn("score", score("s1", "s2")).select(*cols, "ref_id", "cand_id", "score")
    kinds = {f.name: f.dataType.simpleString() for f in scored.schema}

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        used_r, used_c, keep = set(), set(), []
        for i, r in enumerate(rows.sort_values(["score", "ref_id", "cand_id"], ascending=[False, True, True]).itertuples(index=False)):
            if r.ref_id not in used_r and r.cand_id not in used_c and r.score > 0:
                used_r.add(r.ref_id)
                used_c.add(r.cand_id)
                keep.append((r.ref_id, r.cand_id, r.score))
        return pd.DataFrame(keep, columns=["ref_id", "cand_id", "score"])

    schema = f"ref_id {kinds['ref_id']}, cand_id {kinds['cand_id']}, score double"
    best = scored.groupBy(*cols).applyInPandas(assign, schema)
    return same.select("ref_id", "cand_id", F.lit(1.0).alias("score")).unionByName(best)
