"""Toxicity by maximum-scoring segments.

*Learning.*  Counts over toxic and clean labelled texts (a word once a text, a word prefix once for each of its words, three
at most; equal texts once) give each word and prefix a log-odds ratio with an informative Dirichlet prior, the background
frequencies of both classes together.  The ratio less two standard errors is used where it is positive; a word takes that of
its longest kept form, so unseen endings of a known stem count, and words known from clean texts don't borrow from a prefix.

*Scoring.*  Every word of a text scores its ratio less a constant drift, so that clean text drifts down.  One linear pass
finds all maximal scoring segments (each segment can't be lengthened or shortened without losing score, and none overlap).
For clean text the number of segments of score S or more in n words is about K n exp(-lambda S) (extreme-value law);
lambda solves sum p(s) exp(lambda s) = 1 over the clean score distribution.  A segment's evidence is -log of that number where
positive; a text's evidence is the sum, turned into a probability by a logistic curve.  K and the curve are fitted by
likelihood on folds that the ratios did not see.

The fit reads at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled rows, chosen by hash of the identifier; the curve weighs each
class back to its count among all training labels, so a score means the same when a bound is met.  Scoring covers every row
and whole texts.  Null texts count as empty and get the score of no evidence; rows that repeat are scored each; labels
that are null or disagree for one identifier: nulls are ignored, the larger label holds.  With no labelled rows of one class
nothing is learned and every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_utf8, release, settle, small_batches, tidy

MAX_TOXIC, MAX_CLEAN = 6_000, 12_000
PREFIXES = (3, 4, 5, 6, 7, 8)
PRIOR = 0.3  # size of the prior, as a share of the counted words
ERRORS = 2.0  # standard errors taken off a ratio
LEAST = 0.2  # smallest ratio that is kept
DRIFT = 0.25
K_GRID = tuple(10 ** (-e / 2) for e in range(0, 11))
MAX_WORDS = 200_000
CUT = 0.7

_words = re.compile(r"[^\W_]+").findall


def forms(word: str) -> list[str]:
    """The word, then its prefixes from long to short; '~' marks a prefix."""
    return [word, *(word[:k] + "~" for k in reversed(PREFIXES) if k <= len(word))]


@dataclass
class Model:
    ratios: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    k: float = 1e-3
    base: float = 0.0
    slope: float = 0.0

    def ratio(self, word: str) -> float:
        for f in forms(word):
            r = self.ratios.get(f)
            if r is not None:
                return r
        return 0.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.base + self.slope * math.log1p(evidence)))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), in order of start; linear in the number of scores.

    Candidates are kept with the running totals before and after them.  A new positive score looks back for the last
    candidate that began at a lower total; if that one also ended below the new total, the two and all between become one.
    A link from each candidate to that earlier one keeps the look-back from visiting any candidate twice.
    """
    ups = np.flatnonzero(scores > 0)
    if not len(ups):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[list] = []  # start, end, total before, total after, index of the last candidate with a lower total before
    for i in ups.tolist():
        new = [i, i + 1, float(total[i]), float(total[i + 1]), -1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
    return [(a, b, after - before) for a, b, before, after, _ in kept]


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        outer = self

        class Known(dict):
            def __missing__(self, word):
                r = outer.m.ratio(word) - DRIFT
                if len(self) >= MAX_WORDS:
                    self.clear()
                if len(word) <= 64:
                    self[word] = r
                return r

        self.known = Known()

    def passages(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """(evidence, significant passages as (first word, word after the last, evidence))."""
        words = _words(text.lower())
        if not words:
            return 0.0, []
        scores = np.fromiter(map(self.known.__getitem__, words), float, len(words))
        found = []
        for a, b, s in segments(scores):
            e = self.m.lam * s - math.log(max(self.m.k * len(words), 1e-9))
            if e > 0:
                found.append((a, b, e))
        return sum(e for *_, e in found), found


# -- learning ------------------------------------------------------------------------------------------------------------


def text_counts(words: list[str]) -> Counter:
    """What one text adds to the counts of its class; the key "" holds the number of distinct words."""
    distinct = set(words)
    out: Counter = Counter(f for w in distinct for f in forms(w)[1:])
    out = Counter({f: min(n, 3) for f, n in out.items()})
    out.update(distinct)
    out[""] = len(distinct)
    return out


def learned(names: pa.Array, toxic: np.ndarray, clean: np.ndarray) -> Model:
    """Cautious log-odds ratios of features that speak for toxicity, 0 for exempt clean words, and the clean law's lambda.

    ``names`` are words, prefixes (ending in '~') and "", whose counts are the sizes of the classes.  Counts stay arrays; only
    features that are kept become Python objects.
    """
    all_of = pc.equal(names, "").to_numpy(zero_copy_only=False)
    size_t, size_c = int(toxic[all_of].sum()) + 1, int(clean[all_of].sum()) + 1
    prior = PRIOR * (size_t + size_c)
    with np.errstate(divide="ignore", invalid="ignore"):
        a = PRIOR * (toxic + clean)
        d = np.log((toxic + a) / (size_t + prior)) - np.log((clean + a) / (size_c + prior)) - ERRORS * np.sqrt(1 / (toxic + a) + 1 / (clean + a))
    keep = (toxic >= 2) & (d > LEAST) & ~all_of
    ratios = dict(zip(names.filter(pa.array(keep)).to_pylist(), d[keep].tolist()))
    m, exempt, dist = Model(ratios), {}, Counter()
    words = (clean > 0) & ~all_of & ~pc.ends_with(names, "~").to_numpy(zero_copy_only=False)
    at, total = np.flatnonzero(words), 0
    for k in range(0, len(at), 20_000):
        part = at[k : k + 20_000]
        for f, n in zip(names.take(pa.array(part)).to_pylist(), clean[part].tolist()):
            r = m.ratio(f)
            if r > 0 and f not in ratios:
                exempt[f] = r = 0.0  # known from clean texts: it does not borrow from a prefix
            dist[round(r - DRIFT, 2)] += n
            total += n
    dist[-DRIFT] += max(0, size_c - 1 - total)  # words met once
    return Model(ratios | exempt, _clean_law(dist, max([*ratios.values(), 1.0])))


def _clean_law(dist: Counter, top: float) -> float:
    """Lambda of the clean score distribution."""
    dist[round(top - DRIFT, 2)] += 1  # so that a positive score is possible
    s, p = np.array(list(dist)), np.array(list(dist.values()), float)
    p /= p.sum()
    if (s * p).sum() >= 0:
        return 0.1
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.clip(mid * s, -700, 700))).sum() < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """(log likelihood, base, slope) of a logistic curve over weighted rows, with a light ridge."""
    w, X, ridge = np.zeros(2), np.stack([np.ones_like(x), x], 1), np.array([1e-3, 1e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X * (weight * p * (1 - p))[:, None]).T @ X + np.diag(ridge), X.T @ (weight * (p - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(X @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float((weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()), float(w[0]), max(0.0, float(w[1]))


def learn_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "toxic") -> Model:
    """Fit a model on labelled rows of the training folds: those whose crc32(id as text) mod 3 is not 1."""
    spark = docs.sparkSession
    small_batches(spark)
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y in (0, 1)")
    marked = marked.where(F.pmod(crc32_utf8(F.col("_id").cast("string")), F.lit(3)) != 1).groupBy("_id").agg(F.max("_y").alias("_y"))
    n_all = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit(7), "_id")
    chosen = marked.where("_y = 1").orderBy(order, "_id").limit(MAX_TOXIC).unionByName(marked.where("_y = 0").orderBy(order, "_id").limit(MAX_CLEAN))
    # at most MAX_TOXIC + MAX_CLEAN narrow rows: a proven bound for the broadcast
    sample = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), "_id")
    sample = sample.groupBy("_text").agg(F.max("_y").alias("_y")).select("_y", F.pmod(F.xxhash64("_text"), F.lit(2)).alias("_fold"), "_text")
    sample = settle(sample, "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 250):  # keeps the counters of a worker small
                parts: list[Counter] = [Counter() for _ in range(4)]
                for y, fold, t in zip(*(c.to_pylist() for c in b.slice(k, 250).columns)):
                    parts[2 * fold + y].update(text_counts(_words(t.lower())))
                for i, total in enumerate(parts):
                    if total:
                        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array([i] * len(total), pa.int32()), pa.array(total.values(), pa.int64())], ["f", "part", "n"])

    tallies = sample.mapInArrow(tidy(count), "f string, part int, n long").groupBy("f").agg(*(F.sum(F.when(F.col("part") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(4)))
    # of the bounded sample only what toxic texts hold more than once, and clean words, matter
    rows = tallies.where("n1 + n3 > 1 or (n0 + n2 > 1 and not endswith(f, '~'))").toArrow()
    n_y = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if not n_y.get(0) or not n_y.get(1):
        share = n_y.get(1, 0) / max(1, sum(n_y.values()))
        return Model(base=math.log(max(share, 1e-9) / max(1 - share, 1e-9)))
    names = rows.column("f").combine_chunks()
    n0, n1, n2, n3 = (rows.column(f"n{i}").to_numpy() for i in range(4))
    folds = [learned(names, n3, n2), learned(names, n1, n0)]  # for each fold one that did not see it
    model = learned(names, n1 + n3, n0 + n2)
    shared = spark.sparkContext.broadcast(folds)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per sampled row: label, words, segment scores in units of 1/lambda."""
        scorers = [Scorer(m) for m in shared.value]
        for b in batches:
            y, n, s = [], [], []
            for label_, fold, t in zip(*(c.to_pylist() for c in b.columns)):
                sc = scorers[fold]
                words = _words(t.lower())
                scores = np.fromiter(map(sc.known.__getitem__, words), float, len(words))
                y.append(label_)
                n.append(len(words))
                s.append([sc.m.lam * x for *_, x in segments(scores)])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64()))], ["y", "n", "s"])

    got = sample.mapInArrow(tidy(raw), "y int, n long, s array<double>").toArrow()
    y, n = got.column("y").to_numpy().astype(float), got.column("n").to_numpy()
    scores = got.column("s").combine_chunks()
    row, flat = np.repeat(np.arange(len(y)), pc.list_value_length(scores).to_numpy(zero_copy_only=False)), scores.flatten().to_numpy()
    weight = np.where(y == 1, max(1.0, n_all[1] / MAX_TOXIC), max(1.0, n_all[0] / MAX_CLEAN))  # undoes the sampling
    best = None
    for k in K_GRID:
        evidence = np.maximum(0.0, flat - np.log(np.maximum(k * n, 1e-9))[row])
        fit = (*_logistic(np.log1p(np.bincount(row, evidence, len(y))), y, weight), k)
        best = fit if best is None or fit > best else best
    _, model.base, model.slope, model.k = best
    shared.destroy()
    del rows, names, n0, n1, n2, n3, folds, got, scores, row, flat
    release(spark)
    return model


# -- scoring -------------------------------------------------------------------------------------------------------------


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id", passages: bool = False) -> DataFrame:
    """id, score, predicted (and passages: word ranges with their evidence) for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = f"{id_col} {rows.schema['_id'].dataType.simpleString()}, score double, predicted int" + ", passages array<struct<first:int,after:int,evidence:double>>" * passages
    kind = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32()), ("evidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            got = [scorer.passages(t.as_py()) for t in b.column(1)]
            p = [shared.value.probability(e) for e, _ in got]
            cols = [b.column(0), pa.array(p, pa.float64()), pa.array([int(x >= CUT) for x in p], pa.int32())]
            if passages:
                cols.append(pa.array([[{"first": a, "after": z, "evidence": e} for a, z, e in found] for _, found in got], kind))
            yield pa.RecordBatch.from_arrays(cols, [id_col, "score", "predicted", "passages"][: len(cols)])

    return rows.mapInArrow(tidy(run), schema)


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic; all columns as they were."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 500):  # small copies
                part = b.slice(k, 500)
                keep = [shared.value.probability(scorer.passages(t.as_py() or "")[0]) < CUT for t in part.column(at)]
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
