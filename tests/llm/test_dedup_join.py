"""Exact dedup and the n-gram join against SQL, brute force, and awkward rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import veridiff.llm.ngram_join as J
from tests.oracle import connect, rows_of, rows_of_sql
from veridiff.llm import queries as Q
from veridiff.llm.common import connected_components
from veridiff.llm.exact_dedup import digest_rows, drop_copies, exact_dedup, keep_state

ODD = [(1, "a b", "q", 1.0), (1, "a b", "q", 1.0), (None, None, "z", None), (2, "", " ", 2.0), (3, "ab", "r", None), (4, "\x0bab  ", "t", 1.0), (None, "x", "x", 1.0), (None, "x", "y", 1.0)]
ODD_SCHEMA = "doc_id long, text string, digest string, node double"


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op8_exact_dedup"])
def test_against_sql(spark, data, name):
    assert rows_of(Q.QUERIES[name](spark, data)) == rows_of_sql(connect(data), Q.ORACLE_SQL[name])


def test_dedup_odd_rows(spark):
    df = spark.createDataFrame(ODD, ODD_SCHEMA)
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup(df).collect())
    assert got == sorted([("1", "4", 4, False)] * 2 + [("3", "4", 4, False), ("4", "4", 4, True), ("2", "2", 2, True), ("None", "2", 2, False), ("None", "None", 2, True), ("None", "None", 2, False)])
    assert sorted((str(r["doc_id"]), r["text"]) for r in drop_copies(df).collect()) == [("2", ""), ("4", "\x0bab  "), ("None", "x")]
    assert drop_copies(df).columns == df.columns
    assert exact_dedup(df.limit(0)).count() == 0


def test_dedup_digest_clashes(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    weak = exact_dedup(docs, digest=lambda c: F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 1)).drop("locator")
    assert rows_of(weak) == rows_of(exact_dedup(docs).drop("locator"))


def test_dedup_state_goes_on(spark, tmp_path):
    """A second run takes in new files only and remembers the first."""
    rows, state = f"file://{tmp_path}/rows", f"file://{tmp_path}/state"
    digest_rows(spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")).write.parquet(rows)
    assert keep_state(spark, rows, state).where("n > 1").count() == 0
    digest_rows(spark.createDataFrame([(1, "a "), (9, "c")], "doc_id long, text string")).write.mode("append").parquet(rows)
    hits = keep_state(spark, rows, state).where("n > 1").select("best.id", "n").collect()
    assert [tuple(h) for h in hits] == [(1, 2)]


def test_dedup_is_native(spark, data):
    plan = exact_dedup(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|InArrow", plan)


# -- n-gram join -----------------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = {i: shingles(t) for i, t in docs if i is not None}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    keys = sorted(sets)
    for a in keys:
        for b in keys:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def check(spark, docs, parts=1):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.similar_components(df).collect() if r["doc_id"] is not None}
    assert got == brute(docs)


def corpus(seed, n=120):
    """Texts from a small vocabulary, with near copies at similarities around the threshold, and a shared passage."""
    rng = np.random.default_rng(seed)
    word = lambda: "w" + str(rng.integers(0, 400))
    passage = [f"p{i}" for i in range(30)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.5:
            base = docs[int(rng.integers(0, len(docs)))][1].split(" ")
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(0, len(base)))] = word()
            words = base
        else:
            words = [word() for _ in range(int(rng.integers(1, 90)))]
        if rng.random() < 0.2:
            words = words + passage
        docs.append((i, " ".join(words).replace("w1 ", "W1\t ")))
    return docs


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 6)])
def test_join_against_brute_force(spark, seed, parts):
    check(spark, corpus(seed), parts)


def test_large_cells(spark, monkeypatch):
    """Cells beyond the pairing size, in several blocks, lose no link."""
    monkeypatch.setattr(J, "CELL", 2)
    monkeypatch.setattr(J, "BLOCK_ROWS", 5)
    monkeypatch.setattr(J, "RECENT", 3)
    shared = " ".join(f"s{i}" for i in range(40))
    docs = corpus(5, 60) + [(1000 + i, f"{shared} " + " ".join(f"x{i}y{k}" for k in range(i % 12))) for i in range(60)]
    check(spark, docs, 8)


@pytest.mark.parametrize("centre", [True, False])
def test_one_passage_in_all_rows(spark, monkeypatch, centre):
    """A group whose members link by way of a centre, or only here and there, over salted keys."""
    monkeypatch.setattr(J, "CELL", 4)
    monkeypatch.setattr(J, "SALT_ROWS", 8)
    monkeypatch.setattr(J, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(11)
    base = [f"s{i}" for i in range(90)]
    docs = [(500, " ".join(base))] if centre else []
    for i in range(90):
        words = list(base)
        for k in rng.choice(90, int(rng.integers(1, 4)), replace=False).tolist():
            words[k] = f"n{i}x{k}"
        docs.append((i, " ".join(words + [f"t{i}y{k}" for k in range(i % 9)])))
    check(spark, docs, 9)


def test_repeated_ids_tie_their_texts(spark):
    first, second = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(1, first), (5, first), (5, second), (7, second)], "doc_id long, text string").repartition(4)
    assert sorted(r["component_id"] for r in J.similar_components(df).collect()) == [1, 1, 1, 1]


def test_join_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, " \t\n", 1), (3, "one two", 1), (4, "One  TWO", 2), (5, "ÉTÉ a b c d e", 1), (6, "été a b c d e", 1), (None, "one two", 1), (7, "x " * 30_000, 1), (7, "x " * 30_000, 1)], "doc_id long, text string, node int")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in J.similar_components(df).collect())
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 1, "3"), ("4", 1, "3"), ("5", 2, "5"), ("6", 2, "6"), ("None", 1, "None"), ("7", 1, "7"), ("7", 1, "7")])
    assert J.similar_components(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(3)
    rule = J.Jaccard()
    for n in (3, 60, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 1 << 63, max(1, n // 12)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert J.overlap_bound(J.count_vector(a), J.count_vector(b)) >= both
        assert rule.links(a, b) == (100 * both >= 80 * (len(a) + len(b) - both))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100), (7, 7)]
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 100: 50}
