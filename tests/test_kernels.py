"""Kernels on hand-made values, identity pairs and empty candidates."""

import math

import pytest
from pyspark.sql import functions as F

from veridiff.functions import kernels as K
from veridiff.fixtures import load
from veridiff.operators import tables as O
from veridiff.operators.dist import histogram_similarity
from veridiff.plans.models import AlignPlan
from veridiff.strategies import bam, bed, fasta, signals, table, vcf


def one(spark, expr, x, y):
    return spark.createDataFrame([(x, y)], "x double, y double").select(expr(F.col("x"), F.col("y")).alias("v")).first()["v"]


@pytest.mark.parametrize("x,y,want", [(0, 0, 1), (0, 5, 0), (10, 5, 0.5), (10, 30, 0), (-4, -2, 0.5), (0, None, 0), (3, None, None), (None, 3, None)])
def test_rae(spark, x, y, want):
    x, y = (None if v is None else float(v) for v in (x, y))
    assert one(spark, K.rae_similarity, x, y) == want


def test_other_kernels(spark):
    assert one(spark, K.min_max_ratio, 2.0, 8.0) == 0.25
    assert one(spark, K.min_max_ratio, 0.0, 8.0) == 0
    assert one(spark, K.relative_error, 0.0, 1.0) == math.inf
    assert one(spark, K.normalized_difference, 3.0, -3.0) is None


def test_hellinger(spark):
    def h(pairs):
        return spark.createDataFrame(pairs, "p double, q double").agg(K.hellinger_agg(F.col("p"), F.col("q")).alias("v")).first()["v"]

    assert h([(1.0, 2.0), (3.0, 6.0)]) == pytest.approx(0, abs=1e-7)
    assert h([(1.0, 0.0), (0.0, 1.0)]) == pytest.approx(1)
    assert h([(1.0, 0.0), (2.0, 0.0)]) is None
    assert h([(-1.0, 1.0), (2.0, 1.0)]) is None
    assert h([(3.0, 1.0), (1.0, 3.0)]) == pytest.approx(h([(1.0, 3.0), (3.0, 1.0)]))


def test_jaccard_and_prf(spark):
    r = spark.range(1).select(K.jaccard(F.lit(0), F.lit(0), F.lit(0)).alias("e"), K.jaccard(F.lit(2), F.lit(4), F.lit(3)).alias("j"), K.precision(F.lit(1), F.lit(0)).alias("p"), K.f1(F.lit(0.0), F.lit(0.0)).alias("f")).first()
    assert (r["e"], r["j"], r["p"], r["f"]) == (1.0, 0.4, 0.0, 0.0)


def test_histogram_bins_close_on_the_right(spark):
    r = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double").select(K.histogram_bin(F.col("v"), F.lit(0.0), F.lit(1.0), 4).alias("b")).collect()
    assert [x["b"] for x in r] == [0, 2, 3]
    same = spark.createDataFrame([(2.0,)] * 3, "v double")
    assert histogram_similarity(same, same, "v", 5).first()["similarity"] == pytest.approx(1)


def test_average_ranks(spark):
    r = O.average_ranks(spark.createDataFrame([(v,) for v in (5.0, 1.0, 5.0, 2.0, 5.0, None)], "v double"), "v").collect()
    assert {x["v"]: x["rank"] for x in r} == {1.0: 1.0, 2.0: 2.0, 5.0: 4.0}


IDENTITY = {
    "table": lambda s, d: table.approximate(*[load(s, d, "table_ref")] * 2, AlignPlan(id_columns=("o_orderkey",))),
    "table_exact": lambda s, d: table.exact(*[load(s, d, "table_ref")] * 2, order="o_orderkey"),
    "table_summary": lambda s, d: table.summary(*[load(s, d, "table_ref")] * 2),
    "bed": lambda s, d: bed.exact(*[load(s, d, "bed_ref")] * 2),
    "bed_overlap": lambda s, d: bed.overlap(*[load(s, d, "bed_ref")] * 2),
    "bed_summary": lambda s, d: bed.summary(*[load(s, d, "bed_ref")] * 2),
    "vcf_exact": lambda s, d: vcf.exact(*[load(s, d, "vcf_raw")] * 2),
    "vcf": lambda s, d: vcf.approximate(*[load(s, d, "vcf_raw")] * 2),
    "vcf_summary": lambda s, d: vcf.summary(*[load(s, d, "vcf_raw")] * 2),
    "bam_exact": lambda s, d: bam.exact(*[load(s, d, "sam_ref")] * 2),
    "bam_summary": lambda s, d: bam.summary(*[load(s, d, "sam_ref")] * 2),
    "fasta": lambda s, d: fasta.exact(*[load(s, d, "seq_ref")] * 2),
    "fasta_summary": lambda s, d: fasta.summary(*[load(s, d, "seq_ref")] * 2),
    "bigwig": lambda s, d: signals.exact(*[load(s, d, "signal_ref")] * 2),
    "bigwig_summary": lambda s, d: signals.summary(*[load(s, d, "signal_ref")] * 2),
    "fai": lambda s, d: signals.fai_exact(*[load(s, d, "fai_ref")] * 2),
}


@pytest.mark.parametrize("name", sorted(IDENTITY))
def test_identity_pairs_score_one(spark, data, name):
    assert IDENTITY[name](spark, data).first()["similarity"] == pytest.approx(1.0, abs=1e-7)


def test_empty_candidates(spark, data):
    none = load(spark, data, "bed_ref").limit(0)
    assert bed.approximate(load(spark, data, "bed_ref"), none).first()["similarity"] is None
    ref = load(spark, data, "vcf_raw")
    assert vcf.approximate(ref, ref.limit(0)).first()["similarity"] == 0
    seq = load(spark, data, "seq_ref")
    assert fasta.exact(seq, seq.limit(0)).first()["similarity"] == 0


def test_row_order_does_not_matter(spark, data):
    ref, cand = load(spark, data, "table_ref", "table_cand")
    plan = AlignPlan(id_columns=("o_orderkey",))
    a = table.approximate(ref, cand, plan).first()["similarity"]
    b = table.approximate(ref.orderBy(F.rand(3)), cand.orderBy(F.rand(4)), plan).first()["similarity"]
    assert a == pytest.approx(b)


def test_table_plan_is_one_join_and_one_aggregate(spark, data):
    plan = table.columns(*load(spark, data, "table_ref", "table_cand"), AlignPlan(id_columns=("o_orderkey",)))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join FullOuter") == 1 and text.count("Aggregate [") == 1


def test_merge_touching_and_bins(spark):
    from veridiff.operators.intervals import merge

    df = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("a", 5, 7), ("a", 30, 70), ("a", 31, 32), ("a", 69, 71), ("b", 1, 2)], "chrom string, start long, end long")
    want = [("a", 0, 20), ("a", 30, 71), ("b", 1, 2)]
    for width in (4, 16, 1000):
        assert sorted(map(tuple, merge(df, width).collect())) == want


def test_depth_with_reads_beyond_the_contig(spark):
    from veridiff.operators.alignments import depth

    reads = spark.createDataFrame([("a", 2, 0, "4M"), ("a", 14, 0, "2M"), ("a", 20, 0, "3M"), ("b", 1, 4, "4M")], "rname string, pos long, flag int, cigar string")
    sizes = spark.createDataFrame([("a", 10), ("b", 10)], "chrom string, size int")
    runs = [("a", 0, 2, 0), ("a", 2, 6, 1), ("a", 6, 10, 0), ("a", 14, 16, 1), ("a", 20, 23, 1)]
    assert sorted(map(tuple, depth(reads, sizes).collect())) == runs
    assert sorted(map(tuple, depth(reads).collect())) == [r for r in runs if r[3]]


def test_bam_depth_beyond_its_size(spark, tmp_path):
    """Parts beyond the fixture's contig size of 22000, against the SQL."""
    from tests.oracle import connect, rows_of, rows_of_sql
    from veridiff.queries import QUERIES, SQL

    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    t = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(*cols)
    far = t.withColumn("l_partkey", F.col("l_partkey") + 40_000).withColumn("l_orderkey", F.col("l_orderkey") + 10_000_000)
    t.unionByName(far).coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("part-*.parquet")).rename(tmp_path / "lineitem.parquet")
    got = rows_of(QUERIES["bam_depth"](spark, str(tmp_path)))
    assert got == rows_of_sql(connect(str(tmp_path)), SQL["bam_depth"])


def test_values_at_one_place_are_chosen_alike(spark):
    """Repeated sites whose order is equal too: the choice must not hang on the order that rows arrive in."""
    from veridiff.operators.variants import flatten

    rows = [("c", i, "A", "C", q, f, i) for i in range(20) for q, f in ((5.0, "PASS"), (0.0, "q10"), (7.0, "PASS"), (7.0, "q10"))]
    schema = "chrom string, pos long, ref string, alts string, qual double, filter string, ord long"
    ref, cand = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema)
    for side in (ref, cand):
        assert {(r["qual"], r["filter"]) for r in flatten(side).collect()} == {(7.0, "q10")}
    assert vcf.exact(ref, cand).first().asDict() == {"similarity": 1.0, "n_ref": 20, "n_cand": 20, "n_both": 20, "details_equal": 20}


SITES = "chrom string, pos long, ref string, alts string, qual double, filter string, ord long"


@pytest.mark.parametrize("order", ["b1 b2 a1 a2", "a1 b1 a2 b2", "b1 a1 a2 b2", "a2 a1 b1 b2", "a1 a2 b1 b2"])
def test_vcf_exact_compares_order_across_chromosomes(spark, order):
    """Chromosomes that change places or mix, each in its own order, are another order of the whole."""
    side = lambda names: spark.createDataFrame([(n[0], int(n[1]), "A", "C,G", 5.0, "PASS", i) for i, n in enumerate(names.split())], SITES)
    got = vcf.exact(side("a1 a2 b1 b2"), side(order)).first().asDict()
    assert got == {"similarity": 1.0 if order == "a1 a2 b1 b2" else 0.0, "n_ref": 8, "n_cand": 8, "n_both": 8, "details_equal": 8}


def test_vcf_exact_keeps_sites_without_a_place(spark):
    rows = [("a", i, "A", "C", 5.0, "PASS", None if i > 7 else i % 4) for i in range(10)]
    ref, cand = spark.createDataFrame(rows, SITES), spark.createDataFrame(rows[::-1], SITES)
    assert vcf.exact(ref, cand).first().asDict() == {"similarity": 1.0, "n_ref": 10, "n_cand": 10, "n_both": 10, "details_equal": 10}
