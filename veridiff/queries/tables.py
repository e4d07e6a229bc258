"""Table comparison over the orders pair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import tables as O
from ..plans.models import AlignPlan, ColumnRule, ComparePlan
from ..strategies import table as T
from .registry import query, rounded

PAIR = ("table_ref", "table_cand")
KEYS = AlignPlan(id_columns=("o_orderkey",))
J = """, j AS (SELECT coalesce(a.o_orderkey, b.O_ORDERKEY) AS k, a.o_orderkey AS lk, b.O_ORDERKEY AS rk, a.o_custkey AS c1, b.O_CUSTKEY AS c2, a.o_orderstatus AS s1, b.O_ORDERSTATUS AS s2,
  a.o_totalprice AS p1, b.O_TOTALPRICE AS p2, a.o_orderpriority AS r1, b.O_ORDERPRIORITY AS r2 FROM table_ref a FULL JOIN table_cand b ON a.o_orderkey = b.O_ORDERKEY)"""
RAE = "CASE WHEN {0} IS NULL THEN NULL WHEN {0} = 0 AND {1} = 0 THEN 1 WHEN {0} = 0 THEN 0 WHEN {1} IS NULL THEN NULL ELSE greatest(0, least(1, 1 - abs({0} - {1}) / abs({0}))) END"
COLUMNS = f"""{J}, m AS (
  SELECT 'o_custkey' AS "column", 'rae' AS strategy, avg({RAE.format("c1", "c2")}) AS similarity, sum(CASE WHEN {RAE.format("c1", "c2")} >= 1 - 1e-6 THEN 1 ELSE 0 END)::BIGINT AS matching, count({RAE.format("c1", "c2")}) AS total FROM j
  UNION ALL SELECT 'o_orderstatus', 'exact', avg(CASE WHEN s1 IS NOT DISTINCT FROM s2 THEN 1.0 ELSE 0 END), sum(CASE WHEN s1 IS NOT DISTINCT FROM s2 THEN 1 ELSE 0 END)::BIGINT, count(*) FROM j
  UNION ALL SELECT 'o_totalprice', 'rae', avg({RAE.format("p1", "p2")}), sum(CASE WHEN {RAE.format("p1", "p2")} >= 1 - 1e-6 THEN 1 ELSE 0 END)::BIGINT, count({RAE.format("p1", "p2")}) FROM j
  UNION ALL SELECT 'o_orderpriority', 'exact', avg(CASE WHEN r1 IS NOT DISTINCT FROM r2 THEN 1.0 ELSE 0 END), sum(CASE WHEN r1 IS NOT DISTINCT FROM r2 THEN 1 ELSE 0 END)::BIGINT, count(*) FROM j)"""


def _pair(spark, sf_dir):
    return load(spark, sf_dir, *PAIR)


@query(COLUMNS + ' SELECT "column", strategy, round(similarity, 6) AS similarity, matching, total FROM m', PAIR)
def table_approx_columns(spark, sf_dir):
    return rounded(T.columns(*_pair(spark, sf_dir), KEYS))


@query(COLUMNS + " SELECT round(avg(similarity), 6) AS similarity, count(similarity) AS n_columns FROM m", PAIR)
def table_approx_overall(spark, sf_dir):
    return rounded(T.approximate(*_pair(spark, sf_dir), KEYS))


@query(
    J
    + """, r AS (SELECT *, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2.0 AS x, rank() OVER (ORDER BY p2) + (count(*) OVER (PARTITION BY p2) - 1) / 2.0 AS y FROM j WHERE p1 IS NOT NULL AND p2 IS NOT NULL)
    SELECT 'o_totalprice' AS "column", 'spearman' AS strategy, round((corr(x, y) + 1) / 2, 6) AS similarity, count(*) AS matching, (SELECT count(*) FROM j) AS total FROM r
    UNION ALL SELECT 'o_custkey', 'pearson', round((corr(c1, c2) + 1) / 2, 6), count(CASE WHEN c1 IS NOT NULL AND c2 IS NOT NULL THEN 1 END), count(*) FROM j""",
    PAIR,
)
def table_correlation_columns(spark, sf_dir):
    rules = ComparePlan((ColumnRule("o_totalprice", "spearman"), ColumnRule("o_custkey", "pearson")))
    return rounded(T.columns(*_pair(spark, sf_dir), KEYS, rules))


@query(
    J
    + """, t AS (SELECT *, (CASE WHEN s1 IS NOT DISTINCT FROM s2 THEN 1 ELSE 0 END + CASE WHEN p1 IS NOT DISTINCT FROM p2 THEN 1 ELSE 0 END + CASE WHEN r1 IS NOT DISTINCT FROM r2 THEN 1 ELSE 0 END + CASE WHEN c1 IS NOT DISTINCT FROM c2 THEN 1 ELSE 0 END) AS m FROM j WHERE lk IS NOT NULL AND rk IS NOT NULL)
    SELECT round(sum(m) / (count(*) * 4), 6) AS similarity, sum(m)::BIGINT AS matching_cells, count(*) * 4 AS total_cells, false AS identical FROM t""",
    PAIR,
)
def table_exact(spark, sf_dir):
    return rounded(T.exact(*_pair(spark, sf_dir), order="o_orderkey"))


@query(
    """, n AS (SELECT v, sum(p) AS p, sum(q) AS q FROM (
        SELECT unnest([o_orderkey::DOUBLE, o_custkey::DOUBLE, o_totalprice]) AS v, 1 AS p, 0 AS q FROM table_ref UNION ALL SELECT unnest([O_ORDERKEY::DOUBLE, O_CUSTKEY::DOUBLE, O_TOTALPRICE]), 0, 1 FROM table_cand) GROUP BY v),
    l AS (SELECT min(v) AS lo, max(v) AS hi FROM n),
    h AS (SELECT least(floor((v - lo) / (hi - lo) * 50), 49) AS b, sum(p) AS p, sum(q) AS q FROM n, l GROUP BY 1),
    k AS (SELECT v, sum(p) AS p, sum(q) AS q FROM (
        SELECT unnest([o_orderstatus, o_orderpriority]) AS v, 1 AS p, 0 AS q FROM table_ref UNION ALL SELECT unnest([O_ORDERSTATUS, O_ORDERPRIORITY]), 0, 1 FROM table_cand) WHERE v IS NOT NULL GROUP BY v),
    s AS (SELECT (SELECT count(*) FROM table_ref) AS nr, (SELECT count(*) FROM table_cand) AS nc, (SELECT count(*) FROM table_cand WHERE O_ORDERPRIORITY IS NULL) AS mc),
    o AS (SELECT (1 - abs(nr - nc) / nr + 1.0 + 0.0) / 3 AS structural, CASE WHEN mc > 0 THEN 0.0 ELSE 1.0 END AS missing,
      (SELECT 1 - sqrt(sum(pow(sqrt(p / (SELECT sum(p) FROM h)) - sqrt(q / (SELECT sum(q) FROM h)), 2)) / 2) FROM h) AS numeric_,
      (SELECT 1 - sqrt(sum(pow(sqrt(p / (SELECT sum(p) FROM k)) - sqrt(q / (SELECT sum(q) FROM k)), 2)) / 2) FROM k) AS categorical FROM s)
    SELECT round((structural + missing + numeric_ + categorical) / 4, 6) AS similarity, round(structural, 6) AS structural, round(missing, 6) AS missing, round(numeric_, 6) AS "numeric", round(categorical, 6) AS categorical FROM o""",
    PAIR,
)
def table_summary(spark, sf_dir):
    return rounded(T.summary(*_pair(spark, sf_dir)))


@query(J + " SELECT CASE WHEN lk IS NULL THEN 'cand' WHEN rk IS NULL THEN 'ref' ELSE 'both' END AS side, count(*) AS n, round(sum(p1), 2) AS ref_price, round(sum(p2), 2) AS cand_price FROM j GROUP BY 1", PAIR)
def table_outer_align(spark, sf_dir):
    ref, cand = O.align_columns(*_pair(spark, sf_dir))
    j = O.outer_align(ref, cand, ["o_orderkey"])
    return j.groupBy(F.col("_side").alias("side")).agg(F.count("*").alias("n"), F.round(F.sum("`o_totalprice@r`"), 2).alias("ref_price"), F.round(F.sum("`o_totalprice@c`"), 2).alias("cand_price"))


@query(
    """, n AS (SELECT count(DISTINCT o_orderkey) AS r, (SELECT count(DISTINCT O_ORDERKEY) FROM table_cand) AS c, (SELECT count(*) FROM table_ref a JOIN table_cand b ON a.o_orderkey = b.O_ORDERKEY) AS o FROM table_ref)
    SELECT r AS n_ref, c AS n_cand, o AS n_both, round(o / c, 6) AS "precision", round(o / r, 6) AS recall, round(2 * (o / c) * (o / r) / (o / c + o / r), 6) AS f1, round(o / (r + c - o), 6) AS jaccard FROM n""",
    PAIR,
)
def table_overlap(spark, sf_dir):
    ref, cand = O.align_columns(*_pair(spark, sf_dir))
    return rounded(O.key_overlap(ref, cand, ["o_orderkey"]))


@query(
    J
    + """ SELECT round(sum((CASE WHEN (c1 IS NULL) = (c2 IS NULL) THEN 1 ELSE 0 END) + (CASE WHEN (s1 IS NULL) = (s2 IS NULL) THEN 1 ELSE 0 END) + (CASE WHEN (p1 IS NULL) = (p2 IS NULL) THEN 1 ELSE 0 END) + (CASE WHEN (r1 IS NULL) = (r2 IS NULL) THEN 1 ELSE 0 END)) / (count(*) * 4), 6) AS pattern_similarity,
    round(sum((c1 IS NULL)::INT + (s1 IS NULL)::INT + (p1 IS NULL)::INT + (r1 IS NULL)::INT) / (count(*) * 4), 6) AS ref_missing, round(sum((c2 IS NULL)::INT + (s2 IS NULL)::INT + (p2 IS NULL)::INT + (r2 IS NULL)::INT) / (count(*) * 4), 6) AS cand_missing FROM j""",
    PAIR,
)
def table_missing(spark, sf_dir):
    ref, cand = O.align_columns(*_pair(spark, sf_dir))
    return rounded(O.missing_pattern(O.outer_align(ref, cand, ["o_orderkey"]), [c for c in ref.columns if c != "o_orderkey"]))


@query(
    J
    + """, t AS (SELECT list_distinct(list_filter(list_transform(string_split(r1, '-'), lambda x: trim(x)), lambda x: x <> '')) AS a, list_distinct(list_filter(list_transform(string_split(r2, '-'), lambda x: trim(x)), lambda x: x <> '')) AS b FROM j),
    u AS (SELECT CASE WHEN coalesce(len(a), 0) = 0 AND coalesce(len(b), 0) = 0 THEN 1.0 WHEN coalesce(len(a), 0) = 0 OR coalesce(len(b), 0) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS s FROM t)
    SELECT 'o_orderpriority' AS "column", 'overlap' AS strategy, round(avg(s), 6) AS similarity, sum(CASE WHEN s >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS matching, count(*) AS total FROM u""",
    PAIR,
)
def table_cell_jaccard(spark, sf_dir):
    return rounded(T.columns(*_pair(spark, sf_dir), KEYS, ComparePlan((ColumnRule("o_orderpriority", "overlap", delimiter="-", threshold=0.5),))))


@query(
    """, a AS (SELECT row_number() OVER (ORDER BY n_nationkey) AS o, n_name FROM nation), b AS (SELECT row_number() OVER (ORDER BY n_name DESC) AS o, n_name FROM nation)
    SELECT true AS same_rows, sum(CASE WHEN a.n_name = b.n_name THEN 0 ELSE 1 END)::BIGINT AS moved, sum(CASE WHEN a.n_name = b.n_name THEN 0 ELSE 1 END) > 0 AS is_permutation FROM a JOIN b USING (o)""".replace(", a AS", "WITH a AS", 1)
)
def table_permutation(spark, sf_dir):
    from pyspark.sql import Window

    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    a = n.select(F.row_number().over(Window.orderBy("n_nationkey")).alias("o"), "n_name")
    b = n.select(F.row_number().over(Window.orderBy(F.desc("n_name"))).alias("o"), "n_name")
    return O.is_permutation(a, b, "o")


@query("SELECT 0.5 AS dtype_match, 4 AS columns_checked")
def table_dtype_match(spark, sf_dir):
    """Share of common columns of one type, after two of four columns were read as text."""
    ref = load(spark, sf_dir, "table_ref").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    cand = ref.withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_totalprice", F.col("o_totalprice").cast("string"))
    return spark.range(1).select(F.lit(O.dtype_match(ref, cand)).cast("double").alias("dtype_match"), F.lit(len(ref.columns)).alias("columns_checked"))


@query("SELECT 'Supplier#' || s_suppkey AS ref_id, 'SUPPLIER_' || s_suppkey AS cand_id FROM supplier WHERE s_suppkey % 3 = 0")
def table_fuzzy_id(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    ref = s.select(F.concat(F.lit("Supplier#"), "s_suppkey").alias("id"))
    cand = s.select(F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("SUPPLIER_"), "s_suppkey")).otherwise(F.concat(F.lit("Supplier#"), "s_suppkey")).alias("id"))
    return O.fuzzy_pairs(ref, cand)


@query("SELECT 'l_orderkey,l_linenumber' AS id_columns WHERE (SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem) UNION ALL SELECT 'none' WHERE NOT (SELECT count(*) = count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem)")
def table_id_columns(spark, sf_dir):
    """Smallest unique set of columns: order and line number where they identify a line."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    found = O.find_id_columns(line, line, most=2)
    return spark.range(1).select(F.lit(",".join(found) or "none").alias("id_columns"))


@query("SELECT 'r_name' AS key, max(CASE WHEN r_regionkey = 0 THEN r_name END) AS \"0\", max(CASE WHEN r_regionkey = 1 THEN r_name END) AS \"1\", max(CASE WHEN r_regionkey = 2 THEN r_name END) AS \"2\", max(CASE WHEN r_regionkey = 3 THEN r_name END) AS \"3\", max(CASE WHEN r_regionkey = 4 THEN r_name END) AS \"4\" FROM region")
def table_transpose(spark, sf_dir):
    return O.transpose(spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name"), "r_regionkey")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM table_ref QUALIFY place <= 100", ("table_ref",))
def table_sorted_head(spark, sf_dir):
    """Preview: the first rows after a sort by several columns."""
    top = O.sort_rows(load(spark, sf_dir, "table_ref"), ["o_orderstatus", "o_totalprice", "absent", "o_orderkey"], [True, False]).limit(100)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy("o_orderstatus", F.desc("o_totalprice"), "o_orderkey"))).select("o_orderkey", "o_orderstatus", "o_totalprice", "place")


@query(
    """, j AS (SELECT a.o_custkey::DOUBLE AS x1, b.O_CUSTKEY::DOUBLE AS y1, a.o_totalprice AS x2, b.O_TOTALPRICE AS y2 FROM table_ref a JOIN table_cand b ON a.o_orderkey = b.O_ORDERKEY),
    c AS (SELECT corr(x1, y1) AS p1, corr(x2, y2) AS p2 FROM j)
    SELECT 'o_custkey' AS "column", round(p1, 6) AS pearson FROM c UNION ALL SELECT 'o_totalprice', round(p2, 6) FROM c UNION ALL SELECT NULL, round((p1 + p2) / 2, 6) FROM c""",
    ("table_ref", "table_cand"),
)
def table_pearson_columns(spark, sf_dir):
    ref, cand = load(spark, sf_dir, "table_ref", "table_cand")
    ref, cand = O.align_columns(ref, cand)
    joined = O.inner_align(ref, cand, ["o_orderkey"])
    return rounded(O.pearson_columns(joined, ["o_custkey", "o_totalprice"]))


@query("SELECT lower('Label ' || n_nationkey) AS label, n_name AS a, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END AS b, CASE WHEN n_nationkey % 3 = 0 THEN 'ref' ELSE 'both' END AS side FROM nation")
def table_label_align(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    ref = n.select(F.concat(F.lit("Label "), "n_nationkey").alias("label"), F.col("n_name").alias("v"))
    cand = n.where("n_nationkey % 3 <> 0").select(F.concat(F.lit("LABEL "), "n_nationkey").alias("label"), F.col("n_regionkey").alias("v"))
    j = O.align_labels(ref, cand, "label")
    return j.select("label", F.col("`v@r`").alias("a"), F.col("`v@c`").alias("b"), F.col("_side").alias("side"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer")
def table_to_numbers(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("n/a "), "c_custkey")).otherwise(F.col("c_acctbal").cast("string"))
    return O.to_numbers(c.select("c_custkey", text.alias("v")), ["v"])
