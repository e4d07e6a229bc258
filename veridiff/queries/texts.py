"""Text comparison over document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import load
from ..operators import texts as T
from ..strategies import txt as S
from .registry import query, rounded

PAIR = ("text_ref", "text_cand")
WHOLE = ", a AS (SELECT doc, string_agg(line, chr(10) ORDER BY line_no) AS x FROM text_ref GROUP BY doc), b AS (SELECT doc, string_agg(line, chr(10) ORDER BY line_no) AS y FROM text_cand GROUP BY doc), w AS (SELECT doc, x, coalesce(y, '') AS y FROM a LEFT JOIN b USING (doc))"


def _stat(c: str) -> dict[str, str]:
    return {
        "num_lines": f"(CASE WHEN len({c}) = 0 THEN 0 ELSE len(string_split({c}, chr(10))) - CASE WHEN ends_with({c}, chr(10)) THEN 1 ELSE 0 END END)",
        "num_words": f"len(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''))",
        "num_characters": f"len({c})",
        "num_characters_no_whitespace": f"len(regexp_replace({c}, '[ \\n\\t]', '', 'g'))",
        "num_sentences": f"len(list_filter(regexp_split_to_array({c}, '[.!?]+'), lambda s: len(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) > 0))",
    }


def _rae(x: str, y: str) -> str:
    return f"CASE WHEN {x} = 0 AND {y} = 0 THEN 1 WHEN {x} = 0 THEN 0 ELSE greatest(0, least(1, 1 - abs({x} - {y}) / abs({x}))) END"


def _pairs(spark, sf_dir):
    a, b = load(spark, sf_dir, *PAIR)
    return T.joined(a).withColumnRenamed("text", "ref").join(T.joined(b).withColumnRenamed("text", "cand"), "doc", "left").withColumn("cand", F.coalesce("cand", F.lit("")))


@query(", j AS (SELECT coalesce(a.doc, b.doc) AS doc, (a.doc IS NOT NULL AND b.doc IS NOT NULL AND lower(a.line) IS NOT DISTINCT FROM lower(b.line)) AS ok FROM text_ref a FULL JOIN text_cand b ON a.doc = b.doc AND a.line_no = b.line_no) SELECT doc, min(ok::INT)::DOUBLE AS similarity, sum(ok::INT)::BIGINT AS n_equal, count(*) AS n_lines FROM j GROUP BY doc", PAIR)
def txt_exact(spark, sf_dir):
    return S.exact(*load(spark, sf_dir, *PAIR), ignore_case=True)


@query(WHOLE + ", s AS (SELECT doc, " + ", ".join(f"{_rae(_stat('x')[k], _stat('y')[k])} AS {k}" for k in _stat("x")) + ") SELECT doc, round((num_lines + num_words + num_characters + num_characters_no_whitespace + num_sentences) / 5, 6) AS similarity, ".replace(") SELECT", " FROM w) SELECT", 1) + ", ".join(f"round({k}, 6) AS {k}" for k in _stat("x")) + " FROM s", PAIR)
def txt_summary(spark, sf_dir):
    return rounded(S.summary(_pairs(spark, sf_dir)))


@query(" SELECT o_orderkey, round(CASE WHEN o_totalprice = 0 THEN 1 ELSE greatest(0, 1 - abs(o_totalprice - (o_totalprice + o_custkey % 7)) / o_totalprice) END, 6) AS similarity, CASE WHEN abs((o_custkey % 7) / o_totalprice) <= 0.0001 THEN 1.0 ELSE 0.0 END::DOUBLE AS within FROM orders")
def txt_numeric(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    a, b = F.concat(F.lit(" "), F.col("o_totalprice").cast("string")), (F.col("o_totalprice") + F.col("o_custkey") % 7).cast("string")
    return rounded(o.select("o_orderkey", S.numeric(a, b).alias("similarity"), S.numeric(a, b, 0.0001).alias("within")))


@query()
def txt_approx(spark, sf_dir):
    """Matching lines of each document's versions, letters lowered."""
    return rounded(S.approximate(_pairs(spark, sf_dir), ignore_whitespace=False))
