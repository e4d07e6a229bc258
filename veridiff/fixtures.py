"""Reference and candidate pairs made from the star-schema tables by fixed rules, for queries, tests and the benchmark.

Each fixture is one SELECT in the dialect that Spark SQL and other engines share; ``{table}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL: dict[str, str] = {
    # P1: orders with dropped, changed, blanked and added rows
    "table_ref": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders}",
    "table_cand": """
        SELECT o_orderkey AS O_ORDERKEY, o_custkey AS O_CUSTKEY, CASE WHEN o_orderkey % 19 = 0 THEN 'X' ELSE o_orderstatus END AS O_ORDERSTATUS,
          CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice * CAST(1.02 AS DOUBLE) ELSE o_totalprice END AS O_TOTALPRICE,
          CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderpriority END AS O_ORDERPRIORITY FROM {orders} WHERE o_orderkey % 17 <> 0
        UNION ALL SELECT o_orderkey + 10000000, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM {orders} WHERE o_orderkey % 29 = 0""",
    # P2: intervals
    "bed_ref": """
        SELECT event_type AS chrom, user_id * 100 + event_id % 50 AS "start", user_id * 100 + event_id % 50 + 20 + event_id % 7 AS "end", value AS score, event_id AS ord FROM {events}""",
    "bed_cand": """
        SELECT event_type AS chrom, user_id * 100 + event_id % 50 + event_id % 3 AS "start", user_id * 100 + event_id % 50 + 20 + event_id % 7 + event_id % 3 AS "end",
          value * CAST(1.1 AS DOUBLE) AS score, event_id AS ord FROM {events} WHERE event_id % 11 <> 0""",
    # P3: variants; some rows have two alternatives, some none
    "vcf_raw": """
        SELECT l_returnflag || l_linestatus AS chrom, l_orderkey * 10 + l_linenumber AS pos, substr('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) AS ref,
          CASE WHEN l_orderkey % 41 = 0 THEN '' WHEN l_linenumber = 2 THEN substr('CGTA', CAST(l_suppkey % 4 + 1 AS INT), 1) || ',' || substr('GTAC', CAST(l_suppkey % 4 + 1 AS INT), 1)
            WHEN l_linenumber = 3 THEN substr('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) || 'TT' ELSE substr('CGTA', CAST(l_suppkey % 4 + 1 AS INT), 1) END AS alts,
          CASE WHEN l_quantity < 2 THEN 0 ELSE l_quantity END AS qual, CASE WHEN l_linenumber % 3 = 0 THEN 'PASS' ELSE 'q10;s50' END AS filter,
          l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 10 AS ord FROM {lineitem}""",
    "vcf_raw_cand": """
        SELECT l_returnflag || l_linestatus AS chrom, l_orderkey * 10 + l_linenumber AS pos, substr('ACGT', CAST(l_suppkey % 4 + 1 AS INT), 1) AS ref,
          CASE WHEN l_orderkey % 37 = 0 THEN substr('TACG', CAST(l_suppkey % 4 + 1 AS INT), 1) ELSE substr('CGTA', CAST(l_suppkey % 4 + 1 AS INT), 1) END AS alts,
          CASE WHEN l_quantity < 2 THEN 0 ELSE l_quantity END AS qual, CASE WHEN l_linenumber % 3 = 0 THEN 'PASS' ELSE 'q10;s50' END AS filter,
          l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey * 10 AS ord FROM {lineitem} WHERE l_orderkey % 31 <> 0""",
    # P4: sequences
    "seq_ref": "SELECT item_id AS id, upper(regexp_replace(text, '[^A-Za-z]'@all)) AS seq, item_id AS ord FROM {benchmark}",
    "seq_cand": """
        SELECT item_id AS id, CASE WHEN item_id % 5 = 0 THEN 'Q' || substr(s, 2) ELSE s END AS seq, item_id AS ord
        FROM (SELECT item_id, upper(regexp_replace(text, '[^A-Za-z]'@all)) AS s FROM {benchmark}) t WHERE item_id % 9 <> 0
        UNION ALL SELECT item_id + 100000, upper(regexp_replace(text, '[^A-Za-z]'@all)), item_id + 100000 FROM {benchmark} WHERE item_id % 7 = 0""",
    # P6: alignments, one per (qname, mate)
    "sam_ref": """
        SELECT qname, is_read2, flag, rname, pos, mapq, len, cigar, rnext, pnext, tlen, qual, ord FROM (
          SELECT CASE l_linenumber % 3 WHEN 0 THEN '50M' WHEN 1 THEN '20M30N30M' ELSE '5S25M5D20M' END AS cigar, '=' AS rnext, l_partkey + 200 AS pnext, l_partkey % 300 AS tlen, 'III' AS qual, l_orderkey || '-' || l_suppkey AS qname, l_linenumber % 2 AS is_read2,
            1 + CASE WHEN l_linenumber % 2 = 1 THEN 128 ELSE 64 END + CASE WHEN l_partkey % 41 = 0 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 0 END
              + CASE WHEN l_linenumber = 6 THEN 256 ELSE 0 END + CASE WHEN l_suppkey % 7 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_orderkey % 50 = 0 THEN 512 ELSE 0 END AS flag,
            l_returnflag AS rname, l_partkey AS pos, CAST(floor(l_quantity) AS INT) AS mapq, CASE l_linenumber % 3 WHEN 1 THEN 80 ELSE 50 END AS len, l_orderkey * 10 + l_linenumber AS ord,
            row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey) AS rn FROM {lineitem}) t WHERE rn = 1""",
    "sam_cand": """
        SELECT qname, is_read2, flag, rname, CASE WHEN okey % 21 = 0 THEN pos + 100 WHEN okey % 10 = 0 THEN pos + 1 ELSE pos END AS pos, mapq, len,
          CASE WHEN cigar = '50M' AND okey % 4 = 0 THEN '25M25M' WHEN cigar = '20M30N30M' AND okey % 8 = 1 THEN '50M30N' ELSE cigar END AS cigar, rnext, CASE WHEN okey % 18 = 0 THEN pnext + 1 ELSE pnext END AS pnext, tlen, CASE WHEN okey % 26 = 0 THEN 'II#' ELSE 'III' END AS qual, ord FROM (
          SELECT CASE l_linenumber % 3 WHEN 0 THEN '50M' WHEN 1 THEN '20M30N30M' ELSE '5S25M5D20M' END AS cigar, '=' AS rnext, l_partkey + 200 AS pnext, l_partkey % 300 AS tlen, l_orderkey AS okey, l_orderkey || '-' || l_suppkey AS qname, l_linenumber % 2 AS is_read2,
            1 + CASE WHEN l_linenumber % 2 = 1 THEN 128 ELSE 64 END + CASE WHEN l_partkey % 43 = 0 THEN 4 ELSE 0 END + CASE WHEN l_partkey % 5 = 0 THEN 2 ELSE 0 END
              + CASE WHEN l_linenumber = 6 THEN 256 ELSE 0 END + CASE WHEN l_suppkey % 7 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_orderkey % 50 = 0 THEN 512 ELSE 0 END AS flag,
            l_returnflag AS rname, l_partkey AS pos, CAST(floor(l_quantity) AS INT) AS mapq, CASE l_linenumber % 3 WHEN 1 THEN 80 ELSE 50 END AS len, l_orderkey * 10 + l_linenumber AS ord,
            row_number() OVER (PARTITION BY l_orderkey, l_suppkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey) AS rn FROM {lineitem}) t WHERE rn = 1 AND okey % 33 <> 0""",
    # P7: depth and signal
    "signal_ref": "SELECT l_returnflag AS chrom, l_partkey AS pos, count(*) AS depth, avg(l_quantity) AS value FROM {lineitem} GROUP BY l_returnflag, l_partkey",
    "signal_cand": """
        SELECT chrom, pos, CASE WHEN pos % 5 = 0 THEN depth + 1 ELSE depth END AS depth, CASE WHEN pos % 5 = 0 THEN value * CAST(1.05 AS DOUBLE) ELSE value END AS value FROM (
          SELECT l_returnflag AS chrom, l_partkey AS pos, count(*) AS depth, avg(l_quantity) AS value FROM {lineitem} WHERE l_partkey % 12 <> 0 GROUP BY l_returnflag, l_partkey) t""",
    # P8: a sequence index; offsets follow from the lengths of earlier rows
    "fai_ref": "SELECT 's' || doc_id AS name, n_chars AS length, doc_id * 100000 AS offset_, 60 AS linebases, 61 AS linewidth FROM {documents}",
    "fai_cand": "SELECT 's' || doc_id AS name, CASE WHEN doc_id % 8 = 0 THEN n_chars + 1 ELSE n_chars END AS length, doc_id * 100000 AS offset_, 60 AS linebases, 61 AS linewidth FROM {documents} WHERE doc_id % 15 <> 0",
    # idxstats: reads by reference
    "idx_ref": "SELECT l_returnflag || l_linestatus AS reference, 1000 + count(*) AS length, sum(CASE WHEN l_linenumber < 6 THEN 1 ELSE 0 END) AS mapped, sum(CASE WHEN l_linenumber >= 6 THEN 1 ELSE 0 END) AS unmapped FROM {lineitem} GROUP BY l_returnflag || l_linestatus",
    "idx_cand": "SELECT l_returnflag || l_linestatus AS reference, 1010 + count(*) AS length, sum(CASE WHEN l_linenumber < 5 THEN 1 ELSE 0 END) AS mapped, sum(CASE WHEN l_linenumber >= 5 THEN 1 ELSE 0 END) AS unmapped FROM {lineitem} GROUP BY l_returnflag || l_linestatus",
    # P9: text lines
    "text_ref": "SELECT doc_id AS doc, line_no, line FROM @lines",
    "text_cand": "SELECT doc_id AS doc, line_no, CASE WHEN doc_id % 4 = 0 THEN translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE line END AS line FROM @lines WHERE (doc_id + line_no) % 10 <> 0",
    # P11: reporting
    "agent_eval": "SELECT CAST(c_custkey % 20 AS STRING) AS id, c_mktsegment AS agent, CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE abs(c_acctbal % 100) / 100 END AS avg_similarity, CASE WHEN c_custkey % 9 = 0 AND c_custkey % 20 > 9 THEN NULL WHEN c_custkey % 160 = 1 THEN '' ELSE c_name END AS candidate_path, c_custkey AS row_no FROM {customer}",
    "catalog": "SELECT CAST(n_nationkey AS STRING) AS id, 'domain' || n_regionkey AS domain, n_name AS field FROM {nation}",
    "difficulty": "SELECT CAST(n_nationkey AS STRING) AS id, CASE n_nationkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS difficulty FROM {nation} WHERE n_nationkey <> 11",
    "cost": "SELECT CAST(c_custkey % 20 AS STRING) AS id, c_mktsegment AS agent, o_totalprice / 1000 AS duration_seconds, o_orderkey AS input_tokens, o_custkey AS output_tokens, o_orderkey AS row_no FROM {orders} JOIN {customer} ON o_custkey = c_custkey",
    "skip": "SELECT CAST(n_nationkey AS STRING) AS id FROM {nation} WHERE n_nationkey IN (3, 7)",
}

LINES = {
    "spark": "(SELECT doc_id, pos + 1 AS line_no, line FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) AS pos, line)",
    "other": "(SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM {documents}))",
}


def load(spark: SparkSession, sf_dir: str, *names: str):
    """The named fixtures as DataFrames."""
    out = []
    for name in names:
        sql = SQL[name].replace("@lines", LINES["spark"]).replace("@all", ", ''").replace('"start"', "`start`").replace('"end"', "`end`")
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", sql))}
        out.append(spark.sql(sql, **tables))
    return out[0] if len(out) == 1 else out


def sql(name: str) -> str:
    """The fixture as a subquery for engines whose regexp_replace needs the 'g' flag and that unnest lists."""
    text = SQL[name].replace("@lines", LINES["other"]).replace("@all", ", '', 'g'").replace("AS STRING)", "AS VARCHAR)").replace("AS INT)", "AS INTEGER)")
    return "(" + re.sub(r"\{(\w+)\}", r"\1", text) + ")"


def both(*names: str) -> str:
    """A WITH clause that names the fixtures."""
    return "WITH " + ", ".join(f"{n} AS {sql(n)}" for n in names)


DataFrames = list[DataFrame]
