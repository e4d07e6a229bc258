"""Format detection as queries over documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..sources import detect as D
from .registry import query


def _vote(c: str) -> str:
    tests = []
    for i, (d, name) in enumerate(D.DELIMITERS):
        char = "chr(9)" if d == "\t" else f"'{d}'"
        extra = "" if d == "\t" else " AND min(k) >= 3 AND count(*) >= 5"
        tests.append(f"WHEN min(len(string_split({c}, {char}))) = max(len(string_split({c}, {char}))) AND min(len(string_split({c}, {char}))) > 1" + extra.replace("min(k)", f"min(len(string_split({c}, {char})))") + f" THEN '{name}'")
    return "CASE " + " ".join(tests) + " ELSE 'none' END"


@query(f"SELECT doc_id AS doc, {_vote('line')} AS format FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY doc_id")
def detect_delimiter(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = d.select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''")
    return D.delimiter_vote(lines)


NAMES = ("a.fa.gz", "b.FASTQ", "c.vcf.bgz", "d.narrowPeak", "e.unknown", "f.tsv", "noext", "g.bw")


@query("SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{D.BY_EXTENSION.get(D.extension(n), 'unknown')}'" for i, n in enumerate(NAMES)) + " END AS format FROM documents")
def detect_extension(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.select("doc_id", D.extension_format(F.concat(F.lit("/x/"), name)).alias("format"))


@query()
def detect_signature(spark, sf_dir):
    """Signature of each document's text, as if it were a file without a name."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: D.classify((t or "").encode()[: D.HEAD], "").format)

    return d.select("doc_id", run("text").alias("format"))
