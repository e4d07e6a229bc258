"""From raw documents to packed training sequences: toxic documents go, equal texts leave one row, near copies leave one
document of each group, and what stays is packed.  Each stage is written and read again before the next one.

All stages take null and empty texts (as empty), very long ones, rows that repeat, rows without an identifier, other columns
of any name, and empty tables; all but the last return the columns of their input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veridiff.llm.common import settle
from veridiff.llm.exact_dedup import drop_copies
from veridiff.llm.ngram_join import drop_similar
from veridiff.llm.packing import best_fit_packing
from veridiff.llm.queries import table, vocabulary
from veridiff.llm.toxicity import drop_toxic, learn_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject: scores under the cut, repeated rows each; without labelled rows of a
    class none is rejected."""
    return drop_toxic(docs, learn_toxicity(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: most code points first, then the smallest identifier,
    null last; null and empty texts are one group."""
    return drop_copies(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies; documents without words or identifier stay."""
    return drop_similar(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row a piece; null and empty texts hold the closing token alone."""
    return best_fit_packing(docs, vocabulary("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", ngram_jaccard_join), ("packing", packing)]

#: Model scores and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
