"""Text operators over lines: doc, line_no, line."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalise(text: Column, ignore_whitespace: bool, ignore_case: bool) -> Column:
    """Blanks removed altogether (line feeds too) and letters lowered, as asked."""
    if ignore_case:
        text = F.lower(text)
    return F.regexp_replace(text, r"\s+", "") if ignore_whitespace else text


def joined(lines: DataFrame) -> DataFrame:
    """(doc, text): lines put together again in order; a document is one value, as it is in its file."""
    return lines.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


def stats(text: Column) -> dict[str, Column]:
    """Lines, words, characters, characters without blanks, sentences."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    sentences = F.filter(F.split(text, "[.!?]+"), lambda s: F.length(F.regexp_replace(s, r"^\s+|\s+$", "")) > 0)
    lines = F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0))
    return {"num_lines": lines, "num_words": F.size(words), "num_characters": F.length(text), "num_characters_no_whitespace": F.length(F.translate(text, " \n\t", "")), "num_sentences": F.size(sentences)}


def matched_share(pairs: DataFrame, by: str = "line") -> DataFrame:
    """``pairs`` (ref, cand) with matched and total: sizes of the matching blocks of the longest-common-run search.

    No built-in expresses that search, so it runs on Arrow batches of whole texts.
    """
    @F.pandas_udf("matched long, total long")
    def run(ref: pd.Series, cand: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(ref, cand):
            x, y = ((a or "").splitlines(), (b or "").splitlines()) if by == "line" else (a or "", b or "")
            size = sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
            out.append((size, len(x)))
        return pd.DataFrame(out, columns=["matched", "total"])

    return pairs.withColumn("m", run("ref", "cand")).select(*[c for c in pairs.columns], "m.matched", "m.total")
