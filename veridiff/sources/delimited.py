"""Delimited tables: options found from the first lines, GCT's fixed layout, row numbers, NaN as NULL."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.models import TableMeta
from .lines import head, numbered_lines


def sniff(lines: list[str]) -> TableMeta:
    """Delimiter, comment character and header of the first lines of a file."""
    if len(lines) > 2 and lines[0].startswith("#1.") and lines[2].lower().startswith("name\tdescription"):
        return TableMeta("\t", None, True, 2)
    comment = next((c for c in "#%" if lines and lines[0].startswith(c)), None)
    data = [x for x in lines if x.strip() and not (comment and x.startswith(comment))]
    if not data:
        return TableMeta(comment=comment)
    text = "\n".join(data[:20])
    try:
        dialect = csv.Sniffer().sniff(text, "\t,;| ").delimiter
    except csv.Error:
        dialect = "\t" if "\t" in text else ","
    first = next(csv.reader([data[0]], delimiter=dialect), [])
    rest = [row for x in data[1:] for row in csv.reader([x], delimiter=dialect)]

    def number(x: str) -> bool:
        try:
            float(x)
        except ValueError:
            return False
        return True

    numeric_columns = [i for i in range(len(first)) if rest and all(i < len(r) and number(r[i]) for r in rest)]
    header = not any(number(first[i]) for i in numeric_columns) if numeric_columns else not any(map(number, first))
    return TableMeta(dialect, comment, header, 0)


def read_table(spark: SparkSession, path: str, meta: TableMeta | None = None) -> DataFrame:
    """The table with ``_row``, its line order; without a header columns are named by their ordinals."""
    meta = meta or sniff(head(spark, path))
    lines = numbered_lines(spark, path).where(F.col("_row") >= meta.skip_rows)
    if meta.comment:
        lines = lines.where(~F.col("value").startswith(meta.comment))
    lines = lines.where(F.trim("value") != "")
    first = lines.orderBy("_row").select("_row", "value").first()
    if first is None:
        return spark.createDataFrame([], "_row long")
    names = next(csv.reader([first["value"]], delimiter=meta.delimiter))
    if meta.header:
        lines = lines.where(F.col("_row") > first["_row"])
        seen: dict[str, int] = {}
        for i, n in enumerate(names):
            k = seen.get(n, 0)
            seen[n] = k + 1
            names[i] = f"{n}.{k}" if k else n
    else:
        names = [str(i) for i in range(len(names))]
    options = {"sep": meta.delimiter, "mode": "PERMISSIVE"}
    parsed = lines.select("_row", F.from_csv("value", ", ".join(f"`{i}` string" for i in range(len(names))), options).alias("c")).select("_row", *(F.col(f"c.`{i}`").alias(f"{i}") for i in range(len(names))))
    blank = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None"]  # fixed values: texts read as missing
    parsed = parsed.select("_row", *(F.when(~F.col(f"`{i}`").isin(blank), F.col(f"`{i}`")).alias(f"{i}") for i in range(len(names))))
    # one pass decides every column's type
    kinds = parsed.agg(*(F.count(F.when(F.col(f"`{i}`").isNotNull() & F.col(f"`{i}`").try_cast(t).isNull(), 1)).alias(f"{t}{i}") for i in range(len(names)) for t in ("long", "double")), *(F.count(f"`{i}`").alias(f"n{i}") for i in range(len(names)))).first()
    pick = lambda i: "long" if kinds[f"n{i}"] and not kinds[f"long{i}"] else "double" if not kinds[f"double{i}"] else "string"
    return parsed.select(*(F.col(f"`{i}`").try_cast(pick(i)).alias(n) for i, n in enumerate(names)), "_row")
