"""URL filters that judge every capture by the list of its day: a temporal join.

A list is a history of dated events: on a day an entry (a domain, or a host with a path prefix) is added to or removed from a
category.  Events become validity intervals, from a day up to the entry's next event.  A capture has a key for each domain
its host belongs to and for each prefix of its path; it is blocked when one of its keys has an interval that holds its fetch
time.  Equal (url, time) pairs are judged once, and so a host that a third of all captures share is many different rows;
what is joined by key are urls, whose skewed partitions adaptive execution splits.

Nulls: a capture without url or time matches nothing; events without key, day or action are ignored; two events of an entry
on one day: removal comes last.  Rows that repeat are kept; other columns go through, but for those named like a result, which
the result replaces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-case host without port, user or trailing dot; empty where there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*[^/:?#.])", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """The domains above and at a host, and the host with each prefix of whole path segments."""
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    prefixes = F.when(F.size(segments) > 0, F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(host) > 0, F.array_distinct(F.concat(domains, prefixes)))


def intervals(events: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of events (key, category, day, action 'add' or 'remove'); valid_to is open."""
    e = events.where("key is not null and day is not null and action in ('add', 'remove')").groupBy("key", "category", "day").agg(F.max("action").alias("action"))
    nxt = F.lead("day").over(Window.partitionBy("key", "category").orderBy("day"))
    return e.withColumn("valid_to", nxt).where("action = 'add'").select("key", "category", F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, events: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """``captures`` with blocked, n_entries and the categories (sorted) of the entries that hold at fetch time."""
    asked = captures.select(F.col(url).alias("_url"), F.col(at).alias("_at")).where("_url is not null and _at is not null").distinct()
    keyed = asked.select("_url", "_at", F.explode(keys_of(F.col("_url"))).alias("key"))
    hits = keyed.join(intervals(events), "key").where("valid_from <= _at and (valid_to is null or _at < valid_to)")
    found = hits.groupBy("_url", "_at").agg(F.count("*").alias("n_entries"), F.sort_array(F.collect_set("category")).alias("categories"))
    results = {"blocked", "n_entries", "categories"}
    kept = [F.col(f"_row.`{c}`") for c in captures.columns if c.lower() not in results]
    rows = captures.select(F.struct("*").alias("_row"), captures[url].alias("_u"), captures[at].alias("_t"))
    out = rows.join(found, (F.col("_u") == F.col("_url")) & (F.col("_t") == F.col("_at")), "left")
    return out.select(
        *kept,
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"),
    )
