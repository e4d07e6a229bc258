"""Exact deduplication by a streaming query whose keyed state lives on disk and never expires.

* :func:`digest_rows` reads every whole text once and keeps a narrow row: digest of the normalised text, stable identifier,
  content locator (position of the row in the input) and size.
* :func:`keep_state` streams such rows into RocksDB state keyed by digest.  Partial aggregation runs before the shuffle, so
  a digest that a third of all rows share arrives as one row per task.  State has no watermark and outlives the query: a
  later call with the same folder goes on from it, and only files that it has not seen are read.
* :func:`exact_dedup` reads the state back as a table and checks full bytes on hits: rows whose digest has others are
  grouped by the digest *and* the text itself, so equal means equal byte for byte; texts that merely share a digest get
  groups of their own.

Everything is DataFrame code.  Defined results: null texts count as empty, and all empty texts are equal; of equal texts the
one with most code points before normalisation stays, then the smallest identifier (null last), then the first row; rows
that repeat identifier and text are copies of which one stays; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, release, settle, work_dir

#: Fixed settings of the state: disk-backed store, memory shared by all stores of an executor and bounded.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def _sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def digest_rows(df: DataFrame, text: str = "text", id_col: str = "doc_id", digest=_sha256) -> DataFrame:
    return df.select(
        digest(normalised(F.col(text))).alias("digest"),
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("locator"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"),
    )


def _best() -> Column:
    """The row that stays: most code points, then smallest id, nulls last, then first position."""
    return F.min(F.struct((-F.col("size")).alias("n"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("locator").alias("locator"))).alias("best")


#: Bits of the screen: 128 kB in the plan, whatever the input.
SCREEN = 1 << 20


def screen(digests: DataFrame):
    """A test that all of ``digests`` pass and that turns away nearly all others while they are few for the bits.

    It only spares rows a shuffle; the join that follows decides.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(SCREEN))
    maps = digests.select(bit(F.col("digest")).alias("bit")).groupBy(F.expr("bit div 32768").alias("k")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("m")).collect()
    flags = bytearray(SCREEN // 8)
    for r in maps:
        flags[r["k"] * 4096 : r["k"] * 4096 + 4096] = r["m"]
    held = F.lit(bytes(flags))

    def passes(digest: Column) -> Column:
        b = bit(digest)
        value = F.conv(F.hex(F.substring(held, (F.floor(b / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", value, (b % 8).cast("int")) % 2 == 1

    return passes


def keep_state(spark: SparkSession, rows_dir: str, state_dir: str, id_type: str = "long", max_bytes: str | None = None) -> DataFrame:
    """Take in the digest rows of ``rows_dir`` that ``state_dir`` has not seen; return the state as a table."""
    mine = spark.newSession()  # settings of the state stay out of the caller's session
    for k, v in STATE_CONF.items():
        mine.conf.set(k, v)
    mine.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))  # a new session has its own
    source = mine.readStream.schema(f"digest string, id {id_type}, locator long, size long")
    if max_bytes:
        source = source.option("maxBytesPerTrigger", max_bytes)
    kept = source.parquet(rows_dir).groupBy("digest").agg(_best(), F.count("*").alias("n"))
    query = kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_dir).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.format("statestore").load(state_dir)
    # the value struct is positional: the aggregate's buffers, in the order in which they were asked for
    best, n = (f"value.`{f.name}`" for f in state.schema["value"].dataType.fields[-2:])
    return state.select(F.col("key.digest").alias("digest"), F.expr(best).alias("best"), F.expr(n).alias("n"))


def exact_dedup(df: DataFrame, text: str = "text", id_col: str = "doc_id", digest=_sha256) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256 and locator."""
    spark = df.sparkSession
    rows_dir, state_dir = work_dir(spark, "digests"), work_dir(spark, "state")
    id_type = df.schema[id_col].dataType.simpleString()
    digest_rows(df, text, id_col, digest).write.parquet(rows_dir)
    rows = spark.read.schema(f"digest string, id {id_type}, locator long, size long").parquet(rows_dir)
    hits = settle(keep_state(spark, rows_dir, state_dir, id_type).where("n > 1"), "hits")
    groups = rows.join(hits, "digest", "left")

    # full bytes on hits: the text is part of the grouping key, collapsed within each task before it moves
    texts = df.select(normalised(F.col(text)).alias("body"))
    texts = texts.withColumn("digest", digest(F.col("body"))).where(screen(hits)(F.col("digest")))
    variants = texts.groupBy("digest", "body").agg(F.count("*").alias("n")).select("digest")
    shared = variants.groupBy("digest").agg(F.count("*").alias("k")).where("k > 1").join(hits.select("digest"), "digest", "left_semi").select("digest")
    clash = settle(shared, "clash")
    release(spark)
    out = groups.select("digest", "id", "locator", F.coalesce("best.id", F.when(F.col("best").isNull(), F.col("id"))).alias("keep_id"), F.coalesce("best.locator", "locator").alias("keep_locator"), F.coalesce("n", F.lit(1)).alias("group_size"))
    if clash.take(1):
        out = _untangle(df, out, clash, text, id_col, digest)
    sha = F.col("digest") if digest is _sha256 else F.col("text_sha256")
    if digest is not _sha256:
        out = out.join(df.select(F.monotonically_increasing_id().alias("locator"), _sha256(normalised(F.col(text))).alias("text_sha256")), "locator")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("locator") == F.col("keep_locator")).alias("kept"), sha.alias("text_sha256"), "locator")


def _untangle(df: DataFrame, out: DataFrame, clash: DataFrame, text: str, id_col: str, digest) -> DataFrame:
    """Regroup by full text the rows whose digest belongs to several texts (never seen with SHA-256)."""
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text)).alias("body"), F.monotonically_increasing_id().alias("locator"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"))
    rows = settle(rows.withColumn("digest", digest(F.col("body"))).join(clash, "digest", "left_semi"), "clashing")
    best = rows.groupBy("digest", "body").agg(_best(), F.count("*").alias("n"))
    right = rows.join(best, ["digest", "body"]).select("locator", F.col("best.id").alias("k_id"), F.col("best.locator").alias("k_locator"), F.col("n").alias("k_n"))
    hit = F.col("k_locator").isNotNull()
    return out.join(right, "locator", "left").select("digest", "id", "locator", F.when(hit, F.col("k_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("k_locator", "keep_locator").alias("keep_locator"), F.coalesce("k_n", "group_size").alias("group_size"))


def drop_copies(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with one row of each group of equal texts, and its own columns only.

    Rows to drop are named by identifier and digest, not by position, so ``df`` may be any plan.
    """
    names = {c.lower() for c in df.columns}
    mark = next(m for m in ("_digest" + "_" * k for k in range(len(names) + 1)) if m not in names)
    decided = exact_dedup(df, text, id_col).groupBy(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    decided = settle(decided.where("not kept or n > 1"), "decided")
    named = df.withColumn(mark, _sha256(normalised(F.col(text))))

    def same(right: DataFrame) -> Column:
        return (F.col(mark) == right["digest"]) & named[id_col].eqNullSafe(right["id"])

    dropped = decided.where("not kept")
    twice = decided.where("kept")
    if not twice.take(1):
        maybe = screen(dropped)(F.col(mark))
        clear, named = named.where(~maybe), named.where(maybe)
        return clear.unionByName(named.join(dropped, same(dropped), "left_anti")).drop(mark)
    # rows that repeat both identifier and text: one of them stays
    single = named.join(decided, same(decided), "left_anti")
    again = named.join(twice, same(twice), "left_semi").dropDuplicates([id_col, mark])
    return single.unionByName(again).drop(mark)
