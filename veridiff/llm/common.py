"""Shared plumbing of the corpus operators: work folders on shared storage, cut lineage, connected components."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[object, object]] = []
_tmp: dict[str, str] = {}

#: Characters of the class [\x20\x09-\x0D], the white space that the corpus contracts name.
BLANKS = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset on a local master."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _tmp.setdefault("root", "file://" + tempfile.mkdtemp(prefix="veridiff-"))


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root, removed when the driver ends."""
    path = f"{shared_root(spark)}/veridiff-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    _made.append((p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p))
    return path


@atexit.register
def _clean() -> None:
    for fs, p in _made:
        try:
            fs.delete(p, True)
        except Exception:  # noqa: BLE001  the gateway may be gone already at exit
            return


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and any executor may be lost."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a Python worker's freed memory to the system, so that an idle worker leaves room for what runs next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Let the driver give memory back after many small jobs: what it no longer refers to, and with it the shuffles and
    broadcasts that executors still hold for that, and what its JVM's C library keeps of freed memory."""
    spark.sparkContext._jvm.java.lang.System.gc()
    trim_jvm(spark)
    give_back()


def trim_jvm(spark: SparkSession) -> bool:
    """Whether the driver's JVM could return freed native memory (threads, compiled code, buffers) to the system: it knows the
    command System.trim_native_heap from Java 17.0.9 on, with glibc."""
    sc = spark.sparkContext
    lang, new = sc._jvm.java.lang, sc._gateway.new_array
    try:
        kind = lang.Class.forName
        types = new(lang.Class, 4)
        for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[i] = kind(name)
        # by the interface's method: the server's own class is not open to reflection
        invoke = kind("javax.management.MBeanServerConnection").getMethod("invoke", types)
        args = new(lang.Object, 4)
        args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Exception:  # noqa: BLE001  another JVM or C library
        return False
    return True


def tidy(run):
    """A batch function that gives memory back when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


#: Bytes of an Arrow batch on its way to Python; the session's own setting holds where it is smaller.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches of whole texts by bytes, so that executors and their workers hold a few megabytes of them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def regrouped(batches, rows: int = 10_000, size: int = 32 << 20):
    """Arrow batches joined up to a number of rows or bytes, for work that gains from seeing many rows at once."""
    import pyarrow as pa

    held, n, b = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        b += batch.nbytes
        if n >= rows or b >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if n else batch
            held, n, b = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def crc32_utf8(col):
    return F.crc32(F.encode(col, "UTF-8"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a long, b long); comp is the smallest id reachable.

    Alternates large-star and small-star rewirings until the edges no longer change, so a chain of length n takes about
    log n rounds.  Edges stay on the executors; each round is one written table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = settle(e, "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to u's smallest neighbour (or u itself)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = settle(small, "edges")
        # done when each node has one edge up and no node above another has one itself
        ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        if not ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("top")).where("ups > 1 or ups = 1 and top = 0").take(1):
            break
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def merge_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after further ``links`` (a, b): only the components that these tie are worked on."""
    def comp_of(p: DataFrame, end: str) -> DataFrame:
        return p.join(comps.toDF(end, "_c"), end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")

    tied = settle(connected_components(comp_of(comp_of(links.select("a", "b"), "a"), "b")), "tied")
    out = comps.join(tied.toDF("comp", "_t"), "comp", "left").select("node", F.coalesce("_t", "comp").alias("comp"))
    return out.unionByName(tied.join(comps, "node", "left_anti"))  # nodes that stood alone


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
