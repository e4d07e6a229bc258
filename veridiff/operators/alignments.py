"""Alignment operators.  Reads: qname, is_read2, flag, rname, pos (0-based), mapq, len, and optionally cigar; ord for order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import dist as D

#: Bits of the alignment flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 8, 64, 128, 256, 512, 1024, 2048


def has(bit: int, flag: str = "flag") -> Column:
    return F.col(flag).bitwiseAND(F.lit(bit)) != 0


def flagstat(reads: DataFrame) -> DataFrame:
    """(category, pass, fail, ratio): all categories from one aggregate; ratio is pass over both, NULL for neither."""
    primary = ~has(SECONDARY) & ~has(SUPPLEMENTARY)
    paired = primary & has(PAIRED)
    kinds = {
        "total": F.lit(True),
        "primary": primary,
        "secondary": has(SECONDARY),
        "supplementary": has(SUPPLEMENTARY) & ~has(SECONDARY),
        "duplicates": has(DUPLICATE),
        "primary_duplicates": has(DUPLICATE) & primary,
        "mapped": ~has(UNMAPPED),
        "primary_mapped": ~has(UNMAPPED) & primary,
        "paired": paired,
        "read1": paired & has(READ1),
        "read2": paired & has(READ2),
        "properly_paired": paired & has(PROPER) & ~has(UNMAPPED),
        "both_reads_mapped": paired & ~has(UNMAPPED) & ~has(MATE_UNMAPPED),
        "singletons": paired & ~has(UNMAPPED) & has(MATE_UNMAPPED),
    }
    ok = ~has(QC_FAIL)
    aggs = [F.coalesce(F.sum((c & good).cast("long")), F.lit(0)).alias(f"{p}{i}") for i, c in enumerate(kinds.values()) for p, good in (("p", ok), ("f", ~ok))]
    pairs = ", ".join(f"'{k}', p{i}, f{i}" for i, k in enumerate(kinds))
    return reads.agg(*aggs).select(F.expr(f"stack({len(kinds)}, {pairs}) AS (category, pass, fail)")).withColumn("ratio", F.expr("pass / nullif(pass + fail, 0)"))


def primary_count(reads: DataFrame) -> DataFrame:
    return reads.where(F.col("flag").bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) == 0).agg(F.count("*").alias("n"))


def mapq_stats(reads: DataFrame) -> DataFrame:
    """Minimum, discrete quartiles, maximum and mean of mapping quality, from its value counts."""
    counts = reads.groupBy("mapq").agg(F.count("*").alias("n"))
    box = D.discrete_percentile(counts, "mapq", "n", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    ends = counts.agg(F.min("mapq").alias("min"), F.max("mapq").alias("max"), (F.sum(F.col("mapq") * F.col("n")) / F.sum("n")).alias("average"))
    return ends.crossJoin(box).select("min", "q25", "median", "q75", "max", "average")


def depth(reads: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(chrom, start, end, depth): runs of equal depth, from 0 and half open, over the aligned blocks of mapped, kept reads.

    With ``sizes`` (chrom, size) the positions without reads, of contigs that have any, are runs of depth 0; those end with
    the contig, also where reads lie beyond it.
    """
    kept = reads.where(F.col("flag").bitwiseAND(F.lit(UNMAPPED | SECONDARY | QC_FAIL | DUPLICATE)) == 0)
    runs = kept.select(F.col("rname").alias("chrom"), F.explode(blocks(reads)).alias("b")).select("chrom", "b.s", "b.e")
    steps = runs.select("chrom", F.explode(F.expr("array(struct(s as at, 1L as depth), struct(e as at, -1L as depth))")).alias("v")).select("chrom", "v.at", "v.depth")
    if sizes is not None:
        used = runs.select("chrom").distinct()
        ends = sizes.join(used, "chrom", "left_semi").select("chrom", F.explode(F.expr("array(struct(0L as at, 0L as past), struct(cast(size as long) as at, 1L as past))")).alias("v"))
        steps = steps.withColumn("past", F.lit(0).cast("long")).unionByName(ends.select("chrom", "v.at", F.lit(0).cast("long").alias("depth"), "v.past"))
        return levels(steps, ["depth", "past"]).where("depth > 0 or past = 0").drop("past")
    return levels(steps, ["depth"]).where("depth > 0")


#: Positions of one window of running sums.
REACH = 1 << 16


def levels(steps: DataFrame, values: list[str]) -> DataFrame:
    """(chrom, start, end, values...): running sums of the changes in ``steps`` (chrom, at, values...) up to the next change.

    Sums run inside ranges of ``REACH`` positions and once over the ranges' totals, so no task sorts a chromosome.
    """
    at = steps.groupBy("chrom", "at").agg(*(F.sum(v).alias(v) for v in values)).withColumn("range", F.expr(f"at div {REACH}"))
    inside = Window.partitionBy("chrom", "range").orderBy("at")
    rows = at.select("chrom", "range", F.col("at").alias("start"), F.lead("at").over(inside).alias("next"), *(F.sum(v).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(v) for v in values))
    over = Window.partitionBy("chrom").orderBy("range")
    ranges = at.groupBy("chrom", "range").agg(F.min("at").alias("first"), *(F.sum(v).alias("b_" + v) for v in values))
    ranges = ranges.select("chrom", "range", F.lead("first").over(over).alias("after"), *((F.sum("b_" + v).over(over) - F.col("b_" + v)).alias("b_" + v) for v in values))
    out = rows.join(ranges, ["chrom", "range"]).withColumn("end", F.coalesce("next", "after")).where("end is not null")
    return out.select("chrom", "start", "end", *((F.col(v) + F.col("b_" + v)).alias(v) for v in values))


#: Operation letters in the order of their codes.
CIGAR = "MIDNSHP=X"


def cigar_ops(cigar: Column) -> Column:
    """Array of (op, len)."""
    parts = F.regexp_extract_all(cigar, F.lit(f"([0-9]+[{CIGAR}])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct((F.position(F.substring(p, -1, 1), F.lit(CIGAR)) - 1).alias("op"), F.regexp_extract(p, "[0-9]+", 0).cast("int").alias("len")))


def expand_cigar(cigar: Column) -> Column:
    """Operation code of each base of the read; deletions, skips and clips off the read give none."""
    ops = F.filter(cigar_ops(cigar), lambda x: x["op"].isin(0, 1, 4, 7, 8))
    return F.flatten(F.transform(ops, lambda x: F.array_repeat(x["op"], x["len"])))


#: One block of aligned positions, from 0 and half open.
BLOCKS = "array<struct<s:bigint,e:bigint>>"


def cigar_blocks(cigar: Column, pos: Column) -> Column:
    """Runs of reference positions that a read's bases are aligned to: matches and mismatches, without deletions and skips."""
    state = f"struct<at:bigint,out:{BLOCKS}>"
    start = F.struct(pos.cast("long").alias("at"), F.array().cast(BLOCKS).alias("out")).cast(state)

    def step(s: Column, o: Column) -> Column:
        end = s["at"] + F.when(o["op"].isin(0, 2, 3, 7, 8), o["len"]).otherwise(0)
        out = F.when(o["op"].isin(0, 7, 8), F.concat(s["out"], F.array(F.struct(s["at"].alias("s"), end.alias("e"))).cast(BLOCKS))).otherwise(s["out"])
        return F.struct(end.alias("at"), out.alias("out")).cast(state)

    return F.aggregate(cigar_ops(cigar), start, step, lambda s: s["out"])


def blocks(reads: DataFrame) -> Column:
    """Aligned blocks of each read: by its cigar, or one block of its length where the table has none."""
    if "cigar" in reads.columns:
        return cigar_blocks(F.col("cigar"), F.col("pos"))
    return F.array(F.struct(F.col("pos").cast("long").alias("s"), (F.col("pos") + F.col("len")).cast("long").alias("e")))


def concordant(min_overlap: float, min_mapq: int) -> Column:
    """Both unmapped, or both mapped with quality to one contig, sharing enough of the reference read's aligned positions.

    Reads stand side by side with suffixes 1 and 2 and their ``blocks``.
    """
    u1, u2 = F.col("flag1").bitwiseAND(F.lit(UNMAPPED)) != 0, F.col("flag2").bitwiseAND(F.lit(UNMAPPED)) != 0
    zero = F.lit(0).cast("long")
    both = F.flatten(F.transform("blocks1", lambda x: F.transform("blocks2", lambda y: F.greatest(zero, F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"])))))
    shared = F.aggregate(both, zero, lambda s, v: s + v)
    own = F.aggregate(F.transform("blocks1", lambda x: x["e"] - x["s"]), zero, lambda s, v: s + v)
    good = (F.col("mapq1") >= min_mapq) & (F.col("mapq2") >= min_mapq) & (F.col("rname1") == F.col("rname2")) & (own > 0) & (shared / own >= min_overlap)
    return F.when(u1 & u2, True).when(u1 | u2, False).otherwise(F.coalesce(good, F.lit(False)))


def qualifying(reads: DataFrame, min_mapq: int) -> DataFrame:
    """Named primary reads of at least the mapping quality."""
    return reads.where((F.col("flag").bitwiseAND(F.lit(SECONDARY | SUPPLEMENTARY)) == 0) & (F.col("mapq") >= min_mapq) & F.col("qname").isNotNull())


#: Mandatory fields of a record.
FIELDS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def records_equal(fields: list[str], left: str = "x", right: str = "y") -> Column:
    """The mandatory fields among ``fields`` of two record structs agree, missing equal to missing, and so do the tags that
    both have.  Cigars agree when they give each base of the read the same operation."""
    same = F.lit(True)
    for f in FIELDS:
        if f in fields:
            a, b = F.col(f"{left}.{f}"), F.col(f"{right}.{f}")
            equal = a.eqNullSafe(b)
            same = same & (F.when(equal, True).otherwise(F.coalesce(expand_cigar(a) == expand_cigar(b), F.lit(False))) if f == "cigar" else equal)
    if "tags" in fields:
        a, b = F.col(f"{left}.tags"), F.col(f"{right}.tags")
        shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
        same = same & F.coalesce(F.forall(shared, lambda k: a[k].eqNullSafe(b[k])), F.lit(True))
    return same


def coordinate_sorted(reads: DataFrame, contigs: list[str]) -> DataFrame:
    """One row: whether reads stand by contig, in header order, and position, those without a contig last."""
    rank = F.coalesce(F.create_map(*(x for i, c in enumerate(contigs) for x in (F.lit(c), F.lit(i))))[F.col("rname")], F.lit(len(contigs))) if contigs else F.lit(0)
    return in_order(reads, [rank, F.when(rank < len(contigs), F.col("pos")).otherwise(0)])


def sort_by_place(reads: DataFrame, contigs: list[str]) -> DataFrame:
    """Reads by contig, in header order, and position; those without a contig last.  A range-partitioned sort."""
    rank = F.coalesce(F.create_map(*(x for i, c in enumerate(contigs) for x in (F.lit(c), F.lit(i))))[F.col("rname")], F.lit(len(contigs))) if contigs else F.lit(0)
    return reads.orderBy(rank, "pos", "ord")


def sort_by_name(reads: DataFrame) -> DataFrame:
    return reads.orderBy("qname", "is_read2", "ord")


def name_sorted(reads: DataFrame) -> DataFrame:
    return in_order(reads, [F.col("qname")])


def in_order(rows: DataFrame, keys: list[Column], place: str = "ord", reach: int = 100_000) -> DataFrame:
    """One row: whether ``keys`` never fall as ``place`` grows.  Each range of places is checked by itself, then their ends."""
    k = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(keys)))
    x = rows.select(F.col(place).cast("long").alias("p"), k.alias("k")).withColumn("range", F.floor(F.col("p") / reach))
    before = F.lag("k").over(Window.partitionBy("range").orderBy("p"))
    x = x.withColumn("ok", F.coalesce(before <= F.col("k"), F.lit(True)))
    ranges = x.groupBy("range").agg(F.bool_and("ok").alias("ok"), F.min_by("k", "p").alias("first"), F.max_by("k", "p").alias("last"))
    ranges = ranges.withColumn("joined", F.coalesce(F.lag("last").over(Window.orderBy("range")) <= F.col("first"), F.lit(True)))
    return ranges.agg(F.coalesce(F.bool_and(F.col("ok") & F.col("joined")), F.lit(True)).alias("sorted"))


def headers_equal(ref: list[str], cand: list[str]) -> bool:
    """Header lines agree apart from program lines and the sort order."""
    def core(lines: list[str]) -> list[str]:
        return ["\t".join(p for p in x.split("\t") if not p.startswith("SO:")) if x.startswith("@HD") else x for x in lines if x.startswith("@") and not x.startswith("@PG")]

    return core(ref) == core(cand)
