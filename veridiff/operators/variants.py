"""Variant operators.  Raw rows: chrom, pos, ref, alts (comma-separated), qual, filter, ord; flat rows have one ``alt``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("chrom", "pos", "ref", "alt")
#: Rows of the summary section, in order.
SN = ("samples", "records", "no-ALTs", "SNPs", "MNPs", "indels", "others", "multiallelic sites", "multiallelic SNP sites")


def flatten(raw: DataFrame) -> DataFrame:
    """One row per alternative; sites without one drop out; a repeated key keeps its first place and its last values.

    A quality of 0 becomes missing.  Of values at the same place the larger quality, then the larger filter counts, so that
    both sides of a comparison choose alike.
    """
    alts = F.filter(F.split(F.coalesce("alts", F.lit("")), ","), lambda a: (a != "") & (a != "."))
    rows = raw.select("chrom", "pos", "ref", F.posexplode(alts).alias("k", "alt"), "qual", "filter", "ord")
    rows = rows.withColumn("place", F.struct("ord", "k"))
    values = F.struct(F.when(F.col("qual") != 0, F.col("qual").cast("double")).alias("qual"), F.coalesce("filter", F.lit("")).alias("filter"))
    last = F.max(F.struct("place", values.alias("v")))["v"].alias("v")
    return rows.groupBy(*KEY).agg(F.min("place").alias("place"), last).select(*KEY, "v.qual", "v.filter", "place")


def variant_type(ref: Column, alt: Column) -> Column:
    """snp, mnp, indel or other, by allele lengths."""
    plain = ref.rlike("^[ACGTNacgtn]+$") & alt.rlike("^[ACGTNacgtn]+$")
    return F.when(~plain, "other").when((F.length(ref) == 1) & (F.length(alt) == 1), "snp").when(F.length(ref) == F.length(alt), "mnp").otherwise("indel")


def _alts(raw: DataFrame) -> DataFrame:
    alts = F.filter(F.split(F.coalesce("alts", F.lit("")), ","), lambda a: (a != "") & (a != "."))
    return raw.withColumn("a", alts).withColumn("types", F.transform("a", lambda x: variant_type(F.col("ref"), x)))


def stats_sn(raw: DataFrame, samples: int = 0) -> DataFrame:
    """(key, value): the summary section, from one aggregate.  A record counts once for each kind of allele it has."""
    r = _alts(raw)
    has = lambda kind: F.sum(F.array_contains("types", kind).cast("long"))
    all_snp = F.forall("types", lambda t: t == "snp")
    values = [F.lit(samples).cast("long"), F.count("*"), F.sum((F.size("a") == 0).cast("long")), has("snp"), has("mnp"), has("indel"), has("other"), F.sum((F.size("a") > 1).cast("long")), F.sum(((F.size("a") > 1) & all_snp).cast("long"))]
    one = r.agg(*(F.coalesce(v, F.lit(0)).alias(f"v{i}") for i, v in enumerate(values)))
    pairs = ", ".join(f"'number of {k}:', v{i}" for i, k in enumerate(SN))
    return one.select(F.expr(f"stack({len(SN)}, {pairs}) AS (key, value)"))


def transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def stats_tstv(raw: DataFrame) -> DataFrame:
    """Transitions and transversions, over all alternatives and over the first ones."""
    a = _alts(raw).select("ref", F.posexplode("a").alias("k", "alt")).where((F.length("ref") == 1) & (F.length("alt") == 1))
    ts, first = transition(F.col("ref"), F.col("alt")), F.col("k") == 0
    n = a.agg(*(F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name) for name, c in (("ts", ts), ("tv", ~ts), ("ts_1stalt", ts & first), ("tv_1stalt", ~ts & first))))
    rate = lambda x, y: F.when(F.col(y) > 0, F.round(F.col(x) / F.col(y), 2)).otherwise(0.0)
    return n.select("ts", "tv", rate("ts", "tv").alias("ts_tv"), "ts_1stalt", "tv_1stalt", rate("ts_1stalt", "tv_1stalt").alias("ts_tv_1stalt"))


def stats_qual(raw: DataFrame) -> DataFrame:
    """(bin, snps, transitions, transversions, indels) of records by whole quality."""
    r = _alts(raw).withColumn("alt", F.get("a", F.lit(0))).where("alt is not null")
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    ts = transition(F.col("ref"), F.col("alt"))
    return r.groupBy(F.floor("qual").alias("bin")).agg(F.sum(snp.cast("long")).alias("snps"), F.sum((snp & ts).cast("long")).alias("transitions"), F.sum((snp & ~ts).cast("long")).alias("transversions"), F.sum((~snp).cast("long")).alias("indels"))


def stats_indels(raw: DataFrame) -> DataFrame:
    """(length, n): alternatives by length change; deletions are negative."""
    a = _alts(raw).select("ref", F.explode("a").alias("alt")).where(F.length("ref") != F.length("alt"))
    return a.groupBy((F.length("alt") - F.length("ref")).alias("length")).agg(F.count("*").alias("n"))


def stats_af(raw: DataFrame) -> DataFrame:
    """(af, snps, transitions, transversions, indels) of alternatives by allele frequency, to two digits.

    Frequencies come from ``info``: AF, or AC over AN; alternatives without either count at 0.
    """
    a = _alts(raw)
    if "info" in raw.columns:
        nth = lambda name: F.get(F.split(F.col("info")[name], ","), F.col("k")).try_cast("double")
        af = F.coalesce(nth("AF"), nth("AC") / F.when(F.col("info")["AN"].try_cast("double") > 0, F.col("info")["AN"].try_cast("double")), F.lit(0.0))
        a = a.select("ref", "info", F.posexplode("a").alias("k", "alt")).select("ref", "alt", F.round(af, 2).alias("af"))
    else:
        a = a.select("ref", F.explode("a").alias("alt"), F.lit(0.0).alias("af"))
    snp, ts = (F.length("ref") == 1) & (F.length("alt") == 1), transition(F.col("ref"), F.col("alt"))
    kinds = {"snps": snp, "transitions": snp & ts, "transversions": snp & ~ts, "indels": F.length("ref") != F.length("alt")}
    return a.groupBy("af").agg(*(F.sum(c.cast("long")).alias(name) for name, c in kinds.items()))


def is_sorted(raw: DataFrame, reach: int = 100_000) -> DataFrame:
    """One row: whether positions never fall within a chromosome and chromosomes stand together."""
    from .intervals import is_sorted as starts_sorted

    flat = raw.select("chrom", F.col("pos").alias("start"), "ord")
    ends = flat.groupBy("chrom").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    overlap = F.lag("last").over(Window.orderBy("first")) > F.col("first")  # a row a chromosome
    apart = ends.select(overlap.alias("o")).agg((~F.coalesce(F.bool_or("o"), F.lit(False))).alias("together"))
    return starts_sorted(flat, "ord", reach).crossJoin(apart).select((F.coalesce("sorted", F.lit(True)) & F.col("together")).alias("sorted"))


# -- calling ---------------------------------------------------------------------------------------------------------------

#: Bases of one row of a dealt reference.
PIECE = 1 << 14


def pileup(reads: DataFrame, min_base_quality: int = 13) -> DataFrame:
    """(chrom, pos, base, n): bases over each position from 0, by the cigars of mapped, kept reads.

    Bases below the quality do not count; reads without qualities count whole.
    """
    from . import alignments as A

    kept = reads.where(F.col("flag").bitwiseAND(F.lit(A.UNMAPPED | A.SECONDARY | A.QC_FAIL | A.DUPLICATE)) == 0).where("seq <> '*'")
    pairs = "array<struct<s:bigint,q:bigint,n:bigint>>"
    state = f"struct<at:bigint,q:bigint,out:{pairs}>"

    def step(s: Column, o: Column) -> Column:
        n = o["len"].cast("long")
        at = s["at"] + F.when(o["op"].isin(0, 2, 3, 7, 8), n).otherwise(0)
        q = s["q"] + F.when(o["op"].isin(0, 1, 4, 7, 8), n).otherwise(0)
        run = F.array(F.struct(s["at"].alias("s"), s["q"].alias("q"), n.alias("n"))).cast(pairs)
        return F.struct(at.alias("at"), q.alias("q"), F.when(o["op"].isin(0, 7, 8), F.concat(s["out"], run)).otherwise(s["out"]).alias("out")).cast(state)

    start = F.struct(F.col("pos").cast("long").alias("at"), F.lit(0).cast("long").alias("q"), F.array().cast(pairs).alias("out")).cast(state)
    runs = kept.select(F.col("rname").alias("chrom"), "seq", "qual", F.explode(F.aggregate(A.cigar_ops(F.col("cigar")), start, step, lambda s: s["out"])).alias("b"))
    bases = runs.select("chrom", "seq", "qual", "b", F.explode(F.expr("sequence(0L, b.n - 1)")).alias("i"))
    at = (F.col("b.q") + F.col("i") + 1).cast("int")
    good = (F.length("qual") < F.length("seq")) | (F.ascii(F.substring("qual", at, F.lit(1))) - 33 >= min_base_quality)
    bases = bases.where(good).select("chrom", (F.col("b.s") + F.col("i")).alias("pos"), F.upper(F.substring("seq", at, F.lit(1))).alias("base"))
    return bases.where("base in ('A', 'C', 'G', 'T')").groupBy("chrom", "pos", "base").agg(F.count("*").alias("n"))


def call(reads: DataFrame, reference: DataFrame, min_depth: int = 4, min_share: float = 0.2, min_base_quality: int = 13) -> DataFrame:
    """Raw variant rows from a pileup: bases that differ from the reference with a share of the depth at their position.

    A plain caller for comparing two files by the same rule: single bases only, no realignment, no genotype model, so its
    calls are not those of a statistical caller.  Quality is 20 for each read that shows the base.
    """
    n = pileup(reads, min_base_quality)
    depth = n.groupBy("chrom", "pos").agg(F.sum("n").alias("depth"))
    pieces = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("seq") - 1) / PIECE).cast("int")))
    dealt = reference.select(F.col("id").cast("string").alias("chrom"), F.explode(pieces).alias("piece"), F.upper("seq").alias("seq"))
    dealt = dealt.select("chrom", F.col("piece").cast("long").alias("piece"), F.substring("seq", F.col("piece") * PIECE + 1, F.lit(PIECE)).alias("part"))
    rows = n.join(depth, ["chrom", "pos"]).where(F.col("depth") >= min_depth).where(F.col("n") >= F.col("depth") * min_share)
    rows = rows.withColumn("piece", F.expr(f"pos div {PIECE}")).join(dealt, ["chrom", "piece"])
    rows = rows.withColumn("ref", F.substring("part", (F.col("pos") % PIECE + 1).cast("int"), F.lit(1))).where("ref in ('A', 'C', 'G', 'T') and base <> ref")
    sites = rows.groupBy("chrom", "pos", "ref", "depth").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "base"))).alias("v"))  # three bases at most
    return sites.select(
        "chrom", (F.col("pos") + 1).alias("pos"), F.lit(None).cast("string").alias("id"), "ref", F.array_join(F.transform("v", lambda x: x["base"]), ",").alias("alts"),
        (F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s - x["n"]) * 20).cast("double").alias("qual"), F.lit("PASS").alias("filter"), F.create_map(F.lit("DP"), F.col("depth").cast("string")).alias("info"), F.col("pos").alias("ord"),
    )
