"""Scans of sequence, read, alignment, variant, interval, signal, index and structure text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lines import numbered_lines


def fasta(spark: SparkSession, path: str, ignore_case: bool = True) -> DataFrame:
    """id, seq, n_lines, ord: a header opens a record; its number is the running count of headers."""
    x = numbered_lines(spark, path).withColumn("h", F.col("value").startswith(">").cast("long"))
    # running count by chunks of lines, so that no task sorts the file
    x = x.withColumn("chunk", F.floor(F.col("_row") / 100_000))
    per = x.groupBy("file", "chunk").agg(F.sum("h").alias("k"))
    per = per.withColumn("base", F.coalesce(F.sum("k").over(Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("k")
    inside = F.sum("h").over(Window.partitionBy("file", "chunk").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    x = x.join(F.broadcast(per), ["file", "chunk"]).withColumn("ord", F.col("base") + inside).where("ord > 0")
    body = F.when(F.col("h") == 0, F.trim("value"))
    rec = x.groupBy("file", "ord").agg(F.max(F.when(F.col("h") == 1, F.substring("value", 2, 1 << 30))).alias("head"), F.sort_array(F.collect_list(F.when(body.isNotNull() & (body != ""), F.struct("_row", body.alias("s"))))).alias("b"))
    seq = F.array_join(F.transform("b", lambda v: v["s"]), "")
    return rec.select(F.split(F.trim("head"), r"\s+")[0].alias("id"), (F.upper(seq) if ignore_case else seq).alias("seq"), F.size("b").alias("n_lines"), "ord")


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, seq, qual (Phred numbers), ord: four lines a record."""
    x = numbered_lines(spark, path).withColumn("ord", F.floor(F.col("_row") / 4)).withColumn("k", F.col("_row") % 4)
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    rec = x.groupBy("file", "ord").agg(part(0).alias("h"), part(1).alias("seq"), part(3).alias("q")).where("h like '@%'")
    return rec.select(F.split(F.substring("h", 2, 1 << 30), r"\s+")[0].alias("id"), "seq", F.transform(F.filter(F.split("q", ""), lambda c: c != ""), lambda c: F.ascii(c) - 33).alias("qual"), "ord")


def _fields(spark: SparkSession, path: str, comments: tuple[str, ...]) -> DataFrame:
    x = numbered_lines(spark, path)
    for c in comments:
        x = x.where(~F.col("value").startswith(c))
    return x.where(F.trim("value") != "").select("_row", F.split("value", "\t").alias("f"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """The mandatory fields, positions from 0, the covered length, and the tags as a map."""
    from ..operators.alignments import cigar_ops

    f = F.col("f")
    ops = cigar_ops(f[5])
    covered = F.aggregate(F.filter(ops, lambda o: o["op"].isin(0, 2, 3, 7, 8)), F.lit(0), lambda s, o: s + o["len"])
    tags = F.map_from_entries(F.transform(F.slice(f, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, 4, 1 << 20).alias("v"))))
    flag = f[1].try_cast("int")
    return _fields(spark, path, ("@",)).where(F.size("f") >= 11).select(
        f[0].alias("qname"), (flag.bitwiseAND(F.lit(128)) != 0).cast("int").alias("is_read2"), flag.alias("flag"), f[2].alias("rname"), (f[3].try_cast("long") - 1).alias("pos"), f[4].try_cast("int").alias("mapq"),
        covered.alias("len"), f[5].alias("cigar"), f[6].alias("rnext"), (f[7].try_cast("long") - 1).alias("pnext"), f[8].try_cast("long").alias("tlen"), f[9].alias("seq"), f[10].alias("qual"), tags.alias("tags"), F.col("_row").alias("ord"),
    )


def sam_header(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Header lines, and names and lengths of the contigs, of a text file."""
    lines = [r["value"] for r in numbered_lines(spark, path).where(F.col("value").startswith("@")).orderBy("_row").collect()]  # a line a contig or group
    tags = [dict(x.split(":", 1) for x in h.split("\t")[1:] if ":" in x) for h in lines if h.startswith("@SQ")]
    return lines, [(t["SN"], int(t.get("LN", 0))) for t in tags if "SN" in t]


def vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alts, qual, filter, info (map), ord."""
    f = F.col("f")
    info = F.map_from_entries(F.transform(F.filter(F.split(F.coalesce(F.get(f, F.lit(7)), F.lit("")), ";"), lambda s: (s != "") & (s != ".")), lambda s: F.struct(F.split(s, "=", 2)[0].alias("k"), F.coalesce(F.get(F.split(s, "=", 2), F.lit(1)), F.lit("true")).alias("v"))))
    dot = lambda c: F.when(c != ".", c)
    return _fields(spark, path, ("#",)).where(F.size("f") >= 5).select(
        f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), dot(f[2]).alias("id"), f[3].alias("ref"), F.coalesce(dot(f[4]), F.lit("")).alias("alts"),
        F.get(f, F.lit(5)).try_cast("double").alias("qual"), F.coalesce(dot(F.get(f, F.lit(6))), F.lit("")).alias("filter"), info.alias("info"), F.col("_row").alias("ord"),
    )


def bed(spark: SparkSession, path: str, coord_only: bool = False) -> DataFrame:
    """chrom, start, end, score, ord; score is column 4 of a file that has four, else column 5."""
    f = F.col("f")
    x = _fields(spark, path, ("#", "track", "browser")).where(F.size("f") >= 3)
    x = x.where(f[1].try_cast("long").isNotNull() & f[2].try_cast("long").isNotNull())
    core = [f[0].alias("chrom"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end")]
    if coord_only:
        return x.select(*core, F.col("_row").alias("ord"))
    width = x.agg(F.max(F.size("f"))).first()[0] or 0
    score = F.get(f, F.lit(3 if width == 4 else 4)).try_cast("double")
    return x.select(*core, score.alias("score"), F.slice(f, 4, 1 << 20).alias("rest"), F.col("_row").alias("ord"))


def bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value of each run."""
    f = F.col("f")
    x = _fields(spark, path, ("#", "track", "browser")).where(F.size("f") >= 4).select(f[0].alias("chrom"), f[1].try_cast("long").alias("start"), f[2].try_cast("long").alias("end"), f[3].try_cast("double").alias("value"))
    return x.where("`end` > start")


def wig(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end, value of fixedStep and variableStep sections; positions from 0, a run for each span.

    A line's section is the last one opened in its block of lines, or else in the blocks before.
    """
    x = numbered_lines(spark, path).where("value not like '#%' and value not like 'track%' and value not like 'browser%' and trim(value) <> ''")
    x = x.withColumn("head", F.col("value").rlike("^(fixed|variable)Step")).withColumn("chunk", F.floor(F.col("_row") / 100_000))
    opened = F.when(F.col("head"), F.struct(F.col("_row").alias("r"), F.col("value").alias("v")))
    per = x.groupBy("file", "chunk").agg(F.max(opened).alias("o"))
    earlier = F.last("o", ignorenulls=True).over(Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.last(opened, ignorenulls=True).over(Window.partitionBy("file", "chunk").orderBy("_row"))
    x = x.withColumn("own", inside).join(F.broadcast(per.withColumn("earlier", earlier).drop("o")), ["file", "chunk"])
    x = x.withColumn("h", F.coalesce("own", "earlier")).where(~F.col("head") & F.col("h").isNotNull())
    opt = lambda k, d: F.coalesce(F.regexp_extract("h.v", k + "=([0-9]+)", 1).try_cast("long"), F.lit(d))
    fixed, v = F.col("h.v").startswith("fixed"), F.split(F.trim("value"), r"\s+")
    start = F.when(fixed, opt("start", 1) + (F.col("_row") - F.col("h.r") - 1) * opt("step", 1)).otherwise(v[0].try_cast("long")) - 1
    value = F.when(fixed, v[0].try_cast("double")).otherwise(F.get(v, F.lit(1)).try_cast("double"))
    return x.select(F.regexp_extract("h.v", r"chrom=(\S+)", 1).alias("chrom"), start.alias("start"), (start + opt("span", 1)).alias("end"), value.alias("value"))


def fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("name string, length long, offset_ long, linebases long, linewidth long").csv(path, sep="\t")


def contigs(spark: SparkSession, path: str) -> DataFrame:
    """reference, length from the contig lines of a header; 0 where none is given."""
    x = numbered_lines(spark, path).where("value like '##contig=%'")
    return x.select(F.regexp_extract("value", "ID=([^,>]+)", 1).alias("reference"), F.coalesce(F.regexp_extract("value", "length=([0-9]+)", 1).try_cast("long"), F.lit(0)).alias("length"))


def pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of the first model: chain, res_ord, resname, hetero, atom, x, y, z."""
    x = numbered_lines(spark, path)
    end = x.where("value like 'ENDMDL%'").groupBy("file").agg(F.min("_row").alias("end"))
    x = x.join(F.broadcast(end), "file", "left").where("(value like 'ATOM%' or value like 'HETATM%') and (end is null or _row < end)")
    cut = lambda a, n: F.trim(F.substring("value", a, n))
    return x.select(cut(22, 1).alias("chain"), cut(23, 4).try_cast("int").alias("res_ord"), cut(18, 3).alias("resname"), F.col("value").startswith("HETATM").alias("hetero"), cut(13, 4).alias("atom"), *(cut(31 + 8 * i, 8).try_cast("double").alias(c) for i, c in enumerate("xyz")))


def mmcif(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from the ``_atom_site`` loop of an mmCIF file; author's names of chains and residues go first."""
    x = numbered_lines(spark, path)
    heads = x.where("value like '_atom_site.%'").select("file", "_row", F.regexp_extract("value", r"^_atom_site\.(\S+)", 1).alias("name")).orderBy("file", "_row").collect()  # a line a column
    if not heads:
        return spark.createDataFrame([], "chain string, res_ord int, resname string, hetero boolean, atom string, x double, y double, z double")
    names = [r["name"] for r in heads if r["file"] == heads[0]["file"]]
    last = max(r["_row"] for r in heads)
    # rows follow the last column name up to the next item
    rows = x.where(F.col("_row") > last)
    end = rows.where(r"value rlike '^(#|loop_|_|data_)'").groupBy("file").agg(F.min("_row").alias("end"))
    rows = rows.join(F.broadcast(end), "file", "left").where("(end is null or _row < end) and trim(value) <> ''")
    word = r"""('[^']*'(?:[^\s'][^']*')*(?=\s|$)|"[^"]*"(?:[^\s"][^"]*")*(?=\s|$)|\S+)"""
    rows = rows.select(F.transform(F.regexp_extract_all("value", F.lit(word), F.lit(1)), lambda w: F.regexp_replace(w, r"""^(['"])(.*)\1$""", "$2")).alias("f"))

    def field(*wanted: str):
        given = [F.get("f", F.lit(names.index(w))) for w in wanted if w in names]
        return F.coalesce(*(F.when(~g.isin(".", "?"), g) for g in given)) if given else F.lit(None).cast("string")

    model = F.coalesce(field("pdbx_PDB_model_num").try_cast("int"), F.lit(1))
    atoms = rows.select(
        field("auth_asym_id", "label_asym_id").alias("chain"), field("auth_seq_id", "label_seq_id").try_cast("int").alias("res_ord"), field("label_comp_id", "auth_comp_id").alias("resname"),
        (field("group_PDB") == "HETATM").alias("hetero"), field("label_atom_id", "auth_atom_id").alias("atom"), *(field(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"), model.alias("model"),
    )
    first = atoms.agg(F.min("model").alias("first"))
    return atoms.crossJoin(F.broadcast(first)).where("model = first").drop("model", "first")


def text(spark: SparkSession, path: str, ignore_whitespace: bool = False, ignore_case: bool = False) -> DataFrame:
    """(path, text): whole files."""
    from ..operators.texts import normalise

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), normalise(F.col("value"), ignore_whitespace, ignore_case).alias("text"))


def image(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, payload): image bytes in base64, for a judging provider."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.base64("content").alias("payload"))
