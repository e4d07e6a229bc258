"""File scans: tables written in each text format to a scratch folder, read back and compared with the tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import load
from ..sources import delimited, genomics, lines
from .registry import query

_written: list[tuple[object, object]] = []


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared one that the session names; a temporary folder only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="veridiff-scan-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/veridiff-scan-{uuid.uuid4().hex}")
    _written.append((path.getFileSystem(spark._jsc.hadoopConfiguration()), path))
    return path.toString()


@atexit.register
def _clean() -> None:
    for fs, path in _written:
        try:
            fs.delete(path, True)
        except Exception:  # noqa: BLE001  the gateway may be gone already at exit
            return


def written(spark: SparkSession, rows: DataFrame, value, order: str | None = None) -> str:
    """A folder with the texts of ``value``; one file in the given order where the format needs one, small tables only."""
    path = scratch(spark)
    out = rows.coalesce(1).sortWithinPartitions(order) if order else rows
    out.select(value.alias("value")).write.text(path)
    return path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(" SELECT id::VARCHAR AS id, seq, CASE WHEN len(seq) > 60 THEN 2 ELSE 1 END AS n_lines FROM seq_ref WHERE seq <> ''", ("seq_ref",))
def scan_fasta(spark, sf_dir):
    rows = load(spark, sf_dir, "seq_ref").where("seq <> ''")
    value = F.concat(F.lit(">"), "id", F.lit(" words of the header\n"), F.lower(F.substring("seq", 1, 60)), F.lit("\n"), F.substring("seq", 61, 1 << 30))
    return genomics.fasta(spark, written(spark, rows, value)).select("id", "seq", "n_lines")


@query(" SELECT id::VARCHAR AS id, seq, len(seq) AS n, id % 40 AS q FROM seq_ref WHERE seq <> ''", ("seq_ref",))
def scan_fastq(spark, sf_dir):
    rows = load(spark, sf_dir, "seq_ref").where("seq <> ''")
    quality = F.repeat(F.char(33 + F.col("id") % 40), F.length("seq"))
    value = F.concat(F.lit("@"), "id", F.lit(" x\n"), "seq", F.lit("\n+\n"), quality)
    reads = genomics.fastq(spark, written(spark, rows, value))
    return reads.select("id", "seq", F.size("qual").cast("long").alias("n"), F.array_max("qual").cast("long").alias("q"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) + 1 AS _row FROM customer")
def scan_delimited(spark, sf_dir):
    """A comment line, a header, tabs; types follow from the values."""
    names = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
    rows = _table(spark, sf_dir, "customer").select(*names).withColumn("v", F.concat_ws("\t", *names))
    head = spark.createDataFrame([(-1, "# a comment\n" + "\t".join(names))], "c_custkey long, v string")
    path = written(spark, rows.select("c_custkey", "v").unionByName(head), F.col("v"), "c_custkey")
    file = [r["path"] for r in lines.listing(spark, path).collect()][0]
    got = delimited.read_table(spark, file)
    return got.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.col("_row").cast("long").alias("_row"))


@query('SELECT n_name AS "Name", n_regionkey AS "s1", n_nationkey + 0.5 AS "s2" FROM nation')
def scan_gct(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", F.concat_ws("\t", "n_name", F.lit("about"), "n_regionkey", (F.col("n_nationkey") + 0.5).cast("string")).alias("v"))
    head = spark.createDataFrame([(-1, "#1.2\n25\t2\nName\tDescription\ts1\ts2")], "n_nationkey long, v string")
    path = written(spark, rows.unionByName(head), F.col("v"), "n_nationkey")
    file = [r["path"] for r in lines.listing(spark, path).collect()][0]
    return delimited.read_table(spark, file).select("Name", "s1", F.col("s2").cast("double").alias("s2"))


@query(" SELECT qname, is_read2, flag, rname, pos, mapq, len, cigar, pnext, tlen, 'i:' || (pos % 9) AS nm FROM sam_ref", ("sam_ref",))
def scan_sam(spark, sf_dir):
    rows = load(spark, sf_dir, "sam_ref")
    nm = F.concat(F.lit("NM:i:"), F.col("pos") % 9)
    value = F.concat_ws("\t", "qname", "flag", "rname", F.col("pos") + 1, "mapq", "cigar", "rnext", F.col("pnext") + 1, "tlen", F.lit("*"), "qual", nm)
    reads = genomics.sam(spark, written(spark, rows, value))
    return reads.select("qname", "is_read2", "flag", "rname", "pos", "mapq", "len", "cigar", "pnext", "tlen", F.col("tags")["NM"].alias("nm"))


@query(" SELECT chrom, count(*) AS n, count(qual) AS n_qual, sum(pos)::BIGINT AS pos, sum(len(alts))::BIGINT AS alts, sum((filter = 'PASS')::INT)::BIGINT AS passed, sum(pos % 7)::BIGINT AS dp FROM (SELECT *, CASE WHEN qual > 10 THEN qual END AS q FROM vcf_raw) GROUP BY chrom".replace("count(qual)", "count(q)"), ("vcf_raw",))
def scan_vcf(spark, sf_dir):
    rows = load(spark, sf_dir, "vcf_raw")
    value = F.concat_ws("\t", "chrom", "pos", F.lit("."), "ref", F.expr("if(alts = '', '.', alts)"), F.expr("if(qual > 10, cast(qual as string), '.')"), "filter", F.concat(F.lit("DP="), F.col("pos") % 7, F.lit(";DB")))
    v = genomics.vcf(spark, written(spark, rows, value))
    return v.groupBy("chrom").agg(F.count("*").alias("n"), F.count("qual").alias("n_qual"), F.sum("pos").alias("pos"), F.sum(F.length("alts")).alias("alts"), F.sum((F.col("filter") == "PASS").cast("long")).alias("passed"), F.sum(F.col("info")["DP"].cast("long")).alias("dp"))


@query(' SELECT chrom, "start", "end", ord AS score FROM bed_ref', ("bed_ref",))
def scan_bed(spark, sf_dir):
    value = F.concat_ws("\t", "chrom", "start", "end", F.lit("name"), "ord")
    rows = genomics.bed(spark, written(spark, load(spark, sf_dir, "bed_ref"), value))
    return rows.select("chrom", "start", "end", F.col("score").cast("long").alias("score"))


@query(" SELECT chrom, pos AS start, pos + 1 AS \"end\", depth FROM signal_ref", ("signal_ref",))
def scan_bedgraph(spark, sf_dir):
    value = F.concat_ws("\t", "chrom", "pos", F.col("pos") + 1, "depth")
    rows = genomics.bedgraph(spark, written(spark, load(spark, sf_dir, "signal_ref"), value))
    return rows.select("chrom", "start", "end", F.col("value").cast("long").alias("depth"))


@query("SELECT 's' || s_nationkey AS chrom, 10 * s_suppkey + 10 * (k - 1) AS start, 10 * s_suppkey + 10 * (k - 1) + 4 AS \"end\", s_suppkey % 100 + k AS v FROM supplier, (SELECT unnest([1, 2]) AS k) ")
def scan_wig(spark, sf_dir):
    """A fixed-step section of two spans for each supplier."""
    s = _table(spark, sf_dir, "supplier")
    head = F.concat(F.lit("fixedStep chrom=s"), "s_nationkey", F.lit(" start="), 10 * F.col("s_suppkey") + 1, F.lit(" step=10 span=4\n"))
    value = F.concat(head, F.col("s_suppkey") % 100 + 1, F.lit("\n"), F.col("s_suppkey") % 100 + 2)
    return genomics.wig(spark, written(spark, s, value, "s_suppkey")).select("chrom", "start", "end", F.col("value").cast("long").alias("v"))


@query(" SELECT name, length, offset_, linebases, linewidth FROM fai_ref", ("fai_ref",))
def scan_fai(spark, sf_dir):
    return genomics.fai(spark, written(spark, load(spark, sf_dir, "fai_ref"), F.concat_ws("\t", "name", "length", "offset_", "linebases", "linewidth")))


@query("SELECT 'c' || n_nationkey AS reference, CASE WHEN n_nationkey % 2 = 0 THEN 1000 + n_nationkey ELSE 0 END AS length FROM nation")
def scan_contigs(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    value = F.concat(F.lit("##contig=<ID=c"), "n_nationkey", F.expr("if(n_nationkey % 2 = 0, concat(',length=', 1000 + n_nationkey), '')"), F.lit(">"))
    return genomics.contigs(spark, written(spark, n, value))


@query("SELECT 'A' AS chain, n_nationkey AS res_ord, 'ALA' AS resname, false AS hetero, 'CA' AS atom, n_nationkey + 0.5 AS x, n_regionkey + 0.25 AS y, 1.0 AS z FROM nation")
def scan_pdb(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    value = F.format_string("ATOM  %5d  CA  ALA A%4d    %8.3f%8.3f%8.3f", "n_nationkey", "n_nationkey", F.col("n_nationkey") + 0.5, F.col("n_regionkey") + 0.25, F.lit(1.0))
    return genomics.pdb(spark, written(spark, n, value, "n_nationkey")).select("chain", F.col("res_ord").cast("long").alias("res_ord"), "resname", "hetero", "atom", "x", "y", "z")


@query("SELECT 'X' AS chain, n_nationkey + 100 AS res_ord, 'GLY' AS resname, n_nationkey % 2 = 1 AS hetero, 'O5''' AS atom, n_nationkey + 0.5 AS x, n_regionkey + 0.25 AS y, 1.0 AS z FROM nation")
def scan_mmcif(spark, sf_dir):
    n = _table(spark, sf_dir, "nation")
    names = ("group_PDB", "id", "label_atom_id", "label_comp_id", "label_asym_id", "Cartn_x", "Cartn_y", "Cartn_z", "auth_seq_id", "auth_asym_id", "pdbx_PDB_model_num")
    head = "data_X\nloop_\n" + "\n".join("_atom_site." + x for x in names)
    value = F.concat_ws(" ", F.expr("if(n_nationkey % 2 = 1, 'HETATM', 'ATOM')"), F.col("n_nationkey") + 1, F.lit("\"O5'\""), F.lit("GLY"), F.lit("A"), F.col("n_nationkey") + 0.5, F.col("n_regionkey") + 0.25, F.lit(1.0), F.col("n_nationkey") + 100, F.lit("X"), F.lit(1))
    rows = n.select("n_nationkey", value.alias("v")).unionByName(spark.createDataFrame([(-1, head)], "n_nationkey long, v string"))
    return genomics.mmcif(spark, written(spark, rows, F.col("v"), "n_nationkey")).select("chain", F.col("res_ord").cast("long").alias("res_ord"), "resname", "hetero", "atom", "x", "y", "z")


@query("SELECT count(*) AS n, sum(i)::BIGINT AS places, sum(len(c_name))::BIGINT AS letters FROM (SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)")
def scan_numbered_lines(spark, sf_dir):
    x = lines.numbered_lines(spark, written(spark, _table(spark, sf_dir, "customer"), F.col("c_name"), "c_custkey"))
    return x.agg(F.count("*").alias("n"), F.sum("_row").alias("places"), F.sum(F.length("value")).alias("letters"))
