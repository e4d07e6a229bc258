"""Public calls: validate a file, compare two, list formats and strategies, register a handler, compare many."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import alignments, structures, variants
from .operators.texts import joined  # noqa: F401  (public)
from .plans import catalog
from .plans.models import AlignPlan
from .providers import Offline, Provider
from .sources import bcf, bigwig, binary, delimited, detect, genomics, indexes, lines
from .status import SCHEMA, Result, Validation
from .strategies import bam, bed, fasta, pdb, signals, table, txt, vcf

Handler = Callable[[SparkSession, str, str, str, dict, Provider], DataFrame]
_extra: dict[str, tuple[Callable[[SparkSession, str], DataFrame], Handler]] = {}


def register_handler(fmt: str, load: Callable[[SparkSession, str], DataFrame], compare: Handler) -> None:
    """Add a format: how its files load, and how (spark, ref, cand, strategy, parameters, provider) compare to one row."""
    _extra[fmt.lower()] = (load, compare)


def get_supported_formats() -> list[str]:
    """Formats that load; those of ``catalog.BY_HANDLER`` do once a handler is registered."""
    return sorted({*catalog.BY_FORMAT, *_extra} - ({*catalog.BY_HANDLER} - {*_extra}))


def get_supported_strategies(fmt: str) -> list[str]:
    family = catalog.family_of(fmt)
    return list(catalog.CATALOG[family]["strategies"]) if family else []


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def detect_format(spark: SparkSession, path: str) -> str:
    row = detect.signatures(spark, path).first()
    return row["format"] if row else "unknown"


def load(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """The records of a file."""
    if fmt in _extra:
        return _extra[fmt][0](spark, path)
    family = catalog.family_of(fmt)
    loaders = {
        "fasta": genomics.fasta, "fastq": genomics.fastq, "table": delimited.read_table, "vcf": genomics.vcf, "bed": genomics.bed, "fai": genomics.fai, "pdb": genomics.pdb, "txt": genomics.text, "image": genomics.image,
        "tbi": indexes.contigs, "bai": indexes.idxstats,
        "bigwig": genomics.wig, "bam": genomics.sam,
    }
    if fmt == "bam":
        return binary.bam(spark, path)
    if fmt in ("cif", "mmcif"):
        return genomics.mmcif(spark, path)
    if fmt == "xlsx":
        return binary.workbook(spark, path)
    if fmt in ("bigwig", "bw"):
        return bigwig.bigwig(spark, path)
    if fmt == "bcf":
        return bcf.bcf(spark, path)
    if fmt in catalog.BY_HANDLER:
        raise ValueError(f"binary {fmt} files need a registered handler; convert to bam or call register_handler")
    if family not in loaders:
        raise ValueError(f"unsupported format {fmt}")
    return loaders[family](spark, path)


def validate_file(spark: SparkSession, path: str, fmt: str | None = None) -> Validation:
    v = Validation(path, exists=_exists(spark, path))
    if not v.exists:
        v.error = "no such file"
        return v
    fmt = (fmt or detect_format(spark, path)).lower()
    v.format_ok = fmt in _extra or catalog.family_of(fmt) is not None
    if not v.format_ok:
        v.error = f"unsupported format {fmt}"
        return v
    try:
        v.n_records = load(spark, path, fmt).count()
        v.parseable = True
    except Exception as e:  # noqa: BLE001  any failure to read is a finding about the file
        v.error = str(e)[:500]
    return v


def _family(spark: SparkSession, family: str, fmt: str, ref: str, cand: str, strategy: str, p: dict, provider: Provider) -> DataFrame:
    a, b = load(spark, ref, fmt), load(spark, cand, fmt)
    if strategy == "semantic":
        score = provider.judge(family, a, b, str(p.get("question", "")))
        if score is None:
            raise ValueError("no provider for semantic comparison, or no judgement")
        return spark.createDataFrame([(float(score),)], "similarity double")
    if family == "fasta":
        if p.get("single_line"):
            b = b.where("n_lines = 1")
        if strategy == "approximate":
            return pdb.sequences_approximate(a, b, p["by_name"], p["ignore_case"])
        return fasta.exact(a, b, p["by_name"], p["ignore_case"]) if strategy == "exact" else fasta.summary(a, b, **p)
    if family == "fastq":
        return {"exact": fasta.reads_exact, "approximate": fasta.reads_approximate}.get(strategy, lambda x, y, **k: fasta.summary(x, y, ignore_case=False, **k))(a, b, **p)
    if family == "table":
        if strategy == "exact":
            return table.exact(a, b, "_row")
        if strategy == "summary":
            return table.summary(a.drop("_row"), b.drop("_row"))
        plan = provider.align(a.columns, b.columns)
        if plan == AlignPlan():
            names = {c.strip().lower() for c in b.columns}
            keys = table.O.find_id_columns(*table.O.align_columns(a.drop("_row"), b.drop("_row"))) if names else []
            plan = AlignPlan(id_columns=tuple(keys or ["_row"]), fuzzy_ids=p["fuzzy_id_match"] and len(keys) == 1)
        return table.approximate(a, b, plan, provider.compare(a.columns))
    if family == "bam":
        if strategy == "variant":
            if not p["ref_fasta"]:
                raise ValueError("a reference FASTA file is required to call variants")
            genome = genomics.fasta(spark, p["ref_fasta"])
            called = [variants.call(x, genome) for x in (a, b)]
            return {"exact": vcf.exact, "approximate": vcf.approximate, "summary": vcf.summary}[p["vcf_strategy"]](*called)
        if strategy == "coverage":
            sizes = [spark.createDataFrame((binary.bam_header if fmt == "bam" else genomics.sam_header)(spark, x)[1], "chrom string, size long") for x in (ref, cand)]
            return bam.coverage(alignments.depth(a, sizes[0]), alignments.depth(b, sizes[1]), p["depth0_similarity"])
        if strategy == "approximate":
            return bam.approximate(a, b, p["min_mapq"], p["overlap_threshold"])
        return bam.exact(a, b) if strategy == "exact" else bam.summary(a, b)
    if family == "vcf":
        return {"exact": vcf.exact, "approximate": vcf.approximate, "summary": vcf.summary}[strategy](a, b)
    if family == "bed":
        if p.get("merge_overlap") and strategy != "overlap":  # bed.overlap merges by itself
            a, b = (bed.I.merge(x).withColumn("ord", F.col("start")) for x in (a, b))
        if strategy == "exact":
            return bed.exact(a, b, p["ignore_order"])
        if strategy == "approximate":
            return bed.approximate(a, b, p["tolerance"], p["overlap_threshold"])
        if strategy == "correlation":
            return bed.correlation(a, b, p["overlap_threshold"], p["correlation_method"])
        return bed.overlap(a, b, merge=p["merge_overlap"]) if strategy == "overlap" else bed.summary(a, b, p["num_bins"])
    if family == "bigwig":
        a, b = signals.head(a, p["max_positions"]), signals.head(b, p["max_positions"])
        if strategy == "approximate":
            return signals.approximate(a, b, p["tolerance"])
        if strategy == "correlation":
            return signals.correlation(a, b, p["correlation_method"])
        return signals.exact(a, b) if strategy == "exact" else signals.summary(a, b, p["num_bins"])
    if family == "fai":
        return signals.fai_exact(a, b) if strategy == "exact" else signals.fai_approximate(a, b, p["tolerance"]) if strategy == "approximate" else signals.fai_summary(a, b, p["num_bins"])
    if family in ("tbi", "bai"):
        if strategy == "summary":
            size = lambda path: spark.read.format("binaryFile").load(path).select("length")
            return size(ref).toDF("x").crossJoin(size(cand).toDF("y")).select(signals.size_similarity(F.col("x"), F.col("y")).alias("similarity"))
        if p["indexed_file"]:
            a, b = ((indexes.contigs if family == "tbi" else indexes.idxstats)(spark, x, p["indexed_file"]) for x in (ref, cand))
        return (signals.contigs_functional if family == "tbi" else signals.idxstats_functional)(a, b)
    if family == "pdb":
        if strategy == "summary":
            return pdb.summary(a, b, p["num_bins"])
        return (pdb.exact if strategy == "exact" else pdb.approximate)(structures.chains(a), structures.chains(b), **p)
    if family == "txt":
        if strategy == "exact":
            numbered = lambda df: df.select(F.lit(0).alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            return txt.exact(numbered(a), numbered(b), **p).drop("doc")
        pair = a.select(F.col("text").alias("ref")).crossJoin(b.select(F.col("text").alias("cand")))
        if strategy == "approximate":
            return txt.approximate(pair, **p)
        if strategy == "summary":
            return txt.summary(pair)
        if strategy == "numeric":
            return pair.select(txt.numeric(F.col("ref"), F.col("cand"), p["tolerance"]).alias("similarity"))
    raise ValueError(f"no comparison {strategy} of {family}")


def compare_files(spark: SparkSession, ref: str, cand: str, strategy: str | None = None, fmt: str | None = None, provider: Provider | None = None, task_id: str | None = None, **given) -> Result:
    """Compare a candidate file with a reference file."""
    provider = provider or Offline()
    fmt = (fmt or (detect_format(spark, ref) if _exists(spark, ref) else detect.extension(ref))).lower()
    if fmt == "unknown" and _exists(spark, ref):
        fmt = provider.format(ref, lines.head(spark, ref)) or fmt
    family = catalog.family_of(fmt)
    name = catalog.resolve(family, strategy) if family else strategy or ""
    params = catalog.parameters(family, name, given) if family else given
    out = Result(ref, cand, fmt, name, params, task_id=task_id)
    checks = validate_file(spark, ref, fmt), validate_file(spark, cand, fmt)
    if checks[0].is_valid and checks[1].is_valid and checks[1].n_records:
        try:
            run = _extra[fmt][1](spark, ref, cand, name, params, provider) if fmt in _extra else _family(spark, family, fmt, ref, cand, name, params, provider)
            row = run.first().asDict()
            out.similarity = row.pop("similarity")
            out.details = row
        except Exception as e:  # noqa: BLE001  the status tells the caller
            out.error = str(e)[:500]
    return out.settle(*checks)


class ComparisonRunner:
    """Compares many pairs; results are one table in the canonical schema."""

    def __init__(self, spark: SparkSession, provider: Provider | None = None):
        self.spark, self.provider = spark, provider or Offline()

    def compare_files(self, pairs: list[dict], task_id: str | None = None) -> DataFrame:
        """Each pair: ref, cand and, as wanted, strategy, fmt and parameters."""
        rows = [compare_files(self.spark, x["ref"], x["cand"], x.get("strategy"), x.get("fmt"), self.provider, task_id, **x.get("parameters", {})).row() for x in pairs]
        return self.spark.createDataFrame(rows, SCHEMA)
