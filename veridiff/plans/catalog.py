"""The strategies of each format family, their parameters and defaults."""

from __future__ import annotations

#: Family -> extensions and aliases, default strategy, strategies with parameter defaults.
CATALOG: dict[str, dict] = {
    "fasta": {"formats": ("fasta", "fa", "fna"), "default": "exact", "strategies": {"exact": {"by_name": False, "ignore_case": True, "single_line": False}, "approximate": {"by_name": False, "ignore_case": True, "single_line": False}, "summary": {"k": 11, "num_bins": 10, "ignore_case": True}}},
    "fastq": {"formats": ("fastq", "fq"), "default": "summary", "strategies": {"exact": {}, "approximate": {"trim_tolerance": 2, "quality_tolerance": 2}, "summary": {"k": 11, "num_bins": 10}}},
    "table": {"formats": ("csv", "tsv", "gct", "table", "tab", "xlsx"), "default": "approximate", "strategies": {"exact": {"question": ""}, "approximate": {"question": "", "fuzzy_id_match": True}, "summary": {}, "semantic": {"question": "", "max_rows": 1000}}},
    "bam": {"formats": ("bam", "sam", "cram"), "default": "summary", "strategies": {"exact": {}, "approximate": {"min_mapq": 20, "overlap_threshold": 0.95, "chunk_size": 100_000}, "summary": {}, "coverage": {"depth0_similarity": None}, "variant": {"ref_fasta": None, "vcf_strategy": "summary"}}},
    "bai": {"formats": ("bai", "crai"), "default": "functional", "strategies": {"functional": {"indexed_file": None}, "summary": {}}},
    "vcf": {"formats": ("vcf", "bcf"), "default": "summary", "strategies": {"exact": {}, "approximate": {"position_window": 10, "require_allele_match": True}, "summary": {}}},
    "bed": {"formats": ("bed", "bedgraph", "bg", "narrowpeak", "broadpeak"), "default": "approximate", "strategies": {"exact": {"coord_only": True, "ignore_order": False, "merge_overlap": False}, "approximate": {"tolerance": 0, "overlap_threshold": 0.95, "coord_only": True, "merge_overlap": False, "ignore_order": True}, "overlap": {"merge_overlap": True}, "correlation": {"overlap_threshold": 0.95, "correlation_method": "pearson"}, "summary": {"num_bins": 50}}},
    "bigwig": {"formats": ("bigwig", "bw", "wig"), "default": "summary", "strategies": {"exact": {"max_positions": None}, "approximate": {"tolerance": 1.0, "max_positions": None}, "correlation": {"correlation_method": "pearson", "max_positions": None}, "summary": {"num_bins": 50, "max_positions": None}}},
    "fai": {"formats": ("fai",), "default": "exact", "strategies": {"exact": {}, "approximate": {"tolerance": 0.0, "max_rae": 1e6}, "summary": {"num_bins": 10}}},
    "tbi": {"formats": ("tbi", "csi"), "default": "functional", "strategies": {"functional": {"indexed_file": None}, "summary": {}}},
    "pdb": {"formats": ("pdb", "cif", "mmcif"), "default": "exact", "strategies": {"exact": {"by_name": True}, "approximate": {"by_name": True, "sequence_weight": 0.5, "structure_weight": 0.5, "rmsd_threshold": 2.0}, "summary": {"num_bins": 10}}},
    "txt": {"formats": ("txt", "text", "log", "md", "html"), "default": "semantic", "strategies": {"exact": {"ignore_whitespace": False, "ignore_case": False}, "approximate": {"compare_by": "line", "ignore_whitespace": True, "ignore_case": True}, "semantic": {"question": "", "model": ""}, "summary": {}, "numeric": {"tolerance": None}}},
    "image": {"formats": ("image", "png", "jpeg", "jpg", "gif", "tiff", "bmp", "webp", "svg", "pdf"), "default": "semantic", "strategies": {"semantic": {"question": "", "model": ""}}},
}
ALIASES = {("vcf", "statistics"): "summary", ("vcf", "statistical"): "summary", ("bigwig", "semantic"): "summary"}

#: Formats of the families above whose files only a registered handler can read.
BY_HANDLER = ("cram", "crai")

BY_FORMAT = {f: family for family, spec in CATALOG.items() for f in spec["formats"]}


def family_of(fmt: str) -> str | None:
    return BY_FORMAT.get(fmt.lower().lstrip("."))


def family_of_path(path: str) -> str | None:
    """The family by a file's name alone; a compression suffix does not count."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for packed in (".gz", ".bgz", ".bz2", ".xz"):
        name = name.removesuffix(packed)
    return family_of(name.rsplit(".", 1)[-1]) if "." in name else None


def resolve(family: str, strategy: str | None) -> str:
    """The strategy of that name or alias, else the family's default."""
    name = (strategy or "").lower()
    name = ALIASES.get((family, name), name)
    return name if name in CATALOG[family]["strategies"] else CATALOG[family]["default"]


def coerce(value, like):
    """A parameter given as text, in the type of its default."""
    if not isinstance(value, str) or isinstance(like, str):
        return value
    text = value.strip()
    if isinstance(like, bool):
        return text.lower() in ("true", "1", "yes")
    if text.lower() in ("", "none", "null", "nan"):
        return None
    for kind in (type(like),) if isinstance(like, int | float) else (int, float):
        try:
            return kind(float(text)) if kind is int else kind(text)
        except ValueError:
            continue
    return value


def parameters(family: str, strategy: str, given: dict) -> dict:
    """Defaults overlaid with the known parameters that are given."""
    defaults = CATALOG[family]["strategies"][strategy]
    return {k: coerce(given[k], d) if k in given else d for k, d in defaults.items()}
