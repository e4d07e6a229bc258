"""Binary indexes of block-compressed files, and the data files that they belong to."""

from __future__ import annotations

import gzip
import struct

from pyspark.sql import DataFrame, SparkSession

from . import binary, genomics
from .lines import open_file

#: The bin that holds counts instead of places, and the suffix of the data file by that of its index.
COUNTS_BIN = 37450
DATA_OF = {"bai": "bam", "crai": "cram"}


def content_of(spark: SparkSession, path: str) -> bytes:
    """A whole index: it is small beside the file that it indexes."""
    stream = open_file(spark, path)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def data_file(spark: SparkSession, path: str) -> str | None:
    """x.bam of x.bam.bai or x.bai; x of x.tbi or x.csi; None where it is not there."""
    stem, _, suffix = path.rpartition(".")
    kind = DATA_OF.get(suffix.lower())
    for found in ([stem, f"{stem}.{kind}"] if kind and stem.lower().endswith("." + kind) else [f"{stem}.{kind}"] if kind else [stem]):
        if stem and _exists(spark, found):
            return found
    return None


def contig_names(content: bytes) -> list[str]:
    """Names in a tabix index (tbi, or csi with tabix data), in order."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if data[:4] == b"TBI\x01":
        at = 32
    elif data[:4] == b"CSI\x01":
        at = 16 + 24  # the auxiliary data begin with six numbers
        if struct.unpack_from("<i", data, 12)[0] < 28:
            raise ValueError("a csi index without contig names")
    else:
        raise ValueError("not a tabix index")
    n = struct.unpack_from("<i", data, at)[0]
    return [x.decode() for x in data[at + 4 : at + 4 + n].split(b"\0") if x]


def reference_counts(content: bytes) -> list[tuple[int, int]]:
    """(mapped, unmapped) reads of each reference of a bai index."""
    if content[:4] != b"BAI\x01":
        raise ValueError("not a bai index")
    n_ref, at = struct.unpack_from("<i", content, 4)[0], 8
    out = []
    for _ in range(n_ref):
        counts = (0, 0)
        n_bin, at = struct.unpack_from("<i", content, at)[0], at + 4
        for _ in range(n_bin):
            name, chunks = struct.unpack_from("<Ii", content, at)
            if name == COUNTS_BIN and chunks == 2:
                counts = struct.unpack_from("<QQ", content, at + 24)
            at += 8 + 16 * chunks
        at += 4 + 8 * struct.unpack_from("<i", content, at)[0]
        out.append(counts)
    return out


def contigs(spark: SparkSession, path: str, indexed: str | None = None) -> DataFrame:
    """reference, length of a tabix index: names from the index, lengths from the header of the indexed file, else 0."""
    names = contig_names(content_of(spark, path))
    indexed = indexed or data_file(spark, path)
    lengths = {r["reference"]: r["length"] for r in genomics.contigs(spark, indexed).collect()} if indexed else {}  # a row a contig
    return spark.createDataFrame([(n, lengths.get(n, 0)) for n in names], "reference string, length long")


def idxstats(spark: SparkSession, path: str, indexed: str | None = None) -> DataFrame:
    """reference, length, mapped, unmapped of a bai index and the file that it indexes; needs that file's header."""
    indexed = indexed or data_file(spark, path)
    if not indexed:
        raise ValueError(f"the file that {path} indexes is not there")
    header = binary.bam_header(spark, indexed)[1]
    rows = [(name, length, *c) for (name, length), c in zip(header, reference_counts(content_of(spark, path)))]
    return spark.createDataFrame(rows, "reference string, length long, mapped long, unmapped long")
