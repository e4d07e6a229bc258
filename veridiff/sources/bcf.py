"""BCF: the binary form of variant files, decoded to the columns of the text form."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RECORDS = "chrom string, pos long, id string, ref string, alts string, qual double, filter string, info map<string,string>, ord long"
#: Value types, their sizes, codes and missing values.
INTEGERS = {1: ("b", -128), 2: ("h", -32768), 3: ("i", -(2**31))}
FLOAT, TEXT = 5, 7
MISSING_FLOAT = 0x7F800001


def header_names(text: str) -> tuple[list[str], list[str]]:
    """Contig names by number, and the dictionary of filter, info and format names by number."""
    contigs: dict[int, str] = {}
    names: dict[int, str] = {0: "PASS"}
    for line in text.split("\n"):
        m = re.match(r"##(contig|FILTER|INFO|FORMAT)=<(.*)>", line)
        if not m:
            continue
        name, number = re.search(r"(?:^|,)ID=([^,>]+)", m[2]), re.search(r"(?:^|,)IDX=(\d+)", m[2])
        held = contigs if m[1] == "contig" else names
        if name and name[1] not in held.values():
            held[int(number[1]) if number else len(held)] = name[1]
    table = lambda held: [held.get(i, "") for i in range(max(held, default=-1) + 1)]
    return table(contigs), table(names)


class Reader:
    """Typed values one after the other."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def typed(self):
        """A list of numbers (None where missing) or a text."""
        kind = self.data[self.at]
        self.at += 1
        n = kind >> 4
        if n == 15:
            n = self.typed()[0]
        kind &= 15
        if kind == TEXT:
            raw = self.data[self.at : self.at + n]
            self.at += n
            return raw.rstrip(b"\0").decode()
        if kind in INTEGERS:
            code, missing = INTEGERS[kind]
            values = struct.unpack_from(f"<{n}{code}", self.data, self.at)
            self.at += n * struct.calcsize(code)
            return [None if v == missing else v for v in values if v != missing + 1]  # one above missing ends a vector
        if kind == FLOAT:
            bits = struct.unpack_from(f"<{n}I", self.data, self.at)
            values = struct.unpack_from(f"<{n}f", self.data, self.at)
            self.at += 4 * n
            return [None if b == MISSING_FLOAT else v for b, v in zip(bits, values) if b != MISSING_FLOAT + 1]
        return []  # a flag


def _text(value) -> str:
    if isinstance(value, str):
        return value
    return ",".join("." if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in value) or "true"


def records(content: bytes) -> Iterator[tuple]:
    """Rows of RECORDS."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    if data[:3] != b"BCF":
        raise ValueError("not a BCF file")
    n = struct.unpack_from("<I", data, 5)[0]
    contigs, names = header_names(data[9 : 9 + n].rstrip(b"\0").decode())
    at, place = 9 + n, 0
    while at + 8 <= len(data):
        shared, single = struct.unpack_from("<II", data, at)
        chrom, pos, _, bits, counts, _ = struct.unpack_from("<iiiIII", data, at + 8)
        r = Reader(data, at + 32)
        name = r.typed()
        alleles = [r.typed() for _ in range(counts >> 16)]
        filters = ";".join(names[i] for i in r.typed() if i is not None)
        info = []
        for _ in range(counts & 0xFFFF):
            key = names[r.typed()[0]]
            info.append((key, _text(r.typed())))
        qual = None if bits == MISSING_FLOAT else struct.unpack("<f", struct.pack("<I", bits))[0]
        yield contigs[chrom], pos + 1, None if name in ("", ".") else name, alleles[0] if alleles else "", ",".join(a for a in alleles[1:] if a != "."), qual, filters, info, place
        at, place = at + 8 + shared + single, place + 1


def bcf(spark: SparkSession, path: str) -> DataFrame:
    """The columns of :func:`genomics.vcf`; one file a task, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, i64 = pa.string(), pa.int64()
        types = [s, i64, s, s, s, pa.float64(), s, pa.map_(s, s), i64]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for b in batches:
            for content in b.column(0):
                held: list[tuple] = []
                for r in records(content.as_py()):
                    held.append(r)
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)
