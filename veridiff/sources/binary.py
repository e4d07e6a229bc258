"""Binary containers decoded on the executors, one file a task: BAM reads, workbook sheets."""

from __future__ import annotations

import gzip
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Base codes and operation letters of the format.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
READS = "qname string, is_read2 int, flag int, rname string, pos long, mapq int, len int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>, ord long"


def _tags(data: bytes) -> dict[str, str]:
    out, i = {}, 0
    while i + 3 <= len(data):
        name, kind = data[i : i + 2].decode(), chr(data[i + 2])
        i += 3
        if kind in "ZH":
            end = data.index(b"\0", i)
            out[name], i = f"{kind}:{data[i:end].decode()}", end + 1
        elif kind == "B":
            sub, n = chr(data[i]), struct.unpack_from("<i", data, i + 1)[0]
            code = {"C": "B", "c": "b", "S": "H", "s": "h", "I": "I", "i": "i", "f": "f"}[sub]
            values = struct.unpack_from(f"<{n}{code}", data, i + 5)
            out[name] = f"B:{sub}," + ",".join(map(str, values))
            i += 5 + n * SIZES[sub]
        else:
            code = {"A": "c", "C": "B", "c": "b", "S": "H", "s": "h", "I": "I", "i": "i", "f": "f"}[kind]
            v = struct.unpack_from("<" + code, data, i)[0]
            out[name] = f"A:{v.decode()}" if kind == "A" else f"{'f' if kind == 'f' else 'i'}:{v}"
            i += SIZES[kind]
    return out


def bam_records(content: bytes) -> Iterator[tuple]:
    """Rows of READS; the block-compressed file is a series of gzip members."""
    data = gzip.decompress(content)
    if data[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    i = 8 + struct.unpack_from("<i", data, 4)[0]
    n_ref = struct.unpack_from("<i", data, i)[0]
    i += 4
    names = []
    for _ in range(n_ref):
        n = struct.unpack_from("<i", data, i)[0]
        names.append(data[i + 4 : i + 3 + n].decode())
        i += 8 + n
    name_of = lambda k: names[k] if k >= 0 else "*"
    ord_ = 0
    while i < len(data):
        size, ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, i)
        j, end = i + 36, i + 4 + size
        qname = data[j : j + n_name - 1].decode()
        j += n_name
        ops = [(x & 15, x >> 4) for x in struct.unpack_from(f"<{n_cigar}I", data, j)]
        j += 4 * n_cigar
        packed = data[j : j + (n_seq + 1) // 2]
        seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n_seq]
        j += len(packed)
        quals = data[j : j + n_seq]
        qual = "*" if not quals or quals[0] == 255 else "".join(chr(q + 33) for q in quals)
        covered = sum(n for op, n in ops if op in (0, 2, 3, 7, 8))
        cigar = "".join(f"{n}{OPS[op]}" for op, n in ops) or "*"
        yield qname, int(flag & 128 != 0), flag, name_of(ref), pos, mapq, covered, cigar, "=" if mate == ref >= 0 else name_of(mate), mate_pos, tlen, seq or "*", qual, list(_tags(data[j + n_seq : end]).items()), ord_
        i, ord_ = end, ord_ + 1


def bam_header(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Header lines, and names and lengths of the contigs, from as much of the file's beginning as they take."""
    from .lines import first_bytes

    size = 1 << 18
    while True:
        raw = first_bytes(spark, path, size)
        data, rest = b"", raw
        while rest:
            d = zlib.decompressobj(31)
            data += d.decompress(rest)
            rest = d.unused_data
        if data[:4] != b"BAM\x01":
            raise ValueError("not a BAM file")
        try:
            n = struct.unpack_from("<i", data, 4)[0]
            text, i = data[8 : 8 + n].rstrip(b"\0").decode(), 8 + n
            n_ref, i = struct.unpack_from("<i", data, i)[0], i + 4
            contigs = []
            for _ in range(n_ref):
                k = struct.unpack_from("<i", data, i)[0]
                length = struct.unpack_from("<i", data, i + 4 + k)[0]
                contigs.append((data[i + 4 : i + 3 + k].decode(), length))
                i += 8 + k
            return text.splitlines(), contigs
        except struct.error:
            if len(raw) < size:
                raise ValueError("a BAM file cut off in its header") from None
            size *= 8


def bam(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i32, i64, s = pa.int32(), pa.int64(), pa.string()
        types = [s, i32, i32, s, i64, i32, i32, s, s, i64, i64, s, s, pa.map_(s, s), i64]
        names = [x.split()[0] for x in READS.split(", ")]
        for b in batches:
            for content in b.column(0):
                rows: list[tuple] = []
                for r in bam_records(content.as_py()):
                    rows.append(r)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READS)


def sheet(content: bytes) -> list[list[str | None]]:
    """Cells of a workbook's first sheet as text; gaps are None."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if local(t) == "t"))
        first = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))[0]
        root = ElementTree.fromstring(z.read(first))
    rows = []
    for row in (e for e in root.iter() if local(e) == "row"):
        cells: dict[int, str | None] = {}
        for k, c in enumerate(e for e in row if local(e) == "c"):
            letters = re.match("[A-Z]+", c.get("r", ""))
            at = k
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            text = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
            cells[at] = shared[int(text)] if c.get("t") == "s" else ({"1": "true", "0": "false"}.get(text) if c.get("t") == "b" else text or None)
        rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return rows


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet as a table with ``_row``; its first row names the columns, types follow from all values."""
    content = spark.read.format("binaryFile").load(path).select("content").first()
    rows = sheet(content[0]) if content else []
    if not rows:
        return spark.createDataFrame([], "_row long")
    names = [x or f"column {i}" for i, x in enumerate(rows[0])]
    body = [(*[(r[i] if i < len(r) else None) for i in range(len(names))], k) for k, r in enumerate(rows[1:])]
    df = spark.createDataFrame(body, ", ".join(f"`c{i}` string" for i in range(len(names))) + ", _row long")
    n = df.agg(*(F.count(F.when(F.col(f"c{i}").isNotNull() & F.col(f"c{i}").try_cast(t).isNull(), 1)).alias(f"{t}{i}") for i in range(len(names)) for t in ("long", "double"))).first()
    kind = lambda i: "long" if not n[f"long{i}"] else "double" if not n[f"double{i}"] else "string"
    return df.select(*(F.col(f"c{i}").try_cast(kind(i)).alias(x) for i, x in enumerate(names)), "_row")
