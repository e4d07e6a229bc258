"""bigWig tracks: chromosomes and the places of data sections from the header and index, sections decoded on the executors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Marks of the file, its chromosome tree and its index.
FILE, TREE, INDEX = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
RUNS = "chrom string, start long, end long, value double, size long"


def chromosomes(data: bytes, at: int, order: str) -> dict[int, tuple[str, int]]:
    """Number -> (name, size), from the tree at ``at``."""
    mark, _, key_size, _, _, _ = struct.unpack_from(order + "IIIIQQ", data, at)
    if mark != TREE:
        raise ValueError("a bigWig file without its chromosome tree")
    out: dict[int, tuple[str, int]] = {}
    todo = [at + 32]
    while todo:
        p = todo.pop()
        leaf, _, n = struct.unpack_from(order + "BBH", data, p)
        for k in range(n):
            q = p + 4 + k * (key_size + 8)
            if leaf:
                number, size = struct.unpack_from(order + "II", data, q + key_size)
                out[number] = data[q : q + key_size].rstrip(b"\0").decode(), size
            else:
                todo.append(struct.unpack_from(order + "Q", data, q + key_size)[0])
    return out


def sections(data: bytes, at: int, order: str) -> list[tuple[int, int]]:
    """(offset, size) of the data sections, from the index at ``at``."""
    if struct.unpack_from(order + "I", data, at)[0] != INDEX:
        raise ValueError("a bigWig file without its index")
    out, todo = [], [at + 48]
    while todo:
        p = todo.pop()
        leaf, _, n = struct.unpack_from(order + "BBH", data, p)
        for k in range(n):
            if leaf:
                out.append(struct.unpack_from(order + "QQ", data, p + 4 + 32 * k + 16))
            else:
                todo.append(struct.unpack_from(order + "Q", data, p + 4 + 24 * k + 16)[0])
    return sorted(out)


def section_runs(raw: bytes, order: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Chromosome number, starts, ends and values of a section: ranges, or starts with one span, or steps."""
    chrom, start, _, step, span, kind, _, n = struct.unpack_from(order + "IIIIIBBH", raw, 0)
    number, real = order + "u4", order + "f4"
    if kind == 1:
        rows = np.frombuffer(raw, [("s", number), ("e", number), ("v", real)], n, 24)
        return chrom, rows["s"].astype(np.int64), rows["e"].astype(np.int64), rows["v"].astype(float)
    if kind == 2:
        rows = np.frombuffer(raw, [("s", number), ("v", real)], n, 24)
        starts = rows["s"].astype(np.int64)
        return chrom, starts, starts + span, rows["v"].astype(float)
    starts = start + step * np.arange(n, dtype=np.int64)
    return chrom, starts, starts + span, np.frombuffer(raw, real, n, 24).astype(float)


def track_runs(data: bytes) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(chromosome, its size, starts, ends, values) section by section; chromosomes without data as empty arrays."""
    order = "<" if struct.unpack_from("<I", data, 0)[0] == FILE else ">"
    if struct.unpack_from(order + "I", data, 0)[0] != FILE:
        raise ValueError("not a bigWig file")
    tree, _, index = struct.unpack_from(order + "QQQ", data, 8)
    packed = struct.unpack_from(order + "I", data, 52)[0] > 0
    names = chromosomes(data, tree, order)
    for offset, size in sections(data, index, order):
        raw = data[offset : offset + size]
        number, *arrays = section_runs(zlib.decompress(raw) if packed else raw, order)
        yield *names[number], *arrays


def bigwig(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a track with the sizes that the file states; one file a task, one section in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                for name, size, starts, ends, values in track_runs(content.as_buffer().to_pybytes()):
                    n = len(starts)
                    cols = [pa.array([name] * n, pa.string()), pa.array(starts), pa.array(ends), pa.array(values), pa.array([size] * n, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["chrom", "start", "end", "value", "size"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RUNS)
