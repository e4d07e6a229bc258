"""Packing of tokenized documents into as few fixed-length sequences as possible.

1. *Tokens.* Texts are cut at ASCII blanks, which no token of a word-level BPE crosses; distinct units are encoded by the
   tokenizers library once per worker block and joined (whole texts for other kinds of tokenizers).  Documents longer than the capacity are cut into pieces.
2. *Best fit decreasing* runs inside hash partitions of bounded size.
3. *Certificate.* Dual-feasible functions over a partition's length histogram give a lower bound on its sequences; a
   partition that meets it is certified and done.  The same bound over the histogram of all pieces (at most ``capacity``
   rows) certifies the whole set.
4. *Exchange.* While the bound of the whole set is not met, partitions with a gap, and those certified only because their
   own lengths match badly, keep their full sequences and release the documents of all others; partitions whose free space
   is less than a sequence release the emptiest one, which is what their bound rounded up.  Released documents meet in
   fewer, mixed partitions and are packed again, best fit decreasing.  Rounds end when that bound is met, the rest fits into
   one partition, or a round saved nothing; there is no other limit.

Null texts count as empty: they hold the closing id alone.  Rows that repeat are packed each.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, settle, small_batches, tidy, union_all

MAX_UNITS = 300_000
BLOCK_CHARS = 1 << 19
GROUP = 8192


# -- tokens ------------------------------------------------------------------------------------------------------------


class UnitEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, unit by unit; kept units are dropped together when full.

    Files with the usual word-level pattern (contractions, letters, single digits, other signs) and lower-casing part texts
    at ASCII blanks, so units are what lies between these; texts of Latin-1 letters and ASCII signs are lower-cased and cut
    by that pattern itself, as their words repeat far more often, and many of them are encoded in one call.  With any other
    tokenizer file whole texts are encoded.
    """

    #: The split pattern and normalizers that the fast path restates.
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

    def __init__(self, tokenizer_file: str):
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.find = re.compile("[^ \t\n\r]+").findall
        self.kept: dict[str, bytes] = {}
        self.special = list(self.tokenizer.get_added_tokens_decoder().items())
        with open(tokenizer_file) as f:
            spec = json.load(f)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        self.ends = None
        if (spec.get("normalizer") or {}).get("normalizers") == self.NORMALIZERS and split.get("pattern") == {"Regex": self.PATTERN} and spec["model"].get("end_of_word_suffix") == "</w>":
            words = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(words.values()) + 1, bool)
            self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
            self.odd = re.compile("[^ -~\t\n\rÀ-ÖØ-öø-ÿ]").search
            self.words = re.compile("[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+").findall

    def _units(self, text: str) -> list[str]:
        if self.odd(text) or any(t.content[:2] in text for _, t in self.special):
            return self.find(text)
        return self.words(text.lower())

    def _learn(self, units: list[str]) -> None:
        """Encode units many at a time: pure words are parted by their end-of-word ids, others by a special token."""
        words = [u for u in units if u.isalpha() and max(u) <= "ÿ"]
        for i in range(0, len(words), 1000):
            group = words[i : i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw = ids.tobytes()
            assert len(cuts) == len(group)
            self.kept.update(zip(group, map(raw.__getitem__, map(slice, [0, *cuts[:-1].tolist()], cuts.tolist()))))
        units = list(set(units).difference(words))
        if self.special:
            sep, mark = self.special[0][0], self.special[0][1].content
            odd = [u for u in units if any(t.content[0] in u for _, t in self.special)]
            units = list(set(units).difference(odd))
            groups = [units[i : i + 1000] for i in range(0, len(units), 1000)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cuts = np.flatnonzero(ids == sep) * 4
                raw = ids.tobytes()
                self.kept.update(zip(group, map(raw.__getitem__, map(slice, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(raw)]))))
            units = odd
        for u, e in zip(units, self.tokenizer.encode_batch_fast(units, add_special_tokens=False)):
            self.kept[u] = np.array(e.ids, "<u4").tobytes()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        if self.ends is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        units = [self._units(t) for t in texts]
        new = list(set().union(*units).difference(self.kept))
        if len(self.kept) + len(new) > MAX_UNITS:
            self.kept.clear()
            new = list(set().union(*units))
        self._learn(new)
        get = self.kept.__getitem__
        return [b"".join(map(get, u)) for u in units]


def token_pieces(df: DataFrame, tokenizer_file: str, capacity: int, end_id: int, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids when asked) of every piece of every row."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = f"{id_col} {rows.schema['_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = UnitEncoder(tokenizer_file)
        for b in batches:
            ids_of, at = b.column(0), 0
            while at < len(ids_of):
                texts, size, first = [], 0, at
                while at < len(ids_of) and size < BLOCK_CHARS:
                    texts.append(b.column(1)[at].as_py())
                    size += len(texts[-1])
                    at += 1
                out: list[list] = [[] for _ in names]
                for row, e in enumerate(coder.encode_block(texts)):
                    e += end
                    for k, i in enumerate(range(0, len(e), 4 * capacity)):
                        cut = e[i : i + 4 * capacity]
                        values = [first + row, k, i // 4, len(cut) // 4, zlib.crc32(cut)]
                        if with_ids:
                            values.append(memoryview(cut).cast("I").tolist())
                        for col, x in zip(out, values):
                            col.append(x)
                types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([ids_of.take(pa.array(out[0], pa.int64())), *(pa.array(x, t) for x, t in zip(out[1:], types[1:]))], names)

    return rows.mapInArrow(tidy(run), schema)


# -- bounds and packing --------------------------------------------------------------------------------------------------


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences needed at least, by dual-feasible functions; counts[x] pieces have length x, x from 0 to capacity."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * x)])
    # u(lam): lengths over capacity-lam count whole, those under lam count nothing
    lam = np.arange(1, capacity // 2 + 1)
    whole = n[-1] - n[capacity - lam + 1]
    middle = s[capacity - lam + 1] - s[lam]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    # v(k): lengths are rounded down to multiples of capacity/(k+1), measured in capacity/k
    for k in range(1, 64):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        units = np.where(exact, k * x, scaled // capacity * capacity)  # in 1/(k*capacity) of a sequence
        best = max(best, -(-int((counts * units).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each length, and the space left in each bin.

    Bins are filed by the space they have left; a bit set of non-empty files gives the tightest one in one shift.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    files: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, open_bits = [], 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        over = open_bits >> n
        if over:
            left = n + (over & -over).bit_length() - 1
            b = files[left].pop()
            if not files[left]:
                open_bits &= ~(1 << left)
        else:
            b, left = len(free), capacity
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - left
        left -= n
        free[b] = left
        if left:
            files[left].append(b)
            open_bits |= 1 << left
    return bins, offsets, free


def pack(pieces: DataFrame, capacity: int, key: list[str], group: int = GROUP) -> DataFrame:
    """``pieces`` (with a ``length`` from 1 to capacity) with sequence_id, offset and certified: whether the partition that
    packed the sequence last met its bound, or all sequences together met that of all pieces."""
    pieces = settle(pieces, "pieces")
    hist = pieces.groupBy("length").count().toPandas()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    counts[hist["length"].to_numpy(np.int64)] = hist["count"].to_numpy(np.int64)
    bound = lower_bound(counts, capacity)
    frozen, rest = int(counts[capacity]), int(counts[:capacity].sum())
    sure = F.lit(True).alias("certified")
    done = [pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "certified": sure})]
    schema = pieces.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long, _gap boolean, _loose boolean"
    todo = pieces.where(F.col("length") < capacity)
    best, r = None, 0

    # pack_group numbers sequences as round (from 1), group, bin within it; full pieces stand in round 0
    while rest:
        r += 1
        groups = -(-rest // group)

        def pack_group(k: tuple, rows: pa.Table) -> pa.Table:  # runs before r changes: each round is written
            g = k[0].as_py()
            lengths = rows["length"].to_numpy()
            bins, offsets, free = best_fit_decreasing(lengths, capacity)
            gap = len(free) > lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            left = np.array(free)
            release = left > 0
            if not gap and left.sum() < capacity:  # as full as it can be: only what the bound rounded up
                release &= np.arange(len(left)) == left.argmax()
            out = rows.drop_columns("_g").append_column("sequence_id", pa.array((r << 58) + (g << 20) + bins)).append_column("offset", pa.array(offsets))
            return out.append_column("_gap", pa.array(np.full(len(bins), gap))).append_column("_loose", pa.array(release[bins]))

        salted = todo.withColumn("_g", F.pmod(F.xxhash64(F.lit(r), *key), F.lit(groups)))
        out = settle(salted.groupBy("_g").applyInArrow(pack_group, schema), f"packed{r}")
        size = {x["_loose"]: x for x in out.groupBy("_loose").agg(F.sum(F.expr("if(offset = 0, 1, 0)")).alias("bins"), F.count("*").alias("n")).collect()}
        tight, loose = (size[k]["bins"] if k in size else 0 for k in (False, True))
        met = frozen + tight + loose <= bound
        if met or not loose or groups == 1 or best is not None and frozen + tight + loose >= best:
            done.append(out.withColumn("certified", F.lit(met) | ~F.col("_gap")).drop("_gap", "_loose"))
            break
        best = frozen + tight + loose
        frozen, rest = frozen + tight, size[True]["n"]
        done.append(out.where("not _loose").withColumn("certified", sure).drop("_gap", "_loose"))
        todo = out.where("_loose").select(pieces.columns)
    release(pieces.sparkSession)
    return union_all(done)


def best_fit_packing(df: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 1, text: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, certified (and ids when asked)."""
    pieces = token_pieces(df, tokenizer_file, capacity, end_id, text, id_col, with_ids)
    return pack(pieces, capacity, [id_col, "piece", "start", "ids_crc32"])
