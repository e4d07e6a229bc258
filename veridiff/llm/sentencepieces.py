"""SentencePiece encoding and decoding by a Viterbi search that shares prefixes.

The distinct marked words (units, see ``pieces``) of a block of texts are sorted, which lays them out as a depth-first walk
of their trie.  One stack of forward cells follows the walk: cell i holds the best way to end a piece at character i of the
current word.  Moving to the next word pops the stack to their common prefix and computes cells for the rest only.

* Unigram models: a cell keeps the highest score sum and the piece that ends there.
* BPE models: a cell keeps the one piece whose predecessor it *fits*; other paths weigh minus infinity (see ``pieces``).

Words met before are kept while there is room; when it runs out all are dropped and worked out again, so results do not
depend on it.  Blocks are bounded by characters, so memory does not grow with the input.

Nulls count as empty texts, which have no ids.  Repeated rows and other columns change nothing.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import small_batches, tidy
from .pieces import BPE, BYTE, MARK, Vocabulary

MAX_WORDS = 600_000
BLOCK_CHARS = 1 << 21


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.find, self.words = vocabulary, vocabulary.splitter.findall, {}
        v = vocabulary
        self.plain = [p if t != BYTE else None for p, t in zip(v.pieces, v.types)]
        self.byte_of = {i: b for b, i in enumerate(v.byte_ids)}
        self.penalty = min(s for s, t in zip(v.scores, v.types) if t == 1) - 10.0  # fixed value: the library's unknown penalty

    # -- forward cells -------------------------------------------------------------------------------------------------

    def _cell(self, word: str, i: int, cells: list) -> tuple[float, int, int]:
        """(score, length, piece) of the best piece that ends after i characters; piece -2: outside the vocabulary."""
        v, ids = self.v, self.v.ids
        if v.kind == BPE:
            for j in range(max(0, i - v.longest), i):
                piece = ids.get(word[j:i])
                if piece is not None and (cells[j][2] < 0 or v.fits(cells[j][2], piece)):
                    return 0.0, i - j, piece
            return 0.0, 1, -2
        best = None
        for j in range(max(0, i - v.longest), i):
            piece = ids.get(word[j:i])
            if piece is not None and (best is None or cells[j][0] + v.scores[piece] > best[0]):
                best = cells[j][0] + v.scores[piece], i - j, piece
        if word[i - 1] not in ids:
            s = cells[i - 1][0] + self.penalty
            if best is None or s > best[0]:
                best = s, 1, -2
        return best

    def _path(self, word: str, cells: list) -> list[int]:
        out, i = [], len(word)
        while i:
            _, n, piece = cells[i]
            out.append(piece if piece >= 0 else self.v.fallback(word[i - n : i]))
            i -= n
        flat: list[int] = []
        for x in reversed(out):
            if isinstance(x, tuple):
                if self.v.byte_ids or not flat or flat[-1] != self.v.unknown_id:
                    flat.extend(x)
            else:
                flat.append(x)
        return flat

    def learn(self, words: set[str]) -> None:
        """Encode the distinct units that are not kept yet, sharing prefixes."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > MAX_WORDS:
            self.words.clear()
            new = list(words)
        bare = {}
        if self.v.kind == BPE:
            for w in new:
                marks = len(w) - len(w.lstrip(MARK))
                bare[w] = w[marks - 1 :] if marks > 1 else w
        else:
            bare = {w: w for w in new}
        cells: list[tuple] = [(0.0, 0, -1)]
        last, done = "", {}
        for w in sorted(set(bare.values())):
            k, top = 0, min(len(w), len(last))
            while k < top and w[k] == last[k]:
                k += 1
            del cells[k + 1 :]
            for i in range(k + 1, len(w) + 1):
                cells.append(self._cell(w, i, cells))
            done[w] = self._path(w, cells)
            last = w
        for w, b in bare.items():
            ids = done[b]
            if len(w) != len(b):
                marks = len(w) - len(b) + 1
                alone = ids[0] == self.v.ids.get(MARK)
                ids = self.v.run(marks if alone else marks - 1) + ids[alone:]
            self.words[w] = array("I", ids).tobytes()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        units = [self.find(self.v.normalise(t)) for t in texts]
        self.learn(set().union(*units))
        get = self.words.__getitem__
        return [b"".join(map(get, u)) for u in units]

    # -- decoding ------------------------------------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text of ids; runs of byte pieces are joined before they are read as UTF-8."""
        nums = memoryview(ids).cast("I")
        parts = list(map(self.plain.__getitem__, nums))
        if None in parts:
            out, held = [], bytearray()
            for p, i in zip(parts, nums):
                if p is None:
                    held.append(self.byte_of[i])
                    continue
                if held:
                    out.append(held.decode("utf-8", "replace"))
                    held.clear()
                out.append(p)
            out.append(held.decode("utf-8", "replace"))
            parts = out
        text = "".join(parts).replace(MARK, " ")
        return text[1:] if self.v.add_prefix and text[:1] == " " else text


def _blocks(texts: Iterator[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(df: DataFrame, model_file: str, text: str = "text", id_col: str = "doc_id", ids: bool = True, check: bool = False) -> DataFrame:
    """id, n_ids, ids_crc32 and, as asked, ids (array<int>) and round_trip (decoding gives the text back)."""
    small_batches(df.sparkSession)
    with open(model_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(f.read()))
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = f"{id_col} {rows.schema['_id'].dataType.simpleString()}, n_ids long, ids_crc32 long" + ", ids array<int>" * ids + ", round_trip boolean" * check

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for b in batches:
            at = 0
            for texts in _blocks(t.as_py() for t in b.column(1)):
                enc = coder.encode_block(texts)
                cols = [b.column(0).slice(at, len(texts)), pa.array([len(e) // 4 for e in enc], pa.int64()), pa.array([zlib.crc32(e) for e in enc], pa.int64())]
                if ids:
                    cols.append(pa.array([memoryview(e).cast("I").tolist() for e in enc], pa.list_(pa.int32())))
                if check:
                    # a literal space mark reads back as a space, in the library too
                    cols.append(pa.array([coder.decode(e) == t.replace(MARK, " ") for e, t in zip(enc, texts)]))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``df`` with the decoded text of an id array in column ``out`` (replaced where it exists); null ids give null."""
    with open(model_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(Vocabulary.read(f.read()))

    @pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = Encoder(shared.value)
        for s in batches:
            yield s.map(lambda a: None if a is None else coder.decode(array("I", a).tobytes()))

    return df.withColumn(out, text_of(F.col(ids)))
