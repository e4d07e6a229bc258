"""Token counts without tokenizing: a vocabulary compiled into a deterministic transducer.

:class:`Transducer` reads characters.  Its state is what later characters can still depend on: the longest suffix that may
yet grow into a piece, with the last piece and the number of tokens, relative to now, at each prefix inside that suffix.
Each transition carries the change in the number of emitted tokens (negative where a longer piece replaces several).
States and transitions are built when first met and dropped together when ``MAX_STATES`` is reached; that bounds memory and
changes no result.

Every text is cut into chunks of ``CHUNK`` characters.  The map of a chunk is (head, body, exit): the characters before its first *reset* (a place that
no piece crosses, where every state becomes the start state), the tokens between its first and last reset, and the state
with its count after the last one.  :func:`compose` joins the maps of neighbours and is associative, so :func:`scan` may
combine them in any tree order.  Inside a chunk a unit between two resets has the same count wherever it stands; the
transducer's result for it is kept while there is room.

Nulls and empty texts have no tokens; other columns are ignored; repeated rows are counted each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy
from .pieces import BPE, MARK, Vocabulary

MAX_STATES = 150_000
MAX_WORDS = 1_000_000
CHUNK = 1 << 12


class Transducer:
    """Counts the tokens of one unit (see :attr:`Vocabulary.splitter`) in one pass over its characters."""

    def __init__(self, vocabulary: Vocabulary):
        if vocabulary.kind != BPE:
            raise ValueError("token counts are compiled from BPE models")
        self.v = vocabulary
        self._reset()

    def _reset(self) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.keys: list[tuple] = [("", (-1,), (0,))]
        self.index = {self.keys[0]: 0}

    def _arc(self, state: int, char: str) -> tuple[int, int]:
        """Build one transition. Pieces are -1 at a start and -2 for a character outside the vocabulary."""
        v = self.v
        suffix, lasts, counts = self.keys[state]
        if char not in v.ids:
            out = (0, len(v.fallback(char)))
        else:
            grown = suffix + char
            for j in range(len(grown)):
                piece = v.ids.get(grown[j:])
                if piece is not None and (lasts[j] < 0 or v.fits(lasts[j], piece)):
                    break
            delta = counts[j] + 1
            keep = 0
            while grown[keep:] not in v.prefixes:
                keep += 1
            key = (grown[keep:], (*lasts[keep:], piece), tuple(c - delta for c in (*counts[keep:], delta)))
            to = self.index.get(key)
            if to is None:
                to = self.index[key] = len(self.keys)
                self.keys.append(key)
                self.arcs.append({})
            out = (to, delta)
        self.arcs[state][char] = out
        return out

    def step(self, state: int, text: str) -> tuple[int, int]:
        """(state, tokens emitted) after ``text``."""
        arcs, total = self.arcs, 0
        for c in text:
            arc = arcs[state].get(c)
            if arc is None:
                arc = self._arc(state, c)
            state, d = arc
            total += d
        return state, total

    def unit(self, unit: str) -> int:
        """Tokens of a unit: a run of marks, if longer than one, merges after the rest of it (see pieces)."""
        if len(self.keys) > MAX_STATES:
            self._reset()
        marks = len(unit) - len(unit.lstrip(MARK))
        if marks < 2:
            return self.step(0, unit)[1]
        word = unit[marks - 1 :]
        state, n = self.step(0, word)
        free = marks if self._mark_alone(word) else marks - 1
        return n - (free == marks) + len(self.v.run(free))

    def _mark_alone(self, word: str) -> bool:
        """Whether the leading mark of a word stays a token of its own."""
        v = self.v
        lasts = [-1]
        for i in range(1, len(word) + 1):
            if word[i - 1] not in v.ids:
                break
            for j in range(max(0, i - v.longest), i):
                piece = v.ids.get(word[j:i])
                if piece is not None and (lasts[j] < 0 or v.fits(lasts[j], piece)):
                    break
            lasts.append(piece)
        i = len(lasts) - 1
        while i > 1:
            i -= len(v.pieces[lasts[i]])
        return i == 1


class Counter(dict):
    """Unit -> tokens: the state maps of whole units, kept while there is room."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.machine, self.find = vocabulary, Transducer(vocabulary), vocabulary.splitter.findall

    def __missing__(self, unit: str) -> int:
        n = self.machine.unit(unit)
        if len(unit) <= 64:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[unit] = n
        return n

    # A chunk map is (head, None, "") without a reset in the chunk, else (head, tokens of the body, open unit).

    def chunk_map(self, chunk: str) -> tuple[str, int | None, str]:
        units = self.find(chunk)
        if len(units) < 2:
            return chunk, None, ""
        return units[0], sum(map(self.__getitem__, units[1:-1])), units[-1]

    def compose(self, a, b):
        """The map of two neighbouring chunks."""
        if b[1] is None:
            if a[1] is None:
                return self.chunk_map(a[0] + b[0])
            middle = self.find(a[2] + b[0])
            return a if not middle else (a[0], a[1] + sum(map(self.__getitem__, middle[:-1])), middle[-1])
        if a[1] is None:
            middle = self.find(a[0] + b[0])
            return middle[0], sum(map(self.__getitem__, middle[1:])) + b[1], b[2]
        return a[0], a[1] + sum(map(self.__getitem__, self.find(a[2] + b[0]))) + b[1], b[2]

    def close(self, m) -> int:
        """Tokens of a whole text whose map is ``m``."""
        if m[1] is None:
            return sum(map(self.__getitem__, self.find(m[0])))
        return self[m[0]] + m[1] + self[m[2]]

    def scan(self, maps: list) -> tuple:
        """Combine neighbours pairwise until one map is left."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        text = self.v.normalise(text)
        return self.close(self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, max(1, len(text)), chunk)]))


def token_counts(df: DataFrame, model_file: str, text: str = "text", id_col: str = "doc_id", limit: int = 4096) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = df.sparkSession
    small_batches(spark)
    with open(model_file, "rb") as f:
        shared = spark.sparkContext.broadcast(Vocabulary.read(f.read()))
    rows = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = f"{id_col} {rows.schema['_id'].dataType.simpleString()}, n_bytes long, n_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        counter = Counter(shared.value)
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(b.column(1)), pa.int64()), pa.array(n, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return rows.mapInArrow(tidy(run), schema).withColumn("over_limit", F.col("n_tokens") > limit)
