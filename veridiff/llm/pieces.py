"""Vocabularies of sentencepiece model files, and the lattice rules that make prefix-by-prefix encoding exact.

Two model kinds are read.  *Unigram*: the best path is the one with the highest sum of piece scores.  *BPE*: merges run by
score, leftmost first, and any adjacent pair merges whose joined text is a piece.  For BPE the result is also a path in the
lattice of pieces: the only one in which every two neighbours, joined and encoded on their own, stay the same two pieces.
So each prefix of a word has one last piece, found from earlier prefixes alone; :meth:`Vocabulary.fits` is that test.
Runs of the space mark are the exception (their pieces share one score, so order within a run decides); they merge after
everything else and are encoded apart, by :meth:`Vocabulary.run`.
"""

from __future__ import annotations

import heapq
import re
import struct
from dataclasses import dataclass, field

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the public model format
UNIGRAM, BPE = 1, 2  # fixed values: model types of the public model format


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + n]
            i += n


@dataclass
class Vocabulary:
    """What encoding needs of a model; small enough (about a megabyte for 32k pieces) to broadcast whole."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    add_prefix: bool
    byte_ids: list[int]
    unknown_id: int
    ids: dict[str, int] = field(default_factory=dict)
    prefixes: set[str] = field(default_factory=set)
    longest: int = 0
    _fits: dict = field(default_factory=dict)
    _runs: dict = field(default_factory=dict)

    @classmethod
    def read(cls, data: bytes) -> Vocabulary:
        pieces, scores, types, kind, prefix, rest = [], [], [], UNIGRAM, True, {}
        for n, v in _fields(data):
            if n == 1:
                p = dict(_fields(v))
                pieces.append(p.get(1, b"").decode("utf-8"))
                scores.append(struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0])
                types.append(p.get(3, NORMAL))
            elif n == 2:
                kind = dict(_fields(v)).get(3, UNIGRAM)
            elif n == 3:
                rest = dict(_fields(v))
                prefix = bool(rest.get(3, 1))
        if rest.get(2) or rest.get(4, 1) or USER in types or kind not in (UNIGRAM, BPE):
            raise ValueError("only models without a character map, blank removal or user pieces are supported")
        byte_ids = [0] * 256
        for i, (p, t) in enumerate(zip(pieces, types)):
            if t == BYTE:
                byte_ids[int(p[3:5], 16)] = i
        if BYTE not in types:
            byte_ids = []
        v = cls(pieces, scores, types, kind, prefix, byte_ids, types.index(UNKNOWN))
        v.ids = {p: i for i, (p, t) in enumerate(zip(pieces, types)) if t in (NORMAL, UNUSED)}
        if any(re.search(f"[^{MARK}]{MARK}|{MARK}{MARK}+[^{MARK}]", p) for p in v.ids):
            raise ValueError("pieces that hold a space mark after other text are not supported")
        v.longest = max(map(len, v.ids))
        words = [p for p in v.ids if not p.startswith(MARK * 2)] if kind == BPE else v.ids
        v.prefixes = {p[:k] for p in words for k in range(len(p) + 1)}
        return v

    # -- marked words ------------------------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if not text:
            return ""
        return (MARK if self.add_prefix else "") + text.replace(" ", MARK)

    @property
    def splitter(self):
        """A pattern of the units that no piece crosses: a run of marks with what follows; a line feed alone."""
        if any("\n" in p for p in self.ids):
            return re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        return re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")

    def fallback(self, char: str) -> tuple[int, ...]:
        """Ids of a character outside the vocabulary."""
        return tuple(self.byte_ids[b] for b in char.encode("utf-8")) if self.byte_ids else (self.unknown_id,)

    # -- merging, used only to compile the rules ----------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by plain merging."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best = at = None
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces stay as they are when their joined text is encoded alone."""
        key = left * 65536 * 16 + right
        out = self._fits.get(key)
        if out is None:
            a, b = self.pieces[left], self.pieces[right]
            out = self._fits[key] = self.merged(a + b) == [a, b]
            if len(self._fits) > 2_000_000:  # a memo, not a limit: dropped pairs are worked out again
                self._fits.clear()
        return out

    def run(self, n: int) -> list[int]:
        """Ids of n space marks."""
        if n not in self._runs:
            size, nxt, prev = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
            heap = [(-self.scores[self.ids[MARK * 2]], i, 2) for i in range(n - 1)] if MARK * 2 in self.ids else []
            heapq.heapify(heap)
            while heap:
                _, i, total = heapq.heappop(heap)
                j = nxt[i] if size[i] else n
                if not size[i] or j >= n or size[i] + size[j] != total:
                    continue
                size[i], size[j], nxt[i] = total, 0, nxt[j]
                if nxt[i] < n:
                    prev[nxt[i]] = i
                for a, b in ((prev[i], i), (i, nxt[i])):
                    if a >= 0 and b < n and (k := self.ids.get(MARK * (size[a] + size[b]))) is not None:
                        heapq.heappush(heap, (-self.scores[k], a, size[a] + size[b]))
            out = [self.ids.get(MARK * s) for s in size if s]
            mark = self.fallback(MARK)
            self._runs[n] = [t for x in out for t in ((x,) if x is not None else mark)]
        return self._runs[n]
