"""N-gram Jaccard self-join of texts, reported as connected components.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence as one; none: empty, linked with nothing),
held as 64-bit hashes.  Two documents link when |A and B| / |A or B| >= threshold.

*Count vectors.*  Shingles fall into groups by hash; the group counts of a set are a point.  The sum over coordinates of the
smaller count bounds the overlap of two sets, and J >= t needs an overlap of t/(1+t) of both sizes.  A set of n shingles has
``GROUPS`` groups, doubled until a group holds about ``FILL`` of them, for the bound of unrelated sets nears their size as
groups fill up; the groups of a finer vector nest in those of a coarser one, so two vectors compare on the coarser.
:class:`CountTree` is an R-tree of such points, packed by size; a node holds the largest count of each coordinate and the
smallest size below it, so the same sum bounds the overlap with everything in the node.

*Distribution.*

1. Frequent shingles are counted over all documents (sums of local counts; the most frequent ``HEAVY`` are broadcast).  They
   only set an order, rarest first; any order gives the same links.
2. Each batch of rows is indexed in an R-tree and joined with itself; its components become *nodes*.  Equal sets of several
   batches go on once.
3. Sets meet where prefixes meet: sets that link share one of their first n - ceil(t n) + 1 shingles in the order of 1, and
   at the first one that they share, what is left of each set from there on bounds their overlap.  The sets that share a
   shingle are a *cell*; its first set is the one with the greatest part left.  In a cell of more than ``CELL`` sets only
   pairs with the first one are tried at once.  A shingle of more than ``SALT_ROWS`` documents is dealt over several keys.
4. Pairs whose points can't overlap enough are dropped; of the rest the most promising pair of each set is compared exactly.
   Near copies share much of each other but most of their centre, so these links connect a group.
5. What the components of these links leave apart goes on: the other pairs; in large cells one set of each component
   against the cell's centre; then every set for which another component of its cell holds a set of fitting size and
   remainder.  These meet in blocks, each searched through a tree of points, and survivors are compared exactly.
6. Components of all links, by rewiring on the executors.

Nothing is capped or sampled.  Defined results: null or blank texts have n_shingles 0 and are their own component; rows that
repeat a doc_id are one document for reachability; rows with a null doc_id take no part and get a null component_id; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, merge_components, regrouped, release, settle, small_batches, tidy
from .exact_dedup import screen

WORDS = 5
GROUPS = 64
FILL = 3
HEAVY = 1 << 18
LOCAL = 2
CELL = 32
SALT_ROWS = 1 << 13
RECENT = 100_000
BLOCK_ROWS = 1024
FAN = 32
BITS = 1 << 27
BLOCK = 1 << 19

# -- shingles ------------------------------------------------------------------------------------------------------------

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)  # odd multipliers


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _P)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    one = np.ones(n, np.uint64)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = _P, inverse
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts of a block are hashed together."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        first, size = at, 0
        while at < len(texts) and (size == 0 or size + len(texts[at]) < BLOCK):
            size += len(texts[at]) + 1
            at += 1
        out += _block_sets(texts[first:at])
    return out


def _block_sets(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    n = max(BLOCK + 1, 1 << (len(data) + 1).bit_length())
    up, down = _powers(n)
    blank = _BLANK[data]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)])
    edge = np.diff(np.concatenate([[True], blank]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    bounds = np.searchsorted(starts, offsets)
    # each word times a power, summed over a window of WORDS words
    padded = np.concatenate([word, np.zeros(WORDS, np.uint64)])
    power, window = np.uint64(1), np.zeros(len(word), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            window += padded[k : k + len(word)] * power
            power = power * _Q
    window = _mix(window)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(window[a : b - WORDS + 1]))
        elif b > a:
            h, power = np.zeros(1, np.uint64), np.uint64(1)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    h += w * power
                    power = power * _Q
            out.append(_mix(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def count_vector(s: np.ndarray) -> np.ndarray:
    """Group counts of a set; their number is a power of two that grows with the set."""
    groups = groups_for(len(s), FILL)
    return np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.intp), minlength=groups).astype(np.uint32)


def groups_for(n: int, fill: int) -> int:
    """The smallest power of two, at least ``GROUPS``, whose groups hold at most ``fill`` of n shingles on average."""
    return max(GROUPS, 1 << (-(-n // fill) - 1).bit_length()) if n > fill else GROUPS


def packed(v: np.ndarray) -> bytes:
    """Counts as 16-bit numbers: hashed groups of a few shingles never come near that limit, and the test makes sure."""
    if v.max(initial=0) > 65535:
        raise OverflowError("a group of more than 65535 shingles")
    return v.astype("<u2").tobytes()


def unpacked(b) -> np.ndarray:
    return np.frombuffer(b, "<u2").astype(np.uint32)


def fold(v: np.ndarray, groups: int) -> np.ndarray:
    return v.reshape(groups, -1).sum(1, dtype=np.uint32) if len(v) > groups else v


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    return int(np.minimum(fold(a, n), fold(b, n)).sum(dtype=np.int64))


class Jaccard:
    """The threshold as a ratio of whole numbers, so that every test is exact."""

    def __init__(self, num: int = 4, den: int = 5):
        self.num, self.den = num, den

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = (a, b) if len(a) < len(b) else (b, a)
        if self.den * len(small) < self.num * len(large) or not len(small):
            return False
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        both = int((large[at] == small).sum())
        return self.den * both >= self.num * (len(a) + len(b) - both)

    def enough(self, overlap, sizes):
        """Whether an overlap may be enough for sets of these sizes together."""
        return (self.num + self.den) * overlap >= self.num * sizes

    def prefix(self, n: int) -> int:
        return n - -(-n * self.num // self.den) + 1


# -- the tree ------------------------------------------------------------------------------------------------------------


class CountTree:
    """R-tree over count vectors of sets, or of boxes of sets with sizes from ``least`` to ``most``.

    Entries are sorted by size, then by their heaviest coordinate; leaves have ``FAN`` entries.
    """

    def __init__(self, vectors: np.ndarray, least: np.ndarray, most: np.ndarray, rule: Jaccard):
        self.rule = rule
        slab = np.log2(np.maximum(least, 1)) * 8
        self.order = np.lexsort((least, vectors.argmax(1), slab.astype(int))) if len(least) else np.zeros(0, int)
        self.points, self.least, self.most = vectors[self.order], least[self.order], most[self.order]
        cuts = np.arange(0, len(least), FAN)
        self.cuts = np.append(cuts, len(least))
        if len(least):
            self.top = np.maximum.reduceat(self.points, cuts, 0)
            self.top_least, self.top_most = np.minimum.reduceat(self.least, cuts), np.maximum.reduceat(self.most, cuts)

    def search(self, vector: np.ndarray, least: int, most: int) -> np.ndarray:
        """Entries that may hold a set linked with one of the given box, best bound first."""
        r = self.rule
        if not len(self.order):
            return self.order
        nodes = np.flatnonzero((r.den * self.top_most >= r.num * least) & (r.num * self.top_least <= r.den * most))
        if len(nodes):
            nodes = nodes[r.enough(np.minimum(self.top[nodes], vector).sum(1, dtype=np.int64), self.top_least[nodes] + least)]
        if not len(nodes):
            return nodes
        rows = np.concatenate([np.arange(self.cuts[k], self.cuts[k + 1]) for k in nodes.tolist()])
        bound = np.minimum(self.points[rows], vector).sum(1, dtype=np.int64)
        ok = r.enough(bound, self.least[rows] + least) & (r.den * self.most[rows] >= r.num * least) & (r.num * self.least[rows] <= r.den * most)
        rows, bound = rows[ok], bound[ok]
        return self.order[rows[np.argsort(-bound, kind="stable")]]


class Sets:
    """Disjoint sets of 0..n-1 with the smaller index as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def local_components(sets: list[np.ndarray], vectors: list[np.ndarray], rule: Jaccard) -> Sets:
    """Self-join of distinct non-empty sets; pairs that are connected already are not compared."""
    sizes = np.array([len(s) for s in sets], np.int64)
    coarse = np.array([fold(v, GROUPS) for v in vectors], np.uint32).reshape(-1, GROUPS)
    tree, joined = CountTree(coarse, sizes, sizes, rule), Sets(len(sets))
    for i in range(len(sets)):
        found = tree.search(coarse[i], int(sizes[i]), int(sizes[i]))
        if len(found) > 1:
            for j in found.tolist():
                if j == i or joined.root(i) == joined.root(j):
                    continue
                if min(len(vectors[i]), len(vectors[j])) > GROUPS and not rule.enough(overlap_bound(vectors[i], vectors[j]), int(sizes[i] + sizes[j])):
                    continue
                if rule.links(sets[i], sets[j]):
                    joined.join(i, j)
    return joined


# -- distributed join ----------------------------------------------------------------------------------------------------


def _heavy(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts, by shingle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in regrouped(batches, 3_000, 8 << 20):
            sets = shingle_sets([t.as_buffer().to_pybytes() for t in b.column(0)])
            if sets:
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                h, n = h[n >= LOCAL], n[n >= LOCAL]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    top = texts.mapInArrow(tidy(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    h, n = h[order], n[order]
    del top
    release(texts.sparkSession)
    return h, n


def _nodes(rows: DataFrame, heavy, salted: np.ndarray, rule: Jaccard) -> DataFrame:
    """Per row: id, n, node; on the first row of each distinct set of a batch also vec, digest and its routes, the keys of its
    prefix in the common order."""
    shared = rows.sparkSession.sparkContext.broadcast((*heavy, salted))
    schema = "id long, n long, node long, vec binary, digest binary, routes array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, salted = shared.value
        for b in regrouped(batches, 4_000, 12 << 20):
            ids = b.column(0).to_pylist()
            sets = shingle_sets([t.as_buffer().to_pybytes() for t in b.column(1)])
            first: dict[bytes, int] = {}
            kind = [-1] * len(ids)  # index of the row's distinct set
            names: list[int] = []  # smallest id with it
            distinct: list[np.ndarray] = []
            for i, (key, s) in enumerate(zip(ids, sets)):
                if key is None or not len(s):
                    continue
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                k = first.setdefault(d, len(distinct))
                if k == len(distinct):
                    distinct.append(s)
                    names.append(key)
                names[k] = min(names[k], key)
                kind[i] = k
            digests = list(first)
            vectors = [count_vector(s) for s in distinct]
            joined = local_components(distinct, vectors, rule)
            name: dict[int, int] = {}
            for k, key in enumerate(names):
                r = joined.root(k)
                name[r] = min(name.get(r, key), key)
            routes = []
            for key, s in zip(names, distinct):
                n = np.zeros(len(s), np.int64)
                if len(tokens):
                    at = np.searchsorted(tokens, s)
                    at[at == len(tokens)] = 0
                    n = np.where(tokens[at] == s, counts[at], 0)
                routes.append(_deal(s[np.argsort(n, kind="stable")[: rule.prefix(len(s))]], key, salted).view(np.int64))
            done: set[int] = set()
            cols: list[list] = [[] for _ in range(6)]
            for key, s, k in zip(ids, sets, kind):
                row = [key, len(s), key, None, None, None]
                if k >= 0:
                    row[2] = name[joined.root(k)]
                    if k not in done and key == names[k]:
                        done.add(k)
                        row[3:] = packed(vectors[k]), digests[k], routes[k]
                for c, x in zip(cols, row):
                    c.append(x)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(tidy(run), schema)


def _salted(heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of more than ``SALT_ROWS`` documents, and over how many keys each is dealt; then all those keys and their tokens."""
    h, n = heavy
    h, n = h[n > SALT_ROWS], n[n > SALT_ROWS]
    parts = (-(-n // SALT_ROWS)).astype(np.uint64)
    whole = np.repeat(h, parts.astype(np.int64))
    part = np.arange(len(whole), dtype=np.uint64) - np.repeat(np.cumsum(parts) - parts, parts.astype(np.int64))
    keys = _mix(whole + part * _P)
    order = np.argsort(keys)
    return np.stack([h, parts]), keys[order], whole[order]


def _deal(prefix: np.ndarray, name: int, salted: np.ndarray) -> np.ndarray:
    """The keys of a prefix: tokens, but for salted ones the key of the part that this set falls in."""
    h, parts = salted
    if not len(h):
        return prefix
    at = np.searchsorted(h, prefix)
    at[at == len(h)] = 0
    hit = h[at] == prefix
    out = prefix.copy()
    part = _mix(np.full(1, name, np.int64).view(np.uint64)) % parts[at[hit]]
    out[hit] = _mix(prefix[hit] + part * _P)
    return out


def _cells(rule: Jaccard, salted: np.ndarray, whole: np.ndarray):
    """Rows (token, id, node, n, left), sorted by token and the share left: pairs that may link, and rows of large cells.

    ``left`` is how much of a set stands at and behind the token in the common order, so at the first token that two sets
    share the lesser of both bounds their overlap.  Rows of salted keys always go on, under their whole token.
    """
    salted, whole = salted.view(np.int64), whole.view(np.int64)
    order = np.argsort(salted)
    salted, whole = salted[order], whole[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, both = rule.num, rule.num + rule.den
        token, held, count, recent = None, [], 0, set()
        for b in batches:
            t = b.column(0).to_numpy()
            # a token met once in the middle of a batch has no partner
            lone = np.ones(len(t), bool)
            lone[0] = lone[-1] = False
            lone[1:] &= t[1:] != t[:-1]
            lone[:-1] &= t[1:] != t[:-1]
            parts = np.full(len(t), -1)
            if len(salted):
                at = np.searchsorted(salted, t)
                at[at == len(salted)] = 0
                parts = np.where(salted[at] == t, at, -1)
            lone &= parts < 0
            out: list[list] = [[], [], [], [], []]

            def send(*row) -> None:
                for c, v in zip(out, row):
                    c.append(v)

            for t, x, node, n, left, part in zip(*(c.to_numpy()[~lone].tolist() for c in b.columns), parts[~lone].tolist()):
                if t != token:
                    token, held, count = t, [], 0
                for y, other, m, rest in held if count <= CELL else held[:1]:
                    if other != node and both * min(left, rest) >= num * (n + m) and (pair := (min(x, y), max(x, y))) not in recent:
                        recent.add(pair)
                        send(*pair, None, None, None)
                count += 1
                if part >= 0:
                    send(int(whole[part]), x, node, n, left)
                elif count == CELL + 1:
                    for r in held:
                        send(t, *r)
                    send(t, x, node, n, left)
                elif count > CELL:
                    send(t, x, node, n, left)
                if count <= CELL:
                    held.append((x, node, n, left))
                if len(recent) > RECENT:
                    recent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b", "node", "n", "left"])

    return run


def _block_join(rule: Jaccard):
    """Pairs of rows of two blocks of a large cell that lie in different components and may link."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, first = np.unique(rows["id"].to_numpy(), return_index=True)
        vectors = [unpacked(rows["vec"][i].as_py()) for i in first.tolist()]
        coarse = np.array([fold(v, GROUPS) for v in vectors], np.uint32).reshape(-1, GROUPS)
        n, left, comp, block = (rows[c].to_numpy()[first] for c in ("n", "left", "comp", "block"))
        tree = CountTree(coarse, n, n, rule)
        a, b = [], []
        for i in range(len(ids)):
            found = tree.search(coarse[i], int(n[i]), int(n[i]))
            found = found[(ids[found] > ids[i]) & (comp[found] != comp[i])]
            found = found[rule.enough(np.minimum(left[found], left[i]), n[found] + n[i])]
            if key[1].as_py() != key[2].as_py():
                found = found[block[found] != block[i]]
            for j in found.tolist():
                if min(len(vectors[i]), len(vectors[j])) == GROUPS or rule.enough(overlap_bound(vectors[i], vectors[j]), int(n[i] + n[j])):
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _with_bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, node_a, node_b, sizes, vec_a, vec_b): the points give way to an upper bound of the sets' overlap."""
    for b in batches:
        x, y = b.column(5).to_pylist(), b.column(6).to_pylist()
        bounds = [overlap_bound(unpacked(i), unpacked(j)) for i, j in zip(x, y)]
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bounds, pa.int64())], [*b.schema.names[:5], "bound"])


def _screen(ids: DataFrame, n: int):
    """A test of arrays of ids that passes all of ``ids``, at most n, and few others: a bit map, 16 bits an id, 16 MB at most.

    It only spares rows a shuffle; the join that follows decides.
    """
    bits = min(BITS, 1 << max(20, (16 * n).bit_length()))
    bit = F.pmod(F.xxhash64("id"), F.lit(bits))
    maps = ids.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("k")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("m")).toLocalIterator()
    flags = np.zeros(bits // 8, np.uint8)
    for r in maps:
        m = np.frombuffer(r["m"], np.uint8)
        flags[r["k"] * 4096 : r["k"] * 4096 + len(m)] = m
    shared = ids.sparkSession.sparkContext.broadcast(flags)

    def keep(b: pa.RecordBatch) -> pa.RecordBatch:
        """The rows of a batch whose last column, their bit, is on."""
        at = b.column(b.num_columns - 1).to_numpy()
        return b.filter(pa.array((shared.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    return bit, keep


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))


def _points_of(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The points that may occur in settled ``pairs``."""
    bit, keep = _screen(_ends(pairs), 2 * pairs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(keep(b).columns[:-1], b.schema.names[:-1])

    return points.select("*", bit.alias("bit")).mapInArrow(run, points.schema)


def _sets_of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, set) of the documents of settled ``pairs`` (and of a few others)."""
    bit, keep = _screen(_ends(pairs), 2 * pairs.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = keep(b)
            sets = shingle_sets([t.as_buffer().to_pybytes() for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    return rows.where("id is not null").select("id", "text", bit.alias("bit")).mapInArrow(tidy(run), "id long, set binary")


def _verified(rows: DataFrame, pairs: DataFrame, rule: Jaccard, name: str) -> DataFrame:
    """``pairs`` (a, b and others) whose documents link."""
    sets = settle(_sets_of(rows, pairs).join(_ends(pairs).distinct(), "id", "left_semi"), name)
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    keep = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(b.schema.get_field_index("sa")), b.column(b.schema.get_field_index("sb"))
            ok = [rule.links(np.frombuffer(i.as_buffer(), np.uint64), np.frombuffer(j.as_buffer(), np.uint64)) for i, j in zip(x, y)]
            yield b.filter(pa.array(ok, pa.bool_())).select(keep)

    return both.select(*keep, "sa", "sb").mapInArrow(tidy(run), pairs.schema)


def similar_components(df: DataFrame, text: str = "text", id_col: str = "doc_id", num: int = 4, den: int = 5) -> DataFrame:
    """One row per row of ``df``: id, n_shingles, component_id (smallest id reachable by links of J >= num/den)."""
    rule = Jaccard(num, den)
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    heavy = _heavy(rows.select("text"))
    parts, keys, tokens = _salted(heavy)
    nodes = settle(_nodes(rows, heavy, parts, rule), "nodes")
    # equal sets of different batches go on once
    equal = nodes.where("vec is not null").groupBy("digest").agg(F.min("id").alias("b"), F.max("id").alias("hi")).where("b <> hi").select("digest", "b")
    equal = settle(nodes.where("vec is not null").select("id", "node", "digest").join(equal, "digest").where("id <> b").select("id", "digest", "node", "b"), "equal")
    maybe, distinct = screen(equal)(F.col("digest")), nodes.where("vec is not null")
    distinct = distinct.where(~maybe).unionByName(distinct.where(maybe).join(equal.select("id", "digest"), ["id", "digest"], "left_anti"))
    points = settle(distinct.select("id", "node", "n", "vec"), "points")

    routes = distinct.select(F.posexplode("routes").alias("pos", "token"), "id", "node", "n").select("token", "id", "node", "n", F.expr("n - pos").alias("left"))
    dealt = routes.repartition("token").sortWithinPartitions("token", F.desc(F.expr("left / n")), "id")
    cells = settle(dealt.mapInArrow(tidy(_cells(rule, keys, tokens)), "a long, b long, node long, n long, left long"), "cells")

    def bounded(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose points allow a link: a, b, their nodes, and how near they may be."""
        pairs = settle(pairs, f"pairs_{name}")
        own = _points_of(points, pairs)
        q = pairs.join(own.toDF("a", "node_a", "n_a", "vec_a"), "a").join(own.toDF("b", "node_b", "n_b", "vec_b"), "b")
        q = q.select("a", "b", "node_a", "node_b", F.expr("n_a + n_b").alias("sizes"), "vec_a", "vec_b").mapInArrow(tidy(_with_bounds), "a long, b long, node_a long, node_b long, sizes long, bound long")
        return q.where(F.col("bound") * (num + den) >= F.col("sizes") * num).select("a", "b", "node_a", "node_b", F.expr("bound / sizes").alias("near"))

    def links(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs of nodes that the compared sets link."""
        return settle(_verified(rows, pairs, rule, f"sets_{name}").select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), f"links_{name}")

    def comp_of(p: DataFrame, node: str, out: str) -> DataFrame:
        c = comps.select(F.col("node").alias(node), F.col("comp").alias("_c"))
        return p.join(c, node, "left").withColumn(out, F.coalesce("_c", node)).drop("_c")

    def apart(pairs: DataFrame) -> DataFrame:
        return comp_of(comp_of(pairs, "node_a", "ca"), "node_b", "cb").where("ca <> cb").drop("ca", "cb")

    near = settle(bounded(cells.where("node is null").select("a", "b").distinct(), "near"), "near")
    # first the most promising pair of each set: in a group of near copies these links reach its centre, and what they connect
    # needs no comparison
    ends = near.withColumn("x", F.explode(F.array("a", "b"))).groupBy("x").agg(F.max_by(F.struct(near.columns), F.struct("near", "a", "b")).alias("p"))
    first = settle(ends.select("p.*").distinct(), "first")
    # rows that repeat an id tie their nodes together, as equal sets do
    twice = nodes.where("n > 0").groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("hi")).where("b <> hi").select("id", "b")
    ties = nodes.join(twice, "id").select(F.col("node").alias("a"), "b")
    equal_to = points.select(F.col("id").alias("b"), F.col("node").alias("to"))
    ties = ties.unionByName(equal.join(equal_to, "b").select(F.col("node").alias("a"), F.col("to").alias("b")))
    found = settle(links(first, "first").unionByName(ties), "found")
    comps = settle(connected_components(found), "comps")
    rest = apart(near.join(first, ["a", "b"], "left_anti"))

    release(df.sparkSession)
    # large cells: one set of each component against the cell's centre, then all sets that components still keep apart
    large = cells.where("node is not null").select(F.col("a").alias("token"), F.col("b").alias("id"), "node", "n", "left")
    large = settle(comp_of(large, "node", "comp").withColumn("most", F.expr(f"({num + den} * left - {num} * n) div {num}")), "large")
    heads = large.groupBy("token", "comp").agg(F.max_by(F.struct("id", "n", "left"), F.struct(F.expr("left / n"), F.col("id"))).alias("head"))
    middle = heads.groupBy("token").agg(F.max_by("head", F.struct(F.expr("head.left / head.n"), F.col("head.id"))).alias("mid"))
    second = heads.join(middle, "token").where(f"head.id <> mid.id and {num + den} * least(head.left, mid.left) >= {num} * (head.n + mid.n)")
    second = second.select(F.expr("least(head.id, mid.id)").alias("a"), F.expr("greatest(head.id, mid.id)").alias("b")).distinct()
    second = settle(bounded(second.join(near, ["a", "b"], "left_anti"), "second").unionByName(rest), "second")
    comps = settle(merge_components(comps, links(second, "second")), "comps")

    # a set stays only if another component of its cell has sets small enough for it that reach its own size
    large = comp_of(large.drop("comp"), "node", "comp")
    ends = large.groupBy("token").agg(F.min(F.struct("n", "comp")).alias("lo"), F.max(F.struct("most", "comp")).alias("hi"))
    ends = large.join(ends, "token").groupBy("token").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min(F.expr("if(comp <> lo.comp, n, null)")).alias("lo2"), F.max(F.expr("if(comp <> hi.comp, most, null)")).alias("hi2"))
    kept = large.join(ends, "token").where("if(comp = lo.comp, lo2, lo.n) <= most and if(comp = hi.comp, hi2, hi.most) >= n")
    kept = settle(kept.select("token", "id", "n", "left", "comp"), "kept")
    # a cell is dealt in blocks; each two blocks meet in one task and send on only pairs whose points allow a link
    counts = kept.groupBy("token").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    dealt = kept.join(counts, "token").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).join(points.select("id", "vec"), "id")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("token", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "id", "n", "left", "comp", "vec")
    crossed = dealt.groupBy("token", "b1", "b2").applyInArrow(_block_join(rule), "a long, b long").distinct()
    crossed = settle(bounded(crossed.join(near, ["a", "b"], "left_anti").join(second, ["a", "b"], "left_anti"), "crossed"), "crossed")
    if crossed.take(1):
        comps = merge_components(comps, links(crossed, "crossed"))
    release(df.sparkSession)
    out = nodes.select("id", F.col("n").alias("n_shingles"), "node").join(comps, "node", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("comp", "node").alias("component_id"))


def drop_similar(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with the document of smallest id of each component; rows without an id stay."""
    gone = similar_components(df, text, id_col).where(f"{id_col} <> component_id").select(F.col(id_col).alias("_gone"))
    gone = settle(gone, "gone")
    return df.join(gone, df[id_col] == gone["_gone"], "left_anti")
