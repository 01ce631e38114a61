"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct word n-grams, kept as 64-bit hashes; equal
sets are one node. Two sets of n and m n-grams link if they share T of them,
T = ceil(t * (n + m) / (1 + t)). The search has two levels.

*Lists.* All n-grams have one global order, rare ones first. A partner that is in
none of a set's ``n - ceil(t * n) + 1`` rarest lists cannot reach T. In each list a
leader is compared by parity bits (sets differ in as many n-grams at least as their
bits do) with the rest; who may link with it, or with someone that may, is joined to
it. That gives a spanning forest (fewer edges than rows), never the pairs of a list;
the components of all forests hold every link. Of lists with the very same sets (as
many, the same first and last, the same XOR of their hashes) one is searched.

*Blocks.* Whole sets meet in the task of their component, which indexes them: lists
of n-grams, short ones first. For a set, L = T - K of its lists are long; the rest are
merged, sets met K times or more are candidates, and these are probed in the long
lists: by binary search, or by one bit each where a block has a bit row for each set.
Links are counted in the task and leave it as a number for each set and as a forest.

Scale: n-gram frequencies come from a counter array of fixed size, summed over all
documents; it orders and never decides. Long lists are split into cells of bounded
size, so are components; a cell holds two of their blocks. Nothing that leaves a
task grows with the pairs of a group. The work on a component, and how often its
sets are sent, grows with the square of its different sets, as its links do, over
``_CELL_SETS``. A Bloom filter of fixed size spares most texts outside components
the second shuffle, another one spares postings of n-grams that no other set has;
where they fill up, more sets and postings travel and the result is the same.

Defined cases: null or empty text: no set, its own component. Fewer words than
n: the whole sequence is the only n-gram. Null ids: linked like all others, but
never a component's id (null if a component has no other). Rows that share an id
are one document to links: their components join. Empty tables give no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import SPACED, arrow_batch, blocks, distinct, sent, shingle_hashes, thrifty, word_hashes, written

BITS = 22
_BLOCK = 1 << 16
_MASK = np.uint64((1 << BITS) - 1)
#: Bits of the filter for sets to fetch.
_FILTER = 25
#: Bits of the filter for n-grams of two sets or more, and low bits of their hashes that it leaves out (they choose the counter).
_SHARED = 27
_LOW = 24
#: Rows of a list, sets and bytes of a component that one block takes; a cell has two blocks.
_LIST = 4096
_CELL_SETS = 1024
_CELL_BYTES = 4 << 20
#: Postings that one step of the forest takes; 1024 parity bits count as one more.
_STEP = 1 << 16
#: K: occurrences in short lists that make a candidate. Binary probes of one set before bit rows serve.
OCCURRENCES = 2
_PROBES = 1 << 13


def _sets(col: pa.Array, n: int):
    """(row, sorted distinct n-gram hashes) of all rows with words, and (row, None) of the rest."""
    for i, j, data, bounds in blocks(col):
        h, first = word_hashes(data, bounds, SPACED, lower=True)
        s, at = shingle_hashes(h, first, n)
        for r in range(j - i):
            yield i + r, distinct(s[at[r] : at[r + 1]]) if at[r + 1] > at[r] else None


def _sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many documents have an n-gram, by its hash modulo 2**BITS: blocks are summed by Spark, 16 MB at any input."""

    def row(k, part):
        narrow = part.astype(np.min_scalar_type(part.max()))
        return pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "v": pa.array([zlib.compress(narrow.tobytes(), 1)], pa.binary())})

    def numbers(v):
        v = zlib.decompress(v)
        return np.frombuffer(v, f"u{len(v) // _BLOCK}").astype(np.int32)

    @thrifty
    def count(batches):
        total = np.zeros(1 << BITS, np.int32)
        for b in batches:
            for _, s in _sets(b.column(0), n):
                if s is not None:
                    np.add.at(total, (s & _MASK).astype(np.int64), 1)
        for k in range(0, len(total), _BLOCK):
            part = total[k : k + _BLOCK]
            if part.any():
                yield row(k, part)

    @thrifty
    def merge(batches):
        out = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out[k] = out[k] + numbers(v) if k in out else numbers(v)
        for k, a in out.items():
            yield row(k, a)

    kind = "k long, v binary"
    found = docs.select("text").mapInArrow(count, kind).repartition(16, "k").mapInArrow(merge, kind).toArrow()
    total = np.zeros(1 << BITS, np.int32)
    for k, v in zip(found.column(0), found.column(1)):
        total[k.as_py() : k.as_py() + _BLOCK] = numbers(v.as_py())
    return total


def _parity(s: np.ndarray, width: int) -> np.ndarray:
    """So many bits: whether an odd number of n-grams falls on each. Two sets differ in as many n-grams at least as their bits do."""
    odd = np.bincount((s >> np.uint64(40) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _width(n: int) -> int:
    """Bits of a set's parity row: a power of two above 5/4 of its size, where bits of unlike sets still differ by more than the forest joins; 512 to 2**17."""
    return min(1 << 17, max(512, 1 << int(n + n // 4).bit_length()))


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed numbers."""
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _prefixes(docs: DataFrame, n: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """A written table: doc_id, n_shingles, digest (h1, h2), row (a number of its own), parity bits and rarest n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("row", pa.int64()), ("sig", pa.list_(pa.int64())), ("short", pa.list_(pa.int64()))])

    @thrifty
    def make(batches):
        counts, row = shared.value, TaskContext.get().partitionId() << 40
        for b in batches:
            ids, rows = b.column(0), []
            for r, s in _sets(b.column(1), n):
                row += 1
                doc = ids[r].as_py()
                if s is None:
                    rows.append((doc, 0, None, None, row, [], []))
                    continue
                c = counts[(s & _MASK).astype(np.int64)]
                p = len(s) - -(-num * len(s) // den) + 1
                o = np.lexsort((s, c))[:p]
                rows.append((doc, len(s), *_digest(s), row, _parity(s, _width(len(s))), s[o].view(np.int64)))
            if rows:
                yield arrow_batch(schema, *zip(*rows))

    out = written(docs.select("doc_id", "text").mapInArrow(make, "doc_id long, n_shingles long, h1 long, h2 long, row long, sig array<long>, short array<long>"), "prefixes")
    shared.destroy()
    return out


# ---------------------------------------------------------------- lists
def forest(cell: np.ndarray, n: np.ndarray, sig: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, leader) that connect, inside each cell (rows of one list, together), all rows that may link. ``sig``: parity bits, one row each."""
    alive, a, b = np.arange(len(cell)), [], []
    up = np.arange(len(cell))  # joined rows point to one that stands for them

    def found(rows):
        top = up[rows]
        while (up[top] != top).any():
            top = up[top]
        return top

    while len(alive):
        now = cell[alive]
        start = np.concatenate([[True], now[1:] != now[:-1]])
        lead = alive[start][np.cumsum(start) - 1]
        differ = np.bitwise_count((sig[alive] ^ sig[lead]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        low, high, both = np.minimum(n[alive], n[lead]), np.maximum(n[alive], n[lead]), n[alive] + n[lead]
        near = (den * low >= num * high) & ((num + den) * differ <= (den - num) * both)
        # a row near the leader leaves the list; whoever it may link with differs from the leader by both distances at most
        reach = (den * den * low >= num * num * high) & ((num + den) * num * differ <= (den - num) * (num * both + 2 * den * low))
        mine, other = found(lead), found(alive)
        pick = reach & (mine != other)
        other, at = np.unique(other[pick], return_index=True)
        up[other] = mine[pick][at]
        a.append(other)
        b.append(mine[pick][at])
        alive = alive[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _folded(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[i:j] for i, j in zip(at, at[1:])]


def _as_rows(sigs: list[np.ndarray], width: int) -> np.ndarray:
    """Parity rows of one width: a wider one is folded, which keeps what it says."""
    out = np.empty((len(sigs), width), np.int64)
    for k, s in enumerate(sigs):
        out[k] = s if len(s) == width else np.bitwise_xor.reduce(s.reshape(-1, width), axis=0)
    return out


def _shared_postings(nodes: DataFrame) -> DataFrame:
    """A written table (node, n, gram): the postings of n-grams of two sets at least, and others that the filter lets by. Most n-grams are one set's alone; of these only 40 bits are shuffled, once."""
    met = nodes.select(F.explode("short").alias("gram")).groupBy(F.expr(f"shiftrightunsigned(gram, {_LOW})").alias("key")).agg(F.count("*").alias("m"))
    shared = nodes.sparkSession.sparkContext.broadcast(_filter(met.where("m > 1"), _SHARED))
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("gram", pa.int64())])

    @thrifty
    def pick(batches):
        words = shared.value
        for b in batches:
            gram = b.column(2).flatten().to_numpy(zero_copy_only=False)
            key = gram.view(np.uint64) >> np.uint64(_LOW)
            word = words[((key >> np.uint64(6)) & np.uint64(len(words) - 1)).astype(np.int64)]
            at = np.flatnonzero(word >> (key & np.uint64(63)) & np.uint64(1))
            row = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy(zero_copy_only=False))[at]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row)), pa.array(gram[at])], schema=schema)

    out = written(nodes.select("node", "n", "short").mapInArrow(pick, "node long, n long, gram long"), "postings")
    shared.destroy()
    return out


def _candidates(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): edges whose components hold every link; ``nodes`` (node, n, sig, short)."""
    post = _shared_postings(nodes)
    # lists of one set, or of two whose sizes can't link, hold nothing
    lists = post.groupBy("gram").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("node").alias("first"), F.max("node").alias("last"), F.bit_xor(F.xxhash64("node")).alias("all"))
    lists = lists.where(f"m > 2 or m = 2 and {den} * least >= {num} * most")
    # n-grams of the very same sets (those of copies and of shared passages) make one list, which gives the edges of all
    lists = lists.groupBy("m", "first", "last", "all").agg(F.min("gram").alias("gram"))
    lists = written(lists.select("gram", F.expr(f"cast(ceil(m / {_LIST}) as int)").alias("k")), "lists")
    # joined alike at every size: whether a side is small enough to be sent everywhere would else change with the input
    live = post.select("node", "gram").join(lists.hint("merge"), "gram")
    rows = live.join(nodes.select("node", "n", "sig").hint("merge"), "node")
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(node), k) as int)")).withColumn("with", F.explode(F.expr("sequence(0, k - 1)")))
    # a list is dealt by the width of parity rows; a set whose partners may be of the class below is met there too
    below = f"size(sig) > 8 and 5 * n * {num} < {den} * (128L * size(sig) + 5)"
    rows = rows.withColumn("as", F.explode(F.expr(f"if({below}, array(size(sig), size(sig) div 2), array(size(sig)))")))
    rows = rows.select(F.xxhash64("gram", F.least("block", "with"), F.greatest("block", "with"), "as").alias("cell"), F.xxhash64("node").alias("turn"), "node", "n", "as", "sig")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @thrifty
    def edges(batches):
        held, size = [], 0

        def weight(part):
            return sum(1 + len(s) // 16 for s in part[4])

        def closed(part):
            cell, node, n, width = (np.concatenate([x[k] for x in part]) for k in range(4))
            sigs = [s for x in part for s in x[4]]
            for w in np.unique(width):
                pick = np.flatnonzero(width == w)
                a, b = forest(cell[pick], n[pick], _as_rows([sigs[k] for k in pick], int(w)), num, den)
                pair = np.unique(np.stack([node[pick][a], node[pick][b]]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], schema=schema)

        for x in batches:
            part = [*(x.column(k).to_numpy(zero_copy_only=False) for k in range(4)), _folded(x.column(4))]
            held.append(part)
            size += weight(part)
            if size < _STEP:
                continue
            last = part[0][-1]
            cut = [int(np.flatnonzero(h[0] != last)[-1]) + 1 if (h[0] != last).any() else 0 for h in held]
            if any(cut):
                yield from closed([[c[:k] for c in h] for h, k in zip(held, cut) if k])
                held = [[c[k:] for c in h] for h, k in zip(held, cut) if k < len(h[0])]
                size = sum(weight(h) for h in held)
        if held:
            yield from closed(held)

    dealt = rows.repartition("cell").sortWithinPartitions("cell", "turn", "node").select("cell", "node", "n", "as", "sig")
    return written(dealt.mapInArrow(edges, "a long, b long").distinct(), "candidates")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for all nodes of edges (a, b): the smallest node reachable. Minimum labels with pointer jumping; each round is a written table."""
    # a node's smallest neighbour takes its place in its other edges: stars remain, and edges between their centres
    star = edges.join(edges.groupBy("a").agg(F.min("b").alias("least")), "a")
    edges = star.select("a", F.col("least").alias("b")).union(star.select(F.col("b").alias("a"), F.col("least").alias("b"))).where("a != b")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(step.join(jump, "label", "left").select("node", "was", F.least("label", "further").alias("label")), "labels")
        changed = new.where("label != was").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels


# ---------------------------------------------------------------- blocks
class Index:
    """Inverted lists of the n-grams of some sets: numbered from the shortest on, without those of one set alone."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        _, at = np.unique(np.concatenate(sets), return_inverse=True)
        owner, length = np.repeat(np.arange(len(sets)), self.size), np.bincount(at)
        order = np.argsort(length, kind="stable")
        number = np.empty(len(length), np.int64)
        number[order] = np.arange(len(length)) - int((length == 1).sum())
        at = number[at]
        owner, at = owner[at >= 0], at[at >= 0]
        self.n_lists = max(0, len(length) - int((length == 1).sum()))
        o = np.argsort(at, kind="stable")
        #: Sets of each list; list and set as one number, ascending.
        self.lists, self.keys = owner[o], at[o] * len(sets) + owner[o]
        self.begin = np.searchsorted(at[o], np.arange(self.n_lists + 1))
        o = np.lexsort((at, owner))
        self.of, self.first = at[o], np.searchsorted(owner[o], np.arange(len(sets) + 1))
        self._bits = None

    @property
    def bits(self) -> np.ndarray:
        """A row for each set, a bit for each list."""
        if self._bits is None:
            self._bits = np.zeros((len(self.size), self.n_lists // 64 + 1), np.uint64)
            owner = np.repeat(np.arange(len(self.size)), np.diff(self.first))
            np.bitwise_or.at(self._bits, (owner, self.of >> 6), np.uint64(1) << (self.of & 63).astype(np.uint64))
        return self._bits

    def partners(self, q: int, fits: np.ndarray, num: int, den: int) -> np.ndarray:
        """Sets among ``fits`` (a mask) that reach the similarity with set q: short lists merged, long ones probed."""
        mine = self.of[self.first[q] : self.first[q + 1]]
        t = -(-num * int(self.size[q]) // den)  # of the smallest partner that fits
        if len(mine) < t:
            return np.zeros(0, np.int64)
        k = min(t, OCCURRENCES)
        cut = len(mine) - (t - k)
        short, long = mine[:cut], mine[cut:]
        merged = np.sort(np.concatenate([self.lists[self.begin[x] : self.begin[x + 1]] for x in short.tolist()]), kind="stable")
        at = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]]))
        met, times = merged[at], np.diff(np.append(at, len(merged)))
        pick = (times >= k) & fits[met]
        met, times = met[pick], times[pick]
        if not len(met):
            return met
        if len(met) * len(long) <= _PROBES:
            want = long[None, :] * len(self.size) + met[:, None]
            times = times + (self.keys[np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)] == want).sum(axis=1)
        elif len(long):
            word = int(long[0]) >> 6
            own = self.bits[q, word:].copy()
            own[0] &= ~np.uint64(0) << np.uint64(long[0] & 63)
            times = times + np.bitwise_count(self.bits[met, word:] & own).sum(axis=1)
        return met[(num + den) * times >= num * (self.size[q] + self.size[met])]


def divide_skip(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the (different) sets: its links, and the first set that it reaches by links. ``side``: 0 and 1 for two blocks, whose own pairs don't count, or 2 throughout for all pairs."""
    index, size = Index(sets), np.array([len(s) for s in sets], np.int64)
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    later = np.arange(len(sets))
    for q in range(len(sets)):
        fits = (later > q) & (den * np.minimum(size, size[q]) >= num * np.maximum(size, size[q])) & ((side != side[q]) | (side == 2))
        if not fits.any():
            continue
        met = index.partners(q, fits, num, den)
        if len(met):
            links[q] += len(met)
            links[met] += 1
            known = np.unique(root[np.append(met, q)])
            if len(known) > 1:
                root[np.isin(root, known)] = known[0]
    return links, root


def _filter(keys: DataFrame, bits: int = _FILTER) -> np.ndarray:
    """A Bloom filter of 2**bits bits of the column ``key``, as 64-bit words."""
    found = keys.select(F.expr(f"shiftrightunsigned(key, 6) & {(1 << bits - 6) - 1}").alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit"))
    found = found.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out.view(np.uint64)


def _whole_sets(docs: DataFrame, shared, n: int) -> DataFrame:
    """(h1, h2, grams): the sorted sets of the rows that pass the filter, one for each task that meets them."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("grams", pa.binary())])

    @thrifty
    def make(batches):
        words, seen = shared.value, set()
        for b in batches:
            ids, rows = b.column(0).fill_null(0).to_pylist(), []
            for r, s in _sets(b.column(1), n):
                if s is None:
                    continue
                h = _digest(s)
                key = h[0] ^ ids[r]
                if h not in seen and int(words[(key >> 6) & ((1 << _FILTER - 6) - 1)]) >> (key & 63) & 1:
                    seen.add(h)
                    rows.append((*h, s.tobytes()))
            if rows:
                yield arrow_batch(schema, *zip(*rows))

    return docs.select("doc_id", "text").mapInArrow(make, "h1 long, h2 long, grams binary")


def links(docs: DataFrame, nodes: DataFrame, labels: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """A written table (node, n_links, root): for a cell, the links of each of its sets and a set that it reaches by them. ``nodes`` (node, h1, h2, n, row_id), ``labels`` (node, label)."""
    mine = written(labels.join(nodes.select("node", "h1", "h2", "n", "row_id"), "node"), "linked")
    of = mine.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).where("m > 1")
    of = of.select("label", F.expr(f"cast(greatest(ceil(m / {_CELL_SETS}), ceil(8 * grams / {_CELL_BYTES})) as int)").alias("k"))
    placed = mine.join(of, "label").select("node", "h1", "h2", "label", F.expr("cast(pmod(xxhash64(node), k) as int)").alias("block"), "k")
    shared = docs.sparkSession.sparkContext.broadcast(_filter(mine.select(F.col("h1").bitwiseXOR(F.coalesce("row_id", F.lit(0))).alias("key"))))
    # a set goes to one cell for each block of its component
    cells = _whole_sets(docs, shared, n).join(placed, ["h1", "h2"]).withColumn("with", F.explode(F.expr("sequence(0, k - 1)")))
    cells = cells.select("label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), F.expr("case when block = with then 2 when block < with then 0 else 1 end").alias("side"), "node", "grams")
    schema = pa.schema([("node", pa.int64()), ("n_links", pa.int64()), ("root", pa.int64())])

    @thrifty
    def count(batches):
        key, held = None, {}

        def closed():
            if len(held) > 1:
                node, (side, sets) = np.array(list(held)), zip(*held.values())
                n_links, root = divide_skip(list(sets), np.array(side), num, den)
                at = np.flatnonzero(n_links)
                if len(at):
                    yield arrow_batch(schema, node[at], n_links[at], node[root[at]])

        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(5)]
            for r, now in enumerate(zip(*cols[:3])):
                if now != key:
                    yield from closed()
                    key, held = now, {}
                held[cols[4][r]] = (cols[3][r], np.frombuffer(b.column(5)[r].as_buffer(), np.uint64).copy())
        yield from closed()

    dealt = cells.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
    found = written(dealt.mapInArrow(count, "node long, n_links long, root long"), "links")
    shared.destroy()
    return found


def jaccard_components(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (other different sets that reach the similarity with the document's)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = _prefixes(docs, n, num, den, _sketch(docs, n))
    sets = rows.where("h1 is not null")
    nodes = sets.groupBy("h1", "h2").agg(F.min(F.struct("row", "n_shingles", "doc_id", "sig", "short")).alias("r"), F.min("doc_id").alias("least_id"))
    nodes = written(nodes.select("h1", "h2", "least_id", F.col("r.row").alias("node"), F.col("r.n_shingles").alias("n"), F.col("r.doc_id").alias("row_id"), "r.sig", "r.short"), "nodes")
    labels = components(_candidates(nodes, num, den))
    found = links(docs, nodes, labels, n, num, den)
    edges = found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    # rows that share an id are one document
    of = nodes.select("h1", "h2", "node", "least_id")
    shared = sets.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("one"), F.max(F.struct("h1", "h2")).alias("last")).where("one != last").select("doc_id", "one.*")
    if shared.limit(1).count():
        one = shared.join(of, ["h1", "h2"]).select("doc_id", F.col("node").alias("b"))
        edges = edges.unionByName(sets.select("doc_id", "h1", "h2").distinct().join(one, "doc_id").join(of, ["h1", "h2"]).where("node != b").select(F.col("node").alias("a"), "b"))
    degree = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    of = of.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node")).join(degree, "node", "left")
    least = of.groupBy("label").agg(F.min("least_id").alias("component_id"))
    of = of.join(least, "label").select("h1", "h2", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    out = rows.select("doc_id", "n_shingles", "h1", "h2").join(of, ["h1", "h2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicated(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, all columns as they were: that of the smallest id, of several texts of this id the one of smallest hash, of rows alike in both any one. Rows without words stay. Rows without id stand for their text: numbers from 2**62 on, above real ids, take the id's place meanwhile."""
    text = F.col("text").cast("string")
    worded = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    stand_in = F.when(worded, F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62))
    key, h = _unused(docs, "key"), _unused(docs, "h")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), stand_in))
    found = written(jaccard_components(keyed.select(F.col(key).alias("doc_id"), "text"), n, num, den), "components")
    gone = sent(found.where("doc_id != component_id").select(F.col("doc_id").alias(key)).distinct(), "repeated")
    repeated = found.where("doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    out = keyed.join(gone, key, "left_anti")
    if repeated.limit(1).count():
        # rows without words may share an id with others: they stay beside
        out = out.withColumn(h, F.xxhash64(text))
        least = out.where(worded & F.col(key).isNotNull()).groupBy(key).agg(F.min(h).alias(h))
        one = out.where(worded).join(least, [key, h], "left_semi").dropDuplicates([key])
        out = one.unionByName(out.where(~worded))
    return out.select(docs.columns)


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def required_overlap(n: int, m: int, num: int, den: int) -> int:
    """T of two set sizes."""
    return math.ceil(num * (n + m) / (num + den))
