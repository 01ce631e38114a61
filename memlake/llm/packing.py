"""Packing by cutting-stock column generation.

Every document becomes token ids and an end id, cut into pieces of a full
sequence and one remainder. Piece lengths, rounded up to a step, form a bounded
histogram: the linear program over cutting patterns is solved by column
generation (a knapsack dynamic program prices columns), patterns are rounded
down, and what rounding leaves is packed first-fit decreasing. Documents ranked
inside their length class are then dealt to the places of the patterns.

Scale: the driver sees the histogram only (2048 / step numbers). Texts are
tokenised once; what goes on is a small row for each piece, written to the shared
folder. Ranks come from counts by class and salt, so a class that holds most
pieces is ranked in many tasks. A worker encodes each unit (letters, marks, a digit,
or what can't be parted) once and keeps its ids, up to a bound.

Defined cases: null text is empty: its only token is the end id. Documents of
any length are cut; empty tables give no rows. Repeated rows are packed each.
"""

from __future__ import annotations

import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import _LOWER, arrow_batch, blocks, span_hashes, thrifty, written

END = 1
SIZE = 2048
STEP = 16
#: Of a worker: what it keeps of units is bounded.
_KEPT_UNITS = 400_000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Byte classes: white space, letters, digits, marks, apostrophe, bytes of other characters.
_SPACE, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(6)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[128:] = _OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _APOSTROPHE
#: [before, at]: whether a unit begins at a byte. The tokenizer drops white space and joins none of these pairs; an apostrophe may take the letters after it, and what stands next to other characters stays whole.
_CUT = np.zeros((6, 6), bool)
_CUT[_SPACE, _LETTER:] = True
_CUT[_LETTER, [_DIGIT, _MARK, _APOSTROPHE]] = True
_CUT[_DIGIT, [_LETTER, _DIGIT, _MARK, _APOSTROPHE]] = True
_CUT[_MARK, [_LETTER, _DIGIT]] = True
_CUT[_APOSTROPHE, _DIGIT] = True


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the units that are encoded alone, and for each row the index of its first."""
    kind = _CLASS[data]
    before = np.concatenate([[_SPACE], kind]).astype(np.uint8)
    before[bounds] = _SPACE  # a row begins
    cut = _CUT.ravel()[before[:-1] * 6 + kind]
    last = np.ones(len(kind), bool)  # the next byte begins a unit, or is in none
    last[:-1] = cut[1:] | (kind[1:] == _SPACE)
    last[bounds[1:] - 1] = True
    starts = np.flatnonzero(cut)
    return starts, np.flatnonzero(last & (kind != _SPACE)) + 1, np.searchsorted(starts, bounds)


class Encoder:
    """Ids of texts. A unit is encoded when it is first met; its ids are kept by its hash, for at most ``_KEPT_UNITS`` units."""

    def __init__(self, path: str, split=units, lower: bool = True, end: int = END):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split, self.lower, self.end = split, lower, end
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        new = len(self.bounds) - 1 + np.arange(len(found))
        self.bounds = np.append(self.bounds, self.bounds[-1] + np.cumsum(lengths))
        self.ids = np.concatenate([self.ids, np.fromiter((x for e in found for x in e), np.uint32, int(lengths.sum()))])
        to = np.searchsorted(self.hashes, hashes)
        self.hashes, self.at = np.insert(self.hashes, to, hashes), np.insert(self.at, to, new)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, each with its end, and the n+1 bounds of the rows."""
        raw = data.tobytes()
        starts, ends, first = self.split(data, bounds)
        h = span_hashes(_LOWER[data] if self.lower else data, starts, ends)
        met = pa.array(h).dictionary_encode()
        known, which = met.dictionary.to_numpy(), met.indices.to_numpy()
        if len(self.hashes) > _KEPT_UNITS:
            self._forget()
        order = np.argsort(known)
        to = np.searchsorted(self.hashes, known[order])
        new = order[self.hashes[np.minimum(to, len(self.hashes) - 1)] != known[order]] if len(self.hashes) else order
        if len(new):
            one = np.empty(len(known), np.int64)
            one[which[::-1]] = np.arange(len(which))[::-1]
            self._learn(known[new], [raw[starts[k] : ends[k]].decode("utf-8", "replace") for k in one[new]])
        slot = self.at[np.searchsorted(self.hashes, known)]
        begin, length = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        # every row's end is a unit of its own after its last
        n = len(bounds) - 1
        at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))
        lengths = np.ones(len(h) + n, np.int64)
        lengths[at] = length[which]
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        out = np.full(cuts[-1], self.end, "<u4")
        to = np.repeat(cuts[at] - np.concatenate([[0], np.cumsum(length[which])[:-1]]) if len(h) else cuts[:0], length[which])
        source = np.repeat(begin[which] - np.concatenate([[0], np.cumsum(length[which])[:-1]]) if len(h) else cuts[:0], length[which])
        k = np.arange(len(to))
        out[to + k] = self.ids[source + k]
        row = cuts[first + np.arange(n + 1)]
        return out, row

    def rows(self, col: pa.Array):
        """Ids of each row, with its end. Rows that spell a special token are left to the tokenizer whole."""
        for i, j, data, bounds in blocks(col):
            ids, at = self(data, bounds)
            raw = data.tobytes()
            odd = any(t in raw for t in self.special)
            for r in range(j - i):
                if odd and any(t in raw[bounds[r] : bounds[r + 1]] for t in self.special):
                    yield np.append(np.asarray(self.tokenizer.encode(col[i + r].as_py(), add_special_tokens=False).ids, "<u4"), np.uint32(self.end)).astype("<u4")
                else:
                    yield ids[at[r] : at[r + 1]]


def encoder(path: str, split=units, lower: bool = True, end: int = END) -> Encoder:
    """One for each worker process."""
    kept = sys.modules.setdefault("_memlake_worker", types.ModuleType("_memlake_worker"))
    asked = (path, split.__name__, lower, end)
    if getattr(kept, "encoder_of", None) != asked:
        kept.encoder, kept.encoder_of = Encoder(path, split, lower, end), asked
    return kept.encoder


def pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of all pieces."""
    path = tokenizer or default_tokenizer()

    @thrifty
    def cut(batches):
        encode = encoder(path)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encode.rows(b.column(1))):
                for k in range(0, len(ids), size):
                    part = ids[k : k + size]
                    rows.append((doc, k, len(part), zlib.crc32(part), len(ids)))
            if rows:
                yield arrow_batch(_SCHEMA, *zip(*rows))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best multiset of items 1..capacity (item c has size c and value[c]): its value and counts."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for w in range(1, capacity + 1):
        gain = best[w - 1 :: -1] + value[1 : w + 1]
        c = int(np.argmax(gain))
        best[w], took[w] = (gain[c], c + 1) if gain[c] > best[w - 1] + 1e-12 else (best[w - 1], 0)
    counts, w = np.zeros(capacity + 1, np.int64), capacity
    while w > 0:
        c = took[w]
        counts[c] += c > 0
        w -= max(int(c), 1)
    return float(best[capacity]), counts


def inverted(basis: np.ndarray) -> np.ndarray:
    """The inverse by elimination, row by row. No BLAS or LAPACK: their threads can wait for ever beside the driver's JVM."""
    n = len(basis)
    both = np.concatenate([basis, np.eye(n)], axis=1)
    for k in range(n):
        top = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, top]] = both[[top, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= factor[:, None] * both[k]
    return both[:, n:]


def cutting_stock(demand: np.ndarray, most_rounds: int = 2000) -> list[tuple[int, np.ndarray]]:
    """demand[c]: pieces of size c (1..capacity). Patterns as (times used, counts by size) that cover the demand exactly."""
    capacity = len(demand) - 1
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    pos = {int(c): k for k, c in enumerate(used)}
    n = demand[used] + 1e-4 * np.arange(1, len(used) + 1) / len(used)  # so that no two ratios are equal
    basis = np.diag([float(capacity // c) for c in used])
    for turn in range(most_rounds):
        if turn % 64 == 0:
            inverse = inverted(basis)
        x, y = (inverse * n).sum(axis=1), inverse.sum(axis=0)
        value = np.full(capacity + 1, -1.0)
        value[used] = y
        worth, counts = knapsack(value, capacity)
        # no solution has fewer than sum(x) / worth sequences
        if x.sum() * (1 - 1 / max(worth, 1)) <= max(0.5, 1e-4 * x.sum()):
            break
        column = np.zeros(len(used))
        for c in np.flatnonzero(counts):
            column[pos[int(c)]] = counts[c]
        d = (inverse * column).sum(axis=1)
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        leaving = int(np.argmin(ratio))
        basis[:, leaving] = column
        pivot = inverse[leaving] / d[leaving]
        inverse -= d[:, None] * pivot
        inverse[leaving] = pivot
    x = np.maximum((inverted(basis) * n).sum(axis=1), 0)
    left, out = demand.astype(np.int64).copy(), []
    for k in np.argsort(-x):
        counts = np.zeros(capacity + 1, np.int64)
        counts[used] = np.rint(basis[:, k]).astype(np.int64)
        have = counts > 0
        times = int(min(np.floor(x[k] + 1e-6), (left[have] // counts[have]).min()))
        if times > 0:
            left -= times * counts
            out.append((times, counts))
    return out + first_fit_decreasing(left)


def first_fit_decreasing(left: np.ndarray) -> list[tuple[int, np.ndarray]]:
    capacity, out = len(left) - 1, []
    left = left.copy()
    while left.any():
        counts, room = np.zeros(capacity + 1, np.int64), capacity
        for c in np.flatnonzero(left)[::-1]:
            if take := min(int(left[c]), room // int(c)):
                counts[c] += take
                room -= take * int(c)
        have = counts > 0
        times = int((left[have] // counts[have]).min())
        left -= times * counts
        out.append((times, counts))
    return out


def packed(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE, step: int = STEP) -> DataFrame:
    """The pieces with sequence_id and offset."""
    return dealt(pieces(docs, tokenizer, size), size, step, cutting_stock).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def dealt(cut: DataFrame, size: int, step: int, patterns) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, ...) with sequence_id and offset, by the patterns made of the counts of their length classes."""
    spark = cut.sparkSession
    cut = written(cut.withColumn("cls", F.expr(f"cast((length + {step - 1}) div {step} as int)")), "pieces")
    salts = max(16, cut.count() // 50_000)
    cut = cut.withColumn("salt", F.expr(f"pmod(xxhash64(doc_id, start, ids_crc32), {salts})"))
    counts = written(cut.groupBy("cls", "salt").agg(F.count("*").alias("c")), "classes")
    demand = np.zeros(size // step + 1, np.int64)
    for r in counts.groupBy("cls").agg(F.sum("c").alias("c")).collect():
        demand[r.cls] = r.c
    table, sequence, rank = [], 0, np.zeros(len(demand), np.int64)
    for times, pattern in patterns(demand):
        for c in np.flatnonzero(pattern):
            each = int(pattern[c])
            table.append((int(c), int(rank[c]), int(rank[c]) + times * each, each, sequence))
            rank[c] += times * each
        sequence += times
    places = spark.createDataFrame(table, "cls int, lo long, hi long, each long, base long")
    before = Window.partitionBy("cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cls", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.withColumn("rn", F.row_number().over(inside)).join(offsets, ["cls", "salt"]).withColumn("rank", F.col("first") + F.col("rn") - 1)
    # the table of places is bounded by patterns and classes, not by data
    placed = ranked.join(F.broadcast(places), "cls").where("rank >= lo and rank < hi").withColumn("sequence_id", F.expr("base + (rank - lo) div each"))
    along = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0))).drop("cls", "salt", "rn", "first", "rank", "lo", "hi", "each", "base")
