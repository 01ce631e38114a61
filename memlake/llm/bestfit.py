"""Best-fit packing: best-two-fit.

Every document becomes token ids and an end id. One that is longer than a sequence
is cut into full pieces, its first piece taking the rest. Sequences are filled one
after another: greedily, the longest piece that fits first; then the smallest piece
of the sequence gives way to the two unpacked pieces that fill its place and the gap
best, if they fill them better than it does alone.

Scale: bins of the same filling are made at once, from the counts of lengths alone,
so the driver sees ``size`` numbers however many documents there are, and works in
time that grows with lengths and not with documents. Texts are tokenised once, in
tasks. Pieces are then ranked inside their length (in salted runs, so that a length
which most pieces have is ranked in many tasks) and dealt to the places.

Defined cases: null text is empty: its only token is the end id. Documents of any
length are cut; an empty table gives no rows. Repeated rows and null ids are packed
each. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import arrow_batch, thrifty
from memlake.llm.packing import dealt, encoder

END = 2
SIZE = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- units of the byte-level tokenizer
#: Byte classes: space, other white space, letters, digits, marks, apostrophe, anything else (never cut beside it).
_SPACE, _BREAK, _LETTER, _DIGIT, _MARK, _APOSTROPHE, _OTHER = range(7)
_CLASS = np.full(256, _MARK, np.uint8)
_CLASS[:32] = _CLASS[127:] = _OTHER
_CLASS[9:14] = _BREAK
_CLASS[32] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _APOSTROPHE
#: [before, at]: the tokenizer's own pattern always ends a word between these; after an apostrophe it may take letters along.
_CUT = np.zeros((7, 7), bool)
_CUT[_LETTER, [_DIGIT, _MARK, _APOSTROPHE]] = True
_CUT[_DIGIT, [_LETTER, _MARK, _APOSTROPHE]] = True
_CUT[_MARK, [_LETTER, _DIGIT]] = True


def byte_units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the units that the tokenizer may encode alone, and for each row the index of its first.

    A unit begins with a row, at a single space between two visible characters, around
    a single break between two, and where the class of visible characters changes.
    Every byte is in a unit.
    """
    n = len(data)
    kind = np.full(n + 3, _OTHER, np.uint8)
    kind[2 : n + 2] = _CLASS[data]
    # Latin letters of two bytes from C3 80 to C3 BF, but for the signs of multiplication and division
    wide = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)) if n > 1 else np.zeros(0, int)
    kind[wide + 2] = kind[wide + 3] = _LETTER
    seen = (kind >= _LETTER) & (kind <= _APOSTROPHE)
    at, before, after = kind[2 : n + 2], kind[1 : n + 1], kind[3 : n + 3]
    row = np.zeros(n + 1, bool)
    row[bounds] = True
    inner = ~row[:n]  # the byte before is of the same row
    whole = inner & ~row[1:]  # so is the one after
    cut = _CUT.ravel()[before * 7 + at] & inner
    cut |= ((at == _SPACE) | (at == _BREAK)) & seen[1 : n + 1] & seen[3 : n + 3] & whole
    cut[1:] |= (before[1:] == _BREAK) & seen[2 : n + 2][1:] & seen[1 : n + 1][:-1] & inner[1:] & inner[:-1]
    cut |= row[:n]
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n)[: len(starts)], np.searchsorted(starts, bounds)


# ---------------------------------------------------------------- the packing itself
def best_two_fit(demand: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """demand[c]: pieces of size c (1..capacity). Patterns as (times used, counts by size) that cover the demand exactly.

    The pattern of the next bin depends on which sizes are left, and on how many only
    where it wants more of one than there are; so it is used as often as its counts
    last, as filling the bins one by one would.
    """
    capacity = len(demand) - 1
    left, out = demand.astype(np.int64).copy(), []
    while left.any():
        counts, gap = _greedy(left), 0
        gap = capacity - int((counts * np.arange(capacity + 1)).sum())
        if gap and counts.sum() > 1:
            smallest = int(np.flatnonzero(counts)[0])
            pair = _best_pair(left - counts, smallest, smallest + gap)
            if pair:
                counts[smallest] -= 1
                counts[pair[0]] += 1
                counts[pair[1]] += 1
        have = counts > 0
        times = int((left[have] // counts[have]).min())
        left -= times * counts
        out.append((times, counts))
    return out


def _greedy(left: np.ndarray) -> np.ndarray:
    """The longest piece that fits, again and again."""
    room, counts = len(left) - 1, np.zeros(len(left), np.int64)
    for c in np.flatnonzero(left)[::-1].tolist():
        if c <= room:
            take = min(int(left[c]), room // c)
            counts[c] = take
            room -= take * c
            if not room:
                break
    return counts


def _best_pair(left: np.ndarray, over: int, most: int) -> tuple[int, int] | None:
    """Sizes a >= b of two unpacked pieces whose sum is over ``over`` and as near to ``most`` as can be; the longest a of these."""
    sizes = np.flatnonzero(left[: most + 1])[::-1].tolist()
    best, found = over, None
    for a in sizes:
        if 2 * a <= best:
            break  # a and all after it are too short
        for total in range(most, best, -1):
            b = total - a
            if 0 < b <= a and left[b] > (a == b):
                best, found = total, (a, b)
                break
        if best == most:
            break
    return found


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of all pieces."""
    import pyarrow as pa

    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    @thrifty
    def cut(batches):
        encode = encoder(path, byte_units, False, END)
        for b in batches:
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), encode.rows(b.column(1))):
                first = len(ids) % size or size
                for k, begin in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[begin : first + k * size]
                    rows.append((doc, k, begin, len(part), zlib.crc32(part)))
            if rows:
                yield arrow_batch(schema, *zip(*rows))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit_packed(docs: DataFrame, tokenizer: str | None = None, size: int = SIZE) -> DataFrame:
    """The pieces with sequence_id and offset."""
    return dealt(cut_pieces(docs, tokenizer, size), size, 1, best_two_fit).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
