"""Phrase collocation mining: minimal perfect hashes over Apriori-safe candidates.

Words are counted first. Longer phrases are counted level by level: a phrase of n
words is looked at only where both its parts of n - 1 words may be frequent (a bit
filter says so, and errs on the safe side alone). Each mapper sums up what it sees
and hands every block of the hash space its share. In a block, buckets that can't
reach the least count go; what is left are its candidates: a minimal perfect hash
gives each a slot, where its key is stored. Every mapper's share is then counted into
an array by slot, after its keys were compared with the stored ones, and the arrays
are summed pairwise. Cuts are joined from the counts by the slots' keys, and the
best of each language come from the best of its salted parts.

Scale: nothing depends on the vocabulary's fitting anywhere. The number of blocks
follows the number of words, so a block (some million entries) fits a task at any
size; a frequent phrase adds one entry for each mapper's run. The filters have
at most 2**27 bits, whatever the data: larger ones would spare more entries, results
are the same. Joins are plain, so a frequent word's rows may be split at run time.

A word is known by a 64-bit hash of its language and letters (two frequent words of
the same hash end the run with an error), a phrase by the hashes of its words, 128 or
192 bits. Scores are integers made of decimals of 38 digits.

Defined cases: null text is empty, null language ``und``. Texts of any length are
read whole; repeated rows count each; an empty table gives no rows. Extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import _LOWER, arrow_batch, blocks, mix, span_hashes, thrifty, word_spans, written

LEAST = 10
TOP = 2000
#: A phrase goes where a longer candidate around it has this share of its count.
SWALLOWED_PERCENT = 50
MOST_BITS = 1 << 27
#: Words that a mapper sums up at once, and entries that a block should have.
RUN = 1 << 20
BLOCK = 1 << 20
_SALTS = 64
_U = np.uint64
#: Bytes that end a piece of text: line breaks and . , ; : ! ?
_STOP = np.zeros(256, bool)
_STOP[[10, 11, 12, 13, *b".,;:!?"]] = True
_WORD = ~_STOP
_WORD[[9, 32]] = False


# ---------------------------------------------------------------- words of texts
def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little")


def _words(batch: pa.RecordBatch):
    """From columns lang and text, some 1 MB at once: the languages' names, each word's language, hash, start and end, whether the next word follows in the same piece, and the bytes."""
    langs = batch.column(0).fill_null("und").dictionary_encode()
    names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
    seeds = np.asarray([_seed(x) for x in names], np.uint64)
    for i, j, data, bounds in blocks(batch.column(1)):
        data = _LOWER[data]
        starts, ends, first = word_spans(data, bounds, _WORD)
        if not len(starts):
            continue
        row = np.repeat(np.arange(j - i), np.diff(first))
        lang = code[i:j][row]
        stops = np.cumsum(_STOP[data])[starts]
        follows = np.zeros(len(starts), bool)
        follows[:-1] = (stops[1:] == stops[:-1]) & (row[1:] == row[:-1])
        yield names, lang, mix(span_hashes(data, starts, ends) + seeds[lang]), starts, ends, follows, data


_COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("c", pa.int64())])


def words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, word, h, c of frequent words; a row without word has the number of all words of its language."""

    @thrifty
    def tally(batches):
        held: dict = {}
        totals: dict = {}

        def rows():
            out = [(lang, None, 0, c) for lang, c in totals.items()] + [(lang, word, h, c) for h, (lang, word, c) in held.items()]
            held.clear()
            totals.clear()
            return arrow_batch(_COUNTED, *(zip(*out)))

        for b in batches:
            for names, lang, h, starts, ends, _, data in _words(b):
                raw = data.tobytes()
                for k, c in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
                    if c:
                        totals[names[k]] = totals.get(names[k], 0) + c
                found, at, count = np.unique(h.view(np.int64), return_index=True, return_counts=True)
                for x, k, c in zip(found.tolist(), at.tolist(), count.tolist()):
                    one = held.get(x)
                    if one:
                        one[2] += c
                    else:
                        held[x] = [names[lang[k]], raw[starts[k] : ends[k]].decode("utf-8", "replace"), c]
                if len(held) >= 250_000:
                    yield rows()
        if totals:
            yield rows()

    counted = _texts(docs).mapInArrow(tally, "lang string, word string, h long, c long").groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("c").alias("c"))
    return written(counted.where(F.col("word").isNull() | (F.col("c") >= least)), "words")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


# ---------------------------------------------------------------- phrases
def key_of(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """64 bits of the words' hashes."""
    x = np.full(len(parts[0]), _U(0x2545F4914F6CDD1D + seed))
    for p in parts:
        x = mix(x * _U(0xD6E8FEB86659FD93) + p)
    return x


class BitFilter:
    """Which keys may be frequent: two bits of each frequent one are set."""

    def __init__(self, packed: np.ndarray):
        self.packed, self.mask = packed, _U(8 * len(packed) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for turn in (0, 32):
            at = (keys >> _U(turn)) & self.mask
            out &= (self.packed[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 > 0
        return out


def bit_filter(keys: DataFrame) -> BitFilter:
    """The filter of the long column ``key``: the bits are set where the keys are, the driver gets 16 MB of them at most."""
    n = max(1, keys.count())
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    at = keys.select(F.explode(F.array(F.expr(f"key & {bits - 1}L"), F.expr(f"shiftrightunsigned(key, 32) & {bits - 1}L"))).alias("at"))
    maps = at.groupBy(F.expr("at div 32768").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bits"))
    packed = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():
        packed[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return BitFilter(packed)


_TALLY = "block int, n int, keys binary, counts binary"
_TALLY_ARROW = pa.schema([("block", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def tallies(docs: DataFrame, size: int, shorter: BitFilter, n_blocks: int) -> DataFrame:
    """Each mapper's phrases of ``size`` words whose parts may be frequent: for each block their keys (``size`` hashes) and counts."""

    def summed(parts: list[np.ndarray]):
        key = key_of(parts)
        order = np.argsort(key)
        key, parts = key[order], [p[order] for p in parts]
        new = np.ones(len(key), bool)
        new[1:] = np.any([p[1:] != p[:-1] for p in parts], axis=0)
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(key))).astype("<u4")
        block = (((key[at] >> _U(32)) * _U(n_blocks)) >> _U(32)).astype(np.int32)
        keys = np.stack([p[at] for p in parts], axis=1)
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        return arrow_batch(_TALLY_ARROW, *zip(*((int(block[a]), b - a, keys[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts, cuts[1:]))))

    @thrifty
    def tally(batches):
        held, n = [], 0
        for b in batches:
            for _, _, h, _, _, follows, _ in _words(b):
                fits = shorter(h) if size == 2 else shorter(key_of([h[:-1], h[1:]]))
                last = len(h) - size + 1
                if last <= 0:
                    continue
                ok = np.ones(last, bool)
                for k in range(size - 1):
                    ok &= follows[k : k + last]
                for k in range(2):
                    ok &= fits[k : k + last]
                at = np.flatnonzero(ok)
                if len(at):
                    held.append([h[at + k] for k in range(size)])
                    n += len(at)
                if n >= RUN:
                    yield summed([np.concatenate(x) for x in zip(*held)])
                    held, n = [], 0
        if n:
            yield summed([np.concatenate(x) for x in zip(*held)])

    return _texts(docs).mapInArrow(tally, _TALLY)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: levels of places that one key alone has, numbered through."""

    def __init__(self, keys: np.ndarray):
        self.levels, base = [], 0
        while len(keys):
            size = max(64, 2 * len(keys))
            at = self._at(keys, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            keys = keys[~alone[at]]

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + _U(level * 0x9E3779B9 + 1)) % _U(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots; keys that the hash wasn't made of get any slot or -1."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, alone, slot) in enumerate(self.levels):
            at = self._at(keys[todo], level, size)
            hit = alone[at]
            out[todo[hit]] = slot[at[hit]]
            todo = todo[~hit]
        return out


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    while len(arrays) > 1:
        arrays = [a + b for a, b in zip(arrays[::2], arrays[1::2])] + arrays[len(arrays) & ~1 :]
    return arrays[0]


def count_block(shares: list[tuple[np.ndarray, np.ndarray]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (rows of hashes) that reach ``least`` and their counts, from mappers' (keys, counts)."""
    size, total = shares[0][0].shape[1], sum(len(c) for _, c in shares)
    n_buckets = 1 << max(6, total.bit_length())
    bucket = lambda k: (key_of(list(k.T)) & _U(n_buckets - 1)).astype(np.int64)
    full = np.zeros(n_buckets, np.int64)
    for keys, counts in shares:
        full += np.bincount(bucket(keys), weights=counts, minlength=n_buckets).astype(np.int64)
    full = full >= least
    shares = [(keys[keep], counts[keep]) for keys, counts in shares for keep in [full[bucket(keys)]]]
    candidates = np.concatenate([k for k, _ in shares])
    if not len(candidates):
        return np.zeros((0, size), np.uint64), np.zeros(0, np.int64)
    candidates = candidates[np.lexsort(candidates.T)]
    candidates = candidates[np.concatenate([[True], np.any(candidates[1:] != candidates[:-1], axis=1)])]
    seed = 1  # of another hash if two keys have the same 64 bits
    while len(np.unique(key_of(list(candidates.T), seed))) < len(candidates):
        seed += 1
    hashed = PerfectHash(key_of(list(candidates.T), seed))
    stored = np.empty_like(candidates)
    stored[hashed(key_of(list(candidates.T), seed))] = candidates

    def counted(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slot = hashed(key_of(list(keys.T), seed))
        own = (slot >= 0) & (stored[slot] == keys).all(axis=1)
        return np.bincount(slot[own], weights=counts[own], minlength=len(stored)).astype(np.int64)

    sums = tree_sum([counted(k, c) for k, c in shares])
    keep = sums >= least
    return stored[keep], sums[keep]


def frequent(docs: DataFrame, size: int, shorter: BitFilter, n_blocks: int, least: int) -> DataFrame:
    """h1, .., a of the phrases of ``size`` words found ``least`` times or more."""
    names = [f"h{k + 1}" for k in range(size)]
    schema = pa.schema([(x, pa.int64()) for x in [*names, "a"]])

    def count(table: pa.Table) -> pa.Table:
        shares = [(np.frombuffer(k, np.uint64).reshape(n, size), np.frombuffer(c, "<u4")) for n, k, c in zip(*(table.column(x).to_pylist() for x in ("n", "keys", "counts")))]
        keys, sums = count_block(shares, least)
        return pa.table([*(pa.array(np.ascontiguousarray(keys[:, k]).view(np.int64)) for k in range(size)), pa.array(sums, pa.int64())], schema=schema)

    found = tallies(docs, size, shorter, n_blocks).groupBy("block").applyInArrow(count, ", ".join(f"{x} long" for x in [*names, "a"]))
    return written(found, f"phrases-{size}")


def _bigram_key(two: DataFrame) -> DataFrame:
    """``key`` as the mappers compute it."""

    def keys(batches):
        for b in batches:
            parts = [b.column(k).to_numpy().view(np.uint64) for k in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(key_of(parts).view(np.int64))], names=["key"])

    return two.select("h1", "h2").mapInArrow(keys, "key long")


# ---------------------------------------------------------------- scores
def scored(two: DataFrame, three: DataFrame, found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one swallows."""
    w = lambda k: found.select(F.col("h").alias(f"h{k}"), F.col("word").alias(f"w{k}"), F.col("c").alias(f"c{k}"))
    pair = lambda a, b, name: two.select(F.col("h1").alias(f"h{a}"), F.col("h2").alias(f"h{b}"), F.col("a").alias(name))
    score = lambda left, right: F.expr(f"cast(1000000 * cast(a as decimal(15)) * cast(a as decimal(15)) as decimal(38)) div (cast({left} as decimal(15)) * cast({right} as decimal(15)))")
    longer = three.select("h1", "h2", "a").unionByName(three.select(F.col("h2").alias("h1"), F.col("h3").alias("h2"), "a")).groupBy("h1", "h2").agg(F.max("a").alias("longer"))
    left = two.join(longer, ["h1", "h2"], "left").where(f"longer is null or 100 * longer < {SWALLOWED_PERCENT} * a").drop("longer")
    lang = found.select(F.col("h").alias("h1"), "lang")
    pairs = left.join(w(1), "h1").join(w(2), "h2").join(lang, "h1")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("c1").alias("l"), F.col("c2").alias("r"), score("c1", "c2").alias("score"))
    triples = three.join(pair(1, 2, "c12"), ["h1", "h2"]).join(pair(2, 3, "c23"), ["h2", "h3"]).join(w(1), "h1").join(w(2), "h2").join(w(3), "h3").join(lang, "h1")
    triples = triples.withColumn("early", score("c1", "c23")).withColumn("late", score("c12", "c3"))
    cut = lambda a, b: F.when(F.col("early") <= F.col("late"), F.col(a)).otherwise(F.col(b))
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", cut("c1", "c12").alias("l"), cut("c23", "c3").alias("r"), cut("early", "late").alias("score"))
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 and 3 words of every language."""
    known = words(docs, least)
    totals, found = known.where("word is null").select("lang", F.col("c").alias("n")), known.where("word is not null")
    total = found.agg(F.count("*"), F.count_distinct("h")).first()
    if total[0] != total[1]:
        raise ValueError("two frequent words have the same 64-bit hash")
    n_blocks = max(1, -(-int(totals.agg(F.sum("n")).first()[0] or 0) // BLOCK))
    two = frequent(docs, 2, bit_filter(found.select(F.col("h").alias("key"))), n_blocks, least)
    three = frequent(docs, 3, bit_filter(_bigram_key(two)), n_blocks, least)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = scored(two, three, found).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(f"rank <= {top}")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"rank <= {top}")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
