"""Language-model scoring by context-tree weighting over bytes.

Each byte of a lower-cased text is coded as eight binary decisions. At every
decision, and for every depth 0..D of the preceding bytes, a node holds how often
bit 0 and bit 1 followed in the training texts. A node's estimate is that of
Krichevsky and Trofimov; the weighted probability of a node is half its own and
half the product of its children's, from the deepest up, and the posterior share
of a node's own estimate is its weight in the mixture. The code length of a text
is the sum over its bytes and one end byte.

Scale: n-grams of D+1 bytes and words are counted over all texts where they lie,
summed by shuffling, and written; no n-gram, context or word is left out. The tree
is never in one place: n-grams are dealt by their last ``TOP`` bytes of context, and
each task weighs the subtrees below its contexts from the leaves up. Only nodes of
depth below ``TOP`` meet on the driver: at most 256 ** (TOP - 1) * 255, a bound by
the alphabet and not by the corpus. A second pass goes down the same subtrees and
writes each n-gram's log probability. Texts lie in chunks; a join brings each chunk
the values of its own n-grams and words, so nothing that grows with the corpus is
broadcast or collected. A context never met in training passes on its parent's estimate.

On few texts the tree knows too little: words seen once are hardly likelier than
noise. So ``mixed_score`` sums over words the even mixture of the tree (the word with
the separators after it; the first one with those before it, the last one with the
end) and the smoothed word frequency of ``base_score``, and the text's own is the even
mixture of that sum and ``base_score``: at most log10(2) below the latter. As there,
all words that training never met are one event, of which the tree's spelling of one
word is only a part. ``score`` is that of the tree alone.

Defined cases: null or empty text: only the end is scored. Documents are in
training unless the CRC of their id as text, modulo 7, is 2; null ids count as
"". An empty corpus scores by estimates without counts. Repeated rows count
each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import _LOWER, SPACED, arrow_batch, blocks, span_hashes, word_spans, word_hashes, written

DEPTH = 5
TOP = 3
CHUNK_BYTES = 16 << 20
_MERGE = 1 << 20
_SLICE = 1 << 18
FOLDS, HELD_OUT = 7, 2
END = 0
_U = np.uint64


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def byte_grams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each byte and end of each row: the byte below, the DEPTH bytes before it above (END where a row begins)."""
    n = len(bounds) - 1
    at = bounds[:-1] + np.arange(n) * (DEPTH + 1) + DEPTH  # DEPTH ends before each row, one after it
    out = np.zeros(len(data) + n * (DEPTH + 1), np.uint64)
    lengths = np.diff(bounds)
    where = np.arange(len(data)) + np.repeat(at - bounds[:-1], lengths)
    out[where] = _LOWER[data]
    g = out.copy()
    for k in range(1, DEPTH + 1):
        g[k:] |= out[:-k] << _U(8 * k)
    use = np.ones(len(out), bool)
    for k in range(DEPTH):
        use[at - DEPTH + k] = False
    return g[use]


class _Tally:
    """Counts of n-grams or words; those met with weight 0 only are kept too."""

    def __init__(self):
        self.raw, self.size, self.keys, self.n = [], 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, grams: np.ndarray, learn: bool) -> None:
        self.raw.append((grams, learn))
        self.size += len(grams)
        if self.size >= _MERGE:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, n = [self.keys], [self.n]
        for learn in (True, False):
            if part := [pa.array(g) for g, which in self.raw if which == learn and len(g)]:
                got = pa.chunked_array(part).value_counts()
                keys.append(got.field(0).to_numpy())
                n.append(got.field(1).to_numpy() * learn)
        self.raw, self.size = [], 0
        self.keys, back = np.unique(np.concatenate(keys), return_inverse=True)
        self.n = np.bincount(back, np.concatenate(n), minlength=len(self.keys)).astype(np.int64)
        return self.keys, self.n


def _counts(docs: DataFrame) -> DataFrame:
    """(kind, chunk, key, n): byte n-grams (kind 0) and words (kind 1) of each chunk with their counts in its training texts."""
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("key", pa.int64()), ("n", pa.int64())])

    def batch(kind, chunk, keys, n):
        size = len(keys)
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, chunk, np.int64)), pa.array(np.ascontiguousarray(keys).view(np.int64)), pa.array(np.asarray(n, np.int64))], schema=schema)

    def flush(chunk, *tallies):
        for kind, tally in enumerate(tallies):
            keys, n = tally.merge()
            if len(keys):
                yield batch(kind, chunk, keys, n)
        pa.default_memory_pool().release_unused()

    def count(batches):
        now, grams, words = None, _Tally(), _Tally()
        for b in batches:
            chunk = b.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if chunk[lo] != now:
                    yield from flush(now, grams, words)
                    now, grams, words = chunk[lo], _Tally(), _Tally()
                part = b.slice(lo, hi - lo)
                ids = part.column(0).to_pylist()
                for i, j, data, bounds in blocks(part.column(1)):
                    learn = np.array([not held_out(d) for d in ids[i:j]])
                    h, first = word_hashes(data, bounds, SPACED, lower=True)
                    for tally, keys, of in ((words, h, np.diff(first)), (grams, byte_grams(data, bounds), np.diff(bounds) + 1)):
                        of = np.repeat(learn, of)
                        tally.add(keys[of], True)
                        tally.add(keys[~of], False)
        yield from flush(now, grams, words)

    kept = docs.repartition("chunk").sortWithinPartitions("chunk").select("doc_id", "text", "chunk")
    return written(kept.mapInArrow(count, "kind int, chunk long, key long, n long"), "counts", "zstd")


# ---------------------------------------------------------------- the model
def _lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma by Stirling's series after a shift of 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def _kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def _nodes(grams: np.ndarray, n: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (context << 8 | prefix of the byte, from 1) of one bit's decisions, with their zeros and ones."""
    byte = (grams & _U(255)).astype(np.int64)
    k = ((grams >> _U(8)) << _U(8)) | ((1 << bit) | (byte >> (8 - bit))).astype(np.uint64)
    one = (byte >> (7 - bit)) & 1
    u, back = np.unique(k, return_inverse=True)
    return u, np.bincount(back, n * (1 - one), minlength=len(u)), np.bincount(back, n * one, minlength=len(u))


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _parents(k: np.ndarray, weighted: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> tuple:
    """Nodes of a depth, from all their children: sorted keys, the product of the children's probabilities (its log), zeros and ones."""
    u, back = np.unique((((k >> _U(8)) & _U((1 << (8 * depth)) - 1)) << _U(8)) | (k & _U(255)), return_inverse=True)
    return u, *(np.bincount(back, x, minlength=len(u)) for x in (weighted, a, b))


def _weighed(a: np.ndarray, b: np.ndarray, split: np.ndarray | None) -> tuple:
    """log weighted probability of nodes, the estimate of bit 1, and the weight of the own estimate."""
    own = _kt(a, b)
    one = ((b + 0.5) / (a + b + 1)).astype(np.float32)
    if split is None:
        return own, one, np.ones(len(a), np.float32)
    both = np.logaddexp(own, split) - math.log(2)
    return both, one, np.exp(own - math.log(2) - both).astype(np.float32)


def subtrees(grams: np.ndarray, n: np.ndarray, least: int = TOP) -> tuple[dict, list]:
    """levels[depth][bit] = (sorted node keys, estimate of bit 1, weight of the own estimate) for depths DEPTH to least, and for each bit the nodes of depth least - 1 as _parents() gives them."""
    met = n > 0
    grams, n = grams[met], n[met]
    levels: dict = {d: [None] * 8 for d in range(DEPTH, least - 1, -1)}
    above = []
    for bit in range(8):
        k, a, b = _nodes(grams, n, bit)
        split = None
        for d in range(DEPTH, least - 1, -1):
            weighted, one, share = _weighed(a, b, split)
            levels[d][bit] = (k, one, share)
            if d:
                k, split, a, b = _parents(k, weighted, a, b, d - 1)
        above.append((k, split, a, b))
    return levels, above


def crown(k: np.ndarray, split: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict:
    """levels[depth][bit] for depths TOP - 1 to 0, from the nodes of depth TOP - 1 of all bits."""
    levels: dict = {d: [None] * 8 for d in range(TOP)}
    bits = np.floor(np.log2((k & _U(255)).astype(float)))
    for bit in range(8):
        pick = np.flatnonzero(bits == bit)
        pick = pick[np.argsort(k[pick])]
        now = (k[pick], split[pick], a[pick], b[pick])
        for d in range(TOP - 1, -1, -1):
            weighted, one, share = _weighed(now[2], now[3], now[1])
            levels[d][bit] = (now[0], one, share)
            if d:
                now = _parents(now[0], weighted, now[2], now[3], d - 1)
    return levels


def log10_of(levels: dict, grams: np.ndarray) -> np.ndarray:
    """log10 probability of the byte of each n-gram after its context, mixed over all depths of levels."""
    byte = (grams & _U(255)).astype(np.int64)
    total = np.zeros(len(grams))
    for bit in range(8):
        prefix = ((1 << bit) | (byte >> (8 - bit))).astype(np.uint64)
        rest = np.ones(len(grams))  # share not yet given to an estimate
        p, last, open_ = np.zeros(len(grams)), np.full(len(grams), 0.5), np.ones(len(grams), bool)
        for d in range(DEPTH + 1):
            keys, one, share = levels[d][bit]
            ctx = (grams >> _U(8)) & _U((1 << (8 * d)) - 1)
            at, ok = _lookup(keys, (ctx << _U(8)) | prefix)
            ok &= open_
            if len(keys):
                w = np.where(ok, share[at], 0)
                p += rest * w * one[at]
                rest = rest * (1 - w)
                last = np.where(ok, one[at], last)
            open_ = ok
        p += rest * last
        # an estimate is kept in single precision, where a bit that never failed in many millions is 1
        total += np.log10(np.maximum(np.where((byte >> (7 - bit)) & 1 == 1, p, 1 - p), 1e-10))
    return total


def _even(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 of the even mixture of two probabilities given by theirs."""
    return np.logaddexp(a * math.log(10), b * math.log(10)) / math.log(10) - math.log10(2)


def mixed(tree: np.ndarray, bounds: np.ndarray, starts: np.ndarray, first: np.ndarray, words: np.ndarray, end: float) -> np.ndarray:
    """For each row the sum over its words of the even mixture of two log10 probabilities, the tree's (of each byte and end) and the word's own; a row without words is its end."""
    n = len(bounds) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    begins = starts + row  # each row before has an end besides its bytes
    some = np.flatnonzero(np.diff(first))
    begins[first[some]] = bounds[some] + some
    none = np.flatnonzero(np.diff(first) == 0)
    at = np.concatenate([begins, bounds[none] + none])
    own = np.concatenate([words, np.full(len(none), end)])
    own[first[some + 1] - 1] += end
    o = np.argsort(at)
    if not len(o):
        return np.zeros(n)
    return np.bincount(np.concatenate([row, none])[o], _even(np.add.reduceat(tree, at[o]), own[o]), minlength=n)


def _slices(batches, least: int):
    """(n-grams, counts) in runs of whole contexts of TOP bytes, of least rows or more, from rows sorted by them."""
    held, size, full = [], 0, least
    for batch in batches:
        held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size < full:
            continue
        g, n = (np.concatenate(x) for x in zip(*held))
        ctx = (g >> _U(8)) & _U((1 << (8 * TOP)) - 1)
        cut = int(np.searchsorted(ctx, ctx[-1]))
        if cut:
            yield g[:cut], n[:cut]
        held, size = [(g[cut:], n[cut:])], len(g) - cut
        full = max(least, 2 * size)
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _model(counts: DataFrame) -> DataFrame:
    """(gram, p): log10 probability of every n-gram of any text, trained or not."""
    spark = counts.sparkSession
    ctx = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * TOP)) - 1).cast("long"))
    # dealt by context before the sum: one shuffle serves both
    grams = counts.where("kind = 0").select("key", "n", ctx.alias("ctx")).repartition("ctx").groupBy("ctx", F.col("key").alias("gram")).agg(F.sum("n").alias("n"))
    # one row for each slice keeps the slices together when they are read again
    schema = pa.schema([("grams", pa.binary()), ("counts", pa.binary())])

    def cut(batches):
        for g, n in _slices(batches, _SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (g, n.astype(np.int64))], schema=schema)

    slices = written(grams.sortWithinPartitions("ctx").select("gram", "n").mapInArrow(cut, "grams binary, counts binary"), "subtrees", "zstd")

    def rows(batch):
        for g, n in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(g.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)

    up_schema = pa.schema([("key", pa.int64()), ("split", pa.float64()), ("a", pa.float64()), ("b", pa.float64())])

    def up(batches):
        for batch in batches:
            for g, n in rows(batch):
                for k, *rest in subtrees(g, n)[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *map(pa.array, rest)], schema=up_schema)

    top = slices.mapInArrow(up, "key long, split double, a double, b double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("split", "a", "b"))).toPandas()
    shared = spark.sparkContext.broadcast(crown(top["key"].to_numpy(np.int64).view(np.uint64), *(top[c].to_numpy(float) for c in ("split", "a", "b"))))
    out_schema = pa.schema([("gram", pa.int64()), ("p", pa.float32())])

    def down(batches):
        for batch in batches:
            for g, n in rows(batch):
                p = log10_of(shared.value | subtrees(g, n)[0], g)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(p, pa.float32())], schema=out_schema)

    return written(slices.mapInArrow(down, "gram long, p float"), "model", "zstd")


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, mixed_score double"


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, mixed_score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    chunks = max(1, -(-((total.b or 0) + 64 * total.n) // CHUNK_BYTES))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks).cast("long")))
    counts = _counts(docs)
    model = _model(counts)
    in_chunks = counts.where("kind = 1").select("chunk", "key", "n")
    words = written(in_chunks.groupBy("key").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    s = words.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = docs.select("doc_id").where(~_held(F.col("doc_id"))).count()
    n, v = (s.n or 0) + ends, s.v + (ends > 0)
    # what each chunk needs: the log probabilities of its n-grams (kind 0) and the counts of its words (kind 1)
    of_grams = _packed(counts.where("kind = 0").select("chunk", F.col("key").alias("gram")).join(model, "gram").select("chunk", "gram", "p"), 0, "float32")
    of_words = _packed(in_chunks.select("chunk", "key").join(words, "key").select("chunk", "key", "c"), 1, "int64")
    local = of_grams.unionByName(of_words)
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]]) for f in _OUT.split(", ")])

    def values(known, wanted):
        """What is known of the wanted keys, 0 for those that aren't there."""
        keys, v = known
        at = pc.index_in(pa.array(wanted), value_set=pa.array(keys)).fill_null(len(v)).to_numpy()
        return np.append(v, 0)[at].astype(float)

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        of_gram, of_word = _unpacked(known, 0, "float32"), _unpacked(known, 1, "int64")
        out = []
        for part in texts.to_batches():
            ids = part.column("doc_id").to_pylist()
            for i, j, data, bounds in blocks(part.column("text")):
                starts, stops, first = word_spans(data, bounds, SPACED)
                cw = values(of_word, span_hashes(_LOWER[data], starts, stops))
                row = np.repeat(np.arange(j - i), np.diff(first))
                base = np.bincount(row, np.log10(cw + 1.0), minlength=j - i)
                hit = np.bincount(row, cw > 0, minlength=j - i)
                tokens = np.diff(first) + 1
                lengths = np.diff(bounds) + 1
                p = values(of_gram, byte_grams(data, bounds))
                lm = np.bincount(np.repeat(np.arange(j - i), lengths), p, minlength=j - i)
                held = [held_out(d) for d in ids[i:j]]
                total = np.full(j - i, n)
                smallest = math.log10(n + v + 1.0)
                base = base + math.log10(ends + 1.0) - tokens * smallest
                both = _even(mixed(p, bounds, starts, first, np.log10(cw + 1.0) - smallest, math.log10(ends + 1.0) - smallest), base)
                out.append(arrow_batch(schema, ids[i:j], held, tokens, hit.astype(np.int64) + (ends > 0), total, base, lm, lengths, both))
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(out, schema)

    return docs.groupBy("chunk").cogroup(local.groupBy("chunk")).applyInArrow(score, _OUT)


def _packed(rows: DataFrame, kind: int, number: str) -> DataFrame:
    """(chunk, kind, keys, numbers): rows (chunk, key, number) with those of one chunk together, as far as a task has met them."""
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary())])

    def flush(held):
        chunk, keys, v = (np.concatenate(x) for x in zip(*held))
        o = np.argsort(chunk, kind="stable")
        chunk, keys, v = chunk[o], keys[o], v[o].astype(number)
        at = np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1))
        ends = np.append(at[1:], len(chunk))
        for lo in range(0, len(at), 4096):
            cut = list(zip(at[lo : lo + 4096], ends[lo : lo + 4096]))
            yield arrow_batch(schema, chunk[at[lo : lo + 4096]], np.full(len(cut), kind, np.int32), [keys[i:j].tobytes() for i, j in cut], [v[i:j].tobytes() for i, j in cut])

    def pack(batches):
        held, size = [], 0
        for b in batches:
            held.append(tuple(b.column(k).to_numpy() for k in range(3)))
            size += b.num_rows
            if size >= _MERGE // 2:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return rows.mapInArrow(pack, "chunk long, kind int, keys binary, numbers binary")


def _unpacked(known: pa.Table, kind: int, number: str) -> tuple[np.ndarray, np.ndarray]:
    part = known.filter(pc.equal(known.column("kind"), kind))
    read = lambda name, t: np.frombuffer(b"".join(part.column(name).to_pylist()), t)
    return read("keys", np.uint64), read("numbers", number)


def _held(doc_id):
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS)) == HELD_OUT
