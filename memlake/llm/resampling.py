"""Quality classifier by importance resampling.

Two bags of hashed n-grams (words, word pairs, raw tokens with their marks) are
generative models of the target (labelled good and not toxic) and of the raw
corpus. A document's weight is the sum of its n-grams' log ratios, each smoothed
by a Gamma prior so that n-grams the sample is too small to judge weigh nothing.
Gumbel noise on these log weights makes the k largest keys a sample without
replacement in proportion to the weights (nothing is tempered). k is a parameter;
without one it is the number of documents above the cut that parts labelled good
from labelled bad best while it keeps most good ones, whatever their share.

Scale: raw counts cover all documents in fixed-size arrays (3 * 2**20 numbers),
summed by Spark; only ratios that are not 0 come to the driver. Target counts come from at most ``MOST_LABELLED`` labelled rows
(those of smallest hash; a documented bound). Labelled documents are weighed with
counts from the other half of the labels. The k-th key is found by histograms.

Defined cases: null or empty text: weight 0. Null ids are unlabelled and get
noise of their text. Without labels, or with one kind only, all are kept. Ties
of keys are kept together. Rows of one id share its noise. An empty table gives no
rows. Extra columns are ignored (``kept`` keeps them), whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import ALNUM, arrow_batch, blocks, distinct, few_rows, mix, sent, SPACED, thrifty, word_hashes, written

BITS = 20
SLOTS = 3 << BITS
MOST_LABELLED = 20_000
PRIOR = 2.0
SHRINK = 3.0
#: Of the labelled good documents, k leaves room for so many at least.
LEAST_KEPT = 0.97
SEED = 7
_CHUNK = 1 << 13


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each row's distinct n-grams, and their rows."""
    h, first = word_hashes(data, bounds, ALNUM, lower=True)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = row[1:] == row[:-1]
    g = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])[pair]
    s, sfirst = word_hashes(data, bounds, SPACED, lower=True)
    srow = np.repeat(np.arange(len(sfirst) - 1), np.diff(sfirst))
    shift = np.uint64(64 - BITS)
    slots = np.concatenate([(h >> shift).astype(np.int64), (g >> shift).astype(np.int64) + (1 << BITS), (mix(s) >> shift).astype(np.int64) + (2 << BITS)])
    at = distinct(np.concatenate([row, row[1:][pair], srow]) * SLOTS + slots)
    return at % SLOTS, at // SLOTS


def labelled_sample(labels: DataFrame, most: int = MOST_LABELLED) -> dict[int, tuple[bool, int]]:
    """doc_id -> (good, half) of at most ``most`` labelled documents."""
    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.expr("coalesce(q = 1, false) and coalesce(t = 0, true)").alias("good")).toArrow()
    return {d: (g, k % 2) for k, (d, g) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))}


def log_ratios(raw: np.ndarray, target: np.ndarray, share: float) -> np.ndarray:
    """log of target over raw probability by slot, shrunk to 0 where it is within ``SHRINK`` standard errors (of square roots, which lean to neither side); share: target documents of all."""
    expected = raw * share
    w = np.log((target + PRIOR) / (expected + PRIOR))
    errors = np.abs(2 * (np.sqrt(target + 0.375) - np.sqrt(expected + 0.375)))
    return (w * np.maximum(0, 1 - SHRINK / np.maximum(errors, SHRINK))).astype(np.float32)


def ratio_tables(docs: DataFrame, sample: dict, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots whose ratio is not 0, and two ratios of each: for labelled documents of the first and of the second half, by the other's target counts. Counts are summed and compared in the tasks; what comes to the driver is bounded by the slots."""
    known = docs.sparkSession.sparkContext.broadcast(sample)
    good = [sum(g and h == half for g, h in sample.values()) for half in (0, 1)]

    @thrifty
    def count(batches):
        total = np.zeros((3, SLOTS), np.int32)
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, data, bounds in blocks(b.column(1)):
                slots, row = features(data, bounds)
                np.add.at(total[0], slots, 1)
                target = [known.value.get(d, (False, 0)) for d in ids[i:j]]
                for half in (0, 1):
                    pick = np.array([g and h == half for g, h in target], bool)
                    if pick.any():
                        np.add.at(total[1 + half], slots[pick[row]], 1)
        for k in range(0, SLOTS, _CHUNK):
            part = total[:, k : k + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "v": pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())})

    @thrifty
    def compare(batches):
        out = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                a = np.frombuffer(zlib.decompress(v), np.int32)
                out[k] = out[k] + a if k in out else a
        for k, a in out.items():
            raw, one, two = a.reshape(3, _CHUNK)
            w = np.stack([log_ratios(raw, two, good[1] / n), log_ratios(raw, one, good[0] / n)])
            at = np.flatnonzero(w.any(axis=0))
            if len(at):
                yield pa.RecordBatch.from_pydict({"slots": pa.array([(k + at).astype(np.int32).tobytes()], pa.binary()), "w": pa.array([np.ascontiguousarray(w[:, at].T).tobytes()], pa.binary())})

    counted = docs.select("doc_id", "text").mapInArrow(count, "k long, v binary").repartition(64, "k")
    found = counted.mapInArrow(compare, "slots binary, w binary").toArrow()
    known.destroy()
    read = lambda c, t: np.concatenate([np.zeros(0, t), *(np.frombuffer(v.as_buffer(), t) for v in found.column(c))])
    return read(0, np.int32), read(1, np.float32).reshape(-1, 2)


def importance(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict]:
    """A written table (doc_id, weight, gumbel_key, row hash) and the sample. ``weight`` is the log of the importance."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text"))
    sample = labelled_sample(labels)
    slots, w = ratio_tables(docs, sample, max(1, docs.count())) if any(g for g, _ in sample.values()) else (np.zeros(0, np.int32), np.zeros((0, 2), np.float32))
    shared = docs.sparkSession.sparkContext.broadcast((sample, slots, w))
    schema = pa.schema([("doc_id", pa.int64()), ("weight", pa.float64()), ("noise", pa.int64()), ("h", pa.int64())])

    @thrifty
    def weigh(batches):
        known, slots_, w_ = shared.value
        table = np.zeros((3, SLOTS), np.float32)
        table[:2, slots_] = w_.T
        table[2] = table[:2].mean(axis=0)  # documents without label: of the same scale as those that choose the cut
        for b in few_rows(batches):
            ids = b.column(0).to_pylist()
            for i, j, data, bounds in blocks(b.column(1)):
                slots, row = features(data, bounds)
                which = np.array([known[d][1] if d in known else 2 for d in ids[i:j]])
                weight = np.bincount(row, table[which[row], slots], minlength=j - i)
                h = [hash_text(data[bounds[r] : bounds[r + 1]]) if ids[i + r] is None else ids[i + r] for r in range(j - i)]
                yield arrow_batch(schema, ids[i:j], weight, h, b.column(2).slice(i, j - i))

    rows = docs.mapInArrow(weigh, "doc_id long, weight double, noise long, h long")
    u = (F.pmod(F.xxhash64(F.lit(SEED), "noise"), F.lit(1 << 53).cast("long")) + 0.5) / float(1 << 53)
    out = written(rows.select("doc_id", "weight", (F.col("weight") - F.log(-F.log(u))).alias("gumbel_key"), "h"), "weights")
    shared.destroy()
    return out, sample


def hash_text(data: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data.tobytes()) >> 1


def best_cut(good: np.ndarray, bad: np.ndarray, least_kept: float = LEAST_KEPT) -> float:
    """The weight that parts good from bad with most balanced accuracy among those that keep ``least_kept`` of the good; midway in the gap."""
    if not len(good) or not len(bad):
        return -math.inf
    x = np.unique(np.concatenate([good, bad]))
    kept = 1 - np.searchsorted(np.sort(good), x) / len(good)
    ok = np.where(kept >= least_kept, kept + np.searchsorted(np.sort(bad), x) / len(bad), -1)
    k = int(np.argmax(ok))
    return float((x[k] + x[max(0, k - 1)]) / 2)


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 20_000) -> float:
    """The k-th largest value, by histograms that narrow until few values remain."""
    s = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, above = s.lo, s.hi, 0
    while True:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return hi
        part = df.where((F.col(column) >= lo) & (F.col(column) <= hi)).select(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("b"), column)
        found = part.groupBy("b").agg(F.count("*").alias("c"), F.min(column).alias("l"), F.max(column).alias("h")).orderBy(F.desc("b")).collect()
        for r in found:
            if above + r.c >= k:
                break
            above += r.c
        lo, hi = r.l, r.h
        if r.c <= few:
            rows = df.where((F.col(column) >= lo) & (F.col(column) <= hi)).select(column).collect()
            return sorted((x[0] for x in rows), reverse=True)[k - above - 1]


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, weight, gumbel_key, kept: one row for each of docs. ``k``: how many to sample; without it as many as lie above the cut."""
    return _resampled(docs, labels, k).drop("h")


def _resampled(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    rows, sample = importance(docs, labels)
    if k is None:
        # one weight for each labelled id, whatever its rows: as many numbers as labels at most
        judged = docs.sparkSession.createDataFrame([(d, g) for d, (g, _) in sample.items()] or [], "doc_id long, good boolean")
        seen = rows.join(F.broadcast(judged), "doc_id").groupBy("doc_id", "good").agg(F.min("weight").alias("weight")).toArrow()
        good, weight = seen.column("good").to_numpy().astype(bool), seen.column("weight").to_numpy()
        k = rows.where(F.col("weight") >= best_cut(weight[good], weight[~good])).count()
    least = kth_largest(rows, "gumbel_key", k) if k else math.inf
    return rows.withColumn("kept", F.col("gumbel_key") >= least)


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled rows of ``docs``, with its own columns only. Rows of one id fall together, those without one by their text."""
    out = sent(_resampled(docs, labels).where("not kept").select(F.col("doc_id").alias("__d"), F.expr("if(doc_id is null, h, 0)").alias("__h")).distinct(), "rejected")
    d = docs["doc_id"].cast("long")
    h = F.when(d.isNull(), F.xxhash64(docs["text"].cast("string"))).otherwise(F.lit(0))
    return docs.join(out, d.eqNullSafe(out["__d"]) & (h == out["__h"]), "left_anti").select(docs.columns)
