"""Shared folders, byte-level text vectors and Arrow helpers of the operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, named in ``spark.checkpoint.dir``.

    Only where that is unset in a local run (tests) a temporary folder takes its place;
    on a cluster a folder of the driver's machine would be lost to the executors.
    """
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError(f"{KEY} has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="memlake-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set(KEY, found)
    return found


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what follows survives lost executors without recomputing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/memlake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that say which documents go, for which no text is shuffled: some 100 MB where they are sent at most.
MOST_SENT = 1_000_000


def sent(df: DataFrame, name: str) -> DataFrame:
    """A written table of ids for a join with texts: sent to all tasks if it is short, joined by a shuffle if it isn't."""
    df = written(df, name)
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the quick way."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# ---------------------------------------------------------------- text as vectors
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes: all but ASCII white space (as bytes.split() sees it).
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes: digits, letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: For bytes.translate(): lower-cased word bytes, all others a space.
ALNUM_TABLE = bytes(int(_LOWER[b]) if ALNUM[b] else 32 for b in range(256))

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, to n."""
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, 1 << 16)
        p, q = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 1 << 64)))
        p[0] = q[0] = 1
        _pow, _inv = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 bounds of its rows; nulls are empty."""
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(col: pa.Array, most: int = 1 << 20):
    """The rows of a column as (first row, end row, bytes, bounds), some 1 MB at once; a longer text comes alone, whole."""
    data, bounds = text_bytes(col)
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each row the index of its first word (n+1 of them)."""
    n = len(data)
    w = np.zeros(n + 2, bool)
    w[1:-1] = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(w[1:] & (~w[:-1] | cut))
    ends = np.flatnonzero(w[:-1] & (~w[1:] | cut))
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (equal in all processes) and each row's first word."""
    if lower:
        data = _LOWER[data]
    starts, ends, first = word_spans(data, bounds, is_word)
    return span_hashes(data, starts, ends), first


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal in all processes."""
    p, q = _powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * p[: len(data)], out=s[1:])
    return mix((s[ends] - s[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside a row, and each row's first; a row of fewer words has its whole sequence as one."""
    s = h[: max(0, len(h) - n + 1)].copy()
    for k in range(1, n):
        s = mix(s * _U(0xD6E8FEB86659FD93) + h[k : k + len(s)])
    words = np.diff(first)
    count = np.where(words >= n, words - n + 1, (words > 0).astype(np.int64))
    out_first = np.concatenate([[0], np.cumsum(count)])
    long_rows = np.flatnonzero(words >= n)
    if len(long_rows) == len(words):
        keep = np.ones(len(s), bool)
        for k in range(1, n):
            at = first[1:-1] - k
            keep[at[(at >= 0) & (at < len(s))]] = False
        return s[keep], out_first
    out = np.empty(out_first[-1], np.uint64)
    for r in range(len(words)):
        a, b = out_first[r], out_first[r + 1]
        if words[r] >= n:
            out[a:b] = s[first[r] : first[r] + b - a]
        elif words[r]:
            x = _U(words[r])
            with np.errstate(over="ignore"):
                for y in h[first[r] : first[r + 1]]:
                    x = mix(np.asarray([x * _U(0xD6E8FEB86659FD93) + y]))[0]
            out[a] = x
    return out, out_first


def hand_back() -> None:
    """Freed memory of this worker back to the machine: it may wait, idle, beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def few_rows(batches, most: int = 1000):
    """Batches in parts of ``most`` rows, which share the batch's buffers: what is derived from a part is short-lived."""
    for b in batches:
        for lo in range(0, b.num_rows, most):
            yield b.slice(lo, most)


def thrifty(task, every: float = 1.0):
    """A task over batches that hands freed memory back at its end, and each ``every`` seconds until then."""

    @functools.wraps(task)
    def run(batches):
        last = time.monotonic()
        try:
            for out in task(batches):
                yield out
                del out
                if time.monotonic() - last > every:
                    hand_back()
                    last = time.monotonic()
        finally:
            hand_back()

    return run


def arrow_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)
