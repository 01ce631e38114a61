"""An LRU cache with expiry over a log of accesses: what each access finds, and what it drives out.

An access that misses stores its key. So the cache holds the ``capacity`` keys that were
accessed last, whatever they found: which keys these are at any point follows from
each key's last access before it. The log is cut into blocks in its order; each block's
last accesses, at most ``capacity`` of them, are merged with those of the blocks
before in steps of 1, 2, 4, ... blocks, and every block is then played from the state
it begins with. An entry expires ``ttl`` seconds after it was stored, however often it
was found since; that is settled key by key.

Scale: no step holds more than a block and ``capacity`` keys; merging takes as many
steps as the number of blocks has binary digits. A key's accesses are read in order
by one task that remembers one time stamp, so a hot key is streamed, not gathered.

Defined cases: equal ``seq`` are ordered by key; a null key is never stored and never
found; an empty log gives no rows.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.shared import stored

CAPACITY = 1000
TTL_SECONDS = 3600
BLOCK = 100_000


def _latest(entries: DataFrame, capacity: int) -> DataFrame:
    """The last ``capacity`` keys of each block: block, key, seq."""
    last = entries.groupBy("block", "key").agg(F.max("seq").alias("seq"))
    w = Window.partitionBy("block").orderBy(F.desc("seq"), F.desc("key"))
    return last.withColumn("r", F.row_number().over(w)).where(F.col("r") <= capacity).drop("r")


def _beginnings(log: DataFrame, blocks: int, capacity: int) -> DataFrame:
    """What the cache holds when a block begins."""
    state, step = stored(_latest(log, capacity), "cache"), 1
    while step < blocks:
        moved = state.withColumn("block", F.col("block") + step).where(F.col("block") < blocks)
        state = stored(_latest(state.unionByName(moved), capacity), "cache")
        step *= 2
    return state.withColumn("block", F.col("block") + 1).where(F.col("block") < blocks)


def played(accesses: pd.DataFrame, held: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """One block: whether each access finds its key in the cache, and which key it drives out."""
    order = held.sort_values(["seq", "key"])
    cache = OrderedDict.fromkeys(order["key"])
    rows = accesses.sort_values(["seq", "key"]).reset_index(drop=True)
    present, evicted = [], []
    for key in rows["key"]:
        out = None
        if key in cache:
            cache.move_to_end(key)
            present.append(True)
        else:
            if len(cache) >= capacity:
                out = cache.popitem(last=False)[0]
            cache[key] = None
            present.append(False)
        evicted.append(out)
    return rows.assign(present=present, evicted=pd.array(evicted, dtype=object))[["seq", "key", "ts", "present", "evicted"]]


def _expiry(batches: Iterator[pd.DataFrame], ttl: int) -> Iterator[pd.DataFrame]:
    """Accesses in the order of their keys: an entry that is present but too old is a miss, and stored anew."""
    last, since = None, None
    for b in batches:
        outcome = []
        for key, ts, present in zip(b["key"], b["ts"], b["present"]):
            if key == last and present and (ts - since).total_seconds() <= ttl:
                outcome.append("hit")
                continue
            outcome.append("expired" if key == last and present else "absent")
            last, since = key, ts
        yield b.assign(outcome=outcome)[["seq", "key", "outcome", "evicted"]]


def lru(log: DataFrame, capacity: int = CAPACITY, ttl: int = TTL_SECONDS, block: int = BLOCK) -> DataFrame:
    """seq, key, outcome (hit, expired or absent), evicted from a log (seq, key, ts)."""
    log = log.where("key is not null").select(F.col("seq").cast("long").alias("seq"), F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    blocks = max(1, -(-log.count() // block))
    log = stored(log.repartitionByRange(blocks, "seq").withColumn("block", F.spark_partition_id()), "cache-log")
    held = _beginnings(log, blocks, capacity).select("block", F.col("key").alias("held"), F.col("seq").alias("at"))

    def play(accesses: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return played(accesses, before.rename(columns={"held": "key", "at": "seq"}), capacity)

    found = log.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(play, "seq long, key string, ts timestamp, present boolean, evicted string")
    ordered = found.repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInPandas(lambda batches: _expiry(batches, ttl), "seq long, key string, outcome string, evicted string")


def statistics(outcomes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """hits, misses, total_requests, hit_rate, evictions, size of the whole log."""
    n = lambda c, name: F.count_if(c).alias(name)
    g = outcomes.agg(n(F.col("outcome") == "hit", "hits"), n(F.col("outcome") != "hit", "misses"), F.count("*").alias("total_requests"), F.count("evicted").alias("evictions"), n(F.col("outcome") == "absent", "__in"))
    rate = F.when(F.col("total_requests") > 0, F.col("hits") / F.col("total_requests")).otherwise(F.lit(0.0))
    return g.select("hits", "misses", "total_requests", rate.alias("hit_rate"), "evictions", (F.col("__in") - F.col("evictions")).alias("size"))
