"""Channels of recalled items: caps, quotas, fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators.vector import greedy_dedup

#: Most items of a source; profile items have no cap.
CAPS = {"projectMemory": 6, "userMemory": 6, "chunk": 4}


def capped(items: DataFrame, caps: dict[str, int] = CAPS) -> DataFrame:
    """Items (request_id, source, position) up to each source's cap; ``over`` tells what was cut and at which rank."""
    cap = F.lit(1 << 30)
    for s, n in caps.items():
        cap = F.when(F.col("source") == s, n).otherwise(cap)
    rank = F.row_number().over(Window.partitionBy("request_id", "source").orderBy("position", "ordinal"))
    return items.withColumn("source_rank", rank).withColumn("over", F.col("source_rank") > cap)


def quota(core: DataFrame, graph: DataFrame, most: int = 5) -> DataFrame:
    """Twice ``most`` core items, then a third of ``most`` from the entity graph."""
    w = Window.partitionBy("request_id").orderBy("ordinal")
    pick = lambda df, n: df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
    return pick(core, 2 * most).unionByName(pick(graph, max(1, (most + 2) // 3)))


def first_seen(items: DataFrame, key: list[str], order: str = "ordinal") -> DataFrame:
    return items.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__r = 1").drop("__r")


def fused(items: DataFrame, threshold: float = 0.85, caps: dict[str, int] = CAPS) -> DataFrame:
    """request_id, ordinal, source, content, position: memories equal to a profile item go first, then near ones of lower priority, then what is over a cap."""
    text = F.trim("content")
    profile = items.where("source = 'profile'").select("request_id", text.alias("t")).distinct()
    memory = items.where("source != 'profile'").withColumn("t", text).join(profile, ["request_id", "t"], "left_anti").drop("t")
    pool = items.where("source = 'profile'").unionByName(memory)
    near = greedy_dedup(pool.select("request_id", "ordinal", "source", "priority", "embedding"), threshold).where("kept")
    out = pool.drop("position").join(near.select("request_id", "ordinal", "position"), ["request_id", "ordinal"])
    return capped(out, caps).where("not over").select("request_id", "ordinal", "source", "content", "position")


def hybrid(memories: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """Two ranked lists of each query by similarity (to 9 places); memories first at ties."""
    both = memories.withColumn("source_rank", F.lit(0)).unionByName(chunks.withColumn("source_rank", F.lit(1)))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "source_rank", "id")
    return both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
