"""The recall channels of many requests at once: memories and chunks, each with what was left out and why.

Memory channel: the nearest memories of the request's container, marked as unsure where
they are barely near enough and share no keyword with the question; memories that the
first three lead to; memories of the entities around these. Each arm adds only what the
ones before it didn't find; quotas end it. Chunk channel: the nearest chunks, and those
of entities that the question names, under a lower bar.

All arms are joins keyed by request; a request's lists are bounded by its limits before
they are ranked. Tables: requests (request_id, container, query, query_vec, sub_agent),
memories (id, container, content, vec, created_at, is_forgotten), relations (from_id,
to_id, type, ord), entities (id, name, container, mention_count), links (memory_id,
entity_id), entity_edges (from_id, to_id, confidence), excluded (request_id, id).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.functions.vectors import cosine
from memlake.operators import ann, graph
from memlake.operators.shared import stored


class Limits(NamedTuple):
    memories: int = 5
    memories_sub_agent: int = 3
    threshold: float = 0.40
    edge: float = 0.05
    hops_from: int = 3
    seeds: int = 5
    depth: int = 2
    nodes: int = 3
    chunks: int = 3
    chunks_sub_agent: int = 2
    chunk_threshold: float = 0.45
    entity_chunk_threshold: float = 0.30


def _most(sub_agent: Column, usual: int, few: int) -> Column:
    return F.when(sub_agent, F.least(F.lit(usual), F.lit(few))).otherwise(F.lit(usual))


def shares_keyword(a: Column, b: Column) -> Column:
    words = lambda c: F.transform(text.keywords(c), F.lower)
    return F.coalesce(F.arrays_overlap(words(a), words(b)), F.lit(False))


def _numbered(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)))


def vector_hits(requests: DataFrame, memories: DataFrame, excluded: DataFrame, p: Limits) -> DataFrame:
    """request_id, id, rank, similarity, low_confidence, reason: hits of a request, in order; excluded ones have a reason and no place."""
    live = memories.where(~F.coalesce("is_forgotten", F.lit(False)))
    q = requests.select(F.col("request_id").alias("query_id"), "query_vec", "container")
    found = ann.exact_top_k(q, live.select("id", "vec", "container"), p.memories, p.threshold, by=["container"]).select(F.col("query_id").alias("request_id"), "id", "similarity", "rank")
    found = found.join(requests.select("request_id", "query", "sub_agent"), "request_id").where(F.col("rank") <= _most(F.col("sub_agent"), p.memories, p.memories_sub_agent))
    found = found.join(live.select("id", "content"), "id").join(excluded.select("request_id", "id", F.lit("excluded").alias("reason")), ["request_id", "id"], "left")
    unsure = (F.col("similarity") < p.threshold + p.edge) & ~shares_keyword(F.col("query"), F.col("content"))
    return found.select("request_id", "id", "rank", "similarity", unsure.alias("low_confidence"), "reason")


def hops(hits: DataFrame, memories: DataFrame, relations: DataFrame, excluded: DataFrame, most: DataFrame, p: Limits) -> tuple[DataFrame, DataFrame]:
    """What the first hits lead to: new memories (request_id, id, at, relation_type, reason: budget or null), and the relation type that each known one gets."""
    first = _numbered(hits, "rank").where(F.col("n") <= p.hops_from)
    targets = first.select("request_id", F.col("id").alias("from_id"), "n").join(relations, "from_id").join(memories.where(~F.coalesce("is_forgotten", F.lit(False))).select(F.col("id").alias("to_id")), "to_id", "left_semi")
    reached = targets.groupBy("request_id", F.col("to_id").alias("id")).agg(F.min(F.struct("n", "ord", "type")).alias("at"))
    new = reached.join(hits.select("request_id", "id"), ["request_id", "id"], "left_anti").join(excluded.select("request_id", "id"), ["request_id", "id"], "left_anti")
    held = hits.groupBy("request_id").agg(F.count("*").alias("held"))
    new = _numbered(new.join(held, "request_id").join(most, "request_id"), "at.n", "at.ord", "id")
    room = 2 * F.col("most") - F.col("held")
    reason = F.when(F.col("n") > room, "budget")
    # relations are looked at until the budget is spent; what they meet of the hits by then gets its type from them
    full = new.where(F.col("n") == room).select("request_id", F.struct("at.n", "at.ord").alias("full"))
    known = reached.join(hits.select("request_id", "id"), ["request_id", "id"], "left_semi").join(full, "request_id", "left")
    known = known.where(F.col("full").isNull() | (F.struct("at.n", "at.ord") < F.col("full"))).select("request_id", "id", F.col("at.type").alias("relation_type"))
    return new.select("request_id", "id", F.col("n").alias("at"), F.col("at.type").alias("relation_type"), reason.alias("reason")), known


def entity_memories(held: DataFrame, requests: DataFrame, memories: DataFrame, entities: DataFrame, links: DataFrame, edges: DataFrame, most: DataFrame, p: Limits) -> DataFrame:
    """request_id, id, at: memories of the entities around the ones held, by how many of these entities they have, newest first; the first ``most`` of a request."""
    e = entities.withColumn("key", text.normalized_name(F.col("name")))
    met = held.join(links.withColumnRenamed("memory_id", "id").distinct(), "id").groupBy("request_id", "entity_id").agg(F.count("*").alias("together"))
    met = met.join(e.select(F.col("id").alias("entity_id"), "key", F.col("container").alias("of"), "mention_count"), "entity_id")
    best = Window.partitionBy("request_id", "of", "key").orderBy(F.desc("together"), F.desc("mention_count"), "entity_id")
    lone = met.withColumn("n", F.row_number().over(best)).where("n = 1")
    seeds = _numbered(lone.drop("n"), F.desc("together"), F.desc("mention_count"), "entity_id").where(F.col("n") <= p.seeds).select("request_id", "entity_id")
    around = graph.dfs_order(seeds.select(F.col("entity_id").alias("id")).distinct(), edges, p.depth, p.nodes).select(F.col("seed").alias("entity_id"), F.col("id").alias("near"))
    wanted = seeds.join(around, "entity_id").select("request_id", F.col("near").alias("id")).distinct().join(e.select("id", "key", "container"), "id")
    wanted = wanted.join(requests.select("request_id", F.col("container").alias("own")), "request_id").where("container = own").select("request_id", "container", "key").distinct()
    live = memories.where(~F.coalesce("is_forgotten", F.lit(False))).select(F.col("id").alias("memory_id"), "container", "created_at")
    family = e.select(F.col("id").alias("entity_id"), "container", "key")
    tagged = links.join(family, "entity_id").join(live, ["memory_id", "container"]).groupBy("memory_id", "container", "created_at").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    # memories of the same keys match every request alike: the newest of them come before the rest
    newest = Window.partitionBy("container", "keys").orderBy(F.desc("created_at"), "memory_id")
    kept = stored(tagged.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= p.memories).drop("r"), "tagged")
    sets = kept.select("container", "keys").distinct().withColumn("key", F.explode("keys"))
    met = wanted.join(sets, ["container", "key"]).groupBy("request_id", "container", "keys").agg(F.count("*").alias("match_count"))
    found = met.join(kept, ["container", "keys"]).select("request_id", F.col("memory_id").alias("id"), "created_at", "match_count")
    return _numbered(found.join(most, "request_id"), F.desc("match_count"), F.desc("created_at"), "id").where(F.col("n") <= F.col("most")).select("request_id", "id", F.col("n").alias("at"))


def memory_channel(requests: DataFrame, memories: DataFrame, relations: DataFrame, entities: DataFrame, links: DataFrame, entity_edges: DataFrame, excluded: DataFrame, p: Limits = Limits()) -> DataFrame:
    """request_id, id, channel (vector, memory_graph, entity_graph), at (place in its channel), similarity, relation_type, low_confidence, reason (null: taken; else excluded, budget, seen or quota)."""
    most = requests.select("request_id", _most(F.col("sub_agent"), p.memories, p.memories_sub_agent).alias("most"))
    # read by every arm below: written once
    all_hits = stored(vector_hits(requests, memories, excluded, p), "hits")
    hits = all_hits.where("reason is null")
    hopped, known = hops(hits, memories, relations, excluded, most, p)
    vector = _numbered(hits.join(known, ["request_id", "id"], "left"), "rank").select("request_id", "id", F.lit("vector").alias("channel"), F.col("n").alias("at"), "similarity", "relation_type", "low_confidence", "reason")
    gone = all_hits.where("reason is not null").select("request_id", "id", F.lit("vector").alias("channel"), F.lit(None).cast("int").alias("at"), "similarity", F.lit(None).cast("string").alias("relation_type"), "low_confidence", "reason")
    near = hopped.select("request_id", "id", F.lit("memory_graph").alias("channel"), "at", F.lit(None).cast("double").alias("similarity"), "relation_type", F.lit(False).alias("low_confidence"), "reason")
    vector, near = stored(vector, "vector"), stored(near, "hops")
    core = vector.unionByName(near.where("reason is null"))
    held = core.select("request_id", "id")
    around = entity_memories(held, requests, memories, entities, links, entity_edges, most, p)
    seen = held.unionByName(excluded.select("request_id", "id")).distinct().withColumn("seen", F.lit(True))
    around = around.join(seen, ["request_id", "id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False))).join(most, "request_id")
    place = F.row_number().over(Window.partitionBy("request_id", "seen").orderBy("at"))
    quota = F.greatest(F.lit(1), F.floor((F.col("most") + 2) / 3))
    around = around.withColumn("reason", F.when(F.col("seen"), "seen").when(place > quota, "quota"))
    third = around.select("request_id", "id", F.lit("entity_graph").alias("channel"), "at", F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("string").alias("relation_type"), F.lit(False).alias("low_confidence"), "reason")
    return core.unionByName(gone).unionByName(near.where("reason is not null")).unionByName(third)


def chunk_channel(requests: DataFrame, chunks: DataFrame, entities: DataFrame, links: DataFrame, p: Limits = Limits()) -> DataFrame:
    """request_id, id, channel (vector or entity), similarity, reason (null: taken; else noise or far) from requests (also names: entities in the question, the first five count), chunks (id, container, content, vec, status of its document) and links (chunk_id, entity_id). An entity's chunk without a vector is taken."""
    done = chunks.where("status = 'done'")
    most = requests.select("request_id", "container", "query_vec", _most(F.col("sub_agent"), p.chunks, p.chunks_sub_agent).alias("most"))
    q = requests.select(F.col("request_id").alias("query_id"), "query_vec", "container")
    near = ann.exact_top_k(q, done.select("id", "vec", "container"), p.chunks, p.chunk_threshold, by=["container"]).select(F.col("query_id").alias("request_id"), "id", "similarity", "rank")
    near = near.join(most.select("request_id", "most"), "request_id").where("rank <= most").select("request_id", "id", F.lit("vector").alias("channel"), "similarity")
    named = requests.select("request_id", "container", F.explode(F.slice("names", 1, 5)).alias("name")).distinct()
    of = links.join(entities.select("name", "container", F.col("id").alias("entity_id")), "entity_id").select("name", "container", F.col("chunk_id").alias("id"))
    # of a name's chunks only the first can be among a request's first
    of = of.join(done.select("id", "container"), ["id", "container"], "left_semi").distinct().withColumn("r", F.row_number().over(Window.partitionBy("name", "container").orderBy("id"))).where(F.col("r") <= p.chunks)
    found = named.join(of, ["name", "container"]).select("request_id", "container", "id").distinct().join(done.select("id", "container", F.col("vec").alias("v")), ["id", "container"])
    found = _numbered(found.join(most.select("request_id", "query_vec", "most"), "request_id"), "id").where("n <= most")
    found = found.join(near.select("request_id", "id"), ["request_id", "id"], "left_anti").where("query_vec is not null")
    by_name = found.select("request_id", "id", F.lit("entity").alias("channel"), cosine(F.col("query_vec"), F.col("v")).alias("similarity"))
    both = near.unionByName(by_name).join(chunks.select("id", "content"), "id")
    reason = F.when(text.is_html_noise(F.coalesce("content", F.lit(""))), "noise").when((F.col("channel") == "entity") & (F.col("similarity") < p.entity_chunk_threshold), "far")
    return both.select("request_id", "id", "channel", "similarity", reason.alias("reason"))
