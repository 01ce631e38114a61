"""Entity families, seeds, neighbours, traversal and version chains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions.text import normalized_name
from memlake.operators.shared import stored


def families(entities: DataFrame, links: DataFrame) -> DataFrame:
    """id, family key, representative: that of most links, then the smallest id. A window by (container, name), never a self join."""
    n = links.groupBy("entity_id").agg(F.count("*").alias("n_links")).withColumnRenamed("entity_id", "id")
    e = entities.select("id", "container_tag", normalized_name(F.col("name")).alias("name_key")).join(n, "id", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    first = F.max_by("id", F.struct("n_links", -F.col("id"))).over(Window.partitionBy("container_tag", "name_key"))
    return e.withColumn("representative", first)


def neighbours(edges: DataFrame) -> DataFrame:
    """id, other, direction, confidence."""
    out = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit("out").alias("direction"), "confidence")
    return out.unionByName(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), F.lit("in").alias("direction"), "confidence"))


#: A seed that has reached no more than so many ids, by one way on, is carried on without a shuffle of what it reaches.
FEW = 64


def reachable(seeds: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """seed, id, depth: breadth-first, by frontier joins; each id at its least depth.

    A seed with one vertex at its frontier meets each neighbour once, so its rows need no
    grouping: behind a hub they are most of the result, and are written as they come.
    """
    step = stored(neighbours(edges).select("id", "other").distinct(), "steps")
    seen = front = stored(seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct(), "front")
    for d in range(1, depth + 1):
        short = seen.groupBy("seed").agg(F.count("*").alias("n"), F.count_if(F.col("depth") == d - 1).alias("ends")).where(f"n <= {FEW} and ends = 1").select("seed")
        met = seen.join(short, "seed", "left_semi").groupBy("seed").agg(F.collect_list("id").alias("met"))
        lone = front.join(met, "seed").join(step, "id").where(~F.array_contains("met", F.col("other"))).select("seed", F.col("other").alias("id"))
        wide = front.join(short, "seed", "left_anti").join(step, "id").select("seed", F.col("other").alias("id")).distinct().join(seen, ["seed", "id"], "left_anti")
        front = lone.unionByName(wide).withColumn("depth", F.lit(d))
        if d < depth:
            front = stored(front, "front")
        seen = seen.unionByName(front)
    return seen


def closure(edges: DataFrame, depth: int) -> DataFrame:
    """id, other, depth: who is reached along edges (from_id, to_id) in ``depth`` steps at most, at the least number of steps.

    Every round joins what is known with itself, so the steps it covers double; a round
    that adds nothing is the last. A cycle gives its members to themselves.
    """
    known = stored(edges.where("from_id is not null and to_id is not null").select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), F.lit(1).alias("depth")).distinct(), "closure")
    reach, n = 1, known.count()
    while reach < depth and n:
        onward = known.select(F.col("id").alias("other"), F.col("other").alias("end"), F.col("depth").alias("more"))
        far = known.join(onward, "other").select("id", F.col("end").alias("other"), (F.col("depth") + F.col("more")).alias("depth")).where(F.col("depth") <= depth)
        known = stored(known.unionByName(far).groupBy("id", "other").agg(F.min("depth").alias("depth")), "closure")
        reach, before, n = 2 * reach, n, known.count()
        if n == before:
            break
    return known


def stepwise(edges: DataFrame, depth: int) -> DataFrame:
    """What closure() gives, one step a round: for chains that seldom branch. A round moves one row for each id, while rounds that double meet each pair once for each vertex between."""
    step = stored(edges.select(F.col("from_id").alias("other"), F.col("to_id").alias("next")).distinct(), "steps")
    front = step.select(F.col("other").alias("id"), F.col("next").alias("other"), F.lit(1).alias("depth"))
    found = front
    for d in range(2, depth + 1):
        front = stored(front.join(step, "other").select("id", F.col("next").alias("other")).distinct().withColumn("depth", F.lit(d)), "steps")
        if front.isEmpty():
            break
        found = found.unionByName(front)
    return found.groupBy("id", "other").agg(F.min("depth").alias("depth"))


def version_history(memories: DataFrame, updates: DataFrame, depth: int = 10) -> DataFrame:
    """seed, id, depth, created_at, is_latest, position (newest first) from memories (id, created_at, is_latest) and updates (from_id, to_id): the versions behind every memory, forgotten ones too; edges to what isn't there lead nowhere. Depth counts from 0."""
    there = updates.select("from_id", "to_id").join(memories.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi").where("from_id is not null")
    found = stepwise(there, depth + 1).select(F.col("id").alias("seed"), F.col("other").alias("id"), (F.col("depth") - 1).alias("depth"))
    rows = found.join(memories.select("id", "created_at", "is_latest"), "id")
    newest = Window.partitionBy("seed").orderBy(F.desc_nulls_last("created_at"), "depth", "id")
    return rows.withColumn("position", F.row_number().over(newest)).select("seed", "id", "depth", "created_at", "is_latest", "position")


def walk(seeds: DataFrame, links: DataFrame, depth: int = 2, nodes: int = 5) -> DataFrame:
    """seed, id, position: depth-first pre-order from each seed (id) along links (id, other, ord) in their order, with one visited set and a budget of nodes (the start counts).

    Of a node's links only the first 2 * ``nodes`` can matter: fewer than ``nodes`` lead
    to what was visited, and each other one takes from the budget. So what a walk has to
    know is bounded, however many links a hub has.
    """
    first = links.groupBy("id", "other").agg(F.min("ord").alias("ord")).withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("ord", "other"))).where(F.col("r") <= 2 * nodes)
    near = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "other"))).alias("l")).select("id", F.expr("transform(l, x -> x.other)").alias("others"))
    level = seeds.select(F.col("id").alias("seed"), "id").distinct()
    known = None
    for d in range(max(depth, 1)):
        level = level.join(near, "id", "left")
        known = level if known is None else known.unionByName(level)
        if d + 1 < depth:
            level = level.select("seed", F.explode("others").alias("id")).distinct().join(known.select("seed", "id"), ["seed", "id"], "left_anti")
    each = known.groupBy("seed").agg(F.collect_list(F.struct("id", "others")).alias("known"))

    def visited(batches):
        for b in batches:
            rows = []
            for seed, found in zip(b["seed"], b["known"]):
                by = {x["id"]: x["others"] for x in found}
                out, stack = [], [(seed, 0)]
                while stack and len(out) < nodes:
                    v, d = stack.pop()
                    if d > depth or v in out:
                        continue
                    out.append(v)
                    others = by.get(v)
                    stack += [(x, d + 1) for x in (() if others is None else others[::-1])]
                rows += [(seed, v, k) for k, v in enumerate(out)]
            yield pd.DataFrame(rows, columns=["seed", "id", "position"])

    return each.mapInPandas(visited, "seed long, id long, position long")


def dfs_order(seeds: DataFrame, edges: DataFrame, depth: int = 2, nodes: int = 5) -> DataFrame:
    """A walk along entity relations (from_id, to_id, confidence): outgoing before incoming, surer edges first."""
    links = neighbours(edges).select("id", "other", F.struct((F.col("direction") == "in").alias("i"), (-F.col("confidence")).alias("c")).alias("ord"))
    return walk(seeds, links, depth, nodes)


def memory_walk(seeds: DataFrame, memories: DataFrame, relations: DataFrame, depth: int = 2, nodes: int = 5, types: list[str] | None = None) -> DataFrame:
    """A walk along memory relations (from_id, to_id, type, ord) of the given types over memories (id, is_forgotten): forgotten and missing ones are neither visited nor passed, as seeds neither."""
    live = memories.where(~F.coalesce("is_forgotten", F.lit(False))).select("id").distinct()
    r = relations if types is None else relations.where(F.col("type").isin(types))
    links = r.join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "ord")
    return walk(seeds.join(live, "id", "left_semi"), links, depth, nodes)


def chains(claims: DataFrame, edges: DataFrame, owner: str | None = None, longest: int = 64) -> DataFrame:
    """claim_id, n_out, n_in, n_above, n_below, heads from claims (claim_id, owner_id) and edges (from_claim, to_claim, type).

    n_out and n_in count all edges whose first claim has the owner asked for (any owner if
    none is). n_above are the claims that came after this one in chains of ``supersedes``,
    n_below those before it, and heads (sorted) those above that nothing supersedes: of a
    claim that nothing supersedes, itself; none where the chain is a cycle. An edge to
    nothing (a retraction) counts in n_out and ends no chain.
    """
    own = claims if owner is None else claims.where(F.col("owner_id") == owner)
    ids = own.select("claim_id").distinct()
    e = edges.join(ids.select(F.col("claim_id").alias("from_claim")), "from_claim", "left_semi")
    out = e.groupBy(F.col("from_claim").alias("claim_id")).agg(F.count("*").alias("n_out"))
    into = e.where("to_claim is not null").groupBy(F.col("to_claim").alias("claim_id")).agg(F.count("*").alias("n_in"))
    steps = e.where("type = 'supersedes' and to_claim is not null").select(F.col("from_claim").alias("from_id"), F.col("to_claim").alias("to_id"))
    far = closure(steps, longest).where("id <> other")
    ends = far.join(steps.select(F.col("from_id").alias("other")).distinct(), "other", "left_anti").groupBy(F.col("id").alias("claim_id")).agg(F.array_sort(F.collect_set("other")).alias("heads"))
    above = far.groupBy(F.col("id").alias("claim_id")).agg(F.count("*").alias("n_above"))
    below = far.groupBy(F.col("other").alias("claim_id")).agg(F.count("*").alias("n_below"))
    gone = steps.select(F.col("from_id").alias("claim_id"), F.lit(True).alias("gone")).distinct()
    all_ = ids
    for part in (out, into, above, below, ends, gone):
        all_ = all_.join(part, "claim_id", "left")
    itself = F.array("claim_id")
    heads = F.coalesce("heads", F.when(F.col("gone"), F.slice(itself, 1, 0)).otherwise(itself))
    return all_.fillna(0, ["n_out", "n_in", "n_above", "n_below"]).select("claim_id", "n_out", "n_in", "n_above", "n_below", heads.alias("heads"))


def network(claims: DataFrame, edges: DataFrame, evidence: DataFrame, links: DataFrame) -> DataFrame:
    """owner_id and how many claims, evidences, links of claims to evidence and lineage edges an owner has; edges and links belong to their claim's owner."""
    owner = claims.select("claim_id", "owner_id")
    n = lambda df, name: df.groupBy("owner_id").agg(F.count("*").alias(name))
    parts = [n(owner, "claim_count"), n(evidence, "evidence_count"), n(links.join(owner, "claim_id"), "claim_evidence_count"), n(edges.join(owner.withColumnRenamed("claim_id", "from_claim"), "from_claim"), "lineage_edge_count")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "owner_id", "full_outer")
    return out.fillna(0)


def store_edges(edges: DataFrame, start: float = 0.5, step: float = 0.1) -> DataFrame:
    """Mentions of an edge in any order: weight 0.5 and 0.1 more for each further mention, 1 at most."""
    g = edges.groupBy("from_id", "to_id", "relation_type").agg(F.count("*").alias("mentions"))
    return g.withColumn("weight", F.least(F.lit(start) + step * (F.col("mentions") - 1), F.lit(1.0)))
