"""Memories, profiles, claims and their upkeep: DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import rules
from memlake.operators import ann


# ---------------------------------------------------------------- reading
def by_id(df: DataFrame, key: str, value, hidden: Column | None = None) -> DataFrame:
    """The row of an id; ``hidden`` rows only count if it is left out."""
    found = df.where(F.col(key) == value)
    return found if hidden is None else found.where(~hidden)


def page(df: DataFrame, order: list[Column], offset: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def literal_prefix(tag: Column, key: str) -> Column:
    """The key's container or one of its projects; the underscore stands for itself."""
    return (tag == key) | tag.startswith(f"{key}_")


def but_id(key: Column, gone) -> Column:
    """All rows if no id is given, else all but this one."""
    return F.lit(True) if gone is None else ~key.eqNullSafe(F.lit(gone))


def missing(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    return rows.join(vectors.select(key), key, "left_anti")


# ---------------------------------------------------------------- writing
def with_id(rows: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    """Rows with an id of their content, the same in every run."""
    return rows.withColumn("id", F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *columns).cast("binary"), 256), 1, 16)))


def updated(df: DataFrame, where: Column, **values: Column) -> DataFrame:
    """New values where the condition holds; where it is null rows stay as they are."""
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def scope_mismatch(scope: Column, tag: Column) -> Column:
    """Whether a row of scope user stands in a project's container (owner_project), or the reverse."""
    project = tag.contains("_")
    return ((scope == "user") & project) | ((scope == "project") & ~project)


def spoofed(scope: Column) -> Column:
    """Whether a scope begins like somebody's id."""
    return scope.rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


#: How near a new memory may be to an old one: those written on purpose, those captured, those distilled.
MERGE, CAPTURE, DISTIL = 0.95, 0.80, 0.80


def written_dedup(new: DataFrame, old: DataFrame, merge: float = MERGE, capture: float = CAPTURE) -> DataFrame:
    """new (id, tag, embedding, is_capture) against old (id, tag, embedding): id, action (kept, merged or dropped), other (the most similar old memory of its tag, if it is near enough), similarity. A captured memory is dropped from ``capture`` on, any other merged from ``merge`` on; one without a vector is kept."""
    q = new.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"), "tag")
    v = old.select("id", F.col("embedding").alias("vec"), "tag")
    best = ann.exact_top_k(q, v, 1, min(merge, capture), by=["tag"]).select(F.col("query_id").alias("id"), F.col("id").alias("other"), "similarity")
    out = new.select("id", F.coalesce("is_capture", F.lit(False)).alias("is_capture")).join(best, "id", "left")
    near = F.col("similarity") >= F.when(F.col("is_capture"), capture).otherwise(merge)
    action = F.when(~F.coalesce(near, F.lit(False)), "kept").when(F.col("is_capture"), "dropped").otherwise("merged")
    return out.select("id", action.alias("action"), F.when(near, F.col("other")).alias("other"), F.when(near, F.col("similarity")).alias("similarity"))


def merged(old: DataFrame, found: DataFrame) -> DataFrame:
    """old (id, merged_count, ..) with one more for each memory that was merged into it."""
    n = found.where("action = 'merged'").groupBy(F.col("other").alias("id")).agg(F.count("*").alias("__n"))
    return old.join(n, "id", "left").withColumn("merged_count", F.col("merged_count") + F.coalesce("__n", F.lit(0))).drop("__n")


def distilled(found: DataFrame) -> DataFrame:
    """What a distilled candidate is told: kept, or dropped with the reason ``similar_to:<id>``."""
    return found.select("id", (F.col("action") != "kept").alias("dropped"), F.when(F.col("action") != "kept", F.concat(F.lit("similar_to:"), F.col("other").cast("string"))).alias("reason"))


# ---------------------------------------------------------------- profiles and recall
def profile(rows: DataFrame, static: int = 100, dynamic: int = 50) -> DataFrame:
    """rows (container, id, created_at, is_static, profile_worthy): the newest of either bucket in each container; rows told to be unworthy stay out."""
    w = Window.partitionBy("container", "is_static").orderBy(F.desc("created_at"), "id")
    ranked = rows.where(F.coalesce("profile_worthy", F.lit(True))).withColumn("position", F.row_number().over(w))
    return ranked.where(F.col("position") <= F.when(F.col("is_static"), static).otherwise(dynamic))


def injected(rows: DataFrame, most_static: int = 30, most_dynamic: int = 10) -> DataFrame:
    """rows of profile() with ``is_rule``: rules all stay, passing facts fill what is left of the static room, dynamic ones have their own."""
    rules = F.count(F.when(F.col("is_static") & F.col("is_rule"), 1)).over(Window.partitionBy("container"))
    w = Window.partitionBy("container", "is_static", "is_rule").orderBy("position")
    ranked = rows.withColumns({"rules": rules, "rank": F.row_number().over(w)})
    room = F.when(F.col("is_static") & F.col("is_rule"), F.col("rules")).when(F.col("is_static"), F.greatest(F.lit(0), most_static - F.col("rules"))).otherwise(most_dynamic)
    own = Window.partitionBy("container", "is_static").orderBy("position")
    dynamic = ranked.withColumn("rank", F.when(F.col("is_static"), F.col("rank")).otherwise(F.row_number().over(own)))
    return dynamic.where(F.col("rank") <= room).drop("rules", "rank")


def one_hop(hits: DataFrame, relations: DataFrame, most: int = 3, budget: int = 10) -> DataFrame:
    """hits (request_id, rank, id), relations (from_id, to_id, type): what the first ``most`` hits lead to, not hit itself, up to a budget."""
    first = hits.where(F.col("rank") <= most)
    out = first.join(relations, F.col("id") == F.col("from_id")).groupBy("request_id", F.col("to_id").alias("id")).agg(F.min(F.struct("rank", "type")).alias("by"))
    out = out.join(hits.select("request_id", "id"), ["request_id", "id"], "left_anti")
    w = Window.partitionBy("request_id").orderBy("by.rank", "id")
    return out.withColumn("position", F.row_number().over(w)).where(F.col("position") <= budget).select("request_id", "id", F.col("by.type").alias("type"), "position")


def longest_name(texts: DataFrame, names: DataFrame) -> DataFrame:
    """texts (id, words array), names (name): the longest known name among a text's words; ties: the first by alphabet."""
    met = texts.select("id", F.explode(F.array_distinct("words")).alias("name")).join(names.select("name").distinct(), "name")
    return met.groupBy("id").agg(F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("m")).select("id", "m.name")


def named_entities(queries: DataFrame, entities: DataFrame, links: DataFrame, most: int = 5) -> DataFrame:
    """request_id, name, type, mention_count, memory_ids, position: the entities of a request's container whose names stand in its query, longest first, each name once (the smallest id), with the ``most`` smallest ids of their memories. queries: request_id, container, query; entities: id, name, type, container, mention_count; links: memory_id, entity_id."""
    met = queries.select("request_id", "container", "query").join(entities.where("name <> ''"), "container").where(F.col("query").contains(F.col("name")))
    once = met.groupBy("request_id", "name").agg(F.min_by(F.struct("id", "type", "mention_count"), "id").alias("e")).select("request_id", "name", "e.*")
    first = Window.partitionBy("entity_id").orderBy("memory_id")
    few = links.select("entity_id", "memory_id").distinct().join(once.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").withColumn("r", F.row_number().over(first)).where(F.col("r") <= most)
    ids = few.groupBy(F.col("entity_id").alias("id")).agg(F.array_sort(F.collect_list("memory_id")).alias("memory_ids"))
    out = once.join(ids, "id", "left").withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(F.length("name")), "name")))
    return out.select("request_id", "name", "type", "mention_count", F.coalesce("memory_ids", F.array().cast("array<bigint>")).alias("memory_ids"), "position")


def noisy(entities: DataFrame, blacklist: DataFrame) -> DataFrame:
    """id, name, type, reasons: entities (id, name, type, mention_count) that some finder hits. ``blacklist`` (name): names without meaning, by lower case; ``duplicate``: all of a name but the one mentioned most (then of smallest id)."""
    black = blacklist.select(F.lower("name").alias("__low"), F.lit("blacklist").alias("__black")).distinct()
    best = Window.partitionBy("name").orderBy(F.desc("mention_count"), "id")
    e = entities.withColumn("__low", F.lower(F.trim("name"))).join(black, "__low", "left").withColumn("__n", F.row_number().over(best))
    reasons = F.concat(rules.noise_reasons(F.col("name"), F.col("type")), F.array_compact(F.array(F.col("__black"), F.when(F.col("__n") > 1, F.lit("duplicate")))))
    return e.select("id", "name", "type", reasons.alias("reasons")).where("size(reasons) > 0")


def derived(memories: DataFrame, inferences: DataFrame, confidence: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """memories (id, container_tag, content, is_inference) with one more for each inference (container_tag, content, sources: array of ids), and its ``derives`` edges to those of its sources that are there. An inference's id follows from its container and content; without sources it has no edges."""
    new = with_id(inferences, "mem", ["container_tag", "content"]).dropDuplicates(["id"])
    rows = new.select("id", "container_tag", "content", F.lit(True).alias("is_inference"))
    edges = new.select(F.col("id").alias("from_id"), F.explode(F.array_distinct("sources")).alias("to_id")).join(memories.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return memories.select("id", "container_tag", "content", "is_inference").unionByName(rows), edges.select("from_id", "to_id", F.lit("derives").alias("type"), F.lit(confidence).alias("confidence"))


def told_once(lists: DataFrame) -> DataFrame:
    """lists (request_id, section static, dynamic or search, position, content): every text of a request once, where it stands first: static facts before dynamic ones before what was found. Empty texts are only dropped from what was found."""
    rank = F.when(F.col("section") == "static", 0).when(F.col("section") == "dynamic", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("request_id", "content").orderBy(rank, "position"))
    kept = (F.col("section") != "search") | (F.coalesce("content", F.lit("")) != "")
    return lists.where(kept).withColumn("__r", first).where("__r = 1").drop("__r")


def sampled(df: DataFrame, key: Column, rate: float, forced: Column | None = None) -> DataFrame:
    """Rows of a sample that follows from their keys: about ``rate`` of them, the same in every run; ``forced`` rows besides."""
    share = F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10_000 < round(rate * 10_000)
    return df.where(share if forced is None else share | forced)


# ---------------------------------------------------------------- graph and claims
def family_expanded(ids: DataFrame, families: DataFrame) -> DataFrame:
    """ids (id), families (id, family): all members of the ids' families; ids without one stay."""
    own = ids.join(families, "id", "left")
    members = own.where("family is not null").select("family").distinct().join(families, "family").select("id")
    return members.unionByName(own.where("family is null").select("id")).distinct()


def graph_view(memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """memories (id, confidence, entities map<type, array<name>>): nodes and edges; an edge is as sure as its memory."""
    each = memories.select("id", "confidence", F.explode("entities").alias("type", "names")).select("id", "confidence", "type", F.explode("names").alias("name"))
    return each.select("type", "name").distinct(), each.select("id", "type", "name", "confidence").distinct()


def next_batch(processing: DataFrame, now: str, stale_seconds: int = 30, n: int = 50) -> DataFrame:
    """The oldest rows that wait, failed, or have been in work for too long, and are not isolated."""
    late = (F.col("state") == "processing") & (F.col("since") < F.expr(f"timestamp_ntz'{now}' - interval {stale_seconds} seconds"))
    return processing.where((F.col("state").isin("pending", "failed") | late) & ~F.col("isolated")).orderBy("since", "id").limit(n)


def corrected(claims: DataFrame, corrections: DataFrame, confidence: float) -> tuple[DataFrame, DataFrame]:
    """corrections (claim_id, content): each makes a claim of the old one's kind that supersedes it. All claims, and the edges."""
    new = corrections.join(claims.select("claim_id", "kind"), "claim_id")
    made = new.select(F.concat(F.col("claim_id"), F.lit("_c")).alias("claim_id"), "kind", F.lit(confidence).alias("confidence"), F.lit("active").alias("status"))
    old = claims.join(new.select("claim_id", F.lit(True).alias("gone")), "claim_id", "left")
    old = old.select("claim_id", "kind", "confidence", F.when(F.col("gone"), "superseded").otherwise(F.col("status")).alias("status"))
    return old.unionByName(made), new.select(F.col("claim_id").alias("from_claim"), F.concat(F.col("claim_id"), F.lit("_c")).alias("to_claim"), F.lit("supersedes").alias("type"))


def relation_appended(relations: Column, kind: Column, target: Column) -> Column:
    """A map kind -> targets with one more target; what is there already is not repeated."""
    known = F.coalesce(relations, F.create_map().cast("map<string,array<string>>"))
    has = F.coalesce(F.try_element_at(known, kind), F.array().cast("array<string>"))
    rest = F.map_filter(known, lambda k, _: k != kind)
    return F.map_concat(rest, F.map_from_arrays(F.array(kind), F.array(F.array_union(has, F.array(target)))))


def compared(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two arms by key: only_on, only_off or both."""
    a, b = before.select(*key).distinct().withColumn("x", F.lit(1)), after.select(*key).distinct().withColumn("y", F.lit(1))
    side = F.when(F.col("y").isNull(), "only_on").when(F.col("x").isNull(), "only_off").otherwise("both")
    return a.join(b, key, "full_outer").select(*key, side.alias("side"))


def non_inferior(scores: DataFrame, margin: float = 0.3) -> DataFrame:
    """scores (query_id, arm a or b, score): wins, losses and ties of b, the mean difference, and whether it is above minus the margin."""
    each = scores.groupBy("query_id").agg(F.avg(F.when(F.col("arm") == "a", F.col("score"))).alias("a"), F.avg(F.when(F.col("arm") == "b", F.col("score"))).alias("b")).where("a is not null and b is not null")
    d = F.round(F.col("b") - F.col("a"), 9)
    out = each.agg(F.count(F.when(d > 0, 1)).alias("wins"), F.count(F.when(d < 0, 1)).alias("losses"), F.count(F.when(d == 0, 1)).alias("ties"), F.round(F.avg(d), 6).alias("delta"))
    return out.withColumn("non_inferior", F.col("delta") >= -margin)


def bootstrap_interval(scores: DataFrame, rounds: int = 4000, seed: int = 7) -> DataFrame:
    """scores (cluster, difference): mean, and 95 % interval of the mean over clusters drawn again and again. A round doesn't draw as many clusters as there are: it weighs each by a Poisson number (mean 1) of its hash, to which drawing comes close for many clusters, so no round is gathered in one task."""
    each = scores.groupBy("cluster").agg(F.sum("difference").alias("s"), F.count("*").alias("n"))
    u = (F.pmod(F.xxhash64(F.lit(seed), "round", "cluster"), F.lit(1 << 53).cast("long")) + 0.5) / float(1 << 53)
    weight, below, term = F.lit(0), 0.0, 2.718281828459045**-1
    for k in range(1, 21):
        below += term
        weight, term = weight + F.when(u > below, 1).otherwise(0), term / k
    drawn = each.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", weight)
    means = drawn.groupBy("round").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    bounds = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return each.agg((F.sum("s") / F.sum("n")).alias("mean")).crossJoin(F.broadcast(bounds))
