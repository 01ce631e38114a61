"""Evidence to claims as pure functions: state and judgements in, state out.

State: claims (claim_id, claim_kind, content_confidence, status), links (claim_id,
evidence_id, session_id) of the evidence a claim rests on, edges (from_claim, to_claim,
type, evidence_id). What a judgement does depends on the state alone and never on
confidences, so any number of evidences is applied at once, in the order of
(observed_at, evidence_id): applying them in batches, or rebuilding all from nothing,
gives the same state. Confidences are kept unrounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions.scoring import evidence_strength, prior_confidence
from memlake.operators import ann

POISON_LIMIT = 3
MOST_CHARS = 1500
MOST_CLAIMS = 15
#: Of what a confidence lacks, a support of strength 1 adds this share.
SHARE = 0.2


def isolated(evidence: DataFrame, judgements: DataFrame | None = None) -> DataFrame:
    """evidence with ``isolated``: why it is left for a person to decide (too_long, too_many_claims, not_decomposed), or null."""
    too_long = F.when(F.length("content") > MOST_CHARS, "too_long")
    if judgements is None:
        return evidence.withColumn("isolated", too_long)
    n = judgements.groupBy("evidence_id").agg(F.count_distinct("claim_no").alias("__n"))
    e = evidence.join(n, "evidence_id", "left")
    reason = F.coalesce(too_long, F.when(F.col("__n") > MOST_CLAIMS, "too_many_claims"), F.when(F.col("__n").isNull(), "not_decomposed"))
    return e.withColumn("isolated", reason).drop("__n")


def empty_state(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "claims": spark.createDataFrame([], "claim_id string, claim_kind string, content_confidence double, status string"),
        "links": spark.createDataFrame([], "claim_id string, evidence_id string, session_id string"),
        "edges": spark.createDataFrame([], "from_claim string, to_claim string, type string, evidence_id string"),
    }


def _moved(confidence: Column, first: Column, left: Column) -> Column:
    """A confidence after all its supports: each takes its share of what is missing; one that is unknown begins at the first."""
    begun = 1 - (1 - F.least(first, F.lit(1.0))) * left / (1 - first * SHARE)
    return F.when(left.isNull(), confidence).when(confidence.isNull(), begun).otherwise(1 - (1 - confidence) * left)


def applied(state: dict[str, DataFrame], evidence: DataFrame, judgements: DataFrame) -> dict[str, DataFrame]:
    """The state after evidence (evidence_id, observed_at, content, source_kind, extraction_type, session_id, claim_kind) and its judgements (evidence_id, claim_no, ord, judgment, target_claim_id).

    Isolated evidence changes nothing. Of a new claim's judgements the first support
    (SUPPORT or REDUNDANT) and the first CONFLICT count. A claim that supports one is not
    made: it becomes a link of its target, and scores unless the target already rests on
    evidence of its session. All others are made; one in conflict supersedes its target.
    Besides the state: ``made`` claims, and ``poison``, evidence that superseded more than
    three. Judgements of targets that aren't there make a claim without an edge.
    """
    e = isolated(evidence, judgements).where("isolated is null").withColumn("at", F.struct("observed_at", "evidence_id"))
    j = judgements.withColumn("__o", F.struct("ord", "target_claim_id"))
    first = lambda kinds: F.min_by(F.struct("target_claim_id"), F.when(F.col("judgment").isin(kinds), F.col("__o")))["target_claim_id"]
    each = j.groupBy("evidence_id", "claim_no").agg(first(["SUPPORT", "REDUNDANT"]).alias("backs"), first(["CONFLICT"]).alias("against")).join(e, "evidence_id")
    name = F.concat_ws("_", F.lit("cl"), "evidence_id", "claim_no")
    new = each.where("backs is null").withColumn("claim_id", name)
    made = new.select("claim_id", "claim_kind", prior_confidence(F.col("source_kind"), F.col("claim_kind"), F.col("extraction_type")).alias("content_confidence"), F.lit("active").alias("status"))
    claims = state["claims"].select("claim_id", "claim_kind", "content_confidence", "status").unionByName(made)
    there = claims.select("claim_id")
    # evidence under claims, in order: what made a claim stands before all that supports it
    fresh = new.select("claim_id", "evidence_id", "session_id", "at", "claim_no", F.lit(False).alias("supports"), F.lit(0.0).alias("w"))
    backing = each.where("backs is not null").select(F.col("backs").alias("claim_id"), "evidence_id", "session_id", "at", "claim_no", F.lit(True).alias("supports"), evidence_strength(F.col("source_kind"), F.col("extraction_type")).alias("w")).join(there, "claim_id", "left_semi")
    rests = fresh.unionByName(backing)
    turn = F.row_number().over(Window.partitionBy("claim_id", "session_id").orderBy("supports", "at", "claim_no"))
    known = state["links"].where("session_id is not null").select("claim_id", "session_id").distinct()
    scoring = rests.withColumn("turn", turn).where("supports and w > 0 and (turn = 1 or session_id is null)").join(known, ["claim_id", "session_id"], "left_anti")
    gain = scoring.groupBy("claim_id").agg(F.product(1 - F.col("w") * SHARE).alias("left"), F.min_by("w", F.struct("at", "claim_no")).alias("w"))
    edges = new.where("against is not null").join(there.withColumnRenamed("claim_id", "against"), "against", "left_semi").select(F.col("against").alias("from_claim"), F.col("claim_id").alias("to_claim"), F.lit("supersedes").alias("type"), "evidence_id")
    gone = edges.select(F.col("from_claim").alias("claim_id"), F.lit(True).alias("gone")).distinct()
    after = claims.join(gain, "claim_id", "left").join(gone, "claim_id", "left")
    after = after.select("claim_id", "claim_kind", _moved(F.col("content_confidence"), F.col("w"), F.col("left")).alias("content_confidence"), F.when(F.col("gone"), "superseded").otherwise(F.col("status")).alias("status"))
    poison = edges.groupBy("evidence_id").agg(F.count("*").alias("n")).where(F.col("n") > POISON_LIMIT)
    links = state["links"].select("claim_id", "evidence_id", "session_id").unionByName(rests.select("claim_id", "evidence_id", "session_id").dropDuplicates(["claim_id", "evidence_id"]))
    return {"claims": after, "links": links, "edges": state["edges"].select("from_claim", "to_claim", "type", "evidence_id").unionByName(edges), "made": made, "poison": poison}


def apply_judgements(evidence: DataFrame, claims: DataFrame, judgements: DataFrame) -> dict[str, DataFrame]:
    """One step over claims that know one session each: claims (claim_id, content_confidence, status, session_id), evidence and judgements without times, texts and order. Confidences to 4 places."""
    state = empty_state(evidence.sparkSession) | {
        "claims": claims.select("claim_id", F.lit(None).cast("string").alias("claim_kind"), "content_confidence", "status"),
        "links": claims.select("claim_id", F.lit(None).cast("string").alias("evidence_id"), "session_id"),
    }
    out = applied(state, evidence.withColumns({"observed_at": F.lit(None).cast("timestamp"), "content": F.lit("")}), judgements.withColumn("ord", F.lit(0)))
    known = claims.select("claim_id")
    moved = out["claims"].join(known, "claim_id", "left_semi").select("claim_id", F.round("content_confidence", 4).alias("content_confidence"), "status")
    return {"claims": moved, "new_claims": out["made"], "edges": out["edges"], "links": out["links"].join(known, "claim_id", "left_semi").where("evidence_id is not null").select("claim_id", "evidence_id"), "poison": out["poison"]}


def rebuilt(evidence: DataFrame, judgements: DataFrame) -> dict[str, DataFrame]:
    """The whole derived state from all evidence."""
    return applied(empty_state(evidence.sparkSession), evidence, judgements)


def retry(processing: DataFrame, most: int = 3) -> DataFrame:
    n = F.col("attempts") + 1
    return processing.withColumn("attempts", n).withColumn("state", F.when(F.col("attempts") >= most, "failed").otherwise("pending"))


# ---------------------------------------------------------------- search
def _keyed(claims: DataFrame) -> DataFrame:
    """Active claims under every (scope, kind) that a request may name: their own kind, and any."""
    active = claims.where("status = 'active'").withColumn("scope_key", F.coalesce("scope", F.lit("")))
    return active.withColumn("kind_key", F.explode(F.array(F.lit("*"), F.coalesce("claim_kind", F.lit("")))))


def _asked(requests: DataFrame) -> DataFrame:
    """A request for a scope sees that scope and claims without one; a request without, only the latter."""
    scopes = F.when(F.col("scope").isNull(), F.array(F.lit(""))).otherwise(F.array(F.lit(""), F.col("scope")))
    return requests.select("request_id", "owner_id", F.explode(scopes).alias("scope_key"), F.coalesce("claim_kind", F.lit("*")).alias("kind_key"), "query_vec")


_KEYS = ["owner_id", "scope_key", "kind_key"]


def candidates(requests: DataFrame, claims: DataFrame, k: int = 20) -> DataFrame:
    """request_id, id, similarity, rank: the ``k`` active claims with a vector that are most like a request (request_id, owner_id, scope, claim_kind, query_vec), most similar first. claims: id, owner_id, scope, claim_kind, status, vec."""
    q = _asked(requests).withColumnRenamed("request_id", "query_id")
    found = ann.exact_top_k(q, _keyed(claims).where("vec is not null"), k, by=_KEYS)
    return found.select(F.col("query_id").alias("request_id"), "id", "similarity", "rank")


def search(requests: DataFrame, claims: DataFrame, limit: int = 10, coarse: int = 50, low: float = 0.4) -> DataFrame:
    """request_id, id, relevance, final, rank, low_confidence, n_candidates: claims by relevance times confidence.

    Only the ``coarse`` claims most like the request have a relevance; all others of its
    scope have 0 and come after them, by id, where fewer than ``limit`` are left.
    claims: also content_confidence. Requests without a vector rank all by id.
    """
    keyed = _keyed(claims)
    near = candidates(requests, claims, coarse).withColumn("relevance", F.round((F.col("similarity") + 1) / 2, 4)).select("request_id", "id", "relevance")
    first = keyed.select(*_KEYS, "id").withColumn("r", F.row_number().over(Window.partitionBy(*_KEYS).orderBy("id"))).where(F.col("r") <= coarse + limit).drop("r")
    rest = _asked(requests).join(first, _KEYS).select("request_id", "id").join(near, ["request_id", "id"], "left_anti").withColumn("relevance", F.lit(0.0))
    confidence = claims.select("id", "content_confidence")
    both = near.unionByName(rest).join(confidence, "id")
    final = F.round(F.col("relevance") * F.coalesce("content_confidence", F.lit(0.4)), 4)
    ranked = both.withColumn("final", final).withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("final"), "id"))).where(F.col("rank") <= limit)
    n = _asked(requests).join(keyed.groupBy(*_KEYS).agg(F.count("*").alias("n")), _KEYS).groupBy("request_id").agg(F.sum("n").alias("n_candidates"))
    return ranked.join(n, "request_id").select("request_id", "id", "relevance", "final", "rank", F.coalesce(F.col("content_confidence") < low, F.lit(True)).alias("low_confidence"), "n_candidates")


def context(requests: DataFrame, claims: DataFrame, excluded: DataFrame, kind: str = "preference", most: int = 20, limit: int = 10) -> DataFrame:
    """request_id, id, source (preference or search), rank: the surest ``most`` claims of a kind that a request sees, then what its search finds and they don't have; without excluded ones (request_id, id)."""
    own = _keyed(claims).where((F.col("claim_kind") == kind) & (F.col("kind_key") != "*"))
    asked = _asked(requests.withColumn("claim_kind", F.lit(kind)))
    order = Window.partitionBy("request_id").orderBy(F.desc_nulls_last("content_confidence"), "id")
    sure = asked.join(own.select(*_KEYS, "id", "content_confidence"), _KEYS).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    sure = sure.select("request_id", "id", F.lit("preference").alias("source"), "rank")
    found = search(requests, claims, limit).select("request_id", "id", F.lit("search").alias("source"), "rank").join(sure.select("request_id", "id"), ["request_id", "id"], "left_anti")
    return sure.unionByName(found).join(excluded.select("request_id", "id"), ["request_id", "id"], "left_anti")


def review(evidence: DataFrame, judgements: DataFrame, claims: DataFrame, low: float = 0.4) -> DataFrame:
    """list, id, reason: evidence that was isolated, and active claims of low or unknown confidence, for a person to look at."""
    alone = isolated(evidence, judgements).where("isolated is not null").select(F.lit("isolated").alias("list"), F.col("evidence_id").cast("string").alias("id"), F.col("isolated").alias("reason"))
    unsure = claims.where((F.col("status") == "active") & (F.col("content_confidence").isNull() | (F.col("content_confidence") < low)))
    reason = F.when(F.col("content_confidence").isNull(), "unknown").otherwise("low")
    return alone.unionByName(unsure.select(F.lit("low_confidence").alias("list"), F.col("claim_id").cast("string").alias("id"), reason.alias("reason")))


# ---------------------------------------------------------------- decisions of a person
CONFIRMED = 0.5


def confirmed(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims with the confidence of those confirmed (claim_id) moved as by evidence of strength 0.5; each confirmation counts."""
    n = ids.groupBy("claim_id").agg(F.product(F.lit(1 - CONFIRMED * SHARE)).alias("left"))
    moved = _moved(F.col("content_confidence"), F.lit(CONFIRMED), F.col("left"))
    return claims.join(n, "claim_id", "left").withColumn("content_confidence", moved).drop("left")


def forgotten(state: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The state without the claims of ``ids`` (claim_id): retracted, each with an edge to nothing."""
    gone = state["claims"].join(ids.select("claim_id").distinct(), "claim_id", "left_semi").select("claim_id")
    edges = gone.select(F.col("claim_id").alias("from_claim"), F.lit(None).cast("string").alias("to_claim"), F.lit("retract").alias("type"), F.lit(None).cast("string").alias("evidence_id"))
    claims = state["claims"].join(gone.withColumn("__gone", F.lit(True)), "claim_id", "left").withColumn("status", F.when(F.col("__gone"), "retracted").otherwise(F.col("status"))).drop("__gone")
    return state | {"claims": claims, "edges": state["edges"].unionByName(edges)}


def promoted(claims: DataFrame, links: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Decisions (claim_id, action adopt or reject) on claims (claim_id, owner_id, scope, claim_kind, content_confidence, status) and links (claim_id, evidence_id). An adopted claim gets one without scope beside it, on the same evidence, and an edge ``generalizes`` to it; a rejected one stays as it is. Both are told in ``activity``; what has no scope or isn't there is in neither."""
    d = decisions.groupBy("claim_id").agg(F.min("action").alias("action"))
    asked = claims.where("scope is not null").join(d, "claim_id")
    name = F.concat(F.col("claim_id"), F.lit("_global"))
    adopted = asked.where("action = 'adopt'")
    new = adopted.select(name.alias("claim_id"), "owner_id", F.lit(None).cast("string").alias("scope"), "claim_kind", "content_confidence", F.lit("active").alias("status"))
    copied = links.join(adopted.select("claim_id"), "claim_id", "left_semi").select(name.alias("claim_id"), "evidence_id")
    return {
        "claims": claims.select(*new.columns).unionByName(new),
        "links": links.select("claim_id", "evidence_id").unionByName(copied),
        "edges": adopted.select(F.col("claim_id").alias("from_claim"), name.alias("to_claim"), F.lit("generalizes").alias("type")),
        "activity": asked.select("claim_id", F.lit("promoted_scope").alias("action"), F.col("action").alias("decision")),
    }
