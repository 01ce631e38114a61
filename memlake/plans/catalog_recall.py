"""Queries on recall channels, versions and walks, claims and their evidence, migration.

Bindings: embeddings are memories, chunks or claims (label: container or owner; every
50th row asks); orders of a customer are versions of a memory; events are evidence
that judges a claim of its user; orders are memories to migrate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import channels, claims, graph, migration, shared
from memlake.plans.catalog import Tables, query

_SIM = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_LIMITS = channels.Limits(threshold=0.2, chunk_threshold=0.25, entity_chunk_threshold=0.0)

# ---------------------------------------------------------------- channels
_ENTITIES = """ent AS (SELECT label * 100 + k AS id, 'name' || k % 20 AS key, label AS container, k FROM (SELECT DISTINCT label FROM embeddings), range(1, 31) r(k)),
lnk AS (SELECT vec_id AS memory_id, label * 100 + vec_id * 7 % 30 + 1 AS entity_id FROM embeddings UNION SELECT vec_id, label * 100 + vec_id * 11 % 30 + 1 FROM embeddings),
men AS (SELECT entity_id, count(*) AS mentions FROM lnk GROUP BY 1)"""


def _channel_tables(t: Tables) -> dict[str, DataFrame]:
    e = t.embeddings
    entity = lambda k: (F.col("label") * 100 + F.col("vec_id") * k % 30 + 1).alias("entity_id")
    links = e.select(F.col("vec_id").alias("memory_id"), entity(7)).union(e.select("vec_id", entity(11))).distinct()
    entities = e.select("label").distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30)))).select((F.col("label") * 100 + F.col("k")).cast("long").alias("id"), F.concat(F.lit(" Name"), (F.col("k") % 20).cast("string")).alias("name"), F.col("label").alias("container"), "k")
    mentions = links.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("mention_count"))
    relations = e.select(F.col("vec_id").alias("from_id"), F.explode(F.expr("array(struct(0 as ord, 10 as d, 'extends' as type), struct(1 as ord, 20 as d, 'updates' as type), struct(2 as ord, 3 as d, 'extends' as type))")).alias("r"))
    asks = e.where("vec_id % 50 = 0")
    return {
        "requests": asks.select(F.col("vec_id").alias("request_id"), F.col("label").alias("container"), F.concat(F.lit("TOPIC"), F.expr("(vec_id div 50) % 17"), F.lit(" question")).alias("query"), F.col("embedding").alias("query_vec"), (F.col("vec_id") % 100 == 50).alias("sub_agent"), F.expr("array(concat(' Name', vec_id % 20), concat(' Name', (vec_id + 3) % 20))").alias("names")),
        "memories": e.select(F.col("vec_id").alias("id"), F.col("label").alias("container"), F.expr("concat('topic', vec_id % 17, ' item', vec_id % 5)").alias("content"), F.col("embedding").alias("vec"), F.timestamp_seconds("vec_id").alias("created_at"), (F.col("vec_id") % 9 == 0).alias("is_forgotten")),
        "relations": relations.select("from_id", (F.col("from_id") + F.col("r.d")).alias("to_id"), "r.type", "r.ord"),
        "entities": entities.join(mentions, "id", "left").fillna(0, ["mention_count"]),
        "links": links,
        "entity_edges": entities.where("k % 3 <> 0").select(F.col("id").alias("from_id"), (F.col("id") + 1).alias("to_id"), F.lit(0.5).alias("confidence")),
        "excluded": asks.where("vec_id % 150 = 0").select(F.col("vec_id").alias("request_id"), F.col("vec_id").alias("id")),
    }


@query(f"""WITH {_ENTITIES},
sim AS (SELECT q.vec_id AS request_id, q.label AS container, e.vec_id AS id, {_SIM} AS s, CASE WHEN q.vec_id % 100 = 50 THEN 3 ELSE 5 END AS most FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 50 = 0 AND e.vec_id % 9 <> 0 AND {_SIM} >= 0.2),
rk AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(s, 9) DESC, id) AS rank FROM sim QUALIFY rank <= most),
al AS (SELECT *, request_id % 150 = 0 AND id = request_id AS ex, s < 0.25 AND id % 17 <> request_id // 50 % 17 AS low FROM rk),
hit AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS n, count(*) OVER (PARTITION BY request_id) AS held FROM al WHERE NOT ex),
fst AS (SELECT request_id, most, held, h.id + d AS id, min(n * 10 + ord) AS enc, arg_min(type, n * 10 + ord) AS type FROM hit h, (VALUES (0, 10, 'extends'), (1, 20, 'updates'), (2, 3, 'extends')) o(ord, d, type) WHERE n <= 3 AND EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = h.id + d AND e.vec_id % 9 <> 0) GROUP BY ALL),
new AS (SELECT f.*, row_number() OVER (PARTITION BY request_id ORDER BY enc, id) AS p FROM fst f WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.request_id = f.request_id AND h.id = f.id) AND NOT (f.request_id % 150 = 0 AND f.id = f.request_id)),
ful AS (SELECT request_id, enc AS spent FROM new WHERE p = 2 * most - held),
vec AS (SELECT h.request_id, h.id, 'vector' AS channel, h.n AS pos, s AS similarity, f.type AS relation_type, low AS low_confidence, NULL AS reason FROM hit h LEFT JOIN ful USING (request_id) LEFT JOIN fst f ON f.request_id = h.request_id AND f.id = h.id AND f.enc < coalesce(spent, 9999)),
gra AS (SELECT request_id, id, 'memory_graph' AS channel, p AS pos, NULL::DOUBLE AS similarity, type AS relation_type, false AS low_confidence, CASE WHEN p > 2 * most - held THEN 'budget' END AS reason FROM new),
cor AS (SELECT request_id, id FROM vec UNION ALL SELECT request_id, id FROM gra WHERE reason IS NULL),
req AS (SELECT vec_id AS request_id, label AS container, CASE WHEN vec_id % 100 = 50 THEN 3 ELSE 5 END AS most FROM embeddings WHERE vec_id % 50 = 0),
met AS (SELECT request_id, ent.id AS entity_id, key, container, k, count(*) AS together, any_value(mentions) AS mentions FROM cor JOIN lnk ON lnk.memory_id = cor.id JOIN ent ON ent.id = entity_id JOIN men USING (entity_id) GROUP BY ALL),
lon AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY request_id, container, key ORDER BY together DESC, mentions DESC, entity_id) = 1),
see AS (SELECT * FROM lon QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY together DESC, mentions DESC, entity_id) <= 5),
wan AS (SELECT DISTINCT s.request_id, e.container, e.key FROM see s JOIN ent e ON e.container = s.container AND (e.k - 1) // 3 = (s.k - 1) // 3 JOIN req r ON r.request_id = s.request_id AND r.container = e.container),
aro AS (SELECT w.request_id, l.memory_id AS id, count(DISTINCT w.key) AS m FROM wan w JOIN ent e USING (container, key) JOIN lnk l ON l.entity_id = e.id JOIN embeddings x ON x.vec_id = l.memory_id AND x.label = w.container AND x.vec_id % 9 <> 0 GROUP BY ALL),
top AS (SELECT a.*, most, row_number() OVER (PARTITION BY request_id ORDER BY m DESC, id DESC) AS pos FROM aro a JOIN req USING (request_id) QUALIFY pos <= most),
ee AS (SELECT t.*, EXISTS (SELECT 1 FROM cor c WHERE c.request_id = t.request_id AND c.id = t.id) OR (t.request_id % 150 = 0 AND t.id = t.request_id) AS seen FROM top t),
thi AS (SELECT *, row_number() OVER (PARTITION BY request_id, seen ORDER BY pos) AS place FROM ee),
out AS (SELECT * FROM vec UNION ALL SELECT * FROM gra UNION ALL SELECT request_id, id, 'vector', NULL, s, NULL, low, 'excluded' FROM al WHERE ex
UNION ALL SELECT request_id, id, 'entity_graph', pos, NULL, NULL, false, CASE WHEN seen THEN 'seen' WHEN place > greatest(1, (most + 2) // 3) THEN 'quota' END FROM thi)
SELECT request_id, id, channel, pos::INT AS "at", round(similarity, 6) AS similarity, relation_type, low_confidence, reason FROM out""")
def memory_channel(t: Tables) -> DataFrame:
    """Every request's memories by all arms, what was left out too."""
    x = _channel_tables(t)
    found = channels.memory_channel(x["requests"], x["memories"], x["relations"], x["entities"], x["links"], x["entity_edges"], x["excluded"], _LIMITS)
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_ENTITIES}, req AS (SELECT vec_id AS request_id, label AS container, CASE WHEN vec_id % 100 = 50 THEN 2 ELSE 3 END AS most, embedding FROM embeddings WHERE vec_id % 50 = 0),
rk AS (SELECT q.vec_id AS request_id, e.vec_id AS id, {_SIM} AS s, CASE WHEN q.vec_id % 100 = 50 THEN 2 ELSE 3 END AS most, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_SIM}, 9) DESC, e.vec_id) AS rank FROM embeddings q JOIN embeddings e ON q.label = e.label WHERE q.vec_id % 50 = 0 AND e.vec_id % 8 <> 0 AND e.vec_id % 13 <> 0 AND {_SIM} >= 0.25 QUALIFY rank <= most),
nam AS (SELECT DISTINCT r.request_id, r.container, r.embedding, r.most, l.memory_id AS id FROM req r JOIN ent e ON e.container = r.container AND e.key IN ('name' || r.request_id % 20, 'name' || (r.request_id + 3) % 20) JOIN lnk l ON l.entity_id = e.id WHERE l.memory_id % 8 <> 0),
lim AS (SELECT * FROM nam QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY id) <= most),
q AS (SELECT * FROM lim WHERE NOT EXISTS (SELECT 1 FROM rk WHERE rk.request_id = lim.request_id AND rk.id = lim.id)),
ent2 AS (SELECT q.request_id, q.id, CASE WHEN q.id % 13 <> 0 THEN {_SIM} END AS s FROM q JOIN embeddings e ON e.vec_id = q.id),
a AS (SELECT request_id, id, 'vector' AS channel, s FROM rk UNION ALL SELECT request_id, id, 'entity', s FROM ent2)
SELECT request_id, id, channel, round(s, 6) AS similarity, CASE WHEN id % 10 = 1 THEN 'noise' WHEN channel = 'entity' AND s < 0 THEN 'far' END AS reason FROM a""")
def chunk_channel(t: Tables) -> DataFrame:
    """Every request's chunks by vector and by entities that it names; some are markup, some have no vector or an unfinished document."""
    x = _channel_tables(t)
    content = F.when(F.col("id") % 10 == 1, F.lit(" <div align='x'>")).otherwise(F.col("content"))
    chunks = x["memories"].select("id", "container", content.alias("content"), F.when(F.col("id") % 13 != 0, F.col("vec")).alias("vec"), F.when(F.col("id") % 8 == 0, "processing").otherwise("done").alias("status"))
    found = channels.chunk_channel(x["requests"], chunks, x["entities"], x["links"].withColumnRenamed("memory_id", "chunk_id"), _LIMITS)
    return found.withColumn("similarity", F.round("similarity", 6))


# ---------------------------------------------------------------- claims in two stages
_CLAIM = "SELECT vec_id AS id, label % 3 AS owner_id, CASE WHEN vec_id % 3 > 0 THEN 's' || vec_id % 3 END AS scope, 'k' || vec_id % 4 AS claim_kind, vec_id % 11 <> 0 AS active, CASE vec_id % 5 WHEN 0 THEN NULL ELSE vec_id % 5 * 0.2 END AS confidence, CASE WHEN vec_id % 13 <> 0 THEN embedding END AS embedding FROM embeddings"
_ASKS = "SELECT vec_id AS request_id, label % 3 AS owner_id, CASE WHEN vec_id % 100 = 50 THEN 's1' END AS scope, CASE WHEN vec_id % 150 = 0 THEN 'k1' END AS claim_kind, embedding FROM embeddings WHERE vec_id % 50 = 0"
_SEEN = "q.owner_id = e.owner_id AND e.active AND (e.scope IS NULL OR e.scope = q.scope) AND (q.claim_kind IS NULL OR e.claim_kind = q.claim_kind)"


def _claims(t: Tables) -> tuple[DataFrame, DataFrame]:
    e, n = t.embeddings, F.col("vec_id")
    asks = e.where("vec_id % 50 = 0").select(n.alias("request_id"), (F.col("label") % 3).alias("owner_id"), F.when(n % 100 == 50, "s1").alias("scope"), F.when(n % 150 == 0, "k1").alias("claim_kind"), F.col("embedding").alias("query_vec"))
    rows = e.select(n.alias("id"), (F.col("label") % 3).alias("owner_id"), F.when(n % 3 > 0, F.concat(F.lit("s"), (n % 3).cast("string"))).alias("scope"), F.concat(F.lit("k"), (n % 4).cast("string")).alias("claim_kind"), F.when(n % 11 != 0, "active").otherwise("superseded").alias("status"), F.when(n % 5 != 0, (n % 5) * F.lit(0.2)).alias("content_confidence"), F.when(n % 13 != 0, F.col("embedding")).alias("vec"))
    return asks, rows


@query(f"""WITH c AS ({_CLAIM}), a AS ({_ASKS})
SELECT q.request_id, e.id, round({_SIM}, 6) AS similarity, row_number() OVER (PARTITION BY q.request_id ORDER BY round({_SIM}, 9) DESC, e.id)::INT AS rank FROM a q JOIN c e ON {_SEEN} WHERE e.embedding IS NOT NULL QUALIFY rank <= 20""")
def claim_candidates(t: Tables) -> DataFrame:
    return claims.candidates(*_claims(t)).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH c AS ({_CLAIM}), a AS ({_ASKS}),
s AS (SELECT q.request_id, e.id, e.confidence, CASE WHEN e.embedding IS NOT NULL THEN {_SIM} END AS s, count(*) OVER (PARTITION BY q.request_id) AS n_candidates FROM a q JOIN c e ON {_SEEN}),
r AS (SELECT *, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY request_id ORDER BY round(s, 9) DESC NULLS LAST, id) <= 12 THEN round((s + 1) / 2, 4) ELSE 0 END AS relevance FROM s),
f AS (SELECT *, round(relevance * coalesce(confidence, 0.4)::DOUBLE, 4) AS final FROM r)
SELECT request_id, id, relevance::DOUBLE AS relevance, final::DOUBLE AS final, row_number() OVER (PARTITION BY request_id ORDER BY final DESC, id)::INT AS rank, coalesce(confidence < 0.4, true) AS low_confidence, n_candidates FROM f QUALIFY rank <= 15""")
def claim_search(t: Tables) -> DataFrame:
    """The twelve most similar claims are re-scored; others of the scope come after them with relevance 0."""
    return claims.search(*_claims(t), limit=15, coarse=12)


# ---------------------------------------------------------------- versions and walks
_UPDATES = "SELECT o_orderkey AS a, lag(o_orderkey) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) UNION ALL SELECT min_by(o_orderkey, (o_orderdate, o_orderkey)), max_by(o_orderkey, (o_orderdate, o_orderkey)) FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey UNION ALL SELECT o_orderkey, -1 FROM orders WHERE o_orderkey % 10 = 0"


def _updates(t: Tables) -> DataFrame:
    """Each order updates the one before; some first orders close the circle, some edges lead nowhere."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    at = F.struct("o_orderdate", "o_orderkey")
    before = t.orders.select(F.col("o_orderkey").alias("from_id"), F.lag("o_orderkey").over(w).alias("to_id"))
    circle = t.orders.where("o_custkey % 7 = 0").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("from_id"), F.max_by("o_orderkey", at).alias("to_id")).drop("o_custkey")
    return before.unionByName(circle).unionByName(t.orders.where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("from_id"), F.lit(-1).cast("long").alias("to_id")))


@query(f"""WITH RECURSIVE u AS (SELECT DISTINCT a, b FROM ({_UPDATES}) WHERE b IN (SELECT o_orderkey FROM orders)),
r AS (SELECT a AS seed, b AS id, 0 AS depth FROM u UNION SELECT r.seed, u.b, r.depth + 1 FROM r JOIN u ON u.a = r.id WHERE r.depth < 10),
m AS (SELECT seed, id, min(depth)::INT AS depth FROM r GROUP BY 1, 2)
SELECT seed, id, depth, o_orderstatus <> 'F' AS is_latest, row_number() OVER (PARTITION BY seed ORDER BY o_orderdate DESC, depth, id)::INT AS position FROM m JOIN orders ON o_orderkey = id""")
def version_history(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "F").alias("is_latest"))
    return graph.version_history(rows, _updates(t)).drop("created_at")


@query()
def memory_walk(t: Tables) -> DataFrame:
    """Up to five memories along relations, from every 50th; part keys tie orders, so some have many."""
    x = _channel_tables(t)
    return graph.memory_walk(t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id")), x["memories"], x["relations"], types=["extends", "updates"])


_CHAIN = "SELECT c_custkey AS a, CASE WHEN c_custkey % 12 <> 0 THEN c_custkey + 1 WHEN c_custkey % 36 = 0 THEN c_custkey - 3 END AS b, CASE WHEN c_custkey % 5 = 0 THEN 'extends' ELSE 'supersedes' END AS type FROM customer"


@query(f"""WITH RECURSIVE e AS (SELECT x.*, c_nationkey % 3 AS o FROM ({_CHAIN}) x JOIN customer ON c_custkey = a), c AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey % 3 = 1), own AS (SELECT * FROM e WHERE o = 1),
s AS (SELECT DISTINCT a, b FROM own WHERE type = 'supersedes' AND b IS NOT NULL), r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b), f AS (SELECT * FROM r WHERE a <> b),
h AS (SELECT a, string_agg(b, ',' ORDER BY b) AS heads FROM f WHERE b NOT IN (SELECT a FROM s) GROUP BY 1)
SELECT id AS claim_id, (SELECT count(*) FROM own WHERE a = id) AS n_out, (SELECT count(*) FROM own WHERE b = id) AS n_in, (SELECT count(*) FROM f WHERE a = id) AS n_above, (SELECT count(*) FROM f WHERE b = id) AS n_below, coalesce(heads, CASE WHEN id IN (SELECT a FROM s) THEN '' ELSE id::VARCHAR END) AS heads FROM c LEFT JOIN h ON h.a = id""")
def claim_lineage(t: Tables) -> DataFrame:
    """Edges and supersede chains of one owner's claims."""
    found = graph.chains(*_chain_tables(t), owner="1")
    return found.withColumn("heads", F.array_join(F.col("heads").cast("array<string>"), ","))


def _chain_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("claim_id"), (F.col("c_nationkey") % 3).cast("string").alias("owner_id"))
    edges = t.customer.select(k.alias("from_claim"), F.when(k % 12 != 0, k + 1).when(k % 36 == 0, k - 3).alias("to_claim"), F.when(k % 5 == 0, "extends").otherwise("supersedes").alias("type"))
    return rows, edges


@query(f"""WITH e AS ({_CHAIN}), c AS (SELECT c_custkey AS id, (c_nationkey % 3)::VARCHAR AS owner_id FROM customer)
SELECT owner_id, count(*) AS claim_count, any_value(ev) AS evidence_count, any_value(ce) AS claim_evidence_count, (SELECT count(*) FROM e JOIN c d ON d.id = e.a WHERE d.owner_id = c.owner_id) AS lineage_edge_count FROM c
LEFT JOIN (SELECT (user_id % 3)::VARCHAR AS owner_id, count(*) AS ev FROM events GROUP BY 1) USING (owner_id) LEFT JOIN (SELECT d.owner_id, count(*) AS ce FROM orders JOIN c d ON d.id = o_custkey GROUP BY 1) USING (owner_id) GROUP BY owner_id""")
def owner_network(t: Tables) -> DataFrame:
    rows, edges = _chain_tables(t)
    evidence = t.events.select((F.col("user_id") % 3).cast("string").alias("owner_id"))
    return graph.network(rows, edges, evidence, t.orders.select(F.col("o_custkey").alias("claim_id")))


# ---------------------------------------------------------------- evidence
_JUDGED = """ev AS (SELECT 'ev_' || event_id AS evidence_id, ts, event_id, user_id, event_type, CASE WHEN event_id % 11 > 0 THEN 's' || event_id % 6 END AS session_id, CASE WHEN event_type = 'click' THEN 0.3 WHEN event_type = 'view' AND event_id % 2 = 0 THEN 0.0 ELSE 0.8 END AS w FROM events WHERE event_id % 10 <> 9)"""
#: Who a judgement supports: views and clicks the user's claim, errors the next user's.
_BACKS = "CASE WHEN event_type IN ('view', 'click') THEN 'cl_' || user_id WHEN event_type = 'error' THEN 'cl_' || user_id + 1 END"


def _evidence(t: Tables) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    e = t.events
    name = F.concat(F.lit("ev_"), F.col("event_id"))
    kind = F.col("event_type")
    extraction = F.when(kind == "click", "paraphrase").when((kind == "view") & (F.col("event_id") % 2 == 0), "inference").otherwise("verbatim")
    evidence = e.select(name.alias("evidence_id"), F.col("ts").alias("observed_at"), F.when(F.col("event_id") % 10 == 9, F.repeat(F.lit("x"), 1501)).otherwise("short").alias("content"), F.lit("agent_add").alias("source_kind"), extraction.alias("extraction_type"), F.when(F.col("event_id") % 11 > 0, F.concat(F.lit("s"), (F.col("event_id") % 6).cast("string"))).alias("session_id"), F.lit("fact").alias("claim_kind"))
    own, following = F.concat(F.lit("cl_"), F.col("user_id").cast("string")), F.concat(F.lit("cl_"), (F.col("user_id") + 1).cast("string"))
    judged = lambda what, target, ord_: F.struct(F.lit(what).alias("judgment"), target.alias("target_claim_id"), F.lit(ord_).alias("ord"))
    all_ = F.when(kind == "view", F.array(judged("SUPPORT", own, 0), judged("SUPPORT", following, 1))).when(kind == "click", F.array(judged("REDUNDANT", own, 0))).when(kind == "error", F.array(judged("CONFLICT", own, 0), judged("SUPPORT", following, 1))).when(kind == "purchase", F.array(judged("UNRELATED", own, 0), judged("CONFLICT", own, 1))).otherwise(F.array(judged("UNRELATED", F.lit(None).cast("string"), 0)))
    judgements = e.select(name.alias("evidence_id"), F.lit(0).alias("claim_no"), F.explode(all_).alias("j")).select("evidence_id", "claim_no", "j.*")
    users = e.select("user_id").distinct()
    state = claims.empty_state(t.spark) | {
        "claims": users.select(own.alias("claim_id"), F.lit("fact").alias("claim_kind"), F.when(F.col("user_id") % 5 > 0, F.lit(0.2) + (F.col("user_id") % 7) / 10).alias("content_confidence"), F.lit("active").alias("status")),
        "links": users.select(own.alias("claim_id"), F.lit("old").alias("evidence_id"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("session_id")),
    }
    return state, evidence, judgements


@query(f"""WITH {_JUDGED}, u AS (SELECT DISTINCT 'cl_' || user_id AS claim_id, user_id FROM events), b AS (SELECT *, {_BACKS} AS claim_id FROM ev),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.claim_id, session_id ORDER BY ts, evidence_id) AS turn FROM b JOIN u USING (claim_id)),
g AS (SELECT claim_id, product(1 - w * 0.2) AS rest, arg_min(w, (ts, evidence_id)) AS w FROM r JOIN u USING (claim_id) WHERE w > 0 AND (session_id IS NULL OR (turn = 1 AND session_id <> 's' || u.user_id % 4)) GROUP BY 1),
x AS (SELECT DISTINCT 'cl_' || user_id AS claim_id FROM ev WHERE event_type = 'purchase')
SELECT claim_id, round(CASE WHEN rest IS NULL THEN CASE WHEN user_id % 5 > 0 THEN 0.2 + user_id % 7 / 10 END WHEN user_id % 5 = 0 THEN 1 - (1 - least(w, 1)) * rest / (1 - w * 0.2) ELSE 1 - (1 - (0.2 + user_id % 7 / 10)) * rest END, 4)::DOUBLE AS content_confidence, CASE WHEN x.claim_id IS NULL THEN 'active' ELSE 'superseded' END AS status FROM u LEFT JOIN g USING (claim_id) LEFT JOIN x USING (claim_id)""")
def claim_reconciliation(t: Tables) -> DataFrame:
    """Events judge the claims of their users: supports of sessions that a claim doesn't know move its confidence, purchases supersede it."""
    state, evidence, judgements = _evidence(t)
    after = claims.applied(state, evidence, judgements)["claims"].join(state["claims"].select("claim_id"), "claim_id", "left_semi")
    return after.select("claim_id", F.round("content_confidence", 4).alias("content_confidence"), "status")


@query(f"""WITH {_JUDGED} SELECT 'cl_' || evidence_id || '_0' AS claim_id, 'fact' AS claim_kind, 0.8::DOUBLE AS content_confidence, CASE WHEN event_type = 'purchase' THEN 'cl_' || user_id END AS supersedes FROM ev WHERE NOT (event_type IN ('view', 'click') OR (event_type = 'error' AND user_id + 1 IN (SELECT user_id FROM events)))
AND NOT (event_type = 'error')""")
def reconciled_claims(t: Tables) -> DataFrame:
    """Claims that the events make, with what they supersede."""
    out = claims.applied(*_evidence(t))
    edges = out["edges"].select(F.col("to_claim").alias("claim_id"), F.col("from_claim").alias("supersedes"))
    return out["made"].join(edges, "claim_id", "left").select("claim_id", "claim_kind", "content_confidence", "supersedes")


@query("""WITH e AS (SELECT o_orderkey, o_custkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'o' || o_orderkey) AS n, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, 'o' || o_orderkey) AS f, o_orderkey % 4 AS session, o_orderstatus AS s FROM orders),
made AS (SELECT * FROM e WHERE n = 1 OR s <> 'O'), sup AS (SELECT e.*, row_number() OVER (PARTITION BY f, session ORDER BY o_orderdate, 'o' || o_orderkey) AS turn FROM e WHERE n > 1 AND s = 'O'),
g AS (SELECT sup.f, product(1 - 0.3 * 0.2) AS rest FROM sup JOIN e b ON b.o_orderkey = sup.f WHERE sup.turn = 1 AND sup.session <> b.session GROUP BY 1),
gone AS (SELECT DISTINCT f FROM e WHERE n > 1 AND s = 'F')
SELECT 'cl_o' || o_orderkey || '_0' AS claim_id, round(1 - 0.2 * coalesce(rest, 1), 6)::DOUBLE AS content_confidence, CASE WHEN gone.f IS NULL THEN 'active' ELSE 'superseded' END AS status FROM made LEFT JOIN g ON g.f = o_orderkey LEFT JOIN gone ON gone.f = o_orderkey""")
def rebuilt_claims(t: Tables) -> DataFrame:
    """The whole derived layer from evidence: an order supports (O), contradicts (F) or leaves alone (P) the claim of its customer's first."""
    return claims.rebuilt(*_orders_as_evidence(t))["claims"].select("claim_id", F.round("content_confidence", 6).alias("content_confidence"), "status")


def _orders_as_evidence(t: Tables) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit("o"), F.col("o_orderkey"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", name)
    o = t.orders.withColumns({"n": F.row_number().over(w), "f": F.first("o_orderkey").over(w)})
    first = F.concat(F.lit("cl_o"), F.col("f"), F.lit("_0"))
    what = F.when(F.col("n") == 1, "UNRELATED").when(F.col("o_orderstatus") == "O", "SUPPORT").when(F.col("o_orderstatus") == "F", "CONFLICT").otherwise("UNRELATED")
    evidence = o.select(name.alias("evidence_id"), F.col("o_orderdate").alias("observed_at"), F.lit("text").alias("content"), F.lit("agent_add").alias("source_kind"), F.lit("paraphrase").alias("extraction_type"), (F.col("o_orderkey") % 4).cast("string").alias("session_id"), F.lit("fact").alias("claim_kind"))
    return evidence, o.select(name.alias("evidence_id"), F.lit(0).alias("claim_no"), F.lit(0).alias("ord"), what.alias("judgment"), first.alias("target_claim_id"))


@query("""SELECT e.doc_id, CASE WHEN length(text) > 1500 THEN 'too_long' WHEN n > 15 THEN 'too_many_claims' WHEN n IS NULL THEN 'not_decomposed' END AS isolated FROM documents e LEFT JOIN (SELECT doc_id, len(list_filter(string_split(text, '.'), lambda x: trim(x) <> '')) AS n FROM documents WHERE n_chars % 7 <> 0) USING (doc_id)""")
def isolation_gates(t: Tables) -> DataFrame:
    """Documents as evidence, sentences as claims; some were not decomposed."""
    d = t.documents.select(F.col("doc_id").alias("evidence_id"), F.col("text").alias("content"), "n_chars")
    parts = d.where("n_chars % 7 <> 0").select("evidence_id", F.posexplode(F.filter(F.split("content", r"\."), lambda x: F.trim(x) != "")).alias("claim_no", "x"))
    return claims.isolated(d, parts).select(F.col("evidence_id").alias("doc_id"), "isolated")


@query("""WITH k AS (SELECT 'k' || n_nationkey AS key_id FROM nation WHERE n_nationkey % 5 <> 0), m AS (SELECT lpad(o_orderkey::VARCHAR, 12, '0') AS id, CASE o_custkey % 3 WHEN 0 THEN 'k' || o_custkey % 30 WHEN 1 THEN 'k' || o_custkey % 30 || '_project-dir' || o_custkey % 7 ELSE 'k' || o_custkey % 30 || '_other' END AS tag, o_custkey % 30 AS k, o_custkey FROM orders WHERE o_orderstatus <> 'F')
SELECT 'ev_' || substr(sha256('migrate:' || id), 1, 32) AS evidence_id, id AS migrated_from_memory_id, 'k' || k AS owner_id, CASE o_custkey % 3 WHEN 1 THEN 'project-dir' || o_custkey % 7 END AS scope, 'pending' AS processing_state FROM m WHERE o_custkey % 3 <> 2 AND 'k' || k IN (SELECT key_id FROM k)""")
def migrated_evidence(t: Tables) -> DataFrame:
    """Orders that are memories, moved to evidence in batches of their ids."""
    c = F.col("o_custkey")
    key = F.concat(F.lit("k"), (c % 30).cast("string"))
    tag = F.when(c % 3 == 0, key).when(c % 3 == 1, F.concat(key, F.lit("_project-dir"), (c % 7).cast("string"))).otherwise(F.concat(key, F.lit("_other")))
    rows = t.orders.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"), tag.alias("container_tag"), F.lit("text").alias("content"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") != "F").alias("is_latest"), F.lit(False).alias("is_forgotten"))
    keys = t.nation.select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key_id"), (F.col("n_nationkey") % 5 != 0).alias("is_active"))
    path = shared.new_path(t.spark, "migration")
    migration.migrate(rows, keys, path, "run")
    return migration.migrated(t.spark, path).select("evidence_id", "migrated_from_memory_id", "owner_id", "scope", "processing_state")


@query(f"""WITH c AS ({_CLAIM}), a AS ({_ASKS}),
p AS (SELECT q.request_id, e.id, row_number() OVER (PARTITION BY q.request_id ORDER BY confidence DESC NULLS LAST, e.id)::INT AS rank FROM a q JOIN c e ON q.owner_id = e.owner_id AND e.active AND (e.scope IS NULL OR e.scope = q.scope) AND e.claim_kind = 'k2' QUALIFY rank <= 5),
s AS (SELECT q.request_id, e.id, e.confidence, CASE WHEN e.embedding IS NOT NULL THEN {_SIM} END AS s FROM a q JOIN c e ON {_SEEN}),
r AS (SELECT *, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY request_id ORDER BY round(s, 9) DESC NULLS LAST, id) <= 50 THEN round((s + 1) / 2, 4) ELSE 0 END AS relevance FROM s),
f AS (SELECT request_id, id, row_number() OVER (PARTITION BY request_id ORDER BY round(relevance * coalesce(confidence, 0.4)::DOUBLE, 4) DESC, id)::INT AS rank FROM r QUALIFY rank <= 10),
u AS (SELECT request_id, id, 'preference' AS source, rank FROM p UNION ALL SELECT request_id, id, 'search', rank FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.request_id = f.request_id AND p.id = f.id))
SELECT * FROM u WHERE NOT (id % 7 = 0 AND request_id % 100 = 0)""")
def claim_context(t: Tables) -> DataFrame:
    """The surest claims of one kind and what the search finds, without what a session has had."""
    asks, rows = _claims(t)
    excluded = asks.where("request_id % 100 = 0").select("request_id").join(rows.where("id % 7 = 0").select("id", "owner_id").join(asks.select("owner_id", "request_id"), "owner_id").select("request_id", "id"), "request_id")
    return claims.context(asks, rows, excluded, "k2", 5)


@query(f"""WITH {_JUDGED}, c AS ({_CLAIM}) SELECT 'isolated' AS list, 'ev_' || event_id AS id, 'too_long' AS reason FROM events WHERE event_id % 10 = 9 UNION ALL SELECT 'low_confidence', id::VARCHAR, CASE WHEN confidence IS NULL THEN 'unknown' ELSE 'low' END FROM c WHERE active AND (confidence IS NULL OR confidence < 0.4)""")
def review_lists(t: Tables) -> DataFrame:
    _, evidence, judgements = _evidence(t)
    return claims.review(evidence, judgements, _claims(t)[1].withColumnRenamed("id", "claim_id"))
