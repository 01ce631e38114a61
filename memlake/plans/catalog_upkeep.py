"""Queries on profiles with a question, decisions of a person, noise, anomalies, samples and scans.

Bindings: parts are entities of their brands' containers, customers are claims, orders
memories; events are traces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import rules
from memlake.operators import ann, claims, memory, recall, relational
from memlake.plans.catalog import Tables, query

_SIM = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


# ---------------------------------------------------------------- profiles
@query(f"""WITH m AS (SELECT vec_id AS id, label, embedding, vec_id % 3 = 0 AS is_static, vec_id % 7 <> 0 AS worthy, vec_id AS created FROM embeddings), q AS (SELECT vec_id AS request_id, label, embedding FROM embeddings WHERE vec_id % 50 = 0),
pr AS (SELECT request_id, CASE WHEN is_static THEN 'static' ELSE 'dynamic' END AS section, m.id::VARCHAR AS item, row_number() OVER (PARTITION BY request_id, is_static ORDER BY created DESC, m.id)::INT AS position FROM q JOIN m USING (label) WHERE worthy QUALIFY position <= CASE WHEN is_static THEN 30 ELSE 10 END),
se AS (SELECT q.request_id, 'search' AS section, e.id::VARCHAR AS item, row_number() OVER (PARTITION BY q.request_id ORDER BY round({_SIM}, 9) DESC, e.id)::INT AS position FROM q JOIN m e USING (label) WHERE {_SIM} >= 0.2 QUALIFY position <= 30),
en AS (SELECT request_id, 'entity' AS section, 'name' || n || ':' || string_agg(i, ',' ORDER BY i) AS item, n FROM (SELECT request_id, n, x.vec_id AS i FROM q, range(1, 13) r(n), embeddings x WHERE x.label = q.label AND x.vec_id % 12 + 1 = n AND contains('about name' || q.request_id // 50 % 12 + 1 || ' here', 'name' || n) QUALIFY row_number() OVER (PARTITION BY request_id, n ORDER BY x.vec_id) <= 5) GROUP BY request_id, n)
SELECT * FROM pr UNION ALL SELECT * FROM se UNION ALL SELECT request_id, section, item, row_number() OVER (PARTITION BY request_id ORDER BY length('name' || n) DESC, 'name' || n)::INT FROM en""")
def profile_with_query(t: Tables) -> DataFrame:
    """The profile of each request's container, what its question finds, and the entities that it names."""
    e, n = t.embeddings, F.col("vec_id")
    asks = e.where("vec_id % 50 = 0").select(n.alias("request_id"), F.col("label").alias("container"), F.col("embedding").alias("query_vec"), F.expr("concat('about name', (vec_id div 50) % 12 + 1, ' here')").alias("query"))
    rows = e.select(F.col("label").alias("container"), n.alias("id"), n.alias("created_at"), (n % 3 == 0).alias("is_static"), (n % 7 != 0).alias("profile_worthy"))
    section = F.when(F.col("is_static"), "static").otherwise("dynamic")
    own = memory.profile(rows, 30, 10).join(asks.select("request_id", "container"), "container").select("request_id", section.alias("section"), F.col("id").cast("string").alias("item"), "position")
    found = ann.exact_top_k(asks.select(F.col("request_id").alias("query_id"), "query_vec", "container"), e.select(n.alias("id"), F.col("label").alias("container"), F.col("embedding").alias("vec")), 30, 0.2, by=["container"])
    found = found.select(F.col("query_id").alias("request_id"), F.lit("search").alias("section"), F.col("id").cast("string").alias("item"), F.col("rank").alias("position"))
    links = e.select(n.alias("memory_id"), (F.col("label") * 100 + n % 12 + 1).cast("long").alias("entity_id"))
    entities = links.join(e.select(n.alias("memory_id"), F.col("label").alias("container")), "memory_id").groupBy(F.col("entity_id").alias("id"), "container").agg(F.count("*").alias("mention_count")).withColumns({"name": F.concat(F.lit("name"), (F.col("id") % 100).cast("string")), "type": F.lit("thing")})
    named = memory.named_entities(asks, entities, links)
    named = named.select("request_id", F.lit("entity").alias("section"), F.concat("name", F.lit(":"), F.array_join(F.col("memory_ids").cast("array<string>"), ",")).alias("item"), "position")
    return own.unionByName(found).unionByName(named)


# ---------------------------------------------------------------- decisions
def _customers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(k.cast("string").alias("claim_id"), (k % 3).cast("string").alias("owner_id"), F.when(k % 4 > 0, F.col("c_mktsegment")).alias("scope"), F.lit("fact").alias("claim_kind"), F.when(k % 5 > 0, (k % 9) / F.lit(10.0)).alias("content_confidence"), F.lit("active").alias("status"))


@query("""WITH n AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT c_custkey::VARCHAR AS claim_id, round(CASE WHEN n IS NULL THEN CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 9 / 10.0 END WHEN c_custkey % 5 = 0 THEN 1 - 0.5 * power(0.9, n - 1) ELSE 1 - (1 - c_custkey % 9 / 10.0) * power(0.9, n) END, 6)::DOUBLE AS content_confidence FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def claims_confirmed(t: Tables) -> DataFrame:
    out = claims.confirmed(_customers(t), t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("claim_id")))
    return out.select("claim_id", F.round("content_confidence", 6).alias("content_confidence"))


@query("""WITH g AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') SELECT c_custkey::VARCHAR AS claim_id, CASE WHEN k IS NULL THEN 'active' ELSE 'retracted' END AS status, (k IS NOT NULL)::BIGINT AS edges FROM customer LEFT JOIN g ON k = c_custkey""")
def claims_forgotten(t: Tables) -> DataFrame:
    state = claims.empty_state(t.spark) | {"claims": _customers(t).select("claim_id", "claim_kind", "content_confidence", "status")}
    out = claims.forgotten(state, t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("claim_id")))
    n = out["edges"].where("to_claim is null").groupBy(F.col("from_claim").alias("claim_id")).agg(F.count("*").alias("edges"))
    return out["claims"].join(n, "claim_id", "left").select("claim_id", "status", F.coalesce("edges", F.lit(0)).alias("edges"))


@query("""WITH d AS (SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 1 THEN 'adopt' WHEN 2 THEN 'reject' END AS action, c_custkey % 4 > 0 AS scoped FROM customer), a AS (SELECT * FROM d WHERE scoped AND action = 'adopt')
SELECT 'claim' AS what, k::VARCHAR || '_global' AS claim_id, NULL AS detail FROM a UNION ALL SELECT 'edge', k::VARCHAR, k || '_global' FROM a UNION ALL SELECT 'activity', k::VARCHAR, action FROM d WHERE scoped AND action IS NOT NULL UNION ALL SELECT 'link', k || '_global', o_orderkey::VARCHAR FROM a JOIN orders ON o_custkey = k""")
def scope_promotion(t: Tables) -> DataFrame:
    """What adopting and rejecting wider scopes adds."""
    c = _customers(t)
    k = F.col("claim_id").cast("long") % 6
    decisions = c.select("claim_id", F.when(k == 1, "adopt").when(k == 2, "reject").alias("action")).where("action is not null")
    out = claims.promoted(c, t.orders.select(F.col("o_custkey").cast("string").alias("claim_id"), F.col("o_orderkey").cast("string").alias("evidence_id")), decisions)
    row = lambda df, what, detail: df.select(F.lit(what).alias("what"), "claim_id", detail.cast("string").alias("detail"))
    parts = [row(out["claims"].where("claim_id like '%global'"), "claim", F.lit(None)), row(out["edges"].withColumnRenamed("from_claim", "claim_id"), "edge", F.col("to_claim")), row(out["activity"], "activity", F.col("decision")), row(out["links"].where("claim_id like '%global'"), "link", F.col("evidence_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# ---------------------------------------------------------------- noise and anomalies
_NAMES = "CASE p_partkey % 25 WHEN 0 THEN concat(p_name, '.py') WHEN 1 THEN '12.5' WHEN 2 THEN '用户表' WHEN 3 THEN concat('v1.', p_partkey % 10) WHEN 4 THEN concat('bg_abc', p_partkey % 10, 'def') WHEN 5 THEN 'Some BUG' WHEN 6 THEN '## x' WHEN 7 THEN '史诗' WHEN 8 THEN '支付系统' WHEN 9 THEN '运输费用' WHEN 10 THEN '抽卡概率' WHEN 11 THEN 'MIGRATION plan' WHEN 12 THEN '技术12' WHEN 13 THEN '传说卡' WHEN 14 THEN '10连抽' WHEN 15 THEN '喜欢游戏' WHEN 16 THEN '修复机制' WHEN 17 THEN 'my agent' WHEN 18 THEN 'Google' WHEN 19 THEN 'x' WHEN 20 THEN 'Foo' WHEN 21 THEN '大家' ELSE substring(p_type, 1, 20) END"
_TYPES = "CASE p_partkey % 6 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'location' WHEN 3 THEN 'preference' WHEN 4 THEN 'event' ELSE 'thing' END"


def _finders_sql() -> str:
    arms = []
    for finder, type_, patterns, case, parts, whole in rules.NOISE_FINDERS:
        tests = [f"regexp_matches(name, '{p}')" if case else f"regexp_matches(name, '(?i){p}')" for p in patterns] + [f"contains(name, '{x}')" for x in parts] + [f"name = '{x}'" for x in whole]
        test = f"({' OR '.join(tests)})"
        if finder == "file_path":
            test += " AND (contains(name, '/') OR regexp_matches(name, '\\.[a-z]{2,4}$'))"
        arms.append(f"SELECT id, '{finder}' AS reason FROM e WHERE {test}" + (f" AND type = '{type_}'" if type_ else ""))
    return " UNION ALL ".join(arms)


@query(f"""WITH e AS (SELECT p_partkey AS id, {_NAMES} AS name, {_TYPES} AS type, p_size AS m FROM part), f AS ({_finders_sql()} UNION ALL SELECT id, 'length_invalid' FROM e WHERE length(name) < 2 OR length(name) > 20 UNION ALL SELECT id, 'blacklist' FROM e WHERE lower(trim(name)) IN ('大家', 'foo')
UNION ALL SELECT id, 'duplicate' FROM e QUALIFY row_number() OVER (PARTITION BY name ORDER BY m DESC, id) > 1) SELECT id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM f GROUP BY id""")
def entity_noise(t: Tables) -> DataFrame:
    """Every finder's hits, for each entity."""
    e = t.part.select(F.col("p_partkey").alias("id"), F.expr(_NAMES).alias("name"), F.expr(_TYPES).alias("type"), F.col("p_size").alias("mention_count"))
    found = memory.noisy(e, t.spark.createDataFrame([("大家",), ("Foo",)], "name string"))
    return found.select("id", F.array_join(F.array_sort("reasons"), ",").alias("reasons"))


@query("""WITH m AS (SELECT o_custkey % 7 AS container, o_orderdate AS created_at, '{"_status": "' || CASE o_orderstatus WHEN 'P' THEN 'processing' WHEN 'F' THEN 'failed' ELSE 'completed' END || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ', "_extraction_degraded": "x"' ELSE '' END || '}' AS metadata, (SELECT max(o_orderdate) FROM orders) AS now FROM orders)
SELECT container, count(*) FILTER (metadata->>'_status' = 'processing') AS processing, count(*) FILTER (metadata->>'_status' = 'processing' AND created_at < now - INTERVAL 10 MINUTE) AS processing_stuck, count(*) FILTER (metadata->>'_status' = 'failed') AS failed,
count(*) FILTER (json_exists(metadata, '$._extraction_degraded') AND created_at >= now - INTERVAL 24 HOUR) AS extraction_degraded_24h, count(*) FILTER (json_exists(metadata, '$._extraction_degraded') AND created_at >= now - INTERVAL 7 DAY) AS extraction_degraded_7d FROM m GROUP BY 1""")
def anomalies(t: Tables) -> DataFrame:
    """What is at work, stuck, failed or degraded in each container, as of the newest row."""
    status = F.when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderstatus") == "F", "failed").otherwise("completed")
    metadata = F.concat(F.lit('{"_status": "'), status, F.lit('"'), F.when(F.col("o_orderkey") % 3 == 0, ', "_extraction_degraded": "x"').otherwise(""), F.lit("}"))
    now = t.orders.agg(F.max("o_orderdate").alias("now"))
    m = t.orders.select((F.col("o_custkey") % 7).alias("container"), F.col("o_orderdate").alias("created_at"), metadata.alias("metadata")).crossJoin(F.broadcast(now))
    s, degraded = F.get_json_object("metadata", "$._status"), F.get_json_object("metadata", "$._extraction_degraded").isNotNull()
    n = lambda c, name: F.count_if(c).alias(name)
    since = lambda x: F.col("created_at") >= F.col("now") - F.expr(f"interval {x}")
    return m.groupBy("container").agg(n(s == "processing", "processing"), n((s == "processing") & (F.col("created_at") < F.col("now") - F.expr("interval 10 minutes")), "processing_stuck"), n(s == "failed", "failed"), n(degraded & since("24 hours"), "extraction_degraded_24h"), n(degraded & since("7 days"), "extraction_degraded_7d"))


# ---------------------------------------------------------------- samples and scans
@query("SELECT event_id FROM events WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT % 10000 < 500 OR event_type = 'error'")
def trace_sample(t: Tables) -> DataFrame:
    """A twentieth of all traces, and all that failed."""
    return memory.sampled(t.events, F.col("event_id"), 0.05, F.col("event_type") == "error").select("event_id")


@query("""WITH r AS (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS page FROM orders), p AS (SELECT page, max(o_orderkey) AS last, count(*) AS n FROM r GROUP BY 1) SELECT page, lag(last) OVER (ORDER BY page) AS after, last, n FROM p""")
def scan_pages(t: Tables) -> DataFrame:
    """All pages of a resumable scan by key."""
    return relational.scan_pages(t.orders, "o_orderkey", 100)


# ---------------------------------------------------------------- lists, filters and sums
@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey)::INT AS position FROM orders WHERE o_orderstatus <> 'F' QUALIFY position <= 100")
def container_lists(t: Tables) -> DataFrame:
    """The newest active memories of each container, in order."""
    rows = t.orders.withColumns({"is_latest": F.lit(True), "is_forgotten": F.col("o_orderstatus") == "F"}).where(relational.active())
    return relational.top_per_key(rows, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], 100).select("o_custkey", "o_orderkey", F.col("rank").alias("position"))


@query("SELECT c_custkey, 'wanted' AS asked FROM customer WHERE c_custkey % 4 = 0 OR c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'none' FROM customer WHERE c_custkey % 4 = 0")
def claim_scopes(t: Tables) -> DataFrame:
    """What a request for a scope sees, and one without."""
    scope = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    one = lambda wanted, name: t.customer.where(relational.scoped(scope, wanted)).select("c_custkey", F.lit(name).alias("asked"))
    return one("BUILDING", "wanted").unionByName(one(None, "none"))


@query("SELECT l_partkey, l_orderkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_suppkey, l_quantity) = 1")
def first_occurrences(t: Tables) -> DataFrame:
    items = t.lineitem.withColumn("ordinal", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), "l_suppkey", "l_quantity"))
    return recall.first_seen(items, ["l_partkey"]).select("l_partkey", "l_orderkey")


@query("""WITH i AS (SELECT o_custkey AS request_id, o_orderkey AS id, o_orderpriority < '3' AS core, row_number() OVER (PARTITION BY o_custkey, o_orderpriority < '3' ORDER BY o_orderkey) AS r FROM orders) SELECT request_id, id, core FROM i WHERE r <= CASE WHEN core THEN 6 ELSE 1 END""")
def quota_truncation(t: Tables) -> DataFrame:
    """Twice three core items of a request, and one from the entity graph."""
    i = t.orders.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderpriority") < "3").alias("core"))
    return recall.quota(i.where("core"), i.where("not core"), 3).select("request_id", "id", "core")


@query("""SELECT coalesce(event_type, 'all') AS kind, count(*) AS total, count(*) FILTER (user_id % 3 <> 1) AS ok, count(*) FILTER (user_id % 3 = 0) AS cache_hits, round(avg(value) FILTER (user_id % 3 <> 0), 4) AS avg_ms, sum(length(props))::BIGINT AS text_len FROM events GROUP BY ROLLUP (event_type)""")
def embedding_health(t: Tables) -> DataFrame:
    """Embeddings by kind and in all: what succeeded, came from the cache, took, and how much text there was."""
    n = lambda c, name: F.count_if(F.expr(c)).alias(name)
    g = t.events.rollup("event_type").agg(F.count("*").alias("total"), n("user_id % 3 <> 1", "ok"), n("user_id % 3 = 0", "cache_hits"), F.round(F.avg(F.expr("if(user_id % 3 <> 0, value, null)")), 4).alias("avg_ms"), F.sum(F.length("props")).alias("text_len"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("kind"), "total", "ok", "cache_hits", "avg_ms", "text_len")


@query("""SELECT (ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai')::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def daily_trend_shanghai(t: Tables) -> DataFrame:
    day = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai").cast("date")
    return t.events.groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT props AS query, user_id, event_type AS project, user_id % 3 AS container, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY ALL""")
def last_seen_queries(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("props").alias("query"), "user_id", F.col("event_type").alias("project"), (F.col("user_id") % 3).alias("container")).agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_size > 25 GROUP BY 1 HAVING count(*) > 1")
def duplicate_names(t: Tables) -> DataFrame:
    return t.part.where("p_size > 25").groupBy("p_type").agg(F.count("*").alias("n")).where("n > 1")


@query("""WITH l AS (SELECT conv_id % 20 AS request_id, CASE role WHEN 'system' THEN 'static' WHEN 'assistant' THEN 'dynamic' ELSE 'search' END AS section, conv_id * 10 + turn AS position, substr(text, 1, 3) AS content FROM conversations WHERE NOT (role = 'user' AND substr(text, 1, 3) = '')) SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY request_id, content ORDER BY CASE section WHEN 'static' THEN 0 WHEN 'dynamic' THEN 1 ELSE 2 END, position) = 1""")
def client_dedup(t: Tables) -> DataFrame:
    """Facts and finds of a request, each text once (beginnings of turns, so that some are alike)."""
    section = F.when(F.col("role") == "system", "static").when(F.col("role") == "assistant", "dynamic").otherwise("search")
    return memory.told_once(t.conversations.select((F.col("conv_id") % 20).alias("request_id"), section.alias("section"), (F.col("conv_id") * 10 + F.col("turn")).alias("position"), F.substring("text", 1, 3).alias("content")))


@query("""WITH i AS (SELECT c_custkey, 'c' || c_nationkey AS tag, 'customer ' || c_custkey || ' is busy' AS content FROM customer JOIN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 8) ON o_custkey = c_custkey)
SELECT 'mem_' || substr(sha256(tag || '|' || content), 1, 16) AS from_id, o_orderkey::VARCHAR AS to_id, 'derives' AS type, 0.7::DOUBLE AS confidence FROM i JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'""")
def derived_memories(t: Tables) -> DataFrame:
    """What follows from many orders of a customer, with edges to those that are there."""
    name = F.concat(F.lit("c"), F.col("c_nationkey"))
    busy = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set(F.col("o_orderkey").cast("string")).alias("sources")).where("size(sources) > 8").join(t.customer, "c_custkey")
    inferences = busy.select(name.alias("container_tag"), F.concat(F.lit("customer "), F.col("c_custkey"), F.lit(" is busy")).alias("content"), "sources")
    rows = t.orders.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("c").alias("container_tag"), F.lit("order").alias("content"), F.lit(False).alias("is_inference"))
    return memory.derived(rows, inferences)[1]
