"""Queries over the test tables, each beside the SQL that says the same.

Bindings: embeddings are memories with vectors (label: container); events are
recall logs (value: elapsed ms, error: failure); orders, lineitem and part are
memories, links and entities; orders of a customer by date are versions;
documents, pages and conversations are themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memlake.functions import rules, scoring, text
from memlake.operators import ann, chunking, graph, recall, relational, vector
from memlake.operators.shared import stored

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None):
    def register(f: Callable[[Tables], DataFrame]):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- vectors
# Queries of a search are all rows whose id is divisible by 50, against all rows.
_SIM = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_EVERY_50 = "q.vec_id % 50 = 0"
_BY_SIM = f"PARTITION BY q.vec_id ORDER BY round({_SIM}, 9) DESC, e.vec_id"


def _searched(t: Tables) -> tuple[DataFrame, DataFrame]:
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    return q, t.embeddings.select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


_TOP_10 = f"""SELECT q.vec_id AS query_id, e.vec_id AS id, round({_SIM}, 6) AS similarity, row_number() OVER ({_BY_SIM})::INT AS rank
FROM embeddings q, embeddings e WHERE {_EVERY_50} AND q.vec_id <> e.vec_id QUALIFY rank <= 10"""


@query(_TOP_10)
def vector_topk(t: Tables) -> DataFrame:
    return ann.exact_top_k(*_searched(t), 10, but_self=True).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""SELECT q.vec_id AS query_id, e.vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings q, embeddings e
WHERE {_EVERY_50} AND q.label = e.label AND {_SIM} >= 0.25 QUALIFY row_number() OVER ({_BY_SIM}) <= 10""")
def vector_threshold_search(t: Tables) -> DataFrame:
    return ann.exact_top_k(*_searched(t), 10, 0.25, by=["label"]).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT q.vec_id AS query_id, e.vec_id AS id, round({_SIM}, 6) AS similarity FROM embeddings q, embeddings e
WHERE {_EVERY_50} AND q.vec_id <> e.vec_id AND {_SIM} > 0.2 QUALIFY row_number() OVER ({_BY_SIM}) = 1""")
def nearest_duplicate_excluding_self(t: Tables) -> DataFrame:
    return ann.exact_top_k(*_searched(t), 1, 0.2, strict=True, but_self=True).select("query_id", "id", F.round("similarity", 6).alias("similarity"))


def _index(t: Tables) -> tuple[ann.Index, DataFrame, DataFrame]:
    q, rows = _searched(t)
    return ann.build(rows), q, rows


@query()
def ann_top_k(t: Tables) -> DataFrame:
    """The ten nearest rows by the index, with as many probes as a bounded sample of rows asked for."""
    index, q, rows = _index(t)
    return ann.search(index, q, 10, ann.calibrated(index, rows), but_self=True).select("query_id", "id", "similarity", "rank")


@query()
def ann_recall(t: Tables) -> DataFrame:
    """What of the exact ten nearest rows the index finds, for each query."""
    index, q, rows = _index(t)
    return ann.recall(ann.search(index, q, 10, ann.calibrated(index, rows), but_self=True), ann.exact_top_k(q, rows, 10, but_self=True))


@query(_TOP_10)
def ann_all_lists(t: Tables) -> DataFrame:
    """The index's exact way: every list is probed."""
    index, q, _ = _index(t)
    return ann.search(index, q, 10, None, but_self=True).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""SELECT e.vec_id AS id, q.vec_id AS other, round({_SIM}, 6) AS similarity FROM embeddings q, embeddings e WHERE e.vec_id < q.vec_id AND e.label = q.label AND {_SIM} >= 0.35""")
def pairwise_near_duplicates(t: Tables) -> DataFrame:
    """Of one container only, in blocks."""
    return ann.pairs(_searched(t)[1], 0.35, ["label"]).select("id", "other", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, ({_SIM} + 1) / 2 AS relevance, CASE e.label % 4 WHEN 0 THEN NULL ELSE (e.label % 4) * 0.25 END AS confidence FROM embeddings q, embeddings e WHERE {_EVERY_50} AND e.label < 6),
f AS (SELECT *, relevance * coalesce(confidence, 0.4)::DOUBLE AS final FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, id)::INT AS rank FROM f)
SELECT query_id, id, round(final, 6) AS final, rank, CASE WHEN rank <= 8 THEN 'ranked' ELSE 'cap_limit' END AS state, coalesce(confidence < 0.4, true) AS low_confidence FROM r WHERE rank <= 16""")
def prefilter_then_rank(t: Tables) -> DataFrame:
    """Claims of the first containers by relevance times confidence."""
    q, rows = _searched(t)
    rows = rows.where("label < 6").withColumn("confidence", F.when(F.col("label") % 4 != 0, (F.col("label") % 4) * 0.25))
    s = ann.exact_top_k(q, rows.withColumn("weight", F.coalesce("confidence", F.lit(scoring.UNKNOWN_FACTOR))), 16).join(rows.select("id", "confidence"), "id")
    return s.select("query_id", "id", F.round("score", 6).alias("final"), "rank", F.when(F.col("rank") <= 8, "ranked").otherwise("cap_limit").alias("state"), F.coalesce(F.col("confidence") < 0.4, F.lit(True)).alias("low_confidence"))


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {_SIM} AS sim, e.vec_id % 2 AS source_rank FROM embeddings q, embeddings e WHERE {_EVERY_50} AND e.vec_id <> q.vec_id)
SELECT query_id, id, source_rank::INT AS source_rank, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, source_rank, id) <= 12""")
def hybrid_merge(t: Tables) -> DataFrame:
    """Memories (even ids) and chunks (odd ids) merged by similarity, memories first at ties."""
    q, rows = _searched(t)
    kind = lambda k: ann.exact_top_k(q, rows.where(f"id % 2 = {k}"), 12, but_self=True).select("query_id", "id", "similarity")
    return recall.hybrid(kind(0), kind(1), 12).select("query_id", "id", "source_rank", F.round("similarity", 6).alias("similarity"))


@query()
def greedy_semantic_dedup(t: Tables) -> DataFrame:
    """Requests of 40 vectors each, as capped recall makes them."""
    items = t.embeddings.select(F.floor(F.col("vec_id") / 40).cast("long").alias("request_id"), F.col("vec_id").alias("ordinal"), F.lit("chunk").alias("source"), (F.col("label") % 4 + 1).cast("double").alias("priority"), "embedding")
    return vector.greedy_dedup(items, 0.2)


# ---------------------------------------------------------------- statistics
@query("""SELECT count(*) AS all_rows, count(*) FILTER (o_orderstatus <> 'F') AS total, count(*) FILTER (o_orderpriority LIKE '1%') AS static, count(*) FILTER (o_orderpriority NOT LIKE '1%') AS dynamic, count(*) FILTER (o_orderstatus = 'F') AS forgotten, count(*) FILTER (o_totalprice > 100000) AS with_embedding, round(coalesce(avg(o_totalprice) FILTER (o_orderstatus <> 'F'), 0), 2) AS avg_active FROM orders""")
def overview_filtered_counts(t: Tables) -> DataFrame:
    c = lambda e, n: F.count_if(F.expr(e)).alias(n)
    return t.orders.agg(F.count("*").alias("all_rows"), c("o_orderstatus <> 'F'", "total"), c("o_orderpriority like '1%'", "static"), c("o_orderpriority not like '1%'", "dynamic"), c("o_orderstatus = 'F'", "forgotten"), c("o_totalprice > 100000", "with_embedding"), F.round(F.coalesce(F.avg(F.expr("if(o_orderstatus <> 'F', o_totalprice, null)")), F.lit(0.0)), 2).alias("avg_active"))


def _timeline_sql(unit: str, zone: str = "") -> str:
    ts = f"(ts AT TIME ZONE 'UTC' AT TIME ZONE '{zone}')" if zone else "ts"
    return f"""WITH b AS (SELECT date_trunc('{unit}', {ts})::DATE AS bucket, count(*) AS n FROM events GROUP BY 1),
s AS (SELECT g::DATE AS bucket FROM generate_series(date_trunc('{unit}', DATE '2023-12-20'), date_trunc('{unit}', DATE '2024-02-10'), INTERVAL 1 {unit}) x(g))
SELECT s.bucket, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN b USING (bucket)"""


@query(_timeline_sql("day"))
def timeline_day_zero_fill(t: Tables) -> DataFrame:
    return relational.timeline(t.events, "ts", "day", "2023-12-20", "2024-02-10")


@query(_timeline_sql("week"))
def timeline_week_zero_fill(t: Tables) -> DataFrame:
    return relational.timeline(t.events, "ts", "week", "2023-12-20", "2024-02-10")


@query(_timeline_sql("month"))
def timeline_month_zero_fill(t: Tables) -> DataFrame:
    return relational.timeline(t.events, "ts", "month", "2023-12-20", "2024-02-10")


@query(_timeline_sql("day", "Asia/Shanghai"))
def timeline_day_shanghai(t: Tables) -> DataFrame:
    return relational.timeline(t.events, "ts", "day", "2023-12-20", "2024-02-10", "Asia/Shanghai")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 1) AS avg_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms FROM events GROUP BY 1""")
def activity_p95(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(*relational.percentile_report(t.events, "value"))


@query("""SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def daily_trend(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("""SELECT props, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, props LIMIT 5""")
def top_error_values(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'error'").groupBy("props").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "props").limit(5)


@query("""SELECT json_extract_string(props, '$.k') AS status, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE json_exists(props, '$.k') GROUP BY 1""")
def json_status_counts(t: Tables) -> DataFrame:
    e = t.events.withColumn("status", F.get_json_object("props", "$.k")).where("status is not null")
    return e.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("""WITH l AS (SELECT user_id, list(DISTINCT event_type) AS kinds, count(*) AS n FROM events GROUP BY 1) SELECT sum(len(kinds))::BIGINT AS n_kinds, max(len(kinds))::INT AS most_kinds, sum(CASE WHEN len(kinds) = 5 THEN 1 ELSE 0 END)::BIGINT AS complete, sum(n)::BIGINT AS n FROM l""")
def profile_array_rollup(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"), F.count("*").alias("n"))
    return g.agg(F.sum(F.size("kinds")).alias("n_kinds"), F.max(F.size("kinds")).alias("most_kinds"), F.sum(F.when(F.size("kinds") == 5, 1).otherwise(0)).alias("complete"), F.sum("n").alias("n"))


@query("SELECT p_type AS type, count(*) AS n FROM part GROUP BY 1")
def entity_type_distribution(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS id, count(*) AS mention_count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_entities(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("mention_count")).orderBy(F.desc("mention_count"), "id").limit(20)


@query("SELECT l_returnflag AS type, count(*) AS n, round(avg(l_discount), 3) AS avg_weight FROM lineitem GROUP BY 1")
def relation_avg_weight(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("type")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 3).alias("avg_weight"))


@query("SELECT count(*) AS isolated FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
def isolated_entities(t: Tables) -> DataFrame:
    return t.part.join(t.lineitem.select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").agg(F.count("*").alias("isolated"))


@query("""SELECT count(*) FILTER (c IS NULL) AS unknown, count(*) FILTER (c < 0.4) AS low, count(*) FILTER (c BETWEEN 0.4 AND 0.7) AS medium, count(*) FILTER (c > 0.7) AS high FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS c FROM lineitem)""")
def confidence_histogram(t: Tables) -> DataFrame:
    c = t.lineitem.select(F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 10).alias("c"))
    n = lambda e, a: F.count_if(F.expr(e)).alias(a)
    return c.agg(n("c is null", "unknown"), n("c < 0.4", "low"), n("c between 0.4 and 0.7", "medium"), n("c > 0.7", "high"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS processing, count(*) FILTER (event_type = 'view' AND ts < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 MINUTE) AS stuck FROM events GROUP BY 1""")
def stuck_detection(t: Tables) -> DataFrame:
    e = t.events
    old = F.col("ts") < F.expr("timestamp_ntz'2024-01-30 12:00:00' - interval 10 minutes")
    return e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("processing"), F.count_if((F.col("event_type") == "view") & old).alias("stuck"))


@query("""SELECT user_id, ts, n FROM (SELECT user_id, ts, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 5""")
def rate_limit_violations(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-24 * 3600 * 1_000_000, 0)
    return t.events.withColumn("n", F.count("*").over(w)).where("n > 5").select("user_id", "ts", "n")


@query("SELECT count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def retention_window(t: Tables) -> DataFrame:
    return relational.retained(t.events, "ts", "2024-01-31 00:00:00", 7).agg(F.count("*").alias("kept"))


@query("""SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY 1""")
def last_seen(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count("*").alias("n"))


# ---------------------------------------------------------------- ranking, paging, sets
@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::INT AS version, o_orderkey = last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS is_latest FROM orders""")
def version_chain(t: Tables) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.row_number().over(w).alias("version"), F.lead("o_orderkey").over(w).isNull().alias("is_latest"))


@query("""SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1""")
def latest_active_rows(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus <> 'F'").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@query("""SELECT p_partkey, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) = 1""")
def cleanup_duplicate_names(t: Tables) -> DataFrame:
    return relational.top_per_key(t.part, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 1).select("p_partkey", "p_type")


@query("""SELECT c_custkey, coalesce((SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1), (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)) AS snippet, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS links FROM customer""")
def correlated_latest_snippet(t: Tables) -> DataFrame:
    at = F.struct("o_orderdate", "o_orderkey")
    g = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.coalesce(F.max_by(F.expr("if(o_orderpriority like '1%', o_orderkey, null)"), F.when(F.col("o_orderpriority").like("1%"), at)), F.max_by("o_orderkey", at)).alias("snippet"), F.count("*").alias("links"))
    return t.customer.select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", "snippet", F.coalesce("links", F.lit(0)).alias("links"))


@query("SELECT DISTINCT tag FROM (SELECT n_name AS tag FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer UNION ALL SELECT lang FROM documents UNION ALL SELECT source FROM documents UNION ALL SELECT role FROM conversations)")
def distinct_union_containers(t: Tables) -> DataFrame:
    cols = [(t.nation, "n_name"), (t.region, "r_name"), (t.customer, "c_mktsegment"), (t.documents, "lang"), (t.documents, "source"), (t.conversations, "role")]
    out = None
    for df, c in cols:
        one = df.select(F.col(c).alias("tag"))
        out = one if out is None else out.unionByName(one)
    return out.distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (150000.0, 1000) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 21")
def keyset_page(t: Tables) -> DataFrame:
    return relational.keyset_page(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], (150000.0, 1000), 20)


@query("""SELECT doc_id, source, source_rank::INT AS source_rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS source_rank FROM documents) WHERE source_rank <= CASE source WHEN 'src0' THEN 6 WHEN 'src1' THEN 6 ELSE 4 END""")
def per_source_caps(t: Tables) -> DataFrame:
    d = t.documents.withColumn("source_rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    cap = F.when(F.col("source").isin("src0", "src1"), 6).otherwise(4)
    return d.where(F.col("source_rank") <= cap).select("doc_id", "source", "source_rank")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS rn FROM documents), a AS (SELECT doc_id FROM r WHERE rn <= 10), b AS (SELECT doc_id FROM r WHERE rn > 10 ORDER BY doc_id DESC LIMIT 5) SELECT doc_id FROM a UNION ALL SELECT doc_id FROM b""")
def stratified_sample(t: Tables) -> DataFrame:
    r = t.documents.select("doc_id", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("doc_id"))).alias("rn"))
    return r.where("rn <= 10").select("doc_id").unionByName(r.where("rn > 10").orderBy(F.desc("doc_id")).limit(5).select("doc_id"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def exclude_ids(t: Tables) -> DataFrame:
    gone = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer_%' AND (c_nationkey = 3 OR c_mktsegment IS NULL) AND c_acctbal IS DISTINCT FROM 0""")
def tenant_scope_filter(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_name").like("Customer_%") & ((F.col("c_nationkey") == 3) | F.col("c_mktsegment").isNull()) & ~F.col("c_acctbal").eqNullSafe(0)).select("c_custkey", "c_name")


@query("""SELECT coalesce(s.o_custkey, d.o_custkey) AS o_custkey, coalesce(s.n, 0) + coalesce(d.n, 0) AS n, coalesce(d.last, s.last) AS last FROM (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) s FULL JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) d ON s.o_custkey = d.o_custkey""")
def upsert_counters(t: Tables) -> DataFrame:
    half = lambda k: t.orders.where(f"o_orderkey % 2 = {k}").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last"))
    return relational.upsert(half(0), half(1), ["o_custkey"], counter="n")


# ---------------------------------------------------------------- graph
@query("""WITH l AS (SELECT l_partkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT p_partkey AS id, first_value(p_partkey) OVER (PARTITION BY lower(trim(p_type)) ORDER BY coalesce(n, 0) DESC, p_partkey) AS representative FROM part LEFT JOIN l ON id = p_partkey""")
def family_representative(t: Tables) -> DataFrame:
    e = t.part.select(F.col("p_partkey").alias("id"), F.lit("all").alias("container_tag"), F.col("p_type").alias("name"))
    return graph.families(e, t.lineitem.select(F.col("l_partkey").alias("entity_id"))).select("id", "representative")


@query("SELECT l_partkey AS entity, count(*) AS hits FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') ON l_orderkey = o_orderkey GROUP BY 1 ORDER BY hits DESC, entity LIMIT 25")
def cooccurrence_seeds(t: Tables) -> DataFrame:
    m = t.orders.where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("l_orderkey"))
    return t.lineitem.join(m, "l_orderkey", "left_semi").groupBy(F.col("l_partkey").alias("entity")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "entity").limit(25)


@query("""SELECT o_orderkey, count(DISTINCT lower(trim(p_type))) AS match_count FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size <= 10 GROUP BY o_orderkey, o_orderdate ORDER BY match_count DESC, o_orderdate DESC, o_orderkey LIMIT 50""")
def memories_by_entities(t: Tables) -> DataFrame:
    p = t.part.where("p_size <= 10").select(F.col("p_partkey").alias("l_partkey"), text.normalized_name(F.col("p_type")).alias("name"))
    j = t.lineitem.select("l_orderkey", "l_partkey").join(p, "l_partkey").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    g = j.groupBy(F.col("l_orderkey").alias("o_orderkey"), "o_orderdate").agg(F.count_distinct("name").alias("match_count"))
    return g.orderBy(F.desc("match_count"), F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "match_count")


@query("""SELECT n_nationkey AS id, CASE WHEN n_regionkey = n_nationkey THEN n_nationkey ELSE n_regionkey END AS other, 'out' AS direction FROM nation UNION ALL SELECT n_regionkey, n_nationkey, 'in' FROM nation""")
def related_either_direction(t: Tables) -> DataFrame:
    e = t.nation.select(F.col("n_nationkey").alias("from_id"), F.col("n_regionkey").alias("to_id"), F.lit(0.5).alias("confidence"))
    return graph.neighbours(e).select("id", "other", "direction")


def _edges(t: Tables) -> DataFrame:
    a = t.customer.select((F.col("c_custkey") + 1000).cast("long").alias("from_id"), F.col("c_nationkey").cast("long").alias("to_id"))
    b = t.nation.select(F.col("n_nationkey").cast("long").alias("from_id"), (F.col("n_regionkey") + 500).cast("long").alias("to_id"))
    return a.unionByName(b).withColumn("confidence", F.lit(0.5))


@query("""WITH RECURSIVE e AS (SELECT c_custkey + 1000 AS a, c_nationkey::BIGINT AS b FROM customer UNION ALL SELECT n_nationkey::BIGINT, n_regionkey::BIGINT + 500 FROM nation), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(seed, id, depth) AS (SELECT a, a, 0 FROM (SELECT DISTINCT a FROM s WHERE a % 50 = 0) UNION SELECT r.seed, s.b, r.depth + 1 FROM r JOIN s ON s.a = r.id WHERE r.depth < 2)
SELECT seed, id, min(depth)::INT AS depth FROM r GROUP BY 1, 2""")
def reachability_depth2(t: Tables) -> DataFrame:
    e = _edges(t)
    return graph.reachable(_every_50th_vertex(e), e, 2)


def _every_50th_vertex(e: DataFrame) -> DataFrame:
    return e.select(F.col("from_id").alias("id")).union(e.select("to_id")).where("id % 50 = 0").distinct()


@query()
def dfs_traverse(t: Tables) -> DataFrame:
    e = _edges(t)
    return graph.dfs_order(_every_50th_vertex(e), e, 2, 5)


@query("""SELECT l_suppkey AS from_id, l_partkey AS to_id, l_returnflag AS relation_type, count(*) AS mentions, round(least(0.5 + 0.1 * (count(*) - 1), 1.0), 6)::DOUBLE AS weight FROM lineitem GROUP BY ALL""")
def edge_upsert_weights(t: Tables) -> DataFrame:
    g = graph.store_edges(t.lineitem.select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("relation_type")))
    return g.withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- texts
@query("""SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*) AS copies FROM documents GROUP BY 2""")
def exact_doc_dedup(t: Tables) -> DataFrame:
    return t.documents.groupBy(text.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(r"""WITH d AS (SELECT doc_id, text || repeat('汉字1', (doc_id % 40)::INT) AS text FROM documents), n AS (SELECT *, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS han, len(regexp_extract_all(text, '[^\pL\pM\p{Nd}\p{Pc}\s\p{Z}]')) AS symbols FROM d)
SELECT doc_id, (han + len(regexp_extract_all(text, '[a-zA-Z]+')) + len(regexp_extract_all(text, '[0-9]+')) + symbols // 2)::INT AS tokens, CASE WHEN length(text) = 0 THEN 0 WHEN han / length(text) > 0.3 THEN len(regexp_extract_all(text, '[^\s]')) ELSE greatest(length(text) // 4, 1) END::INT AS dense_tokens, len(regexp_extract_all(text, '[^ \t\n\r\f]+'))::INT AS words FROM n""")
def token_estimates(t: Tables) -> DataFrame:
    """Documents with some Han characters behind them."""
    d = t.documents.select("doc_id", F.expr("concat(text, repeat('汉字1', cast(doc_id % 40 as int)))").alias("text"))
    c = F.col("text")
    return d.select("doc_id", text.token_estimate(c).alias("tokens"), text.dense_token_estimate(c).alias("dense_tokens"), F.regexp_count(c, F.lit(r"[^ \t\n\r\f]+")).alias("words"))


@query(r"""WITH d AS (SELECT doc_id, substr(text, 1, (doc_id % 200)::INT) || repeat('中', (doc_id % 70)::INT) AS text FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(text, '\S')) AS visible, doc_id % 70 AS han, len(regexp_extract_all(text, '\p{L}'))::INT AS letters FROM d)
SELECT doc_id, CASE WHEN visible > 0 AND han / visible > 0.3 THEN 'zh' ELSE 'en' END AS language, CASE WHEN letters = 0 THEN 'unknown' WHEN han / letters > 0.3 THEN 'chinese' ELSE 'english' END AS by_letters, letters FROM n""")
def language_ratio(t: Tables) -> DataFrame:
    """Beginnings of documents with Han characters behind them."""
    d = t.documents.select("doc_id", F.expr("concat(substring(text, 1, cast(doc_id % 200 as int)), repeat('中', cast(doc_id % 70 as int)))").alias("text"))
    return d.select("doc_id", text.document_language(F.col("text")).alias("language"), text.alpha_language(F.col("text")).alias("by_letters"), F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"))


@query(r"""SELECT page_id, regexp_matches(html, '^\s*<[a-zA-Z/!]') AS noise, md5(regexp_replace(html, '<[^>]+>', '', 'g')) AS stripped FROM pages""")
def html_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.is_html_noise(F.col("html")).alias("noise"), F.md5(text.html_stripped(F.col("html"))).alias("stripped"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview, CASE WHEN length(text) > 600 THEN true ELSE false END AS clamped FROM documents""")
def preview_and_clamp(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.preview(F.col("text")).alias("preview"), (F.length("text") > 600).alias("clamped"))


@query(r"""WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[\s,.;!?]+')) AS name FROM documents), n AS (SELECT name FROM w WHERE name <> '')
SELECT count(*) AS names, count(*) FILTER (length(name) < 2) AS short, count(*) FILTER (length(name) > 20) AS long, count(*) FILTER (regexp_matches(name, '^[0-9.]+$')) AS numeric, count(*) FILTER (regexp_matches(lower(name), '^(bg_)?[a-f0-9]{6,}$')) AS hex FROM n""")
def entity_noise_rules(t: Tables) -> DataFrame:
    w = t.documents.select(F.explode(F.split("text", r"[ \t\n\f\r,.;!?]+")).alias("name")).where("name <> ''").distinct()
    n = lambda e, a: F.count_if(F.expr(e)).alias(a)
    return w.agg(F.count("*").alias("names"), n("length(name) < 2", "short"), n("length(name) > 20", "long"), n(r"name rlike '^[0-9.]+$'", "numeric"), n(r"lower(name) rlike '^(bg_)?[a-f0-9]{6,}$'", "hex"))


@query()
def rule_entities(t: Tables) -> DataFrame:
    """Names of documents that pass every noise rule, with mentions."""
    w = t.documents.select("doc_id", F.explode_outer(text.keywords(F.col("text"))).alias("name")).where("name is not null")
    # each name is judged once: the rules cost more than the counting
    names = w.groupBy("name").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))
    return stored(names, "names").where(~rules.noise_name(F.col("name")))


@query(r"""SELECT d.conv_id, d.turn, round(CASE WHEN greatest(len(d.w), len(p.w)) = 0 THEN 0 ELSE len(list_intersect(d.w, p.w)) / greatest(len(d.w), len(p.w)) END, 6) AS overlap
FROM (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations) d JOIN (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS w FROM conversations) p ON d.conv_id = p.conv_id AND d.turn = p.turn + 1""")
def word_overlap(t: Tables) -> DataFrame:
    c = t.conversations
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return c.join(p, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.word_overlap(F.col("text"), F.col("before")), 6).alias("overlap"))


@query("""SELECT conv_id, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn, role, text) AS summary, count(*) AS turns FROM conversations GROUP BY 1""")
def session_summary(t: Tables) -> DataFrame:
    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.col("text"))
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("l"), F.count("*").alias("turns"))
    return g.select("conv_id", F.array_join("l.line", "\n").alias("summary"), "turns")


@query("""SELECT doc_id, item_id FROM documents JOIN benchmark ON contains(documents.text, benchmark.text)""")
def substring_containment_join(t: Tables) -> DataFrame:
    """Whole items as needles."""
    return relational.containing(t.documents.select("doc_id", "text"), t.benchmark.select("item_id", F.col("text").alias("needle"))).select("doc_id", "item_id")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS rn, sha256(text) AS h FROM documents)
SELECT a.doc_id, coalesce(b.doc_id, c.doc_id) AS existing, CASE WHEN b.doc_id IS NOT NULL THEN CASE WHEN b.h = a.h THEN 'unchanged' ELSE 'update' END WHEN c.doc_id IS NOT NULL THEN 'hash' ELSE 'new' END AS action
FROM (SELECT * FROM o WHERE doc_id % 2 = 1) a LEFT JOIN (SELECT source, n_chars, min(doc_id) AS doc_id, arg_min(h, doc_id) AS h FROM o WHERE doc_id % 2 = 0 GROUP BY 1, 2) b ON a.source = b.source AND a.n_chars = b.n_chars LEFT JOIN (SELECT h, min(doc_id) AS doc_id FROM o WHERE doc_id % 2 = 0 GROUP BY 1) c ON a.h = c.h""")
def document_dedup_cascade(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars", text.content_hash(F.col("text")).alias("h"))
    old = d.where("doc_id % 2 = 0")
    by_key = old.groupBy("source", "n_chars").agg(F.min("doc_id").alias("k"), F.min_by("h", "doc_id").alias("kh"))
    by_hash = old.groupBy("h").agg(F.min("doc_id").alias("x"))
    j = d.where("doc_id % 2 = 1").join(by_key, ["source", "n_chars"], "left").join(by_hash, "h", "left")
    action = F.when(F.col("k").isNotNull(), F.when(F.col("kh") == F.col("h"), "unchanged").otherwise("update")).when(F.col("x").isNotNull(), "hash").otherwise("new")
    return j.select("doc_id", F.coalesce("k", "x").alias("existing"), action.alias("action"))


@query()
def chunk_documents(t: Tables) -> DataFrame:
    return chunking.chunks(t.documents)


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, k, n AS size, 0 AS chunk FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, CASE WHEN f.size + t.n > 3000 THEN t.n ELSE f.size + t.n END, CASE WHEN f.size + t.n > 3000 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1)
SELECT conv_id, chunk::INT AS chunk, string_agg('[' || role || '] ' || text, chr(10) ORDER BY turn) AS content FROM f JOIN t USING (conv_id, k) GROUP BY conv_id, chunk""")
def chunk_conversations(t: Tables) -> DataFrame:
    return chunking.conversation_chunks(t.conversations)


@query()
def context_fuse(t: Tables) -> DataFrame:
    """Requests of 40 items over four sources, deduplicated and capped."""
    e = t.embeddings
    source = F.element_at(F.array(*map(F.lit, ("profile", "projectMemory", "userMemory", "chunk"))), (F.col("label") % 4 + 1).cast("int"))
    items = e.select(F.floor(F.col("vec_id") / 40).cast("long").alias("request_id"), F.col("vec_id").alias("ordinal"), source.alias("source"), F.concat(F.lit("m"), F.col("vec_id")).alias("content"), scoring.channel_priority(source, F.col("label") == 9, F.col("label") == 5).alias("priority"), "embedding", F.col("vec_id").alias("position"))
    return recall.fused(items, 0.3)


# ---------------------------------------------------------------- claims
_GIVEN = "CASE event_type WHEN 'view' THEN 'agent_add' WHEN 'click' THEN 'user_correction' WHEN 'error' THEN 'outcome_trace' WHEN 'purchase' THEN 'document' ELSE 'bogus' END AS s, CASE user_id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' WHEN 2 THEN 'constraint' WHEN 3 THEN 'learned-pattern' ELSE 'bogus' END AS k, CASE event_id % 3 WHEN 0 THEN 'inference' WHEN 1 THEN 'verbatim' END AS x"


@query(f"""WITH g AS (SELECT event_id, {_GIVEN} FROM events), a AS (SELECT *, CASE WHEN k = 'bogus' THEN NULL WHEN s = 'user_correction' THEN 6 WHEN s = 'outcome_trace' THEN 3 WHEN s = 'document' THEN 2 WHEN s = 'agent_add' THEN CASE k WHEN 'preference' THEN 5 WHEN 'learned-pattern' THEN 3 ELSE 4 END END * CASE WHEN x = 'inference' THEN 0.7 ELSE 1.0 END AS a FROM g)
SELECT s AS source_kind, k AS claim_kind, x AS extraction_type, round(a / (a + 1), 4)::DOUBLE AS confidence, count(*) AS n FROM a GROUP BY ALL""")
def claim_priors(t: Tables) -> DataFrame:
    """What a claim is believed before anything supports it, by what the events say of its source."""
    g = t.events.selectExpr("event_id", *_GIVEN.replace(" AS s, ", " AS s|").replace(" AS k, ", " AS k|").split("|"))
    g = g.select(F.col("s").alias("source_kind"), F.col("k").alias("claim_kind"), F.col("x").alias("extraction_type"))
    return g.withColumn("confidence", scoring.prior_confidence(F.col("source_kind"), F.col("claim_kind"), F.col("extraction_type"))).groupBy("source_kind", "claim_kind", "extraction_type", "confidence").agg(F.count("*").alias("n"))


@query("""SELECT event_id, round(CASE WHEN w <= 0 THEN c WHEN c IS NULL THEN least(w, 1.0) ELSE c + (1 - c) * w * 0.2 END, 4) AS confidence FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 0.8 WHEN 'click' THEN 0.3 WHEN 'error' THEN 0.0 ELSE 0.6 END AS w, CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 97) / 97.0 END AS c FROM events)""")
def reinforce_scores(t: Tables) -> DataFrame:
    w = F.when(F.col("event_type") == "view", 0.8).when(F.col("event_type") == "click", 0.3).when(F.col("event_type") == "error", 0.0).otherwise(0.6)
    c = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 97) / F.lit(97.0))
    return t.events.select("event_id", F.round(scoring.reinforced(c, w), 4).alias("confidence"))
