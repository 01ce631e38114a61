"""More queries over the test tables: reading and writing memories, profiles, graph, claims, upkeep and evaluation.

Bindings: orders are memories (customer: container; priority 1-URGENT and 2-HIGH:
static), lineitem their links to entities (part) or chunks of them, customers are
claims, events evidence; documents, pages and conversations are themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import rules, text
from memlake.operators import channels, memory, relational
from memlake.plans.catalog import Tables, query

_MEMORIES = "SELECT o_custkey AS container, o_orderkey AS id, o_orderdate AS created_at, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_static, CASE o_orderstatus WHEN 'P' THEN false WHEN 'O' THEN true END AS profile_worthy, o_orderpriority = '1-URGENT' AS is_rule FROM orders"


def _memories(t: Tables) -> DataFrame:
    worthy = F.when(F.col("o_orderstatus") == "P", False).when(F.col("o_orderstatus") == "O", True)
    return t.orders.select(F.col("o_custkey").alias("container"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_static"), worthy.alias("profile_worthy"), (F.col("o_orderpriority") == "1-URGENT").alias("is_rule"))


# ---------------------------------------------------------------- scans
@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 50 AND n_chars > 0")
def point_lookup(t: Tables) -> DataFrame:
    return memory.by_id(t.documents, "doc_id", 50, hidden=F.col("n_chars") <= 0).select("doc_id", "lang", "source", "n_chars")


@query(f"SELECT container, id, is_static, row_number() OVER (PARTITION BY container, is_static ORDER BY created_at DESC, id)::INT AS position FROM ({_MEMORIES}) WHERE coalesce(profile_worthy, true) QUALIFY position <= CASE WHEN is_static THEN 50 ELSE 20 END")
def static_dynamic_lists(t: Tables) -> DataFrame:
    return memory.profile(_memories(t), 50, 20).select("container", "id", "is_static", "position")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def document_page(t: Tables) -> DataFrame:
    return memory.page(t.documents.select("doc_id", "lang", "n_chars"), [F.desc("n_chars"), F.col("doc_id")], 40, 20)


@query("SELECT l_orderkey AS document_id, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS chunks FROM lineitem GROUP BY l_orderkey")
def chunks_by_position(t: Tables) -> DataFrame:
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("document_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("c"))
    return c.select("document_id", F.array_join(F.transform("c.l_partkey", lambda x: x.cast("string")), ",").alias("chunks"))


@query("SELECT doc_id, count(*) OVER () AS remaining FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def missing_embeddings(t: Tables) -> DataFrame:
    gone = memory.missing(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id")
    return gone.crossJoin(F.broadcast(gone.agg(F.count("*").alias("remaining"))))


@query("SELECT 'mem_' || substr(sha256(concat_ws('|', conv_id, turn, text)), 1, 16) AS id, conv_id, turn FROM conversations")
def inserted_with_id(t: Tables) -> DataFrame:
    return memory.with_id(t.conversations, "mem", ["conv_id", "turn", "text"]).select("id", "conv_id", "turn")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 1000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where(t: Tables) -> DataFrame:
    return memory.updated(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 1000), o_orderstatus=F.lit("F")).drop("o_totalprice")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS parents, (SELECT count(*) FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P') AS children")
def delete_cascade_counts(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'P'")
    left = relational.delete_cascade(t.orders, {"lines": (t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi"), "l_orderkey")}, gone, "o_orderkey")
    return left["parent"].agg(F.count("*").alias("parents")).crossJoin(left["lines"].agg(F.count("*").alias("children")))


# ---------------------------------------------------------------- filters
@query("SELECT doc_id, source FROM documents WHERE source = 'src1' OR starts_with(source, 'src1_')")
def literal_prefix_scope(t: Tables) -> DataFrame:
    return t.documents.where(memory.literal_prefix(F.col("source"), "src1")).select("doc_id", "source")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name LIKE '%7' OR c_nationkey = 3")
def three_column_scope(t: Tables) -> DataFrame:
    return t.customer.where((F.col("c_mktsegment") == "BUILDING") | F.col("c_name").endswith("7") | (F.col("c_nationkey") == 3)).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey FROM part WHERE (NULL IS NULL OR p_partkey <> NULL) AND (7 IS NULL OR p_partkey <> 7)")
def nullable_parameter(t: Tables) -> DataFrame:
    return t.part.where(memory.but_id(F.col("p_partkey"), None) & memory.but_id(F.col("p_partkey"), 7)).select("p_partkey")


@query("SELECT p_partkey, r_name FROM part, region WHERE p_name ILIKE '%' || substr(r_name, 1, 1) || '%'")
def contains_ignoring_case(t: Tables) -> DataFrame:
    """A needle of its own for each row of the other table."""
    return t.part.join(t.region, F.lower("p_name").contains(F.lower(F.substring("r_name", 1, 1)))).select("p_partkey", "r_name")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%AnD tHe%'")
def documents_containing_ignoring_case(t: Tables) -> DataFrame:
    return t.documents.where(F.lower("text").contains(F.lower(F.lit("AnD tHe")))).select("doc_id")


@query("WITH d AS (SELECT *, CASE WHEN contains(source, '1') THEN 'owner_project' ELSE source END AS tag FROM documents) SELECT source, coalesce((lang = 'en' AND contains(tag, '_')) OR (lang = 'fr' AND NOT contains(tag, '_')), false) AS rejected, count(*) AS n FROM d GROUP BY ALL")
def write_guard(t: Tables) -> DataFrame:
    tag = F.when(F.col("source").contains("1"), "owner_project").otherwise(F.col("source"))
    scope = F.when(F.col("lang") == "en", "user").when(F.col("lang") == "fr", "project")
    return t.documents.groupBy("source", F.coalesce(memory.scope_mismatch(scope, tag), F.lit(False)).alias("rejected")).agg(F.count("*").alias("n"))


@query("SELECT event_id, regexp_matches(CASE WHEN event_id % 3 = 0 THEN '12345678-9abc-4def-8123-' || lpad(CAST(event_id AS VARCHAR), 12, '0') || ':x' ELSE 'team-' || event_id END, '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}') AS spoofed FROM events")
def scope_spoofing(t: Tables) -> DataFrame:
    scope = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("12345678-9abc-4def-8123-"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(":x"))).otherwise(F.concat(F.lit("team-"), F.col("event_id").cast("string")))
    return t.events.select("event_id", memory.spoofed(scope).alias("spoofed"))


@query("SELECT doc_id, lang FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) WHERE lang IN ('en', 'de')")
def filter_after_limit(t: Tables) -> DataFrame:
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(50).where(F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 ELSE 1 END AS rank FROM orders")
def rank_projection(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("rank"))


# ---------------------------------------------------------------- joins
@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_custkey % 10 = 1")
def chunks_of_done_documents(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F' and o_custkey % 10 = 1").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return t.lineitem.select("l_orderkey", "l_linenumber").join(done, "l_orderkey")


@query("SELECT o_custkey AS container, count(*) AS relations FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def relations_by_container(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey").groupBy(F.col("o_custkey").alias("container")).agg(F.count("*").alias("relations"))


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE p_size < 5 AND o_orderstatus = 'O' ORDER BY l_orderkey, l_linenumber LIMIT 200")
def chunks_by_entities(t: Tables) -> DataFrame:
    """In the order of their places, so that the limit takes the same ones each time."""
    wanted = t.part.where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    hits = t.lineitem.join(wanted, "l_partkey", "left_semi").join(t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return hits.select("l_orderkey", "l_linenumber").distinct().orderBy("l_orderkey", "l_linenumber").limit(200)


@query("SELECT d.doc_id, coalesce(CASE WHEN l.toxic = 1 THEN 'failed' WHEN l.quality = 1 THEN 'done' ELSE 'pending' END, 'pending') AS state FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def evidence_with_processing(t: Tables) -> DataFrame:
    done = t.labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return t.documents.select("doc_id").join(done, "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 1, "done").otherwise("pending").alias("state"))


@query("SELECT d.source, count(*) AS n, sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS failed FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source")
def processing_by_owner(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("failed"))


@query("SELECT c_custkey AS claim_id, count(o_orderkey) AS evidences, max(o_orderdate) AS last_seen FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def claim_evidence_join(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_custkey").alias("claim_id")).agg(F.count("o_orderkey").alias("evidences"), F.max("o_orderdate").alias("last_seen"))


@query("SELECT e.event_id, c.c_mktsegment AS claim_scope FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'purchase'")
def claim_activity(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("c_custkey")).join(t.customer.select("c_custkey", F.col("c_mktsegment").alias("claim_scope")), "c_custkey").select("event_id", "claim_scope")


@query("SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_partkey % 50 = 0)")
def exact_name_lookup(t: Tables) -> DataFrame:
    return t.part.join(t.part.where("p_partkey % 50 = 0").select("p_name"), "p_name", "left_semi").select("p_partkey", "p_name")


# ---------------------------------------------------------------- statistics
@query("SELECT (SELECT count(*) FROM part) AS entities, (SELECT count(*) FROM lineitem) AS entity_relations, (SELECT count(*) FROM orders) AS memories")
def graph_totals(t: Tables) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(t.part, "entities").crossJoin(n(t.lineitem, "entity_relations")).crossJoin(n(t.orders, "memories"))


@query("SELECT count(*) AS documents, count(*) FILTER (WHERE n_chars > 1000) AS done, coalesce(sum(n_chars // 4), 0)::BIGINT AS tokens, coalesce(sum(n_chars // 2000 + 1), 0)::BIGINT AS chunks FROM documents")
def document_sums(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("*").alias("documents"), F.count(F.when(F.col("n_chars") > 1000, 1)).alias("done"), F.coalesce(F.sum(F.expr("n_chars div 4")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.expr("n_chars div 2000 + 1")), F.lit(0)).alias("chunks"))


@query("SELECT 'status' AS what, o_orderstatus AS key, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'source_kind', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'edge', l_returnflag, count(*) FROM lineitem GROUP BY 2")
def claims_by_status(t: Tables) -> DataFrame:
    part = lambda df, what, key: df.groupBy(F.lit(what).alias("what"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return part(t.orders, "status", "o_orderstatus").unionByName(part(t.events, "source_kind", "event_type")).unionByName(part(t.lineitem, "edge", "l_returnflag"))


@query("SELECT source AS container, count(*) AS memories, sum(n_chars)::BIGINT AS chars, count(*) > 30 AS too_many, sum(n_chars) > 50000 AS too_long FROM documents WHERE lang = 'en' GROUP BY source")
def profile_health(t: Tables) -> DataFrame:
    g = t.documents.where("lang = 'en'").groupBy(F.col("source").alias("container")).agg(F.count("*").alias("memories"), F.sum("n_chars").alias("chars"))
    return g.withColumns({"too_many": F.col("memories") > 30, "too_long": F.col("chars") > 50000})


@query("SELECT p_brand AS type, count(*) AS n, string_agg(p_name || '@' || p_partkey, ';' ORDER BY p_name || '@' || p_partkey) AS provenance FROM part GROUP BY p_brand")
def entities_with_provenance(t: Tables) -> DataFrame:
    each = F.concat("p_name", F.lit("@"), F.col("p_partkey").cast("string"))
    return t.part.groupBy(F.col("p_brand").alias("type")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(each)), ";").alias("provenance"))


@query("SELECT source, count(*) AS original, count(DISTINCT text) AS kept, count(*) - count(DISTINCT text) AS removed FROM documents GROUP BY source")
def dedup_stats(t: Tables) -> DataFrame:
    kept = F.count_distinct("text")
    return t.documents.groupBy("source").agg(F.count("*").alias("original"), kept.alias("kept"), (F.count("*") - kept).alias("removed"))


@query("SELECT event_type AS channel, count(*) AS items, count(DISTINCT user_id) AS agents, round(count(*) / count(DISTINCT user_id), 6) AS per_agent FROM events GROUP BY event_type")
def trace_summary(t: Tables) -> DataFrame:
    agents = F.count_distinct("user_id")
    return t.events.groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("items"), agents.alias("agents"), F.round(F.count("*") / agents, 6).alias("per_agent"))


@query("WITH h AS (SELECT event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS base, count(*) FILTER (WHERE event_id % 2 = 1 AND value < 50) AS now FROM events GROUP BY 1) SELECT *, now < 0.5 * base AS regressed FROM h")
def regression_rollup(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type").agg(F.count(F.when(F.col("event_id") % 2 == 0, 1)).alias("base"), F.count(F.when((F.col("event_id") % 2 == 1) & (F.col("value") < 50), 1)).alias("now"))
    return g.withColumn("regressed", F.col("now") < 0.5 * F.col("base"))


@query("SELECT count(*) AS lookups, count(*) - count(DISTINCT user_id) AS hits, round((count(*) - count(DISTINCT user_id)) * 100.0 / count(*), 2)::DOUBLE AS hit_rate, count(DISTINCT user_id) AS size, round(count(DISTINCT user_id) * 100.0 / 1000, 2)::DOUBLE AS usage FROM events")
def cache_rates(t: Tables) -> DataFrame:
    users = F.count_distinct("user_id")
    return t.events.agg(F.count("*").alias("lookups"), (F.count("*") - users).alias("hits"), F.round((F.count("*") - users) * 100 / F.count("*"), 2).alias("hit_rate"), users.alias("size"), F.round(users * 100 / 1000, 2).alias("usage"))


# ---------------------------------------------------------------- order and sets
@query("SELECT c_custkey AS claim_id, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS confidence FROM customer ORDER BY confidence DESC NULLS LAST, c_custkey LIMIT 20")
def preferences_nulls_last(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("claim_id"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("confidence")).orderBy(F.desc_nulls_last("confidence"), "claim_id").limit(20)


@query("WITH w AS (SELECT doc_id AS id, unnest(list_distinct(string_split(text, ' '))) AS name FROM documents), n AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part UNION SELECT * FROM (VALUES ('the'), ('and'), ('license'), ('de'), ('la')) v(name)) SELECT id, min_by(name, (-length(name), name)) AS name FROM w JOIN n USING (name) GROUP BY id")
def longest_name_first(t: Tables) -> DataFrame:
    names = t.part.select(F.explode(F.split("p_name", " ")).alias("name")).union(t.spark.createDataFrame([(x,) for x in ("the", "and", "license", "de", "la")], "name string"))
    return memory.longest_name(t.documents.select(F.col("doc_id").alias("id"), F.split("text", " ").alias("words")), names)


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 60), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 60) SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'only_on' WHEN a.user_id IS NULL THEN 'only_off' ELSE 'both' END AS side FROM a FULL JOIN b ON a.user_id = b.user_id")
def arms_compared(t: Tables) -> DataFrame:
    return memory.compared(t.events.where("event_type = 'purchase' and value > 60"), t.events.where("event_type = 'error' and value > 60"), ["user_id"])


@query(r"""WITH k AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(string_split_regex(text, '[，。！？、；：\s,.;!?]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^[0-9]+$'))) AS w FROM conversations)
SELECT a.conv_id, a.turn, list_has_any(a.w, b.w) AS shared FROM k a JOIN k b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1""")
def keyword_overlap(t: Tables) -> DataFrame:
    """Whether a turn has a keyword of the turn before."""
    before = t.conversations.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    return t.conversations.join(before, ["conv_id", "turn"]).select("conv_id", "turn", channels.shares_keyword(F.col("text"), F.col("before")).alias("shared"))


# ---------------------------------------------------------------- texts
@query("SELECT doc_id, md5(coalesce(text, '')) AS cache_key, sha1(coalesce(text, '')) AS digest FROM documents")
def cache_keys(t: Tables) -> DataFrame:
    b = F.coalesce("text", F.lit("")).cast("binary")
    return t.documents.select("doc_id", F.md5(b).alias("cache_key"), F.sha1(b).alias("digest"))


_ONCE = " + ".join([*(f"CASE WHEN contains(text, '{w}') THEN 2 ELSE 0 END" for w in rules.CODE_WORDS), *(f"CASE WHEN regexp_matches(text, '{p}') THEN {n} ELSE 0 END" for p, n in rules.CODE_ONCE)])
_EACH = lambda patterns: " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in patterns)


@query(f"""WITH s AS (SELECT doc_id, text, {_ONCE} + CASE WHEN contains(text, '{{') AND abs(length(replace(text, '}}', '')) - length(replace(text, '{{', ''))) <= 2 THEN 2 ELSE 0 END AS code,
{_EACH(rules.MARKDOWN_EACH)} + {" + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {n} ELSE 0 END" for p, n in rules.MARKDOWN_ONCE)} AS markdown, 3 * ({_EACH(rules.CONVERSATION_EACH)}) AS conversation FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'unknown' WHEN greatest(code, markdown, conversation) = 0 THEN 'document' WHEN code = greatest(code, markdown, conversation) THEN 'code' WHEN markdown = greatest(code, markdown, conversation) THEN 'markdown' ELSE 'conversation' END AS content_type FROM s""")
def content_types(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", rules.content_type(F.col("text")).alias("content_type"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '必须|禁止|不要|always|never|required|must') THEN 'constraint' ELSE 'fact' END AS kind, length(trim(text)) > 800 OR (starts_with(trim(text), '[') AND regexp_matches(substr(trim(text), 1, 200), 'CONTEXT|analyze-mode|search-mode|SYSTEM|System:')) AS sub_agent FROM conversations")
def claim_kinds(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", rules.claim_kind(F.col("text")).alias("kind"), rules.sub_agent_query(F.col("text")).alias("sub_agent"))


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'updates' WHEN 'click' THEN 'extends' WHEN 'error' THEN 'derives' END AS relation, date_diff('day', CAST(ts AS DATE), DATE '2024-05-01') AS age FROM events)
SELECT event_id, 'item' || CASE relation WHEN 'updates' THEN ' [updated]' WHEN 'extends' THEN ' [extended]' WHEN 'derives' THEN ' [derived]' ELSE '' END || CASE WHEN age > 100 THEN ' (recorded ' || age || ' days ago)' ELSE '' END AS content FROM e""")
def stale_annotation(t: Tables) -> DataFrame:
    relation = F.when(F.col("event_type") == "view", "updates").when(F.col("event_type") == "click", "extends").when(F.col("event_type") == "error", "derives")
    age = F.date_diff(F.lit("2024-05-01").cast("date"), F.col("ts").cast("date"))
    return t.events.select("event_id", rules.stale_suffix(F.lit("item"), relation, age, after=100).alias("content"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag ELSE 'related_to' END AS kind, least(1.0, greatest(0.0, l_quantity / 40)) AS confidence FROM lineitem WHERE l_quantity / 40 >= 0.3")
def relation_filter(t: Tables) -> DataFrame:
    kept = rules.relation_kept(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag"), F.col("l_quantity") / 40, ["A", "R"])
    return t.lineitem.select("l_orderkey", "l_linenumber", kept.alias("r")).where("r is not null").select("l_orderkey", "l_linenumber", "r.kind", "r.confidence")


@query("SELECT conv_id, greatest(2, floor(8 * (1 - least(0.5, count(*) * 0.05))))::INT AS recall_size, max(replace(text || '</system-reminder>' || turn, '</system-reminder>', '&lt;/system-reminder&gt;')) AS escaped FROM conversations GROUP BY conv_id")
def recall_size(t: Tables) -> DataFrame:
    """How many of eight memories a session may still get, and its last text with the closing tag escaped."""
    size = F.greatest(F.lit(2), F.floor(8 * (1 - F.least(F.lit(0.5), F.count("*") * 0.05)))).cast("int")
    tagged = F.concat("text", F.lit("</system-reminder>"), F.col("turn").cast("string"))
    return t.conversations.groupBy("conv_id").agg(size.alias("recall_size"), F.max(F.replace(tagged, F.lit("</system-reminder>"), F.lit("&lt;/system-reminder&gt;"))).alias("escaped"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_totalprice > 2000 THEN true END, CASE WHEN o_orderstatus = 'F' THEN false END, o_orderpriority IS NULL OR o_orderpriority = '5-LOW') AS worthy FROM orders")
def profile_worthiness(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.coalesce(F.when(F.col("o_totalprice") > 2000, True), F.when(F.col("o_orderstatus") == "F", False), F.col("o_orderpriority").isNull() | (F.col("o_orderpriority") == "5-LOW")).alias("worthy"))


_MESSAGE = "CASE event_type WHEN 'error' THEN concat('HTTP 402: insufficient credits for ', event_id) WHEN 'click' THEN 'Error 429 too many' WHEN 'view' THEN 'RATE_LIMIT hit' WHEN 'purchase' THEN concat('timed out after ', event_id % 100) END"


@query(f"WITH m AS (SELECT event_id, {_MESSAGE} AS m, 'Error' || user_id % 3 AS kind FROM events) SELECT event_id, CASE WHEN m LIKE '%insufficient credits%' THEN 'llm_error: insufficient_credits' WHEN m LIKE '%429%' OR lower(m) LIKE '%rate\\_limit%' ESCAPE '\\' THEN 'llm_error: rate_limited' WHEN m IS NOT NULL THEN 'llm_error: ' || kind END AS reason FROM m")
def degraded_reason(t: Tables) -> DataFrame:
    kind = F.concat(F.lit("Error"), (F.col("user_id") % 3).cast("string"))
    return t.events.select("event_id", text.degraded_reason(F.expr(_MESSAGE), kind).alias("reason"))


@query("SELECT l_orderkey AS id, string_agg(DISTINCT l_returnflag || ':' || l_partkey, ',' ORDER BY l_returnflag || ':' || l_partkey) AS relations FROM lineitem GROUP BY l_orderkey")
def relation_map(t: Tables) -> DataFrame:
    """Relations folded one by one into a map, told as a sorted list."""
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct("l_returnflag", F.col("l_partkey").cast("string").alias("p"))).alias("l"))
    folded = F.reduce("l", F.create_map().cast("map<string,array<string>>"), lambda acc, x: memory.relation_appended(acc, x["l_returnflag"], x["p"]))
    each = F.flatten(F.transform(F.map_entries(folded), lambda e: F.transform(e["value"], lambda p: F.concat(e["key"], F.lit(":"), p))))
    return g.select("id", F.array_join(F.array_sort(each), ",").alias("relations"))


# ---------------------------------------------------------------- write-time dedup
_SIM = "list_cosine_similarity(n.embedding::DOUBLE[], o.embedding::DOUBLE[])"


def _write(t: Tables, merge: float, capture: float) -> tuple[DataFrame, DataFrame]:
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("tag"), "embedding", (F.col("vec_id") % 100 == 0).alias("is_capture"))
    old = e.where("id % 50 <> 0")
    return memory.written_dedup(e.where("id % 50 = 0"), old, merge, capture), old.withColumn("merged_count", F.lit(0).cast("long"))


_BEST = f"SELECT n.vec_id AS new_id, o.vec_id AS id, {_SIM} AS s FROM embeddings n JOIN embeddings o ON n.label = o.label WHERE n.vec_id % 50 = 0 AND o.vec_id % 50 <> 0 QUALIFY row_number() OVER (PARTITION BY n.vec_id ORDER BY round({_SIM}, 9) DESC, o.vec_id) = 1"


@query(f"WITH b AS ({_BEST}) SELECT o.vec_id AS id, count(b.id) AS merged_count FROM embeddings o LEFT JOIN b ON b.id = o.vec_id AND b.new_id % 100 <> 0 AND s >= 0.25 WHERE o.vec_id % 50 <> 0 GROUP BY o.vec_id")
def merge_on_write(t: Tables) -> DataFrame:
    """Old memories, with the new ones that were merged into them; captured ones are dropped instead."""
    found, old = _write(t, 0.25, 0.2)
    return memory.merged(old, found).select("id", "merged_count")


@query(f"WITH b AS ({_BEST}) SELECT x.vec_id AS id, CASE WHEN s >= CASE WHEN x.vec_id % 100 = 0 THEN 0.3 ELSE 0.35 END THEN CASE WHEN x.vec_id % 100 = 0 THEN 'dropped' ELSE 'merged' END ELSE 'kept' END AS action, CASE WHEN s >= CASE WHEN x.vec_id % 100 = 0 THEN 0.3 ELSE 0.35 END THEN b.id END AS other FROM embeddings x LEFT JOIN b ON new_id = x.vec_id WHERE x.vec_id % 50 = 0")
def capture_dedup(t: Tables) -> DataFrame:
    """Captured memories are held to a lower bar than those written on purpose."""
    return _write(t, 0.35, 0.3)[0].select("id", "action", "other")


@query(f"WITH b AS ({_BEST}) SELECT x.vec_id AS id, coalesce(s >= 0.28, false) AS dropped, CASE WHEN s >= 0.28 THEN 'similar_to:' || b.id END AS reason FROM embeddings x LEFT JOIN b ON new_id = x.vec_id WHERE x.vec_id % 50 = 0")
def distillation_dedup(t: Tables) -> DataFrame:
    return memory.distilled(_write(t, 0.28, 0.28)[0])


# ---------------------------------------------------------------- profiles and recall
@query(f"SELECT container, id, is_static, is_rule, row_number() OVER (PARTITION BY container, is_static ORDER BY created_at DESC, id)::INT AS position FROM ({_MEMORIES}) WHERE coalesce(profile_worthy, true) QUALIFY position <= CASE WHEN is_static THEN 100 ELSE 50 END")
def profile_build(t: Tables) -> DataFrame:
    return memory.profile(_memories(t)).select("container", "id", "is_static", "is_rule", "position")


@query(f"""WITH p AS (SELECT container, id, is_static, is_rule, row_number() OVER (PARTITION BY container, is_static ORDER BY created_at DESC, id) AS position FROM ({_MEMORIES}) WHERE coalesce(profile_worthy, true) QUALIFY position <= CASE WHEN is_static THEN 100 ELSE 50 END),
r AS (SELECT *, count(*) FILTER (WHERE is_static AND is_rule) OVER (PARTITION BY container) AS rules, row_number() OVER (PARTITION BY container, is_static, CASE WHEN is_static THEN is_rule END ORDER BY position) AS k FROM p)
SELECT container, id, is_static FROM r WHERE CASE WHEN is_static AND is_rule THEN true WHEN is_static THEN k <= greatest(0, 3 - rules) ELSE k <= 2 END""")
def profile_inject(t: Tables) -> DataFrame:
    return memory.injected(memory.profile(_memories(t)), 3, 2).select("container", "id", "is_static")


@query("""WITH h AS (SELECT o_custkey AS request_id, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 5),
r AS (SELECT DISTINCT a.l_orderkey AS from_id, b.l_orderkey AS to_id, a.l_returnflag AS type FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_orderkey <> b.l_orderkey),
x AS (SELECT request_id, to_id AS id, min((rank, type)) AS m FROM h JOIN r ON h.id = r.from_id WHERE rank <= 3 GROUP BY 1, 2),
y AS (SELECT x.*, row_number() OVER (PARTITION BY request_id ORDER BY m[1], id) AS position FROM x ANTI JOIN h USING (request_id, id))
SELECT request_id, id, m[2] AS type, position::INT AS position FROM y WHERE position <= 10""")
def memory_one_hop(t: Tables) -> DataFrame:
    hits = relational.top_per_key(t.orders.select(F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("id"), "o_totalprice"), ["request_id"], [F.desc("o_totalprice"), F.col("id")], 5)
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    other = line.select("l_partkey", "l_suppkey", F.col("l_orderkey").alias("to_id"))
    related = line.join(other, ["l_partkey", "l_suppkey"]).where("l_orderkey <> to_id").select(F.col("l_orderkey").alias("from_id"), "to_id", F.col("l_returnflag").alias("type")).distinct()
    return memory.one_hop(hits.select("request_id", "rank", "id"), related)


# ---------------------------------------------------------------- graph and claims
#: Lines whose brands a task of the graph view gathers.
LINES_AT_ONCE = 500_000


@query("WITH i AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 0 UNION SELECT -1), f AS (SELECT p_partkey AS id, lower(p_name) AS family FROM part) SELECT DISTINCT f.id FROM f WHERE family IN (SELECT family FROM f JOIN i USING (id)) UNION SELECT id FROM i WHERE id NOT IN (SELECT id FROM f)")
def family_expansion(t: Tables) -> DataFrame:
    ids = t.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("id")).union(t.spark.range(1).select(F.lit(-1).cast("long").alias("id")))
    return memory.family_expanded(ids, t.part.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("family")))


@query("SELECT DISTINCT o_orderkey AS id, 'brand' AS type, p_brand AS name, o_totalprice AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey")
def graph_view(t: Tables) -> DataFrame:
    # as many tasks as there are so many lines: Spark would make as many as there are cores, of any size
    n = max(1, -(-t.lineitem.count() // LINES_AT_ONCE))
    lines = t.lineitem.select("l_partkey", F.col("l_orderkey").alias("id")).join(t.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    brands = lines.select("id", "p_brand").repartition(n, "id").groupBy("id").agg(F.collect_set("p_brand").alias("b"))
    orders = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("confidence")).repartition(n, "id")
    m = brands.join(orders, "id").select("id", "confidence", F.create_map(F.lit("brand"), F.col("b")).alias("entities"))
    return memory.graph_view(m)[1]


@query("""SELECT event_id AS id, event_type AS state, ts AS since FROM events WHERE (event_type IN ('view', 'error') OR (event_type = 'click' AND ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 30 SECOND)) AND NOT value > 95 ORDER BY ts, event_id LIMIT 50""")
def claim_next_batch(t: Tables) -> DataFrame:
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "processing").otherwise("done")
    p = t.events.select(F.col("event_id").alias("id"), state.alias("state"), F.col("ts").alias("since"), (F.col("value") > 95).alias("isolated"), "event_type")
    return memory.next_batch(p, "2024-01-20 00:00:00").select("id", F.col("event_type").alias("state"), "since")


@query("SELECT CAST(c_custkey AS VARCHAR) AS claim_id, c_mktsegment AS kind, c_acctbal AS confidence, CASE WHEN c_custkey % 50 = 0 THEN 'superseded' ELSE 'active' END AS status FROM customer UNION ALL SELECT c_custkey || '_c', c_mktsegment, 0.8571, 'active' FROM customer WHERE c_custkey % 50 = 0")
def user_correction(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").cast("string").alias("claim_id"), F.col("c_mktsegment").alias("kind"), F.col("c_acctbal").alias("confidence"), F.lit("active").alias("status"))
    return memory.corrected(c, c.where("cast(claim_id as long) % 50 = 0").select("claim_id", F.lit("new").alias("content")), 0.8571)[0]


# ---------------------------------------------------------------- upkeep and evaluation
@query("WITH s AS (SELECT user_id AS query_id, avg(value) FILTER (WHERE event_id % 2 = 0) AS a, avg(value) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY 1), d AS (SELECT round(b - a, 9) AS d FROM s WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses, count(*) FILTER (WHERE d = 0) AS ties, round(avg(d), 6) AS delta, round(avg(d), 6) >= -0.3 AS non_inferior FROM d")
def non_inferiority(t: Tables) -> DataFrame:
    return memory.non_inferior(t.events.select(F.col("user_id").alias("query_id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("arm"), F.col("value").alias("score")))


@query()
def bootstrap_interval(t: Tables) -> DataFrame:
    return memory.bootstrap_interval(t.events.select(F.col("user_id").alias("cluster"), (F.col("value") - 50).alias("difference")))


@query("WITH a AS (SELECT source, count(*) FILTER (WHERE n_chars > 5000) AS active FROM documents GROUP BY 1) SELECT source AS container FROM a WHERE (source = 'src3' OR (regexp_matches(source, '^src1') AND active = 0)) AND NOT regexp_matches(source, '9$')")
def junk_containers(t: Tables) -> DataFrame:
    a = t.documents.groupBy(F.col("source").alias("container")).agg(F.count(F.when(F.col("n_chars") > 5000, 1)).alias("active"))
    return a.where(((F.col("container") == "src3") | (F.col("container").rlike("^src1") & (F.col("active") == 0))) & ~F.col("container").rlike("9$")).select("container")


@query("SELECT o_orderkey AS id FROM orders o WHERE o_orderstatus = 'P' OR NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def backfill_candidates(t: Tables) -> DataFrame:
    linked = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("linked")).distinct()
    return t.orders.select("o_orderkey", "o_orderstatus").join(linked, "o_orderkey", "left").where("o_orderstatus = 'P' or linked is null").select(F.col("o_orderkey").alias("id"))


@query("WITH n AS (SELECT l_partkey, count(*) AS links FROM lineitem GROUP BY 1), s AS (SELECT *, count(*) OVER (PARTITION BY lower(p_name), p_brand) AS siblings FROM part) SELECT p_partkey AS id, links FROM s JOIN n ON l_partkey = p_partkey WHERE links >= 30 AND siblings = 1")
def retype_candidates(t: Tables) -> DataFrame:
    links = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("links")).where("links >= 30")
    lone = t.part.groupBy(F.lower("p_name").alias("name"), "p_brand").agg(F.count("*").alias("siblings"), F.min("p_partkey").alias("p_partkey")).where("siblings = 1")
    return lone.join(links, "p_partkey").select(F.col("p_partkey").alias("id"), "links")
