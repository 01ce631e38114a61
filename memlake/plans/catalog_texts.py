"""Queries on chunks of code and documents, and on typed entities of texts.

Bindings: an order is a source file (even keys Python, odd keys JavaScript), its lines
are its methods or functions; customers write messages about themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import text
from memlake.operators import chunking, code, extraction
from memlake.plans.catalog import Tables, query
from memlake.streaming import injection

# ---------------------------------------------------------------- code
_LINES = "SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)::INT AS n, l_partkey AS part, l_quantity::INT AS q FROM lineitem"


@query(f"""WITH l AS ({_LINES}),
py AS (SELECT k, n, 'method' AS kind, 'line_' || n AS name, '    def line_' || n || '(self, quantity: float) -> float:' || chr(10) || '        return quantity * ' || q || '  # }} {{' || part AS content,
  '# Scope: Order' || k || chr(10) || '# Defines: def line_' || n || '(self, quantity: float) -> float' AS head FROM l WHERE k % 2 = 0
UNION ALL SELECT k, 1000, 'function', 'main_' || k, 'async def main_' || k || '(rows):' || chr(10) || '    return Order' || k || '()',
  '# Defines: async def main_' || k || '(rows)' || chr(10) || '# Uses: json, floor, sqrt' FROM (SELECT DISTINCT k FROM l WHERE k % 2 = 0)),
js AS (SELECT k, n, 'function' AS kind, 'line' || n AS name, 'function line' || n || '(quantity) {{' || chr(10) || '  return "}}" + {{ value: quantity * ' || q || ' }};' || chr(10) || '}}' AS content, '# Defines: function line' || n || '(quantity)' AS head FROM l WHERE k % 2 = 1
UNION ALL SELECT k, 1000, 'class', 'Order' || k, 'class Order' || k || ' extends Base {{' || chr(10) || '}}', '# Defines: class Order' || k FROM (SELECT DISTINCT k FROM l WHERE k % 2 = 1)),
a AS (SELECT * FROM py UNION ALL SELECT * FROM js)
SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY n) - 1)::INT AS position, kind, name, content, head || chr(10) || chr(10) || content AS embedded_content, greatest(length(regexp_replace(content, '\\s', '', 'g')) // 4, 1)::INT AS token_count FROM a""")
def chunk_code(t: Tables) -> DataFrame:
    """Source files made of orders, cut by their syntax."""
    return code.code_chunks(_files(t)).select("doc_id", "position", "kind", "name", "content", "embedded_content", "token_count")


def _files(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("l"))
    python = "concat_ws('\\n', 'import json', 'from math import floor, sqrt', '', '', concat('class Order', doc_id, ':'), array_join(transform(l, (x, i) -> concat('    def line_', i + 1, '(self, quantity: float) -> float:\\n        return quantity * ', cast(x.l_quantity as int), '  # } {', x.l_partkey)), '\\n\\n'), '', '', concat('async def main_', doc_id, '(rows):'), concat('    return Order', doc_id, '()'), '')"
    script = "concat(array_join(transform(l, (x, i) -> concat('function line', i + 1, '(quantity) {\\n  return \"}\" + { value: quantity * ', cast(x.l_quantity as int), ' };\\n}')), '\\n'), '\\nclass Order', doc_id, ' extends Base {\\n}')"
    return lines.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.expr(python)).otherwise(F.expr(script)).alias("text"), F.when(F.col("doc_id") % 2 == 0, ".PY").otherwise(".tsx").alias("file_extension"))


# ---------------------------------------------------------------- documents
@query()
def chunk_documents_overlap(t: Tables) -> DataFrame:
    """Whole documents in runs of sentences, with the lines before and under a header."""
    docs = t.documents.select("doc_id", "text", text.title_fallback(F.col("text")).alias("title"), F.concat_ws(" ", "lang", "source").alias("summary"))
    return chunking.document_chunks(docs)


# ---------------------------------------------------------------- entities
_MESSAGE = [
    ("'我住在', n_name, '，在', c_name, '公司工作。'"),
    ("'我的妻子毕业于', n_name, '大学，职位是', c_mktsegment, '经理'"),
    ("'2024年', c_custkey % 12 + 1, '月', c_custkey % 28 + 1, '日 和', c_name, '一起去', n_name, '省'"),
    ("'我喜欢', c_mktsegment, '，不喜欢 ', n_name, '。微信号：wx_', c_custkey, 'abc'"),
    ("'加我QQ：', 10000 + c_custkey, '，手机138', lpad(cast(c_custkey as {string}), 8, '0'), '，邮箱 user', c_custkey, '@', lower(n_name), '.com'"),
    ("'擅长', c_mktsegment, '，硕士学历，端午节见 ', n_name, ' 说'"),
]
_CASES = "CASE c_custkey % 6 " + " ".join(f"WHEN {k} THEN concat({m})" for k, m in enumerate(_MESSAGE)) + " END"


def _entity_sql() -> str:
    """The same patterns in the other engine's dialect, whose classes know ASCII alone."""
    strip = lambda x: f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"
    wide = lambda p: p.replace(r"[\w.-]", r"[\pL\pM\p{Nd}\p{Pc}.-]").replace(r"\.\w+", r"\.[\pL\pM\p{Nd}\p{Pc}]+").replace(r"\d", r"\p{Nd}")
    arms, n = [], 0
    for kind, patterns in extraction.PATTERNS.items():
        for p in patterns:
            groups = p.count("(")
            lists = ", ".join(f"regexp_extract_all(text, '{wide(p)}', {g}) AS l{g}" for g in range(groups + 1))
            each = ", ".join(f"unnest(l{g}) AS g{g}" for g in range(groups + 1))
            text_ = "coalesce(" + ", ".join(strip(f"g{g}") for g in [*range(1, groups + 1), 0]) + ")"
            arms.append(f"SELECT doc_id, {n} AS p, i, '{kind}' AS type, {text_} AS text FROM (SELECT doc_id, unnest(range(len(l0))) AS i, {each} FROM (SELECT doc_id, {lists} FROM m))")
            n += 1
    return f"""WITH m AS (SELECT doc_id, text FROM documents UNION ALL SELECT -c_custkey, {_CASES.replace("{string}", "varchar")} FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS ({" UNION ALL ".join(arms)})
SELECT doc_id, text, arg_min(type, p * 1000000 + i) AS type, 0.9::DOUBLE AS confidence, count(*) AS n_found FROM f WHERE text IS NOT NULL GROUP BY doc_id, text"""


def _messages(t: Tables) -> DataFrame:
    # one file's rows for all tasks: their short texts are long in work
    own = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").repartition(4 * t.spark.sparkContext.defaultParallelism).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select((-F.col("c_custkey")).alias("doc_id"), F.expr(_CASES.replace("{string}", "string")).alias("text"))
    return t.documents.select("doc_id", "text").unionByName(own)


@query(_entity_sql())
def typed_entities(t: Tables) -> DataFrame:
    """Entities by rules of all documents, and of messages that customers would write."""
    return extraction.rule_entities(_messages(t)).select("doc_id", "text", "type", "confidence", "n_found")


@query(f"""WITH e AS ({_entity_sql()}), d AS (SELECT DISTINCT doc_id, CASE WHEN type IN ('location', 'organization') THEN 'thing_concept' WHEN type IN ('person', 'occupation', 'family_relation') THEN 'person' WHEN type IN ('preference', 'education', 'skill', 'hobby') THEN 'attribute_fact' ELSE 'meta' END AS dimension, type FROM e)
SELECT dimension, count(*) AS n_texts, count(DISTINCT doc_id) AS n_docs FROM d GROUP BY 1""")
def entity_dimensions(t: Tables) -> DataFrame:
    """How many types, and how many texts, each dimension has."""
    types = extraction.rule_entities(_messages(t)).groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    return types.groupBy(extraction.dimension(F.col("type")).alias("dimension")).agg(F.count("*").alias("n_texts"), F.count_distinct("doc_id").alias("n_docs"))


# ---------------------------------------------------------------- pieces of texts
@query("""WITH h AS (SELECT doc_id, text, substr(text, 1, 500) AS head, regexp_extract(substr(text, 1, 500), '(?s)^(.*[。！？.!?])', 1) AS whole FROM documents) SELECT doc_id, CASE WHEN length(text) <= 500 THEN text WHEN length(whole) - 1 > 400 THEN whole ELSE head END AS cut FROM h""")
def sentence_cuts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.cut_at_sentence(F.col("text"), 500).alias("cut"))


@query()
def document_sections(t: Tables) -> DataFrame:
    return chunking.document_sections(t.documents)


_TIMES = "concat('请看', CASE c_custkey % 7 WHEN 0 THEN '今天' WHEN 1 THEN '昨天和今天' WHEN 2 THEN '前天' WHEN 3 THEN '最近' WHEN 4 THEN '本周' WHEN 5 THEN '上周' ELSE '明年' END, '的', c_name)"


@query("""WITH d AS (SELECT c_custkey, DATE '2024-01-01' + (c_custkey % 365)::INT AS day, c_custkey % 7 AS k FROM customer), m AS (SELECT *, (day - (isodow(day) - 1)::INT)::DATE AS monday FROM d)
SELECT c_custkey, CASE k WHEN 0 THEN day WHEN 1 THEN day WHEN 2 THEN day - 2 WHEN 3 THEN day - 7 WHEN 4 THEN monday WHEN 5 THEN monday - 7 END::DATE AS first, CASE k WHEN 0 THEN day WHEN 1 THEN day WHEN 2 THEN day - 2 WHEN 3 THEN day WHEN 4 THEN monday + 6 WHEN 5 THEN monday - 1 END::DATE AS last, CASE k WHEN 0 THEN '今天' WHEN 1 THEN '今天' WHEN 2 THEN '前天' WHEN 3 THEN '最近' WHEN 4 THEN '本周' WHEN 5 THEN '上周' END AS word FROM m""")
def time_ranges(t: Tables) -> DataFrame:
    """Messages with words for times, each read on a day of its own."""
    day = F.expr("date_add(date'2024-01-01', cast(c_custkey % 365 as int))")
    return t.customer.select("c_custkey", text.time_range(F.expr(_TIMES), day).alias("r")).select("c_custkey", "r.first", "r.last", "r.word")


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN props END AS json FROM events""")
def salvaged_json(t: Tables) -> DataFrame:
    """Answers that are JSON, hold it in a fence or in a sentence, or don't hold any."""
    answer = F.expr("CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('Here {it} is:\n```json\n', props, '\n```\nmore') WHEN 2 THEN concat('Sure: ', props, ' as asked.') WHEN 3 THEN concat('{', user_id, ' is no object}') ELSE 'nothing' END")
    return t.events.select("event_id", text.salvaged_json(answer).alias("json"))


@query(r"""WITH c AS (SELECT conv_id, turn, replace(replace(text, '#', ''), chr(34), '') AS x FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '【发现/决策】' || chr(10) || regexp_replace(x, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || '[代码已省略]' || chr(10) || chr(10) || 'end' WHEN 1 THEN '【明确约束】' || chr(10) || '- never ' || conv_id || chr(10) || '- always' WHEN 2 THEN '【发现/决策】' || chr(10) || 'one' || chr(10) || chr(10) || '【明确约束】' || chr(10) || '- never' END AS sections FROM c""")
def summary_sections(t: Tables) -> DataFrame:
    """Summaries made of turns: discoveries with code, constraints, both or none."""
    c = t.conversations.withColumn("x", F.regexp_replace("text", '[#"]', ""))
    summary = F.expr("""CASE turn % 4 WHEN 0 THEN concat('# S\n## Discoveries\n', x, '\n\n```py\ncode ## \n```\n\n\nend\n\n## Next\nmore') WHEN 1 THEN concat('## 3. Explicit Constraints\nas said:\n- "never ', conv_id, '"\n-  "always"\n\ntail') WHEN 2 THEN '## Discoveries\none\n## Explicit Constraints\n- "never"' ELSE x END""")
    return c.select("conv_id", "turn", text.important_sections(summary).alias("sections"))


@query("SELECT conv_id, turn, CASE " + " ".join(f"WHEN contains(lower(text), '{w}') THEN '{w}'" for w in injection.KEYWORDS) + " END AS keyword FROM conversations")
def trigger_keywords(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.first_of(F.col("text"), injection.KEYWORDS).alias("keyword"))


@query("""SELECT source, count(*) AS n, count(*) - count(*) FILTER (n_chars > 500) - count(*) FILTER (n_chars < 100) AS history, round(100.0 * count(*) FILTER (n_chars > 500) / count(*))::INT AS active_percent, round(100.0 * count(*) / max(count(*)) OVER ())::INT AS bar FROM documents GROUP BY source""")
def dashboard_bars(t: Tables) -> DataFrame:
    """Containers with what is neither active nor forgotten, the share that is active, and the height of their bars."""
    active, gone = F.count_if(F.col("n_chars") > 500), F.count_if(F.col("n_chars") < 100)
    g = t.documents.groupBy("source").agg(F.count("*").alias("n"), (F.count("*") - active - gone).alias("history"), F.round(100 * active / F.count("*")).cast("int").alias("active_percent"))
    most = g.agg(F.max("n").alias("most"))
    return g.crossJoin(F.broadcast(most)).select("source", "n", "history", "active_percent", F.round(100 * F.col("n") / F.col("most")).cast("int").alias("bar"))
