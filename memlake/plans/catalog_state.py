"""Queries on state that changes from row to row: caches, written memories, sessions.

Bindings: events are accesses to a cache (key: user); an order is a written memory, its
lines are what happens to it, some minutes later each; conversations are sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.operators import cache
from memlake.plans.catalog import Tables, query
from memlake.streaming import injection, writes

# ---------------------------------------------------------------- cache
_LOG = "SELECT event_id AS seq, 'u' || user_id AS key, ts FROM events"


@query(f"""WITH RECURSIVE l AS ({_LOG}), p AS (SELECT *, lag(seq) OVER (PARTITION BY key ORDER BY seq) AS before, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM l),
d AS (SELECT p.seq, p.key, p.ts, p.k, before IS NOT NULL AND (SELECT count(DISTINCT x.key) FROM l x WHERE x.seq > p.before AND x.seq < p.seq) < 100 AS present, (SELECT count(*) FROM p x WHERE x.before IS NULL AND x.seq < p.seq) >= 100 AS full_ FROM p),
r AS (SELECT key, k, seq, present, full_, ts AS since, 'absent' AS outcome FROM d WHERE k = 1
UNION ALL SELECT d.key, d.k, d.seq, d.present, d.full_, CASE WHEN d.present AND date_diff('microsecond', r.since, d.ts) <= 43200000000 THEN r.since ELSE d.ts END, CASE WHEN NOT d.present THEN 'absent' WHEN date_diff('microsecond', r.since, d.ts) <= 43200000000 THEN 'hit' ELSE 'expired' END FROM r JOIN d ON d.key = r.key AND d.k = r.k + 1)
SELECT seq, key, outcome, outcome = 'absent' AND full_ AS evicts FROM r""")
def cache_outcomes(t: Tables) -> DataFrame:
    """An LRU cache of 100 keys for 12 hours over the log of events."""
    log = t.events.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id")).alias("key"), "ts")
    return cache.lru(log, 100, 43_200).select("seq", "key", "outcome", F.col("evicted").isNotNull().alias("evicts"))


# ---------------------------------------------------------------- written memories
_HAPPENS = """SELECT CAST(o_orderkey AS VARCHAR) AS memory_id, o_orderdate AS ts, 'written' AS event, '' AS detail, o_orderstatus = 'F' AS capture, 0 AS rank FROM orders
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), o_orderdate + to_minutes(l_linenumber * (l_partkey % 4)), CASE WHEN l_returnflag = 'R' AND l_partkey % 2 = 0 THEN 'error' ELSE CASE l_linenumber WHEN 1 THEN 'embedded' WHEN 2 THEN CASE WHEN l_quantity > 40 THEN 'duplicate' ELSE 'distinct' END WHEN 3 THEN 'extracted' WHEN 4 THEN 'related' ELSE 'error' END END AS e,
CASE WHEN l_linenumber = 1 AND l_discount > 0.08 THEN 'none' WHEN l_discount > 0.05 THEN 'late' ELSE '' END, false, CASE e WHEN 'embedded' THEN 1 WHEN 'distinct' THEN 2 WHEN 'duplicate' THEN 3 WHEN 'extracted' THEN 4 WHEN 'related' THEN 5 ELSE 6 END FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY ts, rank, detail)::INT AS k FROM ({_HAPPENS})),
s AS (SELECT memory_id, k, ts AS began, ts, 'written' AS stage, 0 AS attempts, 'processing' AS status, capture, false AS stuck FROM e WHERE k = 1
UNION ALL SELECT memory_id, k, began, ts, CASE WHEN ended OR event = 'error' THEN stage WHEN stage = 'written' AND event = 'embedded' THEN CASE WHEN detail = 'none' THEN 'distinct' ELSE 'embedded' END WHEN stage = 'embedded' AND event = 'distinct' THEN 'distinct' WHEN stage = 'distinct' AND event = 'extracted' THEN 'extracted' ELSE stage END,
CASE WHEN NOT ended AND event = 'error' THEN attempts + 1 ELSE attempts END,
CASE WHEN ended THEN status WHEN event = 'error' THEN CASE WHEN attempts >= 2 THEN 'failed' ELSE status END WHEN stage = 'embedded' AND event = 'duplicate' THEN CASE WHEN capture THEN 'dropped' ELSE 'merged' END WHEN stage = 'extracted' AND event = 'related' THEN 'completed' ELSE status END, capture, stuck OR (NOT ended AND late)
FROM (SELECT s.memory_id, e.k, s.began, e.ts, s.stage, s.attempts, s.status, s.capture, s.stuck, e.event, e.detail, s.status <> 'processing' AS ended, e.ts >= s.began + INTERVAL 10 MINUTE AS late FROM s JOIN e ON e.memory_id = s.memory_id AND e.k = s.k + 1)),
f AS (SELECT memory_id, arg_max(status, k) AS status, arg_max(stage, k) AS stage, max(attempts) AS attempts, bool_or(stuck) AS stuck FROM s GROUP BY 1)
SELECT CASE WHEN status = 'processing' THEN 'open' ELSE status END AS status, stage, attempts::INT AS attempts, stuck OR status = 'processing' AS stuck, count(*) AS n FROM f GROUP BY ALL""")
def write_path_outcomes(t: Tables) -> DataFrame:
    """Where written memories end: the reports of the state machine, summed up by memory."""
    # places in lists, so that sums by memory need no sort by strings
    reports = writes.statuses(_happenings(t), until="2100-01-01").select("memory_id", "attempts", _place(_ENDS, "status").alias("ended"), _place(_STAGES, "stage").alias("stage"), (F.col("status") == "stuck").cast("int").alias("stuck"))
    found = reports.groupBy("memory_id").agg(*(F.max(c).alias(c) for c in ("ended", "attempts", "stage", "stuck")))
    ends = found.groupBy("ended", "stage", "attempts", (F.col("stuck") == 1).alias("stuck")).agg(F.count("*").alias("n"))
    return ends.select(F.coalesce(_at(_ENDS, "ended"), F.lit("open")).alias("status"), _at(_STAGES, "stage").alias("stage"), "attempts", "stuck", "n")


_ENDS = ("completed", "dropped", "failed", "merged")
_STAGES = ("written", "embedded", "distinct", "extracted")


def _place(names: tuple[str, ...], c: str) -> Column:
    """From 1; 0 if it isn't one of them."""
    return F.array_position(F.array(*map(F.lit, names)), F.col(c)).cast("int")


def _at(names: tuple[str, ...], c: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.col(c) - 1)


def _happenings(t: Tables) -> DataFrame:
    first = t.orders.select(F.col("o_orderkey").cast("string").alias("memory_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("written").alias("event"), F.lit("").alias("detail"), (F.col("o_orderstatus") == "F").alias("is_capture"))
    j = t.lineitem.join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    n = F.col("l_linenumber")
    event = F.when((F.col("l_returnflag") == "R") & (F.col("l_partkey") % 2 == 0), "error").when(n == 1, "embedded").when(n == 2, F.when(F.col("l_quantity") > 40, "duplicate").otherwise("distinct")).when(n == 3, "extracted").when(n == 4, "related").otherwise("error")
    detail = F.when((n == 1) & (F.col("l_discount") > 0.08), "none").when(F.col("l_discount") > 0.05, "late").otherwise("")
    at = F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, 0, cast(l_linenumber * (l_partkey % 4) as int), 0)")
    return first.unionByName(j.select(F.col("l_orderkey").cast("string").alias("memory_id"), at.alias("ts"), event.alias("event"), detail.alias("detail"), F.lit(False).alias("is_capture")))


@query("""WITH e AS (SELECT CASE user_id % 4 WHEN 0 THEN 'key_' ELSE 'key' END || user_id AS tag, epoch_us(ts) AS us FROM events), x AS (SELECT tag, us, unnest(range((us + 299999999) // 300000000, (us + 599999999) // 300000000 + 1)) AS tick FROM e WHERE NOT contains(tag, '_'))
SELECT DISTINCT tag AS container_tag, epoch(make_timestamp(tick * 300000000))::BIGINT AS at FROM x""")
def rebuilds_due(t: Tables) -> DataFrame:
    """When profiles are rebuilt: every five minutes, for containers written to in the last ten."""
    tag = F.concat(F.when(F.col("user_id") % 4 == 0, "key_").otherwise("key"), F.col("user_id").cast("string"))
    return writes.rebuilds_due(t.events.select(tag.alias("container_tag"), "ts")).select("container_tag", F.unix_seconds("at").alias("at"))


# ---------------------------------------------------------------- sessions
def session_turns(t: Tables) -> DataFrame:
    """Conversations with eight candidates for each turn; the first of them is what the assistant said before, if anything."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    said = F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    one = "struct(-round(((conv_id * 31 + turn * 17 + j * 13) % 100) / 100.0, 2) as s, concat('m', (conv_id * 5 + turn * 3 + j * j) % 40) as id, j)"
    c = t.conversations.withColumn("said", said).withColumn("c", F.array_sort(F.expr(f"transform(sequence(0, 7), j -> {one})")))
    content = "transform(c, x -> if(x.j = 0 and said is not null, said, concat('memory ', x.id)))"
    return c.select(F.col("conv_id").alias("session"), "turn", "role", "text", F.expr("transform(c, x -> x.id)").alias("ids"), F.expr(content).alias("contents"), F.expr("transform(c, x -> cast(-x.s as double))").alias("similarities"))


@query()
def injection_decisions(t: Tables) -> DataFrame:
    """What each user turn of the conversations is given."""
    return injection.decisions(session_turns(t))
