"""Steps whose cost must not grow faster than what they give."""

import ast
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from memlake.operators import ann, channels, code, graph
from memlake.streaming import writes


def test_contains_takes_its_needles_from_every_row_of_the_other_table(spark, tmp_path):
    from memlake.plans import catalog, catalog_memory  # noqa: F401

    spark.createDataFrame([(1, "Green"), (2, "blue")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([("Xa",), ("Ya",), ("Za",), ("Wa",), ("Qa",), ("BLUE",), ("north",)], "r_name string").coalesce(1).write.parquet(f"{tmp_path}/region.parquet")
    got = catalog.queries()["contains_ignoring_case"](spark, str(tmp_path)).collect()
    assert {(r.p_partkey, r.r_name) for r in got} == {(1, "north"), (2, "BLUE")}


def test_reachable_behind_hubs_is_not_grouped(spark):
    r = random.Random(1)
    pairs = [(k, 900 + k % 3) for k in range(300)] + [(900, 990), (901, 990), (5, 901), (7, 7)] + [(r.randrange(300), r.randrange(300)) for _ in range(40)]
    edges = spark.createDataFrame([(a, b, 0.5) for a, b in pairs], "from_id long, to_id long, confidence double")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seeds = [0, 5, 7, 50, 900, 990, 12345]
    for depth in (0, 1, 2, 3):
        want = set()
        for s in seeds:
            seen = front = {s}
            want.add((s, s, 0))
            for d in range(1, depth + 1):
                front = {y for x in front for y in near.get(x, ())} - seen
                seen = seen | front
                want |= {(s, x, d) for x in front}
        found = graph.reachable(spark.createDataFrame([(s,) for s in seeds], "id long"), edges, depth).collect()
        assert len(found) == len(want) and {(x.seed, x.id, x.depth) for x in found} == want


def test_stepwise_is_the_closure(spark):
    r = random.Random(2)
    rows = [(k, k + 1) for k in range(30)] + [(30, 25), (3, 9), (40, 41), (41, 40), (50, 50)] + [(r.randrange(60), r.randrange(60)) for _ in range(15)]
    edges = spark.createDataFrame(rows, "from_id long, to_id long")
    for depth in (1, 2, 5, 11):
        assert sorted(map(tuple, graph.stepwise(edges, depth).select("id", "other", "depth").collect())) == sorted(map(tuple, graph.closure(edges, depth).select("id", "other", "depth").collect()))


def test_a_task_compares_few_queries_at_once(spark, monkeypatch):
    sizes = []
    whole = ann.similarities
    monkeypatch.setattr(ann, "similarities", lambda q, v: sizes.append(len(q[0])) or whole(q, v))
    rng = np.random.default_rng(4)
    make = lambda n: pa.array([x.tolist() for x in rng.normal(size=(n, 3))], pa.list_(pa.float64()))
    left = pa.table({"query_id": pa.array(range(300), pa.int64()), "query_vec": make(300)})
    right = pa.table({"id": pa.array(range(50), pa.int64()), "vec": make(50), "weight": pa.array([float("nan")] * 50), "ord": pa.array(range(50), pa.int64())})
    seen = []

    class Blocks:
        def groupBy(self, *_):
            return self

        def cogroup(self, other):
            return self

        def applyInArrow(self, block, schema):
            seen.append(block(left, right))

    ann._compare(Blocks(), Blocks(), [], 5, None, False, True)
    got = seen[0].to_pydict()
    s = whole(ann._matrix(left.column("query_vec")), ann._matrix(right.column("vec")))
    want = [(q, k) for q in range(300) for k in sorted((k for k in range(50) if k != q), key=lambda k: (-round(s[q, k], 9), k))[:5]]
    assert list(zip(got["query_id"], got["id"])) == want and max(sizes) <= 128


def test_memories_of_the_same_entities_are_ranked_once(spark, monkeypatch):
    r, sizes = random.Random(3), []
    whole = channels._numbered
    monkeypatch.setattr(channels, "_numbered", lambda df, *order: sizes.append(df.count()) or whole(df, *order))
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    container, stamp = {m: "cd"[m % 2] for m in range(800)}, {m: m // 3 for m in range(800)}
    has = {m: r.sample(range(4), r.choice((1, 2))) for m in container}
    ids = {(c, k): 10 * i + k for i, c in enumerate("cd") for k in range(4)}
    memories = one([(m, container[m], m % 9 == 0) for m in container], "id long, container string, is_forgotten boolean").selectExpr("*", "timestamp_seconds(id div 3) as created_at")
    entities = one([(i, f"name{k % 3}", c, 1) for (c, k), i in ids.items()], "id long, name string, container string, mention_count long")
    links = one([(m, ids[container[m], k]) for m in has for k in has[m]], "memory_id long, entity_id long")
    requests = one([(q, "c") for q in range(6)], "request_id long, container string")
    held = one([(q, 2 * q) for q in range(6)], "request_id long, id long")
    edges = one([], "from_id long, to_id long, confidence double")
    most = one([(q, 5 - q % 3) for q in range(6)], "request_id long, most int")
    got = channels.entity_memories(held, requests, memories, entities, links, edges, most, channels.Limits()).collect()
    names = {m: {k % 3 for k in has[m]} for m in has}
    want = set()
    for q in range(6):
        match = {m: len(names[m] & names[2 * q]) for m in has if container[m] == "c" and m % 9}
        first = sorted((m for m in match if match[m]), key=lambda m: (-match[m], -stamp[m], m))[: 5 - q % 3]
        want |= {(q, m, n + 1) for n, m in enumerate(first)}
    assert {(x.request_id, x.id, x["at"]) for x in got} == want and len(got) == len(want)
    # six sets of names, five memories each; not the hundreds that have one of the names
    assert sizes[-1] <= 6 * 6 * 5


def test_only_the_first_chunks_of_a_name_meet_its_requests(spark, monkeypatch):
    sizes = []
    whole = channels._numbered
    monkeypatch.setattr(channels, "_numbered", lambda df, *order: sizes.append(df.count()) or whole(df, *order))
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    chunks = one([(k, "c", f"text {k}", [0.0, 1.0], "done" if k % 4 else "processing") for k in range(400)], "id long, container string, content string, vec array<double>, status string")
    entities = one([(1, "x", "c"), (2, "y", "c"), (3, "x", "c")], "id long, name string, container string")
    links = one([(k, 1 + k % 3) for k in range(400)], "chunk_id long, entity_id long")
    requests = one([(q, "c", [1.0, 0.2], q == 2, ["x", "y"] if q else ["y"]) for q in range(3)], "request_id long, container string, query_vec array<double>, sub_agent boolean, names array<string>")
    got = channels.chunk_channel(requests, chunks, entities, links, channels.Limits(entity_chunk_threshold=0.1)).collect()
    assert {(x.request_id, x.id, x.channel) for x in got} == {(0, k, "entity") for k in (1, 7, 10)} | {(1, k, "entity") for k in (1, 2, 3)} | {(2, k, "entity") for k in (1, 2)}
    assert sizes[-1] <= 3 * 6


def test_python_units_visit_statements_only(monkeypatch):
    source = """import a.b, c
from d import e as f
if x:
    import g
    class K:
        import h
else:
    from i import j
try:
    import k
except E:
    import l
else:
    import m
finally:
    import n
match x:
    case 1:
        import o
with p as q:
    while True:
        import r
def s(t: u, v: dict[str, int], w=lambda: 0) -> y:
    import z
    return {b: [c for c in d] for b in e}
"""
    want = tuple(a.name for n in ast.walk(ast.parse(source)) if isinstance(n, (ast.Import, ast.ImportFrom)) for a in n.names)
    unparsed, whole = [], ast.unparse
    monkeypatch.setattr(ast, "walk", None)
    monkeypatch.setattr(ast, "unparse", lambda n: unparsed.append(n) or whole(n))
    (unit,) = code.python_units(source)
    assert unit.uses == want and len(want) == 13 and unit.signature == "def s(t: u, v: dict[str, int], w) -> y" and len(unparsed) == 1


def test_reports_count_real_minutes_as_numbers(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # clocks go from 2:00 to 3:00 between the first two: eight minutes pass
        events = spark.sql("select 'm' as memory_id, timestamp'2024-03-10 01:55:00' as ts, 'written' as event, '' as detail, false as is_capture union all select 'm', timestamp'2024-03-10 03:03:00', 'embedded', '', false union all select 'm', timestamp'2024-03-10 03:06:00', 'distinct', '', false")
        found = writes.statuses(events, until="2024-03-10 03:04:00")
        got = [(r.status, r.stage, r.at) for r in found.select("status", "stage", F.col("at").cast("string").alias("at")).collect()]
        assert "Arrow" in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [("processing", "written", "2024-03-10 01:55:00"), ("processing", "embedded", "2024-03-10 03:03:00"), ("stuck", "embedded", "2024-03-10 03:05:00"), ("processing", "distinct", "2024-03-10 03:06:00")]


def test_graph_view_has_tasks_by_its_lines(spark, monkeypatch, tmp_path):
    from memlake.plans import catalog, catalog_memory

    monkeypatch.setattr(catalog_memory, "LINES_AT_ONCE", 50, raising=False)
    lines = [(k % 97, k % 13) for k in range(600)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k / 2) for k in range(99)], "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, f"b{k % 5}") for k in range(12)], "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = catalog.queries()["graph_view"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert {(r.id, r.type, r.name, r.confidence) for r in got} == {(o, "brand", f"b{p % 5}", o / 2) for o, p in lines if p < 12}
    assert len({r[:4] for r in got}) == len(got) and len({r.task for r in got}) == 12
