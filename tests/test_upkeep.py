"""Streams of evidence, decisions of a person, names in questions, noise, samples, scans."""

import random
import re
from datetime import datetime, timedelta

from memlake.functions import rules
from memlake.operators import chunking, claims, memory, migration, relational
from memlake.streaming import reconcile

BEGIN = datetime(2024, 1, 1)


def test_stream_of_evidence_equals_a_rebuild(spark, tmp_path):
    """Evidence in three files; the stream is stopped after each, and once breaks off between a version's files and its number."""
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = [(f"e{k:02d}", BEGIN + timedelta(minutes=k), "text", "agent_add", "verbatim", f"s{k % 5}", "fact") for k in range(45)]
    judged = []
    for k in range(45):
        for no in range(r.randint(1, 2)):
            kind = r.choice(["UNRELATED", "SUPPORT", "CONFLICT"]) if k else "UNRELATED"
            judged.append((f"e{k:02d}", no, 0, kind, f"cl_e{r.randint(0, max(k - 1, 0)):02d}_0"))
    schema = "evidence_id string, observed_at timestamp, content string, source_kind string, extraction_type string, session_id string, claim_kind string"
    all_judged = spark.createDataFrame(judged, "evidence_id string, claim_no int, ord int, judgment string, target_claim_id string").cache()
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    fail = {"at": 1}

    def judge(batch, state):
        return all_judged.join(batch.select("evidence_id"), "evidence_id", "left_semi")

    swap = migration.swap

    def broken(state, path, version=None):
        if fail.get("at") == version - 1:
            del fail["at"]
            state["claims"].limit(3).write.mode("overwrite").parquet(f"{path}/claims/version={version}")
            raise RuntimeError("lost")
        return swap(state, path, version)

    migration.swap = broken
    try:
        for a, b in ((0, 20), (20, 21), (21, 45)):
            spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(source)
            for _ in range(2):
                q = reconcile.reconciled(spark.readStream.schema(spark.createDataFrame(rows, schema).schema).parquet(source), out, judge, check).trigger(availableNow=True).start()
                try:
                    assert q.awaitTermination(120)
                    break
                except Exception:
                    assert "at" not in fail
    finally:
        migration.swap = swap
    state = migration.current(spark, out)
    whole = claims.rebuilt(spark.createDataFrame(rows, schema), all_judged)
    read = lambda s: sorted((x.claim_id, round(x.content_confidence, 6), x.status) for x in s["claims"].collect())
    assert read(state) == read(whole) and len(read(whole)) > 25 and migration.latest(spark, out) == 3 and not fail
    assert state["edges"].count() == whole["edges"].count() and F is not None


def test_decisions(spark):
    c = spark.createDataFrame([("a", "o", "s", "fact", 0.5, "active"), ("b", "o", None, "fact", None, "active"), ("c", "o", "s", "fact", 0.2, "active")], "claim_id string, owner_id string, scope string, claim_kind string, content_confidence double, status string")
    yes = spark.createDataFrame([("a",), ("a",), ("b",), ("zz",)], "claim_id string")
    assert {r.claim_id: None if r.content_confidence is None else round(r.content_confidence, 6) for r in claims.confirmed(c, yes).collect()} == {"a": 0.595, "b": 0.5, "c": 0.2}
    state = claims.empty_state(spark) | {"claims": c.select("claim_id", "claim_kind", "content_confidence", "status")}
    out = claims.forgotten(state, yes)
    assert {r.claim_id: r.status for r in out["claims"].collect()} == {"a": "retracted", "b": "retracted", "c": "active"}
    assert sorted((r.from_claim, r.to_claim, r.type) for r in out["edges"].collect()) == [("a", None, "retract"), ("b", None, "retract")]
    links = spark.createDataFrame([("a", "e1"), ("a", "e2"), ("c", "e3")], "claim_id string, evidence_id string")
    p = claims.promoted(c, links, spark.createDataFrame([("a", "adopt"), ("b", "adopt"), ("c", "reject"), ("zz", "adopt")], "claim_id string, action string"))
    assert {r.claim_id for r in p["claims"].where("scope is null").collect()} == {"b", "a_global"} and p["claims"].count() == 4
    assert sorted(r.evidence_id for r in p["links"].where("claim_id = 'a_global'").collect()) == ["e1", "e2"]
    assert {(r.claim_id, r.decision) for r in p["activity"].collect()} == {("a", "adopt"), ("c", "reject")} and p["edges"].count() == 1


def test_names_in_questions(spark):
    q = spark.createDataFrame([(1, "c", "my apple pie and apple"), (2, "d", "apple"), (3, "c", None)], "request_id long, container string, query string")
    e = spark.createDataFrame([(1, "apple", "thing", "c", 3), (2, "apple", "org", "c", 9), (3, "apple pie", "thing", "c", 1), (4, "", "thing", "c", 1), (5, "pear", "thing", "c", 1)], "id long, name string, type string, container string, mention_count long")
    links = spark.createDataFrame([(k, 1) for k in range(9, 0, -1)] + [(7, 1)], "memory_id long, entity_id long")
    out = memory.named_entities(q, e, links).orderBy("position").collect()
    assert [(r.request_id, r.name, r.type, r.memory_ids) for r in out] == [(1, "apple pie", "thing", []), (1, "apple", "thing", [1, 2, 3, 4, 5])]


def test_noise_finders_one_by_one(spark):
    names = ["src/a.py", "a.py", "3.14", "用户表", "v2.0.1", "bg_00ff11", "deadbeef", "a BUG", "## head", "a|1", "史诗", "系统", "价格", "阈值", "迁移", "Migration", "迁移到2", "技术7", "稀有卡", "天罡星", "10连抽", "3张好卡牌", "玩游戏", "测试", "修复", "agent x", "Kimi", "Google", "仓库", "x", "y" * 21, "good name", "将 |"]
    kinds = ["person", "preference", "event", "organization", "location", "thing"]
    rows = [(k, n, t, 1) for k, (n, t) in enumerate((n, t) for n in names for t in kinds)] + [(1000, "good name", "thing", 99), (1001, " THE ", "thing", 1)]
    found = {r.id: set(r.reasons) for r in memory.noisy(spark.createDataFrame(rows, "id long, name string, type string, mention_count long"), spark.createDataFrame([("the",)], "name string")).collect()}
    best = {}
    for k, n, _, m in rows:
        if n not in best or (-m, k) < best[n]:
            best[n] = (-m, k)
    for k, n, t, _ in rows:
        want = set()
        for finder, type_, patterns, case, parts, whole in rules.NOISE_FINDERS:
            hit = any(re.search(p, n, 0 if case else re.I) for p in patterns) or any(x in n for x in parts) or n in whole
            if finder == "file_path":
                hit = hit and ("/" in n or bool(re.search(r"\.[a-z]{2,4}$", n)))
            if hit and type_ in (None, t):
                want.add(finder)
        want |= {"length_invalid"} if not 2 <= len(n) <= 20 else set()
        want |= {"blacklist"} if n.strip().lower() == "the" else set()
        want |= {"duplicate"} if best[n][1] != k else set()
        assert found.get(k, set()) == want, (n, t)
    assert {x for v in found.values() for x in v} >= {f for f, *_ in rules.NOISE_FINDERS}


def test_samples_and_scans(spark):
    from pyspark.sql import functions as F

    df = spark.range(20_000).withColumn("bad", F.col("id") % 1000 == 0)
    n = memory.sampled(df, F.col("id"), 0.1).count()
    assert 1700 < n < 2300 and memory.sampled(df, F.col("id"), 0.0, F.col("bad")).count() == 20 and memory.sampled(df, F.col("id"), 1.0).count() == 20_000
    keys = sorted({(k * 7919) % 10_007 for k in range(1003)})
    t = spark.createDataFrame([(k, "x") for k in keys], "key long, row_number string").repartition(5)
    numbered = {r.key: r.n for r in relational.numbered(t.select("key"), "key", 7).withColumnRenamed("row_number", "n").collect()}
    assert numbered == {k: i + 1 for i, k in enumerate(keys)}
    pages = relational.scan_pages(t, "key", 100).orderBy("page").collect()
    assert [(p.after, p.last, p.n) for p in pages] == [(keys[i * 100 - 1] if i else None, keys[min(i * 100 + 99, 1002)], min(100, 1003 - i * 100)) for i in range(11)]
    assert relational.scan_pages(t.where("false"), "key", 10).count() == 0


def test_long_conversations_are_read_in_order(spark):
    rows = [(1, t, "user", "x" * (t % 7 * 100)) for t in range(4000)] + [(2, 0, "a", "y" * 5000), (2, 1, "a", None), (3, 0, None, "z")]
    out = {}
    for r in chunking.conversation_chunks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1000).collect():
        out.setdefault(r.conv_id, {})[r.chunk] = r.content
    want, size = [[]], 0
    for _, t, role, text in rows[:4000]:
        if want[-1] and size + len(text) > 1000:
            want.append([])
            size = 0
        want[-1].append(f"[{role}] {text}")
        size += len(text)
    assert [out[1][k] for k in sorted(out[1])] == ["\n".join(x) for x in want] and len(out[2]) == 2
