"""Caches, written memories and sessions: tables and streams against plain versions."""

import hashlib
import random
import time
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest

from memlake.operators import cache
from memlake.streaming import injection, writes

BEGIN = datetime(2024, 3, 1)


# ---------------------------------------------------------------- cache
def plain_cache(log, capacity, ttl):
    held, out = OrderedDict(), {}
    for seq, key, ts in sorted(log):
        entry, evicted = held.get(key), None
        if entry is not None and ts - entry <= ttl:
            held.move_to_end(key)
            outcome = "hit"
        else:
            outcome = "expired" if entry is not None else "absent"
            held.pop(key, None)
            if len(held) >= capacity:
                evicted = held.popitem(last=False)[0]
            held[key] = ts
        out[seq] = (key, outcome, evicted)
    return out, len(held)


@pytest.mark.parametrize("capacity,ttl,block", [(5, 40, 60), (1, 10**6, 7), (30, 25, 1000), (8, 0, 33)])
def test_cache_is_a_plain_lru(spark, capacity, ttl, block):
    r = random.Random(capacity)
    # a hot key, a run of new keys, a key that comes back late
    log, now = [], 0
    for seq in range(700):
        now += r.choice([0, 1, 1, 5])
        key = "hot" if seq % 3 == 0 else f"k{r.randint(0, 12)}" if seq % 50 < 30 else f"n{seq}"
        log.append((seq, key, now))
    table = spark.createDataFrame([(s, k, BEGIN + timedelta(seconds=t), "x") for s, k, t in log] + [(9999, None, BEGIN, "x")], "seq long, key string, ts timestamp, block string")
    found = cache.lru(table.repartition(5), capacity, ttl, block)
    want, size = plain_cache(log, capacity, ttl)
    assert {x.seq: (x.key, x.outcome, x.evicted) for x in found.collect()} == want
    s = cache.statistics(found, capacity).first()
    hits = sum(o == "hit" for _, o, _ in want.values())
    assert (s.hits, s.misses, s.size, s.hit_rate) == (hits, len(log) - hits, size, hits / len(log))
    assert cache.lru(table.where("false")).count() == 0


# ---------------------------------------------------------------- written memories
def stories(seed=1, n=60):
    """(memory_id, minute, event, detail, is_capture): orderly, broken, repeated, late and forgotten ones."""
    r, out = random.Random(seed), []
    for m in range(n):
        at = r.uniform(0, 50)
        out.append((f"m{m}", at, "written", None, m % 2 == 0))
        for event in ["embedded", r.choice(["distinct", "duplicate"]), "extracted", "related"]:
            at += r.choice([0.1, 0.5, 2, 6])
            if r.random() < 0.3:
                out.append((f"m{m}", at, "error", "boom", None))
                at += 0.2
            if r.random() < 0.1:
                continue
            out.append((f"m{m}", at, event, "none" if event == "embedded" and m % 5 == 0 else None, None))
            if r.random() < 0.2:
                out.append((f"m{m}", at, event, None, None))
    out += [("m0", 3000, "written", None, False), ("m0", 3000.5, "embedded", None, None), ("zz", 1, "related", None, None)]
    return sorted(out, key=lambda x: x[1])


def table(spark, rows):
    return spark.createDataFrame([(m, BEGIN + timedelta(minutes=at), e, d, c) for m, at, e, d, c in rows], "memory_id string, ts timestamp, event string, detail string, is_capture boolean")


def key(rows):
    return sorted((r.memory_id, r.at, r.status, r.stage, r.attempts, r.detail or "") for r in rows)


def test_statuses_of_one_memory(spark):
    def run(*events, until=None):
        return [(r.status, r.stage, r.attempts) for r in sorted(writes.statuses(table(spark, [("a", *e) for e in events]), until).collect(), key=lambda r: r.at)]

    done = [(0, "written", None, False), (1, "embedded", None, None), (2, "distinct", None, None), (3, "extracted", "rate_limited", None), (4, "related", None, None)]
    assert run(*done) == [("processing", "written", 0), ("processing", "embedded", 0), ("processing", "distinct", 0), ("processing", "extracted", 0), ("completed", "extracted", 0)]
    assert run(*done[:2], (2, "duplicate", "b", None))[-1] == ("merged", "embedded", 0)
    assert run((0, "written", None, True), done[1], (2, "duplicate", "b", None))[-1] == ("dropped", "embedded", 0)
    assert run(done[0], (1, "embedded", "none", None), (2, "extracted", None, None))[1:] == [("processing", "distinct", 0), ("processing", "extracted", 0)]
    assert run(done[0], *[(k, "error", "x", None) for k in (1, 2, 3, 4)])[1:] == [("retrying", "written", 1), ("retrying", "written", 2), ("failed", "written", 3)]
    assert run(done[0], done[2], done[4]) == [("processing", "written", 0)]  # too early: ignored
    assert run(done[0], (15, "embedded", None, None)) == [("processing", "written", 0), ("stuck", "written", 0), ("processing", "embedded", 0)]
    assert run(done[0]) == [("processing", "written", 0)] and run(done[0], until="2024-03-02") == [("processing", "written", 0), ("stuck", "written", 0)]
    assert run(*done, (5, "written", None, False))[-1][0] == "completed" and run(*done, (5000, "written", None, False))[-1] == ("processing", "written", 0)


def replay(spark, tmp_path, frames, make, name, schema):
    """A stream over files that arrive one by one; the query is stopped and started again from its checkpoint after each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, sink, check = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "check"))
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
        time.sleep(0.1)
    return spark.read.parquet(sink).collect()


def test_stream_of_writes_equals_the_table(spark, tmp_path):
    rows = stories()
    end = [("end", 9000, "written", None, False)]
    frames = [rows[:90], rows[90:91], rows[91:], end]
    found = replay(spark, tmp_path, [table(spark, f) for f in frames], writes.status_stream, "writes", table(spark, rows).schema)
    want = writes.statuses(table(spark, rows + end), until=str(BEGIN + timedelta(minutes=9000))).collect()
    assert key(found) == key(want)
    assert {"stuck", "failed", "completed", "merged", "dropped"} <= {r.status for r in want}


def test_rebuilds(spark):
    rows = [("a", 0), ("a", 299), ("a", 300), ("b", 301), ("b_c", 5), ("d", 900)]
    e = spark.createDataFrame([(c, BEGIN + timedelta(seconds=s)) for c, s in rows], "container_tag string, ts timestamp")
    got = {(r.container_tag, int((r.at - BEGIN).total_seconds())) for r in writes.rebuilds_due(e).collect()}
    assert got == {(c, t) for c, s in rows if "_" not in c for t in range(0, 3000, 300) if t - 600 < s <= t}


# ---------------------------------------------------------------- sessions
def plain_session(turns, p):
    """The rules written down a second time, over whole lists."""
    injected, order, digests, begun, out = set(), [], set(), False, {}
    for k, (turn, role, text, candidates) in enumerate(turns):
        if role != "user" or not text:
            continue
        if begun and len(text) < p.shortest:
            out[turn] = ("short", [])
            continue
        words = [w for w in injection.KEYWORDS if w in text.lower()]
        if begun and (p.strategy == "once" or (p.strategy == "smart" and not words)):
            out[turn] = ("none", [])
            continue
        history = [(r, t) for _, r, t, _ in turns[:k] if r in ("user", "assistant")][-p.look_back :]
        said = "\n".join(t for r, t in history if r == "assistant")
        good = [(i, c) for i, c, s in candidates if i not in order[-p.most_ids :] and s >= p.threshold and not (history and c[: p.snippet] in said)]
        n = min(len(order), p.most_ids)
        most = p.later if begun else p.first
        good = good[: max(2, int(most * (1 - min(0.5, n * 0.05)))) if p.shrinking else most]
        digest = hashlib.sha1("\n".join(c for _, c in good).encode()).hexdigest()
        if not good:
            out[turn] = ("empty", [])
        elif digest in digests:
            out[turn] = ("repeated", [])
        else:
            out[turn] = ("first" if not begun else "always" if p.strategy == "always" else "keyword", [i for i, _ in good])
            digests.add(digest)
            order += [i for i, _ in good]
            begun = True
    return out


def sessions(n=25):
    r, rows = random.Random(6), []
    for s in range(n):
        said = []
        for t in range(r.randint(1, 60 if s < 3 else 12)):
            role = r.choice(["user", "user", "assistant", "system", None])
            text = r.choice(["what about the config", "之前的项目", "ok", "", None, "nothing special here", f"answer number {t} " * 12])
            ids = r.sample(range(30), r.randint(0, 6))
            c = sorted(((-r.randint(0, 10) / 10, f"i{i}", r.choice([f"text of {i}", *(said[-3:] or ["x"])])) for i in ids))
            rows.append((s, t, role, text, [i for _, i, _ in c], [x for *_, x in c], [-v for v, *_ in c]))
            if role == "assistant" and text:
                said.append(text)
    return rows + [(99, 0, "user", "hello there", None, None, None)]


SCHEMA = "session long, turn long, role string, text string, ids array<string>, contents array<string>, similarities array<double>"


def expected(rows, policy):
    by = {}
    for s, t, role, text, ids, contents, sims in rows:
        by.setdefault(s, []).append((t, role or "", text or "", list(zip(ids or [], contents or [], sims or []))))
    return {(s, t): x for s, turns in by.items() for t, x in plain_session(sorted(turns, key=lambda x: x[0]), policy).items()}


@pytest.mark.parametrize("policy", [injection.Policy(), injection.Policy("once"), injection.Policy("always", most_ids=4, look_back=3), injection.Policy("always", most_ids=2, threshold=0.0, shrinking=False, shortest=1)])
def test_decisions_on_tables(spark, policy):
    rows = sessions()
    got = {(r.session, r.turn): (r.action, r.injected) for r in injection.decisions(spark.createDataFrame(rows, SCHEMA), policy).collect()}
    assert got == expected(rows, policy) and len({a for a, _ in got.values()}) >= 3


def test_decisions_on_streams(spark, tmp_path):
    """Sessions that go on over several runs of the query keep their state."""
    rows, policy = sessions(12), injection.Policy("always", most_ids=3, threshold=0.0)
    frames = [[r for r in rows if r[1] < 3], [r for r in rows if 3 <= r[1] < 9], [r for r in rows if r[1] >= 9]]
    found = replay(spark, tmp_path, [spark.createDataFrame(f, SCHEMA) for f in frames], lambda s: injection.decision_stream(s, policy), "sessions", spark.createDataFrame(rows, SCHEMA).schema)
    assert {(r.session, r.turn): (r.action, r.injected) for r in found} == expected(rows, policy)
