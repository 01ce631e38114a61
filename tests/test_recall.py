"""Walks, chains, claims, channels and migration, against plain versions."""

import random
from datetime import datetime, timedelta

import pytest

from memlake.operators import channels, claims, graph, migration

BEGIN = datetime(2024, 1, 1)


# ---------------------------------------------------------------- graphs
def plain_reach(edges, depth):
    out = {}
    for a in {a for a, _ in edges}:
        front, seen, d = {a}, {}, 0
        while front and d < depth:
            d += 1
            front = {y for x, y in edges if x in front}
            front = {y for y in front if y not in seen}
            seen |= dict.fromkeys(front, d)
        out |= {(a, b): d for b, d in seen.items()}
    return out


@pytest.mark.parametrize("depth", [1, 3, 11])
def test_closure(spark, depth):
    r = random.Random(depth)
    edges = {(k, k + 1) for k in range(30)} | {(40, 41), (41, 42), (42, 40), (50, 50)} | {(r.randint(60, 75), r.randint(60, 75)) for _ in range(20)}
    found = graph.closure(spark.createDataFrame(sorted(edges) * 2 + [(None, 1), (1, None)], "from_id long, to_id long"), depth).collect()
    assert {(x.id, x.other): x.depth for x in found} == plain_reach(edges, depth) and len(found) == len({(x.id, x.other) for x in found})
    assert graph.closure(spark.createDataFrame([], "from_id long, to_id long"), depth).count() == 0


def test_version_history(spark):
    m = spark.createDataFrame([(k, BEGIN + timedelta(days=k), k == 15) for k in range(16)] + [(99, None, False)], "id long, created_at timestamp, is_latest boolean")
    u = spark.createDataFrame([(k, k - 1) for k in range(1, 16)] + [(0, 99), (2, 77), (5, 5)], "from_id long, to_id long")
    rows = [r for r in graph.version_history(m, u).collect() if r.seed == 15]
    assert sorted((r.depth, r.id) for r in rows) == [(d, 14 - d) for d in range(11)] and sorted((r.position, r.id) for r in rows) == [(d + 1, 14 - d) for d in range(11)]
    of5 = {r.id: (r.depth, r.position) for r in graph.version_history(m, u).where("seed = 5").collect()}
    assert of5[5] == (0, 1) and of5[99] == (5, 7) and 77 not in of5


def plain_walk(seed, links, live, depth, nodes):
    out = []

    def go(v, d):
        if d > depth or len(out) >= nodes or v in out or v not in live:
            return
        out.append(v)
        for x in dict.fromkeys(links.get(v, [])):
            if len(out) >= nodes:
                return
            go(x, d + 1)

    go(seed, 0)
    return out


@pytest.mark.parametrize("depth,nodes", [(2, 5), (1, 3), (3, 7), (2, 1)])
def test_memory_walk(spark, depth, nodes):
    """A hub of 300 links, cycles, forgotten and missing targets, types that are not asked for."""
    r = random.Random(nodes)
    links = {0: [*range(1, 300)], 1: [0, 2, 3], 2: [1, 0, 5], 7: [7, 8]} | {k: [r.randint(0, 60) for _ in range(r.randint(0, 25))] for k in range(10, 60)}
    forgotten, missing = {2, 13, 20}, {5, 30}
    rel = [(a, b, "updates" if k % 3 else "derives", k) for a, bs in links.items() for k, b in enumerate(bs)]
    live = set(range(400)) - forgotten - missing
    memories = spark.createDataFrame([(k, k in forgotten) for k in range(400) if k not in missing], "id long, is_forgotten boolean")
    for types in (None, ["updates"]):
        use = {}
        for a, b, kind, _ in rel:
            if types is None or kind in types:
                use.setdefault(a, []).append(b)
        seeds = spark.createDataFrame([(k,) for k in (*range(62), 399, 5, 2)], "id long")
        got = {}
        for x in graph.memory_walk(seeds, memories, spark.createDataFrame(rel, "from_id long, to_id long, type string, ord int"), depth, nodes, types).orderBy("seed", "position").collect():
            got.setdefault(x.seed, []).append(x.id)
        assert got == {s: w for s in (*range(62), 399) if (w := plain_walk(s, use, live, depth, nodes))}


def test_chains(spark):
    c = spark.createDataFrame([(k, "a" if k < 20 else "b") for k in range(25)], "claim_id long, owner_id string")
    e = spark.createDataFrame([(1, 2, "supersedes"), (2, 3, "supersedes"), (9, 3, "supersedes"), (3, None, "retract"), (4, 5, "extends"), (6, 7, "supersedes"), (7, 6, "supersedes"), (10, 11, "supersedes"), (10, 12, "supersedes"), (20, 21, "supersedes")], "from_claim long, to_claim long, type string")
    got = {r.claim_id: (r.n_out, r.n_in, r.n_above, r.n_below, list(r.heads)) for r in graph.chains(c, e, "a").collect()}
    assert len(got) == 20 and got[1] == (1, 0, 2, 0, [3]) and got[3] == (1, 2, 0, 3, [3]) and got[4] == (1, 0, 0, 0, [4]) and got[6] == (1, 1, 1, 1, []) and got[10] == (2, 0, 2, 0, [11, 12])
    assert {r.claim_id for r in graph.chains(c, e).where("n_above > 0").collect()} == {1, 2, 9, 6, 7, 10, 20}


# ---------------------------------------------------------------- claims
PRIOR = {"verbatim": 0.8, "paraphrase": 0.8, "inference": round(2.8 / 3.8, 4)}
STRENGTH = {"verbatim": 0.8, "paraphrase": 0.3, "inference": 0.0}


def plain_claims(evidence, judgements):
    """One evidence after the other, one claim after the other."""
    state, links, edges, poison = {}, {}, [], set()
    for ev, _, content, extraction, session in sorted(evidence, key=lambda x: (x[1], x[0])):
        own = [j for j in judgements if j[0] == ev]
        numbers = sorted({j[1] for j in own})
        if len(content) > 1500 or len(numbers) > 15 or not numbers:
            continue
        n = 0
        for no in numbers:
            ordered = sorted((j for j in own if j[1] == no), key=lambda j: j[2])
            back = next((j[4] for j in ordered if j[3] in ("SUPPORT", "REDUNDANT")), None)
            against = next((j[4] for j in ordered if j[3] == "CONFLICT"), None)
            if back is not None:
                if back in state:
                    known = session is not None and session in [s for _, s in links[back]]
                    links[back].append((ev, session))
                    if STRENGTH[extraction] > 0 and not known:
                        state[back][0] += (1 - state[back][0]) * STRENGTH[extraction] * 0.2
                continue
            name = f"cl_{ev}_{no}"
            state[name], links[name] = [PRIOR[extraction], "active"], [(ev, session)]
            if against in state and against != name:
                edges.append((against, name))
                state[against][1] = "superseded"
                n += 1
        if n > 3:
            poison.add(ev)
    return {k: (round(c, 6), s) for k, (c, s) in state.items()}, edges, poison


def claim_rows(seed=3, n=80):
    r, evidence, judged, names = random.Random(seed), [], [], []
    for k in range(n):
        ev = f"e{k:03d}"
        evidence.append((ev, BEGIN + timedelta(hours=k // 2), "x" * (1600 if k % 17 == 5 else 10), r.choice(["verbatim", "paraphrase", "inference"]), r.choice(["s1", "s2", "s3", None])))
        if k % 19 == 7:
            continue
        made = []
        for no in range(20 if k % 23 == 9 else 6 if k % 9 == 8 else r.randint(1, 3)):
            kinds = ["CONFLICT"] * 5 if k % 9 == 8 else ["UNRELATED", "SUPPORT", "REDUNDANT", "CONFLICT"]
            targets = names[:] or [None]
            for o in range(r.randint(1, 3)):
                kind = r.choice(kinds)
                judged.append((ev, no, o, kind, None if kind == "UNRELATED" else r.choice([*targets[:6], targets[-1], "nowhere"] if no else targets[-3:])))
            made.append(f"cl_{ev}_{no}")
        names += made
    return evidence, judged


EV, JU = "evidence_id string, observed_at timestamp, content string, extraction_type string, session_id string", "evidence_id string, claim_no int, ord int, judgment string, target_claim_id string"


def frames(spark, evidence, judged):
    from pyspark.sql import functions as F

    return spark.createDataFrame(evidence, EV).withColumns({"source_kind": F.lit("agent_add"), "claim_kind": F.lit("fact")}), spark.createDataFrame(judged, JU)


def read(state):
    return {r.claim_id: (round(r.content_confidence, 6), r.status) for r in state["claims"].collect()}


@pytest.mark.parametrize("seed", [3, 4])
def test_rebuild_equals_batches_and_a_plain_fold(spark, tmp_path, seed):
    evidence, judged = claim_rows(seed)
    want, edges, poison = plain_claims(evidence, judged)
    whole = claims.rebuilt(*frames(spark, evidence, judged))
    assert read(whole) == want and len(want) > 60 and {s for _, s in want.values()} == {"active", "superseded"}
    assert sorted((r.from_claim, r.to_claim) for r in whole["edges"].collect()) == sorted(edges)
    assert {r.evidence_id for r in whole["poison"].collect()} == poison and (poison or seed == 4)
    path = str(tmp_path / "claims")
    state = claims.empty_state(spark)
    for a, b in ((0, 20), (20, 21), (21, 60), (60, 80)):
        part = {e[0] for e in evidence[a:b]}
        after = claims.applied(state, *frames(spark, [e for e in evidence if e[0] in part], [j for j in judged if j[0] in part]))
        assert migration.swap(after, path) == migration.latest(spark, path)
        state = migration.current(spark, path)
    assert read(state) == want and migration.latest(spark, path) == 4
    assert {(r.claim_id, r.evidence_id) for r in state["links"].collect()} == {(r.claim_id, r.evidence_id) for r in whole["links"].collect()}


def test_unknown_confidence_begins_at_its_first_support(spark):
    state = claims.empty_state(spark) | {"claims": spark.createDataFrame([("c", "fact", None, "active")], "claim_id string, claim_kind string, content_confidence double, status string")}
    evidence = [("e2", BEGIN + timedelta(days=1), "x", "verbatim", "s2"), ("e1", BEGIN, "x", "paraphrase", "s1")]
    after = claims.applied(state, *frames(spark, evidence, [("e1", 0, 0, "SUPPORT", "c"), ("e2", 0, 0, "SUPPORT", "c")]))
    assert read(after) == {"c": (round(0.3 + 0.7 * 0.16, 6), "active")}


def test_claim_search(spark):
    asks = spark.createDataFrame([(1, "o", "s", None, [1.0, 0.0]), (2, "o", None, "k", [1.0, 0.0]), (3, "o", "s", None, None), (4, "nobody", "s", None, [1.0, 0.0])], "request_id long, owner_id string, scope string, claim_kind string, query_vec array<double>")
    rows = [(k, "o", "s" if k % 2 else None, "k" if k % 3 else "j", "active" if k != 4 else "superseded", 0.5 + k / 100, [1.0, k / 5]) for k in range(12)] + [(20, "o", "s", "k", "active", 0.9, None), (21, "o", "t", "k", "active", 0.9, [1.0, 0.0]), (22, "p", "s", "k", "active", 0.9, [1.0, 0.0])]
    c = spark.createDataFrame(rows, "id long, owner_id string, scope string, claim_kind string, status string, content_confidence double, vec array<double>")
    near = [(r.id, r["rank"]) for r in claims.candidates(asks, c, 3).where("request_id = 1").orderBy("rank").collect()]
    assert near == [(0, 1), (1, 2), (2, 3)]
    out = claims.search(asks, c, limit=6, coarse=4).collect()
    first = {r.id: (r["rank"], r.relevance, r.n_candidates) for r in out if r.request_id == 1}
    assert set(first) == {0, 1, 2, 3, 5, 6} and first[5][:2] == (5, 0.0) and first[6][:2] == (6, 0.0) and first[0][2] == 12
    assert [r.id for r in sorted(out, key=lambda r: r["rank"]) if r.request_id == 2][:2] == [2, 8]
    assert [(r.id, r.relevance) for r in sorted(out, key=lambda r: r["rank"]) if r.request_id == 3] == [(k, 0.0) for k in (0, 1, 2, 3, 5, 6)]
    assert not [r for r in out if r.request_id == 4]


# ---------------------------------------------------------------- channels
def test_memory_channel_by_hand(spark):
    p = channels.Limits(threshold=0.4)
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    requests = one([(1, "c", "about apples", [1.0, 0.0], False), (2, "c", "about apples", [1.0, 0.0], True), (3, "empty", "x", [1.0, 0.0], False)], "request_id long, container string, query string, query_vec array<double>, sub_agent boolean")
    vec = lambda s: [s, (1 - s * s) ** 0.5]
    sims = {10: 0.99, 11: 0.9, 12: 0.8, 13: 0.44, 14: 0.42, 15: 0.41, 16: 0.1, 17: 0.1, 18: 0.1, 19: 0.95, 20: 0.1, 21: 0.1, 22: 0.1}
    text = {13: "fresh APPLES here", 14: "pears"}
    memories = one([(k, "c", text.get(k, f"memory {k}"), vec(s), BEGIN + timedelta(days=k), k == 19) for k, s in sims.items()] + [(99, "other", "x", vec(1.0), BEGIN, False)], "id long, container string, content string, vec array<double>, created_at timestamp, is_forgotten boolean")
    relations = one([(10, 16, "extends", 0), (10, 11, "updates", 1), (11, 19, "updates", 0), (12, 17, "derives", 0), (13, 18, "extends", 0)], "from_id long, to_id long, type string, ord int")
    entities = one([(1, "Fruit", "c", 9), (2, " fruit ", "c", 3), (3, "tree", "c", 1), (4, "tree", "other", 1)], "id long, name string, container string, mention_count long")
    links = one([(10, 1), (11, 1), (20, 2), (21, 3), (20, 3), (22, 3), (99, 4)], "memory_id long, entity_id long")
    edges = one([(1, 3, 0.5), (3, 4, 0.5)], "from_id long, to_id long, confidence double")
    excluded = one([(1, 12)], "request_id long, id long")
    found = channels.memory_channel(requests, memories, relations, entities, links, edges, excluded, p).collect()
    of = lambda r, c: {x.id: (x["at"], x.relation_type, x.low_confidence, x.reason) for x in found if x.request_id == r and x.channel == c}
    # 12 is excluded, so the first three are 10, 11 and 13; 19 is forgotten
    assert of(1, "vector") == {10: (1, None, False, None), 11: (2, "updates", False, None), 13: (3, None, False, None), 14: (4, None, True, None), 12: (None, None, False, "excluded")}
    assert of(1, "memory_graph") == {16: (1, "extends", False, None), 18: (2, "extends", False, None)}
    # families of Fruit and tree: 20 has both; of five, two may be new
    assert of(1, "entity_graph") == {20: (1, None, False, None), 22: (2, None, False, None), 21: (3, None, False, "quota"), 11: (4, None, False, "seen"), 10: (5, None, False, "seen")}
    assert set(of(2, "vector")) == {10, 11, 12} and of(2, "memory_graph") == {16: (1, "extends", False, None), 17: (2, "derives", False, None)}
    assert {k: v[3] for k, v in of(2, "entity_graph").items()} == {20: None, 22: "quota", 21: "quota"}
    assert not [x for x in found if x.request_id == 3]


# ---------------------------------------------------------------- migration
def test_a_broken_run_goes_on(spark, tmp_path):
    keys = spark.createDataFrame([("k1", True), ("k2", True), ("dead", False)], "key_id string, is_active boolean")
    tags = ["k1", "k2_project-app", "k1_project-a_project-b", "dead", "k2_other", "_project-x", None]
    rows = [(f"m{k:03d}", tags[k % 7], f"text {k}", BEGIN, k % 11 != 0, k % 13 == 0) for k in range(100)] + [(None, "k1", "x", BEGIN, True, False)]
    memories = spark.createDataFrame(rows, "id string, container_tag string, content string, created_at timestamp, is_latest boolean, is_forgotten boolean")
    want = {i: {"k1": ("k1", None), "k2_project-app": ("k2", "project-app"), "k1_project-a_project-b": ("k1", "project-a_project-b")}[t] for i, t, _, _, latest, gone in rows if i and latest and not gone and t in tags[:3]}
    read_ = lambda path: {r.migrated_from_memory_id: (r.owner_id, r.scope) for r in migration.migrated(spark, path).collect()}
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    first = migration.migrate(memories, keys, whole, "r")
    assert read_(whole) == want and first["migrated"] == len(want) and first["skipped"] == first["total"] - len(want) and first["status"] == "done"

    class Broken(Exception):
        pass

    def fail(batch):
        if batch == 2:
            raise Broken

    with pytest.raises(Broken):
        migration.migrate(memories, keys, broken, "r", batch_rows=15, between=fail)
    assert migration.totals(spark, broken)["status"] == "running" and set(read_(broken)) < set(want)
    migration.migrate(memories, keys, broken, "r", batch_rows=15, stop_after=2)
    last = migration.migrate(memories, keys, broken, "r", batch_rows=15)
    assert read_(broken) == want and {k: last[k] for k in ("total", "migrated", "skipped", "status")} == {k: first[k] for k in ("total", "migrated", "skipped", "status")}
    assert migration.migrated(spark, broken).count() == len(want)
    assert migration.migrate(memories, keys, broken, "r") == last  # done: nothing more happens
    again = migration.migrate(memories, keys, str(tmp_path / "again"), "r2", known=migration.migrated(spark, whole))
    assert again["migrated"] == 0 and again["status"] == "done"
    assert migration.migrate(memories.where("false"), keys, str(tmp_path / "none"), "r3")["total"] == 0
