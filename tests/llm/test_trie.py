"""The prefix trie against a plain version that makes every node from all prefixes."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from memlake.llm import trie


def plain(rows):
    """rows: (conv_id, turn, role, text). Nodes as {(conv_id, depth): the other columns}."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0, role or "", text or ""), (role or "", text or "")))
    own = {c: [x for _, x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.defaultdict(set)
    for key in members:
        if key:
            children[key[:-1]].add(key)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        leaves[key] = sum(leaves[k] for k in children[key]) or 1
        mine = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        saved[key] = mine + sum(saved[k] for k in children[key])
    out = {}
    for key, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(key))))
        out[min(convs), len(key)] = (min(members[key[:-1]]) if key else None, len(convs), len(children[key]), leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, d int")
    out = trie.prefix_trie(table, **options).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out}
    assert len(found) == len(out)
    return found


@pytest.fixture(scope="module")
def mixed():
    """A hot first turn, copies of a conversation, a long shared prefix, nulls, ties, repeated rows, ids below zero, turnless ones."""
    rng = np.random.default_rng(11)
    rows = []
    for c in range(-20, 150):
        n = int(rng.integers(1, 9))
        for t in range(n):
            text = "hello" if t == 0 and c % 3 == 0 else f"ü{rng.integers(0, 3)}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", text))
    for c in range(300, 340):
        rows += [(c, t, "user", "same") for t in range(6)]
    for c in range(400, 412):
        rows += [(c, t, "user", f"step {t}") for t in range(9 + 3 * (c - 400))]
    rows += [(500, None, None, None), (500, 0, "b", "y"), (500, 0, "a", "z"), (500, 0, "a", "z"), (501, 5, "user", ""), (502, 1, "", None), (None, 0, "user", "lost")]
    return rows


def test_small_buckets_at_once(spark, mixed):
    assert got(spark, mixed) == plain(mixed)


def test_rounds_of_large_buckets(spark, mixed):
    assert got(spark, mixed, local_turns=40) == plain(mixed)


def test_every_bucket_dealt_out(spark):
    rows = [(c, t, "u", f"{(c >> (3 - t)) & 1}") for c in range(16) for t in range(4)] + [(c, t, "u", "deep") for c in range(20, 24) for t in range(30 + c)]
    assert got(spark, rows, local_turns=0) == plain(rows)


def test_empty_and_turnless(spark):
    assert got(spark, []) == {}
    # crc32 of these leaves them no turns of their own and no base
    short = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0][:4]
    rows = [(c, 0, "user", "gone") for c in short]
    assert got(spark, rows) == plain(rows) and len(plain(rows)) == 1


def test_multikey_quicksort_on_one_task():
    rng = np.random.default_rng(2)
    rows = {tuple(rng.integers(0, 3, rng.integers(1, 6)).tolist()) for _ in range(60)}
    rows = [(k, 1 + k % 3, f"e{k}", list(ids), [1] * len(ids)) for k, ids in enumerate(sorted(rows, key=hash))]
    nodes = trie.multikey(rows, 0)
    prefixes = {tuple(r[3][:d]) for r in rows for d in range(1, len(r[3]) + 1)}
    assert len(nodes) - 1 == len(prefixes)
    assert nodes[0][7] == sum(1 for p in prefixes if not any(q[: len(p)] == p and len(q) > len(p) for q in prefixes))
    assert sorted(n[4] for n in nodes if n[4]) == sorted(r[2] for r in rows)
