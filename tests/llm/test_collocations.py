"""Collocations against a plain version that counts all phrases."""

import collections
import re

import numpy as np
import pytest

from memlake.llm import collocations

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    counts = collections.defaultdict(lambda: [collections.Counter() for _ in range(4)])
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                counts["und" if lang is None else lang][k].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, f in counts.items():
        n = sum(f[1].values())
        if not n:
            continue
        found = []
        for k in (2, 3):
            for p, a in f[k].items():
                if a < least:
                    continue
                if k == 2 and any(c >= least and 100 * c >= 50 * a for q, c in f[3].items() if p in (q[:2], q[1:])):
                    continue
                score, cut = min((1000000 * a * a // (f[i][p[:i]] * f[k - i][p[i:]]), i) for i in range(1, k))
                found.append((-score, -a, " ".join(p).encode(), f[cut][p[:cut]], f[k - cut][p[cut:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out[lang, rank] = (p.decode(), -a, left, right, n, -s)
    return out


def got(spark, rows, **options):
    table = spark.createDataFrame([(lang, text, "x", 1) for lang, text in rows], "lang string, text string, h1 string, c long")
    found = collocations.collocations(table, **options).collect()
    assert len({(r.lang, r["rank"]) for r in found}) == len(found)
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found}


@pytest.fixture(scope="module")
def mixed():
    rng = np.random.default_rng(13)
    vocabulary = ["New", "york", "CITY", "the", "été", "a", "b", "Ünder", "x y", "中文", "it's", "c"]
    rows = [(None, None), ("en", ""), ("en", ".;!\n"), ("xx", None), ("", "new york " * 5)]
    for k in range(150):
        weights = rng.dirichlet(np.ones(len(vocabulary)))
        text = "".join(str(w) + str(rng.choice([" ", "  ", "\t", ". ", "\n", ", ", " "])) for w in rng.choice(vocabulary, rng.integers(1, 60), p=weights))
        rows.append((["en", "fr", None, ""][k % 4], text))
    return rows + [("en", "one two three " * 4000)] + [("fr", "copy of a copy")] * 30


def test_all_against_plain(spark, mixed):
    want = plain(mixed, 10, 2000)
    assert got(spark, mixed) == want and len(want) >= 20


def test_cut_of_the_first_and_blocks(spark, mixed, monkeypatch):
    """Ties at the cut, many blocks, runs that end in the middle of a text."""
    monkeypatch.setattr(collocations, "BLOCK", 500)
    monkeypatch.setattr(collocations, "RUN", 700)
    assert got(spark, mixed, least=3, top=7) == plain(mixed, 3, 7)


def test_empty(spark):
    assert got(spark, []) == {} and got(spark, [("en", None), (None, "")]) == {}


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64))
    hashed = collocations.PerfectHash(keys)
    assert sorted(hashed(keys).tolist()) == list(range(len(keys)))
    others = hashed(keys + np.uint64(1))
    assert others.min() >= -1 and others.max() < len(keys)
    assert len(collocations.PerfectHash(keys[:0])(keys)) == len(keys)


def test_block_counts_verify_keys():
    rng = np.random.default_rng(2)
    shares = [(rng.integers(0, 12, (n, 2)).astype(np.uint64), rng.integers(1, 5, n).astype("<u4")) for n in (400, 1, 90, 7)]
    want = collections.Counter()
    for keys, counts in shares:
        for k, c in zip(map(tuple, keys.tolist()), counts.tolist()):
            want[k] += c
    keys, sums = collocations.count_block(shares, 9)
    assert dict(zip(map(tuple, keys.tolist()), sums.tolist())) == {k: c for k, c in want.items() if c >= 9}


def test_scores_pass_64_bits(spark):
    """Counts of a corpus far larger than a test's."""
    big = 3 * 10**11
    found = spark.createDataFrame([("en", "a", 1, big + 7), ("en", "b", 2, big + 9)], "lang string, word string, h long, c long")
    two = spark.createDataFrame([(1, 2, big)], "h1 long, h2 long, a long")
    three = spark.createDataFrame([], "h1 long, h2 long, h3 long, a long")
    assert collocations.scored(two, three, found).first().score == 1000000 * big * big // ((big + 7) * (big + 9))
