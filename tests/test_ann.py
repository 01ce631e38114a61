"""Searches in blocks and through the index, against all pairs in numpy."""

import numpy as np
import pytest

from memlake.operators import ann


@pytest.fixture(scope="module")
def rows():
    """Clusters with copies (a third of all rows is one vector), plus odd rows."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    v = np.concatenate([centres[rng.integers(0, 12, 400)] + 0.3 * rng.normal(size=(400, 8)), np.tile(centres[0], (200, 1))])
    out = [(k, x.tolist(), int(k % 3)) for k, x in enumerate(v)]
    return out + [(9000, None, 0), (9001, [0.0] * 8, 1), (9002, [1.0, 2.0], 1), (9003, [], 2)]


def cosine(a, b):
    if len(a) != len(b):
        return 0.0
    n = np.sqrt((np.asarray(a) ** 2).sum()) * np.sqrt((np.asarray(b) ** 2).sum())
    return float(np.dot(a, b) / n) if n else 0.0


def plain(rows, queries, k, least=None, strict=False, by=False, skip_odd=False):
    out = {}
    for q, v, label in queries:
        if v is None:
            continue
        found = []
        for i, w, other in rows:
            if w is None or i == q or (by and label != other) or (skip_odd and i >= 9001):
                continue
            s = cosine(v, w)
            if least is None or (s > least if strict else s >= least):
                found.append((-round(s, 9), i))
        out[q] = [i for _, i in sorted(found)[:k]]
    return {q: x for q, x in out.items() if x}


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.id)
    return out


@pytest.fixture(scope="module")
def tables(spark, rows):
    v = spark.createDataFrame(rows, "id long, vec array<double>, label int").repartition(3)
    q = v.where("id % 50 = 0 or id > 8999").select(v.id.alias("query_id"), v.vec.alias("query_vec"), "label")
    return q, v, [r for r in rows if r[0] % 50 == 0 or r[0] > 8999]


@pytest.mark.parametrize("block", [4096, 37])
def test_exact_search(tables, rows, monkeypatch, block):
    monkeypatch.setattr(ann, "ROWS", block)
    monkeypatch.setattr(ann, "QUERIES", max(5, block // 10))
    q, v, queries = tables
    assert got(ann.exact_top_k(q, v, 7, but_self=True)) == plain(rows, queries, 7)
    assert got(ann.exact_top_k(q, v, 5, 0.5, strict=True, but_self=True, by=["label"])) == plain(rows, queries, 5, 0.5, True, True)


def test_weights_and_order(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0.5, 9), (2, [0.0, 1.0], 1.0, 8), (3, [0.0, 1.0], 1.0, 7)], "id long, vec array<double>, weight double, ord long")
    q = spark.createDataFrame([(5, [1.0, 0.0])], "query_id long, query_vec array<double>")
    found = ann.exact_top_k(q, v, 2).orderBy("rank").collect()
    assert [(r.id, r.score) for r in found] == [(3, 0.5), (2, 0.5)]


@pytest.mark.parametrize("block", [4096, 29])
def test_pairs(tables, rows, monkeypatch, block):
    monkeypatch.setattr(ann, "ROWS", block)
    few = [r for r in rows if r[0] < 150 or r[0] > 8999]
    found = {(r.id, r.other): round(r.similarity, 6) for r in ann.pairs(tables[1].where("id < 150 or id > 8999"), 0.6, ["label"]).collect()}
    assert found == {(a[0], b[0]): round(cosine(a[1], b[1]), 6) for a in few for b in few if a[0] < b[0] and a[2] == b[2] and a[1] is not None and b[1] is not None and cosine(a[1], b[1]) >= 0.6}


def test_index(spark, tables, rows, monkeypatch, tmp_path):
    """All lists give the exact rows; few lists give nine in ten; the hot list has several parts; the index can be opened again."""
    monkeypatch.setattr(ann, "ROWS", 64)
    monkeypatch.setattr(ann, "QUERIES", 6)
    q, v, queries = tables
    index = ann.build(v, str(tmp_path / "index"), lists=10)
    assert max(index.parts) >= 3 and 10 >= len(index.parts) == len(index.centroids) >= 5
    assert index.rows(spark).count() == 600
    usable = [r for r in queries if r[0] < 9000]
    assert got(ann.search(index, q, 7, None, but_self=True)) == plain(rows, usable, 7, skip_odd=True)
    probes = ann.calibrated(index, v, 0.95, 10)
    assert 1 <= probes < len(index.parts)
    again = ann.opened(spark, str(tmp_path / "index"))
    assert again.parts == index.parts and np.allclose(again.centroids, index.centroids)
    found = ann.search(again, q, 10, probes, but_self=True)
    exact = ann.exact_top_k(q.where("query_id < 9000"), v.where("id < 9000"), 10, but_self=True)
    each = ann.recall(found, exact).collect()
    assert len(each) == len(usable) and sum(r.n_found for r in each) >= 0.9 * sum(r.n for r in each)


def test_empty_index(spark):
    v = spark.createDataFrame([], "id long, vec array<float>")
    index = ann.build(v)
    q = spark.createDataFrame([(1, [1.0])], "query_id long, query_vec array<double>")
    assert ann.search(index, q).count() == 0 and ann.calibrated(index, v) == 1 and ann.exact_top_k(q, v).count() == 0
