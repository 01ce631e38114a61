"""op9's mixture of the tree and the frequencies of words."""

import math
import random

import numpy as np

from memlake.llm import language, queries


def test_scores_stay_near_the_base_and_are_finite(spark, tmp_path):
    r = random.Random(5)
    new = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(4, 16)))
    texts = [" ".join(r.choice(["the", "Of", new()]) for _ in range(r.randint(0, 30))) for _ in range(60)] + [None, "", " \n", "one two", " one  two \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op9_lm_scoring(spark, str(tmp_path)).collect()
    assert len(out) == len(texts) and any(x.held_out for x in out)
    assert any(x.tree_score < 1.2 * x.base_score for x in out if x.held_out)  # what made the finding
    for x in out:
        assert math.isfinite(x.score) and x.score >= x.base_score - math.log10(2) - 1e-6
        assert (texts[x.doc_id] or "").strip() or x.n_tokens == 1


def test_mixed_by_words():
    texts = [b"", b" ab  c ", b"d", b"  "]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    tree = -np.random.default_rng(3).random(bounds[-1] + 4)
    words, end = {b"ab": -2.0, b"c": -1.0, b"d": -9.0}, -0.7
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = language.word_spans(data, bounds, language.SPACED)
    got = language.mixed(tree, bounds, starts, first, np.array([words[data[a:b].tobytes()] for a, b in zip(starts, ends)]), end)
    even = lambda a, b: math.log10((10**a + 10**b) / 2)
    ab, c = even(tree[1:6].sum(), -2.0), even(tree[6:9].sum(), -1.0 + end)  # " ab  " and "c " with the end
    expected = [even(tree[0], end), ab + c, even(tree[9:11].sum(), -9.0 + end), even(tree[11:14].sum(), end)]
    assert np.allclose(got, expected)
