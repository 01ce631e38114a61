"""The pipeline on small tables: every stage against a plain version, and what has been planted."""

import re

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("memlake.llm")
import corpus_pipeline  # noqa: E402
from memlake.llm import rules  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n=120):
    return " ".join(("w" + str(x) + ("." if k % 9 == 8 else "")) for k, x in enumerate(rng.integers(0, 5000, n)))


def cleaned(text):
    """Without lines that fail or were there before."""
    out = []
    for line in text.split("\n"):
        if not line.split() or not (line in out or rules.line_fails(line.encode(), len(line.split()))):
            out.append(line)
    return "\n".join(out)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    texts = [prose(rng) for _ in range(60)]
    passage = prose(rng, 40)
    texts[5] = texts[3]
    texts[7] = texts[3].replace(texts[3].split()[50], "changed")
    texts[9] = texts[8] + " " + passage
    texts[11], texts[12], texts[13] = None, "", "too short"
    texts[15] = "Home | About | Contact\n" + texts[15] + "\n\n" + texts[15].split(".")[0] + ".\nsubscribe\n" + texts[15].split(".")[0] + "."
    rows = [(k, t, "en", "src0") for k, t in enumerate(texts)] + [(20, texts[20], "en", "again"), (None, texts[30], "en", "none"), (None, prose(rng), "en", "none")]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None), (3, "not met in any text at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def texts_of(rows, k):
    return next(r[1] for r in rows if r[0] == k)


def test_stages_against_plain_versions(spark, sf_dir):
    folder, rows = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source"]
        if name == "quality rules":
            left = [(r[0], cleaned(r[1]), *r[2:]) for r in left if rules.verdict(next(rules.measured(pa.array([r[1]], pa.string()))))[1]]
        elif name == "n-gram Jaccard join":
            sets = [set(zip(*(r[1].translate(LOW).split()[k:] for k in range(5)))) for r in left]
            kept = []
            for k in sorted(range(len(left)), key=lambda k: (left[k][0] is None, left[k][0] or 0)):
                if not any(100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]) for j in kept):
                    kept.append(k)
            left = [left[k] for k in kept]
        elif name == "benchmark decontamination":
            passage = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
            words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOW))
            p = words(passage)
            windows = {tuple(p[k : k + 10]) for k in range(len(p) - 9)}
            left = [r for r in left if not windows & set(zip(*(words(r[1])[k:] for k in range(10))))]
        assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == sorted((str(r[0]), r[1]) for r in left), name
    ids = {r.doc_id for r in docs.collect()}
    assert next(r.text for r in docs.collect() if r.doc_id == 15) == cleaned(texts_of(rows, 15)) != texts_of(rows, 15)
    assert {3, 8, 20, 30} <= ids and not {5, 7, 9, 11, 12, 13} & ids
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in out} == ids
    for r in out:
        assert 0 <= r.offset and r.offset + r.length <= 2048
