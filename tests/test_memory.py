"""Rules, chunkers and claims on small rows, Chinese texts among them."""

import pytest
from pyspark.sql import functions as F

from memlake.functions import rules
from memlake.operators import chunking, claims, memory


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, kind", [("You MUST not", "constraint"), ("requires nothing", "fact"), ("required here", "constraint"), ("我们必须这样", "constraint"), ("nevertheless", "constraint"), ("不得不说", "fact")])
def test_claim_kind(spark, text, kind):
    assert one(spark, rules.claim_kind(F.col("t")), t=text) == kind


@pytest.mark.parametrize("text, yes", [(" [SYSTEM] do", True), ("[task] sub-agent", False), ("[" + "x" * 210 + "CONTEXT", False), ("x" * 801, True), ("", False), (None, False)])
def test_sub_agent_query(spark, text, yes):
    assert one(spark, rules.sub_agent_query(F.col("t").cast("string")), t=text) is yes


@pytest.mark.parametrize("text, kind", [("  ", "unknown"), (None, "unknown"), ("plain words", "document"), ("def f():\n    return 1", "code"), ("# A\n- b\n- c", "markdown"), ("user: hi\nassistant: yes", "conversation")])
def test_content_type(spark, text, kind):
    assert one(spark, rules.content_type(F.col("t").cast("string")), t=text) == kind


def test_static_and_contradicting_texts(spark):
    assert [one(spark, rules.is_static(F.col("t")), t=t) for t in ("我喜欢咖啡", "今天喜欢咖啡", "今天下雨", "nothing")] == [True, False, False, False]
    x = one(spark, rules.contradiction(F.col("a"), F.col("b")), a="我现在北京工作", b="我以前上海工作")
    assert (x.contradicts, x.score) == (True, 0.7)
    assert one(spark, rules.contradiction(F.col("a"), F.col("b")), a="same", b="same").contradicts is False


def test_stale_suffix(spark):
    assert one(spark, rules.stale_suffix(F.lit("c"), F.lit("updates"), F.lit(91), chinese=True)) == "c [更新]（记录于 91 天前）"
    assert one(spark, rules.stale_suffix(F.lit("c"), F.lit(None).cast("string"), F.lit(90))) == "c"


def test_conversation_chunks_keep_their_bound(spark):
    rows = [(1, 1, "user", ""), (1, 2, "user", "a" * 2000), (1, 3, "assistant", "b" * 1109), (1, 4, "user", "c" * 4000), (1, 5, "user", "d"), (2, 1, "user", None)]
    got = [(r.conv_id, r.chunk, len(r.content)) for r in chunking.conversation_chunks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "chunk").collect()]
    assert got == [(1, 0, 7 + 1 + 2007), (1, 1, 12 + 1109), (1, 2, 4007), (1, 3, 8), (2, 0, 7)]


def test_packed_overlaps():
    text = " ".join(f"Sentence number {k} has some words in it." for k in range(300))
    out = chunking.packed(text, 100, 20, 20)
    assert len(out) > 5 and all(n <= 100 + 20 + 5 for _, n in out)
    for (a, _), (b, _) in zip(out, out[1:]):
        shared = b.split("\n")[0]
        assert shared and a.replace(".", "").endswith(shared) and chunking.estimate(shared) <= 20
    assert chunking.packed("第一句话。" * 400, 100, 20, 10)[1][0].startswith("第一句话。第一句话。\n")


def test_every_support_counts(spark):
    evidence = spark.createDataFrame([(f"e{k}", "agent_add", "verbatim", f"s{k}", "fact") for k in range(3)], "evidence_id string, source_kind string, extraction_type string, session_id string, claim_kind string")
    state = spark.createDataFrame([("c", 0.5, "active", "s0"), ("n", None, "active", "s9")], "claim_id string, content_confidence double, status string, session_id string")
    judged = spark.createDataFrame([(f"e{k}", j, "SUPPORT", c) for k in range(3) for j, c in enumerate("cn")], "evidence_id string, claim_no int, judgment string, target_claim_id string")
    out = {r.claim_id: r.content_confidence for r in claims.apply_judgements(evidence, state, judged)["claims"].collect()}
    assert out["c"] == 0.6472 and out["n"] == round(1 - (1 - 0.8) * 0.84**2, 4)


def test_bootstrap_interval_holds_the_mean(spark):
    r = memory.bootstrap_interval(spark.range(400).selectExpr("id % 40 as cluster", "cast(id % 7 as double) as difference"), rounds=300).first()
    assert r.low < r["mean"] < r.high
