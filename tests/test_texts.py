"""Code units, document runs and typed entities, against plain versions."""

import re

import pytest

from memlake.operators import chunking, code, extraction

PYTHON = '''"""Top."""
import os, sys
from a.b import c as d


@wrap
async def first(x: int, *rest, y=1) -> "str":
    """Doc."""
    def inner(z):
        import late
        return {"}": z}
    return inner


class Empty:
    value = 1


class Full(Base):
    def one(self): return 1

    async def two(self, q: list[int]) -> None:
        class Nested:
            def deep(self):
                pass
'''


def test_python_by_its_tree():
    found = code.units_of(PYTHON, None, ".py")
    lines = PYTHON.split("\n")
    assert [(k, n) for *_, k, n in found] == [("function", "first"), ("class", "Empty"), ("method", "one"), ("method", "two")]
    # a decorator is not part of its function's lines
    assert found[0][0] == "\n".join(lines[6:12]) and found[0][1].startswith("# Defines: async def first(x: int) -> 'str'\n# Uses: os, sys, c, late\n\nasync def first")
    assert found[1][1].startswith("# Defines: class Empty\n\nclass Empty")
    assert found[3][1].startswith("# Scope: Full\n# Defines: async def two(self, q: list[int]) -> None\n\n    async def two")
    for content, _, tokens, a, b, *_ in found:
        assert PYTHON[a : b - 1] == content and tokens == max(len(re.findall(r"\S", content)) // 4, 1)


SCRIPT = """interface Shape<T> {
  area(): { value: number };
}
type Name =
  string;
const add = async (a, b) => {
  const t = "}"; return `{${a}` + '\\'}' + b; // }
};
class Box extends Shape {
  go() { function inner(x) { return x; } }
}
export async function last(a,
  b) { if (a) {
"""


def test_scripts_by_braces():
    found = code.units_of(SCRIPT, "TypeScript")
    lines = SCRIPT.split("\n")
    got = [(k, n, SCRIPT[:a].count("\n")) for _, _, _, a, _, k, n in found]
    assert got == [("interface", "Shape", 0), ("type", "Name", 3), ("function", "add", 5), ("class", "Box", 8), ("function", "inner", 9), ("function", "last", 11)]
    by = {n: content for content, *_, n in found}
    assert by["Shape"] == "\n".join(lines[:3]) and by["Name"] == "\n".join(lines[3:5]) and by["add"] == "\n".join(lines[5:7])  # a brace in a comment counts
    assert by["Box"] == "\n".join(lines[8:11]) and by["inner"] == lines[9] and by["last"] == "\n".join(lines[11:])  # unclosed: to the end


def test_code_that_has_no_units():
    assert code.units_of(None) == code.units_of("  \n ") == []
    broken = "def f(:\n  pass\n" + "\n".join(f"x{k} = {'y' * 40}" for k in range(50))
    found = code.units_of(broken, "python", most=100)
    assert "\n".join(c for c, *_ in found) == broken and all(t <= 100 for _, _, t, *_ in found) and found[-1][4] == len(broken)
    assert [x[3] for x in found] == [0, *(x[4] for x in found[:-1])]
    # a unit that is too large: runs of its lines, no header
    large = "def big():\n" + "\n".join(f"    a{k} = '{'z' * 60}'" for k in range(30))
    found = code.units_of(large, most=100)
    assert len(found) > 3 and "\n".join(c for c, *_ in found) == large and all(c == e and n == "big" for c, e, *_, n in found)
    assert code.language("import x\nfrom y import z") == "python" and code.language("const a = 1") == "javascript" and code.language("SELECT 1") == "unknown" and code.language("", "PyThon") == "python" and code.language("", None, ".MJS") == "javascript"


def test_headers_are_cut_at_lines():
    u = code.Unit("method", "m", 0, 1, "def m(" + "a" * 150 + ")", "Scope", tuple(f"module{k}" for k in range(9)))
    assert code.header(u) == f"# Scope: Scope\n# Defines: {u.signature}"
    assert code.header(u, 400).endswith("# Uses: module0, module1, module2, module3, module4, ...")


def test_hostile_code_is_fast():
    import time

    began = time.time()
    assert code.units_of("{" * 200_000 + '"' * 99_999, "javascript")
    assert code.units_of("(" * 50_000, "python")
    code.units_of("function f() {" * 2000, "javascript")
    assert time.time() - began < 20


def test_code_chunks_in_spark(spark):
    rows = [(1, PYTHON, None, ".py", "x"), (2, SCRIPT, "typescript", None, "x"), (3, None, None, None, None), (4, "", "", "", "")]
    out = code.code_chunks(spark.createDataFrame(rows, "doc_id long, text string, language string, file_extension string, content string")).collect()
    want = {(d, k, c[0], c[1], c[6]) for d, t, lang, end, _ in rows for k, c in enumerate(code.units_of(t, lang, end))}
    assert {(r.doc_id, r.position, r.content, r.embedded_content, r.name) for r in out} == want and len(out) == len(want)
    assert code.code_chunks(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).first().content == "a\nb"


# ---------------------------------------------------------------- documents
def plain_pieces(text, most, least, overlap):
    """One boundary after the other, with running counts."""
    if not text.strip():
        return []
    if code.dense_estimate(text) <= most:
        return [text.strip()]
    ends = sorted({m.end() for m in re.finditer(r"\n\s*\n", text)} | {m.end() for m in re.finditer(r"[。！？.!?]\s*", text)} | {len(text)})
    chunks, current, size, at = [], [], 0, 0
    for e in ends:
        part = text[at:e].strip()
        at = e
        if part:
            n = code.dense_estimate(part)
            if size + n > most:
                if current:
                    chunks.append("".join(current))
                current, size = [], 0
            current.append(part)
            size += n
    if size >= least or not chunks:
        chunks.append("".join(current))
    else:
        chunks[-1] += "\n" + "".join(current)
    for k in range(1, len(chunks)):
        before = "\n".join(chunks[k - 1].split("\n")[-overlap:]) if overlap else ""
        if before.strip():
            chunks[k] = before + "\n" + chunks[k]
    return chunks


def texts():
    import random

    r = random.Random(3)
    sentence = lambda: " ".join("word" * r.randint(1, 4) for _ in range(r.randint(1, 30))) + r.choice([". ", "! ", ".\n", "\n\n", "。", " ", "?\n \n"])
    out = ["".join(sentence() for _ in range(r.randint(1, 120))) for _ in range(40)]
    return out + ["", " \n ", "中文句子。" * 500, "no end " * 3000, "a.\n\n\n\nb", "x" * 20000 + ". tail."]


@pytest.mark.parametrize("most,least,overlap", [(3000, 200, 5), (100, 30, 2), (60, 0, 0), (40, 39, 5)])
def test_document_pieces(most, least, overlap):
    for text in texts():
        found = chunking.document_pieces(text, most, least, overlap)
        assert [c for c, *_ in found] == plain_pieces(text, most, least, overlap)
        # every visible character is in the new part of one run, or in the tail that joined the last
        if len(found) > 1:
            squeezed = lambda x: "".join(x.split())
            rest = found[-1][0].split(found[-1][1])[-1] if found[-1][0].count(found[-1][1]) == 1 else None
            if rest is not None:
                assert squeezed("".join(n for _, n, *_ in found) + rest) == squeezed(text)
            assert all(0 <= b <= len(text) for *_, b in found)


def test_document_chunks_in_spark(spark):
    rows = [(k, t, f"Title {k}" if k % 2 else None, "s" * (400 * (k % 3))) for k, t in enumerate(texts())] + [(99, None, "t", "s")]
    out = chunking.document_chunks(spark.createDataFrame(rows, "doc_id long, text string, title string, summary string"), 100, 30, 2).collect()
    assert {(r.doc_id, r.position, r.content) for r in out} == {(d, k, c) for d, t, *_ in rows if t for k, c in enumerate(plain_pieces(t, 100, 30, 2))}
    for r in out:
        title, summary = rows[r.doc_id][2], rows[r.doc_id][3]
        head = [f"文档主题: {title}"] if title else []
        if summary:
            head.append("文档摘要: " + (summary if len(summary) // 4 <= 150 else summary[:600] + "..."))
        new = chunking.document_pieces(rows[r.doc_id][1], 100, 30, 2)[r.position][1]
        assert r.embedded_content == ("\n".join(head) + "\n\n" + new if head else new)


# ---------------------------------------------------------------- entities
def plain_entities(text):
    out, at = {}, 0
    for kind, patterns in extraction.PATTERNS.items():
        for p in patterns:
            for m in re.finditer(p, text or ""):
                g = next((x for x in m.groups() if x and x.strip()), m.group(0)).strip()
                if g and g not in out:
                    out[g] = kind
    return out


def test_entities_against_the_patterns(spark):
    import random

    r = random.Random(4)
    pieces = ["在", "住在", "来自", "北京", "市", "工作", "公司", "和", "小王", "一起", "说", "2024年", "3月", "05日", "喜欢", "不喜欢", "，", "。", "苹果", "是", "医生", "担任", "会", "技能", "爱好", "我的", "妻子", " ", "\n", "电话：", "010-12345678", "13812345678", "a.b@c-d.org", "微信号：", "wx_12345", "QQ：", "123456", "硕士学历", "端午节", "　", "大学", "毕业于", "٣点", "x"]
    texts_ = ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(400)] + [None, "", "mail me at x@y.de or 0123-4567890", "我的QQ是12345", "加我微信abcdef"]
    found = extraction.rule_entities(spark.createDataFrame(list(enumerate(texts_)), "doc_id long, text string")).collect()
    got = {}
    for e in found:
        got.setdefault(e.doc_id, {})[e.text] = e.type
    assert got == {k: e for k, t in enumerate(texts_) if (e := plain_entities(t))}


def test_dimensions_and_graph_entities(spark):
    rows = [(1, "person", "a", 0), (1, "occupation", "b", 1), (1, "time", "c", 2), (2, "skill", "d", 3), (2, "contact", "e", 0), (3, "odd", "f", 0)]
    e = spark.createDataFrame(rows, "doc_id long, type string, text string, position int")
    assert {r.doc_id: r.dimension for r in extraction.primary_dimension(e).collect()} == {1: "person", 2: "meta", 3: "meta"}
    assert {(r.text, r.type) for r in extraction.graph_entities(e, ["person", "skill"]).collect()} == {("a", "person"), ("b", "thing"), ("d", "skill"), ("e", "thing"), ("f", "thing")}


# ---------------------------------------------------------------- pieces of texts
def column(spark, values, make, schema="x string"):
    from pyspark.sql import functions as F

    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(make(F.col("x"))).collect()]


def test_sections():
    text = "a" * 10 + "\n\n" + "b" * 25 + "\n \n\n" + "c" * 5 + "\n\n" + "d" * 5
    assert chunking.sections(text, 20) == ["a" * 10, "b" * 25, "c" * 5 + "\n\n" + "d" * 5]
    assert chunking.sections(None, 5) == [] and chunking.sections("", 5) == [""] and chunking.sections("x\n\ny", 50) == ["x\n\ny"] and chunking.sections(" \n\n " * 9, 5) == []


def test_small_functions(spark):
    from pyspark.sql import functions as F

    from memlake.functions import text as t

    assert column(spark, ["short.", "a" * 90 + ". " + "b" * 50, "a" * 70 + ". " + "b" * 50, None], lambda c: t.cut_at_sentence(c, 100)) == ["short.", "a" * 90 + ".", ("a" * 70 + ". " + "b" * 50)[:100], None]
    assert column(spark, ['{"a": 1}', "x ```json\n[1, 2]\n``` y", 'so {"a": {"b": 2}} it is', "```json\nbroken", "no", None, "12"], t.salvaged_json) == ['{"a": 1}', "[1, 2]", '{"a": {"b": 2}}', None, None, None, "12"]
    assert column(spark, ["insufficient credits", "got 429", "Rate_Limit", "other", None], lambda c: t.degraded_reason(c, F.lit("KeyError"))) == ["llm_error: insufficient_credits", "llm_error: rate_limited", "llm_error: rate_limited", "llm_error: KeyError", None]
    assert column(spark, ["2024-01-01|é|x"], lambda c: F.array_join(t.cursor_parts(t.cursor(*(F.split(c, r"\|")[k] for k in range(3)))), "#")) == ["2024-01-01#é#x"]
    assert column(spark, [["abc", "中文字a"], ["abc", ""], [], ["a中bcdefg"]], t.is_chinese, "x array<string>") == [True, False, False, False]
    found = column(spark, ["昨天 本周", "nothing", "上周见"], lambda c: t.time_range(c, F.lit("2024-05-15").cast("timestamp")))
    assert [None if r is None else (str(r.first), str(r.last), r.word) for r in found] == [("2024-05-14", "2024-05-14", "昨天"), None, ("2024-05-06", "2024-05-12", "上周")]
    assert column(spark, ["## Discoveries\n\n\n\n", "## Discoveries\nx\n```\ny\n```", "none", None], t.important_sections) == [None, "【发现/决策】\nx\n\n[代码已省略]", None, None]


def test_written_memories_and_needles(spark, monkeypatch):
    from memlake.operators import memory, relational

    new = spark.createDataFrame([(1, "a", [1.0, 0.0], False), (2, "a", [1.0, 0.1], True), (3, "a", [1.0, 0.5], True), (4, "a", [1.0, 0.5], None), (5, "b", [1.0, 0.0], True), (6, "a", None, True)], "id long, tag string, embedding array<double>, is_capture boolean")
    old = spark.createDataFrame([(10, "a", [1.0, 0.0], 2), (11, "a", [0.0, 1.0], 0)], "id long, tag string, embedding array<double>, merged_count long")
    found = memory.written_dedup(new, old)
    assert {r.id: (r.action, r.other) for r in found.collect()} == {1: ("merged", 10), 2: ("dropped", 10), 3: ("dropped", 10), 4: ("kept", None), 5: ("kept", None), 6: ("kept", None)}
    assert {r.id: r.merged_count for r in memory.merged(old, found).collect()} == {10: 3, 11: 0}
    assert {r.id: r.reason for r in memory.distilled(found).where("dropped").collect()} == {1: "similar_to:10", 2: "similar_to:10", 3: "similar_to:10"}
    texts_ = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None)], "id long, text string")
    needles = spark.createDataFrame([("a", "two"), ("b", "three"), ("c", None), ("d", "two"), ("e", "x" * 50)], "name string, needle string")
    for most in (10**6, 60):
        assert sorted((r.id, r.name) for r in relational.containing(texts_, needles, most).collect()) == [(1, "a"), (1, "b"), (1, "d"), (2, "a"), (2, "d")]


def test_estimates_of_pieces_are_differences():
    import random

    r = random.Random(8)
    letters = list("abZ é_ß09٣½.,!?#`\n\t 　中文。！😀𝟗𠀀") + ["```", ". ", "\n\n", "12.5"]
    for _ in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 80)))
        whole, half = chunking.prefix_estimates(text)
        assert whole[-1] + half[-1] // 2 == chunking.estimate(text)
        for a, b in chunking.segments(text):
            assert whole[b] - whole[a] + (half[b] - half[a]) // 2 == chunking.estimate(text[a:b].strip())
