"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import collections
import functools
import math
import re
import zlib

import numpy as np
import pytest

from memlake.llm import decontamination, extraction, jaccard, language, licenses, packing, resampling, rules, sharding, urls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
BASE = " ".join(f"word{k % 37}x{k % 11}" for k in range(300))
TEXTS = [None, "", "One", "one two", BASE, BASE, BASE + " tail", BASE.replace("word5x5", "other"), "Été À la CC BY 4.0, all rights reserved", "x " * 9000, "a b c d e f g h i j k l", "|" * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash", 1.0) for k, t in enumerate(TEXTS)] + [(4, BASE, "clash", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, size string, score double")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(p, t):
    return p.findall((t or "").translate(LOW))


def test_empty_tables_and_clashing_names(spark, none):
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for out in (resampling.resampled(none, labels), decontamination.contamination(none, bench), licenses.license_scan(none), rules.quality_rules(none), urls.url_verdicts(spark.createDataFrame([], "page_id long, url string"), labels), extraction.extracted(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert out.count() == 0
    odd = spark.createDataFrame([(1, BASE, "x", 2, 3, "y")], "doc_id long, text string, w string, h int, kept int, `__d` string")
    for out in (rules.kept(odd), resampling.kept(odd, labels), jaccard.deduplicated(odd), decontamination.decontaminated(odd, bench)):
        assert out.columns == odd.columns and out.count() <= 1
    assert decontamination.contamination(odd, bench).first().n_words == 300 and sharding.feistel_shards(odd).first().slot == 0


def test_proximity(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdefgh"), 40)) for _ in range(20)] + [None]
    phrases = {1: "A b c", 2: "h h g f", 3: "z a", 4: None}
    got = {(r.doc_id, r.phrase_id): list(r.starts) for r in decontamination.proximity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(phrases.items()), "phrase_id long, text string"), span=6).collect()}
    want = {}
    for d, t in enumerate(texts):
        w = words(ALNUM, t)
        for p, x in phrases.items():
            terms = set(words(ALNUM, x))
            at = [k for k in range(len(w)) if w[k] in terms and terms <= set(w[k : k + 6])]
            if terms and at:
                want[d, p] = at
    assert got == want and want


def test_anchors_in_blocks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, BASE), (2, "one TWO"), (3, "x x x x")], "item_id long, text string")
    want = sorted(map(str, decontamination.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 100)
    assert sorted(map(str, decontamination.contamination(docs, bench).collect())) == want


def test_license_spans_against_plain_search():
    """Longest matches by comparing all places, phrases by looking at every place."""
    rng = np.random.default_rng(6)
    vocabulary = ["a", "b", "c"]
    texts = [rng.integers(0, 3, 14).tolist() for _ in range(4)]
    automaton = licenses.SuffixAutomaton(texts)
    for _ in range(30):
        ids = rng.integers(0, 3, 25).tolist()
        longest = [max((n for n in range(k + 1) for t in texts for j in range(len(t) - n + 1) if t[j : j + n] == ids[k - n : k]), default=0) for k in range(len(ids) + 1)]
        want = [(k, longest[k]) for k in range(1, len(ids) + 1) if longest[k] >= 3 and (k == len(ids) or longest[k + 1] <= longest[k])]
        got = list(automaton.matches(ids, 3))
        assert [(k, n) for k, n, _ in got] == want
        for k, n, state in got:
            ends = {(t, j + n - 1) for t, x in enumerate(texts) for j in range(len(x) - n + 1) if x[j : j + n] == ids[k - n : k]}
            assert {(t, e) for t, at in automaton.at[state].items() for e in at} == ends
    some = "cc by general public license all rights reserved the".split()
    for _ in range(40):
        w = rng.choice(some, 30).tolist()
        places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        n_words, n_base, first, last, base, labels, score, _ = licenses.scanned(" ".join(w).upper().encode())
        assert (n_words, n_base, first, last) == (30, len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert base == ",".join(sorted({x for _, x in places})) and set(base.split(",")) - {""} <= set(labels.split(",")) and 0 <= score <= 1
    mit = licenses.TEMPLATES["mit"][2]
    assert licenses.scanned(f"Some code. {mit.capitalize()}. More".encode())[5:7] == ("mit", 1.0)
    assert 0.4 < licenses.scanned(" ".join(mit.split()[:35]).encode())[6] < 0.9


def test_jaccard(docs, none):
    out = {r.doc_id: r for r in jaccard.jaccard_components(docs).collect()}
    sets = {}
    for k, t in enumerate(TEXTS):
        w = words(SPACED, t)
        sets[k] = {tuple(w)} if 0 < len(w) < 3 else set(zip(w, w[1:], w[2:]))
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert {k: (len(sets[k]), label[k]) for k in sets} == {k: (r.n_shingles, r.component_id) for k, r in out.items()}
    assert jaccard.jaccard_components(none).count() == 0
    assert jaccard.deduplicated(docs).columns == docs.columns


@pytest.mark.parametrize("cell, probes", [(1024, 1 << 13), (5, 4), (1024, 4)])
def test_jaccard_counts_every_link(spark, none, monkeypatch, cell, probes):
    monkeypatch.setattr(jaccard, "_CELL_SETS", cell)
    monkeypatch.setattr(jaccard, "_LIST", 4 * cell)
    monkeypatch.setattr(jaccard, "_PROBES", probes)
    rng = np.random.default_rng(4)
    rows = []
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(120)]
        for _ in range(30 if group == 0 else 3):
            w = list(base)
            for k in rng.integers(0, 120, int(rng.integers(0, 4))):
                w[k] = f"x{rng.integers(1000)}"
            rows.append(" ".join(w))
    rows += [rows[0], rows[0], None, "", "one two", "one two", "lone text of its own"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = []
    for t in rows:
        w = words(SPACED, t)
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < 3 else frozenset(zip(w, w[1:], w[2:])))
    different = set(sets) - {frozenset()}
    want = [sum(b != a and 100 * len(a & b) >= 90 * len(a | b) for b in different) if a else 0 for a in sets]
    assert max(want) > 5
    assert {r.doc_id: r.n_links for r in jaccard.jaccard_components(docs).collect()} == dict(enumerate(want))
    assert jaccard.jaccard_components(none).count() == 0


def plain_components(rows, n, num, den):
    """(links, component) of each (id, text) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(SPACED, t)
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < n else frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)))
    label = list(range(len(rows)))
    linked = [[bool(a and b) and den * len(a & b) >= num * len(a | b) or (i == j) or (rows[i][0] is not None and rows[i][0] == rows[j][0] and bool(a and b)) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    for _ in rows:
        label = [min(label[j] for j in range(len(rows)) if linked[i][j]) for i in range(len(rows))]
    different = set(sets) - {frozenset()}
    links = [sum(b != a and den * len(a & b) >= num * len(a | b) for b in different) if a else 0 for a in sets]
    ids = [[rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None] for i in range(len(rows))]
    return [(rows[i][0], len(sets[i]), min(ids[i], default=None), links[i]) for i in range(len(rows))]


@pytest.mark.parametrize("n, num, den, seed", [(3, 90, 100, 1), (5, 80, 100, 2), (1, 50, 100, 3)])
def test_jaccard_against_all_pairs(spark, monkeypatch, n, num, den, seed):
    """Sizes about the bounds of parity rows, shared passages, copies, rows that share an id, rows without one."""
    monkeypatch.setattr(jaccard, "_LIST", 7)
    monkeypatch.setattr(jaccard, "_CELL_SETS", 6)
    rng = np.random.default_rng(seed)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for group in range(12):
        base = [f"g{group}w{k}" for k in range(int(rng.choice([1, 3, 8, 40, 500, 530, 1040])))] + (passage if group % 3 == 0 else [])
        for _ in range(int(rng.integers(1, 7))):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, max(2, len(w) // 25)))):
                w[k] = f"x{rng.integers(1000)}"
            rows.append((len(rows) * 3 if rng.random() > 0.1 else None, " ".join(w[: len(w) - int(rng.integers(0, max(1, len(w) // 20)))])))
    rows += [(5, rows[0][1]), (5, rows[-1][1]), (5, "a text of its own"), (6, None), (6, ""), (None, None), (0, rows[3][1])]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, node string, n int")
    got = [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(docs, n, num, den).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_components(rows, n, num, den)))


def test_deduplicated_rows_that_share_an_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a"), (1, text, "b"), (1, "another text under this very id", "c"), (1, None, "d"), (1, " ", "e"), (2, text + " end", "f"), (3, "alone with words enough", "g")]
    left = jaccard.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, key string")).collect()
    by_id = [r.key for r in left if r.doc_id == 1 and (r.text or "").strip()]
    assert len(by_id) == 1 and {r.key for r in left} - set(by_id) == {"d", "e", "g"}


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, BASE[:200]), (2, "one TWO"), (3, None), (4, "not there at all in any of these texts you see")], "item_id long, text string")
    out = decontamination.contamination(docs, bench).collect()
    assert len(out) == len(TEXTS) + 1
    win = collections.defaultdict(set)
    for i, t in ((1, BASE[:200]), (2, "one TWO")):
        w = words(ALNUM, t)
        for k in range(max(1, len(w) - 9)):
            win[tuple(w[k : k + 10])].add(str(i))
    for r in out:
        w, hit, items = words(ALNUM, TEXTS[r.doc_id]), set(), set()
        for t, i in win.items():
            for k in range(len(w) - len(t) + 1):
                if tuple(w[k : k + len(t)]) == t:
                    hit |= set(range(k, k + len(t)))
                    items |= i
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(items), bool(hit))


def test_rows_without_id(spark):
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = [(1, text), (None, text), (None, text + " end"), (None, other), (None, other), (None, None), (None, ""), (2, "quite another text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(text.split()[5:17]))], "item_id long, text string")
    out = sorted((r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontamination.contamination(docs, bench).where("doc_id is null").collect())
    assert out == [(0, 0, (), False)] * 2 + [(40, 0, (), False)] * 2 + [(40, 12, ("9",), True), (41, 12, ("9",), True)]
    left = [tuple(r) for r in jaccard.deduplicated(docs).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(1, text), (None, other), (None, None), (None, ""), (2, "quite another text")]))


def test_classifier_rejects_rows_without_id(spark):
    rng = np.random.default_rng(5)
    rows = [(k if k < 500 else None, " ".join(rng.choice([f"g{x}" for x in range(60)], 60)) + (" scum moron scum trash" if k % 4 == 0 else "")) for k in range(600)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(0, 500, 2)], "doc_id long, quality int, toxic int")
    left = resampling.kept(spark.createDataFrame(rows, "doc_id long, text string"), labels).where("doc_id is null").collect()
    assert sum("scum" in r.text for r in left) <= 2 and sum("scum" not in r.text for r in left) >= 70


def test_rules(docs):
    for r in rules.quality_rules(docs).collect():
        t = TEXTS[r.doc_id] or ""
        w = SPACED.findall(t)
        c = collections.Counter(zip(w, w[1:], w[2:]))
        m = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(m))
        assert r.base_failed == (len(w) < 50 or 100 * len(m) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert rules.kept(docs).columns == docs.columns


def test_licenses(docs):
    r = {x.doc_id: x for x in licenses.license_scan(docs).collect()}
    assert (r[8].n_base, r[8].first_word, r[8].last_word, r[8].base_labels) == (2, 3, 7, "cc-by,reserved")
    assert r[0].labels == "" and r[0].first_word is None
    assert licenses.scanned(b"Licensed under the Apache License, Version 2.0.")[5] == "apache-2.0"


def test_extraction(spark):
    page = "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article><h1>A &amp; B</h1><p>First  para<br>graph.<p>Second.</article><div id=comments>Nice!</div><footer>(c)</footer></body></html>"
    out = [r.text for r in extraction.extracted(spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "")], "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert out == ["A & B\n\nFirst para graph.\n\nSecond.", "", ""]


PROSE = " ".join(f"Sentence {k} of the article says something that a reader came for." for k in range(6))
ARTICLE = f"<article><h1>Title of it</h1><p>{PROSE}</p><p>Short end.</p></article>"
PLAIN = f"<div id=content><h1>Title of it</h1><p>{PROSE}</p><p>{PROSE}</p></div>"


@pytest.mark.parametrize("before, after", [("<body class='right-sidebar'>", ""), ("<div class='no-sidebar'>", "</div>"), ("<body class='comments-open'>", ""), ("<form action=x>", "</form>"), ("<div class='right-sidebar'>", "</div>"), ("<div class=widget><div class=sidebar>", "</div></div>")])
def test_extraction_keeps_articles_in_noisy_wrappers(before, after):
    side = "<div class='sidebar'><ul><li>Other pages</li><li>Buy now</li></ul></div><div id=comments><div class=comment><p>Nice!</p></div></div>"
    assert extraction.main_text(f"<html>{before}{ARTICLE}{side}{after}</html>") == f"Title of it\n\n{PROSE}\n\nShort end."
    if "widget" not in before:
        assert extraction.main_text(f"<html>{before}{PLAIN}{side}{after}</html>").count(PROSE) == 2


@pytest.mark.parametrize("tag", ["<svg class='i'/>", "<svg/>", "<svg width=\"1\" data-x='a>b' />", "<select-box>", "<script src='x'/>", "<svg><path d='M0'/></svg>", "<script>if (a > '</p>') b()</script>", "<script src=/x/>code()</script>"])
def test_extraction_swallows_no_more_than_the_element(tag):
    assert extraction.main_text(f"<article><p>{tag}{PROSE}</p></article>") == PROSE


@pytest.mark.parametrize("wrap", ["<div class='overflow-hidden'>{}</div>", "<body class='has-sidebar'>{}", "<div style='overflow:hidden'>{}</div>", "<div data-x=it's>{}</div>"])
def test_extraction_reads_names_as_names(wrap):
    assert extraction.main_text(wrap.format(ARTICLE)) == f"Title of it\n\n{PROSE}\n\nShort end."
    assert extraction.main_text(wrap.format(ARTICLE.replace("<article>", "<article class='post tag-social'>"))) == f"Title of it\n\n{PROSE}\n\nShort end."
    assert extraction.main_text(f"<article><p>{PROSE}</p><p hidden>{PROSE}</p><p style='display: none'>{PROSE}</p></article>").count(PROSE) == 1


@pytest.mark.parametrize("hostile", ['<a "' * 40_000, "<a " * 60_000, "<div>" * 30_000 + "x" + "</b>" * 30_000, "<svg>" * 30_000, '<p a="' * 30_000 + "'" * 9, "<!--" * 40_000, "<b>" * 5_000 + "<p>x" * 5_000])
def test_extraction_is_linear(hostile):
    import time

    began = time.process_time()
    text = extraction.main_text(f"<article><p>{PROSE}</p></article>{hostile}")
    assert text.startswith(PROSE) and time.process_time() - began < 5


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        gain = rng.integers(-9, 10, n).tolist()
        smooth = {(a, b): int(rng.integers(0, 6)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5}
        cost = lambda s: sum(max(0, -g) if x else max(0, g) for g, x in zip(gain, s)) + sum(w for (a, b), w in smooth.items() if s[a] != s[b])
        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(extraction.minimum_cut(gain, smooth)) == best


def test_urls(spark):
    rows = [(1, "https://A.example.com/en/1?x"), (2, "http://www.example.com/en/2"), (3, "http://x.net/es/"), (4, None), (5, "no scheme"), (6, "http://h.org")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(pages, labels).collect()}
    assert out == {1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 3: ("x.net", "/es/", "net/es/", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("h.org", "", None, "allow")}


def test_mined_rules(spark):
    rows = [(f"http://{'spam' if k % 3 == 0 else 'good'}.example.org/en/{k}", int(k % 3 == 0)) for k in range(300)]
    got = urls.mined_rules(spark.createDataFrame(rows, "url string, bad int")).where("verdict = 'block'").collect()
    assert ["h:spam"] in [r.tokens for r in got] and all(r.confidence >= urls.MIN_CONFIDENCE for r in got)


def test_rules_of_many_tokens_and_endings(spark):
    from itertools import combinations

    parts = [("hx", "hy"), ("ax", "ay"), ("bx", "by"), ("cx", "cy")]
    rows = []
    for m in range(16):
        host, a, b, c = (p[m >> k & 1] for k, p in enumerate(parts))
        rows += [(f"http://{host}.example.org/{a}/{b}/{c}/{k}.html", int(m == 0)) for k in range(20)]
    rows += [(f"http://hy.example.org/ay/x{k}.PHP", 1) for k in range(60)]
    got = [r.tokens for r in urls.mined_rules(spark.createDataFrame(rows, "url string, bad int")).where("verdict = 'block'").collect()]
    assert ["h:hx", "p:ax", "p:bx", "p:cx"] in got and ["e:php"] in got
    # exactly what plain counting finds: all sets of tokens of enough support and confidence without a shorter one as sure
    sets = [(set(x), bad) for x, bad in zip((r[0] for r in spark.createDataFrame(rows, "url string, bad int").select(urls.url_tokens(*urls.host_path(urls.F.col("url")))).collect()), (bad for _, bad in rows))]
    known = sorted({x for s, _ in sets for x in s if sum(x in t for t, _ in sets) >= 2})
    sure = {}
    for n in range(1, 5):
        for c in combinations(known, n):
            met = [bad for s, bad in sets if s.issuperset(c)]
            if sum(met) >= 2 and sum(met) / len(met) >= urls.MIN_CONFIDENCE:
                sure[c] = sum(met) / len(met)
    want = {c for c, x in sure.items() if not any(len(d) < len(c) and set(d) < set(c) and y >= x for d, y in sure.items())}
    assert {tuple(x) for x in got if len(x) < 5} == want


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.packed(docs.where("doc_id <> 4")).collect()
    by, seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    for k, t in enumerate(TEXTS):
        if k != 4:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
            at = 0
            for r in sorted(by[k], key=lambda r: r.start):
                assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes()))
                at += r.length
            assert at == len(ids)
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= packing.SIZE
    assert packing.packed(none).count() == 0


def test_cutting_stock_covers():
    demand = np.bincount(np.random.default_rng(1).integers(1, 65, 500), minlength=65)
    found = packing.cutting_stock(demand)
    assert (sum(t * c for t, c in found) == demand).all() and all((c * np.arange(65)).sum() <= 64 for _, c in found)


def test_language(docs):
    out = language.scored(docs).collect()
    counts, total = collections.Counter(), 0
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(4, BASE)]
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            counts.update(words(SPACED, t))
            counts["\n"] += 1
    total = sum(counts.values())
    assert len(out) == len(rows)
    for r in out:
        w = words(SPACED, TEXTS[r.doc_id]) + ["\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0


def plain_tree(grams):
    """log10 probability by recursion over dicts: (context, bits so far) -> [zeros, ones] for contexts of every depth."""
    met = collections.defaultdict(lambda: [0, 0])
    kids = collections.defaultdict(set)
    for g, n in grams.items():
        for bit in range(8):
            pre, one = (1 << bit) | ((g & 255) >> (8 - bit)), (g >> (7 - bit)) & 1
            for d in range(language.DEPTH + 1):
                ctx = ((g >> 8) & ((1 << 8 * d) - 1), d, pre)
                met[ctx][one] += n
                if d:
                    kids[((g >> 8) & ((1 << 8 * (d - 1)) - 1), d - 1, pre)].add(ctx)

    def kt(node):
        a, b = met[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def weighted(node):
        if node[1] == language.DEPTH:
            return kt(node)
        return float(np.logaddexp(kt(node), sum(map(weighted, kids[node])))) - math.log(2)

    def value(g):
        total = 0.0
        for bit in range(8):
            pre, p, rest, last = (1 << bit) | ((g & 255) >> (8 - bit)), 0.0, 1.0, 0.5
            for d in range(language.DEPTH + 1):
                node = ((g >> 8) & ((1 << 8 * d) - 1), d, pre)
                if node not in met:
                    break
                last = (met[node][1] + 0.5) / (sum(met[node]) + 1)
                share = 1.0 if d == language.DEPTH else math.exp(kt(node) - math.log(2) - weighted(node))
                p, rest = p + rest * share * last, rest * (1 - share)
            p += rest * last
            total += math.log10(p if (g >> (7 - bit)) & 1 else 1 - p)
        return total

    return value


def text_grams(t):
    b = bytes(language.DEPTH) + (t or "").translate(LOW).encode() + b"\0"
    return [int.from_bytes(b[k : k + language.DEPTH + 1], "big") for k in range(len(b) - language.DEPTH)]


@pytest.mark.parametrize("slice_size", [1 << 18, 5])
def test_language_scores_are_those_of_a_plain_tree(docs, none, monkeypatch, slice_size):
    monkeypatch.setattr(language, "_SLICE", slice_size)
    monkeypatch.setattr(language, "CHUNK_BYTES", 4000)
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(4, BASE)]
    met = collections.Counter()
    for k, t in rows:
        if zlib.crc32(str(k).encode()) % 7 != 2:
            met.update(text_grams(t))
    value = plain_tree(met)
    got = language.scored(docs).collect()
    assert len(got) == len(rows) and any(r.held_out for r in got)
    for r in got:
        assert math.isclose(r.score, sum(map(value, text_grams(TEXTS[r.doc_id]))), rel_tol=1e-5)
    assert language.scored(none).count() == 0


def test_language_without_training_texts(docs):
    out = language.scored(docs.where("pmod(crc32(encode(cast(doc_id as string), 'UTF-8')), 7) = 2")).collect()
    assert out and all(r.train_tokens == 0 and r.n_known == 0 for r in out)
    for r in out:
        assert math.isclose(r.score, -8 * math.log10(2) * len(text_grams(TEXTS[r.doc_id])), rel_tol=1e-6)


def test_context_tree_sums_to_one():
    data = np.frombuffer(b"abracadabra abracadabra", np.uint8)
    g, n = np.unique(language.byte_grams(data, np.array([0, len(data)])), return_counts=True)
    low, top = language.subtrees(g, n)
    levels = low | language.crown(*(np.concatenate(x) for x in zip(*top)))
    for ctx in (0, int(g[5]) >> 8, 0x7A7A7A7A7A):
        p = 10 ** language.log10_of(levels, np.uint64(ctx << 8) | np.arange(256, dtype=np.uint64))
        assert math.isclose(p.sum(), 1, rel_tol=1e-6)


def test_sharding(docs, none):
    out = sharding.feistel_shards(docs).collect()
    n = len(out)
    assert sorted(r.place for r in out) == list(range(n)) == sorted(r.row_number for r in out)
    for r in out:
        t = (TEXTS[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.shard, r.slot) == (len(t) + 1, zlib.crc32(t), r.place % 8, r.place // 8)
    assert sharding.feistel_shards(none).count() == 0


def test_sharding_of_spread_and_repeated_ids(spark):
    rows = [(0, "a"), (5, "b"), (2**62, "c"), (-(2**63), "d"), (2**63 - 1, "e"), *[(None, f"t{k % 3}") for k in range(50)], *[(7, "same")] * 300]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.feistel_shards(df).collect()
    assert sorted(r.place for r in out) == sorted(r.row_number for r in out) == list(range(len(rows)))
    by_shard = collections.defaultdict(list)
    for r in out:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values()) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert collections.Counter((r.doc_id, r.text_crc32) for r in out) == collections.Counter((d, zlib.crc32(t.encode())) for d, t in rows)
    numbers, n = sharding.row_numbers(df.selectExpr("doc_id", "crc32(encode(text, 'UTF-8')) text_crc32", "2L size"), rows_in_bucket=4, together=16)
    assert n == len(rows) and sorted(r.row_number for r in numbers.collect()) == list(range(n))


def test_resampling(spark):
    rng = np.random.default_rng(5)
    good = [f"g{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(600):
        bad = k % 4 == 0
        rows.append((k, " ".join(rng.choice(good, 60)) + (" scum moron scum trash" if bad else "")))
        if k % 2 == 0:
            labels.append((k, 1, int(bad)))
    rows += [(1000, None), (None, "g1 g2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r for r in resampling.resampled(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert np.mean([out[k].kept == (k % 4 != 0) for k in range(600)]) > 0.95
    assert out[1000].weight == 0


def test_kth_largest(spark):
    df = spark.range(1000).selectExpr("cast(id * id as double) as x")
    assert resampling.kth_largest(df, "x", 10, bins=8, few=4) == 990.0**2


def test_cutting_stock_over_all_classes_beside_the_jvm(spark):
    """As many classes as in production: the driver's algebra has to return while the JVM is up."""
    demand = np.random.default_rng(3).integers(1, 4000, 129)
    demand[0] = 0
    found = packing.cutting_stock(demand)
    assert (sum(t * c for t, c in found) == demand).all()
    assert sum(t for t, _ in found) <= sum(t for t, _ in packing.first_fit_decreasing(demand))
    m = np.random.default_rng(4).normal(size=(60, 60))
    assert np.abs((packing.inverted(m)[:, :, None] * m[None]).sum(axis=1) - np.eye(60)).max() < 1e-8


def test_near_matches_against_plain_search(spark):
    """Windows whose words all stand near their rarest one: reordered, with words between, at the ends, and of short items."""
    rng = np.random.default_rng(21)
    vocabulary = [f"t{k}" for k in range(40)]
    items = {k: " ".join(rng.choice(vocabulary, n)) for k, n in enumerate((14, 10, 3, 1, 12))} | {9: None, 10: "absent words only"}
    texts = [" ".join(rng.choice(vocabulary, 60)) for _ in range(15)] + [None, "", items[0], items[2].upper()]
    for i in (0, 1, 4):
        w = items[i].split()[:10]
        rng.shuffle(w)
        texts.append("x y " + " zz ".join(w[:5]) + " " + " ".join(w[5:]) + " end")
    got = {r.doc_id: r.near_items for r in decontamination.contamination(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    counts = collections.Counter(x for t in texts for x in words(ALNUM, t))
    want = {k: set() for k in range(len(texts))}
    for i, t in items.items():
        w = words(ALNUM, t)
        for part in {tuple(w[k : k + 10]) for k in range(max(len(w) - 9, 1))} if w else ():
            rare = min(set(part), key=lambda x: (counts[x], x))
            for d, text in enumerate(texts):
                v = words(ALNUM, text)
                if any(v[k] == rare and set(part) <= set(v[max(0, k - 10) : k + 11]) for k in range(len(v))):
                    want[d].add(str(i))
    assert got == {d: sorted(x) for d, x in want.items()} and sum(map(len, want.values())) >= 12


def test_places_of_phrases_are_words(spark):
    text = "cc by " * 3 + "x all rights reserved, General  Public-License ccby cc.by"
    r = licenses.license_scan(spark.createDataFrame([(1, text), (2, "cc by " * 60_000)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].n_base, r[0].first_word, r[0].last_word) == (6, 0, 14) and (r[1].n_base, r[1].last_word) == (60_000, 119_998)
