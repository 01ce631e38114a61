"""Best-two-fit packing against the tokenizer itself and a bin-by-bin version."""

import collections
import zlib

import numpy as np

from memlake.llm import bestfit, packing

ODD = [
    None,
    "",
    "x",
    "it's 'there' don't 90's ('s) ''s",
    "a  b   c \n d\n\ne\tf \t g\r\nh ",
    " lead and trail ",
    "été à la  façon: 3×4÷5, naïve—dash “quotes” éclaiŕ a",
    "nb sp  x  y    z　w  q",
    "tab\x1cfile\x1d gr\x85oup \x7f del\x00nul",
    "日本語 テキスト 中文,混合 text 한국어",
    "<|endoftext|> inside <|endoftext|>",
    "😀 emoji 👍🏽 ok!! ...wow?! #tag $5.00 (a) [b] {c}",
    "word " * 3000,
]


def plain(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bin by bin, over a sorted list."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        taken, room = [], capacity
        for k, c in enumerate(left):
            if c <= room:
                taken.append(k)
                room -= c
        own = [left[k] for k in taken]
        rest = [c for k, c in enumerate(left) if k not in set(taken)]
        if room and len(own) > 1:
            small = own[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(rest) for b in rest[i + 1 :] if small < a + b <= small + room]
            if pairs:
                _, a, b = max(pairs)
                rest.remove(a)
                rest.remove(b)
                rest.append(small)
                own = own[:-1] + [a, b]
        out.append(sorted(own))
        left = sorted(rest, reverse=True)
    return out


def test_patterns_are_those_of_bins_filled_one_by_one():
    rng = np.random.default_rng(12)
    for capacity, n in ((10, 40), (50, 120), (97, 200), (30, 0)):
        for _ in range(6):
            lengths = rng.integers(1, capacity + 1, n).tolist()
            demand = np.bincount(lengths, minlength=capacity + 1) if n else np.zeros(capacity + 1, int)
            found = bestfit.best_two_fit(demand)
            assert (sum((t * c for t, c in found), np.zeros(capacity + 1, int)) == demand).all()
            got = collections.Counter()
            for t, c in found:
                got[tuple(np.repeat(np.arange(capacity + 1), c).tolist())] += t
            assert got == collections.Counter(map(tuple, plain(lengths, capacity)))
            assert sum(got.values()) <= sum(t for t, _ in packing.first_fit_decreasing(demand)) + 1


def test_units_alone_give_the_same_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bestfit.default_tokenizer())
    rng = np.random.default_rng(5)
    letters = list("abZ éß×'’.,(-01 \n\t ́　中\x1c\x85") + ["  ", "'s", " 're", "\r\n"]
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    import pyarrow as pa

    encode = packing.Encoder(bestfit.default_tokenizer(), bestfit.byte_units, False, bestfit.END)
    for text, ids in zip(texts, encode.rows(pa.array(texts, pa.string()))):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids + [bestfit.END], repr(text)


def test_packed_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bestfit.default_tokenizer())
    rows = [(k, t, "clash", 7) for k, t in enumerate(ODD)] + [(None, "no id", "x", 1), (3, ODD[3], "again", 2), (3, ODD[3], "again", 2)]
    out = bestfit.best_fit_packed(spark.createDataFrame(rows, "doc_id long, text string, cls string, rank int")).collect()
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, k, a, b - a, zlib.crc32(ids[a:b])] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert bestfit.best_fit_packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
