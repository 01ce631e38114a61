"""Quality rules: line-first cleaning.

Each line is judged alone: punctuation (short lines that end no sentence, lines
that are mostly symbols), navigation (menus, separators), boilerplate (phrases of
notices and forms, lines met before in the text). Failing lines are removed; a
document whose remaining words are too few of its words is rejected, as is one
that fails the base rules (too short, or made of repeated 3-word windows).

Defined cases: null or empty text has no words and is rejected. Long texts are
judged whole; work is linear in the text. Repeated rows are judged alike. Extra
columns are ignored; ``kept`` passes them through, whatever their names. A text that is
not rejected goes on without its failing lines; blank lines stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import SPACED, arrow_batch, blocks, few_rows, mix, thrifty, word_hashes, word_spans

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Of its words, a kept document loses at most this share with its failing lines.
MAX_LOST = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SYMBOL = re.compile(rb"[#*$%&|<>{}\[\]\\^~=_+/]")
_SENTENCE = re.compile(rb"[.!?;:]|\xe2\x80\xa6|\xe3\x80\x82|\xef\xbc[\x81\x9f]")
_SEPARATOR = re.compile("[|]|»|›|•|·| [>/] ".encode())
_MENU = re.compile(rb"^\W*(home|menu|login|log in|sign in|sign up|register|search|contact( us)?|about( us)?|next|previous|back|top|share|tweet|print|read more|click here|skip to content|subscribe)\W*$", re.I)
_NOTICE = re.compile(rb"all rights reserved|cookie (policy|notice|settings)|uses cookies|privacy policy|terms of (use|service)|enable javascript|lorem ipsum|subscribe to our|sign up for our|powered by|licen[cs]ed under|copyright \W*\d{4}", re.I)


def line_fails(line: bytes, n_words: int) -> str:
    """The rule that a line with words fails, or nothing."""
    marks = len(_SYMBOL.findall(line))
    if marks > 0.1 * len(line) and marks > 2:
        return "navigation" if line.count(b"|") * 2 >= marks else "punctuation"
    if n_words < 10 and not _SENTENCE.search(line):
        return "navigation" if _MENU.match(line) else "punctuation"
    if marks and len(_SEPARATOR.findall(line)) > max(2, 0.15 * n_words):
        return "navigation"
    if n_words < 40 and _NOTICE.search(line):
        return "boilerplate"
    return ""


def measured(col: pa.Array, left: list[bytes | None] | None = None):
    """For each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_failed, words_lost.

    ``left`` gets what remains of each text without its failing lines, or None where no line fails.
    """
    for i, j, data, bounds in blocks(col):
        starts, ends, first = word_spans(data, bounds, SPACED)
        h, _ = word_hashes(data, bounds, SPACED, lower=False)
        words = np.diff(first)
        chars = np.concatenate([[0], np.cumsum(SPACED[data] & ((data & 0xC0) != 0x80))])
        symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
        chars, symbols = np.diff(chars[bounds]), np.diff(symbols[bounds])
        repeat = _repeat_words(h, first, words)
        raw = data.tobytes()
        for r in range(j - i):
            seen, dup, failed, lost, good = set(), 0, 0, 0, []
            for line in raw[bounds[r] : bounds[r + 1]].split(b"\n"):
                if n := len(line.split()):
                    again = line in seen
                    dup += again
                    seen.add(line)
                    if again or line_fails(line, n):
                        failed, lost = failed + 1, lost + n
                        continue
                good.append(line)
            if left is not None:
                left.append(b"\n".join(good) if failed else None)
            yield int(words[r]), int(chars[r]), int(symbols[r]), dup, int(repeat[r]), failed, lost


def _repeat_words(h: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in it."""
    n = len(h)
    if n < 3:
        return np.zeros(len(words), np.int64)
    row = np.repeat(np.arange(len(words)), words)
    whole = row[:-2] == row[2:]
    w = mix(mix(h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:] + row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(whole)
    _, back, count = np.unique(w[at], return_inverse=True, return_counts=True)
    at = at[count[back] > 1]
    hit = np.zeros(n, bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return np.diff(np.concatenate([[0], np.cumsum(hit)])[first])


def verdict(m: tuple) -> tuple:
    n_words, _, _, _, repeat, _, lost = m
    base = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n_words
    return base, not base and lost <= MAX_LOST * n_words


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines_failed long, n_words_lost long, base_failed boolean, kept boolean"
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f.split()[0], pa.bool_() if f.endswith("boolean") else pa.int64()) for f in FIELDS.split(", "))])


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id and the figures and verdicts of each row."""

    @thrifty
    def judge(batches):
        for b in few_rows(batches):
            rows = [(*m, *verdict(m)) for m in measured(b.column(1))]
            if rows:
                yield arrow_batch(_SCHEMA, b.column(0), *zip(*rows))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(judge, f"doc_id long, {FIELDS}")


def kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns only: texts without their failing lines, and ``n_chars``, where there is such a column, counted anew."""
    schema = docs.schema
    text, names = docs.columns.index("text"), docs.columns

    @thrifty
    def judge(batches):
        for b in few_rows(batches):
            left: list[bytes | None] = []
            keep = pa.array([verdict(m)[1] for m in measured(b.column(text).cast(pa.string()), left)], pa.bool_())
            cut = pa.array([x is not None for x in left], pa.bool_())
            new = pc.if_else(cut, pa.array([x or b"" for x in left], pa.binary()).cast(pa.string()), b.column(text))
            columns = list(b.columns)
            columns[text] = new.cast(columns[text].type)
            if "n_chars" in names:
                at = names.index("n_chars")
                columns[at] = pc.if_else(cut, pc.utf8_length(new).cast(columns[at].type), columns[at])
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(keep)

    return docs.mapInArrow(judge, schema)
