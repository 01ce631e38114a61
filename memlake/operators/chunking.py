"""Documents to chunks: a sequential fold over one document, parallel over documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.functions import text as texts
from memlake.operators.code import dense_estimate

_HAN = re.compile(r"[一-鿿]")
_END = re.compile(r"[。！？.!?]+\s*|\n\s*\n")
_SENTENCE = re.compile(r"[^。！？]+[。！？]")
_FENCE = re.compile(r"```.*?```", re.S)


def estimate(text: str) -> int:
    return len(_HAN.findall(text)) + len(re.findall(r"[a-zA-Z]+", text)) + len(re.findall(r"\d+", text)) + len(re.findall(r"[^\w\s]", text)) // 2


def _kinds(codes: np.ndarray) -> np.ndarray:
    """Of code points: 1 Han, 2 Latin letter, 3 digit, 4 neither a word character nor white space, 0 anything else."""
    known, at = np.unique(codes, return_inverse=True)
    kind = [1 if 0x4E00 <= k <= 0x9FFF else 2 if k < 128 and c.isalpha() else 3 if c.isdecimal() else 0 if c.isalnum() or c == "_" or c.isspace() else 4 for k, c in ((k, chr(k)) for k in known.tolist())]
    return np.asarray(kind, np.int8)[at]


def prefix_estimates(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Running counts over a text: of what counts whole (Han characters, beginnings of runs of letters and of digits), and of what counts half. What a piece has that begins after a break is a difference of two."""
    kind = _kinds(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))
    before = np.concatenate([[0], kind[:-1]])
    whole = (kind == 1) | (((kind == 2) | (kind == 3)) & (kind != before))
    return np.concatenate([[0], np.cumsum(whole)]), np.concatenate([[0], np.cumsum(kind == 4)])


def segments(text: str) -> list[tuple[int, int]]:
    """First and end character of the pieces between ends of fenced code and, outside it, of paragraphs and sentences; blank pieces are left out."""
    ends, at = [], 0
    for fence in [*(m.span() for m in _FENCE.finditer(text)), (len(text), len(text))]:
        ends += [m.end() for m in _END.finditer(text, at, fence[0])] + [fence[1]]
        at = fence[1]
    return [(a, b) for a, b in zip([0, *ends], ends) if text[a:b].strip()]


def packed(text: str, most: int = 800, least: int = 50, overlap: int = 50) -> list[tuple[str, int]]:
    """(content, tokens): runs of segments of ``most`` tokens, cut where the running count passes it; a tail under ``least`` joins the run before. Each run but the first begins with the last sentences of the run before, up to ``overlap`` tokens."""
    if not text.strip():
        return []
    whole, half = prefix_estimates(text)
    if (n := int(whole[-1] + half[-1] // 2)) <= most:
        return [(text.strip(), n)]
    spans = segments(text)
    a, b = np.asarray(spans).T
    total = np.concatenate([[0], np.cumsum(whole[b] - whole[a] + (half[b] - half[a]) // 2)])
    cuts = [0]
    while cuts[-1] < len(spans):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, total[cuts[-1]] + most, "right")) - 1))
    runs = [("".join(text[x:y].strip() for x, y in spans[i:j]), int(total[j] - total[i])) for i, j in zip(cuts, cuts[1:])]
    if runs and runs[-1][1] < least:
        tail, n = runs.pop()
        if runs:
            runs[-1] = (f"{runs[-1][0]}\n{tail}", runs[-1][1] + n)
    out = runs[:1]
    for text_, n in runs[1:]:
        before = last_sentences(out[-1][0], overlap)
        out.append((f"{before}\n{text_}", estimate(f"{before}\n{text_}")) if before else (text_, n))
    return out


def last_sentences(text: str, most: int) -> str:
    """The whole sentences at the end of a text that have ``most`` tokens at most."""
    # up to the last such end: the pattern would look through what follows once from each of its characters
    end = max(map(text.rfind, "。！？")) + 1
    found = _SENTENCE.findall(text[:end]) or [p for x in re.split(r"[.!?]+", text) if (p := x.strip())]
    counts = np.cumsum([estimate(p) for p in found[::-1]])
    keep = int(np.searchsorted(counts, most, "right"))
    return "".join(found[len(found) - keep :]).strip()


def headings(text: str, most: int = 3000, least: int = 300) -> list[str]:
    """Sections by heading; short ones join the one before, long ones split at paragraphs. What stands before the first heading is left out."""
    at = [m.start() for m in re.finditer(r"(?m)^#{1,6} ", text)]
    parts = [text[a:b].strip() for a, b in zip(at, [*at[1:], len(text)])] if at else [text.strip()]
    out: list[str] = []
    for p in filter(None, parts):
        if out and min(len(p), len(out[-1])) < least and len(out[-1]) + len(p) <= most:
            out[-1] += "\n\n" + p
        elif len(p) <= most:
            out.append(p)
        else:
            piece = ""
            for q in p.split("\n\n"):
                if piece and len(piece) + len(q) > most:
                    out.append(piece)
                    piece = ""
                piece = f"{piece}\n\n{q}" if piece else q
            out.append(piece)
    return out


def chunks(docs: DataFrame, kind: str = "text", most: int = 800, least: int = 50) -> DataFrame:
    """doc_id, position, content, token_count, content_hash from (doc_id, text)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            rows = []
            for doc, text in zip(b["doc_id"], b["text"]):
                text = text or ""
                found = packed(text, most, least) if kind == "text" else [(x, estimate(x)) for x in headings(text)]
                rows += [(doc, k, c, n) for k, (c, n) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "content", "token_count"])

    out = docs.select("doc_id", "text").mapInPandas(fold, "doc_id long, position int, content string, token_count int")
    return out.withColumn("content_hash", F.sha2(F.encode("content", "UTF-8"), 256))


def _few(batches: Iterator[pd.DataFrame], most: int = 250) -> Iterator[pd.DataFrame]:
    """Batches in parts of ``most`` rows: a task holds the chunks of one part."""
    for b in batches:
        for lo in range(0, len(b), most):
            yield b.iloc[lo : lo + most]


_SENTENCE_END = re.compile(r"[。！？.!?]\s*")
_PARAGRAPH = re.compile(r"\n\s*\n")


def document_pieces(text: str | None, most: int = 3000, least: int = 200, overlap: int = 5) -> list[tuple[str, str, int, int, int]]:
    """(content, what is new in it, tokens, first character, end character): runs of segments that end with a paragraph or sentence, cut where the running count would pass ``most``.

    A last run under ``least`` tokens joins the run before. Every run but the first
    begins with the last ``overlap`` lines of the run before, what that took over
    included. Offsets are those of a run's own segments.
    """
    if not text or not text.strip():
        return []
    total = dense_estimate(text)
    if total <= most:
        whole = text.strip()
        return [(whole, whole, dense_estimate(whole), 0, len(text))]
    ends = sorted({m.end() for p in (_PARAGRAPH, _SENTENCE_END) for m in p.finditer(text)} | {len(text)})
    parts = [(a, b, p) for a, b in zip([0, *ends], ends) if (p := text[a:b].strip())]
    sums = np.concatenate([[0], np.cumsum([dense_estimate(p) for *_, p in parts])])
    cuts = [0]
    while cuts[-1] < len(parts):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(sums, sums[cuts[-1]] + most, "right")) - 1))
    runs = []
    for i, j in zip(cuts, cuts[1:]):
        body = "".join(p for *_, p in parts[i:j])
        last = j == len(parts)
        if last and runs and sums[j] - sums[i] < least:
            content, new, n, a, b = runs[-1]
            runs[-1] = (f"{content}\n{body}", new, n + int(sums[j] - sums[i]), a, b)
            continue
        end = len(text) if last else parts[j][0]
        runs.append((body, body, dense_estimate(body), end - len(body), end))
    for k in range(1, len(runs) if overlap > 0 else 0):
        before = "\n".join(runs[k - 1][0].split("\n")[-overlap:])
        if before.strip():
            content, new, _, a, b = runs[k]
            runs[k] = (f"{before}\n{content}", new, dense_estimate(f"{before}\n{content}"), a, b)
    return runs


def context_header(title, summary, most_tokens: int = 150):
    """What is put before an embedded chunk: the document's theme and its summary, cut to four times ``most_tokens`` characters where it has more tokens. Empty without both."""
    short = F.when(texts.visible_token_estimate(summary) <= most_tokens, summary).otherwise(F.concat(F.substring(summary, 1, 4 * most_tokens), F.lit("...")))
    line = lambda name, c: F.when(F.length(c) > 0, F.concat(F.lit(name), c))
    return F.concat_ws("\n", line("文档主题: ", title), F.when(F.length(summary) > 0, F.concat(F.lit("文档摘要: "), short)))


def document_chunks(docs: DataFrame, most: int = 3000, least: int = 200, overlap: int = 5) -> DataFrame:
    """doc_id, position, content, embedded_content, token_count, start_offset, end_offset from (doc_id, text, title, summary): chunks with the lines before them, embedded without these lines but under a header."""
    columns = ["content", "new", "token_count", "start_offset", "end_offset"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            rows = [(doc, head, k, *piece) for doc, text, head in zip(b["doc_id"], b["text"], b["header"]) for k, piece in enumerate(document_pieces(text, most, least, overlap))]
            yield pd.DataFrame(rows, columns=["doc_id", "header", "position", *columns])

    out = docs.select("doc_id", F.col("text").cast("string").alias("text"), context_header(F.col("title"), F.col("summary")).alias("header"))
    out = out.mapInPandas(fold, "doc_id long, header string, position int, content string, new string, token_count int, start_offset int, end_offset int")
    embedded = F.when(F.col("header") == "", F.col("new")).otherwise(F.concat("header", F.lit("\n\n"), "new"))
    return out.select("doc_id", "position", "content", embedded.alias("embedded_content"), "token_count", "start_offset", "end_offset")


def sections(text: str | None, most: int) -> list[str]:
    """Paragraphs in runs of ``most`` characters (blank lines between them not counted); a paragraph that is longer stands alone."""
    if text is None or len(text) <= most:
        return [] if text is None else [text]
    out, size = [], most + 1
    for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        if size + len(p) > most:
            out.append([])
            size = 0
        out[-1].append(p)
        size += len(p)
    return ["\n\n".join(run) for run in out]


def document_sections(docs: DataFrame, most: int = 3000) -> DataFrame:
    """doc_id, position, content."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _few(batches):
            rows = [(doc, k, x) for doc, text in zip(b["doc_id"], b["text"]) for k, x in enumerate(sections(text, most))]
            yield pd.DataFrame(rows, columns=["doc_id", "position", "content"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(cut, "doc_id long, position int, content string")


def incremental(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_id, position, action (keep, update, insert, delete) by comparing hashes at each position."""
    a, b = old.select("doc_id", "position", F.col("content_hash").alias("was")), new.select("doc_id", "position", F.col("content_hash").alias("now"))
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "delete").when(F.col("was") == F.col("now"), "keep").otherwise("update")
    return a.join(b, ["doc_id", "position"], "full_outer").select("doc_id", "position", action.alias("action"))


def conversation_chunks(turns: DataFrame, most: int = 3000) -> DataFrame:
    """conv_id, chunk, content from (conv_id, turn, role, text): whole turns in order, a new chunk where the next turn would pass ``most`` characters. A turn that is longer stands alone. Turns are read in order, one conversation after the other; no conversation is gathered."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, size, chunk = None, 0, 0
        for b in batches:
            of = []
            for conv, n in zip(b["conv_id"], b["n"]):
                if conv != key:
                    key, size, chunk = conv, 0, 0
                elif size + n > most:
                    size, chunk = 0, chunk + 1
                size += n
                of.append(chunk)
            yield b.assign(chunk=of)[["conv_id", "turn", "line", "chunk"]]

    line = F.concat(F.lit("["), F.col("role"), F.lit("] "), F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", line.alias("line"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "line").mapInPandas(deal, "conv_id long, turn long, line string, chunk int")
    each = dealt.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    return each.select("conv_id", "chunk", F.array_join("l.line", "\n").alias("content"))
