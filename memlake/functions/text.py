"""Text expressions, JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{4E00}-\x{9FFF}]"


def normalized_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def content_hash(c: Column) -> Column:
    return F.sha2(F.encode(c, "UTF-8"), 256)


def idempotency_key(session: Column, message: Column, content: Column) -> Column:
    """Null if session or message is."""
    return F.when(session.isNotNull() & message.isNotNull(), F.substring(F.sha2(F.encode(F.concat_ws("|", session, message, content), "UTF-8"), 256), 1, 32))


def migration_key(memory_id: Column) -> Column:
    return F.substring(F.sha2(F.encode(F.concat(F.lit("migrate:"), memory_id), "UTF-8"), 256), 1, 32)


def han_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HAN))


def token_estimate(c: Column) -> Column:
    """Han characters, Latin words, digit runs, and half of the other symbols."""
    words, digits = F.regexp_count(c, F.lit("[a-zA-Z]+")), F.regexp_count(c, F.lit(r"\d+"))
    symbols = F.regexp_count(c, F.lit(rf"(?U)[^\w\s]"))
    return han_count(c) + words + digits + F.floor(symbols / 2).cast("int")


def dense_token_estimate(c: Column) -> Column:
    """Mostly Han: characters but white space; else a quarter of all, 1 at least; 0 for empty."""
    n = F.length(c)
    return F.when(n == 0, 0).when(han_count(c) / n > 0.3, F.regexp_count(c, F.lit(r"\S"))).otherwise(F.greatest(F.floor(n / 4).cast("int"), F.lit(1)))


def visible_token_estimate(c: Column) -> Column:
    """Mostly Han: visible characters; else a quarter of them, 1 at least."""
    visible = F.regexp_count(c, F.lit(r"(?U)\S"))
    return F.when(han_count(c) / F.greatest(F.length(c), F.lit(1)) > 0.3, visible).otherwise(F.greatest(F.floor(visible / 4).cast("int"), F.lit(1)))


def document_language(c: Column) -> Column:
    visible = F.regexp_count(c, F.lit(r"\S"))
    return F.when((visible > 0) & (han_count(c) / F.greatest(visible, F.lit(1)) > 0.3), "zh").otherwise("en")


def alpha_language(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return F.when(letters == 0, "unknown").when(han_count(c) / F.greatest(letters, F.lit(1)) > 0.3, "chinese").otherwise("english")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def preview(c: Column, n: int = 500, more: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(more))).otherwise(c)


def title_fallback(c: Column) -> Column:
    return preview(F.trim(F.substring_index(F.trim(c), "\n", 1)), 50)


def keywords(c: Column, least: int = 2) -> Column:
    """Split at punctuation and white space; long enough, not a number; first of each."""
    parts = F.split(c, r"[，。！？、；：\s,.;!?]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) >= least) & ~t.rlike(r"^\d+$")))


def word_overlap(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != "")) for c in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def strip_private(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?s)<private>.*?</private>", ""))


def is_html_noise(c: Column) -> Column:
    return c.rlike(r"^\s*<[a-zA-Z/!]")


def clamped(c: Column, n: int = 600, notice: str = "…") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(notice))).otherwise(c)


def cursor(*parts: Column) -> Column:
    """URL-safe base64 of the parts joined by |."""
    return F.translate(F.base64(F.encode(F.concat_ws("|", *(p.cast("string") for p in parts)), "UTF-8")), "+/", "-_")


def html_stripped(c: Column) -> Column:
    """Tags out, fenced code kept: odd parts between fences stay as they are."""
    parts = F.split(c, "```")
    kept = F.transform(parts, lambda p, i: F.when(i % 2 == 1, p).otherwise(F.regexp_replace(p, r"<[^>]+>", "")))
    return F.array_join(kept, "```")


# Sentence ends, words for times with the first and last day they mean, counted from today (week: from its Monday).
SENTENCE_ENDS = "。！？.!?"
TIME_WORDS = {"今天": (0, 0, False), "昨天": (-1, -1, False), "前天": (-2, -2, False), "最近": (-7, 0, False), "本周": (0, 6, True), "上周": (-7, -1, True)}


def cut_at_sentence(c: Column, most: int, share: float = 0.8) -> Column:
    """The first ``most`` characters, or fewer: up to the last sentence end, if that is beyond ``share`` of them."""
    head = F.substring(c, 1, most)
    whole = F.regexp_extract(head, f"(?s)^(.*[{SENTENCE_ENDS}])", 1)
    return F.when(F.length(c) <= most, c).when(F.length(whole) - 1 > most * share, whole).otherwise(head)


def time_range(c: Column, now: Column) -> Column:
    """first, last (dates) and word of the first of TIME_WORDS that a text has; null without one."""
    today = now.cast("date")
    monday = F.date_sub(today, F.weekday(today))
    day = lambda n, week: F.date_add(monday if week else today, n)
    each = [F.when(c.contains(w), F.struct(day(a, week).alias("first"), day(b, week).alias("last"), F.lit(w).alias("word"))) for w, (a, b, week) in TIME_WORDS.items()]
    return F.coalesce(*each)


def salvaged_json(c: Column) -> Column:
    """The JSON text in an answer: all of it, else what its first json fence holds, else from the first to the last brace; null if none of these parses."""
    fence = F.regexp_replace(F.regexp_extract(c, r"(?s)```json(.*?)(?:```|\z)", 1), r"(?U)^\s+|\s+$", "")
    braces = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.when((x != "") & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(valid(c), F.when(c.contains("```json"), valid(fence)), valid(braces))


def important_sections(c: Column) -> Column:
    """Discoveries (code left out) and explicit constraints of a session's summary, under their titles; null if it has neither."""
    found = F.regexp_extract(c, r"(?s)## Discoveries\n(.*?)(?=\n## |\z)", 1)
    found = F.trim(F.regexp_replace(F.regexp_replace(found, r"(?s)```.*?```", "\n[代码已省略]\n"), r"\n{3,}", "\n\n"))
    found = F.regexp_replace(found, r"(?U)^\s+|\s+$", "")
    rules = F.regexp_extract(c, r'(?s)##\s*(?:\d+\.\s*)?Explicit Constraints.*?((?:-\s*"[^"]+"\n?)+)', 1)
    rules = F.regexp_replace(F.regexp_replace(F.regexp_replace(rules, r'-\s*"', "- "), r'"\n?', "\n"), r"(?U)^\s+|\s+$", "")
    out = F.concat_ws("\n\n", F.when(found != "", F.concat(F.lit("【发现/决策】\n"), found)), F.when(rules != "", F.concat(F.lit("【明确约束】\n"), rules)))
    return F.when(out != "", out)


def first_of(c: Column, words: list[str]) -> Column:
    """The first of the words that a text contains, whatever its case."""
    low = F.lower(c)
    return F.coalesce(*(F.when(low.contains(w.lower()), F.lit(w)) for w in words))


def degraded_reason(message: Column, kind: Column) -> Column:
    """Why a model's answer is missing, from its error's message and the kind of error; null without a message."""
    return F.when(message.contains("insufficient credits"), "llm_error: insufficient_credits").when(message.contains("429") | F.lower(message).contains("rate_limit"), "llm_error: rate_limited").when(message.isNotNull(), F.concat(F.lit("llm_error: "), kind))


def cursor_parts(c: Column) -> Column:
    """What ``cursor`` joined."""
    return F.split(F.decode(F.unbase64(F.translate(c, "-_", "+/")), "UTF-8"), r"\|")


def is_chinese(texts: Column) -> Column:
    """Whether any of an array of texts is mostly Han (over 0.3 of its characters)."""
    return F.exists(texts, lambda x: (F.length(x) > 0) & (han_count(x) / F.length(x) > 0.3))
