"""Benchmark decontamination over a distributed positional inverted index (native).

The index holds postings (term, document, position) of training texts. Test
phrases are windows of consecutive item words. Each window is looked up from its
rarest terms (by their counts over all documents): the postings of its anchor
terms are shifted by the term's offset in the window, stored, and intersected by
(window, document, start); what all anchors agree on is compared with the whole
window, carried by the rarest anchor's postings. From the same stored postings come
near matches: places where all words of a window stand within ``REACH`` words of its
rarest one, in any order and with others between. ``proximity`` looks for phrases of
any words within a span.

Scale: of anchor terms those postings are stored that a match can need; texts never leave their scan.
What is broadcast comes from the benchmark, in blocks of some ``BROADCAST_ROWS``
anchors; a larger benchmark takes more scans, each like the first. Intersection is an
aggregation with partial sums, so no list of a term is gathered in one task.

Defined cases: null or empty text: no words, not contaminated. Null items have no
windows. Equal windows of several items are looked up once and reported for all.
Rows that share id and text are alike, rows without id too; empty tables give no
hits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.common import ascii_lower, sent, written

NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
ANCHORS = 3
#: Words to either side of a window's rarest one, for a near match.
REACH = 10
BROADCAST_ROWS = 200_000


def raw_words(text: Column) -> Column:
    """Words as they stand; the first or last may be the empty string if the text begins or ends with none."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), NOT_WORD)


def words_of(text: Column) -> Column:
    """The same, lower-cased (A-Z only). Words are lower-cased, not texts: most words are ASCII, though many texts aren't."""
    return F.transform(raw_words(text), ascii_lower)


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_id, terms, items): the distinct windows of all items and the items that have them."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.filter(words_of(F.col("text")), lambda x: x != "").alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    w = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("terms"))
    w = w.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return w.withColumn("window_id", F.xxhash64("terms"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _first_real(w: str = "w") -> str:
    return f"if({w}[0] = '', 1, 0)"


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, h, pos, term): every word of every text with its position; h tells texts of one id apart."""
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), raw_words(F.col("text")).alias("w"))
    return w.select("doc_id", "h", F.posexplode("w").alias("pos", "term")).withColumn("term", ascii_lower(F.col("term")))


def stored_postings(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS, reach: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written index (doc_id, h, window_id, start, n, rank, fits, same, near): postings of anchor terms, moved to where their window would start; the windows; and how many anchors each window needs. ``fits``: the next anchor is in its place; ``near`` (only with ``reach``): all words are in reach of the rarest one."""
    windows = written(item_windows(benchmark, window), "windows")
    terms = windows.select("window_id", F.posexplode("terms").alias("off", "term"))
    vocabulary = written(terms.select("term").distinct(), "vocabulary")
    met = tokens(docs).select("term")
    if vocabulary.count() <= BROADCAST_ROWS:
        met = met.join(F.broadcast(vocabulary), "term")
    counts = vocabulary.join(met.groupBy("term").agg(F.count("*").alias("c")), "term", "left")
    counts = written(counts.withColumn("c", F.coalesce("c", F.lit(0))), "counts")
    # the rarest distinct terms of a window, each at its first offset
    once = terms.groupBy("window_id", "term").agg(F.min("off").alias("off")).join(counts, "term")
    once = once.withColumn("rank", F.row_number().over(Window.partitionBy("window_id").orderBy("c", "term"))).where(F.col("rank") <= anchors)
    # a window with a term that no text has cannot occur
    dead = once.where("rank = 1 and c = 0").select("window_id")
    anchor = written(once.join(dead, "window_id", "left_anti").join(windows.select("window_id", "terms"), "window_id").select("term", "window_id", "off", "rank", F.size("terms").alias("n"), F.when(F.col("rank") == 1, F.col("terms")).alias("terms")), "anchors")
    n_anchor = anchor.count()
    # each list knows the next rarer one (the rarest knows the second): a posting without its neighbour is in no intersection and isn't stored
    other = anchor.select("window_id", F.col("rank").alias("other"), F.col("term").alias("mate"), F.col("off").alias("mate_off"))
    pair = (F.col("a.window_id") == F.col("o.window_id")) & (F.col("o.other") == F.when(F.col("rank") == 1, 2).otherwise(F.col("rank") - 1))
    paired = anchor.alias("a").join(other.alias("o"), pair, "left").select("a.*", "mate", (F.col("mate_off") - F.col("off")).alias("shift"))
    need = anchor.groupBy("window_id").agg(F.count("*").alias("need"))
    # anchors in blocks of a size that is broadcast: each block reads the texts where they lie, and no text is shuffled
    n_blocks = max(1, -(-n_anchor // BROADCAST_ROWS))
    if n_blocks > 1:
        paired = written(paired.withColumn("part", F.pmod(F.xxhash64("term", F.lit(1)), F.lit(n_blocks).cast("long"))), "paired")
    found = None
    for k in range(n_blocks):
        part = paired.where(F.col("part") == k).drop("part") if n_blocks > 1 else paired
        now = _placed(docs, part, reach)
        found = now if found is None else found.unionByName(now)
    return written(found, "postings"), windows, _sized(need, n_anchor)


def window_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, start, n, window_id): all places of all windows; and the windows."""
    postings, windows, need = stored_postings(docs, benchmark, window, anchors)
    return _intersected(postings, need), windows


def _intersected(postings: DataFrame, need: DataFrame) -> DataFrame:
    met = postings.where("fits").groupBy("window_id", "doc_id", "h", "start", "n").agg(F.count_distinct("rank").alias("met"), F.bool_or("same").alias("same"))
    met = met.where("same").join(need, "window_id").where("met = need")
    return met.select("doc_id", "h", "start", "n", "window_id")


def _placed(docs: DataFrame, anchors: DataFrame, reach: int | None) -> DataFrame:
    """Postings of anchor terms, moved to where their window would start; the rarest anchor's compares the whole window."""
    # no expression below the texts' own rows may leave generated code: a posting then never carries its text's words along
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    fits = F.col("mate").isNull() | F.coalesce(F.expr("get(w, pos + shift)") == F.col("mate"), F.lit(False))
    postings = w.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "term")).join(F.broadcast(anchors), "term").withColumn("fits", fits)
    if reach is None:
        postings = postings.where("fits").withColumn("near", F.lit(False))
    else:
        first = F.greatest(F.col("pos") - reach, F.lit(0))
        around = F.slice("w", first + 1, F.col("pos") + reach + 1 - first)
        near = F.when(F.col("rank") == 1, F.size(F.array_except("terms", around)) == 0).otherwise(F.lit(False))
        postings = postings.withColumn("near", near).where("fits or near")
    start = F.expr("pos - off")
    text = F.when(F.col("rank") == 1, F.when((start >= 0) & (start + F.col("n") <= F.size("w")), F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n"))))
    return postings.select("doc_id", "h", "window_id", (start - F.expr(_first_real())).alias("start"), "n", (F.lit(1) * F.col("rank")).alias("rank"), "fits", (text == F.col("terms")).alias("same"), "near")


def proximity(docs: DataFrame, phrases: DataFrame, span: int = 20) -> DataFrame:
    """(doc_id, phrase_id, start): spans of so many words that hold all distinct terms of a phrase (phrase_id, text), in any order; one start for each place of the rarest term's first word in reach."""
    p = phrases.select("phrase_id", F.array_distinct(F.filter(words_of(F.col("text")), lambda x: x != "")).alias("terms")).where("size(terms) > 0")
    need = p.select("phrase_id", F.size("terms").alias("need"), F.explode("terms").alias("term"))
    n = need.count()
    found = tokens(docs).join(_sized(need, n), "term")
    # blocks of one span, each posting in its own and the one before: a span lies in two neighbouring blocks
    blocks = found.select("doc_id", "h", "phrase_id", "need", "term", "pos", F.explode(F.array(F.expr(f"pos div {span}"), F.expr(f"pos div {span} - 1"))).alias("block"))
    key = ["doc_id", "h", "phrase_id", "block"]
    inside = Window.partitionBy(*key).orderBy("pos").rangeBetween(0, span - 1)
    seen = blocks.withColumn("met", F.size(F.collect_set("term").over(inside))).where("met = need")
    return seen.groupBy("doc_id", "h", "phrase_id").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted), contaminated, near_items (sorted): one row for each row of docs."""
    postings, windows, need = stored_postings(docs, benchmark, window, reach=REACH)
    hits = written(_intersected(postings, need), "hits")
    covered = hits.select("doc_id", "h", F.explode(F.sequence(F.col("start"), F.expr("start + n - 1"))).alias("p")).distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    items = hits.select("doc_id", "h", "window_id").distinct().join(windows.select("window_id", "items"), "window_id")
    items = items.select("doc_id", "h", F.explode("items").alias("item")).distinct().groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("item")).alias("items"))
    near = postings.where("near").select("doc_id", "h", "window_id").distinct().join(windows.select("window_id", "items"), "window_id")
    near = near.select("doc_id", "h", F.explode("items").alias("item")).distinct().groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("item")).alias("near_items"))
    w = raw_words(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), w.alias("w"))
    rows = rows.select("doc_id", "h", F.expr("cast(size(w) - if(w[0] = '', 1, 0) - if(size(w) > 1 and w[size(w) - 1] = '', 1, 0) as long)").alias("n_words"))
    i = items.withColumnsRenamed({"doc_id": "i_id", "h": "i_h"})
    both = covered.join(i, F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("h") == F.col("i_h"))).drop("i_id", "i_h").withColumnsRenamed({"doc_id": "d", "h": "g"})
    # all that is hit is near too
    both = near.join(both, near.doc_id.eqNullSafe(both.d) & (near.h == both.g), "left").select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "n_hit", "items", "near_items")
    out = rows.join(both, (rows.doc_id.eqNullSafe(both.d)) & (rows.h == both.g), "left")
    return out.select("doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any occurrence of a window, with its own columns only."""
    bad = sent(window_hits(docs, benchmark, window)[0].select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct(), "hit")
    on = docs["doc_id"].cast("long").eqNullSafe(bad["__d"]) & (F.xxhash64(docs["text"]) == bad["__h"])
    return docs.join(bad, on, "left_anti").select(docs.columns)
