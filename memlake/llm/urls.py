"""URL filter by association rules (native).

Labelled URLs become transactions of tokens (host labels and suffixes, path
segments with digits made alike, file endings) with one label token; FP-growth
mines the frequent combinations and their rules. Rules that imply a label survive
if their confidence and support suffice and no shorter rule inside them is as
sure. An inverted index (token -> rules) matches them to URLs: a rule fires when
all its tokens have been met; the surest, then longest, then first rule decides.

Scale: URLs are first reduced to distinct token sets with counts; hot hosts
collapse before any join. Tokens of the very same URLs are mined as one. Rules are
bounded by support and confidence alone, whatever their number of tokens; they and
their matches are counted before they are broadcast. Long chains of nested tokens,
each of enough support, still make as many sets as they have subsets.

Defined cases: null URLs, or those without "://", have an empty host and path and
no tokens; no rule fires and they are allowed. With no labels all are allowed. URLs
of any length are read whole, repeated rows judged alike, ties go to the longer rule,
then to the larger rule id. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import ascii_lower, written

MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.75
BROADCAST_RULES = 50_000
#: Listed rules: (rule, verdict), host and path prefix.
LISTED = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def host_path(url: Column) -> tuple[Column, Column]:
    """After the first "://": the host up to "/", "?", "#" or the end, the path from there up to "?", "#" or the end."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host, path = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest listed rule that fits, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: every host label, the registered suffixes, path segments (digits as 0) and the ending."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    names = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    suffix = F.array(F.concat(F.lit("s:"), F.substring_index(host, ".", -1)), F.concat(F.lit("s:"), F.substring_index(host, ".", -2)))
    segments = F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != "")
    segments = F.transform(segments, lambda x: F.concat(F.lit("p:"), x))
    ending = F.regexp_extract(path, r"[^/.]\.([A-Za-z][A-Za-z0-9]{0,9})/?$", 1)
    endings = F.when(ending == "", F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("e:"), ascii_lower(ending))))
    tokens = F.array_distinct(F.concat(names, suffix, segments, endings))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(tokens))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, bad): pages whose document number, the last number of the path, has a label; bad is low quality or toxic."""
    number = F.regexp_extract(F.regexp_extract(F.col("url"), r"^[^?#]*", 0), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    p = pages.select("url", number.try_cast("long").alias("doc_id"))
    known = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return p.join(known, "doc_id").select("url", "bad")


def mined_rules(examples: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support) from (url, bad)."""
    host, path = host_path(F.col("url"))
    t = examples.select(url_tokens(host, path).alias("tokens"), F.when(F.col("bad") == 1, "label:block").otherwise("label:allow").alias("label")).where("size(tokens) > 0")
    t = t.select(F.concat("tokens", F.array("label")).alias("items"))
    # rare tokens cannot be in a frequent set: without them transactions are short and alike
    n = t.count()
    frequent = t.select(F.explode("items").alias("item")).groupBy("item").count().where(F.col("count") >= max(2, min_support * n)).select(F.col("item").alias("i"))
    numbered = t.withColumn("k", F.monotonically_increasing_id())
    each = written(numbered.select("k", F.explode("items").alias("i")).join(frequent, "i", "left_semi"), "items")
    # of tokens that stand in the very same URLs the first is mined for all: else each of their subsets would be a set of its own
    alike = each.groupBy("i").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("k")).alias("x"), F.sum(F.xxhash64("k", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    alike = written(alike.groupBy("c", "x", "y", F.col("i").startswith("label:").alias("is_label")).agg(F.array_sort(F.collect_list("i")).alias("same")).select("same", F.col("same")[0].alias("i")), "alike")
    short = each.join(alike.select("i"), "i", "left_semi").groupBy("k").agg(F.collect_list("i").alias("items"))
    short = written(short.select("items"), "transactions")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, 2 / max(n, 1))), minConfidence=min_confidence, numPartitions=max(8, n // 50_000)).fit(short)
    rules = model.associationRules.where("consequent[0] like 'label:%' and not exists(antecedent, x -> x like 'label:%')")
    rules = rules.select(F.xxhash64("antecedent", "consequent").alias("r"), "antecedent", F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"), "confidence", "support")
    # each token of a rule stands for all that are alike with it: a rule for each choice
    choices = rules.select("r", F.explode("antecedent").alias("i")).join(alike, "i").groupBy("r").agg(F.collect_list("same").alias("same"))
    product = "aggregate(same, array(cast(array() as array<string>)), (acc, c) -> flatten(transform(acc, x -> transform(c, y -> array_append(x, y)))))"
    rules = rules.join(choices, "r").select(F.explode(F.expr(product)).alias("tokens"), "verdict", "confidence", "support").withColumn("tokens", F.array_sort("tokens"))
    rules = written(rules.withColumn("rule_id", F.xxhash64("tokens", "verdict")), "rules")
    # pruned: a rule inside which a shorter one of the same verdict is as sure
    # a shorter rule is looked for at its rarest token only
    each = rules.select("rule_id", F.explode("tokens").alias("token"))
    rarest = each.join(each.groupBy("token").agg(F.count("*").alias("c")), "token").groupBy("rule_id").agg(F.min_by("token", F.struct("c", "token")).alias("token"))
    shorter = rules.join(rarest, "rule_id").select("token", F.col("tokens").alias("less"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    worse = rules.select("rule_id", "tokens", "verdict", "confidence", F.explode("tokens").alias("token")).join(shorter, "token")
    worse = worse.where("verdict = v and size(less) < size(tokens) and c >= confidence and size(array_except(less, tokens)) = 0").select("rule_id").distinct()
    return rules.join(worse, "rule_id", "left_anti")


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, mined verdict, rule tokens) for distinct token sets ``urls`` (tokens), by inverted index."""
    index = rules.select("rule_id", F.size("tokens").alias("need"), "verdict", "confidence", F.col("tokens").alias("fired"), F.explode("tokens").alias("token"))
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    met = urls.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
    met = met.groupBy("tokens", "rule_id").agg(F.count("*").alias("met"), F.first("need").alias("need"), F.first("verdict").alias("verdict"), F.first("confidence").alias("confidence"), F.first("fired").alias("fired")).where("met = need")
    best = F.struct("confidence", F.size("fired").alias("n"), F.col("rule_id").alias("r"), "verdict", "fired")
    return met.groupBy("tokens").agg(F.max(best).alias("best")).select("tokens", F.col("best.verdict").alias("mined"), F.col("best.fired").alias("fired"), F.col("best.confidence").alias("confidence"))


def url_verdicts(pages: DataFrame, labels: DataFrame, listed: list[tuple[str, str]] = LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rules = written(mined_rules(labelled(pages, labels)), "pruned")
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), listed)
    rows = rows.withColumn("tokens", url_tokens(F.col("host"), F.col("path"))).withColumn("rule", rule).withColumn("listed", verdict)
    best = written(judged(rows.select("tokens").where("size(tokens) > 0").distinct(), rules), "best")
    if best.count() <= BROADCAST_RULES:
        best = F.broadcast(best)
    out = rows.join(best, "tokens", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit("allow")).alias("verdict"), F.array_join("fired", " ").alias("mined_rule"), "confidence")
