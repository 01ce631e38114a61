"""Typed entities by rules: patterns over texts, JVM-side.

Each pattern's match gives the first of its groups that isn't blank (or the whole
match), stripped. A text found by several patterns keeps the type of the first.

Defined cases: null and empty texts have no entities. Matches of one pattern don't
overlap. Patterns are Unicode-aware and know one line break only, the line feed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = 0.9

# The types of entities and their patterns, in their order.
PATTERNS = {
    "location": [r"在(.{1,10}?)(工作|居住|生活|上班)", r"住在(.{1,10}?)(，|。|$)", r"来自(.{1,10}?)(，|。|$)", r"(.{1,10}?)(市|省|区|县|镇|村)"],
    "organization": [r"在(.{1,20}?)(公司|集团|企业|机构|学校|大学)", r"(.{1,20}?)(公司|集团|企业)", r"(.{1,30}?)(研究所|研究院)", r"毕业于(.{1,20}?)(大学|学院)", r"(.{2,15})(科技有限公司|信息技术有限公司|网络科技有限公司)", r"(.{2,15})(大学|学院|学校)", r"(.{2,15})(医院|银行|证券|保险)", r"在(.{2,20}?)(工作|任职|就职)"],
    "person": [r"和(.{1,10}?)一起", r"跟(.{1,10}?)见面", r"给(.{1,10}?)打电话", r"(.{1,10}?)说"],
    "time": [r"(\d{4}年\d{1,2}月\d{1,2}日)", r"(\d{1,2}月\d{1,2}日)", r"(昨天|今天|明天|上周|下周|本月|下月)", r"(\d{1,2}点\d{1,2}分)", r"农历(正月初一|正月十五|八月十五|腊月初八|腊月三十)", r"(立春|雨水|惊蛰|春分|清明|谷雨|立夏|小满|芒种|夏至|小暑|大暑|立秋|处暑|白露|秋分|寒露|霜降|立冬|小雪|大雪|冬至|小寒|大寒)", r"(春节|元宵节|清明节|端午节|中秋节|国庆节|元旦|劳动节)"],
    "preference": [r"(不喜欢|不爱)(.{1,20}?)(，|。|$)", r"(喜欢|爱|偏好)(.{1,20}?)(，|。|$)", r"(.{1,10}?)是(素食主义者|肉食主义者)"],
    "contact": [r"(1[3-9]\d{9})", r"([\w.-]+@[\w.-]+\.\w+)", r"微信号[是为叫]?[：:]?\s*([a-zA-Z][a-zA-Z0-9_-]{5,19})", r"微信[是叫]([a-zA-Z][a-zA-Z0-9_-]{5,19})", r"加我微信[：:]?\s*([a-zA-Z][a-zA-Z0-9_-]{5,19})", r"QQ[号]?[：:]?\s*(\d{5,11})", r"加我QQ[：:]?\s*(\d{5,11})", r"我的QQ[是号为]*[：:]?\s*(\d{5,11})", r"电话[：:]?\s*(\d{3,4}[-\s]?\d{7,8})", r"座机[：:]?\s*(\d{3,4}[-\s]?\d{7,8})", r"(0\d{2,3}[-\s]?\d{7,8})"],
    "occupation": [r"(.{1,10})是(.{1,10})(工程师|医生|老师|程序员|产品经理|设计师|经理|总监)", r"担任(.{1,20})", r"职位(是|为)(.{1,20})"],
    "education": [r"(本科|硕士|博士|MBA|大专)学历", r"(本科|硕士|博士|MBA|大专)学位"],
    "skill": [r"(会|精通|擅长)(.{1,20})", r"(.{1,20})技能"],
    "hobby": [r"(爱好|业余)(.{1,20})"],
    "family_relation": [r"我的(.{0,10})(妻子|儿子|女儿|父母|哥哥|姐姐|弟弟|妹妹)"],
}
#: The dimension of each type; a type that isn't here is of ``meta``.
DIMENSION = {"location": "thing_concept", "organization": "thing_concept", "person": "person", "time": "meta", "preference": "attribute_fact", "contact": "meta", "occupation": "person", "education": "attribute_fact", "skill": "attribute_fact", "hobby": "attribute_fact", "family_relation": "person", "activity": "event"}
#: Types that make no entity of a graph.
SKIPPED_TYPES = ["time", "number", "activity"]

_FLAGS = "(?dU)"  # only \n breaks lines; \w, \d and \s of all scripts
_BLANK = r"(?U)^\s+|\s+$"


#: The same matches in linear time: one begins where a run of its characters does, or the match before ended.
_QUICK = {r"([\w.-]+@[\w.-]+\.\w+)": r"(?:\G|(?<![\w.-]))([\w.-]++@[\w.-]+\.\w+)"}


def _groups(pattern: str) -> int:
    return pattern.count("(") - pattern.count("(?")


def needles(pattern: str) -> list[list[str]]:
    """Words that every match holds, one of each list: runs of Han characters that stand outside groups and classes, groups of such runs, and the sign of an address."""
    whole = r"[一-鿿]+(?:\|[一-鿿]+)*"
    groups = [g.split("|") for g in re.findall(rf"\(({whole})\)(?![?*{{])", pattern)]
    rest = re.sub(r"\[[^\]]*\][?*+]?|\([^()]*\)[?*+]?", " ", pattern)
    return groups + [[w] for w in re.findall(r"[一-鿿]+(?![?*{])", rest)] + ([["@"]] if "@" in pattern else [])


def matches(text: Column, pattern: str) -> Column:
    """The text of each match, in order. A text without a pattern's words isn't scanned for it."""
    pattern, must = _QUICK.get(pattern, pattern), needles(pattern)
    all_ = lambda k: F.regexp_extract_all(text, F.lit(_FLAGS + pattern), F.lit(k))
    strip = lambda x: F.regexp_replace(x, _BLANK, "")
    found = F.arrays_zip(*(all_(k).alias(f"g{k}") for k in range(_groups(pattern) + 1)))
    out = F.transform(found, lambda m: F.coalesce(*(F.nullif(strip(m[f"g{k}"]), F.lit("")) for k in [*range(1, _groups(pattern) + 1), 0])))
    holds = F.lit(True)
    for words in must:
        one = F.lit(False)
        for w in words:
            one = one | text.contains(w)
        holds = holds & one
    return F.when(holds, out).otherwise(F.array().cast("array<string>")) if must else out


def candidates(text: Column) -> Column:
    """All matches as an array of (type, text), by the order of the patterns. Texts without Han characters are looked through for the patterns that need none."""
    typed = lambda kind, p: F.transform(matches(text, p), lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text")))
    each = [(kind, p, any("一" <= c <= "鿿" for c in p.replace("[号]?", "").replace("[是号为]*", ""))) for kind, ps in PATTERNS.items() for p in ps]
    plain = F.concat(*(typed(kind, p) for kind, p, han in each if not han))
    return F.when(text.rlike(r"[\x{4E00}-\x{9FFF}]"), F.concat(*(typed(kind, p) for kind, p, _ in each))).otherwise(plain)


def rule_entities(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, type, text, position (0: first found), confidence of each entity of a text."""
    # outer: of an array that must not be empty, Spark would compute all of it once more for a filter
    found = docs.select(id_column, F.posexplode_outer(candidates(F.col("text"))).alias("at", "e")).select(id_column, "at", "e.type", "e.text").where("text is not null")
    # the same text may be found by many patterns: the first one names its type
    first = found.groupBy(id_column, "text").agg(F.min(F.struct("at", "type")).alias("f"), F.count("*").alias("n_found"))
    return first.select(id_column, F.col("f.type").alias("type"), "text", F.col("f.at").alias("position"), F.lit(CONFIDENCE).alias("confidence"), "n_found")


def dimension(kind: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in DIMENSION.items() for x in pair))[kind], F.lit("meta"))


def primary_dimension(entities: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The dimension that most types of a text's entities have; of equal ones, that of the type found first."""
    types = entities.groupBy(id_column, "type").agg(F.min("position").alias("first"))
    g = types.groupBy(id_column, dimension(F.col("type")).alias("dimension")).agg(F.count("*").alias("n"), F.min("first").alias("first"))
    return g.groupBy(id_column).agg(F.max_by("dimension", F.struct("n", -F.col("first"))).alias("dimension"))


def graph_entities(entities: DataFrame, known: list[str]) -> DataFrame:
    """Entities that may enter a graph: no skipped types; a type that isn't known is ``thing``."""
    return entities.where(~F.col("type").isin(SKIPPED_TYPES)).withColumn("type", F.when(F.col("type").isin(known), F.col("type")).otherwise("thing"))
