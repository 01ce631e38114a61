"""Rule classifiers of names and texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of names that are no entities (with the length bounds 2..20).
NOISE_NAMES = [
    r"^[\d.]+$",
    r"^[\w.]+:\d+",
    r"^v?\d+\.\d+(\.\d+)?",
    r"^\d+端口$",
    r"^(bg_)?[a-f0-9]{6,}$",
    r"^/\w+",
    r"(表|字段|端点|配置|方法|函数|参数)$",
    r"^[a-zA-Z_]+\(\)$",
    r"(bug|错误|问题)$",
    r"^[#*\-\|]+\s*",
    r"\|\s*\d",
    r"(系统|价格|费用|概率|阈值|机制|规则|服务)$",
    r"^技术\d+$",
    r"^(项目|迁移)",
    r"(?i)^migration",
    r"^\d+.*抽$",
    r"^\d+张.*卡牌$",
    r"^(传说|史诗|普通|稀有|特典|神话)卡$",
    r"^(天罡|地煞)星$",
]
#: Markers of transient facts among lasting ones.
TRANSIENT = [r"已吊销", r"已改为", r"已保存", r"已删除", r"已变更", r"已迁移", r"机器主机名", r"hostnamectl", r"关键bug已修复", r"bug\s*已修复"]
#: Markers of how a memory relates to an earlier one.
UPDATE = ["现在", "改", "换成", "不再", "已经", "更新", "原来是", "以前是", "之前在", "刚换"]
EXTEND = ["而且", "另外", "还有", "同时", "顺便", "具体来说", "比如说", "特别是", "另外还有"]
DERIVE = ["所以", "因此", "可以推断", "由此可见", "这说明", "这意味着", "因为", "由于"]
#: Keywords by topic.
TOPICS = {
    "饮食": ["吃", "喝", "食物", "餐", "口味", "喜欢", "不喜欢", "素食", "肉"],
    "工作": ["工作", "公司", "职业", "职位", "项目", "同事", "老板", "上班"],
    "居住": ["住", "城市", "地区", "地址", "搬家", "房子"],
    "爱好": ["喜欢", "爱好", "兴趣", "运动", "游戏", "电影", "音乐", "书"],
    "社交": ["朋友", "家人", "同事", "见面", "聚会", "社交"],
    "健康": ["健康", "运动", "锻炼", "医生", "医院", "生病"],
}


def noise_name(c: Column) -> Column:
    """Whether a name is too short, too long, or of a form that no entity has."""
    n = F.trim(c)
    ascii_path = n.rlike(r"^[a-zA-Z0-9_\-./]+$") & (n.contains("/") | (F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))) > 1) | F.lower(n).rlike(r"\.(py|js|ts|json|md|sql|txt|html|css|yaml|yml)$"))
    hit = ascii_path
    for p in NOISE_NAMES:
        low = p.startswith(("^v?", "^(bg_)"))
        hit = hit | (F.lower(n) if low else n).rlike("(?U)" + p)
    return n.isNull() | (F.length(n) < 2) | (F.length(n) > 20) | hit


def static_kind(c: Column) -> Column:
    return F.when(c.rlike("|".join(TRANSIENT)), "config_record").otherwise("behavior_rule")


def _any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def relation_by_markers(c: Column) -> Column:
    """struct(type, confidence); updates before extends before derives; null if no marker."""
    make = lambda t, x: F.struct(F.lit(t).alias("type"), F.lit(x).alias("confidence"))
    return F.when(_any(c, UPDATE), make("updates", 0.7)).when(_any(c, EXTEND), make("extends", 0.6)).when(_any(c, DERIVE), make("derives", 0.6))


def topics(c: Column) -> Column:
    return F.filter(F.array(*[F.when(_any(c, w), t) for t, w in TOPICS.items()]), lambda x: x.isNotNull())


def topic_similarity(a: Column, b: Column) -> Column:
    return F.when(F.arrays_overlap(topics(a), topics(b)), 0.7).otherwise(0.0)


#: Words of a constraint, and marks in the first 200 characters of a sub-agent's query.
CONSTRAINT = ["必须", "禁止", "不要", "always", "never", "required", "must"]
SUB_AGENT = ["CONTEXT", "analyze-mode", "search-mode", "SYSTEM", "System:"]
#: Words of lasting and of passing facts.
STATIC_WORDS = ["叫", "姓", "职业是", "工作是", "职位是", "喜欢", "不喜欢", "偏好", "过敏", "信仰", "学历是", "毕业", "专业是", "技能是", "擅长"]
DYNAMIC_WORDS = ["今天", "昨天", "明天", "本周", "上周", "下周", "正在", "最近", "目前", "暂时", "现在", "计划", "准备", "打算"]
#: Patterns of a new and of an old statement that contradict each other, and words that add to it.
CONTRADICTIONS = [
    (r"现在(.+?)(工作|住|在)", r"以前(.+?)(工作|住|在)"),
    (r"目前在(.+?)", r"之前在(.+?)"),
    (r"目前是(.+?)", r"之前是(.+?)"),
    (r"(不喜欢|不爱)(.+)", r"(喜欢|爱)\1"),
    (r"(喜欢|爱)(.+)", r"(不喜欢|不爱)\1"),
    (r"现在(.+?)是(.+)", r"(.+?)是(.+)"),
    (r"(\d+)(岁|年|月|天)", r"(\d+)\1"),
]
NOW_WORDS, PAST_WORDS = ["现在", "目前", "最近", "已经"], ["以前", "之前", "过去", "原来"]
CHANGE_WORDS = ["换了", "改了", "变成", "不再", "现在", "已经"]
#: Marks of code (2 points each), and patterns with their points.
CODE_WORDS = ["def ", "class ", "import ", "from ", "export ", "function ", "const ", "let ", "var ", "async ", "await ", "return ", "interface ", "type ", "enum ", "pub fn ", "fn ", "impl ", "package ", "func ", "struct "]
CODE_ONCE = [(r"(?m)^\s*(def |class |function |const |async |import |export )", 5), (r"[:：]\s*->\s*\w", 3), (r"(?m)^\s*@\w+", 3), (r"(?m)^    [a-zA-Z_]", 2)]
MARKDOWN_EACH = [r"(?m)^#{1,6}\s+\S", r"(?m)^\*{3,}$|^-{3,}$|^_{3,}$", r"(?m)^\s*[-*+]\s+\S", r"(?m)^\s*\d+\.\s+\S"]
MARKDOWN_ONCE = [(r"`{3}\w*\n", 3), (r"\[.+?\]\(.+?\)", 2)]
CONVERSATION_EACH = [r"(?mi)^(user|assistant|system|human|ai)[:：]\s*", r"(?mi)^(q|a|question|answer)[:：]\s*", r"(?mi)^>\s*(用户|助手|问题|回答)"]


def claim_kind(c: Column) -> Column:
    return F.when(_any(F.lower(c), CONSTRAINT), "constraint").otherwise("fact")


def sub_agent_query(c: Column) -> Column:
    """Opens with a bracket and names a mode early on, or is long. Null or empty: no."""
    q = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(q) > 800) | (q.startswith("[") & _any(F.substring(q, 1, 200), SUB_AGENT))


def content_type(c: Column) -> Column:
    """code, markdown or conversation by points; the first wins a tie; none: document; blank: unknown."""
    points = lambda hit, n: F.when(hit, n).otherwise(0)
    each = lambda patterns: sum((F.regexp_count(c, F.lit(p)) for p in patterns), F.lit(0))
    once = lambda patterns: sum((points(c.rlike(p), n) for p, n in patterns), F.lit(0))
    braces = F.length(F.replace(c, F.lit("}"), F.lit(""))) - F.length(F.replace(c, F.lit("{"), F.lit("")))
    code = sum((points(c.contains(w), 2) for w in CODE_WORDS), F.lit(0)) + once(CODE_ONCE) + points(c.contains("{") & (F.abs(braces) <= 2), 2)
    markdown, conversation = each(MARKDOWN_EACH) + once(MARKDOWN_ONCE), each(CONVERSATION_EACH) * 3
    best = F.greatest(code, markdown, conversation)
    typed = F.when(best == 0, "document").when(code == best, "code").when(markdown == best, "markdown").otherwise("conversation")
    return F.when(F.coalesce(F.trim(c), F.lit("")).rlike(r"^\s*$"), "unknown").otherwise(typed)


def is_static(c: Column) -> Column:
    """Whether a text has words of lasting facts and none of passing ones."""
    return _any(F.lower(c), STATIC_WORDS) & ~_any(F.lower(c), DYNAMIC_WORDS)


def contradiction(new: Column, old: Column) -> Column:
    """struct(contradicts, score): 0.3 for each pair of patterns with unlike values, 0.2 for now against then, 0.2 for words of change; from 0.5 on they contradict."""
    score = F.lit(0.0)
    for a, b in CONTRADICTIONS:
        x, y = F.regexp_extract(new, a, 1), F.regexp_extract(old, b, 1)
        score = score + F.when((x != "") & (y != "") & (x != y), 0.3).otherwise(0.0)
    score = score + F.when(_any(new, NOW_WORDS) & _any(old, PAST_WORDS), 0.2).otherwise(0.0) + F.when(_any(new, CHANGE_WORDS), 0.2).otherwise(0.0)
    score = F.round(F.least(score, F.lit(1.0)), 4)
    return F.struct((score >= 0.5).alias("contradicts"), score.alias("score"))


def stale_suffix(content: Column, relation: Column, age_days: Column, chinese: bool = False, after: int = 90) -> Column:
    """The content with its relation's label, and how long ago it was recorded if that is long."""
    #: Labels of relations.
    labels = {"updates": "更新", "extends": "补充", "derives": "推断"} if chinese else {"updates": "updated", "extends": "extended", "derives": "derived"}
    label = relation
    for k, v in labels.items():
        label = F.when(relation == k, v).otherwise(label)
    out = F.when(F.coalesce(relation, F.lit("")) == "", content).otherwise(F.concat(content, F.lit(" ["), label, F.lit("]")))
    age = F.greatest(age_days, F.lit(0)).cast("string")
    tail = F.concat(F.lit("（记录于 "), age, F.lit(" 天前）")) if chinese else F.concat(F.lit(" (recorded "), age, F.lit(" days ago)"))
    return F.when(age_days > after, F.concat(out, tail)).otherwise(out)


def relation_kept(source: Column, target: Column, kind: Column, confidence: Column, known: list[str]) -> Column:
    """struct(kind, confidence) of a relation whose fields are all set and that is sure enough (0.3), else null; unknown kinds are related_to."""
    whole = (F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "") & (F.coalesce(kind, F.lit("")) != "")
    return F.when(whole & (confidence >= 0.3), F.struct(F.when(kind.isin(known), kind).otherwise("related_to").alias("kind"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)).alias("confidence")))


# What cleaning up entities looks for, by name: the type that is looked at (or any), patterns of the name (and whether case matters), parts of the name, whole names.
NOISE_FINDERS = [
    ("file_path", None, [r"^[a-zA-Z0-9_\-./]+$"], True, [], []),
    ("numeric", None, [r"^[0-9.]+$"], True, [], []),
    ("table_field", None, [r"(表|字段|端点|配置|方法|函数|参数)$"], True, [], []),
    ("version", None, [r"^v?[0-9]+\.[0-9]+(\.[0-9]+)?", r"[0-9]+\.[0-9]+版本"], True, [], []),
    ("random_id", None, [r"^(bg_)?[a-f0-9]{6,}$"], True, [], []),
    ("bug_problem", None, [r"(bug|错误|问题)$"], False, [], []),
    ("format_invalid", None, [r"^[#*\-\|]+\s*", r"\|\s*\d"], True, [], []),
    ("invalid_person", "person", [r"[#\*\-\|]", r"\|\s*\d", r"^[#\-\*]+\s*", r"^(将\s*\|)"], True, ["游戏", "用户", "文档"], ["史诗", "天罡", "地煞"]),
    ("system_suffix", None, [r"系统$"], True, [], []),
    ("price_cost", None, [r"(价格|费用)$"], True, [], []),
    ("probability_threshold", None, [r"(概率|阈值)$"], True, [], []),
    ("migration", None, [r"^迁移", r"(?i)^migration", r"迁移.*\d"], True, [], []),
    ("technical_number", None, [r"^技术\d+$"], True, [], []),
    ("card_rarity", None, [r"^(传说|史诗|普通|稀有|特典|神话)卡$", r"^(天罡|地煞)星$"], True, [], []),
    ("draw_count", None, [r"^\d+.*抽$", r"^\d+张.*卡牌$"], True, [], []),
    ("invalid_preference", "preference", [], True, ["卡牌", "游戏", "开发", "测试", "整洁"], []),
    ("invalid_event", "event", [], True, ["配置项", "机制", "通过率", "清理", "修复", "测试"], []),
    ("invalid_organization", "organization", [], True, ["agent", "仓库"], ["Kimi"]),
    ("invalid_location", "location", [], True, ["仓库"], ["Google", "Supermemory"]),
]


def noise_reasons(name: Column, kind: Column) -> Column:
    """The names of all finders that hit an entity, besides those that need other entities (``operators.memory.noisy``)."""
    hits = []
    for finder, type_, patterns, case, parts, whole in NOISE_FINDERS:
        hit = F.lit(False)
        for p in patterns:
            hit = hit | name.rlike(p if case else f"(?i){p}")
        for x in parts:
            hit = hit | name.contains(x)
        if whole:
            hit = hit | name.isin(whole)
        if finder == "file_path":
            hit = hit & (name.contains("/") | name.rlike(r"\.[a-z]{2,4}$"))
        hits.append(F.when(hit if type_ is None else (kind == type_) & hit, F.lit(finder)))
    hits.append(F.when((F.length(name) < 2) | (F.length(name) > 20), F.lit("length_invalid")))
    return F.array_compact(F.array(*hits))
