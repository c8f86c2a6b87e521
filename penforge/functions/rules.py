"""The rule pack and the profiles, as data."""

from __future__ import annotations

from typing import NamedTuple

#: Rule id, category, severity, semantic, patterns, guard at the hit.
RULES = [
    ("C001", "套话/废话填充", "warning", False, ["总而言之", "综上所述", "值得注意的是", "众所周知", "毋庸置疑", "不难发现", "需要注意的是", "换句话说"], "(总而言之|综上所述|值得注意的是|众所周知|毋庸置疑|不难发现|需要注意的是|换句话说)(的|之|地)"),
    ("C002", "套话/废话填充", "warning", True, ["赋能", "抓手", "闭环", "颗粒度", "底层逻辑", "顶层设计", "多维度", "全链路", "保驾护航"], None),
    ("C003", "套话/废话填充", "warning", False, ["由此可见"], "由此可见(一斑|的|之|地|和|与|及)"),
    ("C004", "空泛递进", "suggestion", True, [r"(?:不仅|不只是|不单是|不止是)(?=[^。！？；\n]{1,80}?[，,][ \t]*(?:更是|更|而是|还是|也))"], None),
    ("H001", "模糊词", "warning", False, ["大概", "好像", "似乎", "差不多"], None),
    ("H002", "模糊词", "suggestion", True, ["可能", "或许", "也许", "大约", "一定程度上", "某种程度"], None),
    ("H003", "模糊词", "suggestion", True, ["左右"], "左右(两边|两侧|两翼|左右|边|侧|手|翼|前后|上下)"),
    ("M001", "过程痕迹", "suggestion", True, ["讨论过程", "经过讨论", "经讨论", "讨论后", "讨论中", "讨论结果", "讨论结论", "讨论了", "纠偏说明", "纠偏", "纠正", "修正", "更正", "改为", "改成", "恢复为", "原先", "此前", "先前"], None),
    ("M002", "上下文依赖", "suggestion", True, ["不再", "仍然", "仍旧", "依然", "(?<![优领祖神抢占争率首原])先(?![生进验导端烈贤天决知驱兆例后祖前])", "(?<!不)再(?![现生版造保就审])"], None),
    ("E001", "空洞强调", "suggestion", False, ["非常", "十分", "极其", "超级", "真的", "简直", "绝对", "毫无疑问"], None),
    ("R001", "冗余结构", "suggestion", False, ["进行(?=(分析|讨论|研究|说明|处理|调查|测试|验证))"], None),
    ("R002", "冗余结构", "suggestion", False, ["是否能够"], None),
    ("D001", "重复用词", "warning", False, [r"([一-鿿]{2,8})\1"], None),
]
STRUCTURAL = [("S001", "超长句", "suggestion"), ("A900", "文件结构", "suggestion"), ("DOC001", "文档结构", "warning"), ("DOC002", "文档结构", "candidate")]
#: Disabled rules, severities, longest sentence of each profile.
PROFILES = {
    "general": (["DOC002"], {}, 80),
    "academic": (["H002", "DOC002"], {}, 80),
    "product": ([], {}, 80),
    "formal": (["DOC002"], {"H001": "warning", "E001": "warning"}, 80),
    "instruction": (["DOC002"], {}, 50),
}
RANK = {"error": 3, "warning": 2, "suggestion": 1, "candidate": 0}


def severity(rule_id: str, given: str, semantic: bool, profile: str) -> str:
    """A semantic rule only ever yields candidates, whatever a profile says."""
    return "candidate" if semantic else PROFILES.get(profile, PROFILES["general"])[1].get(rule_id, given)


class Pattern(NamedTuple):
    rule_id: str
    rule_ord: int
    category: str
    severity: str
    pat_ord: int
    pattern: str
    guard: str | None


def rule_patterns(profile: str = "general", only: str | None = None) -> list[Pattern]:
    """The patterns of the enabled rules."""
    off = PROFILES.get(profile, PROFILES["general"])[0]
    return [
        Pattern(rule, i, category, severity(rule, given, semantic, profile), j, pattern, guard)
        for i, (rule, category, given, semantic, patterns, guard) in enumerate(RULES)
        if rule not in off and only in (None, rule)
        for j, pattern in enumerate(patterns)
    ]


#: The message of each rule; {w} is what was found.
MESSAGES = {
    "C001": "套话「{w}」，删掉更直接",
    "C002": "术语滥用「{w}」，换成大白话",
    "C003": "套话「{w}」，删掉更直接",
    "C004": "递进句式「{w}」——核对是否提供了实质新信息",
    "H001": "模糊词「{w}」，表述要精确",
    "H002": "模糊词「{w}」——论文/技术文档中如需保留学术审慎可忽略",
    "H003": "「左右」歧义：时间/数量约数 or 空间方位？",
    "M001": "过程性表述「{w}」——核对成稿是否夹带讨论或纠偏历史",
    "M002": "上下文依赖表述「{w}」——核对顺序、旧状态或比较基线是否完整",
    "E001": "空洞强调「{w}」，删除或换成具体描述",
    "R001": "「{w}」冗余——动词直接说即可（进行+分析 → 分析）",
    "R002": "「是否能够」→「能否」",
    "D001": "「{w}」连续重复",
    "S001": "句子过长（{len}字 > {max}），建议拆分",
    "A900": "SKILL.md 主文件过长（{len} 行 > {max}）——细节应拆到 references/ 子文件，主文件只留触发条件/快速上手",
    "DOC001": "空标题：删除该标题或补齐标题文本",
    "DOC002": "标题编号可能断层：前一为「{prev}」，当前为「{curr}」，请核对是否缺章",
}
#: What to do about a finding, in this engine's own words.
HINTS = {
    "C001": "删去套话后语义不变即可改写；引述除外。", "C002": "有实际所指的行业术语保留，空话改成大白话。", "C003": "前后句不靠它也连贯时删去。",
    "C004": "有实质新信息则保留，只是重复评价则改写。", "H001": "能查证的改成确定表述，查不到的询问作者。", "H002": "风险提示和学术审慎可以保留，事实断言需要核实。",
    "H003": "约数给出精确值，方位保留。", "M001": "终稿只写当前结论；审计和迁移记录可以保留。", "M002": "步骤或比较基线不全时补齐，完整则保留。",
    "E001": "换成具体程度或例证，或者删去。", "R001": "直接使用动词。", "R002": "缩短为能否。", "D001": "多为笔误，去掉一个；专有名词除外。",
    "S001": "在并列、转折或因果处拆句。", "A900": "把细节移到子文件。", "DOC001": "补上标题或删去这一行。", "DOC002": "核对是否缺少一节，不要自动改号。",
}
#: Lines from which A900 speaks.
MOST_LINES = 300
#: The place of each rule among findings of one line and column.
ORDER = {rule: n for n, rule in enumerate(["DOC001", "DOC002", *[r[0] for r in RULES], "S001", "A900"])}


def by_id(rule_id: str) -> dict | None:
    """What is known of a rule, or None."""
    for rule, category, given, semantic, patterns, guard in RULES:
        if rule == rule_id:
            return {"id": rule, "category": category, "severity": given, "semantic": semantic, "patterns": patterns, "guard": guard, "message": MESSAGES[rule], "review_hint": HINTS[rule]}
    for rule, category, given in STRUCTURAL:
        if rule == rule_id:
            return {"id": rule, "category": category, "severity": given, "semantic": False, "patterns": [], "guard": None, "message": MESSAGES[rule], "review_hint": HINTS[rule]}
    return None


def longest(profile: str) -> int:
    return PROFILES.get(profile, PROFILES["general"])[2]


RULE_KIND = "rule_id string, seq int, category string, severity string, semantic boolean, patterns array<string>, guard string, message string, review_hint string"
PROFILE_KIND = "profile string, disabled array<string>, severities map<string,string>, longest int"
#: Rules of a table that are put into a plan at most.
MOST_RULES = 10_000


def _rows() -> list[tuple]:
    return [(r, ORDER[r], *(by_id(r)[k] for k in ("category", "severity", "semantic", "patterns", "guard", "message", "review_hint"))) for r in ORDER]


def rule_frame(spark):
    """The rules as a table; a user's rules are rows of the same kind, united with it. seq is a rule's place among
    findings of one line and column; rules without one come last."""
    return spark.createDataFrame(_rows(), RULE_KIND)


def profile_frame(spark):
    """The profiles as a table: disabled rules, severities that differ, the longest sentence."""
    return spark.createDataFrame([(p, off, changed, most) for p, (off, changed, most) in PROFILES.items()], PROFILE_KIND)


class Active(NamedTuple):
    """An enabled rule under a profile."""

    rule_id: str
    seq: int
    category: str
    severity: str
    patterns: list[str]
    guard: str | None
    message: str
    review_hint: str


def enabled(rules, profiles, profile: str):
    """Of a table of rules those that a profile of a table of profiles doesn't disable, with their severities under it;
    an unknown profile counts as general."""
    from pyspark.sql import functions as F

    mine = profiles.where(F.col("profile").isin(profile, "general")).orderBy(F.col("profile") != profile).limit(1)
    off = mine.select(F.explode("disabled").alias("rule_id")).distinct()
    changed = mine.select(F.explode("severities").alias("rule_id", "changed"))
    rows = rules.join(off, "rule_id", "left_anti").join(changed, "rule_id", "left")
    return rows.withColumn("severity", F.when(F.col("semantic"), "candidate").otherwise(F.coalesce("changed", "severity"))).drop("changed")


def active(profile: str = "general", rules=None, profiles=None) -> tuple[list[Active], int]:
    """(enabled rules in their order, the longest sentence). Tables of rules and profiles are optional; they are
    configuration, so they are read into the plan, at most MOST_RULES rows."""
    if rules is None and profiles is None:
        off, _, most = PROFILES.get(profile, PROFILES["general"])
        kept = [r for r in _rows() if r[0] not in off]
        return [Active(r[0], r[1], r[2], severity(r[0], r[3], r[4], profile), *r[5:]) for r in kept], most
    spark = (rules if rules is not None else profiles).sparkSession
    rules, profiles = rules if rules is not None else rule_frame(spark), profiles if profiles is not None else profile_frame(spark)
    rows = enabled(rules, profiles, profile).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if len({r.rule_id for r in rows}) < len(rows):
        raise ValueError("rule_id isn't unique")
    rows.sort(key=lambda r: (r.seq is None, r.seq or 0, r.rule_id))
    found = [Active(r.rule_id, n if r.seq is None else r.seq, r.category, r.severity, r.patterns or [], r.guard, r.message, r.review_hint or "") for n, r in enumerate(rows, 1000)]
    mine = {r.profile: r.longest for r in profiles.where(profiles["profile"].isin(profile, "general")).collect()}
    return found, mine.get(profile, mine.get("general", 80))
