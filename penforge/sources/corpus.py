"""A deterministic Chinese corpus over the integer keys of documents; one SQL text for Spark and DuckDB.

The supplied tables hold no Chinese text. This corpus is synthetic: agreement on it says nothing about linguistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENTENCES = [
    "总而言之，本次改造通过全链路能力赋能发布闭环，效果非常好。", "综上所述的方案没有变化；由此可见一斑。由此可见，路径是通的！", "计划大概于下周发布，可能推迟，也许不会，误差三天左右。",
    "左右两边各留一行，左右手都能操作。", "登录超时原先为 30 秒，经过讨论后改为 20 秒。", "系统仍然支持旧版，不再维护；先灰度再发布，再现问题先生会处理。",
    "团队将进行验证，并确认是否能够按期上线。", "这不仅是升级，更是革新；不仅仅是口号。", "😀可能需要进行分析，　十分必要。", "普通的一句话，没有任何问题。",
]
HEADS = ["# 说明", "## 1. 目标", "## 3. 验收", "### ", "- 列表项，绝对可靠", "> 引用，简直完美", "正文段落，颗粒度要细。"]


def _case(key: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({key}) % {len(values)} {arms} END"


ZH_SQL = f"""
SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN 'SKILL.md' ELSE concat('d', CAST(doc_id AS VARCHAR(20)), '.md') END AS filename,
  concat({_case('doc_id', HEADS)}, chr(10), {_case('doc_id', SENTENCES)}, {_case('doc_id + 3', SENTENCES)}, chr(10), {_case('doc_id + 5', SENTENCES)}, chr(10), chr(10),
         {_case('doc_id + 1', HEADS)}, chr(10), {_case('doc_id + 7', SENTENCES)}) AS text
FROM documents
"""


def zh_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return spark.sql(ZH_SQL.replace("FROM documents", "FROM {documents}"), documents=docs)


# --- a Markdown corpus: blocks whose findings were worked out by hand -------------------------------------------------

_CYCLE10, _CYCLE12 = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
_LONG, _MIDDLE = "本段" + _CYCLE10 * 9 + "。", _CYCLE12 * 2 + "\n" + _CYCLE12 * 3 + "。"
#: (text, findings): a finding is (line in the block from 0, column, rule, found, sentence, what its message names).
#: Messages of S001 and A900 name a length; S001 is found where that is beyond the profile's limit, A900 in SKILL.md.
BLOCKS: list[tuple[str, list[tuple[int, int, str, str, str, str]]]] = [
    ("# 总览\n\n本周完成了全链路压测，结果非常稳定。\n", [(2, 6, "C002", "全链路", "本周完成了全链路压测，结果非常稳定。", "全链路"), (2, 14, "E001", "非常", "本周完成了全链路压测，结果非常稳定。", "非常")]),
    ("```text\n可能大概非常\n# 不是标题\n```\n围栏之后大概正常。\n", [(4, 5, "H001", "大概", "围栏之后大概正常。", "大概")]),
    ("| 项目 | 说明 |\n| --- | --- |\n| 登录 | 可能失败，大概重试 |\n| `也许` | 正常 |\n", [
        (2, 8, "H002", "可能", "| 登录 | 可能失败，大概重试 |", "可能"), (2, 13, "H001", "大概", "| 登录 | 可能失败，大概重试 |", "大概")]),
    ("名称 | 备注\n--- | ---\n接口 | 十分稳定\n", [(2, 6, "E001", "十分", "接口 | 十分稳定", "十分")]),
    ("<!-- 可能\n大概 --> 之后似乎可用。\n", [(1, 10, "H001", "似乎", "大概 --> 之后似乎可用。", "似乎")]),
    ("## 1. 甲\n\n## 3. 乙\n\n### \n", [(2, 4, "DOC002", "", "## 3. 乙", "1|3"), (4, 1, "DOC001", "", "###", "")]),
    (_LONG + _MIDDLE + "\n", [(0, 1, "S001", _LONG, _LONG, "93"), (0, 94, "S001", _MIDDLE, _MIDDLE, "61")]),
    ("- 结论结论需要核对。\n> 引用部分简直完整。\n", [(0, 3, "D001", "结论结论", "- 结论结论需要核对。", "结论"), (1, 7, "E001", "简直", "> 引用部分简直完整。", "简直")]),
    ("请看 `可能` 与 [大约](http://a.b/好像) 的写法。\n", [(0, 12, "H002", "大约", "请看 `可能` 与 [大约](http://a.b/好像) 的写法。", "大约")]),
    ("综上所述的方案与左右两侧一致。综上所述，完成。\n", [(0, 16, "C001", "综上所述", "综上所述，完成。", "综上所述")]),
    ("进行分析与讨论结果。\n    大概是代码\n", [(0, 1, "R001", "进行", "进行分析与讨论结果。", "进行"), (0, 6, "M001", "讨论结果", "进行分析与讨论结果。", "讨论结果")]),
    ("- 行\n" * 310, []),
]


def _text_case(key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{text}'" for i, (text, _) in enumerate(BLOCKS))
    return f"CASE {key} {arms} END"


_N = len(BLOCKS)
_FIRST, _SECOND = f"doc_id % {_N}", f"(doc_id + 1 + CAST(floor(doc_id / {_N}) AS BIGINT) % {_N - 1}) % {_N}"
#: Two different blocks, each ending in a blank line.
MD_SQL = f"""
SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('s', CAST(doc_id AS VARCHAR(20)), '/SKILL.md') ELSE concat('m', CAST(doc_id AS VARCHAR(20)), '.md') END AS filename,
  concat({_text_case(_FIRST)}, chr(10), {_text_case(_SECOND)}) AS text, {_FIRST} AS first_block, {_SECOND} AS second_block
FROM {{documents}}
"""


def md_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return spark.sql(MD_SQL.format(documents="{documents}"), documents=docs).select("doc_id", "filename", "text")
