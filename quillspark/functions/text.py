"""Text functions as Column expressions; the few that Java has no counterpart for are Arrow functions.

Every function takes null as the empty text. Regular expressions that touch letters use (?U), without which Java's classes
are ASCII only. NFKC has no built-in counterpart: functions that need it take stable=True where the input is known not to
change under it and then stay inside code generation.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CJK = "\\u4e00-\\u9fff"
#: All white space of Unicode; what (?U)\s is, which looks a property up for every character.
SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# Words and marks of the query protocol.
PLACEHOLDER_QUERIES = ["关键词", "关键字", "检索词", "查询词", "待查询内容", "真实查询词", "题目关键词", "自然短语", "query", "keyword", "keywords", "x1", "x2", "x1 x2", "y"]
FEEDBACK_MARKS = ["检索结果返回", "深入阅读返回", "协议反馈", "上一轮动作无效", "正确示例", "不要复述资料", "不要输出", "我没有执行检索", "本轮没有执行检索", "下一轮只输出", "下一轮不要复述", "boxed"]
EXAMPLE_MARKS = ["示例导入前请删除", "（示例", "(示例", "这是单选题题目", "这是一道多选题", "这是一道判断题", "这是一道填空题", "这是一道简答题"]
SOURCE_STAMP = "20260611160325_"
GRADING_MARKS = r"[，,。．\.、；;：:！!？\?\"'`（）()【】\[\]/／\\\s]+"
CHINESE_DIGITS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}


def text_of(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


@F.pandas_udf(StringType())
def nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: unicodedata.normalize("NFKC", t or ""), na_action=None)


@F.pandas_udf(StringType())
def folded(x: pd.Series) -> pd.Series:
    """Full case folding."""
    return x.map(lambda t: (t or "").casefold(), na_action=None)


def fold_stable(x: Column) -> Column:
    """Case folding for texts whose only letter that folds to several is ß."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalize_text(x: Column | str, stable: bool = False) -> Column:
    """NFKC, runs of white space as one space, no white space at the ends."""
    x = text_of(x)
    return F.trim(F.regexp_replace(x if stable else nfkc(x), f"{SPACE}+", " "))


def normalize_terms(x: Column | str, stable: bool = False) -> Column:
    """normalize_text with the spellings of one alias made one."""
    return F.regexp_replace(normalize_text(x, stable), r"(?i)(?=b)\bby\s*[- ]\s*pass\b", "bypass")


def clean_query(x: Column | str, most: int = 64, stable: bool = False) -> Column:
    """A search query without markup, cut to most characters; empty if it repeats feedback or a placeholder."""
    q = F.regexp_replace(F.regexp_replace(normalize_terms(x, stable), r"[<>`*_#]+", " "), " {2,}", " ")
    q = F.btrim(q, F.lit(" \t\r\n,，;；、。."))

    def told(q: Column, low: Column) -> Column:
        short = F.trim(F.substring(q, 1, most))
        marked = reduce(or_, (F.contains(low, F.lit(m)) for m in FEEDBACK_MARKS))
        return F.when(marked | F.lower(short).isin(PLACEHOLDER_QUERIES), "").otherwise(short)

    if not stable:
        return told(q, F.lower(q))
    # a long text is worked on once, however often it is named; a lambda may not stand over a Python function
    once = F.transform(F.transform(F.array(q), lambda x: F.struct(x.alias("q"), F.lower(x).alias("low"))), lambda x: told(x.q, x.low))
    return F.get(once, F.lit(0))


def compact(x: Column | str, stable: bool = False) -> Column:
    """For matching: normalised, folded, without bracketed numbers, empty brackets and all that isn't a letter or digit."""
    t = normalize_text(x, stable)
    t = fold_stable(t) if stable else folded(t)
    return F.regexp_replace(F.regexp_replace(t, r"【\d+】|\[\d+\]|\(\s*\)|（\s*）|_", ""), r"(?U)[\W_]+", "")


def grading_form(x: Column | str) -> Column:
    """For grading: lower-cased without punctuation, slashes and white space; no NFKC."""
    return F.regexp_replace(F.lower(F.trim(text_of(x))), GRADING_MARKS, "")


def clean_cell(x: Column | str) -> Column:
    """A worksheet cell's text."""
    t = F.btrim(F.replace(text_of(x), F.lit("\u00a0"), F.lit(" ")), F.lit(" \t\r\n\f\x0b"))
    return F.regexp_replace(F.regexp_replace(t, "[\u200b-\u200d\ufeff]", ""), r"(?U)\s+", " ")


def header_form(x: Column | str) -> Column:
    return F.regexp_replace(F.trim(text_of(x)), r"（必填）|\(必填\)|\*| ", "")


def source_title(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(text_of(x), f"^{SOURCE_STAMP}", ""), r"\.xlsx$|\.xls$", "")


def is_example(x: Column | str) -> Column:
    t = text_of(x)
    return F.exists(F.array(*map(F.lit, EXAMPLE_MARKS)), lambda m: F.contains(t, m))


def estimate_tokens(x: Column | str, stable: bool = False) -> Column:
    """One for each Chinese character and one for every four others, rounded up."""
    t = normalize_text(x, stable)
    cjk = F.regexp_count(t, F.lit(f"[{CJK}]"))
    return (cjk + F.ceil((F.char_length(t) - cjk) / 4)).cast("int")


def trim_to_budget(x: Column | str, budget: int, stable: bool = False) -> Column:
    """The text, or its longest beginning within the budget (one for a Chinese character, a quarter for others) and dots."""
    t = text_of(x)
    # no character costs less than a quarter, so no more than 4 * budget are looked at
    head = F.substring(t, 1, 4 * budget)
    cost = F.transform(F.split(head, ""), lambda c: F.when(c.rlike(f"[{CJK}]"), 4).otherwise(1))
    n = F.aggregate(cost, F.struct(F.lit(0).alias("n"), F.lit(0).alias("spent")), lambda a, c: F.struct((a.n + F.when(a.spent + c <= 4 * budget, 1).otherwise(0)).alias("n"), F.when(a.spent + c <= 4 * budget, a.spent + c).otherwise(F.lit(1 << 30)).alias("spent")), lambda a: a.n)
    cut = F.when(head.rlike(f"[{CJK}]"), F.substring(head, F.lit(1), n)).otherwise(head)
    return F.when(estimate_tokens(t, stable) <= budget, t).otherwise(F.concat(F.regexp_replace(cut, r"(?U)\s+$", ""), F.lit("...")))


def without_thought(x: Column | str) -> Column:
    """Closed think blocks go, then stray tags."""
    return F.regexp_replace(F.regexp_replace(text_of(x), r"(?is)<think>.*?</think>", ""), r"(?i)</?think>", "")


def gsm8k_answer(x: Column | str) -> Column:
    """The number after ####, without commas; else the text, trimmed."""
    t = text_of(x)
    found = F.regexp_extract(t, r"####\s*(-?[\d,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(F.trim(t))


def instruction_prompt(instruction: Column | str, context: Column | str) -> Column:
    a, b = F.trim(text_of(instruction)), F.trim(text_of(context))
    return F.when(b != "", F.concat_ws("\n\n", a, b)).otherwise(a)


def log_line(x: Column | str, now: Column) -> Column:
    """A log line without colours and worker prefixes, with a time stamp in front; blank lines stay as they are."""
    t = text_of(x)
    bare = F.regexp_replace(F.regexp_replace(t, r"(?i)\x1b\[[0-9;]*m", ""), r"\[\d{1,3}m", "")
    # the first prefix in the line goes, twice
    prefix = r"^(.*?)\([A-Za-z][\w.]*\s+pid=\d+,\s*ip=[\d.]+\)\s*"
    for _ in range(2):
        bare = F.regexp_replace(F.regexp_replace(bare, prefix, "$1"), r"^\s+", "")
    level = r"^(INFO|WARNING|ERROR|DEBUG)\s+(\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2})\s+(.*)$"
    stamp = F.date_format(now, "yyyy-MM-dd HH:mm:ss")
    moved = F.trim(F.concat_ws(" ", F.concat(F.date_format(now, "yyyy"), F.lit("-"), F.regexp_extract(bare, level, 2)), F.regexp_extract(bare, level, 3), F.regexp_extract(bare, level, 1), F.regexp_extract(bare, level, 4)))
    return (
        F.when(F.trim(bare) == "", t)
        .when(bare.rlike(r"^\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s+"), bare)
        .when(bare.rlike(level), moved)
        .otherwise(F.concat_ws(" ", stamp, bare))
    )


def chinese_number(x: Column | str) -> Column:
    """一 to 九十九 as an int, else null."""
    t = F.trim(text_of(x))
    digit = F.create_map(*(F.lit(v) for pair in CHINESE_DIGITS.items() for v in pair))
    a, b, c = (F.element_at(digit, F.substring(t, i, 1)) for i in (1, 2, 3))
    n = F.char_length(t)
    return F.when(n == 1, a).when((n == 2) & (a == 10), b + 10).when((n == 2) & (b == 10), a * 10).when((n == 3) & (b == 10), a * 10 + c)


def one_place(x: Column) -> Column:
    """x with one decimal place, halves to the even digit; format_string alone takes them up."""
    return F.format_string("%.1f", F.bround(x, 1))


def human_bytes(x: Column) -> Column:
    """A size in B, KB, MB or, whatever is larger, GB."""
    out = F.concat(one_place(x / float(1 << 30)), F.lit(" GB"))
    for unit, size in (("MB", 1 << 20), ("KB", 1 << 10)):
        out = F.when(x < size * 1024, F.concat(one_place(x / float(size)), F.lit(f" {unit}"))).otherwise(out)
    return F.when(x < 1024, F.format_string("%d B", x.cast("long"))).otherwise(out)


def format_elapsed(seconds: Column) -> Column:
    """Seconds as 3.2s, 1m 05s or 2h 07m; less than none as none."""
    s = F.greatest(seconds.cast("double"), F.lit(0.0))
    whole = F.floor(s).cast("long")
    minutes = F.floor(whole / 60).cast("long")
    short = F.format_string("%dm %02ds", minutes, whole % 60)
    long_ = F.format_string("%dh %02dm", F.floor(minutes / 60).cast("long"), minutes % 60)
    return F.when(s < 60, F.concat(one_place(s), F.lit("s"))).when(minutes < 60, short).otherwise(long_)


# What isn't uploaded with a job.
NOT_UPLOADED_FOLDERS = [".cursor/", "docs/", "reports/"]
NOT_UPLOADED_SUFFIXES = [".pdf"]


def is_not_uploaded(path: Column | str) -> Column:
    """Whether a relative path lies in one of the folders, is one, or has one of the suffixes."""
    p = F.replace(text_of(path), F.lit("\\"), F.lit("/"))
    inside = F.concat(p, F.lit("/")).rlike("^(?:" + "|".join(re.escape(f) for f in NOT_UPLOADED_FOLDERS) + ")")
    return inside | F.lower(p).rlike("(?:" + "|".join(re.escape(x) for x in NOT_UPLOADED_SUFFIXES) + ")$")


def replay_value(x: Column) -> Column:
    """A text value of the replay report: one line, at most 220 characters, quoted."""
    t = F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))
    t = F.when(F.char_length(t) > 220, F.concat(F.substring(t, 1, 217), F.lit("..."))).otherwise(t)
    return F.concat(F.lit('"'), F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def role_text(log: Column, role: str) -> Column:
    """The contents of one role in array<struct<role, content>>, joined by line feeds."""
    own = F.filter(log, lambda m: F.upper(m.role) == role.upper())
    return F.trim(F.array_join(F.transform(F.filter(own, lambda m: m.content.isNotNull()), lambda m: m.content), "\n"))


def last_assistant(log: Column) -> Column:
    own = F.filter(log, lambda m: m.role == "assistant")
    return F.coalesce(F.trim(F.try_element_at(own, F.lit(-1)).content), F.lit(""))
