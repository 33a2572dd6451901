"""Prompts from questions: instructions of single-turn use taken out, a system text and examples put in front."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import text_of

# Names of question types, and what marks lines of instructions.
TYPES = ["单选题", "多选题", "判断题", "填空题", "简答题"]
INSTRUCTIONS = ["把最终答案放入", "请先简要分析再作答", "请按编号顺序填写每个空"]
INTRODUCTION = "下面是一道"
HERE = "真实题目如下。"


def question_for_prompt(query: Column | str) -> Column:
    """The question's lines without instructions, blank runs as one blank line, its type in front if it says one."""
    lines = F.transform(F.split(text_of(query), "\r?\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    intro = F.filter(lines, lambda x: F.ltrim(x).startswith(INTRODUCTION))
    kind = F.array(*map(F.lit, TYPES))
    named = F.get(F.filter(kind, lambda k: F.exists(intro, lambda x: F.contains(x, k))), F.lit(0))
    told = lambda x: F.ltrim(x).startswith(INTRODUCTION) | F.ltrim(x).startswith("作答后，把") | x.rlike("|".join(INSTRUCTIONS))
    body = F.regexp_replace(F.array_join(F.filter(lines, lambda x: ~told(x)), "\n"), "\n{3,}", "\n\n")
    body = F.btrim(body, F.lit(" \t\r\n"))
    return F.when(named.isNotNull(), F.btrim(F.concat(F.lit("题型："), named, F.lit("\n"), body), F.lit(" \t\r\n"))).otherwise(body)


def prompt(query: Column | str, system: str, examples: str = "") -> Column:
    parts = [F.lit(p.strip()) for p in (system, examples) if p.strip()]
    return F.concat_ws("\n\n", *parts, F.lit(HERE), question_for_prompt(query))


def data(records: DataFrame, system: str, examples: str = "") -> DataFrame:
    """records with prompt and a message log of one user message."""
    made = records.withColumn("prompt", prompt("query", system, examples))
    return made.withColumn("message_log", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))))
