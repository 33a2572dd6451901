"""Short answers judged by a model, all others by rule; what the judge can't say is graded by rule too."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import grading
from quillspark.functions.text import text_of

AT_ONCE = 16


def judge_prompt(query: Column | str, completion: Column | str, expected: Column | str) -> Column:
    query, completion = text_of(query), text_of(completion)
    question = F.trim(F.when(F.contains(query, F.lit("题目：")), F.regexp_replace(query, "(?s)^.*?题目：", "")).otherwise(query))
    points = F.filter(F.transform(F.split(grading.gold(expected), r"\|\|\|"), lambda p: F.trim(p)), lambda p: p != "")
    box = grading.boxed(completion)
    answer = F.concat(F.trim(completion), F.when(F.coalesce(box, F.lit("")) != "", F.concat(F.lit("\n（学生标注要点："), box, F.lit("）"))).otherwise(""))
    listed = F.array_join(F.transform(points, lambda p: F.concat(F.lit("- "), p)), "\n")
    return F.concat(F.lit("【题目】\n"), question, F.lit("\n\n【参考要点】\n"), listed, F.lit("\n\n【学生作答】\n"), answer, F.lit("\n\n请给出 JSON 评分。"))


def score_in(said: str | None) -> float | None:
    """The score that a judge's text names, between 0 and 1; None if it names none."""
    found = re.search(r'"score"\s*:\s*([01](?:\.\d+)?)', said or "") or re.search(r"([01](?:\.\d+)?)", said or "")
    return max(0.0, min(1.0, float(found[1]))) if found else None


def judged(rows: DataFrame, ask: Callable[[str], str] | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """rows (query, completion, expected_answer) with grade. ask gives the judge's text for a prompt; it may fail.

    Without ask all are graded by rule. Each task asks for at_once answers at a time.
    """
    ruled = rows.withColumn("grade", grading.grade("expected_answer", "completion"))
    if ask is None:
        return ruled
    open_ = F.ltrim(text_of("expected_answer")).startswith("[short]") & grading.boxed("completion").isNotNull()
    prompted = ruled.withColumn("_prompt", F.when(open_, judge_prompt("query", "completion", "expected_answer")))

    def one(prompt: str | None) -> float | None:
        if prompt is None:
            return None
        try:
            return score_in(ask(prompt))
        except Exception:  # noqa: BLE001  whatever the judge fails with, the rule answers
            return None

    @F.pandas_udf("double")
    def scores(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(at_once) as pool:
            for series in prompts:
                yield pd.Series(list(pool.map(one, series)), dtype="float64")

    return prompted.withColumn("_score", scores("_prompt")).withColumn("grade", F.coalesce(F.nanvl("_score", F.lit(None).cast("double")), "grade")).drop("_prompt", "_score")
