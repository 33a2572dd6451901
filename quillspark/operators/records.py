"""Tables of questions, answers and message logs: dedupe, splits, validation, grades and their summaries."""

from __future__ import annotations

from json import dumps, loads

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def first_of_each(rows: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """Rows that are the first with their key; a row keeps all its columns."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def duplicates(rows: DataFrame, key: list[str | Column]) -> DataFrame:
    """(rows, distinct, duplicates): how many rows share a key with an earlier one, from partial counts."""
    return rows.groupBy(*key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))


def question_key(qtype: Column, question: Column, options: Column, answer: Column) -> Column:
    return F.concat_ws("::", qtype, F.trim(question), F.array_join(options, "|"), F.trim(answer))


def train_validation(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds split: the first rows are val, at most size and a tenth of all. order must be unique."""
    n = min(size, rows.count() // 10)
    first = rows.select(order).orderBy(order).limit(n)
    edge = first.agg(F.max(order).alias("edge")).first()["edge"] if n else None
    return rows.withColumn("split", F.when(F.col(order) <= F.lit(edge), "val").otherwise("train") if n else F.lit("train"))


def require(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows; reading one that lacks a column's value is an error."""
    for c in columns:
        rows = rows.where(F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.raise_error(F.lit(f"a row has no {c}")).isNull()).otherwise(True))
    return rows


def short_answers(rows: DataFrame, query: str = "query", keywords: str = "reference_keywords") -> DataFrame:
    """Rows of (query, keywords) as typed records; those without a query or keywords go."""
    points = F.filter(F.transform(keywords, lambda k: F.trim(k)), lambda k: k != "")
    out = rows.select(F.trim(query).alias("query"), points.alias("_k")).where((F.col("query") != "") & (F.size("_k") > 0))
    return out.select("query", F.concat(F.lit("[short] "), F.array_join("_k", " ||| ")).alias("expected_answer"))


def grade_summary(grades: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean, accuracy (0.9 or more), shares of full and of negative grades."""
    return grades.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg("grade").alias("mean_grade"), F.avg((F.col("grade") >= 0.9).cast("double")).alias("accuracy"), F.avg((F.col("grade") >= 1.0).cast("double")).alias("full_share"), F.avg((F.col("grade") < 0).cast("double")).alias("negative_share")
    )


def tally(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Counts, most common first; ties by first appearance."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("_first")).orderBy(F.desc("n"), "_first").drop("_first")


def histogram(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("count"))


def _rate(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def turn_metrics(stats: DataFrame) -> DataFrame:
    """Rates over all turns; stats has a row for each turn with flags and counts."""
    n = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    steps = F.count("*")
    return stats.agg(
        _rate(n("valid_search"), steps).alias("valid_search_rate"),
        _rate(n("search_nonempty"), n("valid_search")).alias("search_nonempty_rate"),
        _rate(n("boxed"), steps).alias("boxed_format_rate"),
        _rate(n("final_correct"), n("boxed")).alias("final_correct_rate"),
        _rate(n("format_error"), steps).alias("format_error_rate"),
        _rate(n("timeout"), steps).alias("timeout_rate"),
        _rate(n("extra_action_text"), steps).alias("extra_action_text_rate"),
        _rate(n("answer_mode_search"), steps).alias("answer_mode_search_rate"),
        _rate(n("valid_read"), steps).alias("valid_read_rate"),
        _rate(n("read_nonempty"), n("valid_read")).alias("read_nonempty_rate"),
        n("missing_reads").cast("double").alias("missing_reads"),
        n("repeated_queries").cast("double").alias("repeated_queries"),
        n("empty_queries").cast("double").alias("empty_queries"),
    )


def episode_summary(turns: DataFrame, episode: str = "episode_id") -> DataFrame:
    """Rates over episodes; an episode is right if its summed reward is 0.999 or more. No row for no episodes."""
    each = turns.groupBy(episode).agg(F.sum("reward").alias("reward"), F.count("*").alias("turns"), F.max(F.col("boxed").cast("int")).alias("boxed"), *(F.sum(F.col(c).cast("long")).alias(c) for c in ("valid_search", "search_nonempty", "extra_action_text", "format_error")))
    out = each.agg(
        F.count("*").cast("double").alias("episodes"),
        F.avg((F.col("reward") >= 0.999).cast("double")).alias("accuracy"),
        F.avg("boxed").alias("boxed_rate"),
        F.avg("turns").alias("avg_turns"),
        _rate(F.sum("valid_search"), F.sum("turns")).alias("valid_search_rate"),
        _rate(F.sum("search_nonempty"), F.sum("valid_search")).alias("search_nonempty_rate"),
        _rate(F.sum("extra_action_text"), F.sum("turns")).alias("extra_action_text_rate"),
        _rate(F.sum("format_error"), F.sum("turns")).alias("format_error_rate"),
    )
    return out.where("episodes > 0")


def message_metrics(actions: DataFrame) -> DataFrame:
    """Rates over assistant messages; actions has action, error and has_extra_text."""
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    all_ = F.count("*")
    kinds = [_rate(n(F.col("action") == a), all_).alias(f"{name}_message_rate") for a, name in (("search", "search"), ("answer", "boxed"), ("invalid", "invalid"))]
    errors = [_rate(n((F.col("action") == "invalid") & (F.col("error") == e)), all_).alias(f"error_{e}_rate") for e in ("no_action", "malformed_search", "empty_search", "unclosed_think")]
    return actions.agg(all_.cast("double").alias("assistant_messages"), *kinds, _rate(n(F.col("has_extra_text")), all_).alias("trailing_search_text_rate"), *errors)


def two_ended_sample(rows: DataFrame, n: int, reward: str = "reward", order: str = "idx") -> DataFrame:
    """n rows from both ends of the rewards (and the middle one if n is odd), in their own order; all if n is not below their number.

    The two ends come from top-k sorts of at most n / 2 rows; nothing is sorted as a whole but for the middle row.
    """
    total = rows.count()
    if n <= 0 or n >= total:
        return rows.orderBy(order)
    half = n // 2
    if half == 0:
        # the lower end of nothing is everything, of which the first in order stays
        return rows.orderBy(order).limit(n)
    high = rows.orderBy(F.desc(reward), order).limit(half)
    low = rows.orderBy(reward, F.desc(order)).limit(half)
    picked = high.unionByName(low)
    if n % 2:
        picked = picked.unionByName(rows.orderBy(F.desc(reward), order).offset(total // 2).limit(1))
    return picked.dropDuplicates([order]).orderBy(order).limit(n)


def page(rows: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in an order: those after the first offset, at most limit."""
    return rows.orderBy(*order).offset(offset).limit(limit)


LOGS = ArrayType(ArrayType(StructType([StructField("role", StringType()), StructField("content", StringType())])))
LOG_KEYS = ("message_log", "messages", "conversation")


def logs_in(value: object) -> list[list[dict]]:
    """The message logs in a value, however deep: lists of mappings that all have a role. A log that is met twice counts once."""
    found: dict[int, list[dict]] = {}
    todo = [value]
    while todo:
        at = todo.pop()
        if isinstance(at, list):
            if at and all(isinstance(x, dict) and "role" in x for x in at):
                found.setdefault(id(at), at)
            else:
                todo += reversed(at)
        elif isinstance(at, dict):
            named = [at[k] for k in LOG_KEYS if k in at]
            todo += reversed([*named, *(v for v in at.values() if isinstance(v, (dict, list)))])
    return list(found.values())


def message_logs(records: DataFrame, json: str = "json") -> DataFrame:
    """(other columns, log_no, pos, role, content): the messages of all logs in a JSON text; a malformed text has none."""

    @F.pandas_udf(LOGS)
    def logs(texts: pd.Series) -> pd.Series:
        def of(text: str | None) -> list:
            try:
                value = loads(text or "null")
            except ValueError:
                return []
            plain = lambda x: x if x is None or isinstance(x, str) else dumps(x, ensure_ascii=False)
            return [[{"role": plain(m.get("role")), "content": plain(m.get("content"))} for m in log] for log in logs_in(value)]

        return texts.map(of, na_action=None)

    others = [c for c in records.columns if c != json]
    each = records.select(*others, F.posexplode(logs(json)).alias("log_no", "log"))
    return each.select(*others, "log_no", F.posexplode("log").alias("pos", "m")).select(*others, "log_no", "pos", "m.role", "m.content")


def examples(actions: DataFrame, order: list[str | Column], n: int = 5) -> DataFrame:
    """The first n assistant messages in order, with their action and error."""
    return actions.orderBy(*order).limit(n)
