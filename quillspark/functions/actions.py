"""Actions of a tool-using assistant: their grammar, and the rewards that shape an episode. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import nfkc, without_thought
from quillspark.functions.tokens import distinct_first, search_intents

SEARCH, READ, BOX = r"(?is)<search>(.*?)</search>", r"(?is)<read>(.*?)</read>", r"(?s)\\boxed\s*\{((?:[^{}]|\{[^{}]*\})*)\}"

SEPARATOR = "\x1e"


def with_action(df: DataFrame, text: str, name: str = "action") -> DataFrame:
    """Adds parse_action() of a text whose searches may change under NFKC.

    These are normalised in a projection of their own, as no lambda may stand over a Python function.
    """
    searches = F.array_join(F.regexp_extract_all(without_thought(text), F.lit(SEARCH), 1), SEPARATOR)
    parts = df.withColumn("_searches", searches).withColumn("_normal", nfkc("_searches"))
    return parts.withColumn(name, parse_action(text, normal=F.col("_normal"))).drop("_searches", "_normal")


def parse_action(text: Column | str, most: int = 3, normal: Column | None = None) -> Column:
    """struct<action, error, boxed_answers, search_queries, read_ids, has_extra_text, mixed_action>.

    Exactly one kind of action may stand outside closed think blocks: boxed answers (braces nested once at most), searches
    or reads. Searches are taken as normal under NFKC unless normal has them, joined by SEPARATOR. More than one kind is mixed_action; an empty one is empty_search or empty_read; stray tags are malformed.
    """
    t = without_thought(text)
    boxes = F.regexp_extract_all(t, F.lit(BOX), 1)
    searches, reads = F.regexp_extract_all(t, F.lit(SEARCH), 1), F.regexp_extract_all(t, F.lit(READ), 1)
    asked = F.flatten(F.transform(searches if normal is None else F.split(normal, SEPARATOR), lambda s: search_intents(s, most)))
    asked = F.slice(distinct_first(asked), 1, most)
    numbers = F.flatten(F.transform(reads, lambda r: F.regexp_extract_all(r, F.lit(r"\d+"), 0)))
    ids = F.slice(F.array_distinct(F.filter(F.transform(numbers, lambda n: n.try_cast("int")), lambda n: n > 0)), 1, 2)
    kinds = sum(((F.size(x) > 0).cast("int") for x in (boxes, searches, reads)), F.lit(0))
    low = F.lower(t)
    error = (
        F.when(kinds > 1, "mixed_action")
        .when(F.size(boxes) > 0, "")
        .when(F.size(searches) > 0, F.when(F.size(asked) > 0, "").otherwise("empty_search"))
        .when(F.size(reads) > 0, F.when(F.size(ids) > 0, "").otherwise("empty_read"))
        .when(low.rlike("</?search>"), "malformed_search")
        .when(low.rlike("</?read>"), "malformed_read")
        .otherwise("no_action")
    )
    action = F.when(error != "", "invalid").when(F.size(boxes) > 0, "answer").when(F.size(searches) > 0, "search").otherwise("read")
    after = F.when(action == "search", F.regexp_extract(t, r"(?is)^.*</search>(.*)$", 1)).when(action == "read", F.regexp_extract(t, r"(?is)^.*</read>(.*)$", 1)).otherwise("")
    none = F.array().cast("array<string>")
    return F.struct(
        action.alias("action"),
        error.alias("error"),
        F.when((action == "answer") | (kinds > 1), boxes).otherwise(none).alias("boxed_answers"),
        F.when(action == "search", asked).otherwise(none).alias("search_queries"),
        F.when(action == "read", ids).otherwise(F.array().cast("array<int>")).alias("read_ids"),
        (F.btrim(after, F.lit(" \t\r\n")) != "").alias("has_extra_text"),
        (kinds > 1).alias("mixed_action"),
    )


PHASES = {"a": ["a", "phase_a", "protocol"], "b": ["b", "phase_b", "retrieval"], "c": ["c", "phase_c", "accuracy"]}
SLIPS = ["malformed_search", "malformed_read", "empty_search", "empty_read", "unclosed_think"]


def phase(name: Column, turn: Column) -> Column:
    """a, b or c, by name or else by the number of turns: below 2, below 5, beyond."""
    return F.when(name.isin(PHASES["a"]), "a").when(name.isin(PHASES["b"]), "b").when(name.isin(PHASES["c"]), "c").when(turn < 2, "a").when(turn < 5, "b").otherwise("c")


def is_validation(split: Column) -> Column:
    return F.lower(F.coalesce(split, F.lit("train"))).isin("val", "valid", "validation")


def search_reward(stats: Column, turn: Column, split: Column, name: Column) -> Column:
    """stats: struct with answer_mode_search, search_nonempty, repeated_queries, empty_queries, extra_action_text."""
    at = phase(name, turn)
    base = F.when(at == "a", 0.04 + 0.02 * stats.search_nonempty.cast("int")).when(at == "b", 0.01 - 0.02 * stats.repeated_queries - 0.02 * stats.empty_queries).otherwise(-0.005)
    shaped = F.greatest(F.least(base - 0.02 * stats.extra_action_text.cast("int"), F.lit(0.2)), F.lit(-0.2))
    return F.when(is_validation(split), 0.0).when(stats.answer_mode_search, -0.2).otherwise(shaped)


def read_reward(stats: Column, split: Column) -> Column:
    """stats: struct with read_nonempty, missing_reads, extra_action_text."""
    base = F.when(stats.read_nonempty, 0.02).otherwise(-0.03) - 0.02 * stats.missing_reads - 0.02 * stats.extra_action_text.cast("int")
    return F.when(is_validation(split), 0.0).otherwise(F.greatest(F.least(base, F.lit(0.1)), F.lit(-0.1)))


def error_reward(error: Column, split: Column) -> Column:
    return F.when(is_validation(split), 0.0).when(error == "mixed_action", -0.2).when(error.isin(SLIPS), -0.05).otherwise(-0.1)


def timeout_reward(split: Column) -> Column:
    return F.when(is_validation(split), 0.0).otherwise(-1.0)
