"""Experiment configurations as tables of (name, key, value): layers merged, differences, checks, run ledgers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OVERRIDE = "_override_"


def merged(base: dict, over: dict) -> dict:
    """base with over on top; a mapping that says _override_ replaces what it would be merged with."""
    if over.get(OVERRIDE):
        return {k: v for k, v in over.items() if k != OVERRIDE}
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else merged({}, value) if isinstance(value, dict) else value
    return out


def resolved(name: str, load: Callable[[str], dict]) -> dict:
    """A configuration on top of the ones that its defaults name, in order, each resolved in turn; load gives one by name."""
    own = dict(load(name) or {})
    out: dict = {}
    for other in own.pop("defaults", None) or []:
        if isinstance(other, str):
            out = merged(out, resolved(other, load))
    return merged(out, own)


def flat(value: Any, prefix: str = "") -> list[tuple[str, str]]:
    """(key, value) texts: mappings by dots, lists by [i], None as null."""
    if isinstance(value, dict):
        return [x for k, v in value.items() for x in flat(v, f"{prefix}.{k}" if prefix else str(k))]
    if isinstance(value, list):
        return [x for i, v in enumerate(value) for x in flat(v, f"{prefix}[{i}]")]
    return [(prefix, "null" if value is None else str(value))]


def table_of(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    rows = [(name, k, v) for name, config in configs.items() for k, v in flat(config)]
    return spark.createDataFrame(rows, "name string, key string, value string")


def layered(layers: DataFrame) -> DataFrame:
    """(name, key, value) of the top layer that has the key, for layers (name, layer, key, value)."""
    return layers.groupBy("name", "key").agg(F.max_by("value", "layer").alias("value"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a, b, kind): changed, only_a or only_b."""
    both = a.select("key", F.col("value").alias("a"), F.lit(True).alias("_a")).join(b.select("key", F.col("value").alias("b"), F.lit(True).alias("_b")), "key", "full")
    kind = F.when(F.col("_a").isNull(), "only_b").when(F.col("_b").isNull(), "only_a").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.withColumn("kind", kind).where("kind is not null").select("key", "a", "b", "kind")


def issues(configs: DataFrame, positive: list[str], products: list[tuple[str, str, str]]) -> DataFrame:
    """(name, key, issue) for values that should be positive integers and products (whole, factor, factor) that don't hold.

    Values with ${...} are not judged.
    """
    judged = configs.where(~F.contains("value", F.lit("${")))
    number = F.col("value").try_cast("long")
    wrong = judged.where(F.col("key").isin(positive) & (number.isNull() | (number <= 0))).select("name", "key", F.lit("not a positive integer").alias("issue"))
    for whole, a, b in products:
        each = judged.where(F.col("key").isin(whole, a, b)).groupBy("name").agg(*(F.max(F.when(F.col("key") == k, number)).alias(c) for k, c in ((whole, "w"), (a, "a"), (b, "b"))))
        wrong = wrong.unionByName(each.where("w is not null and a is not null and b is not null and w <> a * b").select("name", F.lit(whole).alias("key"), F.lit(f"not {a} times {b}").alias("issue")))
    return wrong


def run_ledger(runs: DataFrame, contains: str, n: int, column: str = "exp", order: str = "submitted_at") -> DataFrame:
    """The n latest runs whose column has the text."""
    return runs.where(F.contains(column, F.lit(contains))).orderBy(F.desc(order), F.desc("run_id")).limit(n)


def provenance(configs: DataFrame, content: str = "content") -> DataFrame:
    """Adds config_sha: the first 12 hex digits of the content's SHA-256."""
    return configs.withColumn("config_sha", F.substring(F.sha2(content, 256), 1, 12))


def epochs(records: DataFrame, n: int, seed: int = 42, order: str = "idx") -> DataFrame:
    """n rows of (position, epoch, record columns): the records again and again, shuffled anew in each epoch by a hash."""
    total = records.count()
    if not total:
        return records.limit(0).withColumn("position", F.lit(0).cast("long")).withColumn("epoch", F.lit(0).cast("long"))
    rounds = records.sparkSession.range(-(-n // total)).withColumnRenamed("id", "epoch")
    all_ = records.crossJoin(rounds)
    place = F.row_number().over(Window.partitionBy("epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", order), order)) - 1
    return all_.withColumn("position", F.col("epoch") * total + place).where(F.col("position") < n)
