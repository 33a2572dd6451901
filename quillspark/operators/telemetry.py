"""Metric points, hardware gauges, log lines and validation samples, as batch operators; streaming uses the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG_AFTER, LONGEST_AFTER, SHORT, MIDDLE, LONG, LEAST = 10, 50, 10.0, 30.0, 60.0, 5.0
STEP_MARK = r"(?i)Starting validation at step\s+(\d+)"


def sampling_interval(n: Column, base: float | Column = SHORT, dynamic: bool = True) -> Column:
    """Seconds until the next sample after n samples."""
    floor = F.greatest(F.lit(LEAST), F.lit(base) if not isinstance(base, Column) else base)
    if not dynamic:
        return floor
    return F.when(n < LONG_AFTER, floor).when(n < LONGEST_AFTER, F.greatest(floor, F.lit(MIDDLE))).otherwise(F.greatest(floor, F.lit(LONG)))


def flattened(json: Column, depth: int = 4) -> Column:
    """map<string, string> of a JSON object: nested keys joined by dots, arrays and scalars as JSON texts."""
    kind = "map<string,string>"
    level = F.from_json(json, kind)
    for _ in range(depth):
        parts = F.transform(F.map_entries(level), lambda e: F.when(F.ltrim(e.value).startswith("{"), F.transform_keys(F.from_json(e.value, kind), lambda k, _v: F.concat(e.key, F.lit("."), k))).otherwise(F.create_map(e.key, e.value)))
        level = F.aggregate(parts, F.create_map().cast(kind), lambda a, m: F.map_concat(a, m))
    return level


def scalar(value: Column) -> Column:
    """A JSON text as a number: booleans as 0 and 1, arrays as the mean of their numbers and booleans; else null."""
    one = lambda x: F.when(x == "true", 1.0).when(x == "false", 0.0).otherwise(x.try_cast("double"))
    items = F.filter(F.transform(F.from_json(value, "array<string>"), one), lambda x: x.isNotNull())
    mean = F.when(F.size(items) > 0, F.aggregate(items, F.lit(0.0), lambda a, x: a + x) / F.size(items))
    return F.when(F.ltrim(value).startswith("["), mean).otherwise(one(value))


def metric_points(rows: DataFrame, metrics: str, prefix: str = "", depth: int = 4) -> DataFrame:
    """One row for each metric that is a number, its key with the prefix unless it has it; other columns stay."""
    others = [c for c in rows.columns if c != metrics]
    out = rows.select(*others, F.explode(flattened(F.col(metrics), depth)).alias("key", "_value"))
    if prefix:
        out = out.withColumn("key", F.when(F.col("key").startswith(prefix + "/"), F.col("key")).otherwise(F.concat(F.lit(prefix + "/"), F.col("key"))))
    return out.withColumn("value", scalar(F.col("_value"))).drop("_value").where("value is not null")


def hardware_points(rows: DataFrame, gauges: str, uuids: str | None = None) -> DataFrame:
    """One row for each gauge of a map<string, double>, with the GPU's number from its key and, from uuids, its id."""
    others = [c for c in rows.columns if c not in (gauges, uuids)]
    out = rows.select(*others, *([uuids] if uuids else []), F.explode(gauges).alias("key", "value"))
    out = out.withColumn("gpu_idx", F.regexp_extract("key", r"^gpu\.(\d+)\.", 1).try_cast("int"))
    return out.withColumn("gpu_uuid", F.get(uuids, F.col("gpu_idx"))).drop(uuids) if uuids else out


def active_step(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """Adds active_step: the step of the last validation start up to each line."""
    found = F.regexp_extract(line, STEP_MARK, 1).try_cast("long")
    return lines.withColumn("active_step", F.last(found, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def pieces(text: Column, size: int = 8192) -> Column:
    """A text in pieces of so many characters."""
    return F.when(F.char_length(text) > 0, F.transform(F.sequence(F.lit(0), F.char_length(text) - 1, F.lit(size)), lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sample_chunks(samples: DataFrame, by: list[str], order: str, size: int = 64) -> DataFrame:
    """Samples in chunks of so many rows: chunk_index, total_chunks, total_samples and the rows' places."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    total = F.count("*").over(Window.partitionBy(*by))
    return samples.withColumn("total_samples", total).withColumn("chunk_index", F.floor(place / size)).withColumn("total_chunks", F.ceil(total / size))


def windowed(points: DataFrame, length: str, slide: str | None = None, by: list[str] | None = None, time: str = "ts") -> DataFrame:
    """Count and sum of values in tumbling or sliding windows."""
    frame = F.window(time, length, slide) if slide else F.window(time, length)
    return points.groupBy(frame.alias("_w"), *(by or [])).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("_w.start").alias("start"), *(by or []), "n", "total")


def sessions(points: DataFrame, gap: str, by: list[str], time: str = "ts") -> DataFrame:
    return points.groupBy(F.session_window(time, gap).alias("_w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(*by, F.col("_w.start").alias("start"), "n", "total")


def latest(rows: DataFrame, path: str, by: list[str] | None = None) -> DataFrame:
    """The path whose step_<N> is the greatest number."""
    step = F.regexp_extract(path, r"step_(\d+)", 1).try_cast("long")
    return rows.withColumn("step", step).where("step is not null").groupBy(*(by or [])).agg(F.max_by(path, F.struct("step", path)).alias("path"), F.max("step").alias("step"))


def gpu_in_use(processes: Column, own: Column, used_mib: Column, threshold: int = 2048) -> Column:
    """Whether a GPU belongs to a job: some process is its own; without a list of own ones, by memory in use."""
    return F.when(own.isNull(), used_mib >= threshold).otherwise(F.arrays_overlap(processes, own))


def job_scope(actors: DataFrame, fallback: DataFrame) -> DataFrame:
    """(job_id, node_id) of live actors (neither DEAD nor RESTARTING); a job without any is on its fallback (job_id, node_id)."""
    live = actors.where(~F.upper(F.coalesce("state", F.lit(""))).isin("DEAD", "RESTARTING") & F.col("node_id").isNotNull()).select("job_id", "node_id").distinct()
    return live.unionByName(fallback.join(live, "job_id", "left_anti").select("job_id", "node_id"))


def scoped(gauges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Gauges of the nodes in scope."""
    return gauges.join(nodes.select("node_id").distinct(), "node_id", "left_semi")


def of_active_step(samples: DataFrame, lines: DataFrame, key: str, order: str) -> DataFrame:
    """Samples (key, step, ...) whose step is the one that their run's log lines say is being validated last."""
    found = lines.withColumn("_step", F.regexp_extract("line", STEP_MARK, 1).try_cast("long")).where("_step is not null")
    last = found.groupBy(key).agg(F.max_by("_step", order).alias("_step"))
    return samples.join(last, key).where(F.col("step") == F.col("_step")).drop("_step")
