"""What the operators of this subpackage share: the shared folder, written tables and Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the cluster names no folder of its own, as in tests.
FALLBACK_ROOT = "file:///tmp/checkpoints"
_MADE: list[tuple[object, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset a session of one process uses FALLBACK_ROOT; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or FALLBACK_ROOT).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_root(spark)}/quillspark/{uuid.uuid4().hex}-{name}"
    if not _MADE:
        atexit.register(_remove)
    _MADE.append((spark, path))
    return path


def _remove() -> None:
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session may have gone first
            continue


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch, where the session allows more.
ROWS_A_BATCH = 1024


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows that go to a Python worker at once: whole texts are long, and a batch is held several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 2048, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (tuples in the order of schema) as Arrow batches of bounded size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
        if len(held) >= most or size >= most_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


# --- Rows of the caller -------------------------------------------------------------------------------------------------


def packed(docs: DataFrame) -> DataFrame:
    """docs as one struct column, row, so that no name of the caller's can clash with a column that is added."""
    return docs.select(F.struct("*").alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    """The caller's columns again, and no others."""
    return rows.select("row.*")


# --- Bit tables ---------------------------------------------------------------------------------------------------------
#
# A table of fixed size that tells which hashes may be in a set. It goes to all executors whatever the set's size; what it
# lets through wrongly is settled by a join, so it prunes rows before a shuffle and never decides.

#: Bits of a table, 4 MB.
TABLE_BITS = 1 << 25


def bits_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each hash (unsigned)."""
    return (hashes & np.uint64(bits - 1)).astype(np.int64), ((hashes >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def table_of(marks: DataFrame, bits: int = TABLE_BITS) -> np.ndarray:
    """The bit table of marks (hash long): OR-ed together from partitions, at most bits / 8 bytes from each."""

    def filled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bytes_ = np.zeros(bits // 8, dtype=np.uint8)
        for frame in frames:
            for at in bits_of(frame["hash"].to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(bytes_, at >> 3, (1 << (at & 7)).astype(np.uint8))
        at = np.flatnonzero(bytes_)
        yield pd.DataFrame({"at": at, "byte": bytes_[at].astype(np.int32)})

    joined = marks.select("hash").distinct().mapInPandas(filled, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    got = joined.toPandas()
    out[got["at"].to_numpy(dtype=np.int64)] = got["byte"].to_numpy(dtype=np.uint8)
    return out


def held_by(table: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which of these hashes (unsigned) may be in the set."""
    fits = np.ones(len(hashes), dtype=bool)
    for at in bits_of(hashes, bits):
        fits &= (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return fits


def may_hold(spark: SparkSession, table: np.ndarray, mark: Column, bits: int = TABLE_BITS) -> Column:
    """Whether a hash (long, not null) may be in the table's set."""
    held = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def found(marks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in marks:
            yield pd.Series(held_by(held.value, series.to_numpy(dtype=np.int64).view(np.uint64), bits))

    return found(mark)
