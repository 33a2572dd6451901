"""Rows brought to the documents that need them, where the documents are too large to be moved.

Documents that are read from Parquet have a block: the file and the range of ROWS rows in it that they were read from. A
block is the same whatever way the file is split, and however often. What a block's documents need (here: pairs of a key
and a number) is grouped by block and written to the shared folder, a file for each of a number of shards with an index of
its blocks at the end; a task that reads documents takes its blocks' arrays from there. So only the small side is shuffled.
Documents that don't come from Parquet files are written first.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.archives import place
from quillspark.llm.shared import batches, partitions, shared_path, written

ROWS = 8192


def with_block(docs: DataFrame) -> DataFrame:
    """(row, block): docs as a struct, and the block of each row."""
    rows = docs.select(F.struct("*").alias("row"))
    at = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / ROWS)).alias("block")
    try:
        return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), at)
    except AnalysisException:
        return written(rows, "docs").select("row", at)


def shard_of(block: Column, shards: int) -> Column:
    return F.pmod(F.hash(block), F.lit(shards))


MADE = pa.schema([("shard", pa.int32()), ("rows", pa.int64())])


@dataclass
class Side:
    """Arrays by block in the shared folder."""

    folder: str
    shards: int
    #: Indexes of files and arrays of blocks that were used last.
    _indexes: OrderedDict = field(default_factory=OrderedDict, repr=False)
    _arrays: OrderedDict = field(default_factory=OrderedDict, repr=False)

    def arrays(self, shard: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of a block, sorted, and their numbers; empty if it has none."""
        if block in self._arrays:
            return self._arrays[block]
        found = np.zeros(0, dtype=np.int64), np.zeros(0)
        store, base = place(self.folder)
        path = f"{base}/{shard:06d}.bin"
        if shard not in self._indexes:
            self._indexes[shard] = self._index(store, path)
            while len(self._indexes) > 16:
                self._indexes.popitem(last=False)
        if (at := self._indexes[shard].get(block)) is not None:
            offset, n = at
            with store.open_input_file(path) as file:
                file.seek(offset)
                raw = file.read(16 * n)
            found = np.frombuffer(raw, dtype="<i8", count=n), np.frombuffer(raw, dtype="<f8", offset=8 * n, count=n)
        self._arrays[block] = found
        while len(self._arrays) > 2:
            self._arrays.popitem(last=False)
        return found

    @staticmethod
    def _index(store, path: str) -> dict[int, tuple[int, int]]:
        info = store.get_file_info(path)
        if info.type != pa.fs.FileType.File:
            return {}
        with store.open_input_file(path) as file:
            file.seek(info.size - 8)
            size = int.from_bytes(file.read(8), "little")
            file.seek(info.size - 8 - size)
            rows = np.load(io.BytesIO(file.read(size)))
        return {int(block): (int(offset), int(n)) for block, offset, n in rows}

    def __getstate__(self) -> dict:
        return {"folder": self.folder, "shards": self.shards}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)


def deliver(rows: DataFrame, name: str) -> Side:
    """rows (block, key, value) as arrays by block. A file is written under another name and renamed when whole."""
    spark = rows.sparkSession
    folder, shards = shared_path(spark, name), partitions(spark)

    def files(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, base = place(folder)
        store.create_dir(base, recursive=True)
        now, out, name, index, held, size, total = None, None, "", [], [], 0, 0

        def ended_block() -> None:
            nonlocal size
            if held:
                block, keys, values = held[0][0], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
                out.write(keys.astype("<i8").tobytes() + values.astype("<f8").tobytes())
                index.append((block, size, len(keys)))
                size += 16 * len(keys)
                held.clear()

        def ended_file() -> tuple:
            ended_block()
            tail = io.BytesIO()
            np.save(tail, np.array(index, dtype=np.int64).reshape(-1, 3))
            out.write(tail.getvalue() + len(tail.getvalue()).to_bytes(8, "little"))
            out.close()
            store.move(name, f"{base}/{now:06d}.bin")
            return now, total

        for part in parts:
            shard, block, keys, values = (part.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(block)]):
                if a == b:
                    continue
                if now != shard[a]:
                    if out is not None:
                        yield ended_file()
                    now, index, size, total = int(shard[a]), [], 0, 0
                    name = f"{base}/.open-{now}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                if held and held[0][0] != block[a]:
                    ended_block()
                held.append((int(block[a]), keys[a:b], values[a:b]))
                total += b - a
        if out is not None:
            yield ended_file()

    dealt = rows.select(shard_of(F.col("block"), shards).alias("shard"), "block", "key", "value")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block", "key")
    written(dealt.mapInArrow(lambda parts: batches(files(parts), MADE), "shard int, rows long"), f"{name}-files")
    return Side(folder, shards)
