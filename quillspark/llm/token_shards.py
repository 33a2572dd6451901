"""Token ids in training order: fixed-stride binary shards under a keyed permutation.

Texts are tokenised by byte-level BPE (ranks from a vocabulary file), each followed by an end mark, and laid end to end in
the order of doc_id (null first; texts of one doc_id by a hash of the text). The stream is cut into sequences of LENGTH ids,
numbered from 0; the last is padded with end marks and its true length kept. A Feistel network, keyed and balanced over the
least domain of an even number of bits that holds all numbers, walks its cycle until it is back among them: a permutation of
0 .. N - 1 that gives each sequence its global slot, and whose inverse gives the sequence of a slot. Neither the sequences
nor their slots depend on how the documents are partitioned.

Slots are cut into shards of SHARD sequences, files of fixed stride: the sequence of slot s lies in shard s // SHARD at
byte (s % SHARD) * LENGTH * 2. A reader that stopped at a slot resumes there by one seek. Partitions are ranges of shards.

The ids are written once, in the place where their text was read. Only the lengths are sorted; the sums of those before,
first by range and then by row, are each document's place in the stream and are brought back to the ids (blocks.py). The ids
are then moved once, compressed and cut at the borders of sequences, to the shard that they belong to. A shard is written
under another name and renamed when whole. Null texts count as empty; an empty text is an end mark alone. Rows that agree in
doc_id and text follow one another; each counts.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.archives import place
from quillspark.llm.blocks import Side, deliver, shard_of
from quillspark.llm.shared import batches, partitions, shared_path, small_batches, written

LENGTH, SHARD, KEY, ROUNDS = 4096, 2048, 0x5EED, 6
#: Free in a vocabulary of 50,256 ranks.
END = 50_256


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as file:
        pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})


STAGED = pa.schema([("task", pa.int32()), ("local", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())])
STAGED_SQL = "task int, local long, doc_id long, mark long, n_tokens long, payload binary"


def tokenised(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(task, local, doc_id, mark, n_tokens, payload) for each row: little-endian 16-bit ids with the end mark, as a written table.

    task and local tell rows apart; mark is a hash of the text.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        from pyspark import TaskContext

        task, own, local = TaskContext.get().partitionId(), encoding(ranks, pattern), 0
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                said = text.as_py() or ""
                ids = own.encode_ordinary(said)
                ids.append(END)
                mark = xxhash.xxh3_64_intdigest(said.encode()) - (1 << 63)
                yield task, local, doc_id, mark, len(ids), np.array(ids, dtype="<u2").tobytes()
                local += 1

    small_batches(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda parts: batches(rows(parts), STAGED), STAGED_SQL)
    path = shared_path(docs.sparkSession, "ids")
    made.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def placed(staged: DataFrame) -> tuple[Side, int]:
    """Where each row's ids begin in the stream (by task and local), and the stream's length.

    The driver gets a number for each range.
    """
    spark, order = staged.sparkSession, ["doc_id", "mark", "task", "local"]
    lengths = staged.select(*order, "n_tokens").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    lengths = written(lengths.withColumn("part", F.spark_partition_id()), "lengths")
    sums = {r["part"]: r["n"] for r in lengths.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sums, default=-1) + 1):
        starts.append(total)
        total += sums.get(part, 0)
    before = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    start = F.element_at(F.lit(starts or [0]), F.col("part") + 1)
    rows = lengths.select(F.col("task").cast("long").alias("block"), F.col("local").alias("key"), (F.coalesce(before, F.lit(0)) + start).cast("double").alias("value"))
    return deliver(rows, "places"), total


def _round(half: np.ndarray, key: int, i: int, bits: int) -> np.ndarray:
    x = (half + np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xD1B54A32D192ED03) & ((1 << 64) - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - bits)) if bits else x & np.uint64(0)


def permuted(numbers: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The slots of numbers below n, or with inverse the numbers of slots."""
    bits = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << bits) - 1)
    x = numbers.astype(np.uint64)
    left = np.arange(len(x))
    while len(left):
        a, b = x[left] >> np.uint64(bits), x[left] & mask
        for i in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            a, b = (b ^ _round(a, key, i, bits), a) if inverse else (b, a ^ _round(b, key, i, bits))
        x[left] = (a << np.uint64(bits)) | b
        left = left[x[left] >= n]
    return x.astype(np.int64)


def sequences_of(total: int, length: int = LENGTH) -> int:
    return -(-total // length)


FRAGMENTS = pa.schema([("slot", pa.int64()), ("number", pa.int64()), ("first", pa.int32()), ("payload", pa.binary())])


def fragments(staged: DataFrame, places: Side, total: int, length: int = LENGTH, key: int = KEY) -> DataFrame:
    """(slot, number, first, payload): the ids cut at the borders of sequences, first being the place of a cut's first id.

    Documents that follow one another in a task and in the stream are cut together. Payloads are compressed.
    """
    n = sequences_of(total, length)

    def cuts(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        held, begin = bytearray(), 0

        def cut(whole: bool) -> Iterator[tuple[int, int, bytes]]:
            """What is held, or with whole the sequences of it that are complete."""
            nonlocal begin
            done, end = begin, begin + len(held) // 2
            while done < end:
                stop = (done // length + 1) * length
                if stop > end:
                    if whole:
                        break
                    stop = end
                yield done // length, done % length, bytes(held[2 * (done - begin) : 2 * (stop - begin)])
                done = stop
            del held[: 2 * (done - begin)]
            begin = done

        for part in parts:
            task, local, shard = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            edges = (np.flatnonzero(np.diff(task)) + 1).tolist()
            for a, b in zip([0, *edges], [*edges, len(task)]):
                if a == b:
                    continue
                keys, values = places.arrays(int(shard[a]), int(task[a]))
                at = values[np.searchsorted(keys, local[a:b])].astype(np.int64).tolist()
                for place_, payload in zip(at, part.column(2).slice(a, b - a).to_pylist()):
                    if held and place_ != begin + len(held) // 2:
                        yield from cut(False)
                    if not held:
                        begin = place_
                    held += payload
                    if len(held) >= 64 * length:
                        yield from cut(True)
        yield from cut(False)

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        packer, found = zstandard.ZstdCompressor(level=6), cuts(parts)
        while some := list(islice(found, 256)):
            slots = permuted(np.array([x[0] for x in some], dtype=np.int64), n, key).tolist()
            for slot, (number, first, raw) in zip(slots, some):
                yield slot, number, first, packer.compress(raw)

    own = staged.select("task", "local", "payload", shard_of(F.col("task").cast("long"), places.shards).alias("shard"))
    return own.mapInArrow(lambda parts: batches(rows(parts), FRAGMENTS), "slot long, number long, first int, payload binary")


INDEX = pa.schema([("slot", pa.int64()), ("number", pa.int64()), ("n_tokens", pa.int32()), ("shard", pa.int64()), ("offset", pa.int64()), ("tokens_sha256", pa.string())])
INDEX_SQL = "slot long, number long, n_tokens int, shard long, offset long, tokens_sha256 string"


def name_of(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


#: A task writes at most so many shards, however few partitions the session asks for.
SHARDS_A_TASK = 16


def by_range(rows: DataFrame, shards: int, *order: str) -> DataFrame:
    """rows (shard, ...) in partitions that are ranges of shards, each in this order."""
    n = max(1, min(shards, max(partitions(rows.sparkSession), -(-shards // SHARDS_A_TASK))))
    return rows.repartitionById(n, F.expr(f"CAST(shard * {n} DIV {max(shards, 1)} AS INT)")).sortWithinPartitions(*order)


def write(cut: DataFrame, total: int, folder: str, length: int = LENGTH, per_shard: int = SHARD) -> DataFrame:
    """Writes the shards and returns the index, a row for each slot, as a written table."""
    last = sequences_of(total, length) - 1

    def shards(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, base = place(folder)
        store.create_dir(base, recursive=True)
        unpack, now, out, at, name, held = zstandard.ZstdDecompressor(), None, None, 0, "", bytearray()

        def close() -> None:
            if out is not None:
                out.close()
                store.move(name, f"{base}/{name_of(now)}")

        for part in parts:
            for shard, slot, number, first, payload in zip(*(part.column(i).to_pylist() for i in range(5))):
                if shard != now:
                    close()
                    now, at, name = shard, 0, f"{base}/.open-{shard}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                if slot != shard * per_shard + at // (2 * length) or 2 * first != len(held):
                    raise ValueError(f"id {first} of slot {slot} isn't the next of shard {shard}")
                held += unpack.decompress(payload)
                n_tokens = total - last * length if number == last else length
                if len(held) < 2 * n_tokens:
                    continue
                digest = hashlib.sha256(held).hexdigest()
                held += np.full(length - n_tokens, END, dtype="<u2").tobytes()
                out.write(bytes(held))
                yield slot, number, n_tokens, shard, at, digest
                at, held = at + len(held), bytearray()
        if held:
            raise ValueError(f"shard {now} ends within a sequence")
        close()

    dealt = cut.select(F.expr(f"slot div {per_shard}").alias("shard"), "slot", "number", "first", "payload")
    dealt = by_range(dealt, -(-(last + 1) // per_shard), "slot", "first")
    return written(dealt.mapInArrow(lambda parts: batches(shards(parts), INDEX), INDEX_SQL), "index")


def resume(folder: str, slot: int, length: int = LENGTH, per_shard: int = SHARD) -> Iterator[np.ndarray]:
    """Sequences from a slot on, shard after shard, in training order."""
    store, base = place(folder)
    while True:
        info = store.get_file_info(f"{base}/{name_of(slot // per_shard)}")
        at = slot % per_shard * 2 * length
        if info.type != pa.fs.FileType.File or at >= info.size:
            return
        with store.open_input_file(info.path) as file:
            file.seek(at)
            while raw := file.read(2 * length):
                yield np.frombuffer(raw, dtype="<u2")
                slot += 1


def read_back(index: DataFrame, folder: str, length: int = LENGTH) -> DataFrame:
    """The index with tokens_sha256 taken from the shards."""

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        store, base = place(folder)
        now, file = None, None
        for part in parts:
            for slot, number, n_tokens, shard, offset, said in zip(*(part.column(i).to_pylist() for i in range(6))):
                if shard != now:
                    if file is not None:
                        file.close()
                    now, file = shard, store.open_input_file(f"{base}/{name_of(shard)}")
                file.seek(offset)
                found = hashlib.sha256(file.read(2 * length)[: 2 * n_tokens]).hexdigest()
                if found != said:
                    raise ValueError(f"slot {slot} isn't what was written")
                yield slot, number, n_tokens, shard, offset, found
        if file is not None:
            file.close()

    last = index.agg(F.max("shard").alias("last")).first()["last"]
    dealt = by_range(index, 0 if last is None else last + 1, "slot")
    return dealt.mapInArrow(lambda parts: batches(rows(parts), INDEX), INDEX_SQL)


def materialise(docs: DataFrame, ranks: str, pattern: str, length: int = LENGTH, per_shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Tokenises, permutes, writes and reads back: slot, number, n_tokens, shard, offset, tokens_sha256 of each sequence."""
    folder, staged = shared_path(docs.sparkSession, "shards"), tokenised(docs, ranks, pattern)
    places, total = placed(staged)
    index = write(fragments(staged, places, total, length, key), total, folder, length, per_shard)
    return read_back(index, folder, length)
