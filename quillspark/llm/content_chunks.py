"""Document fingerprints from content-defined chunks.

A gear hash rolls over the text's UTF-8 bytes; a place whose hash has zeros under a mask ends a chunk. Boundaries are
normalised: a strict mask before the usual chunk length, a loose one after it, with a least and a greatest length. As the
hash at a place depends on the last few bytes only, an insertion moves the boundaries near it and no others. A
fingerprint is the set of chunk digests, each with the total length of its chunks; containment of one text in another is
the share of its bytes in chunks whose digests the other has too, counted as often as both have them.

Null texts count as empty. The empty text has the empty fingerprint; two empty fingerprints are alike (1.0), an empty and
another are not (0.0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import batches, partitions, small_batches

LEAST, USUAL, MOST = 12, 32, 128
STRICT, LOOSE = 0x3F << 4, 0xF << 4
SEED = 20240229


@lru_cache(maxsize=1)
def gear() -> np.ndarray:
    """A number for each byte: the low half of XXH64 (seed SEED) of the byte. Stored fingerprints depend on it."""
    return np.array([xxhash.xxh64_intdigest(bytes([i]), SEED) & 0xFFFFFFFF for i in range(256)], dtype=np.uint32)


def gear_hash(raw: bytes) -> np.ndarray:
    """At each byte the sum of the table's values for the last 32 bytes, each shifted by its distance, modulo 2**32."""
    h = gear()[np.frombuffer(raw, dtype=np.uint8)]
    width = 1
    while width < 32:
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(raw: bytes, least: int = LEAST, usual: int = USUAL, most: int = MOST) -> list[int]:
    """Where chunks end, exclusive; the last is the text's length."""
    n, out, start = len(raw), [], 0
    if not n:
        return out
    h = gear_hash(raw)
    # a place is where the next chunk starts: one after the byte whose hash fits; n stands for none
    places = np.arange(1, n + 1)
    following = []
    for mask in (STRICT, LOOSE):
        fits = np.where(h & np.uint32(mask) == 0, places, n)
        following.append(np.minimum.accumulate(fits[::-1])[::-1].tolist())
    strict, loose = following
    while start < n:
        if n - start <= least:
            end = n
        else:
            end = strict[start + least - 1]
            if end > start + usual:
                end = loose[min(start + usual, n) - 1]
            end = min(end, start + most, n)
        out.append(end)
        start = end
    return out


def fingerprint(text: str | None) -> dict[int, int]:
    """Digest of chunk (40 bits) to the bytes in such chunks."""
    raw, out, start = (text or "").encode(), {}, 0
    digest = xxhash.xxh3_64_intdigest
    for end in cuts(raw):
        key = digest(raw[start:end]) >> 24
        out[key] = out.get(key, 0) + end - start
        start = end
    return out


def as_text(marks: dict[int, int]) -> str:
    """Base64 of the digests in order, 5 bytes each with 5 bytes of length."""
    if not marks:
        return ""
    keys = np.fromiter(marks.keys(), dtype=np.uint64, count=len(marks))
    sizes = np.fromiter(marks.values(), dtype=np.uint64, count=len(marks))
    order = np.argsort(keys)
    packed = np.empty((len(keys), 10), dtype=np.uint8)
    packed[:, :5] = keys[order].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    packed[:, 5:] = sizes[order].astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    return base64.b64encode(packed.tobytes()).decode()


def from_text(said: str) -> dict[int, int]:
    raw = base64.b64decode(said)
    return {int.from_bytes(raw[i : i + 5], "big"): int.from_bytes(raw[i + 5 : i + 10], "big") for i in range(0, len(raw), 10)}


def containment(one: dict[int, int], other: dict[int, int]) -> float:
    """The share of one's bytes that lie in chunks which other has too."""
    if not one:
        return float(not other)
    return sum(min(n, other[k]) for k, n in one.items() if k in other) / sum(one.values())


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many code points from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Every document once, in order of descending doc_id, each followed by the next one: (bucket, carried, doc_id, text).

    Buckets are ranges of doc_id. A bucket also holds, as carried rows, the first document of the range below it (of the
    highest range for the lowest), so that the last of its own documents has its neighbour at hand; these are a row for
    each bucket, whatever the size of the table. One shuffle moves every text once. Ties of doc_id go by text; a null
    doc_id counts as lower than all others.
    """
    small_batches(docs.sparkSession)
    n = partitions(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # a null doc_id is of the lowest range, and is told apart from the least long there
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    points = sorted({int(x) for x in ids.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    bucket = _bucket(key, points)
    tops = sorted((r["bucket"], r["top"]) for r in ids.groupBy(_bucket(F.col("key"), points).alias("bucket")).agg(F.max("key").alias("top")).collect())
    rows = F.array(F.struct(bucket.cast("int").alias("bucket"), F.lit(False).alias("carried")))
    if tops:
        # the highest document of a range also goes to the next range above it that has any, that of the highest to the lowest
        above = {at: tops[(i + 1) % len(tops)][0] for i, (at, _) in enumerate(tops)}
        top = {at: key for at, key in tops}
        last = tops[-1][0] + 1
        by_bucket = lambda known: F.element_at(F.lit([known.get(i) for i in range(last)]), bucket.cast("int") + 1)
        also = F.struct(by_bucket(above).cast("int").alias("bucket"), F.lit(True).alias("carried"))
        rows = F.when(by_bucket(top) == key, F.concat(rows, F.array(also))).otherwise(rows)
    dealt = docs.select("doc_id", "text", F.explode(rows).alias("_at")).select("_at.bucket", "_at.carried", "doc_id", "text")
    return dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "carried", F.desc_nulls_last("doc_id"), "text")


def _bucket(key, points: list[int]):
    """How many of the sorted points are below key, by two steps of about the root of their number."""
    if not points:
        return F.lit(0)
    step = max(1, round(len(points) ** 0.5))
    heads = points[::step]
    coarse = F.size(F.filter(F.array(*map(F.lit, heads)), lambda p: p < key))
    fine = F.array(*(F.array(*map(F.lit, points[i : i + step])) for i in range(0, len(points), step)))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(coarse, F.lit(1))), lambda p: p < key))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + inside)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints every text and its edited text, and tells how far it is contained in that and in the next document's.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for each row of
    docs. The next document is that of the next lower doc_id, for the lowest the highest; a sole document is its own.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, place, open_ = None, None, False
        for part in parts:
            columns = [part.column(i) for i in range(4)]
            for i in range(part.num_rows):
                bucket, carried, doc_id, text = (c[i].as_py() for c in columns)
                if bucket != place:
                    held, place, open_ = None, bucket, True
                if not open_:
                    continue
                marks = fingerprint(text)
                if held is not None:
                    yield compared(*held, text, marks)
                held, open_ = (doc_id, text, marks), not carried
                if carried:
                    held = None

    def compared(doc_id: int, text: str, marks: dict, following: str, next_marks: dict) -> tuple:
        other = edited(text, following)
        others = fingerprint(other)
        return doc_id, len(text), hashlib.sha256(other.encode()).hexdigest(), as_text(marks), as_text(others), containment(marks, others), containment(marks, next_marks)

    return with_neighbours(docs).mapInArrow(lambda parts: batches(rows(parts), OUT), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
