"""Benchmark decontamination by winnowing.

A text's k-grams of words are hashed, and of every window of w consecutive hashes the least is kept (the rightmost of
equals). Any span of at least w + k - 1 words that two texts share has a kept hash in both, at the same place of the span.
Here k = 5 and w = 6, so every run of SPAN = 10 shared words is found. The kept hashes of the documents are joined with
those of the benchmark; each hit is then extended: the runs of ten words around it are compared as text. Items shorter
than SPAN, but not empty, are one run of their own length, whose k-gram is the whole item.

The benchmark's hashes also fill a bit table of fixed size, which goes to all executors; a document's hash that isn't in
the table can't join and stays where it is. However full the table gets, the join decides.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. Null and empty texts have no words,
no hits and no items. Rows are told apart by place, so repeated doc_ids and item_ids each count for themselves; an item
listed twice counts once in n_items.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import TABLE_BITS, held_by, small_batches, table_of, unpacked, written

SPAN, K, W = 10, 5, 6
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def gram_hashes(words: list[bytes], k: int, known: dict[bytes, int]) -> np.ndarray:
    """A hash of every run of k words; known keeps the words' own hashes."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    try:
        own = np.array([known[w] for w in words], dtype=np.uint64)
    except KeyError:
        if len(known) > 200_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        own = np.array([known[w] for w in words], dtype=np.uint64)
    n = len(words) - k + 1
    out = own[:n].copy()
    for i in range(1, k):
        out = out * FACTOR + own[i : i + n]
    out ^= out >> np.uint64(31)
    return out * FACTOR


def winnowed(hashes: np.ndarray, w: int) -> np.ndarray:
    """Places of the hashes that are kept: the rightmost least of each window of w (of all, if fewer)."""
    n = len(hashes)
    if n == 0 or w <= 1:
        return np.arange(n)
    w = min(w, n)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)
    return np.unique(np.arange(n - w + 1) + (w - 1 - windows[:, ::-1].argmin(axis=1)))


def item_fingerprints(items: DataFrame) -> DataFrame:
    """(item_id, size, at, hash, run): each kept hash of each item, its place and the item's words; size is the run's length."""

    @F.pandas_udf("struct<words:array<string>,size:int,marks:array<struct<at:int,hash:long>>>")
    def marked(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        for series in texts:
            rows = []
            for text in series:
                words = words_of(text)
                k, w = (K, W) if len(words) >= SPAN else (len(words), 1)
                hashes = gram_hashes(words, k, known) if words else np.zeros(0, dtype=np.uint64)
                kept = winnowed(hashes, w)
                rows.append(([x.decode() for x in words], min(len(words), SPAN), [{"at": int(i), "hash": int(hashes[i].astype(np.int64))} for i in kept]))
            yield pd.DataFrame(rows, columns=["words", "size", "marks"])

    return items.select("item_id", marked(F.col("text")).alias("m")).select("item_id", "m.words", "m.size", F.explode("m.marks").alias("mark")).select("item_id", "words", "size", "mark.at", "mark.hash")


def _around(words: Column, at: Column, size: Column) -> Column:
    """The runs of size words that hold the k-gram at this place: array of struct<start, run>."""
    k = F.least(size, F.lit(K))
    first = F.greatest(F.lit(0), at - size + k)
    last = F.least(at, F.size(words) - size)
    return F.when(first <= last, F.transform(F.sequence(first, last), lambda s: F.struct(s.cast("int").alias("start"), F.array_join(F.slice(words, s + 1, size), " ").alias("run"))))


def runs_of_items(items: DataFrame) -> DataFrame:
    """(hash, size, run, item_id) for every run around every kept hash of the items."""
    marks = item_fingerprints(items)
    return marks.select("item_id", "size", "hash", F.explode(_around(F.col("words"), F.col("at"), F.col("size"))).alias("r")).select("hash", "size", "r.run", "item_id").distinct()


def candidates(docs: DataFrame, table: np.ndarray, sizes: list[int], bits: int) -> DataFrame:
    """Adds _found with n_words and hits (size, start, hash, run): the runs around kept hashes that the table may hold."""
    held = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("struct<n_words:long,hits:array<struct<size:int,start:int,hash:long,run:string>>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen, known = held.value, {}

        def hits(words: list[bytes]) -> list[dict]:
            out = []
            for size in sizes:
                k, w = (K, W) if size == SPAN else (size, 1)
                if len(words) < size:
                    continue
                hashes = gram_hashes(words, k, known)
                kept = winnowed(hashes, w)
                for at in kept[held_by(seen, hashes[kept], bits)].tolist():
                    value = int(hashes[at].astype(np.int64))
                    out += [{"size": size, "start": s, "hash": value, "run": b" ".join(words[s : s + size]).decode()} for s in range(max(0, at - size + k), min(at, len(words) - size) + 1)]
            return out

        for series in texts:
            rows = [(len(words), hits(words)) for words in map(words_of, series)]
            yield pd.DataFrame(rows, columns=["n_words", "hits"])

    return docs.withColumn("_found", found(F.col("text")))


ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _hits(rows: DataFrame, items: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """rows (any columns, text among them) as a written table with _row, n_words and hits instead of text; and the hits that are real.

    The latter are (_row, start, size, item_id). Rows without hits in the table never enter the join.
    """
    small_batches(rows.sparkSession)
    runs = written(runs_of_items(items.select("item_id", "text")), "runs")
    sizes = [r["size"] for r in runs.select("size").distinct().collect()]
    found = candidates(rows, table_of(runs, bits), sorted(sizes), bits)
    kept = [c for c in rows.columns if c != "text"]
    base = written(found.select(F.monotonically_increasing_id().alias("_row"), *kept, "_found.n_words", "_found.hits"), "candidates")
    hits = base.where(F.size("hits") > 0).select("_row", F.explode("hits").alias("h")).select("_row", "h.hash", "h.size", "h.start", "h.run")
    return base, hits.join(runs, ["hash", "size", "run"]).select("_row", "start", "size", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """docs, without its text, with n_words, n_hit, n_items, items_sha256 and contaminated for each row.

    n_hit counts the words inside any run that the document shares with an item; n_items counts the items with such runs
    and items_sha256 is the hex digest of their ids as strings, sorted and joined by commas. Columns of docs that have one
    of these names go.
    """
    others = [c for c in docs.columns if c not in ("text", *ADDED)]
    base, met = _hits(docs.select(F.struct(*others).alias("row") if others else F.struct(F.lit(0)).alias("row"), "text"), items, bits)
    spans = F.array_sort(F.collect_set(F.struct("start", "size")))
    per_doc = met.groupBy("_row").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    # spans in order of start: each adds what lies beyond the furthest end so far
    cover = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a.n + F.greatest(F.lit(0), s.start + s["size"] - F.greatest(a.end, s.start))).alias("n"), F.greatest(a.end, s.start + s["size"]).alias("end")),
        lambda a: a.n.cast("long"),
    )
    per_doc = per_doc.select("_row", cover.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("said"))
    zero = F.lit(0).cast("long")
    told = [
        F.col("n_words"),
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce("n_items", zero).alias("n_items"),
        F.sha2(F.coalesce("said", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    ]
    plain = [F.col("n_words"), zero.alias("n_hit"), zero.alias("n_items"), F.lit(EMPTY_SHA).alias("items_sha256"), F.lit(False).alias("contaminated")]
    own = ["row.*"] if others else []
    moved = base.where(F.size("hits") > 0).drop("hits").join(per_doc, "_row", "left").select(*own, *told)
    return base.where(F.size("hits") == 0).select(*own, *plain).unionByName(moved)


def clean(docs: DataFrame, items: DataFrame, bits: int = TABLE_BITS) -> DataFrame:
    """The rows of docs that share no run with an item, with the columns of docs.

    Texts without hits in the table stay where they are; the others are moved once, to be held against the real hits.
    """
    base, met = _hits(docs.select(F.struct("*").alias("row"), "text"), items, bits)
    suspects = base.where(F.size("hits") > 0).join(met.select("_row").distinct(), "_row", "left_anti")
    return unpacked(base.where(F.size("hits") == 0).select("row").unionByName(suspects.select("row")))
