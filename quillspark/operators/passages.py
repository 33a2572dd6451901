"""Search hits where the chunks lie: a block of queries goes to every task, and only what answers one of them leaves it.

Nothing is written for a chunk or for a pair that doesn't pass, and no chunk is moved. Statistics are one pass over the chunks;
another finds each query's candidates, and only these are looked through for what profiles seek and scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions.profile import Passage, Sought, count_evidence, terms_form
from quillspark.functions.tokens import Counted
from quillspark.operators.retrieval import B, K1

#: So many chunks are worked on at once.
CHUNKS_AT_ONCE = 1024

STEM = re.compile(r"^.*/"), re.compile(r"\.[^.]*$")


def stem_of(path: str | None) -> str:
    return STEM[1].sub("", STEM[0].sub("", path or ""))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Slices with the (text, heading, stem) of their rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, CHUNKS_AT_ONCE):
            some = batch.slice(start, CHUNKS_AT_ONCE)
            own = [some.column(some.schema.get_field_index(c)).to_pylist() for c in ("text", "heading", "doc_path")]
            yield some, [(t, h or "", stem_of(p)) for t, h, p in zip(*own)]


def statistics(chunks: DataFrame, terms: list[str]) -> tuple[np.ndarray, int, int]:
    """(document frequencies of terms, number of chunks, sum of lengths): one pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, df, n, total = Counted(terms), Counter(), 0, 0
        for _, rows in rows_of(batches):
            for text, heading, stem in rows:
                met, dl = counted.chunk(text or "", heading, stem)
                df.update(met.keys())
                n, total = n + 1, total + dl
        yield pa.RecordBatch.from_arrays([pa.array([*df, -1, -2], pa.int64()), pa.array([*df.values(), n, total], pa.int64())], names=["term", "n"])

    # a row for each asked term
    rows = chunks.select("text", "heading", "doc_path").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return np.array([found.get(i, 0) for i in range(len(terms))], dtype=np.int64), found.get(-1, 0), found.get(-2, 0)


def drawn(terms: dict[str, int], df: dict[str, int], n: int, soft_cap: int, most: int = 48, floor: int = 800, share: float = 0.12, fallback: int = 24) -> list[str]:
    """Of a query's terms those that candidates are drawn from: retrieval.rare_terms() and capped() of one query."""
    known = sorted(((df[t] > max(floor, int(n * share)), df[t], t) for t in terms if df.get(t)))
    usual = [x for x in known if not x[0]]
    out, before = [], 0
    for _, each, term in usual[:most] if usual else known[:fallback]:
        if before >= soft_cap:
            break
        out.append(term)
        before += each
    return out


def hits(profiled: DataFrame, chunks: DataFrame, soft_cap: int) -> DataFrame:
    """(query_id, chunk_key, doc_path, chunk_id, text, same, contents, score, matched_terms): all candidates that answer a query.

    profiled: a block of queries (query_id, p); chunks: chunk_key, doc_path, chunk_id, heading, text. text is given for lists
    of contents alone.
    """
    # a block of queries, as those of profiles()
    asked = profiled.where("query_id IS NOT NULL").select("query_id", "p").collect()
    ids, profiles = [r["query_id"] for r in asked], [r["p"].asDict(recursive=True) for r in asked]
    low = lambda p: [t.lower() for f in ("proper_terms", "mandatory_terms", "quantity_required") for t in p[f]]
    sought = [dict.fromkeys([*p["lexical_terms"], *low(p)]) for p in profiles]
    terms = sorted({t for own in sought for t in own})
    number = {t: i for i, t in enumerate(terms)}
    df, n, total = statistics(chunks, terms)
    known, mean = dict(zip(terms, df.tolist())), total / max(n, 1)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5)).tolist()
    lexical = [frozenset(number[t] for t in p["lexical_terms"]) for p in profiles]
    seekers: dict[int, list[int]] = {}
    for q, own in enumerate(sought):
        for t in drawn(own, known, n, soft_cap):
            seekers.setdefault(number[t], []).append(q)

    kind, key_kind, place_kind = (to_arrow_type(d.schema[c].dataType) for d, c in ((profiled, "query_id"), (chunks, "chunk_key"), (chunks, "chunk_id")))
    fields = [("query_id", kind), ("chunk_key", key_kind), ("doc_path", pa.string()), ("chunk_id", place_kind), ("text", pa.string()), ("same", pa.int64()), ("contents", pa.bool_()), ("score", pa.float64()), ("matched_terms", pa.list_(pa.string()))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted, seeks = Counted(terms), [Sought(p) for p in profiles]
        for some, rows in rows_of(batches):
            keys, paths, places = (some.column(some.schema.get_field_index(c)).to_pylist() for c in ("chunk_key", "doc_path", "chunk_id"))
            out = []
            for at, (text, heading, stem) in enumerate(rows):
                met, dl = counted.chunk(text or "", heading, stem)
                queries = {q for t in met.keys() & seekers.keys() for q in seekers[t]}
                if not queries:
                    continue
                passage = Passage(terms_form.__wrapped__(" ".join((text or "", heading, stem))), text or "", heading, stem)
                contents = passage.is_contents
                length, whole = K1 * (1 - B + B * dl / mean), None
                part = {t: idf[t] * tf * (K1 + 1) / (tf + length) for t, tf in met.items()}
                same = 42 if text is None else signed(xxhash.xxh64_intdigest(text, 42))
                for q in queries:
                    base = sum([part[t] for t in sorted(lexical[q] & part.keys())])
                    count = 0.0
                    if profiles[q]["is_quantity"] and text is not None:
                        whole = whole or terms_form.__wrapped__(f"{text} {heading}")
                        count = count_evidence(profiles[q], whole)
                    made = seeks[q].scored(passage, contents, base, count)
                    if made and made[0] > 0:
                        out.append((ids[q], keys[at], paths[at], places[at], text if contents else None, same, contents, *made))
            for start in range(0, len(out), 8192):
                columns = list(zip(*out[start : start + 8192]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields)], names=[c for c, _ in fields])

    shape = f"query_id {profiled.schema['query_id'].dataType.simpleString()}, chunk_key {chunks.schema['chunk_key'].dataType.simpleString()}, doc_path string, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, text string, same long, contents boolean, score double, matched_terms array<string>"
    return chunks.select("chunk_key", "doc_path", "chunk_id", "heading", "text").mapInArrow(search, shape)
