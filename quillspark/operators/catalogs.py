"""Scores of catalog entries where they lie: a block of queries goes to every task, and only what may be among the best leaves it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.functions.profile import CATALOG_ANCHOR, CATALOG_HIDDEN, CATALOG_SCORES, CATALOG_SHARED, CATALOG_TITLE, LATIN, Finder, ngrams, passage_of
from quillspark.operators.passages import stem_of
from quillspark.operators.scoring import CELLS, WAITING

#: At most so many hits of a document.
PER_DOC = 3


class Postings:
    """Items (terms or ids) with the queries that seek each, and what it is worth to them."""

    def __init__(self, rows: dict[tuple, tuple], width: int):
        self.width, items = width, sorted({i for i, _ in rows})
        self.number = number = {x: n for n, x in enumerate(items)}
        order = sorted((number[i], q, *worth) for (i, q), worth in rows.items())
        self.queries = np.array([r[1] for r in order], dtype=np.int64)
        self.worth = np.array([r[2:] for r in order], dtype=np.float64).reshape(len(order), -1)
        self.starts = np.searchsorted(np.array([r[0] for r in order], dtype=np.int64), np.arange(len(items) + 1))

    def met(self, lists: list) -> tuple[np.ndarray, np.ndarray]:
        """(cell, posting) for all items of the lists and the queries that seek them; a cell is list * queries + query."""
        own = [[self.number[x] for x in some if x in self.number] for some in lists]
        row, item = np.repeat(np.arange(len(own)), [len(some) for some in own]), np.array([i for some in own for i in some], dtype=np.int64)
        each = self.starts[item + 1] - self.starts[item]
        place = np.repeat(np.arange(len(item)), each)
        posting = self.starts[item][place] + np.arange(len(place)) - np.repeat(np.cumsum(each) - each, each)
        return row[place] * self.width + self.queries[posting], posting


class Kept:
    """Of each query the first PER_DOC hits of a document and of these the first k; rows beyond WAITING are cut to them."""

    def __init__(self, k: int, width: int):
        self.k, self.floor, self.rows = k, np.full(width, -np.inf), []
        self.waiting, self.after = 0, WAITING

    def add(self, row: dict, entries: pa.RecordBatch) -> None:
        # matched terms, then the score to six places
        row |= {"worth": row["matched"] * 1e6 + np.round(row["score"], 6)}
        fit = row["worth"] >= self.floor[row["query"]]
        row = {c: v[fit] for c, v in row.items()}
        used, at = np.unique(row.pop("entry"), return_inverse=True)
        self.rows.append((row | {"entry": at}, entries.take(pa.array(used))))
        self.waiting += len(at)
        if self.waiting > self.after:
            self.cut()

    def cut(self) -> tuple[dict, pa.Table] | None:
        if not self.rows:
            return None
        entries = pa.Table.from_batches([e for _, e in self.rows])
        base = np.cumsum([0, *(e.num_rows for _, e in self.rows)])
        row = {c: np.concatenate([r[c] for r, _ in self.rows]) for c in self.rows[0][0] if c != "entry"}
        entry = np.concatenate([r["entry"] + b for (r, _), b in zip(self.rows, base)]).astype(np.int64)
        of = lambda c: entries.column(c).to_numpy()[entry]
        paths = {p: n for n, p in enumerate(sorted(set(entries.column("doc_path").to_pylist())))}
        doc = np.array([paths[p] for p in entries.column("doc_path").to_pylist()], dtype=np.int64)[entry]
        by = np.lexsort((of("_key"), doc, -of("depth"), -of("level"), -row["worth"], row["query"]))
        of_doc = np.lexsort((np.arange(len(by)), doc[by], row["query"][by]))
        pair = row["query"][by][of_doc] * (len(paths) + 1) + doc[by][of_doc]
        by = by[np.sort(of_doc[np.arange(len(pair)) - np.searchsorted(pair, pair) < PER_DOC])]
        query = row["query"][by]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        last = by[nth == self.k - 1]
        self.floor[row["query"][last]] = row["worth"][last]
        by = by[nth < self.k]
        used, at = np.unique(entry[by], return_inverse=True)
        row, entries = {c: v[by] for c, v in row.items()} | {"entry": at}, entries.take(pa.array(used)).combine_chunks()
        self.rows = [(row, batch) for batch in entries.to_batches()[:1]]
        self.waiting = len(at)
        self.after = self.waiting + WAITING
        return row, entries


def features(x: str) -> set[str]:
    """The words, numbers and n-grams of Chinese characters of a normal text."""
    words = set(LATIN.findall(x.lower()))
    return words if x.isascii() else words.union(ngrams(x))


def best(profiled: DataFrame, entries: DataFrame, k: int, seek: list[tuple[str, str, int]]) -> DataFrame:
    """(query_id, _key, doc_path, section_path, level, score, matched): hits among which are the k best of each query, at most PER_DOC of a document.

    entries: _key, doc_path, section_path, level, bonus, _title (all that is shown of it), heading, text; seek is what profiles
    look for. A hit shares a term of the title or the text; a query with anchors takes only entries that have one. A task gives at most k rows for each query.
    """
    fields = ["lexical_terms", "proper_terms", "mandatory_terms", "high_value_terms", "anchor_ids", "invoice_ids", *(f for f, _ in CATALOG_SCORES)]
    # a block of queries, as those of profiles()
    asked = profiled.select("query_id", *(F.col("p")[f].alias(f) for f in dict.fromkeys(fields))).where("query_id IS NOT NULL").collect()
    ids = [r["query_id"] for r in asked]
    width = max(len(ids), 1)
    terms = {(t, q): () for q, r in enumerate(asked) for f in fields[:4] for t in r[f]}
    sought: dict[tuple, list] = {}
    for q, r in enumerate(asked):
        for f, worth in (*CATALOG_SCORES, ("anchor_ids", 0.0), ("invoice_ids", 0.0)):
            for i in r[f]:
                own = sought.setdefault((i, q), [0.0, 0, 0, 0])
                own[0] += worth
                for n, field in enumerate(("keyword_ids", "anchor_ids", "invoice_ids"), 1):
                    own[n] = max(own[n], int(f == field))
    anchors, invoices = (np.array([len(r[f]) for r in asked] or [0]) for f in ("anchor_ids", "invoice_ids"))
    proper: dict[str, list[int]] = {}
    for q, r in enumerate(asked):
        for t in r["proper_terms"]:
            proper.setdefault(t, []).append(q)
    id_kind, id_name = to_arrow_type(profiled.schema["query_id"].dataType), profiled.schema["query_id"].dataType.simpleString()
    names = ["query_id", "_key", "doc_path", "section_path", "level", "score", "matched"]
    shape = f"query_id {id_name}, _key long, doc_path string, section_path array<string>, level int, score double, matched long"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, by_id = Postings(terms, width), Postings({k: tuple(v) for k, v in sought.items()}, width)
        finder, kept, tree = Finder(seek), Kept(k, width), ahocorasick.Automaton()
        for t, queries in proper.items():
            tree.add_word(t, queries)
        if len(tree):
            tree.make_automaton()
        most = max(1, min(1024, CELLS // width))
        for batch in batches:
            for start in range(0, batch.num_rows, most):
                some = batch.slice(start, most)
                of = lambda c: some.column(some.schema.get_field_index(c))  # noqa: E731, B023
                cells = some.num_rows * width
                texts, headings, paths = (of(c).to_pylist() for c in ("text", "heading", "doc_path"))
                titles = [unicodedata.normalize("NFKC", x or "") for x in of("_title").to_pylist()]
                shown, hidden = by_term.met([features(x) for x in titles])[0], by_term.met([features(unicodedata.normalize("NFKC", x or "")) for x in texts])[0]
                n_shown, n_hidden = np.bincount(shown, minlength=cells), np.bincount(hidden, minlength=cells)
                cell, posting = by_id.met([finder.ids(passage_of(t or "", h or "", stem_of(p))) for t, h, p in zip(texts, headings, paths)])
                worth, key, anchor, invoice = (np.bincount(cell, weights=by_id.worth[posting, n] if len(by_id.worth) else None, minlength=cells) for n in range(4))
                titled = np.zeros(cells, dtype=bool)
                # a proper term counts for the title in its own case alone, titles being folded
                for d, title in enumerate(titles if len(tree) else ()):
                    for _, queries in tree.iter(title.lower()):
                        titled[[d * width + q for q in queries]] = True
                hit = np.flatnonzero(n_shown + n_hidden)
                entry, query = hit // width, hit % width
                by_invoice = (anchors[query] > 0) & (invoices[query] > 0) & (invoice[hit] == invoices[query])
                anchored = np.where(anchor[hit] > 0, anchor[hit], by_invoice)
                base = CATALOG_SHARED * n_shown[hit] + CATALOG_HIDDEN * n_hidden[hit] + worth[hit]
                score = base + of("bonus").to_numpy(zero_copy_only=False)[entry] + CATALOG_ANCHOR * anchored + np.where(titled[hit], CATALOG_TITLE, 0.0)
                fit = ((anchors[query] == 0) | (anchored > 0)) & (score > 0)
                kept.add({"entry": entry[fit], "query": query[fit], "score": score[fit], "matched": key[hit][fit]}, some.select(["_key", "doc_path", "section_path", "level", "depth"]))
        made = kept.cut()
        if made:
            row, found = made
            found = found.take(pa.array(row["entry"]))
            columns = [pa.array([ids[q] for q in row["query"]], id_kind), *(found.column(c).combine_chunks() for c in names[1:5]), pa.array(row["score"]), pa.array(row["matched"].astype(np.int64))]
            yield from pa.Table.from_arrays(columns, names=names).to_batches(max_chunksize=8192)

    depth = F.size("section_path").alias("depth")
    return entries.select("_key", "doc_path", "section_path", F.coalesce("level", F.lit(0)).cast("int").alias("level"), depth, "bonus", "_title", "heading", "text").mapInArrow(search, shape)
