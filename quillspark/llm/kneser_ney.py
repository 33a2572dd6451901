"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are the characters of a text whose runs of white space are one space; a word that repeats the word
before it is, with the space before it, one symbol of its own (REPEAT), so that stuttering text is as improbable as it is rare in trusted text. The
counts of all trusted documents' n-grams are gathered, as many as there are, and joined with the counts of their contexts
and of their shorter forms to give probabilities and back-off weights. A document's perplexity is then the exponential of
the mean surprise of its symbols.

Texts aren't moved, at any size of corpus or model. One pass over them counts the n-grams of each block of documents
(blocks.py): for each n-gram that a block has, how often the block's trusted documents have it. The sums over blocks make
the model; the n-grams that occur anywhere are joined with it, order by order; and each block gets the log probabilities
of its own n-grams back, with which a second pass scores the texts. What is shuffled is a row for each n-gram of a block.

A document is rejected if its perplexity is above the threshold of its language: the QUANTILE of the trusted documents'
perplexities in that language (the least value that this share of them doesn't exceed, exactly) times MARGIN. A language
without trusted documents (null counts as one) has the threshold of all trusted documents together; without any, nothing
is rejected. Null and empty texts have no perplexity and stay. A document that labels call both good and bad is trusted;
repeated rows of a document each count. A null doc_id is never trusted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.blocks import Side, deliver, shard_of, with_block
from quillspark.llm.shared import batches, small_batches, unpacked, written

ORDER = 4
START, END, REPEAT = "\x02", "\x03", "\x01"
QUANTILE, MARGIN = 0.995, 1.25
#: Symbols that are worked on at once, and n-grams that a task holds before it passes them on; they bound a worker's
#: memory, not what counts.
BLOCK, HELD = 1 << 20, 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def symbols(text: str | None) -> str:
    """The text as the model sees it, without start marks; empty if it has no words."""
    words = (text or "").split()
    if not words:
        return ""
    return "".join([words[0], *(REPEAT if w == p else " " + w for p, w in zip(words, words[1:]))]) + END


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _keys(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k symbols."""
    n = len(codes) - k + 1
    out = np.full(max(n, 0), (k + 1) * 0x51_7CC1_B727_2205 & ((1 << 64) - 1), dtype=np.uint64)
    for i in range(k):
        out = (out ^ codes[i : i + n]) * FACTOR
        out ^= out >> np.uint64(29)
    return out


def _blocks(texts: Iterable[str], size: int = BLOCK) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, with start marks, in groups of about size symbols; a longer one comes in pieces that overlap by a context."""
    places, held, total = [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        text = START * (ORDER - 1) + text
        for at in range(0, len(text) - ORDER + 1, size):
            piece = text[at : at + size + ORDER - 1]
            places.append(i)
            held.append(piece)
            total += len(piece)
            if total >= size:
                yield places, held
                places, held, total = [], [], 0
    if held:
        yield places, held


COUNTS = pa.schema([("block", pa.int64()), ("gram", pa.string()), ("key", pa.int64()), ("n", pa.int64())])
COUNTS_SQL = "block long, gram string, key long, n long"


class Counted:
    """The n-grams of some texts: their keys, their symbols' codes and how often trusted texts have them."""

    def __init__(self) -> None:
        self.keys, self.codes, self.n = np.zeros(0, dtype=np.uint64), np.zeros((0, ORDER), dtype=np.uint32), np.zeros(0, dtype=np.int64)

    def add(self, texts: list[str], trusted: bool) -> None:
        for _, held in _blocks(texts):
            codes = _codes("".join(held))
            keys = _keys(codes, ORDER)
            # runs that cross from one piece to the next aren't n-grams
            ends = np.cumsum([len(x) for x in held])[:-1]
            keep = np.ones(len(keys), dtype=bool)
            for back in range(1, ORDER):
                keep[np.clip(ends - back, 0, len(keys) - 1)] = False
            places = np.flatnonzero(keep)
            found, first, n = np.unique(keys[places], return_index=True, return_counts=True)
            own = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[places[first]].astype(np.uint32)
            self._merge(found, own, n if trusted else np.zeros(len(n), dtype=np.int64))

    def _merge(self, keys: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
        both = np.concatenate([self.keys, keys])
        self.keys, first, place = np.unique(both, return_index=True, return_inverse=True)
        self.codes = np.concatenate([self.codes, codes])[first]
        self.n = np.bincount(place, weights=np.concatenate([self.n, n]), minlength=len(self.keys)).astype(np.int64)

    def rows(self, block: int) -> Iterator[tuple]:
        said = self.codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for i, (key, n) in enumerate(zip(self.keys.view(np.int64).tolist(), self.n.tolist())):
            yield block, said[i * ORDER : (i + 1) * ORDER], key, n


def _stretches(block: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of rows of one block."""
    edges = (np.flatnonzero(np.diff(block)) + 1).tolist()
    yield from ((a, b) for a, b in zip([0, *edges], [*edges, len(block)]) if b > a)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def count_grams(rows: DataFrame, good: Side) -> DataFrame:
    """(block, gram, key, n) for rows (row, block): each n-gram of a block and how often its documents in good have it."""

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, held = None, Counted()
        for part in parts:
            texts, block, shard, doc_id = part.column(0), *(_numbers(part.column(i)) for i in (1, 2, 3))
            known = ~np.asarray(part.column(3).is_null())
            for a, b in _stretches(block):
                if now is not None and (now != block[a] or len(held.keys) > HELD):
                    yield from held.rows(now)
                    held = Counted()
                now = int(block[a])
                trusted = known[a:b] & np.isin(doc_id[a:b], good.arrays(int(shard[a]), now)[0])
                said = [symbols(t) for t in texts.slice(a, b - a).to_pylist()]
                for kind in (True, False):
                    held.add([t for t, y in zip(said, trusted.tolist()) if y == kind], kind)
        if now is not None:
            yield from held.rows(now)

    asked = rows.select("row.text", "block", shard_of(F.col("block"), good.shards).alias("shard"), "row.doc_id")
    made = asked.mapInArrow(lambda parts: batches(counted(parts), COUNTS, most=65536), COUNTS_SQL)
    return written(made.groupBy("block", "gram").agg(F.first("key").alias("key"), F.sum("n").alias("n")), "counts")


def _discounts(table: DataFrame) -> list[float]:
    n = [0, *(table.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first())]
    usual = [0.0, 0.5, 1.0, 1.5]
    if not n[1] or not n[2]:
        return usual
    y = n[1] / (n[1] + 2 * n[2])
    found = [0.0] + [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else usual[k] for k in (1, 2, 3)]
    return [min(max(d, 0.0), float(k)) if d > 0 else usual[k] for k, d in enumerate(found)]


def model_of(counts: DataFrame) -> DataFrame:
    """(gram, logp, logback) from counts (gram, n): log probabilities of n-grams of all orders and back-off weights of contexts.

    The empty gram's logp is that of an unknown symbol before its back-off weight. Each order is built by joins of its
    counts with the sums of their contexts and with the next lower order, all shuffled by n-gram.
    """
    tables = {ORDER: written(counts.where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")), "grams")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")), "grams")
    known = tables[1].count()
    lower = None
    grams, backs = [], []
    for k in range(1, ORDER + 1):
        d = _discounts(tables[k])
        cut = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
        table = tables[k].withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        sums = table.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("freed")).withColumn("back", F.col("freed") / F.col("total"))
        backs.append(sums.select(F.col("context").alias("gram"), F.log("back").alias("logback")))
        table = table.join(sums, "context").select("gram", ((F.col("n") - cut) / F.col("total")).alias("own"), "back")
        if lower is None:
            table = table.withColumn("p", F.col("own") + F.col("back") / (known + 1))
        else:
            table = table.withColumn("shorter", F.expr("substring(gram, 2)")).join(lower.toDF("shorter", "ps"), "shorter").withColumn("p", F.col("own") + F.col("back") * F.col("ps"))
        lower = table.select("gram", "p")
        grams.append(lower.select("gram", F.log("p").alias("logp")))
    all_grams, all_backs = grams[0], backs[0]
    for g, b in zip(grams[1:], backs[1:]):
        all_grams, all_backs = all_grams.unionAll(g), all_backs.unionAll(b)
    unknown = counts.sparkSession.range(1).select(F.lit("").alias("gram"), F.lit(-math.log(known + 1)).alias("logp"))
    return written(all_grams.unionAll(unknown).join(all_backs, "gram", "full"), "model")


def log_probabilities(grams: DataFrame, model: DataFrame) -> DataFrame:
    """(gram, value) for grams (gram) of the highest order: the log probability of the last symbol after those before it."""
    found = grams.select("gram").distinct()
    for k in range(ORDER, 0, -1):
        logp = model.where(F.col("logp").isNotNull()).select(F.col("gram").alias(f"g{k}"), F.col("logp").alias(f"p{k}"))
        back = model.where(F.col("logback").isNotNull()).select(F.col("gram").alias(f"c{k}"), F.col("logback").alias(f"b{k}"))
        found = found.withColumn(f"g{k}", F.expr(f"substring(gram, {ORDER - k + 1})")).join(logp, f"g{k}", "left")
        found = found.withColumn(f"c{k}", F.expr(f"substring(gram, {ORDER - k + 1}, {k - 1})")).join(back, f"c{k}", "left")
    # one row, the unknown symbol's
    worth = F.lit(model.where("gram = ''").select("logp").first()["logp"])
    for k in range(1, ORDER + 1):
        worth = F.coalesce(F.col(f"p{k}"), F.coalesce(F.col(f"b{k}"), F.lit(0.0)) + worth)
    return found.select("gram", worth.alias("value"))


class Lookup:
    """An open-addressing table from keys to numbers."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.view(np.uint64)
        self.mask = np.uint64((1 << max(4, (4 * len(keys)).bit_length())) - 1)
        self.keys, self.values = np.zeros(int(self.mask) + 1, dtype=np.uint64), np.full(int(self.mask) + 1, np.nan)
        left, step = np.arange(len(keys)), np.uint64(0)
        while len(left):
            at = ((keys[left] >> np.uint64(7)) + step) & self.mask
            free = np.isnan(self.values[at])
            self.keys[at[free]], self.values[at[free]] = keys[left[free]], values[left[free]]
            left = left[self.keys[at] != keys[left]]
            step += np.uint64(1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' numbers; a key that isn't there is an error."""
        at = (keys >> np.uint64(7)) & self.mask
        out = self.values[at]
        left, step = np.flatnonzero(self.keys[at] != keys), np.uint64(1)
        while len(left):
            at = ((keys[left] >> np.uint64(7)) + step) & self.mask
            out[left] = self.values[at]
            left = left[self.keys[at] != keys[left]]
            step += np.uint64(1)
        if np.isnan(out).any():
            raise ValueError("a block lacks an n-gram of its own texts")
        return out


def _totals(texts: list[str | None], table: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """The sum of log probabilities and the number of symbols of each text."""
    totals, sizes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
    for places, held in _blocks(map(symbols, texts)):
        keys, start = _keys(_codes("".join(held)), ORDER), 0
        for place, piece in zip(places, held):
            n = len(piece) - ORDER + 1
            totals[place] += table.find(keys[start : start + n]).sum()
            sizes[place] += n
            start += len(piece)
    return totals, sizes


def with_perplexity(rows: DataFrame, sides: Side) -> DataFrame:
    """rows (row, block) with score: struct<perplexity double, bits long>, bits being the double's own, in its order."""

    @F.pandas_udf("perplexity double, bits long")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        now, table = None, None
        for texts, block, shard in parts:
            out = np.full(len(texts), np.nan)
            place = block.to_numpy()
            for a, b in _stretches(place):
                if now != place[a]:
                    now, table = place[a], Lookup(*sides.arrays(int(shard.iloc[a]), int(place[a])))
                totals, sizes = _totals(list(texts.iloc[a:b]), table)
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[a:b] = np.where(sizes > 0, np.exp(-totals / sizes), np.nan)
            bits = pd.Series(out.view(np.int64), dtype="Int64").mask(np.isnan(out))
            yield pd.DataFrame({"perplexity": out, "bits": bits})

    return rows.withColumn("score", scored("row.text", "block", shard_of(F.col("block"), sides.shards)))


def order_statistic(values: DataFrame, share: float) -> DataFrame:
    """(kind, bits) for values (kind, bits): the least value of each kind that this share of them doesn't exceed.

    Exact, whatever the partitioning: four rounds, each of which counts the next 16 bits of those values that begin as the
    one looked for, so a round's sums are at most 65,536 rows for each kind.
    """
    state = written(values.groupBy("kind").agg(F.greatest(F.lit(1), F.ceil(F.count("*") * share)).cast("long").alias("rank")).withColumn("start", F.lit(0).cast("long")), "ranks")
    for shift in (48, 32, 16, 0):
        same = F.lit(True) if shift == 48 else F.shiftrightunsigned("bits", shift + 16) == F.col("start")
        digit = F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit(0xFFFF)).alias("digit")
        counts = values.join(state, "kind").where(same).groupBy("kind", digit).agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("kind").orderBy("digit")))
        hit = upto.join(state, "kind").where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        state = written(hit.select("kind", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), (F.shiftleft("start", 16) + F.col("digit")).alias("start")), "ranks")
    return state.select("kind", F.col("start").alias("bits"))


def good_ids(labels: DataFrame) -> DataFrame:
    """The ids of documents that labels call good (quality 1)."""
    return labels.where("quality = 1").select("doc_id").distinct()


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, score) for every row of docs, under the model of those that labels call good."""
    small_batches(docs.sparkSession)
    rows = with_block(docs)
    # ids alone are moved to learn which documents are trusted
    known = rows.select("block", F.col("row.doc_id").alias("doc_id")).join(good_ids(labels).hint("merge"), "doc_id", "left_semi")
    good = deliver(known.distinct().select("block", F.col("doc_id").alias("key"), F.lit(0.0).alias("value")), "good")
    counts = count_grams(rows, good)
    values = log_probabilities(counts, model_of(counts))
    sides = deliver(counts.select("block", "gram", "key").join(values, "gram").select("block", "key", "value"), "values")
    return with_perplexity(rows, sides).drop("block")


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, margin: float, whole: bool) -> DataFrame:
    """(row, score, threshold, keep); row is the caller's if whole, else doc_id and lang."""
    rows = scored(docs, labels)
    # a written table, so that texts are scored once
    rows = written(rows if whole else rows.select(F.struct("row.doc_id", "row.lang").alias("row"), "score"), "scored")
    known = F.coalesce("row.lang", F.lit(""))
    good = rows.where("score.bits is not null").select(F.col("row.doc_id").alias("doc_id"), known.alias("lang"), "score.bits").join(good_ids(labels).hint("merge"), "doc_id", "left_semi")
    # each trusted document counts for its language and, under the null kind's stand-in, for all
    kinds = F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("lang")), F.struct(F.lit(False).alias("own"), F.lit("").alias("lang"))))
    values = written(good.select(kinds.alias("kind"), "bits"), "trusted")
    limits = order_statistic(values, quantile).select("kind.own", "kind.lang", as_double("bits").alias("limit"))
    limits = written(limits.withColumn("threshold", F.col("limit") * margin), "thresholds")
    overall = limits.where("not own").select("threshold").first()
    own = limits.where("own").select(F.col("lang").alias("_lang"), F.col("threshold").alias("_own"))
    out = rows.withColumn("_lang", known).join(own, "_lang", "left")
    threshold = F.coalesce("_own", F.lit(overall["threshold"] if overall else None).cast("double"))
    out = out.select("row", "score", threshold.alias("threshold"))
    return out.withColumn("keep", F.coalesce(F.col("score.perplexity") <= F.col("threshold"), F.lit(True)))


def as_double(bits: str) -> Column:
    """The double with these bits."""

    @F.pandas_udf("double")
    def read(x: pd.Series) -> pd.Series:
        return pd.Series(x.to_numpy(dtype=np.int64).view(np.float64))

    return read(bits)


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every row of docs."""
    out = _judged(docs.select("doc_id", "lang", "text"), labels, quantile, margin, False)
    return out.select("row.doc_id", "row.lang", "score.perplexity", "threshold", "keep")


def clean(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose perplexity is within their language's threshold, with the columns of docs."""
    return unpacked(_judged(docs, labels, quantile, margin, True).where("keep").select("row"))
