"""Toxicity scores from a counterfactual-regularised classifier.

The classifier is logistic regression on which words and beginnings of words a text has. It is fitted on labelled texts
and, at the same time, on counterfactual pairs: a sentence of a labelled text that names an identity term, and the same
sentence with another term of its kind in its place. The squared change of the score's logit over each pair is part of the
loss, so a term's own weight is held down and neutral mentions of a group don't raise the score. All sentences of the
sampled texts are looked at, whole; where more than PAIRS different ones name a term, those of least hash are taken. Texts
without any identity term give no pairs, and there is nothing to hold down then.

Only a bounded sample of labelled rows is fitted on (SAMPLE, chosen by a hash of doc_id; the same rows for every order
and partitioning of the input). All rows are scored, whole texts. The features that enter are chosen on the sample by their
association with the label, at most FEATURES, so the model that goes to all executors has a fixed bound. Inputs of a
score are the words of the text alone. Null and empty texts have no words and get the score of the intercept alone. A
document with several labels counts once, as toxic if any of them says so; of several documents with one id each counts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.shared import packed, small_batches, unpacked, written

#: At most so many labelled rows are fitted on.
SAMPLE = 8_000
#: At most so many features enter the model.
FEATURES = 4_096
#: A feature must be in so many of the sampled texts.
LEAST_TEXTS = 2
#: And its likelihood ratio statistic with the label be so large (chance exceeds 10 once in 600 features).
LEAST_STRENGTH = 10.0
PREFIXES = (4, 5, 6, 7)
#: At most so many counterfactual pairs.
PAIRS = 2_000
PENALTY, RIDGE, ROUNDS, RATE = 1.0, 2e-4, 150, 0.7
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")

#: Identity terms by kind; a term is swapped for others of its kind. Plain words of four languages.
IDENTITY = {
    "gender": ["women", "men", "girls", "boys", "femmes", "hommes", "frauen", "männer", "mujeres", "hombres"],
    "religion": ["christians", "muslims", "jews", "hindus", "buddhists", "atheists", "chrétiens", "musulmans", "juifs", "christen", "muslime", "juden", "cristianos", "musulmanes", "judíos"],
    "origin": ["africans", "asians", "europeans", "americans", "mexicans", "arabs", "africains", "asiatiques", "afrikaner", "asiaten", "africanos", "asiáticos"],
    "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "transgender"],
    "age": ["young", "old", "elderly", "teenagers"],
    "ability": ["disabled", "deaf", "blind", "autistic"],
}
KIND = {term: kind for kind, terms in IDENTITY.items() for term in terms}


def features(text: str | None) -> set[str]:
    """The words of a text, lower-cased, and their beginnings (with a hyphen)."""
    words = set(WORD.findall((text or "").lower()))
    out = set(words)
    for w in words:
        for n in PREFIXES:
            if len(w) <= n:
                break
            out.add(w[:n] + "-")
    return out


@dataclass
class Model:
    weights: dict[str, float]
    intercept: float

    def logit(self, text: str | None) -> float:
        words, own, total = set(WORD.findall((text or "").lower())), self.weights, self.intercept
        found = set()
        for w in words:
            if w in own:
                found.add(w)
            for n in PREFIXES:
                if len(w) <= n:
                    break
                p = w[:n] + "-"
                if p in own:
                    found.add(p)
        return total + sum(own[x] for x in sorted(found))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(text), -40, 40))))


def counterfactuals(text: str | None) -> list[tuple[str, set[str], set[str]]]:
    """Of each sentence that names identity terms, for each term, two pairs: the sentence, and the features that only it has
    and that only its counterfactual has.

    One counterfactual has another term of the same kind, told by a hash of the sentence; the other has the term left out.
    The latter anchors a kind, whose weights could otherwise rise together where the texts name few of its terms.
    """
    out = []
    for found in SENTENCE.finditer((text or "").lower()):
        said = found[0].strip()
        words = WORD.findall(said)
        for term in sorted({w for w in words if w in KIND}):
            others = [t for t in IDENTITY[KIND[term]] if t != term]
            other = others[zlib.crc32(f"{term}: {said}".encode()) % len(others)]
            own = features(said)
            for place in (other, ""):
                changed = features(" ".join(place if w == term else w for w in words))
                out.append((f"{term}: {place}: {said}", own - changed, changed - own))
    return out


def fit(names: list[str], texts: list[np.ndarray], labels: list[int], pairs: list[tuple[set[str], set[str]]]) -> Model:
    """Weights of the named features by full-batch gradient descent with momentum.

    texts: the places in names of each text's features; pairs: what a sentence has and its counterfactual hasn't, and the
    other way round. Identity terms are features too, whether named or not.
    """
    total, positive = len(texts), sum(labels)
    if not positive or positive == total:
        rate = (positive + 0.5) / (total + 1)
        return Model({}, float(np.log(rate / (1 - rate))) if total else float(np.log(0.1 / 0.9)))
    place = {f: i for i, f in enumerate(names)}
    for term in KIND:
        place.setdefault(term, len(place))
    rows = np.repeat(np.arange(total), [len(x) for x in texts]), np.concatenate(texts).astype(np.int64)
    y = np.array(labels, dtype=np.float64)
    ones, others = (_matrix([p[k] for p in pairs], place) for k in (0, 1))
    w, b, vw, vb = np.zeros(len(place)), float(np.log(positive / (total - positive))), 0.0, 0.0
    for _ in range(ROUNDS):
        miss = 1 / (1 + np.exp(-np.clip(_dot(rows, w, total) + b, -40, 40))) - y
        grad = _back(rows, miss, len(w)) / total + RIDGE * w
        if pairs:
            change = _dot(ones, w, len(pairs)) - _dot(others, w, len(pairs))
            grad += PENALTY * (_back(ones, change, len(w)) - _back(others, change, len(w))) / len(pairs)
        vw, vb = 0.9 * vw + grad, 0.9 * vb + miss.mean()
        w, b = w - RATE * vw, b - RATE * vb
    return Model({f: float(w[i]) for f, i in place.items() if abs(w[i]) > 1e-6}, float(b))


def association(both: F.Column, n: F.Column, positive: int, total: int) -> F.Column:
    """The likelihood ratio statistic of a feature in n texts, both of which are labelled 1."""
    out = F.lit(0.0)
    for seen, rows, columns in ((both, n, positive), (n - both, n, total - positive), (positive - both, total - n, positive), (total - positive - n + both, total - n, total - positive)):
        out = out + F.when(seen > 0, 2 * seen * F.log(seen * total / (rows * F.lit(columns)))).otherwise(0.0)
    return out


def _matrix(texts: list[set[str]], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [(i, place[f]) for i, words in enumerate(texts) for f in words if f in place]
    pairs.sort()
    return np.array([p[0] for p in pairs], dtype=np.int64), np.array([p[1] for p in pairs], dtype=np.int64)


def _dot(m: tuple[np.ndarray, np.ndarray], w: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(m[0], weights=w[m[1]], minlength=n)


def _back(m: tuple[np.ndarray, np.ndarray], x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(m[1], weights=x[m[0]], minlength=n)


def is_held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS) -> Model:
    """Fits on at most sample labelled rows that are not held out. Rows with a null label or no document don't count."""
    small_batches(docs.sparkSession)
    chosen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample is of fixed size, so it may go to all executors; its texts are read again, not the table's
    texts = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "sample")

    @F.pandas_udf("array<string>")
    def taken(series: pd.Series) -> pd.Series:
        return series.map(lambda t: sorted(features(t)), na_action=None)

    total, positive = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counted = texts.select("toxic", F.explode(taken("text")).alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("both"))
    strength = F.round(association(F.col("both"), F.col("n"), positive, total), 6)
    strong = counted.where(F.col("n") >= LEAST_TEXTS).withColumn("strength", strength).where(F.col("strength") >= LEAST_STRENGTH)
    names = [r["f"] for r in strong.orderBy(F.desc("strength"), "f").limit(FEATURES).select("f").collect()]
    place = {f: i for i, f in enumerate([*names, *(t for t in KIND if t not in set(names))])}

    @F.pandas_udf("array<int>")
    def coded(series: pd.Series) -> pd.Series:
        return series.map(lambda t: sorted(place[f] for f in features(t) if f in place), na_action=None)

    @F.pandas_udf("array<struct<said:string,one:array<string>,other:array<string>>>")
    def swapped(series: pd.Series) -> pd.Series:
        known = lambda x: sorted(f for f in x if f in place)
        return series.map(lambda t: [{"said": s, "one": known(a), "other": known(b)} for s, a, b in counterfactuals(t)], na_action=None)

    # of each text only the places of the chosen features reach the driver
    rows = texts.select("doc_id", "toxic", coded("text").alias("places")).sort("doc_id", "toxic", F.xxhash64("places")).collect()
    named = texts.select(F.explode(swapped("text")).alias("s")).select(F.xxhash64("s.said").alias("mark"), "s.one", "s.other").distinct()
    twins = named.orderBy("mark", F.to_json(F.struct("one", "other"))).limit(pairs).collect()
    return fit(names, [np.array(r["places"], dtype=np.int32) for r in rows], [r["toxic"] for r in rows], [(set(r["one"]), set(r["other"])) for r in twins])


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score (0 to 1) of every whole text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = held.value
        for series in texts:
            yield pd.Series([own.score(t) for t in series], dtype="float64")

    return docs.withColumn(name, scored(F.col(text)))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    own = score(docs.select("doc_id", "text"), train(docs, labels))
    return own.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs."""
    rows = packed(docs).withColumn("text", F.col("row.text"))
    return unpacked(score(rows, train(docs.select("doc_id", "text"), labels)).where(F.col("score") < threshold))
