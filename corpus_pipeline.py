"""A corpus pipeline of five stages, each on all that its predecessor kept.

Quality, toxicity, near-duplicates, decontamination and SentencePiece round trip. Stages take (spark, docs, sf_dir) and
return a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last return the columns
of documents; further columns that docs has, whatever their names, go. Documents that a filter rejects go; one document of
each class of near copies (five-word shingles, similarity of 0.8 or more) stays, the one of least doc_id; documents that
share ten words in a row with a benchmark item go; the last stage gives what op1 gives.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import kneser_ney, sentence_pieces, simhash, toxicity, winnowing
from quillspark.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kneser_ney.clean(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs.select(*COLUMNS), _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs.select(*COLUMNS), words=5, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnowing.clean(docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.round_trip(docs.select("doc_id", "text"), model).drop("text")


STAGES = [("quality", quality), ("toxicity", toxic), ("near_copies", near_copies), ("decontamination", decontaminated), ("sentence_pieces", pieces)]

#: The first stages fit models, which SQL can't express; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
