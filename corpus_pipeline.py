"""A training corpus from documents: language, toxicity, near-duplicates, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. A driver
may write each result and read it again as the next stage's docs; run() does that in the shared checkpoint folder.

All stages take null ids, texts and sources, repeated rows, empty tables and columns of any other name; what they make of them is
said below and in the operators. A stage never changes a row, only how often it stands in the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankmill.llm import language_id, mixing, sentencepiece, simhash, toxicity
from rankmill.llm.common import checkpoint_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no learned language codes better than raw bytes, go.

    So do null and blank texts. Rows with null ids are judged like others; repeated rows stay or go together.
    """
    return language_id.accepted(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go.

    Examples are labelled documents that the stage before kept. Null ids are judged and not learnt from; equal texts go together.
    """
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id.

    Of rows that share that id, the smallest fingerprint stays; rows with null ids stay only in groups without an id, one of each
    fingerprint.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times; ties are broken by id and size, and null sources are one source."""
    return mixing.sampled(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, piece_ids, nbest_scores, nbest_edits, round_trip of every row; null texts would count as empty."""
    return sentencepiece.sentencepiece_nbest(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Trained models and XXH64 fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs.checkpoint()
    return docs
