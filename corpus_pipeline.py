"""From raw documents to packed training sequences: STAGES in order, run() for all.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import _common as C
from tessella.llm import language_id, ngram_join, packing, secret_scan

#: A document stays if its language is known with at least this score.
LEAST_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language.

    Null and empty texts have no letters and go.  The model learns from rows that
    have an id, a text and a language; if none has, all go.  Equal scores go to
    the language first in order, and are no clear language.  Each repeated row is
    judged for itself; an empty table gives an empty one; a very long text is judged whole.
    """
    told = C.free_name(docs, "_language")
    model = language_id.fit(docs, F.lit(True))
    judged = language_id.labelled(docs, model, name=told)
    return judged.where((F.col(f"{told}.lang_pred") != language_id.UND) & (F.col(f"{told}.score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


#: Dropped rows' keys of at most this number (8 bytes each) are sent to every task; more are joined by a shuffle.
MOST_SENT_IDS = 4_000_000


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the one of the smallest id, of equal ids any one.

    Five-word shingles, similarity 0.8.  Groups are made of rows, each under a
    key of its own, not of ids: rows that share an id stay if their texts are no
    near copies, and rows without an id (last in order) are dropped as others are.
    Texts without words (null, empty) are copies of none and stay; repeated rows
    are copies; an empty table gives an empty one; very long texts are compared whole.
    """
    key = C.free_name(docs, "_row")
    rows = C.stored(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    told = ngram_join.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), width=5, percent=80)
    told = told.select(F.col("doc_id").alias("row"), "component_id").join(rows.select(F.col(key).alias("row"), "doc_id"), "row")
    told = C.stored(told, "near-copies")
    stays = told.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")).select("first.row")
    gone = C.stored(told.select("row").join(stays, "row", "left_anti").select(F.col("row").alias(key)), "near-copies")
    return rows.join(F.broadcast(gone) if gone.count() <= MOST_SENT_IDS else gone, key, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; reported secrets in its text are replaced.

    A null text stays null, an empty one empty; overlapping finds become one mark;
    repeated rows are redacted alike; an empty table gives an empty one; very long
    texts are searched whole.
    """
    return secret_scan.redact_secrets(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids.

    A null or empty text is its end id alone; pieces of equal length have no order
    that matters; repeated rows are packed each for itself; an empty table gives no
    rows; a very long text is cut into full pieces and a rest.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Tokenizers and learned models are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
