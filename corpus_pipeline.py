"""From raw documents to token ids: five of the corpus operators as one pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridemark.llm import bpe, mixing, secrets, simhash, toxicity

#: The columns of ``documents``, which every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The tokenizer's file, on every machine.
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, learned from the labels, does not reject.

    Null and empty texts stay, texts of any length are judged whole, equal rows alike. Without rows or
    labels nothing is rejected. Columns other than those of documents are dropped, as by every stage.
    """
    docs = docs.select(COLUMNS)
    model = toxicity.fit(toxicity.sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model, tuple(COLUMNS)).where("predicted = 0").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, texts that share 0.8 of their five-word shingles or more, one document.

    That of the smallest id stays, null ids last, then of the smallest hash. Rows are told apart by
    all their columns, so unlike texts that repeat an id, or have none, stay; equal rows become one.
    Null texts, empty ones and those without words are one group. No rows give no rows.
    """
    return simhash.one_of_each(docs.select(COLUMNS), COLUMNS)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in the place of each secret of the whole text; n_chars is that of the new text.

    A null text stays null with its n_chars, an empty one empty. Equal rows come out equal; no rows give no rows.
    """
    shown = secrets.scan(docs.select(COLUMNS)).withColumn("text", secrets.redacted())
    return shown.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it: 0, 1 or 2 rows.

    Null texts and those without words have size 0 and go with their source's whole repetitions; a null
    source is a source, last in order; rows that repeat an id are drawn together. No rows give no rows.
    """
    return mixing.repeat(mixing.mix(docs.select(COLUMNS)), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row: their number, their digest and that of what they decode to.

    A null text is an empty one, of no tokens. Each row, repeated or not, gets a row; no rows give no rows.
    """
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", hide_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: The trained models and the tokenizer have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
