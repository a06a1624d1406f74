"""The training-data pipeline: stages that each take (spark, docs, sf_dir) and return a DataFrame.

All stages but the last return the columns of documents and any others that come, whatever their names; an empty
table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import bpe, exact_dedup, langid, mixing, simhash
from sievelight.llm.common import documents, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those all in scripts that no learned language uses; the rest carry the predicted language.

    Learned from the rows of docs that have a language; if none has one, all documents stay as they are. In a
    foreign script every language is as likely as any other, which no text in a known script comes down to. Null and
    empty texts have no letter and go. Very long texts are read whole. Each repeated row is judged by itself.
    """
    model = langid.learn(docs)
    if model is None:
        return docs
    found = "found"
    while found in docs.columns:
        found += "_"
    even = 1 / len(model.langs) + 1e-6 if len(model.langs) > 1 else 0.0
    labelled = langid.annotate(docs, model, found).filter((F.col(f"{found}.lang_pred") != "und") & (F.col(f"{found}.score") > even))
    return labelled.withColumn("lang", F.col(f"{found}.lang_pred")).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (white space normalised), the smallest id stays.

    Null texts are empty, and empty texts equal. Of rows that repeat id and text, one stays; rows that repeat an id with
    different texts stay each. Texts without an id leave if a document with an id has the text, else they stay as one.
    """
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that SimHash links by the contract of op3_simhash, the smallest id stays. The pipeline runs near_copies."""
    return simhash.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a resemblance of 0.8 or more, the smallest id stays.

    Null and blank texts are copies of each other. Rows without an id stay; rows that repeat an id leave or
    stay each by their own text. Very long texts are compared whole.
    """
    return simhash.keep_one_resembling(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: some leave, some come twice, so that sources meet their targets.

    A null source is a source of its own. Texts that are null or blank have no words; a source without words gives no
    rows. Repeated rows are taken each, and a very long text is never split.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of every document of the mix.

    Null text has no ids and decodes to nothing. Repeated rows are encoded each, and very long texts whole.
    """
    out = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digests(out, "ids")


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash", near_copies), ("mixing", mixture), ("bpe", tokens)]

#: Language ID, near-dedup, mixing and byte-level BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's result is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
