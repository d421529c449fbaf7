"""A corpus pipeline: documents in, encoded training documents out. Each stage reads what its predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from carecolumns.llm import bpe, mixing, ngram_jaccard, quality, secrets
from carecolumns.llm.common import remove, shared_folder, table, write
from carecolumns.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are judged by their statistics, rows of one id one by one; rows without an id stay. Other columns are carried along whatever their names;
    an empty table gives an empty one.
    """
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id, its repeated rows once.

    Texts without words, and rows without an id, are in no group and stay. Several texts of the id that stays all stay. An empty table gives an empty one.
    """
    return ngram_jaccard.one_of_each(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked: every row stays, null and empty texts as they are, n_chars follows the text."""
    return secrets.masked(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken (0 to 2 times). Texts without words are not taken; of equal rows as many are taken as fit."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The encoded documents: token ids, their number and digests, a row for each row; a null text has no ids."""
    return bpe.encode_texts(docs, tokenizer("byte_bpe_50k.json"), ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: The classifier, the joins on components and the encoder have no SQL form; the tests hold the pipeline against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = write(stage(spark, docs, sf_dir), f"{folder}/{k}")
        # a stage that is written needs its input no more
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
