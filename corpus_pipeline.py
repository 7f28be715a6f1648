"""From raw documents to token ids: toxic documents go, one of each group of near copies stays, repeated passages are cut out,
sources are mixed to target weights, and what is left is encoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from evseq.llm import bpe, minhash_dedup, mixing, suffix_dedup, toxicity
from evseq.llm.common import forget, scope, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on `labels` scores under one half; null and empty texts stay. Columns as they are. An empty
    table, or labels of one class alone: the classifier is one of a few fixed terms."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity of 0.8 or more), that of the smallest doc_id; rows
    equal in id and text are one. Texts without words, nulls included, all stay. Columns as they are; an empty table stays empty."""
    return minhash_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that strings of 200 bytes cover which also start elsewhere; those of which nothing is left go, null and
    empty texts stay. text and n_chars are new, other columns as they are; an empty table stays empty."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target takes it, three times at most. Texts without words, nulls
    included, are never taken; a null source is one of its own. Columns as they are; an empty table stays empty."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each row; null and empty texts have no ids. An empty table gives none."""
    return bpe.tokenized(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_copies), ("suffix_dedup", cut_repeats), ("mixing", mix_sources), ("byte_bpe", encode)]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result but the last is written to the shared folder as Parquet and read again; what the stage wrote on its way, and what it
    was made of, then goes. The last stage's input stays until the process, or a scope around this call, ends."""
    docs, path = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scope():
            made, before = written(stage(spark, docs, sf_dir), outer=True), path
        docs, path = made
        if before:
            forget(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
