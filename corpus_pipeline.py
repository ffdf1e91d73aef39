"""A training corpus from raw documents, in five stages that each apply one operator.

``run`` writes each stage's rows as Parquet in the shared folder and reads them for the next: toxic
documents go, of equal texts one stays, of near copies one stays, sources are mixed to target weights
(a document may be repeated), and the texts become token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallowmere.llm import bpe, exact_dedup, mixing, simhash, toxicity
from tallowmere.llm.shared import held, released, removed, shared_dir, table, written

#: The tokenizer's file name; the driver reads it and broadcasts its text.
TOKENIZER = "word_bpe_49k.json"


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from the labels of rows that aren't held out.

    Each row is judged by its own text: repeated rows and ids get one verdict where their texts are equal.  A null
    text counts as empty and scores as a text without any known n-gram, a null id is never learnt from.
    No rows give no rows, and without labels all stay.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents with one text, the one with the least id.

    A null text is empty.  A row without id stays only where no copy has one; of rows alike in id and text
    the one with the least hash of all its columns stays.  No rows give no rows.
    """
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents whose fingerprints link at two or fewer bits, the one with the least id.

    Fingerprints are those of ``op10_simhash``: words in threes, two bits of 64.  Rows are told apart by id and
    text, a tie goes to the least hash of the text, then of the whole row, a null id comes last.  Texts without a word are one
    group, null ones among them.  No rows give no rows.
    """
    return simhash.near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the mix's order.

    A null source is a source as any other and comes last; documents without words take no part, null texts
    among them; ties are settled by source, id and text, so that reruns agree.  No rows give no rows.
    """
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids_sha256, decoded_sha256, token_ids.

    A row for each row, repeated ones too; a null text is empty and has no tokens.  No rows give no rows.
    """
    return bpe.encoded(docs, public_tokenizers.path(TOKENIZER), ("doc_id", "source"))


STAGES = [("toxicity", toxic), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("bpe", tokens)]

#: Fitting a classifier, merging by rank and following links have no SQL; the tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what the others wrote is deleted as soon as the next stage is written."""
    docs = table(spark, sf_dir, "documents")
    base = shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        before = held()
        docs, _ = written(stage(spark, docs, sf_dir), f"{base}/{k}")
        released(before)
        removed(spark, f"{base}/{k - 1}")
    return docs
