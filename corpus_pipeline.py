"""From raw documents to packed token ids: five stages, each by one operator of ``kbspark.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; all but the last return the columns of ``documents``.  ``run`` writes each
stage's rows as Parquet to the shared folder and reads them again, so a lost
executor costs at most the running stage.

Defined results are those of the operators: documents that are null, empty or have
no letter go in the first stage, and those of which no language is more likely than
all others together; documents without words stay in the third; empty tables pass
through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kbspark.llm import bitpack, dartminhash, langid_kernel, poisson_mix, storage, winnow
from kbspark.llm.queries import fold_of, tokenizer_path
from kbspark.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learnt from four fifths of the labelled ones."""
    ship(spark)
    return langid_kernel.accepted(docs, langid_kernel.train(docs, learn=fold_of() != 0), min_score=langid_kernel.MAJORITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of least id."""
    ship(spark)
    return dartminhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages."""
    ship(spark)
    return winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target shares, in random order."""
    ship(spark)
    return poisson_mix.mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents; one row for each: (doc_id, start, n_tokens, ids_crc32)."""
    ship(spark)
    return bitpack.token_digests(bitpack.write_token_ids(docs, tokenizer_path()))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

#: SQL has neither the kernel classifier nor the byte-pair encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.materialise(stage(spark, docs, sf_dir), spark, name)
    return docs
