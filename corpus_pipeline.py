"""Corpus pipeline: five operators applied one after the other to the documents table.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet to the
shared folder and read again as the next stage's input.  All stages but the last return the
columns of ``docs``.

1. quality classifier: rejected documents go;
2. SimHash near-dedup: one document of each component stays;
3. suffix-array dedup: repeated passages leave the texts;
4. benchmark decontamination: documents with a benchmark passage go;
5. BPE encoding and decoding: doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left.

A null text counts as empty in every stage; a table without rows, or one that a stage empties,
gives an empty result; extra columns travel to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from secspark.llm.bpe import encode_documents
from secspark.llm.common import materialise, table
from secspark.llm.decontam import drop_leaks
from secspark.llm.quality import keep_good
from secspark.llm.simhash import keep_first
from secspark.llm.suffix import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(spark, docs, sf_dir)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(spark, docs, sf_dir)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, docs, sf_dir)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(spark, docs, sf_dir)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

# Trained models, bit arithmetic and byte-pair merges have no SQL form; tests/llm compares the
# stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
