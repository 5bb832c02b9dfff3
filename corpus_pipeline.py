"""A training corpus from raw documents, in stages. Each stage's result is written as Parquet and is the next one's documents.

Every stage takes null texts and ids, empty tables, repeated rows and columns of any other name, which it keeps: see the
operators' modules for what they give in each case. An empty table of documents gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, quality, repeats, sentence_pieces, simhash
from tessera.llm.common import dropped, read, written_alone


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep; null and empty texts, having no words, go."""
    return quality.kept_documents(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: least doc_id, null ids last, ties by a hash of the text. Of rows that repeat one stays."""
    return simhash.first_of_groups(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 250 bytes, about fifty short words, that start more than once among them; a text may end up empty."""
    return repeats.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each pass of the mix takes of each document, as documents; those without words give nothing. Sources null and given are mixed alike."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, checked by decoding them; an empty text has none."""
    return sentence_pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), "doc_id", "source")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", token_ids),
]

#: The stages' learned list, xxHash64, suffix arrays, index permutations and encoder aren't expressible in DuckDB SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
        if last is not None:
            dropped(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
