"""A corpus from raw documents: good, clean, without copies, packed into sequences.

Each stage takes the documents its predecessor kept, with all their columns, and
returns those that it keeps; the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from assayloom.llm import exact_dedup, near_dedup, packing, quality, toxicity
from assayloom.llm.common import saved, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3. The model is fitted on labelled documents of ``sf_dir``.

    Null and empty texts score as texts of no evidence; columns may be null.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below 0.5. The model is fitted on labelled documents of ``sf_dir``.

    Null and empty texts score as texts of no evidence; repeated rows are judged each.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one: that with the most code points, then the smallest doc_id.

    A null text is an empty one. Of rows that repeat a doc_id and a text one stays; rows without doc_id take part.
    """
    return exact_dedup.keep_one(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over five-word shingles that with the smallest doc_id.

    Texts without words are linked with nothing and stay, as do rows without doc_id; of rows that repeat a doc_id one stays.
    """
    return near_dedup.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and where each lies: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece, of the end mark alone; each of repeated rows is packed.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: Models and a tokenizer decide what stays: SQL can't say that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
