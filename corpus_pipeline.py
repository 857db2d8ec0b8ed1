"""The corpus pipeline: quality, near-dedup, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows that its
predecessor kept, and all but the last return the columns of `documents`. Near copies are
judged by the text that reaches their stage: cleaned of low quality, not yet redacted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotmill.llm.common import Scratch, cut, table
from slotmill.llm.decontaminate import decontaminate
from slotmill.llm.near_dedup import deduplicate
from slotmill.llm.packing import pack, tokenizer_path
from slotmill.llm.quality import keep_good
from slotmill.llm.secrets import redact


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Null and empty texts are judged as
    texts without words, repeated rows each and alike; an empty table gives an empty one."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: the one with the least id; of repeated rows
    one. Null and empty texts, and rows without an id, all stay; an empty table gives an empty one."""
    return deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of a benchmark item occurs. Null and empty texts stay,
    repeated rows share their fate; an empty table, on either side, drops nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; every document stays, null and empty texts as they are."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into training sequences; workers keep memory for the other stages. Null
    and empty texts are a document of the end id alone, repeated rows are packed each."""
    return pack(docs, tokenizer_path(), remembered=150_000)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Trained and iterative stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next. What a stage
    has read or made on its way goes when its result stands."""
    with Scratch():
        docs = table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            with Scratch():
                docs = cut(stage(spark, docs, sf_dir), f"stage-{name}", result=True)
        return cut(STAGES[-1][1](spark, docs, sf_dir), "packed", result=True)
