"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing and packing.

Each stage takes what the one before kept, written as Parquet and reread. All but the last return the columns of
``documents``; the last returns the pieces of sequences. Stages are judged on their own input: the language model, the
mix's targets and the packing's plan are made from the documents that reach them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftlink.llm.common import Workspace, read_documents
from weftlink.llm.exact_dedup import drop_exact_duplicates
from weftlink.llm.language_id import keep_identified, train_on_folds
from weftlink.llm.mixing import apply_mix
from weftlink.llm.near_dedup import drop_near_duplicates
from weftlink.llm.packing import pack_documents


# In every stage null texts count as empty, null ids are ids of their own order, repeated rows are rows, and columns may have any
# names and hold any nulls; an empty table gives an empty one. The operators state the rest.


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without any letter, or text, go, and all where no label was to be learned from."""
    return keep_identified(docs, train_on_folds(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of the smallest id; of repeated rows one. Null ids come last."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the row of the smallest id. Texts without words stay."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a repeated document is a repeated row. Null sources are one source."""
    return apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of all documents, repeated ones as often as they come."""
    return pack_documents(docs)


STAGES = [("language_id", identify), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("pack", pack)]

#: SQL can't express learned language models, best-fit packing or the mix; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes when the next one is written."""
    with Workspace(spark, "pipeline") as work:
        docs = read_documents(spark, sf_dir)
        for name, stage in STAGES[:-1]:
            docs = work.put(stage(spark, docs, sf_dir), name)
            work.clear(name)
        out = STAGES[-1][1](spark, docs, sf_dir)
        work.clear()
        return out
