"""The corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import stored, table
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import hide_personal_data
from gridloom.llm.quality_rules import reject_low_quality
from gridloom.llm.simhash import drop_near_duplicates
from gridloom.llm.toxicity import reject_toxic

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", reject_low_quality),
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", hide_personal_data),
    ("packing", pack_documents),
]

#: The forest, the trained model and the pseudonyms have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
