"""Queries of the text operators, as the driver's contract names them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.gif_media import op8_gif_media
from gridloom.llm.language_model import op4_quality_classifier
from gridloom.llm.packing import op3_packing
from gridloom.llm.pii import op10_pii
from gridloom.llm.quality_rules import op2_quality_rules
from gridloom.llm.sentence_pieces import op7_sentencepiece
from gridloom.llm.simhash import op9_simhash_near_dedup
from gridloom.llm.token_files import op5_token_files
from gridloom.llm.toxicity import op1_toxicity
from gridloom.llm.url_rules import op6_url_rules


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_quality_rules": op2_quality_rules,
        "op3_packing": op3_packing,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_token_files": op5_token_files,
        "op6_url_rules": op6_url_rules,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_gif_media": op8_gif_media,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    return {}
