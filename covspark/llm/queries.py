"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from .ann import op10_nearest
from .bpe import op9_byte_bpe
from .chat import op5_chat
from .decontam import op1_decontaminate
from .langid import op7_language
from .neardup import op6_neardup
from .quality import op4_quality
from .shards import op8_shards
from .substrings import op3_substrings
from .tokencount import op2_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_counts": op2_token_counts,
    "op3_substrings": op3_substrings,
    "op4_quality": op4_quality,
    "op5_chat": op5_chat,
    "op6_neardup": op6_neardup,
    "op7_language": op7_language,
    "op8_shards": op8_shards,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_nearest": op10_nearest,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {}
