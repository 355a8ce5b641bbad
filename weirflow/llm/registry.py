"""The queries of this subpackage for __spark_entry__.py, which adds the pipeline of corpus_pipeline.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm.flac_media import op6_flac_media
from weirflow.llm.language_id import op8_language_id
from weirflow.llm.length_packing import op7_length_packing
from weirflow.llm.license_scan import op3_license_scan
from weirflow.llm.line_dedup import OP1_SQL, op1_line_dedup
from weirflow.llm.passage_dedup import OP10_SQL, op10_passage_dedup
from weirflow.llm.quality_rules import op2_quality_rules
from weirflow.llm.simhash_dedup import op5_simhash_dedup
from weirflow.llm.source_mix import OP4_SQL, op4_source_mix
from weirflow.llm.token_rollup import op9_token_rollup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_license_scan": op3_license_scan,
        "op4_source_mix": op4_source_mix,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op6_flac_media": op6_flac_media,
        "op7_length_packing": op7_length_packing,
        "op8_language_id": op8_language_id,
        "op9_token_rollup": op9_token_rollup,
        "op10_passage_dedup": op10_passage_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {"op1_line_dedup": OP1_SQL, "op4_source_mix": OP4_SQL, "op10_passage_dedup": OP10_SQL}
