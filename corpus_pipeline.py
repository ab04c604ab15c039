"""The training-data pipeline: toxicity, near duplicates, repeated strings, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a
DataFrame that is written as Parquet into the shared folder and read again as the next one's documents.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logsieve.llm.near_copies import keep_first
from logsieve.llm.packing import pack_stage
from logsieve.llm.secrets_scan import redact_secrets
from logsieve.llm.shared import materialize, table
from logsieve.llm.suffix_dedup import cut_repeats
from logsieve.llm.toxicity import drop_toxic

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_first),
    ("repeated_strings", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_stage),
]

#: The stages hold trained models and local search, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
