"""SQL functions that programs in any language of Spark share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: The shared functions.
FUNCTIONS = (
    """CREATE OR REPLACE TEMPORARY FUNCTION task_queue_priority(kind STRING, created TIMESTAMP, moment TIMESTAMP) RETURNS INT RETURN
CASE WHEN created <= moment - INTERVAL 15 MINUTES THEN 0 WHEN kind IN ('export', 'export-selection') THEN 0 WHEN kind IN ('catalog-sync', 'catalog-reconcile', 'catalog', 'catalog-process', 'curate-batch') THEN 2 ELSE 1 END""",
    """CREATE OR REPLACE TEMPORARY FUNCTION resolve_id(requested STRING, canonical STRING) RETURNS STRING RETURN coalesce(canonical, requested)""",
)


def register(spark: SparkSession) -> None:
    for text in FUNCTIONS:
        spark.sql(text)
