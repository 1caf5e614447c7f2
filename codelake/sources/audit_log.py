"""JSON-Lines audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake import schemas

_BROKEN = "_broken"


def parse_audit(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines to entries; blank and malformed lines are skipped."""
    parsed = F.from_json(
        column, f"{schemas.AUDIT}, {_BROKEN} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN},
    )
    return (
        lines.filter(F.trim(column) != "")
        .select(parsed.alias("e"))
        .filter(F.col("e").isNotNull() & F.col(f"e.{_BROKEN}").isNull())
        .select("e.*")
        .drop(_BROKEN)
    )


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_audit(spark.read.text(path))


def write_audit_log(entries: DataFrame, path: str) -> None:
    """Appends entries; a missing id or time is filled in."""
    filled = entries
    columns = set(entries.columns)
    entry_id = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    now = F.current_timestamp()
    filled = filled.withColumn(
        "entryId",
        F.coalesce(F.nullif("entryId", F.lit("")), entry_id) if "entryId" in columns else entry_id,
    ).withColumn("timestamp", F.coalesce("timestamp", now) if "timestamp" in columns else now)
    filled.write.mode("append").json(path)
