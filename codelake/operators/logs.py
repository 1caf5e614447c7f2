"""Build, test and audit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelake import fixed_values as fv


def build_diagnostics(lines: DataFrame) -> DataFrame:
    """``lines(run_id, ord, line)`` -> one row per compiler error or warning."""

    def group(n: int):
        return F.regexp_extract("line", fv.BUILD_DIAGNOSTIC, n)

    return lines.filter(F.col("line").rlike(fv.BUILD_DIAGNOSTIC)).select(
        "run_id", "ord",
        F.trim(group(1)).alias("file"),
        group(2).try_cast("int").alias("line_no"),
        group(3).try_cast("int").alias("column_no"),
        F.lower(group(4)).alias("severity"),
        group(5).alias("code"),
        F.btrim(group(6), F.lit(" \t\r")).alias("message"),
    )


def build_log_summary(lines: DataFrame) -> DataFrame:
    """Error and warning counts of each run; runs without any are kept."""
    severity = F.lower(F.regexp_extract("line", fv.BUILD_DIAGNOSTIC, 4))
    return lines.groupBy("run_id").agg(
        F.count_if(severity == "error").alias("error_count"),
        F.count_if(severity == "warning").alias("warning_count"),
    )


def test_log_summary(logs: DataFrame) -> DataFrame:
    """``logs(run_id, text)`` -> the four totals; failed tests count as errors."""

    def number(pattern: str):
        return F.regexp_extract("text", pattern, 1).try_cast("int")

    failed = number(fv.TEST_FAILED)
    return logs.select(
        "run_id",
        number(fv.TEST_TOTAL).alias("total"),
        number(fv.TEST_PASSED).alias("passed"),
        failed.alias("failed"),
        number(fv.TEST_SKIPPED).alias("skipped"),
        F.coalesce(failed, F.lit(0)).alias("error_count"),
    )


def query_audit(
    audit: DataFrame, since=None, until=None, request_id: str | None = None,
    session_id: str | None = None, target_path: str | None = None,
    operation_type: str | None = None, outcome: str | None = None,
    page_index: int | None = None, page_size: int = fv.DEFAULT_PAGE_SIZE,
) -> DataFrame:
    """Filtered entries, newest first; ``page_index`` counts from 0."""
    rows = audit
    if since is not None:
        rows = rows.filter(F.col("timestamp") >= F.lit(since))
    if until is not None:
        rows = rows.filter(F.col("timestamp") <= F.lit(until))
    if request_id:
        rows = rows.filter(F.col("requestId") == request_id)
    if session_id:
        rows = rows.filter(F.col("sessionId") == session_id)
    if target_path:
        rows = rows.filter(F.lower("targetPath").contains(target_path.lower()))
    if operation_type:
        rows = rows.filter(F.col("operationType") == operation_type)
    if outcome:
        rows = rows.filter(F.col("outcome") == outcome)
    if page_index is None:
        return rows.orderBy(F.desc("timestamp"), "entryId")
    return (
        rows.orderBy(F.desc("timestamp"), "entryId")
        .offset(page_index * page_size)
        .limit(page_size)
    )
