"""Session settings that fit the shape of these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession

SHUFFLE_BYTES = 128 << 20
SCAN_BYTES = 32 << 20


def configured(builder: SparkSession.Builder, input_bytes: int) -> SparkSession.Builder:
    """Settings for a corpus of ``input_bytes``.

    Shuffle partitions start near 128 MiB of input each and are merged at run
    time. Scans get small splits, as parsing costs far more than reading.
    """
    partitions = max(200, min(100_000, input_bytes // SHUFFLE_BYTES))
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(SCAN_BYTES),
        # Ranks up to this bound are cut before the shuffle (pages, caps, top-n).
        "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
        # Regular expressions on long lines recurse.
        "spark.executor.extraJavaOptions": "-Xss8m",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder
