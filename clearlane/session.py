"""Session settings the jobs are designed for.

Every setting is adaptive: partition counts follow measured shuffle sizes and
skewed shuffle partitions are split at run time, so the same code runs on a
laptop and on a cluster.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where a later grouping reuses its partitioning
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: str | int = "*", app: str = "clearlane", **extra: str) -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    parallel = os.cpu_count() if cores == "*" else cores
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(parallel),
        "spark.driver.memory": os.environ.get("CLEARLANE_DRIVER_MEMORY", "8g"),
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
