"""A local session for tests and the benchmark.

Cluster jobs bring their own session; no other module sets configuration.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str = "*", memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brightwater")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
