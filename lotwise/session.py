"""Session settings the operators assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "lotwise", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session when ``cpus`` is given, else the cluster's own session.

    Adaptive execution picks the number of shuffle partitions and splits skewed
    joins; on a cluster ``spark.sql.shuffle.partitions`` is left to the cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if cpus is not None:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
