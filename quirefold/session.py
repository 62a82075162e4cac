"""Session helpers: one place for Spark settings and table paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "quirefold", cpus: str = "8", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the driver's tables through Spark, wherever it is stored."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
