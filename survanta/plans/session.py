"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows with whole texts differ in size; batches for Python workers are cut by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


def local_session(cpus: str = "8", shuffle: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    b = (SparkSession.builder.master(f"local[{cpus}]").appName("survanta")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory)
         .config("spark.sql.shuffle.partitions", str(shuffle))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return b.getOrCreate()

