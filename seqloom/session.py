"""Settings of a session for tables of long texts; `configure` is called once by the entry points, never by operators."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: A batch of a scan or of Arrow holds rows up to a number, whatever their length; these keep batches of long texts small. The
#: last lets filters reach the readers of `seqloom.sources`.
SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.python.filterPushdown.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Sets what the session has not set itself."""
    own = spark.conf.getAll
    for key, value in SETTINGS.items():
        if key not in own:
            spark.conf.set(key, value)
    return spark
