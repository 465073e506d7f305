"""How large the record batches are that kernels are given."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bytes of a batch. Spark's own bound lets each task hold several times 64 MB, in the JVM and in each of its Python workers.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def small(spark: SparkSession) -> None:
    """8 MB where the session leaves it at Spark's default."""
    key, default, own = _BATCH
    if spark.conf.get(key, default) == default:
        spark.conf.set(key, own)
