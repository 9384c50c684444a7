"""Size of the Arrow batches that carry whole texts to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spanloom.session import ship

#: Rows of a batch: every worker and its JVM side hold a few batches at once, and texts may be long.
TEXT_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship_texts(spark: SparkSession) -> SparkSession:
    """``ship``, with the session's batches held to ``TEXT_ROWS`` rows; a smaller setting stays.

    Plans read the setting when they run, so it stays on the session. No row is lost by it.
    """
    held = int(spark.conf.get(_ROWS, "10000"))
    if held <= 0 or held > TEXT_ROWS:
        spark.conf.set(_ROWS, str(TEXT_ROWS))
    return ship(spark)
