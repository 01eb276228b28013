"""Score arriving rows and append them to the prediction log.

The batch job scores a table and appends to the log each time it is run. Here
the same projection runs on a stream of files; the checkpoint makes a restart
continue where it stopped, without double records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_rows(spark: SparkSession, path: str, schema: StructType,
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def append_scored(rows: DataFrame, to_records: Callable[[DataFrame], DataFrame], log_path: str,
                  checkpoint: str) -> StreamingQuery:
    """``to_records`` scores rows and shapes log records; row by row, no state."""
    return (to_records(rows).writeStream.format("json").outputMode("append")
            .option("path", log_path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
