"""Runs a stream to its end into a table of the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codequarry.tables import new_path


def drain(stream: DataFrame, name: str = "stream") -> DataFrame:
    """All rows that are there now, as a batch table; the checkpoint beside it lets a lost run go on."""
    spark = stream.sparkSession
    at = new_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")
