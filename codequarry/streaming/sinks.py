"""Appends of workflow events beside the table they speak of (SNK4, SNK1): one batch id for both, nothing written twice.

Each batch of a stream has a folder in both tables, named by its id and overwritten if the batch is run again. A batch counts once its id stands in the list of
batches, which is written last: readers see both tables' rows of a batch or neither's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types that must be stored with what they speak of (fixed values).
CRITICAL = ["HUMAN_APPROVED", "HUMAN_REJECTED", "PATCH_APPROVED", "PATCH_REJECTED", "PATCH_REVISION_CREATED"]


def unfit(rows: DataFrame) -> Column:
    """Why an event can't be stored; null if it can."""
    broken = F.col("metadata_payload").isNotNull() & F.try_parse_json("metadata_payload").isNull()
    return F.when(F.col("event_type").isNull(), "no event type").when(F.col("scan_id").isNull(), "no scan").when(broken, "metadata is no JSON")


def writer(path: str, rows_of: Callable[[DataFrame], DataFrame], critical: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that stores a batch of events, and rows_of(batch) as the caller's table, under path.

    A critical event that can't be stored fails the batch, and none of it counts. An operational one goes to the table `refused` with the reason, and the
    batch goes on. events: id, scan_id, event_type, metadata_payload and others.
    """
    critical = CRITICAL if critical is None else critical

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id in {r[0] for r in _batches(spark, path).where(F.col("batch_id") == batch_id).collect()}:
            return
        judged = batch.withColumn("refusal", unfit(batch)).persist()
        try:
            bad = judged.where(F.col("refusal").isNotNull() & F.col("event_type").isin(critical)).select("refusal").first()
            if bad:
                raise ValueError(f"a critical event can't be stored: {bad[0]}")
            put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
            put(rows_of(batch), "rows")
            put(judged.where("refusal is null").drop("refusal"), "events")
            put(judged.where("refusal is not null"), "refused")
            spark.range(1).select(F.lit(batch_id).cast("long").alias("batch_id")).write.mode("overwrite").parquet(f"{path}/batches/{batch_id}")
        finally:
            judged.unpersist()

    return append


def _batches(spark: SparkSession, path: str) -> DataFrame:
    from codequarry.sources.vectors import exists

    return spark.read.schema("batch_id long").option("recursiveFileLookup", True).parquet(f"{path}/batches") if exists(spark, f"{path}/batches") else spark.createDataFrame([], "batch_id long")


def stored(spark: SparkSession, path: str, name: str) -> DataFrame:
    """What counts of the table rows, events or refused, with its batch_id."""
    return spark.read.parquet(f"{path}/{name}").withColumn("batch_id", F.col("batch_id").cast("long")).join(_batches(spark, path), "batch_id", "left_semi")
