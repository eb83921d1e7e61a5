"""Stored tables of scans, bucketed by scan, and reports that join them where they lie (SRC11, JN20, PIP9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that belong to scans, each with its scan's id under this name.
TABLES, BY = ["scans", "findings", "evidences", "patches", "deliveries", "events"], "scan_id"
#: Lets Spark join on more columns than the tables are bucketed by without dealing them out anew.
SETTINGS = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.v2.bucketing.enabled": "true"}


def save(df: DataFrame, name: str, database: str, buckets: int) -> None:
    """Stores one of TABLES (with BY among its columns): bucketed and sorted by scan, a file for each bucket. All tables of a database need the same number of buckets."""
    if name not in TABLES or BY not in df.columns:
        raise ValueError(f"{name} is none of {TABLES}, or has no {BY}")
    df.repartition(buckets, BY).write.mode("overwrite").format("parquet").bucketBy(buckets, BY).sortBy(BY).saveAsTable(f"{database}.{name}")


def read(spark: SparkSession, name: str, database: str, **equal: str) -> DataFrame:
    """One of the tables, where columns have given values: scan_id prunes buckets, others are pushed to the files."""
    out = spark.table(f"{database}.{name}")
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out


def reports(spark: SparkSession, database: str, **equal: str) -> DataFrame:
    """scan_id, status, findings (array, each with its evidences and patches, a patch with its deliveries) and events of every scan, or of those chosen.

    With SETTINGS in the session no table is shuffled: every join and aggregation goes by scan first, as the tables are bucketed. A finding's evidences are told by
    finding_id, a patch's deliveries by patch_id; both ids are of their scan.
    """
    t = {name: read(spark, name, database, **(equal if name == "scans" or set(equal) <= {BY} else {})) for name in TABLES}
    pack = lambda df, keys, name: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in keys]))).alias(name))
    patches = t["patches"].withColumnRenamed("id", "patch_id").join(pack(t["deliveries"], [BY, "patch_id"], "deliveries"), [BY, "patch_id"], "left")
    findings = t["findings"].withColumnRenamed("id", "finding_id").join(pack(t["evidences"], [BY, "finding_id"], "evidences"), [BY, "finding_id"], "left").join(pack(patches, [BY, "finding_id"], "patches"), [BY, "finding_id"], "left")
    out = t["scans"].join(pack(findings, [BY], "findings"), BY, "left").join(pack(t["events"], [BY], "events"), BY, "left")
    return out.withColumns({c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("findings", "events")})
