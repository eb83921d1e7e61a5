"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Unset, a local folder does for a local master; a cluster needs the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="codequarry-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        root = "file://" + _own[0]
    return f"{root.rstrip('/')}/codequarry/{name}-{uuid.uuid4().hex}"


#: Spark takes the size of Parquet files for that of their rows. Written like this it is; else millions of keys, packed into less than
#: spark.sql.autoBroadcastJoinThreshold, are broadcast through the driver.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}


def kept(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """df written as Parquet and read back: what non-deterministic plans gave stays as it is, and lost executors cost nothing.

    plain: neither encoded nor compressed, for tables of keys that are joined.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**(PLAIN if plain else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def removed(*tables: DataFrame) -> None:
    """Deletes tables made by kept() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(t.kept_path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
