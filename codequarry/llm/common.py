"""Shared plumbing of the corpus operators: shared-folder tables, worker imports, Arrow slices."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.shipping import ship

__all__ = ["apart", "claim", "forget", "new_path", "shared_dir", "ship", "slices", "table", "text_hash", "unused", "with_fields", "written"]

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, a new local one does for a local master; a cluster needs the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="codequarry-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return "file://" + _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/codequarry/{name}-{uuid.uuid4().hex}"


#: While a table is written: Spark deletes an execution's shuffle files when it ends, and hands Python 8 MB at a time.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, lost executors cost nothing.

    What its plan shuffled is deleted as soon as the table is complete.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = {k: spark.conf.get(k) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def apart(df: DataFrame) -> DataFrame:
    """df dealt out anew: a join on the key that it was grouped by then shuffles both sides, and Spark can split a hot key's rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no result reads any more."""
    for t in tables:
        path = getattr(t, "written_path", None)
        if path:
            jvm = t.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: T.StructType, drop: set[str], *extra: tuple[str, T.DataType]) -> T.StructType:
    """schema without the fields named in drop or extra (in any letter case), then extra."""
    gone = {x.lower() for x in drop} | {n.lower() for n, _ in extra}
    return T.StructType([f for f in schema.fields if f.name.lower() not in gone] + [T.StructField(n, t) for n, t in extra])


_held: dict[str, Callable[[], object]] = {}


def claim(name: str, drop: Callable[[], object]) -> None:
    """Said by a worker that starts on an operator's rows: what other operators have kept in this process is dropped, as drop() will drop this one's."""
    for other in [x for x in _held if x != name]:
        _held.pop(other)()
    _held[name] = drop
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the strings of one column stay below about `most` bytes a slice; a longer row comes alone."""
    for b in batches:
        if not b.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype("float64"))
        start = 0
        while start < b.num_rows:
            base = total[start - 1] if start else 0.0
            end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
            yield b.slice(start, end - start)
            start = end


def unused(df: DataFrame, n: int) -> list[str]:
    """n column names that df doesn't have, in any letter case."""
    there, out, i = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"own_{i}" not in there:
            out.append(f"own_{i}")
        i += 1
    return out


def text_hash(column: str) -> "F.Column":
    """A row's text as a key: a null text has a key of its own."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("t"), F.col(column)), F.lit("")))

