"""A vector store with a folder for each namespace (SRC12, SNK2-3, AGG20): reads and rewrites touch the namespaces they name and no other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.operators import retrieval
from codequarry.tables import kept, removed

SCHEMA = "id string, embedding array<double>, metadata string, model_name string, write_seq long, namespace string"


def read(spark: SparkSession, path: str, *namespaces: str) -> DataFrame:
    """The vectors of some namespaces, or of all if none is named; the folders of others aren't listed."""
    rows = spark.read.schema(SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], SCHEMA)
    return rows.where(F.col("namespace").isin(*namespaces)) if namespaces else rows


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def upsert(new: DataFrame, path: str, dimensions: int) -> None:
    """Writes vectors (in the columns of SCHEMA) over those of the same namespace and id; the last write_seq stays. Another length raises, and nothing is written.

    Only namespaces that new holds are read and rewritten, each as a whole. What they will hold is stored aside first, so that a run that is lost while folders are
    replaced can be repeated. Large namespaces are split over tasks and files.
    """
    spark = new.sparkSession
    fits = F.when(F.size("embedding") == dimensions, F.col("embedding")).otherwise(F.raise_error(F.format_string("%s: a vector of %d instead of %d", "id", F.size("embedding"), F.lit(dimensions))))
    new = kept(new.select(*[fits.alias(c) if c == "embedding" else F.col(c) for c in (f.split()[0] for f in SCHEMA.split(", "))]), "vectors-new")
    old = read(spark, path).join(new.select("namespace").distinct(), "namespace", "left_semi").select(new.columns)
    merged = kept(retrieval.upsert(old, new, ["namespace", "id"]), "vectors")
    merged.hint("rebalance", "namespace").write.partitionBy("namespace").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    removed(new, merged)


def clear(spark: SparkSession, path: str, namespace: str) -> None:
    """Takes a namespace's folder away."""
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(namespace)
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/namespace={name}")
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """AGG20: namespace, n."""
    return read(spark, path).groupBy("namespace").agg(F.count("*").alias("n"))


def nearest(spark: SparkSession, path: str, namespace: str, query: list[float], k: int) -> DataFrame:
    """ORD2, MTH2: chunk_id, score of a namespace's k nearest vectors."""
    return retrieval.dense(read(spark, path, namespace), query, k, "id")
