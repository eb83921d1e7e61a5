"""Prefix joins by order: strings and their prefixes sorted together, and swept once with a stack of the prefixes that are open."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.shipping import ship
from codequarry.tables import kept


def prefix_pairs(prefixes: DataFrame, strings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, prefix, string: every prefix (keys, prefix; not empty) with the strings (keys, string) that start with it, each pair once.

    In byte order the strings that start with a prefix follow it directly. Both are dealt out in ranges of that order, so no key, and no prefix that very
    many strings share, is one task's; the prefixes still open where a range begins are looked up by the prefixes of its first string.
    Rows made are those of the two tables and of the result.
    """
    spark = strings.sparkSession
    ship(spark)
    own = prefixes.select(*keys, F.col("prefix").alias("s")).where("s <> ''").distinct()
    rows = own.withColumn("kind", F.lit(0)).unionByName(strings.select(*keys, F.col("string").alias("s"), F.lit(1).alias("kind")).where("s is not null").distinct())
    order = [*keys, "s", "kind"]
    laid = kept(kept(rows, "prefix-rows").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "prefix-ranges")
    first = laid.groupBy("part").agg(F.min(F.struct(*order)).alias("x")).select("part", "x.*")
    cuts = first.select("part", *keys, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("s"), F.lit(1))), lambda n: F.substring(F.col("s"), F.lit(1), n))).alias("s"))
    same = [F.col(k).eqNullSafe(F.col(f"own_{k}")) for k in keys]
    open_ = cuts.join(own.select(*[F.col(k).alias(f"own_{k}") for k in keys], F.col("s").alias("own_s")), [F.col("s") == F.col("own_s"), *same], "left_semi")
    both = laid.select("part", *order).unionByName(open_.select("part", *keys, "s", F.lit(0).alias("kind")))
    names = [*keys, "prefix", "string"]

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, stack = None, []
        for b in batches:
            out = []
            for part, *key, s, kind in b[["part", *order]].itertuples(index=False):
                if (part, key) != at:
                    at, stack = (part, key), []
                while stack and not s.startswith(stack[-1]):
                    stack.pop()
                if kind:
                    out += [(*key, p, s) for p in stack]
                elif not stack or stack[-1] != s:
                    stack.append(s)
            yield pd.DataFrame(out, columns=names, dtype="object")

    shape = ", ".join([f"{k} {dict(strings.dtypes)[k]}" for k in keys] + ["prefix string", "string string"])
    return both.repartition("part").sortWithinPartitions("part", *order).mapInPandas(sweep, shape)
