"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a document are hashed together. A window whose
hash stands anywhere earlier (in the order of document key, then position) is
a later occurrence; the lines that later occurrences cover, merged, are removed.
All in DataFrame operations: only 16-byte hashes and positions are shuffled, and the
texts once to meet the positions to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import apart, text_hash, unused

SIZE = 3


def removals(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, th (hash of the text), cover array<int>: starts of the windows that stand earlier somewhere."""
    lines = docs.select(F.col(key_col).alias("key"), text_hash(text_col).alias("th"), F.split(text_col, "\n", -1).alias("lines")).where(F.size("lines") >= SIZE)
    hashes = lambda i: [F.col("lines")[i + j] for j in range(SIZE)]
    windows = F.transform(F.sequence(F.lit(0), F.size("lines") - SIZE), lambda i: F.struct(F.xxhash64(*hashes(i)).alias("h1"), F.xxhash64(F.lit(7), *hashes(i)).alias("h2"), i.cast("int").alias("i")))
    rows = lines.select("key", "th", F.explode(windows).alias("x")).select("key", "th", "x.h1", "x.h2", "x.i")
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("key", "th", "i")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    own = F.struct("key", "th", "i")
    later = rows.join(apart(first), ["h1", "h2"]).where(~own.eqNullSafe(F.col("first")))
    return later.groupBy("key", "th").agg(F.collect_set("i").alias("cover"))


def dedup(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with repeated lines taken out of text_col; all other columns stay as they are.

    With counts, n_lines and n_removed (long) follow, replacing columns so named. Lines are parted by \\n alone and
    compared as they are. Texts below three lines have no window and stay; a null text stays null, with 0 lines.
    Null keys come first. Rows equal in key and text are one document listed more than once: each gets the same
    result. A document all of whose lines go stays, with an empty text.
    """
    key, th, cover, lines, covered, all_, less = unused(docs, 7)
    gone = removals(docs, key_col, text_col).withColumnsRenamed({"key": key, "th": th, "cover": cover})
    joined = docs.join(gone, F.col(key_col).eqNullSafe(F.col(key)) & (text_hash(text_col) == F.col(th)), "left")
    joined = joined.withColumns({lines: F.split(text_col, "\n", -1), covered: F.array_distinct(F.flatten(F.transform(cover, lambda i: F.array(*[i + j for j in range(SIZE)]))))})
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(covered)), lambda i: F.col(lines)[i])
    none = F.lit(0)
    out = joined.withColumns({all_: F.coalesce(F.size(lines), none).cast("long"), less: F.coalesce(F.size(covered), none).cast("long")})
    out = out.withColumn(text_col, F.when(F.col(cover).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))
    if counts:
        out = out.withColumns({"n_lines": F.col(all_), "n_removed": F.col(less)})
    return out.drop(key, th, cover, lines, covered, all_, less)
