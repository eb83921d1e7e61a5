"""SimHash near-duplicates through the bit counts of fingerprint segments.

A fingerprint is cut into segments, and the number of bits set in each makes it a point of a small grid. Flipping a bit moves the
point by one step in one dimension, so the Manhattan distance of two points is never above the Hamming distance of their fingerprints. Two
points at distance two or less have a grid point within one step of both: every fingerprint is put into the cells one step
around its point, and those that meet in a cell are verified on all bits.

A cell that many different fingerprints share would give pairs by its square. Its fingerprints are linked through the fingerprints one bit
around each: two differ in two bits at most exactly if they have one of those in common, so each is linked to the least that
shares it, and nothing is paired. Equal fingerprints stand once throughout.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import apart, forget, ship, slices, written
from codequarry.llm.jaccard import _components

SEED = 42
#: Fingerprints link at this many differing bits at most: one step from either side.
BITS = 2
#: More fingerprints than this in a cell are linked bit by bit instead of in pairs.
CROWD = 32
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(data):
        m = _BLANK.search(data, start + PIECE)
        end = m.start() if m else len(data)
        yield data[start:end]
        start = end


def fingerprint(text: str | None, n: int = 3) -> int:
    """The text's 64-bit fingerprint: a bit is set if it is in over half of the XXH64 hashes of its n-word shingles, repeats included.

    A-Z are lower-cased; fewer words than n are one shingle; none give 0.
    """
    ones, total, carry = np.zeros(64, np.int64), 0, []
    for piece in _pieces((text or "").encode("utf-8", "replace")):
        words = carry + piece.lower().split()
        if len(words) < n:
            carry = words
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = (ends - [len(w) + 1 for w in words])[: len(words) - n + 1].tolist()
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist(), strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
        carry = words[len(words) - n + 1 :]
    if not total and carry:
        return xxhash.xxh64_intdigest(b" ".join(carry), SEED)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long (the fingerprint's 64 bits), one row per row of docs."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = np.array([fingerprint(t.as_py(), n) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return rows.mapInArrow(mark, rows.select("doc_id").withColumn("fp", F.lit(0).cast("long")).schema)


def _bits(width: int) -> int:
    """The low bit of every segment of this width, as a signed long."""
    return int.from_bytes(sum(1 << i for i in range(0, 64, width)).to_bytes(8, "little"), "little", signed=True)


def point(fp: Column, width: int) -> Column:
    """Bits set per segment of width 2, 4 or 8, each count in its own segment of a long."""
    if width not in (2, 4, 8):
        raise ValueError("width must be 2, 4 or 8")
    low = F.lit(_bits(2))
    a, b = fp.bitwiseAND(low), F.shiftrightunsigned(fp, 1).bitwiseAND(low)
    x = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    for half in [h for h in (2, 4) if h < width]:
        mask = F.lit(_bits(2 * half) * ((1 << half) - 1))
        x = x.bitwiseAND(mask) + F.shiftrightunsigned(x, half).bitwiseAND(mask)
    return x


def cells(point_col: str, width: int) -> Column:
    """The grid points one step around a point, itself included."""
    p = F.col(point_col)
    lane = lambda s: F.shiftrightunsigned(p, s).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    moved = lambda s, d: p.bitwiseXOR(F.shiftleft(lane(s).bitwiseXOR(lane(s) + d), s))
    up = [F.when(lane(s) < width, moved(s, 1)) for s in range(0, 64, width)]
    down = [F.when(lane(s) > 0, moved(s, -1)) for s in range(0, 64, width)]
    return F.array_compact(F.array(p, *up, *down))


def links(marks: DataFrame, width: int = 4, crowd: int = CROWD) -> DataFrame:
    """a, b: links between the different fingerprints of marks (fp) that join all that BITS differing bits connect; each links fingerprints that differ in
    no more. Cells of up to `crowd` fingerprints give all of theirs, crowded ones give stars."""
    points = marks.select("fp", point(F.col("fp"), width).alias("own_point"))
    around = points.select("fp", F.explode(cells("own_point", width)).alias("z"))
    counted = written(around.groupBy("z").agg(F.count("*").alias("k"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("k > 1"), "cells")
    close = f"bit_count(a ^ b) <= {BITS}"
    two = counted.where("k = 2").where(close).select("a", "b")
    held = around.join(counted.where(f"k between 3 and {crowd}").select("z"), "z").groupBy("z").agg(F.collect_list("fp").alias("x"))
    held = held.select(F.explode("x").alias("a"), "x").select("a", F.explode(F.filter("x", lambda b: (b > F.col("a")) & (F.bit_count(F.col("a").bitwiseXOR(b)) <= BITS))).alias("b"))
    many = around.join(counted.where(f"k > {crowd}").select("z"), "z", "left_semi").select("fp").distinct()
    near = written(many.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(64)])).alias("w")), "bits-around")
    least = near.groupBy("w").agg(F.min("fp").alias("a"), F.count("*").alias("k")).where("k > 1").select("w", "a")
    stars = near.join(apart(least), "w").where("fp <> a").select("a", F.col("fp").alias("b"))
    out = written(two.unionByName(held).unionByName(stars).distinct(), "links")
    forget(counted, near)
    return out


def groups(docs: DataFrame, n: int = 3, width: int = 4, crowd: int = CROWD, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest key that links at BITS differing bits or fewer lead to.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows of a null key take part but name no group: one of null
    keys alone has component_id null. Repeated rows are linked with one another. Columns of docs beside the two take no part; an empty
    table gives no rows. A text is cut into words a megabyte at a time.
    """
    rows = written(fingerprints(docs, n, key_col, text_col), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    found = links(classes.select("fp"), width, crowd)
    labels = _components(found)
    named = classes.join(labels.withColumnsRenamed({"c": "fp"}), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "label").select("fp", "component_id"), "named")
    forget(found, labels, classes)
    out = rows.join(apart(named), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
