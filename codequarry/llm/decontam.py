"""Benchmark decontamination on a distributed positional inverted index, in DataFrame operations only.

Training words are tokenised once into a forward table. Counting the test items' words over all of it ranks the words of
each test window by rarity. The index stores a posting (term, document, position) for each occurrence of the rarest terms
of any window. Each window's list of its rarest term is intersected, adjusted by the offset between them, with the list of its
second rarest; what is left is compared word by word with the documents, and is an exact phrase match if all agree.
Where the few rarest terms of a window all stand near one another, in any order and with other words between, that is a
proximity match; its lists meet by blocks of positions.

Equal windows of several items stand once, so a question template or a word that many items share multiplies nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import forget, text_hash, unused, written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes up to which a side of a join is broadcast, as counted beforehand; beyond, Spark shuffles both.
BROADCAST_BYTES = 16 << 20
DOC = ["doc_id", "th"]


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.coalesce(F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), ""), F.array().cast("array<string>"))


def _small(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast if the sizes of its rows add up to little enough."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


@contextmanager
def _bloom_filters(spark: SparkSession) -> Iterator[None]:
    """Within, Spark sifts the large side of shuffle joins by Bloom filters of the small side's keys, whatever the sizes."""
    own = "spark.sql.optimizer.runtime.bloomFilter."
    wish = {own + "enabled": "true", own + "applicationSideScanSizeThreshold": "0b", own + "creationSideThreshold": "1TB"}
    before = {k: spark.conf.get(k) for k in wish}
    for k, v in wish.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _terms(df: DataFrame) -> DataFrame:
    return _small(df, F.octet_length("t") + 32)


@dataclass
class Index:
    """forward: doc_id, th, w, dk (hash of doc_id and th). windows: w1, w2 (hash), ws (words), known (n, t, o of its words that documents have, rarest first).
    owners: w1, w2, item. postings: t, doc_id, th, p."""

    forward: DataFrame
    windows: DataFrame
    owners: DataFrame
    postings: DataFrame


def index(docs: DataFrame, items: DataFrame, window: int = 13, rarest: int = 2, key_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Index:
    """The index of docs for the windows of items, stored in the shared folder: postings of each window's `rarest` rarest terms.

    Items with a null id or without words have no windows; items shorter than `window` are one window each; null texts have no
    words. Rows equal in key and text share their postings' key.
    """
    forward = docs.select(F.col(key_col).alias("doc_id"), text_hash(text_col).alias("th"), words(F.col(text_col)).alias("w"))
    forward = written(forward.select("*", F.xxhash64(*DOC).alias("dk")), "forward")
    test = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    each = test.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, F.lit(window)))).alias("ws"))
    each = each.select("item", "ws", F.xxhash64("ws").alias("w1"), F.xxhash64(F.lit(7), "ws").alias("w2"))
    owners = written(each.select("w1", "w2", "item").distinct(), "owners")
    distinct = written(each.groupBy("w1", "w2").agg(F.first("ws").alias("ws")), "test-windows")
    spots = distinct.select("w1", "w2", F.posexplode("ws").alias("o", "t"))
    # nothing but the word itself is carried past explode
    counts = forward.select(F.explode("w").alias("t")).join(_terms(spots.select("t").distinct()), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    known = spots.join(counts, "t").groupBy("w1", "w2").agg(F.array_sort(F.collect_list(F.struct("n", "t", "o"))).alias("known"))
    windows = written(distinct.join(known, ["w1", "w2"]), "windows")
    forget(distinct)
    # the two rarest places of a window may hold one term; proximity asks for different terms
    needed = F.array_union(F.slice(_distinct_terms("known"), 1, rarest), F.transform(F.slice("known", 1, 2), lambda x: x["t"]))
    terms = windows.select(F.explode(needed).alias("t")).distinct()
    postings = forward.select("doc_id", "th", F.posexplode("w").alias("p", "t")).join(_terms(terms), "t", "left_semi")
    return Index(forward, windows, owners, written(postings.select("t", "doc_id", "th", "p"), "postings"))


def _distinct_terms(known: str) -> Column:
    """Terms of a ranked list, each once, rarest first."""
    return F.array_distinct(F.transform(known, lambda x: x["t"]))


def phrases(own: Index) -> DataFrame:
    """doc_id, th, w1, w2, a, b (first and last word, from 0): all occurrences of windows in documents."""
    whole = own.windows.where("size(known) = size(ws)")  # a window with a word that no document has occurs nowhere
    first, second = F.col("known")[0], F.try_element_at("known", F.lit(2))
    lists = whole.select("w1", "w2", first["t"].alias("t"), first["o"].alias("o"), second["t"].alias("t2"), second["o"].alias("o2"))
    met = own.postings.join(_small(lists, F.octet_length("t") + F.coalesce(F.octet_length("t2"), F.lit(0)) + 64), "t")
    met = met.select(*DOC, "w1", "w2", (F.col("p") - F.col("o")).alias("a"), "t2", (F.col("p") - F.col("o") + F.col("o2")).alias("p2")).where("a >= 0")
    other = own.postings.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), F.col("t").alias("x"), F.col("p").alias("y"))
    both = met.where("t2 is not null").join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("t2") == F.col("x")) & (F.col("p2") == F.col("y")), "left_semi")
    alive = written(met.where("t2 is null").unionByName(both).select(*DOC, "w1", "w2", "a"), "alive")
    texts = own.windows.select("w1", "w2", "ws")
    wide = alive.join(_small(texts, F.octet_length(F.concat_ws(" ", "ws")) + 16 * F.size("ws") + 48), ["w1", "w2"])
    spots = wide.groupBy(*DOC).agg(F.collect_list(F.struct("w1", "w2", "a", "ws")).alias("x")).select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "x")
    # texts are sifted by Spark's Bloom filter of the documents wanted (8 MB at most) before any is shuffled
    wanted = written(alive.select(F.xxhash64(*DOC).alias("dk"), F.lit(1).alias("one")).distinct(), "wanted")
    with _bloom_filters(own.forward.sparkSession):
        texts_met = written(own.forward.join(wanted.where("one > 0"), "dk", "left_semi").select(*DOC, "w"), "texts-met")
    there = texts_met.join(spots, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")))
    same = F.filter("x", lambda m: F.slice("w", m["a"] + 1, F.size(m["ws"])) == m["ws"])
    # rows equal in key and text give the same matches
    found = there.select(*DOC, F.explode(same).alias("m")).select(*DOC, "m.w1", "m.w2", "m.a", (F.col("m.a") + F.size("m.ws") - 1).alias("b"))
    found = written(found.distinct(), "phrases")
    forget(alive, wanted, texts_met)
    return found


def near(own: Index, rarest: int, span: int) -> DataFrame:
    """doc_id, th, w1, w2: windows whose `rarest` rarest terms that documents have (all, if fewer) stand within fewer than `span` words of
    one occurrence of the rarest of them."""
    lists = own.windows.select("w1", "w2", F.slice(_distinct_terms("known"), 1, rarest).alias("ts"))
    size = F.octet_length(F.concat_ws(" ", "ts")) + 80
    at = own.postings.join(_small(lists.withColumn("t", F.col("ts")[0]), size), "t").select(*DOC, "w1", "w2", "p", "ts")
    alone = at.where("size(ts) = 1").select(*DOC, "w1", "w2")
    block = F.floor(F.col("p") / span)
    rest = at.where("size(ts) > 1").select(*DOC, "w1", "w2", "p", F.size("ts").alias("k"), F.explode(F.slice("ts", 2, rarest)).alias("x"))
    rest = rest.withColumn("y", F.explode(F.array(block - 1, block, block + 1)))
    other = own.postings.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "t", F.col("p").alias("q"), block.alias("z"))
    met = rest.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")) & (F.col("x") == F.col("t")) & (F.col("y") == F.col("z")))
    met = met.where(F.abs(F.col("p") - F.col("q")) < span).groupBy(*DOC, "w1", "w2", "p").agg(F.countDistinct("x").alias("n"), F.first("k").alias("k")).where("n = k - 1")
    return alone.unionByName(met.select(*DOC, "w1", "w2")).distinct()


def _items(own: Index, found: DataFrame) -> DataFrame:
    """doc_id, th, items (sorted ids as text) of the windows found."""
    owners = _small(own.owners, F.octet_length("item") + 48)
    return found.select(*DOC, "w1", "w2").distinct().join(owners, ["w1", "w2"]).groupBy(*DOC).agg(F.array_sort(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, share: int = 20, window: int = 13, slop: int | None = None, rarest: int = 3, **columns: str) -> DataFrame:
    """doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated: a row per row of docs.

    A word is hit if an occurrence of an item's window covers it; a document is contaminated if it has hit words and
    they are at least one in `share`. With slop, n_near follows: the number of items with a window whose `rarest` rarest terms stand
    within window + slop words (exact matches among them). See index() for nulls, short items and repeated rows; empty tables give
    no rows, or rows without hits. th tells texts of one key apart.
    """
    own = index(docs, items, window, 2 if slop is None else max(2, rarest), **columns)
    found = phrases(own)
    hit = found.groupBy(*DOC).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    hit = hit.select(*DOC, F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"]))))).cast("long").alias("n_hit"))
    parts = [hit, _items(own, found)]
    if slop is not None:
        parts.append(_items(own, near(own, rarest, window + slop)).select(*DOC, F.size("items").cast("long").alias("n_near")))
    sized = out = written(own.forward.select(*DOC, F.size("w").cast("long").alias("n_words")), "sized")
    for part in parts:
        part = part.withColumnsRenamed({"doc_id": "d", "th": "h"})
        out = out.join(part, sized.doc_id.eqNullSafe(part.d) & (sized.th == part.h), "left").drop("d", "h")
    none = F.lit(0).cast("long")
    out = out.withColumns({
        "n_hit": F.coalesce("n_hit", none),
        "n_items": F.coalesce(F.size("items").cast("long"), none),
        "items_sha256": F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256),
    })
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
    names = [*DOC, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    if slop is None:
        forget(own.forward, own.windows, own.postings)
        return out.select(*names)
    return out.select(*names, F.coalesce("n_near", none).alias("n_near"))


def clean(docs: DataFrame, items: DataFrame, key_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """docs without the contaminated rows, all columns as they are."""
    k, h = unused(docs, 2)
    bad = contamination(docs, items, key_col=key_col, text_col=text_col, **options).where("contaminated").select(F.col("doc_id").alias(k), F.col("th").alias(h)).distinct()
    return docs.join(bad, F.col(key_col).eqNullSafe(F.col(k)) & (text_hash(text_col) == F.col(h)), "left_anti")
