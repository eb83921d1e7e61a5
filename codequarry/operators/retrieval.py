"""Hybrid retrieval over chunks: exact, lexical, dense and graph channels, rank fusion, budgets (PIP1-4, AGG9-13, WIN1, WIN3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.tables import kept


def tokens_of(query: str) -> list[str]:
    import re

    return [t.lower() for t in re.findall(r"\w+", query) if len(t) > 1]


def exact(chunks: DataFrame, query: str) -> DataFrame:
    """chunk_id, score of the exact channel (STR4)."""
    return chunks.select("chunk_id", X.exact_score(F.col("symbol"), F.col("file_path"), query).alias("score")).where("score is not null")


def lexical(chunks: DataFrame, query: str, symbol_boost: float = 3.0) -> DataFrame:
    """chunk_id, score by token frequency and rarity (AGG9, MTH3-4): tokens count as substrings, repeats in the query count again.

    One pass finds the number of chunks and every token's document frequency; the tokens stay literals, so no text is copied per token.
    """
    tokens = tokens_of(query)
    if not tokens:
        return chunks.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    c, s = F.lower(F.coalesce("content", F.lit(""))), F.lower(F.coalesce("symbol", F.lit("")))
    distinct = list(dict.fromkeys(tokens))
    stats = chunks.agg(F.count("*").alias("n"), *[F.count_if(c.contains(t) | s.contains(t)).alias(f"df{i}") for i, t in enumerate(distinct)])
    frequency = lambda t: X.count_of(c, F.lit(t)) + symbol_boost * X.count_of(s, F.lit(t))
    terms = [X.idf(F.col("n"), F.col(f"df{distinct.index(t)}")) * X.saturation(frequency(t)) for t in tokens]
    scored = chunks.crossJoin(F.broadcast(stats)).select("chunk_id", reduce(lambda a, b: a + b, terms).alias("score"))  # stats is one row
    return scored.where("score > 0")


def dense(vectors: DataFrame, query: list[float], k: int, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """chunk_id, score of the k nearest vectors by cosine (ORD2); k <= 0 gives none."""
    q = F.array(*[F.lit(float(v)) for v in query])
    scored = vectors.select(F.col(id_col).alias("chunk_id"), X.unit_score(X.cosine(F.col(vector_col), q)).alias("score"))
    return scored.orderBy(F.desc("score"), "chunk_id").limit(max(0, k))


def graph(chunks: DataFrame, exact_hits: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: int = 5, out_weight: float = 0.7, in_weight: float = 0.6) -> DataFrame:
    """chunk_id, score: chunks in files beside those of the top exact hits (JN14); the seeds themselves are left out."""
    top = exact_hits.orderBy(F.desc("score"), "chunk_id").limit(seeds)
    files = top.join(chunks, "chunk_id").select("file_path").distinct()
    held = nodes.where(F.col("kind").isin("FILE", "TEST")).join(F.broadcast(files), "file_path", "left_semi").select(F.col("id").alias("at"))  # seeds rows at most
    held = F.broadcast(held)
    beside = edges.join(held, edges.source == held["at"]).select(F.col("target").alias("id"), F.lit(out_weight).alias("w"))
    beside = beside.unionByName(edges.join(held, edges.target == held["at"]).select(F.col("source").alias("id"), F.lit(in_weight).alias("w")))
    weight = beside.join(nodes, "id").where("file_path is not null").groupBy("file_path").agg(F.max("w").alias("score"))
    return chunks.join(weight, "file_path").select("chunk_id", "score").join(F.broadcast(top.select("chunk_id")), "chunk_id", "left_anti")


def ranks(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """rows (channel, score, chunk_id and others) with rank: the 1-based place in its channel by score, then id.

    Rows are sorted into ranges over all tasks; a place is one in a range plus the rows of the ranges before, of which there is a number per
    range and channel. keys (channel alone, if not given) name what is ranked by itself, such as each query's channels.
    """
    keys = keys or ["channel"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*keys, F.desc("score"), "chunk_id"]
    # the ranges are told from a sample: the channels are worked out once, not once more for that
    laid = kept(kept(rows, "scores").repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranks", plain=True)
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy(*keys, "range").agg(F.count("*").alias("n")).select(*keys, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy(*keys, "range").orderBy(F.desc("score"), "chunk_id"))
    return laid.join(kept(sizes, "range-sizes", plain=True), [*keys, "range"]).withColumn("rank", own + F.col("before")).drop("range", "before")


def fuse(channels: dict[str, DataFrame], k: int = 60) -> DataFrame:
    """chunk_id, score, channels: reciprocal rank fusion (WIN1, AGG12, SET7) of (chunk_id, score) channels."""
    rows = [df.select("chunk_id", "score", F.lit(n).alias("channel"), F.lit(i).alias("place")) for i, (n, df) in enumerate(channels.items())]
    every = reduce(lambda a, b: a.unionByName(b), rows)
    names = F.transform(F.array_sort(F.collect_set(F.struct("place", "channel"))), lambda x: x["channel"])
    return ranks(every).groupBy("chunk_id").agg(F.sum(X.rrf(F.col("rank"), k)).alias("score"), names.alias("channels"))


def retrieve(chunks: DataFrame, query: str, top_k: int = 10, vectors: DataFrame | None = None, query_vector: list[float] | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, path_filter: str | None = None, kind_filter: str | None = None, rerank: DataFrame | None = None) -> DataFrame:
    """PIP1-2: fused ranking, filtered after fusion (FLT6), cut to top_k, then re-ordered by rerank scores where there are any."""
    found = {"exact": exact(chunks, query), "lexical": lexical(chunks, query)}
    if vectors is not None and query_vector is not None:
        found["dense"] = dense(vectors, query_vector, 2 * top_k)
    if nodes is not None and edges is not None:
        found["graph"] = graph(chunks, found["exact"], nodes, edges)
    out = fuse(found).join(chunks, "chunk_id")
    if path_filter:
        out = out.where(F.lower("file_path").contains(path_filter.lower()))
    if kind_filter:
        out = out.where(F.col("symbol_kind") == kind_filter)
    out = out.orderBy(F.desc("score"), "chunk_id").limit(max(0, top_k))
    if rerank is not None:
        out = out.join(rerank.select("chunk_id", F.col("score").alias("rerank_score")), "chunk_id", "left").withColumn("score", F.coalesce("rerank_score", "score")).orderBy(F.desc("score"), "chunk_id")
    return out


def within_budget(ranked: DataFrame, tokens: int, order: list[Column], size: Column, partition: list[str] | None = None) -> DataFrame:
    """WIN3: the longest prefix whose characters fit in 4 * tokens; the first row always stays.

    Without a partition the rows meet in one task: cut them to a top-k before, as context_bundle() does.
    """
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    out = ranked.withColumn("__total", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__rank", F.row_number().over(w))
    return out.where((F.col("__total") <= 4 * tokens) | (F.col("__rank") == 1)).drop("__total", "__rank")


def context_bundle(retrieved: DataFrame, edges: DataFrame, contracts: DataFrame, findings: DataFrame, tokens: int = 4000, max_chunks: int = 5, edge_cap: int = 20, contract_cap: int = 10, finding_cap: int = 15) -> DataFrame:
    """PIP3: one row with chunks, edges, contracts, findings and the token estimate (JN15-17, AGG11, AGG21, ORD8)."""
    top = within_budget(retrieved.orderBy(F.desc("score"), "chunk_id").limit(max_chunks), tokens, [F.desc("score"), F.col("chunk_id")], F.length("content"))
    files = F.broadcast(top.select("file_path").distinct())  # max_chunks rows at most
    ids = files.select(F.explode(F.array(F.concat(F.lit("file:"), "file_path"), F.concat(F.lit("test:"), "file_path"))).alias("id"))
    near = edges.join(ids, F.col("source") == F.col("id"), "left_semi").unionByName(edges.join(ids, F.col("target") == F.col("id"), "left_semi")).distinct().orderBy("write_seq").limit(edge_cap)
    matched = contracts.join(files.select(F.col("file_path").alias("frontend_file")), "frontend_file", "left_semi").orderBy("request_id").limit(contract_cap)
    per = findings.join(files, "file_path", "left_semi")
    before = per.groupBy("file_path").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = per.join(F.broadcast(before.where(F.col("before") < finding_cap).select("file_path")), "file_path", "left_semi")
    pack = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    sizes = top.agg(F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("c")).crossJoin(kept.agg(F.coalesce(F.sum(F.length("description")), F.lit(0)).alias("d")))
    parts = [pack(top, "chunks"), pack(near, "edges"), pack(matched, "contracts"), pack(kept, "findings"), sizes.select(F.greatest(F.lit(1), F.floor((F.col("c") + F.col("d")) / 4)).alias("estimated_tokens"))]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # each is one row


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str = "write_seq") -> DataFrame:
    """SNK2, WIN4: the last write of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
