"""Retrieval and context for a whole table of queries in one plan, repository by repository (PIP1, PIP3-4, PIP14, AGG9, STR3).

Tokens count as substrings, so words can't be looked up: chunks are indexed by the grams of three characters that the queries' strings are made
of (fewer for shorter strings). The lists of a string's rarest grams are intersected, and what is left is verified against the chunk,
whose text is met once for all strings that could stand in it. Document frequencies are counts of verified rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators.retrieval import ranks
from codequarry.tables import kept

#: Characters of a gram, and how many of a string's rarest grams are intersected before it is verified.
GRAM, RAREST = 3, 2
#: Grams that a text is asked for one by one.
FEW = 256
#: Channels in order of their names in a result.
CHANNELS = ["exact", "lexical", "dense", "graph"]
QUERY = ["repo", "query_id"]


def grams(text: Column, size: int = GRAM) -> Column:
    """All runs of `size` characters of a text, each once."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def postings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """repo, chunk_id, gram: where texts (repo, chunk_id, text) hold a gram of wanted (repo, gram).

    Where a repository's queries want FEW grams or fewer, each text is asked for them; beyond, its own grams are listed and those wanted stay.
    """
    wanted = wanted.distinct()
    counted = kept(wanted.join(wanted.groupBy("repo").agg(F.count("*").alias("n")), "repo"), "grams-wanted", plain=True)
    few = counted.where(F.col("n") <= FEW).groupBy("repo").agg(F.collect_list("gram").alias("grams"))
    asked = texts.join(few, "repo").select("repo", "chunk_id", F.explode(F.filter("grams", lambda g: F.contains(F.col("text"), g))).alias("gram"))
    many = counted.where(F.col("n") > FEW)
    sizes = [r[0] for r in many.select(F.length("gram").alias("n")).distinct().collect()]  # GRAM numbers at most
    if not sizes:
        return asked
    rest = texts.join(many.select("repo").distinct(), "repo", "left_semi")
    listed = reduce(lambda a, b: a.unionByName(b), [rest.select("repo", "chunk_id", F.explode(grams(F.col("text"), n)).alias("gram")) for n in sorted(sizes)])
    return asked.unionByName(listed.join(many.select("repo", "gram"), ["repo", "gram"], "left_semi").select("repo", "chunk_id", "gram"))


def occurrences(chunks: DataFrame, strings: DataFrame) -> DataFrame:
    """repo, chunk_id, string, in_content, in_symbol (numbers of non-overlapping occurrences), is_symbol, in_path: the chunks that hold a string, in any case.

    chunks: repo, chunk_id, content, symbol, file_path. strings: repo, string (lower-cased, not empty). Equal to looking for every string in every chunk.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    texts = chunks.select("repo", "chunk_id", low("content").alias("c"), low("symbol").alias("s"), low("file_path").alias("p"))
    wanted = strings.select("repo", "string").distinct()
    size = F.least(F.length("string"), F.lit(GRAM))
    own = wanted.select("repo", "string", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("string") - size + 1), lambda i: F.substring(F.col("string"), i, size)))).alias("gram"))
    own = kept(own, "string-grams", plain=True)
    index = kept(postings(texts.select("repo", "chunk_id", F.concat_ws("\n", "c", "s", "p").alias("text")), own.select("repo", "gram")), "postings", plain=True)
    rare = own.join(index.groupBy("repo", "gram").agg(F.count("*").alias("n")), ["repo", "gram"], "left")
    # a string with a gram that no chunk holds stands nowhere
    lists = rare.groupBy("repo", "string").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("x")).where(F.col("x")[0]["n"] > 0)
    lists = lists.select("repo", "string", F.slice("x", 1, RAREST).alias("x")).select("repo", "string", F.size("x").alias("k"), F.explode("x").alias("x")).select("repo", "string", "k", "x.gram")
    lists = kept(lists, "string-lists", plain=True)  # as large as the strings, and known to be so before the postings are read
    could = index.join(lists, ["repo", "gram"]).groupBy("repo", "chunk_id", "string", "k").agg(F.count("*").alias("n")).where("n = k")
    asked = could.groupBy("repo", "chunk_id").agg(F.collect_list("string").alias("strings"))
    found = texts.join(asked, ["repo", "chunk_id"]).select("repo", "chunk_id", "c", "s", "p", F.explode("strings").alias("string"))
    t = F.col("string")
    return found.select("repo", "chunk_id", "string", X.count_of(F.col("c"), t).alias("in_content"), X.count_of(F.col("s"), t).alias("in_symbol"), (F.col("s") == t).alias("is_symbol"), F.contains("p", t).alias("in_path")).where("in_content + in_symbol > 0 or in_path")


def tokens(queries: DataFrame) -> DataFrame:
    """repo, query_id, at, string: the tokens of queries (repo, query_id, text) in order."""
    return queries.select(*QUERY, F.posexplode(X.query_tokens(F.col("text"))).alias("at", "string"))


def phrase(queries: DataFrame) -> DataFrame:
    """repo, query_id, string: what the exact channel looks for; '' for a blank query."""
    return queries.select(*QUERY, F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")).alias("string"))


def lexical(queries: DataFrame, chunks: DataFrame, found: DataFrame, symbol_boost: float = 3.0, digits: int | None = None) -> DataFrame:
    """repo, query_id, chunk_id, score as retrieval.lexical() gives it for each query in its repository; found: occurrences(). Scores are added in the
    order of the tokens, and rounded to digits if given."""
    hits = found.where("in_content + in_symbol > 0").select("repo", "chunk_id", "string", (F.col("in_content") + symbol_boost * F.col("in_symbol")).alias("tf"))
    sizes = chunks.groupBy("repo").agg(F.count("*").alias("docs"))
    weights = hits.groupBy("repo", "string").agg(F.count("*").alias("df")).join(sizes, "repo").select("repo", "string", X.idf(F.col("docs"), F.col("df")).alias("idf"))
    asked = kept(tokens(queries).join(weights, ["repo", "string"]), "weights", plain=True)
    met = asked.join(hits, ["repo", "string"]).select(*QUERY, "chunk_id", F.struct("at", (F.col("idf") * X.saturation(F.col("tf"))).alias("w")).alias("x"))
    total = F.aggregate(F.array_sort(F.collect_list("x")), F.lit(0.0), lambda s, x: s + x["w"])
    return met.groupBy(*QUERY, "chunk_id").agg((total if digits is None else F.round(total, digits)).alias("score"))


def exact(queries: DataFrame, chunks: DataFrame, found: DataFrame) -> DataFrame:
    """repo, query_id, chunk_id, score of the exact channel; a blank query meets every chunk of its repository."""
    asked = phrase(queries)
    score = F.when(F.col("is_symbol"), F.lit(1.0)).when(F.col("in_symbol") > 0, F.lit(0.8)).when(F.col("in_path"), F.lit(0.6))
    some = asked.where("string <> ''").join(found, ["repo", "string"]).select(*QUERY, "chunk_id", score.alias("score")).where("score is not null")
    blank = F.when(F.coalesce("symbol", F.lit("")) == "", F.lit(1.0)).otherwise(F.lit(0.8))
    every = asked.where("string = ''").join(chunks.select("repo", "chunk_id", blank.alias("score")), "repo").select(*QUERY, "chunk_id", "score")
    return some.unionByName(every)


def _first(rows: DataFrame, most: Column | int, order: list[Column]) -> DataFrame:
    """The first rows of each query; Spark cuts each task's before they are shuffled."""
    w = Window.partitionBy(*QUERY).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def dense(queries: DataFrame, vectors: DataFrame, pool: int) -> DataFrame:
    """repo, query_id, chunk_id, score of each query's `pool` nearest vectors of its repository; queries without a vector have none."""
    asked = queries.where("vector is not null").select(*QUERY, "vector")
    met = asked.join(vectors.select("repo", "chunk_id", "embedding"), "repo").select(*QUERY, "chunk_id", X.unit_score(X.cosine(F.col("embedding"), F.col("vector"))).alias("score"))
    return _first(met, max(0, pool), [F.desc("score"), F.col("chunk_id")])


def graph(hits: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: int = 5, out_weight: float = 0.7, in_weight: float = 0.6) -> DataFrame:
    """repo, query_id, chunk_id, score: chunks of files beside those of each query's first exact hits, the seeds left out."""
    top = kept(_first(hits, seeds, [F.desc("score"), F.col("chunk_id")]).select(*QUERY, "chunk_id"), "seeds", plain=True)
    files = top.join(chunks.select("repo", "chunk_id", "file_path"), ["repo", "chunk_id"]).select(*QUERY, "file_path").distinct()
    at = files.select(*QUERY, F.explode(F.array(F.concat(F.lit("file:"), "file_path"), F.concat(F.lit("test:"), "file_path"))).alias("at"))
    side = lambda here, there, w: at.join(edges.select("repo", F.col(here).alias("at"), F.col(there).alias("id")), ["repo", "at"]).select(*QUERY, "id", F.lit(w).alias("w"))
    beside = side("source", "target", out_weight).unionByName(side("target", "source", in_weight))
    weight = beside.join(nodes.select("repo", "id", "file_path").where("file_path is not null"), ["repo", "id"]).groupBy(*QUERY, "file_path").agg(F.max("w").alias("score"))
    return weight.join(chunks.select("repo", "chunk_id", "file_path"), ["repo", "file_path"]).select(*QUERY, "chunk_id", "score").join(top, [*QUERY, "chunk_id"], "left_anti")


def retrieve(queries: DataFrame, chunks: DataFrame, top_k: int = 10, vectors: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None, variants: dict[str, list[str]] | None = None, digits: int | None = None, k: int = 60) -> DataFrame:
    """variant, repo, query_id, rank, chunk_id, score, channels: each query's best chunks in its repository by rank fusion, cut to top_k after filtering.

    queries: repo, query_id, text, and where wanted vector (array), path_filter, kind_filter. chunks: repo, chunk_id, file_path, symbol, symbol_kind, content. vectors: repo,
    chunk_id, embedding. nodes: repo, id, file_path; edges: repo, source, target. variants: the channels of each, fused from the same rankings; without them, one
    named `all` of every channel. Chunks are read once for the index and once to verify, whatever the number of queries.
    """
    extra = {"vector": "array<double>", "path_filter": "string", "kind_filter": "string"}
    queries = queries.withColumns({c: F.lit(None).cast(t) for c, t in extra.items() if c not in queries.columns})
    strings = tokens(queries).select("repo", "string").unionByName(phrase(queries).select("repo", "string").where("string <> ''")).distinct()
    found = kept(occurrences(chunks, strings), "occurrences", plain=True)
    hits = kept(exact(queries, chunks, found), "exact", plain=True)
    rows = {"exact": hits, "lexical": lexical(queries, chunks, found, digits=digits)}
    if vectors is not None:
        rows["dense"] = dense(queries, vectors, 2 * top_k)
    if nodes is not None and edges is not None:
        rows["graph"] = graph(hits, chunks, nodes, edges)
    every = reduce(lambda a, b: a.unionByName(b), [df.select(*QUERY, "chunk_id", "score", F.lit(n).alias("channel")) for n, df in rows.items()])
    ranked = ranks(every, [*QUERY, "channel"])
    variants = variants or {"all": CHANNELS}
    of = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(c).alias("channel"), F.lit(CHANNELS.index(c)).alias("place")) for v, own in variants.items() for c in own])
    each = ranked.select(*QUERY, "chunk_id", "rank", F.explode(F.filter(of, lambda x: x["channel"] == F.col("channel"))).alias("x")).select("x.variant", *QUERY, "chunk_id", X.rrf(F.col("rank"), k).alias("r"), F.struct("x.place", "x.channel").alias("c"))
    names = F.transform(F.array_sort(F.collect_list("c")), lambda x: x["channel"])
    # added in the order of the channels, so that equal places give equal scores
    score = F.aggregate(F.array_sort(F.collect_list(F.struct("c", "r"))), F.lit(0.0), lambda s, x: s + x["r"])
    fused = each.groupBy("variant", *QUERY, "chunk_id").agg(score.alias("score"), names.alias("channels"))
    about = queries.select(*QUERY, "path_filter", "kind_filter")
    fused = fused.join(chunks.select("repo", "chunk_id", "file_path", "symbol_kind"), ["repo", "chunk_id"]).join(about, QUERY)
    fused = fused.where("(coalesce(path_filter, '') = '' or contains(file_path, path_filter)) and (coalesce(kind_filter, '') = '' or symbol_kind = kind_filter)")
    w = Window.partitionBy("variant", *QUERY).orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("variant", *QUERY, "rank", "chunk_id", "score", "channels")


def bundles(retrieved: DataFrame, chunks: DataFrame, edges: DataFrame, contracts: DataFrame, findings: DataFrame, budget: int = 3000, max_chunks: int = 4, edge_cap: int = 20, contract_cap: int = 10, finding_cap: int = 15) -> DataFrame:
    """repo, query_id, chunks, edges, contracts, findings, estimated_tokens: a context for each query of retrieved (repo, query_id, rank, chunk_id, score).

    The longest prefix of the best max_chunks chunks whose characters fit in 4 * budget (the first always), edges at either end of their files by write_seq, contracts of
    their files by request_id, and whole files' findings, by path, until finding_cap is passed. edges: repo, write_seq, source, target. contracts: repo,
    request_id, frontend_file. findings: repo, file_path, description and others. The caps are the feature: they bound what a context holds.
    """
    retrieved = kept(retrieved.select(*QUERY, "rank", "chunk_id", "score"), "retrieved", plain=True)
    top = retrieved.where(F.col("rank") <= max_chunks).join(chunks, ["repo", "chunk_id"])
    w = Window.partitionBy(*QUERY).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    top = kept(top.withColumn("__total", F.sum(F.length("content")).over(w)).where((F.col("__total") <= 4 * budget) | (F.col("rank") == 1)).drop("__total"), "context")
    files = top.select(*QUERY, "file_path").distinct()
    ids = files.select(*QUERY, F.explode(F.array(F.concat(F.lit("file:"), "file_path"), F.concat(F.lit("test:"), "file_path"))).alias("at"))
    side = lambda c: edges.withColumn("at", F.col(c)).join(ids, ["repo", "at"]).drop("at")
    near = _first(side("source").unionByName(side("target")).distinct(), edge_cap, [F.col("write_seq"), F.col("source"), F.col("target")])
    matched = _first(contracts.withColumn("file_path", F.col("frontend_file")).join(files, ["repo", "file_path"]).drop("file_path"), contract_cap, [F.col("request_id")])
    counts = findings.groupBy("repo", "file_path").agg(F.count("*").alias("n")).join(files, ["repo", "file_path"])
    before = Window.partitionBy(*QUERY).orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
    open_ = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < finding_cap).select(*QUERY, "file_path")
    open_ = kept(open_, "open-files", plain=True)
    told = findings.join(open_, ["repo", "file_path"])
    pack = lambda df, name: df.groupBy(*QUERY).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c not in QUERY]))).alias(name))
    chars = told.groupBy(*QUERY).agg(F.sum(F.length("description")).alias("d"))
    texts = top.groupBy(*QUERY).agg(F.sum(F.length("content")).alias("c"))
    out = retrieved.select(*QUERY).distinct()
    for part in (pack(top.select(*QUERY, "rank", "chunk_id", "file_path", "score", "content"), "chunks"), pack(near, "edges"), pack(matched, "contracts"), pack(told, "findings"), chars, texts):
        out = out.join(part, QUERY, "left")
    size = F.greatest(F.lit(1), F.floor((F.coalesce("c", F.lit(0)) + F.coalesce("d", F.lit(0))) / 4))
    return out.select(*QUERY, *[F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c) for c in ("chunks", "edges", "contracts", "findings")], size.alias("estimated_tokens"))
