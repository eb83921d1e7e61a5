"""Quality metrics of retrieval, findings and remediation, and the runs that give them (AGG14-17, JN21, PIP11-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators import batch, retrieval


def ranking_metrics(ranked: DataFrame, expected: DataFrame, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """AGG14, WIN9: query_id, recall, mrr. ranked: query_id, chunk_id, rank; expected: query_id, chunk_id (null: nothing is expected, recall 1)."""
    by = by or []
    e = expected.select("query_id", "chunk_id").distinct()
    hit = ranked.join(e.where("chunk_id is not null"), ["query_id", "chunk_id"]).groupBy("query_id", *by).agg(F.count_distinct(F.when(F.col("rank") <= k, F.col("chunk_id"))).alias("found"), F.min("rank").alias("first"))
    n = e.groupBy("query_id").agg(F.count("chunk_id").alias("n"))
    if by:
        n = n.crossJoin(F.broadcast(ranked.select(*by).distinct()))  # variants: a fixed handful
    out = n.join(hit, ["query_id", *by], "left")
    return out.select("query_id", *by, F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("mrr"))


def variant_means(metrics: DataFrame, by: list[str]) -> DataFrame:
    """AGG15: means per variant, to 4 places; of latency_ms, where metrics have it, to 2."""
    latency = [F.round(F.avg("latency_ms"), 2).alias("latency_ms")] if "latency_ms" in metrics.columns else []
    return metrics.groupBy(*by).agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("mrr"), 4).alias("mrr"), *latency)


def match_truth(findings: DataFrame, truth: DataFrame, tolerance: int = 5) -> DataFrame:
    """JN21: finding_id, issue_id: the first expected issue of a finding's file whose lines, widened, hold its start; a finding without a line matches its file."""
    near = F.col("start_line").isNull() | F.col("start_line").between(F.col("expected_start_line") - tolerance, F.col("expected_end_line") + tolerance)
    met = findings.join(truth, findings.file_path == truth.expected_file).where(near)
    return met.withColumn("n", F.row_number().over(Window.partitionBy("finding_id").orderBy("gt_seq"))).where("n = 1").select("finding_id", "issue_id", F.col("start_line").isNotNull().alias("localised"))


def finding_metrics(findings: DataFrame, truth: DataFrame, candidates: int, rejected: int, tolerance: int = 5) -> DataFrame:
    """AGG16: one row of precision, recall, fpr (false positives among the confirmed), localisation, rejection; without truth 1, 1, 0, 1, 0."""
    m = match_truth(findings, truth, tolerance)
    a = findings.agg(F.count("*").alias("confirmed")).crossJoin(m.agg(F.count("*").alias("tp"), F.count_distinct("issue_id").alias("found"), F.count_if("localised").alias("loc"))).crossJoin(truth.agg(F.count("*").alias("gt")))
    share = lambda x, y, empty=0.0: F.coalesce(F.try_divide(x, y), F.lit(empty))
    none = F.col("gt") == 0
    pick = lambda value, constant: F.when(none, F.lit(constant)).otherwise(value)
    return a.select(
        pick(share(F.col("tp"), F.col("confirmed")), 1.0).alias("precision"), pick(share(F.col("found"), F.col("gt")), 1.0).alias("recall"), pick(share(F.col("confirmed") - F.col("tp"), F.col("confirmed")), 0.0).alias("fpr"),
        pick(share(F.col("loc"), F.col("tp")), 1.0).alias("localisation"), pick(F.lit(rejected / candidates if candidates else 0.0), 0.0).alias("rejection"),
    )


def remediation(patches: DataFrame) -> DataFrame:
    """AGG17: per variant means. patches: variant, valid, resolved, fabricated, unnecessary, grounded (null: no plan), escalated, revisions, latency_ms."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4).alias(f"{c}_rate")
    return patches.groupBy("variant").agg(F.count("*").alias("patches"), rate("valid"), rate("resolved"), rate("grounded"), rate("escalated"), F.sum("fabricated").alias("fabricated"), F.sum("unnecessary").alias("unnecessary"), F.round(F.avg("revisions"), 4).alias("revisions"), F.round(F.avg("latency_ms"), 2).alias("latency_ms"))


# Channels of the retrieval variants (fixed values); the last one falls back to the fused order where there are no rerank scores.
VARIANTS = {"LEXICAL_ONLY": ["exact", "lexical"], "VECTOR_ONLY": ["dense"], "LEXICAL_VECTOR": ["exact", "lexical", "dense"], "LEXICAL_VECTOR_GRAPH": ["exact", "lexical", "dense", "graph"], "HYBRID_GRAPH_RERANKER": ["exact", "lexical", "dense", "graph"]}


def variant_ranks(chunks: DataFrame, query: str, variant: str, k: int = 5, vectors: DataFrame | None = None, query_vector: list[float] | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """variant, chunk_id, rank: the k best chunks of a query with the channels of a variant."""
    want = VARIANTS[variant]
    found = {}
    hits = retrieval.exact(chunks, query)
    if "exact" in want:
        found["exact"], found["lexical"] = hits, retrieval.lexical(chunks, query)
    if "dense" in want and vectors is not None and query_vector is not None:
        found["dense"] = retrieval.dense(vectors, query_vector, 2 * k)
    if "graph" in want and nodes is not None and edges is not None:
        found["graph"] = retrieval.graph(chunks, hits, nodes, edges)
    top = retrieval.fuse(found).orderBy(F.desc("score"), "chunk_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))  # k rows at most
    return top.select(F.lit(variant).alias("variant"), "chunk_id", rank.alias("rank"))


def retrieval_benchmark(chunks: DataFrame, queries: dict[str, tuple[str, list[float] | None]], expected: DataFrame, k: int = 5, vectors: DataFrame | None = None, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """PIP11: variant, queries, recall, mrr of the five variants over a stated set of queries (id to text and vector), in one plan.

    expected: query_id, chunk_id (null: nothing is expected). A variant and query without any hit counts with recall and rank 0.
    """
    spark = chunks.sparkSession
    rows = [("", q, text, None if vector is None else [float(x) for x in vector]) for q, (text, vector) in queries.items()]
    asked = spark.createDataFrame(rows, "repo string, query_id string, text string, vector array<double>")
    of = lambda df: None if df is None else df.withColumn("repo", F.lit(""))
    ranked = batch.retrieve(asked, of(chunks), k, of(vectors), of(nodes), of(edges), VARIANTS).select("variant", "query_id", "chunk_id", "rank")
    # every variant meets every query, also those that find nothing
    each = expected.select("query_id").distinct().crossJoin(F.broadcast(chunks.sparkSession.createDataFrame([(v,) for v in VARIANTS], "variant string")))
    per = ranking_metrics(ranked, expected, k, ["variant"])
    full = each.join(per, ["query_id", "variant"], "left")
    none = expected.groupBy("query_id").agg((F.count("chunk_id") == 0).alias("none"))
    full = full.join(none, "query_id").select("query_id", "variant", F.coalesce("recall", F.when(F.col("none"), 1.0).otherwise(0.0)).alias("recall"), F.coalesce("mrr", F.lit(0.0)).alias("mrr"))
    return variant_means(full, ["variant"])


def patch_metrics(patches: DataFrame) -> DataFrame:
    """PIP12: what remediation() averages, from the diffs themselves.

    patches: variant, unified_diff, defect_snippet, known_files, expected_files, plan_files (null: no plan), escalated, revisions, latency_ms. A diff
    that isn't one resolves nothing; fabricated files are those that the repository lacks, unnecessary ones those outside the expected.
    """
    d = F.coalesce("unified_diff", F.lit(""))
    files = X.diff_files(d)
    valid = X.is_unified_diff(d)
    clean = lambda c: F.transform(c, lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/+", ""))
    return patches.select(
        "variant", valid.cast("int").alias("valid"), (valid & X.defect_removed(d, F.col("defect_snippet"))).cast("int").alias("resolved"), F.size(F.array_except(files, "known_files")).alias("fabricated"), F.size(F.array_except(files, clean("expected_files"))).alias("unnecessary"),
        F.when(F.col("plan_files").isNotNull(), (F.size(F.array_except("plan_files", "known_files")) == 0).cast("int")).alias("grounded"), F.col("escalated").cast("int").alias("escalated"), "revisions", "latency_ms")


# The remediation pipelines that are compared, and what the first, without a plan, changes beside the fix (fixed values).
PIPELINES = ["DIRECT_LLM", "FIXPLAN_PATCH", "FIXPLAN_PATCH_VERIFICATION", "FULL_PIPELINE"]
STRAY = "\n--- a/README.md\n+++ b/README.md\n@@ -1,1 +1,2 @@\n # Project\n+## Fixed issues\n"


def remediation_variants(fixtures: DataFrame) -> DataFrame:
    """PIP12: what each pipeline makes of each fixture, without a model: variant and the columns that patch_rates() reads.

    fixtures: issue_id, good_diff, defect_snippet, expected_files, known_files, category, and latency_ms where measured. The first pipeline strays into
    another file and has no plan; the others plan the expected files; the last two are verified; the last lets a critic see what concerns security.
    """
    v, security = F.col("variant"), F.coalesce(F.col("category") == "security", F.lit(False))
    rows = fixtures.select("*", F.explode(F.array(*map(F.lit, PIPELINES))).alias("variant"))
    return rows.select(
        "variant", "issue_id", F.when(v == PIPELINES[0], F.concat("good_diff", F.lit(STRAY))).otherwise(F.col("good_diff")).alias("unified_diff"), "defect_snippet", "expected_files", "known_files", F.when(v != PIPELINES[0], F.col("expected_files")).alias("plan_files"),
        F.when(v.isin(PIPELINES[2:]), F.lit(False)).alias("verifier_rejected"), F.when(v == PIPELINES[3], security).alias("critic_invoked"), F.lit(False).alias("revision_applied"),
        F.when(v == PIPELINES[0], 1).when((v == PIPELINES[3]) & security, 3).otherwise(2).alias("model_calls"), (F.col("latency_ms") if "latency_ms" in fixtures.columns else F.lit(0.0)).alias("latency_ms"))


def patch_rates(patches: DataFrame) -> DataFrame:
    """variant, issue_id, valid, resolved, grounded (null: no plan), fabricated_rate, unnecessary_rate and what else patches have of a run: one row a patch. A diff that isn't one names no files and resolves nothing."""
    d = F.coalesce("unified_diff", F.lit(""))
    valid = X.is_unified_diff(d)
    files = F.when(valid, X.diff_files(d)).otherwise(F.array().cast("array<string>"))
    clean = lambda c: F.transform(c, lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/+", ""))
    share = lambda beyond: F.round(F.coalesce(F.try_divide(F.size(F.array_except(files, beyond)), F.size(files)), F.lit(0.0)), 4)
    return patches.select(
        "variant", "issue_id", valid.alias("valid"), (valid & X.defect_removed(d, F.col("defect_snippet"))).alias("resolved"), F.when(F.col("plan_files").isNotNull(), F.size(F.array_except("plan_files", "known_files")) == 0).alias("grounded"),
        share(F.col("known_files")).alias("fabricated_rate"), share(clean("expected_files")).alias("unnecessary_rate"), "verifier_rejected", "critic_invoked", "revision_applied", "model_calls", "latency_ms")


def pipeline_report(rates: DataFrame) -> DataFrame:
    """PIP12, AGG17: a row per pipeline with the counts and means of patch_rates(); a pipeline without patches has none."""
    n = lambda c: F.count_if(F.col(c))
    mean = lambda c, places: F.round(F.avg(F.col(c).cast("double")), places)
    count = F.count("*")
    return rates.groupBy("variant").agg(
        count.alias("total_findings"), n("valid").alias("valid_diff_count"), F.round(n("valid") / count, 4).alias("valid_diff_rate"), mean("fabricated_rate", 4).alias("fabricated_path_rate"), n("resolved").alias("target_resolution_count"), F.round(n("resolved") / count, 4).alias("target_resolution_rate"),
        mean("unnecessary_rate", 4).alias("unnecessary_file_change_rate"), mean("grounded", 4).alias("plan_evidence_grounding_rate"), n("verifier_rejected").alias("verifier_rejection_count"), F.round(n("verifier_rejected") / count, 4).alias("verifier_rejection_rate"), n("critic_invoked").alias("critic_invocations"),
        n("revision_applied").alias("patch_revision_count"), F.round(n("revision_applied") / count, 4).alias("patch_revision_rate"), mean("model_calls", 2).alias("avg_model_calls"), mean("latency_ms", 2).alias("avg_latency_ms"))
