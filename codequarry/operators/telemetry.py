"""Telemetry and scanner coverage of scans, from the metadata of everything that belongs to them (AGG6-7, AGG23, PIP9-10).

Metadata are JSON texts. What is recorded nowhere stays null; a key that is there with null or nothing in it makes a count of 0. All sources of a scan are
one table of (scan, metadata), added up in one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as X

# Tool events, the statuses that they stand for, and the statuses of metadata that count as failed (fixed values).
TOOL_EVENTS = {"TOOL_COMPLETED": "COMPLETED", "TOOL_FAILED": "FAILED", "TOOL_UNAVAILABLE": "UNAVAILABLE"}
FAILED = ["FAILED", "INVALID_OUTPUT", "TIMEOUT"]
# Keys of the counts that metadata may hold, the first that isn't empty counting (fixed values).
COUNTS = {"llm_calls": ["llm_calls", "calls"], "llm_retries": ["retry_count", "retries", "llm_retries"]}
TOKENS = ["prompt_tokens", "completion_tokens", "total_tokens"]
_SCANNERS = "array<struct<tool: string, scanner: string, status: string, findings_count: int, execution_time_ms: double, failure_reason: string, error_category: string>>"
_SCOPE = "struct<truncated: boolean, reason: string, files_processed: bigint, source_bytes_processed: bigint, total_observed_files: bigint, total_observed_bytes: bigint>"


def _get(meta: Column, key: str) -> Column:
    return F.get_json_object(meta, f"$.{key}")


def _filled(value: Column) -> Column:
    """A value of metadata, null if it is empty."""
    return F.when(~F.trim(value).isin("", "0", "0.0", "[]", "{}", "false"), value)


def scanners(meta: Column) -> Column:
    """The list of scanners that a scan's metadata hold; empty where there is none."""
    held = F.coalesce(_filled(_get(meta, "scanner_coverage")), _filled(_get(meta, "scanners")))
    return F.coalesce(F.from_json(held, _SCANNERS), F.array().cast(_SCANNERS))


def scope(meta: Column) -> Column:
    """What a scan's metadata say of how much was analysed; null where they don't."""
    return F.from_json(F.coalesce(_filled(_get(meta, "analysis_scope")), _filled(_get(meta, "scope"))), _SCOPE)


def usage(sources: DataFrame) -> DataFrame:
    """scan_id, llm_calls, llm_retries, provider_fallbacks, prompt_tokens, completion_tokens, total_tokens: sums over the metadata (scan_id, meta) of each scan."""
    meta = F.col("meta")
    names = F.json_object_keys(meta)
    has = lambda *keys: F.coalesce(F.arrays_overlap(names, F.array(*map(F.lit, keys))), F.lit(False))
    count = lambda keys: F.coalesce(X.count_shape(F.coalesce(*[_filled(_get(meta, k)) for k in keys])), F.lit(0))
    fallbacks = ["fallbacks_attempted", "provider_fallbacks"]
    fell = F.coalesce(*[X.count_shape(_get(meta, k)) for k in fallbacks], F.lit(0))
    each = sources.where(names.isNotNull()).select(
        "scan_id", has(*TOKENS).alias("has_tokens"), *[F.coalesce(F.try_to_number(_get(meta, t), F.lit("S999999999999999999")).cast("long"), F.lit(0)).alias(t) for t in TOKENS],
        (has(*COUNTS["llm_retries"]) | has(*fallbacks)).alias("has_retries"), count(COUNTS["llm_retries"]).alias("llm_retries"), F.when(has(*fallbacks), fell).otherwise(0).alias("provider_fallbacks"), has(*COUNTS["llm_calls"]).alias("has_calls"), count(COUNTS["llm_calls"]).alias("llm_calls"))
    s = each.groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in (*TOKENS, "llm_retries", "provider_fallbacks", "llm_calls")], *[F.bool_or(c).alias(c) for c in ("has_tokens", "has_retries", "has_calls")])
    total = F.when(F.col("total_tokens") != 0, F.col("total_tokens")).otherwise(F.col("prompt_tokens") + F.col("completion_tokens"))
    shown = lambda flag, value, name: F.when(F.col(flag), value).alias(name)
    return s.select("scan_id", shown("has_calls", F.col("llm_calls"), "llm_calls"), *[shown("has_retries", F.col(c), c) for c in ("llm_retries", "provider_fallbacks")], *[shown("has_tokens", F.col(c), c) for c in TOKENS[:2]], shown("has_tokens", total, "total_tokens"))


def scan_telemetry(scans: DataFrame, events: DataFrame, findings: DataFrame, patches: DataFrame, deliveries: DataFrame) -> DataFrame:
    """PIP10: scan_id, status, total_duration_ms and the counts of each scan.

    scans: id, status, created_at, completed_at, model_metadata. events: id, scan_id, event_type, stage, metadata_payload. findings: scan_id, verification_verdict, model_metadata.
    patches: scan_id, status, machine_verdict, model_metadata. deliveries: scan_id, status. Tools are counted from the events, and from the scan's metadata where no event tells of any.
    """
    sources = [scans.select(F.col("id").alias("scan_id"), F.col("model_metadata").alias("meta")), *[df.select("scan_id", F.col("model_metadata").alias("meta")) for df in (findings, patches)], events.select("scan_id", F.col("metadata_payload").alias("meta"))]
    used = usage(reduce(lambda a, b: a.unionByName(b), sources))
    stage = F.coalesce(F.nullif("stage", F.lit("")), F.when(F.col("event_type").isin("STAGE_STARTED", "STAGE_COMPLETED"), F.nullif(_get(F.col("metadata_payload"), "stage"), F.lit(""))))
    e = events.groupBy("scan_id").agg(F.count("*").alias("event_count"), F.count_distinct(stage).alias("stage_count"), *[F.count_if(F.col("event_type") == t).alias(f"e_{s.lower()}") for t, s in TOOL_EVENTS.items()])
    is_ = lambda c, *v: F.coalesce(F.col(c).isin(*v), F.lit(False))
    f = findings.groupBy("scan_id").agg(*[F.count_if(is_("verification_verdict", v)).alias(f"{v.lower()}_findings") for v in ("CONFIRMED", "POSSIBLE", "REJECTED")])
    p = patches.groupBy("scan_id").agg(
        F.count("*").alias("patches_generated"), F.count_if(is_("status", "VERIFIED", "APPROVED") | is_("machine_verdict", "PASSED")).alias("patches_verified"), F.count_if(is_("status", "NEEDS_REVIEW") | is_("machine_verdict", "NEEDS_REVIEW")).alias("patches_needing_review"),
        F.count_if(is_("status", "APPROVED")).alias("patches_approved"), F.count_if(is_("status", "REJECTED") | is_("machine_verdict", "REJECTED")).alias("patches_rejected"))
    d = deliveries.groupBy("scan_id").agg(F.count("*").alias("deliveries_requested"), *[F.count_if(is_("status", s)).alias(n) for s, n in (("BLOCKED", "deliveries_blocked"), ("PR_CREATED", "pull_requests_created"), ("FAILED", "delivery_failures"))])
    meta = F.col("model_metadata")
    listed = F.transform(scanners(meta), lambda x: F.upper(x["status"]))
    by = lambda *s: F.size(F.filter(listed, lambda x: x.isin(*s)))
    out = scans.select(F.col("id").alias("scan_id"), "status", X.duration_ms(F.col("status"), F.col("created_at"), F.col("completed_at")).alias("total_duration_ms"), by("COMPLETED").alias("m_completed"), by(*FAILED).alias("m_failed"), by("UNAVAILABLE").alias("m_unavailable"), scope(meta).alias("scope"))
    for part in (e, f, p, d, used):
        out = out.join(part, "scan_id", "left")
    zero = [c for part in (e, f, p, d) for c in part.columns if c != "scan_id"]
    out = out.na.fill(0, zero)
    told = F.col("e_completed") + F.col("e_failed") + F.col("e_unavailable") > 0
    tools = [F.when(told, F.col(f"e_{s}")).otherwise(F.col(f"m_{s}")).cast("long").alias(f"tools_{s}") for s in ("completed", "failed", "unavailable")]
    return out.select("scan_id", "status", "total_duration_ms", *tools, *[c for c in zero if not c.startswith("e_")], *[c for c in used.columns if c != "scan_id"], F.coalesce("scope.truncated", F.lit(False)).alias("analysis_truncated"), F.col("scope.reason").alias("analysis_truncation_reason"))


def scanner_coverage(scans: DataFrame, events: DataFrame) -> DataFrame:
    """AGG23: scan_id, place, tool, status, findings_count, execution_time_ms, failure_reason: the scanners of each scan, from its metadata, else from the first event
    of each tool that says how its run ended. Reasons and names are redacted and cut at 512 and 128 characters; a run that completed has no reason of its event."""
    cut = lambda c, n: F.when(c.isNotNull(), F.left(X.redact(c), F.lit(n)))
    listed = scans.select(F.col("id").alias("scan_id"), F.posexplode(scanners(F.col("model_metadata"))).alias("place", "x"))
    own = listed.select(
        "scan_id", "place", cut(F.coalesce(F.nullif("x.tool", F.lit("")), F.nullif("x.scanner", F.lit("")), F.lit("unknown")), 128).alias("tool"), F.coalesce(F.nullif("x.status", F.lit("")), F.lit("UNKNOWN")).alias("status"), F.coalesce("x.findings_count", F.lit(0)).alias("findings_count"), F.col("x.execution_time_ms").alias("execution_time_ms"),
        cut(F.coalesce(F.nullif("x.failure_reason", F.lit("")), F.col("x.error_category")), 512).alias("failure_reason"))
    told = events.where(F.col("event_type").isin(*TOOL_EVENTS) & (F.col("tool_name") != "")).join(own.select("scan_id").distinct(), "scan_id", "left_anti")
    # the first event of each tool, without bringing a scan's events together
    first = told.groupBy("scan_id", "tool_name").agg(F.min(F.struct("id", "event_type", "metadata_payload")).alias("e"))
    place = F.row_number().over(Window.partitionBy("scan_id").orderBy("e.id")) - 1
    status = F.create_map(*[F.lit(x) for kv in TOOL_EVENTS.items() for x in kv])[F.col("e.event_type")]
    meta = F.col("e.metadata_payload")
    reason = F.coalesce(_filled(_get(meta, "reason")), _get(meta, "status"))
    fallback = first.select("scan_id", place.alias("place"), cut(F.col("tool_name"), 128).alias("tool"), status.alias("status"), F.coalesce(_get(meta, "findings_count").cast("int"), F.lit(0)).alias("findings_count"), _get(meta, "execution_time_ms").cast("double").alias("execution_time_ms"), F.when(status != "COMPLETED", cut(reason, 512)).alias("failure_reason"))
    return own.unionByName(fallback)


def report_heads(scans: DataFrame, events: DataFrame) -> DataFrame:
    """PIP9: scan_id, requested_branch, resolved_branch, architecture_overview (redacted), languages (map), frameworks (JSON), analysis_scope, scanner_coverage (array): what a
    report says of a scan beside its findings. scans: id, branch, model_metadata."""
    meta = F.col("model_metadata")
    s = scans.select(
        F.col("id").alias("scan_id"), _get(meta, "requested_branch").alias("requested_branch"), F.coalesce(_filled(_get(meta, "resolved_branch_or_ref")), F.col("branch")).alias("resolved_branch"), F.when(_filled(_get(meta, "architecture_overview")).isNotNull(), X.redact(_get(meta, "architecture_overview"))).alias("architecture_overview"),
        F.coalesce(F.from_json(_get(meta, "languages"), "map<string,bigint>"), F.create_map().cast("map<string,bigint>")).alias("languages"), F.when(_get(meta, "frameworks").startswith("["), _get(meta, "frameworks")).otherwise("[]").alias("frameworks"), scope(meta).alias("analysis_scope"))
    s = s.withColumn("analysis_scope", F.when(F.col("analysis_scope").isNotNull(), F.struct(F.coalesce("analysis_scope.truncated", F.lit(False)).alias("truncated"), F.when(_filled(F.col("analysis_scope.reason")).isNotNull(), X.redact(F.col("analysis_scope.reason"))).alias("reason"), *[F.coalesce(f"analysis_scope.{c}", F.lit(0)).alias(c) for c in ("files_processed", "source_bytes_processed", "total_observed_files", "total_observed_bytes")])))
    cover = scanner_coverage(scans, events)
    packed = cover.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in cover.columns if c != "scan_id"]))).alias("scanner_coverage"))
    out = s.join(packed, "scan_id", "left")
    return out.withColumn("scanner_coverage", F.coalesce("scanner_coverage", F.array().cast(out.schema["scanner_coverage"].dataType)))
