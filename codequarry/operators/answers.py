"""Model answers and their evidence as tables: findings, research, plans, patches, scanner rows, list filters and sets (PRJ16, PRJ18, PRJ21-22, WIN7, ORD5, STR22, FLT17, SET5-6, AGG20, AGG24, SNK1, SNK3, JSN2, PIP14)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.schemas import SEVERITIES

# What each specialist asks the context for, with 3000 tokens and 4 chunks (fixed values); the architect's overview follows its query.
SPECIALIST_QUERIES = {
    "security": "security vulnerability injection secrets authentication sanitization",
    "architecture": "architecture layer module structure",
    "integration": "API endpoints client fetch axios route contract",
    "bug": "logic bug null exception async handling race condition",
}
CONTEXT_TOKENS, CONTEXT_CHUNKS = 3000, 4

_FINDING = "struct<title: string, description: string, severity: string, category: string, rule_id: string, mitigation_guidance: string, mitigation: string, file_path: string, start_line: string, end_line: string, code_snippet: string>"
_EVIDENCE = "struct<source_url: string, source_title: string, supported_claim: string, confidence: double>"
_STEP = "struct<step_number: int, target_file: string, target_symbol: string, description: string, rationale: string>"
_PLAN = f"struct<root_cause: string, objective: string, files_expected_to_change: array<string>, symbols_expected_to_change: array<string>, interfaces_affected: array<string>, migration_config_impact: string, regression_risks: array<string>, validation_plan: array<string>, assumptions: array<string>, estimated_scope: string, ordered_changes: array<{_STEP}>>"
_PATCH = "struct<unified_diff: string, explanation: string, expected_behavior_change: string, generated_tests_or_test_plan: array<string>>"
#: Scopes of a plan (fixed values); any other is `file`.
SCOPES = ["line", "function", "file", "cross_file"]


def _or(c: Column, other: Column | str) -> Column:
    return F.coalesce(c, F.lit(other) if isinstance(other, str) else other)


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def findings_of(answers: DataFrame) -> DataFrame:
    """PRJ16: a row per finding of answers: scan_id, seq, title, description, severity, category, rule_id, mitigation_guidance, status, evidence.

    answers: scan_id, content, default_category, provider, model_name. The JSON may stand in a fence, as a list or under `findings`; an answer
    that can't be read gives none. Unknown severities are MEDIUM, lines that are no numbers null.
    """
    body = X.json_block(F.col("content"))
    items = F.when(body.startswith("["), F.from_json(body, f"array<{_FINDING}>")).otherwise(F.from_json(body, f"struct<findings: array<{_FINDING}>>")["findings"])
    a = answers.select("scan_id", "default_category", "provider", "model_name", F.posexplode(items).alias("seq", "x")).where("x is not null")
    x = lambda c: F.col(f"x.{c}")
    level, line = F.upper(_or(x("severity"), "MEDIUM")), lambda c: F.when(x(c).rlike(r"^\d+$") & (x(c) != "0"), x(c).cast("int"))
    evidence = F.struct(_or(x("file_path"), "unknown").alias("file_path"), line("start_line").alias("start_line"), line("end_line").alias("end_line"), x("code_snippet").alias("code_snippet"), F.concat(F.lit("Identified by "), _or(F.col("provider"), "AI"), F.lit(" ("), "model_name", F.lit(")")).alias("context_notes"))
    return a.select(
        X.uuid5_dns(F.col("scan_id")).alias("scan_id"), "seq", _or(x("title"), "Untitled Issue").alias("title"), _or(x("description"), "").alias("description"), F.when(level.isin(SEVERITIES), level).otherwise("MEDIUM").alias("severity"),
        _or(x("category"), F.col("default_category")).alias("category"), x("rule_id").alias("rule_id"), _or(F.nullif(x("mitigation_guidance"), F.lit("")), x("mitigation")).alias("mitigation_guidance"), F.lit("OPEN").alias("status"), evidence.alias("evidence"))


def scanner_rows(results: DataFrame) -> DataFrame:
    """PRJ18: scan_id, tool, status, findings_count, failure_reason, event_type, message of scanner runs (scan_id, tool, status, findings_count, error_message)."""
    s, n = F.col("status"), F.coalesce("findings_count", F.lit(0))
    said = lambda *parts: F.concat(F.lit("Deterministic scanner "), "tool", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    message = F.when(s == "COMPLETED", said(" completed with ", n, " findings")).when(s == "UNAVAILABLE", said(" is unavailable on host")).when(s == "TIMEOUT", said(" timed out")).when(s == "INVALID_OUTPUT", said(" produced invalid output")).otherwise(said(" failed execution"))
    event = F.when(s == "COMPLETED", "TOOL_COMPLETED").when(s == "UNAVAILABLE", "TOOL_UNAVAILABLE").otherwise("TOOL_FAILED")
    reason = F.when(F.coalesce("error_message", F.lit("")) != "", F.substring(X.redact(F.col("error_message")), 1, 512))
    return results.select("scan_id", "tool", "status", n.alias("findings_count"), reason.alias("failure_reason"), event.alias("event_type"), message.alias("message"))


def research_evidence(answers: DataFrame) -> DataFrame:
    """PRJ21: query_id, seq, source_url, source_title, supported_claim, confidence: what answers cite, then their grounding chunks.

    answers: query_id, content, grounding (array of struct<uri, title>). Without a confidence it is 0.9.
    """
    cited = F.from_json(X.json_block(F.col("content")), f"struct<evidences: array<{_EVIDENCE}>>")["evidences"]
    a = answers.select("query_id", F.posexplode(cited).alias("seq", "x")).where("x.source_url <> ''")
    a = a.select("query_id", "seq", "x.source_url", _or(F.col("x.source_title"), "Technical Reference").alias("source_title"), _or(F.col("x.supported_claim"), "").alias("supported_claim"), F.coalesce("x.confidence", F.lit(0.9)).alias("confidence"))
    g = answers.select("query_id", F.posexplode("grounding").alias("seq", "x")).where("x.uri <> ''")
    return a.unionByName(g.select("query_id", (F.col("seq") + 1_000_000).alias("seq"), F.col("x.uri").alias("source_url"), _or(F.col("x.title"), "Google Search Grounding Source").alias("source_title"), F.lit("Verified via Google Search Grounding").alias("supported_claim"), F.lit(0.9).alias("confidence")))


def ranked_evidence(evidence: DataFrame) -> DataFrame:
    """WIN7, ORD5: per query the first row of each URL, with source_tier and rank by tier, confidence (highest first) and URL; blank URLs are left out."""
    url = F.trim("source_url")
    other = [c for c in evidence.columns if c not in ("query_id", "source_url", "seq")]
    first = evidence.where(url != "").groupBy("query_id", url.alias("source_url")).agg(F.min_by(F.struct(*other), "seq").alias("x")).select("query_id", "source_url", "x.*")
    return first.withColumn("source_tier", X.source_tier(F.col("source_url"))).withColumn("rank", F.expr("row_number() over (partition by query_id order by source_tier, confidence desc, source_url)"))


def target_framework(title: Column, path: Column, first: Column) -> Column:
    """STR22: the framework that a finding's title or path names, else the first of the manifest, else General."""
    t, p = F.lower(F.coalesce(title, F.lit(""))), F.coalesce(path, F.lit(""))
    return (
        F.when(t.contains("fastapi") | p.contains("routes"), "FastAPI").when(t.contains("react") | p.contains(".tsx") | p.contains(".jsx"), "React")
        .when(t.contains("express"), "Express").when(t.contains("pydantic"), "Pydantic").otherwise(F.coalesce(first, F.lit("General")))
    )


def plans_of(answers: DataFrame) -> DataFrame:
    """PRJ22: plan_id and the fields of a fix plan, each with its default; without steps, one that resolves the finding.

    answers: plan_id, content, title, file_path (of the finding's first evidence, or null). An answer that can't be read keeps the defaults, and its first 200 characters are the step.
    """
    body = X.json_block(F.col("content"))
    a = answers.withColumn("j", F.from_json(body, _PLAN)).withColumn("read", F.try_parse_json(body).isNotNull() & body.startswith("{"))
    j = lambda c: F.when(F.col("read"), F.col(f"j.{c}"))
    files = F.coalesce(j("files_expected_to_change"), F.array(_or(F.col("file_path"), "app/main.py")))
    first = F.coalesce(F.try_element_at(files, F.lit(1)), F.lit("unknown"))
    steps = F.transform(j("ordered_changes"), lambda x, i: F.struct(F.coalesce(x["step_number"], i + 1).alias("step_number"), F.coalesce(x["target_file"], first).alias("target_file"), x["target_symbol"].alias("target_symbol"), _or(x["description"], "Apply targeted remediation").alias("description"), _or(x["rationale"], "Resolves root cause").alias("rationale")))
    told = F.when(F.col("read"), F.concat(F.lit("Resolve "), "title")).otherwise(F.substring("content", 1, 200))
    one = F.array(F.struct(F.lit(1).alias("step_number"), first.alias("target_file"), F.lit(None).cast("string").alias("target_symbol"), told.alias("description"), F.when(F.col("read"), "Direct root cause fix").otherwise("Fallback parsed description").alias("rationale")))
    scope = F.lower(_or(j("estimated_scope"), "file"))
    many = lambda c, *other: F.coalesce(j(c), _strings(*other)).alias(c)
    return a.select(
        "plan_id", _or(j("root_cause"), "Analysis in progress").alias("root_cause"), F.coalesce(j("objective"), F.concat(F.lit("Remediate "), "title")).alias("objective"), files.alias("files_expected_to_change"), many("symbols_expected_to_change"), many("interfaces_affected"),
        j("migration_config_impact").alias("migration_config_impact"), many("regression_risks"), many("validation_plan", "Run existing test suite"), many("assumptions"), F.when(scope.isin(SCOPES), scope).otherwise("file").alias("estimated_scope"),
        F.when(F.size(F.coalesce(steps, F.array().cast(f"array<{_STEP}>"))) > 0, steps).otherwise(one).alias("ordered_changes"))


def patches_of(answers: DataFrame) -> DataFrame:
    """PRJ22: patch_id, unified_diff, files_modified, explanation, expected_behavior_change, generated_tests_or_test_plan. answers: patch_id, content, plan_files.

    What can't be read as JSON is the diff itself; a diff that names no files modifies those of the plan.
    """
    body = X.json_block(F.col("content"))
    a = answers.withColumn("j", F.from_json(body, _PATCH)).withColumn("read", F.try_parse_json(body).isNotNull() & body.startswith("{"))
    diff = F.when(F.col("read"), F.trim(_or(F.col("j.unified_diff"), ""))).otherwise(F.trim("content"))
    files = X.diff_files(diff)
    j = lambda c: F.when(F.col("read"), F.col(f"j.{c}"))
    return a.select(
        "patch_id", diff.alias("unified_diff"), F.when(F.size(files) > 0, files).otherwise(F.col("plan_files")).alias("files_modified"), _or(j("explanation"), "Patch generated for finding.").alias("explanation"),
        _or(j("expected_behavior_change"), "Remediates identified defect.").alias("expected_behavior_change"), F.coalesce(j("generated_tests_or_test_plan"), _strings("Run test suite")).alias("generated_tests_or_test_plan"))


def shown(findings: DataFrame, severity: str = "ALL", verdict: str = "ALL") -> DataFrame:
    """FLT17: findings of a severity and a verdict (CONFIRMED or POSSIBLE); ALL takes every one, another verdict none."""
    s = F.lit(True) if severity == "ALL" else F.col("severity") == severity
    v = F.lit(True) if verdict == "ALL" else (F.col("verification_verdict") == verdict) & F.lit(verdict in ("CONFIRMED", "POSSIBLE"))
    return findings.where(s & v)


def completed_findings(results: dict[str, DataFrame], statuses: DataFrame) -> DataFrame:
    """SET5: all rows of the scanners' findings, repeats kept, of those tools that completed (statuses: tool, status)."""
    every = reduce(lambda a, b: a.unionByName(b), [df.withColumn("tool", F.lit(tool)) for tool, df in results.items()])
    return every.join(statuses.where("status = 'COMPLETED'").select("tool").distinct(), "tool", "left_semi")


def path_difference(a: Column, b: Column) -> Column:
    """SET6: paths of one array that another lacks, both with / and without a leading one; first seen first."""
    clean = lambda c: F.transform(c, lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/+", ""))
    return F.array_except(clean(a), clean(b))


def merged(parts: list[DataFrame]) -> DataFrame:
    """AGG24: lists that parallel agents gave, one behind the other; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def new_findings(stored: DataFrame, found: DataFrame) -> DataFrame:
    """SNK1: verified findings whose id isn't stored yet, each id once (the first by its columns): the rows to append."""
    other = [c for c in found.columns if c != "id"]
    one = found.groupBy("id").agg(F.min(F.struct(*other)).alias("x")).select("id", "x.*")
    return one.join(stored.select("id"), "id", "left_anti")


def cleared(vectors: DataFrame, namespace: str) -> DataFrame:
    """SNK3: vectors without those of a namespace."""
    return vectors.where(~F.col("namespace").eqNullSafe(F.lit(namespace)))


def vectors_per_namespace(vectors: DataFrame) -> DataFrame:
    """AGG20: namespace, n."""
    return vectors.groupBy("namespace").agg(F.count("*").alias("n"))


def scan_metadata(scans: DataFrame, json_col: str = "model_metadata") -> DataFrame:
    """JSN2: id, scope, scanners (JSON texts): analysis_scope or scope, scanner_coverage or scanners; empty ones count as absent."""
    get = lambda *names: F.coalesce(*[F.when(~F.get_json_object(json_col, f"$.{n}").isin("", "{}", "[]", "null"), F.get_json_object(json_col, f"$.{n}")) for n in names])
    return scans.select("id", get("analysis_scope", "scope").alias("scope"), get("scanner_coverage", "scanners").alias("scanners"))


def specialist_query(role: str, overview: str = "") -> str:
    """PIP14: the query of a specialist; the architect's goes on with 80 characters of the overview."""
    own = SPECIALIST_QUERIES[role]
    return f"{own} {overview[:80]}" if role == "architecture" else own
