"""Unified diffs, patch and plan validation, verification rollup, workflow and delivery rules (M21, SNK9, FLT12-16, FLT19-20, AGG18-19, WIN6, PIP7-8)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.schemas import DIFF_LINES
from codequarry.shipping import ship

# Phrases of plans that paper over a mismatch (fixed values).
FORBIDDEN_PLANS = ["add alias route", "create alias endpoint", "add route alias", "add compatibility shim route", "duplicate route to match", "duplicate endpoint to hide", "hide contract mismatch with alias", "add alias to hide"]
# Categories and title words that make a finding one of security (fixed values).
SECURITY_CATEGORIES = ["security", "sast", "vulnerability", "auth", "secrets", "cve"]
SECURITY_WORDS = ["auth", "token", "password", "sql injection", "secret", "permission", "xss", "cors"]

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def _parse(patch_id: str, diff: str | None) -> list[tuple]:
    out, file, hunk, path, head, left = [], -1, -1, None, None, (0, 0)
    lines = (diff or "").split("\n")
    for i, line in enumerate(lines):
        inside = head is not None and (left[0] > 0 or left[1] > 0)
        if not inside and line.startswith("--- ") and i + 1 < len(lines) and lines[i + 1].startswith("+++ "):
            file, hunk, head = file + 1, -1, None
            path = re.sub(r"^b/", "", lines[i + 1][4:].strip())
            if path == "/dev/null":
                path = re.sub(r"^a/", "", line[4:].strip())
        elif m := (_HUNK.match(line) if path else None):
            hunk, at = hunk + 1, 0
            head = tuple(int(x) if x is not None else 1 for x in m.groups())
            left = (head[1], head[3])
        elif head is not None and line[:1] in (" ", "+", "-") and not (line.startswith("+++ ") and not inside):
            out.append((patch_id, file, path, hunk, *head, at, line[0], line[1:]))
            left = (left[0] - (line[0] != "+"), left[1] - (line[0] != "-"))
            at += 1
    return out


def diff_lines(patches: DataFrame) -> DataFrame:
    """M21: patches (patch_id, unified_diff) as one row per changed or context line; null and malformed diffs give no rows."""
    ship(patches.sparkSession)
    names = [x.split()[0] for x in DIFF_LINES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, d in zip(b.patch_id, b.unified_diff, strict=True) for r in _parse(p, d)], columns=names)

    return patches.select("patch_id", "unified_diff").mapInPandas(run, DIFF_LINES)


def hunk_errors(lines: DataFrame) -> DataFrame:
    """AGG18, WIN6: patch_id, path, hunk_idx, error of hunks whose counts differ from their header or that overlap the next."""
    key = ["patch_id", "file_idx", "path", "hunk_idx", "orig_start", "orig_count", "new_count"]
    h = lines.groupBy(*key).agg(F.count_if(F.col("prefix") != "+").alias("old"), F.count_if(F.col("prefix") != "-").alias("new"))
    after = F.lead("orig_start").over(Window.partitionBy("patch_id", "file_idx").orderBy("orig_start", "hunk_idx"))
    error = F.when((F.col("old") != F.col("orig_count")) | (F.col("new") != F.col("new_count")), "count mismatch").when(after < F.col("orig_start") + F.col("orig_count"), "overlapping hunks")
    return h.withColumn("error", error).where("error is not null").select("patch_id", "path", "hunk_idx", "error")


def _applied(original: str | None, path: str, lines: list[dict]) -> tuple[str | None, str | None]:
    """A file's content after its lines of a diff, in order, or the reason why they can't be applied."""
    out, at = [], 0
    source = original.split("\n") if original is not None else []
    error = "path leaves the repository" if re.search(r"(^|/)\.\.(/|$)|^/|^[A-Za-z]:", path) else None
    for _, part in groupby(lines, key=itemgetter("hunk_idx")):
        h = list(part)
        start = max(0, h[0]["orig_start"] - (1 if h[0]["orig_count"] else 0))
        if start < at:
            error = error or "overlapping hunks"
            break
        old = [x["content"] for x in h if x["prefix"] != "+"]
        new = [x["content"] for x in h if x["prefix"] != "-"]
        if len(old) != h[0]["orig_count"] or len(new) != h[0]["new_count"]:
            error = error or "count mismatch"
            break
        if source[start : start + len(old)] != old:
            error = error or "context mismatch"
            break
        out += source[at:start] + new
        at = start + len(old)
    return (None if error else "\n".join(out + source[at:])), error


def apply(lines: DataFrame, files: DataFrame) -> DataFrame:
    """SNK9: patch_id, path, content, error: each patched file, strictly: context and removed lines must stand where the header says.

    files: path, content. The lines of one file of one patch become a row, which meets that file's content once. A file that doesn't exist may only be created.
    """
    ship(lines.sparkSession)
    told = F.array_sort(F.collect_list(F.struct("hunk_idx", "line_idx", "orig_start", "orig_count", "new_count", "prefix", "content")))
    each = lines.groupBy("patch_id", "file_idx").agg(F.min("path").alias("path"), told.alias("lines"))
    met = each.join(files.select("path", F.col("content").alias("original")), "path", "left").select("patch_id", "path", "original", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                done = [_applied(r["original"], r["path"], r["lines"]) for r in part.select(["path", "original", "lines"]).to_pylist()]
                texts = [pa.array([x[i] for x in done], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("patch_id"), part.column("path"), *texts], names=["patch_id", "path", "content", "error"])

    return met.mapInArrow(run, "patch_id string, path string, content string, error string")


def allowed_files(planned: Column, steps: Column) -> Column:
    """SET4: files that a plan lets change, those of its steps among them; null without a plan."""
    clean = lambda c: F.transform(c, lambda p: F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^/+", ""))
    return F.when(planned.isNotNull(), F.array_union(clean(planned), clean(F.coalesce(steps, F.array().cast("array<string>")))))


def validate_patch(patches: DataFrame) -> DataFrame:
    """FLT14, JN26: patch_id, errors. patches: patch_id, unified_diff, files_modified, known_files, plan_files (arrays; a null one isn't checked), and step_files where known.

    A file that is neither known nor planned is fabricated; one that isn't planned is outside the plan. An empty diff has no further errors.
    """
    d = F.coalesce("unified_diff", F.lit(""))
    files = X.diff_files(d)
    plan = allowed_files(F.col("plan_files"), F.col("step_files") if "step_files" in patches.columns else F.lit(None).cast("array<string>"))
    known = F.array_union(F.transform("known_files", X.stripped_path), F.coalesce(plan, F.array().cast("array<string>")))
    beyond = lambda allowed: F.coalesce(F.size(F.array_except(files, allowed)) > 0, F.lit(False))
    there = d.rlike(r"\S")
    rules = [
        (~there, "empty diff"), (there & (~d.rlike(r"(?m)^--- \S") | ~d.rlike(r"(?m)^\+\+\+ \S")), "missing file headers"),
        (there & ~d.rlike(r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), "missing hunk header"), (there & ~d.rlike(r"(?m)^[+-](?!\+\+|--)"), "no changed lines"),
        (there & (F.size("known_files") > 0) & beyond(known), "fabricated files"), (there & beyond(plan), "files outside the plan"),
    ]
    return patches.select("patch_id", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])).alias("errors"))


def validate_plan(plans: DataFrame) -> DataFrame:
    """FLT15: plan_id, errors. plans: plan_id, verdict (of the finding), objective, root_cause, planned_files, steps (array of struct<target_file,
    description, rationale>), validation_plan, known_files (null or empty: files aren't checked).

    Only confirmed findings are planned for; no file may be invented, no phrase may paper over a mismatch, no step may hold code, and there must be steps and a
    plan to validate them.
    """
    steps = F.coalesce("steps", F.array().cast("array<struct<target_file:string,description:string,rationale:string>>"))
    named = allowed_files(F.coalesce("planned_files", F.array().cast("array<string>")), F.transform(steps, lambda x: x["target_file"]))
    words = lambda c: F.array_join(F.transform(steps, lambda x: F.coalesce(x[c], F.lit(""))), " ")
    text = F.lower(F.concat_ws(" ", F.coalesce("objective", F.lit("")), F.coalesce("root_cause", F.lit("")), words("description"), words("rationale")))
    bad = F.coalesce(*[F.when(text.contains(p), F.lit(f"forbidden: {p}")) for p in FORBIDDEN_PLANS])
    code = F.exists(steps, lambda x: x["description"].contains("```") | (F.size(F.split(x["description"], "\n")) > 15))
    rules = [
        F.when(F.coalesce("verdict", F.lit("")) != "CONFIRMED", "finding not confirmed"), F.when((F.size("known_files") > 0) & (F.size(F.array_except(named, allowed_files(F.col("known_files"), F.lit(None).cast("array<string>")))) > 0), "invented files"), bad,
        F.when(code, "code in a step"), F.when(F.size(steps) == 0, "no steps"), F.when(F.size(F.coalesce("validation_plan", F.array().cast("array<string>"))) == 0, "no validation plan"),
    ]
    return plans.select("plan_id", F.array_compact(F.array(*rules)).alias("errors"))


def critic_reasons(rows: DataFrame) -> DataFrame:
    """FLT16: patch_id, reasons. rows: patch_id, title, category, severity, verification_status, cross_file, n_files, warnings."""
    title = F.lower(F.coalesce("title", F.lit("")))
    security = F.lower(F.coalesce("category", F.lit(""))).isin(SECURITY_CATEGORIES) | reduce(lambda a, b: a | b, [title.contains(w) for w in SECURITY_WORDS])
    rules = [(security, "security"), (F.col("severity").isin("HIGH", "CRITICAL"), "severity"), (F.col("verification_status") == "NEEDS_REVIEW", "needs review"), (F.coalesce("cross_file", F.lit(False)) | (F.col("n_files") > 1), "several files"), ((F.col("warnings") > 0) & (F.coalesce("verification_status", F.lit("")) != "FAILED"), "warnings")]
    return rows.select("patch_id", F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in rules])).alias("reasons"))


def added_secrets(lines: DataFrame) -> DataFrame:
    """FLT19: patch_id, secrets: names of the secret patterns that added lines show."""
    return lines.where("prefix = '+'").select("patch_id", F.explode(X.patch_secrets(F.col("content"))).alias("s")).groupBy("patch_id").agg(F.array_sort(F.collect_set("s")).alias("secrets"))


def verification_status(checks: DataFrame) -> DataFrame:
    """AGG19: patch_id, status, failed: FAILED if a check failed, else NEEDS_REVIEW if one needs review or was unavailable, else PASSED."""
    s = F.col("status")
    return checks.groupBy("patch_id").agg(
        F.when(F.bool_or(s == "FAILED"), "FAILED").when(F.bool_or(s.isin("NEEDS_REVIEW", "UNAVAILABLE")), "NEEDS_REVIEW").otherwise("PASSED").alias("status"),
        F.array_sort(F.collect_list(F.when(s.isin("FAILED", "NEEDS_REVIEW"), F.col("check_name")))).alias("checks_failed"),
    )


def new_identities(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """SET1, JN23: keys, change: what only one of two tables holds, new or resolved."""
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("resolved")))


def new_high_findings(before: DataFrame, after: DataFrame, tools_before: DataFrame, tools_after: DataFrame) -> DataFrame:
    """JN24: new HIGH and CRITICAL findings of tools that completed both times."""
    done = lambda t: t.where("status = 'COMPLETED'").select("tool").distinct()
    both = done(tools_before).join(done(tools_after), "tool")
    return after.where(F.col("severity").isin("HIGH", "CRITICAL")).join(both, "tool", "left_semi").join(before, ["tool", "rule_id", "file_path", "severity"], "left_anti")


def still_flagged(finding: DataFrame, after: DataFrame) -> DataFrame:
    """JN25: finding_id, flagged: the rule or the detector reports the file again."""
    a = after.select(F.col("rule_id").alias("r"), F.col("detector_id").alias("d"), F.col("file_path").alias("f"))
    ids = a.select("f", F.explode(F.array("r", "d")).alias("any")).where("any is not null").distinct()
    want = finding.select("finding_id", F.col("file_path").alias("f"), F.explode(F.array("rule_id", "detector_id")).alias("any"))
    hit = want.join(ids, ["f", "any"], "left_semi").select("finding_id").distinct().withColumn("flagged", F.lit(True))
    return finding.select("finding_id").join(hit, "finding_id", "left").select("finding_id", F.coalesce("flagged", F.lit(False)).alias("flagged"))


def workflow(rows: DataFrame) -> DataFrame:
    """PIP8: patch_id, verdict, from verification_status, escalated, critic_verdict and revisions (one at most)."""
    v, c = F.col("verification_status"), F.coalesce("critic_verdict", F.lit("APPROVE"))
    plain = F.when(v == "PASSED", "PASSED").otherwise("NEEDS_REVIEW")
    verdict = F.when(v == "FAILED", "REJECTED").when(~F.col("escalated"), plain).when(c == "REJECT", "REJECTED").when(c == "REVISE", F.when(F.col("revisions") < 1, "REVISE").otherwise("NEEDS_REVIEW")).otherwise(plain)
    return rows.select("patch_id", verdict.alias("verdict"))


def transition(status: Column, action: Column, revision: Column | None = None, has_child: Column | None = None) -> Column:
    """FLT20: status after approve or reject, and of the new child after revise; null where the action isn't allowed.

    A rejected patch stays so, an approved one can only be rejected, and a lineage is revised once at most.
    """
    revision, has_child = F.lit(0) if revision is None else F.coalesce(revision, F.lit(0)), F.lit(False) if has_child is None else F.coalesce(has_child, F.lit(False))
    free = ~status.isin("REJECTED", "APPROVED")
    return F.when((action == "approve") & free, "APPROVED").when((action == "reject") & (status != "REJECTED"), "REJECTED").when((action == "revise") & free & (revision < 1) & ~has_child, "DRAFT")


def remediation_block(status: Column, commit: Column, verdict: Column) -> Column:
    """FLT12: why a finding can't be fixed yet; null where it can."""
    return F.when(F.coalesce(status, F.lit("")) != "COMPLETED", "SCAN_NOT_COMPLETED").when(F.coalesce(commit, F.lit("")).isin("", "unknown"), "COMMIT_UNKNOWN").when(F.coalesce(verdict, F.lit("")) != "CONFIRMED", "FINDING_NOT_CONFIRMED")


#: Columns of delivery_block() that callers may leave out.
LATER = {"remote_error": "string", "snapshot_error": "string", "reapply_error": "string", "patched_contents": "array<string>"}


def delivery_block(rows: DataFrame) -> DataFrame:
    """FLT13, JN22, SET2, FLT10: patch_id, failure_code of the first of fifteen rules a delivery breaks; null where it breaks none.

    rows: patch_id, finding_id, scan_id (null: the join found none), patch_status (null: no such patch), machine_verdict, commit_hash,
    repository_url, branch (null or empty: main), unified_diff, files_modified, head_sha (of the remote branch; null: not asked), and, where known,
    remote_error, snapshot_error, reapply_error (texts of what failed), patched_contents (array). Codes are fixed values.
    """
    rows = rows.withColumns({c: F.lit(None).cast(k) for c, k in LATER.items() if c not in rows.columns})
    path = lambda c: F.regexp_replace(F.trim(F.replace(c, F.lit("\\"), F.lit("/"))), r"^[./]+", "")
    unique = lambda c: F.array_sort(F.array_distinct(F.transform(c, path)))
    same = unique(F.coalesce("files_modified", F.array().cast("array<string>"))) == unique(X.diff_files(F.col("unified_diff")))
    branch = F.coalesce(F.nullif(F.col("branch"), F.lit("")), F.lit("main"))
    rules = [
        (F.col("patch_status").isNull(), "PATCH_NOT_FOUND"), (F.col("finding_id").isNull(), "FINDING_NOT_FOUND"), (F.col("scan_id").isNull(), "SCAN_NOT_FOUND"),
        (F.col("patch_status") != "APPROVED", "PATCH_NOT_APPROVED"), (F.col("machine_verdict") == "REJECTED", "MACHINE_VERDICT_REJECTED"),
        (F.length(F.coalesce("commit_hash", F.lit(""))) != 40, "INVALID_COMMIT_SHA"), (X.github_url(F.col("repository_url")).isNull(), "INVALID_REPOSITORY_URL"),
        (~branch.rlike(r"^(?!HEAD@)[a-zA-Z0-9_.-]+(?:/[a-zA-Z0-9_.-]+)*$"), "INVALID_BASE_BRANCH"), (F.col("remote_error").isNotNull(), "REMOTE_BRANCH_UNRESOLVED"),
        (F.col("head_sha") != F.col("commit_hash"), "BLOCKED_BASE_DRIFT"), (F.col("unified_diff").isNull(), "DIFF_PARSE_FAILED"), (~same, "FILE_SET_MISMATCH"),
        (F.col("snapshot_error").isNotNull(), "SNAPSHOT_REHYDRATION_FAILED"), (F.col("reapply_error").isNotNull(), "PATCH_REAPPLY_FAILED"),
        (F.exists("patched_contents", lambda x: X.redact(x) != x), "PATCH_CONTAINS_SECRETS"),
    ]
    return rows.select("patch_id", F.coalesce(*[F.when(c, F.lit(m)) for c, m in rules]).alias("failure_code"))


#: Suffixes of files that no patch may touch (fixed values).
BINARY = [".png", ".jpg", ".jpeg", ".gif", ".exe", ".bin", ".pyc", ".so", ".dll", ".db", ".sqlite"]


def twelve_checks(rows: DataFrame, tools: DataFrame, enabled: int) -> DataFrame:
    """PIP7: patch_id, check_name, status of the twelve checks of every patch, from what the single operators found.

    rows: patch_id, errors (of validate_patch), unified_diff, plan_files, apply_error, syntax_errors (array), new_mismatches, target_before, target_after
    (numbers of route mismatches: new ones, and the finding's own before and after), route_finding (boolean), graph_nodes, secrets (array), source_tool, detector_kind,
    category, title, still_flagged (boolean), snippet_left (boolean; null: no snippet or its file isn't patched), new_high (number of new HIGH and CRITICAL findings).
    tools: patch_id, tool, status of the scanners' runs over the patched files; enabled: how many should have run.
    """
    files = X.diff_files(F.coalesce("unified_diff", F.lit("")))
    every = lambda test: (F.size(files) > 0) & F.forall(files, test)
    ran = lambda *s: F.count_if(F.col("status").isin(*s))
    t = tools.groupBy("patch_id").agg(ran("FAILED", "TIMEOUT").alias("failed"), ran("INVALID_OUTPUT").alias("invalid"), ran("UNAVAILABLE").alias("away"), ran("COMPLETED").alias("done"), F.map_from_entries(F.collect_list(F.struct("tool", "status"))).alias("by_tool"))
    r = rows.join(t, "patch_id", "left").na.fill(0, ["failed", "invalid", "away", "done"])
    verdict = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "PASSED").otherwise("FAILED")
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    routes = F.when(F.col("new_mismatches") > 0, "FAILED").when(F.col("route_finding"), verdict((F.col("target_before") > 0) & (F.col("target_after") == 0))).otherwise("PASSED")
    clean = F.size("secrets") == 0
    parsed = F.size("syntax_errors") == 0
    scanned = F.when(F.col("failed") > 0, "FAILED").when(F.col("invalid") > 0, "NEEDS_REVIEW").when((F.col("away") > 0) & (F.col("done") == 0), "UNAVAILABLE").when(F.col("away") > 0, "NEEDS_REVIEW").when((F.col("done") > 0) & (F.col("done") == enabled), "PASSED").otherwise("NEEDS_REVIEW")
    tool = F.try_element_at("by_tool", lower("source_tool"))
    secret = (F.col("detector_kind") == "deterministic_secret") | lower("category").contains("secret") | lower("title").contains("secret")
    resolved = (
        F.when(tool == "COMPLETED", verdict(~F.col("still_flagged"))).when(tool == "UNAVAILABLE", "NEEDS_REVIEW").when(tool.isNotNull(), "FAILED")
        .when(F.col("route_finding"), routes).when(F.coalesce(secret, F.lit(False)), verdict(clean)).when(F.col("snippet_left"), "FAILED").otherwise("NEEDS_REVIEW")
    )
    checks = {
        "check_1_diff_syntax": verdict(F.size("errors") == 0),
        "check_2_path_confinement": verdict(every(lambda p: ~p.rlike(r"^(/|\\|\.\.)"))),
        "check_3_symlink_traversal_prevention": verdict(every(lambda p: ~p.contains("..") & ~p.rlike(r"^[/\\]"))),
        "check_4_no_binary_modification": verdict(every(lambda p: ~reduce(lambda a, b: a | b, [F.lower(p).endswith(x) for x in BINARY]))),
        "check_5_scope_confinement": verdict((F.size(files) > 0) & (F.size(F.array_except(files, F.transform("plan_files", X.stripped_path))) == 0)),
        "check_6_tree_sitter_parse": verdict(F.col("apply_error").isNull() & parsed),
        "check_7_route_contracts": routes,
        "check_8_graph_rebuild": verdict(F.col("graph_nodes") > 0),
        "check_9_finding_remediation": resolved,
        "check_10_scanners_clean": scanned,
        "check_11_no_secrets_introduced": verdict(clean),
        "check_12_no_new_critical_findings": verdict(clean & parsed & (F.col("new_high") == 0)),
    }
    each = F.array(*[F.struct(F.lit(n).alias("check_name"), c.alias("status")) for n, c in checks.items()])
    return r.select("patch_id", F.explode(each).alias("c")).select("patch_id", "c.check_name", "c.status")
