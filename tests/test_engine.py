import json
import random

import pytest
from pyspark.sql import functions as F

from codequarry import schemas
from codequarry.operators import evaluate, patching, report
from codequarry.sources import files as src
from codequarry.sources import scanners
from codequarry.streaming import events as ev
from codequarry.streaming import run


def test_scanner_documents(spark):
    sem = json.dumps({"results": [{"check_id": "a.b.sql-injection", "path": "./x.py", "start": {"line": 3}, "end": {"line": 4}, "extra": {"message": "m", "severity": "ERROR"}}]})
    tri = json.dumps({"Results": [{"Target": "p.lock", "Vulnerabilities": [{"VulnerabilityID": "CVE-1", "PkgName": "p", "InstalledVersion": "1", "Severity": "CRITICAL"}], "Secrets": [{"RuleID": "r", "Title": "t", "Severity": "HIGH", "StartLine": 1, "EndLine": 1, "Match": "sk-abcdefghijklmnop1"}]}]})
    osv = json.dumps({"results": [{"source": {"path": "r.txt"}, "packages": [{"package": {"name": "q", "version": "2"}, "vulnerabilities": [{"id": "G-1", "summary": "s"}]}]}]})
    doc = lambda *x: spark.createDataFrame([(y,) for y in x], "stdout string")
    a = scanners.semgrep(doc(sem, "junk", None)).collect()
    assert len(a) == 1 and a[0]["severity"] == "HIGH" and a[0]["title"] == "Sql Injection" and a[0]["evidence"]["file_path"] == "x.py"
    b = scanners.trivy(doc(tri, json.dumps(json.loads(tri)["Results"]))).collect()
    assert len(b) == 4 and {r["severity"] for r in b} == {"CRITICAL", "HIGH"} and all("abcdefgh" not in (r["evidence"]["code_snippet"] or "") for r in b)
    assert [r["severity"] for r in scanners.osv(doc(osv)).collect()] == ["MEDIUM"]
    counts = {r["key"]: r["n"] for r in scanners.by_severity(scanners.semgrep(doc(sem))).collect()}
    assert counts == {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 0, "LOW": 0, "INFO": 0}


def test_scanner_fields(spark):
    """Mitigation, confidence, notes and titles as the three formats give them, or do without."""
    doc = lambda x: spark.createDataFrame([(json.dumps(x),)], "stdout string")
    sem = [{"check_id": "plain-id", "path": "a\\b.py", "extra": {"message": "m", "metadata": {"fix": "", "remediation": "do it", "confidence": "high"}}}, {"extra": {}}]
    a, b = scanners.semgrep(doc({"results": sem})).collect()
    assert (a["title"], a["mitigation"], a["confidence"], a["evidence"]["context_notes"], a["evidence"]["file_path"]) == ("plain-id", "do it", "HIGH", "m", "a/b.py")
    assert (b["rule_id"], b["description"], b["confidence"], b["category"]) == ("unknown-rule", "Semgrep rule match", None, "sast")
    vuln = {"VulnerabilityID": "C-1", "PkgName": "p", "InstalledVersion": "1", "FixedVersion": "2", "PrimaryURL": "u"}
    rows = scanners.trivy(doc({"Results": [{"Target": "l", "Vulnerabilities": [vuln, {**vuln, "FixedVersion": ""}], "Misconfigurations": [{"ID": "M", "Message": "why"}]}]})).collect()
    assert [r["mitigation"] for r in rows] == ["Upgrade p to version 2 (Ref: u)", "Reference: u", None]
    assert rows[0]["title"] == "C-1 in p 1" and rows[1]["evidence"]["context_notes"] == "Installed version: 1, Fixed version: N/A" and (rows[2]["title"], rows[2]["description"], rows[2]["detector_kind"]) == ("Misconfiguration: M", "why", None)
    o = scanners.osv(doc({"results": [{"packages": [{"package": {"name": "q"}, "vulnerabilities": [{"id": "G", "details": "d", "aliases": ["X", "Y"]}]}]}]})).first()
    assert (o["title"], o["description"], o["evidence"]["code_snippet"], o["evidence"]["context_notes"]) == ("G in q@unknown", "d", "q==unknown ()", "Vulnerable package q version unknown. Aliases: X, Y")


def test_scanner_status(spark):
    rows = [("semgrep", True, True, False, 1, "{}", "COMPLETED"), ("trivy", True, True, False, 1, "{}", "FAILED"), ("osv", True, True, False, 0, " ", "INVALID_OUTPUT"), ("osv", True, True, False, 0, "x{", "INVALID_OUTPUT"), ("osv", False, True, False, 0, "{}", "DISABLED"), ("osv", True, False, False, 0, "{}", "UNAVAILABLE"), ("osv", True, True, True, 0, "{}", "TIMEOUT")]
    df = spark.createDataFrame(rows, "t string, e boolean, a boolean, o boolean, c int, s string, want string")
    assert df.where(scanners.status(*[F.col(x) for x in "teaocs"]) != F.col("want")).count() == 0


def test_verifier(spark):
    c = spark.createDataFrame([(1, "Bug A", "x.py", 3, 99), (2, "bug-a", "x.py", 3, 4), (3, "B", "none.py", 1, 1), (4, "C", "x.py", 11, 12), (5, "D", None, 1, 1)], "seq int, title string, file_path string, start_line int, end_line int")
    got = {r["seq"]: (r["reason"], r["clamped_end"]) for r in scanners.verify(c, spark.createDataFrame([("x.py", 10)], "path string, lines_count int")).collect()}
    assert got[1] == (None, 10) and got[2][0] == "Duplicate" and got[3][0] == "File does not exist" and got[4][0] == "Line out of bounds" and got[5][0] == "No evidence"


def test_greedy_budget(spark):
    f = spark.createDataFrame([(f"f{i}", n, b, "x") for i, (n, b) in enumerate([(2000, False), (9000, True), (2500, False), (2000, False), (400, False)])], "path string, size_bytes bigint, is_binary boolean, content string")
    got = {r["path"]: r["skipped_reason"] for r in src.manifest(f, 10, 4000, 5000).collect()}
    assert got == {"f0": None, "f1": "byte budget exceeded", "f2": None, "f3": "byte budget exceeded", "f4": None}


def test_greedy_budget_by_pieces(spark):
    """No row is left out however many there are, repeated paths and a null repository included; repositories span pieces."""
    rng = random.Random(3)
    rows = [(repo, f"f{i % 480:04d}", rng.choice([0, 1, 3, 40, 90, 200, 700]), i % 7 == 0) for repo, m in (("hot", 500), ("b", 30), (None, 60), ("c", 1)) for i in range(m)]
    f = spark.createDataFrame([(*x, "x") for x in rows], "repo string, path string, size_bytes bigint, is_binary boolean, content string")
    for budget in (50, 2000, 20000, 10**9):
        want = []
        for repo in {x[0] for x in rows}:
            used = 0
            for x in sorted(x for x in rows if x[0] == repo):
                why = "byte budget exceeded" if used + x[2] > budget else "file too large" if x[2] > 500 else "binary" if x[3] else None
                used += 0 if why else x[2]
                want.append((*x, why))
        for whole in (src.manifest(f, None, 500, budget, "repo"), src.listed(src.folded_by_pieces(f, ["repo"], 500, budget, 20), ["repo"])):
            got = [tuple(r) for r in whole.select("repo", "path", "size_bytes", "is_binary", "skipped_reason").collect()]
            assert sorted(map(str, got)) == sorted(map(str, want)), budget
    one = f.where("repo = 'b'").drop("repo")
    assert src.manifest(one, None, 500, 300).count() == 30


def test_whole_chunks_and_parity(spark, tmp_path):
    """Lines past the fifth are in the chunk, up to 500; rows of every remainder of doc_id are compared."""
    from codequarry.plans import named

    rows = [(1, "\n".join(f"l{i}" for i in range(7)) + "\n", "en", "s", 1), (2, "\n".join(map(str, range(600))), "en", "s", 2), (3, "a", "en", "s", 2), (5, "b", "fr", "s", 5), (6, " ", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r["file_path"]): r["content"].split("\n") for r in named.QUERIES["q_chunk_fallback_500"](spark, str(tmp_path)).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 7, 2: 500, 3: 1, 5: 1} and got[2][-1] == "499"
    diff = {tuple(r) for r in named.QUERIES["q_set_diff_parity"](spark, str(tmp_path)).collect()}
    assert diff == {("s", "fr", 5, "new")}  # doc_id 5 leaves 2 by 3


def test_scan_and_frameworks(spark, tmp_path):
    for p, c in {"package.json": '{"dependencies": {"next": "14", "react": "18"}}', "requirements.txt": "# c\nfastapi==0.1\nunknown\n", "a/b.py": "x=1\n", "node_modules/x.js": "no", "pic.png": "a\0b"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(c)
    f = src.scan(spark, str(tmp_path))
    rows = {r["path"]: r["is_binary"] for r in f.collect()}
    assert rows == {"package.json": False, "requirements.txt": False, "a/b.py": False, "pic.png": True}
    names = {r["name"] for r in src.frameworks(f).collect()}
    assert names == {"Next.js", "React", "FastAPI"}


DIFF = "--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n one\n-two\n+TWO\n three\n@@ -5,1 +5,2 @@\n five\n+six\n"


@pytest.mark.parametrize(("diff", "error", "content"), [
    (DIFF, None, "one\nTWO\nthree\nfour\nfive\nsix\n"), (DIFF.replace("-two", "-2"), "context mismatch", None), (DIFF.replace("@@ -1,3 +1,3", "@@ -1,4 +1,3"), "count mismatch", None),
    (DIFF.replace("x.py", "../x.py"), "path leaves the repository", None), ("--- /dev/null\n+++ b/new.py\n@@ -0,0 +1,2 @@\n+a\n+b\n", None, "a\nb"), (DIFF.replace("-5,1 +5,2", "-3,1 +3,2"), "overlapping hunks", None),
])
def test_patch_apply(spark, diff, error, content):
    files = spark.createDataFrame([("x.py", "one\ntwo\nthree\nfour\nfive\n"), ("../x.py", "one\ntwo\nthree\nfour\nfive\n")], "path string, content string")
    r = patching.apply(patching.diff_lines(spark.createDataFrame([("p", diff)], "patch_id string, unified_diff string")), files).first()
    assert (r["error"], r["content"]) == (error, content)


def test_patch_rules(spark):
    p = spark.createDataFrame([("a", DIFF, ["x.py"], ["x.py"], ["x.py"]), ("b", "", None, None, None), ("c", DIFF, None, ["y.py"], None)], "patch_id string, unified_diff string, files_modified array<string>, known_files array<string>, plan_files array<string>")
    got = {r["patch_id"]: r["errors"] for r in patching.validate_patch(p).collect()}
    assert got["a"] == [] and "empty diff" in got["b"] and got["c"] == ["fabricated files"]
    bad = DIFF.replace("-1,3 +1,3", "-1,9 +1,3")
    assert patching.hunk_errors(patching.diff_lines(spark.createDataFrame([("p", bad)], "patch_id string, unified_diff string"))).count() >= 1
    checks = spark.createDataFrame([("a", "1", "PASSED"), ("b", "1", "NEEDS_REVIEW"), ("c", "1", "FAILED"), ("c", "2", "NEEDS_REVIEW")], "patch_id string, check_name string, status string")
    assert {r["patch_id"]: r["status"] for r in patching.verification_status(checks).collect()} == {"a": "PASSED", "b": "NEEDS_REVIEW", "c": "FAILED"}


def test_delivery_rules(spark):
    cols = "patch_id string, finding_id string, scan_id string, patch_status string, approved_by string, machine_verdict string, scan_status string, verdict string, commit_hash string, repository_url string, branch string, unified_diff string, files_modified array<string>, head_sha string"
    ok = ("p", "f", "s", "APPROVED", "me", "PASSED", "COMPLETED", "CONFIRMED", "a" * 40, "https://github.com/o/r.git", "fix/x", DIFF, ["./x.py"], "a" * 40)
    rows = [ok, (*ok[:3], "DRAFT", *ok[4:]), (*ok[:10], "HEAD@x", *ok[11:]), (*ok[:12], ["y"], ok[13]), (*ok[:13], "b" * 40)]
    df = spark.createDataFrame([(str(i), *r[1:]) for i, r in enumerate(rows)], cols)
    assert [r["failure_code"] for r in patching.delivery_block(df).orderBy("patch_id").collect()] == [None, "PATCH_NOT_APPROVED", "INVALID_BASE_BRANCH", "FILE_SET_MISMATCH", "BLOCKED_BASE_DRIFT"]
    more = [(*ok[:3], None, *ok[4:]), (ok[0], None, *ok[2:]), (*ok[:2], None, *ok[3:]), (*ok[:5], "REJECTED", *ok[6:]), (*ok[:8], "abc", *ok[9:]), (*ok[:9], "https://gitlab.com/o/r", *ok[10:]), (*ok[:11], None, *ok[12:]), (*ok[:10], None, *ok[11:])]
    df = spark.createDataFrame([(str(i), *r[1:]) for i, r in enumerate(more)], cols)
    want = ["PATCH_NOT_FOUND", "FINDING_NOT_FOUND", "SCAN_NOT_FOUND", "MACHINE_VERDICT_REJECTED", "INVALID_COMMIT_SHA", "INVALID_REPOSITORY_URL", "DIFF_PARSE_FAILED", None]
    assert [r["failure_code"] for r in patching.delivery_block(df).orderBy("patch_id").collect()] == want
    late = spark.createDataFrame([("0", *ok[1:])], cols)
    for column, code in (("remote_error", "REMOTE_BRANCH_UNRESOLVED"), ("snapshot_error", "SNAPSHOT_REHYDRATION_FAILED"), ("reapply_error", "PATCH_REAPPLY_FAILED")):
        assert patching.delivery_block(late.withColumn(column, F.lit("x"))).first()["failure_code"] == code
    assert patching.delivery_block(late.withColumn("patched_contents", F.array(F.lit("ok"), F.lit("password='hunter22'")))).first()["failure_code"] == "PATCH_CONTAINS_SECRETS"


def test_metrics(spark):
    truth = spark.createDataFrame([(1, "i1", "a.py", 10, 20), (2, "i2", "b.py", 1, 2)], "gt_seq int, issue_id string, expected_file string, expected_start_line int, expected_end_line int")
    found = spark.createDataFrame([("f1", "a.py", 24), ("f2", "c.py", 1)], "finding_id string, file_path string, start_line int")
    r = evaluate.finding_metrics(found, truth, 2, 1).first().asDict()
    assert r == {"precision": 0.5, "recall": 0.5, "fpr": 0.5, "localisation": 1.0, "rejection": 0.5}
    e = spark.createDataFrame([("q", "c1"), ("q", "c2"), ("n", None)], "query_id string, chunk_id string")
    ranked = spark.createDataFrame([("q", "c1", 2), ("q", "c3", 1)], "query_id string, chunk_id string, rank int")
    assert {x["query_id"]: (x["recall"], x["mrr"]) for x in evaluate.ranking_metrics(ranked, e, 2).collect()} == {"q": (0.5, 0.5), "n": (1.0, 0.0)}


def test_sanitiser(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1}}}}}}}}
    cases = [{"stage": "x", "n": 5, "null": None}, {"api_key": "s", "ok": 1}, {f"f{i}": i for i in range(200)}, {"l": list(range(200))}, {"s": "x" * 10_000}, deep, {f"f{i}": "y" * 2000 for i in range(45)}]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(cases)] + [(7, None), (8, "junk")], "i int, p string")
    got = [json.loads(r["o"]) for r in df.select("i", report.sanitised("p").alias("o")).orderBy("i").collect()]
    assert got[0] == cases[0] and got[1] == {"ok": 1} and len(got[2]) == 51 and got[2]["_truncated"] and len(got[3]["l"]) == 51 and len(got[4]["s"]) < 2100
    assert "[truncated: max depth exceeded]" in json.dumps(got[5]) and got[7] == got[8] == {}
    assert got[6] == {"_truncated": True, "reason": "Total metadata serialized bytes exceeded limit (65536 bytes)"}
    assert got[3]["l"][-1] == "[truncated: max items exceeded]"
    # sensitive keys don't count towards the entries, and strings are redacted
    many = {f"my_token_{i}": i for i in range(60)} | {f"f{i}": "sk-abcdefghijklmnopqrst" for i in range(50)}
    out = json.loads(spark.createDataFrame([(json.dumps(many),)], "p string").select(report.sanitised("p").alias("o")).first()["o"])
    assert len(out) == 50 and set(out.values()) == {"sk-[REDACTED]"}


def test_report_and_telemetry(spark):
    f = spark.createDataFrame([("f1", "s", "HIGH", "CONFIRMED", '{"prompt_tokens":5,"retry_count":0,"retries":2}'), ("f2", "s", "LOW", "POSSIBLE", None)], "id string, scan_id string, severity string, verification_verdict string, model_metadata string")
    e = spark.createDataFrame([("e1", "f1", "x.py")], "id string, finding_id string, file_path string")
    p = spark.createDataFrame([("p1", "f1", "APPROVED", "VERIFIED", None)], "id string, finding_id string, status string, machine_verdict string, parent_patch_id string")
    d = spark.createDataFrame([("d1", "p1")], "id string, patch_id string")
    rows = {r["finding_id"]: r for r in report.nested(f, e, p, d).collect()}
    assert len(rows["f1"]["evidences"]) == len(rows["f1"]["patches"]) == 1 and rows["f2"]["patches"] == [] and rows["f1"]["patches"][0]["deliveries"][0]["id"] == "d1"
    s = report.summary(f, p, d).first()
    assert (s["findings"], s["high"], s["patches_verified"], s["patches_approved"], s["deliveries"]) == (2, 1, 1, 1, 1)
    scans = spark.sql("SELECT 's' id, 'COMPLETED' status, timestamp'2024-01-01 00:00:00' created_at, timestamp'2024-01-01 00:00:05.5' completed_at UNION ALL SELECT 't', 'RUNNING', timestamp'2024-01-01 00:00:00', null")
    events = spark.createDataFrame([(1, "s", "TOOL_COMPLETED", "semgrep", "scan", None), (2, "s", "STAGE_STARTED", None, None, '{"stage":"map"}'), (3, "s", "TOOL_FAILED", "semgrep", None, None)], "id long, scan_id string, event_type string, tool_name string, stage string, metadata_payload string")
    t = {r["scan_id"]: r for r in report.telemetry(scans, events, f).collect()}
    assert (t["s"]["duration_ms"], t["s"]["stages"], t["s"]["prompt_tokens"], t["s"]["retries"], t["s"]["total_tokens"]) == (5500, 2, 5, 2, None) and t["t"]["duration_ms"] is None and t["t"]["events"] == 0
    assert [tuple(r) for r in report.coverage(events).collect()] == [("s", "semgrep", "COMPLETED")]
    assert report.lineage(p).first()["child_id"] is None


def test_whole_reports(spark):
    """A scan with a finding, evidence, a patch and its delivery, and one without anything, as JSON and as Markdown."""
    none = "cast(null as string)"
    scans = spark.sql(f"select 's' id, 'https://github.com/o/r' repository_url, {none} commit_hash, 'main' branch, 'COMPLETED' status union all select 't', 'u', 'abc', null, 'FAILED'")
    findings = spark.sql(f"select 'f' id, 's' scan_id, 'A <b>' title, 'password = \\'hunter22\\'' description, 'HIGH' severity, 'OPEN' status, 'r' rule_id, {none} category, 'do' mitigation_guidance, 'CONFIRMED' verification_verdict, {none} verification_reason, {none} source_tool, {none} detector_id")
    evidences = spark.sql(f"select 'e' id, 'f' finding_id, 'x.py' file_path, 3 start_line, cast(null as int) end_line, {none} context_notes, 'a ``` b' code_snippet")
    patches = spark.sql(f"select 'patch-123456' id, 'f' finding_id, 's' scan_id, 'APPROVED' status, 'PASSED' machine_verdict, 2 revision_number, 'me' approved_by, {none} approved_at, {none} rejected_reason, {none} user_feedback, array('x.py') files_modified, 'why' explanation, '--- a' unified_diff")
    deliveries = spark.sql(f"select 'd' id, 'patch-123456' patch_id, 's' scan_id, 'PR_CREATED' status, 7 pr_number, 'http://p' pr_url, {none} head_branch")
    events = spark.sql("select 1L id, 's' scan_id, 'TOOL_COMPLETED' event_type, cast(null as string) stage, 'semgrep' tool_name, 'a|b' message, timestamp'2024-01-01 10:00:00' created_at")
    made = report.scan_reports(scans, findings, evidences, patches, deliveries, events)
    texts = {r["scan_id"]: r["markdown"] for r in report.markdown(made, "Own").collect()}
    s = texts["s"]
    for line in ("# Own Evidence & Intelligence Report", "**Commit SHA**: `N/A`  ", "| **Total Findings** | 1 |", "| 🔄 Child Revisions | 1 |", "### 1. [HIGH] A &lt;b&gt;", "- **Category**: `General`", "- **Rule ID**: `r`", "password='[REDACTED]'", "**Source Evidences** (1):", "📁 `x.py` (lines 3-?)", "````", "#### Patch `patch-12` (Revision #2) — Status: `APPROVED`",
                 "- **GitHub Delivery**: 1 delivery record(s)", "  - Status: `PR_CREATED` [PR #7](http://p) (Branch: `N/A`)", "```diff", "## Workflow Audit Trail (1 events)"):
        assert line in s.split("\n"), line
    assert "| `1` | " in s and "a\\|b" in s and "Detector / Source" not in s and "hunter22" not in s
    assert "*No security or architectural findings were identified in this scan.*" in texts["t"] and texts["t"].rstrip().endswith("*No durable workflow events recorded.*") and "`default`" in texts["t"]
    j = {r["scan_id"]: json.loads(r["json"]) for r in report.as_json(made).collect()}
    assert j["s"]["findings"][0]["patches"][0]["deliveries"][0]["status"] == "PR_CREATED" and j["t"]["findings"] == [] and j["s"]["summary"]["pull_requests_created"] == 1
    body = report.pr_body(spark.sql("select 'p' patch_id, 't|<' title, 'd' description, 'LOW' severity, cast(null as string) category, cast(null as string) verification_verdict, 'abc' commit_hash, 'e' explanation, 'b' expected_behavior_change, cast(null as array<string>) files_modified, cast(null as string) machine_verdict, 'me' approved_by, 'hi' notes"), "Own").first()["body"]
    assert "- None recorded" in body and "**Category**: `Security/Quality`" in body and "Approved by `me`" in body and "### ✍️ Human Sign-Off Notes\n\nhi\n" in body
    stored = report.event_rows(spark.createDataFrame([("sk-abcdefghijklmnopqrst" + "x" * 3000, '{"prompt": 1, "a": 2}'), (None, None)], "message string, metadata_payload string")).collect()
    assert stored[0]["message"].startswith("sk-[REDACTED]") and stored[0]["metadata_payload"] == '{"a":2}' and stored[1]["message"] is None


def test_pieces_of_reports_are_the_whole_reports(spark):
    """Scans with ten findings and events, with one each and with nothing; rows of a scan that isn't there. No piece holds two findings."""
    none = "cast(null as string)"
    scan = "if(id = 10, 't', if(id = 11, 'gone', 's')) scan_id"
    n = spark.range(12)
    scans = spark.sql(f"select x id, 'u' repository_url, {none} commit_hash, 'main' branch, 'COMPLETED' status from values ('s'), ('t'), ('none') as t(x)")
    findings = n.selectExpr("concat('f', id) id", scan, "concat('T', id, ' sk-abcdefghijklmnopqrst') title", "'d' description", "'HIGH' severity", "'OPEN' status", "'r' rule_id", f"{none} category", f"{none} mitigation_guidance", "'CONFIRMED' verification_verdict", f"{none} verification_reason", f"{none} source_tool", f"{none} detector_id")
    evidences = n.where("id % 2 = 0").selectExpr("concat('e', id) id", "concat('f', id) finding_id", "'x.py' file_path", "3 start_line", "cast(null as int) end_line", f"{none} context_notes", "'a' code_snippet")
    patches = n.selectExpr("concat('p', id) id", "concat('f', id % 3) finding_id", "'s' scan_id", "'APPROVED' status", "'PASSED' machine_verdict", "2 revision_number", "'me' approved_by", f"{none} approved_at", f"{none} rejected_reason", f"{none} user_feedback", "array('x.py') files_modified", "'why' explanation", "'--- a' unified_diff")
    deliveries = n.where("id < 3").selectExpr("concat('d', id) id", "concat('p', id) patch_id", "'s' scan_id", "'PR_CREATED' status", "7 pr_number", "'http://p' pr_url", f"{none} head_branch")
    events = n.selectExpr("id", scan, "'TOOL_COMPLETED' event_type", f"{none} stage", "'semgrep' tool_name", "'m' message", "timestamp'2024-01-01 10:00:00' created_at")
    tables, at = (scans, findings, evidences, patches, deliveries, events), F.lit("2024-01-01 10:00:00").cast("timestamp")
    made, parts = report.scan_reports(*tables), report.scan_parts(*tables)
    for whole, pieces, between in ((report.as_json(made), report.json_pieces(*parts), ""), (report.markdown(made, "Own", at), report.markdown_pieces(*parts, "Own", at), "\n")):
        got = {}
        for r in sorted(pieces.collect(), key=lambda r: (r["scan_id"], r["section"], r["finding_id"] or "", r["event_id"] or 0)):
            got.setdefault(r["scan_id"], []).append(r["piece"])
        assert {k: between.join(v) for k, v in got.items()} == {r[0]: r[1] for r in whole.collect()}
        assert {k: len(v) for k, v in got.items()} == {"s": 23, "t": 5, "none": 3} and max(p.count("sk-[REDACTED]") for v in got.values() for p in v) == 1


def test_text_of_ids_urls_and_times(spark):
    import uuid

    from codequarry.functions import text as X

    ids = ["hello", "", "1B4E28BA-2FA1-11D2-883F-0016D3CCA427", "1b4e28ba2fa111d2883f0016d3cca427", "é"]
    df = spark.createDataFrame([(x,) for x in [*ids, None]], "x string")
    got = [r[0] for r in df.select(X.uuid5_dns(F.col("x"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, x)) if len(x) < 32 else "1b4e28ba-2fa1-11d2-883f-0016d3cca427" for x in ids] + [None]
    code = spark.createDataFrame([("a`b",), ("x<",), (None,)], "x string").select(X.inline_code(F.col("x")), X.code_block(F.col("x"), "py")).collect()
    assert [r[0] for r in code] == ["`` a`b ``", "`x&lt;`", "``"] and code[2][1] == "```py\n```"


def test_stream_ends_and_lists(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "a", "b"), (5, "b", "z")], "id long, scan_id string, event_type string")
    assert [tuple(r) for r in ev.client_list(e).collect()] == [(1, "a", "x"), (2, "a", "b"), (5, "b", "z")]
    scans = spark.createDataFrame([("a", "COMPLETED"), ("b", "FAILED"), ("c", "RUNNING"), ("d", "COMPLETED")], "id string, status string")
    done = {r["scan_id"]: r["done"] for r in ev.finished(scans, e, spark.createDataFrame([("a", 1), ("b", 5)], "scan_id string, after long")).collect()}
    assert done == {"a": False, "b": True, "c": False, "d": True}
    spark.sql("select id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) ts from range(20)").write.parquet(f"{tmp_path}/in")
    spark.sql("select id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) ts from range(10)").write.mode("append").parquet(f"{tmp_path}/in")
    out = run.drain(ev.after_cursor(ev.read(spark, f"{tmp_path}/in", "id long, ts timestamp"), 4, time_col="ts"))
    assert sorted(r["id"] for r in out.collect()) == list(range(5, 20))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"k{i % 3}", f"s{i}") for i in range(1, 11)], "id long, key string, status string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    rows.limit(2).write.mode("append").parquet(f"{tmp_path}/in")
    out = run.drain(ev.after_cursor(ev.read(spark, f"{tmp_path}/in", "id long, key string, status string"), 4))
    assert sorted(r["id"] for r in out.collect()) == list(range(5, 11))
    assert {r["key"]: r["last_id"] for r in ev.latest_state(rows, "key", F.col("status")).collect()} == {"k0": 9, "k1": 10, "k2": 8}
    q = ev.lifecycle(ev.read(spark, f"{tmp_path}/in", "id long, key string, status string"), "key", "status").writeStream.outputMode("update").format("memory").queryName("life").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["key"]: r["last_id"] for r in spark.sql("select key, max(last_id) last_id from life group by key").collect()} == {"k0": 9, "k1": 10, "k2": 8}
    c = spark.createDataFrame([("7", 1), ("x", 1), (None, -4)], "l string, a long")
    assert [r[0] for r in c.select(ev.cursor(F.col("l"), F.col("a"))).collect()] == [7, None, 0]


def test_named_queries_match_their_sql(spark):
    import duckdb

    from codequarry.plans import named, rules

    assert rules.QUERIES is named.QUERIES
    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in "documents embeddings benchmark pages labels conversations region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{where}/{name}.parquet'")
    for name, sql in named.SQL.items():
        want, got = con.execute(sql).df(), named.QUERIES[name](spark, where).toPandas()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols, name
        norm = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).to_numpy().tolist()))
        assert norm(got) == norm(want), name
    assert schemas.SEVERITIES[0] == "CRITICAL"


def test_model_answers(spark):
    from codequarry.operators import answers

    a = spark.createDataFrame([("s1", '```json\n[{"title":"T","severity":"odd","start_line":"x","mitigation":"m","mitigation_guidance":""}]\n```', "own", "P", "m"), ("s2", '{"findings": []}', "own", None, "m"), ("s3", "junk", "own", None, "m"), ("s4", None, "own", None, "m")], "scan_id string, content string, default_category string, provider string, model_name string")
    rows = answers.findings_of(a).collect()
    assert len(rows) == 1 and (rows[0]["severity"], rows[0]["mitigation_guidance"], rows[0]["evidence"]["start_line"], rows[0]["evidence"]["file_path"], rows[0]["evidence"]["context_notes"]) == ("MEDIUM", "m", None, "unknown", "Identified by P (m)")
    r = spark.createDataFrame([("q", '{"evidences": [{"source_url": "https://docs.python.org/3", "confidence": 0.5}, {"source_url": ""}]}', [("https://x.example", None), ("https://docs.python.org/3", "t"), (None, "n")]), ("z", None, None)], "query_id string, content string, grounding array<struct<uri: string, title: string>>")
    got = answers.ranked_evidence(answers.research_evidence(r)).orderBy("query_id", "rank").collect()
    assert [(x["source_url"], x["source_tier"], x["confidence"], x["rank"]) for x in got] == [("https://docs.python.org/3", 1, 0.5, 1), ("https://x.example", 5, 0.9, 2)]
    p = spark.createDataFrame([("a", '{"unified_diff": " --- a/x.py\\n+++ b/x.py\\n "}', ["p.py"]), ("b", "--- a/y\n+++ b/y.py\n", ["p.py"]), ("c", "{}", ["p.py"])], "patch_id string, content string, plan_files array<string>")
    assert {x["patch_id"]: (x["files_modified"], x["explanation"]) for x in answers.patches_of(p).collect()} == {"a": (["x.py"], "Patch generated for finding."), "b": (["y.py"], "Patch generated for finding."), "c": (["p.py"], "Patch generated for finding.")}
    assert answers.specialist_query("architecture", "x" * 99).endswith(" " + "x" * 80) and answers.specialist_query("bug", "x") == answers.SPECIALIST_QUERIES["bug"]
    f = spark.createDataFrame([("HIGH", "REJECTED"), ("LOW", "POSSIBLE")], "severity string, verification_verdict string")
    assert answers.shown(f).count() == 2 and answers.shown(f, verdict="REJECTED").count() == 0 and answers.shown(f, "LOW", "POSSIBLE").count() == 1
    m = answers.scan_metadata(spark.createDataFrame([(1, '{"scope": {"a": 1}, "scanners": []}'), (2, None)], "id int, model_metadata string"))
    assert [tuple(x) for x in m.orderBy("id").collect()] == [(1, '{"a":1}', None), (2, None, None)]


def test_retrieval_variants(spark):
    """Five variants over three queries: what each channel finds, and averages that count what isn't found."""
    rows = [("k1", "auth/login.py", "login", "FUNCTION", "def login user token"), ("k2", "auth/util.py", "helper", "FUNCTION", "token token"), ("k3", "x.py", "other", "CLASS", "nothing here")]
    c = spark.createDataFrame(rows, "chunk_id string, file_path string, symbol string, symbol_kind string, content string")
    v = spark.createDataFrame([("k1", [1.0, 0.0]), ("k2", [0.0, 1.0]), ("k3", [0.5, 0.5])], "chunk_id string, embedding array<double>")
    nodes = spark.createDataFrame([("file:auth/login.py", "FILE", "auth/login.py"), ("file:x.py", "FILE", "x.py")], "id string, kind string, file_path string")
    edges = spark.createDataFrame([("file:auth/login.py", "file:x.py")], "source string, target string")
    expected = spark.createDataFrame([("a", "k1"), ("b", "k3"), ("c", None)], "query_id string, chunk_id string")
    got = {r["variant"]: r for r in evaluate.retrieval_benchmark(c, {"a": ("login", [0.0, 1.0]), "b": ("login", [1.0, 0.0]), "c": ("zzz", [0.0, 1.0])}, expected, 1, v, nodes, edges).collect()}
    assert set(got) == set(evaluate.VARIANTS) and all(r["queries"] == 3 for r in got.values())
    assert got["LEXICAL_ONLY"]["recall"] == round((1 + 0 + 1) / 3, 4) and got["VECTOR_ONLY"]["recall"] == round((0 + 0 + 1) / 3, 4)
    assert got["LEXICAL_VECTOR_GRAPH"]["recall"] == got["HYBRID_GRAPH_RERANKER"]["recall"]


def test_twelve_checks_by_tool_and_finding(spark):
    none = "cast(array() as array<string>)"
    diff = "'--- a/x.py\\n+++ b/x.py\\n@@ -1 +1 @@\\n-a\\n+b\\n'"
    base = f"{none} errors, {diff} unified_diff, array('x.py') plan_files, cast(null as string) apply_error, {none} syntax_errors, 0 new_mismatches, 0 target_before, 0 target_after, false route_finding, 3 graph_nodes, {none} secrets, 'semgrep' source_tool, cast(null as string) detector_kind, 'c' category, 't' title, false still_flagged, cast(null as boolean) snippet_left, 0 new_high"
    rows = spark.sql(f"select 'p' patch_id, {base}").unionByName(spark.sql(f"select 'q' patch_id, {base}").withColumn("unified_diff", F.lit("+++ b/../x.PNG\n")).withColumn("secrets", F.array(F.lit("k"))).withColumn("source_tool", F.lit(None).cast("string")).withColumn("category", F.lit("Secret")))
    tools = spark.createDataFrame([("p", "semgrep", "COMPLETED")], "patch_id string, tool string, status string")
    got = {(r["patch_id"], r["check_name"].split("_")[1]): r["status"] for r in patching.twelve_checks(rows, tools, 1).collect()}
    assert len(got) == 24 and all(got["p", str(i)] == "PASSED" for i in range(1, 13))
    assert [got["q", str(i)] for i in (2, 3, 4, 5, 9, 10, 11, 12)] == ["FAILED", "FAILED", "FAILED", "FAILED", "FAILED", "NEEDS_REVIEW", "FAILED", "FAILED"]
    status = patching.verification_status(patching.twelve_checks(rows, tools, 1))
    assert {r["patch_id"]: r["status"] for r in status.collect()} == {"p": "PASSED", "q": "FAILED"}


def test_rerank_stderr_and_plans(spark):
    from codequarry.functions import text as X
    from codequarry.operators import retrieval

    rows = [("k1", "a.py", "login", "FUNCTION", "login"), ("k2", "b.py", "login", "FUNCTION", "login login"), ("k3", "c.py", "x", "CLASS", "login")]
    c = spark.createDataFrame(rows, "chunk_id string, file_path string, symbol string, symbol_kind string, content string")
    plain = [r["chunk_id"] for r in retrieval.retrieve(c, "login", 3).collect()]
    scores = spark.createDataFrame([(plain[-1], 0.99)], "chunk_id string, score double")
    again = retrieval.retrieve(c, "login", 3, rerank=scores).collect()
    assert [r["chunk_id"] for r in again] == [plain[-1], *plain[:-1]] and again[0]["score"] == 0.99
    got = spark.createDataFrame([(" \n",), (None,), (" x ",), ("y" * 2001,)], "x string").select(X.stderr_text(F.col("x"))).collect()
    assert [r[0] for r in got] == [None, None, "x", "y" * 2000 + "\n... [truncated]"]
    got = spark.createDataFrame([(None,), ("",), (" a System Prompt b ",)], "x string").select(X.defused(F.col("x"))).collect()
    assert [r[0] for r in got] == ["", "", "<untrusted_external_evidence>\na [filtered] b\n</untrusted_external_evidence>"]
    plan = "'CONFIRMED' verdict, 'o' objective, 'r' root_cause, array('./a.py') planned_files, array(named_struct('target_file', 'a.py', 'description', 'd', 'rationale', 'hide contract mismatch with alias')) steps, array('t') validation_plan, array('./a.py') known_files"
    rows = spark.sql(f"select 'p' plan_id, {plan}")
    assert patching.validate_plan(rows).first()["errors"] == ["invented files", "forbidden: hide contract mismatch with alias"]
    assert patching.validate_plan(rows.withColumn("known_files", F.lit(None).cast("array<string>")).withColumn("verdict", F.lit(None).cast("string"))).first()["errors"] == ["finding not confirmed", "forbidden: hide contract mismatch with alias"]


def test_patches_are_applied_in_batches_and_not_group_by_group(spark):
    diff = "--- a/d/x.txt\n+++ b/d/x.txt\n@@ -1,1 +1,1 @@\n-a\n+b\n@@ -3,1 +3,2 @@\n c\n+d\n"
    p = spark.range(300).selectExpr("cast(id as string) as patch_id", f"'{diff}' as unified_diff".replace("\n", "\\n"))
    made = patching.apply(patching.diff_lines(p), spark.createDataFrame([("d/x.txt", "a\nb\nc\n")], "path string, content string"))
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in made.drop("patch_id").collect()} == {("d/x.txt", "b\nb\nc\nd\n", None)} and made.count() == 300
