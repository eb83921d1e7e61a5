"""Scanner output as tables: JSON documents of three tools to one findings schema (SRC6-10, AGG1, FLT1-4, PIP5-6, PIP17)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.schemas import SEVERITIES

# Exit codes that count as success, by tool (fixed values).
EXIT_CODES = {"semgrep": [0, 1], "osv": [0, 1], "trivy": [0]}

SEMGREP = "struct<results: array<struct<check_id: string, path: string, start: struct<line: int>, end: struct<line: int>, extra: struct<message: string, severity: string, lines: string, metadata: struct<category: string, confidence: string, fix: string, remediation: string>>>>>"
TRIVY_RESULT = (
    "array<struct<Target: string, Vulnerabilities: array<struct<VulnerabilityID: string, PkgName: string, InstalledVersion: string, FixedVersion: string, Title: string, Description: string, Severity: string, PrimaryURL: string>>, "
    "Secrets: array<struct<RuleID: string, Title: string, Severity: string, StartLine: int, EndLine: int, Match: string, Code: struct<Lines: array<struct<Content: string>>>>>, "
    "Misconfigurations: array<struct<ID: string, Title: string, Description: string, Message: string, Severity: string, Resolution: string>>>>"
)
OSV = "struct<results: array<struct<source: struct<path: string>, packages: array<struct<package: struct<name: string, version: string, ecosystem: string>, vulnerabilities: array<struct<id: string, summary: string, details: string, aliases: array<string>, database_specific: struct<severity: string>>>>>>>>"


def raw(spark: SparkSession, path: str) -> DataFrame:
    """path, stdout: a row per scanner document of a folder."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("stdout"))


def status(tool: Column, enabled: Column, available: Column, timed_out: Column, exit_code: Column, stdout: Column) -> Column:
    """SRC9-10: how a run ended."""
    codes = F.create_map(*[x for t, c in EXIT_CODES.items() for x in (F.lit(t), F.array(*map(F.lit, c)))])
    accepted = F.array_contains(F.coalesce(codes[tool], F.array(F.lit(0))), exit_code)
    parsed = F.try_parse_json(stdout).isNotNull()
    blank = F.trim(F.coalesce(stdout, F.lit(""))) == ""
    return F.when(~enabled, "DISABLED").when(~available, "UNAVAILABLE").when(timed_out, "TIMEOUT").when(~accepted, "FAILED").when(blank | ~parsed, "INVALID_OUTPUT").otherwise("COMPLETED")


def _finding(tool: str, rule: Column, title: Column, description: Column, sev: Column, category: Column, path: Column, start: Column, end: Column, snippet: Column, mitigation: Column, confidence: Column, notes: Column | None = None, kind: str | None = "static_scanner") -> list[Column]:
    none = F.lit(None).cast("string")
    evidence = F.struct(X.stripped_path(path).alias("file_path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), snippet.alias("code_snippet"), (none if notes is None else notes).alias("context_notes"))
    return [F.lit(tool).alias("tool"), rule.alias("rule_id"), title.alias("title"), description.alias("description"), X.severity(sev).alias("severity"), category.alias("category"), evidence.alias("evidence"), mitigation.alias("mitigation"), confidence.alias("confidence"), (F.lit(tool) if kind else none).alias("source_tool"), (rule if kind else none).alias("detector_id"), F.lit(kind).cast("string").alias("detector_kind")]


def semgrep(df: DataFrame, json_col: str = "stdout") -> DataFrame:
    """SRC6: findings of Semgrep documents; unreadable ones give none."""
    r = df.select(F.explode(F.from_json(json_col, SEMGREP)["results"]).alias("r")).select("r.*")
    given = lambda c: F.nullif(F.col(f"extra.metadata.{c}"), F.lit(""))
    rule, message = F.coalesce("check_id", F.lit("unknown-rule")), F.coalesce("extra.message", F.lit("Semgrep rule match"))
    return r.select(*_finding("semgrep", rule, X.rule_title(rule), message, F.col("extra.severity"), F.coalesce("extra.metadata.category", F.lit("sast")), F.coalesce("path", F.lit("")), F.col("start.line"), F.col("end.line"), F.col("extra.lines"), F.coalesce(given("fix"), F.col("extra.metadata.remediation")), F.upper(given("confidence")), message))


def trivy(df: DataFrame, json_col: str = "stdout") -> DataFrame:
    """SRC7: vulnerabilities, secrets and misconfigurations of Trivy documents, whether an object with Results or a bare list."""
    both = F.coalesce(F.when(F.ltrim(json_col).startswith("["), F.from_json(json_col, TRIVY_RESULT)), F.from_json(json_col, f"struct<Results: {TRIVY_RESULT}>")["Results"])
    r = df.select(F.explode(both).alias("r")).select("r.*")
    none, no = F.lit(None).cast("string"), F.lit(None).cast("int")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    given = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    target = F.coalesce("Target", F.lit("repository"))
    v = r.select(target.alias("at"), F.explode("Vulnerabilities").alias("x")).select("at", "x.*")
    rule, pkg, have = F.coalesce("VulnerabilityID", F.lit("UNKNOWN-CVE")), F.coalesce("PkgName", F.lit("package")), F.coalesce("InstalledVersion", F.lit(""))
    fixed, url = F.nullif(F.col("FixedVersion"), F.lit("")), F.nullif(F.col("PrimaryURL"), F.lit(""))
    upgrade = text("Upgrade ", pkg, " to version ", fixed)
    advice = F.coalesce(text(upgrade, " (Ref: ", url, ")"), text("Reference: ", F.when(fixed.isNull(), url)), upgrade)
    notes = text("Installed version: ", have, ", Fixed version: ", F.coalesce(fixed, F.lit("N/A")))
    v = v.select(*_finding("trivy", rule, given(F.col("Title"), text(rule, " in ", pkg, " ", have)), given(F.col("Description"), text("Vulnerability ", rule, " detected in ", pkg, " (", have, ").")), F.col("Severity"), F.lit("vulnerability"), F.col("at"), no, no, text(pkg, "==", have), advice, none, notes))
    s = r.select(target.alias("at"), F.explode("Secrets").alias("x")).select("at", "x.*")
    rule = F.coalesce("RuleID", F.lit("exposed-secret"))
    code = F.array_join(F.transform("Code.Lines", lambda x: F.coalesce(x["Content"], F.lit(""))), "\n")
    snippet = X.redact(F.when(F.size("Code.Lines") > 0, code).otherwise(F.col("Match")))
    s = s.select(*_finding("trivy", rule, F.coalesce("Title", text("Exposed Secret: ", rule)), F.lit("Hardcoded credential or private secret key found in source code."), F.coalesce("Severity", F.lit("CRITICAL")), F.lit("secret"), F.col("at"), F.col("StartLine"), F.col("EndLine"), snippet, F.lit("Revoke the credential immediately and migrate to secure environment variables or secret management."), none, F.lit("Hardcoded secret or credential token detected."), "deterministic_secret"))
    m = r.select(target.alias("at"), F.explode("Misconfigurations").alias("x")).select("at", "x.*")
    rule = F.coalesce("ID", F.lit("misconfiguration"))
    m = m.select(*_finding("trivy", rule, F.coalesce("Title", text("Misconfiguration: ", rule)), given(F.col("Description"), F.coalesce("Message", F.lit(""))), F.col("Severity"), F.lit("misconfiguration"), F.col("at"), no, no, none, F.col("Resolution"), none, F.coalesce("Message", F.lit("Infrastructure misconfiguration")), None))
    return v.unionByName(s).unionByName(m)


def osv(df: DataFrame, json_col: str = "stdout") -> DataFrame:
    """SRC8: vulnerabilities of OSV documents; without a severity they are MEDIUM."""
    r = df.select(F.explode(F.from_json(json_col, OSV)["results"]).alias("r")).select("r.source.path", F.explode("r.packages").alias("p")).select("path", "p.package", F.explode("p.vulnerabilities").alias("v"))
    no, none = F.lit(None).cast("int"), F.lit(None).cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rule, pkg, have = F.coalesce("v.id", F.lit("UNKNOWN-OSV")), F.coalesce("package.name", F.lit("package")), F.coalesce("package.version", F.lit("unknown"))
    described = F.coalesce(F.nullif(F.col("v.summary"), F.lit("")), F.nullif(F.col("v.details"), F.lit("")), text("Vulnerability ", rule, " affects ", pkg, "."))
    names = F.coalesce(F.nullif(F.array_join("v.aliases", ", "), F.lit("")), F.lit("None"))
    notes = text("Vulnerable package ", pkg, " version ", have, ". Aliases: ", names)
    return r.select(*_finding("osv", rule, text(rule, " in ", pkg, "@", have), described, F.coalesce("v.database_specific.severity", F.lit("MEDIUM")), F.lit("dependency"), F.coalesce("path", F.lit("")), no, no, text(pkg, "==", have, " (", F.coalesce("package.ecosystem", F.lit("")), ")"), text("Upgrade dependency ", pkg, " to a non-vulnerable release."), none, notes))


def where(findings: DataFrame, file_path: str | None = None, severity: str | None = None, category: str | None = None, tool: str | None = None) -> DataFrame:
    """FLT1: findings that fit every condition given."""
    out = findings
    if file_path:
        out = out.where(F.replace("evidence.file_path", F.lit("\\"), F.lit("/")) == file_path.replace("\\", "/"))
    if severity:
        out = out.where(F.col("severity") == severity)
    if category:
        out = out.where(F.lower("category") == category.lower())
    return out.where(F.lower("tool") == tool.lower()) if tool else out


def overlapping(df: DataFrame, start: int, end: int, first: str, last: str) -> DataFrame:
    """FLT4: rows whose lines meet start..end; rows without lines are left out."""
    return df.where((F.col(first) <= end) & (F.coalesce(last, first) >= start))


def summary(findings: DataFrame, key: str, domain: list[str] | None = None) -> DataFrame:
    """AGG1: findings by a key; with a domain, its values without findings count 0."""
    n = findings.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    if domain is None:
        return n
    all_ = findings.sparkSession.createDataFrame([(d,) for d in domain], "key string")
    return F.broadcast(all_).join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def by_severity(findings: DataFrame) -> DataFrame:
    return summary(findings, "severity", SEVERITIES)


def verify(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """PIP5, WIN2: candidates with verdict and reason, the first rule broken: no evidence, a repeat of an earlier one, no such file, lines out of bounds; an end past the file is cut."""
    # titles may be long: 128 bits of hash stand for them
    sig = [F.xxhash64(X.title_key(F.col("title"))), F.xxhash64(F.lit(7), X.title_key(F.col("title"))), F.col("file_path"), F.col("start_line")]
    lines = files.select(F.col("path").alias("file_path"), F.col("lines_count").alias("lines"))
    has = F.col("file_path").isNotNull() & (F.trim("file_path") != "")
    df = candidates.withColumn("__n", F.row_number().over(Window.partitionBy(*sig, has).orderBy("seq"))).join(lines, "file_path", "left")
    reason = (
        F.when(~has, "No evidence").when(F.col("__n") > 1, "Duplicate").when(F.col("lines").isNull(), "File does not exist")
        .when((F.col("start_line") < 1) | (F.col("start_line") > F.col("lines")), "Line out of bounds")
    )
    return df.select(*candidates.columns, F.least("end_line", "lines").alias("clamped_end"), F.when(reason.isNotNull(), "REJECTED").otherwise("PENDING").alias("verdict"), reason.alias("reason"))


def merge_verdicts(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """PIP6, JN28: model verdicts (seq, verdict, severity, reason) by seq, in any case; what is neither CONFIRMED nor POSSIBLE is REJECTED.

    A severity that is one of the five replaces the candidate's, but not of a rejected one. A candidate without a verdict is POSSIBLE.
    """
    reason = F.col("reason") if "reason" in verdicts.columns else F.lit(None).cast("string")
    v = verdicts.where("verdict is not null").select("seq", F.upper("verdict").alias("__v"), F.col("severity").alias("__s"), F.coalesce(reason, F.lit("No verification explanation provided.")).alias("__r"), F.lit(True).alias("__m"))
    told = F.when(F.col("__v").isin("CONFIRMED", "POSSIBLE"), F.col("__v")).otherwise("REJECTED")
    verdict = F.when(F.col("__m"), told).otherwise("POSSIBLE")
    severity = F.when(F.col("__s").isin(SEVERITIES) & F.col("__v").isin("CONFIRMED", "POSSIBLE"), F.col("__s")).otherwise(F.col("severity"))
    why = F.when(F.col("__m"), F.col("__r")).otherwise("Grounded in source code; passed deterministic checks.")
    return candidates.join(v, "seq", "left").withColumns({"verdict": verdict, "severity": severity, "verification_reason": why}).drop("__v", "__s", "__r", "__m")
