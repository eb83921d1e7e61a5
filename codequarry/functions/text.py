"""Column -> Column functions over strings, paths, URLs and hashes (STR*, HSH*, MTH*, DAT*, ARR* of the survey).

All are built-in expressions but char_histogram, which runs as an Arrow function; those with transform, aggregate or filter over
arrays are evaluated outside generated code. A null argument gives the value named in each docstring.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix -> language (fixed values).
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".sql": "sql", ".html": "html", ".css": "css", ".scss": "scss", ".sh": "shell", ".bash": "shell",
    ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".cpp": "cpp", ".h": "c_header",
}

# Spelling -> severity (fixed values); everything else is INFO.
SEVERITY_SPELLINGS = {"CRITICAL": "CRITICAL", "FATAL": "CRITICAL", "HIGH": "HIGH", "ERROR": "HIGH", "MEDIUM": "MEDIUM", "MODERATE": "MEDIUM", "WARNING": "MEDIUM", "WARN": "MEDIUM", "LOW": "LOW", "NOTE": "LOW"}

# Secret and host-path patterns with their replacements, applied in this order (fixed values).
REDACTIONS = [
    (r"(?i)\b(bearer\s+)[a-zA-Z0-9_\-\.]{10,}\b", "$1[REDACTED]"),
    (r"\b(sk-[a-zA-Z0-9_\-]{16,})\b", "sk-[REDACTED]"),
    (r"\b(gsk_[a-zA-Z0-9_\-]{16,})\b", "gsk_[REDACTED]"),
    (r"\b(hf_[a-zA-Z0-9_\-]{16,})\b", "hf_[REDACTED]"),
    (r"\b(nvapi-[a-zA-Z0-9_\-]{16,})\b", "nvapi-[REDACTED]"),
    (r"\b(AIza[0-9A-Za-z\-_]{20,})\b", "AIza[REDACTED]"),
    (r"\b(ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{22,})\b", "[REDACTED_GITHUB_TOKEN]"),
    (r"\b(eyJ[a-zA-Z0-9_\-]{10,}\.eyJ[a-zA-Z0-9_\-]{10,}\.[a-zA-Z0-9_\-]{10,})\b", "[REDACTED_JWT]"),
    (r"(?i)\b(api[_-]?key|secret|password|auth[_-]?token)\s*[:=]\s*['\"][^\s'\"]{6,}['\"]", "$1='[REDACTED]'"),
    (r"[a-zA-Z]:\\[Uu]sers\\[^\s\\/:]+", "[HOST_USER_DIR]"),
    (r"/home/[^\s/:]+", "/home/[HOST_USER]"),
]

# Texts without any of these, in lower case, hold nothing that a pattern of REDACTIONS finds: each pattern needs one of them.
REDACTION_HINTS = ["bearer", "sk-", "gsk_", "hf_", "nvapi-", "aiza", "ghp_", "github_pat_", "eyj", "'", '"', ":\\users\\", "/home/"]

# Patterns whose presence in a patch fails it (fixed values).
PATCH_SECRETS = [
    (r"(?i)(api[_-]?key|secret[_-]?key|access[_-]?token)\s*=\s*['\"][A-Za-z0-9_\-]{16,}['\"]", "Hardcoded API/Secret Key"),
    (r"AKIA[0-9A-Z]{16}", "AWS Access Key ID"),
    (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "Private Key Header"),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", "JSON Web Token"),
    (r"ghp_[A-Za-z0-9]{36}", "GitHub Personal Access Token"),
]

# Domains by source tier (fixed values).
OFFICIAL_DOCS = [
    "fastapi.tiangolo.com", "docs.python.org", "react.dev", "reactjs.org", "expressjs.com", "docs.pydantic.dev", "pydantic-docs.helpmanual.io", "nextjs.org", "docs.sqlalchemy.org", "typescriptlang.org",
    "nodejs.org", "flask.palletsprojects.com", "docs.djangoproject.com", "networkx.org", "vitest.dev", "jestjs.io", "pkg.go.dev", "golang.org", "docs.rs", "rust-lang.org",
]
ADVISORIES = ["osv.dev", "nvd.nist.gov", "cve.mitre.org", "cve.org", "security.snyk.io", "vulncheck.com"]
VENDOR_DOCS = ["developer.mozilla.org", "cloud.google.com", "aws.amazon.com", "learn.microsoft.com", "v8.dev", "web.dev"]


def _chain(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def route_path(c: Column) -> Column:
    """STR1: a route or request path in canonical form; null and blank give /.

    Parameters are ${...}, :name, {name} and [name], [...name] with an identifier as name; [1] or ${} stay.
    """
    x = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    # of a whole URL the path alone counts, without ;parameters of its last segment
    path = _chain(x, [(r"^https?://[^/?#]*", ""), (r"(?s)[?#].*$", ""), (r"(?s);[^/]*$", "")])
    x = F.when(x.rlike(r"^https?://"), path).otherwise(F.regexp_replace(x, r"(?s)[?#].*$", ""))
    name = "[a-zA-Z_][a-zA-Z0-9_]*"
    x = _chain(x, [(r"\$\{[^}]+\}", "{param}"), (f":{name}", "{param}"), (rf"\{{{name}\}}", "{param}"), (rf"\[(?:\.\.\.)?{name}\]", "{param}"), (r"/+", "/")])
    x = F.when(x.startswith("/"), x).otherwise(F.concat(F.lit("/"), x))
    x = F.when(F.length(x) > 1, F.regexp_replace(x, r"/$", "")).otherwise(x)
    return F.lower(x)


def path_suffixes(c: Column) -> Column:
    """Every suffix of a /-rooted path that starts at a segment, longest first: the keys of an equi-join for endswith."""
    parts = F.split(F.substring(c, 2, 1 << 20), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.size(parts)), "/")))


def query_tokens(c: Column) -> Column:
    """STR2: lower-cased word tokens of two characters or more, repeats kept; null gives none."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def count_of(c: Column, token: Column) -> Column:
    """STR3: non-overlapping occurrences of a token."""
    return ((F.length(c) - F.length(F.replace(c, token, F.lit("")))) / F.length(token)).cast("int")


def exact_score(symbol: Column, path: Column, query: str) -> Column:
    """STR4: 1.0 for the symbol, 0.8 inside it, 0.6 inside the path; null otherwise."""
    q = query.strip().lower()
    s, p = F.lower(F.coalesce(symbol, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return F.when(s == q, F.lit(1.0)).when(s.contains(q), F.lit(0.8)).when(p.contains(q), F.lit(0.6))


def title_key(c: Column) -> Column:
    """STR5: letters and digits of the lower-cased title."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def redact(c: Column) -> Column:
    """STR6: text without secrets and host paths; null gives an empty text."""
    low = F.lower(c)
    hinted = reduce(lambda a, b: a | b, [low.contains(h) for h in REDACTION_HINTS])
    return F.when(hinted, _chain(c, REDACTIONS)).otherwise(F.coalesce(c, F.lit("")))


def patch_secrets(c: Column) -> Column:
    """FLT19: names of the secret patterns that a text shows."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(n)) for p, n in PATCH_SECRETS]))


def language(path: Column) -> Column:
    """STR7: language by suffix; null for none or an unknown one. A name that only starts with a dot has none."""
    suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix]


def requirement(line: Column) -> tuple[Column, Column]:
    """STR8: package (lower-cased) and version text of a requirements line; null where it is blank or a comment."""
    x = F.trim(line)
    pattern = r"^([a-zA-Z0-9_\-\.]+)(?:[>=<~!\s]+(.*))?$"
    ok = x.rlike(pattern) & ~x.startswith("#")
    version = F.trim(F.regexp_extract(x, pattern, 2))
    return F.when(ok, F.lower(F.regexp_extract(x, pattern, 1))), F.when(ok & (version != ""), version)


def severity(c: Column) -> Column:
    """STR9: canonical severity; null and unknown spellings are INFO."""
    known = F.create_map(*[F.lit(x) for kv in SEVERITY_SPELLINGS.items() for x in kv])
    return F.coalesce(known[F.upper(F.trim(c))], F.lit("INFO"))


def bounded(c: Column, most: int = 2000, mark: str = "... [truncated]") -> Column:
    """At most `most` characters, a mark after a cut text."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def stderr_text(c: Column) -> Column:
    """STR10: a tool's error output without outer white space, cut at 2000 characters with a mark; null for none."""
    x = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(x != "", bounded(x, 2000, "\n... [truncated]"))


def rule_title(c: Column) -> Column:
    """STR11: last dotted part of a rule id, - as blank, every run of letters capitalised; an id without a dot stays as it is."""
    last = F.replace(F.element_at(F.split(c, r"\."), -1), F.lit("-"), F.lit(" "))
    runs = F.regexp_extract_all(last, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    titled = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))), "")
    return F.when(c.contains("."), titled).otherwise(c)


def escape_markdown(c: Column) -> Column:
    """STR12: & < > as references; null gives an empty text."""
    return _chain(F.coalesce(c, F.lit("")), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def escape_cell(c: Column) -> Column:
    """STR12: as escape_markdown, fit for a table cell."""
    return _chain(escape_markdown(c), [(r"\|", r"\\|"), (r"\r\n|\r|\n", " ")])


def fence(c: Column) -> Column:
    """STR13: a code fence longer than any run of backticks inside, three at least."""
    runs = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(`+)"), 1), lambda x: F.length(x))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_file(path: Column) -> Column:
    """FLT8: whether a path is a test's by convention."""
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return p.rlike(r"^(tests|test|__tests__)/") | p.rlike(r"/(tests|test|__tests__)/") | base_name(p).rlike(r"^test_|_test\.py$|\.(test|spec)\.(js|ts|tsx)$") & ~base_name(p).rlike(r"^$")


def tested_name(path: Column) -> Column:
    """STR14: file name that a test's name points at; null where it follows no convention."""
    b = base_name(F.replace(path, F.lit("\\"), F.lit("/")))
    return (
        F.when(b.startswith("test_"), F.substring(b, 6, 1 << 20))
        .when(b.endswith("_test.py"), F.concat(F.substring(b, F.lit(1), F.length(b) - 8), F.lit(".py")))
        .when(b.contains(".test."), F.replace(b, F.lit(".test."), F.lit(".")))
        .when(b.contains(".spec."), F.replace(b, F.lit(".spec."), F.lit(".")))
    )


def branch_name(finding_id: Column, patch_id: Column, prefix: str = "codequarry") -> Column:
    """STR15: prefix/fix-<8>-<8> of the two ids without dashes, in lower case."""
    short = lambda c: F.lower(F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 8))
    return F.concat(F.lit(f"{prefix}/fix-"), short(finding_id), F.lit("-"), short(patch_id))


def stripped_path(path: Column) -> Column:
    """STR16: forward slashes, without leading dots and slashes."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def source_tier(url: Column) -> Column:
    """STR17: 1 official documentation .. 5 community; null and malformed URLs are 5."""
    u = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.lower(F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    under = lambda names: reduce(lambda a, b: a | b, [(host == n) | host.endswith("." + n) for n in names])
    releases = (host == "github.com") & (path.contains("/releases") | path.contains("/changelog")) | (host == "pypi.org") & u.contains("#history") | (host == "npmjs.com") & path.contains("/v/")
    return F.when(under(OFFICIAL_DOCS), 1).when(releases, 2).when((host == "github.com") & path.contains("/advisories") | under(ADVISORIES), 3).when(under(VENDOR_DOCS), 4).otherwise(5)


def defused(c: Column) -> Column:
    """STR18: web text without phrases that try to instruct a reader, in a fence that says what it is; null and empty stay empty."""
    clean = F.regexp_replace(c, r"(?i)(ignore previous instructions|system prompt|disregard all)", "[filtered]")
    inner = F.regexp_replace(clean, r"^\s+|\s+$", "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("<untrusted_external_evidence>\n"), inner, F.lit("\n</untrusted_external_evidence>")))


def is_unified_diff(c: Column) -> Column:
    """STR19: headers, a hunk and a changed line are all there; null is none."""
    x = F.coalesce(c, F.lit(""))
    return x.rlike(r"(?m)^--- ") & x.rlike(r"(?m)^\+\+\+ ") & x.rlike(r"(?m)^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@") & x.rlike(r"(?m)^[+-](?!\+\+|--)")


def diff_files(c: Column) -> Column:
    """STR20: files of the +++ lines in order of first appearance, without b/; /dev/null stays as dev/null."""
    heads = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.startswith("+++ "))
    names = F.transform(heads, lambda x: F.regexp_replace(F.regexp_replace(F.trim(F.substring(x, 5, 1 << 20)), r"^b/", ""), r"^/+", ""))
    return F.array_distinct(F.filter(names, lambda x: x != ""))


def defect_removed(diff: Column, snippet: Column) -> Column:
    """STR21: whether a removed line shows the snippet."""
    core = F.trim(F.coalesce(snippet, F.lit("")))
    return (core != "") & F.exists(F.split(F.coalesce(diff, F.lit("")), "\n"), lambda x: x.startswith("-") & ~x.startswith("---") & x.contains(core))


def owner_repo(url: Column) -> tuple[Column, Column]:
    """STR23: owner and repository of a GitHub URL; empty where it is none."""
    p = r"github\.com[/:]([^/\s]+)/([^/\s]+?)(?:\.git)?/?$"
    return F.regexp_extract(url, p, 1), F.regexp_extract(url, p, 2)


def json_block(c: Column) -> Column:
    """STR24: content of the first fenced block, else the trimmed text."""
    inner = F.regexp_extract(c, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    return F.when(inner != "", inner).otherwise(F.trim(c))


def sha256(c: Column) -> Column:
    """HSH1"""
    return F.sha2(c, 256)


def idempotency_key(owner: Column, repo: Column, patch: Column, branch: Column, sha: Column) -> Column:
    """HSH2: key of a delivery; everything but the branch lower-cased."""
    return F.sha2(F.concat_ws(":", F.lit("github"), F.lower(owner), F.lower(repo), F.lower(patch), branch, F.lower(sha)), 256)


def cosine(a: Column, b: Column) -> Column:
    """MTH1: 0 for unequal lengths, empty vectors or zero norms; within [-1, 1]."""
    d = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(d(a, a)) * F.sqrt(d(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(d(a, b), norm)))).otherwise(F.lit(0.0))


def unit_score(similarity: Column) -> Column:
    """MTH2"""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1) / 2))


def idf(docs: Column, df: Column) -> Column:
    """MTH3"""
    return F.log((docs + 1.0) / (df + 1.0)) + 1.0


def saturation(tf: Column) -> Column:
    """MTH4"""
    return tf / (tf + 1.2)


def rrf(rank: Column, k: int = 60) -> Column:
    """MTH5"""
    return F.lit(1.0) / (F.lit(float(k)) + rank)


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """ARR2: lines start..end (from 1), clamped; an empty text where none are left."""
    lines = F.split(content, "\n", -1)
    a = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, a, F.greatest(F.least(end, F.size(lines)) - a + 1, F.lit(0))), "\n")


def line_count(content: Column) -> Column:
    """ARR3: newlines, and one more if the text doesn't end in one; 0 for an empty text."""
    n = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(F.length(content) == 0, F.lit(0)).otherwise(n + F.when(content.endswith("\n"), 0).otherwise(1)).cast("int")


def count_shape(json: Column) -> Column:
    """ARR1: an integer as it is, the length of a list; null for anything else."""
    return F.when(json.rlike(r"^\s*-?\d+\s*$"), json.cast("int")).when(json.rlike(r"^\s*\["), F.json_array_length(json))


def duration_ms(status: Column, start: Column, end: Column) -> Column:
    """DAT1: whole milliseconds of an ended scan, at least 0; null while it runs."""
    return F.when(status.isin("COMPLETED", "FAILED"), F.greatest(F.lit(0), F.unix_millis(end) - F.unix_millis(start)))


def event_frame(id_: Column, kind: Column, data: Column) -> Column:
    """SNK7: one server-sent event."""
    return F.format_string("id: %d\nevent: %s\ndata: %s\n\n", id_, kind, data)


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def char_histogram(texts: pa.Array) -> pa.Array:
    """PRJ20: unit vector of code points modulo 16 of the lower-cased text; zeros for an empty or null one."""

    def one(text: str | None) -> np.ndarray:
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4") % 16
        counts = np.bincount(codes, minlength=16).astype(float)
        return counts / (np.linalg.norm(counts) or 1.0)

    # a text at a time: a batch is never held as Python strings beside its Arrow buffers
    flat = np.empty((len(texts), 16))
    for i, x in enumerate(texts):
        flat[i] = one(x.as_py())
    return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * 16, flat.ravel())


def inline_code(c: Column) -> Column:
    """A redacted text as inline code; one with backticks stands in double ones; null and empty give ``."""
    x = escape_markdown(redact(c))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("``")).when(x.contains("`"), F.concat(F.lit("`` "), x, F.lit(" ``"))).otherwise(F.concat(F.lit("`"), x, F.lit("`")))


def code_block(c: Column, lang: str = "") -> Column:
    """A redacted text in a fence longer than any inside."""
    x = redact(c)
    mark = fence(x)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(f"```{lang}\n```")).otherwise(F.concat(mark, F.lit(f"{lang}\n"), x, F.lit("\n"), mark))


def table_cell(c: Column) -> Column:
    """A redacted text as a table cell; - for none."""
    x = F.trim(escape_cell(redact(c)))
    return F.when(x == "", F.lit("-")).otherwise(x)


def github_url(c: Column) -> Column:
    """FLT9: https://github.com/owner/repo.git of a public repository's URL; null for anything else."""
    x = F.trim(c)
    pattern = r"^https://github\.com/([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+?)(?:\.git)?/?$"
    owner, repo = F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)
    ok = x.rlike(pattern) & ~x.rlike(r"[\s;&|`$<>\\*?]") & ~owner.isin(".", "..") & ~repo.isin(".", "..")
    return F.when(ok, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit(".git")))


def uuid5_dns(c: Column) -> Column:
    """PRJ17: a UUID as it is, lower-cased; of any other text, version 5 of it in the DNS namespace; null for null."""
    plain = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
    dashed = lambda h: F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), c.cast("binary")))
    variant = F.element_at(F.split(F.lit("8,9,a,b"), ","), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    made = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    return F.when(c.rlike(plain), dashed(F.lower(F.replace(c, F.lit("-"), F.lit(""))))).when(c.isNotNull(), dashed(made))


def clock(c: Column) -> Column:
    """DAT2: HH:MM:SS of a timestamp in UTC."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "HH:mm:ss")


def retrieval_date(c: Column) -> Column:
    """DAT3: YYYY-MM-DD of a timestamp in UTC."""
    return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd")


def backoff(attempt: Column, retry_after: Column, jitter: Column, most: float = 2.0) -> Column:
    """MTH6: seconds before the next attempt (from 0): what the server asks, else 0.2 * 2 ** attempt, and a share `jitter` (0 to 1) of a quarter of it, of 0.25 at most; never above `most`."""
    base = F.least(F.when(retry_after > 0, retry_after).otherwise(F.lit(0.2) * F.pow(F.lit(2.0), attempt)), F.lit(most))
    return F.least(base + jitter * F.least(base * 0.25, F.lit(0.25)), F.lit(most))
