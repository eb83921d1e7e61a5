"""Twelve-check verification out of tables of repositories, patches and scanner runs, by delta maintenance (PIP7, GRF1, GRF4, JN23).

No patched repository is ever built. Of each patch the patched files alone are parsed, against the symbols that their paths had before. Nodes are
kept by counting: an id stays as long as some file still writes it. Of the contracts only those requests are matched anew that stand in a
changed file or whose path a changed route's path could serve, against only those routes that could serve them. Everything is
keyed by repository and patch, so one plan takes all patches of all repositories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators import applying, graph, patching
from codequarry.sources import parsers
from codequarry.tables import kept

PATCH = ["repo", "patch_id"]
_MARK = "\x1f"


def symbols_of(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the symbols of files (keys, file_seq, path, language, content), whatever repositories they are of."""
    own = files.select("file_seq", "language", "content", F.concat_ws(_MARK, *[F.col(k) for k in keys], F.col("path")).alias("path"))
    parts = F.split("path", _MARK)
    out = parsers.symbols(own)
    return out.select(*[parts[i].alias(k) for i, k in enumerate(keys)], *[parts[len(keys)].alias("path") if c == "path" else F.col(c) for c in out.columns])


def requests_of(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """keys, request_id, file, method, path: the client calls of symbols, one for each node."""
    url = F.coalesce("details.url", F.lit("/"))
    method = F.upper(F.coalesce("details.http_method", F.lit("GET")))
    return symbols.where(F.col("kind").isin(graph.HTTP_KINDS)).select(*keys, graph.request_id().alias("request_id"), F.col("path").alias("file"), method.alias("method"), url.alias("path")).distinct()


def routes_of(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """keys, route_id, file, route_seq (file and place), method, path: the routes of symbols, every file's."""
    method, path = F.upper(F.coalesce("details.http_method", F.lit("GET"))), F.coalesce("details.path", F.lit("/"))
    return symbols.where(F.col("kind").isin(graph.ROUTE_KINDS)).select(*keys, graph.route_id().alias("route_id"), F.col("path").alias("file"), F.struct(F.col("path").alias("file"), "sym_seq").alias("route_seq"), method.alias("method"), path.alias("path"))


def _nodes(routes: DataFrame, keys: list[str]) -> DataFrame:
    """One route for each id, where it stands first."""
    return routes.groupBy(*keys, "route_id").agg(F.min(F.struct("route_seq", "method", "path")).alias("x")).select(*keys, "route_id", "x.*")


def matched(requests: DataFrame, routes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, request_id, file, method, url, status of every request."""
    found = graph.contract_counts(requests, _nodes(routes, keys), keys).select(*keys, "request_id", "status")
    return requests.withColumnRenamed("path", "url").join(found, [*keys, "request_id"])


def _defects(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file, method, url, status: what identifies a mismatch, of all requests that aren't matched."""
    file = F.regexp_replace(F.replace("file", F.lit("\\"), F.lit("/")), "^/+", "")
    return rows.where("status <> 'MATCHED'").select(*keys, file.alias("file"), "method", F.trim("url").alias("url"), "status").distinct()


def contract_changes(base: DataFrame, requests: DataFrame, routes: DataFrame, touched: DataFrame, new_requests: DataFrame, new_routes: DataFrame) -> DataFrame:
    """JN23 for many patches: repo, patch_id, file, method, url, status, change (new, resolved) of the mismatches that each patch makes or mends.

    base: matched() of the repositories as they are; requests and routes: theirs (keyed by repo). touched: repo, patch_id, path: the files that a patch
    changes, makes or deletes; new_requests and new_routes: what stands in them afterwards (keyed by repo and patch_id).
    """
    file = F.col("path").alias("file")
    changed = touched.select(*PATCH, file).distinct()
    canon = lambda df, *c: df.select(*c, X.route_path(F.col("path")).alias("p"))
    moved = kept(canon(changed.join(routes, ["repo", "file"]), *PATCH).unionByName(canon(new_routes, *PATCH)).distinct(), "routes-moved")
    # requests that a changed route could serve, outside the changed files
    where = requests.select("repo", "request_id", F.col("file"), "method", "path", X.route_path(F.col("path")).alias("lp"))
    near = graph.related_paths(where.select("repo", F.col("lp").alias("p")), moved, ["repo"])
    served = moved.withColumnRenamed("p", "rp").join(near, ["repo", "rp"]).select(*PATCH, "lp").distinct()
    outside = served.join(where, ["repo", "lp"]).join(changed, [*PATCH, "file"], "left_anti").select(*PATCH, "request_id", "file", "method", "path").distinct()
    again = kept(outside.unionByName(new_requests.select(*PATCH, "request_id", "file", "method", "path")), "requests-again")
    # routes that could serve those, the changed files' as they are afterwards
    wanted = canon(again, *PATCH).distinct()
    every = graph.related_paths(wanted.select("repo", "p").distinct(), canon(routes, "repo"), ["repo"])
    could = kept(wanted.withColumnRenamed("p", "lp").join(every, ["repo", "lp"]).select(*PATCH, "rp").distinct(), "paths-again")
    still = could.join(routes.withColumn("rp", X.route_path(F.col("path"))), ["repo", "rp"]).join(changed, [*PATCH, "file"], "left_anti")
    cols = [*PATCH, "route_id", "file", "route_seq", "method", "path"]
    # written down, as each is read more than once: plans that repeat them grow with every step
    still = kept(still.select(cols).unionByName(new_routes.select(cols)), "routes-again")
    after = kept(_defects(matched(again, still, PATCH), PATCH), "defects-after")
    own = changed.join(base, ["repo", "file"]).unionByName(outside.select(*PATCH, "request_id").join(base, ["repo", "request_id"]), allowMissingColumns=True)
    before = kept(_defects(own, PATCH), "defects-before")
    return patching.new_identities(before, after, [*PATCH, "file", "method", "url", "status"])


def node_counts(files: DataFrame, symbols: DataFrame, frameworks: DataFrame, touched: DataFrame, new_files: DataFrame, new_symbols: DataFrame) -> DataFrame:
    """repo, patch_id, graph_nodes: nodes of the patched graph, by counting which ids a patch's files no longer write and which they write anew.

    Frameworks count as before the patch.
    """
    base = graph.node_rows(files, symbols, frameworks, ["repo"]).select("repo", "path", "id")
    refs = kept(base.groupBy("repo", "id").agg(F.count("*").alias("refs")), "node-refs")
    totals = refs.groupBy("repo").agg(F.count("*").alias("total"))
    gone = base.join(touched.select(*PATCH, "path").distinct(), ["repo", "path"]).groupBy(*PATCH, "id").agg((-F.count("*")).alias("d"))
    none = frameworks.limit(0).withColumn("patch_id", F.lit(None).cast("string"))
    come = graph.node_rows(new_files, new_symbols, none, PATCH).groupBy(*PATCH, "id").agg(F.count("*").alias("d"))
    change = gone.unionByName(come).groupBy(*PATCH, "id").agg(F.sum("d").alias("d")).join(refs, ["repo", "id"], "left")
    had, has = F.coalesce("refs", F.lit(0)) > 0, F.coalesce("refs", F.lit(0)) + F.col("d") > 0
    step = change.groupBy(*PATCH).agg(F.sum(has.cast("int") - had.cast("int")).alias("step"))
    return touched.select(*PATCH).distinct().join(step, PATCH, "left").join(totals, "repo", "left").select(*PATCH, (F.coalesce("total", F.lit(0)) + F.coalesce("step", F.lit(0))).alias("graph_nodes"))


def _open_brackets(code: Column) -> Column:
    """Whether the brackets of a JavaScript or TypeScript text don't close, strings and comments left out: a stand-in for a grammar."""
    bare = F.regexp_replace(code, r"""(?s)"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|/\*.*?\*/|//[^\n]*""", "")
    marks = F.regexp_replace(bare, r"[^(){}\[\]]", "")
    # pairs vanish from the inside; what is nested more than a hundred deep is taken for sound
    flat = F.aggregate(F.sequence(F.lit(0), F.least(F.length(marks), F.lit(100))), marks, lambda x, _: F.regexp_replace(x, r"\(\)|\[\]|\{\}", ""))
    return flat.rlike(r"^[)\]}]|[(\[{]$|\([\]}]|\[[)}]|\{[)\]]")


def syntax_errors(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path of the source files that don't parse: Python by its grammar, JavaScript and TypeScript by their brackets."""
    python = parsers.unparsed(files.where("language = 'python'").select("content", F.concat_ws(_MARK, *[F.col(k) for k in keys], F.col("path")).alias("path")))
    parts = F.split("path", _MARK)
    a = python.select(*[parts[i].alias(k) for i, k in enumerate(keys)], parts[len(keys)].alias("path"))
    b = files.where(F.col("language").isin("javascript", "typescript", "tsx")).where(_open_brackets(F.coalesce("content", F.lit("")))).select(*keys, "path")
    return a.unionByName(b)


def verify(patches: DataFrame, files: DataFrame, frameworks: DataFrame, tools: DataFrame, findings_after: DataFrame, findings_before: DataFrame, tools_before: DataFrame, enabled: int) -> DataFrame:
    """PIP7: repo, patch_id, check_name, status of the twelve checks, from tables alone.

    patches: repo, patch_id, unified_diff, plan_files (array), title, category, source_tool, detector_kind, rule_id, detector_id, target_file, code_snippet: the patch and
    the finding that it mends. files: repo, file_seq, path, language, content. frameworks: repo, name, version. tools: repo, patch_id, tool, status (scanner runs over the
    patched repository); tools_before: repo, tool, status. findings_after: repo, patch_id, and findings_before: repo, with tool, rule_id, detector_id, file_path,
    severity. Patch ids are unique in a repository.
    """
    files = files.select("repo", "file_seq", "path", "language", "content")
    done = kept(applying.apply_patches(patches, files), "patched")
    named = patches.select(*PATCH, F.explode(X.diff_files(F.coalesce("unified_diff", F.lit("")))).alias("path"))
    errors = done.where("error is not null").groupBy(*PATCH).agg(F.min("error").alias("apply_error"))
    applied = done.where("error is null and path is not null")
    texts = applied.where("not deleted").select(*PATCH, "path", "content").join(files.select("repo", "path", "file_seq"), ["repo", "path"], "left")
    new_files = kept(texts.select(*PATCH, F.coalesce("file_seq", F.lit(0)).alias("file_seq"), "path", X.language(F.col("path")).alias("language"), "content"), "new-files")
    base_symbols = kept(symbols_of(files, ["repo"]), "base-symbols")
    new_symbols = kept(symbols_of(new_files, PATCH), "new-symbols")

    requests, routes = kept(requests_of(base_symbols, ["repo"]), "requests"), kept(routes_of(base_symbols, ["repo"]), "routes")
    new_requests, new_routes = kept(requests_of(new_symbols, PATCH), "new-requests"), kept(routes_of(new_symbols, PATCH), "new-routes")
    base = kept(matched(requests, routes, ["repo"]), "contracts")
    changes = kept(contract_changes(base, requests, routes, applied, new_requests, new_routes), "contract-changes")
    target = F.regexp_replace(F.replace(F.coalesce("target_file", F.lit("")), F.lit("\\"), F.lit("/")), "^/+", "")
    wanted = patches.select(*PATCH, target.alias("file"))
    sums = changes.groupBy(*PATCH).agg(F.count_if(F.col("change") == "new").alias("new_mismatches"))
    in_repo = _defects(base, ["repo"])
    count = lambda df, *on: df.groupBy(*on).agg(F.count("*").alias("n"))
    before = wanted.where("file <> ''").join(count(in_repo, "repo", "file"), ["repo", "file"]).select(*PATCH, "n").unionByName(wanted.where("file = ''").join(count(in_repo, "repo"), "repo").select(*PATCH, "n")).withColumnRenamed("n", "target_before")
    mended = changes.where("change = 'resolved'").join(wanted.withColumnRenamed("file", "want"), PATCH).where("want = '' or want = file").groupBy(*PATCH).agg(F.count("*").alias("mended"))

    # what the diff names, as it is now: patched, or as it was where the patch didn't apply
    now = named.join(errors, PATCH, "left_semi").join(files.select("repo", "path", "content"), ["repo", "path"]).select(*PATCH, "path", X.language(F.col("path")).alias("language"), "content")
    broken = syntax_errors(now.unionByName(new_files.select(*PATCH, "path", "language", "content")), PATCH)
    there = now.select(*PATCH, "path").unionByName(new_files.select(*PATCH, "path"))
    syntax = broken.unionByName(named.join(there, [*PATCH, "path"], "left_anti")).groupBy(*PATCH).agg(F.array_sort(F.collect_set("path")).alias("syntax_errors"))
    added = F.array_join(F.transform(F.filter(F.split(F.coalesce("unified_diff", F.lit("")), "\n"), lambda x: x.startswith("+") & ~x.startswith("+++")), lambda x: F.substring(x, 2, 1 << 30)), "\n")
    shown = patches.select(*PATCH, X.patch_secrets(added).alias("s")).unionByName(new_files.select(*PATCH, X.patch_secrets(F.coalesce("content", F.lit(""))).alias("s")))
    secrets = shown.select(*PATCH, F.explode("s").alias("s")).groupBy(*PATCH).agg(F.array_sort(F.collect_set("s")).alias("secrets"))
    core = F.regexp_replace(F.coalesce("code_snippet", F.lit("")), r"^\s+|\s+$", "")
    snippet = patches.where(F.length("code_snippet") > 0).select(*PATCH, target.alias("path"), core.alias("core")).join(applied.select(*PATCH, "path", "content"), [*PATCH, "path"]).select(*PATCH, ((F.length("core") > 10) & F.contains("content", "core")).alias("snippet_left"))

    clean = lambda df: df.withColumn("file_path", F.regexp_replace(F.replace("file_path", F.lit("\\"), F.lit("/")), "^/+", ""))
    tool = F.lower(F.coalesce("source_tool", F.lit("")))
    detector = F.coalesce("detector_id", "rule_id")
    after = clean(findings_after)
    flagged = patches.select(*PATCH, tool.alias("by"), detector.alias("any"), target.alias("file_path")).join(
        after.select(*PATCH, F.lower("tool").alias("by"), "file_path", F.explode(F.array_compact(F.array("rule_id", "detector_id"))).alias("any")), [*PATCH, "by", "any", "file_path"], "left_semi").select(*PATCH, F.lit(True).alias("still_flagged"))
    both = tools.where("status = 'COMPLETED'").select(*PATCH, "tool").distinct().join(tools_before.where("status = 'COMPLETED'").select("repo", "tool").distinct(), ["repo", "tool"])
    known = clean(findings_before).select("repo", "tool", F.coalesce("rule_id", F.lit("")).alias("rule"), "file_path", "severity")
    high = after.where(F.col("severity").isin("HIGH", "CRITICAL")).withColumn("rule", F.coalesce("rule_id", F.lit(""))).join(both, [*PATCH, "tool"], "left_semi").join(known, ["repo", "tool", "rule", "file_path", "severity"], "left_anti").groupBy(*PATCH).agg(F.count("*").alias("new_high"))

    # of a repository's files a patch is shown those that its diff names, and one more: it says that files are known
    some = files.groupBy("repo").agg(F.min("path").alias("one"))
    met = named.join(files.select("repo", X.stripped_path(F.col("path")).alias("path")).distinct(), ["repo", "path"], "left_semi").groupBy(*PATCH).agg(F.collect_set("path").alias("met"))
    known = F.array_compact(F.concat(F.coalesce("met", F.array().cast("array<string>")), F.array("one"))).alias("known_files")
    checked = patches.join(some, "repo", "left").join(met, PATCH, "left").select(F.struct(*PATCH).alias("patch_id"), "unified_diff", F.lit(None).cast("array<string>").alias("files_modified"), known, "plan_files")
    errs = patching.validate_patch(checked).select("patch_id.*", "errors")
    nodes = node_counts(files, base_symbols, frameworks, applied, new_files, new_symbols)
    plain = graph.nodes_of(files, base_symbols, frameworks, ["repo"]).groupBy("repo").agg(F.count("*").alias("plain_nodes"))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    route_finding = (tool == "route_contract") | (low("detector_kind") == "contract_matcher") | low("category").isin("route_mismatch", "contract", "api_contract") | low("title").rlike("route mismatch|api contract|route contract")
    rows = patches.withColumn("route_finding", route_finding)
    for part in (errs, errors, sums, before, mended, syntax, secrets, snippet, flagged, high, nodes):
        rows = rows.join(part, PATCH, "left")
    rows = rows.join(plain, "repo", "left")
    nothing = F.array().cast("array<string>")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    key = F.struct(*PATCH).alias("patch_id")
    rows = rows.select(
        key, "errors", "unified_diff", "plan_files", "apply_error", F.coalesce("syntax_errors", nothing).alias("syntax_errors"), zero("new_mismatches").alias("new_mismatches"), zero("target_before").alias("target_before"), (zero("target_before") - zero("mended")).alias("target_after"),
        "route_finding", F.coalesce("graph_nodes", "plain_nodes", F.lit(0)).alias("graph_nodes"), F.coalesce("secrets", nothing).alias("secrets"), "source_tool", "detector_kind", "category", "title", F.coalesce("still_flagged", F.lit(False)).alias("still_flagged"), "snippet_left", zero("new_high").alias("new_high"))
    rows = kept(rows, "verified")
    runs = tools.select(key, F.lower("tool").alias("tool"), "status")
    return patching.twelve_checks(rows, runs, enabled).select("patch_id.*", "check_name", "status")
