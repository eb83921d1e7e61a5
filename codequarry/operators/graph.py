"""Repository graph: nodes, edges, call and module resolution, route contracts (GRF1-7, JN1-13, JN18-19, WIN4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators.ordering import prefix_pairs
from codequarry.operators.retrieval import upsert

# Suffixes a relative JavaScript module may leave out, in order, and those that a path ending in any other may have (fixed values).
JS_SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".d.ts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
JS_TAILS = [".ts", ".tsx", ".js", "/index.ts", "/index.js"]
HTTP_KINDS = ["FETCH_CALL", "AXIOS_CALL"]
ROUTE_KINDS = ["FASTAPI_ROUTE", "EXPRESS_ROUTE"]


def related_paths(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lp, rp: canonical paths of left (keys, p) and right (keys, p) that are equal, or of which one is a suffix of the other, / left out.

    Suffixes are exploded on either side and meet in equi-joins.
    """
    a, b = left.select(*keys, F.col("p").alias("lp")).distinct(), right.select(*keys, F.col("p").alias("rp")).distinct()
    tails = lambda df, c: df.where(F.col(c) != "/").select(*keys, c, F.explode(X.path_suffixes(F.col(c))).alias("k"))
    same = a.join(b.withColumn("lp", F.col("rp")), [*keys, "lp"])
    longer = tails(a, "lp").join(b.where("rp <> '/'").withColumn("k", F.col("rp")), [*keys, "k"])
    shorter = tails(b, "rp").join(a.where("lp <> '/'").withColumn("k", F.col("lp")), [*keys, "k"])
    cut = lambda df: df.select(*keys, "lp", "rp")
    return cut(same).unionByName(cut(longer)).unionByName(cut(shorter)).distinct()


def _routed(requests: DataFrame, routes: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Requests (keys, request_id, p, m, rp: the route path that they meet, null for none) and routes (keys, rp, rm, route_seq, route_id).

    Paths are matched once each, whatever the number of requests and routes that share them: suffixes of either side meet in equi-joins.
    """
    req = requests.select(*keys, "request_id", X.route_path(F.col("path")).alias("p"), F.upper("method").alias("m")).distinct()
    rt = routes.select(*keys, "route_seq", "route_id", X.route_path(F.col("path")).alias("rp"), F.upper("method").alias("rm"))
    paths = rt.groupBy(*keys, F.col("rp").alias("p")).agg(F.min("route_seq").alias("first"))
    open_ = req.where("p <> '/'").select(*keys, "p").distinct().join(paths, [*keys, "p"], "left_anti")
    named = paths.where("p <> '/'")
    longer = open_.select(*keys, "p", F.explode(X.path_suffixes(F.col("p"))).alias("k")).join(named.withColumnRenamed("p", "k"), [*keys, "k"]).select(*keys, "p", "first", F.col("k").alias("rp"))
    ends = named.select(*keys, F.col("p").alias("rp"), "first", F.explode(X.path_suffixes(F.col("p"))).alias("p")).groupBy(*keys, "p").agg(F.min_by("rp", "first").alias("rp"), F.min("first").alias("first"))
    best = longer.unionByName(open_.join(ends, [*keys, "p"])).groupBy(*keys, "p").agg(F.min_by("rp", "first").alias("rp"))
    return req.join(paths.select(*keys, "p", F.col("p").alias("rp")).unionByName(best), [*keys, "p"], "left"), rt


def contract_counts(requests: DataFrame, routes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, request_id, path, method, status, n (routes of the path that the request meets), same (those of its method): contracts() without its lists.

    Routes are counted by path and method before requests meet them, so many of both on one path cost no more than their rows.
    """
    keys = keys or []
    req, rt = _routed(requests, routes, keys)
    every = rt.groupBy(*keys, "rp").agg(F.count("route_id").alias("n"))
    own = rt.groupBy(*keys, "rp", F.col("rm").alias("m")).agg(F.count("*").alias("same"))
    out = req.join(every, [*keys, "rp"], "left").join(own, [*keys, "rp", "m"], "left").na.fill(0, ["n", "same"])
    status = F.when(F.col("n") == 0, "UNMATCHED_FRONTEND_REQUEST").when(F.col("same") == 1, "MATCHED").when(F.col("same") > 1, "AMBIGUOUS_MATCH").otherwise("METHOD_MISMATCH")
    return out.select(*keys, "request_id", F.col("p").alias("path"), F.col("m").alias("method"), status.alias("status"), "n", "same")


def contracts(requests: DataFrame, routes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, request_id, path, method, status, route_ids, methods: JN1-3.

    requests: keys, request_id, path, method. routes: keys, route_seq, route_id, path, method. A request meets the routes of its
    canonical path; without any, those of the first route path (by route_seq) that is a suffix of its own or the other way
    round, / left out. Rows with null methods match none. keys (none: one repository a
    call) name the repository: nothing meets across them. Every request lists its routes: where many of both share a path the result is their product;
    contract_counts() is not.
    """
    keys = keys or []
    req, rt = _routed(requests, routes, keys)
    lists = rt.groupBy(*keys, "rp").agg(F.array_sort(F.collect_list(F.struct("route_seq", "route_id", "rm"))).alias("all"), F.array_sort(F.collect_set("rm")).alias("methods"))
    counts = contract_counts(requests, routes, keys).select(*keys, "request_id", F.col("path").alias("p"), F.col("method").alias("m"), "status", "same")
    on = [req[k].eqNullSafe(counts[k]) for k in (*keys, "request_id", "p", "m")]
    met = req.join(counts, on).select(*[req[c] for c in req.columns], "status", "same").join(lists, [*keys, "rp"], "left")
    ids = F.transform(F.filter("all", lambda x: F.when(F.col("same") > 0, F.coalesce(x["rm"] == F.col("m"), F.lit(False))).otherwise(x["route_id"].isNotNull())), lambda x: x["route_id"])
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    return met.select(*keys, "request_id", F.col("p").alias("path"), F.col("m").alias("method"), "status", none(ids, f"array<{dict(rt.dtypes)['route_id']}>").alias("route_ids"), none(F.col("methods"), "array<string>").alias("methods"))


def contract_totals(matched: DataFrame) -> DataFrame:
    """AGG3: one row of totals."""
    n = lambda s: F.count_if(F.col("status") == s)
    return matched.agg(F.count("*").alias("requests"), n("MATCHED").alias("matched"), n("METHOD_MISMATCH").alias("method_mismatches"), n("UNMATCHED_FRONTEND_REQUEST").alias("unmatched"), n("AMBIGUOUS_MATCH").alias("ambiguous"))


def trace(path: str, routes: DataFrame, calls: DataFrame) -> DataFrame:
    """JN19: routes and calls whose canonical path is that of `path`."""
    want = X.route_path(F.lit(path))
    side = lambda df, kind: df.where(X.route_path(F.col("path")) == want).select(F.lit(kind).alias("side"), "id", "path", "method")
    return side(routes, "route").unionByName(side(calls, "request"))


def nodes_of(files: DataFrame, symbols: DataFrame, frameworks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """GRF1: FILE, TEST, ROUTE with its handler, FRONTEND_REQUEST, SYMBOL and DEPENDENCY nodes; the last write of an id stays. A test is a FILE, too.

    keys (columns of all three) name the repository: equal ids of two are two nodes.
    """
    keys = keys or []
    every = node_rows(files, symbols, frameworks, keys).drop("path")
    return upsert(every, every.limit(0), [*keys, "id"])


def node_rows(files: DataFrame, symbols: DataFrame, frameworks: DataFrame, keys: list[str]) -> DataFrame:
    """Every write of a node, with the path of the file that it comes from (null: a framework)."""
    test = X.is_test_file(F.col("path"))
    seq = lambda step, *c: (F.lit(step) * F.lit(10**15) + F.coalesce(*c, F.lit(0))).cast("long")
    path = lambda df: F.col("path") if "path" in df.columns else F.lit(None).cast("string")
    row = lambda df, s, i, kind, label, start=None, end=None, meta=None: df.select(
        *keys, s.alias("write_seq"), i.alias("id"), kind.alias("kind"), label.alias("label"), path(df).alias("file_path"),
        (start if start is not None else F.lit(None)).cast("int").alias("start_line"), (end if end is not None else F.lit(None)).cast("int").alias("end_line"), (meta if meta is not None else F.lit(None)).cast("string").alias("metadata"), path(df).alias("path"))
    at = F.col("file_seq").cast("long") * 10**6 + F.coalesce(F.col("sym_seq"), F.lit(0))
    method, url = F.upper(F.coalesce("details.http_method", F.lit("GET"))), F.coalesce("details.url", F.lit("/"))
    routes, http, plain = symbols.where(F.col("kind").isin(ROUTE_KINDS)), symbols.where(F.col("kind").isin(HTTP_KINDS)), symbols.where(~F.col("kind").isin(ROUTE_KINDS + HTTP_KINDS))
    rpath = F.coalesce("details.path", F.lit("/"))
    rows = [
        row(files.where(test), seq(1, F.col("file_seq").cast("long")), F.concat(F.lit("test:"), "path"), F.lit("TEST"), X.base_name(F.col("path")), meta=F.to_json(F.struct("language"))),
        row(files, seq(1, F.col("file_seq").cast("long")), F.concat(F.lit("file:"), "path"), F.lit("FILE"), F.col("path"), meta=F.to_json(F.struct("language"))),
        row(routes, seq(2, at), handler_id(), F.lit("SYMBOL"), F.col("name"), F.col("start_line"), F.col("end_line"), F.to_json(F.struct(F.lit("FUNCTION").alias("kind"), F.lit(True).alias("route_handler")))),
        row(routes, seq(2, at), route_id(), F.lit("ROUTE"), F.concat_ws(" ", method, rpath), F.col("start_line"), F.col("end_line"), F.to_json(F.struct(method.alias("method"), rpath.alias("path")))),
        row(http, seq(2, at), request_id(), F.lit("FRONTEND_REQUEST"), F.concat_ws(" ", method, url), F.col("start_line"), F.col("end_line"), F.to_json(F.struct(method.alias("method"), url.alias("path")))),
        row(plain, seq(2, at), symbol_id(), F.lit("SYMBOL"), F.col("name"), F.col("start_line"), F.col("end_line"), F.to_json(F.struct("kind"))),
        row(frameworks, seq(3), F.concat(F.lit("dep:"), F.lower("name")), F.lit("DEPENDENCY"), F.col("name"), meta=F.to_json(F.struct("version"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), rows)


def _method() -> Column:
    return F.upper(F.coalesce("details.http_method", F.lit("GET")))


def route_id() -> Column:
    """Id of a route symbol's node: one for each method and path of a repository."""
    return F.concat(F.lit("route:"), _method(), F.lit(":"), F.coalesce("details.path", F.lit("/")))


def request_id() -> Column:
    """Id of a client call's node."""
    return F.concat(F.lit("req:"), "path", F.lit(":"), "start_line", F.lit(":"), _method(), F.lit(":"), F.coalesce("details.url", F.lit("/")))


def symbol_id() -> Column:
    return F.concat(F.lit("symbol:"), "path", F.lit(":"), "kind", F.lit(":"), "name", F.lit(":"), F.col("start_line").cast("string"))


def handler_id() -> Column:
    """Id of the function behind a route symbol."""
    return F.concat(F.lit("symbol:"), "path", F.lit(":FUNCTION:"), "name", F.lit(":"), F.col("start_line").cast("string"))


# Files that name a repository's dependencies (fixed values).
DEPENDENCY_FILES = ["package.json", "requirements.txt", "pyproject.toml", "Pipfile", "go.mod"]


def structure_edges(files: DataFrame, symbols: DataFrame, frameworks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """GRF2, JN10-12: keys and CONTAINS, TESTS, DEPENDS_ON, EXPOSES_ROUTE and IMPORTS edges, in the schema of edges; last_edges() drops those without both ends.

    frameworks has a row per known framework of a repository at most, and goes out to every manifest file. keys (columns of all three) name the repository.
    """
    keys = keys or []
    file, at = F.concat(F.lit("file:"), "path"), F.col("file_seq").cast("long") * 10**6 + F.coalesce(F.col("sym_seq"), F.lit(0))
    edge = lambda df, seq, source, target, kind, meta=None: df.select(*keys, seq.cast("long").alias("write_seq"), source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), (F.lit(None) if meta is None else meta).cast("string").alias("metadata"))
    own = F.col("file_seq").cast("long") * 10**6
    is_route, is_call = F.col("kind").isin(ROUTE_KINDS), F.col("kind").isin(HTTP_KINDS)
    manifests = files.where(reduce(lambda a, b: a | b, [F.col("path").endswith(n) for n in DEPENDENCY_FILES]))
    named = frameworks.select(*keys, F.concat(F.lit("dep:"), F.lower("name")).alias("dep"))
    needs = manifests.join(named, keys) if keys else manifests.crossJoin(F.broadcast(named))
    seqs = files.select(*keys, file.alias("source"), own.alias("seq"))
    tests = test_edges(files, keys).join(seqs.select(*keys, F.replace("source", F.lit("file:"), F.lit("test:")).alias("source"), "seq"), [*keys, "source"])
    imports = import_edges(symbols.where("kind = 'IMPORT'").select(*keys, "path", "name"), files, keys).join(seqs, [*keys, "source"])
    parts = [
        edge(files.where(X.is_test_file(F.col("path"))), own, file, F.concat(F.lit("test:"), "path"), "CONTAINS"),
        edge(tests, F.col("seq"), F.col("source"), F.col("target"), "TESTS", F.lit('{"inferred":true}')),
        edge(needs, own, file, F.col("dep"), "DEPENDS_ON", F.lit('{"framework":true}')),
        edge(symbols.where(is_route), at, file, route_id(), "CONTAINS"), edge(symbols.where(is_route), at, file, handler_id(), "CONTAINS"), edge(symbols.where(is_route), at, handler_id(), route_id(), "EXPOSES_ROUTE"),
        edge(symbols.where(is_call), at, file, request_id(), "CONTAINS"), edge(symbols.where(~is_route & ~is_call), at, file, symbol_id(), "CONTAINS"),
        edge(imports, F.col("seq"), F.col("source"), F.col("target"), "IMPORTS"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def callers(calls: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """JN7: keys, file_seq, call_seq, caller: the symbol that a call stands in, by its kind or else as a function; the file where neither is a node."""
    keys = keys or []
    ident = lambda kind: F.concat(F.lit("symbol:"), "path", F.lit(":"), kind, F.lit(":"), "caller_name", F.lit(":"), F.col("caller_start_line").cast("string"))
    c = calls.select(*keys, "file_seq", "call_seq", F.concat(F.lit("file:"), "path").alias("file"), ident(F.coalesce("caller_kind", F.lit("FUNCTION"))).alias("own"), ident(F.lit("FUNCTION")).alias("plain"))
    known = lambda name: nodes.select(*keys, F.col("id").alias(name)).withColumn(f"has_{name}", F.lit(True))
    c = c.join(known("own"), [*keys, "own"], "left").join(known("plain"), [*keys, "plain"], "left")
    return c.select(*keys, "file_seq", "call_seq", F.when(F.col("has_own"), F.col("own")).when(F.col("has_plain"), F.col("plain")).otherwise(F.col("file")).alias("caller"))


def call_edges(resolved: DataFrame, calls: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """GRF3: keys and CALLS edges of resolve_calls()'s rows with a target."""
    keys = keys or []
    met = resolved.where("target is not null").join(callers(calls, nodes, keys), [*keys, "file_seq", "call_seq"])
    seq = F.col("file_seq").cast("long") * 10**6 + F.col("call_seq")
    return met.select(*keys, seq.alias("write_seq"), F.col("caller").alias("source"), "target", F.lit("CALLS").alias("kind"), F.to_json(F.struct(F.col("path").alias("call_site_file"), F.col("line_number").alias("call_site_line"), F.col("callee").alias("callee_expression"), F.col("status").alias("resolution"))).alias("metadata"))


def node(nodes: DataFrame, ident: str) -> DataFrame:
    """GRF5: the node of an id."""
    return nodes.where(F.col("id") == ident)


def of_kind(df: DataFrame, kind: str) -> DataFrame:
    """GRF5: nodes or edges of a kind."""
    return df.where(F.col("kind") == kind)


def incoming(edges: DataFrame, ident: str) -> DataFrame:
    """GRF5"""
    return edges.where(F.col("target") == ident)


def outgoing(edges: DataFrame, ident: str) -> DataFrame:
    """GRF5"""
    return edges.where(F.col("source") == ident)


def domain_data(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF6-7: one row with totals, counts by kind and whether the graph is empty. Edges are those handed in: matches come later."""
    total = lambda df, name: counts(df).agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"total_{name}s"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias(f"{name}_counts_by_kind"))
    return total(nodes, "node").crossJoin(total(edges, "edge")).withColumn("is_empty", F.col("total_nodes") == 0)


def symbols_where(symbols: DataFrame, file_path: str | None = None, kind: str | None = None) -> DataFrame:
    """FLT2"""
    out = symbols if not file_path else symbols.where(F.col("path") == file_path.replace("\\", "/"))
    return out if not kind else out.where(F.col("kind") == kind)


def routes_of(symbols: DataFrame) -> DataFrame:
    """FLT3: backend routes."""
    return symbols.where(F.col("kind").isin(ROUTE_KINDS))


def http_calls_of(symbols: DataFrame) -> DataFrame:
    """FLT3: client calls."""
    return symbols.where(F.col("kind").isin(HTTP_KINDS))


def evidence_context(symbols: DataFrame, findings: DataFrame, file_path: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """PIP17: one row with the symbols and findings of a file region; of the whole file without bounds. findings: evidence with its lines."""
    path = file_path.replace("\\", "/")
    meets = lambda a, b: F.lit(True) if start is None and end is None else ~((F.col(b) < F.lit(start if start is not None else 1)) | (F.col(a) > F.lit(end if end is not None else 2**31 - 1)))
    inside = symbols.where((F.col("path") == path) & meets("start_line", "end_line")).select("start_line", "end_line", "name", "kind")
    lines = findings.where(F.col("evidence.file_path") == path).select(F.col("evidence.start_line").alias("start_line"), F.coalesce("evidence.end_line", "evidence.start_line").alias("end_line"), "title", "severity")
    hits = lines.where(F.col("start_line").isNull() | meets("start_line", "end_line"))
    pack = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    return pack(inside, "symbols").crossJoin(pack(hits, "findings"))  # one row each


def framework_version(wanted: DataFrame, frameworks: DataFrame) -> DataFrame:
    """JN29: framework, version of the first framework (by seq) whose name equals or contains the wanted one, or lies in it; in any case.

    wanted: framework. frameworks: seq, name, version; known names only, so it is small and goes out to every row.
    """
    f = F.broadcast(frameworks.select("seq", F.lower("name").alias("known"), "version"))
    w = wanted.select("framework").distinct()
    low = F.lower("framework")
    hit = w.join(f, (F.col("known") == low) | F.col("known").contains(low) | low.contains(F.col("known")))
    first = hit.groupBy("framework").agg(F.min_by("version", "seq").alias("version"))
    return w.join(first, "framework", "left")


def last_edges(edges: DataFrame, nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """WIN4, JN13: one edge for each pair of nodes, the last written; edges without either end are dropped. keys name the repository."""
    keys = keys or []
    ids = nodes.select(*keys, "id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), [*keys, "source"], "left_semi").join(ids.withColumnRenamed("id", "target"), [*keys, "target"], "left_semi")
    return upsert(kept, kept.limit(0), [*keys, "source", "target"]).select(*keys, "write_seq", "source", "target", "kind", "metadata")


def test_edges(files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """JN10: keys, source, target of each test and the files it names: the same file name, or one that ends in it.

    A name's end is the beginning of it reversed: a prefix join by order.
    """
    keys = keys or []
    tests = files.where(X.is_test_file(F.col("path"))).select(*keys, F.col("path").alias("test"), F.reverse(X.tested_name(F.col("path"))).alias("prefix")).where("prefix <> ''")
    own = files.where(~X.is_test_file(F.col("path"))).select(*keys, F.col("path").alias("target"), F.reverse(X.base_name(F.col("path"))).alias("string"))
    met = prefix_pairs(tests, own, keys)
    out = tests.join(met, [*keys, "prefix"]).join(own, [*keys, "string"])
    return out.select(*keys, F.concat(F.lit("test:"), "test").alias("source"), F.concat(F.lit("file:"), "target").alias("target")).distinct()


def import_edges(imports: DataFrame, files: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """JN11: keys, source, target where a file's path starts with the import's path, or ends in it with .py, .ts or .js; not itself.

    imports: keys, path, name. Two prefix joins by order, the second of reversed paths.
    """
    keys = keys or []
    imp = imports.select(*keys, "path", F.replace(F.replace("name", F.lit("."), F.lit("/")), F.lit("@/"), F.lit("")).alias("mod")).where("mod <> ''")
    mods = imp.select(*keys, "mod").distinct()
    heads = prefix_pairs(mods.withColumnRenamed("mod", "prefix"), files.select(*keys, F.col("path").alias("string")), keys).select(*keys, F.col("prefix").alias("mod"), F.col("string").alias("target"))
    stems = files.where(F.col("path").rlike(r"\.(py|ts|js)$")).select(*keys, F.col("path").alias("target"), F.reverse(F.regexp_replace("path", r"\.(py|ts|js)$", "")).alias("string"))
    tails = prefix_pairs(mods.select(*keys, F.reverse("mod").alias("prefix")), stems, keys).join(stems, [*keys, "string"]).select(*keys, F.reverse("prefix").alias("mod"), "target")
    met = imp.join(heads.unionByName(tails), [*keys, "mod"]).where("path <> target")
    return met.select(*keys, F.concat(F.lit("file:"), "path").alias("source"), F.concat(F.lit("file:"), "target").alias("target")).distinct()


def _unique_suffix(modules: DataFrame, files: DataFrame, tails: list[str], whole: bool, keys: list[str]) -> DataFrame:
    """keys, module, source, target where just one file ends in the module's path with one of the tails; or is it, if whole."""
    ends = X.path_suffixes(F.concat(F.lit("/"), "path"))
    known = files.select(*keys, F.col("path").alias("target"), F.explode(ends if whole else F.slice(ends, F.lit(2), F.size(ends))).alias("k"))
    want = modules.select(*keys, "source", "module", F.explode(F.array(*[F.concat(F.lit("/"), "rel", F.lit(t)) for t in tails])).alias("k"))
    return want.join(known, [*keys, "k"]).groupBy(*keys, "source", "module").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def folded(path: Column) -> Column:
    """A relative path with . and .. segments folded; .. at the root is dropped."""
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_modules(imports: DataFrame, files: DataFrame, python: bool, keys: list[str] | None = None) -> DataFrame:
    """JN8 (python) or JN9: keys, source, module, target; the first candidate path that exists, else the only file that ends in it.

    A relative JavaScript module only has candidates, any other only the files that end in it.
    """
    keys = keys or []
    paths = files.select(*keys, F.col("path").alias("target"))
    here = F.regexp_extract("source", r"^(.*)/[^/]*$", 1)
    mods = imports.select(*keys, "source", "module").where("module is not null").distinct()
    if python:
        dots = F.length(F.regexp_extract("module", r"^(\.*)", 1))
        body = F.replace(F.regexp_replace("module", r"^\.+", ""), F.lit("."), F.lit("/"))
        up = F.when(dots > 0, F.concat(here, F.lit("/"), F.repeat(F.lit("../"), dots - 1), body)).otherwise(body)
        mods, tails = mods.withColumn("rel", folded(up)).withColumn("near", dots > 0), [".py", "/__init__.py"]
    else:
        near = F.col("module").startswith(".")
        mods, tails = mods.withColumn("rel", F.when(near, folded(F.concat(here, F.lit("/"), "module"))).otherwise(F.col("module"))).withColumn("near", near), JS_TAILS
    cand = mods.where("near") if not python else mods
    cand = cand.select(*keys, "source", "module", F.posexplode(F.array(*[F.concat("rel", F.lit(t)) for t in (tails if python else [*JS_SUFFIXES, ""])])).alias("prio", "target"))
    found = cand.join(paths, [*keys, "target"]).groupBy(*keys, "source", "module").agg(F.min_by("target", "prio").alias("target"))
    rest = mods.join(found, [*keys, "source", "module"], "left_anti").where("not near and rel <> ''")
    return found.unionByName(_unique_suffix(rest, files, tails, python, keys).select(*keys, "source", "module", "target"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, files: DataFrame, repo: list[str] | None = None) -> DataFrame:
    """JN4-7: repo (the columns that name a repository), file_seq, call_seq, path, callee, status, reason, target (symbol id): each call's function, or why there is none.

    A plain name is looked up in the imports in order: the first that names a function decides, and more than one
    candidate stops the search. Then in the caller's file. A member call is looked up under the module its base stands for.
    """
    repo = repo or []
    fn = symbols.where(F.col("kind").isin("FUNCTION", "METHOD")).select(*repo, F.col("path").alias("fpath"), F.col("name").alias("fname"), symbol_id().alias("fid"))
    handlers = symbols.where(F.col("kind").isin(ROUTE_KINDS)).select(*repo, F.col("path").alias("fpath"), F.coalesce("details.handler", "name").alias("fname"), handler_id().alias("fid"))
    fn = fn.unionByName(handlers)
    imp = symbols.where("kind = 'IMPORT'").select(*repo, "path", "sym_seq", F.coalesce("details.module", "details.source").alias("module"), "details.imported_names", "details.modules", "details.namespace_import", "details.default_import", (F.col("details.source").isNull()).alias("py"))
    sources = lambda py: imp.where(F.col("py") == py).select(*repo, F.col("path").alias("source"), "module")
    aliased = imp.where("py").select(*repo, F.col("path").alias("source"), F.explode(F.map_values("modules")).alias("module"))
    where = resolve_modules(sources(True).unionByName(aliased), files, True, repo).unionByName(resolve_modules(sources(False), files, False, repo)).withColumnsRenamed({"source": "path", "target": "fpath"})
    names = imp.select(*repo, "path", "sym_seq", "module", F.explode("imported_names").alias("callee_name", "fname"))
    names = names.unionByName(imp.where("default_import is not null").select(*repo, "path", "sym_seq", "module", F.col("default_import").alias("callee_name"), F.col("default_import").alias("fname")))
    key = [*repo, "file_seq", "call_seq"]
    plain, member = calls.where("callee_base is null"), calls.where("callee_base is not null")
    by_import = plain.join(names, [*repo, "path", "callee_name"]).join(where, [*repo, "path", "module"]).join(fn, [*repo, "fpath", "fname"]).groupBy(*key, "sym_seq").agg(F.count_distinct("fid").alias("n"), F.min("fid").alias("fid"))
    by_import = by_import.groupBy(*key).agg(F.min_by(F.struct("n", "fid"), "sym_seq").alias("i"))
    local = plain.join(fn.withColumnsRenamed({"fpath": "path", "fname": "callee_name"}), [*repo, "path", "callee_name"]).groupBy(*key).agg(F.struct(F.count_distinct("fid").alias("n"), F.min("fid").alias("fid")).alias("l"))
    bases = imp.select(*repo, "path", "sym_seq", F.explode("modules").alias("callee_base", "module")).unionByName(imp.where("namespace_import is not null").select(*repo, "path", "sym_seq", F.col("namespace_import").alias("callee_base"), "module"))
    by_base = member.join(bases, [*repo, "path", "callee_base"]).join(where, [*repo, "path", "module"]).join(fn.withColumnRenamed("fname", "callee_name"), [*repo, "fpath", "callee_name"]).groupBy(*key, "sym_seq").agg(F.count_distinct("fid").alias("n"), F.min("fid").alias("fid"))
    by_base = by_base.groupBy(*key).agg(F.min_by(F.struct("n", "fid"), "sym_seq").alias("b"))
    out = calls.select(*key, "path", "callee", "callee_base", "line_number").join(by_import, key, "left").join(local, key, "left").join(by_base, key, "left")
    status = (
        F.when(F.col("callee_base").isNotNull(), F.when(F.col("b.n") == 1, "imported_member").otherwise("unresolved"))
        .when(F.col("i.n") == 1, "imported").when(F.col("i.n") > 1, "unresolved").when(F.col("l.n") == 1, "same_file").otherwise("unresolved")
    )
    reason = F.when(F.col("b.n") > 1, "ambiguous_imported_member_functions").when(F.col("callee_base").isNotNull(), "unresolved_receiver_method").when(F.col("i.n") > 1, "ambiguous_imported_target_functions").when(F.col("l.n") > 1, "ambiguous_local_functions").otherwise("unresolved_or_external")
    target = F.when(status == "imported", F.col("i.fid")).when(status == "same_file", F.col("l.fid")).when(status == "imported_member", F.col("b.fid"))
    return out.select(*key, "path", "callee", "line_number", status.alias("status"), F.when(status == "unresolved", reason).alias("reason"), target.alias("target"))


def unresolved_by_file(resolved: DataFrame) -> DataFrame:
    """GRF3: calls without a target, listed on their file."""
    return resolved.where("status = 'unresolved'").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_number", "callee", "reason"))).alias("unresolved"))


def matches_edges(matched: DataFrame) -> DataFrame:
    """GRF4: MATCHES_ROUTE edges of matched and mismatched requests."""
    return matched.where(F.col("status").isin("MATCHED", "METHOD_MISMATCH")).select(F.col("request_id").alias("source"), F.explode("route_ids").alias("target"), F.lit("MATCHES_ROUTE").alias("kind"), F.to_json(F.struct("status")).alias("metadata"))


def related(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """JN18: edges out of and into the nodes whose label equals or contains a name."""
    hit = nodes.where(F.lower("label").contains(name.lower())).select("id")
    out = edges.join(hit, F.col("source") == F.col("id")).select("id", F.lit("out").alias("way"), F.col("target").alias("other"), "kind")
    return out.unionByName(edges.join(hit, F.col("target") == F.col("id")).select("id", F.lit("in").alias("way"), F.col("source").alias("other"), "kind"))


def counts(df: DataFrame) -> DataFrame:
    """AGG2: rows by kind."""
    return df.groupBy("kind").agg(F.count("*").alias("n"))
