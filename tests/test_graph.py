from pyspark.sql import functions as F

from codequarry import schemas
from codequarry.operators import graph, retrieval
from codequarry.sources import files as src
from codequarry.sources import parsers

SOURCES = {
    "shop/order.py": "from shop.stock import reserve, price_of as cost\nimport shop.stock as depot\n\ndef total(items):\n    return sum(cost(i) for i in items)\n\ndef place(items):\n    total(items)\n    reserve(items)\n    depot.release(items)\n    items.sort()\n    missing(1)\n",
    "shop/stock.py": "def reserve(x):\n    return x\n\ndef price_of(x):\n    return 1\n\ndef release(x):\n    pass\n",
    "shop/legacy.py": "def twice(x):\n    return x\n\nif True:\n    def twice(x):\n        return x + x\n\ndef call():\n    twice(2)\n",
    "shop/other.py": "from .legacy import twice\n\ndef far():\n    twice(3)\n\nclass Cart:\n    def add(self, x):\n        far()\n",
    "web/cart.ts": "import { tax } from './lib/rates';\nimport * as money from './lib/money';\nfunction sumUp(x) {\n  return tax(x, 19);\n}\nconst show = () => { sumUp(5); money.format(3); fetch('/api/cart', { method: 'POST' }); };\n",
    "web/lib/rates.ts": "export function tax(a, b) { return a * b; }\n",
    "web/lib/money.ts": "export function format(a) { return a; }\n",
    "api.py": "@router.get('/carts/{id}')\nasync def show(id):\n    return 1\n\nclass Svc:\n    def method(self):\n        pass\n",
    "broken.py": "def (:\n",
    "tests/test_order.py": "import shop.order\n",
    "requirements.txt": "fastapi==1\n",
}


def files_of(spark):
    rows = [(i, p, "python" if p.endswith(".py") else "typescript" if p.endswith(".ts") else None, c) for i, (p, c) in enumerate(SOURCES.items())]
    return spark.createDataFrame(rows, "file_seq int, path string, language string, content string")


def test_symbols_and_calls(spark):
    f = files_of(spark)
    got = {(r["path"], r["kind"], r["name"]) for r in parsers.symbols(f).collect()}
    assert {("api.py", "FASTAPI_ROUTE", "GET /carts/{id}"), ("api.py", "FUNCTION", "show"), ("api.py", "CLASS", "Svc"), ("api.py", "METHOD", "method"), ("web/cart.ts", "FETCH_CALL", "/api/cart"), ("web/cart.ts", "FUNCTION", "sumUp")} <= got
    assert not any(p == "broken.py" for p, _, _ in got)
    assert parsers.symbols(f).schema.simpleString() == spark.createDataFrame([], schemas.SYMBOLS).schema.simpleString()


def test_call_resolution(spark):
    f = files_of(spark)
    rows = graph.resolve_calls(parsers.calls(f), parsers.symbols(f), f).collect()
    got = {(r["path"], r["callee"]): (r["status"], r["reason"], r["target"]) for r in rows}
    assert got["shop/order.py", "total"] == ("same_file", None, "symbol:shop/order.py:FUNCTION:total:4")
    assert got["shop/order.py", "reserve"] == ("imported", None, "symbol:shop/stock.py:FUNCTION:reserve:1")
    assert got["shop/order.py", "cost"][2] == "symbol:shop/stock.py:FUNCTION:price_of:4"
    assert got["shop/order.py", "depot.release"] == ("imported_member", None, "symbol:shop/stock.py:FUNCTION:release:7")
    assert got["shop/order.py", "items.sort"] == ("unresolved", "unresolved_receiver_method", None)
    assert got["shop/order.py", "missing"] == ("unresolved", "unresolved_or_external", None)
    assert got["shop/legacy.py", "twice"][1] == "ambiguous_local_functions" and got["shop/other.py", "twice"][1] == "ambiguous_imported_target_functions"
    assert got["web/cart.ts", "sumUp"][0] == "same_file" and got["web/cart.ts", "tax"][2] == "symbol:web/lib/rates.ts:FUNCTION:tax:1"
    assert got["web/cart.ts", "money.format"][0] == "imported_member"


def test_call_graph_and_structure(spark):
    f = files_of(spark)
    symbols, calls = parsers.symbols(f), parsers.calls(f)
    frameworks = spark.createDataFrame([("FastAPI", "1", "x")], "name string, version string, evidence string")
    nodes = graph.nodes_of(f, symbols, frameworks)
    edges = graph.structure_edges(f, symbols, frameworks).unionByName(graph.call_edges(graph.resolve_calls(calls, symbols, f), calls, nodes))
    edges = graph.last_edges(edges, nodes).cache()
    got = {(r["source"], r["target"]): r["kind"] for r in edges.collect()}
    place = "symbol:shop/order.py:FUNCTION:place:7"
    assert got[place, "symbol:shop/order.py:FUNCTION:total:4"] == got[place, "symbol:shop/stock.py:FUNCTION:release:7"] == "CALLS"
    assert got["symbol:shop/other.py:METHOD:add:7", "symbol:shop/other.py:FUNCTION:far:3"] == "CALLS"
    assert got["file:tests/test_order.py", "test:tests/test_order.py"] == "CONTAINS" and got["test:tests/test_order.py", "file:shop/order.py"] == "TESTS"
    assert got["file:requirements.txt", "dep:fastapi"] == "DEPENDS_ON"
    handler = "symbol:api.py:FUNCTION:GET /carts/{id}:2" if ("symbol:api.py:FUNCTION:GET /carts/{id}:2", "route:GET:/carts/{id}") in got else "symbol:api.py:FUNCTION:GET /carts/{id}:1"
    assert got[handler, "route:GET:/carts/{id}"] == "EXPOSES_ROUTE" and got["file:api.py", "route:GET:/carts/{id}"] == got["file:api.py", handler] == "CONTAINS"
    assert any(s == "file:web/cart.ts" and t.startswith("req:web/cart.ts:") and k == "CONTAINS" for (s, t), k in got.items())
    assert {r["target"] for r in graph.outgoing(graph.of_kind(edges, "CALLS"), place).collect()} == {"symbol:shop/order.py:FUNCTION:total:4", "symbol:shop/stock.py:FUNCTION:reserve:1", "symbol:shop/stock.py:FUNCTION:release:7"}
    assert graph.incoming(edges, "dep:fastapi").count() == 1 and graph.node(nodes, "dep:fastapi").first()["label"] == "FastAPI"
    d = graph.domain_data(nodes, edges).first()
    assert d["total_edges"] == len(got) and d["node_counts_by_kind"]["TEST"] == 1 and not d["is_empty"] and graph.domain_data(nodes.limit(0), edges.limit(0)).first()["is_empty"]
    assert {r["path"] for r in graph.routes_of(symbols).collect()} == {"api.py"} and graph.http_calls_of(symbols).count() == 1
    assert {r["name"] for r in graph.symbols_where(symbols, "api.py", "METHOD").collect()} == {"method"}
    findings = spark.sql("select struct('api.py' file_path, 2 start_line, cast(null as int) end_line) evidence, 'a' title, 'LOW' severity union all select struct('api.py', 40, 41), 'b', 'LOW'")
    region = graph.evidence_context(symbols, findings, "api.py", 1, 3).first()
    assert "method" not in {x["name"] for x in region["symbols"]} and [x["title"] for x in region["findings"]] == ["a"]
    known = spark.createDataFrame([(1, "React", "18"), (2, "React Native", "0.7"), (3, "FastAPI", None)], "seq int, name string, version string")
    want = spark.createDataFrame([("react",), ("native",), ("FastAPI",), ("Vue",)], "framework string")
    assert {r["framework"]: r["version"] for r in graph.framework_version(want, known).collect()} == {"react": "18", "native": "0.7", "FastAPI": None, "Vue": None}


def test_js_modules_by_suffix(spark):
    paths = ["a/b.ts", "a/c.d.ts", "a/lib/index.ts", "x/util/deep.tsx", "y/@/one.js", "z/two.js", "w/two.js", "a/style.css", "p/jsx.jsx"]
    f = spark.createDataFrame([(p,) for p in paths], "path string")
    cases = {"./b": "a/b.ts", "./c": "a/c.d.ts", "./lib": "a/lib/index.ts", "./style.css": "a/style.css", "../x/util/deep": "x/util/deep.tsx", "./none": None, "util/deep": "x/util/deep.tsx", "@/one": "y/@/one.js", "two": None, "jsx": None, "a/b": None}
    imports = spark.createDataFrame([("a/main.ts", m) for m in cases], "source string, module string")
    got = {r["module"]: r["target"] for r in graph.resolve_modules(imports, f, False).collect()}
    assert {m: got.get(m) for m in cases} == cases


def test_contract_matching(spark):
    routes = spark.createDataFrame([(1, "r1", "/api/users/{id}", "GET"), (2, "r2", "/api/users", "POST"), (3, "r3", "/api/duplicate", "GET"), (4, "r4", "/api/duplicate", "GET")], "route_seq int, route_id string, path string, method string")
    req = spark.createDataFrame([("a", "/api/users/:userId", "GET"), ("b", "/api/users", "PUT"), ("c", "/api/nonexistent", "DELETE"), ("d", "/api/duplicate", "get"), ("e", "/users/:x", "GET"), ("f", "/", "GET"), ("g", None, None)], "request_id string, path string, method string")
    got = {r["request_id"]: (r["status"], r["route_ids"], r["methods"]) for r in graph.contracts(req, routes).collect()}
    assert got["a"][:2] == ("MATCHED", ["r1"]) and got["b"] == ("METHOD_MISMATCH", ["r2"], ["POST"]) and got["d"][:2] == ("AMBIGUOUS_MATCH", ["r3", "r4"])
    assert got["c"][0] == got["f"][0] == got["g"][0] == "UNMATCHED_FRONTEND_REQUEST" and got["e"][:2] == ("MATCHED", ["r1"])


def test_nodes_edges_and_chunks(spark):
    f = files_of(spark)
    nodes = graph.nodes_of(f, parsers.symbols(f), spark.createDataFrame([("FastAPI", "1", "x")], "name string, version string, evidence string"))
    ids = {r["id"]: r["kind"] for r in nodes.collect()}
    assert ids["test:tests/test_order.py"] == "TEST" and ids["dep:fastapi"] == "DEPENDENCY" and ids["route:GET:/carts/{id}"] == "ROUTE" and "file:shop/order.py" in ids
    edges = graph.test_edges(f)
    assert [tuple(r) for r in edges.collect()] == [("test:tests/test_order.py", "file:shop/order.py")]
    imports = spark.createDataFrame([("shop/legacy.py", "shop.stock"), ("shop/order.py", "from x import y")], "path string, name string")
    assert [tuple(r) for r in graph.import_edges(imports, f).collect()] == [("file:shop/legacy.py", "file:shop/stock.py")]
    e = spark.createDataFrame([(1, "file:api.py", "file:broken.py", "IMPORTS", None), (2, "file:api.py", "file:broken.py", "CALLS", None), (3, "file:api.py", "gone", "CALLS", None)], schemas.EDGES)
    assert [r["kind"] for r in graph.last_edges(e, nodes).collect()] == ["CALLS"]
    c = src.chunks(f, parsers.symbols(f), "0123456789abcdef").collect()
    assert {"0123456789ab:shop/stock.py:price_of:4", "0123456789ab:broken.py:broken.py:1"} <= {r["chunk_id"] for r in c}


def test_fusion_values(spark):
    ch = lambda ids: spark.createDataFrame([(x, 1.0 - i / 10) for i, x in enumerate(ids)], "chunk_id string, score double")
    got = {r["chunk_id"]: (r["score"], r["channels"]) for r in retrieval.fuse({"exact": ch(["c1", "c2"]), "lexical": ch(["c2", "c3", "c1"]), "dense": ch(["c1", "c4"])}).collect()}
    assert abs(got["c1"][0] - (1 / 61 + 1 / 63 + 1 / 61)) < 1e-12 and got["c2"][1] == ["exact", "lexical"]


def test_retrieval_and_budget(spark):
    rows = [("k1", "auth/login.py", "login", "FUNCTION", "def login(user): token"), ("k2", "auth/util.py", "helper", "FUNCTION", "token token"), ("k3", "x.py", "other", "CLASS", "nothing")]
    c = spark.createDataFrame(rows, "chunk_id string, file_path string, symbol string, symbol_kind string, content string")
    v = spark.createDataFrame([("k1", [1.0, 0.0]), ("k2", [0.8, 0.2]), ("k3", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    got = retrieval.retrieve(c, "login", 2, v, [1.0, 0.0]).collect()
    assert got[0]["chunk_id"] == "k1" and got[0]["channels"] == ["exact", "lexical", "dense"] and len(got) == 2
    assert retrieval.lexical(c, "!").count() == 0 and retrieval.dense(v, [1.0, 0.0], 0).count() == 0
    kept = retrieval.within_budget(c, 1, [F.col("chunk_id")], F.length("content"))
    assert [r["chunk_id"] for r in kept.collect()] == ["k1"]


def test_javascript_and_http_client_symbols(spark):
    """Express routes, kinds of imports, fetch and axios calls, and Python's HTTP clients."""
    js = "import def, { one, two as deux } from './m';\nimport * as ns from './n';\nconst express = require('express');\nrouter.get('/a/:id', (req, res) => { res.send(1); });\napp.post(\"/b\", handler);\naxios.put('/c', { x: 1 });\naxios({ url: '/d', method: 'delete' });\nfetch('/e');\nother.get('/no');\n"
    py = "import requests, httpx\n\ndef pull(client):\n    requests.get('http://h/x')\n    httpx.post('/y')\n    client.delete('/z')\n"
    f = spark.createDataFrame([(0, "s.js", "javascript", js), (1, "h.py", "python", py)], "file_seq int, path string, language string, content string")
    rows = parsers.symbols(f).collect()
    routes = {(r["details"]["http_method"], r["details"]["path"]) for r in rows if r["kind"] == "EXPRESS_ROUTE"}
    assert routes == {("GET", "/a/:id"), ("POST", "/b")}
    http = {(r["kind"], r["details"]["http_method"], r["details"]["url"]) for r in rows if r["kind"] in ("FETCH_CALL", "AXIOS_CALL")}
    assert {("FETCH_CALL", "GET", "/e"), ("AXIOS_CALL", None, "/c"), ("AXIOS_CALL", None, "unknown")} <= http
    imports = {r["details"]["source"]: r["details"] for r in rows if r["kind"] == "IMPORT" and r["details"]["source"]}
    assert imports["./m"]["imported_names"] == {"one": "one", "deux": "two"} and imports["./m"]["default_import"] == "def" and imports["./n"]["namespace_import"] == "ns"
    own = [r["details"] for r in rows if r["path"] == "h.py" and r["kind"] == "FETCH_CALL"]
    assert len(own) == 2 and all(d["snippet"] and d["url"] is None for d in own)  # client.delete is none of them


def test_javascript_strings_comments_methods_and_routes():
    source = """fetch('https://api.x.com/v1/items', {method: 'POST'}); // fetch('/gone')
const s = "fetch('/inside')"; /* axios.get('/gone') */
class Svc extends Base {
  constructor(x) { super(x); if (x) { run(x); } }
  async load(id: string): Promise<void> { await fetch(url); return new Svc(); }
}
app.use(cors()); app.use('/api', r); v1Router.all('/z', h); app.options('/no', h); axios.request(conf);
"""
    symbols, calls = parsers.javascript(source)
    got = {(s[1], s[0], s[2]) for s in symbols}
    assert got == {("FETCH_CALL", "https://api.x.com/v1/items", 1), ("CLASS", "Svc", 3), ("METHOD", "constructor", 4), ("METHOD", "load", 5), ("FETCH_CALL", "fetch", 5), ("EXPRESS_ROUTE", "USE unknown", 7), ("EXPRESS_ROUTE", "USE /api", 7), ("EXPRESS_ROUTE", "ALL /z", 7), ("AXIOS_CALL", "axios.request", 7)}
    details = {s[0]: s[6] for s in symbols}
    assert details["https://api.x.com/v1/items"] == {"url": "https://api.x.com/v1/items", "target": "https://api.x.com/v1/items", "http_method": "POST"} and details["fetch"]["url"] == "url" and details["axios.request"]["url"] == "conf"
    assert [(c[0], *c[5:7]) for c in calls] == [("run", "constructor", "METHOD"), ("cors", None, None), ("app.options", None, None)]


def test_contract_counts_of_many_requests_and_routes_on_one_path(spark):
    """Counts don't pair requests with routes: 200 million pairs on one path here."""
    n = 20000
    req = spark.range(n).selectExpr("id as request_id", "concat('/a/', '{id}') as path", "'get' as method").unionByName(spark.createDataFrame([(-1, "/x/only", "PUT"), (-2, "/none", "GET")], "request_id long, path string, method string"))
    routes = spark.range(n // 2).selectExpr("id as route_seq", "id as route_id", "'/a/{k}' as path", "if(id = 7, 'GET', 'POST') as method").unionByName(spark.createDataFrame([(50000, 50000, "/only", "PUT")], "route_seq long, route_id long, path string, method string"))
    got = {tuple(r) for r in graph.contract_counts(req, routes).groupBy("path", "method", "status", "n", "same").count().collect()}
    assert got == {("/a/{param}", "GET", "MATCHED", n // 2, 1, n), ("/x/only", "PUT", "MATCHED", 1, 1, 1), ("/none", "GET", "UNMATCHED_FRONTEND_REQUEST", 0, 0, 1)}
