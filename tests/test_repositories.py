"""Two repositories of equal paths in one call, and joins by order."""

import random

from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators import graph, ordering, verifying
from codequarry.sources import files as src
from codequarry.sources import parsers

FILES = "repo string, file_seq int, path string, content string"


def two(spark):
    rows = []
    for repo, other in (("a", "helper"), ("b", "other")):
        rows += [
            (repo, 0, "package.json", '{"dependencies": {"react": "1%s"}}' % (8 if repo == "a" else 9)), (repo, 1, "requirements.txt", "fastapi==0.1\n" if repo == "a" else "flask\n"),
            (repo, 2, "app/main.py", f"from app.util import {other}\nimport app.util\n\n@router.get('/x')\ndef read():\n    {other}()\n    return app.util.{other}()\n"),
            (repo, 3, "app/util.py", f"def {other}():\n    return gone()\n"), (repo, 4, "tests/test_util.py", "import app.util\n"), (repo, 5, "web/a.ts", "fetch('/x');\n" if repo == "a" else "fetch('/y');\n"),
            (repo, 6, "notes.md", "text\n"),
        ]
    return spark.createDataFrame(rows, FILES).withColumn("language", X.language(F.col("path")))


def symbols_and_calls(files):
    """Keyed: paths carry the repository through the parsers."""
    own = verifying.symbols_of(files, ["repo"])
    marked = files.withColumn("path", F.concat_ws("\x1f", "repo", "path"))
    calls = parsers.calls(marked).withColumn("repo", F.split("path", "\x1f")[0]).withColumn("path", F.split("path", "\x1f")[1])
    return own, calls


def test_graph_of_two_repositories_is_the_graphs_of_both(spark):
    files = two(spark)
    symbols, calls = symbols_and_calls(files)
    symbols, calls = symbols.cache(), calls.cache()

    def build(f, s, c, keys):
        known = src.frameworks(f, keys)
        nodes = graph.nodes_of(f, s, known, keys).cache()
        resolved = graph.resolve_calls(c, s, f, keys)
        edges = graph.last_edges(graph.structure_edges(f, s, known, keys).unionByName(graph.call_edges(resolved, c, nodes, keys)), nodes, keys)
        chunks = src.chunks(f, s, F.concat(F.lit("commit-"), "repo"), keys=keys)
        return [sorted(map(str, (r.asDict() for r in df.collect()))) for df in (known.drop("evidence"), nodes, resolved, edges, chunks)]

    both = build(files, symbols, calls, ["repo"])
    for repo in "ab":
        of = lambda df, repo=repo: df.where(F.col("repo") == repo)
        one = build(of(files), of(symbols), of(calls), [])
        own = [sorted(x.replace(f"'repo': '{repo}', ", "") for x in part if f"'repo': '{repo}'" in x) for part in both]
        assert own == one and all(one)
    kinds = {x.split("'kind': '")[1].split("'")[0] for x in both[3]}
    assert kinds == {"CONTAINS", "TESTS", "DEPENDS_ON", "EXPOSES_ROUTE", "CALLS"}


def test_prefixes_by_order_equal_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice(["a", "b", "/", "é", "\U0001d538", "\uffff"]) for _ in range(rng.randrange(n)))
    strings = sorted({(k, text(9)) for k in ("r", "s", None) for _ in range(120)}, key=str)
    prefixes = sorted({(k, text(4)) for k in ("r", "s", None) for _ in range(40)} | {("r", s) for k, s in strings[:20] if k == "r"}, key=str)
    p, s = spark.createDataFrame(prefixes, "repo string, prefix string"), spark.createDataFrame([*strings, ("r", None), *strings[:5]], "repo string, string string")
    want = sorted([(k, a, b) for k, a in prefixes for j, b in strings if k == j and a and b.startswith(a)], key=str)
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert sorted(map(tuple, ordering.prefix_pairs(p, s, ["repo"]).collect()), key=str) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(want) > 100 and ordering.prefix_pairs(p.limit(0), s, ["repo"]).count() == 0


def test_manifests_of_two_repositories(spark):
    rows = [("a", f"f{i}.py", s, False, "x\n") for i, s in enumerate([40, 70, 30, 200, 10])] + [("a", "z.bin", 5, True, None)] + [("b", f"f{i}.ts", 10, False, "") for i in range(9)] + [("c", "README", 1, False, "x")]
    df = spark.createDataFrame(rows, "repo string, path string, size_bytes long, is_binary boolean, content string")
    entries, totals = src.manifests(df, max_files=7, max_file_bytes=60, max_bytes=100)
    got = {(r["repo"], r["path"]): r["skipped_reason"] for r in entries.collect()}
    big, over = "exceeds_max_size", "total_source_byte_budget_exceeded"
    assert [got["a", f"f{i}.py"] for i in range(5)] == [None, over, None, over, None] and got["a", "z.bin"] == "binary_file"
    assert len([k for k in got if k[0] == "b"]) == 7 and big not in got.values()
    t = {r["repo"]: r.asDict() for r in totals.collect()}
    assert t["a"] == {"repo": "a", "truncated": True, "reason": "exceeded_max_total_source_bytes (100 bytes)", "files_processed": 3, "source_bytes_processed": 80, "total_observed_files": 6, "total_observed_bytes": 355, "languages": {"python": 5}}
    assert t["b"]["reason"] == "exceeded_max_repo_files (7)" and t["b"]["total_observed_files"] == 8 and t["b"]["total_observed_bytes"] == 80 and t["b"]["languages"] == {"typescript": 7}
    assert t["c"] == {"repo": "c", "truncated": False, "reason": None, "files_processed": 1, "source_bytes_processed": 1, "total_observed_files": 1, "total_observed_bytes": 1, "languages": {}}
