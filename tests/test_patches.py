"""Strict diffs, the patched graph against a full rebuild, and keys of several repositories."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.operators import applying, graph, verifying

BODY = "one\ntwo\n\nthree\nfour\nfive\n"
TWO = "--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n one\n-two\n+TWO\n"


@pytest.mark.parametrize(("diff", "error", "content"), [
    (TWO, None, "one\nTWO\n\nthree\nfour\nfive\n"),
    ("--- a/x.py\n+++ b/x.py\n@@ -2,3 +2,3 @@\n two\n\n-three\n+THREE\n", None, "one\ntwo\n\nTHREE\nfour\nfive\n"),  # an empty line is context
    ("--- a/crlf.py\n+++ b/crlf.py\n@@ -1,2 +1,2 @@\n a\n-b\n+B\n", None, "a\nB\nc\n"),
    ("--- /dev/null\n+++ b/x.py\n@@ -0,0 +1,1 @@\n+new\n", "file already exists", None),
    ("--- /dev/null\n+++ b/deep/new.py\n@@ -0,0 +1,2 @@\n+a\n+b\n\\ No newline at end of file\n", None, "a\nb\n"),
    ("--- a/x.py\n+++ /dev/null\n@@ -1,2 +0,1 @@\n-one\n-two\n+kept\n", "deletion adds lines", None),
    ("--- a/x.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-one\n-2\n", "context mismatch", None),
    ("--- a/x.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-one\n-two\n", None, ""),
    ("--- a/x.py\n+++ b/x.py\n@@ -5,1 +5,1 @@\n-four\n+FOUR\n@@ -1,1 +1,1 @@\n-one\n+ONE\n", None, "ONE\ntwo\n\nthree\nFOUR\nfive\n"),  # hunks in any order
    ("--- a/x.py\n+++ b/x.py\n@@ -1,3 +1,3 @@\n one\n two\n \n@@ -3,1 +3,1 @@\n \n", "count mismatch", None),  # a section's last blank line is trimmed
    ("--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n one\n two\n@@ -2,1 +2,1 @@\n-two\n+2\n", "overlapping hunks", None),
    (TWO.replace("x.py", "logo.SVG"), "binary file", None), ("GIT binary patch\n" + TWO, "binary patch", None), ("diff --git a/x.py b/x.py\n" + TWO, "malformed file headers", None),
    (TWO + "index 1..2\n", "invalid line marker", None), ("--- a/x.py\n+++ b/x.py\n", "no hunks", None), ("  \n", "empty diff", None), (None, "empty diff", None),
    (TWO.replace("x.py", "gone.py"), "file not found", None), (TWO.replace("x.py", "../x.py"), "path leaves the repository", None), (TWO.replace("x.py", "c:x.py"), "path leaves the repository", None),
    (TWO.replace("x.py", "pic"), "not a text file", None), (TWO.replace("-1,2 +1,2", "-2,2 +2,2"), "context mismatch", None), (TWO.replace("-1,2 +1,2", "-1,3 +1,2"), "count mismatch", None),
    ("--- a/x.py\n+++ b/x.py\n@@ -6,1 +6,2 @@\n five\n+six\n--- a/x.py\n+++ b/x.py\n@@ -7,1 +7,1 @@\n-six\n+SIX\n", None, BODY + "SIX\n"),  # sections of a file follow each other
])
def test_strict_diffs(spark, diff, error, content):
    files = spark.createDataFrame([("r", "x.py", BODY), ("r", "crlf.py", "a\r\nb\r\nc"), ("r", "pic", None), ("other", "x.py", "one\nelse\n"), ("other", "gone.py", BODY)], "repo string, path string, content string")
    p = spark.createDataFrame([("r", "p", diff)], "repo string, patch_id string, unified_diff string")
    rows = applying.apply_patches(p, files).collect()
    assert len(rows) == 1 and (rows[0]["error"], rows[0]["content"]) == (error, content)
    assert rows[0]["deleted"] == (content == "")


def test_patches_apply_whole_and_keep_repositories_apart(spark):
    files = spark.createDataFrame([("a", "x.py", BODY), ("b", "x.py", BODY.replace("two", "zwei"))], "repo string, path string, content string")
    new = "--- /dev/null\n+++ b/y.py\n@@ -0,0 +1,1 @@\n+y\n"
    p = spark.createDataFrame([(r, i, d) for r in "ab" for i, d in (("new then x", new + TWO), ("x", TWO))], "repo string, patch_id string, unified_diff string")
    got = {(r["repo"], r["patch_id"], r["path"]): (r["content"], r["error"]) for r in applying.apply_patches(p, files).collect()}
    assert got == {
        ("a", "new then x", "y.py"): ("y\n", None), ("a", "new then x", "x.py"): (BODY.replace("two", "TWO"), None), ("a", "x", "x.py"): (BODY.replace("two", "TWO"), None),
        ("b", "new then x", "y.py"): (None, "context mismatch"), ("b", "new then x", "x.py"): (None, "context mismatch"), ("b", "x", "x.py"): (None, "context mismatch"),
    }
    assert applying.apply_patches(p.limit(0), files).count() == 0


def repositories(rng):
    """Files of two repositories with equal paths, and patches that change, make, break and delete some."""
    files, patches = [], []
    words = ["items", "users", "v1/items", "v1", "{id}", "orders/{id}"]
    for repo in "ab":
        own = {}
        for i in range(7):
            routes = [f"@router.{rng.choice(['get', 'post'])}('/{rng.choice(words)}')\ndef f{i}_{j}():\n    return {j}\n" for j in range(rng.randrange(1, 3))]
            own[f"api/m{i}.py"] = "".join(routes)
            calls = [rng.choice([f"fetch('/{rng.choice(words)}');\n", f"fetch('/api/{rng.choice(words)}', {{method: 'POST'}});\n"]) for _ in range(2)]
            own[f"web/c{i}.ts"] = "".join(calls)
        own["test_m1.py"] = "def test():\n    pass\n"
        files += [(repo, i, p, "python" if p.endswith(".py") else "typescript", c) for i, (p, c) in enumerate(sorted(own.items()))]
        for k in range(14):
            diff = ""
            for path in rng.sample(sorted(own), rng.randrange(1, 4)):
                lines = own[path].splitlines()
                kind = rng.randrange(4)
                old, new = f"--- a/{path}\n", f"+++ b/{path}\n"
                if kind == 0:
                    diff += old + f"+++ /dev/null\n@@ -1,{len(lines)} +0,0 @@\n" + "".join(f"-{x}\n" for x in lines)
                elif kind == 1:
                    made = f"extra/n{k}.py" if rng.random() < 0.5 else f"extra/n{k}.ts"
                    body = f"@router.get('/{rng.choice(words)}')\ndef g():\n    return 1\n" if made.endswith("py") else f"fetch('/{rng.choice(words)}');\n"
                    if made not in diff:
                        diff += f"--- /dev/null\n+++ b/{made}\n@@ -0,0 +1,{body.count(chr(10))} @@\n" + "".join(f"+{x}\n" for x in body.splitlines())
                else:
                    first = f"@router.put('/{rng.choice(words)}')" if path.endswith(".py") else f"fetch('/{rng.choice(words)}');"
                    diff += old + new + f"@@ -1,1 +1,1 @@\n-{lines[0]}\n+{first}\n"
            patches.append((repo, f"p{k}", diff or TWO))
    return files, patches


def test_patched_graph_by_deltas_equals_a_full_rebuild(spark):
    files, patches = repositories(random.Random(11))
    f = spark.createDataFrame(files, "repo string, file_seq int, path string, language string, content string")
    p = spark.createDataFrame(patches, "repo string, patch_id string, unified_diff string")
    done = applying.apply_patches(p, f)
    rows = done.collect()
    applied = spark.createDataFrame([r for r in rows if r["error"] is None and r["path"]], done.schema)
    good = {(r["repo"], r["patch_id"]) for r in rows} - {(r["repo"], r["patch_id"]) for r in rows if r["error"]}
    assert len(good) > 15
    new_files = applied.where("not deleted").select("repo", "patch_id", F.lit(0).alias("file_seq"), "path", X.language(F.col("path")).alias("language"), "content")
    base_symbols, new_symbols = verifying.symbols_of(f, ["repo"]).cache(), verifying.symbols_of(new_files, verifying.PATCH).cache()
    requests, routes = verifying.requests_of(base_symbols, ["repo"]), verifying.routes_of(base_symbols, ["repo"])
    base = verifying.matched(requests, routes, ["repo"])
    changes = verifying.contract_changes(base, requests, routes, applied, verifying.requests_of(new_symbols, verifying.PATCH), verifying.routes_of(new_symbols, verifying.PATCH))
    no_frameworks = spark.createDataFrame([("a", "FastAPI", None), ("b", "FastAPI", None)], "repo string, name string, version string")
    nodes = verifying.node_counts(f, base_symbols, no_frameworks, applied, new_files, new_symbols)

    # every patched repository as a whole
    touched = {(r["repo"], r["patch_id"], r["path"]) for r in rows}
    whole = [(*k, s, path, lang, c) for k in sorted(good) for r, s, path, lang, c in files if r == k[0] and (*k, path) not in touched]
    whole += [(r["repo"], r["patch_id"], 0, r["path"], None, r["content"]) for r in rows if (r["repo"], r["patch_id"]) in good and not r["deleted"]]
    full = spark.createDataFrame(whole, "repo string, patch_id string, file_seq int, path string, language string, content string").withColumn("language", X.language(F.col("path")))
    symbols = verifying.symbols_of(full, verifying.PATCH).cache()
    after = verifying._defects(verifying.matched(verifying.requests_of(symbols, verifying.PATCH), verifying.routes_of(symbols, verifying.PATCH), verifying.PATCH), verifying.PATCH)
    was = verifying._defects(base, ["repo"]).collect()
    before = {(*k, *tuple(r)[1:]) for k in good for r in was if r["repo"] == k[0]}
    now = {tuple(r) for r in after.collect()}
    want = {(*x, "new") for x in now - before} | {(*x, "resolved") for x in before - now}
    assert {tuple(r) for r in changes.collect()} == want and len(want) > 20
    frameworks = no_frameworks.join(spark.createDataFrame(sorted(good), "repo string, patch_id string"), "repo")
    total = graph.nodes_of(full, symbols, frameworks, verifying.PATCH).groupBy("repo", "patch_id").count()
    assert {tuple(r) for r in nodes.collect()} == {tuple(r) for r in total.collect()}


def test_brackets_stand_in_for_a_grammar(spark):
    texts = {"f(a[1], {b: `}`});": False, "f(a;": True, "f(']');": False, "x = {": True, "a)": True, "([)]": True, "// (\nf()": False, "/* { */ f('\\'(')": False, "": False}
    df = spark.createDataFrame(list(texts.items()), "c string, bad boolean")
    assert all(r["bad"] == r["found"] for r in df.withColumn("found", verifying._open_brackets(F.col("c"))).collect())
