import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as X
from codequarry.sources import files


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_route_paths(spark):
    table = {
        "/api/v1/users/:userId/posts/:postId": "/api/v1/users/{param}/posts/{param}", "/items/:id": "/items/{param}", "/items/{item_id}": "/items/{param}", "/users/[id]": "/users/{param}", "/blog/[...slug]": "/blog/{param}",
        "/api/search?q=test&page=1#results": "/api/search", "http://localhost:8000/api/items/${itemId}": "/api/items/{param}", "/api/orders/${orderId}/status": "/api/orders/{param}/status", "///api//v1///items/": "/api/v1/items", "/": "/", "": "/", None: "/",
    }
    assert values(spark, X.route_path, list(table)) == list(table.values())


def test_what_only_looks_like_a_route_parameter(spark):
    table = {"/a/[1]": "/a/[1]", "/a/${}": "/a/${}", "/a/{not-one}": "/a/{not-one}", "HTTP://h/a": "/http:/h/a", "https://h": "/", "http://h/x;v=1": "/x", " \t/A/{b}/ ": "/a/{param}", "/x/[[...opt]]": "/x/[{param}]", "a:b": "/a{param}"}
    assert values(spark, X.route_path, list(table)) == list(table.values())
    assert values(spark, X.rule_title, ["a.b.sql_in-JECT", "no-dot", "x.", None]) == ["Sql_In Ject", "no-dot", "", None]
    urls = ["https://github.com/o/r", " https://github.com/o/r.git/ ", "https://github.com/o", "git@github.com:o/r", "https://github.com/o/r?x", "https://github.com/../r", None]
    assert values(spark, X.github_url, urls) == ["https://github.com/o/r.git"] * 2 + [None] * 5


def test_redaction(spark):
    got = values(spark, X.redact, ["Bearer abcdefghijkl.x", "sk-abcdefghijklmnop1", "password = 'hunter22'", "C:\\Users\\bob\\x /home/eve/y", "ghp_" + "a" * 36, None])
    assert got == ["Bearer [REDACTED]", "sk-[REDACTED]", "password='[REDACTED]'", "[HOST_USER_DIR]\\x /home/[HOST_USER]/y", "[REDACTED_GITHUB_TOKEN]", ""]


def test_paths_and_names(spark):
    assert values(spark, X.language, ["a.py", "b/C.TSX", ".bashrc", "x/.env", "noext", "k.h"]) == ["python", "tsx", None, None, None, "c_header"]
    assert values(spark, X.is_test_file, ["tests/x.py", "a/test_b.py", "a/b_test.py", "a/b.spec.ts", "src/contest.py", "a/__tests__/x.js"]) == [True, True, True, True, False, True]
    assert values(spark, X.tested_name, ["tests/test_a.py", "b_test.py", "c.test.ts", "d.spec.tsx", "e.py"]) == ["a.py", "b.py", "c.ts", "d.tsx", None]
    assert values(spark, X.stripped_path, ["./a/b", "/a", ".github/x", "a\\b"]) == ["a/b", "a", "github/x", "a/b"]
    assert values(spark, files.confined, ["a/b", "../x", "a/../../b", "a/../b", "/abs", "C:/x", ""]) == [True, False, False, True, False, False, False]
    assert values(spark, files.ignored, ["a/node_modules/x.js", ".git/config", "a/.b/c", "src/dist.py", "dist/x"]) == [True, True, True, False, True]


def test_severity_and_tiers(spark):
    assert values(spark, X.severity, [" fatal", "Error", "WARN", "note", "unknown", None, "odd"]) == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "INFO", "INFO"]
    urls = ["https://docs.python.org/3", "https://fastapi.tiangolo.com/x", "https://github.com/a/b/releases", "https://pypi.org/project/x/#history", "https://nvd.nist.gov/v", "https://github.com/advisories/G", "https://learn.microsoft.com/x", "https://blog.example", None, "junk"]
    assert values(spark, X.source_tier, urls) == [1, 1, 2, 2, 3, 3, 4, 5, 5, 5]


def test_markdown_and_lines(spark):
    assert values(spark, X.escape_cell, ["a|b<c>\nd&", None]) == ["a\\|b&lt;c&gt; d&amp;", ""]
    assert values(spark, X.fence, ["x", "a ```` b", None]) == ["```", "`````", "```"]
    assert values(spark, X.line_count, ["", "a", "a\n", "a\nb", "\n"]) == [0, 1, 1, 2, 1]
    assert values(spark, lambda c: X.line_slice(c, F.lit(2), F.lit(9)), ["a\nb\nc", "a"]) == ["b\nc", ""]
    assert values(spark, X.count_shape, ["3", "[1, 2]", '"x"', None, "{}"]) == [3, 2, None, None, None]
    assert values(spark, X.json_block, ["x ```json\n{\"a\":1}\n``` y", " {} "]) == ['{"a":1}', "{}"]


def test_diff_grammar(spark):
    good = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n"
    assert values(spark, X.is_unified_diff, [good, "+++ b/x", "", None]) == [True, False, False, False]
    assert values(spark, X.diff_files, [good + "--- a/y\n+++ /dev/null\n", None]) == [["x", "dev/null"], []]


@pytest.mark.parametrize(("a", "b", "want"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(X.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def test_owner_and_repository(spark):
    urls = {"https://github.com/own/repo": ("own", "repo"), "https://github.com/own/repo.git/": ("own", "repo"), "git@github.com:own/re.po.git": ("own", "re.po"), "http://github.com/a/b/": ("a", "b"), "https://gitlab.com/a/b": ("", ""), "": ("", "")}
    owner, name = X.owner_repo(F.col("u"))
    got = {r["u"]: (r["o"], r["n"]) for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", owner.alias("o"), name.alias("n")).collect()}
    assert got == urls


def test_every_redaction_has_its_hint(spark):
    """Texts without a hint are left alone, so each pattern's text must hold one, in either letter case."""
    from codequarry.operators import report

    secrets = ["BEARER abcdefghijk", "sk-" + "a" * 16, "gsk_" + "a" * 16, "hf_" + "a" * 16, "nvapi-" + "a" * 16, "AIza" + "a" * 20, "ghp_" + "a" * 36, "github_pat_" + "a" * 22, "eyJ" + "a" * 10 + ".eyJ" + "a" * 10 + "." + "a" * 10, "Password: 'abcdefg'", 'api_key="abcdefg"', "C:\\Users\\me", "/home/me"]
    got = [r["x"] for r in spark.createDataFrame([(s,) for s in [*secrets, "plain", None]], "s string").select(X.redact(F.col("s")).alias("x")).collect()]
    assert all("[" in x for x in got[:-2]) and got[-2:] == ["plain", ""]
    assert [report._redacted(s) for s in [*secrets, "plain"]] == got[:-1]


def test_redaction_skips_texts_without_a_hint(spark):
    assert "contains" in str(X.redact(F.col("s")))[:4000].lower()


def test_char_histogram_of_null_empty_and_wide_texts(spark):
    got = [r["v"] for r in spark.createDataFrame([(None,), ("",), ("Aq\U0001f600",)], "s string").select(X.char_histogram(F.col("s")).alias("v")).collect()]
    assert got[0] == got[1] == [0.0] * 16
    assert len(got[2]) == 16 and got[2][1] > 0.8 and X.char_histogram.evalType == 250
