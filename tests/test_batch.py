"""Retrieval for a table of queries against the operators for one query."""

import random

import pytest
from pyspark.sql import functions as F

from codequarry.operators import batch, retrieval
from codequarry.tables import kept

CHUNKS = "repo string, chunk_id string, file_path string, symbol string, symbol_kind string, content string"


def table(spark):
    rng = random.Random(3)
    words = ["login", "logout", "Ab", "user_id", "é\u00df", "x", "aaa", "route", "foo.bar", "\U0001d538b"]
    rows = []
    for repo in ("one", "two"):
        for i in range(25):
            rows.append((repo, f"k{i}", rng.choice(["auth/login.py", "web/App.tsx", "x.py"]), rng.choice([*words, None]), rng.choice(["FUNCTION", "CLASS"]), " ".join(rng.choices(words, k=rng.randrange(15))) if i else None))
    return spark.createDataFrame(rows, CHUNKS)


@pytest.mark.parametrize("few", [256, 12])
def test_occurrences_equal_a_scan_for_every_string(spark, monkeypatch, few):
    monkeypatch.setattr(batch, "FEW", few)
    c = table(spark)
    strings = ["login", "log", "aa", "a", "u", "ser_id", "é", "\U0001d538b", "foo.bar route", "web/app", "nowhere", "in l"]
    df = spark.createDataFrame([(r, x) for r in ("one", "two") for x in strings[: None if r == "one" else 6]], "repo string, string string")
    got = {(r["repo"], r["chunk_id"], r["string"]): tuple(r)[3:] for r in batch.occurrences(c, df).collect()}
    want = {}
    for r in c.collect():
        text, symbol, path = ((r[x] or "").lower() for x in ("content", "symbol", "file_path"))
        for x in strings[: None if r["repo"] == "one" else 6]:
            if x in text or x in symbol or x in path:
                want[r["repo"], r["chunk_id"], x] = (text.count(x), symbol.count(x), symbol == x, x in path)
    assert got == want and len(want) > 100
    assert batch.occurrences(c, df.limit(0)).count() == 0


def test_batch_equals_one_query_at_a_time(spark):
    c = table(spark)
    rng = random.Random(4)
    asked = ["login", "log user_id log", "Auth/Login.py", "zzz", "aa aaa route", "\U0001d538b", " "]
    queries = [(r, f"{r}{i}", t, [rng.random() for _ in range(3)] if i % 2 else None, None, "CLASS" if i == 4 else None) for r in ("one", "two") for i, t in enumerate(asked)]
    q = spark.createDataFrame(queries, "repo string, query_id string, text string, vector array<double>, path_filter string, kind_filter string")
    v = spark.createDataFrame([(r, f"k{i}", [rng.random() for _ in range(3)]) for r in ("one", "two") for i in range(25)], "repo string, chunk_id string, embedding array<double>")
    nodes = spark.createDataFrame([(r, f"file:{p}", "FILE", p) for r in ("one", "two") for p in ("auth/login.py", "web/App.tsx", "x.py")], "repo string, id string, kind string, file_path string")
    edges = spark.createDataFrame([("one", "file:auth/login.py", "file:web/App.tsx"), ("two", "file:x.py", "file:auth/login.py")], "repo string, source string, target string")
    got = {}
    for r in batch.retrieve(q, c, 6, v, nodes, edges).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["chunk_id"], round(r["score"], 9), list(r["channels"])))
    for repo, ident, text, vector, _, kind in queries[1::3]:
        own = lambda df, repo=repo: df.where(F.col("repo") == repo).drop("repo")
        one = retrieval.retrieve(own(c), text, 6, own(v), vector, own(nodes), own(edges), kind_filter=kind).collect()
        assert sorted(got.get(ident, [])) == [(i, r["chunk_id"], round(r["score"], 9), list(r["channels"])) for i, r in enumerate(one, 1)], ident


def test_keys_kept_for_joins_are_as_large_as_their_files(spark):
    """A million keys packed into a few kilobytes would be broadcast; written plain, they are met by shuffles."""
    keys = spark.range(1_000_000).selectExpr("'repo' AS repo", "id DIV 100000 AS chunk_id")
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert size(kept(keys, "packed")) < 10 << 20 < size(kept(keys, "plain", plain=True))


@pytest.mark.parametrize("step", ["postings", "occurrences", "exact", "ranks"])
def test_tables_that_grow_with_the_chunks_are_plain(spark, monkeypatch, step):
    plain = {}
    for module in (batch, retrieval):
        monkeypatch.setattr(module, "kept", lambda df, name, plain_=False, **o: plain.__setitem__(name, o.get("plain", plain_)) or kept(df, name, **o))
    q = spark.createDataFrame([("one", "a", "login")], "repo string, query_id string, text string")
    assert batch.retrieve(q, table(spark), 3).count() == 3 and plain[step]
