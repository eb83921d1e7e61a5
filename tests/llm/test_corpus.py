import base64
import hashlib
import random
import re
import zlib
from itertools import combinations, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from codequarry.llm import bpe, decontam, html_extract, jaccard, langid, line_dedup, substring_dedup, token_files, topk, toxicity
from codequarry.llm.common import table

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, lang=None):
    """Texts under the ids 0.., with a clashing extra column."""
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t in enumerate(texts)], DOCS).withColumn("ids", F.lit(7)).withColumn("th", F.lit("x"))


def words_of(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, nulls, empty and junk texts."""
    rng = random.Random(5)
    base = [words_of(rng, rng.randrange(1, 160)) for _ in range(25)]
    passage = words_of(rng, 60)
    out = [" ".join(w) for w in base]
    out += [" ".join(base[3])] * 4 + [" ".join(base[4] + ["x", "y"])]
    for _ in range(6):
        near = list(base[7] * 2)
        near[rng.randrange(len(near))] = "changed"
        out.append(" ".join(near))
    out += [" ".join(base[10][:20] + passage + base[11][:20]), " ".join(passage[5:] + base[12]), "\n".join(base[13][:9]) + "\t a  b"]
    out += [None, "", "   ", "one", "one two", "go " * 90, ("a b c " * 30).strip(), "É Ünï code\x85x " * 12]
    return out


# byte-level BPE


def test_bpe_equals_tiktoken():
    codec = bpe.codec(RANKS, PATTERN)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    alphabet = ["a", "the", "é", "ß", "'s", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "12", ".", "日本", "\U0001f600", "aaaa", "́", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == reference.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_bpe_of_one_long_pre_token():
    codec = bpe.codec(RANKS, PATTERN)
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(3)
    for text in ("ab" * 20_000, "".join(rng.choice("abcdefgh") for _ in range(50_000)), " " * 10_000):
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    assert not any(codec.words)


def test_bpe_with_a_pattern_that_joins_lines():
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    codec = bpe.codec(RANKS, pattern)
    assert not codec.cut and bpe.codec(RANKS, PATTERN).cut
    reference = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["x();\n\ny", ""] + ["".join(rng.choice(["ab", "é", " ", "\n", "();", ".", ",", "12", "\t"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    assert codec.encode_all(pa.array(texts)).to_pylist() == [reference.encode_ordinary(t) for t in texts]


def test_bpe_ranks_that_no_training_gives():
    """Where a longer token has a lower rank than its parts, the queue goes back to it."""
    rng = random.Random(6)
    tokens = list({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))).encode() for _ in range(80)})
    rng.shuffle(tokens)
    codec = bpe.Codec({**{bytes([b]): b for b in range(256)}, **{t: 256 + i for i, t in enumerate(tokens)}}, PATTERN)

    def brute(piece):
        parts = [bytes([b]) for b in piece]
        while ranked := [(codec.ranks[x + y], i) for i, (x, y) in enumerate(pairwise(parts)) if x + y in codec.ranks]:
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [codec.ranks[p] for p in parts]

    pieces = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))).encode() for _ in range(400)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.merge(pieces)] == [brute(p) for p in pieces]


def test_bpe_round_trip_of_nulls_repeated_rows_and_clashes(spark):
    df = docs_of(spark, ["hello there", None, "", "hello there", "a " * 20_000]).withColumn("n_tokens", F.lit("clash"))
    out = bpe.round_trip(df.withColumn("doc_id", F.when(F.col("doc_id") != 2, F.col("doc_id"))), RANKS, PATTERN).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 5 and by[None]["n_tokens"] == by[1]["n_tokens"] == 0 and by[0]["ids"] == by[3]["ids"] and by[0]["th"] == "x"
    assert by[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest() and by[4]["decoded_sha256"] == hashlib.sha256(b"a " * 20_000).hexdigest()
    assert by[0]["ids_sha256"] == hashlib.sha256(np.array(by[0]["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN, with_ids=False).count() == 0


def test_bpe_columns_nulls_and_clashes(spark):
    df = docs_of(spark, ["hello there", None, "", "hello there"])
    out = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).withColumn("sha", bpe.ids_sha256("ids")).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]).decode() for r in out] == ["hello there", "", "", "hello there"]
    assert out[1]["ids"] == [] and out[0]["ids"] == out[3]["ids"] and out[0]["th"] == "x"
    assert out[0]["sha"] == hashlib.sha256(np.array(out[0]["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0


# substring dedup


def brute_substrings(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    where = {}
    for d, w in enumerate(words):
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), []).append((d, i))
    gone = [set() for _ in words]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    return {d: (len(w), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest()) for d, w in enumerate(words)}


@pytest.mark.parametrize("length", [35, 7, 2])
def test_substring_dedup_equals_brute_force(spark, corpus, length):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(docs_of(spark, corpus), length, (length + 1) // 2).collect()}
    assert got == brute_substrings(corpus, length)


def test_substring_dedup_goes_up_the_levels_and_ends_early(spark, corpus):
    trace = []
    rows = substring_dedup.dedup(docs_of(spark, corpus), 35, 5, trace=trace).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute_substrings(corpus, 35)
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] and r["lang"] is None and r["th"] == "x" for r in rows)
    assert substring_dedup.levels(35, 5) == [5, 9, 18, 35] and len(trace) == 3 and trace[0] >= trace[1] >= trace[2] > 0
    # a passage of 12 words repeats: windows of 5 and 9 words survive, those of 18 don't, and the last level sees nothing
    rng = random.Random(1)
    passage, trace = words_of(rng, 12), []
    texts = [" ".join(f"{i}x{j}" for j in range(40)) + " " + " ".join(passage) + " " + " ".join(f"{i}y{j}" for j in range(40)) for i in range(30)]
    assert sum(r["n_removed"] for r in substring_dedup.dedup(docs_of(spark, texts), 35, 5, trace=trace).collect()) == 0
    assert trace[0] > 0 and trace[-1] == 0
    trace = []
    assert substring_dedup.dedup(docs_of(spark, [" ".join(f"{i}x{j}" for j in range(90)) for i in range(9)]), 35, 5, trace=trace).count() == 9
    assert trace == [0]


def test_substring_dedup_of_null_keys_and_repeated_rows(spark):
    text = " ".join(str(i) for i in range(50))
    df = spark.createDataFrame([(None, text), (None, text), (1, text + " end"), (1, "short"), (1, "short")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(df).collect())
    assert got == [("1", 1, 0), ("1", 1, 0), ("1", 51, 50), ("None", 50, 50), ("None", 50, 50)]
    assert substring_dedup.dedup(df.limit(0)).count() == 0


# exact top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 8)).astype(np.float32).tolist()
    vectors[7] = vectors[8] = vectors[9] = vectors[0]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, []), (None, vectors[1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block=64, query_block=4).collect()))
    x = np.floor(256 * np.array(vectors, np.float64)).astype(int)
    want = []
    for q in range(0, 300, 50):
        best = sorted((-int(x[q] @ x[c]), c) for c in range(300) if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0
    assert topk.top_k(df.where("vec_id in (0, 1)"), F.col("vec_id") % 50 == 0, 5).count() == 1


def test_top_k_reads_lists_until_outsiders_cannot_qualify():
    rng = np.random.default_rng(2)
    # few components carry the score: the cursors pass the best candidates soon
    x = np.floor(256 * np.concatenate([rng.exponential(size=(4000, 3)) ** 3, rng.normal(size=(4000, 5)) / 100], axis=1))
    lists = topk.Lists(x, np.arange(4000))
    q = np.floor(256 * np.array([1, 2, 1, 0.01, 0, -0.01, 0.01, 0]))
    want = sorted((-int(s), i) for i, s in enumerate((x @ q).tolist()) if i != 9)[:5]
    ask = lambda q, own, lists, floor: topk.nra(q[None, :], np.array([own]), lists, 5, np.array([floor]))
    [(ids, scores)], reads = ask(q, 9, lists, -np.inf)
    assert topk._best(ids.tolist(), scores.tolist(), 5) == ([i for _, i in want], [-s for s, _ in want]) and 0 < reads[0] < 0.3 * 6 * 4000
    [(again, _)], fewer = ask(q, 9, lists, float(-want[-1][0]))
    assert set(ids) >= set(again) >= {i for _, i in want} and fewer[0] <= reads[0]
    # nothing tells candidates apart: the lists are read to their ends
    [(ids, scores)], reads = ask(np.ones(4), 0, topk.Lists(np.ones((300, 4)), np.arange(300)), -np.inf)
    assert topk._best(ids.tolist(), scores.tolist(), 5)[0] == [1, 2, 3, 4, 5] and reads[0] == 4 * 300
    # queries of one call stop by themselves
    found, reads = topk.nra(np.array([q, np.floor(256 * rng.normal(size=8))]), np.array([9, 5000]), lists, 5, np.full(2, -np.inf))
    assert reads[0] < reads[1] and {i for _, i in want} <= set(found[0][0])


def test_top_k_of_large_components_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [5e13, 1.0]), (2, [0.5, 3.0]), (2, [0.5, 3.0]), (2, [0.25, 1.0]), (3, [-5e13, 2.0]), (50, [2.0, 2.0]), (50, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    for sizes in ({}, {"block": 2, "query_block": 1}):
        got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, **sizes).collect()))
        v = {(i, tuple(int(np.floor(256 * c)) for c in x)) for i, x in rows}
        want = []
        for i, q in sorted(v):
            if i % 50 == 0:
                best = sorted({(-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in v if j != i})[:5]
                want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
        assert got == want
    big = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond the range of a long"):
        topk.top_k(big, F.col("vec_id") == 0, 5).collect()


# HTML extraction


PAGE = """<html><head><title>T</title><script>var a="</p>"</script></head><body><nav><a>Menu</a></nav><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p>One <b>two</b>
 three<br>four<p>Next</article><div class="comments">Nice</div><footer>F</footer></body></html>"""


def test_html_structure():
    assert [t for t, _ in html_extract.blocks(PAGE)] == ["Head & more", "One two three four", "Next"]
    assert [t for t, _ in html_extract.blocks("<article><p>cut off &eacute;")] == ["cut off é"]
    assert html_extract.blocks(None) == [] and [t for t, _ in html_extract.blocks("plain <i>text</i>")] == ["plain text"]


def texts_of(html):
    return [t for t, _ in html_extract.blocks(html)]


def test_html_structure_is_evidence_and_loses_no_text():
    long = "a long paragraph of the article " * 3
    assert texts_of(f'<div class="layout has-sidebar"><article><p>{long}</article></div>') == [long.strip()]
    assert texts_of(f'<div class="post no-ads"><p>{long}</div><div class="ads">Buy</div>') == [long.strip()]
    assert texts_of(f'<form action="/"><nav>Menu</nav><p>{long}</p></form>') == [long.strip()]
    assert texts_of(f'<article><div class="article-header"><h1>Title</h1></div><p class="alert">{long}</p></article>') == ["Title", long.strip()]
    assert texts_of(f"<nav><a>Menu</a><article><p>{long}</article>") == ["Menu", long.strip()]  # never closed: differencing decides about the menu
    assert texts_of(f"<form><input><p>{long}") == [long.strip()]
    assert texts_of(f'<div class="sidebar">{long}{long}</div><p>short') == [f"{long}{long}".strip(), "short"]
    assert texts_of(f'<article><header><h1>T</h1></header>{long}<div class="Comments">Nice</div><article class="comment">x</article></article>') == ["T", long.strip()]
    assert texts_of("<body><script>x<p>y</script><style>p</style><p>kept<template>t</template>") == ["kept"]


def test_html_differencing_equals_brute_force_over_whole_pages(spark):
    """No article elements: shared lines alone decide. Copies, wide frames, lone pages, ties of URLs, null URLs and repeated rows."""
    rng = random.Random(8)
    rows = []
    for host in ("h.example", "wide.example", "lone.example"):
        frame_ = [f"{host} line {i}" for i in range({"h.example": 3, "wide.example": 12, "lone.example": 2}[host])]
        for i in range(1 if host == "lone.example" else 9):
            own = [f"{host} {i} own {j}" for j in range(rng.randrange(4, 8))]
            lines = frame_[: len(frame_) // 2] + own + frame_[len(frame_) // 2 :]
            rows.append((len(rows), f"http://{host}/x/{i // 2}", "".join(f"<div>{x}</div>" for x in lines)))
    rows += [(len(rows), *rows[2][1:]), (len(rows) + 1, rows[2][1] + "z", rows[2][2]), (len(rows) + 2, None, "<p>no url"), (None, None, rows[0][2]), (None, None, rows[0][2]), (len(rows) + 5, "http://h.example/", "")]

    def brute_lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        i = j = 0
        out = []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append(i)
                i, j = i + 1, j + 1
            elif t[i + 1][j] >= t[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    pages = [(k, u, tuple(re.findall(r"<(?:div|p)>([^<]*)", h)), html_extract._place(u)) for k, u, h in rows]
    want = {}
    for host in {p[3][0] for p in pages}:
        first = {}
        for k, u, lines, (h, path) in pages:
            if h == host:
                at = (path, k is not None, k or 0)
                first[lines] = min(first.get(lines, at), at)
        distinct = sorted((at, lines) for lines, at in first.items())
        for n, (at, lines) in enumerate(distinct):
            beside = [distinct[m] for m in (n - 1, n + 1, n - 2, n + 2) if 0 <= m < len(distinct) and distinct[m][1]]
            gone, counts = None, {}
            for other in sorted(beside, key=lambda o: -html_extract._near(at[0], o[0][0])):
                shared = brute_lcs(lines, other[1])
                if 0 < len(shared) < len(lines) / 2:
                    gone = shared
                    break
                for i in shared:
                    counts[i] = counts.get(i, 0) + 1
            if gone is None:
                gone = [i for i, c in counts.items() if c > 1]
                gone = [] if len(gone) == len(lines) else gone
            want[host, lines] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(df).collect()
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got) == sorted((str(k), want[p[0], lines], len(want[p[0], lines])) for k, _, lines, p in pages)
    # without differencing the frames would stay
    assert any("h.example line" in h for _, u, h in rows if u) and not any("//h.example" in (r["url"] or "") and "h.example line" in r["text"] for r in got)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_lines_outside_the_article_are_decided_by_differencing(spark):
    page = lambda i: f"<div>Our site</div><h1>Title {i}</h1><article><p>Text {i}<p>Licence</article><div>Imprint</div>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()} == {i: f"Title {i}\nText {i}\nLicence" for i in range(6)}


def test_lcs_in_halves(monkeypatch):
    rng = random.Random(14)
    cases = [([rng.randrange(9) for _ in range(60)], [rng.randrange(9) for _ in range(70)]) for _ in range(60)]
    whole = [len(html_extract.lcs(a, b)) for a, b in cases]
    monkeypatch.setattr(html_extract, "TABLE_BITS", 300)
    for (a, b), n in zip(cases, whole, strict=True):
        at = html_extract.lcs(a, b)
        rest = iter(b)
        assert len(at) == n and at == sorted(set(at)) and all(any(y == a[i] for y in rest) for i in at)


def test_lcs_is_longest():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
        at = html_extract.lcs(a, b)
        assert len(at) == table_[-1][-1] and at == sorted(set(at))
        rest = iter(b)
        assert all(any(y == a[i] for y in rest) for i in at)


def test_html_differencing(spark):
    body = lambda own: f"<div>Site name</div><div>Welcome to us</div>{own}<div>All about us</div>"
    rows = [(1, "http://h.example/a/1", body("<div>Alpha</div><div>A1</div><div>A2</div><div>A3</div><div>A4</div>")), (2, "http://h.example/a/2", body("<div>Beta</div><div>B1</div><div>B2</div><div>B3</div><div>B4</div>")), (3, "http://other.example/a/1", body("<div>Alone</div>")), (4, None, None), (5, "http://h.example/a/2", PAGE)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[1] == "Alpha\nA1\nA2\nA3\nA4" and got[2] == "Beta\nB1\nB2\nB3\nB4"
    assert got[3] == "Site name\nWelcome to us\nAlone\nAll about us" and got[4] == "" and got[5].startswith("Head & more")


# line dedup


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice(["a", "b", "c", "d", ""]) for _ in range(rng.randrange(9))) for _ in range(60)] + [None, "", "a\nb\nc\nd"]
    seen, want = set(), {}
    for d, t in enumerate(texts):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        want[d] = (len(lines), len(gone), None if t is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup(docs_of(spark, texts), counts=True).collect()}
    assert got == want
    assert line_dedup.dedup(docs_of(spark, texts)).columns == docs_of(spark, texts).columns


def test_line_dedup_of_null_keys_repeated_rows_and_clashes(spark):
    text = "l1\nl2\nl3\nl4"
    rows = [(None, text), (1, text), (1, text), (2, "x\n" + text), (3, "y\n" * 30_000), (4, None), (5, "a\nb")]
    names = ["__key", "__th", "__own", "__n", "__gone", "own_0", "own_3", "n_lines"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("kept") for c in names})
    out = line_dedup.dedup(df)
    assert out.columns == df.columns
    got = sorted((str(r["doc_id"]), r["text"] if r["text"] is None else r["text"][:9]) for r in out.collect())
    assert got == [("1", ""), ("1", ""), ("2", "x"), ("3", "y\n"), ("4", None), ("5", "a\nb"), ("None", text[:9])]
    counted = line_dedup.dedup(df, counts=True).where("doc_id = 2").first()
    assert (counted["n_lines"], counted["n_removed"], counted["__key"]) == (5, 4, "kept")
    assert line_dedup.dedup(df.limit(0)).count() == 0


# toxicity


def test_html_wide_frames_and_copies(spark):
    """A frame of more than half the lines is deleted; copies on both sides of a page hide neither it nor the next page."""
    frame = [f"<div>menu {i}</div>" for i in range(6)]
    page = lambda i: "".join([*frame, *(f"<p>own {i} {j}</p>" for j in range(5)), "<div>foot</div>"])
    own = lambda i: "\n".join(f"own {i} {j}" for j in range(5))
    rows = [(k, f"http://h/p/{k:03d}", page(k // 9)) for k in range(36)]  # nine copies of each of four pages, side by side
    small = lambda i: f"<div>menu</div><p>a {i}</p><p>b {i}</p>"
    rows += [(100 + k, f"http://g/{k:03d}", small(k // 9)) for k in range(18)] + [(200, "http://two/1", page(1)), (201, "http://two/2", page(2))]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows) and all(got[k] == own(k // 9) for k in range(36))
    assert all(got[100 + k] == f"a {k // 9}\nb {k // 9}" for k in range(18))
    assert got[200].startswith("menu 0") and got[200].endswith("foot")  # one distinct page says nothing about a frame so wide


def test_levenshtein_automaton():
    lex = toxicity.Lexicon({"worthless": 2.0, "idiot": 3.0, "lostrang*": 1.0})
    assert lex.match("worthless") == (2.0, 0) and lex.match("wortless") == (2.0, 1) and lex.match("wrothless") is None
    assert lex.match("idiots") is None and lex.match("lostrangbc") == (1.0, 0) and lex.match("lostangbc") == (1.0, 1) and lex.match("plain") is None
    abuse, quote = lex.features("you are an idiot , idiot"), lex.features('he said the word "idiot" once')
    assert abuse[0] > 0 and abuse[1] == 0 and quote[1] > 0 and quote[0] == 0 and lex.features(None) == [0.0] * 6


def test_toxicity_held_out(spark):
    rng = random.Random(8)
    texts, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        texts.append(" ".join(words_of(rng, 40) + (["dreadful", "rascal"] if bad else [])))
        labels.append((i, 1, int(bad)))
    df = docs_of(spark, [*texts, None, ""])
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("k") % 2 == 0)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    assert all((got[i] >= 0.5) == (i % 5 == 0) for i in range(400)) and got[400] == got[401] < 0.5
    empty = toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"), F.lit(True))
    assert empty.score("anything") < 0.5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_toxicity_matches_equal_edit_distances():
    """The automaton along the trie finds just the entries that are within their edits, the fewest edits first."""
    rng = random.Random(31)
    for _ in range(40):
        entries = {}
        while len(entries) < 12:
            e = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 13)))
            entries[e + "*" * rng.randrange(2)] = float(rng.randrange(1, 9))
        lexicon = toxicity.Lexicon(entries)
        for _ in range(60):
            word = list(rng.choice(list(entries)).rstrip("*") + "".join(rng.choice("abc") for _ in range(rng.randrange(3))))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(word) + 1)
                word[at : at + rng.randrange(2)] = [rng.choice("abcd")] * rng.randrange(2)
            word = "".join(word)
            found = []
            for e, weight in entries.items():
                stem = e.rstrip("*")
                k = min(edits(stem, word[:n]) for n in range(len(word) + 1)) if e.endswith("*") else edits(stem, word)
                if k <= toxicity.allowed(e):
                    found.append((k, -weight))
            best = min(found, default=None)
            assert lexicon.match(word) == (best and (-best[1], best[0])), (word, entries)


def test_toxicity_of_null_keys_repeated_rows_and_long_texts(spark):
    rows = [(i, "you vilevile " + "calm word " * 5 if i % 2 else "calm word " * 6, "clash") for i in range(60)]
    rows += [(None, "you vilevile", "x"), (1, "you vilevile", "x"), (1, "you vilevile", "x"), (70, None, "x"), (71, "calm " * 40_000 + "you vilevile you vilevile", "x"), (72, "calm " * 40_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, lambda key: key >= 0)
    got = toxicity.score(df, model).collect()
    assert len(got) == len(rows) and all((r["score"] >= 0.5) == ("vile" in (r["text"] or "")) for r in got if len(r["text"] or "") < 1000)
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_lexicon_is_whole(spark):
    """Stems of 6 and 7 letters have their edit; terms of few toxic rows and entries past the hundredth stay."""
    stems = toxicity.Lexicon({"wretch*": 1.0, "scoundr*": 2.0})
    assert stems.match("wrtchedly") == (1.0, 1) and stems.match("scoundrels") == (2.0, 0) and stems.match("scuondrels") is None and stems.match("scondrels") == (2.0, 1)
    rng = random.Random(9)
    heads = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]  # 150 terms without common stems, each in four toxic rows
    terms = [h + h[::-1] + h for h in heads]
    texts = [" ".join(words_of(rng, 30) + [terms[i // 4]] * 2) for i in range(600)] + [" ".join(words_of(rng, 30)) for _ in range(600)]
    df = docs_of(spark, texts)
    model = toxicity.fit(df, spark.createDataFrame([(i, 1, int(i < 600)) for i in range(1200)], "doc_id long, quality int, toxic int"), F.lit(True))
    assert all(model.lexicon.match(t) for t in terms) and len(model.entries) > 100
    assert all(model.score(x) >= 0.5 for x in texts[:600]) and not any(model.score(x) >= 0.5 for x in texts[600:])


# decontamination


def brute_contamination(texts, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, found = split(t), set(), set()
        for win, ids in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= ids
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_equals_brute_force(spark, corpus):
    rng = random.Random(9)
    long_item = words_of(rng, 30)
    items = [(1, " ".join(long_item)), (10, "one two"), (2, "W3 w3-W3"), (3, None), (4, ""), (5, "nowhere " * 20), (6, " ".join(long_item[5:25])), (7, "go " * 40)]
    texts = [*corpus, " ".join(words_of(rng, 50) + long_item[2:20] + words_of(rng, 30)), "x " + "One, TWO! " * 3, "w3 w3 w3 w3", " ".join(long_item).upper()]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.contamination(docs_of(spark, texts), bench).collect()}
    want = brute_contamination(texts, items)
    assert got == want
    clean = {r["doc_id"] for r in decontam.clean(docs_of(spark, texts), bench).collect()}
    assert clean == {d for d, x in want.items() if not x[4]}
    assert decontam.contamination(docs_of(spark, texts), bench.limit(0)).where("n_hit > 0").count() == 0


def brute_near(texts, items, rarest, span):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    docs = [split(t) for t in texts]
    count = {}
    for w in docs:
        for x in w:
            count[x] = count.get(x, 0) + 1
    out = {d: set() for d in range(len(docs))}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 12) if w and i is not None else 0):
            terms = sorted({(count[x], x) for x in w[s : s + 13] if x in count})[:rarest]
            for d, words in enumerate(docs):
                places = [[p for p, x in enumerate(words) if x == t] for _, t in terms]
                if terms and any(all(any(abs(p - q) < span for q in at) for at in places[1:]) for p in places[0]):
                    out[d].add(i)
    return {d: len(x) for d, x in out.items()}


def test_decontamination_by_proximity(spark):
    rng = random.Random(21)
    item = [f"q{i}" for i in range(16)]
    loose = item[:5] + ["inserted"] + item[5:9] + ["two", "more"] + item[9:]
    texts = [" ".join(words_of(rng, 40) + x + words_of(rng, 40)) for x in (item, loose, item[:8] + words_of(rng, 60) + item[8:], list(reversed(item)), [])] + [None, "q3 q3", " ".join(item[:6] + ["q6q"] + item[7:])]
    items = [(1, " ".join(item)), (2, " ".join(item[:3])), (3, "q3"), (4, None), (5, "unknown q1 words"), (None, "q1"), (6, " ".join(words_of(rng, 40)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.contamination(docs_of(spark, texts), bench, slop=4, rarest=3).collect()
    assert {r["doc_id"]: r["n_near"] for r in rows} == brute_near(texts, items, 3, 17)
    want = brute_contamination(texts, [x for x in items if x[0] is not None])
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in rows} == {d: x[:3] for d, x in want.items()}
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["n_items"] < by[1]["n_near"]


def test_decontamination_of_shared_windows_null_keys_and_clashes(spark):
    """Many items of one text, repeated rows, null keys, and documents with columns of internal names."""
    text = "a b c d e f g h i j k l m n o p"
    items = [(i, text) for i in range(40)] + [(99, "the")]
    rows = [(None, text), (None, text), (1, "the the " * 9), (1, "the the " * 9), (2, "nothing here"), (3, "x " * 50_000 + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("own_0", "d", "h", "w", "p", "t", "__key", "__th")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.contamination(df, bench).collect())
    assert got == [("1", 18, 18, 1, True)] * 2 + [("2", 2, 0, 0, False), ("3", 50_016, 16, 40, False)] + [("None", 16, 16, 40, True)] * 2
    kept = decontam.clean(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert decontam.contamination(df.limit(0), bench).count() == 0


def test_decontamination_plan_is_native(spark, corpus):
    plan = decontam.contamination(docs_of(spark, corpus), spark.createDataFrame([(1, "one two")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# n-gram Jaccard join


def test_jaccard_of_a_large_group_of_near_and_not_so_near_copies(spark):
    """One base with copies at every distance: buckets are large, some copies link, some don't, and no pair is lost."""
    rng = random.Random(41)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(160):
        w = list(base)
        for j in rng.sample(range(120), rng.randrange(0, 14)):
            w[j] = f"x{i}y{j}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.sample(base, 120)) for _ in range(20)] + [None, "", "b0 b1"]
    for percent, n, hubs in ((90, 3, 4), (80, 5, 1)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs_of(spark, texts), percent, n, hubs=hubs).collect()}
        assert got == brute_groups(texts, percent, n)


def test_jaccard_filters_lose_no_similar_pair():
    rng = random.Random(43)
    for _ in range(300):
        n = rng.randrange(2, 120)
        x = np.array(rng.sample(range(1, 2**40), n), np.uint64)
        change = rng.randrange(0, max(1, n // 8) + 1)
        y = np.concatenate([x[change:], np.array(rng.sample(range(2**41, 2**42), rng.randrange(0, change + 1)), np.uint64)])
        same = len(set(x.tolist()) & set(y.tolist()))
        for percent in (80, 90):
            if len(y) and 100 * same >= percent * (len(x) + len(y) - same):
                assert jaccard.may_be_similar(jaccard.sketch(x, percent), jaccard.sketch(y, percent), len(x), len(y), percent)


def test_jaccard_of_null_keys_and_clashing_columns(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a), (None, a + " end"), (None, b), (5, b), (5, b), (6, b + " end"), (7, c), (None, None), (8, "x " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("own_0", "own_1", "r1", "r2", "__rh", "__own", "label", "c", "n")})
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns
    texts = sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect())
    assert len(texts) == 6 and [k for k, _ in texts] == ["5", "5", "7", "8", "None", "None"]  # one of the two nameless copies, and the null text


def brute_groups(texts, percent, n):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in enumerate(sets)}


@pytest.mark.parametrize(("percent", "n", "hubs"), [(90, 3, 4), (80, 5, 4), (50, 1, 1)])
def test_jaccard_groups_equal_brute_force(spark, corpus, percent, n, hubs):
    rng = random.Random(10)
    chain = words_of(rng, 120)
    texts = list(corpus)
    for _ in range(10):  # neighbours alike, ends not
        chain[rng.randrange(len(chain))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs_of(spark, texts), percent, n, hubs=hubs).collect()}
    assert got == brute_groups(texts, percent, n)


def test_jaccard_representatives_and_nulls(spark):
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (3, "A b c d"), (9, None), (8, ""), (3, "A b c d")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in jaccard.representatives(df).collect()) == ["3", "3", "8", "9"]
    assert jaccard.groups(df.limit(0)).count() == 0


# token files


def test_token_files_round_trip(spark, corpus, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write(docs_of(spark, corpus), folder, path, end_id=1, shards=3)
    rows = token_files.read(spark, manifest, folder).orderBy("doc_id").collect()
    from tokenizers import Tokenizer

    own, start = Tokenizer.from_file(path), 0
    for r, t in zip(rows, corpus, strict=True):
        want = own.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["ids"], r["start"]) == (want, start), t
        start += len(want)
    shard = manifest.orderBy("shard").first()
    fs, root = token_files._store(folder)
    dictionary = open(f"{tmp_path}/ids/dictionary.bin", "rb").read()
    assert token_files.Shard(fs, shard["path"], dictionary).ids(2).tolist() == rows[2]["ids"]
    with pytest.raises(ValueError, match="another dictionary"):
        token_files.Shard(fs, shard["path"], dictionary + b"x")
    assert token_files.read(spark, token_files.write(docs_of(spark, corpus).limit(0), folder + "0", path, 1), folder + "0").count() == 0


def test_word_batches_equal_the_library():
    enc = token_files._Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(11)
    alphabet = ["a", "É", "'s", " ", "  ", "\n", "\t", "\x01", "\x85", "1", ".", "日", "İ", "é", "́", "Σ", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(1500)]
    for t, x in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(x, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_token_files_of_a_tokenizer_that_keeps_blanks(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = token_files._Encoder(path)
    assert not enc.parted
    texts = ["two  blanks \n and lines\n\n", None, "", "x y", "x y", "long " * 30_000]
    df = spark.createDataFrame([(None if i == 3 else i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, start string")
    manifest = token_files.write(df, f"file://{tmp_path}/ids", path, end_id=1, shards=2)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["ids"]) for r in token_files.read(spark, manifest, f"file://{tmp_path}/ids").collect()))
    want = sorted((-1 if i == 3 else i, enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in enumerate(texts))
    assert got == want


# language identification


def test_language_id(spark):
    rng = random.Random(12)
    sound = {"en": ["the", "ing", "wh", "sh"], "de": ["sch", "ung", "ei", "ß"], "fr": ["eau", "oi", "ç", "qu"]}
    rows = [(i, " ".join("".join(rng.choice(sound[x]) for _ in range(3)) for _ in range(30)), x) for i in range(150) for x in (list(sound)[i % 3],)]
    df = spark.createDataFrame([*rows, (900, None, "en"), (901, "12 34 !", "de"), (902, "", None), (903, "a", None)], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = langid.fit(df.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(df, model).collect()}
    assert all(got[i][0] == x for i, _, x in rows) and all(0 <= s <= 1 for _, s in got.values())
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] in sound
    assert langid.fit(df.limit(0)).predict("the") == ("und", 0.0)


def test_language_filters_hold_all_their_ngrams(spark):
    """The bit-sliced filters say yes for every n-gram put in, and the corrected counts are near the exact sets'."""
    rng = random.Random(17)
    sound = {"aa": "abcdefg", "bb": "efghijk", "cc": "ijklmno"}
    rows = [(i, " ".join("".join(rng.choice(sound[x]) for _ in range(rng.randrange(3, 8))) for _ in range(80)), x) for i in range(90) for x in (list(sound)[i % 3],)]
    rows += [(None, rows[0][1], "aa"), (0, rows[0][1], "aa"), (200, "abc " * 50_000, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    model = langid.fit(df, per_lang=100_000)
    use = {x: {} for x in sound}
    for _, t, x in {r[:3] for r in rows}:
        g, n = np.unique(langid.ngrams(t, model.sizes), return_counts=True)
        for h, c in zip(g.tolist(), (n / n.sum()).tolist(), strict=True):
            use[x][h] = use[x].get(h, 0) + c
    total = {x: sum(u.values()) for x, u in use.items()}
    share = {x: {h: c / total[x] for h, c in u.items()} for x, u in use.items()}
    sets = {x: {h for h, c in u.items() if c >= 0.51 * sum(share[y].get(h, 0) for y in sound)} for x, u in share.items()}
    masks = {x: 1 << i for i, x in enumerate(model.langs)}
    for x, own in sets.items():
        h = np.array(sorted(own), np.uint64)
        held = np.full(len(h), 2**64 - 1, np.uint64)
        for j in range(model.k):
            held &= model.slots[0][model.slot(h, j)]
        assert (held & np.uint64(masks[x]) != 0).mean() > 0.999
    right = 0
    for r in langid.predict(df, model).collect():
        g = langid.ngrams(r["text"], model.sizes).tolist()
        counts = {x: sum(h in sets[x] for h in g) for x in sound}
        right += r["lang_pred"] == max(counts, key=counts.get) == r["lang"]
    assert right == len(rows)
    assert langid.predict(df.limit(0), model).count() == 0


# queries and pipeline


def test_queries_match_their_sql(spark):
    import duckdb

    from codequarry.llm import queries

    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{where}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.execute(sql).df()
        got = queries.queries()[name](spark, where).toPandas()
        cols = sorted(want.columns)
        assert sorted(got.columns) == cols, name
        assert sorted(map(tuple, got[cols].astype(str).to_numpy())) == sorted(map(tuple, want[cols].astype(str).to_numpy())), name


def test_contract_columns(spark):
    from codequarry.llm import queries

    where = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in table(spark, where, "documents").collect()}
    codec = bpe.codec(RANKS, PATTERN)
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    assert ranks == codec.ranks
    for r in queries.op1_bpe(spark, where).collect():
        ids = codec.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    rows = queries.op10_langid(spark, where).collect()
    assert len(rows) == len(texts) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    rows = queries.op6_toxicity(spark, where).collect()
    assert len(rows) == len(texts) and all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    start = 0
    for r in sorted(queries.op9_token_files(spark, where).collect(), key=lambda r: r["doc_id"]):
        assert r["start"] == start
        start += r["n_tokens"]
    assert queries.op4_html_extract(spark, where).count() == table(spark, where, "pages").count()


def test_pipeline_stages(spark):
    import corpus_pipeline
    from codequarry.llm.common import written

    where = "/root/testdata/sf0.001"
    docs = table(spark, where, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = written(stage(spark, docs, where), name)
        after = {r["doc_id"] for r in docs.collect()}
        assert after <= set(before)
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "ngram_jaccard_join":
            ids = sorted(before)
            want = brute_groups([before[i] for i in ids], 80, 5)
            assert after == {ids[d] for d, (n, c) in want.items() if n == 0 or c == d}
        if name == "benchmark_decontamination":
            ids = sorted(before)
            bench = [tuple(r) for r in table(spark, where, "benchmark").select("item_id", "text").collect()]
            want = brute_contamination([before[i] for i in ids], bench)
            assert after == {ids[d] for d, x in want.items() if not x[4]}
        if name in ("line_dedup", "byte_bpe"):
            assert after == set(before)


def test_jaccard_usual_tokens_beyond_the_counted_ones_keep_out_of_prefixes(spark, monkeypatch):
    """A corpus with more repeated tokens than the table of counts holds: its documents don't go on to the second order for that."""
    rng = random.Random(8)
    phrases = [" ".join(f"p{k}_{i}" for i in range(6)) for k in range(120)]
    docs = [(i, " ".join([f"w{rng.random()}" for _ in range(300)] + rng.sample(phrases, 8))) for i in range(300)]
    docs.append((300, docs[0][1] + " more"))
    crowded, plain = [], jaccard.written

    def seen(df, name):
        out = plain(df, name)
        crowded.extend([out.count()] if name == "many" else [])
        return out

    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    monkeypatch.setattr(jaccard, "written", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(300)} | {300: 0}
    assert crowded[0] < 30
