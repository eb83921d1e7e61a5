"""Source divergence, SimHash groups and conversation repair, each against a brute-force version."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from functools import cache
from itertools import pairwise

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from codequarry.llm import bpe, conversations, divergence, queries, simhash, token_files, topk, toxicity, units

# source divergence

TEXTS = "doc_id long, text string, lang string, source string"


def test_divergence_equals_its_sql_on_nulls_ties_and_clashes(spark):
    rng = random.Random(1)
    words = ["Alpha", "alpha", "BETA", "École", "école", "ÉCOLE", "İx", "ﬀ", "x1y", "\U0001d538b", "über", "z", "Z"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "é", "Z", None])) for i in range(300)]
    rows += [(None, None, "en", "only"), (7, "", "xx", "p"), (7, "rare words", "xx", "q"), (7, "rare words", "xx", "q"), (8, "12 34", "xx", None), (9, "alpha " * 30_000, "en", "a")]
    df = spark.createDataFrame(rows, TEXTS)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    want = sorted(map(tuple, con.execute(queries.OP11_SQL).fetchall()))
    clash = df.withColumns({x: F.lit("clash") for x in ("term", "n", "p", "w", "docs", "item", "rank", "v", "total")})
    got = divergence.audit(clash).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == want and {r[2] for r in want} == {"pair", "term"}
    assert {(r["lang"], r["source"], r["item"], r["value"]) for r in got if r["lang"] == "xx" and r["source"] == "p"} == {("xx", "p", "q", 0), ("xx", "p", "", 0)}
    assert divergence.audit(df.limit(0)).count() == 0


def test_divergence_is_exact_in_large_numbers(spark):
    groups = spark.createDataFrame([("x", "a"), ("x", "b")], "lang string, source string")
    many = 3 * 10**14
    counted = spark.createDataFrame([("x", "a", "t", many + 1, 10), ("x", "b", "t", many, 10), ("x", "b", "u", 1, 10), ("x", "a", "v", 5, 9)], "lang string, source string, term string, n long, docs long")
    parties, terms, dense = divergence.shares(groups, counted, 10)
    got = {(r["source"], r["term"]): r["p"] for r in dense.join(parties, "g").join(terms.drop("lang"), "t").collect()}
    share = lambda n, total: 1 + int(Fraction(10**9 * (n + 2), total + 4))
    assert got == {("a", "t"): share(many + 1, many + 1), ("a", "u"): share(0, many + 1), ("b", "t"): share(many, many + 1), ("b", "u"): share(1, many + 1), (None, "t"): share(2 * many + 1, 2 * many + 2), (None, "u"): share(1, 2 * many + 2)}


# SimHash


def brute_fingerprint(text, n=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_classes(marks):
    """The least of each group linked by two differing bits or fewer."""
    label = {x: x for x in marks}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in label:
        for b in label:
            if a < b and (a ^ b).bit_count() <= 2:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {x: root(x) for x in label}


def test_simhash_fingerprint_equals_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "one TWO", "É x\x85y\xa0z b", "a b a b a b " * 40]
    texts += ["".join(rng.choice(["Ab", "c", "ß", " ", "\t", "\n", "\x0b", "\x1c", "日"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    want = [brute_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.where("t is not null").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r["h"] % 2**64 == xxhash.xxh64_intdigest(r["t"].encode(), simhash.SEED) for r in same)
    monkeypatch.setattr(simhash, "PIECE", 5)
    assert [simhash.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("width", [2, 4, 8])
def test_simhash_cells_bound_the_distance(spark, width):
    rng = random.Random(width)
    marks = [0, 2**64 - 1, 2**63] + [rng.getrandbits(64) for _ in range(60)]
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    df = spark.createDataFrame([(m,) for m in signed], "fp long").withColumn("p", simhash.point(F.col("fp"), width))
    lanes = lambda x: [x >> s & ((1 << width) - 1) for s in range(0, 64, width)]
    for r in df.withColumn("z", simhash.cells("p", width)).collect():
        want = [x.bit_count() for x in lanes(r["fp"] % 2**64)]
        assert lanes(r["p"] % 2**64) == want
        around = [lanes(z % 2**64) for z in r["z"]]
        assert all(sum(abs(x - y) for x, y in zip(z, want, strict=True)) <= 1 and 0 <= min(z) and max(z) <= width for z in around)
        assert len({tuple(z) for z in around}) == len(around) == 1 + sum((x < width) + (x > 0) for x in want)


@pytest.mark.parametrize(("width", "crowd"), [(4, 32), (8, 2), (2, 3)])
def test_simhash_links_equal_brute_force(spark, width, crowd):
    rng = random.Random(3)
    hearts = [rng.getrandbits(64) for _ in range(6)]
    marks = {0, 1, 3, 7, 15, 2**64 - 1, 2**64 - 4}
    for h in hearts:
        spots = rng.sample(range(64), 8)
        marks |= {h} | {h ^ sum(1 << s for s in rng.sample(spots, rng.randrange(1, 7))) for _ in range(40)}
    signed = {m: m - 2**64 if m >= 2**63 else m for m in marks}
    df = spark.createDataFrame([(m,) for m in signed.values()], "fp long")
    found = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links(df, width, crowd).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in found)
    label = {m: m for m in marks}
    changed = True
    while changed:
        changed = False
        for a, b in found:
            low = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = low
    assert label == brute_classes(marks)


def test_simhash_groups_of_nulls_repeated_rows_and_clashes(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(150)) for _ in range(12)]
    texts = base + [base[0]] * 3 + [base[1] + " end", base[2].replace(" ", "\n  ").upper(), None, "", "\t", "solo", "x " * 300_000]
    texts += [" ".join([*base[3].split()[:k], "new", *base[3].split()[k + 1 :]]) for k in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, base[0]), (None, base[5]), (None, "nobody else's words"), (-4, base[6])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({x: F.lit("clash") for x in ("fp", "label", "least", "z", "component_id", "fingerprint")})
    got = sorted(map(tuple, simhash.groups(df, crowd=4).collect()), key=str)
    marks = [(k, brute_fingerprint(t)) for k, t in rows]
    classes = brute_classes({m for _, m in marks})
    least = {}
    for k, m in marks:
        if k is not None:
            least[classes[m]] = min(k, least.get(classes[m], k))
    assert got == sorted(((k, f"{m:016x}", least.get(classes[m])) for k, m in marks), key=str)
    assert len({c for *_, c in got}) < len(texts) - 5 and any(k is None and c is None for k, _, c in got)
    assert simhash.groups(df.limit(0)).count() == 0


# conversation repair


def broken(rows):
    """Rows (conv, turn, role, text) after damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(rows):
    """Counts, cost, audit and repaired turns of rows (turn, role, text) in order, by trying every edit."""
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\f\r")
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials))

    def accepts(word):
        return re.fullmatch("(s?(ua)+)?", word) is not None

    def could(word):
        return re.fullmatch("(s?(ua)*u?)", word) is not None

    @cache
    def best(i, word, put):
        """(cost, edits, turns) of the cheapest way from row i on behind the last two initials of what is there; put: insertions just made."""
        tried = [(0, "", ())] if i == len(rows) and accepts(word) else []

        def add(cost, edit, role, text, j, more):
            word2 = word + role[:1]
            if could(word2):
                # of a long word only its end and whether it begins with s matter
                rest = best(j, word2 if len(word2) < 4 else word2[:-2], more)
                if rest:
                    tried.append((cost + rest[0], edit + rest[1], ((role, text), *rest[2])))

        if put < 3:
            for role in ("user", "assistant"):
                add(3, "I", role, "", i, put + 1)
        if i < len(rows):
            _, role, text = rows[i]
            rest = best(i + 1, word, 0)
            if rest:
                tried.append((4 + rest[0], "D" + rest[1], rest[2]))
            if faults[i] not in ("blank", "duplicate"):
                own = 3 * (faults[i] == "truncated")
                if role[:1]:
                    add(own, "K", role, text, i + 1, 0)
                for new in ("user", "assistant"):
                    add(3 + own, "R", new, text, i + 1, 0)
        return min(tried) if tried else None

    cost, audit, made = best(0, "", 0)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest


def random_rows(rng, convs, most):
    rows = []
    for c in range(convs):
        roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "system", "tool", None, ""]])
        for t in range(rng.randrange(most)):
            text = rng.choice(["Fine.", "Fine.", f"Said {rng.randrange(9)}!", "Cut off", "ends? \n\t", "é.", "  ", "", None, "..."])
            rows.append((None if c == 3 else c, t + (t > 4) * rng.randrange(3), rng.choice(roles), text))
    return rows


@pytest.mark.parametrize("piece", [1 << 14, 3])
def test_conversations_equal_brute_force(spark, piece):
    rng = random.Random(5)
    rows = random_rows(rng, 120, 12)
    rows += [(500, t, "user" if t % 2 else "assistant", f"Turn {t}." if t % 7 else "cut") for t in range(60)]
    rows += [(None, 20, "user", "Hi."), (None, 21, "assistant", "Yes"), (501, None, "user", "One."), (502, 2**40, "user", "Far."), (502, 1, "assistant", "Near.")]
    rows = list(dict.fromkeys(rows))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit("clash") for x in ("conv", "part", "seq", "n", "fault", "k1", "x1", "damage_copy_", "audit")})
    repaired = conversations.repair(conversations.damage(df), piece=piece)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.summary(df, repaired).collect()}
    want = {}
    for conv, own in broken(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        if len({r[0] for r in own}) == len({r for r in own}):  # order of one turn's different rows is by hash
            want[conv] = brute_repair(own)
    assert set(want) <= set(got) and len(got) == len({r[0] for r in rows}) and len(want) > 60 and None in got
    assert {k: got[k] for k in want} == want
    words = "".join(audit for *_, audit, _ in want.values())
    assert set(words) == set("KRDI")


def test_conversations_split_over_pieces_and_partitions_are_repaired_alike(spark):
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"So {t}.", f"No {t}", " "])) for t in range(3000)] + random_rows(rng, 30, 9)
    rows += [(2, None, "user", "Same.")] * 500 + [(2, 5, "assistant", "cut")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole, cut = (conversations.repair(df, piece=p) for p in (1 << 14, 50))
    assert cut.turns.select("part", "seq").distinct().count() > 30
    a, b = (sorted(map(tuple, conversations.summary(df, x).collect()), key=str) for x in (whole, cut))
    assert a == b
    two = next(r for r in a if r[0] == 2)
    assert two[1:8] == (0, 0, 501, 1, 501, 4 * 501 + 3, "K" + "D" * 499 + "K" + "DD")


def test_conversations_empty_or_dropped(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.summary(df, conversations.repair(conversations.damage(df))).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(gone, 0, "user", "Hello."), (-1, None, "user", "x." * 300_000)], df.schema)
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.summary(one, conversations.repair(conversations.damage(one))).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[-1] == brute_repair(broken([(-1, None, "user", "x." * 300_000)])[-1])


def test_conversation_tables_walks_and_chains_agree():
    rng = random.Random(7)
    for _ in range(200):
        turns = [(rng.choice("sua-"), rng.random() < 0.3) for _ in range(rng.randrange(1, 9))]
        at = rng.randrange(len(turns) + 1)
        after = conversations.END
        costs = list(after)
        for t in reversed(turns):
            after, least = conversations.back(*t, after)
        for part in (turns[at:], turns[:at]):
            costs = conversations.closed((conversations.table_of(part) + costs).min(axis=1).tolist()) if part else costs
        assert tuple(c - min(costs) for c in costs) == after
        edits, state = conversations.walk(turns, conversations.END, 0)
        audit = "".join(edits) + conversations.ending(state)
        assert conversations.END[state] < conversations.INF and set(audit) <= set("KRDI")


# repeated ids, large strings, added tokens


def test_top_k_of_repeated_ids_is_whole_in_any_blocks(spark):
    rng = np.random.default_rng(8)
    rows = [(0, [1.0, 1.0])] + [(7, [4.0 + i, 4.0 - i]) for i in range(40)] + [(100 + i, rng.normal(size=2).tolist()) for i in range(400)] + [(9, [3.0, 3.0]), (9, [2.0, 4.0]), (9, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = sorted({(-int(x[0][1] @ v), i) for i, v in x if i != 0})[:5]
    for block in (8192, 20, 3):
        got = topk.top_k(df, F.col("vec_id") == 0, 5, block=block).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]


def test_texts_with_64_bit_ends_encode_alike(spark):
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["hello there, world", "", "É x. y, z", "a " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = "spark.sql.execution.arrow.useLargeVarTypes"
    seen = []
    for large in ("false", "true"):
        spark.conf.set(own, large)
        try:
            one = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in bpe.round_trip(df, ranks, pattern).collect()}
            folder = token_files.default_folder(spark)
            manifest = token_files.write(df, folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
            two = {r["doc_id"]: list(r["ids"]) for r in token_files.read(spark, manifest, folder).collect()}
        finally:
            spark.conf.set(own, "false")
        seen.append((one, two))
    assert seen[0] == seen[1] and seen[0][0][0][0] > 0 and len(seen[0][1][3]) > 5000
    with pytest.raises(TypeError, match="not strings"):
        units.stretches(pa.array([b"x"]))


def test_added_tokens_that_blanks_do_not_part():
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert token_files.parted_by_blanks(spec)
    token = {"id": 10**6, "content": "<x>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    for content, ok in (("<x>", True), ("<a.b>", False), ("Mr,", False), ("a b", False), ("1.5", True)):
        assert token_files.parted_by_blanks(spec | {"added_tokens": [*spec["added_tokens"], token | {"content": content}]}) == ok


# toxicity lexicons of any size


def test_toxicity_lexicon_grows_in_proportion():
    import sys
    import time

    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(4, 14)))
    entries = {word() + rng.choice(["", "*"]): rng.random() for _ in range(50_000)}
    began = time.time()
    lexicon = toxicity.Lexicon(entries)
    assert time.time() - began < 30
    size, todo = 0, [lexicon.root]
    while todo:
        node = todo.pop()
        size += sys.getsizeof(node) + sys.getsizeof(node[0]) + 2 * 32
        todo += node[0].values()
    assert size < 250 << 20  # without entries as bits; those took 1.5 GB
    few = dict(list(entries.items())[:300])
    small = toxicity.Lexicon(few)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, d in enumerate(b, 1):
                row[j] = min(row[j - 1] + 1, last[j] + 1, last[j - 1] + (c != d))
        return row

    for _ in range(300):
        w = list(rng.choice(sorted(few)).rstrip("*"))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice("abcq")
        w = "".join(w) + rng.choice(["", "ab"])
        found = []
        for e, weight in few.items():
            row = distance(e.rstrip("*"), w)
            edits = min(row) if e.endswith("*") else row[-1]
            if edits <= toxicity.allowed(e):
                found.append((edits, -weight))
        got = small.match(w)
        assert (None if got is None else (got[1], -got[0])) == (min(found) if found else None), w


def test_toxicity_choice_equals_comparing_all():
    rng = random.Random(11)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "*"]), rng.randrange(3, 60), rng.randrange(3)) for _ in range(400)]
    rows = list({r[0]: r for r in rows}.values())
    out = {}
    scored = []
    for term, a, b in rows:
        lift = __import__("math").log((a + 0.5) / 101 / ((b + 0.5) / 201))
        scored.append((a * lift, len(term.rstrip("*")), not term.endswith("*"), term, lift, a))
    for _, _, _, term, lift, a in sorted(scored, reverse=True):
        stem = term.rstrip("*")
        if any(stem.startswith(x.rstrip("*")) for x in out if x.endswith("*")) or any(x.startswith(stem) and 0.9 * a <= n for x, (_, n) in out.items()):
            continue
        out[term] = (lift, a)
    assert toxicity._choose(rows, 100, 200, None) == {t: x for t, (x, _) in out.items()} and 5 < len(out) < len(rows)
