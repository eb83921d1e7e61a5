"""Toxicity by Levenshtein automata over a lexicon trie, with context windows.

The lexicon is learned: words, and stems (marked *) that open many words, which
labelled toxic texts use far more than clean ones. It forms a trie. A word of a
text is matched by running its Levenshtein automaton, whose states are rows of
the edit table bounded by the distance allowed, along the trie; branches die as
soon as no entry below can still be reached. So misspelled terms count, too.
Each hit is scored in its window of words: inside quotation marks or near words of
reporting it counts as quotation, near words of address or other hits as abuse.
A logistic regression over the window scores gives the score.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import claim, ship, slices, with_fields

#: Words of reporting and of address in five languages: fixed values of this model, not learned.
REPORTING = frozenset("said says called calls quoted quote word term wrote dit mot citation sagte wort zitat dijo palabra cita".split())
ADDRESS = frozenset("you your youre u ur tu te toi vous du dich dir ihr usted ustedes ti".split())
WINDOW = 8
#: Distinct words a Python worker keeps with their hits; when full, the cache starts anew.
CACHE = 200_000
_WORDS = re.compile(r"[^\W_]+").findall
_TOKENS = re.compile(r"[^\W_]+|[\"“”„«»]").findall
N_FEATURES = 6


def allowed(entry: str) -> int:
    """Edits allowed for an entry: none below 6 letters, 1 below 10, else 2."""
    n = len(entry.rstrip("*"))
    return 0 if n < 6 else 1 if n < 10 else 2


class Lexicon:
    """Trie of entries with weights. A node: [children, (weight, edits) of a word, same of a stem, edits allowed below, first entry below, last entry below].

    Entries are numbered in the trie's order, so those below a node are a range of numbers, whatever the lexicon's size.
    """

    def __init__(self, entries: dict[str, float]):
        self.root: list = [{}, None, None, 0, 0, len(entries) - 1]
        self.exact = dict(entries)
        self.stems = sorted({len(e) - 1 for e in entries if e.endswith("*")})
        pieces: dict[str, list[tuple[int, int, int]]] = {}
        for number, entry in enumerate(sorted(entries, key=lambda e: (e.rstrip("*"), e))):
            stem, k = entry.rstrip("*"), allowed(entry)
            node = self.root
            node[3] = max(node[3], k)
            for c in stem:
                node = node[0].setdefault(c, [{}, None, None, 0, number, number])
                node[3] = max(node[3], k)
                node[5] = number
            node[2 if entry.endswith("*") else 1] = (entries[entry], k)
            cuts = [round(i * len(stem) / (k + 1)) for i in range(k + 2)] if k else []
            for x, y in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(stem[x:y], []).append((x, k, number))
        self.pieces = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.pieces.add_word(piece, (len(piece), places))
        self.pieces.make_automaton()
        self.cache: dict[str, tuple[float, int] | None] = {}

    def near(self, word: str) -> list[int]:
        """Numbers, rising, of the entries that have a piece about where it should stand: k edits leave one of k + 1 pieces whole."""
        return sorted({number for end, (n, places) in self.pieces.iter(word) for at, k, number in places if -k <= end + 1 - n - at <= k})

    def match(self, word: str) -> tuple[float, int] | None:
        """Best (weight, edits) of an entry that the word is, or opens with, within the edits allowed; None without one."""
        weights = [w for w in (self.exact.get(word), *(self.exact.get(word[:k] + "*") for k in self.stems)) if w is not None]
        if weights:
            return max(weights), 0
        may = self.near(word) if len(self.pieces) else []
        if not may:
            return None
        best: tuple[float, int] | None = None
        n = len(word)
        stack = [(self.root, list(range(n + 1)), 0)]
        while stack:
            node, row, depth = stack.pop()
            for end, edits in ((node[1], row[n]), (node[2], min(row))):
                if end and edits <= end[1] and (best is None or (edits, -end[0]) < (best[1], -best[0])):
                    best = (end[0], edits)
            depth += 1
            for c, child in node[0].items():
                first = bisect.bisect_left(may, child[4])
                if first == len(may) or may[first] > child[5]:
                    continue
                k = child[3]
                new = [k + 1] * (n + 1)  # cells further than k from the diagonal are above k
                if depth <= k:
                    new[0] = depth
                for j in range(max(1, depth - k), min(n, depth + k) + 1):
                    new[j] = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (word[j - 1] != c), k + 1)
                if min(new) <= k:
                    stack.append((child, new, depth))
        return best

    def features(self, text: str | None) -> list[float]:
        """Window scores of a whole text: exact and fuzzy, abuse and quotation, their number and density (logarithms)."""
        out = [0.0] * N_FEATURES
        words = _WORDS(text.lower()) if text else []
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = [w for w in dict.fromkeys(words) if w not in cache]
        for w in new:
            cache[w] = self.match(w)
        if not any(map(cache.__getitem__, words)):
            return out
        tokens, inside, quoted = [], False, []
        for t in _TOKENS(text.lower()):
            if t in "\"“”„«»":
                inside = not inside if t == '"' else t in "“„«"
            else:
                tokens.append(t)
                quoted.append(inside)
        hits = [i for i, w in enumerate(tokens) if cache[w]]
        for at, i in enumerate(hits):
            weight, edits = cache[tokens[i]]
            around = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW]
            abuse = any(w in ADDRESS for w in around) or (at > 0 and i - hits[at - 1] <= WINDOW) or (at + 1 < len(hits) and hits[at + 1] - i <= WINDOW)
            quote = quoted[i] or any(w in REPORTING for w in around)
            out[2 * (edits > 0) + (quote and not abuse)] += weight * (1.5 if abuse else 1.0)
        out[4], out[5] = len(hits), 100 * len(hits) / len(tokens)
        return [math.log1p(v) for v in out]


class Model:
    """entries: lexicon with weights; beta: intercept and a coefficient per feature."""

    def __init__(self, entries: dict[str, float], beta: list[float]):
        self.entries, self.beta = entries, beta
        self.lexicon = Lexicon(entries)

    def score(self, text: str | None) -> float:
        z = self.beta[0] + sum(b * x for b, x in zip(self.beta[1:], self.lexicon.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    a = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(a.shape[1])
    penalty = ridge * np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(a.T @ (a * w[:, None]) + penalty + 1e-9 * np.eye(len(beta)), a.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return [float(v) for v in beta]


def _choose(rows: list, toxic: int, clean: int, most: int | None) -> dict[str, float]:
    """Entries by strength, leaving out those that say what a stronger one says already."""
    scored = []
    for term, a, b in rows:
        lift = math.log((a + 0.5) / (toxic + 1) / ((b + 0.5) / (clean + 1)))
        scored.append((a * lift, len(term.rstrip("*")), not term.endswith("*"), term, lift, a))
    out: dict[str, float] = {}
    #: chosen stems and their lengths; and for each beginning of a chosen entry, the most rows of one that begins so
    stems, sizes, use = set(), set(), {}
    for _, _, _, term, lift, a in sorted(scored, reverse=True):
        stem = term.rstrip("*")
        if most is not None and len(out) >= most:
            break
        if any(stem[:k] in stems for k in sizes) or use.get(stem, -1) >= 0.9 * a:
            continue
        out[term] = lift
        if stem != term:
            stems.add(stem)
            sizes.add(len(stem))
        for k in range(len(term) + 1):
            use[term[:k]] = max(a, use.get(term[:k], a))
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column | Callable[[Column], Column], key_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 6000, most: int | None = None, lift: float = 8.0) -> Model:
    """Learns from at most per_class labelled rows of either label among those whose key `learn` lets in.

    learn: a condition as a function of the key, or as a column over `k`, the key's name here. The rows with the lowest key
    hashes are taken; a key with several labels counts as toxic if one says so, and of several texts of one key the first in
    order stands for it. Null keys, labels and texts are left out. Entries are words of two letters and more, and stems of 4 to 8
    letters, that stand in three toxic rows at least (a two-hundredth of the sample's, if that is more), `lift` times as often as in clean ones; as many as the sample
    gives, unless `most` is given. Without rows of both labels the model has no entries and scores every text alike, at
    the share of toxic labels (0.5 without any, then rounded below 0.5).
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(key_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y is not null")
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    let_in = learn(F.col("k")) if callable(learn) else learn
    keyed = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t")).where(let_in & F.col("t").isNotNull())
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model({}, [3.0 if counts.get(1) else -3.0] + [0.0] * N_FEATURES)
    h = F.xxhash64("k")
    few = [known.where(f"y = {y}").where(h <= F.lit(min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (1.3 * per_class + 100) / counts[y]))))).orderBy(h, "k").limit(per_class) for y in (0, 1)]
    chosen = F.broadcast(few[0].unionByName(few[1]))  # 2 * per_class rows of two numbers at most
    train = keyed.join(chosen, "k").groupBy("k").agg(F.min("t").alias("t"), F.max("y").alias("y")).select("t", "y")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t", 1 << 20):
            out: list[str] = []
            ys: list[int] = []
            for text, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                own = set()
                for w in set(_WORDS(text.lower())):
                    if len(w) > 1:
                        own.add(w)
                        own.update(w[:k] + "*" for k in range(4, min(len(w), 9)))
                out += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_pydict({"term": pa.array(out, pa.string()), "y": pa.array(ys, pa.int32())})

    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Model({}, [3.0 if toxic else -3.0] + [0.0] * N_FEATURES)
    use = train.mapInArrow(terms, "term string, y int").groupBy("term").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    strong = use.where((F.col("a") >= max(3, toxic // 200)) & ((F.col("a") + 0.5) / (toxic + 1) >= lift * (F.col("b") + 0.5) / (clean + 1)))
    rows = strong.collect()  # of words of 2 * per_class texts
    entries = _choose([tuple(r) for r in rows], toxic, clean, most)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", bool)
        lexicon = Lexicon(entries)
        for b in slices(batches, "t"):
            x = [lexicon.features(t) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    seen = train.mapInArrow(featured, "x array<double>, y int").collect()  # 2 * per_class rows of six numbers at most
    return Model(entries, _logistic(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)))


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with score_col (0 to 1) of each whole text; a null or empty text scores as one without hits.

    A column already named score_col is replaced, all others are kept.
    """
    ship(df.sparkSession)
    entries, beta = model.entries, model.beta
    schema = with_fields(df.schema, set(), (score_col, T.DoubleType()))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", bool)
        own = Model(entries, beta)
        for b in slices(batches, text_col):
            out = [own.score(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(out, pa.float64())], names=[*kept, score_col])

    return df.mapInArrow(run, schema)
