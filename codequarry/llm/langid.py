"""Language identification by language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: slot s holds a mask with one bit
per language, so AND-ing the k slots of an n-gram yields at once every language
whose filter holds it. A text's n-grams are looked up, the bits counted per
language, and each count is corrected for the filter's own false positives:
a slot set with share p by chance turns n misses into about n * p**k hits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import ship, slices, with_fields

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ALPHA = np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x10000)])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _points(text: str) -> np.ndarray:
    """Code points of the lower-cased text: letters, and single spaces (0) for all the rest between them."""
    p = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = p < 0x10000
    letter = np.where(low, _ALPHA[np.where(low, p, 0)], False)
    for i in np.flatnonzero(~low):
        letter[i] = chr(p[i]).isalpha()
    p = np.where(letter, p, 0)
    p = np.concatenate([[0], p, [0]]).astype(np.uint64)
    keep = np.ones(len(p), bool)
    keep[1:] = (p[1:] != 0) | (p[:-1] != 0)
    return p[keep]


def ngrams(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of all letter n-grams of the whole text, word edges included, with repeats."""
    p = _points(text)
    out = []
    for n in sizes:
        if len(p) < n:
            continue
        h = np.full(len(p) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + p[k : len(p) - n + 1 + k]
        if n > 2:  # an edge may stand at either end but not within
            inner = np.zeros(len(h), bool)
            for k in range(1, n - 1):
                inner |= p[k : len(p) - n + 1 + k] == 0
            h = h[~inner]
        out.append(_mix(h))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Model:
    """langs: names in bit order; slots: uint64[words, size]; fill: share of set slots by language."""

    def __init__(self, langs: list[str], slots: np.ndarray, k: int, sizes: tuple[int, ...]):
        self.langs, self.slots, self.k, self.sizes = langs, slots, k, sizes
        self.bits = slots.shape[1].bit_length() - 1
        self.fill = np.array([np.count_nonzero(slots[i >> 6] & np.uint64(1 << (i & 63))) / slots.shape[1] for i in range(len(langs))])

    def slot(self, h: np.ndarray, j: int) -> np.ndarray:
        times = np.uint64((int(_M1) + 2 * j * j + 2 * j) % 2**64)
        plus = np.uint64(j * int(_M2) % 2**64)
        return ((h * times + plus) >> np.uint64(64 - self.bits)).astype(np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        h = ngrams(text, self.sizes)
        if not len(h):
            return ("und" if not any(c.isalpha() for c in text) else self.langs[0]), 0.0
        n = len(h)
        at = [self.slot(h, j) for j in range(self.k)]
        real = np.zeros(len(self.langs))
        for w in range(self.slots.shape[0]):
            mask = self.slots[w][at[0]]
            for x in at[1:]:
                mask = mask & self.slots[w][x]
            for i in range(64 * w, min(64 * w + 64, len(self.langs))):
                false = self.fill[i] ** self.k
                hits = np.count_nonzero(mask & np.uint64(1 << (i & 63)))
                real[i] = max(0.0, (hits - n * false) / max(1e-9, 1 - false))
        best = int(real.argmax())
        total = real.sum()
        return self.langs[best], float(min(1.0, real[best] / total)) if total > 0 else 0.0


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", docs_per_lang: int = 3000, per_lang: int = 20_000, share: float = 0.5, sizes: tuple[int, ...] = (2, 3, 4), k: int = 3, bits_per_item: int = 12) -> Model:
    """Fits the filters on at most docs_per_lang labelled rows of each language, those with the lowest hashes.

    A language's filter gets the per_lang n-grams that its sample uses most among those of which it has at least
    `share` of the use by all languages, each language weighing alike. Rows without text or language are left out; no
    rows at all give a model without languages. The model's size depends on the number of languages alone.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.xxhash64(F.col(key_col), F.col(text_col)).alias("h")).where("t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], np.zeros((1, 2), np.uint64), k, sizes)
    langs = sorted(counts)
    top = 2**63
    limits = [(x, int(-top + 2 * top * min(1.0, (1.3 * docs_per_lang + 200) / counts[x]))) for x in langs]
    cut = F.create_map(*[F.lit(v) for x, y in limits for v in (x, min(y, top - 1))])
    few = rows.where(F.col("h") <= cut[F.col("l")]).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= docs_per_lang)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            for text, lang in zip(b.column("t").to_pylist(), b.column("l").to_pylist(), strict=True):
                g, n = np.unique(ngrams(text, sizes), return_counts=True)
                yield pa.RecordBatch.from_pydict({"l": pa.array([lang] * len(g), pa.string()), "g": pa.array(g.view(np.int64)), "n": pa.array(n.astype(np.float64) / max(1, n.sum()))})

    used = few.select("t", "l").mapInArrow(grams, "l string, g long, n double").groupBy("g", "l").agg(F.sum("n").alias("n"))
    size = {r["l"]: r["n"] for r in used.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    even = F.create_map(*[F.lit(v) for x in langs for v in (x, 1.0 / max(1e-12, size.get(x, 1.0)))])
    used = used.withColumn("p", F.col("n") * even[F.col("l")]).withColumn("q", F.sum("p").over(Window.partitionBy("g")))
    best = used.where(F.col("p") >= share * F.col("q")).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("p"), "g"))).where(F.col("r") <= per_lang)
    chosen = best.select("l", "g").toPandas()  # per_lang rows a language at most
    bits = max(10, math.ceil(math.log2(max(2, bits_per_item * per_lang))))
    model = Model(langs, np.zeros(((len(langs) + 63) // 64, 1 << bits), np.uint64), k, sizes)
    for i, x in enumerate(langs):
        h = chosen.g[chosen.l == x].to_numpy().view(np.uint64)
        for j in range(k):
            np.bitwise_or.at(model.slots[i >> 6], model.slot(h, j), np.uint64(1 << (i & 63)))
    return Model(langs, model.slots, k, sizes)


def predict(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with the predicted language and the share of corrected hits it has (0 to 1).

    `und`, score 0: null text, text without a letter, or a model without languages. Columns of the two new names are
    replaced, others kept.
    """
    spark = df.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((model.langs, model.slots, model.k, model.sizes))  # a few MB for any corpus
    schema = with_fields(df.schema, set(), (lang_col, T.StringType()), (score_col, T.DoubleType()))
    kept = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for b in slices(batches, text_col):
            out = [own.predict(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=[*kept, lang_col, score_col])

    return df.mapInArrow(run, schema)
