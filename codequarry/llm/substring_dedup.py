"""Substring dedup by level-wise doubling.

To find word windows of length L that repeat anywhere, short windows are looked at first, and of those only the ones that any
window of length L must share: in every window of length L, the short window with the lowest hash (2 of 28 positions, for
9 words in 35). Short windows that repeat are extended to windows of twice the length around them, forwards (same start)
and backwards (same end); those that repeat are extended again, and so on. Every window of length L holds the forward or the
backward window of each length below L around its lowest short window, so it can only repeat if one of those does.
The last level looks at the windows of length L themselves, around what has survived. A level without survivors ends the search.

Texts that are equal stand once, with their number. Sequences are compared by 64-bit hashes while they are candidates, which
can only let more through, and by 128-bit hashes at the last level. What is shuffled is hashes and positions, those of the
later levels for survivors alone, and each text twice at most to meet them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import apart, claim, forget, ship, slices, written

_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Distinct words a Python worker keeps with their hashes; when full, the cache starts anew.
CACHE = 200_000
_EMPTY = hashlib.sha256(b"").hexdigest()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


class _Words(dict):
    """Hash of a word, kept."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = _Words()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = _TABLES.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 1 << 15), np.uint64(base), np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if len(p) <= 1 << 20:
            _TABLES[base] = p
    return p[:n]


def window_hashes(h: np.ndarray, size: int, base: int = _B1) -> np.ndarray:
    """Hash of each run of `size` words; equal runs have equal hashes wherever they stand."""
    n = len(h)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(base, n), dtype=np.uint64)])
    return mix((sums[size:] - sums[: n - size + 1]) * _powers(pow(base, -1, 2**64), n - size + 1))


def _extreme(g: np.ndarray, span: int, of: np.ufunc) -> np.ndarray:
    """Least (or greatest) of each run of `span`, by doubling."""
    have = 1
    while have < span:
        step = min(have, span - have)
        g = of(g[:-step], g[step:])
        have += step
    return g


def selected(h: np.ndarray, size: int, within: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of `size` that are a lowest one of some window of `within`, ties included."""
    g = window_hashes(h, size)
    span = within - size + 1
    if len(g) < span:
        return np.zeros(0, np.int64), g[:0]
    low = _extreme(g, span, np.minimum)
    pad = np.zeros(span - 1, np.uint64)
    p = np.flatnonzero(g == _extreme(np.concatenate([pad, low, pad]), span, np.maximum))
    return p, g[p]


def candidates(h: np.ndarray, size: int, within: int, hits: np.ndarray) -> np.ndarray:
    """Starts of the windows of `within` whose lowest window of `size` stands at one of `hits`."""
    g = window_hashes(h, size)
    span = within - size + 1
    if len(g) < span:
        return np.zeros(0, np.int64)
    low = _extreme(g, span, np.minimum)
    only = np.full(len(g), np.uint64(2**64 - 1), np.uint64)
    only[hits] = g[hits]
    return np.flatnonzero(_extreme(only, span, np.minimum) == low)


def levels(length: int, start: int) -> list[int]:
    """Window lengths from the first of at least `start` up to length, each at most twice the one before."""
    out = [length]
    while out[-1] > max(start, 2):
        out.append((out[-1] + 1) // 2)
        if out[-1] < start:
            out.pop()
            break
    return out[::-1]


def _lists(flat: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else [], kind))


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode("utf-8", "replace").split() if text else []


def around(h: np.ndarray, p: np.ndarray, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of `size` that start where the windows of `first` at p start, and that end where they end; 0 where the text ends before."""
    g = window_hashes(h, size)
    g[g == 0] = 1
    out = []
    for start in (p, p + first - size):
        there = (start >= 0) & (start < len(g))
        out.append(np.where(there, g[np.clip(start, 0, max(len(g) - 1, 0))] if len(g) else 0, 0).astype(np.uint64))
    return out[0], out[1]


def _repeated(spots: DataFrame, column: str) -> DataFrame:
    """The rows of spots whose value in column (not 0) stands in another row, too."""
    twice = spots.where(F.col(column) != 0).groupBy(column).agg(F.count("*").alias("n")).where("n > 1").select(column)
    return spots.join(apart(twice), column, "left_semi")


def survivors(spots: DataFrame, sizes: list[int], trace: list[int] | None = None) -> DataFrame:
    """rid, p of the short windows around which windows of all sizes below the last repeat.

    spots: rid, p, g (hash of the short window), and f0, b0, f1, b1 .. (forward and backward hashes per size). trace, where
    given, gets the number of rows that each level left; a level that leaves none is the last.
    """
    now = written(_repeated(spots, "g"), "level")
    for i in range(len(sizes)):
        if trace is not None:
            trace.append(now.count())
        if now.isEmpty():
            return now.select("rid", "p")
        sides = []
        for side in (f"f{i}", f"b{i}"):
            own = now.select("rid", "p", *[c for c in now.columns if c[0] == side[0] and c[1:].isdigit()])
            sides.append(_repeated(own, side).select("rid", "p", F.lit(side[0]).alias("side")))
        kept = sides[0].unionByName(sides[1]).groupBy("rid", "p").agg(F.max(F.col("side") == "f").alias("f"), F.max(F.col("side") == "b").alias("b"))
        # only a side that repeats is extended on
        later = [F.when(F.col(side), F.col(f"{side}{j}")).otherwise(F.lit(0)).alias(f"{side}{j}") for j in range(i + 1, len(sizes)) for side in "fb"]
        last, now = now, written(now.join(kept, ["rid", "p"]).select("rid", "p", *later), "level")
        forget(last)
    if trace is not None:
        trace.append(now.count())
    return now.select("rid", "p")


def dedup(docs: DataFrame, length: int = 35, start: int = 9, text_col: str = "text", with_text: bool = True, trace: list[int] | None = None) -> DataFrame:
    """All columns of docs but text_col, and n_words long, n_removed long, kept_sha256 string, kept string: a row per row of docs.

    A word goes if it is in a window of `length` words whose sequence also starts anywhere else in docs. Null and empty
    texts have no words; texts of fewer than `length` words have no windows and stay. Repeated rows are
    different rows, so their windows repeat; null keys play no part. kept holds the kept words joined by one space; without
    with_text, it is null. Columns with the names of the new ones are replaced. An empty table gives no rows. trace: see survivors().
    """
    spark = docs.sparkSession
    ship(spark)
    lengths = levels(length, start)
    if len(lengths) == 1:
        lengths = [max(1, length // 2), length]
    first, sizes = lengths[0], lengths[1:-1]
    new = {"n_words", "n_removed", "kept_sha256", "kept", text_col.lower()}
    others = [c for c in docs.columns if c.lower() not in new]
    telling = [F.col(c) for c, t in docs.dtypes if c in others and "map<" not in t and "variant" not in t]
    rows = docs.select(F.struct(*others, F.lit(0).alias("none")).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.lit(3), *telling).alias("row"))
    rows = rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(11), "text")})
    kind = rows.schema["own"].dataType.simpleString()
    names = ["g", *[f"{side}{i}" for i in range(len(sizes)) for side in "fb"]]

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", WORDS.clear)
        for b in slices(batches, "text"):
            ps: list[np.ndarray] = []
            gs: list[list[np.ndarray]] = [[] for _ in names]
            for t in b.column("text").to_pylist():
                h = word_hashes(split(t))
                p, g = selected(h, first, length)
                found = [g, *[x for size in sizes for x in around(h, p, first, size)]]
                ps.append(p.astype(np.int32))
                for x, to in zip(found, gs, strict=True):
                    to.append(x.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("t1"), b.column("t2"), b.column("row"), _lists(ps, pa.int32()), *[_lists(x, pa.int64()) for x in gs]], names=["t1", "t2", "row", "p", *names])

    lists = ", ".join(f"{x} array<long>" for x in names)
    hashed = rows.select("text", "t1", "t2", "row").mapInArrow(lowest, f"t1 long, t2 long, row long, p array<int>, {lists}")
    texts = hashed.groupBy("t1", "t2").agg(F.count("*").alias("m"), F.min("row").alias("rep"), F.first(F.struct("p", *names)).alias("x"))
    texts = written(texts.select("t1", "t2", "m", "rep", "x.*", F.monotonically_increasing_id().alias("rid")), "texts")
    spots = texts.select("rid", F.explode(F.arrays_zip("p", *names)).alias("x")).select("rid", "x.*")
    hits = survivors(spots, sizes, trace).groupBy("rid").agg(F.sort_array(F.collect_list("p")).alias("hits"))
    known = texts.select("t1", "t2", "m", "rep", "rid").join(hits, "rid", "left").drop("rid")
    met = rows.join(known.withColumnsRenamed({"t1": "k1", "t2": "k2"}), (F.col("t1") == F.col("k1")) & (F.col("t2") == F.col("k2")))
    # only one row of a repeated text brings it along, unless it is short: then nothing goes from any
    met = met.withColumn("n_words", F.when(F.col("m") > 1, F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")).cast("long")))
    lead = (F.col("m") == 1) | (F.col("row") == F.col("rep"))
    met = met.select("own", F.when(lead, F.col("text")).alias("text"), "n_words", F.when(~lead & (F.col("n_words") < length), F.col("text")).alias("short"), "m", "hits")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", WORDS.clear)
        for b in slices(batches, "text"):
            n_words, done, texts_, keep, starts, h1s, h2s = [], [], [], [], [], [], []
            for text, known_n, short, m, at in zip(*(b.column(c).to_pylist() for c in ("text", "n_words", "short", "m", "hits")), strict=True):
                none = np.zeros(0, np.int64)
                s, h1, h2 = none, none, none
                words = split(text if text is not None else short)
                n = known_n if known_n is not None and text is None else len(words)
                if at and text is not None and n >= length:
                    h = word_hashes(words)
                    s = candidates(h, first, length, np.array(at))
                    h1 = window_hashes(h, length)[s].view(np.int64)
                    h2 = window_hashes(mix(h), length, _B2)[s].view(np.int64)
                if m > 1 and n >= length:
                    done.append(_EMPTY)
                    texts_.append(None)
                elif m == 1 and len(s):
                    done.append(None)
                    texts_.append(text)
                else:  # nothing repeats, or a repeated text without windows
                    done.append(None if text is None and short is None else hashlib.sha256(b" ".join(words)).hexdigest())
                    texts_.append(None)
                keep.append(None if not with_text or done[-1] is None else "" if done[-1] == _EMPTY else b" ".join(words).decode("utf-8"))
                n_words.append(n)
                starts.append(s.astype(np.int32))
                h1s.append(h1)
                h2s.append(h2)
            yield pa.RecordBatch.from_arrays(
                [b.column("own"), b.column("m"), pa.array(n_words, pa.int64()), pa.array(done, pa.string()), pa.array(texts_, pa.string()), pa.array(keep, pa.string()), _lists(starts, pa.int32()), _lists(h1s, pa.int64()), _lists(h2s, pa.int64())],
                names=["own", "m", "n_words", "done", "text", "keep", "s", "h1", "h2"],
            )

    wide = met.mapInArrow(windows, f"own {kind}, m long, n_words long, done string, text string, keep string, s array<int>, h1 array<long>, h2 array<long>")
    wide = written(wide.withColumn("rid", F.monotonically_increasing_id()), "windows")
    forget(texts)
    each = wide.select("rid", F.explode(F.arrays_zip("s", "h1", "h2")).alias("x")).select("rid", "x.s", "x.h1", "x.h2")
    again = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    gone = each.join(apart(again), ["h1", "h2"]).groupBy("rid").agg(F.collect_list("s").alias("gone"))
    open_ = wide.where("done is null").select("rid", "own", "n_words", "text").join(gone, "rid", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            removed, kept, sha = [], [], []
            for text, at in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
                words = split(text)
                if at:
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, np.array(at), 1)
                    np.add.at(step, np.array(at) + length, -1)
                    stay = np.cumsum(step[:-1]) == 0
                    words = [w for w, ok in zip(words, stay, strict=True) if ok]
                    removed.append(int(len(stay) - stay.sum()))
                else:
                    removed.append(0)
                joined = b" ".join(words)
                kept.append(joined.decode("utf-8") if with_text else None)
                sha.append(hashlib.sha256(joined).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("own"), b.column("n_words"), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=["own", "n_words", "n_removed", "kept", "kept_sha256"])

    cleaned = open_.select("own", "n_words", "text", "gone").mapInArrow(cut, f"own {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
    whole = (F.col("m") > 1) & (F.col("n_words") >= length)
    kept = F.when(whole, F.lit("")).otherwise(F.col("keep")) if with_text else F.lit(None).cast("string")
    settled = wide.where("done is not null").select("own", "n_words", F.when(whole, F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept"), F.col("done").alias("kept_sha256"))
    return settled.unionByName(cleaned).select(*[F.col("own")[c].alias(c) for c in others], "n_words", "n_removed", "kept_sha256", "kept")
