"""Exact n-gram Jaccard join under several global token orders, and its linked groups.

Two sets of n tokens with Jaccard similarity of at least t must share a token among
the first n - ceil(t n) + 1 of each, under any one order of all tokens, and their first shared
token stands no later than their sizes allow. A pair is only compared if it passes under every order used:

1. A hash order, with tokens known as frequent last (the most frequent by their counts, all others by a map of their hashes), finds buckets of documents that share a prefix token. Buckets of a
   few documents propose their pairs at once. Documents of larger buckets go on to
2. the order by rising document frequency, counted over all tokens of these documents. Tokens that one document alone
   holds come first there, so an edited copy that is too far from the others has none of their tokens in its prefix,
   and what is proposed lies mostly within one group.
3. Two more hash orders sift what is proposed, by sketches of each document's first tokens, before any set is fetched.

Documents with equal sets form a class and stand once. A large bucket never yields all its pairs: each round a few hubs,
those with the earliest positions, meet its members; what is linked gets one label, and only members that could still
fit one of another label go on, with more hubs than before. Every pair of a bucket is compared, can't be similar, or belongs to one group already.
How many pairs of different groups fit each other in a bucket isn't bounded by the method; under the frequency order they are few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import apart, claim, forget, ship, slices, unused, written
from codequarry.llm.substring_dedup import WORDS, _lists, mix, word_hashes

#: Tokens in a share of the hash range come first in the order, and are counted: so many times the share that a prefix takes.
COUNTED = 1.5
#: The most frequent tokens, whose counts order the prefixes; fixed, so their broadcast is bounded (16 bytes each). All others that
#: FREQUENT_FROM classes hold stand between those and the rare ones, as marks in a map of USUAL_BITS bits for each, MOST_USUAL in all (32 MB).
FREQUENT, FREQUENT_FROM = 100_000, 4
USUAL_BITS, MOST_USUAL = 16, 1 << 28
#: Buckets of up to so many documents propose all their pairs at once.
SMALL = 8
#: Bits of the map that says which rows' sets are needed again (2 MB for any corpus).
MAP_BITS = 24
ORDERS = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)  # multipliers of the further orders


def shingles(text: str | None, n: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of a shorter text, of all its words together."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out ^ h[j : len(h) - k + 1 + j]) * np.uint64(0x100000001B3)
    return np.unique(out)


def prefix_size(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return n - (percent * n + 99) // 100 + 1


def counted_below(percent: int) -> int:
    """Hash below which tokens are counted; at most 45 % of the range, so that it is positive as a signed number."""
    return int(min(0.45, COUNTED * (100 - percent) / 100 + 0.01) * 2**64)


def sketch_sizes(n: int, percent: int) -> tuple[int, int]:
    """(m, M): of a similar pair, all but (100 - percent) % of the first m tokens of either set are among the first M of the other."""
    most = n - (percent * n + 99) // 100
    m = min(n, (5 * most) // 2 + 1)
    return m, min(n, m + (100 * most) // percent + 2)


def sketch(s: np.ndarray, percent: int) -> bytes:
    """The first M tokens under each of the further orders, in that order, as 16 bits each; one order after the other."""
    _, most = sketch_sizes(len(s), percent)
    out = []
    for times in ORDERS:
        h = s * np.uint64(times)
        out.append((np.sort(np.partition(h, most - 1)[:most] if most < len(h) else h) >> np.uint64(13)).astype("<u2"))
    return np.concatenate(out).tobytes()


def may_be_similar(x: bytes, y: bytes, nx: int, ny: int, percent: int) -> bool:
    """False only for pairs that can't reach the similarity: the prefix filter for more than one shared token, under each further order.

    An overlap of at least `alpha` leaves x at most nx - alpha tokens that y lacks, so of x's first m tokens at least
    m - (nx - alpha) are in y, and no further down there than m + (ny - alpha). Equal tokens have equal 16 bits.
    """
    alpha = -(-percent * (nx + ny) // (100 + percent))
    if alpha > min(nx, ny):
        return False
    for a, b in zip(np.frombuffer(x, "<u2").reshape(len(ORDERS), -1), np.frombuffer(y, "<u2").reshape(len(ORDERS), -1), strict=True):
        m = min(sketch_sizes(nx, percent)[0], len(a))
        reach = m + ny - alpha
        if reach > len(b) and len(b) < ny:
            m = max(0, len(b) - (ny - alpha))
            reach = len(b)
        if int(np.isin(a[:m], b[:reach]).sum()) < m - (nx - alpha):
            return False
    return True


def _components(edges: DataFrame) -> DataFrame:
    """c, label (least c reachable) for the ends of edges a-b: large-star and small-star steps until nothing changes."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "links")
        sign = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        forget(now)
        now = new
        if sign == last:
            break
        last = sign
    own = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("c"), "label")
    roots = now.select(F.col("v").alias("c")).distinct().join(now.select(F.col("u").alias("c")).distinct(), "c", "left_anti")
    out = written(own.unionByName(roots.select("c", F.col("c").alias("label"))), "labels")
    forget(now)
    return out


def _overlap(n: str, m: str, percent: int) -> str:
    """Least overlap of similar sets of n and m tokens, as SQL."""
    return f"({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent}"


def fits(percent: int, x: str = "", y: str = "hub_") -> str:
    """SQL condition on sizes n and positions i of a token in two sets: it can be the first shared token of similar sets."""
    alpha = _overlap(f"{x}n", f"{y}n", percent)
    return f"({x}n - {x}i >= {alpha} and {y}n - {y}i >= {alpha})"


def _spare(percent: int) -> str:
    """SQL of a number per entry; two entries of a bucket only fit if their numbers add up to zero or less."""
    return f"({100 + percent} * i - {100 - percent} * n)"


def _within(buckets: DataFrame, percent: int) -> DataFrame:
    """a, b: all fitting pairs of different labels of buckets of at most SMALL entries."""
    some = buckets.groupBy("h").agg(F.collect_list(F.struct("c", "n", "i", "label")).alias("x"))
    both = f"flatten(transform(x, p -> transform(filter(x, q -> p.c < q.c and p.label <> q.label and {fits(percent, 'p.', 'q.')}), q -> struct(p.c as a, q.c as b))))"
    return some.select(F.explode(F.expr(both)).alias("p")).select("p.a", "p.b")


def _sized(index: DataFrame, name: str) -> DataFrame:
    """The entries of buckets of two and more, with the bucket's size k."""
    shared = index.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    return written(index.join(apart(shared), "h"), name)


def groups(docs: DataFrame, percent: int = 90, n: int = 3, key_col: str = "doc_id", text_col: str = "text", hubs: int = 4) -> DataFrame:
    """doc_id, r1, r2 (hashes of the row), n_shingles long, component_id, label long: a row per row of docs.

    Rows link when 100 * intersection >= percent * union of their shingle sets; component_id is the least doc_id
    reachable by links, itself included; label is equal within a group alone, and null for empty sets. Null texts and texts
    without words have empty sets and link with nothing. Repeated rows have equal sets and link. A null key is never the
    least; a group of null keys alone has a null component_id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    limit = counted_below(percent)
    rows = docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumns({"r1": F.xxhash64("doc_id", "text"), "r2": F.xxhash64(F.lit(5), "text", "doc_id")})
    kind = dict(rows.dtypes)["doc_id"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", WORDS.clear)
        for b in slices(batches, "text"):
            s1, s2, sizes, cand, sketches = [], [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, n)
                d = xxhash.xxh3_128_digest(s.tobytes())
                s1.append(d[:8])
                s2.append(d[8:])
                sizes.append(len(s))
                sketches.append(sketch(s, percent) if len(s) else b"")
                cand.append(s[: max(prefix_size(len(s), percent), int(np.searchsorted(s, np.uint64(limit))))].view(np.int64) if len(s) else s.view(np.int64))
            sig = [pa.array(np.frombuffer(b"".join(x), "<i8")) for x in (s1, s2)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("r1"), b.column("r2"), *sig, pa.array(sizes, pa.int64()), _lists(cand, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "r1", "r2", "s1", "s2", "n", "cand", "sk"])

    each = written(rows.select("text", "doc_id", "r1", "r2").mapInArrow(sets, f"doc_id {kind}, r1 long, r2 long, s1 long, s2 long, n long, cand array<long>, sk binary"), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2"))
    classes = each.where("n > 0").groupBy("s1", "s2").agg(first.alias("f"), F.first("n").alias("n"), F.first("cand").alias("cand"), F.first("sk").alias("sk"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("c"), "s1", "s2", F.col("f.doc_id").alias("least"), "f.r1", "f.r2", "n", "cand", "sk"), "classes")
    members = written(each.select("doc_id", "r1", "r2", "s1", "s2", "n"), "members")
    forget(each)
    counted = classes.select(F.explode("cand").alias("h")).where((F.col("h") >= 0) & (F.col("h") < limit)).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    counted = written(counted, "counted")
    top = counted.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas().sort_values("h")  # FREQUENT rows at most
    bits = min(MOST_USUAL, 1 << max(15, (USUAL_BITS * counted.count()).bit_length()))
    usual = _marks(counted.select(F.pmod("h", F.lit(bits)).alias("s")), bits)
    forget(counted)
    frequent = spark.sparkContext.broadcast((top.h.to_numpy(np.int64), top.n.to_numpy(np.int64), usual))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, usual = frequent.value
        for b in batches:
            lists = b.column("cand")
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            late = ~((flat >= 0) & (flat < limit))
            # any function of the token orders all sets alike, so tokens that share a mark with a usual one only stand later
            use = np.where(late, 0, _marked(usual, flat % bits).astype(np.int64))
            if len(known):
                where = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                use = np.where(known[where] == flat, count[where], use)
            sizes = b.column("n").to_numpy()
            take = prefix_size(sizes, percent)
            out = []
            for i in range(b.num_rows):
                x, u, w = flat[at[i] : at[i + 1]], use[at[i] : at[i + 1]], late[at[i] : at[i + 1]]
                out.append(x[np.lexsort((x.view(np.uint64), u, w))[: take[i]]])
            many = np.array([len(x) for x in out])
            places = np.concatenate([np.arange(k, dtype=np.int64) for k in many]) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), pa.array(np.repeat(b.column("c").to_numpy(), many)), pa.array(np.repeat(sizes, many)), pa.array(places)], names=["h", "c", "n", "i"])

    index = written(classes.select("c", "n", "cand").mapInArrow(prefixes, "h long, c long, n long, i long"), "prefixes")
    light = written(classes.select("c", "s1", "s2", "least", "r1", "r2", "n", "sk"), "light")
    forget(classes)
    active = _sized(index, "buckets")
    forget(index)
    few = _within(active.where(F.col("k") <= SMALL).withColumn("label", F.col("c")), percent)
    few = written(_sifted(few.distinct(), light, percent), "few")
    many = written(active.where(F.col("k") > SMALL).select("c").distinct(), "many")
    forget(active)
    needed = few.select(F.col("a").alias("c")).unionByName(few.select(F.col("b").alias("c"))).unionByName(many).distinct()
    known = _sets(rows, light, needed, n)
    active = _by_frequency(known.join(many, "c", "left_semi"), percent).withColumn("label", F.col("c"))
    forget(many)
    links, labels = few, None
    turn = 0
    while True:
        slot = F.pmod(F.xxhash64(F.lit(turn), "c"), F.lit(hubs))
        large = active.where(F.col("k") > SMALL)
        chosen = written(large.groupBy("h", slot.alias("slot")).agg(F.min(F.struct("i", "c", "n", "label")).alias("x")).select("h", F.col("x.c").alias("hub_c"), F.col("x.n").alias("hub_n"), F.col("x.i").alias("hub_i"), F.col("x.label").alias("hub_label")), "hubs")
        met = large.join(chosen, "h").where(f"c <> hub_c and label <> hub_label and {fits(percent)}").select(F.least("c", "hub_c").alias("a"), F.greatest("c", "hub_c").alias("b"))
        proposed = _sifted(_within(active.where(F.col("k") <= SMALL), percent).unionByName(met).distinct(), light, percent)
        found = written(_similar(written(proposed.unionByName(links).distinct() if turn == 0 else proposed, "sifted"), known, percent), "found")
        if labels is None or not found.isEmpty():
            labels = _relabelled(labels, found)
        rest = large.join(chosen.select("h", F.col("hub_c").alias("c")), ["h", "c"], "left_anti").select("h", "c", "n", "i")
        rest = rest.join(labels, "c", "left").select("h", "c", "n", "i", F.coalesce("label", "c").alias("label"))
        least = rest.groupBy("h").agg(F.min(F.expr(_spare(percent))).alias("spare"))
        rest = rest.join(apart(least), "h").where(f"{_spare(percent)} + spare <= 0").drop("spare")
        open_ = rest.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("k")).where("x <> y").select("h", "k")
        left = written(rest.join(apart(open_), "h"), "buckets")
        forget(active, chosen, found)
        active = left
        if active.isEmpty():
            break
        turn += 1
        hubs *= 8
    forget(few, known, active)
    named = light.join(labels, "c", "left").select("s1", "s2", "least", F.coalesce("label", "c").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    named = named.join(least, "label").select("s1", "s2", "component_id", "label")
    out = members.where("n > 0").join(named, ["s1", "s2"]).select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), "component_id", "label")
    alone = members.where("n = 0").select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    return out.unionByName(alone)


def _by_frequency(sets: DataFrame, percent: int) -> DataFrame:
    """h, c, n, i, k: buckets of the prefixes under the order by rising frequency of a token among these sets (ties by hash).

    Tokens of one set alone come first and are only counted: they have no bucket.
    """
    tokens = sets.select("c", F.size("s").cast("long").alias("n"), F.explode("s").alias("h"))
    shared = tokens.groupBy("h").agg(F.count("*").alias("k")).where("k > 1")
    own = tokens.join(apart(shared), "h").groupBy("c", "n").agg(F.array_sort(F.collect_list(F.struct("k", "h"))).alias("x"))
    first = F.col("n") - F.size("x")
    take = F.expr(f"n - ({percent} * n + 99) div 100 + 1") - first
    index = own.where(take > 0).select("c", "n", first.alias("first"), F.posexplode(F.slice("x", F.lit(1), take.cast("int"))).alias("i", "x"))
    index = written(index.select(F.col("x.h").alias("h"), "c", "n", (F.col("first") + F.col("i")).alias("i")), "prefixes")
    out = _sized(index, "buckets")
    forget(index)
    return out


def _relabelled(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """labels (c, label) with the links found joined in."""
    if labels is None:
        return _components(found)
    end = lambda x: labels.select(F.col("c").alias(x), F.col("label").alias(f"l{x}"))
    edges = found.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    found_above = _components(edges)
    above = found_above.withColumnsRenamed({"label": "higher"})
    new = labels.join(above.withColumnsRenamed({"c": "label"}), "label", "left").select("c", F.coalesce("higher", "label").alias("label"))
    fresh = above.join(labels.select("c"), "c", "left_anti").select("c", F.col("higher").alias("label"))
    out = written(new.unionByName(fresh), "labels")
    forget(labels, found_above)
    return out


def _sifted(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) that can be similar under every further order."""
    side = lambda c, *names: light.select(F.col("c").alias(c), F.col("n").alias(names[0]), F.col("sk").alias(names[1]))

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [may_be_similar(x, y, nx, ny, percent) and may_be_similar(y, x, ny, nx, percent) for x, y, nx, ny in zip(*(b.column(c).to_pylist() for c in ("x", "y", "nx", "ny")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("a", "nx", "x"), "a").join(side("b", "ny", "y"), "b").select("a", "b", "x", "y", "nx", "ny").mapInArrow(sift, "a long, b long")


def _marks(values: DataFrame, size: int) -> np.ndarray:
    """A map of the values (s) below size."""
    parts = values.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    bits = np.zeros(size // 8 + 8192, np.uint8)
    for r in parts.toLocalIterator():  # at most size / 32768 + 1 maps of 4 KB
        m = np.frombuffer(r["m"], np.uint8)
        bits[r["b"] * 4096 : r["b"] * 4096 + len(m)] |= m
    return bits


def _marked(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Which of s are in a map of _marks()."""
    # bit i of bucket k (from 1) stands for value (k - 1) * 32768 + i + 1; bucket 0 holds value 0
    bucket, bit = np.where(s > 0, 1 + (s - 1) // 32768, 0), np.where(s > 0, (s - 1) % 32768, 0)
    return ((bits[bucket * 4096 + bit // 8] >> (bit % 8).astype(np.uint8)) & 1).astype(bool)


def _sets(rows: DataFrame, light: DataFrame, needed: DataFrame, n: int) -> DataFrame:
    """c, s (sorted tokens) of the classes in needed, from the texts: the corpus is read once more."""
    spark = rows.sparkSession
    needed = written(light.join(needed, "c", "left_semi").select("c", "r1", "r2"), "needed")
    bits = _marks(needed.select(F.pmod("r1", F.lit(1 << MAP_BITS)).alias("s")), 1 << MAP_BITS)
    held = spark.sparkContext.broadcast(bits)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words", WORDS.clear)
        known = held.value
        for b in slices(batches, "text"):
            part = b.filter(pa.array(_marked(known, np.mod(b.column("r1").to_numpy(), 1 << MAP_BITS))))
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([part.column("r1"), part.column("r2"), _lists([shingles(t, n).view(np.int64) for t in part.column("text").to_pylist()], pa.int64())], names=["r1", "r2", "s"])

    sets = rows.select("text", "r1", "r2").mapInArrow(again, "r1 long, r2 long, s array<long>")
    out = written(needed.join(sets, ["r1", "r2"]).groupBy("c").agg(F.first("s").alias("s")), "needed-sets")
    forget(needed)
    return out


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are similar enough."""
    wide = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column("x"), b.column("y")
            ox, fx, oy, fy = xs.offsets.to_numpy(), xs.values.to_numpy(), ys.offsets.to_numpy(), ys.values.to_numpy()
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = fx[ox[i] : ox[i + 1]], fy[oy[i] : oy[i + 1]]
                same = int(np.count_nonzero(np.isin(x, y, assume_unique=True)))
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return wide.select("a", "b", "x", "y").mapInArrow(similar, "a long, b long")


def representatives(docs: DataFrame, percent: int = 90, n: int = 3, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each linked group: the one whose key is its component_id; all columns as they are.

    Rows without a set stay. Repeated rows of a kept key stay. Of a group of null keys alone, the text with the lowest hash stays.
    """
    found = groups(docs, percent, n, key_col, text_col).where("n_shingles > 0")
    nameless = found.where("component_id is null").groupBy("label").agg(F.min(F.struct("r1", "r2")).alias("first"))
    found = found.join(nameless, "label", "left").where("not (doc_id <=> component_id) or (component_id is null and struct(r1, r2) <> first)")
    mine = unused(docs, 2)
    gone = found.select(F.col("r1").alias(mine[0]), F.col("r2").alias(mine[1])).distinct()
    same = (F.xxhash64(key_col, text_col) == F.col(mine[0])) & (F.xxhash64(F.lit(5), text_col, key_col) == F.col(mine[1]))
    return docs.join(gone, same, "left_anti")
