"""Exact top-k inner products by no-random-access aggregation (NRA).

Every dimension of a block of candidates is a list sorted by component, read with a cursor from its high end where the query's
component is positive and from its low end where it is negative. A candidate's score lies between a lower bound
(what was read of it, and for the rest the lists' far ends) and an upper bound (what was read, and for the rest the
values under the cursors). All lists are read on, to four times the depth each time, and only the entries newly read are added up,
until few are left whose upper bound reaches the k-th best lower bound, or the k-th best score known from blocks before; nobody
outside can qualify then, and those left get their final scores. Lists read to their ends give the scores themselves. Some
queries at a time share their reads, as matrix products over the entries read; each stops by itself.

Queries go out in chunks of bounded size, each with a floor: the k-th best score among a few rows of the chunk itself. A task
reads its rows once per chunk, block by block, and sends on k rows a query at most; vectors are never shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.common import ship, written

#: A sixteenth of each list is read first; so many queries share their reads.
FIRST_READ, TOGETHER = 16, 128
#: Bytes of a chunk of queries at most.
CHUNK_BYTES = 32 << 20
#: Rows of a chunk that give its queries their floors.
FLOOR_ROWS = 512
#: Sums of integers up to here are exact as doubles.
EXACT = 2.0**53


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold such a floor exactly."""
    with np.errstate(over="ignore"):
        out = np.floor(scale * vectors.astype(np.float64))
    if not np.isfinite(out).all():
        raise OverflowError("a component times the scale is beyond the range of doubles")
    return out


class Lists:
    """A block of candidates as one sorted list per dimension."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        if len(np.unique(ids)) < len(ids):  # rows equal in id and vector count once
            _, first = np.unique(np.column_stack([ids.astype(np.float64), ids >> 53, vectors]), axis=0, return_index=True)
            vectors, ids = vectors[first], ids[first]
        self.vectors, self.ids = vectors, ids
        by_id = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.r_[True, ids[by_id][1:] != ids[by_id][:-1]]) if len(ids) else np.zeros(0, np.int64)
        #: rows in order of their ids and where each id's begin; None where no id is repeated
        self.same = (by_id, starts) if len(starts) < len(ids) else None
        order = np.argsort(vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, order, axis=0)
        #: place of each candidate in each list, from the low end
        self.place = np.empty(order.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(ids), dtype=np.int32)[:, None], axis=0)


def nra(queries: np.ndarray, own: np.ndarray, lists: Lists, k: int, floors: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per query the ids and scores of candidates among which its k best are, of those that score its floor at least; and the entries read per query.

    The candidates of a query's own id take no part. All scores and their sums must be exact as doubles.
    """
    x, n = lists.vectors, len(lists.ids)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    other = lists.ids[None, :] != own[:, None]
    part = np.zeros((len(queries), n))
    out: list[tuple[np.ndarray, np.ndarray]] = [(lists.ids[:0], x[:0, 0])] * len(queries)
    reads = np.zeros(len(queries), np.int64)
    open_ = np.arange(len(queries))
    done = 0
    while len(open_):
        end = min(n, max(4 * done, n // FIRST_READ, k, 1))
        high, low = lists.place >= n - end, lists.place < end  # read from either end so far
        new_high, new_low = high & (lists.place < n - done), low & (lists.place >= done)
        part[open_] += up[open_] @ np.where(new_high, x, 0).T + down[open_] @ np.where(new_low, x, 0).T
        reads[open_] += (queries[open_] != 0).sum(axis=1) * (end - done)
        done = end
        if done < n:
            rest = lambda a, b: part[open_] + up[open_] @ np.where(high, 0, a).T + down[open_] @ np.where(low, 0, b).T
            upper, lower = rest(lists.sorted[n - done], lists.sorted[done - 1]), rest(lists.sorted[0], lists.sorted[-1])
        else:
            upper = lower = part[open_]
        upper, lower = (np.where(other[open_], v, -np.inf) for v in (upper, lower))
        need = floors[open_]
        # rows of one id with equal scores are one result, so only different ids make up the k-th best
        sure = lower if lists.same is None else np.maximum.reduceat(lower[:, lists.same[0]], lists.same[1], axis=1)
        if sure.shape[1] > k:
            need = np.maximum(need, np.partition(sure, sure.shape[1] - k, axis=1)[:, sure.shape[1] - k])
        left = []
        for i, bound, least in zip(open_, upper, need, strict=True):
            inside = np.flatnonzero((bound >= least) & other[i])
            if done < n and len(inside) > max(4 * k, n // 64):
                left.append(i)
            else:
                score = part[i, inside] if done == n else x[inside] @ queries[i]
                keep = score >= floors[i]
                out[i] = lists.ids[inside[keep]], score[keep]
        open_ = np.array(left, int)
    return out, reads


def _wide(query: np.ndarray, own: int, lists: Lists) -> tuple[np.ndarray, list[int]]:
    """All scores of a block in Python's integers: for components so large that doubles would round. No early stop."""
    keep = lists.ids != own
    q = [int(v) for v in query]
    return lists.ids[keep], [sum(a * int(b) for a, b in zip(q, x, strict=True)) for x in lists.vectors[keep]]


def _best(ids: list[int], scores: list[int], k: int) -> tuple[list[int], list[int]]:
    """The k highest of (score, id), equal ones once, ties to the smaller id."""
    found = sorted(set(zip([-int(s) for s in scores], ids, strict=True)))[:k]
    return [i for _, i in found], [-s for s, _ in found]


class _Chunk:
    """Queries of one length, with the best found so far for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.size = np.abs(vectors).sum(axis=1) if len(vectors) else np.zeros(0)
        self.floors = np.full(len(ids), -np.inf)
        if len(ids) > k and self.fits(self.vectors).all():
            few = Lists(vectors[:FLOOR_ROWS], ids[:FLOOR_ROWS])
            scores = vectors @ few.vectors.T
            scores[ids[:, None] == few.ids[None, :]] = -np.inf
            # one id's rows may hold several places: only as many different ids as there are count
            if len(np.unique(few.ids)) == len(few.ids) > k:
                self.floors = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        self.best: list[tuple[list[int], list[int]]] = [([], []) for _ in ids]

    def fits(self, candidates: np.ndarray) -> np.ndarray:
        """Per query whether all scores with these candidates are exact as doubles."""
        return self.size * float(np.abs(candidates).max(initial=0)) < EXACT / 4

    def meet(self, lists: Lists) -> None:
        fits = self.fits(lists.vectors)
        at = np.flatnonzero(fits)
        for s in range(0, len(at), TOGETHER):
            some = at[s : s + TOGETHER]
            floors = [max(self.floors[i], self.best[i][1][-1]) if len(self.best[i][1]) == self.k and self.best[i][1][-1] < EXACT else self.floors[i] for i in some]
            found, _ = nra(self.vectors[some], self.ids[some], lists, self.k, np.array(floors, float))
            for i, (ids, score) in zip(some, found, strict=True):
                if len(ids):
                    self.add(i, ids, score.astype(np.int64).tolist())
        for i in np.flatnonzero(~fits):
            self.add(i, *_wide(self.vectors[i], self.ids[i], lists))

    def add(self, i: int, ids: np.ndarray, scores: list[int]) -> None:
        known, old = self.best[i]
        self.best[i] = _best(known + ids.tolist(), old + scores, self.k)


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block: int = 8192, query_block: int = 8192) -> DataFrame:
    """query_id, rank (from 1), vec_id, score long of each query row's k highest integer inner products.

    Components become floor(scale * x). Rows with a null id, or a vector that is null, empty or holds null or
    non-finite components, take no part; vectors meet only vectors of their own length. A query's own id is no
    candidate of it. Rows equal in id and vector count once, as queries and as candidates; of different vectors of one id, each
    is a query, and equal scores of one candidate id count once, so that the result is the k highest different (score, id), however rows lie in blocks. Fewer candidates than k give fewer rows, an empty table none.
    Scores are exact whatever the size of components; one beyond a long raises. block: candidates in one set of lists;
    query_block: queries in a chunk, fewer where their bytes pass CHUNK_BYTES.
    """
    spark = vectors.sparkSession
    ship(spark)
    x = F.col(vector_col)
    good = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0))
    good = good.where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf")))))
    good = good.select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"), is_query.alias("q"))
    asked = written(good.where("q").select("id", "v").distinct(), "queries")
    total = asked.agg(F.count("*").alias("n"), F.sum(F.size("v") * 8 + 8).alias("bytes"), F.max(F.size("v")).alias("d")).first()
    chunks = max(-(-total["n"] // query_block), -(-(total["bytes"] or 0) // CHUNK_BYTES), 1)
    part = F.pmod(F.xxhash64("id", "v"), F.lit(chunks))
    found = []
    for c in range(chunks):
        rows = asked.where(part == c).toPandas()  # about query_block rows and CHUNK_BYTES at most
        held = spark.sparkContext.broadcast({d: _Chunk(g.id.to_numpy(np.int64), scaled(np.array(g.v.tolist()), scale), k) for d, g in rows.groupby(rows.v.map(len))} if len(rows) else {})

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            asked = {d: _Chunk(x.ids, x.vectors, k) for d, x in held.value.items()}
            for d, x in held.value.items():
                asked[d].floors = x.floors
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {d: [] for d in asked}
            count = dict.fromkeys(asked, 0)

            def work(d: int) -> None:
                ids, flat = (np.concatenate(x) for x in zip(*waiting[d], strict=True))
                waiting[d], count[d] = [], 0
                for s in range(0, len(ids), block):
                    asked[d].meet(Lists(scaled(flat[s : s + block], scale), ids[s : s + block]))

            for b in batches:
                lists = b.column("v")
                at, flat, ids = lists.offsets.to_numpy(), lists.values.to_numpy(), b.column("id").to_numpy()
                sizes = np.diff(at)
                for d in np.unique(sizes).tolist():
                    if d in asked:
                        rows = np.flatnonzero(sizes == d)
                        waiting[d].append((ids[rows], flat[at[rows][:, None] + np.arange(d)]))
                        count[d] += len(rows)
                        if count[d] >= block:
                            work(d)
            for d in asked:
                if count[d]:
                    work(d)
                own = asked[d]
                out = [(q, zlib.crc32(v.tobytes()), i, s) for q, v, (ids, scores) in zip(own.ids.tolist(), own.vectors, own.best, strict=True) for i, s in zip(ids, scores, strict=True)]
                if any(abs(s) >= 2**63 for *_, s in out):
                    raise OverflowError("a score is beyond the range of a long")
                cols = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "qh", "vec_id", "score"])

        local = good.select("id", "v").mapInArrow(scan, "query_id long, qh long, vec_id long, score long")
        found.append(written(local, "best") if chunks > 1 else local)
    local = found[0] if chunks == 1 else spark.read.schema(found[0].schema).parquet(*[x.written_path for x in found])
    rank = F.row_number().over(Window.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id"))
    return local.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
