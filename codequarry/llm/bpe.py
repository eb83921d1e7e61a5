"""Byte-level BPE with a hierarchical-bitmap rank queue.

The bytes of pre-tokens, many short ones or one very long one, form a linked list of symbols with an edge behind each
pre-token. Every adjacent pair that makes up a known token waits in the bucket of that token's rank, as the position of its left symbol.
A two-level bitmap says which buckets hold anything: one bit per rank in 64-bit
words, and one bit per word in the root, so two find-first-set steps give the
lowest waiting rank. Its bucket is worked off from the left; where a merge makes a lower rank wait, that goes first. A position whose
pair has changed since it was queued is stale and skipped. So each pre-token is merged by lowest rank, leftmost first, and a
pre-token of a million bytes is as cheap per byte as a short one.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codequarry.llm.common import claim, ship, slices, with_fields
from codequarry.llm.units import Known, gathered, stretches

#: Bytes of stretches kept with their ids by one Python worker; when full, they are dropped.
CACHE_BYTES = 48 << 20
#: Patterns of which no match goes on behind white space, none starts with more of it than one blank before
#: other characters, and none holds . or , behind a letter. Texts whose only white space is blanks and \n may be cut into
#: stretches before they are matched.
CUT_AT_BLANKS = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}
#: White space of other kinds.
_OTHER_SPACE = r"[\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters of new pre-tokens that wait in one queue; a longer one waits alone.
BATCH = 100_000
#: Bytes of text taken at a time.
SLICE = 4 << 20


class Codec:
    """Encoder and decoder of one rank file.

    Where the pattern is one of CUT_AT_BLANKS, texts are cut at blanks first and each distinct stretch is matched once; with any
    other pattern, whole texts are matched.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the rank file lacks {len(missing)} of the 256 single bytes")
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        if regex.compile(pattern).groups:
            raise ValueError("the pattern must have no capturing groups")
        self.cut = pattern in CUT_AT_BLANKS
        self.words = [0] * ((max(ranks.values()) >> 6) + 1)  # lower level of the bitmap, all zero between calls
        self.shift = (max(ranks.values()) + 1).bit_length()
        self.edge = max(ranks.values()) + 1  # stands between pre-tokens; no token
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        # rank of every two tokens that make up a third, by (left << shift | right); and of two bytes, -1 for none
        self.pairs = {ranks[t[:k]] << self.shift | ranks[t[k:]]: r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.byte_pairs = np.array([ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)], np.int64)
        vocabulary: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            vocabulary[rank] = token
        self.vocabulary = pa.array(vocabulary, pa.binary())
        self.known = Known(CACHE_BYTES)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers: all of them wait in one queue, with an edge behind each."""
        data = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int64)
        ends = np.cumsum([len(x) + 1 for x in pieces]) - 1
        n = len(data)
        ids, first = self.of_byte[data], np.full(n, -1)
        ids[ends] = self.edge
        first[:-1] = self.byte_pairs[data[:-1] << 8 | data[1:]]
        first[ends] = first[ends - 1] = -1
        make = np.ndarray.tolist if n < 1 << 18 else lambda x: array("q", x.tobytes())
        after, before, symbol, waiting = make(np.arange(1, n + 1)), make(np.arange(-1, n - 1)), make(ids), make(first)
        there = np.ones(n, bool)
        there[ends] = False
        alive = bytearray(there.tobytes())
        words, pair, shift = self.words, self.pairs.get, self.shift
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        ranks, starts = np.unique(first[order], return_index=True)
        buckets = {r: x.tolist() for r, x in zip(ranks.tolist(), np.split(order, starts[1:]), strict=True)} if len(ranks) else {}
        root = 0
        for rank in buckets:
            words[rank >> 6] |= 1 << (rank & 63)
            root |= 1 << (rank >> 6)
        while root:
            word = (root & -root).bit_length() - 1
            low = words[word] & -words[word]
            rank = (word << 6) + low.bit_length() - 1
            bucket = buckets.pop(rank)
            words[word] ^= low
            if not words[word]:
                root ^= 1 << word
            bucket.sort()
            lower = False
            for done, i in enumerate(bucket):
                if waiting[i] != rank:
                    continue  # stale
                gone = after[i]
                end = after[i] = after[gone]
                symbol[i] = rank
                waiting[gone] = -1
                alive[gone] = 0
                before[end] = i
                new = pair(rank << shift | symbol[end], -1)
                waiting[i] = new
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        words[new >> 6] |= 1 << (new & 63)
                        root |= 1 << (new >> 6)
                        lower = new < rank
                left = before[i]
                if left >= 0 and symbol[left] != self.edge:
                    new = pair(symbol[left] << shift | rank, -1)
                    waiting[left] = new
                    if new >= 0:
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            words[new >> 6] |= 1 << (new & 63)
                            root |= 1 << (new >> 6)
                            lower = lower or new < rank
                if lower:  # a pre-token's lower rank goes first
                    if done + 1 < len(bucket):
                        del bucket[: done + 1]
                        buckets[rank] = bucket
                        words[word] |= low
                        root |= 1 << word
                    break
        kept = np.frombuffer(alive, np.uint8)
        made = np.asarray(symbol, np.int64)[kept.view(bool)].astype("<u4")
        cuts = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)[ends]])
        flat = made.tobytes()
        return [flat[4 * i : 4 * j] for i, j in pairwise(cuts.tolist())]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, pre-token by pre-token; new pre-tokens are merged together."""
        split = [self.split(x) for x in texts]
        ids = dict.fromkeys(x for pieces in split for x in pieces)
        todo, size, last = [], 0, len(ids)
        for at, x in enumerate(list(ids), 1):
            todo.append(x)
            size += len(x)
            if size > BATCH or at == last:
                ids.update(zip(todo, self.merge([p.encode("utf-8", "replace") for p in todo]), strict=True))
                todo, size = [], 0
        return [b"".join([ids[p] for p in pieces]) for pieces in split]

    def encode_all(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of each text; null has none."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _OTHER_SPACE) if self.cut else pa.repeat(True, len(texts))
        plain = pc.invert(odd)
        cut = texts.filter(plain)
        parts = [gathered(*stretches(cut), self.known, self.ids_of)]
        if len(cut) == len(texts):
            return parts[0]
        ids = self.ids_of(texts.filter(odd).to_pylist())
        ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
        parts.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        place = np.argsort(np.concatenate([np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (plain, odd)]))
        return pc.take(pa.concat_arrays(parts), pa.array(place))

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string())).values.to_numpy().tobytes()

    def decode_all(self, lists: pa.ListArray) -> pa.BinaryArray:
        """The bytes that each array of ids stands for; null stays null. A null or unknown id raises."""
        flat = lists.flatten()
        if flat.null_count:
            raise ValueError("a null among the ids")
        tokens = self.vocabulary.take(flat)
        if tokens.null_count:
            raise ValueError("an id outside the vocabulary")
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.frombuffer(tokens.buffers()[1], np.int32)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int32)
        bounds = np.ascontiguousarray(ends[np.concatenate([[0], np.cumsum(sizes)])])
        out = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(bounds), tokens.buffers()[2] or pa.py_buffer(b"")])
        return pc.if_else(lists.is_valid(), out, pa.scalar(None, pa.binary())) if lists.null_count else out

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


@lru_cache(maxsize=4)
def codec(rank_path: str, pattern: str) -> Codec:
    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return Codec(ranks, pattern)


def encode(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", drop_text: bool = False) -> DataFrame:
    """df with ids_col array<int>: the token ids of each whole text; without text_col if drop_text.

    A null or empty text gives an empty array. A column already named ids_col is
    replaced, all others are kept. Repeated rows are encoded each. rank_path must
    be readable on every executor. Any pattern without capturing groups gives the ids of its own matches.
    """
    ship(df.sparkSession)
    schema = with_fields(df.schema, {text_col} if drop_text else set(), (ids_col, T.ArrayType(T.IntegerType(), True)))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", codec.cache_clear)
        own = codec(rank_path, pattern)
        for b in slices(batches, text_col, SLICE):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), own.encode_all(b.column(text_col))], names=[*kept, ids_col])

    return df.mapInArrow(run, schema)


def _few(batches: Iterator[pa.RecordBatch], column: str, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` ids, one row at least."""
    for b in batches:
        total = np.cumsum(pc.fill_null(pc.list_value_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
            yield b.slice(start, end - start)
            start = end


def decode(df: DataFrame, rank_path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """df with bytes_col binary: the bytes that the ids stand for.

    A null array gives null, an empty one no bytes; an id outside the vocabulary
    or a null id raises. A column already named bytes_col is replaced.
    """
    ship(df.sparkSession)
    schema = with_fields(df.schema, set(), (bytes_col, T.BinaryType()))
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", codec.cache_clear)
        own = codec(rank_path, pattern)
        for part in _few(batches, ids_col):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), own.decode_all(part.column(ids_col))], names=[*kept, bytes_col])

    return df.mapInArrow(run, schema)


def _hashes(data: pa.BinaryArray) -> pa.Array:
    return pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in data.to_pylist()], pa.string())


def round_trip(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """df without text_col, with ids array<int> (if with_ids), n_tokens long, ids_sha256 and decoded_sha256 string.

    encode() and decode() in one pass over the rows: what is hashed last are the bytes decoded from the ids. Ids are hashed as
    little-endian unsigned 32-bit integers. Columns of the new names are replaced, all others kept; a null text is an empty one.
    """
    ship(df.sparkSession)
    new = [("ids", T.ArrayType(T.IntegerType(), True))] if with_ids else []
    new += [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    schema = with_fields(df.schema, {text_col}, *new)
    kept = [f.name for f in schema.fields[: len(schema.fields) - len(new)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", codec.cache_clear)
        own = codec(rank_path, pattern)
        for b in slices(batches, text_col, SLICE):
            ids = own.encode_all(b.column(text_col))
            at, flat = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy()).cast("B")
            sha = pa.array([hashlib.sha256(flat[4 * i : 4 * j]).hexdigest() for i, j in pairwise(at.tolist())], pa.string())
            made = [pc.list_value_length(ids).cast(pa.int64()), sha, _hashes(own.decode_all(ids))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *([ids] if with_ids else []), *made], names=schema.names)

    return df.mapInArrow(run, schema)


@F.arrow_udf(T.StringType())
def ids_sha256(ids: pa.Array) -> pa.Array:
    """Lowercase hex SHA-256 of each array's ids as little-endian unsigned 32-bit integers; null stays null."""
    flat = np.asarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4") if len(ids.values) else np.zeros(0, "<u4")
    at = ids.offsets.to_numpy()
    ok = ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([hashlib.sha256(flat[at[i] : at[i + 1]].tobytes()).hexdigest() if ok[i] else None for i in range(len(ids))], pa.string())
