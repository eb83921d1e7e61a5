"""Token-id files: one zstandard frame per document under a dictionary that all frames share.

Layout of a shard file (all integers little-endian):

    magic b"CQIDS1\\n\\0" | 32 bytes SHA-256 of the dictionary | u32 number of documents
    index: per document i64 doc_id, u8 has_id, u64 frame offset, u32 frame bytes, u32 ids
    frames, one after another; a frame holds the document's ids as u32

The dictionary lies beside the shards as dictionary.bin. A reader checks the hash
before it decompresses, and reads one document by seeking to its frame.
Shards are written under names of their own attempt; only the manifest of
successful tasks counts, so a lost executor leaves at most an unread file.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.common import claim, new_path, ship, slices, text_hash
from codequarry.llm.units import Known, gathered, runs

MAGIC = b"CQIDS1\n\0"
ENTRY = "<qBQII"
#: Bytes of words a Python worker keeps with their ids; when full, they are dropped.
CACHE_BYTES = 48 << 20
#: New words given to the library in one call, and the mark between them.
BATCH, MARK = 1000, "\x01"
#: Text bytes of a shard at most, as planned.
SHARD_BYTES = 256 << 20
#: What a tokenizer file may hold for blanks and \n to part its texts: normalizers that let no characters on two
#: sides of a blank act on each other, and a pattern of which no match holds white space, or letters beside . or ,
_APART_NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
_APART_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _store(url: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    return pafs.FileSystem.from_uri(url if "://" in url else "file://" + url.removeprefix("file:"))


def parted_by_blanks(spec: dict) -> bool:
    """Whether a tokenizer file's contents prove that the ids of a text are the ids of its words (as units.runs cuts them) in a row."""
    norm, pre, model = spec.get("normalizer"), spec.get("pre_tokenizer"), spec.get("model") or {}
    norms = norm["normalizers"] if norm and norm["type"] == "Sequence" else [norm] if norm else []
    pres = pre["pretokenizers"] if pre and pre["type"] == "Sequence" else [pre] if pre else []
    if any(x not in _APART_NORMALIZERS for x in norms) or not pres:
        return False
    split, *later = pres
    cut = split["type"] == "Split" and split["pattern"] == {"Regex": _APART_PATTERN} and split["behavior"] == "Removed" and split["invert"]
    plain = all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in later)
    # a token that holds white space, or . or , behind a letter, would be cut before the library could see it
    added = all(not re.search(r"\s|[A-Za-z][.,]", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec.get("added_tokens") or [])
    return bool(cut and plain and added and not spec.get("truncation") and not spec.get("padding") and not model.get("dropout"))


class _Encoder:
    """A tokenizer of the tokenizers library.

    Where its file proves that blanks part texts, it is asked once per distinct word; else it encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.parted = parted_by_blanks(json.load(f))
        self.known = Known(CACHE_BYTES)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def encode_all(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of each text; null has none."""
        texts = pc.fill_null(texts, "")
        if self.parted:
            return gathered(*runs(texts), self.known, self._ids)
        ids = [np.array(x.ids, "<i4") for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else [], pa.int32()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        lists = self.encode_all(pa.array(texts, pa.string()))
        flat, at = lists.values.to_numpy().tobytes(), lists.offsets.to_numpy().tolist()
        return [flat[4 * i : 4 * j] for i, j in pairwise(at)]

    def _ids(self, words: list[str]) -> list[bytes]:
        return [ids for start in range(0, len(words), BATCH) for ids in self._words(words[start : start + BATCH])]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word: one call for all of them, a mark between them showing where each ends."""
        if self.mark is not None and not any(MARK in w for w in words):
            ids = np.array(self.tokenizer.encode_batch_fast([f" {MARK} ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(words) - 1:
                flat = ids.tobytes()
                return [flat[i:j] for i, j in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(flat)], strict=True)]
        return [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def train_dictionary(df: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text", sample_docs: int = 2000, sample_ids: int = 2000, size: int = 64 << 10, rows: int | None = None) -> bytes:
    """A zstandard dictionary trained on the driver from the first sample_ids ids of sample_docs texts, those with the lowest hashes.

    The sample is bounded by its two parameters and only shapes the compression, never what is read back. rows: number of rows of
    df, if known. Too few or too small texts give no dictionary (b"").
    """
    n = df.count() if rows is None else rows
    if not n:
        return b""
    h = text_hash(text_col)
    limit = int(-(2**63) + 2**64 * min(1.0, (2 * sample_docs + 50) / n))
    found = df.where(h <= F.lit(min(limit, 2**63 - 1))).select(F.substring(F.coalesce(text_col, F.lit("")), 1, 8 * sample_ids).alias("t"), h.alias("h")).orderBy("h").limit(sample_docs).select("t").collect()
    samples = [x[: 4 * sample_ids] + struct.pack("<I", end_id) for x in _Encoder(tokenizer_path).encode([r[0] for r in found])]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, key_col: str = "doc_id", text_col: str = "text", shards: int | None = None, level: int = 1) -> DataFrame:
    """Encodes every text, writes the shards in ascending key order, and returns their manifest.

    Null keys come first; equal keys are ordered by a hash of the text, so repeated rows lie side by side and one key
    may fill several shards. A null text is an empty one: its ids are just end_id. Shards hold about SHARD_BYTES of text at most,
    and there are as many as shuffle partitions at least, unless their number is given. The manifest
    (shard int, path string, first_start long, n_docs long, n_ids long) has a row per shard that holds documents.
    """
    spark = df.sparkSession
    ship(spark)
    total = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    dictionary = train_dictionary(df, tokenizer_path, end_id, text_col, rows=total["n"])
    fs, root = _store(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.bin") as f:
        f.write(dictionary)
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total["bytes"] or 0) // SHARD_BYTES))
    rows = df.select(F.col(key_col).cast("long").alias("k"), F.col(text_col).alias("t"), text_hash(text_col).alias("h"))
    rows = rows.repartitionByRange(n, F.col("k").asc_nulls_first(), "h").sortWithinPartitions(F.col("k").asc_nulls_first(), "h").withColumn("p", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("token_files", _encoder.cache_clear)
        own = _encoder(tokenizer_path)
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        fs, root = _store(folder)
        end = struct.pack("<I", end_id)
        index: list[bytes] = []
        at = ids = 0
        shard = None
        name = f"{root}/{uuid.uuid4().hex}"
        body = None
        for b in slices(batches, "t", 4 << 20):
            if body is None:
                shard = b.column("p")[0].as_py()
                body = fs.open_output_stream(f"{name}.frames")
            lists = own.encode_all(b.column("t"))
            flat, spans = lists.values.to_numpy().tobytes(), pairwise((4 * lists.offsets.to_numpy().astype(np.int64)).tolist())
            for k, (i, j) in zip(b.column("k").to_pylist(), spans, strict=True):
                frame = packer.compress(flat[i:j] + end)
                body.write(frame)
                count = (j - i) // 4 + 1
                index.append(struct.pack(ENTRY, k or 0, k is not None, at, len(frame), count))
                at += len(frame)
                ids += count
        if body is None:
            return
        body.close()
        with fs.open_output_stream(f"{name}.tmp") as out, fs.open_input_stream(f"{name}.frames") as frames:
            out.write(MAGIC + hashlib.sha256(dictionary).digest() + struct.pack("<I", len(index)))
            out.write(b"".join(index))
            while chunk := frames.read(1 << 22):
                out.write(chunk)
        fs.delete_file(f"{name}.frames")
        fs.move(f"{name}.tmp", f"{name}.cqids")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{name}.cqids"], "n_docs": pa.array([len(index)], pa.int64()), "n_ids": pa.array([ids], pa.int64())})

    made = sorted(rows.mapInArrow(run, "shard int, path string, n_docs long, n_ids long").collect(), key=lambda r: r["shard"])  # a row per shard
    start, manifest = 0, []
    for r in made:
        manifest.append((r["shard"], r["path"], start, r["n_docs"], r["n_ids"]))
        start += r["n_ids"]
    return spark.createDataFrame(manifest, "shard int, path string, first_start long, n_docs long, n_ids long")


class Shard:
    """Random access to one shard file."""

    def __init__(self, fs: pafs.FileSystem, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        head = self.file.read(len(MAGIC) + 36)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{path} is no token-id shard")
        if head[len(MAGIC) : -4] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        (n,) = struct.unpack("<I", head[-4:])
        self.index = np.frombuffer(self.file.read(n * struct.calcsize(ENTRY)), dtype=np.dtype([("id", "<i8"), ("has", "u1"), ("at", "<u8"), ("bytes", "<u4"), ("ids", "<u4")]))
        self.base = len(head) + n * struct.calcsize(ENTRY)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, i: int) -> np.ndarray:
        """Ids of the i-th document: one seek, one frame."""
        return self.run(i, i + 1)[0]

    def run(self, i: int, j: int) -> list[np.ndarray]:
        """Ids of the documents i .. j-1: their frames are read in one piece."""
        first, last = self.index[i], self.index[j - 1]
        start = int(first["at"])
        self.file.seek(self.base + start)
        data = memoryview(self.file.read(int(last["at"]) + int(last["bytes"]) - start))
        part = self.index[i:j]
        cuts = zip((part["at"].astype(np.int64) - start).tolist(), part["bytes"].tolist(), strict=True)
        return [np.frombuffer(self.unpacker.decompress(data[at : at + size]), dtype="<u4") for at, size in cuts]


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the shards: doc_id long (null as written), start long, ids array<int>."""
    ship(spark)
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        with fs.open_input_stream(f"{root}/dictionary.bin") as f:
            dictionary = f.read()
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("first_start").to_pylist(), strict=True):
                shard = Shard(fs, path, dictionary)
                total = len(shard.index)
                starts = start + np.concatenate([[0], np.cumsum(shard.index["ids"].astype(np.int64))])
                i = 0
                while i < total:  # about a million ids at a time, one document at least
                    j = max(i + 1, int(np.searchsorted(starts, starts[i] + (1 << 20), side="right")) - 1)
                    flat = [x.view(np.int32) for x in shard.run(i, j)]
                    part = shard.index[i:j]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part["id"].astype(np.int64), mask=part["has"] == 0),
                            pa.array(starts[i:j]),
                            pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)), pa.array(np.concatenate(flat))),
                        ],
                        names=["doc_id", "start", "ids"],
                    )
                    i = j

    return manifest.repartition(n, "shard").mapInArrow(run, "doc_id long, start long, ids array<int>")


def default_folder(spark: SparkSession) -> str:
    return new_path(spark, "ids")
