"""Texts of an Arrow slice cut at blanks, each distinct piece encoded once, ids gathered back: all in vectorised steps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Known:
    """Pieces and their ids as two Arrow arrays; dropped when they pass `most` bytes."""

    def __init__(self, most: int):
        self.most = most
        self.drop()

    def drop(self) -> None:
        self.pieces, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def look_up(self, pieces: pa.StringArray, ids_of: Callable[[list[str]], list[bytes]]) -> tuple[pa.ListArray, np.ndarray]:
        """Ids, and for each of the distinct pieces its place there; ids_of gets new ones and gives little-endian 32-bit ids."""
        if self.pieces.nbytes + self.ids.nbytes > self.most:
            self.drop()
        found = pc.index_in(pieces, self.pieces)
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).copy()
        new = pieces.filter(found.is_null())
        if len(new):
            made = ids_of(new.to_pylist())
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in made], dtype=np.int64)]).astype(np.int32)
            place[place < 0] = np.arange(len(self.pieces), len(self.pieces) + len(new))
            self.pieces = pa.concat_arrays([self.pieces, new])
            self.ids = pa.concat_arrays([self.ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(made), "<i4")))])
        return self.ids, place


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each starts (one more entry: the end). No nulls.

    Strings with 64-bit ends (spark.sql.execution.arrow.useLargeVarTypes) are taken as well, as long as they make up 2 GB at most; more raises, as any other type does.
    """
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    elif not pa.types.is_string(texts.type):
        raise TypeError(f"texts are {texts.type}, not strings")
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at.astype(np.int64) - at[0]


def _strings(ends: np.ndarray, data: np.ndarray) -> pa.StringArray:
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _points(data: np.ndarray) -> np.ndarray:
    """Where . or , follows an ASCII letter."""
    out = np.zeros(len(data), bool)
    out[1:] = ((data[1:] == 46) | (data[1:] == 44)) & (((data[:-1] | 32) - 97) < 26)
    return out


def stretches(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Stretches that make up the texts, and the number of those before each text (and the total).

    A word (no blank, no \\n) has the one blank before it; other blanks and \\n form stretches of their own. Words are cut
    where . or , follows an ASCII letter.
    """
    data, at = _bytes(texts)
    n = len(data)
    white = (data == 32) | (data == 10)
    before, after = np.empty(n, bool), np.empty(n, bool)
    first = np.zeros(n + 1, bool)
    first[at] = True
    before[1:], after[:-1] = white[:-1], white[1:]
    if n:
        before[0] = after[-1] = False
    after |= first[1:]  # as if white stood behind each text
    before[first[:-1]] = False
    line = np.zeros(n, bool)
    line[1:] = data[:-1] == 10
    starts = first[:-1] | (white & (~before | ~after)) | (~white & before & line) | _points(data)
    where = np.flatnonzero(starts)
    return _strings(np.append(where, n), data), np.searchsorted(where, at)


def runs(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """As stretches(), but the words alone: runs without blanks and \\n, cut where . or , follows an ASCII letter."""
    data, at = _bytes(texts)
    n = len(data)
    solid = (data != 32) & (data != 10)
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    first = at[:-1][np.diff(at) > 0]
    before[first] = False
    where = np.flatnonzero(solid & (~before | _points(data)))
    place = np.concatenate([[0], np.cumsum(solid)])
    return _strings(np.append(place[where], place[-1]), data[solid]), np.searchsorted(where, at)


def gathered(pieces: pa.StringArray, per_text: np.ndarray, known: Known, ids_of: Callable[[list[str]], list[bytes]]) -> pa.ListArray:
    """Per text the ids (int32) of its pieces in a row; each distinct piece is looked up once."""
    coded = pieces.dictionary_encode()
    ids, place = known.look_up(coded.dictionary, ids_of)
    taken = pc.take(ids, pa.array(place[coded.indices.to_numpy()]))
    bounds = taken.offsets.to_numpy()[per_text] if len(taken) else np.zeros(len(per_text), np.int32)
    pa.default_memory_pool().release_unused()
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), taken.values)
