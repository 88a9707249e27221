"""Helpers shared by the training-data operators: table readers, the fixed train/test
fold, lineage cuts, and vectorised word hashing over Arrow text buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.session import shared_dir

U64 = np.uint64
MASK = (1 << 64) - 1

#: Bytes of text whose words are hashed at once; bounds the work arrays (about 100 bytes per byte).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts the lineage, outlives any
    executor, and lets several branches read one evaluation."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- word hashing -------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_P, _PINV):
            p = np.full(size, base, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (wrapping arithmetic)."""
    h = h ^ U64(seed & MASK)
    h = (h ^ (h >> U64(33))) * U64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U64(33))) * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def _hash_chunk(data: np.ndarray, starts_of_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data`` and the position where each begins. Words are
    maximal runs without ASCII white space; a document start also begins a word."""
    n = len(data)
    word = ~_SPACE[data]
    brk = np.zeros(n + 1, bool)
    brk[starts_of_docs] = True
    brk[n] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~word[:-1]
    start = np.flatnonzero(word & (before | brk[:n]))
    if not len(start):
        return np.empty(0, U64), start
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~word[1:]
    end = np.flatnonzero(word & (after | brk[1:])) + 1
    p, pinv = _powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum((_LOWER[data].astype(U64) + U64(1)) * p[:n], out=total[1:])
    return mix((total[end] - total[start]) * pinv[start], 0x5851F42D4C957F2D) + (end - start).astype(U64), start


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes, offsets (one more than rows) and validity of an Arrow string array."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.empty(0, np.uint8)
    valid = np.asarray(col.is_valid())
    return data, off, valid


def word_hashes(col: pa.Array) -> Iterator[np.ndarray]:
    """For each row of a string array, the hashes of its lower-cased (A-Z) words in order.
    Null and empty rows give an empty array. Work memory is bounded by ``CHUNK_BYTES``; a
    longer row is hashed in pieces cut at white space."""
    data, off, valid = text_buffers(col)
    n, i = len(off) - 1, 0
    empty = np.empty(0, U64)
    while i < n:
        j = i + 1
        while j < n and off[j + 1] - off[i] <= CHUNK_BYTES:
            j += 1
        lo, hi = int(off[i]), int(off[j])
        if hi == lo:
            yield from (empty for _ in range(i, j))
        elif j == i + 1:
            yield _long_row(data[lo:hi]) if valid[i] else empty
        else:
            h, at = _hash_chunk(data[lo:hi], (off[i:j] - lo)[off[i:j] < hi])
            cut = np.searchsorted(at, off[i : j + 1] - lo)
            for k in range(i, j):
                yield h[cut[k - i] : cut[k - i + 1]] if valid[k] else empty
        i = j


def _long_row(row: np.ndarray) -> np.ndarray:
    out, lo, n = [], 0, len(row)
    while lo < n:
        hi = min(n, lo + CHUNK_BYTES)
        if hi < n:
            gaps = np.flatnonzero(_SPACE[row[lo:hi]])
            while not len(gaps) and hi < n:  # one word longer than a chunk
                hi = min(n, hi + CHUNK_BYTES)
                gaps = np.flatnonzero(_SPACE[row[lo:hi]])
            if hi < n or len(gaps):
                hi = lo + int(gaps[-1]) + 1 if hi < n else hi
        out.append(_hash_chunk(row[lo:hi], np.zeros(1, np.int64))[0])
        lo = hi
    return np.concatenate(out) if out else np.empty(0, U64)
