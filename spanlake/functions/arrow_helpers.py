"""Vectorised Arrow helpers for the two things built-in SQL cannot do in linear time
inside a row: tokens with their offsets and the longest common subsequence.

Tokens are cut from many rows at once (array operations on code points, no per-row
Python objects); the LCS is a bit-parallel loop per row over Arrow-batched input.

A result several times its input is made and handed back in pieces of bounded size (iterator
functions), so a worker holds Spark's input batch and one piece, whatever the batch grows to.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Python's whitespace set (what str.split()/strip() remove), derived by rule; the same
# characters as ``text.WS_CLASS``.
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

TOKEN_TYPE = T.ArrayType(
    T.StructType([
        T.StructField("tok", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
    ])
)


#: Bytes of text that are cut into tokens at once; bounds the work arrays (about 50 bytes per byte) and the result.
CUT_BYTES = 1 << 20
_WORD, _SPACE = 1, 2


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point: a word character (letter, mark, number, underscore), white space, or neither."""
    out = np.fromiter((unicodedata.category(chr(c))[0] in "LMN" for c in range(0x110000)), np.uint8, 0x110000)
    out[ord("_")] = _WORD
    out[[ord(c) for c in WS_CHARS]] = _SPACE
    return out


def _code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte where each begins."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    cp = data[at].astype(np.int32)
    for size, lead, low in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        here = np.flatnonzero(cp >= lead) if size == 4 else np.flatnonzero((cp >= lead) & (cp < lead + low + 1))
        value = cp[here] & low
        for k in range(1, size):
            value = (value << 6) | (data[at[here] + k] & 0x3F)
        cp[here] = -value  # negative: decoded
    return np.abs(cp), at


def _cut(data: np.ndarray, row_at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Tokens (structs of text, start, end) of texts that stand one after another in ``data``, and the number
    of the first token of each row (one more than rows)."""
    cp, at = _code_points(data)
    kind = _classes()[cp]
    first = np.searchsorted(at, row_at)  # code point where each row begins
    edge = np.zeros(len(cp) + 1, bool)
    edge[first] = True
    word = kind == _WORD
    before, after = np.empty(len(cp), bool), np.empty(len(cp), bool)
    before[:1], before[1:] = False, word[:-1]
    after[-1:], after[:-1] = False, word[1:]
    alone = kind == 0
    start = np.flatnonzero(alone | (word & (~before | edge[:-1])))
    end = np.flatnonzero(alone | (word & (~after | edge[1:]))) + 1
    size = np.append(at, len(data))
    text_at = np.concatenate(([0], np.cumsum(size[end] - size[start])))
    if (kind == _SPACE).any():
        data = data[np.repeat(kind != _SPACE, np.diff(size))]
    toks = pa.StringArray.from_buffers(len(start), pa.py_buffer(text_at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    token_at = np.searchsorted(start, first)
    base = np.repeat(first[:-1], np.diff(token_at))
    items = pa.StructArray.from_arrays(
        [toks, pa.array((start - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], names=["tok", "start", "end"])
    return items, token_at


def pieces(rows: pa.Array, sizes: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Successive slices of the rows whose sizes (null: 0) sum to ``limit`` at most; a larger row is a slice of its own."""
    at = np.concatenate(([0], np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield rows.slice(i, j - i)
        i = j


def text_pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """Successive slices of ``CUT_BYTES`` of text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    return pieces(texts, pc.binary_length(texts), CUT_BYTES)


def tokenize(texts: pa.Array) -> pa.Array:
    """Texts to ``array<struct<tok, start, end>>``: runs of word characters and single other characters that are
    not white space, with 0-based code-point offsets. All are cut at once, by array operations on the code points."""
    null = texts.is_null()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, body = texts.buffers()
    row_at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
    items, token_at = _cut(data[row_at[0] : row_at[-1]], row_at - row_at[0])
    return pa.ListArray.from_arrays(pa.array(token_at.astype(np.int32)), items, mask=null)


@F.arrow_udf(TOKEN_TYPE)
def text_to_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``string`` -> ``array<struct<tok,start,end>>``, in pieces of ``CUT_BYTES`` of text."""
    for texts in batches:
        for piece in text_pieces(texts):
            yield tokenize(piece)


#: Windows whose candidates are searched at once; bounds the work arrays (about 100 bytes per position).
SEARCH_ROWS = 512
SPAN_TYPE = T.StructType([
    T.StructField("score", T.FloatType()),
    *[T.StructField(c, T.IntegerType()) for c in ("si", "ei", "start_char", "end_char")],
])


def _matrix(lists: pa.Array, width: int, fill: float, kind: type) -> np.ndarray:
    """A list array as rows of ``width`` values; what a list lacks or has as null is ``fill``."""
    at = np.asarray(lists.offsets, np.int64)
    values = lists.flatten()
    at = at - at[0]
    size = np.diff(at)
    out = np.full((len(lists), width), fill, kind)
    if len(values):
        flat = values.fill_null(fill).to_numpy(zero_copy_only=False).astype(kind)
        place = np.arange(width)[None, :] < size[:, None]
        out[place] = flat
    return out


def _top(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of each row's ``n`` largest, largest first, the higher position first on ties."""
    width = values.shape[1]
    n = min(n, width)
    back = values[:, ::-1]  # a stable sort of the reversed row puts the higher position first
    if n < width:  # everything above the n-th value, and as many of its ties from the end as are needed
        least = -np.partition(-back, n - 1, axis=1)[:, n - 1 : n]
        more = back > least
        ties = (back == least) & (np.cumsum(back == least, axis=1) <= n - more.sum(axis=1, keepdims=True))
        pos = np.nonzero(more | ties)[1].reshape(len(back), n)
    else:
        pos = np.broadcast_to(np.arange(width), back.shape)
    found = np.take_along_axis(back, pos, axis=1)
    order = np.argsort(-found, axis=1, kind="stable")
    return width - 1 - np.take_along_axis(pos, order, axis=1), np.take_along_axis(found, order, axis=1)


def span_search(start: np.ndarray, end: np.ndarray, from_char: np.ndarray, to_char: np.ndarray, n_best: int, max_tokens: int) -> tuple[np.ndarray, ...]:
    """(score, rank of the start, rank of the end, first char, last char) per row of logits; rank -1 where no
    candidate is admissible. Positions without offset have ``from_char`` -1."""
    rows = np.arange(len(start))
    s_at, s_val = _top(start, n_best)
    e_at, e_val = _top(end, n_best)
    known = from_char >= 0
    s_ok = np.take_along_axis(known, s_at, axis=1) & (s_val > -np.inf)
    e_ok = np.take_along_axis(known, e_at, axis=1) & (e_val > -np.inf)
    best = np.full(len(start), -np.inf, np.float32)
    si, ei = np.full(len(start), -1), np.full(len(start), -1)
    reach = e_val[:, 0] if e_val.shape[1] else np.empty(0, np.float32)
    open_rows = rows
    for k in range(s_at.shape[1]):
        # starts fall, so a row ends when this start with the best end of all is no better
        open_rows = open_rows[s_val[open_rows, k] + reach[open_rows] > best[open_rows]]
        if not len(open_rows):
            break
        r = open_rows[s_ok[open_rows, k]]
        span = e_at[r] - s_at[r, k][:, None]
        ends = np.where(e_ok[r] & (span >= 0) & (span < max_tokens), e_val[r], -np.inf)
        pick = ends.argmax(axis=1)  # the first of equal ends
        found = s_val[r, k] + ends[np.arange(len(r)), pick]
        better = found > best[r]
        r, pick = r[better], pick[better]
        best[r], si[r], ei[r] = found[better], k, pick
    hit = si >= 0
    first, last = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
    first[hit] = from_char[rows[hit], s_at[rows[hit], si[hit]]]
    last[hit] = to_char[rows[hit], e_at[rows[hit], ei[hit]]]
    return best, si, ei, first, last


@functools.cache
def best_candidates(n_best: int, max_tokens: int):
    """Arrow function (start logits, end logits, offset starts, offset ends) -> the best admissible candidate."""

    def find(start: pa.Array, end: pa.Array, from_char: pa.Array, to_char: pa.Array) -> pa.Array:
        width = max([0, *(int(np.diff(np.asarray(x.offsets)).max(initial=0)) for x in (start, end, from_char))])
        logits = [np.nan_to_num(_matrix(x, width, np.nan, np.float32), copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf) for x in (start, end)]
        score, si, ei, first, last = span_search(*logits, _matrix(from_char, width, -1, np.int64), _matrix(to_char, width, -1, np.int64), n_best, max_tokens)
        cols = [pa.array(score), *(pa.array(x.astype(np.int32)) for x in (si, ei, first, last))]
        return pa.StructArray.from_arrays(cols, names=["score", "si", "ei", "start_char", "end_char"], mask=pa.array(si < 0))

    @F.arrow_udf(SPAN_TYPE)
    def search(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            whole = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in batch]
            for i in range(0, len(whole[0]), SEARCH_ROWS):
                yield find(*(x.slice(i, SEARCH_ROWS) for x in whole))

    return search


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token lists (bit-parallel)."""
    if not a or not b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    masks: dict = {}
    for j, tok in enumerate(b):
        masks[tok] = masks.get(tok, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for tok in a:
        u = v & masks.get(tok, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Arrow-batched LCS length of two ``array<string>`` columns."""
    return pd.Series(
        [
            None if (x is None or y is None) else lcs_length(list(x), list(y))
            for x, y in zip(a, b)
        ],
        dtype="Int32",
    )
