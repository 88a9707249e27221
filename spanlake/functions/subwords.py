"""Sub-word tokens of a public byte-level BPE vocabulary: encode with character offsets, decode.

The vocabulary is a file of the ``tokenizers`` library (JSON), given as its text: it is read once by
the driver, sent to the workers as one broadcast of fixed size, and compiled once per worker. Tokenizers
are never trained here. The merges run in ``tiktoken`` (equal ids, tested); offsets come from the
tokens' byte lengths by array operations, so many rows are handled without an
object per token, in pieces of bounded size. Strings of the file's special tokens in a text become their ids, as that library does.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.arrow_helpers import pieces, text_pieces

SUBWORD_TYPE = T.ArrayType(T.StructType([
    T.StructField("tok", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("id", T.IntegerType())]))
#: Ids that are decoded at once.
DECODE_IDS = 1 << 18
# fixed value: the split pattern of byte-level pre-tokenisation
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand
    for themselves, the others follow from code point 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A compiled vocabulary: ``encode(text)`` to ids, and of each id its bytes and its name in the file."""

    def __init__(self, text: str):
        import tiktoken

        spec, at = json.loads(text), byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(at[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
        self.encoding = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names = {i: tok for tok, i in spec["model"]["vocab"].items()} | {i: tok for tok, i in special.items()}
        size = max(names) + 1
        self.names = pa.array([names.get(i, "") for i in range(size)])
        raw = {i: b for b, i in ranks.items()} | {i: tok.encode() for tok, i in special.items()}
        self.raw = [raw.get(i, b"") for i in range(size)]
        self.n_bytes = np.fromiter(map(len, self.raw), np.int64, size)
        self.spelt = pa.array([*self.raw, b""], pa.large_binary())  # the last one: ids that the vocabulary lacks

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(np.int64)

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """0-based code-point offsets of each token, end exclusive; a token that holds a part of a character
        has that character."""
        body = np.frombuffer(text.encode(), np.uint8)
        begun = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))  # characters begun before each byte
        end = np.cumsum(self.n_bytes[ids])
        return begun[end - self.n_bytes[ids] + 1] - 1, begun[end]

    def tokens(self, texts: pa.Array) -> pa.Array:
        """Texts to ``array<struct<tok, start, end, id>>``."""
        none = np.empty(0, np.int32)
        ids, starts, ends, at = [none], [none], [none], [0]
        for t in texts.to_pylist():
            got = self.encode(t) if t else none
            a, b = self.offsets(t, got) if t else (none, none)
            for held, x in ((ids, got), (starts, a), (ends, b)):
                held.append(x.astype(np.int32))
            at.append(at[-1] + len(got))
        flat = pa.array(np.concatenate(ids))
        items = pa.StructArray.from_arrays(
            [self.names.take(flat), *(pa.array(np.concatenate(x)) for x in (starts, ends)), flat], names=["tok", "start", "end", "id"])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), items, mask=texts.is_null())

    def token_pieces(self, texts: pa.Array) -> Iterator[pa.Array]:
        """``tokens``, some rows at a time."""
        return map(self.tokens, text_pieces(texts))

    def decode(self, ids) -> str:
        return b"".join(self.raw[i] for i in ids if 0 <= i < len(self.raw)).decode(errors="replace")

    def texts(self, ids: pa.Array) -> pa.Array:
        """``decode`` of each list, without an object per id; null lists give null."""
        size = pc.list_value_length(ids)
        at = np.concatenate(([0], np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)))
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        spelt = self.spelt.take(pa.array(np.where((flat < 0) | (flat >= len(self.raw)), len(self.raw), flat)))
        _, ends, body = spelt.buffers()
        body = body or pa.py_buffer(b"")  # no bytes at all
        byte_at = np.frombuffer(ends, np.int64)[spelt.offset : spelt.offset + len(spelt) + 1][at].tolist()
        known = size.is_valid().to_pylist()
        return pa.array([body[a:b].to_pybytes().decode(errors="replace") if k else None for a, b, k in zip(byte_at, byte_at[1:], known)], pa.string())

    def decoded_pieces(self, ids: pa.Array) -> Iterator[pa.Array]:
        """``texts``, some rows at a time."""
        whole = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        return map(self.texts, pieces(whole, pc.list_value_length(whole), DECODE_IDS))


@functools.lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    """The compiled vocabulary of a file's text (kept by the process)."""
    return Vocabulary(text)


def subword_array(spark: SparkSession, text: str):
    """Function from a text column to ``array<struct<tok, start, end, id>>``; null texts give null."""
    shared = spark.sparkContext.broadcast(text)

    @F.arrow_udf(SUBWORD_TYPE)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(shared.value)
        for texts in batches:
            yield from v.token_pieces(texts)

    return lambda col: encode(F.col(col) if isinstance(col, str) else col)


def decode_ids(spark: SparkSession, text: str):
    """Function from an id array column to text; ids that the vocabulary lacks are left out, bytes that are
    no whole character become U+FFFD."""
    shared = spark.sparkContext.broadcast(text)

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(shared.value)
        for ids in batches:
            yield from v.decoded_pieces(ids)

    return lambda col: decode(F.col(col) if isinstance(col, str) else col)


def public_vocabulary(path: str | None = None) -> str:
    """Text of a vocabulary file; by default the byte-level BPE file of the installed public vocabularies."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def ids_of(tokens: Column | str) -> Column:
    return F.transform(F.col(tokens) if isinstance(tokens, str) else tokens, lambda t: t["id"])
