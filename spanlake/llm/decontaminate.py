"""Benchmark decontamination (operator 10).

All windows of ``WINDOW`` consecutive words of the benchmark's questions and answers go into
an Aho-Corasick automaton over normalised text (A-Z lower-cased, everything that is not a
word turned into one space). Each document is normalised as bytes and scanned once; the words
of every occurrence are marked, and word numbers are mapped back to character offsets of the
original text for the documents that have a hit.

The automaton holds at most ``MAX_PATTERN_BYTES`` of distinct windows; a larger benchmark is
dealt into several automata (by window hash), each scanned in turn inside the same task, so
memory is bounded and no window is lost. The automata know window numbers only; which items
hold a window is a table, joined once for each distinct set of windows that documents hit.

Defined cases: null and empty texts have no words and no hit; an item with fewer than
``WINDOW`` words is one window, an item without words is none; windows shared by items count
for each item; the windows of an item without id mark words but name no item; repeated document rows
give repeated result rows; an empty benchmark hits nothing, an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written

WINDOW = 10
MAX_PATTERN_BYTES = 32 << 20

#: Non-words become spaces, A-Z lower case; bytes over 0x7F are parts of words.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalise(text: str) -> bytes:
    """Words in order, single spaces between them and one at either end."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_TABLE).split()) + b" "


def item_windows(text: str | None, window: int = WINDOW) -> list[bytes]:
    words = normalise(text or "").split()
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (window binary, item_id) pairs; rows without id keep their windows under a null id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wins = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in dict.fromkeys(item_windows(t, window)):
                    ids.append(i)
                    wins.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), pa.array(ids, pa.string())], ["window", "item_id"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(rows, "window binary, item_id string").distinct()


def _automaton(patterns: list[tuple[str, int, int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for p, n, no in patterns:
        a.add_word(p, (len(p), n, no))
    a.make_automaton()
    return a


def scan(text: str, automata: list) -> tuple[int, np.ndarray | None, set[int]]:
    """Number of words, a mark for every word inside an occurrence (None: no hit), windows hit."""
    norm = normalise(text)
    n = norm.count(b" ") - 1 if len(norm) > 2 else 0
    if not n:
        return 0, None, set()
    line = norm.decode("latin-1")
    hits, wins = [], set()
    for a in automata:
        for end, (length, words, no) in a.iter(line):
            hits.append((end - length + 1, words))
            wins.add(no)
    if not hits:
        return n, None, wins
    spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    first = np.searchsorted(spaces, [h[0] for h in hits])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + np.array([h[1] for h in hits]), -1)
    return n, np.cumsum(edge[:n]) > 0, wins


def spans(text: str, mark: np.ndarray) -> list[tuple[int, int]]:
    """Runs of marked words as (start, end) code point offsets of the original text."""
    out: list[tuple[int, int]] = []
    open_run = False
    for k, m in enumerate(_WORD.finditer(text)):
        if mark[k]:
            out.append((out.pop()[0] if open_run else m.start(), m.end()))
        open_run = bool(mark[k])
    return out


SCANNED = "doc_id long, n_words long, n_hit long, spans string, wins array<long>"


def _shares(benchmark: DataFrame, window: int, max_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """Distinct windows with a number, dealt into shares of about ``max_bytes`` (columns window, no, _share);
    (no, item_id) pairs; and the number of shares."""
    pairs = written(benchmark_windows(benchmark, window), "bench-pairs")
    total = pairs.select("window").distinct().agg(F.sum(F.length("window") + 16)).first()[0] or 0
    parts = -(-int(total) // max_bytes) or 1
    # the numbers are kept by the write
    wins = pairs.select("window").distinct().select("window", F.monotonically_increasing_id().alias("no"), F.pmod(F.xxhash64("window"), F.lit(parts)).alias("_share"))
    wins = written(wins, "bench-windows")
    owners = pairs.where(F.col("item_id").isNotNull()).join(wins.select("window", "no"), "window").select("no", "item_id")
    return wins, written(owners, "bench-owners"), parts


def _with_items(scanned: DataFrame, owners: DataFrame) -> DataFrame:
    """Adds n_items and items_sha256. Documents that hit the same windows (copies, and all that quote one
    passage) look their items up once."""
    hits = scanned.where(F.size("wins") > 0).select("wins").distinct()
    # an item list is as long as the contract's digest input
    items = hits.select("wins", F.explode("wins").alias("_no")).join(owners, F.col("_no") == F.col("no")).groupBy("wins").agg(
        F.array_sort(F.collect_set("item_id")).alias("items")).select(
        F.col("wins").alias("_wins"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    none = hashlib.sha256().hexdigest()
    return scanned.join(items, F.col("wins") == F.col("_wins"), "left").select(
        "doc_id", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """One row per document row with its hits; ``spans`` lists start:end of the runs of hit words
    (code points of the original text)."""
    wins, owners, parts = _shares(benchmark, window, max_bytes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if parts == 1:
        return _with_items(written(docs.mapInArrow(_scanner(_rows(wins)), SCANNED), "scanned"), owners)
    # documents are scanned against one bounded share at a time; what the shares find is put
    # together by document (marks as runs of word numbers)
    docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "scan-docs")
    found = None
    for k in range(parts):
        hit = docs.select("_row", "text").mapInArrow(_run_finder(_rows(wins.where(F.col("_share") == k))), "_row long, lo long, hi long, wins array<long>")
        hit = written(hit, "scan-share")
        found = hit if found is None else found.unionByName(hit)
    return _with_items(written(_put_together(docs, found), "scanned"), owners)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """The rows whose text holds no window, all columns unchanged: a filter per share, no join."""
    wins, _, parts = _shares(benchmark, window, max_bytes)
    for k in range(parts):
        docs = docs.where(_clean(_rows(wins.where(F.col("_share") == k)))(F.col("text").cast("string")))
    return docs


def _clean(share: list):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automata = [_automaton(share)] if share else []
        for texts in batches:
            yield pd.Series([scan(t, automata)[1] is None if isinstance(t, str) else True for t in texts], dtype=bool)

    return clean


def _rows(wins: DataFrame) -> list[tuple[str, int, int]]:
    """The windows of one share (at most ``max_bytes``) with their words and numbers."""
    return [(bytes(r[0]).decode("latin-1"), bytes(r[0]).count(b" ") - 1, r[1]) for r in wins.select("window", "no").collect()]


def _scanned(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_words", "n_hit", "spans", "wins"])


def _scanner(share: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [_automaton(share)] if share else []
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                n, mark, wins = scan(text, automata)
                hit = int(mark.sum()) if mark is not None else 0
                rows.append((d, n, hit, ",".join(f"{s}:{e}" for s, e in spans(text, mark)) if hit else "", sorted(wins)))
            yield _scanned(rows)

    return run


def _run_finder(share: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [_automaton(share)] if share else []
        for b in batches:
            rows: list[tuple] = []
            for row, t in zip(b.column(0).to_pylist(), b.column(1)):
                _, mark, wins = scan(t.as_py() or "", automata)
                if mark is not None:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
                    for k, (lo, hi) in enumerate(zip(edge[::2].tolist(), edge[1::2].tolist())):
                        rows.append((row, lo, hi, sorted(wins) if k == 0 else []))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))],
                ["_row", "lo", "hi", "wins"])

    return run


def _put_together(docs: DataFrame, found: DataFrame) -> DataFrame:
    # a document's runs and windows are bounded by its words
    per = found.groupBy(F.col("_row").alias("_r")).agg(
        F.collect_list(F.struct("lo", "hi")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("wins")))).alias("wins"))
    both = docs.join(per, F.col("_row") == F.col("_r"), "left").select("doc_id", "text", "runs", "wins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, runs, wins in zip(*(c.to_pylist() for c in b.columns)):
                n = len(normalise(t or "").split())
                mark = np.zeros(n, bool)
                for r in runs or []:
                    mark[r["lo"] : r["hi"]] = True
                hit = int(mark.sum())
                rows.append((d, n, hit, ",".join(f"{s}:{e}" for s, e in spans(t or "", mark)) if hit else "", wins or []))
            yield _scanned(rows)

    return both.mapInArrow(run, SCANNED)
