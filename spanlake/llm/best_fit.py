"""Best-fit packing of tokenised documents by linear grouping (operator 12).

A document is its token ids and an end id. Documents longer than ``capacity`` are cut into pieces
of ``capacity`` ids, of which only the first may be shorter. Tokenising and cutting is one pass
over the texts, written as a narrow table of pieces; packing never sees a text or an id.

Packing works by linear grouping. The number of pieces of each length (at most ``capacity`` counts)
goes to the driver, where ``bin_plan`` rounds the large lengths up within groups of equal
cardinality and optimises configurations of the few sizes that are left. Then the actual pieces are
substituted: a piece's rank in its group tells the configuration, the bin and the slot that it
takes (arithmetic on a small table of rank intervals). Bins now have their true slack; the counts
of slacks (again at most ``capacity``) go to the driver, the small lengths are planned best-fit, longest
first, on counts, and each small piece finds its bin by its rank among the pieces of its length
and the bin's rank among the bins of its slack.

Ranks are exact and distributed: a class is cut into hash buckets of about the square root of its
size, bucket sizes are summed up to offsets, and rows are numbered inside buckets, so a length that a third
of all pieces share is spread over many tasks.

Tokens: the file is a byte-level BPE vocabulary of the ``tokenizers`` library (JSON); the same
merges run in ``tiktoken``, which gives equal ids (tested) in a fifth of the CPU time.
Strings of the file's special tokens in a text become their ids, as that library does by default.

Defined cases: a null or empty text is its end id alone; a null doc_id is kept; repeated rows are
documents of their own; ties in rank are put in order by (doc_id, piece, start, length, checksum), and fully
equal pieces are interchangeable; an empty table gives an empty result; extra columns are ignored.
A very long text is encoded whole in one task (its ids take four bytes each).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.functions.subwords import vocabulary as compiled
from spanlake.llm import bin_plan
from spanlake.llm.common import written

CAPACITY = 1024
END_ID = 2
#: Rows of a rank bucket at least.
BUCKET_ROWS = 512

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: all of ``capacity`` but the first."""
    n = len(ids)
    ends = range(n - (n - 1) // capacity * capacity, n + 1, capacity)
    return [(max(0, e - capacity), e) for e in ends]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = compiled(shared.value).encode
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                rows += [(doc_id, k, lo, hi - lo, zlib.crc32(ids[lo:hi].tobytes())) for k, (lo, hi) in enumerate(cut(ids, capacity))]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def buckets(n: int) -> int:
    return max(1, -(-n // max(BUCKET_ROWS, math.isqrt(n))))


def ranked(df: DataFrame, kind: str, counts: dict[int, int], order: list[str], no: str) -> DataFrame:
    """Adds ``no``, the 0-based rank of each row among the rows of its ``kind`` (of which ``counts`` has
    the numbers; at most ``capacity`` kinds)."""
    spark = df.sparkSession
    many = spark.createDataFrame([(k, buckets(n)) for k, n in counts.items()], f"{kind} int, _n int")
    df = df.join(F.broadcast(many), kind).withColumn("_b", F.pmod(F.xxhash64(*order), F.col("_n")).cast("int")).drop("_n")
    per = df.groupBy(kind, "_b").agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy(kind).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(kind).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(kind, "_b").orderBy(*order))
    return df.withColumn("_in", inside).join(per, (F.col(kind) == F.col("_k")) & (F.col("_b") == F.col("_kb"))).withColumn(
        no, F.col("_off") + F.col("_in") - 1).drop("_b", "_k", "_kb", "_off", "_in")


def _counts(df: DataFrame, col: str | Column) -> dict[int, int]:
    """How many rows have each value of a column of lengths (at most capacity + 1 values)."""
    return {r[0]: r[1] for r in df.groupBy(col).agg(F.count(F.lit(1))).collect()}


def slots(plan: list[tuple[tuple[int, ...], int]], sizes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, rank after the last, pieces a bin, first bin): which ranks of a group go where."""
    used, first, out = [0] * len(sizes), 0, []
    for config, bins in plan:
        for k, m in enumerate(config):
            if m:
                out.append((sizes[k], used[k], used[k] + m * bins, m, first))
                used[k] += m * bins
        first += bins
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``. ``parts`` is a written table of pieces."""
    spark = parts.sparkSession
    have = _counts(parts, "length")
    large = int(capacity * bin_plan.LARGE)
    groups = bin_plan.group(have, large, capacity)
    sizes = [g[0] for g in groups]
    plan = bin_plan.configurations(sizes, [g[2] for g in groups], capacity)
    kind_of = {x: size for size, first, _ in groups for x in have if first <= x <= size} | {x: x for x in have if x <= large}
    members: dict[int, int] = {}
    for x, n in have.items():
        members[kind_of[x]] = members.get(kind_of[x], 0) + n

    # at most ``capacity`` rows
    kinds = spark.createDataFrame(list(kind_of.items()), "_l long, kind int")
    order = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = parts.join(F.broadcast(kinds), F.col("length") == F.col("_l")).drop("_l")
    rows = written(ranked(rows, "kind", members, order, "no"), "ranked-pieces")

    # large pieces take the slots of their group's ranks; at most a row per configuration and size
    where = spark.createDataFrame(slots(plan, sizes), "size int, lo long, hi long, m long, bin long")
    big = rows.where(F.col("kind") > large).join(
        F.broadcast(where), (F.col("kind") == F.col("size")) & (F.col("no") >= F.col("lo")) & (F.col("no") < F.col("hi")))
    big = big.withColumn("sequence_id", F.col("bin") + F.floor((F.col("no") - F.col("lo")) / F.col("m")))
    own = Window.partitionBy("sequence_id")  # one bin: fewer than 1 / LARGE pieces
    before = own.orderBy("kind", "no").rowsBetween(Window.unboundedPreceding, -1)
    big = written(big.select(
        *order, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"),
        (F.lit(capacity) - F.sum("length").over(own)).cast("int").alias("slack")), "large-places")

    # small pieces, best-fit on counts of slacks and lengths
    bins = big.where("offset = 0 and slack > 0").select("sequence_id", "slack")
    open_bins = _counts(bins, "slack")
    flows = bin_plan.best_fit(open_bins, {x: n for x, n in have.items() if x <= large}, capacity)
    filled = {f[3] for f in flows if f[3] < capacity}
    flow = spark.createDataFrame(flows, "size int, at long, items long, origin int, lo long, per long, base long")
    small = rows.where(F.col("kind") <= large).join(
        F.broadcast(flow), (F.col("kind") == F.col("size")) & (F.col("no") >= F.col("at")) & (F.col("no") < F.col("at") + F.col("items")))
    step = F.col("no") - F.col("at")
    small = small.select(*order, "origin", (F.col("lo") + F.floor(step / F.col("per"))).alias("bin"), (F.col("base") + step % F.col("per") * F.col("length")).alias("offset"))
    numbered = ranked(bins.where(F.col("slack").isin(sorted(filled))), "slack", {s: open_bins[s] for s in filled}, ["sequence_id"], "bin_no")
    new = F.lit(sum(n for _, n in plan)) + F.col("bin")
    placed = small.join(numbered, (F.col("origin") == F.col("slack")) & (F.col("bin") == F.col("bin_no")), "left").select(
        *order, F.when(F.col("origin") == capacity, new).otherwise(F.col("sequence_id")).alias("sequence_id"), "offset")
    return big.drop("slack").unionByName(placed)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. ``vocabulary`` is the text of a byte-level BPE file."""
    return pack(written(pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
