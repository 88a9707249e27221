"""Line deduplication over overlapping windows of three lines (operator 4, native).

Every ``WINDOW`` consecutive lines of a document are one window, known by a 128-bit hash of
its lines; a text of fewer lines is one window, compared only with texts of as many lines.
A window that occurs more than once anywhere keeps its first occurrence (smallest
document id, then text hash, then line); each later one covers its lines, and covered lines,
merged over overlapping windows, are removed.

Windows are counted with partial aggregation, so one passage in a third of all documents is
a few rows per task; the occurrences are then joined to their first place (a plain equi-join,
whose large partitions adaptive execution splits).

Defined cases: a document is a (doc_id, text) pair, so fully equal rows are one document and
each gets its result, while rows that share an id but not the text are compared; null text
stays null with no lines; a passage of fewer lines than a window inside a longer text is never
removed; windows of blank lines only are ignored; line ends are ``\\n`` and lines compare exactly. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import written

WINDOW = 3


def line_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per window: doc_id, text_key, pos (first line, from 0), span (its lines), k1, k2."""
    lines = F.split("text", "\n", -1)
    hashed = F.transform(lines, lambda s: F.struct(
        F.xxhash64(s).alias("a"), F.xxhash64(s, F.lit(1)).alias("b"), (F.trim(s) == "").alias("blank")))
    # the generator evaluates the hashes once; its outer form keeps the optimizer from adding a second look
    once = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.explode_outer(F.array(hashed)).alias("h"))
    # a text shorter than a window is one window with nulls at its end
    span = F.least(F.size("h"), F.lit(window))
    shifted = [F.slice("h", F.lit(k + 1), F.size("h")).alias(f"l{k}") for k in range(window)]
    rows = once.select("doc_id", "text_key", span.alias("span"), *shifted).select(
        "doc_id", "text_key", "span", F.posexplode_outer(F.arrays_zip(*[f"l{k}" for k in range(window)])).alias("pos", "w"))
    part = [F.col(f"w.l{k}") for k in range(window)]
    blank = part[0]["blank"]
    for p in part[1:]:
        blank = blank & F.coalesce(p["blank"], F.lit(True))
    whole = part[-1].isNotNull() | ((F.col("span") < window) & (F.col("pos") == 0))
    return rows.where(whole & ~blank).select(
        "doc_id", "text_key", "pos", "span",
        F.xxhash64("span", *[p["a"] for p in part]).alias("k1"), F.xxhash64("span", *[p["b"] for p in part]).alias("k2"))


def covered_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, covered): sorted numbers of the lines to remove."""
    wins = written(line_windows(docs, window), "line-windows")
    at = F.struct(F.col("doc_id"), F.col("text_key"), F.col("pos"))
    first = (
        wins.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.max(at).alias("last"))
        .where(~F.col("first").eqNullSafe(F.col("last")))
        .select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "first")
    )
    later = wins.join(first, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2"))).where(~at.eqNullSafe(F.col("first")))
    # bounded by the lines of one document
    return later.groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("p"), F.max("span").alias("span")).select(
        "doc_id", "text_key",
        F.array_sort(F.array_distinct(F.flatten(F.transform("p", lambda x: F.sequence(x, x + F.col("span") - 1))))).alias("covered"))


def dedup_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with ``text`` reduced to the kept lines, and n_lines, n_removed, covered (extra
    columns of these three names are replaced)."""
    found = covered_lines(docs, window).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "covered")
    rest = [c for c in docs.columns if c not in ("n_lines", "n_removed", "covered")]
    rows = docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_text"))
    both = rows.join(found, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    lines = F.split("_row.text", "\n", -1)
    both = both.withColumn("_lines", F.when(F.col("covered").isNotNull(), lines))
    # two lists of line numbers; array_except is one hash pass
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("covered"))
    text = F.when(F.col("covered").isNull(), F.col("_row.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("_lines"), i)), "\n"))
    return both.select(
        *[text.alias(c) if c == "text" else F.col(f"_row.{c}").alias(c) for c in rest],
        F.when(F.col("_row.text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"), "covered")
