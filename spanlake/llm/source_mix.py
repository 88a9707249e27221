"""Mixing sources to target weights (operator 9, native).

Each document gets a hash-random key. Inside its source the documents are put in key order
by range: the key space is cut into ``BUCKETS`` equal ranges (even, because keys are hashes,
so a source with a third of all rows is spread over all its ranges), sizes are summed per
(source, range) with partial aggregation, a prefix sum over at most ``BUCKETS`` range totals
gives each range its offset, and a running sum inside a range gives each document its exact
prefix. The source's budget is cut there: whole epochs of every document, one more epoch of
the documents in front of the cut, and the words up to the cut of the one that it falls in.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its
own, placed last; repeated rows are separate documents of equal key (ties are put in order
by text hash; fully equal rows get consecutive places, whichever of them comes first);
without any words every target is 0. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.common import written

#: Ranges of the key space per source; one range holds 1/BUCKETS of a source.
BUCKETS = 4096
KEY_BITS = 60
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"


def n_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_key(doc_id: Column) -> Column:
    """Hash-random 60-bit key of a document."""
    hexed = F.substring(F.md5(F.concat(F.lit(f"{SEED}|"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 15)
    return F.conv(hexed, 16, 10).cast("long")


def targets(sizes: DataFrame, total_share: float = TOTAL_SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(src, source_size) to (src, source_size, target). ``src`` is ordered by code point,
    null last. Targets are proportional to the weights up to ``max_epochs`` times the size:
    with sources by rising size/weight, the first ones are full and the level of the others is
    (total - full sizes) / (weights not full); a source is full when that level reaches it.
    One row per source; the two windows hold the table of sources, not documents."""
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    cap = (F.col("source_size") * max_epochs).cast("double")
    s = sizes.select("src", "source_size", weight.alias("w"), cap.alias("cap")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("_full"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("_open"),
        (F.sum("source_size").over(everything) * F.lit(total_share)).alias("_total"),
    ).withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    # the level of the sources that are not full is the one of the first of them, in this order
    level = F.min(F.when(F.col("_level") < F.col("ratio"), F.struct("ratio", "_level"))).over(everything)
    s = s.withColumn("_level", level["_level"])
    return s.select(
        "src", "source_size",
        F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_level") * F.col("w"))).alias("target"),
    )


def prefix_sums(df: DataFrame, part: str, key: str, value: str, ties: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``prefix``: the sum of ``value`` over the rows of the same ``part`` with a smaller
    (key, ties). ``key`` is uniform in [0, 2**60). No task holds more than one range."""
    df = df.withColumn("_b", F.shiftright(key, KEY_BITS - (buckets.bit_length() - 1)).cast("int"))
    per = df.groupBy(part, "_b").agg(F.sum(value).alias("_s"))
    ahead = Window.partitionBy(part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(part).alias("_p"), F.col("_b").alias("_pb"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(part, "_b").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return ranked.join(per, F.col(part).eqNullSafe(F.col("_p")) & (F.col("_b") == F.col("_pb"))).withColumn(
        "prefix", F.col("_off") + F.col("_in")).drop("_b", "_p", "_pb", "_off", "_in")


def mix_sources(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken (words taken, repeats
    counted), epochs (whole copies) and part (words of a further, cut copy)."""
    base = written(docs.select(
        "doc_id", F.col("source").cast("string").alias("src"), n_words(F.col("text")).alias("size"),
        mix_key(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("tie"),
    ), "mix-sizes")
    goal = targets(base.groupBy("src").agg(F.sum("size").alias("source_size"))).withColumnRenamed("src", "_src")
    placed = prefix_sums(base, "src", "key", "size", ["doc_id", "tie"])
    out = placed.join(goal, F.col("src").eqNullSafe(F.col("_src")))
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("prefix"))).cast("long")
    return out.select(
        "doc_id", "size", F.col("src").alias("source"), "source_size", "target",
        (whole * F.col("size") + more).alias("taken"), whole.alias("_whole"), more.alias("_more"),
    ).withColumn("epochs", F.col("_whole") + ((F.col("_more") == F.col("size")) & (F.col("size") > 0)).cast("long")).withColumn(
        "part", F.when(F.col("_more") == F.col("size"), F.lit(0)).otherwise(F.col("_more")).cast("long")).drop("_whole", "_more")
