"""Corpus pipeline over ``documents``: five stages, each applying one training-data operator.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as
Parquet to the shared folder and hands the reread table to the next one.

1. toxicity: documents that the classifier rejects go.
2. line_dedup: later occurrences of repeated three-line windows are cut out of the texts; a
   document none of whose lines remain goes (it is wholly a repeat).
3. near_dedup: of each group of near copies (five-word shingles, similarity 0.8 or more) the
   document of the smallest id stays.
4. decontaminate: documents that hold a benchmark window go.
5. mix_sources: the remaining documents with the words that the mix takes of each
   (``taken``), as ``epochs`` whole copies and ``part`` words of a further one; documents of
   which it takes nothing go.

Null and empty texts pass all filters (they are neither toxic nor copies nor contaminated) and the
mix takes nothing of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import decontaminate as decontamination
from spanlake.llm import line_dedup as lines
from spanlake.llm import near_dedup as near
from spanlake.llm import source_mix, toxicity
from spanlake.llm.common import table, written


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the training fold of ``documents`` and ``labels``."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*[size.alias(c) if c == "n_chars" else c for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_representatives(docs).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = source_mix.mix_sources(docs)
    return out.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken", "epochs", "part")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("mix_sources", mix_stage),
]

#: The classifier and the similarity join are not expressible in SQL at these sizes; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
