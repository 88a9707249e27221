"""Stateless QA operators on streams.

The reference has no streams; every row-level operator here (flatten, strip,
tokenise, window, normalise) keeps no state, so the same functions apply to a
streaming DataFrame. Sinks write parquet into the shared checkpoint folder with an
``availableNow`` trigger: restartable from the checkpoint after a failure, no
driver-side collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.operators.flatten import flatten_qa, strip_questions
from spanlake.operators.tokens import tokenize_offsets
from spanlake.session import shared_dir
from spanlake.sources.files import QA_DOCUMENT


def qa_json_stream(spark: SparkSession, src_dir: str) -> DataFrame:
    """Nested QA JSON files arriving in ``src_dir`` -> flat examples."""
    raw = spark.readStream.schema(QA_DOCUMENT).option("multiLine", True).json(src_dir)
    return strip_questions(flatten_qa(raw))


def parquet_table_stream(spark: SparkSession, sf_dir: str, name: str,
                         files_per_batch: int = 1000) -> DataFrame:
    """One table of the driver's folder as a file stream (schema from its footer);
    ``files_per_batch`` bounds each micro-batch. A table is one file or a folder of part files: its path is
    given as a pattern that only it matches, since a file stream takes a plain path for a folder."""
    root = sf_dir.rstrip("/")
    schema = spark.read.parquet(f"{root}/{name}.parquet").schema
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{root}/{{{name}.parquet}}")
    )


def token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream, tokenised with offsets (G1)."""
    docs = parquet_table_stream(spark, sf_dir, "documents").select("doc_id", "text")
    return tokenize_offsets(docs, "doc_id", "text")


def run_to_parquet(stream: DataFrame, name: str, out_dir: str | None = None) -> str:
    """Drain a stream into parquet under the shared folder and return the path."""
    spark = stream.sparkSession
    out = out_dir or shared_dir(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/_checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return f"{out}/data"
