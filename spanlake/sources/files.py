"""File sources and sinks (A1-A5) and split loading, all with explicit schemas.

Schemas are fixed here instead of inferred (inference costs a full extra pass over
the files at scale and can change types between runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANSWER = T.StructType([T.StructField("text", T.StringType()), T.StructField("answer_start", T.IntegerType())])
QA = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("answers", T.ArrayType(ANSWER)),
])
PARAGRAPH = T.StructType([T.StructField("context", T.StringType()), T.StructField("qas", T.ArrayType(QA))])
QA_DOCUMENT = T.StructType([
    T.StructField("data", T.ArrayType(T.StructType([T.StructField("paragraphs", T.ArrayType(PARAGRAPH))])))
])
EXAMPLE = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("answer_start", T.IntegerType()),
    T.StructField("answer_end", T.IntegerType()),
    T.StructField("context", T.StringType()),
    T.StructField("id", T.StringType()),
])


def read_qa_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested QA JSON documents (A1). ``multi_line``: each file is one (pretty-printed)
    document, as the original datasets ship; otherwise one document per line."""
    return spark.read.schema(QA_DOCUMENT).json(path, multiLine=multi_line)


def read_qa_variant(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested QA documents of varying shape (A1, B2-B4): ``question, answer, answer_start, answer_end, context,
    id, problem``, a row per question. Documents are VARIANT values, so fields may be missing, of
    another type (``"12"`` for 12) or unknown; a question without answers has the answer ``NA``. What cannot be read
    is a row of its own whose ``problem`` says why, never a failure: ``not json``, ``no data``,
    ``no paragraphs``, ``no context``, ``no questions``, ``no answer start``."""
    get = F.try_variant_get
    text = spark.read.text(path, wholetext=multi_line).where(F.col("value").rlike(r"\S"))
    docs = text.select(F.try_parse_json("value").alias("v"))
    data = docs.select("v", F.explode_outer(get("v", "$.data", "array<variant>")).alias("d"))
    paras = data.select("v", "d", F.explode_outer(get("d", "$.paragraphs", "array<variant>")).alias("p"))
    asked = paras.select("v", "d", "p", get("p", "$.context", "string").alias("context"), F.explode_outer(get("p", "$.qas", "array<variant>")).alias("q"))
    first = F.get(get("q", "$.answers", "array<variant>"), 0)
    rows = asked.select(
        "*", get("q", "$.question", "string").alias("question"), get("q", "$.id", "string").alias("id"), first.isNotNull().alias("_has"),
        get(first, "$.text", "string").alias("_text"), get(first, "$.answer_start", "int").alias("_start"))
    problem = (
        F.when(F.col("v").isNull(), "not json").when(F.col("d").isNull(), "no data").when(F.col("p").isNull(), "no paragraphs")
        .when(F.col("context").isNull(), "no context").when(F.col("q").isNull(), "no questions").when(F.col("_has") & F.col("_start").isNull(), "no answer start"))
    answer = F.when(F.col("q").isNull(), F.lit(None)).when(F.col("_has"), F.col("_text")).otherwise(F.lit("NA"))
    return rows.select(
        "question", answer.alias("answer"), F.col("_start").alias("answer_start"), (F.col("_start") + F.length("_text")).alias("answer_end"),
        "context", "id", problem.alias("problem"))


def write_qa_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested documents as JSON lines, one document per line (read back with
    ``multi_line=False``); written in parallel, one file per task."""
    df.write.mode(mode).json(path)


def write_pairs_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated file with a header (the layout :func:`read_pairs_tsv` reads)."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("sep", "\t")
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_examples_csv(spark: SparkSession, path: str, na_as_null: bool = False) -> DataFrame:
    """Flat examples from CSV with a header and quoted multi-line text (A2).

    ``NA`` stays text unless ``na_as_null`` (the reference's CSV reader turns it into
    a missing value); an empty field is NULL either way."""
    r = (
        spark.read.schema(EXAMPLE)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
    if na_as_null:
        r = r.option("nullValue", "NA")
    return r.csv(path)


def write_examples_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header and no index column (A3); quotes doubled like pandas and
    surrounding whitespace kept (Spark's writer trims it by default)."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_pairs_tsv(spark: SparkSession, path: str, cols=("Query", "Segment")) -> DataFrame:
    """Tab-separated file with a header; only ``cols`` are kept (A4, B1). All columns
    are read as strings, so no inference pass is needed."""
    df = (
        spark.read.option("header", True)
        .option("sep", "\t")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .option("inferSchema", False)
        .csv(path)
    )
    return df.select(*cols)


def load_splits(spark: SparkSession, paths: dict[str, str], reader=read_examples_csv,
                split_col: str = "split") -> DataFrame:
    """Named splits as one DataFrame with a ``split`` column (A5)."""
    parts = [reader(spark, p).withColumn(split_col, F.lit(name)) for name, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
