"""What the operators of this subpackage share: input columns, tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionlake.session import shared_dir

#: A word is a run of anything but these bytes.
WHITE = r"\x20\x09-\x0D"
WORD = f"[^{WHITE}]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones. Only these two columns are
    read, so other columns of ``docs`` may have any name."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Stands for a null id inside tasks, where pandas would turn such columns into floats.
NO_ID = -(2**63)


def plain_ids(frame: DataFrame) -> DataFrame:
    return frame.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))


def null_ids(frame: DataFrame) -> DataFrame:
    return frame.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def stored(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: computed once, and
    a lost executor costs its tasks only."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def stripped(text: Column) -> Column:
    """``text`` without white space."""
    return F.regexp_replace(text, f"[{WHITE}]+", "")
