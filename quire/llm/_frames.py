"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._scratch import Scratch, small_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def col(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def keyed(df: DataFrame, scratch: Scratch, name: str, id_col: str, text_col: str) -> DataFrame:
    """``df`` with a long ``name`` that tells rows apart, but for rows equal in id and text.

    The id itself where it is a key (checked by one aggregation of the ids); else a number
    for each pair of an id and the SHA-256 of a text, from a staged table of these.
    """
    ids = df.select(col(df, id_col).cast("long").alias("k")).groupBy("k").count()
    odd = ids.filter((F.col("count") > 1) | F.col("k").isNull())
    if odd.isEmpty():
        return df.withColumn(name, col(df, id_col).cast("long"))
    a, b = fresh(df, "row_id"), fresh(df, "row_digest")
    marks = [F.coalesce(col(df, id_col).cast("string"), F.lit("-")).alias(a), F.coalesce(F.sha2(col(df, text_col).cast("binary"), 256), F.lit("-")).alias(b)]
    pairs = scratch.stage(df.select(*marks).distinct().withColumn(name, F.monotonically_increasing_id()), "rows_" + name)
    marked = df.select("*", *marks)
    return small_join(marked, scratch, "rows_" + name, pairs, [a, b], "left").select(*[col(df, c) for c in df.columns], name)
