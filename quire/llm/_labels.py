"""Bounded, repeatable samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._frames import col


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(id_.cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int | None = None) -> DataFrame:
    """(label int, text): at most ``per_class`` rows of each label, by a hash of the id, never of fold 1.

    Rows without an id, label or text are no examples; of several labels of an id the
    largest counts, and of several texts the smallest.  With ``most_bytes`` longer documents
    are left out of the sample.
    """
    known = labels.select(col(labels, id_col).alias("id"), col(labels, label).cast("int").alias("label")).filter("id is not null and label in (0, 1)")
    known = known.filter(fold(F.col("id")) != 1).groupBy("id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("id"), "id"]
    ids = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    texts = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).cast("string").alias("text")).filter("text is not null")
    if most_bytes is not None:
        texts = texts.filter(F.octet_length("text") <= most_bytes)
    # per_class ids of each label, a bound; a repeated id is one row
    return texts.join(F.broadcast(ids), "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text")).select("label", "text")
