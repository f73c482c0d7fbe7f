"""The state of a work folder: JSON files of chunks, the freshest one of a block counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "saved string, model string, tr map<string,string>, src map<string,string>, edits map<string,struct<old:string,new:string>>"


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk files under ``folder`` with their name and time: ``saved``, or else when the file was written.

    A file that is no JSON has its name and nulls."""
    rows = spark.read.schema(SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(folder)
    written = F.date_format(F.col("_metadata.file_modification_time"), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return rows.select(F.col("_metadata.file_name").alias("file"), F.coalesce("saved", written).alias("at"), *[x.split()[0] for x in SCHEMA.split(", ")])


def translations(chunks: DataFrame) -> DataFrame:
    """(id, text, fp, model, edited): the last translation of each block with the last edit laid over it."""
    tr = chunks.select("at", "file", "model", "src", F.explode("tr").alias("id", "text"))
    last = tr.withColumn("fp", F.try_element_at("src", F.col("id"))).groupBy("id").agg(F.max_by(F.struct("text", "fp", "model"), F.struct("at", "file")).alias("r"))
    edits = chunks.select("at", "file", F.explode("edits").alias("id", "e")).groupBy("id").agg(F.max_by("e", F.struct("at", "file")).alias("e"))
    both = last.join(edits, "id", "left")
    return both.select("id", F.coalesce("e.new", "r.text").alias("text"), "r.fp", "r.model", F.col("e.new").isNotNull().alias("edited"))
