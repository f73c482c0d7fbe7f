"""A training corpus from raw documents: five stages over the operators of quire.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.  All
but the last return the columns of ``docs``.  Extra columns pass through; null and repeated
ids follow the rules of the stage's operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import jaccard_join, mixing, quality_rules, sentencepiece_bpe, suffix_dedup
from quire.llm._frames import col, fresh, keyed, table
from quire.llm._scratch import Scratch, small_join


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    scratch = Scratch(spark, "pipeline")
    key = fresh(docs, "row_key")
    rows = keyed(docs, scratch, key, "doc_id", "text")
    judged = quality_rules.quality_rules(rows.select(F.col(key).alias("id"), *[col(rows, c).alias(c) for c in ("text", "lang", "source")]), id_col="id")
    good = scratch.stage(judged.filter("kept").select(F.col("id").alias(key)).distinct(), "good")
    return small_join(rows, scratch, "good", good, key, "left_semi").select(*[F.col("`" + c + "`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id stays.

    Of rows that repeat its id that with the smallest row (text first, nulls first) stays.
    Rows without an id link with nothing and stay.
    """
    scratch = Scratch(spark, "pipeline")
    key = fresh(docs, "row_id")
    found = scratch.stage(jaccard_join.jaccard_join(docs).select(F.col("doc_id").alias(key), "component_id"), "found")
    gone = scratch.stage(found.filter(f"component_id <> {key}").select(key).distinct(), "gone")
    rows = docs.withColumn(key, col(docs, "doc_id"))
    left = small_join(rows, scratch, "gone", gone, key, "left_anti")
    again = found.filter(f"{key} is not null and component_id = {key}").groupBy(key).count().filter("count > 1").select(key)
    names = ["`" + c + "`" for c in docs.columns]
    if again.isEmpty():
        return left.select(*names)
    again = scratch.stage(again, "again")
    once = small_join(left, scratch, "again", again, key, "left_anti")
    many = small_join(left, scratch, "again", again, key, "left_semi")
    # an aggregate with a partial one before the shuffle: no task holds the rows of an id
    order = ["`text`"] + [c for c in names if c != "`text`"]
    first = many.groupBy(key).agg(F.min(F.struct(*order)).alias("first_row")).select("first_row.*")
    return once.select(*names).unionByName(first.select(*names))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes and more that repeat anywhere are cut out, whole characters only; n_chars follows."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of sources, languages and topics."""
    scratch = Scratch(spark, "pipeline")
    key = fresh(docs, "row_key")
    rows = keyed(docs, scratch, key, "doc_id", "text")
    judged = mixing.mix(rows.select(F.col(key).alias("k"), *[col(rows, c).alias(c) for c in ("doc_id", "text", "lang", "source")]))
    chosen = scratch.stage(judged.filter("sampled").select(F.col("k").alias(key)).distinct(), "chosen")
    return small_join(rows, scratch, "chosen", chosen, key, "left_semi").select(*[F.col("`" + c + "`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, the tokens of the text, and of what they decode to the digest and whether it is the text."""
    rows = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs.select("doc_id", "lang", "source", "text")))
    decoded = F.col("decoded")
    lossless = (decoded == F.coalesce("text", F.lit(""))).alias("lossless")
    return rows.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens", F.sha2(decoded, 256).alias("decoded_sha256"), lossless)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", repeats), ("mixing", mixture), ("SentencePiece encoding and decoding", tokens)]

#: Stages 4, 7 and 10 have no SQL of use; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each reading what the one before has written."""
    scratch = Scratch(spark, "corpus")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.stage(docs, f"stage{k}")
    return docs
