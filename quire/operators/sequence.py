"""Operators along reading order: islands, spans, heads, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.model import T, Thresholds


def lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("source", "doc_id")) -> DataFrame:
    """Each document's lines with their place from 0; a null text has none."""
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("line", "text"))


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Number runs from 1 within ``by``; a run begins where ``breaks`` is true or null (the first row)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("_b").over(w).cast("long")).drop("_b")


def latest(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; an aggregation, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    row = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("row"))
    return df.groupBy(*by).agg(F.max(row).alias("m")).select(*by, "m.row.*")


def ranges(df: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers by key, as text: ``1–3, 7``."""
    w = Window.partitionBy(*by).orderBy(number)
    runs = df.select(*by, number).distinct().withColumn("_g", F.col(number) - F.row_number().over(w)).groupBy(*by, "_g").agg(F.min(number).alias("_a"), F.max(number).alias("_z"))
    told = F.when(F.col("_a") == F.col("_z"), F.col("_a").cast("string")).otherwise(F.concat_ws("–", F.col("_a").cast("string"), F.col("_z").cast("string")))
    return runs.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_a", told.alias("t")))), lambda x: x["t"]), ", ").alias("ranges"))


def edge_lines(pages: DataFrame, by: list[str], th: Thresholds = T) -> DataFrame:
    """The first and last two full lines of each page that may be running heads, with their key."""
    full = pages.filter(F.trim("text") != "")
    up, down = Window.partitionBy(*by).orderBy("line"), Window.partitionBy(*by).orderBy(F.desc("line"))
    edge = full.withColumn("a", F.row_number().over(up)).withColumn("b", F.row_number().over(down)).filter("a <= 2 or b <= 2").drop("a", "b")
    edge = edge.filter((F.length(F.trim("text")) <= th.head_max) & (X.letter_share(F.col("text")) >= th.head_letters))
    return edge.withColumn("key", X.running_key(F.col("text"))).filter("key <> ''")


def running_heads(docs: DataFrame, least: int = 4, th: Thresholds = T) -> DataFrame:
    """Keys that stand at the edge of at least ``least`` documents: key, n_docs, n_lines."""
    found = edge_lines(lines(docs), ["source", "doc_id"], th).groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_lines"))
    return found.filter(F.col("n_docs") >= least)


def glue(blocks: DataFrame, by: list[str], order: str = "line") -> DataFrame:
    """Paragraphs torn by a page: a block joins the one before it if it begins in lower case and that
    one ends with a letter and a hyphen, or with a letter and at most a comma or semicolon."""
    before = F.lag("text").over(Window.partitionBy(*by).orderBy(order))
    torn = F.col("text").rlike(r"^\p{Ll}") & before.rlike(r"\p{L}[-,;]?$")
    runs = islands(blocks, by, [order], ~torn, "para")
    whole = F.array_sort(F.collect_list(F.struct(order, "text")))
    join = lambda acc, x: F.when(acc == "", x["text"]).when(acc.rlike(r"\p{L}-$"), F.concat(F.regexp_replace(acc, "-+$", ""), x["text"])).otherwise(F.concat(acc, F.lit(" "), x["text"]))
    return runs.groupBy(*by, "para").agg(F.count("*").alias("n_blocks"), whole.alias("w")).select(*by, "para", "n_blocks", F.aggregate("w", F.lit(""), join).alias("text"))


def longest_run(marks: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Of runs of positions with holes of at most ``gap`` the longest (the first among equals)."""
    far = F.col("pos") - F.lag("pos").over(Window.partitionBy(*by).orderBy("pos")) > gap
    runs = islands(marks, by, ["pos"], far, "run").groupBy(*by, "run").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count("*").alias("n"))
    return runs.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("k"), "first_pos", "last_pos", "n")).alias("m")).select(*by, "m.first_pos", "m.last_pos", "m.n")


def value_at(df: DataFrame, column: str, rank: int, most: int = 4096) -> float | None:
    """The value of a double column at ``rank`` (from 0) in ascending order; None past the end.

    Counts in equal bins narrow the range until at most ``most`` rows are left in it, so only so
    many values ever reach the driver; a range of one value needs no more narrowing."""
    x = df.select(F.col(column).alias("x")).filter("x is not null")
    lo, hi, n = x.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if rank >= n:
        return None
    while n > most and lo < hi:
        step = (hi - lo) / most
        if lo + step <= lo:
            break
        inside = x.filter(F.col("x").between(lo, hi))
        place = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(step)), F.lit(most - 1))
        bins = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect()
        for b in bins:
            if rank < b["n"]:
                lo, hi, n = b["lo"], b["hi"], b["n"]
                break
            rank -= b["n"]
    if lo == hi:
        return lo
    counted = x.filter(F.col("x").between(lo, hi)).groupBy("x").agg(F.count("*").alias("n")).orderBy("x").collect()
    for value, times in counted:
        if rank < times:
            return value
        rank -= times
    return None


def merged_saves(records: DataFrame, by: list[str], saved: str, maps: list[str]) -> DataFrame:
    """What repeated saves of a chunk come to: of the ``maps`` the last value of each key, of other fields the
    last save's; ``saved`` orders the saves.  A null map has no keys."""
    rest = [c for c in records.columns if c not in (*by, saved, *maps)]
    out = records.groupBy(*by).agg(F.max_by(F.struct(F.lit(0).alias("_"), *rest), saved).alias("r"), F.max(saved).alias(saved)).select(*by, saved, *[F.col("r." + c).alias(c) for c in rest])
    for m in maps:
        one = records.select(*by, saved, F.explode(m).alias("k", "v")).groupBy(*by, "k").agg(F.max_by("v", saved).alias("v"))
        out = out.join(one.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(m)), by, "left")
    return out
