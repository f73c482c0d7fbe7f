"""Joins of blocks with translations, edits, headings, links, pages and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlay(drafts: DataFrame, edits: DataFrame, key: list[str]) -> DataFrame:
    """Drafts with their edits (old/new) laid over; edits without a draft don't count."""
    e = edits.select(*key, F.col("text").alias("_new"))
    return drafts.join(e, key, "left").select(*key, F.coalesce("_new", "text").alias("text"), F.col("_new").isNotNull().alias("edited"))


def two_tier(left: DataFrame, text: str, heads: DataFrame) -> DataFrame:
    """Look up headings (text, title): exactly, else without tags and white space."""
    loose = lambda c: F.regexp_replace(F.regexp_replace(c, r"</?[a-zA-Z][^>]*>", ""), r"\s+", "")
    exact = heads.groupBy(F.col("text").alias("_k")).agg(F.min("title").alias("_exact"))
    near = heads.groupBy(loose(F.col("text")).alias("_l")).agg(F.min("title").alias("_near"))
    both = left.withColumn("_k", F.col(text)).withColumn("_l", loose(F.col(text))).join(exact, "_k", "left").join(near, "_l", "left")
    return both.withColumn("title", F.coalesce("_exact", "_near")).drop("_k", "_l", "_exact", "_near")


def resolve_links(links: DataFrame, anchors: DataFrame, book: str) -> DataFrame:
    """Links (book, block, fragment) to the block of another anchor of that name; target is null if none."""
    a = anchors.select(F.col(book), F.col("name").alias("fragment"), F.col("block").alias("_to"))
    hit = links.join(a, [book, "fragment"], "left").withColumn("_to", F.when(F.col("_to") != F.col("block"), F.col("_to")))
    return hit.groupBy(book, "block", "n", "fragment").agg(F.min("_to").alias("target"))


def next_at_or_after(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """As-of forward: for each row of ``left`` the ``value`` of the first row of ``right`` with ``at`` no less.

    Both sides meet in one sorted stream, so nothing is compared pairwise."""
    a = left.withColumn("_side", F.lit(1))
    b = right.groupBy(by, at).agg(F.min(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(F.desc(at), "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").drop("_side", "_v")


def sweep(df: DataFrame, text: str, pairs: list[tuple], id_col: str | None = None) -> DataFrame:
    """Exact replacements (old, new) or (old, new, block ids) in the order given, and how many there were;
    one with ids is made in these blocks only."""
    out, n = F.col(text), F.lit(0)
    for a, b, *ids in pairs:
        here = F.lit(True) if not ids else F.coalesce(F.col(id_col).cast("string").isin(*[str(i) for i in ids[0]]), F.lit(False))
        m = F.when(here, F.regexp_count(out, F.lit("\\Q" + a + "\\E"))).otherwise(0)
        n, out = n + m, F.when(here, F.replace(out, F.lit(a), F.lit(b))).otherwise(out)
    return df.withColumn("n_replaced", n.cast("long")).withColumn(text, out)


def term_check(pairs: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (term, pattern) whose term the source has and whose pattern the translation lacks."""
    told = F.array(*[F.when(F.lower("src").contains(a.lower()) & ~F.col("tr").rlike("(?iu)" + p), F.lit(a)) for a, p in rules])
    return pairs.withColumn("term", F.explode(F.array_compact(told)))


def first_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min(F.struct(*order, F.struct(*rest).alias("row"))).alias("m")).select(*by, "m.row.*")


def todo(blocks: DataFrame, done: DataFrame, by: list[str], fp: Column) -> DataFrame:
    """Chunks of which some block has no stored fingerprint equal to the text's (a stored null is trusted)."""
    d = done.select("id", F.col("fp").alias("_fp"), F.lit(True).alias("_has"))
    ok = F.coalesce(F.col("_has"), F.lit(False)) & (F.col("_fp").isNull() | (F.col("_fp") == fp))
    return blocks.join(d, "id", "left").groupBy(*by).agg(F.count("*").alias("blocks"), F.sum(F.when(ok, 0).otherwise(1)).alias("missing")).filter("missing > 0")


def prune_links(blocks: DataFrame, anchors: DataFrame, by: list[str]) -> DataFrame:
    """Blocks (by, id, text, links) without the labels of inner links that lead to no anchor (by, name); the
    labels that stay are numbered anew, and their words stay all."""
    rest = [c for c in blocks.columns if c not in ("text", "links")]
    told = blocks.select(*by, "id", F.posexplode("links").alias("i", "href"))
    known = anchors.select(*by, F.concat(F.lit("#"), "name").alias("href")).distinct().withColumn("_there", F.lit(True))
    good = told.join(known, [*by, "href"], "left").withColumn("keep", ~F.col("href").startswith("#") | F.coalesce("_there", F.lit(False)))
    plan = good.groupBy(*by, "id").agg(F.array_sort(F.collect_list(F.struct("i", "href", "keep"))).alias("_p"))
    both = blocks.join(plan, [*by, "id"], "left").withColumn("_p", F.coalesce("_p", F.expr("cast(array() as array<struct<i:int,href:string,keep:boolean>>)")))
    upto = lambda i: F.size(F.filter(F.slice("_p", 1, i + 1), lambda x: x["keep"]))
    steps = F.transform("_p", lambda x, i: F.struct((i + 1).cast("string").alias("old"), F.when(x["keep"], F.concat(F.lit("a"), upto(i).cast("string"))).alias("new")))

    def relabel(text, x):
        begin, end = F.concat(F.lit("<a"), x["old"], F.lit(">")), F.concat(F.lit("</a"), x["old"], F.lit(">"))
        as_new = lambda slash: F.when(x["new"].isNull(), "").otherwise(F.concat(F.lit(slash), x["new"], F.lit(">")))
        return F.replace(F.replace(text, begin, as_new("<")), end, as_new("</"))

    kept = F.transform(F.filter("_p", lambda x: x["keep"]), lambda x: x["href"])
    return both.select(*rest, F.aggregate(steps, F.col("text"), relabel).alias("text"), kept.alias("links"))
