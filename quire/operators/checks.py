"""Checks of a translation and reports about its passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import numerals
from quire.functions import text as X
from quire.model import T, Thresholds
from quire.operators.sequence import edge_lines


def _bag(pairs: DataFrame, key: list[str], items: Column, name: str) -> DataFrame:
    return pairs.select(*key, F.explode(items).alias("n")).groupBy(*key, "n").agg(F.count("*").alias(name))


def number_check(pairs: DataFrame, key: list[str], source_lang: str, to: str, ocr: bool = False) -> DataFrame:
    """Numbers that (key, src, tr) pairs lose or gain: key, side, n and the excuse (null: a fault).

    A text's own bag joins thousands groups; the other side may spell a group either way, so
    it counts with the larger of both bags.  Counts are made of numbers, and texts are read
    again only for the pairs that have a suspect."""
    bags = [_bag(pairs, key, X.numbers(F.col(c), grouped=g), c + "_" + how) for c in ("src", "tr") for g, how in ((True, "g"), (False, "r"))]
    whole = bags[0]
    for b in bags[1:]:
        whole = whole.join(b, [*key, "n"], "full")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    lost = count("src_g") > F.greatest(count("tr_g"), count("tr_r"))
    gained = count("tr_g") > F.greatest(count("src_g"), count("src_r"))
    side = F.when(lost, "lost").when(gained, "gained")
    suspects = whole.withColumn("side", side).filter("side is not null").select(*key, "n", "side").join(pairs, key)
    s, t, n = F.col("src"), F.col("tr"), F.col("n")
    why = F.when(F.col("side") == "lost", numerals.excuse_lost(s, t, n, to, ocr)).otherwise(numerals.excuse_gained(s, t, n, source_lang))
    return suspects.select(*key, "side", "n", why.alias("excuse"))


def note_marks(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Footnote marks ``<sup>n</sup>`` that the translation has fewer of: key, n, times."""
    marks = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"<sup>\s*([0-9]+)\s*</sup>"), F.lit(1))
    both = _bag(pairs, key, marks("src"), "a").join(_bag(pairs, key, marks("tr"), "b"), [*key, "n"], "left")
    return both.withColumn("times", F.col("a") - F.coalesce("b", F.lit(0))).filter("times > 0").select(*key, "n", "times")


#: What an editor says who has nothing to say.
NOTHING = ("нет", "none", "keine", "aucune", "无", "なし", "-", "—")


def review(edits: DataFrame, note: str) -> DataFrame:
    """Editors' notes that say something."""
    told = F.trim(F.col(note))
    return edits.filter((F.length(told) > 12) & ~F.regexp_replace(F.lower(told), r"\.+$", "").isin(*NOTHING))


def provenance(records: DataFrame, by: list[str], what: str, model: str, at: str) -> DataFrame:
    """By book and pass: its models and their shares, and the days the work took.

    ``records`` holds (by, what, id, model, at): a row for each time a block was written; the
    last one counts for the share."""
    last = records.groupBy(*by, what, "id").agg(F.max_by(model, F.struct(at, model)).alias("m"), F.min(at).alias("a"), F.max(at).alias("z"))
    one = last.groupBy(*by, what, "m").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("z").alias("z"))
    told = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "m", "n")))
    whole = one.groupBy(*by, what).agg(told.alias("t"), F.sum("n").alias("blocks"), F.min("a").alias("a"), F.max("z").alias("z"))
    share = lambda x: F.concat(x["m"].cast("string"), F.lit(" "), F.round(x["n"] * 100 / F.col("blocks")).cast("int").cast("string"), F.lit("%"))
    days = F.array_distinct(F.array(F.date_format("a", "yyyy-MM-dd"), F.date_format("z", "yyyy-MM-dd")))
    return whole.select(*by, what, "blocks", F.array_join(F.transform("t", share), ", ").alias("models"), F.array_join(days, " — ").alias("span"))


#: How a report says that it found nothing.
NOT_FOUND = ("нет", "none", "no", "false", "0", "-", "—", "не обнаружены", "не обнаружено", "not found")


def injections(report: Column) -> Column:
    """Instructions to the machine that a report lists under ``INJECTED:``; empty if there are none."""
    said = F.trim(F.regexp_extract(report, r"(?m)^\s*INJECTED:[ \t]*(.*)$", 1))
    after = F.regexp_extract(report, r"(?m)^\s*INJECTED:[ \t]*.*$\s*((?:^[ \t]*[-*•].*(?:\n|\z))*)", 1)
    bullets = F.transform(F.filter(F.split(after, "\n"), lambda x: F.trim(x) != ""), lambda x: F.trim(F.regexp_replace(x, r"^[\s\-*•]+", "")))
    none = (said == "") | F.regexp_replace(F.lower(said), r"^\.+|\.+$", "").isin(*NOT_FOUND)
    asked = F.coalesce(report, F.lit("")).rlike(r"(?m)^\s*INJECTED:")
    listed = F.when(F.size(bullets) > 0, bullets).otherwise(F.array(said))
    clean = F.regexp_replace(F.lower(said), r"^\.+|\.+$", "").isin(*NOT_FOUND)
    return F.when(~asked | clean | (none & (F.size(bullets) == 0)), F.array().cast("array<string>")).otherwise(listed)


def page_heads(pages: DataFrame, by: list[str], page: str, th: Thresholds = T) -> DataFrame:
    """Running heads of each book from the lines (by, page, line, text) of its pages.

    A key is a head if it stands on 15% of the pages and on four at least, or on four that
    follow closely: the upper median of the gaps between its pages is small.  Books of under five pages have none.  The median is taken by rank, so
    that no key's pages are gathered in one row."""
    n = pages.groupBy(*by).agg(F.countDistinct(page).alias("pages"))
    seen = edge_lines(pages, [*by, page], th).select(*by, "key", page).distinct()
    w = Window.partitionBy(*by, "key")
    gaps = seen.withColumn("gap", F.col(page) - F.lag(page).over(w.orderBy(page))).withColumn("n", F.count("*").over(w))
    ranked = gaps.filter("gap is not null").withColumn("r", F.row_number().over(w.orderBy("gap")))
    mid = ranked.filter("r = (n - 1) div 2 + 1").select(*by, "key", "n", F.col("gap").alias("mid"))
    told = mid.join(n, by).filter("pages >= 5")
    return told.filter(f"n >= greatest(4, 0.15 * pages) or (n >= 4 and mid <= {th.head_gap})").select(*by, "key", "n", "mid")


def unglued(lines: DataFrame, by: list[str], heads: DataFrame, text: str = "text") -> DataFrame:
    """Lines without the printed heads (by, head) of six characters and more that are glued into them,
    longest first.  A book has few heads; they ride along as one array."""
    order = F.array_sort(F.collect_set(F.struct((-F.length("head")).alias("k"), "head")))
    few = heads.filter((F.length("head") >= 6) & F.col("head").rlike(r"\p{L}")).groupBy(*by).agg(order.alias("_heads"))
    cut = F.aggregate(F.coalesce("_heads", F.array()), F.col(text), lambda acc, h: F.replace(acc, h["head"], F.lit("")))
    return lines.join(few, by, "left").withColumn(text, cut).drop("_heads")


def kept_images(images: DataFrame, by: list[str], pages: DataFrame, per_page: int = 3, side: int = 60, long: int = 6, same: int = 2) -> DataFrame:
    """Images (by, page, width, height, md5) that are pictures: none of a book that has more than
    ``per_page`` a page; no rules, no specks, and nothing that is printed more than ``same`` times."""
    n = images.groupBy(*by).agg(F.count("*").alias("_n")).join(pages, by).filter(F.col("_n") <= per_page * F.col("pages")).select(*by)
    a, b = F.least("width", "height"), F.greatest("width", "height")
    good = images.join(n, by, "left_semi").filter((a >= side) & (b <= long * a))
    often = good.groupBy(*by, "md5").agg(F.count("*").alias("_c")).filter(F.col("_c") > same)
    return good.join(often, [*by, "md5"], "left_anti")


#: Addresses that aren't links of the book.
SKIPPED_LINKS = r"(?i)oceanofpdf|authoralerts|contents\.xhtml|#"


def kept_link(href: Column, skip: str = SKIPPED_LINKS) -> Column:
    """Whether an outer link stays: an http address that isn't on the list."""
    return href.startswith("http") & ~href.rlike(skip)


def spread(seen: DataFrame, by: list[str], order: list[str], sample: str, first: int = 60, n: int = 3) -> DataFrame:
    """(by, count, samples): how often, and ``n`` samples evenly spread over the first ones in order."""
    w = Window.partitionBy(*by).orderBy(*order)
    # the first ones of each task are enough to find those of all
    early = seen.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= first)
    some = early.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", sample))).alias("s"))
    at = F.transform(F.sequence(F.lit(0), F.least(F.lit(n), F.size("s")) - 1), lambda i: F.round(i * (F.size("s") - 1) / F.greatest(F.least(F.lit(n), F.size("s")) - 1, F.lit(1))).cast("int"))
    return seen.groupBy(*by).agg(F.count("*").alias("count")).join(some, by).select(*by, "count", F.transform(at, lambda i: F.col("s")[i][sample]).alias("samples"))
