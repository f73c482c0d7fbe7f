"""Parsers of a model's answers: marked text to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.plans import protocol

def blocks(df: DataFrame, out: str) -> DataFrame:
    """A row for each marked block: kind, id, text and its place from 0."""
    rest = [c for c in df.columns if c != out]
    rows = df.select(*rest, F.posexplode(protocol.named(F.col(out), ("P", "V", "T"), 1)).alias("place", "b"))
    return rows.select(*rest, "place", F.col("b.name").alias("kind"), F.col("b.args")[0].alias("id"), protocol.trimmed(F.col("b.body")).alias("text"))


def verdict(expected: Column, got: Column) -> Column:
    """ok, ``truncated`` if what lacks is exactly the tail of ``expected``, else ``wrong``."""
    lacks = F.array_except(expected, got)
    tail = F.slice(expected, F.size(expected) - F.size(lacks) + 1, F.greatest(F.size(lacks), F.lit(1)))
    extra = F.size(F.array_except(got, expected)) > 0
    return F.when(extra, "wrong").when(F.size(lacks) == 0, "ok").when((F.size(lacks) < F.size(expected)) & (lacks == tail), "truncated").otherwise("wrong")


NOTE_KINDS = ("reference", "fact", "term", "source")


def notes(df: DataFrame, out: str) -> DataFrame:
    """A row for each note: block, kind, term, text."""
    rest = [c for c in df.columns if c != out]
    rows = df.select(*rest, F.explode(protocol.named(F.col(out), ("NOTE",), 2)).alias("b")).filter(F.col("b.args")[1].isin(*NOTE_KINDS))
    one_line = lambda name: F.trim(F.substring_index(protocol.value(F.col("b.body"), name), "\n", 1))
    return rows.select(*rest, F.col("b.args")[0].alias("block"), F.col("b.args")[1].alias("kind"), one_line("TERM").alias("term"), one_line("TEXT").alias("text"))


def meta(c: Column) -> tuple[Column, Column]:
    """(summary, terms): what follows SUMMARY: and TERMS:; without SUMMARY all of it is the summary."""
    summary = F.when(c.rlike("SUMMARY:"), F.trim(F.regexp_extract(c, r"(?s)SUMMARY:(.*?)(?:TERMS:|\z)", 1))).otherwise(F.trim(c))
    return summary, F.trim(F.regexp_extract(c, r"(?s)TERMS:(.*)\z", 1))


def unboxed(c: Column, name: str) -> Column:
    """What stands between [[[NAME n]]] and [[[/NAME n]]] of the same n; null if it isn't closed."""
    got = F.regexp_extract(c, rf"(?s)\[\[\[{name} (\w+)\]\]\](.*?)\[\[\[/{name} \1\]\]\]", 2)
    return F.when(c.rlike(rf"(?s)\[\[\[{name} (\w+)\]\]\].*?\[\[\[/{name} \1\]\]\]"), F.trim(got))


def marks(df: DataFrame, out: str) -> DataFrame:
    """Lines ``N kind`` with a known kind."""
    rest = [c for c in df.columns if c != out]
    line = F.explode(F.split(out, "\n"))
    rows = df.select(*rest, line.alias("line")).filter(F.col("line").rlike(r"^\s*\d+\s+(?:\+t?|title|skip|verse|toc|code)\s*$"))
    return rows.select(*rest, F.regexp_extract("line", r"(\d+)", 1).cast("int").alias("n"), F.regexp_extract("line", r"\d+\s+(\S+)", 1).alias("mark"))


def table_rows(c: Column) -> Column:
    """Cells of the rows of Markdown tables, without the rule under the head."""
    rows = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\s*\||\|\s*$", ""), r"\|"), lambda y: F.trim(y)))


def lost_tokens(original: Column, over: Column) -> Column:
    """Protocol tokens of a prompt that its override lacks."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"\[\[\[/?[A-Z]+|\b[A-Z]{3,}:"), F.lit(0)))
    return F.array_except(tokens(original), tokens(over))


def comments(df: DataFrame, out: str) -> DataFrame:
    """Translated comments: block, line, part and translation."""
    rest = [c for c in df.columns if c != out]
    rows = df.select(*rest, F.explode(protocol.named(F.col(out), ("C",), 2)).alias("b")).filter(F.col("b.args")[1].rlike("^[0-9]+$"))
    return rows.select(*rest, F.col("b.args")[0].alias("block"), F.col("b.args")[1].cast("int").alias("line"), protocol.value(F.col("b.body"), "ORIG").alias("part"), protocol.value(F.col("b.body"), "TR").alias("tr"))


def fixes(df: DataFrame, out: str) -> DataFrame:
    """Corrections: block, old and new."""
    rest = [c for c in df.columns if c != out]
    rows = df.select(*rest, F.explode(protocol.named(F.col(out), ("F",), 1)).alias("b"))
    return rows.select(*rest, F.col("b.args")[0].alias("block"), protocol.value(F.col("b.body"), "ORIG").alias("old"), protocol.value(F.col("b.body"), "FIX").alias("new"))


STYLE_KINDS = ("title", "subtitle", "p", "verse", "note", "skip")


def _pairs(lines: Column, sign: str) -> Column:
    """Lines ``left sign right`` as (k, v), trimmed."""
    told = F.filter(lines, lambda x: F.instr(x, sign) > 1)
    return F.transform(told, lambda x: F.struct(F.trim(F.substring_index(x, sign, 1)).alias("k"), F.trim(F.substr(x, F.instr(x, sign) + 1)).alias("v")))


def _last_wins(pairs: Column) -> Column:
    """A map of pairs; of a key told twice the last counts."""
    later = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(later)


def styles(c: Column) -> Column:
    """Lines ``tag|class = kind`` as a map; of a pair told twice the last counts."""
    told = F.transform(_pairs(F.split(c, "\n"), "="), lambda x: F.struct(x["k"].alias("k"), F.lower(x["v"]).alias("v")))
    return _last_wins(F.filter(told, lambda x: x["v"].isin(*STYLE_KINDS) & x["k"].contains("|") & F.substring_index(x["k"], "|", 1).rlike("^[A-Za-z0-9]+$")))


def heading_lines(c: Column) -> Column:
    """Lines ``n. title`` as a map of the number to the title."""
    numbered = F.transform(F.split(c, "\n"), lambda x: F.struct(F.regexp_extract(x, r"^\s*([0-9]+)[.)]", 1).try_cast("int").alias("k"), F.trim(F.regexp_replace(x, r"^\s*[0-9]+[.)]", "")).alias("v")))
    return _last_wins(F.filter(numbered, lambda x: x["k"].isNotNull() & (x["v"] != "")))


def toc_lines(df: DataFrame, out: str) -> DataFrame:
    """Names of chapters under [[[TOC]]], up to the first mark; each once, at its first place."""
    rest = [c for c in df.columns if c != out]
    box = F.regexp_extract(out, r"(?s)\[\[\[TOC\]\]\](.*?)(?=\[\[\[|\z)", 1)
    body = F.regexp_replace(box, r"(?sm)^\s*\d+\s+(?:\+t?|title|skip|verse|toc|code)[ \t]*$.*", "")
    rows = df.select(*rest, F.posexplode(F.split(body, "\n")).alias("place", "line"))
    name = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("line", r"[.·‧․\s]{3,}\d*\s*$", ""), r"^[\s\-•*|.]+|[\s\-•*|.]+$", ""), r"\s+", " "))
    good = rows.select(*rest, "place", name.alias("name")).filter(F.length("name").between(2, 120) & ~F.col("name").rlike(r"`|\[\[\[|:$"))
    return good.groupBy(*rest, "name").agg(F.min("place").alias("place"))


def forked(c: Column, script: str = r"\p{IsCyrillic}") -> Column:
    """Terms of name and term tables with more readings in the target's script than in the original."""
    sections = F.filter(F.split(c, r"(?m)^(?=#)"), lambda s: s.rlike(r"(?i)^#[^\n]*(?:NAMES|TERMS|ИМЕНА|ТЕРМИН)"))
    cells = F.flatten(F.transform(sections, lambda s: table_rows(s)))
    readings = lambda x: F.size(F.split(x, r"(?U)\s/\s|\bили\b|\bor\b"))
    second = lambda r: F.coalesce(F.try_element_at(r, F.lit(2)), F.lit(""))
    hit = F.filter(cells, lambda r: (F.size(r) >= 2) & (F.length(second(r)) <= 70) & second(r).rlike(script) & (readings(second(r)) > readings(r[0])))
    return F.transform(hit, lambda r: r[0])


#: What a book's record may say.
RECORD = ("title", "author", "year", "publisher", "edition", "series", "series_no", "genre", "title_target", "author_target", "series_target")
GENRES = (
    "sf", "sf_space", "sf_cyberpunk", "sf_social", "sf_horror", "sf_fantasy", "sf_heroic", "sf_detective", "sf_action", "sf_history",
    "det_classic", "det_political", "det_action", "thriller", "love_contemporary", "love_history", "love_detective",
    "prose_history", "prose_contemporary", "prose_classic", "prose_rus_classic", "child_prose", "child_adv", "poetry", "nonfiction", "sci_popular",
    "adv_history", "adv_maritime", "adv_animal", "adv_western", "humor_prose", "humor_satire",
)


def _bare(c: Column, marks: str) -> Column:
    """Without white space and these marks at both ends."""
    return F.btrim(c, F.lit(marks + " \t\r\n"))


def section(c: Column, name: str) -> Column:
    """The lines under the heading of that name, up to the next heading; an array."""
    lines = F.split(c, "\n")
    head = lambda x: x.rlike(r"^#{1,4}\s")
    mine = lambda x: head(x) & (F.substring_index(F.trim(F.regexp_replace(x, "^#+", "")), " ", 1) == name)
    tagged = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("on"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.struct(F.when(head(x), mine(x)).otherwise(acc["on"]).alias("on"), F.when(acc["on"] & ~head(x), F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept")),
    )
    return tagged["kept"]


def record(c: Column) -> Column:
    """``key = value`` lines under the META heading as a map, with known keys and genres only."""
    lines = F.transform(section(c, "META"), lambda x: F.when((F.instr(x, "=") == 0) | ((F.instr(x, ":") > 0) & (F.instr(x, ":") < F.instr(x, "="))), F.regexp_replace(x, "^([^:]*):", "$1=")).otherwise(x))
    told = F.transform(_pairs(lines, "="), lambda x: F.struct(_bare(x["k"], "-*").alias("k"), _bare(x["v"], "`\"'*").alias("v")))
    told = F.transform(told, lambda x: F.struct(x["k"].alias("k"), F.when(x["k"] == "genre", F.lower(x["v"])).otherwise(x["v"]).alias("v")))
    return _last_wins(F.filter(told, lambda x: x["k"].isin(*RECORD) & (x["v"] != "") & ~x["v"].startswith("(") & ((x["k"] != "genre") | x["v"].isin(*GENRES))))


def dropped_sections(c: Column) -> Column:
    """The bullets under the line ``drop_sections:``."""
    lines = F.split(c, "\n")
    bullet = lambda x: F.substring(F.trim(x), 1, 1).isin("-", "*")
    # 0: before the line, 1: among its bullets, 2: after them
    state = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("kept")),
        lambda acc, x: F.struct(
            F.when((acc["at"] == 0) & F.lower(F.replace(x, F.lit(" "), F.lit(""))).endswith("drop_sections:"), 1).when((acc["at"] == 1) & ~bullet(x) & (F.trim(x) != ""), 2).otherwise(acc["at"]).alias("at"),
            F.when((acc["at"] == 1) & bullet(x), F.array_append(acc["kept"], _bare(F.substr(F.trim(x), F.lit(2)), "\"'"))).otherwise(acc["kept"]).alias("kept"),
        ),
    )
    return F.filter(state["kept"], lambda x: x != "")
