"""Queries of the checks, the alignment of ids and links, and the grouped model passes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.catalog import _SQL, LINES, NEXT, TAGS, completeness, docs, neighbours, query, table, terms_check
from quire.functions import numerals
from quire.functions import text as X
from quire.operators import alignment, checks
from quire.operators import sequence as S
from quire.plans import answers, contents, model_passes

def _sql_numbers(c: str, grouped: bool) -> str:
    """All numbers of a column; with ``grouped``, thousands separators within one are left out."""
    plain = f"regexp_replace({c}, {TAGS}, ' ', 'g')"
    if not grouped:
        return f"regexp_extract_all({plain}, '[0-9]+')"
    between = "[" + X.SEPARATORS.replace("'", "''") + "]"
    return f"list_transform(regexp_extract_all({plain}, '\\b[0-9]{{1,3}}(?:{between}[0-9]{{3}})+(?:[^0-9]|$)|[0-9]+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"


def _sql_words(text: str, n: str) -> str:
    """Whether every place of a number stands in an English text as a word."""
    table_ = numerals.ENGLISH
    said = "CASE p " + " ".join(f"WHEN {k} THEN regexp_matches({text}, '(?i)\\b{w}\\b')" for k, w in table_.items()) + " ELSE false END"
    v = f"TRY_CAST({n} AS INTEGER)"
    low = f"(CASE WHEN {v} >= 1000 THEN {v} // 1000 ELSE {v} END)"
    own = f"list_filter([{low} - {low} % 100, CASE WHEN {low} % 100 BETWEEN 11 AND 19 THEN {low} % 100 ELSE {low} % 100 - {low} % 10 END, CASE WHEN {low} % 100 BETWEEN 11 AND 19 THEN 0 ELSE {low} % 10 END], lambda x: x > 0)"
    parts = f"CASE WHEN {v} < 1000 THEN {own} WHEN {v} = 1000 THEN [1000] ELSE list_append({own}, 1000) END"
    return f"(coalesce({v} > 0 AND {v} < 10000 AND ({v} < 1000 OR {v} % 1000 = 0), false) AND len(list_filter({parts}, lambda p: NOT {said})) = 0)"


_LEFT = "(^|[^\\pL\\pN_-])"
_COMPOUND = lambda t: f"(regexp_matches({t}, '{_LEFT}' || n || '-\\pL') OR regexp_matches({t}, '{_LEFT}' || n || '[A-ZА-ЯЁ]([^\\pL\\pN_]|$)'))"
_PLACE = f"(regexp_matches(src, '(?i)\\b({numerals.PLACES})\\s+' || n || '\\b') OR regexp_matches(src, '\\b(19|20)\\d0s\\b') OR regexp_matches(src, '[''’]' || n || '0?s\\b'))"
_IMP, _MET, _GAP = numerals.IMPERIAL, numerals.METRIC.replace(r"\w*\b", ""), numerals.GAP
_BAGS = " UNION ALL ".join(f"SELECT conv_id, turn, '{c}_{h}' AS bag, unnest({_sql_numbers(c, g)}) AS n FROM pairs" for c in ("src", "tr") for h, g in (("g", True), ("r", False)))


@query(
    f"""WITH {NEXT}, bags AS ({_BAGS}),
c AS (SELECT conv_id, turn, n, count(*) FILTER (bag = 'src_g') AS sg, count(*) FILTER (bag = 'src_r') AS sr, count(*) FILTER (bag = 'tr_g') AS tg, count(*) FILTER (bag = 'tr_r') AS tr_ FROM bags GROUP BY ALL),
d AS (SELECT *, CASE WHEN sg > greatest(tg, tr_) THEN 'lost' WHEN tg > greatest(sg, sr) THEN 'gained' END AS side FROM c),
e AS (SELECT d.*, src, tr FROM d JOIN pairs USING (conv_id, turn) WHERE side IS NOT NULL)
SELECT conv_id, turn, side, n, CASE WHEN side = 'lost' THEN CASE WHEN {_COMPOUND('src')} THEN 'compound' WHEN {_PLACE} OR {_sql_words('tr', 'n')} THEN 'words'
    WHEN regexp_matches(src, '(?i)(^|[^0-9])' || n || '{_GAP}{_IMP}') AND regexp_matches(tr, '(?i)[0-9]{_GAP}{_MET}') THEN 'units'
    WHEN contains(tr, '<sup>') AND list_contains(regexp_extract_all(regexp_replace(tr, {TAGS}, '', 'g'), '[0-9]+'), n) THEN 'power' END
  ELSE CASE WHEN {_COMPOUND('tr')} THEN 'compound' WHEN {_sql_words('src', 'n')} THEN 'words'
    WHEN regexp_matches(tr, '(?i)(^|[^0-9])' || n || '{_GAP}{_MET}') AND regexp_matches(src, '(?i)[0-9]{_GAP}{_IMP}|[a-z]\\s+{_IMP}') THEN 'units' END END AS excuse FROM e"""
)
def number_check(spark, d):
    """Numbers that the next document loses or gains, and what excuses them."""
    return checks.number_check(neighbours(spark, d), ["conv_id", "turn"], "en", "en")


@query(
    f"""WITH p AS (SELECT a.doc_id, regexp_replace(a.text, '([0-9]+)', '<sup>\\1</sup>', 'g') AS src, regexp_replace(b.text, '([0-9]+)', '<sup>\\1</sup>', 'g') AS tr FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
a AS (SELECT doc_id, n, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(src, '<sup>\\s*([0-9]+)\\s*</sup>', 1)) AS n FROM p) GROUP BY ALL),
b AS (SELECT doc_id, n, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(tr, '<sup>\\s*([0-9]+)\\s*</sup>', 1)) AS n FROM p) GROUP BY ALL)
SELECT a.doc_id, a.n, a.c - coalesce(b.c, 0) AS times FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND a.n = b.n WHERE a.c > coalesce(b.c, 0)"""
)
def note_marks(spark, d):
    """Q05: footnote marks that the next text lacks; here every number is one."""
    marked = F.regexp_replace("text", "([0-9]+)", "<sup>$1</sup>")
    a, b = docs(spark, d).select("doc_id", marked.alias("src")), docs(spark, d).select((F.col("doc_id") - 1).alias("doc_id"), marked.alias("tr"))
    return checks.note_marks(a.join(b, "doc_id"), ["doc_id"])


@query("SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(trim(text)) > 12 AND regexp_replace(lower(trim(text)), '\\.+$', '') NOT IN ('нет', 'none', 'keine', 'aucune', '无', 'なし', '-', '—')")
def review_notes(spark, d):
    """Q07: editors' notes that say something."""
    return checks.review(table(spark, d, "conversations").filter("role = 'assistant'"), "text").select("conv_id", "turn")


@query(
    """WITH e AS (SELECT user_id % 7 AS book, event_type AS pass, user_id AS id, CAST(event_id % 3 AS VARCHAR) AS model, ts FROM events),
l AS (SELECT book, pass, id, arg_max(model, (ts, model)) AS m, min(ts) AS a, max(ts) AS z FROM e GROUP BY ALL),
o AS (SELECT book, pass, m, count(*) AS n, min(a) AS a, max(z) AS z FROM l GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY book, pass) AS s FROM o)
SELECT book, pass, CAST(max(s) AS BIGINT) AS blocks, string_agg(m || ' ' || CAST(round(n * 100 / s) AS INTEGER) || '%', ', ' ORDER BY n DESC, m) AS models,
  CASE WHEN strftime(min(a), '%Y-%m-%d') = strftime(max(z), '%Y-%m-%d') THEN strftime(min(a), '%Y-%m-%d') ELSE strftime(min(a), '%Y-%m-%d') || ' — ' || strftime(max(z), '%Y-%m-%d') END AS span FROM t GROUP BY book, pass"""
)
def provenance(spark, d):
    """Models with their shares and the days of each pass."""
    e = table(spark, d, "events").select((F.col("user_id") % 7).alias("book"), F.col("event_type").alias("pass"), F.col("user_id").alias("id"), (F.col("event_id") % 3).cast("string").alias("model"), "ts")
    return checks.provenance(e, ["book"], "pass", "model", "ts")


@query(
    f"""WITH {LINES}, n AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source),
f AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY line) AS a, row_number() OVER (PARTITION BY source, doc_id ORDER BY line DESC) AS b FROM l WHERE trim(text) <> ''),
e AS (SELECT source, doc_id, lower(regexp_replace(text, '[^\\pL]', '', 'g')) AS key, length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) AS body FROM f WHERE (a <= 2 OR b <= 2) AND length(trim(text)) <= 120),
s AS (SELECT DISTINCT source, key, doc_id FROM e WHERE key <> '' AND length(key) >= 0.5 * body),
g AS (SELECT source, key, doc_id - lag(doc_id) OVER (PARTITION BY source, key ORDER BY doc_id) AS gap, count(*) OVER (PARTITION BY source, key) AS n FROM s),
m AS (SELECT source, key, max(n) AS n, list(gap ORDER BY gap)[(max(n) - 1) // 2 + 1] AS mid FROM g WHERE gap IS NOT NULL GROUP BY source, key)
SELECT source, key, m.n, mid FROM m JOIN n USING (source) WHERE pages >= 5 AND (m.n >= greatest(4, 0.15 * pages) OR m.n >= 4 AND mid <= 5)"""
)
def page_heads(spark, d):
    """Running heads of each book by their share of pages and the median of their gaps."""
    return checks.page_heads(S.lines(docs(spark, d)), ["source"], "doc_id")


@query(
    """SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(regexp_replace(x, '^[\\s\\-*•]+', ''))) AS found
FROM documents WHERE regexp_matches(text, '\\S')"""
)
def injected(spark, d):
    """The places that a report lists; here each text is the list under its line."""
    t = docs(spark, d).filter(F.col("text").rlike(r"\S"))
    listed = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("- "), x))
    report = F.concat(F.lit("# Report\nINJECTED: yes\n"), F.array_join(listed, "\n"), F.lit("\nend"))
    return t.select("doc_id", checks.injections(report).alias("found"))


def _ids(blocks):
    return blocks.withColumn("id", F.format_string("s01.b%04d", F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))))


@query()
def reanchor_ids(spark, d):
    """What becomes of the ids once the repeats of a line are gone; each document is a book."""
    old = _ids(S.lines(docs(spark, d)).filter("trim(text) <> ''")).select("doc_id", "id", X.fingerprint(F.col("text")).alias("fp"))
    left = S.lines(docs(spark, d)).filter("trim(text) <> ''").groupBy("doc_id", "text").agg(F.min("line").alias("line"))
    new = _ids(left).select("doc_id", F.col("line").cast("long").alias("pos"), "id", X.fingerprint(F.col("text")).alias("fp"))
    return alignment.reanchor(old, new, "doc_id")


@query()
def link_pages(spark, d):
    """The first word of each line linked to the page after its own."""
    b = S.lines(docs(spark, d), keep=("doc_id",)).withColumn("page", F.expr("line div 3 + 1"))
    blocks = b.select("doc_id", F.col("line").cast("long").alias("pos"), F.concat(F.lit("b"), F.col("line").cast("string")).alias("id"), F.col("page").cast("int").alias("page"), "text", F.array().cast("array<string>").alias("links"))
    word = F.regexp_extract("text", r"(\p{L}{2,})", 1)
    links = b.select("doc_id", "page", F.col("line").alias("n"), word.alias("words"), (F.col("page") + 1).cast("string").alias("target")).filter("words <> ''")
    out = alignment.link_pages(blocks, links, "doc_id")
    return out.select("doc_id", "pos", "id", F.size("links").alias("n_links"), F.md5("text").alias("digest"))


@query()
def reconcile_contents(spark, d):
    """Titles held against the contents; each document is a book, its first lines the contents."""

    def run(frames):
        for frame in frames:
            rows = []
            for i, text in zip(frame["doc_id"], frame["text"], strict=True):
                pieces = [x for x in (text or "").split("\n") if x.strip()]
                marks = {n: "toc" if n <= 2 else "title" if len(p) < 60 else "p" for n, p in enumerate(pieces, 1)}
                undone = contents.undo_drops(pieces, marks)
                got = contents.reconcile(pieces, marks)
                rows.append((i, len(got.names), got.added, len(got.dropped), len(got.lost), undone))
            yield pd.DataFrame(rows, columns=["doc_id", "names", "added", "dropped", "lost", "undone"])

    return docs(spark, d).select("doc_id", "text").mapInPandas(run, "doc_id long, names long, added long, dropped long, lost long, undone long")


def _marker(system: str, prompt: str) -> str:
    """A model without network: short pieces are titles; each request's first word is corrected nowhere."""
    lines = (x.split(" ", 1) for x in prompt.splitlines())
    return "\n".join(f"{x[0]} title" for x in lines if len(x) == 2 and x[0].isdigit() and len(x[1]) < 40)


@query("WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) + 1 AS n, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, n, 'title' AS mark FROM l WHERE length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) < 40")
def mark_pieces(spark, d):
    """Pieces marked by a model, window by window; here short ones are titles."""
    p = S.lines(docs(spark, d), keep=("doc_id",)).select("doc_id", (F.col("line") + 1).cast("long").alias("n"), "text")
    return model_passes.mark_pieces(p, "doc_id", [_marker])


def _numbered(system: str, prompt: str) -> str:
    return prompt.replace("e", "a")


@query("SELECT doc_id // 8 AS book, t AS text, replace(trim(regexp_replace(t, '\\s+', ' ', 'g')), 'e', 'a') AS title FROM (SELECT DISTINCT doc_id // 8 * 8 AS doc_id, string_split(text, chr(10))[1] AS t FROM documents WHERE text IS NOT NULL AND trim(string_split(text, chr(10))[1]) <> '')")
def stub_headings(spark, d):
    """Distinct headings of each book, translated in batches."""
    b = S.lines(docs(spark, d), keep=("doc_id",)).filter("trim(text) <> '' and line = 0").select(F.expr("doc_id div 8").alias("book"), F.col("doc_id").alias("pos"), F.lit("title").alias("kind"), "text")
    return model_passes.headings(b, "book", [_numbered]).select("book", "text", "title")


@query(
    """SELECT page_id, url FROM pages WHERE starts_with(url, 'http') AND NOT regexp_matches(url, '(?i)oceanofpdf|authoralerts|contents\\.xhtml|#')"""
)
def kept_links(spark, d):
    """Outer links that stay."""
    return table(spark, d, "pages").filter(checks.kept_link(F.col("url"))).select("page_id", "url")


@query(
    """WITH i AS (SELECT l_suppkey % 10 AS book, l_orderkey % 50 AS page, l_partkey AS width, CAST(l_quantity AS BIGINT) * 4 AS height, CAST(l_partkey % 997 AS VARCHAR) AS md5 FROM lineitem),
n AS (SELECT book, count(*) AS c, count(DISTINCT md5) * 3 AS top FROM i GROUP BY book), g AS (SELECT i.* FROM i JOIN n USING (book) WHERE c <= 3 * top AND least(width, height) >= 60 AND greatest(width, height) <= 6 * least(width, height))
SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY book, md5) AS k FROM g) WHERE k <= 2""".replace("SELECT * FROM (SELECT *", "SELECT book, page, width, height, md5 FROM (SELECT *")
)
def kept_images(spark, d):
    """Images that are pictures; here lines of orders stand for them."""
    i = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("book"), (F.col("l_orderkey") % 50).alias("page"), F.col("l_partkey").alias("width"), (F.col("l_quantity").cast("long") * 4).alias("height"), (F.col("l_partkey") % 997).cast("string").alias("md5"))
    pages = i.groupBy("book").agg((F.countDistinct("md5") * 3).alias("pages"))
    return checks.kept_images(i, ["book"], pages).select("book", "page", "width", "height", "md5")


@query(
    """SELECT conv_id, 't' || turn AS block, string_split(trim(text), ' ')[1] AS old, reverse(string_split(trim(text), ' ')[1]) AS new FROM conversations
WHERE text IS NOT NULL AND NOT contains(string_split(trim(text), ' ')[1], '[') AND string_split(trim(text), ' ')[1] <> ''"""
)
def fix_parse(spark, d):
    """Corrections written as an answer and parsed again: the first word of each turn."""
    first = F.element_at(F.split(F.trim("text"), " "), 1)
    c = table(spark, d, "conversations").filter("text is not null").filter(~first.contains("[") & (first != ""))
    said = F.concat(F.lit("[[[F t"), F.col("turn").cast("string"), F.lit("]]]\nORIG: "), first, F.lit("\nFIX: "), F.reverse(first))
    return answers.fixes(c.groupBy("conv_id").agg(F.array_join(F.collect_list(said), "\n").alias("out")), "out")


def _problem_sql() -> str:
    counted = {"missing": ("completeness", "count(*)", "true"), "terms": ("terms_check", "coalesce(sum(missed), 0)", "true"), "marks": ("note_marks", "count(*)", "true"), "numbers": ("number_check", "count(*)", "side = 'lost' AND excuse IS NULL")}
    one = [f"SELECT '{kind}' AS kind, CAST({what} AS BIGINT) AS n FROM ({_SQL[name]}) WHERE {where}" for kind, (name, what, where) in counted.items()]
    return f"WITH c AS ({' UNION ALL '.join(one)}) SELECT * FROM c UNION ALL SELECT 'all', CAST(sum(n) AS BIGINT) FROM c"


@query(_problem_sql())
def problems(spark, d):
    """Q06, Q01, Q02, Q05: problems by kind and altogether, over the tables that the single checks take."""
    count = lambda df, kind, c=F.count("*"): df.agg(c.cast("long").alias("n")).select(F.lit(kind).alias("kind"), "n")
    c = count(completeness(spark, d), "missing")
    c = c.unionByName(count(terms_check(spark, d), "terms", F.coalesce(F.sum("missed"), F.lit(0))))
    c = c.unionByName(count(note_marks(spark, d), "marks"))
    c = c.unionByName(count(number_check(spark, d).filter("side = 'lost' and excuse is null"), "numbers"))
    return c.unionByName(c.agg(F.sum("n").alias("n")).select(F.lit("all").alias("kind"), "n"))
