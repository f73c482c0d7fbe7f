"""Queries of parsers and text functions: what is written from a table is read again by the operator."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.books_catalog import SHELF, shelf
from quire.catalog import PAIRS, docs, pairs, query, table
from quire.functions import text as X
from quire.operators import reading as R
from quire.operators import sequence as S
from quire.plans import answers
from quire.sources import books

#: Words of a document in Latin letters, five at least.
_WS = "w AS (SELECT doc_id, ws FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]{2,}') AS ws FROM documents WHERE text IS NOT NULL) WHERE len(ws) >= 5)"


def _ws(spark, d):
    ws = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))
    return docs(spark, d).filter("text is not null").select("doc_id", ws.alias("ws")).filter(F.size("ws") >= 5)


@query(
    f"""WITH {_WS}, n AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ws[1] WHEN 1 THEN ws[1] || ' ' || ws[2] ELSE '' END AS author, CASE doc_id % 4 WHEN 3 THEN '' ELSE ws[3] || ': ' || ws[4] || '/' || ws[5] || '?' END AS title FROM w)
SELECT doc_id, substr(regexp_replace(CASE WHEN title = '' THEN 'book' WHEN author = '' THEN title ELSE CASE doc_id % 3 WHEN 1 THEN split_part(author, ' ', 2) || ' ' || split_part(author, ' ', 1) ELSE author END || '. ' || title END, '[\\\\/:*?"<>|]+', '-', 'g'), 1, 180) AS name FROM n"""
)
def output_names(spark, d):
    """Names of files from an author and a title."""
    ws = lambda i: F.col("ws")[i]
    author = F.expr("case doc_id % 3 when 0 then ws[0] when 1 then concat(ws[0], ' ', ws[1]) else '' end")
    title = F.when(F.expr("doc_id % 4 = 3"), "").otherwise(F.concat(ws(2), F.lit(": "), ws(3), F.lit("/"), ws(4), F.lit("?")))
    return _ws(spark, d).select("doc_id", X.out_name(author, title, F.lit("book")).alias("name"))


@query(f"WITH {_WS} SELECT doc_id, 'a ' || ws[1] || ws[2] || ' ' || upper(ws[3]) || ', ' || ws[4] AS text FROM w WHERE length(ws[3]) >= 4")
def mended_words(spark, d):
    """words broken over lines and words set with spaces between their letters, put together."""
    spaced = F.array_join(F.split(F.upper(F.col("ws")[2]), ""), " ")
    broken = F.concat(F.lit("a "), F.col("ws")[0], F.lit("-\n"), F.col("ws")[1], F.lit(" / "), F.trim(spaced), F.lit(", "), F.col("ws")[3])
    mended = X.unspaced(X.dehyphenate(broken))
    return _ws(spark, d).filter(F.length(F.col("ws")[2]) >= 4).select("doc_id", F.replace(mended, F.lit(" / "), F.lit(" ")).alias("text"))


@query(
    """SELECT event_id, event_id % 5 <> 4 AS limited, CASE event_id % 5 WHEN 0 THEN event_id % 9 * 3600 + event_id % 60 * 60 + event_id % 7 WHEN 1 THEN (event_id % 50 + 1) * 60
  WHEN 2 THEN CASE WHEN (event_id % 24) * 60 + 30 > 720 THEN ((event_id % 24) * 60 + 30 - 720) * 60 ELSE ((event_id % 24) * 60 + 30 + 720) * 60 END END AS seconds FROM events"""
)
def limit_messages(spark, d):
    """messages about limits, and the seconds until they end; it is noon."""
    said = F.expr("""case event_id % 5 when 0 then concat('Quota used up, resets in ', event_id % 9, 'h ', event_id % 60, 'm ', event_id % 7, 's') when 1 then concat('limit: resets in ', event_id % 50 + 1, 'm')
      when 2 then concat('usage limit reached, resets at ', event_id % 24, ':30') when 3 then 'too many requests, try again' else 'the prompt is too long, the context limit is 9' end""")
    noon = F.lit("2024-05-05 12:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", X.limited(said).alias("limited"), F.when(F.expr("event_id % 5 < 4"), X.reset_after(said, noon)).alias("seconds"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN k = 0 THEN [a] ELSE range(a, a + k + 1) END)))), ' ') AS chunks FROM (SELECT user_id, event_id % 40 AS a, event_id % 3 AS k FROM events WHERE event_id % 7 = 0) GROUP BY user_id")
def chunk_numbers(spark, d):
    """``5,6,41-43`` as numbers."""
    e = table(spark, d, "events").filter("event_id % 7 = 0").select("user_id", F.expr("event_id % 40").alias("a"), F.expr("event_id % 3").alias("k"))
    said = F.when(F.col("k") == 0, F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), (F.col("a") + F.col("k")).cast("string")))
    told = e.groupBy("user_id").agg(F.array_join(F.collect_list(said), ", ").alias("said"))
    return told.select("user_id", F.array_join(F.transform(X.chunk_numbers(F.col("said")), lambda x: x.cast("string")), " ").alias("chunks"))


@query("SELECT conv_id, turn, md5(rtrim(text, ' ' || chr(10) || chr(9) || chr(13))) AS digest FROM conversations WHERE text IS NOT NULL AND NOT regexp_matches(text, '(```|>)\\s*$')")
def cleaned_answers(spark, d):
    """answers without the fences and closing tags after them."""
    c = table(spark, d, "conversations").filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"(```|>)\s*$"))
    bare = F.rtrim(F.col("text"), F.lit(" \n\t\r"))
    dressed = F.concat(bare, F.expr("case turn % 3 when 0 then '\\n```' when 1 then '\\n</answer>\\n```\\n' else '' end"))
    return c.select("conv_id", "turn", F.md5(X.unscaffold(dressed)).alias("digest"))


@query(
    f"""WITH {_WS} SELECT doc_id, ws[1] || ' ' || ws[2] AS title, CAST(1900 + doc_id % 120 AS VARCHAR) AS year, CASE doc_id % 3 WHEN 0 THEN 'sf_space' WHEN 1 THEN 'poetry' END AS genre,
  CASE WHEN doc_id % 4 = 0 THEN ws[4] || ' ' || ws[5] || '|' || ws[3] ELSE '' END AS dropped FROM w"""
)
def meta_records(spark, d):
    """the record of a book from a report, with known keys and genres, and the sections to drop."""
    w = _ws(spark, d)
    at = lambda i: F.col("ws")[i]
    genre = F.expr("case doc_id % 3 when 0 then 'SF_Space' when 1 then '`poetry`' else 'unheard_of' end")
    drop = F.when(F.expr("doc_id % 4 = 0"), F.concat(F.lit("\ndrop_sections:\n- \""), at(3), F.lit(" "), at(4), F.lit("\"\n* "), at(2), F.lit("\n\nend"))).otherwise("")
    report = F.concat(F.lit("# NAMES\ntitle = no\n## META\n- **title** = wrong\ntitle = \""), at(0), F.lit(" "), at(1), F.lit("\"\nyear: "), F.expr("cast(1900 + doc_id % 120 as string)"), F.lit("\nshelf = 3\npublisher = (unknown)\ngenre = "), genre, F.lit("\n## NEXT\nauthor = no"), drop)
    m = w.withColumn("report", report).withColumn("m", answers.record(F.col("report")))
    return m.select("doc_id", F.col("m")["title"].alias("title"), F.col("m")["year"].alias("year"), F.try_element_at("m", F.lit("genre")).alias("genre"), F.array_join(answers.dropped_sections(F.col("report")), "|").alias("dropped"))


@query(f"WITH {_WS} SELECT doc_id, 'b' || (doc_id % 9) AS block, CASE doc_id % 2 WHEN 0 THEN 'fact' ELSE 'source' END AS kind, ws[1] AS term, ws[2] || ' ' || ws[3] AS text FROM w")
def note_parse(spark, d):
    """Notes of an answer; unknown kinds don't count."""
    at = lambda i: F.col("ws")[i]
    out = F.concat(F.lit("Here: [[[NOTE b"), F.expr("cast(doc_id % 9 as string)"), F.expr("if(doc_id % 2 = 0, ' fact', ' source')"), F.lit("]]]\nTERM: "), at(0), F.lit("\nTEXT:  "), at(1), F.lit(" "), at(2), F.lit("\n[[[NOTE b1 rumour]]]\nTERM: x\nTEXT: y"))
    return answers.notes(_ws(spark, d).select("doc_id", out.alias("out")), "out").select("doc_id", "block", "kind", "term", "text")


@query(f"WITH {_WS} SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN 'verse' ELSE 'title' END AS p_a, 'subtitle' AS h3, 2 AS n_styles, ws[1] AS one, ws[3] || ' ' || ws[4] AS two, 2 AS n_titles FROM w")
def style_parse(spark, d):
    """A style map, of which the last word on a pair counts, and numbered headings."""
    at = lambda i: F.col("ws")[i]
    said = F.concat(F.lit("So:\np|a = p\nh3| = Subtitle\np|a = "), F.expr("if(doc_id % 2 = 0, 'VERSE', 'title')"), F.lit("\nq|z = poster\nno line"))
    titles = F.concat(F.lit("Well\n1. "), at(0), F.lit("\n 2) "), at(2), F.lit(" "), at(3), F.lit(" \nx. no"))
    m = _ws(spark, d).select("doc_id", answers.styles(said).alias("s"), answers.heading_lines(titles).alias("t"))
    return m.select("doc_id", F.col("s")["p|a"].alias("p_a"), F.col("s")["h3|"].alias("h3"), F.size("s").alias("n_styles"), F.col("t")[1].alias("one"), F.col("t")[2].alias("two"), F.size("t").alias("n_titles"))


@query(f"WITH {_WS} SELECT doc_id, ws[1] || '~' || ws[2] || ';' || ws[3] || '~' || ws[4] AS cells FROM w")
def table_parse(spark, d):
    """The rows of a Markdown table without its rule."""
    at = lambda i: F.col("ws")[i]
    text = F.concat(F.lit("Names\n| "), at(0), F.lit(" | "), at(1), F.lit(" |\n|---|:--|\n|"), at(2), F.lit("|  "), at(3), F.lit(" |\nend | of"))
    return _ws(spark, d).select("doc_id", F.array_join(F.transform(answers.table_rows(text), lambda r: F.array_join(r, "~")), ";").alias("cells"))


@query("SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'SUMMARY:' ELSE 'SUMMARY: [[[P' END AS lost FROM (SELECT DISTINCT conv_id FROM conversations)")
def prompt_tokens(spark, d):
    """Tokens of the protocol that a user's prompt lacks."""
    own = F.lit("Mark [[[P id]]] and close; then SUMMARY: of it")
    over = F.expr("case conv_id % 3 when 0 then 'Use [[[P x]]], SUMMARY: short' when 1 then 'Use [[[P x]]] alone' else 'Do as you like' end")
    c = table(spark, d, "conversations").select("conv_id").distinct()
    return c.select("conv_id", F.array_join(F.array_sort(answers.lost_tokens(own, over)), " ").alias("lost"))


@query(f"WITH {SHELF} SELECT book, pos FROM b WHERE kind IN ('p', 'note') AND pos % 9 <> 2")
def translatable(spark, d):
    """Blocks that are translated: prose, notes, verse and tables that don't stay as they are."""
    b = shelf(spark, d).withColumn("asis", F.when(F.expr("pos % 9 = 2"), True))
    return R.translatable(b).select("book", "pos")


@query(
    f"""WITH {SHELF}, k AS (SELECT book, pos, kind, text, pos % 9 = 2 AS asis, pos % 13 = 5 AS gone, CASE WHEN pos % 4 <> 3 THEN reverse(text) END AS tr FROM b)
SELECT book, pos, CASE WHEN asis OR kind = 'title' THEN coalesce(tr, text) ELSE tr END AS text, tr IS NULL AND NOT asis AND kind <> 'title' AS missing FROM k WHERE NOT gone"""
)
def backfilled(spark, d):
    """Translations over their blocks; what stays has its own text, dropped blocks are left out, others are missing. Here titles stay."""
    b = shelf(spark, d).withColumn("asis", F.expr("pos % 9 = 2 or kind = 'title'")).withColumn("drop", F.expr("pos % 13 = 5"))
    tr = shelf(spark, d).filter("pos % 4 <> 3").select("book", "pos", X.reverse(F.col("text")).alias("tr"))
    return R.backfilled(b, tr, ["book", "pos"]).select("book", "pos", "text", "missing")


@query(f"WITH {PAIRS}, r AS (SELECT conv_id, turn, length(trim(tr)) / CAST(greatest(length(trim(src)), 1) AS DOUBLE) AS a, length(trim(tr)) * 2 / CAST(greatest(length(trim(src)), 1) AS DOUBLE) AS b, length(trim(src)) AS n FROM pairs) SELECT conv_id, turn, n >= 60 AND NOT a BETWEEN 0.5 AND 2.5 AND abs(b - 1) < abs(a - 1) AS regrown FROM r")
def regrown(spark, d):
    """Answers that are far too short or long, replaced by a second one if it is nearer to the source's length; here twice as long."""
    size = lambda c: F.length(F.trim(c))
    return pairs(spark, d).select("conv_id", "turn", R.better_answer(size(F.col("src")), size(F.col("tr")), size(F.col("tr")) * 2).alias("regrown"))


#: Lines of documents that look like text in every format.
_LINES = "l AS (SELECT doc_id, line, t FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line, trim(unnest(string_split(text, chr(10)))) AS t FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(t, '^[A-Za-z][A-Za-z0-9 .,;:!?-]*$'))"


def _lines(spark, d):
    return S.lines(docs(spark, d), keep=("doc_id",)).withColumn("text", F.trim("text")).filter(F.col("text").rlike(r"^[A-Za-z][A-Za-z0-9 .,;:!?-]*$"))


def _texts(spark, d, sep):
    whole = F.array_sort(F.collect_list(F.struct("line", "text")))
    return _lines(spark, d).groupBy("doc_id").agg(whole.alias("w")).select("doc_id", F.array_join(F.transform("w", lambda x: x["text"]), sep).alias("text"))


def _read(parse):
    def run(batches):
        for batch in batches:
            rows = [(i, n, b["kind"], b["text"]) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for n, b in enumerate(parse(t))]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["doc_id", "pos", "kind", "text"])

    return run


@query(
    f"""WITH {_LINES}, t AS (SELECT *, length(t) < 60 AND (regexp_matches(t, '(?i)^(chapter|part|book|kapitel|chapitre|cap[ií]tulo|глава|часть)\\b.{{0,60}}$') OR upper(t) = t AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 3 AND NOT regexp_matches(t, 'ISBN|[0-9]{{4}}')) AS title FROM l),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, title, t) AS n FROM t)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS BIGINT) AS pos, CASE WHEN title THEN 'title' ELSE 'p' END AS kind, t AS text FROM k WHERE NOT title OR n <= 3"""
)
def plain_text(spark, d):
    """Documents as plain text: titles by their words and capitals, repeated ones left out."""
    t = _texts(spark, d, "\n").withColumn("text", F.concat(F.lit("- 7 -\n"), "text", F.lit("\n 12 ")))
    return t.mapInArrow(_read(books.plain), "doc_id long, pos long, kind string, text string")


@query(f"""WITH {_LINES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS r FROM l)
SELECT doc_id, CAST(r AS BIGINT) AS pos, CASE r % 6 WHEN 0 THEN 'title' WHEN 2 THEN 'subtitle' WHEN 3 THEN 'code' WHEN 4 THEN 'table' ELSE 'p' END AS kind,
  CASE r % 6 WHEN 1 THEN 'see <b>' || regexp_replace(t, '\\s+', ' ', 'g') || '</b> <a1>there</a1>' WHEN 3 THEN t WHEN 4 THEN 'a | b' || chr(10) || t || ' | 1' ELSE regexp_replace(t, '\\s+', ' ', 'g') END AS text FROM k""")
def markdown_text(spark, d):
    """Documents as Markdown with headings, spans, links, fences and tables."""
    w = Window.partitionBy("doc_id").orderBy("line")
    t, one = F.col("text"), F.regexp_replace("text", r"\s+", " ")
    made = (
        F.when(F.expr("r % 6 = 0"), F.concat(F.lit("## "), one))
        .when(F.expr("r % 6 = 1"), F.concat(F.lit("see **"), one, F.lit("**\n[there](http://x.org)")))
        .when(F.expr("r % 6 = 2"), F.concat(F.lit("#### "), one, F.lit(" ##")))
        .when(F.expr("r % 6 = 3"), F.concat(F.lit("```py\n"), t, F.lit("\n```")))
        .when(F.expr("r % 6 = 4"), F.concat(F.lit("| a | b |\n|---|:-:|\n| "), t, F.lit(" | 1 |")))
        .otherwise(one)
    )
    rows = _lines(spark, d).withColumn("r", F.row_number().over(w) - 1).withColumn("text", made)
    whole = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("w"))
    return whole.select("doc_id", F.array_join(F.transform("w", lambda x: x["text"]), "\n\n").alias("text")).mapInArrow(_read(books.markdown), "doc_id long, pos long, kind string, text string")
