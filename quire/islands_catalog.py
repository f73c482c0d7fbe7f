"""Queries whose operators are Python islands: parsers, planners, passes and writers."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quire.catalog import PAIRS, docs, pairs, query, table
from quire.functions import similarity
from quire.functions import text as X
from quire.model import T
from quire.operators import checks
from quire.operators import sequence as S
from quire.plans import packing, passes, protocol
from quire.sinks import writers
from quire.sources import encoding, html

BLOCK = "page_id long, pos long, id string, kind string, text string, links array<string>, level int"


def _page_blocks(frames):
    for frame in frames:
        rows = [{"page_id": i, **{k: b[k] for k in ("pos", "id", "kind", "text", "links", "level")}} for i, h in zip(frame["page_id"], frame["html"], strict=True) for b in html.numbered(html.read(h).blocks)]
        out = pd.DataFrame(rows, columns=["page_id", "pos", "id", "kind", "text", "links", "level"])
        out["level"] = out["level"].astype("Int32")
        yield out


def page_blocks(spark, d):
    return table(spark, d, "pages").select("page_id", "html").mapInPandas(_page_blocks, BLOCK)


@query()
def html_blocks(spark, d):
    """Pages as ordered blocks."""
    return page_blocks(spark, d)


@query()
def style_census(spark, d):
    """Tags and classes with counts and three samples, evenly spread over the first sixty."""

    def run(frames):
        for frame in frames:
            rows = [(i, n, *x) for i, h in zip(frame["page_id"], frame["html"], strict=True) for n, x in enumerate(html.read(h).census)]
            yield pd.DataFrame(rows, columns=["page_id", "n", "tag", "cls", "sample"])

    seen = table(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, n long, tag string, cls string, sample string")
    return checks.spread(seen, ["tag", "cls"], ["page_id", "n"], "sample").orderBy(F.desc("count"))


def _lines_as_blocks(spark, d):
    """Lines as blocks; each document is a book, so that no task holds more than one."""
    return S.lines(docs(spark, d)).filter("trim(text) <> ''").withColumn("pos", F.col("line").cast("long")).withColumn("kind", F.when(F.col("line") == 0, "title").otherwise("p"))


@query()
def chunk_plan(spark, d):
    """Chunks of each book, and their words."""
    b = _lines_as_blocks(spark, d).withColumn("words", X.words(F.col("text")))
    return packing.plan_chunks(b, "doc_id").groupBy("doc_id", "chunk").agg(F.count("*").alias("blocks"), F.sum("words").alias("words"))


@query()
def size_batches(spark, d):
    """Batches of at most 12,000 characters."""
    b = _lines_as_blocks(spark, d).withColumn("size", F.length("text").cast("long"))
    return packing.plan_batches(b, "doc_id", T.fix_chars).groupBy("doc_id", "batch").agg(F.count("*").alias("blocks"), F.sum("size").alias("chars"))


@query()
def glossary_budget(spark, d):
    """The terms that a request about each turn carries, from the turns before it."""

    def run(pdf):
        pdf = pdf.sort_values("turn")
        texts = [t or "" for t in pdf["text"]]
        said = [(k, *t.split()[:2]) for k, t in enumerate(texts) if len(t.split()) > 1]
        out = [(i, n, len(packing.glossary(said, k, t))) for k, (i, n, t) in enumerate(zip(pdf["conv_id"], pdf["turn"], texts, strict=True))]
        return pd.DataFrame(out, columns=["conv_id", "turn", "terms"])

    return table(spark, d, "conversations").select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, terms long")


@query()
def similarity_twins(spark, d):
    """Neighbouring answers that are alike although the questions aren't."""

    def run(pdf):
        pdf = pdf.sort_values("turn")
        found = similarity.twins([str(t) for t in pdf["turn"]], pdf["src"].tolist(), pdf["tr"].tolist())
        return pd.DataFrame({"conv_id": [pdf["conv_id"].iloc[0]], "twins": [len(found)]})

    return pairs(spark, d).groupBy("conv_id").applyInPandas(run, "conv_id long, twins long")


_LISTING = """WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]{3,}') AS ws FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, array_to_string(ws[1:5], ' ') AS said FROM w WHERE len(ws) >= 5)
SELECT doc_id, length(said) >= 12 AND doc_id % 4 <> 1 AS replaced,
  md5('x = 1' || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'y = 2  # ' WHEN 1 THEN 's = "' WHEN 2 THEN 'z(); // ' ELSE '/* ' END
    || CASE WHEN length(said) >= 12 AND doc_id % 4 <> 1 THEN 'neu' ELSE said END || CASE doc_id % 4 WHEN 1 THEN '"' WHEN 3 THEN ' */' ELSE '' END) AS digest FROM k"""


@query(_LISTING)
def comment_splice(spark, d):
    """Translated comments set into listings; a document's first words are a comment, or a string that isn't one."""
    ws = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    k = docs(spark, d).filter("text is not null").withColumn("ws", ws).filter(F.size("ws") >= 5).select("doc_id", F.array_join(F.slice("ws", 1, 5), " ").alias("said"))
    sign = F.expr("case doc_id % 4 when 0 then 'y = 2  # ' when 1 then 's = \"' when 2 then 'z(); // ' else '/* ' end")
    end = F.expr("case doc_id % 4 when 1 then '\"' when 3 then ' */' else '' end")
    rows = k.select("doc_id", "said", F.concat(F.lit("x = 1\n"), sign, "said", end).alias("listing"))

    def run(batches):
        for batch in batches:
            done = [similarity.splice(t, [(2, s, "neu")]) for t, s in zip(batch.column("listing").to_pylist(), batch.column("said").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n > 0 for _, n in done]), pa.array([t for t, _ in done], pa.string())], ["doc_id", "replaced", "listing"])

    return rows.mapInArrow(run, "doc_id long, replaced boolean, listing string").select("doc_id", "replaced", F.md5("listing").alias("digest"))


@query()
def encoding_detect(spark, d):
    """Texts written in each encoding that has their letters, and how many are read as they were."""
    names = ("utf-8", "utf-16", "cp1252", "cp1250", "cp1251", "koi8-r")
    rows = docs(spark, d).filter("text is not null").select("lang", "text")

    def run(batches):
        for batch in batches:
            out = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for name in names:
                    try:
                        raw = text.encode(name)
                    except UnicodeEncodeError:
                        continue
                    out.append((lang, name, encoding.decode(raw)[0] == text))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.string(), pa.bool_()))], ["lang", "name", "same"])

    told = rows.mapInArrow(run, "lang string, name string, same boolean")
    return told.groupBy("lang", "name").agg(F.count_if("same").alias("right"), F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, pos, array_to_string(list_transform(list_filter(regexp_split_to_array(replace(t, '[[[', '['), '\\s+'), lambda w: w <> ''), lambda w: reverse(w)), ' ') AS tr FROM l WHERE trim(t) <> '')
SELECT doc_id, count(*) AS blocks, md5(string_agg(tr, chr(10) ORDER BY pos)) AS digest FROM b GROUP BY doc_id"""
)
def stub_translate(spark, d):
    """An ordered pass over the chunks of each book by a model without network, which reverses words."""
    b = _lines_as_blocks(spark, d).withColumn("words", X.words(F.col("text"))).withColumn("id", F.concat_ws(".", "doc_id", "line"))
    chunked = packing.plan_chunks(b, "doc_id").select("doc_id", "pos", "chunk").join(b.select("doc_id", "pos", "id", F.regexp_replace("text", r"\[\[\[", "[").alias("text")), ["doc_id", "pos"])
    told = passes.translate(chunked, "doc_id", [passes.stub]).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.array_sort(F.collect_list(F.struct("pos", "tr"))).alias("t"))
    return told.select("doc_id", "blocks", F.md5(F.array_join(F.transform("t", lambda x: x["tr"]), "\n")).alias("digest"))


def _editor(system: str, prompt: str) -> str:
    """A model without network: drafts of even length get a mark of exclamation, others aren't named."""
    drafts = (r for r in protocol.records(prompt, "T"))
    return "\n".join(f"[[[P {r.args[0]}]]] {r.body}!" for r in drafts if len(r.body) % 2 == 0)


@query(
    f"""WITH {PAIRS}, t AS (SELECT conv_id, turn, trim(replace(tr, '[[[', '['), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS tr FROM pairs)
SELECT conv_id, turn, md5(tr || '!') AS digest FROM t WHERE length(tr) % 2 = 0 AND tr <> ''"""
)
def stub_edit(spark, d):
    """An edit pass in parallel over chunks; rows are what it changed."""
    safe = lambda c: F.replace(c, F.lit("[[["), F.lit("["))
    p = pairs(spark, d).select("conv_id", F.lit(0).alias("chunk"), F.col("turn").cast("long").alias("pos"), F.col("turn").cast("string").alias("id"), safe("src").alias("text"), safe("tr").alias("tr")).filter("trim(tr) <> ''")
    return passes.edit_pass(p, "conv_id", [_editor]).select("conv_id", F.col("pos").alias("turn"), F.md5("new").alias("digest"))


_TXT = """WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, pos, regexp_replace(text, '</?[a-zA-Z][^>]*>', '', 'g') AS t, pos % 5 = 4 AS verse FROM l)
SELECT doc_id, md5(string_agg(CASE WHEN verse THEN '    ' || t ELSE t END, chr(10) ORDER BY pos)) AS digest FROM r GROUP BY doc_id"""


@query(_TXT)
def render_txt(spark, d):
    """Plain text of each document, every fifth line as verse."""
    b = S.lines(docs(spark, d)).withColumnRenamed("line", "pos").withColumn("kind", F.when(F.col("pos") % 5 == 4, "verse").otherwise("p"))
    return writers.render_text(b, "doc_id").select("doc_id", F.md5("text").alias("digest"))


def _rendered(spark, d, kind):
    return writers.render(page_blocks(spark, d), "page_id", kind).select("page_id", "name", F.octet_length("content").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query()
def render_md(spark, d):
    """Pages as Markdown."""
    return _rendered(spark, d, "md")


@query()
def render_html(spark, d):
    """Pages as HTML."""
    return _rendered(spark, d, "html")


@query()
def render_epub(spark, d):
    """Pages as EPUB."""
    return _rendered(spark, d, "epub")


@query()
def render_fb2(spark, d):
    """Pages as FB2."""
    return _rendered(spark, d, "fb2")


@query()
def render_tex(spark, d):
    """Pages as LaTeX."""
    return _rendered(spark, d, "tex")


#: Lines of a document as blocks: the first a title, every fifth verse.
_DOC = """l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, CASE WHEN pos = 0 THEN 'title' WHEN pos % 5 = 4 THEN 'verse' ELSE 'p' END AS kind FROM l)"""


def _written(spark, d, kind):
    p = S.lines(docs(spark, d), keep=("doc_id",)).withColumn("pos", F.col("line").cast("long"))
    b = p.select("doc_id", "pos", F.expr("concat('b', pos)").alias("id"), F.expr("case when pos = 0 then 'title' when pos % 5 = 4 then 'verse' else 'p' end").alias("kind"), "text", F.array().cast("array<string>").alias("links"), F.lit(None).cast("int").alias("level"))
    return writers.render(b, "doc_id", kind).select("doc_id", F.md5("content").alias("digest"))


def _replaced(x: str, pairs: list[tuple[str, str]]) -> str:
    for a, b in pairs:
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


_XML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]


@query(f"""WITH {_DOC}, m AS (SELECT doc_id, pos, CASE kind WHEN 'title' THEN '# ' ELSE '' END || {_replaced("t", [(chr(92), chr(92) * 2), *((c, chr(92) + c) for c in "`*_[]")])} || CASE kind WHEN 'verse' THEN '  ' ELSE '' END AS x FROM b)
SELECT doc_id, md5(string_agg(x, chr(10) || chr(10) ORDER BY pos) || chr(10)) AS digest FROM m GROUP BY doc_id""")
def write_md(spark, d):
    """Documents as Markdown."""
    return _written(spark, d, "md")


@query(f"""WITH {_DOC}, m AS (SELECT doc_id, pos, CASE kind WHEN 'title' THEN '<h1 id="b0">' || {_replaced("t", _XML)} || '</h1>' WHEN 'verse' THEN '<p class="verse">' || {_replaced("t", _XML)} || '</p>' ELSE '<p>' || {_replaced("t", _XML)} || '</p>' END AS x FROM b)
SELECT doc_id, md5('<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="utf-8"/><title>' || doc_id || '</title></head><body>' || chr(10) || string_agg(x, chr(10) ORDER BY pos) || chr(10) || '</body></html>' || chr(10)) AS digest FROM m GROUP BY doc_id""")
def write_html(spark, d):
    """Documents as HTML."""
    return _written(spark, d, "html")


@query(f"""WITH {_DOC}, e AS (SELECT *, {_replaced("t", _XML)} AS x, kind = 'verse' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos), '') <> 'verse' AS opens, kind = 'verse' AND coalesce(lead(kind) OVER (PARTITION BY doc_id ORDER BY pos), '') <> 'verse' AS closes FROM b),
m AS (SELECT doc_id, pos, CASE kind WHEN 'title' THEN '<section><title><p>' || x || '</p></title>' WHEN 'verse' THEN CASE WHEN opens THEN '<poem><stanza>' ELSE '' END || '<v>' || x || '</v>' || CASE WHEN closes THEN '</stanza></poem>' ELSE '' END ELSE '<p>' || x || '</p>' END AS x FROM e)
SELECT doc_id, md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><book-title>' || doc_id || '</book-title><lang>en</lang></title-info></description><body>' || string_agg(x, '' ORDER BY pos) || '</section></body></FictionBook>') AS digest FROM m GROUP BY doc_id""")
def write_fb2(spark, d):
    """Documents as FB2."""
    return _written(spark, d, "fb2")


_TEX = [(chr(92), "\x01"), *((c, chr(92) + c) for c in "{}$&#%_"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"), ("\x01", r"\textbackslash{}")]


@query(f"""WITH {_DOC}, m AS (SELECT doc_id, pos, CASE kind WHEN 'title' THEN '\\chapter{{' || {_replaced("t", _TEX)} || '}}' WHEN 'verse' THEN {_replaced("t", _TEX)} || '\\\\' ELSE {_replaced("t", _TEX)} || chr(10) END AS x FROM b)
SELECT doc_id, md5('\\documentclass{{book}}' || chr(10) || '\\usepackage{{hyperref,ulem}}' || chr(10) || '\\title{{' || doc_id || '}}' || chr(10) || '\\begin{{document}}' || chr(10) || string_agg(x, chr(10) ORDER BY pos) || chr(10) || '\\end{{document}}' || chr(10)) AS digest FROM m GROUP BY doc_id""")
def write_tex(spark, d):
    """Documents as LaTeX."""
    return _written(spark, d, "tex")
