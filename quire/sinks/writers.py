"""Books from ordered blocks: text by SQL functions, the other formats one book at a time."""

from __future__ import annotations

import html as _html
import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X

TAG = re.compile(r"</?(?:i|b|s|sub|sup|code|a\d+)>")


def text_line(kind: Column, body: Column) -> Column:
    """A block as plain text."""
    plain = X.strip_tags(body)
    return F.when(kind == "title", F.concat(F.lit("\n\n"), F.upper(plain), F.lit("\n"))).when(kind == "break", "\n* * *\n").when(kind.isin("verse", "code"), F.concat(F.lit("    "), plain)).otherwise(plain)


def render_text(blocks: DataFrame, by: str) -> DataFrame:
    """Each book as one text, in order of pos; notes stand at the end, their marks are numbers in brackets."""
    lines = blocks.filter("not coalesce(drop, false)") if "drop" in blocks.columns else blocks
    text, end = F.col("text"), F.lit(False)
    if {"note_id", "links"} <= set(lines.columns):
        w = Window.partitionBy(by).orderBy("pos")
        lines = lines.withColumn("_n", F.count_if((F.col("kind") == "note") & F.col("note_id").isNotNull()).over(w))
        noted = lines.filter("kind = 'note' and note_id is not null").groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("note_id", F.col("_n").cast("string")))).alias("_notes"))
        lines = lines.join(noted, by, "left")
        number = lambda i: F.try_element_at(F.col("_notes"), i)
        aims = F.transform(F.coalesce("links", F.array()), lambda h, i: F.struct((i + 1).cast("string").alias("i"), number(F.substr(h, F.lit(2))).alias("n")))
        swap = lambda acc, x: F.when(x["n"].isNull(), acc).otherwise(F.regexp_replace(acc, F.concat(F.lit("(?s)<a"), x["i"], F.lit(">.*?</a"), x["i"], F.lit(">")), F.concat(F.lit("["), x["n"], F.lit("]"))))
        said = F.transform(F.map_keys("_notes"), lambda k: F.struct(F.concat(F.lit("[^"), k, F.lit("]")).alias("a"), F.concat(F.lit("["), number(k), F.lit("]")).alias("b")))
        text = F.aggregate(aims, text, swap)
        text = F.aggregate(F.coalesce(said, F.array()), text, lambda acc, x: F.replace(acc, x["a"], x["b"]))
        end = (F.col("kind") == "note") & F.col("note_id").isNotNull()
        text = F.when(end, F.concat(F.lit("["), F.col("_n").cast("string"), F.lit("] "), text)).otherwise(text)
    parts = lines.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(end.alias("end"), "pos", text_line(F.col("kind"), text).alias("t")))).alias("p"))
    return parts.select(by, F.array_join(F.transform("p", lambda x: x["t"]), "\n").alias("text"))


#: What stands for a note's mark until a format writes its own.
MARK = "\ue000{}\ue001"


def noted(blocks: list[dict]) -> tuple[list[dict], dict[str, tuple[int, dict]]]:
    """Blocks without notes, with tokens for the marks that lead to notes, and the notes by id: number and block."""
    notes: dict[str, tuple[int, dict]] = {}
    for b in blocks:
        if b["kind"] == "note" and b.get("note_id"):
            notes.setdefault(b["note_id"], (len(notes) + 1, b))
    if not notes:
        return blocks, {}
    body = []
    for b in blocks:
        if b["kind"] == "note" and b.get("note_id"):
            continue
        text, links = b["text"], b.get("links") or []
        for i, href in enumerate(links, 1):
            if href[:1] == "#" and href[1:] in notes:
                text = re.sub(rf"<a{i}>.*?</a{i}>", lambda _, h=href: MARK.format(h[1:]), text, flags=re.S)
        text = re.sub(r"\[\^([^\]\s]+)\]", lambda m: MARK.format(m[1]) if m[1] in notes else m[0], text)
        body.append({**b, "text": text})
    return body, notes


def _marks(text: str, notes: dict, mark) -> str:
    """Tokens as the marks of a format, from a note's id, number and block."""
    return re.sub("\ue000([^\ue001]*)\ue001", lambda m: mark(m[1], *notes[m[1]]), text) if notes else text


def _spans(s: str, tags: dict[str, tuple[str, str]], links: list[str], link, escape) -> str:
    """Known tags as a format's marks, closed in order; text between them escaped."""
    out: list[str] = []
    open_: list[str] = []

    def mark(name: str, begin: bool) -> str:
        if name in open_:  # within itself a tag says nothing more
            return ""
        return link(name, links, begin) if name[1:].isdigit() else tags[name][0 if begin else 1]

    s = re.sub(r"<(i|b|s|sub|sup|code)></\1>", "", s or "")
    for part in re.split(r"(</?(?:i|b|s|sub|sup|code|a\d+)>)", s):
        if not TAG.fullmatch(part):
            out.append(escape(part))
            continue
        name = part.strip("</>")
        if not part.startswith("</"):
            out.append(mark(name, True))
            open_.append(name)
        elif name in open_:
            while True:
                last = open_.pop()
                out.append(mark(last, False))
                if last == name:
                    break
    while open_:
        out.append(mark(open_.pop(), False))
    return "".join(out)


def _url(name: str, links: list[str]) -> str:
    k = int(name[1:])
    return links[k - 1] if k <= len(links) else ""


def _tight(text: str) -> str:
    """White space before what closes, and after what opens, is moved out: marks of Markdown stand at words."""
    while (moved := re.sub(r"(<(?:i|b|s)>)(\s+)", r"\2\1", re.sub(r"(\s+)(</(?:i|b|s)>)", r"\2\1", text))) != text:
        text = moved
    return text


def markdown(blocks: list[dict]) -> str:
    """Markdown: headings by level, fences, tables with a rule, links, hard breaks in verse."""
    tags = {"i": ("*", "*"), "b": ("**", "**"), "s": ("~~", "~~"), "code": ("`", "`"), "sub": ("<sub>", "</sub>"), "sup": ("<sup>", "</sup>")}
    link = lambda n, ls, begin: "[" if begin else f"]({_url(n, ls)})"
    span = lambda b: _spans(_tight(b["text"]), tags, b.get("links") or [], link, lambda t: re.sub(r"([\\`*_\[\]])", r"\\\1", t))
    blocks, notes = noted(blocks)
    out = []
    for b in [*blocks, *(n for _, n in notes.values())]:
        k = b["kind"]
        if k in ("title", "subtitle"):
            out.append("#" * (b.get("level") or (1 if k == "title" else 3)) + " " + span(b))
        elif k == "code":
            out.append("```\n" + b["text"] + "\n```")
        elif k == "break":
            out.append("* * *")
        elif k == "image":
            out.append(f"![{b['text']}]({(b.get('links') or [''])[0]})")
        elif k == "table":
            rows = [f"| {r} |" for r in b["text"].split("\n")]
            n = len(re.split(r"(?<!\\)\|", b["text"].split("\n")[0]))
            out.append("\n".join([rows[0], "|" + " --- |" * n, *rows[1:]]))
        elif k == "verse":
            out.append(span(b) + "  ")
        elif k == "note":
            out.append(f"[^{b.get('note_id') or 'n'}]: " + span(b))
        else:
            out.append(span(b))
    return _marks("\n\n".join(out) + "\n", notes, lambda i, *_: f"[^{i}]")


def html(blocks: list[dict], title: str = "", places: dict[str, str] | None = None, notes: dict | None = None, linked: set[str] = frozenset()) -> str:
    """One self-contained page; notes are a list at its end with links back to their marks.

    Of a page that isn't a book by itself, ``places`` are the files of block ids elsewhere, ``notes`` those that it
    shows, and ``linked`` the ids that other pages lead to."""
    if notes is None:
        blocks, notes = noted(blocks)
    aims = {h[1:] for b in blocks for h in b.get("links") or [] if h[:1] == "#"} | linked
    at = lambda b: f' id="{_html.escape(str(b["id"]))}"' if b.get("id") in aims else ""
    moved = lambda h: (places or {}).get(h[1:], "") + h if h[:1] == "#" else h
    tags = {t: (f"<{t}>", f"</{t}>") for t in ("i", "b", "s", "sub", "sup", "code")}
    link = lambda n, ls, begin: f'<a href="{_html.escape(moved(_url(n, ls)))}">' if begin else "</a>"
    span = lambda b: _linked(_spans(b["text"], tags, b.get("links") or [], link, _html.escape))
    out = []
    for b in blocks:
        k = b["kind"]
        if k in ("title", "subtitle"):
            n = b.get("level") or (1 if k == "title" else 3)
            out.append(f'<h{n} id="{_html.escape(str(b.get("id") or ""))}">{span(b)}</h{n}>')
        elif k == "code":
            out.append(f"<pre>{_html.escape(b['text'])}</pre>")
        elif k == "break":
            out.append("<hr/>")
        elif k == "image":
            out.append(f'<img src="{_html.escape((b.get("links") or [""])[0])}" alt="{_html.escape(b["text"])}"/>')
        elif k == "table":
            rows = ("".join(f"<td>{_spans(c.strip().replace(chr(92) + '|', '|'), tags, [], link, _html.escape)}</td>" for c in re.split(r"(?<!\\)\|", r)) for r in b["text"].split("\n"))
            out.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
        else:
            out.append(f'<p class="{k}"{at(b)}>{span(b)}</p>' if k != "p" else f"<p{at(b)}>{span(b)}</p>")
    if notes:
        items = (f'<li id="{_html.escape(i)}">{span(b)} <a href="#r-{_html.escape(i)}">↩</a></li>' for i, (_, b) in notes.items())
        out.append('<ol class="notes">' + "".join(items) + "</ol>")
    body = _marks("\n".join(out), notes, lambda i, n, _: f'<a id="r-{_html.escape(i)}" href="#{_html.escape(i)}"><sup>{n}</sup></a>')
    return f'<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><meta charset="utf-8"/><title>{_html.escape(title)}</title></head><body>\n{body}\n</body></html>\n'


#: A bare address, which ends with a letter, a figure or a slash.
ADDRESS = re.compile(r"""(?<![\w"'>/=])https?://[a-zA-Z0-9./\-?=_&;#%~+]+[a-zA-Z0-9/]""")


def _linked(text: str) -> str:
    """Bare addresses as links, but for those in tags and in links."""
    parts = re.split(r"(<a\b.*?</a>|<[^>]*>)", text, flags=re.S)
    return "".join(p if i % 2 else ADDRESS.sub(lambda m: f'<a href="{m[0]}">{m[0]}</a>', p) for i, p in enumerate(parts))


def epub(blocks: list[dict], title: str, lang: str = "en") -> bytes:
    """An EPUB with a part for each title of level 1 or 2, links between parts, notes at the end of the
    part that marks them first, and contents."""
    blocks, notes = noted(blocks)
    parts: list[list[dict]] = [[]]
    for b in blocks:
        if b["kind"] == "title" and (b.get("level") or 1) <= 2 and parts[-1]:
            parts.append([])
        parts[-1].append(b)
    names = [f"part{i:03d}.xhtml" for i in range(len(parts))]
    where = {b["id"]: n for n, part in zip(names, parts, strict=True) for b in part if b.get("id")}
    linked = {h[1:] for b in blocks for h in b.get("links") or [] if h[:1] == "#"}
    left, shown = dict(notes), []
    for k, part in enumerate(parts):
        said = "".join(b["text"] for b in part)
        mine = {i: left.pop(i) for i in list(left) if MARK.format(i) in said or k == len(parts) - 1}
        # a mark of a note that another part shows is its number
        for b in part:
            b["text"] = re.sub("\ue000([^\ue001]*)\ue001", lambda m, mine=mine: m[0] if m[1] in mine else f"<sup>{notes[m[1]][0]}</sup>", b["text"])
        shown.append(mine)
    heads = [(n, re.sub("<[^>]*>|\ue000[^\ue001]*\ue001", "", next((b["text"] for b in part if b["kind"] == "title"), title))) for n, part in zip(names, parts, strict=True)]
    raw = io.BytesIO()
    stamp = lambda name: zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(stamp("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr(stamp("META-INF/container.xml"), '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for name, part, mine in zip(names, parts, shown, strict=True):
            z.writestr(stamp(f"OEBPS/{name}"), html(part, title, {i: f for i, f in where.items() if f != name}, mine, linked))
        listed = "".join(f'<li><a href="{n}">{_html.escape(h or title)}</a></li>' for n, h in heads)
        z.writestr(stamp("OEBPS/nav.xhtml"), f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{_html.escape(title)}</title></head><body><nav epub:type="toc"><ol>{listed}</ol></nav></body></html>')
        items = "".join(f'<item id="{n[:-6]}" href="{n}" media-type="application/xhtml+xml"/>' for n in names) + '<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/>'
        spine = "".join(f'<itemref idref="{n[:-6]}"/>' for n in names)
        z.writestr(stamp("OEBPS/book.opf"), f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{_html.escape(title)}</dc:title><dc:language>{lang}</dc:language></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>')
    return raw.getvalue()


def cells(text: str) -> list[list[str]]:
    """The cells of a table's rows."""
    return [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", r)] for r in text.split("\n")]


def fb2(blocks: list[dict], title: str, lang: str = "en") -> str:
    """FB2: a section for each title, verse in poems, notes in a body of their own."""
    names = {"i": "emphasis", "b": "strong", "s": "strikethrough", "sub": "sub", "sup": "sup", "code": "code"}
    tags = {k: (f"<{v}>", f"</{v}>") for k, v in names.items()}
    link = lambda n, ls, begin: f'<a l:href="{_html.escape(_url(n, ls))}">' if begin else "</a>"
    span = lambda b: _spans(b["text"], tags, b.get("links") or [], link, _html.escape)
    blocks, known = noted(blocks)
    aims = {h[1:] for b in blocks for h in b.get("links") or [] if h[:1] == "#"}
    at = lambda b: f' id="{_html.escape(str(b["id"]))}"' if b.get("id") in aims else ""
    out, open_, poem = [], False, False
    notes = [f'<section id="{_html.escape(i)}"><title><p>{n}</p></title><p>{span(b)}</p></section>' for i, (n, b) in known.items()]
    for b in blocks:
        if poem and b["kind"] != "verse":
            out.append("</stanza></poem>")
            poem = False
        k = b["kind"]
        if k == "title":
            out.append(("</section>" if open_ else "") + f"<section><title><p>{span(b)}</p></title>")
            open_ = True
            continue
        if k == "note":
            notes.append(f'<section id="{b.get("note_id") or "n"}"><p>{span(b)}</p></section>')
            continue
        if not open_:
            out.append("<section>")
            open_ = True
        if k == "verse":
            out.append(("" if poem else "<poem><stanza>") + f"<v>{span(b)}</v>")
            poem = True
        elif k == "break":
            out.append("<empty-line/>")
        elif k == "code":
            out += [f"<p><code>{_html.escape(x)}</code></p>" for x in b["text"].split("\n")]
        elif k == "table":
            out.append("<table>" + "".join("<tr>" + "".join(f"<td>{_spans(c, tags, [], link, _html.escape)}</td>" for c in r) + "</tr>" for r in cells(b["text"])) + "</table>")
        else:
            out.append(f"<subtitle{at(b)}>{span(b)}</subtitle>" if k == "subtitle" else f"<p{at(b)}>{span(b)}</p>")
    out.append(("</stanza></poem>" if poem else "") + ("</section>" if open_ else "<section><empty-line/></section>"))
    tail = f'<body name="notes">{"".join(notes)}</body>' if notes else ""
    main = _marks("".join(out), known, lambda i, n, _: f'<a l:href="#{_html.escape(i)}" type="note">[{n}]</a>')
    made = f'<?xml version="1.0" encoding="utf-8"?>\n<FictionBook xmlns="http://www.gribuser.ru/xml/fictionbook/2.0" xmlns:l="http://www.w3.org/1999/xlink"><description><title-info><book-title>{_html.escape(title)}</book-title><lang>{lang}</lang></title-info></description><body>{main}</body>{tail}</FictionBook>'
    made = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", made)  # XML has no such characters
    ElementTree.fromstring(made.encode())  # what isn't well formed is no book
    return made


def fb2_zip(blocks: list[dict], title: str) -> bytes:
    """FB2 in an archive of its own."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(f"{title}.fb2", (2000, 1, 1, 0, 0, 0)), fb2(blocks, title))
    return raw.getvalue()


_TEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "%": r"\%", "_": r"\_", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def tex(blocks: list[dict], title: str) -> str:
    """LaTeX source; levels are chapters, sections and below."""
    escape = lambda t: "".join(_TEX.get(c, c) for c in t)
    tags = {"i": (r"\emph{", "}"), "b": (r"\textbf{", "}"), "s": (r"\sout{", "}"), "code": (r"\texttt{", "}"), "sub": (r"\textsubscript{", "}"), "sup": (r"\textsuperscript{", "}")}
    link = lambda n, ls, begin: rf"\href{{{_url(n, ls)}}}{{" if begin else "}"
    span = lambda b: _spans(b["text"], tags, b.get("links") or [], link, escape)
    level = {1: "chapter", 2: "section", 3: "subsection"}
    blocks, notes = noted(blocks)
    out = [r"\documentclass{book}", r"\usepackage{hyperref,ulem}", rf"\title{{{escape(title)}}}", r"\begin{document}"]
    for b in blocks:
        k = b["kind"]
        if k in ("title", "subtitle"):
            out.append(rf"\{level.get(b.get('level') or (1 if k == 'title' else 3), 'paragraph')}{{{span(b)}}}")
        elif k == "code":
            out.append("\\begin{verbatim}\n" + b["text"] + "\n\\end{verbatim}")
        elif k == "break":
            out.append(r"\bigskip")
        elif k == "table":
            rows = cells(b["text"])
            wide = max(map(len, rows))
            lines = (" & ".join(_spans(c, tags, [], link, escape) for c in [*r, *[""] * (wide - len(r))]) for r in rows)
            out.append("\\begin{tabular}{" + "l" * wide + "}\n" + " \\\\\n".join(lines) + "\n\\end{tabular}\n")
        else:
            out.append(span(b) + (r"\\" if k == "verse" else "\n"))
    return _marks("\n".join([*out, r"\end{document}", ""]), notes, lambda i, n, b: rf"\footnote{{{span(b)}}}")


WRITERS = {"md": lambda b, t: markdown(b).encode(), "html": lambda b, t: html(b, t).encode(), "epub": epub, "fb2": lambda b, t: fb2(b, t).encode(), "fb2.zip": fb2_zip, "tex": lambda b, t: tex(b, t).encode()}
WRITERS |= {"markdown": WRITERS["md"], "htm": WRITERS["html"]}


def render(blocks: DataFrame, by: str, kind: str) -> DataFrame:
    """(by, name, content): each book in one format."""
    writer = WRITERS[kind]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        rows = [{"id": r.id, "kind": r.kind, "text": r.text or "", "links": list(r.links) if r.links is not None else [], "level": int(r.level) if pd.notna(r.level) else None, "note_id": r.note_id} for r in pdf.itertuples()]
        key = pdf[by].iloc[0]
        return pd.DataFrame({by: [key], "name": [f"{key}.{kind}"], "content": [writer(rows, str(key))]})

    note = F.col("note_id") if "note_id" in blocks.columns else F.lit(None).cast("string").alias("note_id")
    stays = blocks.filter("not coalesce(drop, false)") if "drop" in blocks.columns else blocks
    return stays.select(by, "pos", "id", "kind", "text", "links", "level", note).groupBy(by).applyInPandas(run, f"{by} {dict(blocks.dtypes)[by]}, name string, content binary")
