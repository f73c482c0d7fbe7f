"""Books from files: plain text, Markdown, HTML, EPUB and FB2, by one binary scan."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.model import T, Thresholds
from quire.operators import reading as R
from quire.sources import html

SCHEMA = "book_id string, pos long, id string, kind string, text string, links array<string>, level int, note_id string, error string"
CHAPTER = re.compile(r"^\s*(?:chapter|part|book|kapitel|chapitre|cap[ií]tulo|глава|часть)\b.{0,60}$", re.I)
PAGE_NUMBER = re.compile(r"^\s*[-–—]?\s*\d{1,4}\s*[-–—]?\s*$")


def _block(kind, text, links=(), level=None, note_id=None):
    return {"kind": kind, "text": text, "links": list(links), "level": level, "note_id": note_id}


def is_title(line: str, blanks_before: int = 0) -> bool:
    """A chapter heading, a short line in capitals, or a line after four blank ones."""
    s = line.strip()
    if not s or len(s) >= 60:
        return False
    letters = [c for c in s if c.isalpha()]
    capitals = len(letters) >= 3 and s.upper() == s and not re.search(r"ISBN|\d{4}", s)
    return bool(CHAPTER.match(s)) or capitals or blanks_before >= 4


def plain(text: str) -> list[dict]:
    """Titles and paragraphs; page numbers go, and titles that repeat more than three times."""
    lines, blanks, found = text.split("\n"), 0, []
    for line in lines:
        if not line.strip():
            blanks += 1
            continue
        if not PAGE_NUMBER.match(line):
            found.append(_block("title" if is_title(line, blanks) else "p", line.strip()))
        blanks = 0
    times: dict[str, int] = {}
    for b in found:
        if b["kind"] == "title":
            times[b["text"]] = times.get(b["text"], 0) + 1
    return [b for b in found if b["kind"] != "title" or times[b["text"]] <= 3]


def inline(s: str) -> tuple[str, list[str]]:
    """Markdown spans as tags, code left alone; links as numbered labels."""
    links: list[str] = []

    def link(m):
        links.append(m[2])
        return f"<a{len(links)}>{m[1]}</a{len(links)}>"

    out = []
    s = re.sub(r"\\([\\`*_\[\]])", lambda m: chr(0xE100 + ord(m[1])), s)  # an escaped sign is none
    for i, part in enumerate(re.split(r"(`[^`]+`)", s)):
        if i % 2:
            out.append(f"<code>{part[1:-1]}</code>")
            continue
        part = re.sub(r"(?<!!)\[([^\]]+)\]\(([^)\s]+)\)", link, part)
        for mark, tag in ((r"\*\*", "b"), (r"~~", "s"), (r"\*", "i"), (r"(?<!\w)_", "i")):
            close = r"_(?!\w)" if "_" in mark else mark
            part = re.sub(rf"{mark}(?=\S)(.+?)(?<=\S){close}", rf"<{tag}>\1</{tag}>", part)
        out.append(part)
    return re.sub("[\ue100-\ue17f]", lambda m: chr(ord(m[0]) - 0xE100), "".join(out)), links


def markdown(text: str) -> list[dict]:
    """Headings, fences, rules, images, pipe tables and paragraphs."""
    out, para, lines, i = [], [], text.split("\n"), 0

    def flush():
        if para:
            body, links = inline(" ".join(x.strip() for x in para))
            out.append(_block("p", body, links))
            para.clear()

    while i < len(lines):
        line = lines[i]
        if m := re.match(r"\s*(```+|~~~+)", line):
            flush()
            j = next((k for k in range(i + 1, len(lines)) if lines[k].strip().startswith(m[1])), len(lines))
            out.append(_block("code", "\n".join(lines[i + 1 : j])))
            i = j
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", line):
            flush()
            out.append(_block("title" if len(m[1]) <= 2 else "subtitle", inline(m[2])[0], level=len(m[1])))
        elif re.match(r"\s*([-*_])(?:\s*\1){2,}\s*$", line):
            flush()
            out.append(_block("break", ""))
        elif m := re.match(r"\s*!\[([^\]]*)\]\(([^)\s]+)\)\s*$", line):
            flush()
            out.append(_block("image", m[1], [m[2]]))
        elif re.match(r"\s*\|.*\|\s*$", line):
            flush()
            rows = []
            while i < len(lines) and re.match(r"\s*\|.*\|\s*$", lines[i]):
                if not re.fullmatch(r"[\s|:-]+", lines[i]):
                    rows.append(" | ".join(c.strip() for c in re.split(r"(?<!\\)\|", lines[i].strip()[1:-1])))
                i += 1
            out.append(_block("table", "\n".join(rows)))
            continue
        elif line.strip():
            para.append(line)
        else:
            flush()
        i += 1
    flush()
    return out


def epub(raw: bytes) -> list[dict]:
    """The spine's pages in order; publisher's pages under 120 words are left out."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    local = lambda e: e.tag.rpartition("}")[2]
    root = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = next(e.get("full-path") for e in root.iter() if local(e) == "rootfile")
    base = opf.rpartition("/")[0]
    tree = ElementTree.fromstring(z.read(opf))
    items = {e.get("id"): e.get("href") for e in tree.iter() if local(e) == "item"}
    out = []
    for ref in (e.get("idref") for e in tree.iter() if local(e) == "itemref"):
        name = f"{base}/{items[ref]}".lstrip("/")
        found = html.read(z.read(name).decode("utf-8", "replace")).blocks
        words = " ".join(re.sub(r"<[^>]*>", " ", b["text"]) for b in found).split()
        if len(words) < 120 and re.match(r"(?i)begin reading|contents|table of contents|newsletter|sign up", " ".join(words)):
            continue
        out += [_block(b["kind"], b["text"], b["links"], b["level"], b.get("note_id")) for b in found]
    return out


def meta(path: str, raw: bytes) -> dict[str, str]:
    """What a file says of its book: title, author, lang, series and its number, publisher and year."""
    ext = path.lower().rpartition(".")[2]
    local = lambda e: e.tag.rpartition("}")[2]
    said = lambda e: " ".join("".join(e.itertext()).split()) if e is not None else ""
    if ext == "epub":
        z = zipfile.ZipFile(io.BytesIO(raw))
        opf = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        tree = ElementTree.fromstring(z.read(opf))
        names = {"title": "title", "creator": "author", "language": "lang", "publisher": "publisher", "date": "year"}
        out: dict[str, str] = {}
        for e in tree.iter():
            if local(e) in names and e.tag.startswith("{http://purl.org/dc/elements/1.1/}"):
                out.setdefault(names[local(e)], said(e))
            key = {"calibre:series": "series", "calibre:series_index": "series_no"}.get(e.get("name") or "") or {"belongs-to-collection": "series", "group-position": "series_no"}.get(e.get("property") or "")
            if local(e) == "meta" and key:
                out.setdefault(key, e.get("content") or said(e))
    elif ext == "fb2":
        head = next((e for e in ElementTree.fromstring(raw) if local(e) == "description"), None)
        of = lambda name: next((e for e in head.iter() if local(e) == name), None) if head is not None else None
        author, series = of("author"), of("sequence")
        out = {"title": said(of("book-title")), "lang": said(of("lang")), "publisher": said(of("publisher")), "year": said(of("year"))}
        if author is not None:
            out["author"] = " ".join(x for n in ("first-name", "middle-name", "last-name") for x in [said(next((e for e in author if local(e) == n), None))] if x)
        if series is not None:
            out |= {"series": series.get("name") or "", "series_no": series.get("number") or ""}
    elif ext in ("html", "htm", "xhtml"):
        from quire.sources.encoding import decode

        told = html.read(decode(raw)[0]).meta
        out = {"title": told.get("title", "").strip(), "lang": told.get("lang", ""), "author": told.get("author", "")}
    else:
        out = {}
    if out.get("year"):
        out["year"] = out["year"][:4]
    return {k: v for k, v in out.items() if v}


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """(book_id, meta) of all files under ``path``; an unreadable file has an empty map."""

    def run(frames):
        for frame in frames:
            rows = []
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows.append((p.rpartition("/")[2], meta(p, bytes(raw))))
                except (ValueError, KeyError, StopIteration, ElementTree.ParseError, zipfile.BadZipFile):
                    rows.append((p.rpartition("/")[2], {}))
            yield pd.DataFrame(rows, columns=["book_id", "meta"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "book_id string, meta map<string,string>")


def fb2(raw: bytes) -> list[dict]:
    """Sections, poems and the notes body."""
    out = []
    local = lambda e: e.tag.rpartition("}")[2]

    def text(e, links=None):
        body = e.text or ""
        for c in e:
            tag = {"emphasis": "i", "strong": "b", "strikethrough": "s", "code": "code", "sup": "sup", "sub": "sub"}.get(local(c))
            href = next((v for k, v in c.attrib.items() if k.endswith("href")), None) if local(c) == "a" else None
            if href is not None and links is not None:
                links.append(href)
                tag = f"a{len(links)}"
            body += f"<{tag}>{text(c, links)}</{tag}>" if tag else text(c, links)
            body += c.tail or ""
        return re.sub(r"\s+", " ", body)

    def walk(e, depth, note):
        for c in e:
            name = local(c)
            if name == "section":
                walk(c, depth + 1, c.get("id") if note is not None else None)
            elif name == "title":
                if note is None and len(c):
                    out.append(_block("title", " ".join(text(p).strip() for p in c).strip(), level=max(1, depth)))
            elif name in ("poem", "stanza", "cite", "epigraph"):
                walk(c, depth, note)
            elif name in ("p", "text-author", "subtitle", "v"):
                kind = "note" if note is not None else {"subtitle": "subtitle", "v": "verse"}.get(name, "p")
                links: list[str] = []
                if body := text(c, links).strip():
                    out.append(_block("code", body[6:-7], []) if kind == "p" and re.fullmatch(r"<code>[^<]*</code>", body) else _block(kind, body, links, note_id=note))
            elif name == "empty-line":
                out.append(_block("break", ""))
            elif name == "table" and note is None:
                rows = ([re.sub(r"\s+", " ", text(d)).strip().replace("|", "\\|") for d in r if local(d) in ("td", "th")] for r in c if local(r) == "tr")
                out.append(_block("table", "\n".join(" | ".join(r) for r in rows)))
            elif name == "image" and note is None:
                out.append(_block("image", c.get("alt") or "", [next((v for k, v in c.attrib.items() if k.endswith("href")), "")]))

    for body in (e for e in ElementTree.fromstring(raw) if local(e) == "body"):
        walk(body, 0, "" if body.get("name") == "notes" else None)
    return out


def parse(path: str, raw: bytes) -> list[dict]:
    """Blocks of a file by its extension; listings are left as they are by every later pass."""
    from quire.sources.encoding import decode

    ext = path.lower().rpartition(".")[2]
    if ext == "epub":
        return epub(raw)
    if ext == "fb2":
        return fb2(raw)
    if ext in ("html", "htm", "xhtml"):
        return [_block(b["kind"], b["text"], b["links"], b["level"], b.get("note_id")) for b in html.read(decode(raw)[0]).blocks]
    if ext in ("md", "markdown"):
        return markdown(decode(raw)[0])
    if ext == "txt":
        return plain(decode(raw)[0])
    raise ValueError(f"no reader for .{ext}")


def _rows(frames):
    for frame in frames:
        for path, raw in zip(frame["path"], frame["content"], strict=True):
            try:
                found, error = html.numbered(parse(path, bytes(raw))), None
            except (ValueError, KeyError, StopIteration, ElementTree.ParseError, zipfile.BadZipFile, UnicodeError) as why:
                found, error = [{"pos": 0, "id": None, **_block("error", "")}], f"{type(why).__name__}: {why}"
            rows = [{"book_id": path.rpartition("/")[2], "error": error, **{k: b[k] for k in ("pos", "id", "kind", "text", "links", "level", "note_id")}} for b in found]
            if rows:
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
                out["level"] = out["level"].astype("Int32")
                yield out


def finished(blocks: DataFrame, drop: tuple[str, ...] = (), th: Thresholds = T) -> DataFrame:
    """Blocks of books after the passes that every read ends with: adds asis and drop.

    Back matter stays as it is and an index goes; so do reference lists, runs of citations and
    listings; notes that no link leads to are paragraphs."""
    by = ["book_id"]
    good = blocks.filter("error is null")
    numbered = good.withColumn("section", F.count_if(F.col("kind") == "title").over(Window.partitionBy(*by).orderBy("pos")))
    back = R.back_matter(R.sections(good, by), by, drop, th)
    told = numbered.join(back, [*by, "section"], "left")
    refs = R.reference_marks(good, by, th).withColumn("_ref", F.lit(True))
    told = told.join(refs, [*by, "pos"], "left")
    inside = R.citation_runs(good, by, th).select(*by, "first_pos", "last_pos")
    cited = good.filter(F.col("kind").isin(*R.PROSE)).join(inside, by).filter("pos between first_pos and last_pos").filter((F.col("kind") != "note") | R.cites(F.col("text")))
    told = told.join(cited.select(*by, "pos").distinct().withColumn("_cite", F.lit(True)), [*by, "pos"], "left")
    # a section's title is translated even where the section isn't
    kept = F.coalesce("is_back", F.lit(False)) & (F.col("kind") != "title") | F.coalesce("_ref", F.lit(False)) | F.coalesce("_cite", F.lit(False)) | (F.col("kind") == "code")
    told = told.withColumn("asis", kept).withColumn("drop", F.coalesce("dropped", F.lit(False)))
    links = good.select(*by, F.explode("links").alias("href")).filter(F.col("href").startswith("#")).select(*by, F.substring("href", 2, 1 << 20).alias("target"))
    out = R.demote_notes(told, links.unionByName(_marks(good)), by)
    return out.select(*blocks.columns, "asis", "drop").unionByName(blocks.filter("error is not null").withColumn("asis", F.lit(False)).withColumn("drop", F.lit(False)))


def _marks(blocks: DataFrame) -> DataFrame:
    """The notes that marks ``[^n]`` in the text lead to."""
    return blocks.filter("kind <> 'note'").select("book_id", F.explode(F.regexp_extract_all("text", F.lit(r"\[\^([^\]\s]+)\]"), F.lit(1))).alias("target"))


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files under ``path``; a file that can't be read is one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(_rows, SCHEMA)
