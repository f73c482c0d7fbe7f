"""Lenient HTML to ordered blocks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
INLINE = {"i": "i", "em": "i", "b": "b", "strong": "b", "sup": "sup", "sub": "sub", "code": "code", "s": "s", "del": "s", "strike": "s"}
TITLES = {"h1": ("title", 1), "h2": ("title", 2), "h3": ("subtitle", 3), "h4": ("subtitle", 4), "h5": ("subtitle", 5), "h6": ("subtitle", 6)}
BLOCK = {"p", "div", "li", "ul", "ol", "pre", "blockquote", "section", "article", "aside", "body", "table", "tr", "td", "th", "dl", "dt", "dd", "figure", "header", "footer", "main", *TITLES}
#: Parts of a page that are notes.
NOTE_TYPES = {"footnote", "endnote", "note", "rearnote"}
SUB_CLASS = re.compile(r"subtitle|epigraph|source|dedication", re.I)
TITLE_CLASS = re.compile(r"chap|title|head", re.I)


def kind_of(tag: str, cls: str, styles: dict[str, str] | None = None) -> tuple[str, int | None]:
    """(kind, level) of a block; a style map ``tag|class`` decides first."""
    if styles and f"{tag}|{cls}" in styles:
        return styles[f"{tag}|{cls}"], None
    if tag in TITLES:
        return TITLES[tag]
    if tag == "pre":
        return "code", None
    if cls and SUB_CLASS.search(cls):
        return "subtitle", None
    if cls and TITLE_CLASS.search(cls):
        return "title", None
    return "p", None


class _Reader(HTMLParser):
    """Collects runs of inline content; a block's begin or end closes the run before it."""

    def __init__(self, styles=None):
        super().__init__(convert_charrefs=True)
        self.styles, self.blocks, self.meta, self.census = styles, [], {}, []
        self.silent, self.open, self.stack = 0, [], [("body", "")]
        self.text, self.links, self.anchors, self.in_title, self.pre = [], [], [], False, 0
        self.table, self.row, self.cell = None, None, None
        self.note = None  # (depth, id) of an open note

    # a run of inline content
    def _flush(self):
        raw = "".join(self.text) + "".join(f"</{t}>" for t in reversed(self.open) if not t.startswith("a"))
        tag, cls = self.stack[-1]
        if self.pre:
            body = raw.strip("\n")
        else:
            body = re.sub(r"<(\w+)></\1>", "", re.sub(r"\s+", " ", raw)).strip()
        if re.sub(r"<[^>]*>", "", body).strip():
            kind, level = kind_of(tag, cls, self.styles)
            if self.note:
                kind, level, body = "note", None, re.sub(r"^(?:\[\d+\]|\d+[.)]?)\s+", "", body)
            self.blocks.append({"kind": kind, "text": body, "links": self.links, "anchors": self.anchors, "level": level, "spans": None, "note_id": self.note[1] if self.note else None})
            self.census.append((tag, cls, re.sub(r"<[^>]*>", "", body)[:90]))
            self.links, self.anchors = [], []
        self.text = [f"<{t}>" for t in self.open if not t.startswith("a")]

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
            return
        if self.silent:
            return
        at = dict(attrs)
        if at.get("id"):
            self.anchors.append(at["id"])
        if tag == "title":
            self.in_title = True
        elif tag == "meta" and at.get("name") and at.get("content"):
            self.meta[at["name"].lower()] = at["content"]
        elif tag == "html" and at.get("lang"):
            self.meta["lang"] = at["lang"]
        elif tag == "table":
            self._flush()
            self.table = []
        elif tag == "tr" and self.table is not None:
            self._row()
            self.row = []
        elif tag in ("td", "th") and self.table is not None:
            self._cell()
            spans = [min(99, max(1, int(v))) if (v := at.get(k) or "1").isdigit() else 1 for k in ("colspan", "rowspan")]
            self.cell = [tag == "th", spans, []]
        elif self.cell is not None:
            if tag in ("br", "p", "li", "div"):
                self.cell[2].append(" ")
        elif tag == "br":
            self.text.append("\n" if self.pre else " ")
        elif tag == "hr":
            self._flush()
            self.blocks.append({"kind": "break", "text": "", "links": [], "anchors": [], "level": None, "spans": None})
        elif tag == "img":
            self._flush()
            self.blocks.append({"kind": "image", "text": at.get("alt") or "", "links": [at.get("src") or ""], "anchors": [], "level": None, "spans": None})
        elif tag == "a":
            href = (at.get("href") or "").partition("?")[0]
            if href:
                self.links.append(href)
                self.open.append(f"a{len(self.links)}")
                self.text.append(f"<a{len(self.links)}>")
        elif tag in INLINE and not self.pre:
            self.open.append(INLINE[tag])
            self.text.append(f"<{INLINE[tag]}>")
        elif tag in BLOCK:
            self._flush()
            # a paragraph or item ends where the next one begins
            if tag in ("p", *TITLES) or tag == "li":
                while len(self.stack) > 1 and self.stack[-1][0] in ("p", *TITLES) or tag == "li" and self.stack[-1][0] == "li":
                    self.stack.pop()
            self.pre += tag == "pre"
            self.stack.append((tag, at.get("class") or ""))
            kinds = {*(at.get("epub:type") or "").split(), *(x.removeprefix("doc-") for x in (at.get("role") or "").split())}
            if kinds & NOTE_TYPES and at.get("id"):
                self.note = (len(self.stack), at["id"])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif self.silent:
            return
        elif tag == "title":
            self.in_title = False
        elif tag == "table" and self.table is not None:
            self._row()
            self._table()
        elif tag == "tr" and self.table is not None:
            self._row()
        elif tag in ("td", "th"):
            self._cell()
        elif self.cell is not None:
            return
        elif tag == "a":
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].startswith("a"):
                    self.text.append(f"</{self.open.pop(i)}>")
                    break
        elif tag in INLINE:
            if INLINE[tag] in self.open:
                while (last := self.open.pop()) != INLINE[tag]:
                    self.text.append(f"</{last}>")
                self.text.append(f"</{last}>")
        elif tag in BLOCK and any(t == tag for t, _ in self.stack):
            self._flush()
            while self.stack.pop()[0] != tag:
                pass
            self.pre = max(0, self.pre - (tag == "pre"))
            self.stack = self.stack or [("body", "")]
            if self.note and len(self.stack) < self.note[0]:
                self.note = None

    def _cell(self):
        if self.cell is not None:
            head, spans, parts = self.cell
            body = re.sub(r"\s+", " ", "".join(parts)).strip().replace("|", "\\|")
            if self.row is not None:
                self.row.append((f"<b>{body}</b>" if head and body else body, spans))
            self.cell = None

    def _row(self):
        self._cell()
        if self.row:
            self.table.append(self.row)
        self.row = None

    def _table(self):
        if self.table:
            spans = [[s for _, s in r] for r in self.table]
            self.blocks.append({"kind": "table", "text": "\n".join(" | ".join(c for c, _ in r) for r in self.table), "links": [], "anchors": self.anchors, "level": None, "spans": spans if any(s != [1, 1] for r in spans for s in r) else None})
            self.anchors = []
        self.table = None

    def handle_data(self, data):
        if self.silent:
            return
        if self.in_title:
            self.meta["title"] = self.meta.get("title", "") + data
        elif self.cell is not None:
            self.cell[2].append(data)
        elif self.table is None:
            self.text.append(data)

    def finish(self):
        self.close()
        if self.table is not None:
            self._row()
            self._table()
        self._flush()
        return self


def read(html: str, styles: dict[str, str] | None = None) -> _Reader:
    """Blocks, meta and style census of a page; unclosed and crossing tags are allowed."""
    r = _Reader(styles)
    r.feed(html or "")
    return r.finish()


def numbered(blocks: list[dict]) -> list[dict]:
    """Positional ids: a section begins at each title."""
    section = n = 0
    out = []
    for pos, b in enumerate(blocks):
        if b["kind"] == "title" or not section:
            section, n = section + 1, 0
        n += 1
        out.append({"pos": pos, "id": f"s{section:02d}.{'i' if b['kind'] == 'image' else 'b'}{n:04d}", **b})
    return out
