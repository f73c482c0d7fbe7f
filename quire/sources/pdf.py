"""Books from the text layer of a PDF, as a layout tool prints it: pages between form feeds.

The tools themselves (text, images and links of a file) are called by the caller; here is what
their output says: paragraphs without running heads, images that are pictures, and whether a
scanner made the text."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.similarity import near
from quire.model import T, Thresholds
from quire.operators.reading import COLUMN_GAP
from quire.sources import books
from quire.sources.encoding import repair

#: Programs that make text layers by recognition.
OCR_MADE = r"(?i)omnipage|scansoft|abbyy|finereader|tesseract|ocrmypdf|readiris|cuneiform|acrobat capture|paperport|kofax|nuance|iris ?ocr"


def columned(page: str, th: Thresholds = T) -> bool | None:
    """Whether a page is set in columns; null for one with fewer than eight long lines."""
    long = [x for x in page.splitlines() if len(x.strip()) > 30]
    if len(long) < 8:
        return None
    gaps = sum(1 for x in long if re.search(COLUMN_GAP.replace(r"\p{L}", r"[^\W\d_]"), x))
    return gaps >= 3 and gaps >= th.col_lines * len(long)


def multicolumn(pages: list[str], th: Thresholds = T) -> bool:
    """Whether so many of a book's full pages are set in columns."""
    told = [c for c in (columned(p, th) for p in pages) if c is not None]
    return bool(told) and sum(told) >= th.col_pages * len(told)


def unspaced(line: str) -> str:
    """Letterspaced words joined: four single letters and more with one space between them."""
    out, held = [], []
    for word in [*line.split(" "), None]:
        if word is not None and len(word) == 1 and word.isalpha():
            held.append(word)
            continue
        out += ["".join(held)] if len(held) >= 4 else held
        held = []
        if word is not None:
            out.append(word)
    return " ".join(out)


def head_key(line: str, th: Thresholds = T) -> str | None:
    """The letters of a line in lower case; none if they are too few of its letters and figures."""
    body = [c for c in line if c.isalnum()]
    letters = [c for c in body if c.isalpha()]
    return "".join(letters).lower() if body and len(letters) >= th.head_letters * len(body) and letters else None


def _edges(page: list[str], th: Thresholds) -> list[int]:
    """The first and last two full lines of a page that may be heads; none on a page of contents but other lines."""
    full = [i for i, x in enumerate(page) if x.strip()]
    contents = [i for i in full if re.search(r"[.·‧․\s]{3,}\d{1,4}\s*$", page[i].rstrip()) and re.search(r"[^\W\d_]", page[i])]
    listed = set(contents) if len(contents) >= 5 else set()
    return [i for i in dict.fromkeys([*full[:2], *full[-2:]]) if len(page[i].strip()) <= th.head_max and i not in listed]


def heads(pages: list[list[str]], dirty: bool = False, th: Thresholds = T) -> set[str]:
    """Keys that stand at the edges of many pages, or of four that follow closely; in a recognised text
    a key that is seen twice takes in those that are nearly equal."""
    seen: dict[str, list[int]] = defaultdict(list)
    for n, page in enumerate(pages):
        for k in {head_key(page[i], th) for i in _edges(page, th)} - {None}:
            seen[k].append(n)
    family = {k: {k} for k in seen}
    if dirty:
        for k in sorted((k for k in seen if len(seen[k]) >= 2), key=lambda k: (-len(seen[k]), k)):
            for other in [o for o in seen if o != k and o in family and k in family and abs(len(o) - len(k)) <= max(4, len(k) // 4)]:
                if near(k, other, th.head_near):
                    family[k] |= family.pop(other)
    out = set()
    for members in family.values():
        at = sorted({n for m in members for n in seen[m]})
        gaps = sorted(b - a for a, b in zip(at[:-1], at[1:], strict=True))
        if len(at) >= max(4, 0.15 * len(pages)) or len(at) >= 4 and gaps[len(gaps) // 2] <= th.head_gap:
            out |= members
    return out


def stripped(text: str, dirty: bool = False, th: Thresholds = T) -> list[list[str]]:
    """The lines of each page without running heads and page numbers; printed heads that are glued into
    other lines are cut out, the longest first.  Books of under five pages keep all."""
    pages = [p.split("\n") for p in text.split("\f")]
    if len(pages) < 5:
        return pages
    known = heads(pages, dirty, th)
    printed: set[str] = set()
    out = []
    for page in pages:
        gone = set()
        for i in _edges(page, th):
            k = head_key(page[i], th)
            if books.PAGE_NUMBER.match(page[i]) or k is not None and (k in known or any(near(k, h, th.head_near) for h in known)):
                gone.add(i)
                printed.add(page[i].strip())
        out.append([x for i, x in enumerate(page) if i not in gone])
    cuts = sorted((h for h in printed if len(h) >= 6 and any(c.isalpha() for c in h)), key=lambda h: (-len(h), h))

    def unglued(line: str) -> str:
        for h in cuts:
            line = line.replace(h, "")
        return line

    return [[unglued(x) for x in page] for page in out]


def read(layout: str, plain: str | None = None, producer: str = "", th: Thresholds = T) -> list[dict]:
    """Blocks of a book from its text in layout, or from ``plain`` (in reading order) if it is set in columns.

    A book without text is an error: its pages are pictures."""
    text = repair(layout)
    if plain is not None and multicolumn(text.split("\f"), th):
        text = repair(plain)
    if not text.strip():
        raise ValueError("no text layer: the pages are pictures")
    pages = stripped("\n".join(unspaced(x) for x in text.split("\n")), made_by_ocr(producer), th)
    indented = [bool(re.match(r"[ \t]{2,}\S", x)) for p in pages for x in p if x.strip()]
    by_indent = sum(indented) > 0.15 * len(indented)
    found = []
    for n, page in enumerate(pages, 1):
        held: list[str] = []
        for line in [*page, ""]:
            if held and (not line.strip() or by_indent and re.match(r"[ \t]{2,}\S", line)):
                found += [{**b, "page": n} for b in books.plain(joined(held))]
                held = []
            if line.strip():
                held.append(line.strip())
    return found


def joined(lines: list[str]) -> str:
    """Lines of a paragraph as one, words that are broken over two lines put together."""
    out = lines[0]
    for line in lines[1:]:
        out = out[:-1] + line if re.search(r"\w-$", out) and line[:1].islower() else f"{out} {line}"
    return out


def made_by_ocr(producer: str) -> bool:
    return bool(re.search(OCR_MADE, producer or ""))


def ocr_made(producer: Column) -> Column:
    """Whether a scanner's program made a text layer, by the file's creator and producer."""
    return F.coalesce(producer.rlike(OCR_MADE), F.lit(False))


def probe(text: Column, sample: int = 3000) -> Column:
    """What a model is shown to tell recognised text: a sample from the middle third."""
    return F.substr(text, F.floor(F.length(text) / 3).cast("int") + 1, F.lit(sample))


def images(listing: DataFrame, by: list[str], text: str = "listing") -> DataFrame:
    """(by, page, num, width, height) of pictures from the table that the image tool prints: two lines of
    heads, then page, number, type, width and height; masks are no images."""
    line = F.explode(F.split(text, "\n")).alias("line")
    rows = listing.select(*by, line).select(*by, F.split(F.trim("line"), r"\s+").alias("c")).filter((F.size("c") >= 5) & F.col("c")[0].rlike("^[0-9]+$") & (F.col("c")[2] == "image"))
    return rows.select(*by, F.col("c")[0].cast("int").alias("page"), F.col("c")[1].cast("int").alias("num"), F.col("c")[3].cast("int").alias("width"), F.col("c")[4].cast("int").alias("height"))


def is_cover(images_: list[tuple[int, int]], page: tuple[int, int], words: int, th_area: float = 0.5, th_words: int = 30) -> bool:
    """Whether a first page is a cover: hardly any words, and a picture over half of it."""
    return words < th_words and any(w * h >= th_area * page[0] * page[1] for w, h in images_)
