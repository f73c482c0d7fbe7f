"""Which encoding a file is in."""

from __future__ import annotations

import codecs
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CANDIDATES = ("cp1251", "koi8-r", "cp866", "cp1252", "cp1250", "cp1253", "shift_jis", "gb18030")
BOMS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_SCRIPT = ((0x41, 0x24F, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x4FF, "cyrillic"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"))
_MARKERS = frozenset("the and of der die und le les des et el los que и в не на что с по это".split())


def _script(c: str) -> str | None:
    return next((name for a, b, name in _SCRIPT if a <= ord(c) <= b and c.isalpha()), None)


def score(text: str) -> float:
    """Higher for a reading whose words are of one script each, hold function words and no junk."""
    words = re.findall(r"\w+", text)[:4000]
    if not words:
        return 0.0
    whole = sum(len({_script(c) for c in w}) == 1 for w in words) / len(words)
    marks = sum(w.lower() in _MARKERS for w in words) / len(words)
    inner = sum(any(c.isupper() for c in w[1:]) and not w.isupper() for w in words) / len(words)
    junk = sum(ord(c) < 32 and c not in "\t\n\r\f" or 0x80 <= ord(c) < 0xA0 or c == "�" for c in text) / len(text)
    boxes = sum(0x2500 <= ord(c) < 0x25A0 for c in text) / len(text)
    return whole + 4 * marks - 2 * max(0.0, inner - 0.15) - 50 * junk - 10 * boxes


def decode(raw: bytes, forced: str | None = None) -> tuple[str, str]:
    """(text, encoding): forced, byte order mark, strict UTF-8, else the reading that scores best."""
    if forced:
        return raw.decode(forced, "replace"), forced
    for mark, name in BOMS:
        if raw.startswith(mark):
            return raw.decode(name, "replace"), name
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        pass
    readings = []
    for i, name in enumerate(CANDIDATES):
        try:
            text = raw.decode(name)
        except UnicodeDecodeError:
            continue
        readings.append((score(text[:200_000]), -i, text, name))
    if not readings:
        return raw.decode("latin-1"), "latin-1"
    _, _, text, name = max(readings)
    return text, name


#: Readings of bytes that were taken for Latin-1, the first of equal ones wins.
READINGS = ("cp1251", "cp866", "koi8-r")


def letters(name: str) -> tuple[str, str]:
    """The characters of the upper half of Latin-1, and what the same bytes are in ``name``."""
    told = [(chr(c), bytes([c]).decode(name, "replace")) for c in range(0x80, 0x100)]
    return "".join(a for a, _ in told), "".join(b for _, b in told)


def repaired(df: DataFrame, text: str, share: float = 0.25, part: float = 0.1) -> DataFrame:
    """``repair`` of a column, by functions of the JVM; ``share`` and ``part`` of a text must be Latin letters
    and come out Cyrillic, both 0 where every text that has such letters is known to be spoiled."""
    c = F.col(text)
    n = lambda x, chars: F.regexp_count(x, F.lit(chars))
    found = [F.translate(c, *letters(name)) for name in READINGS]
    counts = [n(x, "[\u0400-\u04FF]") for x in found]
    best = F.greatest(*counts)
    spoiled = (n(c, "[\u00C0-\u00FF]") >= share * F.length(c)) & (n(c, "[^\u0000-\u00FF]") == 0) & (best > (F.floor(F.length(c) / round(1 / part)) if part else 0))
    read = F.coalesce(*[F.when(k == best, x) for x, k in zip(found, counts, strict=True)])
    return df.withColumn(text, F.when(spoiled & (F.length(c) > 0), read).otherwise(c))


def repair(text: str) -> str:
    """Cyrillic that was read as Latin-1; the reading with the most Cyrillic wins."""
    if not text or sum(0xC0 <= ord(c) <= 0xFF for c in text) < 0.25 * len(text):
        return text
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    count = lambda t: sum(0x400 <= ord(c) <= 0x4FF for c in t)
    best = max((raw.decode(n, "replace") for n in READINGS), key=count)
    return best if count(best) > len(text) // 10 else text
