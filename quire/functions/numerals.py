"""Numbers that a translation may honestly lose or gain: written in words, part of a compound,
converted to other units, put back into a power, or misread by a scanner.

A rule is a row of ``RULES``: what must stand right before and right after the number in one
text, and what the other text must hold.  ``holds`` is all there is to apply one."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as X

#: How numbers are written in words.
ENGLISH = {
    1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six", 7: "seven", 8: "eight", 9: "nine", 10: "ten",
    11: "eleven", 12: "twelve", 13: "thirteen", 14: "fourteen", 15: "fifteen", 16: "sixteen", 17: "seventeen", 18: "eighteen", 19: "nineteen",
    20: "twenty", 30: "thirty", 40: "forty", 50: "fifty", 60: "sixty", 70: "seventy", 80: "eighty", 90: "ninety", 100: "hundred", 1000: "thousand",
}


def _adjective(stem: str) -> list[str]:
    """The cases of an ordinal."""
    return [stem + e for e in ("ый", "ой", "ая", "ое", "ые", "ого", "ому", "ым", "ом", "ую", "ых", "ыми")]


def _noun(stem: str) -> list[str]:
    """The cases of a feminine noun of a figure."""
    return [stem + e for e in ("а", "и", "ы", "у", "е", "ой", "ам", "ами", "ах", "")]


def _russian() -> dict[int, list[str]]:
    """Cardinals by declension, with ordinals and nouns of the figures."""
    # nominative, genitive, dative, instrumental, prepositional of the units
    unit = {
        1: ("один одна одно одни", "одного одной одних", "одному одной одним", "одним одной одну одними", "одном"),
        2: ("два две", "двух", "двум", "двумя", "двух"), 3: ("три", "трёх", "трём", "тремя", "трёх"), 4: ("четыре", "четырёх", "четырём", "четырьмя", "четырёх"),
        5: "пят", 6: "шест", 7: "сем", 8: "восем", 9: "девят",
    }
    soft = lambda stem: (stem + "ь", stem + "и", stem + "и", stem + "ью", stem + "и")
    for n, cases in unit.items():
        if isinstance(cases, str):
            unit[n] = soft(cases) if n != 8 else ("восемь", "восьми", "восьми", "восемью восьмью", "восьми")
    out = {n: [w for c in cases for w in c.split()] for n, cases in unit.items()}
    ordinal = dict(zip(range(5, 10), ("пят", "шест", "седьм", "восьм", "девят"), strict=True))
    for n, stem in ordinal.items():
        out[n] += _adjective(stem)
    for n, stem in zip(range(1, 10), ("единиц", "двойк", "тройк", "четвёрк", "пятёрк", "шестёрк", "семёрк", "восьмёрк", "девятк"), strict=True):
        out[n] += _noun(stem)
    out[10] = [*soft("десят"), *_adjective("десят"), *_noun("десятк")]
    teens = dict(zip(range(11, 20), ("один", "две", "три", "четыр", "пят", "шест", "сем", "восем", "девят"), strict=True))
    for n, stem in (teens | {20: "два", 30: "три"}).items():
        whole = stem + ("надцат" if n < 20 else "дцат")
        out[n] = [*soft(whole), *_adjective(whole)]
    out[40] = ["сорок", "сорока", *_adjective("сороков")]
    out[90] = ["девяносто", "девяноста", *_adjective("девяност")]
    out[100] = ["сто", "ста", *_adjective("сот")]
    for n in range(5, 9):
        tens = [u + t for u, t in zip((c.split()[0] for c in unit[n]), ("десят", "десяти", "десяти", "десятью", "десяти"), strict=True)]
        out[10 * n] = [*tens, *_adjective(unit[n][1] + "десят")]
    for n in range(2, 10):
        first = {2: "двести", 3: "триста", 4: "четыреста"}.get(n, unit[n][0] + "сот")
        rest = [u.split()[0] + h for u, h in zip(unit[n][1:], ("сот", "стам", "стами", "стах"), strict=True)]
        out[100 * n] = [first, *rest, *_adjective(unit[n][1] + "сот")]
    out[1000] = ["тысяч", *("тысяч" + e for e in ("а", "и", "у", "е", "ей", "ью", "ам", "ами", "ах")), *_adjective("тысячн")]
    return out


def _either(forms: list[str]) -> str:
    """One of the forms as a whole word; ё may be printed as е."""
    return r"\b(?:" + "|".join(sorted({f.replace("ё", "[её]") for f in forms})) + r")\b"


NUMERALS = {"en": {n: rf"(?iu){w}(?<![A-Za-z0-9_]{w})(?![A-Za-z0-9_])" for n, w in ENGLISH.items()}, "ru": {n: "(?iU)" + _either(forms) for n, forms in _russian().items()}}

#: Words before a number that is a place in the book; units; what stands between.
PLACES = "part|chapter|book|volume|section|step|rule|principle"
IMPERIAL = r"(?:pounds?|lbs?|ounces?|oz|inch(?:es)?|feet|foot|ft|yards?|miles?|mph|mpg|psi|gallons?|pints?|quarts?|acres?|fahrenheit|°\s?F)\b"
METRIC = r"(?:кг|килограмм|г|грамм|см|сантиметр|мм|миллиметр|м|метр|км|километр|л|литр|мл|гектар|градус|°\s?C|цельси|kg|cm|mm|km|ml|[gml])\w*\b"
#: A unit, whatever its ending.
_UNIT = METRIC.removesuffix(r"\w*\b")
GAP = r"\s*(?:degrees?\s+|градусов?\s+|по\s+)?"

#: Token borders: no word or hyphen before; no word after; no figure before.
FREE, END, FIGURE = r"(?<![\p{L}\p{N}_-])", r"(?![\p{L}\p{N}_])", r"(?<!\d)"
LETTER = r"\p{L}"


@dataclass(frozen=True)
class Rule:
    """An excuse: the number stands between one of ``around`` (before, after) in its own text, or that
    text holds ``own``; and the other text holds ``other``."""

    around: tuple[tuple[str, str], ...] = ()
    own: str | None = None
    other: str | None = None


RULES = {
    # 88-page and 3D; not COVID-19 and not 5km
    "compound": Rule(((FREE, "-" + LETTER), (FREE, "[A-ZА-ЯЁ]" + END))),
    # part 3, ’90s, and any number of a text with the 1980s, as ’90s may stand for 1990
    "place": Rule(((rf"(?i)\b(?:{PLACES})\s+", r"\b"), ("[’']", r"0?s\b")), own=r"\b(?:19|20)\d0s\b"),
    # 165 pounds, and a metric unit in the translation
    "converted": Rule((("(?i)" + FIGURE, GAP + IMPERIAL),), other=rf"(?i)\d{GAP}{_UNIT}"),
    # 75 kg of a translation, and an imperial unit in the source
    "converted_back": Rule((("(?i)" + FIGURE, GAP + _UNIT),), other=rf"(?i)\d{GAP}{IMPERIAL}|[a-z]\s+{IMPERIAL}"),
    # a figure that a scanner set for a letter
    "scanned": Rule(((LETTER, ""), ("", LETTER))),
}


def holds(rule: Rule, own: Column, other: Column, n: Column) -> Column:
    """Whether a rule excuses the number ``n`` of the text ``own``."""
    plain = lambda p: "(?u)" + X.plain_borders(p)
    places = [F.rlike(own, F.concat(F.lit(plain(before)), n, F.lit(X.plain_borders(after)))) for before, after in rule.around]
    if rule.own is not None:
        places.append(own.rlike(plain(rule.own)))
    there = functools.reduce(operator.or_, places)
    return there if rule.other is None else there & other.rlike(plain(rule.other))


def parts(n: Column) -> Column:
    """The places of a number that have a word each: 45 is 40 and 5, 2000 is 2 and 1000; teens are one
    word.  Null for numbers that nobody writes in words: 0, from 10,000, and odd ones over 1,000."""
    v = n.try_cast("int")
    low = F.when(v >= 1000, F.expr("0") + F.floor(v / 1000)).otherwise(v)
    tail = low % 100
    ones = F.when((tail > 10) & (tail < 20), F.array(tail)).otherwise(F.array(tail - tail % 10, tail % 10))
    own = F.filter(F.concat(F.array(low - tail), ones).cast("array<int>"), lambda x: x > 0)
    whole = F.when(v < 1000, own).when(v == 1000, F.array(F.lit(1000))).when(v % 1000 == 0, F.concat(own, F.array(F.lit(1000))))
    return F.when((v > 0) & (v < 10000), whole)


def spelled_out(text: Column, n: Column, lang: str) -> Column:
    """Whether every place of ``n`` stands in ``text`` as a word of ``lang``; false for other languages."""
    table = NUMERALS.get((lang or "")[:2])
    if not table:
        return F.lit(False)
    p = parts(n)
    known = F.size(F.array_except(p, F.array(*[F.lit(k) for k in table]))) == 0
    said = [~F.array_contains(p, k) | text.rlike(x) for k, x in table.items()]
    return F.coalesce(functools.reduce(operator.and_, said, known), F.lit(False))


def compound(text: Column, n: Column) -> Column:
    """A number that leads a word."""
    return holds(RULES["compound"], text, text, n)


def place_or_decade(text: Column, n: Column) -> Column:
    """A number that other languages write in words: of a chapter or a decade."""
    return holds(RULES["place"], text, text, n)


def converted(source: Column, target: Column, n: Column, back: bool = False) -> Column:
    """A number before an imperial unit whose translation has a metric one; ``back`` asks for the other end."""
    return holds(RULES["converted_back"], target, source, n) if back else holds(RULES["converted"], source, target, n)


def power(target: Column, n: Column) -> Column:
    """``1031`` of a scan that came back as ``10<sup>31</sup>``."""
    digits = F.regexp_extract_all(X.strip_tags(target), F.lit(r"[0-9]+"), F.lit(0))
    return target.contains("<sup>") & F.array_contains(digits, n)


def scanned(source: Column, n: Column) -> Column:
    """A digit that a scanner set for a letter: stuck to one, or of at most two figures."""
    return (F.length(n) <= 2) | holds(RULES["scanned"], source, source, n)


def excuse_lost(source: Column, target: Column, n: Column, to: str, ocr: bool = False) -> Column:
    """Why a number of the source may be missing from the translation; null: it may not."""
    first = F.when(F.lit(ocr) & scanned(source, n), "scan")
    told = place_or_decade(source, n) | spelled_out(target, n, to)
    return first.when(compound(source, n), "compound").when(told, "words").when(converted(source, target, n), "units").when(power(target, n), "power")


def excuse_gained(source: Column, target: Column, n: Column, source_lang: str) -> Column:
    """Why only the translation has a number; null without a reason."""
    return F.when(compound(target, n), "compound").when(spelled_out(source, n, source_lang), "words").when(converted(source, target, n, back=True), "units")
