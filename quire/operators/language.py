"""Language and script detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.model import T, Thresholds

#: Frequent function words by language.
MARKERS = {
    "de": ("der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "auf", "den", "zu", "von", "im", "des"),
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "with", "as", "on", "by", "this"),
    "es": ("el", "los", "las", "y", "que", "en", "un", "una", "por", "con", "para", "del", "se", "no", "su"),
    "fr": ("le", "les", "et", "des", "une", "est", "dans", "que", "qui", "pour", "pas", "sur", "par", "au", "du"),
}
#: Further languages, beside those that the queries' SQL knows.
MORE = {
    "it": ("il", "la", "le", "e", "di", "che", "in", "un", "una", "per", "con", "non", "è", "sono"),
    "pl": ("i", "w", "nie", "na", "że", "to", "się", "jest", "do", "z", "za", "jak", "ale", "był"),
    "ru": ("и", "в", "не", "на", "что", "он", "она", "как", "это", "то", "же", "бы", "был", "была", "для", "его", "её", "их", "мы", "вы"),
    "uk": ("і", "та", "не", "на", "що", "він", "вона", "як", "це", "для", "його", "її", "їх", "ми", "ви", "був", "була"),
}
#: The languages of the queries: it and pl share words with those of their SQL, and would take texts from them.
QUERIED = (*MARKERS, "ru", "uk")
#: Characters of languages that are told by script, not by words.
HANGUL, KANA, HAN = "[가-힯]", "[぀-ヿ]", "[一-鿿]"
#: Scripts by their ranges.
SCRIPTS = {"cyrillic": r"Ѐ-ӿ", "greek": r"Ͱ-Ͽ", "han": r"一-鿿", "kana": r"぀-ヿ", "latin": r"A-Za-zÀ-ɏ"}


def tokens(text: Column) -> Column:
    """Lower-case words, split at what is no letter."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def by_script(t: Column) -> Column:
    """(code, share) of a text in Korean, Japanese or Chinese script, else null."""
    share = lambda chars: F.regexp_count(t, F.lit(chars)) / F.greatest(F.length(t), F.lit(1))
    found = lambda code, c: F.struct(F.lit(code).alias("code"), c.alias("share"))
    hangul, kana, han = share(HANGUL), share(KANA), share(HAN)
    return F.when(hangul > 0.15, found("ko", hangul)).when(kana > 0.04, found("ja", kana + han)).when(han > 0.15, found("zh", han))


def detect(df: DataFrame, text: str = "text", th: Thresholds = T, only: tuple = (*MARKERS, *MORE), sample: int | None = None) -> DataFrame:
    """Adds lang_found and share: the language of the script, or else that whose markers fill most of the text, null under the least share.

    With ``sample`` only so many characters from the beginning of a text are read.
    Ties go to the first language by name, of those in MARKERS before those in MORE; words tell those in ``only``."""
    languages = [(code, ws) for code, ws in [*sorted(MARKERS.items()), *sorted(MORE.items())] if code in only]
    read = F.col(text) if sample is None else F.substring(text, 1, sample)
    df = df.withColumn("_w", tokens(read))
    n = F.greatest(F.size("_w"), F.lit(1))
    count = lambda ws: F.size(F.filter("_w", lambda w: w.isin(*ws)))
    df = df.withColumn("_c", F.array(*[F.struct(count(ws).alias("c"), F.lit(-i).alias("i"), F.lit(code).alias("code")) for i, (code, ws) in enumerate(languages)]))
    best = F.array_max("_c")
    share = best["c"] / n
    df = df.withColumn("_s", by_script(read))
    code = F.coalesce(F.col("_s.code"), F.when(share >= th.min_share, best["code"]))
    return df.withColumn("lang_found", code).withColumn("share", F.coalesce(F.col("_s.share"), share)).drop("_w", "_c", "_s")


def script_counts(text: Column) -> Column:
    return F.array(*[F.struct(F.regexp_count(text, F.lit(f"[{r}]")).alias("c"), F.lit(name).alias("script")) for name, r in sorted(SCRIPTS.items())])


def dominant(df: DataFrame, by: str, text: Column, least: int = 200) -> DataFrame:
    """(by, dominant, letters): the script that most letters have, of ties the first by name; null under ``least`` letters."""
    one = df.select(by, F.explode(script_counts(text)).alias("s")).groupBy(by, F.col("s.script").alias("script")).agg(F.sum("s.c").cast("long").alias("c"))
    top = one.groupBy(by).agg(F.min(F.struct((-F.col("c")).alias("k"), "script", "c")).alias("m"))
    return top.select(by, F.when(F.col("m.c") >= least, F.col("m.script")).alias("dominant"), F.col("m.c").alias("letters"))
