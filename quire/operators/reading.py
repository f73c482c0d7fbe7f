"""A book's apparatus: reference lists, citations, back matter, columns, notes, images and contexts.

Blocks are rows (book, pos, kind, text); ``by`` names the columns that tell books apart and pos
is dense from 0 on in reading order.  Every window is within one book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.model import T, Thresholds
from quire.operators.sequence import islands

PROSE = ("p", "note")
#: Heads of reference lists, of back matter and of an index; a year; an entry's number; a citation.
REFS_HEAD = (
    r"(?i)^\W*(?:bibliograph\w*|references?|works\s+cited|literature\s+cited|библиограф\w*|литература|список\s+литературы|источники"
    r"|bibliographie|literaturverzeichnis|quellen|bibliograf[ií]a|referencias|参考文献|参考書目|参考資料)"
)
BACK_HEAD = (
    r"(?i)^\W*(?:notes?|endnotes?|references?|bibliograph\w*|works\s+cited|index|illustration\s+credits?|sources?"
    r"|примечани\w*|указател\w*|библиограф\w*|(?:список\s+)?литератур\w*|(?:список\s+)?источник\w*"
    r"|anmerkungen|register|quellen|literaturverzeichnis|notas|índice|bibliografía|fuentes|索引|注釈|参考文献)"
)
INDEX_HEAD = r"(?i)^\W*(?:index|указател\w*|索引|indeks|stichwortverzeichnis|índice\s+onomástico|indice)"
#: What ends a head's word.
WORD_END = r"(?:$|[^\p{L}\p{N}_])"
YEAR = r"\b(?:1[6-9]\d\d|20\d\d)\b"
ENTRY = r"(?:^|[\s;(\[])(\d{1,3})[.)]\s+[A-ZА-ЯЁ]"
CITED = r"^.{0,100}?[:—]\s+[A-ZА-ЯЁ][^\n]{0,140}?,"
CITED_PAGE = r"\b\d+[:–—-]\d+|\bp{1,2}\.\s*\d+|\b\d{1,4}\.$"
#: A gap of three spaces and more with prose after it, two words at least.
COLUMN_GAP = r"\S[ \t]{3,}\p{L}\S*[ \t]+\p{L}"


def years(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(YEAR), F.lit(0)))


def entries(c: Column) -> Column:
    """Numbers of the entries of a reference list that stand in a text."""
    return F.transform(F.regexp_extract_all(c, F.lit(ENTRY), F.lit(1)), lambda x: x.cast("int"))


def reference_spans(blocks: DataFrame, by: list[str], th: Thresholds = T) -> DataFrame:
    """Reference lists: (by, span, first_pos, last_pos, hits).

    Entry numbers in reading order rise by 1 to ``refs_step`` and stand at most ``refs_hole`` blocks
    apart; runs of ``refs_run`` entries over more than one block count, those at most ``refs_hole``
    apart are one span, and a span has three different years.  Up to ``refs_tail`` blocks after it
    that begin in lower case belong to it."""
    w = Window.partitionBy(*by)
    body = blocks.filter(F.col("kind").isin(*PROSE)).select(*by, "pos", "text")
    hits = body.select(*by, "pos", F.posexplode(entries(F.col("text"))).alias("k", "n"))
    order = w.orderBy("pos", "k")
    rise = F.col("n") - F.lag("n").over(order)
    apart = (F.col("pos") - F.lag("pos").over(order) > th.refs_hole) | (rise < 1) | (rise > th.refs_step)
    runs = islands(hits, by, ["pos", "k"], apart, "run").groupBy(*by, "run").agg(F.min("pos").alias("a"), F.max("pos").alias("z"), F.count("*").alias("hits"))
    runs = runs.filter((F.col("hits") >= th.refs_run) & (F.col("z") > F.col("a")))
    far = F.col("a") - F.max("z").over(w.orderBy("a", "z").rowsBetween(Window.unboundedPreceding, -1)) > th.refs_hole
    spans = islands(runs, by, ["a", "z"], far, "span").groupBy(*by, "span").agg(F.min("a").alias("first_pos"), F.max("z").alias("z"), F.sum("hits").alias("hits"))
    dated = body.withColumn("year", F.explode(years(F.col("text"))))
    told = spans.join(dated, by).filter("pos between first_pos and z").groupBy(*by, "span").agg(F.countDistinct("year").alias("years")).filter("years >= 3")
    small = [F.coalesce(F.lead(F.col("text").rlike(r"^\s*\p{Ll}"), k).over(w.orderBy("pos")), F.lit(False)) for k in (1, 2)]
    tails = body.select(*by, F.col("pos").alias("z"), F.when(small[0] & small[1], F.lead("pos", 2).over(w.orderBy("pos"))).when(small[0], F.lead("pos", 1).over(w.orderBy("pos"))).otherwise(F.col("pos")).alias("last_pos"))
    return spans.join(told.drop("years"), [*by, "span"]).join(tails, [*by, "z"]).select(*by, "span", "first_pos", "last_pos", "hits")


def reference_marks(blocks: DataFrame, by: list[str], th: Thresholds = T) -> DataFrame:
    """(by, pos) of blocks that stay as they are: in spans, lists within one block, and heads of lists."""
    w = Window.partitionBy(*by).orderBy("pos")
    text = F.col("text")
    spans = reference_spans(blocks, by, th).select(*by, "first_pos", "last_pos")
    within = blocks.filter(F.col("kind").isin(*PROSE)).join(spans, by).filter("pos between first_pos and last_pos").select(*by, "pos").distinct().withColumn("inside", F.lit(True))
    marked = blocks.join(within, [*by, "pos"], "left").withColumn("marked", F.col("kind").isin(*PROSE) & (F.coalesce("inside", F.lit(False)) | ((F.size(years(text)) >= 3) & (F.size(entries(text)) >= 3))))
    head = F.col("kind").isin("title", "subtitle") & (F.length("text") < 80) & text.rlike(REFS_HEAD + WORD_END)
    after = F.coalesce(F.lead("marked", 1).over(w), F.lit(False)) | F.coalesce(F.lead("marked", 2).over(w), F.lit(False))
    return marked.withColumn("after", after).filter(F.col("marked") | (head & F.col("after"))).select(*by, "pos")


def cites(c: Column) -> Column:
    """Whether a note is a citation: a lemma, a colon, a name, a comma, and a year or a page."""
    plain = F.trim(F.regexp_replace(X.strip_tags(c), r"\s+", " "))
    return plain.rlike(CITED) & (plain.rlike(YEAR) | plain.rlike(CITED_PAGE))


def citation_runs(blocks: DataFrame, by: list[str], th: Thresholds = T) -> DataFrame:
    """Runs of citations: (by, span, first_pos, last_pos, hits, marked).

    Among the blocks of prose, citations at most ``note_gap`` places apart are a run; runs of
    ``note_run`` that are at most ``refs_hole`` places apart are one span.  Marked is everything in
    it but notes that are no citations."""
    w = Window.partitionBy(*by)
    body = blocks.filter(F.col("kind").isin(*PROSE)).select(*by, "pos", "kind", cites(F.col("text")).alias("cite")).withColumn("at", F.row_number().over(w.orderBy("pos")))
    hits = body.filter("cite")
    apart = F.col("at") - F.lag("at").over(w.orderBy("at")) > th.note_gap
    runs = islands(hits, by, ["at"], apart, "run").groupBy(*by, "run").agg(F.min("at").alias("a"), F.max("at").alias("z"), F.count("*").alias("hits")).filter(F.col("hits") >= th.note_run)
    far = F.col("a") - F.lag("z").over(w.orderBy("a")) > th.refs_hole
    spans = islands(runs, by, ["a"], far, "span").groupBy(*by, "span").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.sum("hits").alias("hits"))
    inside = spans.join(body, by).filter("at between a and z")
    return inside.groupBy(*by, "span").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.first("hits").alias("hits"), F.count_if(F.col("cite") | (F.col("kind") != "note")).alias("marked"))


def sections(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Sections begin at titles: (by, section, first_pos, title, words, n_p, with_digit, mean_len)."""
    w = Window.partitionBy(*by).orderBy("pos")
    numbered = blocks.withColumn("section", F.count_if(F.col("kind") == "title").over(w))
    prose = F.col("kind").isin(*PROSE)
    return numbered.groupBy(*by, "section").agg(
        F.min("pos").alias("first_pos"),
        F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"),
        F.sum(X.words(F.col("text"))).alias("words"),
        F.count_if(prose).alias("n_p"),
        F.count_if(prose & F.col("text").rlike(r"\d")).alias("with_digit"),
        F.avg(F.when(prose, F.length("text"))).alias("mean_len"),
    )


def back_matter(parts: DataFrame, by: list[str], drop: tuple[str, ...] = (), th: Thresholds = T) -> DataFrame:
    """(by, section, is_back, dropped) of sections.

    A section is back matter if it begins after the tail share of all words, is named so, is on the
    ``drop`` list or follows one that is, and, if it has blocks, looks like references.  An index and
    what is on the list go altogether."""
    w = Window.partitionBy(*by).orderBy("section")
    total, before = F.sum("words").over(Window.partitionBy(*by)), F.sum("words").over(w) - F.col("words")
    like = (F.col("n_p") >= th.back_min) & (F.col("with_digit") >= th.back_digits * F.col("n_p")) & (F.col("mean_len") < th.back_len)
    title = F.coalesce("title", F.lit(""))
    listed = F.lower(title).isin(*[x.lower() for x in drop]) if drop else F.lit(False)
    told = parts.withColumn("fit", (before >= th.back_tail * total) & ((F.col("n_p") == 0) | like)).withColumn("named", title.rlike(BACK_HEAD + WORD_END) | listed).withColumn("gone", title.rlike(INDEX_HEAD + WORD_END) | listed)
    # among neighbours that fit, all from the first named one on
    runs = islands(told, by, ["section"], ~(F.col("fit") & F.lag("fit").over(w)), "run")
    since = Window.partitionBy(*by, "run").orderBy("section")
    back = F.col("fit") & (F.max(F.col("named").cast("int")).over(since) == 1)
    return runs.withColumn("is_back", back).select(*by, "section", "is_back", (F.col("is_back") & F.col("gone")).alias("dropped"))


def columned_pages(lines: DataFrame, by: list[str], page: str, th: Thresholds = T) -> DataFrame:
    """(by, page, columned) of pages with eight long lines from rows (by, page, text): a page is set in
    columns if three of its long lines and a tenth of them have a gap with prose after it."""
    long = lines.filter(F.length(F.trim("text")) > 30)
    found = long.groupBy(*by, page).agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(COLUMN_GAP)).alias("gaps")).filter("n >= 8")
    return found.select(*by, page, ((F.col("gaps") >= 3) & (F.col("gaps") >= th.col_lines * F.col("n"))).alias("columned"))


def multicolumn(lines: DataFrame, by: list[str], page: str, th: Thresholds = T) -> DataFrame:
    """(by, pages, columned, multicolumn): books of which so many full pages are set in columns."""
    n = columned_pages(lines, by, page, th).groupBy(*by).agg(F.count("*").alias("pages"), F.count_if("columned").alias("columned"))
    return n.withColumn("multicolumn", F.col("columned") >= th.col_pages * F.col("pages"))


def demote_notes(blocks: DataFrame, links: DataFrame, by: list[str]) -> DataFrame:
    """Blocks (by, pos, kind, note_id) with notes that no link (by, target) leads to as paragraphs."""
    aims = links.select(*by, F.col("target").alias("note_id")).distinct().withColumn("_linked", F.lit(True))
    told = blocks.join(aims, [*by, "note_id"], "left")
    orphan = (F.col("kind") == "note") & F.col("_linked").isNull()
    return told.withColumn("note_id", F.when(~orphan, F.col("note_id"))).withColumn("kind", F.when(orphan, "p").otherwise(F.col("kind"))).drop("_linked")


def number_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """sNN.bNNNN ids: a section begins at a title, blocks are numbered within it."""
    w = Window.partitionBy(*by).orderBy("pos")
    told = blocks.withColumn("_s", F.greatest(F.count_if(F.col("kind") == "title").over(w), F.lit(1)))
    place = F.row_number().over(Window.partitionBy(*by, "_s").orderBy("pos"))
    return told.withColumn("id", F.format_string("s%02d.b%04d", "_s", place)).drop("_s")


def number_notes(notes: DataFrame, by: list[str]) -> DataFrame:
    """Notes (by, pos, place, note_id) of the book and of its translator, numbered together in reading
    order: their number, and the number by note_id for the marks in the text."""
    w = Window.partitionBy(*by).orderBy("pos", "place", "note_id")
    return notes.withColumn("number", F.row_number().over(w))


def link_targets(links: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, id) of the blocks that links (by, target) lead to."""
    aims = links.filter(F.col("target").startswith("#")).select(*by, F.substring("target", 2, 1 << 20).alias("id")).distinct()
    return blocks.select(*by, "id").join(aims, [*by, "id"], "left_semi")


def stem(word: Column) -> Column:
    """A word without what declension changes: two letters of six and more, one of four and more."""
    n = F.length(word)
    return F.when(n >= 6, F.left(word, n - 2)).when(n >= 4, F.left(word, n - 1)).otherwise(word)


def anchored(text: Column, terms: Column, mark: Column) -> Column:
    """The text with ``mark`` after the first of the terms that it has, whatever their endings, and after
    the tags that close there; the text as it is if it has none."""
    quoted = lambda w: F.concat(F.lit("\\Q"), stem(w), F.lit("\\E[\\p{L}\\p{N}_]{0,4}"))
    pattern = lambda t: F.concat(F.lit("(?iu)"), F.array_join(F.transform(F.split(F.trim(X.strip_tags(t)), r"\s+"), quoted), "\\s+"), F.lit("(?![^<>]*>)(?:</[^>]+>)*"))
    found = F.filter(terms, lambda t: (F.trim(X.strip_tags(t)) != "") & F.rlike(text, pattern(t)))
    first = F.try_element_at(found, F.lit(1))
    hit = F.regexp_substr(text, pattern(first))
    end = F.instr(text, hit) + F.length(hit)
    return F.when(first.isNull(), text).otherwise(F.concat(F.left(text, end - 1), mark, F.substr(text, end)))


def lead_term(term: Column, text: Column) -> Column:
    """A note that begins with its term: the term is put before a text that doesn't have it at its begin."""
    bare = F.btrim(X.strip_tags(F.coalesce(term, F.lit(""))), F.lit(" \"«»“”"))
    first = stem(F.split(bare, r"\s+")[0])
    has = F.instr(F.lower(F.left(text, F.length(bare) + 32)), F.lower(first)) > 0
    return F.when((bare == "") | (F.length(bare) > 60) | has, text).otherwise(F.concat(bare, F.lit(" — "), text))


def merge_notes(notes: DataFrame, by: list[str]) -> DataFrame:
    """(by, block, text, terms, source) from notes (by, pass, file, place, block, term, kind, text).

    Of the notes on a term, in whatever case, the first counts: by pass, file and place.  Those of a
    block are joined in that order, each beginning with its term; source if one names an edition."""
    order = ["pass", "file", "place"]
    once = notes.groupBy(*by, F.lower("term").alias("_t")).agg(F.min(F.struct(*order, "block", "term", "kind", "text")).alias("n")).select(*by, "n.*")
    told = F.array_sort(F.collect_list(F.struct(*order, "term", lead_term(F.col("term"), F.col("text")).alias("said"))))
    whole = once.groupBy(*by, "block").agg(told.alias("t"), F.max(F.col("kind") == "source").alias("source"))
    return whole.select(*by, "block", F.array_join(F.transform("t", lambda x: x["said"]), " ").alias("text"), F.transform("t", lambda x: x["term"]).alias("terms"), "source")


#: Fixed value: a quoted title.
WORK = r"«([^»]{3,80})»|\*([^*]{3,80})\*"


def citation_groups(notes: DataFrame, by: list[str]) -> DataFrame:
    """Notes (by, pos, term, text) by the work that they name in quotes: (by, work, n, first_pos).

    Titles count as one in whatever case and have the spelling that is seen first; a note without a
    title is a group under its term."""
    text = F.col("text")
    named = F.concat(F.regexp_extract(text, WORK, 1), F.regexp_extract(text, WORK, 2))
    once = notes.groupBy(*by, "text").agg(F.min(F.struct("pos", "term")).alias("m")).select(*by, "text", "m.*")
    told = once.withColumn("title", F.btrim(named, F.lit(" .,;:")))
    key = F.when(F.col("title") != "", F.lower("title")).otherwise(F.concat(F.lit("\0"), F.col("pos").cast("string")))
    told = told.withColumn("work", F.when(F.col("title") != "", F.col("title")).otherwise(F.col("term")))
    return told.groupBy(*by, key.alias("_k")).agg(F.min_by("work", "pos").alias("work"), F.count("*").alias("n"), F.min("pos").alias("first_pos")).drop("_k")


def place_images(images: DataFrame, blocks: DataFrame, by: list[str], th: Thresholds = T) -> DataFrame:
    """(by, page, k, pos, before) for images (by, page, k) of blocks (by, pos, page, text).

    An image stands before the first block of its page if the page has little text, else after its
    last one; without blocks on it, after those of the nearest page before; in front of all if there
    is none (pos null).  Pages and images meet in one sorted stream by book."""
    pages = blocks.groupBy(*by, "page").agg(F.min("pos").alias("a"), F.max("pos").alias("z"), F.sum(F.length("text")).alias("chars"))
    both = pages.withColumn("k", F.lit(-1).cast("long")).unionByName(images.select(*by, "page", F.col("k").cast("long").alias("k")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("page", "k").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("k") == -1, F.struct(F.col("page").alias("at"), "a", "z", "chars")), ignorenulls=True).over(w)
    put = both.withColumn("m", last).filter("k >= 0")
    before = (F.col("m.at") == F.col("page")) & (F.col("m.chars") <= th.caption_max)
    return put.select(*by, "page", "k", F.when(before, F.col("m.a")).otherwise(F.col("m.z")).alias("pos"), F.coalesce(before, F.lit(True)).alias("before"))


def place_by_share(images: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, pos) for images (by, k, share): after the first block up to which that share of the text stands."""
    w = Window.partitionBy(*by)
    grown = blocks.select(*by, "pos", (F.sum(F.length("text")).over(w.orderBy("pos")) / F.sum(F.length("text")).over(w)).alias("upto"))
    return images.join(grown, by).filter("upto >= share").groupBy(*by, "k").agg(F.min("pos").alias("pos"))


def contexts(blocks: DataFrame, by: list[str], th: Thresholds = T, heads: int = 4) -> DataFrame:
    """(by, chunk, tail, ahead) from (by, chunk, pos, text, tr): what a request carries of its neighbours,
    the last ``tail_paras`` translations of the chunk before it and, of the first four blocks of the
    next chunk, ``lookahead_words`` words."""
    first, last = Window.partitionBy(*by, "chunk").orderBy("pos"), Window.partitionBy(*by, "chunk").orderBy(F.desc("pos"))
    # a chunk's few outer blocks are all that is gathered
    edge = blocks.withColumn("_a", F.row_number().over(first)).withColumn("_z", F.row_number().over(last)).filter((F.col("_a") <= heads) | (F.col("_z") <= th.tail_paras))
    joined = lambda part, text, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part, F.struct("pos", F.col(text).alias("t"))))), lambda x: x["t"]), sep)
    one = edge.groupBy(*by, "chunk").agg(joined(F.col("_z") <= th.tail_paras, "tr", "\n").alias("_tail"), joined(F.col("_a") <= heads, "text", " ").alias("_head"))
    w = Window.partitionBy(*by).orderBy("chunk")
    ahead = F.array_join(F.slice(F.filter(F.split(F.lead("_head").over(w), r"\s+"), lambda x: x != ""), 1, th.lookahead_words), " ")
    return one.select(*by, "chunk", F.coalesce(F.lag("_tail").over(w), F.lit("")).alias("tail"), F.coalesce(ahead, F.lit("")).alias("ahead"))


def stopped(blocks: DataFrame, edits: DataFrame, by: list[str], least: int = 20, share: float = 0.4) -> DataFrame:
    """(by, n, last) of chunks of ``least`` blocks (by, pos) whose last edit (by, pos) stands in the first ``share`` of them."""
    w = Window.partitionBy(*by).orderBy("pos")
    told = blocks.select(*by, "pos").withColumn("at", F.row_number().over(w)).join(edits.select(*by, "pos").distinct().withColumn("_e", F.lit(True)), [*by, "pos"], "left")
    n = told.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.when(F.col("_e"), F.col("at"))).alias("last"))
    return n.filter((F.col("n") >= least) & (F.col("last") <= share * F.col("n")))


def split_mode(lines: DataFrame, by: list[str], indent: float = 0.3, blank: float = 0.15) -> DataFrame:
    """(by, mode): paragraphs are told apart by an indent, by blank lines, or each line is one."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    full = F.trim("text") != ""
    m = lines.groupBy(*by).agg(share(full & F.col("text").rlike(r"^[ \t]{2,}\S")).alias("indent"), share(~full).alias("blank"))
    return m.select(*by, F.when(F.col("indent") > indent, "indent").when(F.col("blank") > blank, "blank").otherwise("line").alias("mode"))


def paragraphs(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by, para, first_line, text) of lines (by, line, text), split by the mode of their book."""
    w = Window.partitionBy(*by).orderBy("line")
    told = lines.join(split_mode(lines, by), by).withColumn("_full", F.trim("text") != "")
    begins = F.when(F.col("mode") == "indent", F.col("text").rlike(r"^[ \t]{2,}\S")).when(F.col("mode") == "blank", ~F.lag("_full").over(w)).otherwise(F.lit(True))
    numbered = islands(told, by, ["line"], begins, "para").filter("_full")
    whole = F.array_sort(F.collect_list(F.struct("line", F.trim("text").alias("t"))))
    return numbered.groupBy(*by, "para").agg(whole.alias("w")).select(*by, "para", F.col("w")[0]["line"].alias("first_line"), F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("text"))


def book_counts(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a book's blocks (kind, text, links, asis): paragraphs, words, headings, notes, links, images, and those that stay."""
    n = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    return blocks.groupBy(*by).agg(
        n("p", "verse", "table").alias("paragraphs"),
        F.sum(X.words(F.coalesce("text", F.lit("")))).alias("words"),
        n("title", "subtitle").alias("headings"),
        n("note").alias("notes"),
        F.sum(F.greatest(F.coalesce(F.size("links"), F.lit(0)), F.lit(0))).cast("long").alias("n_links"),
        n("image").alias("images"),
        F.count_if(F.coalesce("asis", F.lit(False))).alias("as_is"),
    )


#: Marks that sites leave in the books they pass on.
WATERMARKS = (
    r"oceanofpdf", r"libgen", r"lib\.rus\.ec", r"z-?lib(rary)?\b", r"anna'?s[- ]archive", r"annas-archive", r"bookfrom\.net", r"dokumen\.pub",
    r"epubbooks", r"planetebook", r"ebook-?hunter", r"vdoc\.pub", r"pdfdrive", r"flibusta", r"royallib", r"litres\.ru/pages/biblio",
    r"downloaded (from|by)\b", r"scanned (by|and proofed)", r"this (e-?)?book was (distributed|downloaded)", r"visit .{0,30} for more (books|free)",
    r"\bfree\s+e?books?\s+(at|from)\b",
)


def watermarks(lines: list[str] | None = None) -> str:
    """The pattern of marks, with a user's own lines added; blank lines and comments don't count."""
    own = [x.strip() for x in lines or () if x.strip() and not x.strip().startswith("#")]
    return "(?i)" + "|".join([*WATERMARKS, *own])


def drop_watermarks(blocks: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """The blocks without those that carry a mark, and how many each book lost (by the column ``book``)."""
    hit = F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    return blocks.filter(~hit), blocks.groupBy("book").agg(F.count_if(hit).alias("dropped"), F.count_if(~hit).alias("kept"))


def untranslated(pairs: DataFrame, source: str, target: str, scripts: dict[str, str], least: int = 3) -> DataFrame:
    """Pairs whose translation has so many runs of four letters of the source's script; none if both are written alike."""
    if source == target:
        return pairs.limit(0).withColumn("runs", F.lit(0).cast("long"))
    runs = F.regexp_count(X.strip_tags(F.col("tr")), F.lit(f"[{scripts[source]}]{{4,}}")).cast("long")
    return pairs.withColumn("runs", runs).filter(F.col("runs") >= least)


def natural_key(c: Column) -> Column:
    """The order of ids like s10.b0002: by section and place; others come last."""
    told = c.rlike(r"^s\d+\.[a-z]*\d+")
    return F.when(told, F.struct(F.regexp_extract(c, r"^s(\d+)", 1).cast("int").alias("section"), F.regexp_extract(c, r"\.[a-z]*(\d+)", 1).cast("int").alias("place"))).otherwise(F.struct(F.lit(9999).alias("section"), F.lit(0).alias("place")))


def merged_map(old: Column, new: Column) -> Column:
    """Both maps; of a key in both the new value."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def translatable(blocks: DataFrame) -> DataFrame:
    """Blocks of prose, verse, notes and tables that don't stay as they are."""
    return blocks.filter(F.col("kind").isin("p", "verse", "note", "table") & ~F.coalesce("asis", F.lit(False)))


def backfilled(blocks: DataFrame, translations: DataFrame, key: list[str], partial: bool = False) -> DataFrame:
    """Blocks (key, kind, text, asis, drop) with their translation (key, tr) as text, without what is dropped.

    What stays as it is, breaks and images have the source's text where they have none; so has
    everything with ``partial``, else it is missing."""
    told = blocks.filter(~F.coalesce("drop", F.lit(False))).join(translations.select(*key, "tr"), key, "left")
    stays = F.coalesce("asis", F.lit(False)) | F.col("kind").isin("break", "image", "code")
    text = F.when(stays | F.lit(partial), F.coalesce("tr", "text")).otherwise(F.col("tr"))
    return told.withColumn("missing", F.col("tr").isNull() & ~stays).withColumn("text", text).drop("tr")


def better_answer(source: Column, first: Column, second: Column, th: Thresholds = T) -> Column:
    """Of lengths: whether a first answer is far too short or long, and a second one is nearer to its source."""
    ratio = lambda c: c / F.greatest(source, F.lit(1))
    far = (source >= th.loss_min) & ~ratio(first).between(th.loss_low, th.loss_high)
    return far & (F.abs(ratio(second) - 1) < F.abs(ratio(first) - 1))
