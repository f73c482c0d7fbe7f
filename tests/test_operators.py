"""Operators on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quire.functions import similarity
from quire.functions import text as X
from quire.operators import joins, language, reading, sequence
from quire.plans import answers, packing, passes
from quire.sinks import writers
from quire.sources import books, encoding, html


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "n"), [("a <b>b</b> c", 3), ("<13 µmol", 2), ("", 0), ("<i></i>", 0), ("eins\tzwei", 2)])
def test_words(spark, text, n):
    assert one(spark, X.words, text) == n


@pytest.mark.parametrize(("text", "found"), [("1,234 and 5", ["1234", "5"]), ("1 234 567", ["1234567"]), ("0,4.<sup>116</sup>", ["0", "4", "116"]), ("12,34", ["12", "34"])])
def test_numbers(spark, text, found):
    assert one(spark, X.numbers, text) == found


def test_fingerprint_ignores_tags_and_spacing(spark):
    assert one(spark, X.fingerprint, "a  <b>b</b>\n") == one(spark, X.fingerprint, "a b")


@pytest.mark.parametrize(("text", "seconds"), [("limit; resets in 1h 2m", 3720), ("resets in 45s", 45), ("no", None)])
def test_reset_after(spark, text, seconds):
    assert one(spark, X.reset_after, text) == seconds


def test_chunk_numbers(spark):
    assert one(spark, X.chunk_numbers, "5, 6, 41-43") == [5, 6, 41, 42, 43]


def test_out_name(spark):
    f = lambda c: X.out_name(c, F.lit("A: title"), F.lit("x"))
    assert one(spark, f, "Ann Lee") == "Lee Ann. A- title"


def test_unscaffold(spark):
    assert one(spark, X.unscaffold, "text\n```\n</x>\n") == "text"


def test_glue(spark):
    df = spark.createDataFrame([(1, 0, "the com-"), (1, 1, "pass was,"), (1, 2, "lost"), (1, 3, "End.")], "d int, line int, text string")
    assert [r.text for r in sequence.glue(df, ["d"]).orderBy("para").collect()] == ["the compass was, lost", "End."]


def test_ranges(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 7, 7)], "k string, n int")
    assert sequence.ranges(df, ["k"], "n").first().ranges == "1–3, 7"


def test_reference_spans(spark):
    entry = lambda n, y: f"{n}. Smith ({y})"
    rows = [(1, i, "p", entry(i + 1, 1990 + i)) for i in range(6)] + [(1, 6, "p", "and others"), (1, 7, "p", "so on"), (1, 8, "p", "more")]
    # a run after a hole of forty blocks is of the same span; four entries are no run; one year is no list
    rows += [(1, i, "p", "Prose") for i in range(9, 40)] + [(1, 40 + i, "p", entry(50 + i, 1999)) for i in range(5)]
    rows += [(2, i, "p", entry(i + 1, 1990 + i)) for i in range(4)] + [(3, i, "p", entry(i + 1, 1990)) for i in range(9)] + [(4, 0, "p", " ".join(entry(i, 1990 + i) for i in range(1, 9)))]
    rows += [(4, -2, "title", "References"), (4, -1, "title", "What else"), (5, 0, "title", "References"), (5, 1, "p", "Prose")]
    b = spark.createDataFrame(rows, "book int, pos int, kind string, text string")
    got = [tuple(r) for r in reading.reference_spans(b, ["book"]).collect()]
    assert got == [(1, 1, 0, 44, 11)]
    only = reading.reference_spans(b.filter("pos < 40"), ["book"]).collect()
    assert [(r.first_pos, r.last_pos) for r in only] == [(0, 7)]
    marked = reading.reference_marks(b, ["book"]).collect()
    assert {r.pos for r in marked if r.book == 4} == {-2, 0} and not [r for r in marked if r.book in (2, 3, 5)]


def test_citation_runs_break_at_gaps_over_three(spark):
    cite = "Smith: Jones, 1990"
    near = [(1, p, "note", cite) for p in (0, 3, 6, 9, 12)]
    far = [(2, p, "p", cite) for p in (0, 20, 40, 60, 80)]
    fill = [(k, p, "p" if p % 2 else "note", "Prose") for k, ps in ((1, (0, 3, 6, 9, 12)), (2, (0, 20, 40, 60, 80))) for p in range(81) if p not in ps]
    got = reading.citation_runs(spark.createDataFrame(near + far + fill, "book int, pos int, kind string, text string"), ["book"]).collect()
    assert [(r.book, r.first_pos, r.last_pos, r.hits) for r in got] == [(1, 0, 12, 5)]
    # all inside is marked but notes that are no citations: 2, 4, 8 and 10
    assert got[0].marked == 9


def test_back_matter_goes_on_from_a_named_section(spark):
    rows = [(1, 1, "One", 600, 9, 0, 900.0), (1, 2, "Notes", 10, 9, 9, 50.0), (1, 3, "To two", 100, 9, 9, 50.0), (1, 4, "Index", 100, 9, 9, 50.0), (1, 5, "After", 100, 9, 1, 50.0), (1, 6, "Sources", 5, 0, 0, None)]
    df = spark.createDataFrame(rows, "b int, section long, title string, words long, n_p long, with_digit long, mean_len double")
    got = {r.section: (r.is_back, r.dropped) for r in reading.back_matter(df, ["b"]).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (True, False), 4: (True, True), 5: (False, False), 6: (True, False)}


def test_notes_are_merged_and_anchored(spark):
    rows = [(1, 0, 0, 0, "b1", "Vesti", "fact", "a channel"), (1, 1, 0, 0, "b2", "vesti", "fact", "again"), (1, 0, 0, 1, "b1", "Kremlin", "source", "The Kremlin is old")]
    got = reading.merge_notes(spark.createDataFrame(rows, "book int, pass int, file int, place int, block string, term string, kind string, text string"), ["book"]).collect()
    assert [tuple(r) for r in got] == [(1, "b1", "Vesti — a channel The Kremlin is old", ["Vesti", "Kremlin"], True)]
    t = spark.createDataFrame([("seen in <i>Vesti</i> by all", ["nothing", "Vesti"]), ("no such word", ["else"]), ("the green snakes bit", ["green snake"])], "text string, terms array<string>")
    assert [r[0] for r in t.select(reading.anchored(F.col("text"), F.col("terms"), F.lit("[1]"))).collect()] == ["seen in <i>Vesti</i>[1] by all", "no such word", "the green snakes[1] bit"]


def test_as_of_takes_the_first_at_or_after(spark):
    a = spark.createDataFrame([(1, 5), (1, 8), (1, 20)], "k int, at int")
    b = spark.createDataFrame([(1, 5, 50), (1, 10, 100)], "k int, at int, v int")
    got = joins.next_at_or_after(a, b, "k", "at", "v").orderBy("at").collect()
    assert [r.v for r in got] == [50, 100, None]


def test_two_tier(spark):
    a = spark.createDataFrame([("Part One",), ("Part  Two",), ("Three",)], "t string")
    heads = spark.createDataFrame([("Part One", "I"), ("Part <b>Two</b>", "II")], "text string, title string")
    assert {r.t: r.title for r in joins.two_tier(a, "t", heads).collect()} == {"Part One": "I", "Part  Two": "II", "Three": None}


@pytest.mark.parametrize(("old", "new", "ok"), [("rn0dern", "rn0dem", True), ("cat", "cat", False), ("page 1", "page 12", False), ("alpha", "omega", False), ("", "x", False)])
def test_fix_ok(old, new, ok):
    assert similarity.fix_ok(old, new) is ok


def test_splice_only_comments():
    text = 'a = "// not a comment at all here"; // a comment that is worth it\n'
    assert similarity.splice(text, [(1, "not a comment at all here", "x")])[1] == 0
    got, n = similarity.splice(text, [(1, "a comment that is worth it", "ein Kommentar")])
    assert n == 1 and got.endswith("// ein Kommentar\n")


def test_chunks_keep_all_blocks_in_order():
    kinds = (["title"] + ["p"] * 30) * 5
    words = ([3] + [120] * 30) * 5
    got = packing.chunks(kinds, words)
    assert got == sorted(got) and len(got) == len(kinds)
    assert all(sum(w for w, c in zip(words, got, strict=True) if c == k) <= 3750 for k in set(got))


def test_verse_is_cut_after_groups_only():
    assert set(packing.chunks(["verse"] * 60, [8] * 60)) == {0}  # within the limits of words and blocks
    got = packing.chunks(["verse"] * 90, [8] * 90)
    cuts = [i for i in range(1, 90) if got[i] != got[i - 1]]
    assert cuts == [24, 48, 72]


def test_batches():
    assert packing.batches([5, 5, 5, 20, 1], 10) == [0, 0, 1, 2, 3]


def test_glossary_first_definition_wins_and_hot_terms_lead():
    lines = [(0, "river", "Fluss"), (1, "river", "Strom"), (2, "castle", "Burg"), (9, "late", "spät")]
    assert packing.glossary(lines, 5, "the castle stood") == ["castle = Burg", "river = Fluss"]


def test_ask_retries_and_falls_back():
    calls = []

    def cut(system, prompt):
        calls.append("cut")
        return "[[[P a]]] x"

    assert passes.ask([cut, passes.stub], "", "[[[P a]]] ab cd\n[[[P b]]] ef", ["a", "b"]) == {"a": "ba dc", "b": "fe"}
    assert calls == ["cut", "cut"]


def test_answer_verdicts(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "b"]), (["a", "b"], ["a"]), (["a", "b"], ["b"]), (["a"], ["a", "z"])], "e array<string>, g array<string>")
    assert [r[0] for r in df.select(answers.verdict(F.col("e"), F.col("g"))).collect()] == ["ok", "truncated", "wrong", "wrong"]


def test_notes_meta_box_and_marks(spark):
    df = spark.createDataFrame([("[[[NOTE b1 term]]] TERM: x\nTEXT: y z\n[[[NOTE b2 fact]]] TERM: q\nTEXT: r",)], "o string")
    assert [tuple(r) for r in answers.notes(df, "o").collect()] == [("b1", "term", "x", "y z"), ("b2", "fact", "q", "r")]
    assert one(spark, lambda c: answers.unboxed(c, "REF"), "[[[REF 1]]] in [[[/REF 1]]]") == "in"
    assert one(spark, lambda c: answers.unboxed(c, "REF"), "[[[REF 1]]] in [[[/REF 2]]]") is None
    marks = spark.createDataFrame([("1 title\n2 +\n3 nonsense\n 4 +t",)], "o string")
    assert [tuple(r) for r in answers.marks(marks, "o").collect()] == [(1, "title"), (2, "+"), (4, "+t")]


PAGE = '<html><title>T</title><body><h1 id=a>One</h1><p>x <em>y</em><p>z <a href="u?q">l</a><table><tr><th>h<td colspan=2>c|d</table><script>"</p>"</script><hr><pre>a\n b</pre><b>open'


def test_html_blocks():
    got = html.read(PAGE)
    assert [(b["kind"], b["text"]) for b in got.blocks] == [
        ("title", "One"),
        ("p", "x <i>y</i>"),
        ("p", "z <a1>l</a1>"),
        ("table", "<b>h</b> | c\\|d"),
        ("break", ""),
        ("code", "a\n b"),
        ("p", "<b>open</b>"),
    ]
    assert got.meta["title"] == "T" and got.blocks[3]["spans"] == [[[1, 1], [2, 1]]] and got.blocks[2]["links"] == ["u"]


def test_markdown_round_trip():
    text = "# One\n\nA *b* **c** `d_e_f` [g](h)\n\n```\ncode\n```\n\n| a | b |\n| --- | --- |\n| c | d |\n"
    found = books.markdown(text)
    assert [b["kind"] for b in found] == ["title", "p", "code", "table"]
    assert found[1]["text"] == "A <i>b</i> <b>c</b> <code>d_e_f</code> <a1>g</a1>"
    again = books.markdown(writers.markdown(found))
    assert [(b["kind"], b["text"]) for b in again][:1] + [(b["kind"], b["text"]) for b in again][2:] == [(b["kind"], b["text"]) for b in found][:1] + [(b["kind"], b["text"]) for b in found][2:]


BLOCKS = [{"kind": "title", "text": "A & B", "level": 1}, {"kind": "p", "text": "x <i>y</i> < 3"}, {"kind": "verse", "text": "v"}, {"kind": "break", "text": ""}, {"kind": "note", "text": "n", "note_id": "n1"}]


def test_fb2_and_epub_round_trips():
    got = books.fb2(writers.fb2(BLOCKS, "t").encode())
    assert [(b["kind"], b["text"]) for b in got] == [("title", "A & B"), ("p", "x <i>y</i> < 3"), ("verse", "v"), ("break", ""), ("note", "n")]
    got = books.epub(writers.epub(BLOCKS, "t"))
    assert [(b["kind"], b["text"]) for b in got][:2] == [("title", "A & B"), ("p", "x <i>y</i> < 3")]


def test_read_books(spark, tmp_path):
    (tmp_path / "a.txt").write_text("CHAPTER ONE\ntext here\n12\n", encoding="utf-8")
    (tmp_path / "b.epub").write_bytes(b"no zip")
    got = {(r.book_id, r.kind, r.text) for r in books.read_books(spark, str(tmp_path)).collect()}
    assert ("a.txt", "title", "CHAPTER ONE") in got and ("a.txt", "p", "text here") in got and ("b.epub", "error", "") in got


@pytest.mark.parametrize("name", ["utf-8", "cp1251", "koi8-r", "utf-16"])
def test_decode(name):
    text = "Это не просто текст, и что в нём на самом деле — по словам автора." * 3
    assert encoding.decode(text.replace("—", "-").encode(name))[0] == text.replace("—", "-")


def test_repair():
    text = "Это не просто текст и что в нём по словам автора " * 5
    assert encoding.repair(text.encode("cp1251").decode("latin-1")) == text


def test_stream_keeps_latest(spark, tmp_path):
    from quire.streaming import incremental

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (2, 1, "z")], "k int, at int, v string").write.parquet(src)
    stream = spark.readStream.schema("k int, at int, v string").parquet(src)
    incremental.keep_latest(stream, ["k"], "at", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.k, r.v) for r in incremental.latest_view(spark, str(tmp_path / "out"), ["k"], "at").collect()} == {(1, "c"), (2, "z")}


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("한국어 문장은 이렇게 씁니다", "ko"),
        ("これは日本語の文章です", "ja"),
        ("这是一个中文句子", "zh"),
        ("он не был там и это не то что мы знаем", "ru"),
        ("він не був там і це не те що ми знаємо", "uk"),
        ("il libro che non è per una persona di città", "it"),
        ("to nie jest tak jak się zdaje ale był w domu", "pl"),
        ("the end of the day and 日本", "en"),
        ("der Tag ist nicht mit dem Abend", "de"),
        ("xyzzy", None),
        (None, None),
    ],
)
def test_detect(spark, text, code):
    assert language.detect(spark.createDataFrame([(text,)], "text string")).first().lang_found == code
