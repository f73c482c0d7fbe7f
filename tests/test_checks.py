"""Number checks, alignment, contents, model passes and the engine on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quire import engine
from quire.functions import numerals
from quire.operators import alignment, checks, sequence
from quire.plans import answers, contents, model_passes


def flag(spark, f, *values):
    return spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(f(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(
    ("text", "n", "lang", "told"),
    [
        ("turn it by forty-five degrees", "45", "en", True),
        ("only forty came", "45", "en", False),
        ("twelve of them", "12", "en", True),
        ("someone stood there", "1", "en", False),
        ("two thousand years", "2000", "en", True),
        ("one thousand", "1234", "en", False),
        ("сто метров", "100", "ru", True),
        ("однако поздно", "1", "ru", False),
        ("fünfundvierzig", "45", "de", False),
        (None, "5", "en", False),
    ],
)
def test_spelled_out(spark, text, n, lang, told):
    assert flag(spark, lambda t, x: numerals.spelled_out(t, x, lang), text, n) is told


@pytest.mark.parametrize(("text", "n", "told"), [("an 88-page book", "88", True), ("in 3D now", "3", True), ("COVID-19 came", "19", False), ("ran 5km", "5", False)])
def test_compound(spark, text, n, told):
    assert flag(spark, numerals.compound, text, n) is told


@pytest.mark.parametrize(("text", "n", "told"), [("see chapter 12, below", "12", True), ("the 1980s", "1980", True), ("in the ’90s", "90", True), ("some 12 people", "12", False)])
def test_place_or_decade(spark, text, n, told):
    assert flag(spark, numerals.place_or_decade, text, n) is told


def test_converted_needs_both_ends(spark):
    assert flag(spark, numerals.converted, "it weighed 165 pounds", "75 кг", "165") is True
    assert flag(spark, numerals.converted, "it weighed 165 pounds", "очень много", "165") is False
    assert flag(spark, lambda s, t, n: numerals.converted(s, t, n, back=True), "it weighed 165 pounds", "75 кг", "75") is True


def test_power_and_scan(spark):
    assert flag(spark, numerals.power, "10<sup>31</sup> stars", "1031") is True
    assert flag(spark, numerals.scanned, "the 5t. Paul church of 1848", "1848") is False
    assert flag(spark, numerals.scanned, "World War 11", "11") is True


def test_number_check(spark):
    rows = [(1, "1,234 men in 1999", "1.234 Mann in 1998"), (2, "an 88-page book", "ein langes Buch"), (3, "no number", None)]
    got = checks.number_check(spark.createDataFrame(rows, "k int, src string, tr string"), ["k"], "en", "de")
    assert sorted(map(tuple, got.collect())) == [(1, "gained", "1998", None), (1, "lost", "1999", None), (2, "lost", "88", "compound")]


def test_note_marks_review_and_injections(spark):
    p = spark.createDataFrame([(1, "a<sup>1</sup> b<sup>1</sup>", "a<sup>1</sup>"), (2, "x", "y")], "k int, src string, tr string")
    assert [tuple(r) for r in checks.note_marks(p, ["k"]).collect()] == [(1, "1", 1)]
    e = spark.createDataFrame([("None.",), ("look at the second line",), (None,), ("short",)], "n string")
    assert [r[0] for r in checks.review(e, "n").collect()] == ["look at the second line"]
    assert flag(spark, checks.injections, "x\nINJECTED: yes\n\n- page 3\n* page 9\nrest\n- other") == ["page 3", "page 9"]
    assert flag(spark, checks.injections, "INJECTED: on page 3") == ["on page 3"]
    assert flag(spark, checks.injections, "INJECTED: None.") == [] == flag(spark, checks.injections, "nothing") == flag(spark, checks.injections, None)


def test_heads_and_unglued(spark):
    pages = [(1, p, k, t) for p in range(1, 13) for k, t in enumerate(["The Old House " + str(p), "body " + "x" * p, "more of it", "and " + "z" * p, "end " + "y" * p])]
    df = spark.createDataFrame(pages, "book int, page int, line int, text string")
    assert [r["key"] for r in checks.page_heads(df, ["book"], "page").collect()] == ["theoldhouse"]
    lines = spark.createDataFrame([(1, "and so THE OLD HOUSE it went"), (2, "THE OLD HOUSE")], "book int, text string")
    heads = spark.createDataFrame([(1, "THE OLD HOUSE "), (1, "THE")], "book int, head string")
    assert sorted(map(tuple, checks.unglued(lines, ["book"], heads).collect())) == [(1, "and so it went"), (2, "THE OLD HOUSE")]


@pytest.mark.parametrize("n", [0, 1, 7, 20000])
def test_value_at_is_the_sorted_value(spark, n):
    values = [(float((i * 7919) % 1000) ** 3,) for i in range(n)] + [(None,)]
    df = spark.createDataFrame(values, "x double")
    ordered = sorted(v[0] for v in values if v[0] is not None)
    for rank in {0, n // 2, n - 1} - {-1}:
        assert sequence.value_at(df, "x", rank, most=64) == (ordered[rank] if rank < n else None)


def test_moved_ids():
    old = {"s01.b0001": "a", "s01.b0002": "b", "s01.b0010": "c"}
    assert alignment.moved(old, [("s01.b0001", "new"), ("s01.b0002", "a"), ("s01.b0003", "b"), ("s01.b0011", "c")]) == {"s01.b0001": "s01.b0002", "s01.b0002": "s01.b0003", "s01.b0010": "s01.b0011"}
    assert alignment.moved(old, list(old.items())) == {} == alignment.moved({}, [("s01.b0001", "a")])


def test_reanchor(spark):
    old = spark.createDataFrame([(1, "s01.b0001", "a"), (1, "s01.b0002", "b"), (2, "s01.b0001", "z")], "book int, id string, fp string")
    new = spark.createDataFrame([(1, 0, "s01.b0001", "b"), (2, 0, "s01.b0001", "z"), (3, 0, "s01.b0001", "q")], "book int, pos long, id string, fp string")
    assert [tuple(r) for r in alignment.reanchor(old, new, "book").collect()] == [(1, "s01.b0002", "s01.b0001")]


XML = '<d><page number="1"><text>see <a href="b.html#3">Fig</a></text><text><a href="b.html#3">ure 2</a></text><text><a href="x.html#2">.</a> <a href="http://h/">site</a></text></page></d>'


def test_links_are_joined_and_placed():
    links = alignment.page_links(XML)
    assert links == [(1, 0, "Figure 2", "3"), (1, 1, "site", "http://h/")]
    blocks = [{"id": "b1", "page": 1, "text": "see Figure 2 on the site here", "links": []}, {"id": "b4", "page": 4, "text": "Figure 2", "links": []}]
    assert alignment.place_links(blocks, links) == 2
    assert blocks[0]["text"] == "see <a1>Figure 2</a1> on the <a2>site</a2> here" and blocks[0]["links"] == ["#b4", "http://h/"]
    assert alignment.place_links(blocks, [(4, 0, "Figure 2", "4"), (4, 1, "igur", "http://x/")]) == 0
    assert alignment.place_links(blocks, [(4, 0, "igure", "http://x/")]) == 1  # a link may lack a ligature at its begin
    assert blocks[1]["text"] == "<a1>Figure</a1> 2"


def test_undo_drops():
    pieces = ["He went to the", "market place.", "RUNNING HEAD", "x" * 100, "Index", "apples, 3"]
    marks = {2: "skip", 3: "skip", 4: "skip", 5: "title", 6: "toc"}
    assert contents.undo_drops(pieces, marks) == 3
    assert marks == {2: "p", 3: "skip", 4: "p", 5: "title", 6: "p"}


def test_reconcile_raises_named_titles_and_drops_heads():
    pieces = ["Contents", "The River ..... 3", "The Hill ..... 9", "The River", "text one here.", "My Book", "The Hill", "My Book", "more text here.", "My Book"]
    marks = {1: "title", 2: "toc", 3: "toc", 6: "title", 8: "title", 10: "title"}
    got = contents.reconcile(pieces, marks)
    assert got.names == ["The River", "The Hill"] and got.added == 2 and got.lost == [] and got.dropped == ["My Book"]
    assert marks == {1: "skip", 2: "toc", 3: "toc", 4: "title", 6: "title", 7: "title", 8: "skip", 10: "skip"}


def test_reconcile_joins_torn_titles():
    pieces = ["start of it all.", "A Being", "Makes a Choice", "text " * 30, "The Hill", "end."]
    marks: dict[int, str] = {}
    got = contents.reconcile(pieces, marks, ("A Being Makes a Choice", "The Hill", "Never There At All"))
    assert marks == {2: "title", 3: "+t", 5: "title"} and got.lost == ["Never There At All"]


def test_parsers(spark):
    df = spark.createDataFrame([("[[[C b1 3]]] ORIG: a b\nTR: c d\n[[[F b2]]]\nORIG: x\nFIX: y\n[[[TOC]]]\n- One ..... 4\n- Two\n- One\n12 title\nThree",)], "o string")
    assert [tuple(r) for r in answers.comments(df, "o").collect()] == [("b1", 3, "a b", "c d")]
    assert [tuple(r) for r in answers.fixes(df, "o").collect()] == [("b2", "x", "y")]
    assert [r["name"] for r in answers.toc_lines(df, "o").orderBy("place").collect()] == ["One", "Two"]
    assert flag(spark, answers.styles, "p|x = verse\nnoise\np|x = note\nh1| = title") == {"p|x": "note", "h1|": "title"}
    assert flag(spark, answers.forked, "# NAMES\n| cat | кот / кошка |\n| a / b | в / г |\n# OTHER\n| dog | пёс / собака |\n") == ["cat"]
    assert flag(spark, answers.record, "# META\n- **title** = `T`\ngenre = SF\nyear = (unknown)\nfoo = 1\n# NEXT\nauthor = X") == {"title": "T", "genre": "sf"}
    assert flag(spark, answers.dropped_sections, "drop_sections:\n- Index\n- \"Names\"\n") == ["Index", "Names"]


def test_corrections_and_headings(spark):
    b = spark.createDataFrame([(1, 0, "b1", "p", "hack into space, hack again"), (1, 1, "b2", "title", "One"), (1, 2, "b3", "title", "One")], "book int, pos long, id string, kind string, text string")
    said = "[[[F b1]]] ORIG: hack\nFIX: back\n[[[F b1]]] ORIG: hack into\nFIX: back unto\n[[[F b9]]] ORIG: a\nFIX: b"
    fixes = model_passes.corrections(b, "book", [lambda s, p: said])
    assert sorted((r["old"], r["new"]) for r in fixes.collect()) == [("hack", "back"), ("hack into", "back unto")]
    assert model_passes.corrected(b, fixes, "book").filter("id = 'b1'").first()["text"] == "back unto space, back again"
    assert [tuple(r) for r in model_passes.headings(b, "book", [lambda s, p: "1. Eins"]).collect()] == [(1, "One", "Eins")]


def test_structure_scout_notes_and_listings(spark):
    assert model_passes.structure([("p", "x", 3, ["a"])], [lambda s, p: "p|x = verse\nq|z = note"]) == {"p|x": "verse"}
    long = "| a | b |\n" + "prose " * 50
    assert model_passes.scout(["one"], [lambda s, p: {"scout": long, "condense": "| a | b |\nshort"}[s]], budget=100) == "| a | b |\nshort"
    b = spark.createDataFrame([(1, 0, 0, "b1", "x = 1  # counts the open files")], "book int, chunk int, pos long, id string, text string")
    note = "[[[NOTE b1 term]]] TERM: file\nTEXT: what is open\n[[[NOTE b1 term]]] TERM: Known\nTEXT: old"
    assert [r["term"] for r in model_passes.notes(b, "book", [lambda s, p: note], ("known",)).collect()] == ["file"]
    tr = "[[[C b1 1]]] ORIG: counts the open files\nTR: zählt die Dateien"
    assert model_passes.listings(b, "book", [lambda s, p: tr]).first()["text"] == "x = 1  # zählt die Dateien"


def test_translation_carries_the_tail(spark):
    import dataclasses

    from quire.model import T
    from quire.plans import passes

    alone = dataclasses.replace(T, lookahead_words=0)  # nothing of what follows

    def echo(system, prompt):
        before = prompt.partition("\n---\n")[0] if "\n---\n" in prompt else "none"
        return "\n".join(f"[[[P {i}]]] {before}" for i in passes.parse(prompt))

    b = spark.createDataFrame([(1, 0, 0, "a", "x"), (1, 1, 1, "b", "y")], "book int, chunk int, pos long, id string, text string")
    assert [r["tr"] for r in passes.translate(b, "book", [echo], th=alone).orderBy("pos").collect()] == ["none", "Before: none"]


def test_engine(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# One\n\nab cd 1999\n\n# Two\n\nef\n")
    e = engine.Engine(spark, f"file://{tmp_path}/work")
    out = e.run(f"file://{src}", "xx")
    assert out["qa"] == {"missing": 0, "numbers": 1, "marks": 0}
    assert "ba dc 9991" in out["books"].first()["content"].decode()
    before = e._done("xx").count()
    e.translate("xx")
    assert e._done("xx").count() == before and spark.read.parquet(f"file://{tmp_path}/work/xx").count() == before


def test_groups_of_three_figures(spark):
    from quire.functions import text as X

    got = flag(spark, X.numbers, "193.195.198.107 and 1,234,5678 of 2024 100 at a1,234 or 12 345")
    assert got == ["193195198107", "1234", "5678", "2024", "100", "1", "234", "12345"]


def test_entries_run_together():
    assert contents.entries("The River ..... 3 The Hill ... 9") == ["The River", "The Hill"]
    assert contents.entries("One 3\nTwo 14") == ["One", "Two"]
    assert contents.entries("Only one line 7") == ["Only one line 7"] and contents.entries("") == []


@pytest.mark.parametrize("rows_per_batch", ["1", "3", "1000"])
def test_books_are_planned_whole_whatever_the_batches(spark, rows_per_batch):
    from quire.plans import packing

    sizes = {1: [5, 5, 5], 2: [9], None: [4, 4, 4, 4], 3: [1, 8, 1]}
    rows = [(b, p, n) for b, ns in sizes.items() for p, n in reversed(list(enumerate(ns)))]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows_per_batch)
    try:
        got = packing.plan_batches(spark.createDataFrame(rows, "book long, pos long, size long").coalesce(1), "book", 10).collect()
    finally:
        spark.conf.set(name, before)
    found = {b: [r["batch"] for r in sorted(got, key=lambda r: r["pos"]) if r["book"] == b] for b in sizes}
    assert found == {b: packing.batches(ns, 10) for b, ns in sizes.items()}
