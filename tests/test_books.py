"""PDF text, settings, the passes after a read, and writers whose books are read back."""

import io
import zipfile
from xml.etree import ElementTree

import pytest
from conftest import against_sql
from pyspark.sql import functions as F

from quire import catalog, host
from quire.functions import text as X
from quire.model import T
from quire.sinks import writers
from quire.sources import books, html, pdf


def pages(n, body):
    return "\f".join(f"The Long Road     {i}\n\n{body(i)}\n\n{i}" for i in range(1, n + 1))


def test_pdf_text_loses_heads_and_page_numbers():
    own = lambda i: "abcdefghij"[i] * 9
    text = pages(8, lambda i: f"   Some words {own(i)} of page {own(9 - i)} {i} that go on over\nthe broken line {own(i)} and end {own(9 - i)} here. The Long Road     {i}")
    got = pdf.read(text)
    assert len(got) == 8 and all("Long Road" not in b["text"] for b in got) and got[0]["text"].startswith("Some words bbbbbbbbb of page")
    assert [b["page"] for b in got] == list(range(1, 9))
    assert len(pdf.read(pages(3, lambda i: "Words."))) > 3  # a leaflet keeps all its lines
    with pytest.raises(ValueError, match="pictures"):
        pdf.read(" \f ")


def test_dirty_heads_are_told_by_their_neighbours():
    names = ["Chapter of Rivers", "Chapter of Rlvers", "Chapter of Rivers", "Chapter oi Rivers", "Chapter of Rivers", "Chapter of Rivcrs"]
    some = [[n, f"body number {'abcdefg'[i] * 9}", f"tail {'hijklmn'[i] * 9}"] for i, n in enumerate(names)]
    assert pdf.heads(some, dirty=True) >= {pdf.head_key(n) for n in names}
    assert len(pdf.heads([[n, "x"] for n in names[1::2]] * 1, dirty=False)) == 0


def test_pdf_columns_and_spaced_words():
    line = "one two three four five six seven      eight nine ten eleven"
    assert pdf.columned("\n".join([line] * 8)) and pdf.columned("\n".join(["x" * 40] * 8)) is False and pdf.columned(line) is None
    assert pdf.columned("\n".join(["A chapter of the book that is long        17"] * 9)) is False
    assert pdf.unspaced("the T I T L E of a b") == "the TITLE of a b"
    got = pdf.read("\f".join(["\n".join([line] * 9)] * 6), plain="In reading order.")
    assert [b["text"] for b in got] == ["In reading order."]


def test_pdf_images_and_provenance(spark):
    listing = "page   num  type   width height color comp bpc  enc\n-----\n   1     0 image     300   400  rgb     3   8  jpeg\n   1     1 smask     300   400  gray\n  12     2 image     20    400  rgb\n"
    got = pdf.images(spark.createDataFrame([("a", listing)], "book string, listing string"), ["book"]).collect()
    assert [tuple(r) for r in got] == [("a", 1, 0, 300, 400), ("a", 12, 2, 20, 400)]
    df = spark.createDataFrame([("ABBYY FineReader 11", "abcdef"), ("LaTeX", None), (None, "x")], "p string, t string")
    assert [r[0] for r in df.select(pdf.ocr_made(F.col("p"))).collect()] == [True, False, False]
    assert df.select(pdf.probe(F.col("t"), 2)).first()[0] == "cd" and pdf.is_cover([(500, 700)], (600, 800), 3) and not pdf.is_cover([(50, 70)], (600, 800), 3)


def test_model_chains_and_profiles():
    M = host.Model
    assert host.chain("pro:high, claude:opus:low,codex:,x", "agy") == [M("agy", "pro", "high"), M("claude", "opus", "low"), M("codex", None), M("agy", "x")]
    assert host.chain(None) == [] and host.chain("high", "a") == [M("a", None, "high")]
    assert host.with_profiles(["book", "--profile", "p", "--to=de"], lambda n: "--agent x # why\n--kind 'm d'\n") == ["--agent", "x", "--kind", "m d", "book", "--to=de"]
    with pytest.raises(ValueError, match="profile"):
        host.profile("--profile=other")


def test_settings():
    th, changed = host.tuned("TARGET_WORDS = 100  # less\nSAME=0.9\nNOBODY = 3\nMAX_WORDS = x\nMAX_BLOCKS = 70")
    assert (th.target_words, th.same, th.max_words) == (100, 0.9, T.max_words) and set(changed) == {"target_words", "same"}
    assert host.front_matter("---\na: 1\n---\n\nrest") == ({"a": "1"}, "rest") and host.front_matter("x\n---") == ({}, "x\n---")
    say = host.Messages(host.catalogue("# c\nhello = Hi {0}\\n\n"))
    assert say("hello", "you") == "Hi you\n" and say("unknown", 1) == "unknown"
    assert host.prompt("p", "Use [[[P and SUMMARY: x", "Use [[[P only") == ("Use [[[P only", {"SUMMARY:"})
    assert host.which("no-such-tool") is None and ("pdftotext", "PDF text", host.which("pdftotext") is not None) in host.doctor()


def test_limits_wait_for_the_first_that_is_free():
    now, slept = [0.0], []
    limits = host.Limits(lambda: now[0])
    limits.refuse("a", 50)
    assert limits.first_free(["a", "b"], 100, slept.append) == "b"
    limits.refuse("b", 30)
    assert limits.first_free(["a", "b"], 100, slept.append) == "b" and slept == [30.0]
    assert limits.first_free(["a"], 10, slept.append) is None


def test_resets(spark):
    rows = [("resets in 1h 2m", 3720), ("Limit reached, resets 3pm", 3 * 3600), ("resets at 11:30", 84600), ("resets at 12:50am", 46200), ("busy", None)]
    df = spark.createDataFrame(rows, "t string, want long").withColumn("now", F.lit("2024-05-05 12:00:00").cast("timestamp"))
    assert [r[0] for r in df.select(X.reset_after(F.col("t"), F.col("now"))).collect()] == [w for _, w in rows]
    assert spark.range(1).select(X.unspaced(F.lit("the T I T L E, x y z"))).first()[0] == "the TITLE, x y z"


def test_passes_after_a_read(spark, tmp_path):
    prose = "\n\n".join("It was a long and quiet day in the country, and nobody came. " * 8 for _ in range(12))
    refs = "\n\n".join(f"{i}. Smith, A book ({1990 + i})" for i in range(1, 9))
    (tmp_path / "b.md").write_text(f"# One\n\n{prose}\n\n```\nx = 1\n```\n\n# References\n\n{refs}\n\n# Index\n\n" + "\n\n".join(f"word {i}, {i + 3}" for i in range(9)))
    got = books.finished(books.read_books(spark, f"file://{tmp_path}")).orderBy("pos").collect()
    of = lambda text: next(r for r in got if text in r.text)
    assert not of("quiet day").asis and of("x = 1").asis and of("1. Smith").asis and of("8. Smith").asis and not of("References").drop
    assert of("word 3").drop and of("Index").drop and not of("1. Smith").drop


BOOK = [
    {"id": "s01.b0001", "kind": "title", "text": "One & two", "links": [], "level": 1},
    {"id": "s01.b0002", "kind": "p", "text": "See <a1>there</a1>, a word<a2>1</a2> and <i>more</i> at https://x.org/a&b.", "links": ["#s02.b0002", "#n1"]},
    {"id": "s01.b0003", "kind": "table", "text": "<b>a</b> | b\nc \\| d | e", "links": []},
    {"id": "s01.b0004", "kind": "verse", "text": "Line & line", "links": []},
    {"id": "s02.b0001", "kind": "title", "text": "Three", "links": [], "level": 1},
    {"id": "s02.b0002", "kind": "p", "text": "Here, marked again[^n1] and [^n2].", "links": []},
    {"id": "s02.n0001", "kind": "note", "text": "What it <b>means</b>", "links": [], "note_id": "n1"},
    {"id": "s02.n0002", "kind": "note", "text": "Another", "links": [], "note_id": "n2"},
]


def copied():
    return [dict(b) for b in BOOK]


def test_notes_and_tables_in_every_format(spark):
    md = writers.markdown(copied())
    assert "a word[^n1] and" in md and md.index("[^n1]: What it **means**") > md.index("Three") and "| c \\| d | e |" in md
    page = writers.html(copied(), "t")
    assert '<a id="r-n1" href="#n1"><sup>1</sup></a>' in page and '<li id="n1">What it <b>means</b> <a href="#r-n1">↩</a></li>' in page
    assert '<p id="s02.b0002">' in page and '<a href="https://x.org/a&amp;b">https://x.org/a&amp;b</a>.' in page and "<td>c | d</td>" in page
    tex = writers.tex(copied(), "t")
    assert r"a word\footnote{What it \textbf{means}} and" in tex and "\\begin{tabular}{ll}\n\\textbf{a} & b \\\\\nc | d & e\n\\end{tabular}" in tex
    text = writers.render_text(spark.createDataFrame([("b", i, b["kind"], b["text"], b["links"], b.get("note_id")) for i, b in enumerate(BOOK)], "book string, pos int, kind string, text string, links array<string>, note_id string"), "book").first().text
    assert "See there, a word[1] and more" in text and text.endswith("Here, marked again[1] and [2].\n[1] What it means\n[2] Another")


def test_epub_links_between_its_parts():
    raw = writers.epub(copied(), "t")
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    one, two = (z.read(f"OEBPS/part{i:03d}.xhtml").decode() for i in (0, 1))
    assert 'href="part001.xhtml#s02.b0002"' in one and 'id="s02.b0002"' in two and '<li id="n1">' in one and '<li id="n2">' in two and "again<sup>1</sup>" in two
    nav = z.read("OEBPS/nav.xhtml").decode()
    assert ElementTree.fromstring(nav) is not None and "One &amp; two" in nav and 'properties="nav"' in z.read("OEBPS/book.opf").decode()
    assert [b["text"] for b in books.epub(raw) if b["kind"] == "title"] == ["One & two", "Three"]


def test_fb2_is_read_back():
    made = writers.fb2(copied(), "t")
    got = books.fb2(made.encode())
    assert [(b["kind"], b["text"]) for b in got] == [
        ("title", "One & two"), ("p", "See <a1>there</a1>, a word<a2>[1]</a2> and <i>more</i> at https://x.org/a&b."), ("table", "<b>a</b> | b\nc \\| d | e"), ("verse", "Line & line"),
        ("title", "Three"), ("p", "Here, marked again<a1>[1]</a1> and <a2>[2]</a2>."), ("note", "What it <b>means</b>"), ("note", "Another"),
    ]
    assert got[1]["links"] == ["#s02.b0002", "#n1"] and [b["note_id"] for b in got[-2:]] == ["n1", "n2"]
    z = zipfile.ZipFile(io.BytesIO(writers.WRITERS["fb2.zip"](copied(), "t")))
    assert z.read("t.fb2").decode() == made


def plain(blocks):
    return [(b["kind"], " ".join(__import__("re").sub(r"</?\w+>", "", b["text"]).split())) for b in blocks]


@pytest.mark.parametrize("kind", ["md", "html", "epub", "fb2"])
def test_pages_are_read_back_as_they_were(spark, kind):
    from conftest import SF

    from quire.islands_catalog import page_blocks

    source = {}
    for r in page_blocks(spark, SF).orderBy("page_id", "pos").collect():
        source.setdefault(r.page_id, []).append(r.asDict())
    made = writers.render(page_blocks(spark, SF), "page_id", kind).collect()
    read = {"md": lambda c: books.markdown(c.decode()), "html": lambda c: html.read(c.decode()).blocks, "epub": books.epub, "fb2": books.fb2}[kind]
    assert len(made) == len(source) > 200
    same = 0
    for r in made:
        want = [(k, t) for k, t in plain(source[r.page_id]) if t or k == "break"]
        got = [(k, t) for k, t in plain(read(bytes(r.content))) if t or k == "break"]
        if kind == "md":
            clean = lambda t: t.replace("\\", "")
            want, got = [(k, clean(t)) for k, t in want], [(k, clean(t)) for k, t in got]
        if kind in ("fb2", "epub"):  # one kind of heading within a section; pages may be taken for a publisher's
            want, got = [t for _, t in want], [t for _, t in got]
        same += want == got
    assert same >= 0.99 * len(made)


def test_a_request_carries_the_book_around_it(spark):
    from quire.plans import passes, protocol

    def agent(system, prompt):
        if system == "condense":
            return "all so far"
        ids = [r.args[0] for r in protocol.records(prompt, "P")]
        head = prompt.split("---")[0] if "---" in prompt else ""
        head = "\n".join(x[:12] if x.startswith("Before") else x for x in head.splitlines())
        return "\n".join(f"[[[P {i}]]] {i} <{' '.join(head.split())}>" for i in ids) + f"\n[[[META]]] SUMMARY: part {ids[0]}\nTERMS: river = Fluss\nsea = none"

    rows = [("b", c, c * 10 + k, f"{c}{k}", f"the river {c}{k}") for c in range(3) for k in range(2)]
    got = {r.id: r.tr for r in passes.translate(spark.createDataFrame(rows, "book string, chunk int, pos long, id string, text string"), "book", [agent]).collect()}
    assert got["00"] == "00 <Ahead: the river 10 the river 11>"
    assert "Plot: part 00" in got["10"] and "Terms: river = Fluss" in got["10"] and "Before: 00 <" in got["10"] and "Ahead: the river 20" in got["10"]
    assert "Plot: part 00 part 10 Terms" in got["20"] and "Ahead" not in got["20"]


def test_losses_are_asked_for_again_and_twins_refused():
    from quire.plans import passes

    long = "a long text of many words " * 5
    calls = []

    def agent(system, prompt):
        calls.append(prompt)
        return "[[[P 1]]] " + ("short" if len(calls) == 1 else long)

    assert passes.regrown([agent], {"1": "tiny"}, {"1": long}, 2) == {"1": "short"}
    assert passes.regrown([agent], {"1": "tiny"}, {"1": long}, 2) == {"1": long.strip()}
    with pytest.raises(ValueError, match="same text"):
        passes._answer(f"[[[P 1]]] {long}\n[[[P 2]]] {long}", ["1", "2"], {"1": "one thing " * 9, "2": "quite another " * 9})


def test_edits_keep_the_longest_part():
    from quire.plans import passes

    answers = iter(["[[[P 1]]] A\n[[[P 9]]] x", "[[[P 1]]] A\n[[[P 2]]] B\n[[[P 9]]] x", "[[[P 9]]] x"])
    tr = {"1": "a", "2": "b", "3": "c"}
    assert passes.edited([lambda s, p: next(answers)], ["1", "2", "3"], tr, tr, retries=3) == {"1": "A", "2": "B"}
    assert passes.edited([lambda s, p: "[[[P 1]]] a"], ["1"], tr, tr) == {}


def test_engine_edits_and_notes(spark, tmp_path):
    from quire import engine
    from quire.plans import protocol

    def agent(system, prompt):
        if system == "edit":
            return "\n".join(f"[[[P {r.args[0]}]]] {r.body.replace('dog', 'hound')}" for r in protocol.records(prompt, "T") if "dog" in r.body)
        if system == "notes":
            return "\n".join(f"[[[NOTE {r.args[0]} fact]]]\nTERM: fox\nTEXT: a beast" for r in protocol.records(prompt, "P") if "fox" in r.body)
        return "\n".join(f"[[[P {r.args[0]}]]] {r.body}" for r in protocol.records(prompt, "P"))

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.md").write_text("# Tale\n\nThe foxes saw a dog.\n\nThe dog saw a fox.\n")
    e = engine.Engine(spark, f"file://{tmp_path}/work", [agent])
    out = e.run(f"file://{tmp_path}/in", "de", ("read", "translate", "edit", "notes", "build"), "md")
    made = bytes(out["books"].first().content).decode()
    assert "The foxes[^t-s01.b0002] saw a hound." in made and "The hound saw a fox." in made and "[^t-s01.b0002]: fox — a beast" in made
    with pytest.raises(ValueError, match="hardly a book"):
        e.guard("de")


def test_work_state(spark, tmp_path):
    import json

    from quire.sources import state

    (tmp_path / "a.json").write_text(json.dumps({"saved": "2024-01-02T00:00:00", "model": "m", "tr": {"b1": "one", "b2": "two"}, "src": {"b1": "f1"}}))
    (tmp_path / "b.json").write_text(json.dumps({"saved": "2024-01-01T00:00:00", "model": "old", "tr": {"b1": "older", "b3": "three"}}))
    (tmp_path / "c.json").write_text(json.dumps({"saved": "2024-01-03T00:00:00", "edits": {"b2": {"old": "two", "new": "TWO"}, "b9": {"old": "x", "new": "y"}}}))
    got = {r.id: (r.text, r.fp, r.model, r.edited) for r in state.translations(state.read_chunks(spark, f"file://{tmp_path}")).collect()}
    assert got == {"b1": ("one", "f1", "m", False), "b2": ("TWO", None, "m", True), "b3": ("three", None, "old", False)}


def test_metadata_and_notes_of_files(spark, tmp_path):
    raw = writers.epub(copied(), "A title", "de")
    assert books.meta("x.epub", raw) == {"title": "A title", "lang": "de"}
    fb2 = writers.fb2(copied(), "B title").replace("<book-title>", '<author><first-name>Jo</first-name><last-name>Doe</last-name></author><sequence name="S" number="2"/><book-title>')
    assert books.meta("x.fb2", fb2.encode()) == {"title": "B title", "lang": "en", "author": "Jo Doe", "series": "S", "series_no": "2"}
    page = b'<html lang="fr"><title>T</title><meta name="author" content="A B"><body><p>Text<a href="#f1">1</a></p><aside epub:type="footnote" id="f1"><p>1. A note</p><p>goes on</p></aside><p>After</p>'
    assert books.meta("p.html", page) == {"title": "T", "lang": "fr", "author": "A B"} and books.meta("p.txt", b"") == {}
    assert [(b["kind"], b["text"], b["note_id"]) for b in books.parse("p.html", page)] == [("p", "Text<a1>1</a1>", None), ("note", "A note", "f1"), ("note", "goes on", "f1"), ("p", "After", None)]
    (tmp_path / "x.epub").write_bytes(raw)
    (tmp_path / "y.epub").write_bytes(b"no zip")
    assert {r.book_id: r.meta for r in books.read_meta(spark, f"file://{tmp_path}").collect()} == {"x.epub": {"title": "A title", "lang": "de"}, "y.epub": {}}


def test_sweeps_in_named_blocks_and_mentions(spark):
    from quire.operators import joins
    from quire.plans import packing

    df = spark.createDataFrame([("b1", "a cat and a cat"), ("b2", "a cat")], "id string, text string")
    got = joins.sweep(df, "text", [("cat", "dog", ["b1"]), ("a ", "the ")], "id").orderBy("id").collect()
    assert [(r.text, r.n_replaced) for r in got] == [("the dog and the dog", 4), ("the cat", 1)]
    assert packing.mentions("rivers", "the River flows") and not packing.mentions("rivers", "a driver") and packing.mentions("東京", "私は東京に") and not packing.mentions("cat", "cat")


def test_chains_back_off_and_wait():
    from quire.plans import passes

    now, slept, calls = [0.0], [], []

    def sleep(seconds):
        slept.append(seconds)
        now[0] += seconds

    def spent(system, prompt):
        calls.append("spent")
        if now[0] < 30:
            raise passes.RateLimited("quota", 30)
        return "late"

    def broken(system, prompt):
        calls.append("broken")
        raise passes.AgentError("no line")

    limits = lambda: host.Limits(lambda: now[0])
    with pytest.raises(passes.AgentError):
        passes.request([spent, broken], "s", "p", str, 3, limits(), 100, 1, sleep)
    assert calls == ["spent", "broken", "broken", "broken"] and slept == [1, 2]
    now[0] = 0.0
    assert passes.request([spent], "s", "p", str, 3, limits(), 100, 1, sleep) == "late" and slept[-1] == 30
    now[0] = 0.0
    with pytest.raises(passes.RateLimited):
        passes.request([spent], "s", "p", str, 3, limits(), 10, 1, sleep)
    assert passes.request([broken, lambda s, p: "next"], "s", "p", str, 2, limits()) == "next"


ODD = ["ßheit eins\nßtum zwei", "ŉone two\nﬁrst word", "ΟΔΟΣ ΟΔΟΣ\nİstanbul ΣΑΣ", "été ä tail\nplain", "ᾳ mark\nǰ mark"] * 8


@pytest.mark.parametrize("name", ["backfilled", "context_window", "note_anchors"])
def test_letters_that_change_length_match_sql(spark, tmp_path, name):
    import duckdb

    rows_ = [(i, "s", "en", ODD[i % len(ODD)] + "\n" + ODD[(i * 3 + 1) % len(ODD)]) for i in range(40)]
    spark.createDataFrame(rows_, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    against_sql(catalog.queries()[name](spark, str(tmp_path)), con, catalog.oracle_sql()[name])


def test_entry_after_a_widened_letter_matches_sql(spark, tmp_path):
    import duckdb

    line = lambda k: f"{'ß' if k % 5 == 4 else ''}word {1950 + k}"
    rows_ = [(i, "s", "en", "\n".join(line(k) for k in range(60))) for i in range(24)]
    spark.createDataFrame(rows_, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.queries()["reference_spans"](spark, str(tmp_path))
    assert df.count() > 0
    against_sql(df, con, catalog.oracle_sql()["reference_spans"])


def documents_against_sql(spark, folder, name, texts):
    import duckdb

    rows_ = [(i, f"s{i % 2}", "en", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows_, "doc_id long, source string, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    against_sql(catalog.queries()[name](spark, str(folder)), con, catalog.oracle_sql()[name])


def test_heads_of_few_letters_go_with_their_key(spark, tmp_path):
    texts = [f"Page {i}\nbody {'abcdefgh'[i]} one\nmore of {'abcdefgh'[i]}\nend {'abcdefgh'[i]}" for i in range(6)] + ["Page 1234567890\nsome words\nmore\nlast"]
    documents_against_sql(spark, tmp_path, "heads_removed", texts)


def test_spoiled_text_of_few_letters_is_repaired(spark, tmp_path):
    documents_against_sql(spark, tmp_path, "mojibake_repair", [("abcdefghij" * 6 + " " + "0123456789" * n) for n in (1, 1, 30, 30, 80, 80)] + ["a" * 60 + "\u2028"])


def test_numbers_beside_letters_of_other_scripts_match_sql(spark, tmp_path):
    documents_against_sql(spark, tmp_path, "number_check", ["a ftä b ä1,234 and 7 ßone", "5 kg 9 and ä2,345 é two", "3 tenö 1980sä Part 3ä", "10 and 2 twoé 1,234ä", "chapter 4ß and 165 ftö", "75 cm"])
