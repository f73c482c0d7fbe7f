"""The engine's programming interface, and the command line over it.

``Engine(spark).run(path, to, steps)`` reads books, plans chunks, translates, edits, builds and
checks; each step reads what the one before has written under the work folder, so a run that
stopped goes on where it was."""

from __future__ import annotations

import argparse
import dataclasses
import os
import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire import host
from quire.functions import text as X
from quire.model import T, Thresholds
from quire.operators import checks, joins, language
from quire.operators import reading as R
from quire.plans import model_passes, packing, passes
from quire.sinks import writers
from quire.sources import books

STEPS = ("read", "translate", "build", "qa")
#: Steps that are taken only when they are asked for.
MORE = ("edit", "notes")


class Engine:
    """Books under one work folder; ``agents`` are asked in order."""

    def __init__(self, spark: SparkSession, work: str, agents: list[passes.Agent] | None = None, thresholds: Thresholds = T):
        self.spark, self.work, self.agents, self.th = spark, work.rstrip("/"), agents or [passes.stub], thresholds

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.work}/{name}")

    def read(self, path: str) -> DataFrame:
        """Blocks of all books under ``path``, after the passes that every read ends with."""
        books.finished(books.read_books(self.spark, path), th=self.th).write.mode("overwrite").parquet(f"{self.work}/blocks")
        return self._table("blocks")

    def translatable(self) -> DataFrame:
        """Paragraphs, verse, notes and tables that neither stay as they are nor go, and the headings, which have chunks too."""
        kinds = F.col("kind").isin("p", "verse", "note", "table", "title", "subtitle")
        return self._table("blocks").filter(F.col("error").isNull() & kinds & ~F.col("asis") & ~F.col("drop"))

    def guard(self, to: str, share: float = 0.9) -> None:
        """Refuse a run that can't be meant: nothing to read, hardly any text, or a book that is in the target language already."""
        b = self.translatable().filter("kind not in ('title', 'subtitle')")
        n, words = b.agg(F.count("*"), F.sum(X.words(F.col("text")))).first()
        if n < 20 and (words or 0) < 500:
            raise ValueError(f"{n} paragraphs and {words or 0} words: hardly a book")
        w = Window.partitionBy("book_id")
        sample = b.filter(F.length("text") > 60).withColumn("r", F.row_number().over(w.orderBy("pos")) - 1).withColumn("n", F.count("*").over(w)).filter("r % greatest(1, n div 400) = 0")
        found = language.detect(sample).groupBy("book_id").agg(F.count("*").alias("n"), F.avg((F.col("lang_found") == to).cast("int")).alias("share"))
        done = [r["book_id"] for r in found.filter(f"n >= 20 and share > {share}").limit(5).collect()]
        if done:
            raise ValueError(f"in {to} already: {', '.join(done)}")

    def translate(self, to: str) -> DataFrame:
        """Translations (book_id, chunk, pos, id, tr) of the blocks whose fingerprint isn't stored yet."""
        b = self.translatable().withColumn("words", X.words(F.col("text"))).withColumn("fp", X.fingerprint(F.col("text")))
        where = f"{self.work}/{to}"
        have = self._done(to)
        todo = b if have is None else b.join(have.select("book_id", "id", "fp"), ["book_id", "id", "fp"], "left_anti")
        chunked = packing.plan_chunks(todo, "book_id", self.th).select("book_id", "pos", "chunk").join(todo, ["book_id", "pos"])
        new = passes.translate(chunked, "book_id", self.agents, self.th.tail_paras).join(b.select("book_id", "id", "fp"), ["book_id", "id"])
        new.withColumn("saved", F.current_timestamp()).write.mode("append").parquet(where)
        return self._done(to)

    def edit(self, to: str) -> DataFrame:
        """Edits (book_id, chunk, pos, id, old, new) of the drafts, chunk by chunk; appended, the last one of a block counts."""
        done = self._done(to)
        drafts = self.translatable().join(done.select("book_id", "id", "tr", "chunk"), ["book_id", "id"])
        new = passes.edit_pass(drafts, "book_id", self.agents).withColumn("saved", F.current_timestamp())
        new.write.mode("append").parquet(f"{self.work}/{to}-edits")
        return self._table(f"{to}-edits")

    def unfinished(self, to: str) -> DataFrame:
        """Chunks whose edits stop early."""
        done = self.translatable().join(self._done(to).select("book_id", "id", "chunk"), ["book_id", "id"])
        return R.stopped(done, self._table(f"{to}-edits"), ["book_id", "chunk"])

    def notes(self, to: str) -> DataFrame:
        """Notes (book_id, block, text, terms, source) on the translations, one a term, merged by block."""
        done = self.translatable().join(self._done(to).select("book_id", "id", "tr", "chunk"), ["book_id", "id"])
        told = model_passes.notes(done.select("book_id", "chunk", "pos", "id", F.col("tr").alias("text")), "book_id", self.agents)
        told = told.select("book_id", F.lit("nt").alias("pass"), F.col("chunk").alias("file"), F.col("block").alias("place"), "block", "term", "kind", "text")
        R.merge_notes(told, ["book_id"]).write.mode("overwrite").parquet(f"{self.work}/{to}-notes")
        return self._table(f"{to}-notes")

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.work}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _done(self, to: str) -> DataFrame | None:
        """The last translation of each block; None before the first run."""
        if not self._exists(to):
            return None
        rows = self._table(to)
        return rows.groupBy("book_id", "id").agg(F.max_by(F.struct("tr", "fp", "chunk"), F.struct("saved", "tr")).alias("r")).select("book_id", "id", "r.*")

    def current(self, to: str, partial: bool = False) -> DataFrame:
        """Blocks with their translation as text; with ``partial`` the source stands in for what lacks."""
        b = self._table("blocks").filter(F.col("error").isNull())
        done = self._done(to)
        if done is None:
            return b
        if self._exists(f"{to}-edits"):
            edits = self._table(f"{to}-edits").groupBy("book_id", "id").agg(F.max_by("new", F.struct("saved", "new")).alias("text"))
            done = joins.overlay(done.select("book_id", "id", F.col("tr").alias("text")), edits, ["book_id", "id"]).withColumnRenamed("text", "tr")
        told = b.join(done.select("book_id", "id", "tr"), ["book_id", "id"], "left")
        stays = F.col("kind").isin("break", "image", "code") | F.col("asis")
        text = F.coalesce("tr", "text") if partial else F.when(stays, F.coalesce("tr", "text")).otherwise(F.col("tr"))
        told = told.filter(~F.col("drop")).withColumn("text", text).drop("tr")
        if not self._exists(f"{to}-notes"):
            return told
        # a mark after the first of its terms, or at the block's end, and the note as a block of its own
        n = self._table(f"{to}-notes").select("book_id", F.col("block").alias("id"), F.concat(F.lit("t-"), "block").alias("_note"), F.col("text").alias("_said"), "terms")
        both = told.join(n, ["book_id", "id"], "left")
        mark = F.concat(F.lit("[^"), "_note", F.lit("]"))
        put = R.anchored(F.col("text"), F.coalesce("terms", F.array().cast("array<string>")), mark)
        marked = both.withColumn("text", F.when(F.col("_note").isNull(), F.col("text")).when(put.contains(mark), put).otherwise(F.concat("text", mark)))
        own = both.filter("_note is not null").select(*[F.lit("note").alias(c) if c == "kind" else F.col("_said").alias(c) if c == "text" else F.col("_note").alias(c) if c in ("id", "note_id") else F.array().cast("array<string>").alias(c) if c == "links" else F.col(c) for c in told.columns])
        return marked.select(*told.columns).unionByName(own)

    def build(self, to: str, kind: str, partial: bool = False) -> DataFrame:
        """(book_id, name, content) of each book; also written beside the work as files of bytes."""
        b = self.current(to, partial)
        lacks = b.filter(F.col("text").isNull()).count()
        if lacks:
            raise ValueError(f"{lacks} blocks have no translation")
        if kind == "txt":
            return writers.render_text(b, "book_id").select("book_id", F.concat("book_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
        return writers.render(b, "book_id", kind)

    def qa(self, to: str, source_lang: str = "en") -> dict[str, int]:
        """How many blocks lack a translation, numbers are lost without excuse, and note marks are gone."""
        done = self._done(to)
        b = self.translatable().select("book_id", "id", F.col("text").alias("src"))
        pairs = b.join(done.select("book_id", "id", "tr"), ["book_id", "id"], "left") if done is not None else b.withColumn("tr", F.lit(None).cast("string"))
        both, key = pairs.filter("tr is not null"), ["book_id", "id"]
        numbers = checks.number_check(both, key, source_lang, to)
        return {
            "missing": pairs.filter("tr is null").count(),
            "numbers": numbers.filter("side = 'lost' and excuse is null").count(),
            "marks": checks.note_marks(both, key).count(),
        }

    def run(self, path: str, to: str, steps: tuple[str, ...] = STEPS, kind: str = "md", partial: bool = False, guarded: bool = False) -> dict:
        """The steps in order; what the last two give.  ``guarded``: refuse to translate what can't be meant."""
        out: dict = {}
        if "read" in steps:
            self.read(path)
        if guarded and "translate" in steps:
            self.guard(to)
        if "translate" in steps:
            self.translate(to)
        if "edit" in steps:
            self.edit(to)
        if "notes" in steps:
            self.notes(to)
        if "build" in steps:
            out["books"] = self.build(to, kind, partial)
        if "qa" in steps:
            out["qa"] = self.qa(to)
        return out


def main(argv: list[str] | None = None) -> int:
    """``python -m quire.engine PATH --work DIR --to LANG [--only STEP …] [--kind md] [--dest DIR]``"""
    p = argparse.ArgumentParser(prog="quire")
    p.add_argument("path")
    p.add_argument("--work", required=True)
    p.add_argument("--to", default="en")
    p.add_argument("--only", action="append", choices=STEPS + MORE)
    p.add_argument("--with", dest="more", action="append", choices=MORE, default=[])
    p.add_argument("--skip", action="append", choices=STEPS, default=[])
    p.add_argument("--kind", default="md", choices=["txt", *writers.WRITERS])
    p.add_argument("--partial", action="store_true")
    p.add_argument("--force", action="store_true", help="translate even what hardly is a book, or is in the language already")
    p.add_argument("--tune", help="a file of thresholds, NAME = number")
    p.add_argument("--doctor", action="store_true", help="say which tools there are, and stop")
    p.add_argument("--chunk-words", type=int)
    p.add_argument("--dest", default=".")
    def stored(name: str) -> str:
        where = name if os.path.exists(name) else os.path.join(host.config_dir(), "profiles", name + ".conf")
        with open(where, encoding="utf-8") as f:
            return f.read()

    a = p.parse_args(host.with_profiles(sys.argv[1:] if argv is None else argv, stored))
    if a.doctor:
        print("\n".join(f"{tool}: {'there' if there else 'missing'} ({use})" for tool, use, there in host.doctor()))
        return 0
    th = host.tuned(stored(a.tune))[0] if a.tune else T
    if a.chunk_words is not None:
        th = dataclasses.replace(th, target_words=a.chunk_words, max_words=a.chunk_words * 7 // 5)
    engine = Engine(SparkSession.builder.getOrCreate(), a.work, thresholds=th)
    out = engine.run(a.path, a.to, tuple(s for s in [*(a.only or STEPS), *a.more] if s not in a.skip), a.kind, a.partial, not a.force)
    if "books" in out:
        os.makedirs(a.dest, exist_ok=True)
        for row in out["books"].select("name", "content").toLocalIterator():  # a book at a time
            with open(os.path.join(a.dest, row["name"]), "wb") as f:
                f.write(row["content"])
    if "qa" in out:
        print(", ".join(f"{k}: {v}" for k, v in out["qa"].items()))
        return int(any(out["qa"].values()))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
