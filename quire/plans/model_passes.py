"""Passes over a book by a model: structure, marks, corrections, reconnaissance, headings, notes, comments.

Each pass is grouped work: a window, a batch or a chunk is one request, and requests of a book
run side by side.  Agents are callables that are sent to the workers."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import similarity
from quire.functions import text as X
from quire.model import T, Thresholds
from quire.plans import answers, packing
from quire.plans.passes import Agent, request
from quire.plans.protocol import LABELS, records

MARKS = ("+", "+t", "title", "skip", "verse", "toc", "code")


def told_marks(out: str) -> dict[int, str]:
    """Lines ``N kind`` with a known kind."""
    lines = (x.split() for x in out.splitlines())
    return {int(x[0]): x[1] for x in lines if len(x) == 2 and x[0].isdecimal() and x[1] in MARKS}


def told_styles(out: str) -> dict[str, str]:
    """Lines ``tag|class = kind``; of a pair told twice the last counts."""
    lines = (x.partition("=") for x in out.splitlines() if "|" in x.partition("=")[0])
    pairs = ((k.strip(), v.strip().lower()) for k, _, v in lines)
    return {k: v for k, v in pairs if v in answers.STYLE_KINDS and k.partition("|")[0].isalnum()}


def told_titles(out: str) -> dict[int, str]:
    """Lines ``n. title``."""
    found = {}
    for line in out.splitlines():
        number, sign, rest = (line.partition(".") if line.strip().split(".")[0].isdecimal() else line.partition(")"))
        if sign and number.strip().isdecimal() and rest.strip():
            found[int(number)] = rest.strip()
    return found


def structure(census: list[tuple[str, str, int, list[str]]], agents: list[Agent]) -> dict[str, str]:
    """The kind of each (tag, class, count, samples) that the model names; others keep their own."""
    known = {f"{tag}|{cls}" for tag, cls, _, _ in census}
    listing = "\n".join(f"{tag}|{cls} {n}: {' / '.join(samples)}" for tag, cls, n, samples in census)

    def read(out: str) -> dict[str, str]:
        told = told_styles(out)
        if not told:
            raise ValueError("no line tag|class = kind")
        return {k: v for k, v in told.items() if k in known}

    return request(agents, "structure", listing, read)


def _grouped(df: DataFrame, by: list[str], work: Callable[[pd.DataFrame], list[tuple]], names: str) -> DataFrame:
    """``work`` on each group; its rows follow the group's key."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in by]
        rows = [(*key, *r) for r in work(pdf)]
        return pd.DataFrame(rows, columns=[*by, *(x.split()[0] for x in names.split(", "))], dtype=object)

    return df.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {types[c]}" for c in by), names]))


def mark_pieces(pieces: DataFrame, by: str, agents: list[Agent], th: Thresholds = T) -> DataFrame:
    """(by, n, mark) of pieces (by, n, text), n from 1: a window of so many pieces is a request."""

    def work(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.sort_values("n", kind="stable")
        lo, hi = int(pdf["n"].iloc[0]), int(pdf["n"].iloc[-1])

        def read(out: str) -> list[tuple]:
            return sorted((n, m) for n, m in told_marks(out).items() if lo <= n <= hi)

        return request(agents, "marks", "\n".join(f"{n} {t}" for n, t in zip(pdf["n"], pdf["shown"], strict=True)), read)

    shown = pieces.select(by, "n", X.show(F.regexp_replace("text", r"\s+", " ")).alias("shown"), F.expr(f"(n - 1) div {th.window}").alias("window"))
    return _grouped(shown, [by, "window"], work, "n long, mark string").drop("window")


def corrections(blocks: DataFrame, by: str, agents: list[Agent], th: Thresholds = T) -> DataFrame:
    """(by, id, old, new) that may be taken for blocks (by, pos, id, text) of scanned books."""
    sized = blocks.select(by, "pos", F.length("text").cast("long").alias("size"))
    batch = packing.plan_batches(sized, by, th.fix_chars).select(by, "pos", "batch")

    def work(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.sort_values("pos", kind="stable")
        texts = dict(zip(pdf["id"], pdf["text"], strict=True))
        prompt = "\n".join(f"[[[P {i}]]] {t}" for i, t in texts.items())
        told = request(agents, "correct", prompt, lambda out: [(r.args[0], r.fields.get("ORIG", ""), r.fields.get("FIX", "")) for r in records(out, "F", LABELS) if r.args])
        return [x for x in told if x[1] in texts.get(x[0], "") and similarity.fix_ok(x[1], x[2])]

    return _grouped(blocks.select(by, "pos", "id", "text").join(batch, [by, "pos"]), [by, "batch"], work, "id string, old string, new string").drop("batch")


def corrected(blocks: DataFrame, fixes: DataFrame, by: str) -> DataFrame:
    """Blocks with their corrections, longest first: a short one would spoil a longer one."""
    listed = F.array_sort(F.collect_set(F.struct((-F.length("old")).alias("k"), "old", "new")))
    told = fixes.groupBy(by, "id").agg(listed.alias("_fixes"))
    text = F.aggregate(F.coalesce("_fixes", F.array()), F.col("text"), lambda acc, x: F.replace(acc, x["old"], x["new"]))
    return blocks.join(told, [by, "id"], "left").withColumn("text", text).drop("_fixes")


def scout(parts: list[str], agents: list[Agent], budget: int = 24000, rounds: int = 3) -> str:
    """Findings of each part, merged, and condensed while they pass the budget by a quarter."""
    found = [request(agents, "scout", p, str.strip) for p in parts]
    whole = found[0] if len(found) == 1 else request(agents, "merge", "\n\n".join(found), str.strip) if found else ""
    for _ in range(rounds):
        if len(whole) <= budget * 5 // 4:
            break
        kept = table_names(whole)

        def read(out: str, kept=kept) -> str:
            if gone := kept - table_names(out):
                raise ValueError(f"rows are gone: {sorted(gone)[:5]}")
            return out.strip()

        shorter = request(agents, "condense", whole, read)
        if len(shorter) >= len(whole):
            break
        whole = shorter
    return whole


def table_names(text: str) -> set[str]:
    """First cells of the rows of Markdown tables, without marks and spaces."""
    rows = (x for x in text.splitlines() if x.startswith("|") and x.count("|") > 2 and "---" not in x)
    return {re.sub(r"[\s*`_~]+", "", x.split("|")[1]).lower() for x in rows}


def headings(blocks: DataFrame, by: str, agents: list[Agent], th: Thresholds = T) -> DataFrame:
    """(by, text, title): each distinct heading of a book translated once, so many to a request."""
    distinct = blocks.filter(F.col("kind").isin("title", "subtitle")).groupBy(by, "text").agg(F.min("pos").alias("pos"))
    numbered = distinct.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("pos", "text")) - 1)

    def work(pdf: pd.DataFrame) -> list[tuple]:
        texts = pdf.sort_values("n", kind="stable")["text"].tolist()

        def read(out: str) -> list[tuple]:
            told = told_titles(out)
            if lacks := [t for k, t in enumerate(texts, 1) if k not in told]:
                raise ValueError(f"{len(lacks)} headings are missing: {lacks[:3]}")
            return [(t, told[k]) for k, t in enumerate(texts, 1)]

        return request(agents, "headings", "\n".join(f"{k}. {' '.join(t.split())}" for k, t in enumerate(texts, 1)), read)

    return _grouped(numbered.withColumn("batch", F.expr(f"n div {th.window}")), [by, "batch"], work, "text string, title string").drop("batch")


def notes(blocks: DataFrame, by: str, agents: list[Agent], explained: tuple[str, ...] = ()) -> DataFrame:
    """(by, chunk, block, kind, term, text) for blocks (by, chunk, pos, id, text); known terms are told and left out."""
    known = {t.lower() for t in explained}

    def work(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.sort_values("pos", kind="stable")
        ids = set(pdf["id"])
        prompt = "\n".join([*(["Known: " + ", ".join(explained)] if explained else []), *(f"[[[P {i}]]] {t}" for i, t in zip(pdf["id"], pdf["text"], strict=True))])
        told = request(agents, "notes", prompt, lambda out: [(*r.args, r.fields.get("TERM", ""), r.fields.get("TEXT", "")) for r in records(out, "NOTE", LABELS) if len(r.args) == 2 and r.args[1] in answers.NOTE_KINDS])
        return [x for x in told if x[0] in ids and x[2].lower() not in known]

    return _grouped(blocks.select(by, "chunk", "pos", "id", "text"), [by, "chunk"], work, "block string, kind string, term string, text string")


def listings(blocks: DataFrame, by: str, agents: list[Agent], th: Thresholds = T) -> DataFrame:
    """(by, id, text, replaced): listings (by, pos, id, text) with translated comments, so many lines to a request."""
    sized = blocks.select(by, "pos", F.size(F.split("text", "\n")).cast("long").alias("size"))
    batch = packing.plan_batches(sized, by, th.code_lines).select(by, "pos", "batch")

    def work(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.sort_values("pos", kind="stable")
        prompt = "\n".join(f"[[[P {i}]]] {t}" for i, t in zip(pdf["id"], pdf["text"], strict=True))
        told = request(agents, "comments", prompt, lambda out: [(r.args[0], int(r.args[1]), r.fields.get("ORIG", ""), r.fields.get("TR", "")) for r in records(out, "C", LABELS) if len(r.args) == 2 and r.args[1].isdecimal()])
        return [(i, *similarity.splice(t, [x[1:] for x in told if x[0] == i])) for i, t in zip(pdf["id"], pdf["text"], strict=True)]

    return _grouped(blocks.select(by, "pos", "id", "text").join(batch, [by, "pos"]), [by, "batch"], work, "id string, text string, replaced int").drop("batch")
