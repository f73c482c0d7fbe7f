"""Reply trees: root-to-leaf paths, their ranks, and conversations formatted from them.

Ancestors are found by self-joins that double their reach: after k rounds a message knows
its ancestor 2**k steps up, and the score and root of what lies between.  Leaves
are then ranked within their trees by the score of their path, and only the chosen paths
are enumerated, by the same jump tables from the longest to the shortest: each ancestor is
reached exactly once.  Joins are by message, so a large tree is no hot key.

A turn is written as ``### role: text</turn>`` and a line feed.  Inside roles and texts a
backslash doubles, and one is put before ``###`` and ``</turn>`` (in roles before ``:``), so
parsing gives back every turn.  The loss mask is a list of ranges of code points, one for
each assistant text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._text import lean
from quire.llm._frames import col, table
from quire.llm._scratch import Scratch, shuffle_parts

TOP = 4
PROBE = "\\### Assistant: </turn> ok"
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Roles and texts as one string, and the ranges of it that the loss covers."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"### {escape(role).replace(':', '\\:')}: ", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """What format_turns was given."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def chains(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Flat conversations as messages (conv, node, parent, role, text, score): each turn replies to the one before it.

    Turns are in order of turn, role, text, nulls first; a null conversation is one too.
    A global sort numbers the messages, so a long conversation is spread over tasks.
    """
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark, "chains")
    named = turns.select(*[col(turns, c).alias(n) for c, n in ((conv_col, "conv"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    order = ["conv", "turn", "role", "text"]
    rows = named.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id())
    rows = scratch.stage(rows, "turns")
    parts = rows.groupBy(F.shiftright("node", 33).alias("part")).agg(F.min("node").alias("node"), F.max("node").alias("last"))
    heads = parts.select("node", F.lag("last").over(Window.orderBy("part")).alias("before"))  # a row for each task
    before = rows.select((F.col("node") + 1).alias("node"), F.col("node").alias("before")).unionByName(heads.filter("before is not null"))
    linked = rows.join(before, "node", "left").alias("r").join(rows.select(F.col("node").alias("before"), F.col("conv").alias("conv_before"), F.lit(True).alias("there")), "before", "left")
    parent = F.when(F.col("there") & F.col("conv").eqNullSafe(F.col("conv_before")), F.col("before"))
    return linked.select("conv", "node", parent.alias("parent"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, top: int = TOP, scratch: Scratch | None = None) -> DataFrame:
    """From (node long, parent long, score): the chosen paths as rows (root, leaf, rank, path_score, step, node).

    Step counts down to 0 at the leaf.  Paths are ranked by the sum of their scores (null: 0),
    ties to the smaller leaf.  A parent that isn't there makes a root; messages in or under a
    cycle have no root and are on no path.  Repeated nodes must be removed by the caller.
    """
    scratch = scratch or Scratch(messages.sparkSession, "paths")
    nodes = messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("node").alias("parent"), F.col("node").alias("up"))
    state = nodes.join(known, "parent", "left").select("node", "up", "score", F.when(F.col("up").isNull(), F.col("node")).alias("root"))
    state = scratch.stage(state, "reach0")
    n = state.count()
    jumps, k = [], 0
    while (1 << k) <= n:
        # only messages that haven't reached their root go on
        going = state.filter("up is not null")
        if going.isEmpty():
            break
        jumps.append(going.select("node", "up"))
        far = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("root").alias("root2"))
        moved = going.join(far, "up").select("node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), F.coalesce("root", "root2").alias("root"))
        k += 1
        state = scratch.stage(state.filter("up is null").unionByName(moved), f"reach{k}")
    leaves = state.filter("root is not null").join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    order = Window.partitionBy("root").orderBy(F.desc("score"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    paths = scratch.stage(chosen.select("root", F.col("node").alias("leaf"), "rank", F.col("score").alias("path_score"), F.lit(0).cast("long").alias("step"), "node"), "chosen")
    for k in reversed(range(len(jumps))):
        up = paths.join(jumps[k], "node").withColumn("step", F.col("step") + (1 << k)).withColumn("node", F.col("up")).drop("up")
        paths = scratch.stage(paths.unionByName(up.select(*paths.columns)), f"paths{k}")
    return paths


FORMATTED = "conv {conv}, root long, leaf long, rank int, path_score double, n_turns long, formatted string, loss_spans array<struct<begin:int,end:int>>"


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """Each path as one conversation: formatted, with n_turns and loss_spans.

    A path is one row of the result, so its turns meet in one task.
    """
    rows = paths.join(messages.select("node", "conv", "role", "text"), "node")
    whole = rows.groupBy("leaf").agg(
        F.first("conv").alias("conv"),
        F.first("root").alias("root"),
        F.first("rank").alias("rank"),
        F.first("path_score").alias("path_score"),
        F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("at"), "role", "text"))).alias("turns"),
    )

    def run(batches):
        for batch in batches:
            texts, spans, counts = [], [], []
            for turns in batch.column("turns"):
                made, loss = format_turns([(t["role"].as_py() or "", t["text"].as_py() or "") for t in turns.values])
                texts.append(made)
                spans.append([{"begin": a, "end": b} for a, b in loss])
                counts.append(len(turns.values))
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            first = [batch.column(c) for c in ("conv", "root", "leaf", "rank", "path_score")]
            yield pa.RecordBatch.from_arrays([*first, pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv", "root", "leaf", "rank", "path_score", "n_turns", "formatted", "loss_spans"])

    return whole.mapInArrow(lean(run), FORMATTED.format(conv=dict(whole.dtypes)["conv"]))


def format_conversations(turns: DataFrame, top: int = TOP, **columns) -> DataFrame:
    """Flat conversations, each as one formatted row (see ``chains`` for nulls, ties and repeats)."""
    scratch = Scratch(turns.sparkSession, "chat")
    messages = scratch.stage(chains(turns, scratch=scratch, **columns), "messages")
    return format_paths(messages, reply_paths(messages, top, scratch))


def _digests(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        out = []
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv", "formatted", "loss_spans")), strict=True):
            turns = parse_turns(text)
            loss = "".join(unescape(text[s["begin"] : s["end"]]) for s in spans)
            said = "".join(f"{role}\n{body}\n" for role, body in turns)
            out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)


def query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    made = format_conversations(turns.unionByName(probe))
    return made.mapInArrow(lean(_digests), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS et,
  replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS er FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
