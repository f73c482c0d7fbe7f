"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows: a component that isn't zero is a posting of its term (the
component's number).  A task turns a batch of rows into postings by term and keeps a dense
array of scores; each term of a query scatters its weighted postings into it.  A partition
selection leaves the k best of the batch, these merge with the task's best so far, and the
bests of all tasks merge in a window by query.

Queries are taken in blocks of bounded size, each of which is broadcast for one pass over
the vectors; a pass sends k rows per query and task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm._text import lean
from quire.llm._frames import col, table
from quire.llm._scratch import Scratch

#: Queries of one pass, and components that they may hold together (8 bytes each).
BLOCK, BLOCK_COMPONENTS = 8192, 1 << 20


def _postings(values: np.ndarray, at: np.ndarray):
    """By term: the rows that have it and their weights, zeros left out."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    term = np.arange(len(values)) - np.repeat(at[:-1], np.diff(at))
    live = values != 0
    row, term, values = row[live], term[live], values[live]
    order = np.argsort(term, kind="stable")
    row, term, values = row[order], term[order], values[order]
    names, first = np.unique(term, return_index=True)
    last = [*first[1:], len(term)]
    return {int(t): (row[a:b], values[a:b]) for t, a, b in zip(names, first, last, strict=True)}


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _score(queries, k: int):
    def run(batches):
        block = queries.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in block]
        for batch in batches:
            ids = batch.column("id").to_numpy()
            vectors = batch.column("v")
            at = vectors.offsets.to_numpy().astype(np.int64)
            terms = _postings(vectors.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0])
            for q, (_, own, weights) in enumerate(block):
                scores = np.zeros(len(ids), np.int64)
                for t in np.flatnonzero(weights):
                    if (hit := terms.get(int(t))) is not None:
                        rows, values = hit
                        if len(rows) == len(ids):
                            scores += weights[t] * values
                        else:
                            scores[rows] += weights[t] * values
                other = ids != own
                s, i = (scores, ids) if other.all() else (scores[other], ids[other])
                top = _best(s, i, k)
                s, i = np.concatenate([best[q][0], s[top]]), np.concatenate([best[q][1], i[top]])
                top = _best(s, i, k)
                best[q] = s[top], i[top]
        n = [len(s) for s, _ in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat([q for q, _, _ in block], n)),
                    pa.array(np.repeat([own for _, own, _ in block], n)),
                    pa.array(np.concatenate([i for _, i in best])),
                    pa.array(np.concatenate([s for s, _ in best])),
                ],
                ["q", "query_id", "vec_id", "score"],
            )

    return lean(run)


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """For each row that satisfies ``is_query``: query_id, rank, vec_id and score of the k best others.

    A component x counts as floor(scale * x), the score is the integer inner product (modulo
    2**64) over the terms that both vectors have.  Ties go to the smaller id.  Vectors that
    are null or hold a null or non-finite component, and rows without an id, take no part.
    An empty vector scores 0 with all.  Rows with the query's id are its own and no
    candidates; repeated ids are otherwise rows like others, and a repeated query row is
    answered each time.  Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    named = vectors.select(col(vectors, id_col).cast("long").alias("id"), col(vectors, vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = named.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite)
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    asked = scratch.stage(rows.filter(is_query(F.col("id"))), "queries")
    passes, block, size, n = [], [], 0, 0

    def ask():
        shared = spark.sparkContext.broadcast(list(block))
        passes.append(scratch.stage(rows.mapInArrow(_score(shared, k), "q long, query_id long, vec_id long, score long"), f"pass{len(passes)}"))
        shared.unpersist()

    for r in asked.toLocalIterator():
        block.append((n, r["id"], np.array(r["v"], np.int64)))
        n, size = n + 1, size + len(r["v"])
        if len(block) >= BLOCK or size >= BLOCK_COMPONENTS:
            ask()
            block, size = [], 0
    if block or not passes:
        ask()
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
