"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins at quantiles.  Shallow trees over the bins of one
feature at a time are boosted in cycles, and their sum is one lookup table for each
feature.  The pairs that explain most of what is left are found on a coarse grid, and their
two-way tables are boosted in cycles too.  A score is the sum of the looked-up values
through the logistic function, so scoring is additions over arrays of bins.

Training sees the features of a bounded sample, on the driver; features are made by the
tasks that read the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._frames import col, table
from quire.llm._labels import fold, training_rows
from quire.llm._scratch import small_batches
from quire.llm._text import byte_hashes, groups, lean, runs_of_rows, utf8, words

#: Training documents of each label.
PER_CLASS = 10_000
FEATURES = ("words", "word_length", "symbols", "pipes", "digits", "capitals", "stops", "beyond_ascii", "repeated_lines", "distinct_words", "line_length", "commonest_word")
BINS, CYCLES, RATE, LEAVES = 32, 120, 0.15, 4
PAIRS, PAIR_CYCLES, GRID = 6, 40, 8
RIDGE, LEAST = 2.0, 5
THRESHOLD = 0.5


def _share(data: np.ndarray, at: np.ndarray, chars: str | None) -> np.ndarray:
    """The share of a text's bytes that are among ``chars``, or beyond ASCII."""
    flag = data >= 0x80 if chars is None else np.isin(data, np.frombuffer(chars.encode(), np.uint8))
    total = np.r_[0, np.cumsum(flag)]
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(1, np.diff(at))


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; texts without words have zeros where words are asked for."""
    n = len(at) - 1
    start, end, row = words(data, at)
    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    (h,) = byte_hashes(data, start, end)
    order, first = groups(row, h)
    kinds = np.bincount(row[order[first]], minlength=n)
    often = np.zeros(n)
    np.maximum.at(often, row[order[first]], np.diff(np.r_[first, len(order)]))
    # lines with a word: from the first byte of the line to its end
    feed = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.r_[at[:-1][np.diff(at) > 0], feed + 1])
    begin = begin[begin < len(data)]
    stop = np.minimum(np.r_[begin[1:], len(data)], at[np.searchsorted(at, begin, "right")]) if len(begin) else begin
    trimmed = stop - (data[np.maximum(stop - 1, 0)] == 0x0A) if len(begin) else stop
    full = np.searchsorted(start, trimmed, "left") > np.searchsorted(start, begin, "left") if len(begin) else np.zeros(0, bool)
    begin, trimmed = begin[full], trimmed[full]
    line_row = np.searchsorted(at, begin, "right") - 1
    lines = np.bincount(line_row, minlength=n)
    (lh,) = byte_hashes(data, begin, trimmed)
    lo, lf = groups(line_row, lh)
    alone = np.bincount(line_row[lo[lf]], minlength=n)
    return np.stack(
        [
            np.log1p(count),
            np.bincount(row, weights=end - start, minlength=n) / some,
            _share(data, at, "#*$%&<>"),
            _share(data, at, "|"),
            _share(data, at, "0123456789"),
            _share(data, at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            _share(data, at, ".,;:!?"),
            _share(data, at, None),
            1 - alone / np.maximum(lines, 1) * (lines > 0) - (lines == 0),
            kinds / some,
            np.log1p(np.diff(at) / np.maximum(lines, 1)),
            often / some,
        ],
        axis=1,
    )


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of at most LEAVES leaves over ordered bins, from sums of gradients."""
    spans, out = [(0, len(g))], np.zeros(len(g))
    G, H, N = (np.r_[0, np.cumsum(x)] for x in (g, h, n))
    worth = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + RIDGE)
    while len(spans) < LEAVES:
        best = (1e-9, None, None)
        for a, b in spans:
            cut = np.arange(a + 1, b)
            cut = cut[(N[cut] - N[a] >= LEAST) & (N[b] - N[cut] >= LEAST)]
            if len(cut):
                gain = worth(a, cut) + worth(cut, b) - worth(a, b)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], (a, b), int(cut[i]))
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    for a, b in spans:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + RIDGE)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts each of two features once."""
    G, H = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best, at = -1.0, (1, 1)

    def parts(X, i, j):
        return X[i, j], X[i, -1] - X[i, j], X[-1, j] - X[i, j], X[-1, -1] - X[i, -1] - X[-1, j] + X[i, j]

    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            gain = sum(a * a / (b + RIDGE) for a, b in zip(parts(G, i, j), parts(H, i, j), strict=True))
            if gain > best:
                best, at = gain, (i, j)
    i, j = at
    v = [a / (b + RIDGE) for a, b in zip(parts(G, i, j), parts(H, i, j), strict=True)]
    out = np.empty_like(g)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best - G[-1, -1] ** 2 / (H[-1, -1] + RIDGE), out


class Gam:
    """Cuts and tables; one table for each feature and each chosen pair."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, GRID + 1)[1:-1])) for c in x.T]
        bins, grid = self._bins(x, self.cuts), self._bins(x, self.coarse)
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        f = np.full(len(y), self.base)
        for _ in range(CYCLES):
            for j, t in enumerate(self.tables):
                q = _sigmoid(f)
                b, n = bins[:, j], len(t)
                step = RATE * _tree(np.bincount(b, y - q, n), np.bincount(b, q * (1 - q), n), np.bincount(b, minlength=n))
                t += step
                f += step[b]
        q, found = _sigmoid(f), []
        for i in range(x.shape[1]):
            for j in range(i + 1, x.shape[1]):
                found.append((_quarters(*self._two(grid, i, j, y - q, q * (1 - q)))[0], i, j))
        self.pairs = {(i, j): np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)) for _, i, j in sorted(found, reverse=True)[:PAIRS]}
        for _ in range(PAIR_CYCLES):
            for (i, j), t in self.pairs.items():
                q = _sigmoid(f)
                step = RATE * _quarters(*self._two(grid, i, j, y - q, q * (1 - q)))[1]
                t += step
                f += step[grid[:, i], grid[:, j]]

    @staticmethod
    def _bins(x, cuts):
        return np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], axis=1)

    def _two(self, grid, i, j, g, h):
        a, b = len(self.coarse[i]) + 1, len(self.coarse[j]) + 1
        at = grid[:, i] * b + grid[:, j]
        return np.bincount(at, g, a * b).reshape(a, b), np.bincount(at, h, a * b).reshape(a, b)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, grid = self._bins(x, self.cuts), self._bins(x, self.coarse)
        f = np.full(len(x), self.base)
        for j, t in enumerate(self.tables):
            f += t[bins[:, j]]
        for (i, j), t in self.pairs.items():
            f += t[grid[:, i], grid[:, j]]
        return _sigmoid(f)


def _rows_of(column):
    data, at = utf8(column)
    out = [np.zeros((0, len(FEATURES)))]
    for lo, hi in runs_of_rows(at, 4 << 20):
        out.append(features(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]))
    return np.concatenate(out)


def _features_task(batches):
    for batch in batches:
        x = _rows_of(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("label"), *[pa.array(c) for c in x.T]], ["label", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Gam | float:
    """A model; with labels of one kind only, or none, their share."""
    rows = training_rows(docs, labels, label, per_class, id_col, text_col).mapInArrow(lean(_features_task), "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    m = np.stack([c.to_numpy() for c in rows.columns], axis=1).astype(float) if rows.num_rows else np.zeros((0, 1 + len(FEATURES)))
    m = m[np.lexsort(m.T)]  # the same sums whatever the order of tasks
    y = m[:, 0]
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    return Gam(m[:, 1:], y)


def score(docs: DataFrame, model: Gam | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): null and empty texts score as texts without words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).cast("string").alias("t"))

    def run(batches):
        known = shared.value
        for batch in batches:
            s = np.full(batch.num_rows, known) if isinstance(known, float) else known.score(_rows_of(batch.column("t")))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s)], ["id", "score"])

    return rows.mapInArrow(lean(run), f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """Per row: the id, held_out, score (0 to 1) and predicted (score of THRESHOLD or more).

    Labels of fold 1 are never seen.  A null id is not held out; repeated rows score alike, and
    in training a repeated id is one example.  Null and empty texts score as texts without words;
    the features of a very long one are of all of it.  Only ids and texts are read.  An empty
    table gives no rows; without labels of both kinds the score is a constant.
    """
    out = score(docs, train(docs, labels, label, per_class, id_col, text_col), id_col, text_col)
    held = F.coalesce(fold(F.col("`" + id_col + "`")) == 1, F.lit(False))
    return out.select(F.col("`" + id_col + "`"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
