"""Removal of byte strings that repeat anywhere in a corpus.

A depth-limited radix sort of suffixes, most significant digit first.  Two suffixes are
told apart only through their first ``length`` bytes, so the equal groups that remain at
that depth are exactly the repeated windows.  Sorting every suffix by its leading bytes
would move many times the corpus, so the first digit is chosen by content:

1. *Anchor gram.*  In every window of ``length`` bytes the gram of ``gram`` bytes with the
   smallest hash (the leftmost of equal ones) is its anchor.  Equal windows have equal
   anchors at equal places, so windows are dealt by their anchor's gram, and one record
   stands for all windows of an anchor.  A gram that occurs once leaves with all of these.
2. *Bytes.*  For the others a row holds the bytes that the anchor's windows cover.  The
   rows of a gram meet in one task, which orders them by the bytes from the gram on, eight
   at a time, and by those before it; rows alone in their group leave after each digit.
   Windows are equal where both orders agree as far as the window goes.
3. *Deeper digits.*  A gram with many contexts in a task (``CROWD``) would be a hot group.
   Its rows are cut into the two halves of their windows; all windows of a half share more
   than the gram, and this longer string is the next digit by which they are dealt.  So it
   goes on, to whole windows at last, one pass for each digit and for crowds alone.

Hashes choose anchors and deal rows; that strings are equal is always read from the bytes.
Before a shuffle each task resolves rows that are equal within it and sends one of them,
so a passage that a third of all documents hold is no large group anywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._frames import col, fresh, keyed
from quire.llm._scratch import Scratch, shuffle_parts, small_join
from quire.llm._text import U, byte_hashes, groups, lean, mix, packed, rolling, runs_of_rows, same_bytes, utf8

LENGTH, GRAM = 200, 64
#: Contexts of one digit within a task from which its rows go on to the next digit.
CROWD = 16
#: Anchors, and bytes of rows, that a task holds before it resolves and sends them.
HELD, BODIES = 250_000, 8 << 20
#: Rows that are ordered together, but for those of one digit.
TOGETHER = 1 << 15
#: Bytes of text that are hashed together; a power of two.
PIECE = 1 << 18

ANCHOR = np.dtype([("h", "<u8"), ("k", "<i8"), ("s", "<i4"), ("e", "<i4"), ("a", "<i4"), ("f", "u1")])
#: Of a text: first and last start of the windows of an anchor, and its place.
PLACE = np.dtype([("k", "<i8"), ("s", "<i4"), ("e", "<i4"), ("a", "<i4")])
ROW = np.dtype([("h", "<u8"), ("k", "<i8"), ("s", "<i4"), ("e", "<i4"), ("a", "<i4"), ("f", "u1")])
SPAN = np.dtype([("k", "<i8"), ("s", "<i4"), ("e", "<i4")])
#: Alone in its task, one for several, and a mark that a digit is crowded.
ONE, MANY, CROWDED = 0, 1, 2
#: Kinds of blobs; rows of digit d have kind ROWS + d.
ANCHORS, PLACES, SPANS, ROWS = 0, 1, 2, 8
BLOBS = "bucket int, kind int, data binary, body binary"


def _spans(k, s, e) -> np.ndarray:
    out = np.empty(len(k), SPAN)
    out["k"], out["s"], out["e"] = k, s, e
    return out


def merged(x: np.ndarray) -> np.ndarray:
    """The union of byte ranges, as maximal ranges by key."""
    if not len(x):
        return x
    x = x[np.lexsort((x["s"], x["k"]))]
    new_key = np.r_[True, x["k"][1:] != x["k"][:-1]]
    shift = np.cumsum(new_key).astype(np.int64) << 32
    start, end = x["s"] + shift, np.maximum.accumulate(x["e"] + shift)
    first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    last = np.r_[first[1:], len(x)] - 1
    return _spans(x["k"][first], x["s"][first], (end[last] - shift[last]).astype(np.int64))


def _pieces(at: np.ndarray, length: int):
    """(first byte, last byte, first row, last row) of pieces of at most PIECE bytes; every window lies in one."""
    for lo, hi in runs_of_rows(at, PIECE):
        if at[hi] - at[lo] <= PIECE:
            yield int(at[lo]), int(at[hi]), lo, hi
        else:
            step = PIECE - length + 1
            for b in range(int(at[lo]), int(at[hi]) - length + 1, step):
                yield b, min(b + PIECE, int(at[hi])), lo, hi


def anchors_of(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Of one piece: gram hash, first and last window start, and place of each anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(U), none, none, none
    g = rolling(data, gram)
    place = U(PIECE - 1)
    m = (g & ~place) | np.arange(len(g), dtype=U)
    span, width = 1, length - gram + 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if width > span:
        m = np.minimum(m[: -(width - span)], m[width - span :])
    ends = np.repeat(at[1:], np.diff(at))[: n - length + 1]
    s = np.flatnonzero(np.arange(n - length + 1) + length <= ends)
    if not len(s):
        return none.astype(U), none, none, none
    a = (m[s] & place).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1)])
    s1, s2, a = s[first], s[np.r_[first[1:], len(s)] - 1], a[first]
    return g[a], s1, s2, a


# -- blobs: records by bucket, rows with their bytes


def _bucket(key: np.ndarray, parts: int) -> np.ndarray:
    return (mix(key.astype(U) + U(7)) % U(parts)).astype(np.int64)


def _blobs(kind: int, x: np.ndarray, parts: int) -> pa.RecordBatch:
    which, data = packed(_bucket(x["h" if kind == ANCHORS else "k"].view(U), parts), x)
    return _table(which, kind, data, [None] * len(data))


def _table(which, kind: int, data: list, body: list) -> pa.RecordBatch:
    arrays = [pa.array(which, pa.int32()), pa.array(np.full(len(data), kind, np.int32)), pa.array(data, pa.binary()), pa.array(body, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "kind", "data", "body"])


def _passed(batch: pa.RecordBatch, which: list[bool]) -> pa.RecordBatch:
    """Blobs that go on as they are."""
    kept = batch.filter(pa.array(which, pa.bool_()))
    return pa.RecordBatch.from_arrays(kept.columns, kept.schema.names)


def _sizes(x: np.ndarray, length: int) -> np.ndarray:
    return np.where(x["f"] == CROWDED, 0, x["e"].astype(np.int64) - x["s"] + length)


def _take(flat: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    return flat[np.repeat(off - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Rows:
    """Rows of one digit: records, and where the bytes of each begin in ``flat``."""

    def __init__(self, x: np.ndarray, flat: np.ndarray, off: np.ndarray, digit: int):
        self.x, self.flat, self.off, self.digit = x, flat, off, digit

    def __len__(self):
        return len(self.x)

    def some(self, which: np.ndarray) -> Rows:
        return Rows(self.x[which], self.flat, self.off[which], self.digit)

    def blobs(self, parts: int, length: int) -> pa.RecordBatch:
        bucket = _bucket(self.x["h"], parts)
        order = np.argsort(bucket, kind="stable")
        x, bucket = self.x[order], bucket[order]
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        size = _sizes(x, length)
        raw = _take(self.flat, self.off[order], size)
        at = np.r_[0, np.cumsum(size)]
        ends = [*first[1:], len(x)]
        return _table(bucket[first].astype(np.int32), ROWS + self.digit, [x[a:b].tobytes() for a, b in zip(first, ends, strict=True)], [raw[at[a] : at[b]].tobytes() for a, b in zip(first, ends, strict=True)])


class Digits:
    """How the windows of an anchor are divided, digit by digit: cells of neighbouring offsets of the anchor in its window."""

    def __init__(self, length: int, gram: int, crowd: int = CROWD):
        self.length, self.offsets, self.crowd = length, length - gram + 1, crowd
        self.last = int(np.ceil(np.log2(self.offsets))) if self.offsets > 1 else 0

    def cells(self, x: np.ndarray, digit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cell of each row, and the least and greatest offset in it."""
        bounds = self.offsets * np.arange((1 << digit) + 1) >> digit
        cell = np.searchsorted(bounds, x["a"].astype(np.int64) - x["s"], "right") - 1
        return cell, bounds[cell], bounds[cell + 1] - 1

    def dealt(self, rows: Rows) -> Rows:
        """The same rows with the hash of the string that all windows of their cell share."""
        if not len(rows):
            return rows
        cell, least, most = self.cells(rows.x, rows.digit)
        begin = rows.off + (rows.x["a"].astype(np.int64) - rows.x["s"] - least)
        (h,) = byte_hashes(rows.flat, begin, begin + self.length - (most - least))
        rows.x["h"] = mix(h + cell.astype(U) * U(0xD1342543DE82EF95) + U(rows.digit))
        return rows

    def cut(self, rows: Rows) -> Rows:
        """The rows by the two halves of their cells, dealt by the next digit."""
        x, digit = rows.x, rows.digit + 1
        cell, _, _ = self.cells(x, rows.digit)
        middle = self.offsets * (2 * cell + 1) >> digit
        near, far = x["a"].astype(np.int64) - x["e"], x["a"].astype(np.int64) - x["s"]
        low, high = near < middle, far >= middle
        a, b = x[low].copy(), x[high].copy()
        a["s"] = a["a"] - np.minimum(far, middle - 1)[low]
        b["e"] = b["a"] - np.maximum(near, middle)[high]
        off = np.r_[rows.off[low] + (a["s"] - x["s"][low]), rows.off[high]]
        return self.dealt(Rows(np.concatenate([a, b]), rows.flat, off, digit))

    def twins(self, rows: Rows) -> tuple[np.ndarray, Rows]:
        """Ranges of the rows that are equal to another, and one row of each kind."""
        x = rows.x
        size = _sizes(x, self.length)
        (h,) = byte_hashes(rows.flat, rows.off, rows.off + size)
        order, first = groups(x["h"], h, x["a"] - x["s"], size)
        count = np.diff(np.r_[first, len(x)])
        lead = order[np.repeat(first, count)]
        same = same_bytes(rows.flat, rows.off[order], rows.off[lead], size[order])  # of two kinds under a hash one stays as it is
        lone = np.repeat(count, count) == 1
        again = same & ~lone
        again &= np.repeat(np.add.reduceat(same, first) > 1, count) if len(first) else again
        hit = x[order[again]]
        hit = hit[hit["f"] == ONE]
        kept = (order == lead) | ~same
        out = rows.some(order[kept])
        out.x["f"] = np.where(again[kept], MANY, out.x["f"])
        return _spans(hit["k"], hit["s"], hit["e"] + self.length), out

    def crowds(self, rows: Rows) -> np.ndarray:
        """Whether each row's digit has many kinds of rows."""
        order, first = groups(rows.x["h"])
        count = np.diff(np.r_[first, len(order)])
        out = np.zeros(len(order), bool)
        out[order] = np.repeat(count >= self.crowd, count)
        return out

    def windows(self, rows: Rows) -> np.ndarray:
        """Ranges of the windows that another row has as well, for rows of one digit; rows that stand for several need none."""
        found = [np.zeros(0, SPAN)]
        order, first = groups(rows.x["h"])
        count = np.diff(np.r_[first, len(order)])
        order = order[np.repeat(count > 1, count)]
        h = rows.x["h"][order]
        lo = 0
        while lo < len(order):
            hi = min(len(order), lo + TOGETHER)
            if hi < len(order):  # up to the end or the beginning of a digit
                back = int(np.searchsorted(h[lo:hi], h[hi])) + lo
                hi = back if back > lo else int(np.searchsorted(h[lo:], h[lo], "right")) + lo
            found.append(merged(self._equal(rows.some(order[lo:hi]))))
            lo = hi
        return np.concatenate(found)

    def _equal(self, rows: Rows) -> np.ndarray:
        x, length, n = rows.x, self.length, len(rows)
        cell, least, most = self.cells(x, rows.digit)
        wide = int((most - least).max())
        # in a row of the matrix the string that the digit's windows share begins at ``wide``
        size = _sizes(x, length)
        m = np.zeros((n, wide + length), np.uint8)
        begin = wide - (x["a"].astype(np.int64) - x["s"] - least)
        place = np.repeat(np.arange(n) * m.shape[1] + begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        m.ravel()[place] = _take(rows.flat, rows.off, size)
        _, group = np.unique(np.stack([x["h"], cell.astype(U)], axis=1), axis=0, return_inverse=True)
        after, before = _Order(group.ravel(), m[:, wide:]), _Order(group.ravel(), m[:, :wide][:, ::-1])
        near, far, one = x["a"].astype(np.int64) - x["e"] - least, x["a"].astype(np.int64) - x["s"] - least, x["f"] == ONE
        out = []
        for d in range(wide + 1):
            has = np.flatnonzero((near <= d) & (d <= far))
            if len(has) < 2:
                continue
            kind = (after.classes(length - d)[has] << 32) | before.classes(d)[has]
            order = np.argsort(kind, kind="stable")
            same = kind[order][1:] == kind[order][:-1]
            hit = has[order[np.r_[same, False] | np.r_[False, same]]]
            hit = hit[one[hit]]
            s = x["a"][hit] - least[hit] - d
            out.append(_spans(x["k"][hit], s, s + length))
        return np.concatenate([np.zeros(0, SPAN), *out])


class _Order:
    """Rows of bytes in order within their groups, by digits of eight bytes, the most significant first."""

    def __init__(self, group: np.ndarray, m: np.ndarray):
        n, width = m.shape
        full = np.zeros((n, -(-width // 8) * 8 or 8), np.uint8)
        full[:, :width] = m
        digits = full.view(">u8").astype(U)
        by_group = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.r_[True, group[by_group][1:] != group[by_group][:-1]])
        rank = np.empty(n, np.int64)
        rank[by_group] = np.repeat(first, np.diff(np.r_[first, n]))
        live = by_group
        for d in digits.T:
            live = live[np.lexsort((d[live], rank[live]))]
            r, v = rank[live], d[live]
            outer = np.r_[True, r[1:] != r[:-1]]
            inner = outer | np.r_[True, v[1:] != v[:-1]]
            at = np.arange(len(live))
            # a group's rank is the place of its first row; a part of it begins so many rows later
            rank[live] = r + np.maximum.accumulate(np.where(inner, at, 0)) - np.maximum.accumulate(np.where(outer, at, 0))
            count = np.diff(np.r_[np.flatnonzero(inner), len(live)])
            live = live[np.repeat(count > 1, count)]
            if not len(live):
                break
        self.order = np.argsort(rank, kind="stable")
        # bytes that each row shares with the one before it; another group shares none, not even an empty string
        differ = full[self.order[1:], :width] != full[self.order[:-1], :width]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width) if width else np.zeros(max(0, n - 1), np.int64)
        g = group[self.order]
        self.shared = np.r_[-1, np.where(g[1:] == g[:-1], shared, -1)]

    def classes(self, depth: int) -> np.ndarray:
        """A number for each row; rows of a group have the same if their first ``depth`` bytes are equal."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.shared < depth)
        return out


# -- tasks


def _anchor_task(parts: int, length: int, gram: int):
    """Anchors by gram: those that a task has once, a mark for others, whose places go on at once."""

    def run(batches):
        held, n = [], 0

        def flush():
            x = np.concatenate(held)
            order, first = groups(x["h"])
            x = x[order]
            count = np.diff(np.r_[first, len(x)])
            again = x[np.repeat(count > 1, count)]
            lone = x[first]
            lone["f"] = np.where(count > 1, MANY, ONE)
            yield _blobs(ANCHORS, lone, parts)
            if len(again):
                yield _blobs(PLACES, _places(again), parts)

        for batch in batches:
            keys = batch.column("k").to_numpy(zero_copy_only=False)
            data, at = utf8(batch.column("t"))
            for b, e, lo, hi in _pieces(at, length):
                rows = np.clip(at[lo : hi + 1] - b, 0, e - b)
                h, s1, s2, a = anchors_of(data[b:e], rows, length, gram)
                if not len(h):
                    continue
                x = np.zeros(len(h), ANCHOR)
                row = np.searchsorted(rows, s1, "right") - 1 if hi - lo > 1 else np.zeros(len(h), np.int64)
                off = b - at[lo:hi][row]
                x["h"], x["k"], x["s"], x["e"], x["a"] = h, keys[lo:hi][row], s1 + off, s2 + off, a + off
                held.append(x)
                n += len(x)
                if n >= HELD:
                    yield from flush()
                    held.clear()
                    n = 0
        if held:
            yield from flush()

    return lean(run)


def _places(x: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), PLACE)
    for c in PLACE.names:
        out[c] = x[c]
    return out


def _anchor_merge(parts: int):
    """All anchors of a gram are here: the places of grams that occur again."""

    def run(batches):
        held = []
        for batch in batches:
            kind, data = batch.column("kind").to_pylist(), batch.column("data")
            for k, x in zip(kind, data, strict=True):
                if k == ANCHORS:
                    held.append(np.frombuffer(x.as_buffer(), ANCHOR))
            yield _passed(batch, [k == PLACES for k in kind])
        if held:
            x = np.concatenate(held)
            order, first = groups(x["h"])
            x = x[order]
            count = np.diff(np.r_[first, len(x)])
            again = (count > 1) | (x["f"][first] == MANY)
            hit = x[np.repeat(again, count) & (x["f"] == ONE)]
            if len(hit):
                yield _blobs(PLACES, _places(hit), parts)

    return lean(run)


def _row_task(parts: int, digits: Digits):
    """The bytes around the anchors of each text, resolved within the task down to digits that aren't crowded."""
    length = digits.length

    def flush(held):
        size = [len(d) for _, d, _ in held]
        base = np.cumsum([0, *size[:-1]])
        flat = np.concatenate([d for _, d, _ in held])
        rows = digits.dealt(Rows(np.concatenate([x for x, _, _ in held]), flat, np.concatenate([o + b for (_, _, o), b in zip(held, base, strict=True)]), 0))
        while True:
            found, rows = digits.twins(rows)
            if len(found):
                yield _blobs(SPANS, merged(found), parts)
            crowded = digits.crowds(rows) if rows.digit < digits.last else np.zeros(len(rows), bool)
            stay = rows.some(~crowded)
            if crowded.any():
                marks = rows.some(np.flatnonzero(crowded)[np.unique(rows.x["h"][crowded], return_index=True)[1]])
                marks.x["f"] = CROWDED
                both = Rows(np.concatenate([stay.x, marks.x]), flat, np.r_[stay.off, marks.off], rows.digit)
                yield both.blobs(parts, length)
                rows = digits.cut(rows.some(crowded))
                continue
            if len(stay):
                yield stay.blobs(parts, length)
            return

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for k, t, e in zip(batch.column("k").to_pylist(), batch.column("t"), batch.column("e"), strict=True):
                data = np.frombuffer(t.as_buffer(), np.uint8)
                places = np.sort(np.frombuffer(e.as_buffer(), PLACE), order="s")
                for i in range(0, len(places), 1 << 14):
                    p = places[i : i + (1 << 14)]
                    x = np.zeros(len(p), ROW)
                    for c in PLACE.names:
                        x[c] = p[c]
                    b = int(p["s"].min())
                    part = data[b : int(p["e"].max()) + length]
                    held.append((x, part, p["s"].astype(np.int64) - b))
                    n += len(part) + len(x) * (length + 2 * ROW.itemsize)
                    if n >= BODIES:
                        yield from flush(held)
                        held, n = [], 0
        if held:
            yield from flush(held)

    return lean(run)


def _row_merge(parts: int, digits: Digits, digit: int):
    """All rows of a digit are here: its repeated windows; of a digit that is crowded somewhere, rows for the next one."""
    length = digits.length

    def run(batches):
        heads, bodies = [], []
        for batch in batches:
            kind = batch.column("kind").to_pylist()
            for k, x, body in zip(kind, batch.column("data"), batch.column("body"), strict=True):
                if k == ROWS + digit:
                    heads.append(np.frombuffer(x.as_buffer(), ROW))
                    bodies.append(np.frombuffer(body.as_buffer(), np.uint8))
            yield _passed(batch, [k != ROWS + digit for k in kind])
        if not heads:
            return
        x, flat = np.concatenate(heads), np.concatenate(bodies)
        size = _sizes(x, length)
        off = np.cumsum(size) - size
        crowded = np.unique(x["h"][x["f"] == CROWDED])
        live = x["f"] != CROWDED
        found, rows = digits.twins(Rows(x[live], flat, off[live], digit))
        on = np.isin(rows.x["h"], crowded)
        found = merged(np.concatenate([found, digits.windows(rows.some(~on))]))
        if len(found):
            yield _blobs(SPANS, found, parts)
        if on.any():
            yield digits.cut(rows.some(on)).blobs(parts, length)

    return lean(run)


def _by_key(kind: int):
    """Places or repeated ranges of each text, as one binary of records."""

    def run(batches):
        held = [np.frombuffer(x.as_buffer(), PLACE if kind == PLACES else SPAN) for batch in batches for x in batch.column("data")]
        if not held:
            return
        x = np.concatenate(held)
        x = np.unique(x) if kind == PLACES else merged(x)
        first = np.flatnonzero(np.r_[True, x["k"][1:] != x["k"][:-1]])
        last = [*first[1:], len(x)]
        yield pa.RecordBatch.from_arrays([pa.array(x["k"][first]), pa.array([x[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary())], ["k", "e"])

    return lean(run)


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """From (k long, t string): k and e, the byte ranges to remove, as records of SPAN."""
    parts = shuffle_parts(texts.sparkSession)
    gram = min(gram, length)
    digits = Digits(length, gram, crowd)
    long = texts.filter(F.octet_length("t") >= length)
    met = lambda df: df.repartitionById(parts, F.col("bucket"))
    found = met(long.mapInArrow(_anchor_task(parts, length, gram), BLOBS)).mapInArrow(_anchor_merge(parts), BLOBS)
    found = scratch.stage(found.select("bucket", "data"), "found")
    places = scratch.stage(met(found).mapInArrow(_by_key(PLACES), "k long, e binary"), "places")
    rows = small_join(long, scratch, "places", places, "k", "inner").mapInArrow(_row_task(parts, digits), BLOBS)
    passes = []
    for digit in range(digits.last + 1):
        passes.append(scratch.stage(met(rows).mapInArrow(_row_merge(parts, digits, digit), BLOBS), f"digit{digit}"))
        rows = passes[-1].filter(f"kind > {ROWS + digit}")
        if rows.isEmpty():
            break
    spans = passes[0]
    for p in passes[1:]:
        spans = spans.unionByName(p)
    spans = scratch.stage(met(spans.filter(f"kind = {SPANS}").select("bucket", "data")).mapInArrow(_by_key(SPANS), "k long, e binary"), "spans")
    scratch.drop("found", "places", *[f"digit{d}" for d in range(len(passes))])
    return spans


def _cut(whole_chars: bool, as_text: bool):
    def run(batches):
        for batch in batches:
            kept, sizes, removed, counts = [], [], [], []
            for t, e in zip(batch.column("t"), batch.column("e"), strict=True):
                raw = t.as_buffer() if t.is_valid else b""
                data = bytes(raw) if e.is_valid else raw
                n = len(data) if e.is_valid else (raw.size if t.is_valid else 0)
                gone = spans = 0
                if e.is_valid:
                    out, at = [], 0
                    for _, a, b in np.frombuffer(e.as_buffer(), SPAN).tolist():
                        if whole_chars:
                            while a < b and data[a] & 0xC0 == 0x80:
                                a += 1
                            while a < b < n and data[b] & 0xC0 == 0x80:
                                b -= 1
                            if a >= b:
                                continue
                        out.append(data[at:a])
                        at, gone, spans = b, gone + b - a, spans + 1
                    data = b"".join([*out, data[at:]])
                else:
                    data = bytes(data)
                kept.append(data)
                sizes.append(n)
                removed.append(gone)
                counts.append(spans)
            made = {"kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(counts, pa.int64())}
            if as_text:
                made = {"kept": made["kept"].cast(pa.string())}
            rest = [c for c in batch.schema.names if c not in ("t", "e", "k")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + list(made.values()), rest + list(made))

    return lean(run)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Per row: the id, kept (the bytes that stay, joined), n_bytes, n_removed and n_spans.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else
    in the corpus.  Null text: empty, nothing removed.  Null ids and repeated ids keep
    their rows; equal rows count as occurrences of each other.  Texts under ``length``
    bytes stay; long ones are worked on in pieces.  An empty table gives no rows.  Other
    columns are not read.  ``crowd`` sets when a digit's rows go on to the next digit, never
    the result.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    known = keyed(docs.select(col(docs, id_col).alias("id"), col(docs, text_col).cast("string").alias("t")), scratch, "k", "id", "t")
    texts = known.select("k", "id", "t")
    spans = repeated_spans(texts.select("k", "t"), scratch, length, crowd=crowd)
    kind = dict(texts.dtypes)["id"]
    cut = small_join(texts, scratch, "spans", spans, "k", "left").mapInArrow(_cut(False, False), f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")
    return cut.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut out of the text, every other column as it is.

    Ranges shrink to whole characters, so the text stays valid UTF-8; a null text becomes
    empty only if it has to be cut, which it never has.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    k, e, t = (fresh(docs, x) for x in ("cut_k", "cut_e", "cut_t"))
    rows = keyed(docs, scratch, k, id_col, text_col)
    spans = repeated_spans(rows.select(F.col(k).alias("k"), col(rows, text_col).cast("string").alias("t")), scratch, length)
    hit = small_join(rows.select(k, col(rows, text_col).alias(t)), scratch, "spans", spans.select(F.col("k").alias(k), F.col("e").alias(e)), k, "inner")
    new = hit.select(F.col(k).alias("id"), F.col(k).alias("k"), F.col(t).alias("t"), F.col(e).alias("e")).mapInArrow(_cut(True, True), "id long, kept string").dropDuplicates(["id"])
    new = scratch.stage(new.select(F.col("id").alias(k), F.col("kept").alias(t)), "cut")
    joined = small_join(rows, scratch, "cut", new, k, "left")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return joined.select(*[F.coalesce(F.col(t), quoted(c)).alias(c) if c == text_col else quoted(c) for c in docs.columns])


def query(spark, sf_dir):
    from quire.llm._frames import table

    cut = suffix_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(array_slice(b, i, i + 199)) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 198)) AS i FROM d WHERE octet_length(b) >= 200)),
again AS MATERIALIZED (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT r, i, sum(CASE WHEN i - p <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM again)),
spans AS MATERIALIZED (SELECT r, min(i) AS a, max(i) + 199 AS z FROM runs GROUP BY r, run),
kept AS (SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS a, a - 1 AS z FROM spans UNION ALL SELECT r, max(z) + 1, 2147483647 FROM spans GROUP BY r),
parts AS (SELECT kept.r, string_agg(substr(hex(b), 2 * a - 1, 2 * greatest(least(z, octet_length(b)) - a + 1, 0)), '' ORDER BY a) AS x FROM kept JOIN d USING (r) GROUP BY kept.r),
sums AS (SELECT r, sum(z - a + 1) AS gone, count(*) AS n FROM spans GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, CASE WHEN x IS NULL THEN sha256(b) ELSE sha256(unhex(x)) END AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN parts USING (r)
"""
