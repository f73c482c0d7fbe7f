"""Vectorised work on the bytes of many texts at once (numpy, inside Arrow workers)."""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd base of the rolling numbers modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PIECE = 1 << 18


def lean(run):
    """A task over Arrow batches that gives its memory back when it ends, as the worker lives on."""

    @functools.wraps(run)
    def task(batches):
        try:
            yield from run(batches)
        finally:
            _made.clear()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return task


_made: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if "up" not in _made or len(_made["up"]) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, base, U)
            x[0] = 1
            _made[name] = np.multiply.accumulate(x)
    return _made["up"], _made["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_LETTERS = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A number for every string of ``width`` bytes; equal strings have equal ones, but so may different ones.

    A polynomial modulo 2**64 is quick to roll and collides on structured text, so it only
    chooses and buckets; equality is never read from it.
    """
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_LETTERS[data] * up[: len(data)], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * down[: len(data) - width + 1])


def mix2(x: np.ndarray) -> np.ndarray:
    """Another scrambling, for a second hash that shares nothing with the first (the finaliser of murmur3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


#: Ranges of more bytes are digested one by one.
BLOCKWISE = 512
_HASHES = ((mix, 0x632BE59BD9B4E019), (mix2, 0x9E6C63D0676A9A99))


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, both: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of byte ranges, one or two that share nothing.

    Eight bytes at a time enter a state that is scrambled after each, so no algebra of the
    text cancels out; long ranges have a BLAKE2b digest.
    """
    size = (end - start).astype(np.int64)
    hashes = _HASHES if both else _HASHES[:1]
    out = [f(size.astype(U) * U(0xD1342543DE82EF95) + U(seed)) for f, seed in hashes]
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    live = np.flatnonzero((size > 0) & (size <= BLOCKWISE))
    live = live[np.argsort((BLOCKWISE - size[live]).astype(np.int16), kind="stable")] if len(live) and size[live].max() > 8 else live
    falling = -size[live]
    at = 0
    while len(live):
        left = size[live] - at
        word = eight[start[live] + at]
        short = left < 8
        if short.any():
            word = np.where(short, word & ((U(1) << (np.minimum(left, 7).astype(U) * U(8))) - U(1)), word)
        for x, (f, _) in zip(out, hashes, strict=True):
            x[live] = f(x[live] ^ word) + U(0x9E3779B97F4A7C15)
        at += 8
        live = live[: np.searchsorted(falling, -at, "left")]  # those of more than ``at`` bytes
    for i in np.flatnonzero(size > BLOCKWISE):
        digest = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest(), "<u8")
        for x, d in zip(out, digest, strict=False):
            x[i] = d
    return tuple(out)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ranges of equal sizes, from ``a`` and from ``b`` on, hold the same bytes."""
    out = np.ones(len(a), bool)
    total = np.r_[0, np.cumsum(size)]
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 20), "right")) - 1)
        n = size[lo:hi]
        of = np.repeat(np.arange(lo, hi), n)
        off = np.arange(int(n.sum())) - np.repeat(total[lo:hi] - total[lo], n)
        out[of[data[a[of] + off] != data[b[of] + off]]] = False
        lo = hi
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each row begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs_of_rows(at: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(at, starts, "right") - 1


def packed(bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Records by bucket: the buckets and, for each, its records as bytes."""
    if not len(rows):
        return np.zeros(0, np.int32), []
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return bucket[first].astype(np.int32), [rows[a:b].tobytes() for a, b in zip(first, [*first[1:], len(rows)], strict=True)]


def blobs(bucket: np.ndarray, rows: np.ndarray, kind: int = 0) -> pa.RecordBatch:
    """What ``packed`` gives, as a batch (bucket int, kind int, data binary)."""
    which, data = packed(bucket, rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(which, pa.int32()), pa.array(np.full(len(which), kind, np.int32)), pa.array(data, pa.binary())],
        ["bucket", "kind", "data"],
    )


BLOBS = "bucket int, kind int, data binary"


def unpacked(batches, kinds: dict[int, np.dtype]) -> dict[int, np.ndarray]:
    """All records of a partition of blobs, by kind."""
    found: dict[int, list[np.ndarray]] = {k: [] for k in kinds}
    for batch in batches:
        kind, data = batch.column("kind").to_pylist(), batch.column("data")
        for k, x in zip(kind, data, strict=True):
            found[k].append(np.frombuffer(x.as_buffer(), kinds[k]))
    return {k: np.concatenate(v) if v else np.zeros(0, kinds[k]) for k, v in found.items()}


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and the first place of each group in it."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)
