"""Encoding with a SentencePiece BPE model under seeded merge-dropout, and decoding.

A text is a dummy space and the text, spaces written as the model's space mark.  No piece
holds that mark but at its beginning, so merges never cross the start of a run of spaces:
texts are cut there.  Nor do they cross two ASCII characters that are neighbours in no piece
(before a comma, between digits): chunks are cut into parts there, and each distinct part of
a block of texts is encoded once without dropout.

Within a chunk the agenda holds every pair of neighbours that some piece spells, the best
piece first and of equal ones the leftmost.  A candidate is skipped for good when the keyed
hash of (seed, epoch, text, place of the chunk in it, chunk, span and split of the pair)
falls under the dropout rate; what remains is merged until no candidate is left.  The hash
makes a segmentation a function of its key: runs and lost executors repeat it, while every
occurrence of a chunk, and other seeds and epochs, draw anew.  A dropped candidate changes
a segmentation only if it would have been merged, so an occurrence of a part that drops none of
its undropped merges shares its tokens, and only the others are merged one by one.  Spans are
counted in the chunk, so the cut into parts changes no draw.  Agendas advance together in numpy,
parts of equal size as columns of a matrix; a part of more than ``LONG`` symbols has a heap.

Characters without a piece, and the space mark itself in a text, are spelled in bytes, so
decoding gives back every text.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._frames import col, table
from quire.llm._scratch import small_batches
from quire.llm._text import U, byte_hashes, lean, mix, runs_of_rows, same_bytes, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT, SEED, EPOCH = 0.1, 17, 0
LONG = 96
MARK = "▁"
NEVER = np.int64(1) << 40
#: No entry of the table of pairs: ids and ranks have 20 bits.
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: Parts of up to so many symbols are columns, so many side by side; their ranks carry a row in six bits.
COLUMN, BESIDE, ROW, NO_RANK = 48, 1 << 14, 6, np.int32(1 << 30)
#: Letters, at most, whose pairs are looked up directly.
LETTERS = 512
#: A place where no final symbol begins.
GONE = -9


class Model:
    """The tables of a BPE model: characters, mergeable pairs and the bytes of pieces."""

    def __init__(self, raw: bytes):
        import sentencepiece

        said = sentencepiece.SentencePieceProcessor(model_proto=raw)
        n = said.get_piece_size()
        if n >= 1 << 20:
            raise ValueError(f"{n} pieces; ids have 20 bits here")
        names = [said.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (said.is_control(i) or said.is_unknown(i) or said.is_byte(i) or said.is_unused(i))]
        ids = {names[i]: i for i in plain}
        self.letters = np.full(0x110000, -1, np.int64)
        single = {i for name, i in ids.items() if len(name) == 1}
        for i in single:
            self.letters[ord(names[i])] = i
        order = sorted(plain, key=lambda i: -said.get_score(i))
        rank = {i: r for r, i in enumerate(order)}
        self.piece = np.array(order, np.int64)
        self.pairs = {(ids[s[:k]], ids[s[k:]]): rank[i] for s, i in ids.items() for k in range(1, len(s)) if s[:k] in ids and s[k:] in ids}
        self.bytes = np.zeros(256, np.int64)
        text = []
        for i in range(n):
            if said.is_byte(i):
                value = int(names[i][3:-1], 16)
                self.bytes[value] = i
                text.append(bytes([value]))
            else:
                text.append(names[i].replace(MARK, " ").encode() if i in rank else b"")
        self.lengths = np.array([len(x) for x in text])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.space = self.letters[ord(MARK)]
        # neighbouring ASCII characters that lie in no piece, a space for the mark: no merge crosses them
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for name in ids:
            spelled = name.replace(MARK, " ").encode()
            for a, b in zip(spelled, spelled[1:]):
                self.apart[a, b] = False
        self._hash()
        # pairs of the letters in most pairs have a table of their own; 0 is of all other symbols
        often = Counter(x for pair in self.pairs for x in pair if x in single)
        common = [x for x, _ in often.most_common(LETTERS - 1)]
        self.short = np.zeros(n + 1, np.int32)
        self.short[common] = np.arange(1, len(common) + 1)
        self.two = np.full((LETTERS, LETTERS), NO_RANK, np.int32)
        for (a, b), rank in self.pairs.items():
            if self.short[a] and self.short[b]:
                self.two[self.short[a], self.short[b]] = rank << ROW

    def _hash(self):
        """An open-addressed table of the pairs and their ranks, a word each, with short probes."""
        pair = np.array([(a << 20) | b for a, b in self.pairs], U)
        value = np.array(list(self.pairs.values()), U)
        self.bits = max(4, int(len(pair) * 4).bit_length())
        self.entries = np.full(1 << self.bits, EMPTY, U)
        slot, left, self.probes = self._slot(pair), np.arange(len(pair)), 0
        while len(left):
            at = (slot[left] + self.probes) & ((1 << self.bits) - 1)
            order = np.argsort(at, kind="stable")
            once = order[np.r_[True, at[order][1:] != at[order][:-1]]]
            once = once[self.entries[at[once]] == EMPTY]
            self.entries[at[once]] = (pair[left[once]] << U(20)) | value[left[once]]
            left = np.delete(left, once)
            self.probes += 1

    def _slot(self, pair):
        return ((pair * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair spells, NEVER without one."""
        pair = (a.astype(U) << U(20)) | b.astype(U)  # of a symbol without a piece: no pair of the table
        slot = self._slot(pair)
        found = self.entries[slot]
        hit = found >> U(20) == pair
        out = np.where(hit, (found & U(0xFFFFF)).astype(np.int64), NEVER)
        left = np.flatnonzero(~hit & (found != EMPTY))
        for probe in range(1, self.probes):
            if not len(left):
                break
            found = self.entries[(slot[left] + probe) & ((1 << self.bits) - 1)]
            hit = found >> U(20) == pair[left]
            out[left[hit]] = found[hit] & U(0xFFFFF)
            left = left[~hit & (found != EMPTY)]
        return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


_models: dict[bytes, Model] = {}


def _model(raw: bytes) -> Model:
    if raw not in _models:
        _models.clear()
        _models[raw] = Model(raw)
    return _models[raw]


def _skipped(key: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
    span = (begin.astype(U) << U(42)) | (middle.astype(U) << U(21)) | end.astype(U)
    return (mix(mix(span) ^ key) >> U(32)) < U(limit)


def _by_heap(model: Model, symbols: list[int], key, off: int, limit: int, merges: list | None = None) -> list[int]:
    """One part, symbol by symbol."""
    n = len(symbols)
    after, before, width = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
    agenda = []

    def offer(i):
        j = after[i]
        if j < n and (rank := model.pairs.get((symbols[i], symbols[j]))) is not None:
            if not limit or not _skipped(np.array([key]), *(np.array([off + x]) for x in (i, j, j + width[j])), limit)[0]:
                heapq.heappush(agenda, (rank, i, j, symbols[i], symbols[j], width[i], width[j]))

    for i in range(n):
        offer(i)
    while agenda:
        rank, i, j, a, b, wi, wj = heapq.heappop(agenda)
        if symbols[i] != a or symbols[j] != b or after[i] != j or width[i] != wi or width[j] != wj:
            continue
        if merges is not None:
            merges.append((i, j, j + wj))
        symbols[i], width[i], symbols[j], after[i] = int(model.piece[rank]), wi + wj, -9, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [i for i in range(n) if symbols[i] != -9]


def _segment(model: Model, symbols: np.ndarray, first: np.ndarray, key: np.ndarray, off: np.ndarray, limit: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge the parts that begin at ``first``: final symbols, and where in the input each begins.

    ``key`` and ``off`` are the key of a part's chunk and the place of the part in it; ``merges``
    takes arrays of the merges made: part, begin, middle and end in it."""
    sizes = np.diff(np.r_[first, len(symbols)])
    out = np.full(len(symbols), GONE, np.int32)
    narrow = min(COLUMN, LONG)
    order = np.argsort(np.minimum(sizes, narrow + 1).astype(np.int8), kind="stable")
    ends = np.searchsorted(sizes[order], np.arange(narrow + 1), "right")
    for n in range(1, narrow + 1):
        for lo in range(ends[n - 1], ends[n], BESIDE):
            part = order[lo : min(lo + BESIDE, ends[n])]
            _columns(model, symbols, first[part], n, part, key, off, limit, merges, out)
    rest = order[ends[narrow] :]
    if len(rest):
        made = None if merges is None else []
        sym, place = _wide(model, symbols[_ranges(first[rest], sizes[rest])], np.cumsum(sizes[rest]) - sizes[rest], key[rest], off[rest], limit, made)
        out[_ranges(first[rest], sizes[rest])[place]] = sym
        for m in made or ():
            merges.append(np.concatenate([rest[m[:1]], m[1:]]))
    place = np.flatnonzero(out != GONE)
    return out[place], place


def _columns(model: Model, symbols: np.ndarray, base: np.ndarray, n: int, part: np.ndarray, key: np.ndarray, off: np.ndarray, limit: int, merges: list | None, out: np.ndarray) -> None:
    """Merge parts of ``n`` symbols that begin at ``base``, each a column: every round merges the best pair of each.

    Final symbols go to ``out``, where in the input they begin."""
    sym = symbols[base + np.arange(n)[:, None]].astype(np.int32)
    if n == 1:
        out[base] = sym[0]
        return
    place = np.repeat(np.arange(n + 1, dtype=np.int32)[:, None], len(base), axis=1)  # the last row is the end

    def dropped(at, column):
        """Which of the pairs at these flat places are skipped."""
        o, flat = off[part[column]], place.ravel()
        return _skipped(key[part[column]], *(o + flat[at + i * len(base)] for i in range(3)), limit)

    letters = model.short[sym]
    rank = model.two.ravel()[letters[:-1] * np.int32(LETTERS) + letters[1:]]
    rank |= np.arange(n - 1, dtype=np.int32)[:, None]
    flat = rank.ravel()
    odd = np.flatnonzero(((letters[:-1] == 0) | (letters[1:] == 0)).ravel())
    if len(odd):
        r = model.ranks(sym.ravel()[odd], sym.ravel()[odd + len(base)])
        flat[odd] = np.where(r == NEVER, NO_RANK, (r << ROW) | odd // len(base))
    if limit:
        some = np.flatnonzero(flat < NO_RANK)
        flat[some[dropped(some, some % len(base))]] = NO_RANK
    live = np.arange(len(base))
    while True:
        best = rank.min(axis=0, initial=NO_RANK)
        go = best[live] < NO_RANK >> 1
        if not go.all():
            done, live = live[~go], live[go]
            out[base[done] + place[:-1, done]] = sym[:, done]
            if not len(live):
                return
            if len(live) * 4 < len(base) * 3:
                sym, place, rank, base, part, best = (x.take(live, axis=-1) for x in (sym, place, rank, base, part, best))
                live = np.arange(len(base))
        wide = len(base)
        at = best & ((1 << ROW) - 1)
        at[best >= NO_RANK >> 1] = 0  # columns that are done stay beside the others for a while
        here = at[live] * wide + live
        if merges is not None:
            flat = place.ravel()
            merges.append(np.stack([part[live], flat[here], flat[here + wide], flat[here + 2 * wide]]))
        new = model.piece[best[live] >> ROW]
        after = np.arange(len(sym), dtype=np.int32)[:, None] > at
        sym = np.where(after[:-1], sym[1:], sym[:-1])
        sym.ravel()[here] = new
        place = np.where(after, place[1:], place[:-1])
        rank = np.where(after[:-2], rank[1:] - 1, rank[:-1])
        if not len(rank):
            continue
        flat = sym.ravel()
        left, right = np.flatnonzero(here >= wide), np.flatnonzero(here < rank.size)
        where = np.concatenate([here[left] - wide, here[right]])
        r = model.ranks(np.concatenate([flat[here[left] - wide], new[right]]), np.concatenate([new[left], flat[here[right] + wide]]))
        row = where // wide
        found = np.where(r == NEVER, NO_RANK, (r << ROW) | row).astype(np.int32)
        if limit:
            some = np.flatnonzero(r != NEVER)
            found[some[dropped(where[some], where[some] - row[some] * wide)]] = NO_RANK
        rank.ravel()[where] = found


def _wide(model: Model, symbols: np.ndarray, first: np.ndarray, key: np.ndarray, off: np.ndarray, limit: int, merges: list | None) -> tuple[np.ndarray, np.ndarray]:
    """``_segment`` of parts of any size, one after the other."""
    sizes = np.diff(np.r_[first, len(symbols)])
    out_symbol, out_place = [], []
    for c in np.flatnonzero(sizes > LONG):
        part = symbols[first[c] : first[c] + sizes[c]].tolist()
        made = None if merges is None else []
        live = _by_heap(model, part, key[c], int(off[c]), limit, made)
        if made:
            merges.append(np.c_[np.full(len(made), c), np.array(made, np.int64)].T)
        out_symbol.append(np.array([part[i] for i in live], np.int64))
        out_place.append(np.array(live, np.int64) + first[c])
    short = np.repeat(sizes <= LONG, sizes)
    place = np.flatnonzero(short)
    sym, owner = symbols[place], np.repeat(np.arange(len(first)), sizes)[place]

    def ranked(at):
        """The ranks of the pairs that begin at these places of the current symbols."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        r = np.where((at + 1 < len(sym)) & (owner[nxt] == owner[at]), model.ranks(sym[at], sym[nxt]), NEVER)
        if limit:
            some = np.flatnonzero(r != NEVER)
            i, j = at[some], at[some] + 1
            k = np.minimum(j + 1, len(sym) - 1)
            base = first[owner[i]]
            end = np.where((j + 1 < len(sym)) & (owner[k] == owner[j]), place[k] - base, sizes[owner[i]])
            o = off[owner[i]]
            r[some[_skipped(key[owner[i]], o + place[i] - base, o + place[j] - base, o + end, limit)]] = NEVER
        return r

    rank = ranked(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        counts = np.diff(np.r_[starts, len(sym)])
        best = np.minimum.reduceat((rank << 20) | np.arange(len(sym)) % (1 << 20) if len(sym) < 1 << 20 else rank * (len(sym) + 1) + np.arange(len(sym)), starts)
        best_rank, at = (best >> 20, best & ((1 << 20) - 1)) if len(sym) < 1 << 20 else (best // (len(sym) + 1), best % (len(sym) + 1))
        go = best_rank < NEVER
        done = np.repeat(~go, counts)
        if done.any():
            out_symbol.append(sym[done])
            out_place.append(place[done])
        at = at[go]
        if not len(at):
            break
        if merges is not None:
            i, k = at, np.minimum(at + 2, len(sym) - 1)
            base = first[owner[i]]
            end = np.where((at + 2 < len(sym)) & (owner[k] == owner[i]), place[k] - base, sizes[owner[i]])
            merges.append(np.stack([owner[i], place[i] - base, place[i + 1] - base, end]))
        sym[at] = model.piece[best_rank[go]]
        keep = ~done
        keep[at + 1] = False
        new = np.cumsum(keep) - 1
        at = new[at]
        sym, owner, place, rank = sym[keep], owner[keep], place[keep], rank[keep]
        touched = np.concatenate([at, at[(at > 0)] - 1])
        rank[touched] = ranked(touched)
    sym, place = np.concatenate([*out_symbol, np.zeros(0, np.int64)]), np.concatenate([*out_place, np.zeros(0, np.int64)])
    order = np.argsort(place, kind="stable")
    return sym[order], place[order]


def _chunk_tokens(model: Model, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray, off: np.ndarray, limit: int, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of parts, one after the other, and how many each has."""
    raw = data[_ranges(start, end - start)]
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    width = np.diff(np.r_[lead, len(raw)])
    code = raw[lead].astype(np.int64)
    code &= np.array([0, 0x7F, 0x1F, 0x0F, 0x07])[np.minimum(width, 4)]
    for k in range(1, 4):
        more = np.flatnonzero(width > k)
        code[more] = (code[more] << 6) | (raw[lead[more] + k] & 0x3F)
    symbols = model.letters[np.minimum(code, 0x10FFFF)]
    symbols[code == ord(MARK)] = -1
    symbols[code == 0x20] = model.space
    first = np.searchsorted(lead, np.cumsum(end - start) - (end - start))
    sym, place = _segment(model, symbols, first, key, off, limit, merges)
    size = np.where(sym < 0, width[place], 1)
    tokens = np.repeat(sym, size)
    spelled = np.flatnonzero(sym < 0)
    at = np.cumsum(size) - size
    tokens[_ranges(at[spelled], size[spelled])] = model.bytes[raw[_ranges(lead[place[spelled]], width[place[spelled]])]]
    total = np.r_[0, np.cumsum(size)]
    return tokens, np.diff(total[np.searchsorted(place, np.r_[first, len(lead)])])


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One part of each kind, and the kind of every part; equal hashes are held against the bytes."""
    order = np.argsort(h)
    new = np.r_[True, h[order[1:]] != h[order[:-1]]][: len(h)]
    pick, which = order[new], np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    size = end - start
    same = size == size[pick[which]]
    some = np.flatnonzero(same & (pick[which] != np.arange(len(h))))
    same[some] = same_bytes(data, start[some], start[pick[which[some]]], size[some])
    odd = np.flatnonzero(~same)
    return np.r_[pick, odd], np.where(same, which, len(pick) + np.cumsum(~same) - 1)


def _any_dropped(merges: list, which: np.ndarray, parts: int, key: np.ndarray, off: np.ndarray, limit: int) -> np.ndarray:
    """Whether an occurrence with this key, at this place of its chunk, drops some merge of its part ``which``."""
    chunk, begin, middle, end = np.concatenate([*merges, np.zeros((4, 0), np.int64)], axis=1)
    order = np.argsort(chunk, kind="stable")
    begin, middle, end = begin[order], middle[order], end[order]
    count = np.bincount(chunk, minlength=parts)
    first = np.cumsum(count) - count
    out = np.zeros(len(which), bool)
    n = count[which]
    total = np.r_[0, np.cumsum(n)]
    lo = 0
    while lo < len(which):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 18), "right")) - 1)
        at = _ranges(first[which[lo:hi]], n[lo:hi])
        of = np.repeat(np.arange(lo, hi), n[lo:hi])
        o = off[of]
        out[of[_skipped(key[of], o + begin[at], o + middle[at], o + end[at], limit)]] = True
        lo = hi
    return out


def encode_batch(model: Model, column, dropout: float, seed: int, epoch: int, limit_bytes: int = 2 << 20) -> pa.ListArray:
    """The tokens of each text of a column."""
    data, at = utf8(column)
    limit = int(dropout * (1 << 32))
    tokens, counts = [], []
    for lo, hi in runs_of_rows(at, limit_bytes):
        size = np.diff(at[lo : hi + 1])
        full = np.flatnonzero(size)
        grown = np.zeros(int(size.sum()) + len(full), np.uint8)
        begin = (np.cumsum(size[full]) - size[full]) + np.arange(len(full))
        grown[begin] = 0x20
        body = np.ones(len(grown), bool)
        body[begin] = False
        grown[body] = data[at[lo] : at[hi]]
        count = np.zeros(hi - lo, np.int64)
        if len(full):
            cut = grown == 0x20
            cut[1:] &= grown[:-1] != 0x20
            cut[begin] = True
            start = np.flatnonzero(cut)
            end = np.r_[start[1:], len(grown)]
            doc = np.searchsorted(begin, start, "right") - 1
            # the parts of a chunk, between which no merge is possible
            split = cut.copy()
            split[1:] |= model.apart[grown[:-1], grown[1:]]
            first = np.flatnonzero(split)
            last = np.r_[first[1:], len(grown)]
            (own_h,) = byte_hashes(grown, first, last)
            pick, which = _distinct(grown, first, last, own_h)
            merges = [] if limit else None
            flat, n = _chunk_tokens(model, grown, first[pick], last[pick], own_h[pick], np.zeros(len(pick), np.int64), 0, merges)
            if limit:
                # every occurrence of a chunk has a key: of its text, its place in the text and its bytes
                (h,) = byte_hashes(grown, start, end)
                lead = np.searchsorted(doc, np.arange(len(full)))
                nth = (np.arange(len(start)) - lead[doc]).astype(U)
                text = mix(np.add.reduceat(mix(h + mix(nth + U(1))), lead) + mix(mix(np.array([seed], U)) + U(epoch)))
                key = mix(h + mix(text[doc] + nth))
                # and its parts a place in it, in characters
                of = np.cumsum(cut[first]) - 1
                off = np.cumsum((grown & 0xC0) != 0x80)
                off = off[first] - off[start][of]
                key = key[of]
                hit = np.flatnonzero(_any_dropped(merges, which, len(pick), key, off, limit))
                if len(hit):
                    one, again = _distinct(grown, first[hit], last[hit], mix(key[hit] + mix(off[hit].astype(U))))
                    some = hit[one]
                    own, m = _chunk_tokens(model, grown, first[some], last[some], key[some], off[some], limit)
                    which[hit] = len(n) + again
                    flat, n = np.r_[flat, own], np.r_[n, m]
            where = np.cumsum(n) - n
            tokens.append(flat[_ranges(where[which], n[which])].astype(np.int32))
            count[full] = np.add.reduceat(n[which], np.searchsorted(first, begin))
        counts.append(count)
    n = np.concatenate([np.zeros(1, np.int64), *counts])
    values = np.concatenate([np.zeros(0, np.int32), *tokens])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(n), pa.int32()), pa.array(values))


def decode_batch(model: Model, column: pa.ListArray, together: int = 1 << 19) -> pa.Array:
    """The text of each row of tokens, about ``together`` tokens at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    ids = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    at = at - at[0]
    parts = [_decoded(model, ids[at[lo] : at[hi]].astype(np.int64), at[lo : hi + 1] - at[lo]) for lo, hi in runs_of_rows(at, together)]
    return pa.concat_arrays([pa.array([], pa.string()), *parts])


def _decoded(model: Model, ids: np.ndarray, at: np.ndarray) -> pa.Array:
    size = model.lengths[ids]
    total = np.r_[0, np.cumsum(size)]
    bounds = total[at]
    raw = model.text[_ranges(model.starts[ids], size)]
    body = np.ones(len(raw), bool)
    first = bounds[:-1][np.diff(bounds) > 0]
    body[first[raw[first] == 0x20]] = False
    sizes = np.diff(np.r_[0, np.cumsum(body)][bounds])
    offsets = np.r_[0, np.cumsum(sizes)]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[body])]).cast(pa.large_string()).cast(pa.string())


def _broadcast(df: DataFrame, path: str):
    small_batches(df.sparkSession)
    with open(path, "rb") as f:  # a file of the driver, half a megabyte
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "tokens", dropout: float = DROPOUT, seed: int = SEED, epoch: int = EPOCH, model: str = MODEL) -> DataFrame:
    """``docs`` with the tokens of a text (array<int>) in ``out_col``, after the other columns.

    Null and empty texts have no tokens.  Equal texts have equal tokens under one seed and
    epoch; equal words of a text, or of different texts, are segmented independently.
    Dropout 0 gives the model's own segmentation.  A column named ``out_col`` is replaced.
    """
    raw = _broadcast(docs, model)
    rest = [c for c in docs.columns if c != out_col]
    kept = docs.select(*[col(docs, c) for c in rest])
    at = rest.index(text_col)

    def run(batches):
        known = _model(raw.value)
        for batch in batches:
            tokens = encode_batch(known, batch.column(at), dropout, seed, epoch)
            yield pa.RecordBatch.from_arrays([*batch.columns, tokens], [*batch.schema.names, out_col])

    schema = kept.withColumn(out_col, F.lit(None).cast("array<int>")).schema
    return kept.mapInArrow(lean(run), schema)


def decode(rows: DataFrame, tokens_col: str = "tokens", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text that the tokens spell in ``out_col``; null tokens: empty."""
    raw = _broadcast(rows, model)
    rest = [c for c in rows.columns if c != out_col]
    kept = rows.select(*[F.coalesce(col(rows, c), F.array().cast("array<int>")).alias(c) if c == tokens_col else col(rows, c) for c in rest])
    at = rest.index(tokens_col)

    def run(batches):
        known = _model(raw.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_batch(known, batch.column(at))], [*batch.schema.names, out_col])

    return kept.mapInArrow(lean(run), kept.withColumn(out_col, F.lit(None).cast("string")).schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = decode(encode(docs))
    return rows.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.xxhash64("tokens").alias("tokens_hash"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("lossless"),
    )
