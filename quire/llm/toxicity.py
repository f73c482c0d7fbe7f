"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the embedding of its name (if the vocabulary has it) beside the mean
embedding of its character trigrams.  Two GRUs run over a window of words, attention pools
their states, and a logistic unit scores the window.  All overlapping windows of a text are
scored, one from each word on that has ``WINDOW`` words after it; a logistic unit over the
highest score and the expected number of toxic windows gives the document's score.

Labels are of documents, so training picks windows: those with words that stand out in
toxic documents at first, then those that the network itself scores highest.  Training is
plain numpy on the driver, on a bounded sample, and learns from every ``APART_BY``-th window
of it; the document's unit is fitted on all windows.  Scoring encodes each distinct word of
a batch once, each distinct window of a piece of it once, and runs neighbouring windows
together: their words at one time are a slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm._frames import col, table
from quire.llm._labels import fold, training_rows
from quire.llm._scratch import small_batches
from quire.llm._text import BASE, U, byte_hashes, groups, lean, mix, runs_of_rows, utf8, words

#: Training documents of each label, and the bytes that one may have.
PER_CLASS, MOST_BYTES = 2400, 16 << 10
#: Words of a window; scored windows begin at every word, those that the network learns from so many words apart.
WINDOW, STRIDE, APART_BY = 24, 1, 16
NAMES, TRIGRAMS, EMBED, HIDDEN, ATTEND = 4096, 2048, 8, 8, 8
STEPS, BATCH, RATE, ROUNDS = 320, 384, 0.01, 4
#: Toxic training documents from which a third of the sample is set apart, and -log of a chance that makes a key word.
APART, CHANCE = 200, 7.0
#: Windows that are scored together, and bytes of text that are prepared together.
TOGETHER, PIECE = 4096, 2 << 20
THRESHOLD = 0.7

_CLEAN = np.zeros(256, np.uint8)
_CLEAN[[0x20, *range(0x09, 0x0E)]] = 0x20
for _c in range(256):
    if _c >= 0x80 or chr(_c).isalnum():
        _CLEAN[_c] = ord(chr(_c).lower()) if _c < 0x80 else _c


class Words:
    """The words of some texts: distinct ones with their trigrams, and the sequence of each text."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = _CLEAN[data]
        live = data > 0
        at = np.r_[0, np.cumsum(live)][at]
        data = data[live]
        start, end, row = words(data, at)
        self.counts = np.bincount(row, minlength=len(at) - 1)
        if not len(start):
            self.hashes, self.which, self.first, self.trigrams, self.pick = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), start
            return
        (h,) = byte_hashes(data, start, end)
        self.hashes, pick, self.which = np.unique(h, return_index=True, return_inverse=True)
        size = end[pick] - start[pick]
        # each distinct word between two marks; a trigram begins at every byte but the last two
        width = size + 2
        self.first = np.cumsum(size) - size
        out = np.full(int(width.sum()), 1, np.int64)
        inner = np.repeat(np.cumsum(width) - width + 1 - self.first, size) + np.arange(int(size.sum()))
        out[inner] = data[np.repeat(start[pick] - self.first, size) + np.arange(int(size.sum()))]
        lead = inner - 1
        code = out[lead] + out[lead + 1] * 257 + out[np.minimum(lead + 2, len(out) - 1)] * 66049
        self.trigrams = (mix(code.astype(U)) % U(TRIGRAMS)).astype(np.int64)
        self.size = size

    def windows(self, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts (in ``which``), lengths and texts of all windows; texts without words have none."""
        n = np.maximum(0, -(-(self.counts - WINDOW) // stride)) + 1
        n[self.counts == 0] = 0
        text = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        count = self.counts[text]
        base = (np.cumsum(self.counts) - self.counts)[text]
        start = np.minimum(k * stride, np.maximum(0, count - WINDOW))
        return base + start, np.minimum(count, WINDOW), text

    def alike(self, at: np.ndarray) -> np.ndarray:
        """For whole windows that begin at ``at``, the first of them with the same words."""
        h = self.hashes[self.which]
        done = 1
        for digit in bin(WINDOW)[3:]:  # of 3 words from 1, of 6 from 3: a polynomial over the words' hashes
            h = h[:-done] * U(pow(BASE, done, 1 << 64)) + h[done:]
            done *= 2
            if digit == "1":
                h = h[:-1] * U(BASE) + self.hashes[self.which[done:]]
                done += 1
        h = h[at]
        order = np.argsort(h)
        h = h[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        first = np.empty(len(at), np.int64)
        first[order] = np.repeat(np.minimum.reduceat(order, new), np.diff(np.r_[new, len(at)]))
        # the words decide, not their hashes
        later = np.flatnonzero(first != np.arange(len(at)))
        a, b, same = at[later], at[first[later]], np.ones(len(later), bool)
        for k in range(WINDOW):
            same &= self.which[a + k] == self.which[b + k]
        first[later[~same]] = later[~same]
        return first


def _sigmoid(x, out=None):
    """By exp, which numpy has as a vector instruction on more machines than tanh."""
    with np.errstate(over="ignore"):  # to 0 where exp is infinite
        out = np.negative(x, out=out)
        np.exp(out, out=out)
        out += 1
        return np.reciprocal(out, out=out)


def _tanh(x, out=None):
    out = _sigmoid(2 * x if out is None else np.multiply(x, 2, out=out), out=out)
    out *= 2
    out -= 1
    return out


class Network:
    """The parameters, forwards and backwards passes."""

    def __init__(self, names: np.ndarray, odds: np.ndarray):
        rng = np.random.default_rng(5)
        normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.names = names  # sorted hashes; the embedding after the last is of all other words
        name = (rng.standard_normal((len(names) + 1, EMBED)) * 0.1).astype(np.float32)
        name[:-1, 0] = odds
        self.p = {
            "name": name,
            "gram": (rng.standard_normal((TRIGRAMS, EMBED)) * 0.1).astype(np.float32),
            "att_w": normal(2 * HIDDEN, ATTEND),
            "att_b": np.zeros(ATTEND, np.float32),
            "att_v": normal(ATTEND, 1)[:, 0],
            "out_w": normal(2 * HIDDEN, 1)[:, 0],
            "out_b": np.zeros(1, np.float32),
        }
        for d in "fb":
            self.p |= {f"w_{d}": normal(2 * EMBED, 3 * HIDDEN), f"u_{d}": normal(HIDDEN, 3 * HIDDEN), f"b_{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.doc = np.array([0.0, 1.0, 0.0])

    def inputs(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the distinct words and a zero for padding, and their places among the names."""
        if not len(w.hashes):
            return np.zeros((1, 2 * EMBED), np.float32), np.zeros(0, np.int64)
        at = np.searchsorted(self.names, w.hashes)
        known = self.names[np.minimum(at, len(self.names) - 1)] == w.hashes if len(self.names) else np.zeros(len(at), bool)
        at = np.where(known, at, len(self.names))
        grams = np.add.reduceat(self.p["gram"][w.trigrams], w.first, axis=0) / w.size[:, None].astype(np.float32)
        x = np.concatenate([self.p["name"][at], grams], axis=1)
        return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]), at

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows of words; x: vectors of words, index: (windows, time)."""
        n, time = index.shape
        states = np.empty((time, n, 2 * HIDDEN), np.float32)
        tape = {}
        for d, order in (("f", range(time)), ("b", range(time - 1, -1, -1))):
            gates = x @ self.p[f"w_{d}"] + self.p[f"b_{d}"]
            u, h, side = self.p[f"u_{d}"], np.zeros((n, HIDDEN), np.float32), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            for t in order:
                g, hu = gates[index[:, t]], h @ u
                zr = _sigmoid(g[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = _tanh(g[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                if mask is not None:
                    new = np.where(mask[:, t, None], new, h)
                if keep:
                    tape[d, t] = (h, z, r, c, hu[:, 2 * HIDDEN :])
                h = new
                states[t, :, side] = h
        a = _tanh(states @ self.p["att_w"] + self.p["att_b"])
        s = a @ self.p["att_v"]
        if mask is not None:
            s = np.where(mask.T, s, -1e9)
        s = np.exp(s - s.max(axis=0))
        alpha = s / s.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ self.p["out_w"] + self.p["out_b"][0]
        return (logit, (states, a, alpha, pooled, tape)) if keep else logit

    def backward(self, x, index, mask, delta, saved) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind x, and of x, for the loss's gradient by the logits."""
        states, a, alpha, pooled, tape = saved
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("name", "gram")}
        g["out_w"], g["out_b"] = pooled.T @ delta, np.array([delta.sum()], np.float32)
        dpool = delta[:, None] * self.p["out_w"]
        dalpha = np.einsum("nh,tnh->tn", dpool, states)
        ds = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        da = ds[:, :, None] * self.p["att_v"] * (1 - a * a)
        g["att_v"] = np.einsum("tn,tna->a", ds, a)
        g["att_w"], g["att_b"] = np.einsum("tnh,tna->ha", states, da), da.sum(axis=(0, 1))
        dstates = alpha[:, :, None] * dpool + da @ self.p["att_w"].T
        dx = np.zeros_like(x)
        time = index.shape[1]
        order_of, first = groups(index.T.ravel())  # the places of a word, together
        for d, order in (("f", range(time - 1, -1, -1)), ("b", range(time))):
            u, dh, side = self.p[f"u_{d}"], np.zeros((len(index), HIDDEN), np.float32), slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            dgates, each = np.zeros((len(x), 3 * HIDDEN), x.dtype), np.empty((time, len(index), 3 * HIDDEN), x.dtype)
            for t in order:
                h, z, r, c, hc = tape[d, t]
                dh = dh + dstates[t, :, side]
                live = dh if mask is None else np.where(mask[:, t, None], dh, 0)
                dc = live * z * (1 - c * c)
                dz = live * (c - h) * z * (1 - z)
                dr = dc * hc * r * (1 - r)
                each[t] = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"u_{d}"] += h.T @ du
                dh = dh - live * z + du @ u.T
            dgates[index.T.ravel()[order_of[first]]] = np.add.reduceat(each.reshape(-1, 3 * HIDDEN)[order_of], first, axis=0)
            g[f"w_{d}"], g[f"b_{d}"] = x.T @ dgates, dgates[:-1].sum(axis=0)
            dx += dgates @ self.p[f"w_{d}"].T
        return g, dx

    def tables(self, x: np.ndarray) -> dict:
        """For ``neighbours``, by direction: rows of the words' gates and first states, and the weights of a state.

        A state is kept with 1 added, and a 1 after it that carries the biases.  Every gate is
        1 / (1 + exp(y)), and a tanh twice that less 1: weights give y, signs and factors are in them.
        """
        out = {}
        scale = np.r_[np.full(2 * HIDDEN, -1), np.full(HIDDEN, -2)].astype(np.float32)
        for d in "fb":
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)
            g = (x @ self.p[f"w_{d}"] + self.p[f"b_{d}"]) * scale
            with np.errstate(over="ignore"):
                first = 1 + (2 / (1 + np.exp(g[:, 2 * HIDDEN :])) - 1) / (1 + np.exp(g[:, :HIDDEN]))
            m = np.concatenate([(self.p[f"u_{d}"] * scale).T, -2 * self.p["att_w"][side].T, self.p["out_w"][None, side]])
            bias = -m.sum(axis=1)
            if d == "f":
                bias[3 * HIDDEN :] += np.r_[-2 * self.p["att_b"], self.p["out_b"]]
            out[d] = np.concatenate([g, first], axis=1), np.concatenate([m, bias[:, None]], axis=1)
        return out

    def neighbours(self, tables: dict, which: np.ndarray) -> np.ndarray:
        """Logits of the whole windows that begin at neighbouring words, all that ``which`` has room for.

        One product of a state's weights gives the next gates, its part of the attention and of
        the logit; everything else is done in place.
        """
        n = len(which) - WINDOW + 1
        add, subtract, divide, exp = np.add, np.subtract, np.divide, np.exp
        one, two, twice = np.float32(1), np.float32(2), 2 * self.p["att_v"]
        state, made = np.ones((HIDDEN + 1, n), np.float32), np.empty((3 * HIDDEN + ATTEND + 1, n), np.float32)
        zr, c, h = np.empty((2 * HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32), state[:HIDDEN]
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        made_zr, made_c, made_out = made[: 2 * HIDDEN], made[2 * HIDDEN : 3 * HIDDEN], made[3 * HIDDEN :]
        # by time the exponents of the attention and, last, the logit of the state
        seen, score = np.empty((WINDOW, ATTEND + 1, n), np.float32), np.empty((WINDOW, n), np.float32)
        with np.errstate(over="ignore"):  # to 0 where exp is infinite
            for d, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
                table, weights = tables[d]
                rows = np.ascontiguousarray(table[which].T)
                g_zr, g_c, first = rows[: 2 * HIDDEN], rows[2 * HIDDEN : 3 * HIDDEN], rows[3 * HIDDEN :]
                for t in order:
                    if t == order[0]:
                        h[:] = first[:, t : t + n]
                    else:
                        add(made_zr, g_zr[:, t : t + n], zr)
                        exp(zr, zr)
                        add(zr, one, zr)
                        divide(made_c, r, c)
                        add(c, g_c[:, t : t + n], c)
                        exp(c, c)
                        add(c, one, c)
                        divide(two, c, c)
                        subtract(c, h, c)
                        divide(c, z, c)
                        add(h, c, h)
                    np.matmul(weights, state, made)
                    if d == "f":
                        seen[t] = made_out
                    else:
                        add(seen[t], made_out, seen[t])
                        a = seen[t, :ATTEND]
                        exp(a, a)
                        add(a, one, a)
                        divide(one, a, a)
                        np.matmul(twice, a, score[t])
            score -= score.max(axis=0)
            exp(score, score)
        return np.einsum("tn,tn->n", score, seen[:, ATTEND]) / score.sum(axis=0)

    def all_logits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logits of all overlapping windows, and their texts."""
        start, length, text = w.windows()
        x, _ = self.inputs(w)
        out = np.empty(len(start), np.float32)
        whole = length == WINDOW
        if whole.any():
            tables = self.tables(x)
            at, place = start[whole], np.flatnonzero(whole)
            # windows of the same words are scored once; words are left out where no other window lies
            first = w.alike(at)
            own = np.flatnonzero(first == np.arange(len(at)))
            need = at[own]
            begin = np.flatnonzero(np.r_[True, np.diff(need) > WINDOW])
            run = np.diff(np.r_[begin, len(need)])
            size = need[begin + run - 1] - need[begin] + WINDOW
            moved = need[begin] - (np.cumsum(size) - size)
            which = w.which[np.repeat(moved, size) + np.arange(size.sum())]
            at, whose = need - np.repeat(moved, run), place[own]
            i = 0
            while i < len(at):
                # the windows that begin within so many words; between texts there are some words with none
                j = int(np.searchsorted(at, at[i] + TOGETHER))
                n = int(at[j - 1] - at[i]) + 1
                out[whose[i:j]] = self.neighbours(tables, which[at[i] : at[i] + n + WINDOW - 1])[at[i:j] - at[i]]
                i = j
            out[place] = out[place[first]]
        some = np.flatnonzero(~whole)
        which = np.r_[w.which, np.full(WINDOW, len(x) - 1)]
        for i in range(0, len(some), TOGETHER):
            part = some[i : i + TOGETHER]
            mask = np.arange(WINDOW) < length[part, None]
            out[part] = self.forward(x, np.where(mask, which[start[part, None] + np.arange(WINDOW)], len(x) - 1), mask)
        return out, text

    def window_logits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Logits of the windows that training learns from, and their texts."""
        start, length, text = w.windows(APART_BY)
        x, _ = self.inputs(w)
        pad = len(x) - 1
        out = np.empty(len(start), np.float32)
        which = np.r_[w.which, np.full(WINDOW, pad)]
        for full in (True, False):
            some = np.flatnonzero((length == WINDOW) == full)
            for i in range(0, len(some), TOGETHER):
                part = some[i : i + TOGETHER]
                index = which[start[part, None] + np.arange(WINDOW)]
                mask = None
                if not full:
                    mask = np.arange(WINDOW) < length[part, None]
                    index = np.where(mask, index, pad)
                out[part] = self.forward(x, index, mask)
        return out, text

    def features(self, w: Words) -> np.ndarray:
        """By text: the highest logit, log of the expected toxic windows and of all windows; without words the lowest."""
        logit, text = self.all_logits(w)
        n = len(w.counts)
        top = np.full(n, -12.0)
        if len(text):
            first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])  # a text's windows lie together
            top[text[first]] = np.maximum.reduceat(logit, first)
        some = np.bincount(text, weights=_sigmoid(logit.astype(np.float64)), minlength=n)
        return np.stack([np.ones(n), np.clip(top, -12, 12), np.log1p(some), np.log1p(np.bincount(text, minlength=n))], axis=1)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in runs_of_rows(at, PIECE):
            out.append(_sigmoid(self.features(Words(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])) @ self.doc))
        return np.concatenate(out)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = _sigmoid(x @ b)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        b = b + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * b)
    return b


def train(labels: np.ndarray, column: pa.Array) -> Network | float:
    """A network; with labels of one kind only, or none, their share."""
    if not len(labels) or labels.min() == labels.max():
        return float(labels.mean()) if len(labels) else 0.0
    data, at = utf8(column)
    w = Words(data, at)
    toxic = labels == 1
    # the document's unit is fitted on documents that the network hasn't seen, if there are enough
    apart = np.arange(len(labels)) % 3 == 2 if toxic.sum() >= APART else np.zeros(len(labels), bool)
    text = np.repeat(np.arange(len(labels)), w.counts)
    order, first = groups(text, w.which)
    order = order[first]
    order = order[~apart[text[order]]]
    word, bad = w.which[order], toxic[text[order]]
    a, b = np.bincount(word[bad], minlength=len(w.hashes)), np.bincount(word[~bad], minlength=len(w.hashes))
    odds = np.log((a + 1) / (toxic.sum() + 2)) - np.log((b + 1) / ((~toxic).sum() + 2))
    firm = odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    keep = np.argsort(-np.abs(firm) * (a + b >= 3), kind="stable")[:NAMES]
    keep = np.sort(keep[(a + b)[keep] >= 3])  # hashes are sorted, so are these
    net = Network(w.hashes[keep], np.clip(odds[keep] / 3, -2, 2).astype(np.float32))
    # key words: so often in toxic documents only that chance is no explanation
    share = toxic.sum() / len(labels)
    key = np.r_[(a * -np.log(share) > CHANCE) & (a * (1 - share) > 20 * b * share), False]

    start, length, of = w.windows(APART_BY)
    index = np.r_[w.which, np.full(WINDOW, len(w.hashes))][start[:, None] + np.arange(WINDOW)]
    mask = np.arange(WINDOW) < length[:, None]
    index = np.where(mask, index, len(w.hashes))
    seen = ~apart[of]
    keyed = key[index].any(axis=1) & toxic[of] & seen
    positive, negative = keyed, ~toxic[of] & seen
    rng = np.random.default_rng(7)
    moments = {}
    step = 0
    for stage in range(ROUNDS):
        if not positive.any():
            positive = toxic[of] & seen
        yes, no = np.flatnonzero(positive), np.flatnonzero(negative)
        if stage:
            # clean windows that are taken for toxic come often
            hard = no[logits[no] > -2]  # noqa: F821
        for _ in range(STEPS // ROUNDS):
            step += 1
            some_no = rng.choice(no, BATCH * 2 // 3) if not stage or not len(hard) else np.r_[rng.choice(no, BATCH // 2), rng.choice(hard, BATCH // 6)]
            part = np.r_[rng.choice(yes, BATCH // 3), some_no]
            y = np.r_[np.ones(BATCH // 3), np.zeros(len(some_no))].astype(np.float32)
            used, place = np.unique(index[part], return_inverse=True)
            if used[-1] != len(w.hashes):
                used = np.r_[used, len(w.hashes)]
            place = place.reshape(len(part), WINDOW)
            x, grads_of = _some_inputs(net, w, used[:-1])
            logit, saved = net.forward(x, place, mask[part], keep=True)
            delta = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
            g, dx = net.backward(x, place, mask[part], delta, saved)
            g |= grads_of(dx[:-1])
            norm = np.sqrt(sum(float((v.astype(np.float64) ** 2).sum()) for v in g.values()))
            for k, v in g.items():
                v = v * np.float32(min(1.0, 5 / (norm + 1e-9)))
                m, s = moments.get(k, (0, 0))
                m, s = 0.9 * m + 0.1 * v, 0.999 * s + 0.001 * v * v
                moments[k] = m, s
                net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        logits, _ = net.window_logits(w)
        top = np.full(len(labels), -np.inf)
        np.maximum.at(top, of, logits)
        positive = keyed | (toxic[of] & seen & (logits == top[of]) & (logits > 0))
    use = apart if apart.any() else ~apart
    weight = np.where(toxic, 1.0, min(1.0, 2 * toxic.sum() / (~toxic).sum()))
    net.doc = _logistic(net.features(w)[use], labels[use].astype(float), weight[use])
    return net


def _some_inputs(net: Network, w: Words, used: np.ndarray):
    """Vectors of some distinct words and a zero, and what turns their gradients into those of the embeddings."""
    size = w.size[used]
    spot = np.repeat(w.first[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    grams = w.trigrams[spot]
    first = np.cumsum(size) - size
    at = np.searchsorted(net.names, w.hashes[used])
    known = net.names[np.minimum(at, len(net.names) - 1)] == w.hashes[used] if len(net.names) else np.zeros(len(at), bool)
    at = np.where(known, at, len(net.names))
    x = np.concatenate([net.p["name"][at], np.add.reduceat(net.p["gram"][grams], first, axis=0) / size[:, None].astype(np.float32)], axis=1)

    def back(dx):
        name, gram = np.zeros_like(net.p["name"]), np.zeros_like(net.p["gram"])
        np.add.at(name, at, dx[:, :EMBED])
        np.add.at(gram, grams, np.repeat(dx[:, EMBED:] / size[:, None].astype(np.float32), size, axis=0))
        return {"name": name, "gram": gram}

    return np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)]), back


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): null and empty texts score as texts without words."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(col(docs, id_col).alias("id"), col(docs, text_col).cast("string").alias("t"))

    def run(batches):
        net = shared.value
        for batch in batches:
            data, at = utf8(batch.column("t"))
            s = np.full(len(at) - 1, net) if isinstance(net, float) else net.score(data, at)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.clip(s, 0, 1))], ["id", "score"])

    return rows.mapInArrow(lean(run), f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """Per row: the id, held_out, score (0 to 1) and predicted (score of THRESHOLD or more).

    Labels of fold 1 are never seen.  A null id is not held out; repeated rows score alike, and
    in training a repeated id is one example.  Null and empty texts score as texts without words;
    very long ones are scored whole, windows in blocks.  Only ids and texts are read.  An empty
    table gives no rows; without labels of both kinds the score is a constant.
    """
    rows = training_rows(docs, labels, label, per_class, id_col, text_col, MOST_BYTES).toArrow()
    order = np.argsort([hash_of for hash_of in map(_stable, rows.column("text").to_pylist())], kind="stable")
    rows = rows.take(pa.array(order))
    model = train(rows.column("label").to_numpy(), rows.column("text").combine_chunks())
    out = score(docs, model, id_col, text_col)
    held = F.coalesce(fold(F.col("`" + id_col + "`")) == 1, F.lit(False))
    return out.select(F.col("`" + id_col + "`"), held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _stable(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def query(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
