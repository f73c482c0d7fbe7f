"""Operators of the training-data subpackage, on small fixtures against plain versions."""

import hashlib
import io
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, against_sql
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import _text, components, jaccard_join, mixing, quality_gam, quality_rules, queries, reply_trees, sentencepiece_bpe, suffix_dedup, topk_search, toxicity, warc
from quire.llm._scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, id string, k int, n long"
WORDS = [f"w{i}" for i in range(400)]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", "clash", 1, 2) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    against_sql(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])


# -- suffix dedup


def cut_plainly(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def some_texts():
    rng = np.random.default_rng(1)
    text = lambda n: "".join(rng.choice(list("abcé \n"), n))
    passage = text(300)
    return [text(500) + passage + text(50), passage, text(400) + passage[20:280], passage + passage, "a" * 900, "", None, text(150), text(5000) + passage, passage]


def test_suffix_dedup_is_exact(spark):
    texts = some_texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, texts)).collect()}
    assert got == dict(enumerate(cut_plainly(texts, suffix_dedup.LENGTH)))


@pytest.mark.parametrize("crowd", [2, 4, 16])
def test_suffix_dedup_of_crowds_and_pieces(spark, crowd):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdef"), n))
    passage = text(260)
    texts = [text(230) + passage + text(230) for _ in range(60)] + [text(60_000 if crowd < 16 else 700_000) + passage]
    # one byte too short to repeat, variants of it, and a long run
    texts += [text(90) + passage[:199] + text(90) for _ in range(20)] + [text(50) + passage[: 180 + i] + text(100) for i in range(0, 80, 7)] + ["ab" * 700, "ba" * 300]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, texts), crowd=crowd).collect()}
    assert got == dict(enumerate(cut_plainly(texts, suffix_dedup.LENGTH)))


def test_windows_of_rows_are_read_from_their_bytes():
    rng = np.random.default_rng(21)
    base = rng.integers(97, 100, 60).astype(np.uint8)
    digits = suffix_dedup.Digits(20, 8)
    texts = []
    for _ in range(300):
        t = base.copy()
        t[rng.integers(0, 60, 2)] = rng.integers(97, 100, 2)
        texts.append(t)
    # rows around one place, all dealt alike, though what they share differs
    x = np.zeros(300, suffix_dedup.ROW)
    x["k"], x["a"], x["s"] = np.arange(300), 30, 30 - rng.integers(0, 13, 300)
    x["e"] = np.minimum(30, x["s"] + rng.integers(0, 13, 300))
    off = np.arange(300) * 60 + x["s"]
    got = suffix_dedup.merged(digits.windows(suffix_dedup.Rows(x, np.concatenate(texts), off, 0)))
    held = Counter((s - 30, texts[i][s : s + 20].tobytes()) for i in range(300) for s in range(x["s"][i], x["e"][i] + 1))
    want = [(i, s, s + 20) for i in range(300) for s in range(x["s"][i], x["e"][i] + 1) if held[s - 30, texts[i][s : s + 20].tobytes()] > 1]
    want = suffix_dedup.merged(np.array(want, suffix_dedup.SPAN))
    assert got.tolist() == want.tolist() and 0 < len(want)


def test_suffix_dedup_with_null_and_repeated_ids(spark):
    texts = some_texts()
    ids = [None, None, 1, 1, 1, 1, 1, 2, 3, 3]
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, texts, ids)).collect())
    assert got == sorted(cut_plainly(texts, suffix_dedup.LENGTH))


def test_cut_texts_stay_whole_characters(spark):
    texts = some_texts()
    got = suffix_dedup.without_repeats(frame(spark, texts))
    assert got.columns == [c.split()[0] for c in DOCS.split(", ")]
    kept = {r.doc_id: r.text for r in got.collect()}
    for i, (_, _, _, raw) in enumerate(cut_plainly(texts, suffix_dedup.LENGTH)):
        assert len((kept[i] or "").encode()) - len(raw) in range(0, 8)


def test_merged_ranges():
    x = suffix_dedup._spans([1, 1, 1, 2, 1], [0, 5, 30, 0, 10], [10, 20, 40, 3, 12])
    assert suffix_dedup.merged(x).tolist() == [(1, 0, 20), (1, 30, 40), (2, 0, 3)]


# -- Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def link_plainly(ids, texts):
    sets = [shingles(t) for t in texts]
    ok = [i for i in range(len(ids)) if ids[i] is not None]
    link = {(i, j) for i in ok for j in ok if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    label = {ids[i]: ids[i] for i in ok}
    for _ in range(len(ids)):
        for i, j in link:
            label[ids[i]] = label[ids[j]] = min(label[ids[i]], label[ids[j]])
    return sorted(((ids[i], len(sets[i]), label.get(ids[i]), sum(a == i for a, _ in link)) for i in range(len(ids))), key=str)


def near_copies(n, size, edits, seed):
    rng = np.random.default_rng(seed)
    base = list(rng.choice(WORDS, size))
    out = []
    for _ in range(n):
        w = list(base)
        for at in rng.integers(0, size, edits):
            w[at] = f"x{rng.integers(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("few", [2, 32])
def test_jaccard_join_is_exact(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "BLOCK", ((1 << 13, 4), (1 << 17, 2), (1 << 62, 1)))
    texts = near_copies(60, 150, 3, 1) + near_copies(6, 40, 1, 2) + near_copies(3, 900, 8, 3) + ["A b c", "a  B\tc", "a b", "", None, " \n", "one two three four five"] * 2
    ids = [7 * i % 1009 for i in range(len(texts))]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_join(frame(spark, texts, ids)).collect()), key=str)
    assert got == link_plainly(ids, texts)


def test_jaccard_join_by_packs_is_exact(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", ((1 << 6, 50), (1 << 13, 48), (1 << 62, 1)))
    texts = near_copies(130, 150, 3, 1) + near_copies(60, 40, 1, 2)
    ids = [7 * i % 1009 for i in range(len(texts))]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_join(frame(spark, texts, ids)).collect()), key=str)
    assert got == link_plainly(ids, texts)


def test_packs_of_near_copies_are_small():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    sets = [np.unique(np.r_[base[rng.random(len(base)) < 0.97], rng.integers(0, 1 << 62, 5).astype(np.uint64)]) for _ in range(32)]
    tokens, bits = jaccard_join.packed(sets)
    assert all((a == b).all() for a, b in zip(jaccard_join.unpacked(tokens, bits, len(sets)), sets, strict=True))
    assert len(tokens) + len(bits) < sum(x.nbytes for x in sets) / 8


def test_shuffle_files_of_a_tidy_stage_go_at_once(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    ids = lambda: {f.getName().split("_")[1] for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    old = ids()
    scratch = Scratch(spark, "tidy", tidy=True)
    assert len(scratch.stage(spark.range(1000).repartition(3, "id"), "t").collect()) == 1000
    for _ in range(50):
        files = disk.getAllFiles()
        if ids() <= old:
            break
        time.sleep(0.1)
    assert ids() <= old and spark.conf.get(name) == before


def test_jaccard_join_with_null_and_repeated_ids(spark):
    texts = ["a b c d e f g", "a b c d e f g", "z y x w v u", "z y x w v u", "q", None]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_join(frame(spark, texts, [None, 5, 5, 9, 9, 3])).collect()), key=str)
    # rows of one id are one vertex
    assert [(r[0], r[2]) for r in got] == [(3, 3), (5, 5), (5, 5), (9, 5), (9, 5), (None, None)]


def test_sketches_never_rule_out_links():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60, 500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            b = np.unique(np.r_[a[rng.random(len(a)) < 0.93], rng.integers(0, 1 << 62, max(1, n // 20)).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                assert jaccard_join.may_link(jaccard_join.sketch(a), jaccard_join.sketch(b), len(a), len(b), 75)


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few if few else 3)
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)]
    got = components.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t")).collect()
    root = {r.v: r.root for r in got}
    assert len({root[i] for i in range(31)}) == 1 and root[100] == root[101] != root[0]


# -- the others


def test_quality_rules_on_edges(spark):
    texts = [None, "", "a " * 60, "one two three " * 30, " ".join(WORDS[:60])]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert [got[i].n_words for i in range(5)] == [0, 0, 60, 90, 60]
    assert [got[i].n_repeat_words for i in range(5)] == [0, 0, 60, 90, 0]
    assert [got[i].kept for i in range(5)] == [False, False, False, False, True]


def judged_plainly(rows):
    """(kept, squared distance) of (text, lang, source), by numpy: words, statistics, fits and distances."""
    stats, good = [], []
    for text, lang, source in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + d for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for d in range(3)}
        ok = len(w) >= 50 and 100 * len(again) <= 50 * len(w)
        good.append(ok)
        if ok:
            chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in t)
            x = [np.log(1 + chars / len(w)), np.log(1 + 100 * symbols / chars), np.sqrt((len(lines) - len(set(lines))) / len(lines)), np.sqrt(len(again) / len(w)), np.log(len(w))]
            stats.append((np.floor(1024 * np.array(x) + 0.5), lang, (lang, source)))
    x = np.array([v for v, *_ in stats])
    scale = 1024 * np.array(quality_rules.SCALES)
    chi = quality_rules

    def distance(x, m, c):
        d = x - m
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(c + np.diag(scale**2 / 4)), d)

    def fit(x):
        low, middle, top = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
        e = np.maximum((top - low) / 1.349, scale)
        z = (x - middle) / e
        norm = np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-9)[:, None]
        fits = [(middle, np.diag(e**2))]
        for u in (z / (1 + abs(z)), z / norm):
            u = np.floor(1024 * u + 0.5)
            s = u.T @ u
            r = np.sqrt(np.maximum(np.diag(s), 1))
            corr = s / np.outer(r, r)
            np.fill_diagonal(corr, 1)
            fits.append((middle, corr * np.outer(e, e)))

        def step(m, c):
            b = np.minimum(np.floor(np.sqrt(distance(x, m, c)) * chi.BIN), chi.BINS - 1)
            before = np.searchsorted(np.sort(b), b, "left")
            near = x[before < chi.SHARE * len(x)]
            return near.mean(axis=0), chi.HALF * np.cov(near.T, bias=True)

        for _ in range(chi.STEPS):
            fits = [step(*f) for f in fits]
        best = min(fits, key=lambda f: np.linalg.slogdet(f[1] + np.diag(scale**2 / 4))[1])
        for _ in range(chi.LAST_STEPS):
            best = step(*best)
        near = x[distance(x, *best) <= chi.INNER]
        return len(near), near.mean(axis=0), chi.LAST * np.cov(near.T, bias=True)

    def lean(own, m, c):
        n, om, oc = own
        return (n * om + chi.PRIOR * m) / (n + chi.PRIOR), (n * oc + chi.PRIOR * c) / (n + chi.PRIOR)

    whole = fit(x)
    top = lean(whole, whole[1], np.diag(scale**2))
    d2 = np.zeros(len(x))
    for lang in {s[1] for s in stats}:
        middle = lean(fit(x[[s[1] == lang for s in stats]]), *top)
        for key in {s[2] for s in stats if s[1] == lang}:
            at = np.array([s[2] == key for s in stats])
            d2[at] = distance(x[at], *lean(fit(x[at]), *middle))
    d2 = iter(d2)
    return [(ok and d <= chi.CUTOFF, d) for ok, d in ((ok, next(d2) if ok else None) for ok in good)]


def test_quality_rules_against_numpy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    want = judged_plainly([r[1:] for r in rows])
    for r, (kept, d2) in zip(rows, want, strict=True):
        assert got[r.doc_id].kept == kept
        assert (d2 is None) == (got[r.doc_id].distance2 is None) and (d2 is None or abs(got[r.doc_id].distance2 - d2) < 1e-6 * (1 + d2))
    assert 0.5 < sum(k for k, _ in want) / len(want) < 1


def test_sources_have_fits_of_their_own(spark):
    rng = np.random.default_rng(14)
    text = lambda n, lo, hi: " ".join(w * int(rng.integers(lo, hi)) for w in rng.choice(WORDS, n))
    # words are short in one source and long in another; a long-worded text is at home in the second alone
    rows = [(i, text(200, 1, 2), "en", "short", "x", 0, 0) for i in range(150)] + [(i, text(200, 6, 9), "en", "long", "x", 0, 0) for i in range(150, 300)]
    rows += [(300, text(200, 6, 9), "en", "short", "x", 0, 0), (301, text(200, 6, 9), "en", "long", "x", 0, 0), (302, text(200, 1, 2), None, None, "x", 0, 0)]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] for i in range(300)) and not got[300] and got[301]
    want = judged_plainly([(r[1], r[2], r[3]) for r in rows])
    assert [got[i] for i in range(303)] == [k for k, _ in want]


def test_quality_rules_reject_outliers(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS, 200)) for _ in range(150)] + [" ".join(w + "###" for w in rng.choice(WORDS, 200))]
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert all(got[i] for i in range(150)) and not got[150]


def test_quality_rules_reject_repetition_in_a_clean_source(spark):
    rng = np.random.default_rng(13)
    lines = lambda n: [" ".join(rng.choice(WORDS, 12)) for _ in range(n)]
    texts = ["\n".join(lines(20)) for _ in range(150)]
    same = lines(10)
    short = [" ".join(rng.choice(WORDS, 2)) for _ in range(10)]
    texts += ["\n".join(short * 2 + lines(10)[:9] + short[:1]), "\n".join(same[:3] * 2 + lines(10)), "\n".join(lines(19) + [texts[0][:20]])]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    assert not any(got[i].base_failed for i in range(153))
    assert got[150].n_dup_lines == 11 and not got[150].kept and not got[151].kept
    assert all(got[i].kept for i in [*range(150), 152])


@pytest.mark.parametrize("text", ["", "a", "\\### Assistant: </turn> ok", "x\\", "###", "####", "</turn>\n### user: hi", "\n", "é😀", "\\\\</turn>"])
def test_turns_round_trip(text):
    turns = [("user", text), ("a:b\\", text), ("assistant", text)]
    made, spans = reply_trees.format_turns(turns)
    assert reply_trees.parse_turns(made) == turns
    assert [reply_trees.unescape(made[a:b]) for a, b in spans] == [text]


def test_reply_trees_rank_branches(spark):
    rows = [(1, None, 1.0), (2, 1, 5.0), (3, 1, 1.0), (4, 3, 9.0), (5, 2, 0.0), (6, 99, None), (7, 8, 1.0), (8, 7, 1.0)]
    m = spark.createDataFrame(rows, "node long, parent long, score double")
    got = reply_trees.reply_paths(m, top=1).collect()
    paths = {}
    for r in sorted(got, key=lambda r: -r.step):
        paths.setdefault(r.leaf, []).append(r.node)
    assert paths == {4: [1, 3, 4], 6: [6]}


def test_long_chain(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(300)] + [(None, 0, None, None), (2, None, "assistant", "x"), (2, None, "assistant", "x")]
    got = {r.conv: r for r in reply_trees.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [t for _, t in reply_trees.parse_turns(got[1].formatted)] == [f"t{t}" for t in range(300)]
    assert reply_trees.parse_turns(got[None].formatted) == [("", "")] and got[2].n_turns == 2


def test_topk_on_edges(spark):
    rows = [(0, [1.0, -0.5], 1), (100, [1.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (None, [1.0, 1.0], 1), (8, [], 1)]
    got = topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id int"), lambda i: i % 100 == 0, k=3).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 100] == [(1, 0, 1 << 20), (2, 6, 1 << 20), (3, 7, 1 << 20)]


def test_topk_in_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((60, 8)).astype(np.float32)
    monkeypatch.setattr(topk_search, "BLOCK", 7)
    got = topk_search.top_k(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>"), lambda i: i % 3 == 0, k=4)
    z = np.floor(1024 * m.astype(float)).astype(int)
    want = {(q, r + 1, v) for q in range(0, 60, 3) for r, v in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-(z[q] @ z[i]), i))[:4])}
    assert {(r.query_id, r.rank, r.vec_id) for r in got.collect()} == want


def plainly_raked(docs, targets=None):
    """Bounded raking in numpy, until nothing moves: the expected share of the budget by margin and value."""
    cells = docs.groupby(["source", "lang", "topic"], dropna=False)["n_tokens"].sum().reset_index()
    cells = cells[cells["n_tokens"] > 0].reset_index(drop=True)
    share = cells["n_tokens"] / cells["n_tokens"].sum()
    goals = {}
    for m, power in mixing.EXPONENTS.items():
        had = share.groupby(cells[m].fillna("-")).sum()
        goal = had.index.map(lambda v: (targets or {}).get(m, {}).get(v, 0.0)).to_numpy() if m in (targets or {}) else had.to_numpy() ** power  # noqa: B023
        goal, cap = goal / goal.sum(), had.to_numpy() / mixing.BUDGET
        lo, hi = 0.0, 1e6
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.minimum(cap, mid * goal).sum() < 1 else (lo, mid)
        goals[m] = dict(zip(had.index, np.minimum(cap, hi * goal), strict=True))
    w, bound = share.to_numpy().copy(), share.to_numpy() / mixing.BUDGET
    for _ in range(400):
        for m in mixing.EXPONENTS:
            for v, goal in goals[m].items():
                at = (cells[m].fillna("-") == v).to_numpy()
                lo, hi = 0.0, 1e9
                for _ in range(100):  # the factor by which the bounded weights reach the goal
                    mid = (lo * hi) ** 0.5 if lo else hi / 2 if hi > 1e-9 else 0
                    mid = (lo + hi) / 2 if hi < 2 * lo + 1e-12 or not lo else mid
                    lo, hi = (mid, hi) if np.minimum(w[at] * mid, bound[at]).sum() < goal * (1 - 1e-12) else (lo, mid)
                w[at] = np.minimum(w[at] * hi, bound[at])
    return {m: {v: w[(cells[m].fillna("-") == v).to_numpy()].sum() for v in goals[m]} for m in goals}, goals


def mixed_docs(spark):
    rng = np.random.default_rng(12)
    # one large source and eight small ones, whose targets are above all that they have; a rare topic within
    rows = [(i, " ".join(rng.choice(WORDS, 700)) if i % 9 else "a1 | b2 | c | " * 150, "en" if i % 4 else "de", "big" if i % 16 else f"s{i // 16 % 8}", "x", 5) for i in range(1200)]
    rows += [(2000, None, None, None, None, None), (2001, "", "en", "big", "x", 5), (None, " ".join(WORDS), None, "big", "x", 5), (7, " ".join(WORDS), "en", "big", "x", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string, probability int")


def test_mixing_spends_its_budget_though_cells_are_full(spark):
    docs = mixed_docs(spark)
    made = mixing.mix(docs)
    assert made.columns == ["doc_id", "lang", "source", "topic", "probability", "n_tokens", "_topic", "_probability", "sampled"]
    made = made.select("doc_id", "lang", "source", "n_tokens", F.col("_topic").alias("topic"), F.col("_probability").alias("probability"), "sampled")
    want, _ = plainly_raked(made.toPandas())
    for r in mixing.margins(made).collect():
        assert abs(r.fill / mixing.BUDGET - 1) < 1e-6
        assert abs(r.expected * r.fill / mixing.BUDGET - want[r.margin]["-" if r.value is None else r.value]) < 1e-3
    assert made.filter("n_tokens = 0 and (sampled or probability > 0)").count() == 0
    assert len({r.sampled for r in made.filter("doc_id = 7").collect()}) <= 2


def test_mixing_to_given_weights(spark):
    docs = mixed_docs(spark).filter("doc_id < 1200").drop("topic", "probability")
    targets = {"source": {"big": 6, "s1": 1, "s2": 1, "nowhere": 5}, "lang": {"en": 1, "de": 3}}
    made = mixing.mix(docs, targets=targets, budget=0.02)
    got = {(r.margin, r.value): r for r in mixing.margins(made, targets=targets).collect()}
    assert abs(got["source", "big"].expected - 0.75) < 1e-6 and abs(got["source", "s1"].expected - 0.125) < 1e-6
    assert abs(got["lang", "de"].expected - 0.75) < 1e-6 and abs(got["lang", "de"].target - 0.75) < 1e-9
    assert made.filter("source = 's3' and (sampled or probability > 0)").count() == 0
    # more than there is of s1 and s2: these are taken whole, the others share the rest
    made = mixing.mix(docs, targets={"source": {"big": 1, "s1": 1, "s2": 1}}, budget=0.3)
    got = {(r.margin, r.value): r for r in mixing.margins(made).collect()}
    assert abs(got["source", "s1"].expected * got["source", "s1"].fill / got["source", "s1"].had - 1) < 1e-3 and abs(got["lang", "de"].fill - 0.3) < 1e-3


def test_mixing_in_many_tasks(spark, monkeypatch):
    docs = mixed_docs(spark).drop("topic", "probability")
    whole = {(r.doc_id, r.n_tokens): r.probability for r in mixing.mix(docs).collect()}
    monkeypatch.setattr(mixing, "ONE_TASK", 0)
    assert all(abs(whole[r.doc_id, r.n_tokens] - r.probability) < 1e-9 for r in mixing.mix(docs).collect())


def test_mixing_asks_of_all_margins_at_once(spark):
    sc, docs = spark.sparkContext, mixed_docs(spark).drop("topic", "probability")
    try:
        sc.setJobGroup("mixing", "jobs of one call")
        assert len(mixing.mix(docs).collect()) == 1204
    finally:
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            sc.setLocalProperty(name, None)
    # each job costs the driver a broadcast block, however small its table: 42 where every margin was asked by itself
    assert len(sc.statusTracker().getJobIdsForGroup("mixing")) <= 24


def test_warc_reads_what_it_writes(spark, tmp_path):
    big = "x" * 2000
    pages = spark.createDataFrame([(1, "u\r\n", big, 0), (5, None, big, 0), (3, "v", big, 0), (4, "w", "small", 0), (6, "w", "small", 0), (None, "n", None, 0), (8, "é", "WARC/1.1\r\n\r\n", 0)], "page_id long, url string, html string, payload int")
    warc.register(spark)
    warc.write_pages(pages, str(tmp_path / "a"), Scratch(spark, "t"))
    got = spark.read.format("warc").load(str(tmp_path / "a"))
    told = {r.id: (r.record_type, r.to, r.payload) for r in got.select(warc.page_id(F.col("record_id")).alias("id"), "record_type", warc.page_id(F.col("refers_to")).alias("to"), F.col("payload").cast("string")).collect()}
    assert told[1] == ("revisit", 5, "") and told[3] == ("revisit", 5, "") and told[5] == ("response", None, big)
    assert told[4] == ("response", None, "small") and told[None] == ("response", None, "") and told[8][2] == "WARC/1.1\r\n\r\n"
    assert got.filter("record_type = 'revisit'").count() == 2
    bare = spark.read.format("warc").option("payload", "false").load(str(tmp_path / "a"))
    assert bare.filter("payload is not null").count() == 0 and bare.filter("payload_length = 2000").count() == 3


def test_warc_skips_blocks_and_reads_gzip():
    import gzip

    raw = b"".join(warc.record("response", f"<r{i}>", b"y" * 10, "d", 10, None, None) for i in range(3))
    for stream in (io.BytesIO(raw), gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(raw)))):
        got = list(warc.read_records(stream, lambda h: h["warc-record-id"] == "<r1>", True))
        assert [(h["warc-record-id"], b) for h, b in got] == [("<r1>", b"y" * 10)]


def test_warc_reads_no_payload_that_filters_rule_out(spark, tmp_path, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    big = [("x%d" % i) * 60_000 for i in range(6)]
    pages = spark.createDataFrame([(i, f"u{i}", t) for i, t in enumerate(big)] + [(9, "u9", "small")], "page_id long, url string, html string").coalesce(1)
    warc.register(spark)
    warc.write_pages(pages, str(tmp_path / "a"), Scratch(spark, "t"))
    monkeypatch.setattr(warc._Buffered, "SIZE", 4096)
    whole = warc._open_fs
    seen = []

    class Counting:
        def __init__(self, raw):
            self.raw, self.size, self.seek = raw, raw.size, raw.seek

        def read(self, n):
            got = self.raw.read(n)
            seen.append(len(got))
            return got

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.raw.close()

    class Store:
        def __init__(self, store):
            self.store, self.get_file_info = store, store.get_file_info

        def open_input_file(self, path):
            return Counting(self.store.open_input_file(path))

    monkeypatch.setattr(warc, "_open_fs", lambda path: (Store(whole(path)[0]), whole(path)[1]))

    def read(filters, **options):
        reader = warc.WarcReader({"path": str(tmp_path / "a")} | options)
        kept = list(reader.pushFilters(filters))
        seen.clear()
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return kept, rows, sum(seen)

    kept, rows, cost = read([])
    assert len(rows) == 7 and cost > 6 * 120_000
    kept, rows, cost = read([EqualTo(("record_id",), "<urn:page:3>"), GreaterThan(("payload_length",), 5)])
    assert [r["payload"].decode() for r in rows] == [big[3]] and cost < 3 * 120_000 and [type(f) for f in kept] == [GreaterThan]
    kept, rows, cost = read([In(("record_type",), ("revisit", "metadata"))])
    assert not rows and not kept and cost < 60_000
    kept, rows, cost = read([], **{"header.warc-target-uri": "u9"})
    assert [r["payload"] for r in rows] == [b"small"] and cost < 60_000
    plan = spark.read.format("warc").load(str(tmp_path / "a")).filter("record_id = '<urn:page:3>'")
    assert plan.count() == 1 and "Filter" not in plan._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].split("HashAggregate")[0]


def test_encoding_agrees_with_the_library_and_is_lossless():
    import sentencepiece

    with open(sentencepiece_bpe.MODEL, "rb") as f:
        raw = f.read()
    model, said = sentencepiece_bpe.Model(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["Hello  world\n x", "", " ", "日本語 😀 ﬁ \x00", "a" * 500, "ab" * 200 + " x", "<s> <0x0A>", "thorreou ndernt."]
    assert sentencepiece_bpe.encode_batch(model, pa.array(texts), 0, 1, 1).to_pylist() == [said.encode(t) for t in texts]
    texts += ["▁", "a ▁b", None]
    seen = set()
    for seed in (1, 2):
        ids = sentencepiece_bpe.encode_batch(model, pa.array(texts), 0.3, seed, 4)
        assert sentencepiece_bpe.decode_batch(model, ids).to_pylist() == [t or "" for t in texts]
        assert ids.equals(sentencepiece_bpe.encode_batch(model, pa.array(texts), 0.3, seed, 4))
        seen.add(str(ids.to_pylist()))
    assert len(seen) == 2


def test_heap_and_arrays_drop_alike(monkeypatch):
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        model = sentencepiece_bpe.Model(f.read())
    text = pa.array(["internationalisation of thoughtful misunderstandings"])
    one = sentencepiece_bpe.encode_batch(model, text, 0.3, 3, 1).to_pylist()
    monkeypatch.setattr(sentencepiece_bpe, "LONG", 1)
    assert sentencepiece_bpe.encode_batch(model, text, 0.3, 3, 1).to_pylist() == one


def test_every_occurrence_drops_merges_anew(monkeypatch):
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        model = sentencepiece_bpe.Model(f.read())
    word, n = " misunderstandings", 400
    texts = pa.array([word * n, "x" + word * n, word * n, "a" * 300 + word])
    got = sentencepiece_bpe.encode_batch(model, texts, 0.1, 5, 0).to_pylist()
    ways = Counter()
    for ids in got[:1]:
        text = sentencepiece_bpe.decode_batch(model, pa.array([ids], pa.list_(pa.int32()))).to_pylist()[0]
        assert text == word * n
        bits, size = [], 0
        for t in ids:
            bits.append(t)
            size += int(model.lengths[t])
            if size >= len(word) + (not ways):  # a dummy space before the first
                ways[tuple(bits)] += 1
                bits, size = [], 0
    assert sum(ways.values()) == n and len(ways) > 20 and got[0] == got[2] and got[0] != got[1][-len(got[0]):]
    # sharing the undropped tokens changes nothing: every occurrence merged by itself gives the same
    monkeypatch.setattr(sentencepiece_bpe, "_any_dropped", lambda merges, which, *_: np.ones(len(which), bool))
    assert sentencepiece_bpe.encode_batch(model, texts, 0.1, 5, 0).to_pylist() == got


@pytest.mark.parametrize(("name", "label", "least"), [("op5_toxicity", "toxic", 0.7), ("op6_quality_gam", "quality", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and got["score"].between(0, 1).all()
    hit = got[got[label] == 1]
    assert (hit["predicted"] == 1).mean() >= least - 0.15 and (got[got[label] == 0]["predicted"] == 0).mean() >= least
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) for i in got["doc_id"])


def test_scores_on_edges(spark):
    docs = frame(spark, [None, "", "###", "a b"], [1, None, 2, 2])
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for made in (toxicity.toxicity(docs, labels), quality_gam.quality(docs, labels)):
        assert made.count() == 4 and made.filter("score between 0 and 1").count() == 4


def test_gradients_of_the_network():
    net = toxicity.Network(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(8)
    x = np.r_[rng.standard_normal((5, 2 * toxicity.EMBED)), np.zeros((1, 2 * toxicity.EMBED))]
    index, mask = rng.integers(0, 5, (3, 6)), np.arange(6) < np.array([[6], [4], [1]])
    _, saved = net.forward(x, index, mask, keep=True)
    grads, _ = net.backward(x, index, mask, np.ones(3), saved)
    for k in ("u_f", "w_b", "att_w", "out_w"):
        at = (0, 1) if net.p[k].ndim == 2 else (0,)
        old = net.p[k][at]
        values = []
        for step in (1e-3, -1e-3):
            net.p[k][at] = old + step
            values.append(net.forward(x, index, mask).sum())
        net.p[k][at] = old
        assert abs((values[0] - values[1]) / 2e-3 - grads[k][at]) < 1e-3


def test_a_passage_is_scored_whole_at_every_offset():
    net = toxicity.Network(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    rng = np.random.default_rng(11)
    passage, text = rng.choice(WORDS, toxicity.WINDOW).tolist(), rng.choice(WORDS, 90).tolist()
    alone = toxicity.Words(*_text.utf8(pa.array([" ".join(passage)])))
    x, _ = net.inputs(alone)
    want = net.forward(x, alone.which[None], None)[0]
    texts = [" ".join(text[:k] + passage + text[k:]) for k in range(60)] + ["", "a b c"]
    w = toxicity.Words(*_text.utf8(pa.array(texts)))
    start, length, of = w.windows()
    assert np.bincount(of, minlength=62).tolist() == [91] * 60 + [0, 1] and length[-1] == 3
    logit, _ = net.all_logits(w)
    base = np.cumsum(w.counts) - w.counts
    for k in range(60):
        assert abs(logit[(of == k) & (start == base[k] + k)] - want).max() < 1e-5
    x, _ = net.inputs(w)
    whole = length == toxicity.WINDOW
    assert abs(net.forward(x, w.which[start[whole, None] + np.arange(toxicity.WINDOW)], None) - logit[whole]).max() < 1e-5


def test_words_and_hashes():
    data, at = _text.utf8(pa.array(["a  b\x0bc", "", None, "é\u00a0x", " "]))
    start, end, row = _text.words(data, at)
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == ["a", "b", "c", "é\u00a0x"] and row.tolist() == [0, 0, 0, 3]


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n not in ("op2_reply_trees",)))
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


def test_pipeline_against_plain_versions(spark, tmp_path):
    rng = np.random.default_rng(9)
    text = lambda n: " ".join(rng.choice(WORDS, n)) + "."
    passage = text(80)
    texts = [text(120) for _ in range(40)] + [text(60) + passage + text(60), passage + text(90)]
    texts += [texts[0], texts[1] + " more", "too short", None]
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    good = corpus_pipeline.quality(spark, docs, d)
    assert sorted(r.doc_id for r in good.collect()) == list(range(len(texts) - 2))
    once = corpus_pipeline.near_copies(spark, good, d)
    left = sorted(r.doc_id for r in once.collect())
    assert left == list(range(42))
    cut = corpus_pipeline.repeats(spark, once, d)
    want = {i: x[3] for i, x in zip(left, cut_plainly([texts[i] for i in left], 200), strict=True)}
    assert {r.doc_id: r.text.encode() for r in cut.collect()} == want and all(r.n_chars == len(r.text) for r in cut.collect())
    some = corpus_pipeline.mixture(spark, cut, d)
    assert some.columns == docs.columns and 5 < some.count() < 42
    done = corpus_pipeline.run(spark, d)
    back = sentencepiece_bpe.decode(done)
    assert {r.doc_id: r.decoded.encode() for r in back.collect()} == {r.doc_id: want[r.doc_id] for r in some.collect()}


def test_last_stage_decodes(spark, monkeypatch):
    docs = frame(spark, ["a  b\n ▁é", "", None, "x"])
    got = {r.doc_id: r for r in corpus_pipeline.tokens(spark, docs, "").collect()}
    assert all(r.lossless for r in got.values()) and got[2].n_tokens == 0
    assert got[0].decoded_sha256 == hashlib.sha256("a  b\n ▁é".encode()).hexdigest()
    whole = sentencepiece_bpe.encode
    monkeypatch.setattr(sentencepiece_bpe, "encode", lambda d: whole(d).withColumn("tokens", F.expr("slice(tokens, 1, greatest(size(tokens) - 1, 0))")))
    assert [r.doc_id for r in corpus_pipeline.tokens(spark, docs, "").filter("not lossless").collect()] == [0, 3]


def test_digest_of_kept_bytes(spark):
    got = suffix_dedup.query(spark, SF).filter("n_removed = 0").limit(3).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.kept_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in got)
