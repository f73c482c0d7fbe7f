"""Scorers against plain versions, word by word and document by document; edges and both sides of every switch."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm import WORDS, frame, link_plainly, near_copies, cut_plainly, some_texts

import corpus_pipeline
from quire.llm import _labels, _scratch, _text, components, jaccard_join, mixing, quality_gam, quality_rules, queries, reply_trees, sentencepiece_bpe, suffix_dedup, topk_search, toxicity, warc

sigmoid = lambda x: 1 / (1 + np.exp(-x))


def labelled(label, n=400):
    import pyarrow.parquet as pq

    docs, labels = (pq.read_table(f"{SF}/{t}.parquet").to_pandas() for t in ("documents", "labels"))
    m = docs.merge(labels, on="doc_id")
    m = m[m["text"].notna() & (m["text"].str.len() < 16_000)].head(n)
    return m["text"].tolist(), m[label].to_numpy()


def scored_plainly(net, text):
    """The score of one text: each window word by word."""
    word = re.findall(r"[^\x20\x09-\x0D]+", text)
    word = [b"".join(bytes([c]) for c in w.encode() if c >= 0x80 or chr(c).isalnum()) for w in word]
    word = [bytes(ord(chr(c).lower()) if c < 0x80 else c for c in w) for w in word if w]
    p = net.p

    def vector(w):
        (h,) = _text.byte_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
        at = np.flatnonzero(net.names == h[0])
        name = p["name"][at[0] if len(at) else len(net.names)]
        marked = [1, *w, 1, 0, 0]
        grams = [int(_text.mix(np.array([marked[i] + 257 * marked[i + 1] + 66049 * marked[i + 2]], np.uint64))[0] % toxicity.TRIGRAMS) for i in range(len(w))]
        return np.concatenate([name, p["gram"][grams].mean(axis=0)])

    def window(xs):
        states = np.zeros((len(xs), 2 * toxicity.HIDDEN))
        for d, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            h = np.zeros(toxicity.HIDDEN)
            n = toxicity.HIDDEN
            for t in order:
                g, hu = xs[t] @ p[f"w_{d}"] + p[f"b_{d}"], h @ p[f"u_{d}"]
                z, r = sigmoid(g[:n] + hu[:n]), sigmoid(g[n : 2 * n] + hu[n : 2 * n])
                h = (1 - z) * h + z * np.tanh(g[2 * n :] + r * hu[2 * n :])
                states[t, slice(0, n) if d == "f" else slice(n, None)] = h
        s = np.tanh(states @ p["att_w"] + p["att_b"]) @ p["att_v"]
        a = np.exp(s - s.max())
        return float((a / a.sum()) @ states @ p["out_w"] + p["out_b"][0])

    xs = [vector(w) for w in word]
    logits = [window(xs[i : i + toxicity.WINDOW]) for i in range(max(1, len(xs) - toxicity.WINDOW + 1))] if xs else []
    top = np.clip(max(logits, default=-12.0), -12, 12)
    return sigmoid(np.array([1, top, np.log1p(sum(map(sigmoid, logits))), np.log1p(len(logits))]) @ net.doc)


def test_toxicity_scores_as_word_by_word():
    texts, labels = labelled("toxic")
    old, toxicity.STEPS = toxicity.STEPS, 40
    try:
        net = toxicity.train(labels, pa.array(texts))
    finally:
        toxicity.STEPS = old
    some = [*[t for t in texts if len(t) < 900][:25], "", "###", "One, two!", "a-b c", "été É"]
    got = net.score(*_text.utf8(pa.array(some)))
    assert np.abs(got - [scored_plainly(net, t) for t in some]).max() < 1e-4


def test_a_window_runs_each_word_after_its_first_once(monkeypatch):
    net = toxicity.Network(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    w = toxicity.Words(*_text.utf8(pa.array([" ".join(np.random.default_rng(41).choice(WORDS, 600))])))
    n, values, exp = 600 - toxicity.WINDOW + 1, [], np.exp
    monkeypatch.setattr(np, "exp", lambda x, *a, **k: values.append(np.size(x)) or exp(x, *a, **k))
    assert len(net.all_logits(w)[0]) == n
    gates, rest = 6 * toxicity.HIDDEN, toxicity.WINDOW * (toxicity.ATTEND + 1)
    assert sum(values) <= n * ((toxicity.WINDOW - 1) * gates + rest) + gates * (len(w.hashes) + 1)


def featured_plainly(text):
    """The features of one text."""
    b = text.encode()
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text)]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda chars: sum(c in chars for c in b) / max(1, len(b))
    return [
        np.log1p(len(w)),
        sum(map(len, w)) / max(1, len(w)),
        share(b"#*$%&<>"),
        share(b"|"),
        share(b"0123456789"),
        share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        share(b".,;:!?"),
        share(bytes(range(0x80, 0x100))),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(set(w)) / max(1, len(w)),
        np.log1p(len(b) / max(1, len(lines))),
        max(Counter(w).values(), default=0) / max(1, len(w)),
    ]


def test_windows_of_the_same_words_are_scored_once(monkeypatch):
    rng = np.random.default_rng(3)
    net = toxicity.Network(np.zeros(0, np.uint64), np.zeros(0, np.float32))
    passage, other = (" ".join(map(str, rng.integers(0, 10**6, 200))) for _ in range(2))
    texts = [passage, f"{other} {passage}", "short", "", f"{passage} {passage}", passage]
    one_by_one = [net.features(toxicity.Words(*_text.utf8(pa.array([t]))))[0] for t in texts]
    w = toxicity.Words(*_text.utf8(pa.array(texts)))
    ran = []
    whole = toxicity.Network.neighbours
    monkeypatch.setattr(toxicity.Network, "neighbours", lambda self, tables, which: ran.append(len(which) - toxicity.WINDOW + 1) or whole(self, tables, which))
    assert np.allclose(net.features(w), one_by_one, atol=1e-5)
    assert sum(ran) < 600  # of over 1,000 windows
    # hashes only propose
    monkeypatch.setattr(toxicity, "BASE", 0)
    w.hashes[:] = 7
    start, length, _ = w.windows()
    at = start[length == toxicity.WINDOW]
    words = w.which[at[:, None] + np.arange(toxicity.WINDOW)]
    assert (words[w.alike(at)] == words).all()


def test_quality_features_and_scores_as_document_by_document():
    texts, labels = labelled("quality")
    texts = [*texts, "", " \n", "a\na\n b\n", "é\r\né", "x" * 3000]
    made = quality_gam._rows_of(pa.array(texts))
    want = np.array([featured_plainly(t) for t in texts])
    assert np.abs(made - want).max() < 1e-9
    gam = quality_gam.Gam(made[: len(labels)], labels.astype(float))
    got = gam.score(made)
    for x, score in zip(made, got, strict=True):
        total = gam.base
        for j, cuts in enumerate(gam.cuts):
            total += gam.tables[j][sum(c <= x[j] for c in cuts)]
        for (i, j), t in gam.pairs.items():
            total += t[sum(c <= x[i] for c in gam.coarse[i]), sum(c <= x[j] for c in gam.coarse[j])]
        assert abs(sigmoid(total) - score) < 1e-9


def test_a_repeated_id_is_one_example(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    rows = _labels.training_rows(docs, labels, "toxic", 1).collect()
    assert len(rows) <= 2 and all((r.label, r.text) in ((1, "text 0"), (0, "b")) for r in rows)
    assert [i for i in (1, 2) if zlib.crc32(str(i).encode()) % 3 != 1]


# -- hashes that structured texts don't defeat


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s, s.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 512, 1024, 8192])
def test_thue_morse_words_are_told_apart(spark, n):
    a, b = thue_morse(n)
    data = np.frombuffer((a + b + a).encode(), np.uint8)
    for h in _text.byte_hashes(data, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]), True):
        assert h[0] == h[2] != h[1]
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        model = sentencepiece_bpe.Model(f.read())
    ids = sentencepiece_bpe.encode_batch(model, pa.array([a, b, a]), 0.1, 1, 1)
    assert sentencepiece_bpe.decode_batch(model, ids).to_pylist() == [a, b, a]


def test_thue_morse_documents_have_no_link(spark):
    texts = [x for n in (1024, 2048, 4096, 8192) for x in thue_morse(n)]
    assert sorted(map(tuple, jaccard_join.jaccard_join(frame(spark, texts)).collect())) == [(i, 1, i, 0) for i in range(8)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, texts)).collect()}
    assert got == dict(enumerate(cut_plainly(texts, 200)))


def test_chunks_of_equal_hash_are_held_against_their_bytes(monkeypatch):
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        model = sentencepiece_bpe.Model(f.read())
    texts = pa.array(["one two", "two one three", "one"])
    monkeypatch.setattr(sentencepiece_bpe, "byte_hashes", lambda data, start, end: (np.zeros(len(start), np.uint64),))
    for dropout in (0, 0.3):
        ids = sentencepiece_bpe.encode_batch(model, texts, dropout, 1, 1)
        assert sentencepiece_bpe.decode_batch(model, ids).to_pylist() == texts.to_pylist()


# -- merge-dropout against a plain agenda


def test_dropout_against_a_plain_agenda():
    """Best piece first, leftmost of equals; a pair that its key drops is never merged."""
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        model = sentencepiece_bpe.Model(f.read())
    import pyarrow.parquet as pq

    texts = [t[:400] for t in pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist() if t][:12]
    limit, seed, epoch = int(0.3 * (1 << 32)), 5, 2
    got = sentencepiece_bpe.encode_batch(model, pa.array(texts), 0.3, seed, epoch).to_pylist()
    one = lambda x: np.array([x], np.uint64)
    for text, ids in zip(texts, got, strict=True):
        raw = (" " + text).encode()
        chunks = re.findall(rb" +[^ ]*", raw)
        hs = [_text.byte_hashes(np.frombuffer(c, np.uint8), np.array([0]), np.array([len(c)]))[0] for c in chunks]
        with np.errstate(over="ignore"):
            whole = sum(int(_text.mix(h + _text.mix(one(k + 1)))[0]) for k, h in enumerate(hs))
            own = _text.mix(one((whole + int((_text.mix(_text.mix(one(seed)) + np.uint64(epoch)))[0])) % (1 << 64)))
        out = []
        for k, (c, h) in enumerate(zip(chunks, hs, strict=True)):
            key = _text.mix(h + _text.mix(own + np.uint64(k)))[0]
            letters = [model.space if x == " " else -1 if x == "▁" else int(model.letters[ord(x)]) for x in c.decode()]
            spans = [(i, i + 1, s) for i, s in enumerate(letters)]
            while True:
                offers = []
                for n, ((a, _, x), (m, z, y)) in enumerate(zip(spans, spans[1:], strict=False)):
                    rank = model.pairs.get((x, y))
                    if rank is not None and not sentencepiece_bpe._skipped(np.array([key]), *(np.array([v]) for v in (a, m, z)), limit)[0]:
                        offers.append((rank, a, n))
                if not offers:
                    break
                rank, _, n = min(offers)
                spans[n : n + 2] = [(spans[n][0], spans[n + 1][1], int(model.piece[rank]))]
            for a, z, s in spans:
                out += [s] if s >= 0 else [int(model.bytes[x]) for x in c.decode()[a:z].encode()]
        assert ids == out


def test_parts_that_no_merge_joins_are_encoded_once(monkeypatch):
    with open(sentencepiece_bpe.MODEL, "rb") as f:
        raw = f.read()
    model = sentencepiece_bpe.Model(raw)
    texts = pa.array([" ".join(f"walk{i}, été{i}" for i in range(1000, 1200)), "naïve\u2581x  a,b\n\t" + "мир,мир;" * 40 + "x" * 120, "世界 1,000.5", None, ""])
    plain, dropped = (sentencepiece_bpe.encode_batch(model, texts, rate, 3, 1).to_pylist() for rate in (0, 0.3))
    asked = []
    whole = sentencepiece_bpe._segment
    monkeypatch.setattr(sentencepiece_bpe, "_segment", lambda m, symbols, first, *rest: asked.append(len(first)) or whole(m, symbols, first, *rest))
    sentencepiece_bpe.encode_batch(model, texts.slice(0, 1), 0, 3, 1)
    assert sum(asked) < 20  # of 400 different words
    # whatever lies in columns and whatever letters have a table of their own
    for name, few in (("COLUMN", 1), ("COLUMN", 5), ("BESIDE", 3), ("LETTERS", 2)):
        with monkeypatch.context() as m:
            m.setattr(sentencepiece_bpe, name, few)
            other = sentencepiece_bpe.Model(raw)
            assert sentencepiece_bpe.encode_batch(other, texts, 0, 3, 1).to_pylist() == plain
            assert sentencepiece_bpe.encode_batch(other, texts, 0.3, 3, 1).to_pylist() == dropped


# -- edges


def test_empty_conversations_and_pipeline(spark, tmp_path):
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert [r.conv_id for r in reply_trees.query(spark, str(tmp_path)).collect()] == [-7]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "hi", 1, "x", 2), (1, 1, "assistant", None, 1, "x", 2), (1, 1, "assistant", None, 1, "x", 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int, conv string, parent int")
    assert [r.n_turns for r in reply_trees.format_conversations(turns).collect()] == [3]
    docs = spark.createDataFrame([(1, "a b", 5, "y"), (None, None, 5, "y"), (1, "a b", 5, "y")], "doc_id long, text string, tokens int, decoded string")
    out = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs))
    assert out.columns == ["doc_id", "text", "tokens", "decoded"] and sorted(r.decoded for r in out.collect()) == ["", "a b", "a b"]


def test_pipeline_stages_on_edges(spark):
    rng = np.random.default_rng(31)
    long = " ".join(rng.choice(WORDS, 60_000))
    text = lambda: " ".join(rng.choice(WORDS, 90))
    same = text()
    rows = [(None, text()), (None, text()), (5, same), (5, same), (5, text()), (6, same + " more"), (7, long), (8, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", None, "k", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, row_key string, row_id int, place int, cut_k int")
    good = corpus_pipeline.quality(spark, docs, "")
    assert good.columns == docs.columns and sorted((r.doc_id or 0) for r in good.collect()) == [0, 0, 5, 5, 5, 6]
    once = corpus_pipeline.near_copies(spark, good, "")
    # rows without an id link with nothing; the rows of an id are one vertex, of which the smallest row stays
    assert once.columns == docs.columns and sorted((r.doc_id or 0) for r in once.collect()) == [0, 0, 5]
    cut = corpus_pipeline.repeats(spark, once, "")
    assert cut.columns == docs.columns and cut.count() == 3
    some = corpus_pipeline.mixture(spark, cut, "")
    assert some.columns == docs.columns and some.count() <= 3
    assert all(r.lossless for r in corpus_pipeline.tokens(spark, cut, "").collect())


def test_long_texts(spark):
    rng = np.random.default_rng(33)
    long = " ".join(rng.choice(WORDS, 250_000))
    solid = "".join(rng.choice(list("abcdefgh"), 120_000))
    docs = frame(spark, [long, long + " x", solid, None, ""])
    rules = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert rules[0].n_words == 250_000 and rules[2].n_words == 1
    links = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs).collect()}
    assert links[1][1] == 0 and links[2] == (1, 2) and links[0][0] > 249_000
    back = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs)).select("doc_id", "decoded", "text").collect()
    assert all(r.decoded == (r.text or "") for r in back)


# -- both sides of the switches


@pytest.mark.parametrize("change", [{"BROADCAST_BYTES": -1}, {"COMMON_MOST": 16}, {"UNIT": 64}, {"LISTED": 2}])
def test_jaccard_join_whatever_its_switches(spark, monkeypatch, change):
    for k, v in change.items():
        monkeypatch.setattr(_scratch if k == "BROADCAST_BYTES" else jaccard_join, k, v)
    monkeypatch.setattr(jaccard_join, "BLOCK", ((1 << 13, 4), (1 << 17, 2), (1 << 62, 1)))
    texts = near_copies(40, 120, 3, 1) + near_copies(6, 40, 1, 2) + ["A b c", "a  B\tc", "", None]
    got = sorted((tuple(r) for r in jaccard_join.jaccard_join(frame(spark, texts)).collect()), key=str)
    assert got == link_plainly(list(range(len(texts))), texts)


def test_operators_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(_scratch, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(components, "FEW", 0)
    texts = some_texts()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(frame(spark, texts)).collect()}
    assert got == dict(enumerate(cut_plainly(texts, 200)))
    assert suffix_dedup.without_repeats(frame(spark, texts)).count() == len(texts)
    assert quality_rules.quality_rules(frame(spark, texts)).count() == len(texts)
    assert mixing.mix(frame(spark, texts)).count() == len(texts)
    plan = suffix_dedup.suffix_dedup(frame(spark, texts))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_topk_in_blocks_of_components(spark, monkeypatch):
    rng = np.random.default_rng(35)
    m = rng.standard_normal((40, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, topk_search.top_k(rows, lambda i: i % 2 == 0, k=3).collect()))
    monkeypatch.setattr(topk_search, "BLOCK_COMPONENTS", 20)
    assert sorted(map(tuple, topk_search.top_k(rows, lambda i: i % 2 == 0, k=3).collect())) == whole


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        _scratch.shared_folder(Session)


def test_equal_pages_and_ids_in_archives(spark, tmp_path):
    big = "y" * 1500
    pages = spark.createDataFrame([(4, "u", big), (4, "u", big), (2, "v", big)], "page_id long, url string, html string")
    warc.register(spark)
    warc.write_pages(pages, str(tmp_path / "a"), _scratch.Scratch(spark, "t"))
    kinds = Counter((warc_id, kind) for warc_id, kind in spark.read.format("warc").load(str(tmp_path / "a")).select(warc.page_id(F.col("record_id")), "record_type").collect())
    assert kinds == {(4, "response"): 2, (2, "revisit"): 1}
    assert queries.QUERIES
