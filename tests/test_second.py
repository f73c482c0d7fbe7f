"""Queries without SQL, held over the whole table against plain versions."""

import difflib
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from conftest import SF

from quire import catalog
from quire.model import T
from quire.plans import contents
from quire.sources import html

Q = catalog.queries()


@pytest.fixture(scope="module")
def texts():
    t = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return {int(i): x for i, x in zip(t["doc_id"], t["text"], strict=True) if x is not None}


@pytest.fixture(scope="module")
def pairs():
    c = pq.read_table(f"{SF}/conversations.parquet").to_pandas()
    said = {(r.conv_id, r.turn, r.role): r.text for r in c.itertuples()}
    out = defaultdict(list)
    for (conv, turn, role), text in sorted(said.items()):
        if role == "user" and (conv, turn + 1, "assistant") in said:
            out[conv].append((turn, text, said[conv, turn + 1, "assistant"]))
    return out


def lines(text):
    return [x for x in text.split("\n") if x.strip(" ") != ""]


def n_words(text):
    return len(re.sub(r"</?[a-zA-Z][^>]*>", " ", text).split())


def test_size_batches(spark, texts):
    want = []
    for i, t in texts.items():
        batch, held, sums = 0, 0, Counter()
        for n, x in enumerate(lines(t)):
            if n and held + len(x) > T.fix_chars:
                batch, held = batch + 1, 0
            held += len(x)
            sums[batch] += len(x)
        count = Counter()
        batch, held = 0, 0
        for n, x in enumerate(lines(t)):
            if n and held + len(x) > T.fix_chars:
                batch, held = batch + 1, 0
            held += len(x)
            count[batch] += 1
        want += [(i, b, count[b], sums[b]) for b in count]
    assert sorted(map(tuple, Q["size_batches"](spark, SF).collect())) == sorted(want)


def test_chunk_plan(spark, texts):
    got = defaultdict(list)
    for r in Q["chunk_plan"](spark, SF).collect():
        got[r.doc_id].append((r.chunk, r.blocks, r.words))
    assert set(got) == {i for i, t in texts.items() if lines(t)}
    cut = 0
    for i, parts in got.items():
        own = [n_words(x) for x in lines(texts[i])]
        parts.sort()
        assert [c for c, *_ in parts] == list(range(len(parts)))
        at = 0
        for _, blocks, words in parts:
            assert sum(own[at : at + blocks]) == words
            at += blocks
        assert at == len(own)
        if sum(own) <= T.max_words and len(own) <= T.max_blocks:
            assert len(parts) == 1
        else:
            cut += 1
            # no part is over the limits by more than a block, and none but the first ends with crumbs
            assert all(b <= T.max_blocks + 1 for _, b, _ in parts)
            assert len(parts) > 1 or len(own) == 1 or max(own) > 0.5 * sum(own)
    assert cut


def test_glossary_budget(spark):
    c = pq.read_table(f"{SF}/conversations.parquet").to_pandas().sort_values(["conv_id", "turn"], kind="stable")
    got = {(r.conv_id, r.turn): r.terms for r in Q["glossary_budget"](spark, SF).collect()}
    for conv, part in c.groupby("conv_id"):
        texts = [t or "" for t in part["text"]]
        terms: dict[str, str] = {}
        for k, (turn, text) in enumerate(zip(part["turn"], texts, strict=True)):
            entry = {a: f"{a} = {b}" for a, b in terms.items()}
            low = text.lower()
            hot = [e for a, e in entry.items() if any(re.search(rf"\b{re.escape(w)}", low) for w in [x.removesuffix("s") for x in sorted(a.lower().split(), key=len)[-2:] if len(x) >= 4])]
            used, n = 0, 0
            for e in hot:
                if used + len(e) + 1 <= T.terms_budget:
                    used, n = used + len(e) + 1, n + 1
            left = min(T.terms_budget - used, T.terms_tail)
            for e in reversed([e for e in entry.values() if e not in hot]):
                if len(e) + 1 > left:
                    break
                left, n = left - len(e) - 1, n + 1
            assert got[conv, turn] == n, (conv, turn)
            words = text.split()
            if len(words) > 1 and words[1].strip().lower() not in ("none", "нет", "—", "-"):
                terms.setdefault(*words[:2])
            assert k < len(texts)


def test_similarity_twins(spark, pairs):
    alike = lambda a, b: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= T.twin_near
    want = {}
    for conv, rows in pairs.items():
        both = zip(rows[:-1], rows[1:], strict=True)
        want[conv] = sum(1 for (_, s, t), (_, u, v) in both if min(len(t), len(v)) >= T.twin_len and alike(t, v) and not alike(s, u))
    assert {r.conv_id: r.twins for r in Q["similarity_twins"](spark, SF).collect()} == want


def test_reanchor_ids(spark, texts):
    got = defaultdict(dict)
    for r in Q["reanchor_ids"](spark, SF).collect():
        got[r.doc_id][r.old_id] = r.new_id
    moved = 0
    for i, t in texts.items():
        old = lines(t)
        new = list(dict.fromkeys(old))
        norm = lambda x: " ".join(re.sub(r"</?[a-zA-Z][^>]*>", "", x).split())
        for a, b in got[i].items():
            assert norm(old[int(a[5:]) - 1]) == norm(new[int(b[5:]) - 1])
        once = Counter(map(norm, old))
        for k, x in enumerate(new, 1):
            was = old.index(x) + 1
            if once[norm(x)] == 1 and was != k:
                moved += 1
                assert got[i].get(f"s01.b{was:04d}") == f"s01.b{k:04d}"
        if len(new) == len(old):
            assert not got[i]
    assert moved


def test_link_pages(spark, texts):
    import hashlib

    got = defaultdict(dict)
    for r in Q["link_pages"](spark, SF).collect():
        got[r.doc_id][r.pos] = (r.n_links, r.digest)
    linked = 0
    for i, t in texts.items():
        rows = t.split("\n")
        assert set(got[i]) == set(range(len(rows)))
        last = (len(rows) - 1) // 3 + 1
        for pos, x in enumerate(rows):
            n, digest = got[i][pos]
            if not n:
                assert digest == hashlib.md5(x.encode()).hexdigest()
            else:
                linked += 1
                assert digest != hashlib.md5(x.encode()).hexdigest() and pos // 3 + 1 <= last
        # nothing stands after the last page to link to
        firsts = sum(1 for p, x in enumerate(rows) if re.search(r"[^\W\d_]{2,}", x) and p // 3 + 1 < last)
        assert sum(n for n, _ in got[i].values()) <= firsts
    assert linked > 1000


def test_reconcile_contents(spark, texts):
    for r in Q["reconcile_contents"](spark, SF).collect():
        pieces = lines(texts.get(r.doc_id) or "")
        listed = [x for p in pieces[:2] for x in contents.entries(p)]
        assert r.names <= len({contents.title(x) for x in listed}) and r.lost <= r.names and r.dropped <= len(pieces)


def test_style_census(spark):
    seen = defaultdict(list)
    t = pq.read_table(f"{SF}/pages.parquet").to_pandas().sort_values("page_id")
    for h in t["html"]:
        for tag, cls, sample in html.read(h).census:
            seen[tag, cls].append(sample)
    got = {(r["tag"], r["cls"]): (r["count"], r["samples"]) for r in Q["style_census"](spark, SF).collect()}
    assert set(got) == set(seen)
    for k, samples in seen.items():
        first = samples[:60]
        n = min(3, len(first))
        at = [int(i * (len(first) - 1) / max(n - 1, 1) + 0.5) for i in range(n)]
        assert got[k] == (len(samples), [first[i] for i in at])


def test_html_blocks(spark):
    t = pq.read_table(f"{SF}/pages.parquet").to_pandas()
    got = defaultdict(list)
    for r in Q["html_blocks"](spark, SF).orderBy("page_id", "pos").collect():
        got[r.page_id].append(r)
    for i, h in zip(t["page_id"], t["html"], strict=True):
        bare = re.sub(r"<!--.*?-->", "", re.sub(r"<(script|style|title)\b.*?</\1>", "", h, flags=re.S), flags=re.S)
        import html as entities

        letters = lambda x: re.sub(r"[\W_]", "", x)
        said = letters(entities.unescape(re.sub(r"<[^>]*>", " ", bare)))
        assert letters("".join(re.sub(r"</?\w+>", "", b.text) for b in got[i])) == said
        assert sum(b.kind == "title" for b in got[i]) == len(re.findall(r"<h[12]\b", bare))
        assert sum(len(b.links or []) for b in got[i]) == len(re.findall(r"<a\b[^>]*href=", bare))
        assert len({b.id for b in got[i]}) == len(got[i])


def test_encodings(spark, texts):
    got = defaultdict(lambda: [0, 0])
    for r in Q["encoding_detect"](spark, SF).collect():
        got[r.name][0] += r.right
        got[r.name][1] += r.n
    assert got["utf-8"] == [len(texts)] * 2 and got["utf-16"][1] == len(texts) and got["cp1252"][1] > 0.9 * len(texts)
    assert got["utf-16"][0] == len(texts) and got["cp1252"][0] > 0.9 * got["cp1252"][1]
