"""Operators on texts against brute force, and on rows at the edges."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from sparkdesk.llm import binary_ids, lm_scoring, mixing, near_dup, packing, sharding, toxicity, url_filter
from sparkdesk.llm.queries import QUERIES
from sparkdesk.llm.tokens import encoder, vocabulary

SF = "/root/testdata/sf0.001"
WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def ids_of(path, texts, end):
    t = Tokenizer.from_file(path)
    return [np.array([*e.ids, end], dtype="<u4").tobytes() for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path, kind", [(WORDS, "words"), (BYTES, "bytes")])
@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.sampled_from([*" \n\t'stremd.,!09aAéÉœß$  ", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>"]), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join), min_size=1, max_size=4))
def test_pieces_give_the_ids_of_the_whole(path, kind, texts):
    assert encoder(path, kind).ids(texts) == [x[:-4] for x in ids_of(path, texts, 0)]


def check_pieces(rows, docs):
    left = {}
    for doc_id, text in docs:
        left.setdefault(doc_id, []).append(text)
    ids = {d: ids_of(WORDS, texts, 1)[0] for d, texts in left.items() if len(texts) == 1}
    for r in rows:
        if r.doc_id in ids:
            own = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
            assert (zlib.crc32(own), r.doc_tokens) == (r.ids_crc32, len(ids[r.doc_id]) // 4)
    for d in ids:
        pieces = sorted((r.start, r.length) for r in rows if r.doc_id == d)
        assert [s for s, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        assert sum(n for _, n in pieces) == len(ids[d]) // 4
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
        sizes.append(sum(n for _, n in pieces))
    assert max(sizes, default=0) <= packing.WINDOW and sum(s < packing.WINDOW for s in sizes) <= 1


def test_packing(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_pieces(QUERIES["op1_packing"](spark, SF).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    odd = packing.pack(odd_docs, WORDS).collect()
    check_pieces(odd, [tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert sum(r.start == 0 for r in odd) == odd_docs.count()
    assert packing.pack(no_docs, WORDS).count() == 0


def test_counts_fit_the_histogram():
    counts = np.zeros(2049, dtype=np.int64)
    counts[[100, 1948, 1000, 1048, 500]] = [50, 60, 70, 20, 80]
    plan = packing.make_plan(counts)
    assert plan.whole >= 70  # pairs of 100 + 1948 and 1000 + 1048, triples of 500 + 500 + 1048 or the like
    assert plan.whole * 2048 + plan.residual == int((counts * np.arange(2049)).sum())


def test_binary_ids(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want, at = [], 0
    for (d, _), ids in zip(docs, ids_of(BYTES, [t for _, t in docs], 0)):
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(tuple(r) for r in QUERIES["op5_binary_ids"](spark, SF).collect()) == want
    odd = binary_ids.round_trip(odd_docs, BYTES).collect()
    wanted = sorted(zlib.crc32(x) for x in ids_of(BYTES, [r.text for r in odd_docs.collect()], 0))
    assert sorted(r.ids_crc32 for r in odd) == wanted
    odd.sort(key=lambda r: r.start)
    assert [r.start for r in odd] == [sum(x.n_tokens for x in odd[:i]) for i in range(len(odd))]
    assert [r.doc_id for r in odd] == sorted((r.doc_id for r in odd), key=lambda d: -1 if d is None else d)
    assert binary_ids.round_trip(no_docs, BYTES).count() == 0


def test_one_document_is_read_alone():
    arrays = [np.arange(n, dtype="<u4").tobytes() for n in (0, 5, 3000)]
    for dictionary in (b"", b"some shared bytes " * 40):
        content = binary_ids.file_bytes([1, None, 3], arrays, dictionary)
        assert [binary_ids.read_document(content, i, dictionary) for i in range(3)] == list(zip([1, None, 3], arrays))
    with pytest.raises(ValueError):
        binary_ids.read_document(content, 0, b"another")


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[range(side)] * dims)).reshape(dims, -1).T
        at = sharding.hilbert_index(cells, bits)
        assert sorted(at) == list(range(side**dims))
        path = cells[np.argsort(at)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_sharding(spark, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows = sharding.hilbert_shards(docs).collect()
        sizes = [sum(r.shard == s for r in rows) for s in range(8)]
        assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
        assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
        want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for (t,) in docs.select("text").collect())
        assert sorted((r["size"], r.text_crc32) for r in rows) == want
    assert sharding.hilbert_shards(no_docs).count() == 0


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(docs):
    sets, root = {}, {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingle_set(t))
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if any(x and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in names}


def test_near_duplicates(spark, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows = near_dup.near_duplicates(docs).collect()
        pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        want = components_of([p for p in pairs if p[0] is not None])
        assert len(rows) == len(pairs)
        assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
        assert sorted(r.n_shingles for r in rows) == sorted(len(shingle_set(t)) for _, t in pairs)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in rows)
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_chains_and_large_groups_meet(spark):
    """A chain of near copies, and a group whose members are far from each other but near one of them."""
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words[: 100 + 4 * i][4 * i :] + words[100 + 4 * i : 100 + 4 * i]) for i in range(6)]
    hub = [f"h{i}" for i in range(120)]
    spokes = [" ".join(x if not (k * 7) % 110 <= j < (k * 7) % 110 + 9 else f"s{k}_{j}" for j, x in enumerate(hub)) for k in range(30)]
    docs = [*enumerate(chain), (100, " ".join(hub)), *((200 + k, s) for k, s in enumerate(spokes))]
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == components_of(docs)


def test_groups_without_a_centre(spark):
    """Near copies that are mostly too far from each other: buckets stay mixed, and the few links are all found."""
    hub = [f"h{i}" for i in range(120)]
    cut = lambda k, n: " ".join(x if not (k * 7) % 110 <= j < (k * 7) % 110 + n else f"s{k}_{j}" for j, x in enumerate(hub))
    docs = [(k, cut(k, 9 if k % 4 else 5)) for k in range(40)]
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = components_of(docs)
    assert {r.doc_id: r.component_id for r in rows} == want and 1 < len(set(want.values())) < 40


def test_groups_in_many_blocks(spark, monkeypatch):
    """Buckets that are cut for joins, and blocks cut by rows or by shingles, lose no link."""
    hub = [f"h{i}" for i in range(120)]
    cut = lambda k, n: " ".join(x if not (k * 7) % 110 <= j < (k * 7) % 110 + n else f"s{k}_{j}" for j, x in enumerate(hub))
    docs = [(k, cut(k, 9 if k % 4 else 5)) for k in range(40)]
    want = components_of(docs)
    for name, value in (("MINOR_BLOCK", 3), ("MAJOR_BLOCK", 5), ("HOT_ROWS", 4), ("BLOCK_ITEMS", 300)):
        monkeypatch.setattr(near_dup, name, value)
    rows = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 40 and {r.doc_id: r.component_id for r in rows} == want


def test_links_between_components():
    texts = ["a b c d e f g h i j k l m n o p", "a b c d e f g h i j k l m n o q", "a b c d e f g h i j k l m n o r", "z b c d e f g h i j k l m n o p"]
    items = [near_dup.shingles(t).view(np.int64) for t in texts]
    sketches = [near_dup.sketch(x.view(np.uint64)) for x in items]
    sigs, keys = [(s & np.uint64(255)).astype(np.uint8) for s in sketches], [near_dup.band_keys(s) for s in sketches]
    band = int(np.flatnonzero(keys[1] == keys[2])[0])
    rows = [(True, 7, band, i, c, 0, sigs[i].tobytes(), keys[i], items[i]) for i, c in ((2, 2), (0, 0), (1, 0), (2, 2), (3, 3))]
    f = pd.DataFrame(rows, columns=["minor", "bucket", "band", "id", "component", "leader", "sig", "bands", "items"])
    f.loc[1:, "minor"] = False
    found = near_dup._links_between(f)
    assert found.values.tolist()[:1] == [[1, 2]] and len(found) <= 2 and all(found.dtypes == "int64")
    for a, b in found.itertuples(index=False):
        n = len(np.intersect1d(items[a], items[b]))
        assert 100 * n >= 75 * (len(items[a]) + len(items[b]) - n)


def test_sketches_estimate_similarity():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(250, 1250, dtype=np.uint64)
    mixed = [near_dup.sketch(near_dup._mix(x + np.uint64(7))) for x in (a, b)]
    assert abs((mixed[0] == mixed[1]).mean() - 0.6) < 0.2
    assert (near_dup.sketch(a[:1]) != np.iinfo(np.uint64).max).all()


def test_disguised_words_are_restored():
    words = {"stupid": 50, "idiot": 50, "moron": 50, "loser": 50, "trash": 50, "there": 90, "other": 80, "the": 200}
    model = toxicity.Characters(toxicity.Characters.count(words).reshape((toxicity._SIZE,) * 3))
    for given_, want in (("1d10t", "idiot"), ("m.o.r.o.n", "moron"), ("tr4sh", "trash"), ("l0$er", "loser"), ("stuuupid", "stupid")):
        assert want in toxicity.readings(given_, model)
    assert toxicity.readings("there,", model) == ["there"]
    assert toxicity.restored_text("you m o r o n !", model).split()[1].startswith("moron")


def test_words_written_apart_keep_their_boundaries():
    words = {"you": 200, "are": 150, "a": 300, "idiot": 50, "moron": 50, "worthless": 40, "the": 200, "shit": 50, "asshole": 50}
    model = toxicity.Characters(toxicity.Characters.count(words).reshape((toxicity._SIZE,) * 3))
    for text, want in (("a m o r o n", "moron"), ("so y o u i d i o t !", "idiot"), ("y o u a r e a m 0 r o n", "moron"), ("a w o r t h l e s s", "worthless")):
        assert want in [w for t in toxicity.split(text) for w in toxicity.readings(t, model)]
    for token, want in (("5h17", "shit"), ("$h1+", "shit"), ("!d!0+", "idiot"), ("m...o...r...o...n", "moron")):
        assert want in toxicity.readings(token, model)
    for token in ("1995", "there,", "$5.00"):
        assert len(toxicity.readings(token, model)) == 1
    # a run is walked once for each beginning, however long, and may hold nothing but separators
    assert toxicity.readings(" ".join("-" * 200), model) == [] and "moron" in toxicity.readings(" ".join("moron" + "-" * 200), model)


def test_trigram_counts():
    got = toxicity.Characters.count({"ab": 3, "b": 2}).reshape((toxicity._SIZE,) * 3)
    assert got[0, 0, 1] == 3 and got[0, 1, 2] == 3 and got[1, 2, 0] == 3 and got[0, 0, 2] == 2 and got[0, 2, 0] == 2
    assert got.sum() == 3 * 3 + 2 * 2


def test_toxicity_learns_and_holds_out(spark, odd_docs, no_docs):
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        rows.append((i, f"filler words number {i} and some more " + ("you zork st1nker" if bad else "you friend"), "en", "a", 1))
        labels.append((i, 1, int(bad) if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - int(bad)))  # held-out labels are turned round
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    found = toxicity.score_documents(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    for r in found:
        assert r.predicted == int(r.doc_id % 8 == 0) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    tags = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    odd = toxicity.score_documents(odd_docs, tags).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score_documents(no_docs, tags.limit(0)).count() == 0


def listed(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, name, start in url_filter.LIST:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best[0])):
            best = (name + start, verdict)
    return host, path, *(best or (None, None))


def test_url_rules(spark):
    rows = QUERIES["op7_url_rules"](spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule, verdict = listed(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.matched else "allow"))


def test_mined_url_rules(spark):
    good = [(i, f"http://site{i % 7}.net/en/page", False) for i in range(120)]
    bad = [(200 + i, f"https://WWW.casino.net/win/{'abcd'[i % 4]}?x#y", True) for i in range(40)]
    odd = [(500, None, None), (501, "no scheme/en", None), (502, "http://", None), (503, "http://casino.net", None), (504, "a://sub.Example.ORG/en/1", None), (504, "a://sub.Example.ORG/en/1", None)]
    pages = spark.createDataFrame([(i, u, "h") for i, u, _ in [*good, *bad, *odd]], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, b) for i, _, b in [*good, *bad] if i % 2], "page_id long, blocked boolean")
    rows = url_filter.judge_urls(pages, labels).collect()
    assert len(rows) == pages.count()
    by = {r.page_id: r for r in rows}
    assert all(by[i].verdict == "allow" for i, _, _ in good) and all(by[i].verdict == "block" for i, _, _ in bad)
    assert (by[500].host, by[500].path, by[500].verdict) == ("", "", "allow") and by[502].host == ""
    assert by[503].verdict == "block" and by[504].rule == "example.org/en/1"
    assert url_filter.judge_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_every_bad_host_keeps_a_rule(spark):
    """Hosts of different support, whose combinations of tokens are far more than the rules that pruning leaves."""
    urls = [(f"http://www.casino{h}.net/win/a", True) for h in range(40) for _ in range(10 + h)]
    urls += [(f"http://www.fine{h}.net/win/a", False) for h in range(60) for _ in range(50)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, (_, b) in enumerate(urls)], "page_id long, blocked boolean")
    for r in url_filter.judge_urls(pages, labels).collect():
        assert r.verdict == ("block" if urls[r.page_id][1] else "allow")
        assert len(r.matched or []) == int(urls[r.page_id][1])


def test_backoff_scores(spark, odd_docs, no_docs):
    rows = [(1, "a b a b"), (2, "a b c"), (3, None), (4, ""), (None, "c c"), (5, "a b a b")]
    got = {r.doc_id: r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, c1 = 13, {"a": 5, "b": 5, "c": 3}
    c2 = {"ab": 5, "ba": 2, "bc": 1, "cc": 1}

    def score(t):
        w, total, back = t.split(), 0.0, 0
        for i, x in enumerate(w):
            pair = w[i - 1] + x if i else None
            if pair and c2[pair] >= 2:
                total += np.log10(c2[pair] / c1[w[i - 1]])
            else:
                total += np.log10(c1[x] / n) + (np.log10(0.4) if pair else 0)
                back += bool(pair)
        return len(w), back, round(total / len(w), 6)

    for d, t in rows:
        if t:
            assert (got[d].n_words, got[d].backed_off) == score(t)[:2] and abs(got[d].score - score(t)[2]) < 1e-9
    assert got[3].score is None and got[4].n_words == 0
    assert lm_scoring.score_documents(odd_docs, order=3).count() == odd_docs.count()
    assert lm_scoring.score_documents(no_docs).count() == 0


def test_trigram_scores(spark):
    """The registered query against a walk over all documents, with both steps of backing off."""
    docs = [(r.doc_id, re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    c = {}
    for _, w in docs:
        for i in range(len(w)):
            for k in range(1, min(3, i + 1) + 1):
                g = tuple(w[i + 1 - k : i + 1])
                c[g] = c.get(g, 0) + 1
    n, want = sum(len(w) for _, w in docs), {}
    for d, w in docs:
        total = back = 0
        for i in range(len(w)):
            most = k = min(3, i + 1)
            while k > 1 and c[tuple(w[i + 1 - k : i + 1])] < 2:
                k -= 1
            g = tuple(w[i + 1 - k : i + 1])
            total += np.log10(c[g] / (c[g[:-1]] if k > 1 else n)) + (most - k) * np.log10(0.4)
            back += k < most
        want[d] = (len(w), back, total / len(w) if w else None)
    rows = QUERIES["op9_trigrams"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words, back, score = want[r.doc_id]
        assert (r.n_words, r.backed_off) == (words, back)
        assert r.score is None if score is None else abs(r.score - score) < 1e-5
