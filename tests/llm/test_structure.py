"""Repair of conversations, runs of words and token counts against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sparkdesk.llm import repair, runs, token_counts
from sparkdesk.llm.queries import QUERIES
from sparkdesk.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
PIECES = vocabulary("piece_bpe_32k.model")
WHITE = " \t\n\x0b\x0c\r"


# repair


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        role, text = say(role), say(text)
        d = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else "".join(c for c in text if c not in ".!?") if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def cheapest(rows, faults):
    """The least (cost, audit) over all edits, forward over every state, and what it leaves."""
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                t = following[s]
                more = (cost + 2, audit + "I", [*lines, name[t] + ":"])
                best[t] = min(best.get(t, more), more)
        return best

    best = with_inserts({"": (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faults):
        new = {}

        def offer(s, cost, audit, lines):
            new[s] = min(new.get(s, (cost, audit, lines)), (cost, audit, lines))

        for s, (cost, audit, lines) in best.items():
            offer(s, cost + 3, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            extra = fault == "truncated"
            if role[:1] and role[0] in allowed[s]:
                offer(role[0], cost + extra, audit + "K", [*lines, f"{role}:{text}"])
            t = following[s]
            offer(t, cost + 2 + extra, audit + "R", [*lines, f"{name[t]}:{text}"])
        best = with_inserts(new)
    return min(v for s, v in best.items() if s in ("", "a"))


def expected_repair(rows, order):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]]
    for r in damage(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], order[r[3]]))
        seen, faults = set(), []
        for _, _, role, text in own:
            body = text.strip(WHITE)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = {r[1] for r in own if r[1] is not None}
        heads = [r[2][:1] for r in own]
        cost, audit, lines = cheapest(own, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def hashes(spark, rows):
    texts = sorted({r[3] for r in damage(rows)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h"))
    return {r.text: r.h for r in df.collect()}


def as_dict(df):
    return {r.conv_id: tuple(r[c] for c in [*repair.COUNTS, "audit", "repaired_sha256"]) for r in df.collect()}


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(QUERIES["op11_repair"](spark, SF)) == expected_repair(rows, hashes(spark, rows))


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repair_of_odd_conversations(spark, block):
    """Nulls in any column, ties, repeated rows, far turns, a conversation with most rows, one of which no row is left."""
    chance = random.Random(7)
    texts = ["Yes.", "No", "", " \n", None, "Why?", "Because", "x" * 50_000 + ".", "\x1c", "Ende。"]
    roles = ["user", "assistant", "system", "tool", None, "", "ursula", "a"]
    rows = [
        (chance.choice([1, 1, 1, 1, 2, 3, None, 2**62]), chance.choice([None, *range(12), -(2**62), 2**62]),
         chance.choice(roles[:3] * 2 + roles), chance.choice(texts)) for _ in range(160)
    ]
    gone = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Gone."), (5, None, "user", "Same."), (5, None, "user", "Same.")] + [(6, 1, "user", "Again.")] * 9
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seq string, whole int")
    summary, pieces = repair.repair(repair.damaged(df.repartition(4)), block)
    got = as_dict(repair.with_all(df, summary, repair.text_digests(pieces)))
    want = expected_repair(rows, hashes(spark, rows))
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    summary, pieces = repair.repair(repair.damaged(none))
    assert repair.with_all(none, summary, repair.text_digests(pieces)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x"]), st.sampled_from([0, 1, 2, 3])), max_size=9), st.integers(1, 4))
def test_cheapest_edits(rows, cut):
    named = ["", "blank", "duplicate", "truncated"]
    given_rows = [(0, i, role, "t") for i, (role, _) in enumerate(rows)]
    want = cheapest(given_rows, [named[f] for _, f in rows])
    codes = bytes(repair.role_class(role) + 4 * f for role, f in rows)
    if codes:
        edits, _, cost = repair.walk(codes, repair.AT_END, repair.START, True)
        lines = repair.repaired_lines(edits, [r for r, _ in rows], ["t"] * len(rows), repair.START)
        assert (cost, "".join(edits), lines) == (want[0], want[1], "\n".join(want[2]))
        after = repair.AT_END
        for i in reversed(range(0, len(codes), cut)):  # the same by blocks
            costs = repair._summary(codes[i : i + cut])["costs"]
            after = tuple(min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4))
        assert after[repair.START] == want[0]


# runs


def brute_lyndon(words):
    n, out = len(words), []
    for i in range(n):
        j = i + 1
        while j < n and words[j:] > words[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(words):
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            if j > i and len(own) >= max(6, 4 * q) and not any(own[d:] == own[: len(own) - d] for d in range(1, q)):
                found.add((i, len(own), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_grouping_gives_lyndon_arrays(words):
    assert runs.lyndon_array(words) == brute_lyndon(words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=4), st.integers(1, 9)), max_size=6))
def test_runs_of_words(pieces):
    words = [w for part, times in pieces for w in part * times]
    texts = [words, [], words[::-1], [b"a"] * 7]
    assert runs.search(texts) == [brute_runs(t) for t in texts]


def expected_runs(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in found)]
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def with_repeats(docs):
    return runs.run_digests(runs.find_runs(docs.select("doc_id", runs.repeat_passage(F.col("doc_id"), F.col("text")).alias("text"))))


def key(row):
    return (row[0] is not None, row[0] or 0, *map(str, row[1:]))


def test_runs_query(spark, odd_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 6000)
    short = {r.doc_id for r in docs.select("doc_id").collect()}
    got = [tuple(r) for r in QUERIES["op12_runs"](spark, SF).collect() if r.doc_id in short]
    assert sorted(got, key=key) == sorted((expected_runs(r.doc_id, r.text) for r in docs.collect()), key=key)
    odd = odd_docs.where(F.coalesce(F.length("text"), F.lit(0)) < 100_000)
    assert sorted(map(tuple, with_repeats(odd).collect()), key=key) == sorted(
        (expected_runs(r.doc_id, r.text) for r in odd.collect()), key=key
    )
    long = with_repeats(odd_docs.where("doc_id = 8")).first()
    assert (long.start, long.length, long.period, long.n_runs) == (0, 60_000, 1, 1)
    assert with_repeats(no_docs).count() == 0


def test_long_hostile_runs():
    for words in ([1, 2] * 100_000, list(range(100_000)), [1] * 50_000 + [2] + [1] * 50_000):
        found = runs.runs_of(np.array(words))
        assert found == ([(0, 200_000, 2)] if words[:2] == [1, 2] and len(words) == 200_000 else [] if words[0] == 0 else [(0, 50_000, 1), (50_001, 50_000, 1)])


# token counts


def library(texts):
    return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PIECES).encode([t or "" for t in texts], num_threads=1)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\t'stheinrd.,!09aé東<>"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=5))
def test_transducer_counts_like_the_library(texts):
    assert token_counts.transducer(PIECES).counts(texts) == library(texts)


def test_long_texts_without_words():
    chance = random.Random(3)
    texts = ["x" * 5000, "xy" * 3000, "東京都" * 900, " " * 3000, "=-" * 2222, "1" * 999, "the" * 1111, "\U0001f600" * 500, None, ""]
    texts += ["".join(chance.choice(letters) for _ in range(3000)) for letters in ("abc", "aeinorst", "東京ab", "\x00\x01a", "012.")]
    assert token_counts.transducer(PIECES).counts(texts) == library(texts)


def test_chunks_and_slices_of_any_size(monkeypatch):
    chance = random.Random(4)
    texts = ["".join(chance.choice("then  \n東x") for _ in range(chance.randint(0, 400))) for _ in range(40)] + ["ab" * 300, "x" * 500]
    want = library(texts)
    t = token_counts.Transducer(token_counts.transducer(PIECES).scores)
    for chunk, size, kept, starts in ((1, 64, 10**6, 16), (7, 50, 20, 16), (20, 10**6, 10**6, 1)):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        monkeypatch.setattr(token_counts, "SLICE", size)
        monkeypatch.setattr(token_counts, "KEPT_STATES", kept)
        monkeypatch.setattr(token_counts, "STARTS", starts)
        assert t.counts(texts) == want


def test_token_count_query(spark, odd_docs, no_docs):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, len((t or "").encode()), n, n > 4096) for (d, t), n in zip(docs, library([t for _, t in docs])))
    assert sorted(map(tuple, QUERIES["op13_token_counts"](spark, SF).collect())) == want
    odd = [tuple(r) for r in odd_docs.select("doc_id", "text").collect()]
    want = sorted((len((t or "").encode()), n) for (_, t), n in zip(odd, library([t for _, t in odd])))
    assert sorted((r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd_docs, PIECES).collect()) == want
    assert token_counts.count_tokens(no_docs, PIECES).count() == 0
