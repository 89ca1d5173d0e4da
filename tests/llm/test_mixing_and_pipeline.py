"""Budgets against a plain recursion, token prefixes, and the stages of the pipeline."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkdesk.llm import mixing
from sparkdesk.llm.queries import QUERIES, tree_levels

SF = "/root/testdata/sf0.001"


def filled(total, children):
    """Water-filling by hand over {name: (weight, capacity)}, in real numbers."""
    out, left, rest = {}, total, dict(children)
    while rest:
        weight = sum(w for w, _ in rest.values())
        over = [c for c, (w, cap) in rest.items() if w > 0 and left * w / weight >= cap] if weight else []
        if not over:
            out |= {c: (left * w / weight if weight else 0.0) for c, (w, _) in rest.items()}
            break
        for c in over:
            out[c] = rest.pop(c)[1]
        left = total - sum(out.values())
    return out


def test_shortages_go_to_siblings_first(spark):
    leaves = [
        ("d1", "en", "a", 100, 1.0, 3.0, 1.0), ("d1", "en", "b", 5, 1.0, 3.0, 1.0), ("d1", "de", "a", 10, 1.0, 1.0, 1.0),
        ("d2", "en", "a", 40, 2.0, 1.0, 5.0), (None, "en", "a", 7, 1.0, 1.0, 1.0), ("d3", "en", "a", 50, 0.0, 1.0, 1.0),
    ]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long, w0 double, w1 double, w2 double")
    rows = mixing.budgets(df, ["domain", "lang", "source"], ["w0", "w1", "w2"], F.lit(150) + F.max(F.lit(0)), epochs=1).collect()
    got = {(r.domain, r.lang, r.source): r.budget for r in rows}
    top = filled(150, {"d1": (1, 115), "d2": (2, 40), None: (1, 7), "d3": (0, 50)})
    d1 = filled(top["d1"], {"en": (3, 105), "de": (1, 10)})
    en = filled(d1["en"], {"a": (1, 100), "b": (1, 5)})
    want = {("d1", "en", "a"): en["a"], ("d1", "en", "b"): en["b"], ("d1", "de", "a"): d1["de"], ("d2", "en", "a"): top["d2"], (None, "en", "a"): top[None], ("d3", "en", "a"): 0}
    assert sum(got.values()) == 150 and all(abs(got[k] - want[k]) <= 1 for k in want)


def test_prefixes_fill_their_budgets(spark):
    rows = [(i, "d", "en", "hot" if i % 3 else f"s{i % 5}", i % 7) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long")
    weights = [F.lit(1.0), F.lit(1.0), F.when(F.col("source") == "s0", 9.0).otherwise(1.0)]
    got = mixing.mix(docs, ["domain", "lang", "source"], weights).collect()
    again = mixing.mix(docs, ["domain", "lang", "source"], weights).collect()
    assert sorted(got) == sorted(again) and sum(r.taken for r in got) == sum(r[4] for r in rows)
    leaves = {}
    for r in got:
        leaves.setdefault(r.source, []).append(r)
    for name, taken in leaves.items():
        taken.sort(key=lambda r: (r.start, r.n_tokens))
        at = 0
        for r in taken:
            assert r.start == at
            at += r.taken
        assert sum(r.taken < r.n_tokens for r in taken) <= 1
        whole = max(r.epoch for r in taken)
        for e in range(whole):
            assert sorted(r.doc_id for r in taken if r.epoch == e) == sorted(d for d, _, _, s, _ in rows if s == name)
    assert max(r.epoch for r in leaves["s0"]) > 0


def by_hand(rows, weights, epochs=mixing.EPOCHS):
    """How many tokens each leaf of a one-level tree gives, and which rows without tokens are taken, by plain loops."""
    leaves = {}
    for doc_id, leaf, n in rows:
        leaves.setdefault(leaf, []).append((doc_id, n))
    total = {leaf: sum(n for _, n in own) for leaf, own in leaves.items()}
    share = filled(sum(total.values()), {leaf: (weights.get(leaf, 1.0), epochs * t) for leaf, t in total.items()})
    free = {leaf: sorted(d for d, n in own if n == 0) for leaf, own in leaves.items() if weights.get(leaf, 1.0) > 0}
    return share, total, free


def test_every_row_is_accounted_for(spark):
    """Leaves without tokens, below one epoch and above it, ids that repeat, rows alike."""
    rows = [(1, "en", 50), (2, "fr", 0), (3, "fr", 0), (4, "de", 7), (5, "de", 0), (6, "off", 9), (7, "off", 0), (8, "es", 40), (9, "es", 0)]
    rows += [(10, "es", 30)] * 5 + [(11, "it", 0)] * 3 + [(12, "de", n) for n in range(9)] + [(None, "en", 2), (None, "en", 0)]
    weights = {"off": 0.0, "de": 6.0, "es": 0.5}
    docs = spark.createDataFrame(rows, "doc_id long, lang string, n_tokens long")
    column = F.lit(1.0)
    for leaf, w in weights.items():
        column = F.when(F.col("lang") == leaf, w).otherwise(column)
    got = mixing.mix(docs, ["lang"], [column]).collect()
    share, total, free = by_hand(rows, weights)
    for leaf in total:
        own = [r for r in got if r.lang == leaf]
        assert abs(sum(r.taken for r in own) - share[leaf]) <= 1 and all(0 <= r.taken <= r.n_tokens for r in own)
        whole = int(round(sum(r.taken for r in own))) // total[leaf] if total[leaf] else 0
        key = lambda d: (d is not None, d or 0)
        for e in range(max(whole, 1)):
            assert sorted((r.doc_id for r in own if r.epoch == e and r.n_tokens == 0), key=key) == sorted(free.get(leaf, []), key=key)
        for e in range(whole):
            assert sorted(((r.doc_id, r.n_tokens) for r in own if r.epoch == e), key=str) == sorted(((d, n) for d, g, n in rows if g == leaf), key=str)
        at = 0
        for r in sorted((r for r in own if r.n_tokens), key=lambda r: r.start):
            assert r.start == at
            at += r.taken
    assert sum(r.taken for r in got) == sum(n for _, _, n in rows)


def test_mixing_query(spark):
    """The registered query: budgets by hand, and each leaf's stream gapless up to its budget."""
    docs = tree_levels(spark.read.parquet(f"{SF}/documents.parquet")).select("domain", "lang", "source", "n_tokens").collect()
    tree = {}
    for r in docs:
        leaf = tree.setdefault(r.domain, {}).setdefault(r.lang, {})
        leaf[r.source] = leaf.get(r.source, 0) + r.n_tokens
    room = lambda x: mixing.EPOCHS * x if isinstance(x, int) else sum(map(room, x.values()))
    want, key = {}, lambda n: (2.0 if n == "domain0" else 3.0 if n == "en" else 1.0)
    top = filled(sum(r.n_tokens for r in docs), {d: (2.0 if d == "domain0" else 1.0, room(x)) for d, x in tree.items()})
    for d, langs in tree.items():
        for lang, share in filled(top[d], {g: (key(g), room(x)) for g, x in langs.items()}).items():
            for source, given in filled(share, {s: (1.0, room(n)) for s, n in langs[lang].items()}).items():
                want[d, lang, source] = given
    got = {}
    for r in QUERIES["op8_mixing"](spark, SF).collect():
        got.setdefault((r.domain, r.lang, r.source), []).append(r)
    for leaf, given in want.items():
        own = sorted((r for r in got.get(leaf, []) if r.n_tokens), key=lambda r: r.start)
        assert abs(sum(r.taken for r in own) - given) <= 3
        assert [r.start for r in own] == [sum(x.taken for x in own[:i]) for i in range(len(own))]
        assert sum(r.taken < r.n_tokens for r in own) <= 1


def test_near_dedup_keeps_every_text_of_an_id(spark):
    words = [f"w{i}" for i in range(200)]
    one, two = " ".join(words[:80]), " ".join(words[100:180])
    rows = [(1, one, "en", "a", 1), (1, two, "en", "a", 1), (1, two, "de", "a", 1), (2, one, "en", "a", 1), (3, two + " end", "en", "a", 1), (4, "", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()) == sorted([(1, one), (1, two), (4, "")])


def test_odd_rows_and_first_tokens(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("n_tokens", mixing.token_count())
    assert {r.n_tokens for r in docs.collect()} == {len(re.findall(r"[^ \t\n\x0b\f\r]+", r.text or "")) for r in odd_docs.collect()}
    levels, weights = ["lang", "source"], [F.lit(None).cast("double"), F.lit(1.0)]
    got = mixing.mix(docs, levels, weights).collect()
    assert sum(r.taken for r in got) == sum(r.n_tokens for r in docs.collect())
    assert {r.doc_id for r in got if r.n_tokens == 0} == {r.doc_id for r in docs.collect() if r.n_tokens == 0}
    assert mixing.mix(docs.limit(0), levels, weights).count() == 0
    for n, want in ((0, ""), (2, "  a\nb"), (9, "  a\nb  c")):
        assert spark.range(1).select(mixing.first_tokens(F.lit("  a\nb  c "), F.lit(n)).alias("x")).first().x == want


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, odd_docs, no_docs, name, step):
    for docs in (odd_docs, no_docs):
        rows = step(spark, docs, SF).collect()
        assert name == "packing" or not rows or sorted(rows[0].asDict()) == sorted(corpus_pipeline.COLUMNS)
        if name == "toxicity":
            assert len(rows) == docs.count()
        if name == "near_dedup" and rows:
            ids = [r.doc_id for r in rows]
            assert sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 2


def test_pipeline_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, SF).collect()
    assert 0.7 * docs.count() < len(clean) < docs.count()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in clean} and len(rows) > 100
