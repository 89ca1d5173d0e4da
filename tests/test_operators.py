"""Operators against brute force and literal cases, with blocks small enough to matter."""

import datetime
import ipaddress
import random
import unicodedata

from pyspark.sql import Window, functions as F

from sparkdesk.operators import conversations as C, evaluation as E, layout as Y, markdown as M, network as N, packages as G, pages as PG, replies as R, usage as U, validate as V
from sparkdesk.plans.blocked import Scan, block_of, order_statistic, scan
from sparkdesk.sources import prices as SP
from sparkdesk.sources.evaluation import ASSERT_SCHEMA
from sparkdesk.streaming import ledger as SL


def test_scan_equals_windows(spark):
    rng = random.Random(3)
    # one key holds most rows
    data = [(("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}"), i, rng.choice([None, 1, 2, 5])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, pos long, v long")
    w = Window.partitionBy("k").orderBy("pos")
    frames = {
        "before": w.rowsBetween(Window.unboundedPreceding, -1), "upto": w.rowsBetween(Window.unboundedPreceding, 0),
        "after": w.rowsBetween(1, Window.unboundedFollowing), "onward": w.rowsBetween(0, Window.unboundedFollowing),
        "total": Window.partitionBy("k"),
    }
    scans, want = [], df
    for frame, spec in frames.items():
        for kind, fn in (("sum", F.sum), ("max", F.max), ("min", F.min), ("count", F.count)):
            name = f"{kind}_{frame}"
            scans.append(Scan(name, kind, F.col("v"), frame))
            col = fn("v").over(spec)
            want = want.withColumn(name, F.coalesce(col, F.lit(0)) if kind in ("sum", "count") else col)
    scans.append(Scan("lag", "max", F.struct("pos", "v"), "before"))
    want = want.withColumn("lag", F.max(F.struct("pos", "v")).over(frames["before"]))
    got = scan(df, ["k"], ["pos"], block_of(F.col("pos"), 7), scans)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)


def test_order_statistic(spark):
    rng = random.Random(5)
    data = [(rng.choice("ab"), rng.randrange(200)) for _ in range(301)]
    df = spark.createDataFrame(data, "k string, ms long")
    got = {r["k"]: r["m"] for r in order_statistic(df, ["k"], "ms", F.floor(F.col("n") / 2), 16, "m").collect()}
    for k in "ab":
        values = sorted(v for key, v in data if key == k)
        assert got[k] == values[len(values) // 2]


def test_context_plan_blocks(spark):
    df = spark.createDataFrame([(1, t, "user", "x" * 4 * (t + 1)) for t in range(20)], "conv_id long, turn long, role string, text string")
    one = sorted(map(tuple, C.context_plan(df, 50, block_size=3).collect()))
    assert one == sorted(map(tuple, C.context_plan(df, 50).collect()))
    assert [r[4] for r in one if r[1] == 19] == [False] and one[0][4] is True


def _lines(*lines, request=1):
    return [(request, i, s) for i, s in enumerate(lines)]


def test_decode_and_assemble(spark):
    token = lambda t: 'data: {"choices":[{"delta":{"content":"%s"}}]}' % t
    think = 'data: {"choices":[{"delta":{"reasoning_content":"h"}}]}'
    rows = _lines(": hi", think, think, token("ab"), "data: {bad", token("cd"), 'data: {"usage":{"total_tokens":9}}', "data: [DONE]", token("no"))
    rows += _lines(token("x" * 50), token("y"), request=2)
    rows += _lines(token("long"), "data: " + "z" * 300, token("after"), request=3)
    df = spark.createDataFrame(rows, "request_id long, seq long, line string")
    for size in (2, 1000):
        kinds = [(r["seq"], r["kind"]) for r in R.decode(df.where("request_id = 1"), block_size=size).orderBy("seq", "pos").collect()]
        assert kinds == [(1, "thinking"), (3, "token"), (5, "token"), (6, "usage")]
        got = {r["request_id"]: r for r in R.assemble(df, max_bytes=50, max_line_bytes=200, block_size=size).collect()}
        assert (got[1]["reply"], got[1]["truncated"], got[1]["prompt"], got[1]["completion"]) == ("abcd", False, 0, 9)
        assert (got[2]["reply"], got[2]["truncated"]) == ("x" * 50, True)
        assert got[3]["failed"] and got[3]["reply"] is None


def test_attachments_are_admitted_in_order(spark):
    item = "struct<kind:string,bytes:bigint,chars:bigint>"
    mib = 1024 * 1024
    images = [("image", 20 * mib, 0)] * 3 + [("image", 8 * mib, 0)]
    texts = [("text", 0, 200_000), ("text", 0, 150_000), ("text", 0, 100_000)]
    df = spark.createDataFrame(
        [(1, images), (2, texts), (3, [("text", 0, 1)] * 21)], f"id long, candidates array<{item}>"
    )
    got = {r["id"]: r for r in C.admit_attachments(df).collect()}
    # a refused item leaves its budget to the ones after it
    assert list(got[1]["taken"]) == [0, 1, 3] and got[1]["images_too_big"] == 1
    assert list(got[2]["taken"]) == [0, 2] and got[2]["text_too_long"] == 1
    assert len(got[3]["taken"]) == 20 and got[3]["too_many"] == 1


def _blocks(spark, md):
    df = spark.createDataFrame([(1, md)], "doc_id long, text string")
    return [(r["kind"], r["text"]) for r in M.blocks(df).orderBy("block_no").collect()]


def test_blocks(spark):
    assert _blocks(spark, "> The board noted\n> the risk.\n>\n>Second quote.\n\nAfter.") == [
        ("quote", "The board noted the risk."), ("quote", "Second quote."), ("para", "After.")]
    assert _blocks(spark, "5 > 3") == [("para", "5 > 3")]
    assert _blocks(spark, ">\n>") == []
    assert _blocks(spark, "#tag\n# Title\n***\n1) one\n* two\na\nb") == [
        ("para", "#tag"), ("heading", "Title"), ("rule", None), ("numbered", "one"), ("bullet", "two"), ("para", "a b")]
    # a list line with a pipe is a row once the table has begun, and prose with a pipe is prose
    assert [k for k, _ in _blocks(spark, "x | y\nprose\na | b\n--|--\n- c | d\n\ne | f")] == ["para", "table", "para"]


def _slides(spark, md):
    df = spark.createDataFrame([(1, md)], "doc_id long, text string")
    return [(r["title"], list(r["bullets"]), r["table_block"] is not None) for r in M.slides(df).orderBy("slide_no").collect()]


def test_slides(spark):
    assert _slides(spark, "# One\n## Sub\n- a\n# Two\n1. b") == [("One", ["Sub", "a"], False), ("Two", ["1. b"], False)]
    assert _slides(spark, "# Title\n## A\nx\n## B\ny") == [("Title", [], False), ("A", ["x"], False), ("B", ["y"], False)]
    table = "|h|\n|-|\n|1|\n\n"
    assert _slides(spark, f"# T\n{table}para\n\n{table}") == [("T", ["para"], True), ("T", [], True)]


def test_pagination(spark):
    deck = spark.createDataFrame([(1, 0, "T", [f"line {i}" for i in range(23)], None), (1, 1, "Empty", [], None)],
                                 "doc_id long, slide_no long, title string, bullets array<string>, table_block long")
    got = [(r["title"], len(r["bullets"])) for r in M.paginated_bullets(deck).orderBy("slide_no", "part").collect()]
    assert got == [("T", 10), ("T (cont.)", 10), ("T (cont.)", 3), ("Empty", 0)]


def test_pagination_equals_a_fold_over_many_blocks(spark):
    rng = random.Random(17)
    schema = "doc_id long, slide_no long, title string, bullets array<string>, table_block long"
    decks = [(d, s, f"T{d}", ["x" * rng.randrange(1, 45) for _ in range(rng.choice([0, 1, 4, 5, 16, 17, 63, 64, 65, 300]))], None)
             for d in (1, 2, None) for s in range(12)]
    decks.append((9, 0, "table", ["y"], 3))
    want = {}
    for d, s, title, bullets, table in decks:
        if table is not None:
            continue
        part = filled = 0
        want[d, s, 0] = (title, [])
        for b in bullets:
            cost = -(-len(b) // 5)
            if filled and filled + cost > 10:
                part, filled = part + 1, 0
                want[d, s, part] = (title + " (cont.)", [])
            filled += cost
            want[d, s, part][1].append(b)
    for span in (4, 256):
        got = M.paginated_bullets(spark.createDataFrame(decks, schema), per_line=5, span=span).collect()
        assert len(got) == len(want)
        assert {(r["doc_id"], r["slide_no"], r["part"]): (r["title"], r["bullets"]) for r in got} == want
    assert M.paginated_bullets(spark.createDataFrame([], schema)).count() == 0


def test_reading_order(spark):
    def frag(y, x, width, text, page=1):
        return (page, y - 0.02, y, x, x + width, text)

    rows = [frag(0.5, 0.1, 0.3, "second"), frag(0.9, 0.5, 0.2, "date"), frag(0.905, 0.1, 0.2, "first"), frag(0.495, 0.5, 0.2, "half")]
    for i in range(4):
        rows += [frag(0.9 - i * 0.1, 0.05, 0.35, "l", 2), frag(0.9 - i * 0.1, 0.55, 0.35, "r", 2)]
    df = spark.createDataFrame(rows, "page_id long, min_y double, max_y double, min_x double, max_x double, text string")
    got = {r["page_id"]: r for r in Y.reading_order(df).collect()}
    assert got[1]["text"] == "first date\nsecond half" and got[1]["error"] is None
    assert got[2]["text"] is None and got[2]["error"] == Y.MANY_COLUMNS


def test_gutters_equal_brute_force(spark):
    rng = random.Random(9)
    gaps = [(p, round(rng.random(), 3)) for p in (1, 2) for _ in range(12)]
    df = spark.createDataFrame(gaps, "page_id long, gap double")
    want = {(p, g) for p, g in gaps if sum(1 for q, h in gaps if q == p and g - 0.06 <= h <= g + 0.06) >= 3}
    assert {(r["page_id"], r["gap"]) for r in Y.gutters(df).collect()} == want


def test_lines_equal_a_fold(spark):
    """Pages whose fragments overlap in chains, so that a cluster holds one line or many, against the fold in plain Python."""
    rng = random.Random(11)
    rows = []
    for page in range(40):
        for i in range(rng.randrange(1, 25)):
            low = round(rng.random() * (0.3 if page % 2 else 3), 2)
            rows.append((page, low, round(low + rng.choice([0.02, 0.05, 0.2]), 2), rng.choice([0.1, 0.3, 0.5]), 0.0, rng.choice(["a", " ", "b", "c"])))
    df = spark.createDataFrame(rows, "page_id long, min_y double, max_y double, min_x double, max_x double, text string")
    want = {}
    for page in range(40):
        lines, top, bottom = [], None, None
        for _, lo, hi, x, _, t in sorted((r for r in rows if r[0] == page), key=lambda r: (-r[2], r[3], r[1], r[5])):
            if lines and min(top, hi) - max(bottom, lo) > 0.5 * min(top - bottom, hi - lo):
                top, bottom = max(top, hi), min(bottom, lo)
                lines[-1].append((x, t))
            else:
                top, bottom = hi, lo
                lines.append([(x, t)])
        said = [" ".join(t for _, t in sorted(line, key=lambda p: p[0]) if t.strip()) for line in lines]
        want[page] = sorted(said)
    got = Y.text_lines(Y.line_pieces(df))
    texts = {}
    for r in got.collect():
        texts.setdefault(r["page_id"], []).append(r["text"])
    assert {k: sorted(v) for k, v in texts.items()} == want and len({len(v) for v in want.values()}) > 5
    plan = Y.reading_order(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # a cluster and a page are gathered, a line is not


def test_package_facts_are_sent_once(spark):
    make = spark.createDataFrame
    p, o, d = make([(1, "a.xml")] * 3, "package_id long, name string"), make([(1, "//b")] * 2, "package_id long, part_name string"), make([(1, "png")], "package_id long, extension string")
    r = make([(1, "_rels/a.xml.rels", "r1", "b", False)], "package_id long, rels_name string, rel_id string, target string, external boolean")
    df = G.package_problems(p, o, d, r, make([(1, "a.xml", "r1")], "package_id long, part string, rel_id string"))
    assert sorted(map(tuple, df.collect())) == [(1, "dangling target", "b -> b")] + [(1, "declared but missing", "//b")] * 2 + [(1, "undeclared part", "a.xml")] * 3
    with_names = [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].split("\n") if "Exchange hashpartitioning(package_id" in x and "name#" in x]
    assert len(with_names) == 1


def test_package_problems_equal_brute_force(spark):
    rng = random.Random(5)
    names = ["word/a.xml", "word/b.xml", "c.rels", "d.png", G.CONTENT_TYPES, None]
    some = lambda xs: rng.choice(xs)
    ids = [1, 1, 1, 2, None]  # one package holds most rows
    parts = [(some(ids), some(names)) for _ in range(12)]
    overrides = [(some(ids), some(["/word/a.xml", "word/a.xml", "/e.xml", "/d.png", None])) for _ in range(14)]
    defaults = [(some(ids), some(["xml", "rels", None])) for _ in range(3)]
    rels = [(some(ids), some(["word/_rels/a.xml.rels", "_rels/c.rels.rels", None]), some(["r1", "r2", None]), some(["b.xml", "/d.png", "gone", None]),
             some([False, False, True, None])) for _ in range(40)]
    uses = [(some(ids), some(["word/a.xml", "c.rels", None]), some(["r1", "r2", "r3", None])) for _ in range(40)]
    make = spark.createDataFrame
    p, o, d = make(parts, "package_id long, name string"), make(overrides, "package_id long, part_name string"), make(defaults, "package_id long, extension string")
    r = make(rels, "package_id long, rels_name string, rel_id string, target string, external boolean")
    u = make(uses, "package_id long, part string, rel_id string")

    def has(rows, *key):
        return None not in key and any(x == key for x in rows)

    want = []
    declared = [(k, n and n.lstrip("/")) for k, n in overrides]
    for k, n in parts:
        if n not in (None, G.CONTENT_TYPES) and not has(declared, k, n) and not has(defaults, k, n.rsplit(".", 1)[-1]):
            want.append((k, "undeclared part", n))
    for (k, n), (_, item) in zip(declared, overrides):
        if not has(parts, k, n):
            want.append((k, "declared but missing", item))
    for k, f, _, t, external in rels:
        base = "word/" if f and f.startswith("word/") else ""
        to = None if t is None else t[1:] if t.startswith("/") else base + t
        if external is False and not has(parts, k, to):
            want.append((k, "dangling target", " -> ".join(x for x in (t, to) if x is not None)))
    known = [x[:3] for x in rels]
    for k, n, i in uses:
        f = None if n is None else "word/_rels/a.xml.rels" if n.startswith("word/") else "_rels/c.rels.rels"
        if not has(known, k, f, i):
            want.append((k, "undeclared relationship", ": ".join(x for x in (n, i) if x is not None)))
    got = G.package_problems(p, o, d, r, u)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr) and len({x[1] for x in want}) == 4
    assert G.package_problems(*(x.limit(0) for x in (p, o, d, r, u))).count() == 0


def test_resolved_targets(spark):
    cases = [("word", "media/a.png", "word/media/a.png"), ("word", "../a.xml", "a.xml"), ("word", "/word/b.xml", "word/b.xml"), ("", "./c/../d.xml", "d.xml")]
    df = spark.createDataFrame(cases, "base string, target string, want string")
    assert df.where(G.resolved(F.col("base"), F.col("target")) != F.col("want")).count() == 0


def test_unknown_model_takes_the_default_and_no_default_costs_nothing(spark):
    rates = spark.sql("""SELECT * FROM VALUES ('ai','default',2.0D,4.0D,CAST(NULL AS DOUBLE),'USD'), ('image','known',NULL,NULL,0.5D,'XXX')
        AS r(kind,name,input_per_mtok,output_per_mtok,per_unit,currency)""")
    fx = spark.sql("SELECT 'USD' AS currency, 0.92D AS mult")
    events = spark.sql("""SELECT * FROM VALUES ('ai','other',1000000L,1000000L,0L), ('image','known',0L,0L,2L), ('image','other',0L,0L,2L)
        AS e(kind,price_key,input_tokens,output_tokens,units)""")
    got = [round(r["cost"], 6) for r in U.priced(events, rates, fx).orderBy("kind", "price_key").collect()]
    assert got == [round(6 * 0.92, 6), 1.0, 0.0]


def test_failed_write_is_retried_and_counted_once(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "kind string, ts timestamp, provider string, units long, input_tokens long, output_tokens long, cost double"
    for day in (1, 2):
        spark.createDataFrame([("image", None, "ovh", 2, 0, 0, 1.5)] * 3, schema).withColumn(
            "ts", F.lit(f"2024-01-0{day}").cast("timestamp")).write.mode("append").parquet(source)
    ledger = lambda: SL.running_ledger(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    write, calls = SL.write_batch(out), []

    def failing(batch, batch_id):
        write(batch, batch_id)
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("the write was not acknowledged")

    query = SL.start_ledger(ledger(), out, checkpoint, sink=failing)
    try:
        query.awaitTermination(120)
    except Exception as e:  # noqa: BLE001
        assert "acknowledged" in str(e)
    SL.start_ledger(ledger(), out, checkpoint, sink=failing).awaitTermination(120)
    assert calls[:2] == [0, 0]
    rows = SL.read_ledger(spark, out).collect()
    assert [(r["count"], r["cost"]) for r in rows] == [(12, 9.0)]


def test_edits_follow_each_other(spark):
    """Two edits of one chat leave one; what the turn carried stays; a removed turn cannot be edited."""
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}", f"file{t}") for t in range(8)] + [(2, 0, "user", "x", None)]
    messages = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, attachments string")
    edits = spark.createDataFrame(
        [(1, 1, 4, "four", 0), (1, 2, 6, "six", 0), (1, 3, 2, "two", 0), (1, 4, 2, "two again", 0), (1, 5, 3, "no", 0), (2, 1, 0, " ", 0)],
        "conv_id long, edit_no int, edit_turn long, new_text string, attachments int",
    )
    rows = sorted(C.apply_edits(messages, edits).collect(), key=lambda r: (r.conv_id, r.turn))
    assert [(r.conv_id, r.turn, r.text, r.attachments, r.replaced) for r in rows] == [
        (1, 0, "t0", "file0", None), (1, 1, "t1", "file1", None), (1, 2, "two again", "file2", 0), (2, 0, "x", None, None),
    ]
    first = C.apply_edits(messages, edits.where("edit_no = 3 OR edit_no = 1")).where("replaced IS NOT NULL").first()
    assert (first.turn, first.replaced) == (2, 2)


def test_snippet_is_cut_from_the_text_as_written(spark):
    chats = spark.createDataFrame([(1, "t", "2026", True)], "conv_id long, title string, updated_at string, readable boolean")
    text = chr(0x130) * 4 + " NEEDLE here"
    messages = spark.createDataFrame([(1, 0, text, [])], "conv_id long, turn long, text string, attachments array<struct<kind:string,name:string,content:string>>")
    row = C.search(chats, messages, "needle").first()
    assert (row.snippet_before, row.snippet_match, row.snippet_after) == (text[:5], "NEEDLE", " here")


def test_only_strings_are_tokens(spark):
    said = ['"a"', '{"x": 1}', "5", "null", '"b"']
    lines = [(1, i, 'data: {"choices":[{"delta":{"content":%s}}]}' % x) for i, x in enumerate(said)]
    df = spark.createDataFrame(lines, "request_id long, seq long, line string")
    assert R.assemble(df).first().reply == "ab"
    assert [r.token for r in R.decode(df).orderBy("seq").collect()] == ["a", "b"]


def test_addresses_equal_the_library(spark):
    """Every spelling of an address, and what is none, against Python's own parser and prefixes."""
    rng = random.Random(5)
    heads = ["::", "::1", "::ffff:127.0.0.1", "::ffff:7f00:1", "::7f00:1", "::8.8.8.8", "0:0:0:0:0:ffff:127.0.0.1", "2001:0:1::", "2001:1::", "2001:db8::5",
             "2002:7f00:1::", "64:ff9b::1.2.3.4", "64:ff9b:1::", "fe80::1%eth0", "febf::", "fec0::1", "feff::", "fbff::", "fc00::", "fdff::", "ff02::1", "2606:4700::1111",
             "100::1", "1::2::3", ":::", ":1", "1:", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7::8", "1:2:3:4:5:6:7:8:9", "12345::",
             "g::", "::1.2.3.256", "::01.2.3.4", "1.2.3.4::", "127.0.0.1", "010.0.0.1", "1.2.3", "", "%", "::%", "300.0.0.1", "100.64.0.1", "100.128.0.1", "198.20.0.1"]
    for _ in range(400):
        n = rng.choice([rng.getrandbits(128), rng.getrandbits(32), rng.getrandbits(16), rng.getrandbits(32) | 0xFFFF << 32, rng.getrandbits(64) << 64])
        full = ipaddress.IPv6Address(n)
        heads += [str(full), full.exploded, full.exploded.upper(), "[" + str(full) + "]", str(ipaddress.IPv4Address(n & 0xFFFFFFFF))]
        heads.append(":".join(f"{int(g, 16):x}" for g in full.exploded.split(":")[:6]) + f":{ipaddress.IPv4Address(n & 0xFFFFFFFF)}")
    nets = [(ipaddress.ip_network(f"{net}/{bits}"), why) for net, bits, why in N.PRIVATE_V4 + N.PRIVATE_V6]

    def reason(text):
        try:
            a = ipaddress.ip_address(text[1:-1] if text.startswith("[") and text.endswith("]") and ":" in text else text)
        except ValueError:
            return "not an address"
        if a.version == 6:
            a = ipaddress.IPv6Address(int(a))  # without its zone
            if int(a) >> 32 == 0xFFFF or 1 < int(a) < 1 << 32:
                a = ipaddress.IPv4Address(int(a) & 0xFFFFFFFF)
        return next((why for net, why in nets if net.version == a.version and a in net), None)

    df = spark.createDataFrame([(h,) for h in heads], "address string")
    got = {r.address: r.reason for r in N.vetted_addresses(df, N.private_ranges(spark)).collect()}
    assert {h: (got[h], reason(h)) for h in heads if got[h] != reason(h)} == {}


def test_first_listed_host_explains(spark):
    captures = spark.createDataFrame([("idle", "rust", "1.1.1.1:443"), ("idle", "rust", "2.2.2.2:443")], "phase string, source string, remote string")
    expected = spark.createDataFrame([("1.1.1.1", "zeta.example", "z", 1), ("1.1.1.1", "alpha.example", "a", 2)], "ip string, host string, what string, listed int")
    reverse = spark.createDataFrame([("2.2.2.2", "x.scw.cloud", 1), ("2.2.2.2", "a.apple.com", 2)], "ip string, name string, listed int")
    got = {r.ip: (r["class"], r.what) for r in N.explained(captures, expected, reverse).collect()}
    assert got == {"1.1.1.1": ("EXPECTED", "zeta.example — z"), "2.2.2.2": ("EXPECTED", "Scaleway (by reverse name)")}


def test_a_broken_pattern_fails_its_own_case(spark):
    schema = "id string, text string, error string"
    results = spark.createDataFrame([("a", "abc", None), ("b", "abc", None), ("c", "abc", None), ("d", "abc", None)], schema)
    specs = [("a", '{"regex":"(["}'), ("b", '{"regex":"a.c"}'), ("c", '{"regex":"^b","nonEmpty":true}'), ("d", '{"nonEmpty":true}')]
    cases = spark.createDataFrame(specs, "id string, spec string").select(
        "id", F.from_json("spec", ASSERT_SCHEMA).alias("assert"), F.lit(None).cast("string").alias("review"), F.lit(False).alias("appLevel"))
    rows = {r.id: r for r in E.graded(results, cases).collect()}
    assert {i: r.verdict for i, r in rows.items()} == {"a": "FAIL", "b": "PASS", "c": "FAIL", "d": "PASS"}
    assert [(c.name, c.detail) for c in rows["a"].checks] == [("matches /([/", "the pattern does not compile")]


def test_word_sets_are_compatibility_folded(spark):
    texts = [("ﬁn Straße", "fin STRASSE"), ("Ａ１ ②", "a1 2"), ("x\u00a0y", "Y X"), ("½ İ", "1⁄2 i̇"), ("é", "e\u0301"), ("one", "two"), (None, "ﬀ"), ("K", "k"), ("plain Words", "words PLAIN")]
    df = spark.createDataFrame([(i, 1, a, b) for i, (a, b) in enumerate(texts)], "doc_id long, page_no long, a_text string, b_text string")
    got = {r.doc_id: (r.only_a, r.only_b) for r in PG.word_set_differences(df).collect()}
    want = {}
    for i, pair in enumerate(texts):
        a, b = (set(unicodedata.normalize("NFKC", t or "").casefold().split()) for t in pair)
        if a != b:
            want[i] = (" ".join(sorted(a - b)), " ".join(sorted(b - a)))
    assert got == want and 0 not in got and 1 not in got


def test_equal_texts_are_not_folded(spark):
    """Pages with equal texts, or none, do not reach Python, and words are looked for once."""
    rows = [(1, 1, "ﬁn", "ﬁn"), (2, 1, None, ""), (3, 1, "ﬁn a", "fin b")]
    df = PG.word_set_differences(spark.createDataFrame(rows, "doc_id long, page_no long, a_text string, b_text string"))
    assert [tuple(r) for r in df.collect()] == [(3, 1, "a", "b")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    before = plan[plan.index("ArrowEvalPython"):]
    assert "Filter" in before and plan.count("array_except") == 2


def _batches(spark, path, numbers, every=4):
    write = SL.write_batch(path, compact_every=every)
    for n in numbers:
        rows = [("2024-01", "ai", f"p{n % 3}", n, 10 * n, n, float(n)), (f"2024-{n % 12 + 1:02}", "image", "ovh", n, 0, 0, 0.5 * n)]
        write(spark.createDataFrame(rows, SL.LEDGER_COLUMNS), n)


def _totals(spark, path):
    return {(r.month, r.category, r.provider): (r["count"], r.cost) for r in SL.read_ledger(spark, path).collect()}


def _expected(last):
    out = {}
    for n in range(last + 1):
        out["2024-01", "ai", f"p{n % 3}"] = (n, float(n))
        out[f"2024-{n % 12 + 1:02}", "image", "ovh"] = (n, 0.5 * n)
    return out


def test_ledger_stays_short(spark, tmp_path):
    """However many batches were written, a reader opens one snapshot and fewer batches than are folded at once."""
    path = str(tmp_path / "ledger")
    assert _totals(spark, path) == {}
    for last in (2, 30, 35):
        _batches(spark, path, range(max(0, last - 30), last + 1) if last < 31 else range(31, last + 1))
        assert _totals(spark, path) == _expected(last)
    folders = {k: sorted(p.name for p in (tmp_path / "ledger" / k).iterdir() if "=" in p.name and not p.name.startswith(".")) for k in ("deltas", "snapshots", "commits")}
    assert folders["snapshots"] == ["upto=35"] and folders["commits"] == ["upto=35"] and folders["deltas"] == []
    _batches(spark, path, [36, 37])
    assert len(list((tmp_path / "ledger" / "deltas").glob("batch=*"))) == 2 and _totals(spark, path) == _expected(37)


def test_a_fold_that_fails_counts_nothing_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    _batches(spark, path, range(7))
    real = SL._folder

    def failing(session, at):
        if "/commits/upto=7" in at:
            raise RuntimeError("lost before the pointer")
        return real(session, at)

    monkeypatch.setattr(SL, "_folder", failing)
    try:
        _batches(spark, path, [7])
        raise AssertionError("the pointer was written")
    except RuntimeError:
        pass
    assert _totals(spark, path) == _expected(7)  # snapshot 7 is there, but nothing points to it
    monkeypatch.setattr(SL, "_folder", real)
    _batches(spark, path, [7, 7, 8])  # the batch is repeated, also after it was folded
    assert _totals(spark, path) == _expected(8)


def test_as_of_day_equals_brute_force(spark):
    """A popular name, a long history, days before every list, lists that end, names and kinds without a rate."""
    rng = random.Random(11)
    dates = sorted(rng.sample(range(0, 4000), 300))
    day = lambda n: (datetime.date(2015, 1, 1) + datetime.timedelta(days=n))
    rates = [(f"v{i}", "ai", name, float(i + 1), float(i), None, "EUR") for i in range(300) for name in ("hot", "default") if not (name == "hot" and i % 7 == 0) and not (name == "default" and i % 11 == 0)]
    rate_df = spark.createDataFrame(rates, "version string, kind string, name string, input_per_mtok double, output_per_mtok double, per_unit double, currency string")
    versions = spark.createDataFrame([(f"v{i}", day(d)) for i, d in enumerate(dates)], "version string, collected date")
    events = [(i, "ai" if rng.random() < 0.95 else "image", rng.choice(["hot"] * 5 + ["other"]), rng.randrange(-400, 4400)) for i in range(800)]
    df = spark.createDataFrame([(i, k, n, datetime.datetime.combine(day(d), datetime.time(3)), 1_000_000, 0, 0) for i, k, n, d in events],
                               "id long, kind string, price_key string, ts timestamp, input_tokens long, output_tokens long, units long")
    fx = spark.createDataFrame([("USD", 0.9)], "currency string, mult double")
    got = {r.id: (r.version, r.before_first, r.cost) for r in U.priced_as_of(df, U.price_history(rate_df, versions), fx).collect()}
    known, want = {(v, n) for v, _, n, *_ in rates}, {}
    listed = [i for i in range(300) if any((f"v{i}", n) in known for n in ("hot", "default"))]
    for i, kind, name, d in events:
        at = max((v for v in range(300) if dates[v] <= d), default=None)
        use = listed[0] if at is None or (at < listed[0]) else at
        rated = kind == "ai" and ((f"v{use}", name) in known or (f"v{use}", "default") in known)
        want[i] = (f"v{use}", d < dates[listed[0]], float(use + 1)) if rated else (None, None, 0.0)
    assert got == want


def test_price_tables_are_read_once(spark):
    bad = '{"version":"1","collected":"2020","display_currency":"ZZZ","fx":{"USD":0,"QQQ":-1},"ai":{"m":{"input_per_mtok":-1,"output_per_mtok":99999999,"currency":"???"}},"image":{"i":{"per_unit":1}},"sources":{"a":"http://x.org","b":" "}}'
    df = spark.createDataFrame([(1, bad), (2, "{}"), (3, None), (4, "no json")], "id long, json string")
    report = V.price_table_problems(SP.parse_price_tables(df, "id", "json"), "2026-01-01")
    got = sorted((r.table_id, r.rule, r.item) for r in report.collect())
    assert got == sorted([(1, "currency unknown", "display_currency"), (1, "older than current", "2020"), (1, "fx zero", "USD"), (1, "currency unknown", "QQQ"),
                          (1, "rate negative", "QQQ"), (1, "rate negative", "m"), (1, "rate implausible", "m"), (1, "currency unknown", "m"), (1, "link not https", "a")])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Exchange" not in plan
