"""Readers and writers over real files."""

import json

import pytest

from sparkdesk.operators.corpus import comparison_classes, record_states
from sparkdesk.sources import captures, conversations, corpus, evaluation, ledger, prices
from sparkdesk.operators.validate import price_table_problems
from sparkdesk.plans.prices import PRICE_LIST
from sparkdesk.session import shared_dir


def test_conversations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "messages": [{"role": "user", "text": "hi"}, {"role": "assistant", "image": "data:x"}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"schema": 9, "id": "b", "messages": [{"role": "user", "text": "new"}]}))
    got = conversations.messages(conversations.read_conversations(spark, str(tmp_path))).orderBy("turn").collect()
    assert [(r["conv_id"], r["turn"], r["role"], r["text"], r["has_image"]) for r in got] == [("a", 0, "user", "hi", False), ("a", 1, "assistant", "", True)]


def test_refused_conversations_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "a", "messages": [{"role": "user", "text": "hi"}]}))
    (tmp_path / "b.json").write_text('{"id": "b", "messages": [')
    (tmp_path / "c.json").write_text(json.dumps({"schema": 9, "id": "c"}))
    assert [r["id"] for r in conversations.read_conversations(spark, str(tmp_path)).collect()] == ["a"]
    refused = conversations.refused_conversations(spark, str(tmp_path)).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["reason"]) for r in refused) == [("b.json", "not readable"), ("c.json", "newer version")]


def test_oversized_price_files_are_rows(spark, tmp_path):
    (tmp_path / "big.json").write_text(PRICE_LIST + " " * 300_000)
    row = prices.read_price_tables(spark, str(tmp_path / "big.json")).first()
    assert row["oversized"] and row["price"] is None
    big = spark.createDataFrame([("x", PRICE_LIST + " " * 300_000)], "id string, json string")
    assert [tuple(r) for r in price_table_problems(prices.parse_price_tables(big, "id", "json"), "2026-10-19").collect()] == [("x", "file too large", "file")]


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class conf:
            @staticmethod
            def get(name, default=None):
                return default

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError):
        shared_dir(Cluster())


def test_prices_and_ledger(spark, tmp_path):
    (tmp_path / "p.json").write_text(PRICE_LIST)
    tables = prices.read_price_tables(spark, str(tmp_path / "p.json"))
    assert prices.rates(tables).count() == 21 and prices.exchange(tables).count() == 2
    (tmp_path / "l.json").write_text(json.dumps({"months": {
        "2026-07": {"ai": {"input_tokens": 5, "cost": 1.5}, "image_by_provider": {"ovh": {"count": 3, "cost": 0.5}}},
        "2026-08": {"ai": {"output_tokens": 2, "cost": 2.0}, "image_by_provider": {"ovh": {"count": 4}, "bfl": {"count": 1}}}}}))
    rows = ledger.ledger_rows(ledger.read_ledgers(spark, str(tmp_path / "l.json"))).collect()
    assert sum(r["cost"] for r in rows if r["category"] == "ai") == 3.5
    assert {p: sum(r["count"] for r in rows if r["provider"] == p) for p in ("ovh", "bfl")} == {"ovh": 7, "bfl": 1}


def test_spec_and_newest_results(spark, tmp_path):
    (tmp_path / "prompts.json").write_text(json.dumps({"version": "1", "cases": [
        {"id": "1", "prompt": "p", "assert": {"lines": 2}}, {"id": "2", "conversation": [{"id": "2a", "prompt": "x"}, {"id": "2b", "prompt": "y"}]}]}))
    turns = evaluation.turns(evaluation.read_spec(spark, str(tmp_path / "prompts.json")))
    assert sorted(r["id"] for r in turns.collect()) == ["1", "2a", "2b"]
    root = tmp_path / "results"
    root.mkdir()
    for stamp, text in (("2026-01", "old"), ("2026-02", "new")):
        (root / f"raw-{stamp}.jsonl").write_text(json.dumps({"id": "1", "text": text}) + "\n")
    (root / "report-2026-03.md").write_text("x")
    assert [r["text"] for r in evaluation.latest_results(spark, str(root)).collect()] == ["new"]


def test_captures(spark, tmp_path):
    (tmp_path / "raw.tsv").write_text("# app\tx\n# version\t1\nphase\ttime\tsource\tremote\nidle\t10:00:00\trust\t10.0.0.1:443\nphase\ttime\tsource\tremote\nchat\t10:01:00\twebview\t[::1]:443\n")
    got = captures.read_captures(spark, str(tmp_path)).orderBy("phase").collect()
    assert [tuple(r) for r in got] == [("chat", "10:01:00", "webview", "[::1]:443"), ("idle", "10:00:00", "rust", "10.0.0.1:443")]


def test_records_survive_a_malformed_line(spark, tmp_path):
    page = json.dumps({"Ok": "text"})
    current = '{"record":"reader","reader":"current","elapsedMs":1,"result":{"Ok":[[[1,%s]],false]}}' % page
    native = '{"record":"reader","reader":"pdfkit","elapsedMs":1,"result":{"Ok":[%s]}}' % page
    end, failed = '{"record":"end","readers":2}', current.replace("Ok\": \"text", "Err\": \"none")
    runs = {
        "run-1": [current, '{"record":', native, end, ""], "run-2": [current, native, end, ""],
        "run-3": [failed, native.replace("Ok\": \"text", "Err\": \"none"), ""], "run-4": [current.replace("[1,", "[2,"), native, ""],
        "run-5": [current, native, end], "run-6": [current, native.replace('[{"Ok": "text"}]', '["text"]'), ""],
    }
    for name, lines in runs.items():
        (tmp_path / name).write_text("\n".join(lines))
    (tmp_path / "run-7").write_bytes(current.encode() + b"\n\xff\xfe\n" + native.encode() + b"\n" + end.encode() + b"\n")
    states = record_states(corpus.parse_records(corpus.read_records(spark, str(tmp_path))))
    assert {(r["run_id"], r["error"]) for r in states.collect() if r["error"]} == {
        ("run-1", "malformed"), ("run-4", "invalid reader"), ("run-4", "optional reader first"), ("run-5", "unterminated"),
        ("run-6", "invalid reader"), ("run-7", "not UTF-8"),
    }
    processes = spark.createDataFrame([(f"run-{i}", 0, None, None, True) for i in range(1, 8)],
                                      "run_id string, status int, signal string, reason string, exit_confirmed boolean")
    assert {r["run_id"]: r["class"] for r in comparison_classes(states, processes).collect()} == {
        "run-1": "partial", "run-2": "success", "run-3": "failed", "run-4": "partial", "run-5": "partial", "run-6": "partial", "run-7": "partial",
    }


def test_records_are_parsed_once(spark):
    """Neither errors nor classes need a second look at the lines, and classes do not move the pages."""
    lines = spark.createDataFrame([("r", 0, "[1]"), ("r", 1, '{"record":"end","readers":2}'), (None, 0, "[1]")], "run_id string, seq long, line string")
    states = record_states(corpus.parse_records(lines))
    assert sorted((r["seq"], r["error"]) for r in states.collect()) == [(0, "not an object"), (1, "end too early")]
    processes = spark.createDataFrame([("r", 0, None, None, True)], "run_id string, status int, signal string, reason string, exit_confirmed boolean")
    for df in (states.select("run_id", "seq", "error"), comparison_classes(states, processes)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json(") + plan.count("JsonToStructs") <= 1 and plan.count("try_parse_json") + plan.count("parse_json(") <= 1
    window = plan[plan.index("Window"):].split("\n")[0]
    assert "pages" not in window


def test_manifest_and_inventory(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"version": 1, "documents": [{"id": "a"}, {"id": "b"}]}))
    assert corpus.read_manifest(spark, str(tmp_path / "m.json")).count() == 2
    tree = tmp_path / "tree"
    (tree / "sub" / ".git").mkdir(parents=True)
    (tree / "b.txt").write_text("12")
    (tree / "sub" / "a.txt").write_text("1")
    (tree / "sub" / ".git" / "x").write_text("1")
    got = corpus.inventory(corpus.read_inventory(spark, str(tree))).collect()
    assert [(r["path"], r["is_dir"], r["size"]) for r in got] == [("b.txt", False, 2), ("sub", True, 0), ("sub/a.txt", False, 1)]


def test_a_run_is_never_overwritten(spark, tmp_path):
    results = spark.createDataFrame([("a", "x", "timeout")], "id string, sha256 string, outcome string")
    corpus.write_run(results, results.groupBy("outcome").count(), str(tmp_path / "run"))
    with pytest.raises(Exception, match="already exists"):
        corpus.write_run(results, results.groupBy("outcome").count(), str(tmp_path / "run"))
