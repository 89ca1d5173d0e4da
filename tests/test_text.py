"""Literal cases of the text functions."""

import time

import pytest
from pyspark.sql import functions as F

from sparkdesk.functions import markdown as M, pages as P, text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(s):
    return F.concat(F.lit(s), F.lit(""))


@pytest.mark.parametrize("raw, want", [
    ("<think>a</think>Hi", "Hi"), ("Hi<think>open", "Hi"), ("Hi<tool_call>x", "Hi"), ("loop</think>Hi</think>", "loopHi"),
    ("<think>a\nb</think>x<think>c</think>y", "xy"), ("plain", "plain"),
])
def test_clean_reply(spark, raw, want):
    assert value(spark, X.clean_reply(lit(raw))) == want


def parts(spark, text):
    return [tuple(p) for p in value(spark, X.message_parts(lit(text)))]


def test_artifacts(spark):
    assert parts(spark, "a\n```html Bar chart\n<b>\n```\nb") == [("html", "Bar chart", "<b>\n", False)]
    assert parts(spark, "```python\tFib\nx\n```") == [("python", "Fib", "x\n", False)]
    assert parts(spark, "```markdown\nquote\n```") == [] == parts(spark, "```\nbare\n```")
    assert parts(spark, "intro ```js\nlet a") == [("js", "", "let a", True)]
    # a closed prose fence hides an open one behind it
    assert parts(spark, "```md\nx\n```\n```js\nopen") == []
    # but not where an artifact came between
    assert parts(spark, "```md\nx\n```\n```c\ny\n```\n```js\nopen") == [("c", "", "y\n", False), ("js", "", "open", True)]


@pytest.mark.parametrize("raw, want", [
    ("a", True), ("", False), (" \u200d\u2060\ufe0f\u00ad\u3164\ufffd", False), ("\ue000", False), ("\u4e2d", True), ("\u2028", False),
])
def test_readable(spark, raw, want):
    assert value(spark, X.is_readable(lit(raw))) is want


@pytest.mark.parametrize("raw, want", [
    ("0", "number"), ("-42", "number"), ("0.12", "number"), ("-0.5", "number"), ("128400", "number"), ("4915123456789", "number"),
    ("007", "text"), ("9007199254740993", "text"), ("1,000", "text"), ("12%", "text"), ("", "text"), ("-", "text"), ("1.2.3", "text"), ("1e5", "text"),
])
def test_cell_kind(spark, raw, want):
    assert value(spark, X.cell_kind(lit(raw))) == want


@pytest.mark.parametrize("raw, want", [
    ("It is **urgent**.", "It is urgent."), ("a * b * c", "a * b * c"), ("_x_ and `y`", "x and y"), ("** no**", "** no**"),
    ("****", "****"), ("__b__ *i*", "b i"), ("***a***", "*a*"), ("un*closed", "un*closed"),
])
def test_flatten(spark, raw, want):
    assert value(spark, X.flatten_inline(lit(raw))) == want


def test_widths_and_tokens(spark):
    assert value(spark, X.display_width(lit("ab契約"))) == 6
    assert value(spark, X.estimate_tokens(lit("abcde契約é"))) == 2 + 2 + 1
    assert value(spark, X.estimate_tokens(lit("abcdefgh"))) == 2


def test_steps(spark):
    assert value(spark, X.steps_of(lit('["a",5,"b",{"x":1}]'))) == ["a", "b"]
    assert value(spark, X.steps_of(lit('{"length":1000000000}'))) == [] == value(spark, X.steps_of(lit("not json")))
    assert len(value(spark, X.steps_of(F.to_json(F.array_repeat(F.lit("s"), 1500))))) == 1000


def test_file_classes(spark):
    got = [value(spark, X.file_class(lit(n))) for n in ("a.PDF", "b.doc", "c.dotx", "d.potm", "e.txt", "f")]
    assert got == ["extractable", "legacy", "template", "macro template", "other", "other"]


def test_binary(spark):
    assert value(spark, X.looks_binary(lit("a\x00b"))) is True
    assert value(spark, X.looks_binary(F.concat(F.repeat(F.lit("a"), 4096), F.lit("\ufffd")))) is False


@pytest.mark.parametrize("a, b, want", [
    ("Pay 100\nEUR", "Pay 100 EUR", "same_words_in_order"), ("A 100 B 200", "B 200 A 100", "same_words_reordered"),
    ("Pfizer", "Pfi zer", "spacing_only"), ("Pay 100 100", "Pay 100", "other_difference"), ("\u200d", " ", "neither_readable"),
    ("", "x", "native_only_readable"), ("x", "", "current_only_readable"),
])
def test_page_category(spark, a, b, want):
    got = P.page_category(X.is_readable(lit(a)), P.words(lit(a)), X.is_readable(lit(b)), P.words(lit(b)), F.lit(None))
    assert value(spark, got) == want


@pytest.mark.parametrize("result, want", [
    ((0, None, "ETIMEDOUT", "PDF-TEXT/1\nx"), "timeout"), ((0, "SIGKILL", None, "PDF-TEXT/1\nx"), "process_error"),
    ((0, None, None, "x"), "protocol_error"), ((33, None, None, "PDF-TEXT/1\nx"), "refused"), ((1, None, None, "PDF-TEXT/1\nx"), "process_error"),
    ((0, None, None, "PDF-TEXT/1\n \n"), "protocol_error"), ((0, None, None, "PDF-TEXT/1\r\n[PDF partly read: x]"), "partial_warning"),
    ((0, None, None, "PDF-TEXT/1\n[This document is a scan]"), "scan_ocr"), ((0, None, None, "PDF-TEXT/1\nq [PDF partly read:"), "digital_without_warning"),
])
def test_outcome(spark, result, want):
    status, signal, error, out = result
    col = P.extraction_outcome(F.lit(status), F.lit(signal).cast("string"), F.lit(error).cast("string"), F.lit(out))
    assert value(spark, col) == want


@pytest.mark.parametrize("row, want", [
    ("| a | b |", ["a", "b"]), ("a | b", ["a", "b"]), ("|| a ||", ["", "a", ""]), (r"| a\|b | c |", ["a|b", "c"]),
    (r"C:\share\\|x", [r"C:\share\\", "x"]), ("|", [""]), (r"|a\n|", [r"a\n"]),
])
def test_cells(spark, row, want):
    assert value(spark, M.cells(lit(row))) == want


def test_split_long(spark):
    assert value(spark, M.split_long(lit("aa bb cc dd"), 5)) == ["aa bb", "cc dd"]
    assert value(spark, M.split_long(lit("x abcdefgh y"), 3)) == ["x", "abc", "def", "gh", "y"]
    assert value(spark, M.split_long(lit("契約書の"), 4)) == ["契約", "書の"]


def test_bounds(spark):
    deep = "> " * 21 + "x"
    got = value(spark, M.markdown_bounds(lit(f"{deep}\n```\n{deep}\n{'*' * 900}\n```\n{'*' * 600} a\n{'_' * 500}\n\n{'*' * 700}")))
    assert list(got["nested"]) == [1] and got["delimiters"] == 1100
    # a shorter or different fence does not close one
    got = value(spark, M.markdown_bounds(lit(f"````\n```\n~~~\n{deep}\n````\n- - a")))
    assert list(got["nested"]) == []
    # thousands of markers are counted without recursion
    assert value(spark, M.nesting(F.repeat(F.lit(">"), 15000))) == 15000


def test_hostile_texts_are_read_once(spark):
    """Begun marks without ends, and one very wide table row, take time in proportion to their length."""
    from sparkdesk.operators.web import disallowed_markup, readable_pages

    tags = spark.createDataFrame([("<think>" * 300_000,), ("a</think>" + "<think>" * 300_000,)], "t string")
    rows = spark.createDataFrame([("|" + "--|" * 20_000,), ("|" + "--|" * 20_000 + "x|",)], "t string")
    pages = spark.createDataFrame([(i, m * 200_000) for i, m in enumerate(["<!--", "<script ", "<a ", "<script>"])], "page_id long, html string")
    for df, want in (
        (tags.select(X.clean_reply(F.col("t")).alias("x")), ["", "a"]),
        (rows.select(M.is_delimiter_row(F.col("t")).alias("x")), [True, False]),
    ):
        started = time.perf_counter()
        assert [r["x"] for r in df.collect()] == want
        assert time.perf_counter() - started < 20
    started = time.perf_counter()
    disallowed_markup(pages).collect()
    readable_pages(pages).collect()
    assert time.perf_counter() - started < 40
