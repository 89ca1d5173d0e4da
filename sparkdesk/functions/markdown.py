"""Column functions over Markdown lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkdesk.functions.classes import J_WHITE
from sparkdesk.functions.text import display_width, trimmed

_RULED = rf"^[{J_WHITE}]*+[-:]++[{J_WHITE}]*+$"
_CONTAINER = r"\G {0,3}(?:>[ \t]?|(?:[-*+]|[0-9]{1,9}[.)])(?:[ \t]+|$))"
MAX_NESTING = 20
MAX_DELIMITERS = 1000


def is_delimiter_row(line: Column) -> Column:
    """Whether every cell of a line with a pipe holds hyphens and colons only, a hyphen at least."""
    parts = F.split(F.regexp_replace(F.regexp_replace(line, r"^\|", ""), r"\|$", ""), r"\|")
    return F.contains(line, F.lit("|")) & F.forall(parts, lambda p: F.contains(p, F.lit("-")) & p.rlike(_RULED))


def plain_kind(line: Column) -> Column:
    """What a trimmed line is on its own: tables need the line below."""
    packed = F.regexp_replace(line, f"[{J_WHITE}]+", "")
    number = F.regexp_extract(line, r"^([0-9]+)[.)] ", 1).try_cast("long")
    return (
        F.when(line == "", "blank")
        .when(packed.rlike(r"^(?:-{3,}|\*{3,}|_{3,})$"), "rule")
        .when(line.startswith(">"), F.when(quote_text(line) == "", "quote break").otherwise("quote"))
        .when(line.rlike(r"^#{1,6} "), "heading")
        .when(line.rlike(r"^[-*+] "), "bullet")
        .when(F.coalesce(number <= 4294967295, F.lit(False)), "numbered")
        .otherwise("para")
    )


def quote_text(line: Column) -> Column:
    return trimmed(F.regexp_replace(line, "^> ?", ""))


def line_text(kind: Column, line: Column) -> Column:
    """A trimmed line without its block marker."""
    return (
        F.when(kind == "quote", quote_text(line))
        .when(kind == "heading", trimmed(F.regexp_replace(line, "^#{1,6} ", "")))
        .when(kind == "bullet", trimmed(F.regexp_replace(line, "^[-*+] ", "")))
        .when(kind == "numbered", trimmed(F.regexp_replace(line, "^[0-9]+[.)] ", "")))
        .otherwise(line)
    )


def cells(row: Column) -> Column:
    r"""The cells of a trimmed table row. The outer pipes are optional, ``\|`` is
    a pipe inside a cell, any other escape is left as written."""
    inner = F.regexp_replace(row, r"^\|", "")
    # every match ends at a pipe or at the end; the last one is the empty rest
    parts = F.regexp_extract_all(inner, F.lit(r"((?:\\.|\\$|[^\\|])*+)(?:\||$)"), F.lit(1))
    kept = F.when(inner == "", F.array(F.lit(""))).otherwise(F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - 1)))
    return F.transform(kept, lambda c: trimmed(F.regexp_replace(c, r"(\\[^|])|\\(\|)", "$1$2")))


def split_long(text: Column, budget: int) -> Column:
    """Text in pieces that each fit ``budget`` columns, broken at words; a word
    that is too wide by itself is broken by width."""

    def chunks(word: Column) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("part"), F.lit(0).cast("long").alias("width"))
        chars = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))

        def add(acc: Column, ch: Column) -> Column:
            w = display_width(ch)
            full = acc["width"] + w > budget
            return F.struct(
                F.when(full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"),
                F.when(full, ch).otherwise(F.concat(acc["part"], ch)).alias("part"),
                F.when(full, w).otherwise(acc["width"] + w).alias("width"),
            )

        return F.aggregate(chars, start, add, lambda acc: F.concat(acc["done"], F.array(acc["part"])))

    def token(piece: Column, hard: bool) -> Column:
        return F.struct(piece.alias("text"), display_width(piece).alias("width"), F.lit(hard).alias("hard"))

    words = F.split(trimmed(text), f"[{J_WHITE}]+")
    tokens = F.flatten(F.transform(words, lambda w: F.when(
        display_width(w) > budget, F.transform(chunks(w), lambda c: token(c, True))
    ).otherwise(F.array(token(w, False)))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("current"), F.lit(0).cast("long").alias("width"))

    def step(acc: Column, t: Column) -> Column:
        empty = acc["current"] == ""
        flush = ~empty & (t["hard"] | (acc["width"] + 1 + t["width"] > budget))
        fresh = empty | flush
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["current"]))).otherwise(acc["done"]).alias("done"),
            F.when(fresh, t["text"]).otherwise(F.concat(acc["current"], F.lit(" "), t["text"])).alias("current"),
            F.when(fresh, t["width"]).otherwise(acc["width"] + 1 + t["width"]).alias("width"),
        )

    pieces = F.aggregate(tokens, start, step, lambda acc: F.when(
        acc["current"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["current"]))))
    return F.when(display_width(text) <= budget, F.array(text)).otherwise(pieces)


def nesting(line: Column) -> Column:
    """How many quote or list markers a line opens with."""
    return F.regexp_count(line, F.lit(_CONTAINER))


def markdown_bounds(text: Column, max_nesting: int = MAX_NESTING, max_delimiters: int = MAX_DELIMITERS) -> Column:
    """struct(nested: lines nested too deep, delimiters: most emphasis marks in
    a paragraph). Fenced lines count for neither.

    A fence is closed only by the same character, at least as long, so whether
    a line is fenced depends on every fence before it: one pass over the text's
    own lines, carrying the open fence and the paragraph's count.
    """
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(
        (i + 1).alias("no"), F.regexp_extract(s, r"^ {0,3}(`{3,}|~{3,})", 1).alias("fence"),
        (trimmed(s) == "").alias("blank"), F.regexp_count(s, F.lit("[*_~]")).alias("marks"), nesting(s).alias("depth"),
    ))
    start = F.struct(
        F.lit("").alias("open"), F.lit(0).alias("marks"), F.lit(0).alias("most"), F.array().cast("array<int>").alias("nested"),
    )

    def step(acc: Column, x: Column) -> Column:
        fenced = acc["open"] != ""
        mark = x["fence"] != ""
        closes = fenced & mark & (F.left(x["fence"], F.lit(1)) == F.left(acc["open"], F.lit(1))) & (
            F.length(x["fence"]) >= F.length(acc["open"])
        )
        plain = ~fenced & ~mark
        marks = F.when(plain, F.when(x["blank"], 0).otherwise(acc["marks"]) + x["marks"]).otherwise(acc["marks"])
        return F.struct(
            F.when(closes, "").when(fenced, acc["open"]).otherwise(x["fence"]).alias("open"),
            marks.alias("marks"),
            F.greatest(acc["most"], marks).alias("most"),
            F.when(plain & (x["depth"] > max_nesting), F.concat(acc["nested"], F.array(x["no"]))).otherwise(acc["nested"]).alias("nested"),
        )

    return F.aggregate(lines, start, step, lambda acc: F.struct(acc["nested"].alias("nested"), acc["most"].alias("delimiters")))
