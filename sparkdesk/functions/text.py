"""Column functions over message and document text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkdesk.functions.classes import (
    ARTIFACT_LABELS, EXTRACTABLE, LABEL_NAMES, J_NOT_WHITE, J_NOT_WIDE, J_READABLE, J_WHITE, LEGACY, MACRO_TEMPLATE,
    TEMPLATE, WHITE_CHARS,
)

FENCE = r"(?s)```([^\n]*)\n(.*?)```"
OPEN_FENCE = r"(?s)```([^\n]*)\n(.*)$"
SNIFF_CHARS = 4096
MAX_STEPS = 1000
MAX_ERROR_CHARS = 600


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_CHARS))


def upto_last(c: Column, mark: str, change) -> Column:
    """``change`` applied to the text up to its last ``mark``; what follows stays."""
    rest = F.substring_index(c, mark, -1)
    return F.concat(change(F.left(c, F.length(c) - F.length(rest))), rest)


def clean_reply(c: Column) -> Column:
    """Drop reasoning markup: closed blocks, an unclosed block to the end,
    everything from a tool call on, then orphan close tags."""
    # up to the last end mark every begin mark finds an end, so no tag is searched to the end in vain
    closed = upto_last(c, "</think>", lambda head: F.regexp_replace(head, r"(?s)<think>.*?</think>", ""))
    cut = F.substring_index(F.substring_index(closed, "<think>", 1), "<tool_call>", 1)
    return F.replace(cut, F.lit("</think>"), F.lit(""))


def has_visible_text(c: Column) -> Column:
    return F.length(trimmed(clean_reply(F.coalesce(c, F.lit(""))))) > 0


def fence_label(info: Column) -> Column:
    """Lower-case first word of a fence's info string, ``text`` when there is none."""
    word = F.regexp_extract(trimmed(info), rf"^([{J_NOT_WHITE}]+)", 1)
    return F.when(word == "", "text").otherwise(F.lower(word))


def fence_title(info: Column) -> Column:
    return trimmed(F.regexp_extract(trimmed(info), rf"(?s)^[{J_NOT_WHITE}]+[{J_WHITE}](.*)$", 1))


def is_readable(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{J_READABLE}]"), F.lit(False))


def looks_binary(c: Column) -> Column:
    """A NUL or replacement character among the first characters, as a sniffer sees them."""
    return F.substring(c, 1, SNIFF_CHARS).rlike(r"[\x{0}\x{FFFD}]")


def file_class(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return (
        F.when(ext.isin(MACRO_TEMPLATE), "macro template")
        .when(ext.isin(TEMPLATE), "template")
        .when(ext.isin(EXTRACTABLE), "extractable")
        .when(ext.isin(LEGACY), "legacy")
        .otherwise("other")
    )


def count_wide(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[{J_NOT_WIDE}]+", ""))


def estimate_tokens(c: Column) -> Column:
    """Four ASCII characters, one wide character or two others per token."""
    ascii_n, wide_n = F.length(F.regexp_replace(c, r"[^\x{0}-\x{7F}]+", "")), count_wide(c)
    other = F.length(c) - ascii_n - wide_n
    mixed = F.ceil(ascii_n / 4) + wide_n + F.ceil(other / 2)
    return F.when(_all_ascii(c), F.ceil(F.length(c) / 4)).otherwise(mixed).cast("long")


def _all_ascii(c: Column) -> Column:
    """One byte per character: no class needs counting."""
    return F.octet_length(c) == F.length(c)


def display_width(c: Column) -> Column:
    wide = F.when(_all_ascii(c), 0).otherwise(count_wide(c))
    return (F.length(c) + wide).cast("long")


def cell_kind(raw: Column) -> Column:
    """``number`` only for an unambiguous quantity that a double can hold."""
    s = trimmed(raw)
    number = s.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    leading_zero = s.rlike(r"^-?0[^.]")
    digits = F.length(F.regexp_replace(s, "[^0-9]", ""))
    return F.when(number & ~leading_zero & (digits <= 15), "number").otherwise("text")


_USAGE = "struct<usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>"


def token_usage(json: Column) -> Column:
    """struct(prompt, completion) billed by a provider reply, null without usage.

    Where either direction is missing the total decides, less the prompt.
    """
    u = F.from_json(json, _USAGE)["usage"]

    def count(name: str) -> Column:
        return F.when(u[name] >= 0, u[name])

    prompt, completion, total = count("prompt_tokens"), count("completion_tokens"), count("total_tokens")
    zero = F.lit(0).cast("long")
    rest = F.greatest(zero, total - F.coalesce(prompt, zero))
    return F.when(
        prompt.isNotNull() & completion.isNotNull(),
        F.struct(prompt.alias("prompt"), completion.alias("completion")),
    ).when(total.isNotNull(), F.struct(F.coalesce(prompt, zero).alias("prompt"), rest.alias("completion")))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{J_NOT_WHITE}]+")).cast("long")


def line_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"[^\n]*[{J_NOT_WHITE}][^\n]*")).cast("long")


def numbered_items(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"(?m)^[{J_WHITE}]*[0-9]+[.)][{J_WHITE}]+")).cast("long")


_SENT_AS = "struct<mode:string,webSearch:boolean,force:boolean,quick:boolean>"


def sent_as(json: Column) -> Column:
    """How a stored turn says it was sent. An unknown mode is no record, and
    only a JSON ``true`` switches anything on."""
    s = F.from_json(json, _SENT_AS)

    def flag(name: str) -> Column:
        return F.when(s["mode"] == "chat", F.coalesce(s[name], F.lit(False))).otherwise(F.lit(False))

    return F.when(
        s["mode"].isin("image", "chat"),
        F.struct(
            s["mode"].alias("mode"), flag("webSearch").alias("web_search"), flag("force").alias("force"),
            flag("quick").alias("quick"),
        ),
    )


def steps_of(json: Column, limit: int = MAX_STEPS) -> Column:
    """The strings among the first ``limit`` steps; nothing unless it is a real array."""
    v = F.try_parse_json(json)
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    kept = F.filter(F.slice(items, 1, limit), lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.transform(kept, lambda x: x.cast("string")), F.array().cast("array<string>"))


def clamp(c: Column, limit: int = MAX_ERROR_CHARS) -> Column:
    body = trimmed(c)
    return F.when(F.length(body) <= limit, body).otherwise(F.concat(F.left(body, F.lit(limit)), F.lit("… (truncated)")))


# bold, italic and code spans: not empty, not led by a space, not across lines
_SPANS = (
    r"\*\*((?! |\*\*)[^\n]+?)\*\*|__((?! |__)[^\n]+?)__|\*((?! )[^\n*]+)\*|_((?! )[^\n_]+)_|`((?! )[^\n`]+)`"
)


def flatten_inline(c: Column) -> Column:
    """Inline Markdown as plain text; markers that open no span stay as written."""
    return F.regexp_replace(c, _SPANS, "$1$2$3$4$5")


PARTIAL_MARK = "[PDF partly read:"
SCAN_MARK = "[This document is a scan"


def _warning(content: Column) -> Column:
    head = F.substring_index(content, "\n\n", 1)
    return F.when(content.startswith(PARTIAL_MARK), F.regexp_replace(head, r"^\[|\]$", ""))


def _named_pages(content: Column, lead: str) -> Column:
    listed = F.regexp_extract(_warning(content), lead + r": ([0-9, ]+)\.", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda p: F.trim(p)), lambda p: p != "")


def missing_pages(content: Column) -> Column:
    return _named_pages(content, "Pages without readable digital text")


def recognised_pages(content: Column) -> Column:
    return _named_pages(content, "Pages read from a picture")


def unreadable_pages(content: Column) -> Column:
    """Pages a scan's text says could not be read."""
    found = F.regexp_extract_all(content, F.lit(r"(?m)^\[Page ([0-9]+)\] could not be read"), F.lit(1))
    return F.when(content.startswith(SCAN_MARK), found).otherwise(F.array().cast("array<string>"))


def message_parts(text: Column) -> Column:
    """Artifacts of a cleaned reply, in order: array of struct(lang, title, code, pending).

    Fences whose label is not on the list stay in the text. What follows the
    last artifact may hold a fence that is still open: only the *first* fence
    there is looked at, and it is pending when its label is on the list.
    """
    whole = F.regexp_extract_all(text, F.lit(FENCE), F.lit(0))
    fences = F.transform(whole, lambda m: F.struct(
        fence_label(F.regexp_extract(m, FENCE, 1)).alias("lang"),
        fence_title(F.regexp_extract(m, FENCE, 1)).alias("title"),
        F.regexp_extract(m, FENCE, 2).alias("code"),
        F.lit(False).alias("pending"),
        F.length(m).alias("size"),
    ))
    gaps = F.transform(F.split(text, FENCE, -1), lambda g: F.length(g))
    # characters up to the end of the last artifact
    ends = F.transform(fences, lambda f, i: F.when(f["lang"].isin(ARTIFACT_LABELS), i + 1).otherwise(0))
    last = F.coalesce(F.array_max(ends), F.lit(0))
    zero = F.lit(0)
    end = F.aggregate(F.slice(gaps, zero + 1, last), zero, lambda a, x: a + x) + F.aggregate(
        F.transform(F.slice(fences, zero + 1, last), lambda f: f["size"]), zero, lambda a, x: a + x
    )
    rest = F.substr(text, end + 1)
    info = F.regexp_extract(rest, OPEN_FENCE, 1)
    is_open = rest.rlike(OPEN_FENCE) & fence_label(info).isin(ARTIFACT_LABELS)
    pending = F.when(is_open, F.array(F.struct(
        fence_label(info).alias("lang"), fence_title(info).alias("title"),
        F.regexp_extract(rest, OPEN_FENCE, 2).alias("code"), F.lit(True).alias("pending"),
    ))).otherwise(F.array())
    closed = F.transform(
        F.filter(fences, lambda f: f["lang"].isin(ARTIFACT_LABELS)),
        lambda f: F.struct(f["lang"].alias("lang"), f["title"].alias("title"), f["code"].alias("code"), f["pending"].alias("pending")),
    )
    return F.concat(closed, pending)


def artifact_title(lang: Column, title: Column, code: Column) -> Column:
    """The fence's own title, else the page title or first heading, else the label's name."""
    names = F.create_map(*[F.lit(x) for kv in LABEL_NAMES.items() for x in kv])
    page = trimmed(F.regexp_extract(code, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    heading = trimmed(F.regexp_extract(code, r"(?i)<h[1-3][^>]*>([^<]+)</h[1-3]>", 1))
    return F.coalesce(
        F.nullif(title, F.lit("")), F.nullif(page, F.lit("")), F.nullif(heading, F.lit("")), names[lang], F.upper(lang)
    )
