"""Column functions over the given texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdesk.functions import text as X
from sparkdesk.functions.classes import (
    EXTRACTABLE, LEGACY, MACRO_TEMPLATE, TEMPLATE, UNREADABLE, WHITE, WHITE_CHARS, WIDE,
)
from sparkdesk.plans.derive import DUCK_LINES, MESSAGES_MARKED_SQL, document_lines, messages_marked, run
from sparkdesk.registry.core import query, table

# the same steps in DuckDB's terms
DUCK_CLEAN = (
    "replace(string_split(string_split(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '<think>')[1], "
    "'<tool_call>')[1], '</think>', '')"
)
_MARKED = f"WITH m AS ({MESSAGES_MARKED_SQL}), c AS (SELECT *, {DUCK_CLEAN} AS clean FROM m)"
TRIM = f"'{WHITE_CHARS}'"


def quoted(items):
    return ", ".join(f"'{i}'" for i in items)


@query("clean_reply_p1", _MARKED + " SELECT conv_id, turn, clean FROM c")
def clean_reply(spark, sf_dir):
    return messages_marked(spark, sf_dir).select("conv_id", "turn", X.clean_reply(F.col("text")).alias("clean"))


_HIDDEN = f"SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN concat('<think>', text) ELSE text END AS text FROM ({MESSAGES_MARKED_SQL}) AS m"


@query(
    "visible_replies_p2",
    f"WITH m AS ({_HIDDEN}), c AS (SELECT *, {DUCK_CLEAN} AS clean FROM m) "
    f"SELECT conv_id, turn FROM c WHERE length(trim(clean, {TRIM})) > 0",
)
def visible_replies(spark, sf_dir):
    return (
        run(spark, sf_dir, _HIDDEN, "conversations").where(X.has_visible_text(F.col("text"))).select("conv_id", "turn")
    )


_INFO = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Python' WHEN 2 THEN concat('C++', chr(9), ' Sorting  ', source)
  WHEN 3 THEN concat('  HTML  Chart of ', lang) WHEN 4 THEN concat(upper(lang), ' ', source, ' ') ELSE '   ' END AS info FROM documents"""


@query(
    "fence_info_p3",
    f"""WITH i AS (SELECT doc_id, trim(info, {TRIM}) AS info FROM ({_INFO}))
SELECT doc_id, CASE WHEN info = '' THEN 'text' ELSE lower(regexp_extract(info, '^([^{WHITE}]+)', 1)) END AS lang,
 trim(regexp_extract(info, '(?s)^[^{WHITE}]+[{WHITE}](.*)$', 1), {TRIM}) AS title FROM i""",
)
def fence_info(spark, sf_dir):
    return run(spark, sf_dir, _INFO, "documents").select(
        "doc_id", X.fence_label(F.col("info")).alias("lang"), X.fence_title(F.col("info")).alias("title")
    )


_INVISIBLE = "‍⁠️ �­ㅤ"


@query(
    "readable_lines_p4",
    f"""WITH l AS (SELECT doc_id, page_no, CASE WHEN (doc_id + page_no) % 9 = 0 THEN '{_INVISIBLE}' ELSE element END AS text FROM ({DUCK_LINES}))
SELECT doc_id, page_no, regexp_matches(text, '[^{UNREADABLE}]') AS readable FROM l""",
)
def readable_lines(spark, sf_dir):
    text = F.when((F.col("doc_id") + F.col("page_no")) % 9 == 0, _INVISIBLE).otherwise(F.col("element"))
    return document_lines(spark, sf_dir).select("doc_id", "page_no", X.is_readable(text).alias("readable"))


_BINARY = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(text, '�') ELSE text END AS text FROM documents"


@query(
    "binary_sniff_p5",
    f"SELECT doc_id, regexp_matches(substr(text, 1, 4096), '[\\x{{0}}\\x{{FFFD}}]') AS looks_binary FROM ({_BINARY})",
)
def binary_sniff(spark, sf_dir):
    return run(spark, sf_dir, _BINARY, "documents").select("doc_id", X.looks_binary(F.col("text")).alias("looks_binary"))


_NAMES = """SELECT doc_id, concat(source, '.', lang, CASE doc_id % 9 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.doc' WHEN 3 THEN '.dotx'
  WHEN 4 THEN '.POTM' WHEN 5 THEN '.txt' WHEN 6 THEN '' WHEN 7 THEN '.key' ELSE '.pdf.zip' END) AS name FROM documents"""


@query(
    "file_classes_p6",
    f"""SELECT doc_id, name, CASE WHEN e IN ({quoted(MACRO_TEMPLATE)}) THEN 'macro template' WHEN e IN ({quoted(TEMPLATE)}) THEN 'template'
 WHEN e IN ({quoted(EXTRACTABLE)}) THEN 'extractable' WHEN e IN ({quoted(LEGACY)}) THEN 'legacy' ELSE 'other' END AS class
FROM (SELECT *, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS e FROM ({_NAMES}))""",
)
def file_classes(spark, sf_dir):
    return run(spark, sf_dir, _NAMES, "documents").select("doc_id", "name", X.file_class(F.col("name")).alias("class"))


_MIXED = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, '契約書の概要ですＡＢ') ELSE text END AS text FROM documents"


@query(
    "token_estimate_p7",
    f"""WITH n AS (SELECT doc_id, length(text) AS n, length(regexp_replace(text, '[^\\x{{0}}-\\x{{7F}}]+', '', 'g')) AS a,
  length(regexp_replace(text, '[^{WIDE}]+', '', 'g')) AS w FROM ({_MIXED}))
SELECT doc_id, CAST(ceil(a / 4.0) + w + ceil((n - a - w) / 2.0) AS BIGINT) AS tokens FROM n""",
)
def token_estimate(spark, sf_dir):
    return run(spark, sf_dir, _MIXED, "documents").select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "display_width_p8",
    f"SELECT doc_id, length(text) + length(regexp_replace(text, '[^{WIDE}]+', '', 'g')) AS width FROM ({_MIXED})",
)
def display_width(spark, sf_dir):
    return run(spark, sf_dir, _MIXED, "documents").select("doc_id", X.display_width(F.col("text")).alias("width"))


_CELLS = """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN concat('00', CAST(p_size AS VARCHAR(20))) WHEN 1 THEN CAST(p_size AS VARCHAR(20))
  WHEN 2 THEN concat('-', CAST(p_size AS VARCHAR(20)), '.5') WHEN 3 THEN concat('0.', CAST(p_size AS VARCHAR(20))) WHEN 4 THEN concat('1,', CAST(100 + p_size AS VARCHAR(20)))
  WHEN 5 THEN concat(CAST(p_size AS VARCHAR(20)), '%') WHEN 6 THEN concat('9007199254740', CAST(100 + p_size AS VARCHAR(20))) WHEN 7 THEN concat(' ', CAST(p_size AS VARCHAR(20)), ' ')
  WHEN 8 THEN '' WHEN 9 THEN p_name ELSE concat(CAST(p_size AS VARCHAR(20)), '-', CAST(p_size AS VARCHAR(20))) END AS raw FROM part"""


@query(
    "cell_kinds_p9",
    f"""SELECT p_partkey, CASE WHEN regexp_full_match(s, '-?[0-9.-]+') AND try_cast(s AS DOUBLE) IS NOT NULL
   AND NOT regexp_matches(s, '^-?0[^.]') AND length(regexp_replace(s, '[^0-9]', '', 'g')) <= 15 THEN 'number' ELSE 'text' END AS kind
FROM (SELECT p_partkey, trim(raw, {TRIM}) AS s FROM ({_CELLS}))""",
)
def cell_kinds(spark, sf_dir):
    return run(spark, sf_dir, _CELLS, "part").select("p_partkey", X.cell_kind(F.col("raw")).alias("kind"))


_BILLED = """SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN concat('{"usage":{"prompt_tokens":', CAST(o_custkey AS VARCHAR(20)), ',"completion_tokens":', CAST(o_orderkey % 97 AS VARCHAR(20)), '}}')
  WHEN 1 THEN concat('{"usage":{"total_tokens":', CAST(o_custkey AS VARCHAR(20)), '}}')
  WHEN 2 THEN concat('{"usage":{"prompt_tokens":500,"total_tokens":', CAST(o_custkey AS VARCHAR(20)), '}}')
  WHEN 3 THEN '{"usage":null}' WHEN 4 THEN concat('{"usage":{"prompt_tokens":"', CAST(o_custkey AS VARCHAR(20)), '","total_tokens":7}}')
  ELSE '{"choices":[]}' END AS reply FROM orders"""


@query(
    "token_usage_p10",
    """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 2 THEN 500 ELSE 0 END AS prompt,
 CASE o_orderkey % 6 WHEN 0 THEN o_orderkey % 97 WHEN 1 THEN o_custkey WHEN 2 THEN greatest(o_custkey - 500, 0) ELSE 7 END AS completion
FROM orders WHERE o_orderkey % 6 IN (0, 1, 2, 4)""",
)
def token_usage(spark, sf_dir):
    return (
        run(spark, sf_dir, _BILLED, "orders").select("o_orderkey", X.token_usage(F.col("reply")).alias("u"))
        .where("u IS NOT NULL").select("o_orderkey", "u.prompt", "u.completion")
    )


_LISTED = "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN concat('1. one', chr(10), text, chr(10), '  22) two', chr(10), chr(10), '3.three', chr(10), '4. ') ELSE text END AS text FROM documents"


@query(
    "text_counts_p11",
    f"""SELECT doc_id, len(regexp_extract_all(text, '[^{WHITE}]+')) AS words,
 len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {TRIM}) <> '')) AS lines,
 len(regexp_extract_all(text, '(?m)^[{WHITE}]*[0-9]+[.)][{WHITE}]+')) AS numbered FROM ({_LISTED})""",
)
def text_counts(spark, sf_dir):
    c = F.col("text")
    return run(spark, sf_dir, _LISTED, "documents").select(
        "doc_id", X.word_count(c).alias("words"), X.line_count(c).alias("lines"), X.numbered_items(c).alias("numbered")
    )


SENT_AS_SQL = """CASE conv_id % 7 WHEN 0 THEN '{"mode":"image"}' WHEN 1 THEN '{"mode":"chat","webSearch":true,"force":"true"}'
  WHEN 2 THEN '{"mode":"chat","webSearch":"false","force":true,"quick":true}' WHEN 3 THEN '{"mode":"voice","webSearch":true}'
  WHEN 4 THEN '"chat"' WHEN 5 THEN NULL ELSE '{"mode":"chat"}' END"""
DUCK_SENT = """SELECT k, mode, web_search, force, quick FROM (VALUES (0,'image',false,false,false),(1,'chat',true,false,false),
  (2,'chat',false,true,true),(6,'chat',false,false,false)) AS s(k, mode, web_search, force, quick)"""


@query(
    "sent_as_p12",
    f"SELECT conv_id, turn, mode, web_search, force, quick FROM conversations JOIN ({DUCK_SENT}) s ON conv_id % 7 = k",
)
def sent_as(spark, sf_dir):
    return (
        run(spark, sf_dir, f"SELECT conv_id, turn, {SENT_AS_SQL} AS sent_as FROM conversations", "conversations")
        .select("conv_id", "turn", X.sent_as(F.col("sent_as")).alias("s")).where("s IS NOT NULL")
        .select("conv_id", "turn", "s.*")
    )


@query(
    "research_steps_p13",
    """SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN least(1000, len(string_split(text, ' '))) ELSE 0 END AS steps,
 CASE WHEN doc_id % 3 < 2 THEN coalesce(array_to_string(list_slice(string_split(text, ' '), 1, 1000), '|'), '') ELSE '' END AS joined FROM documents""",
)
def research_steps(spark, sf_dir):
    words = F.split("text", " ")
    raw = F.when(F.col("doc_id") % 3 == 0, F.to_json(words)).when(
        # numbers and objects between the strings, which do not count as steps
        F.col("doc_id") % 3 == 1,
        F.concat(F.regexp_replace(F.to_json(words), r"\]$", ""), F.lit(',7,{"length":3}]')),
    ).otherwise(F.lit('{"length":1000000000}'))
    return table(spark, sf_dir, "documents").select("doc_id", X.steps_of(raw).alias("s")).select(
        "doc_id", F.size("s").cast("long").alias("steps"), F.array_join("s", "|").alias("joined")
    )


@query(
    "clamp_text_p15",
    f"""SELECT doc_id, CASE WHEN length(t) <= 600 THEN t ELSE left(t, 600) || '… (truncated)' END AS shown
FROM (SELECT doc_id, trim(text, {TRIM}) AS t FROM documents)""",
)
def clamp_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.clamp(F.col("text")).alias("shown"))


# the spans of inline Markdown for an engine without look-ahead: what a span may not begin with is spelled out
_DUCK_SPANS = (
    r"\*\*([^ \n*][^\n]*?|\*[^\n*][^\n]*?)\*\*|__([^ \n_][^\n]*?|_[^\n_][^\n]*?)__|\*([^ \n*][^\n*]*)\*|_([^ \n_][^\n_]*)_|`([^ \n`][^\n`]*)`"
)


def duck_flat(c: str) -> str:
    return rf"regexp_replace({c}, '{_DUCK_SPANS}', '\1\2\3\4\5', 'g')"


_WRAPPED = """array_to_string(list_transform(string_split(element, ' '), lambda w: CASE WHEN w = '' THEN w ELSE concat(
 CASE page_no % 5 WHEN 0 THEN '**' WHEN 1 THEN '__' WHEN 2 THEN '*' WHEN 3 THEN '_' ELSE '`' END, w,
 CASE page_no % 5 WHEN 0 THEN '**' WHEN 1 THEN '__' WHEN 2 THEN '*' WHEN 3 THEN '_' ELSE '`' END) END), ' ')"""


@query(
    "flat_inline_p16",
    f"""SELECT doc_id, page_no, false AS wrapped, {duck_flat("element")} AS plain FROM ({DUCK_LINES})
UNION ALL SELECT doc_id, page_no, true, {duck_flat(_WRAPPED)} FROM ({DUCK_LINES})""",
)
def flat_inline(spark, sf_dir):
    """Every given line as it is, and with its words wrapped in markers."""
    e, k = F.col("element"), F.col("page_no") % 5
    words = F.split("element", " ")
    mark = F.when(k == 0, "**").when(k == 1, "__").when(k == 2, "*").when(k == 3, "_").otherwise("`")
    wrapped = F.array_join(F.transform(words, lambda w: F.when(w == "", w).otherwise(F.concat(mark, w, mark))), " ")
    both = F.array(F.struct(F.lit(False).alias("wrapped"), e.alias("line")), F.struct(F.lit(True).alias("wrapped"), wrapped.alias("line")))
    return document_lines(spark, sf_dir).select("doc_id", "page_no", F.inline(both)).select(
        "doc_id", "page_no", "wrapped", X.flatten_inline(F.col("line")).alias("plain")
    )
