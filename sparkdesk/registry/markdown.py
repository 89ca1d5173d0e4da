"""Queries over Markdown derived from the given documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdesk.functions import markdown as MF
from sparkdesk.functions.classes import WHITE, WIDE
from sparkdesk.operators import markdown as M
from sparkdesk.registry.core import query, table
from sparkdesk.registry.text import TRIM, duck_flat


def markdown_documents(spark, sf_dir):
    """Document lines as given, marked up by position; every tenth has a table, whose last
    row reads as a list item, and every twentieth a second table."""
    p = lambda i: i + 1

    def marked(s, i):
        n = p(i)
        return (
            F.when(n == 1, F.concat(F.lit("# "), s)).when(n % 21 == 0, ">").when(n % 9 == 0, F.concat(F.lit("## "), s))
            .when(n % 4 == 0, F.concat(F.lit("- "), s)).when(n % 5 == 0, F.concat(n.cast("string"), F.lit(". "), s))
            .when(n % 7 == 0, F.concat(F.lit("> "), s)).when(n % 11 == 0, F.concat(s, F.lit("\n\n"))).when(n % 13 == 0, " - - - ")
            .otherwise(s)
        )

    lines = F.split("text", "\n")
    rows = F.transform(lines, lambda s, i: F.concat(
        F.lit("| "), p(i).cast("string"), F.lit(r" | a\|b "), F.col("lang"), F.lit(" | "), F.length(s).cast("string"), F.lit(" |")))
    tail = F.concat(
        F.lit("\n\nline | name | size\n---|:-:|--\n"), F.array_join(rows, "\n"), F.lit("\n- last | \\x | \n\nend.\n"),
        F.when(F.col("doc_id") % 20 == 0, "\n|a|b|\n|-|-|\n|1|\n|||\n").otherwise(""),
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.array_join(F.transform(lines, marked), "\n"), F.when(F.col("doc_id") % 10 == 0, tail).otherwise("")).alias("text")
    )


_MD = r"""md AS (SELECT doc_id, concat(array_to_string(list_transform(ls, lambda s, n: CASE WHEN n = 1 THEN '# ' || s WHEN n % 21 = 0 THEN '>' WHEN n % 9 = 0 THEN '## ' || s
  WHEN n % 4 = 0 THEN '- ' || s WHEN n % 5 = 0 THEN n || '. ' || s WHEN n % 7 = 0 THEN '> ' || s WHEN n % 11 = 0 THEN s || chr(10) || chr(10) WHEN n % 13 = 0 THEN ' - - - ' ELSE s END), chr(10)),
 CASE WHEN doc_id % 10 = 0 THEN concat(chr(10), chr(10), 'line | name | size', chr(10), '---|:-:|--', chr(10),
   array_to_string(list_transform(ls, lambda s, n: concat('| ', n, ' | a\|b ', lang, ' | ', length(s), ' |')), chr(10)), chr(10), '- last | \x | ', chr(10), chr(10), 'end.', chr(10),
   CASE WHEN doc_id % 20 = 0 THEN concat(chr(10), '|a|b|', chr(10), '|-|-|', chr(10), '|1|', chr(10), '|||', chr(10)) ELSE '' END) ELSE '' END) AS text
 FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents))"""
_CELL = rf"[{WHITE}]*[-:]*-[-:]*[{WHITE}]*"
_BLOCKS = rf"""{_MD},
l AS (SELECT doc_id, i - 1 AS line_no, trim(raw, {TRIM}) AS line FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS raw FROM md)),
k AS (SELECT *, contains(line, '|') AS piped, contains(line, '|') AND regexp_matches(line, '^\|?{_CELL}(?:\|{_CELL})*\|?$') AS rule_row, CASE WHEN line = '' THEN 'blank'
  WHEN regexp_matches(regexp_replace(line, '[{WHITE}]+', '', 'g'), '^(-{{3,}}|\*{{3,}}|_{{3,}})$') THEN 'rule' WHEN line LIKE '>%' THEN CASE WHEN trim(substr(line, 2), {TRIM}) = '' THEN 'quote break' ELSE 'quote' END
  WHEN regexp_matches(line, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(line, '^[-*+] ') THEN 'bullet' WHEN regexp_matches(line, '^[0-9]{{1,9}}[.)] ') THEN 'numbered' ELSE 'para' END AS k0 FROM l),
o AS (SELECT *, k0 = 'para' AND piped AND coalesce(lead(rule_row) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS opens,
  sum(CASE WHEN piped THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS pipe_run FROM k),
t AS (SELECT *, min(line_no) FILTER (opens) OVER (PARTITION BY doc_id, pipe_run) AS t0 FROM o),
f AS (SELECT *, CASE WHEN piped AND line_no = t0 + 1 THEN 'delimiter' WHEN piped AND line_no >= t0 THEN 'table' ELSE k0 END AS kind, piped AND coalesce(line_no >= t0, false) AS in_table FROM t),
s AS (SELECT *, CASE WHEN kind = 'table' THEN line_no = t0 WHEN kind IN ('rule', 'heading', 'bullet', 'numbered') THEN true WHEN kind IN ('para', 'quote')
   THEN coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no), '') <> kind ELSE false END AS starts FROM f),
b AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS block_no FROM s),
blocks AS (SELECT * REPLACE ({duck_flat("text")} AS text) FROM (SELECT doc_id, block_no, kind, max(CASE WHEN kind = 'heading' THEN length(regexp_extract(line, '^(#+)', 1)) END) AS level,
  max(CASE WHEN kind = 'numbered' THEN CAST(regexp_extract(line, '^([0-9]+)', 1) AS BIGINT) END) AS ordinal,
  string_agg(CASE kind WHEN 'quote' THEN trim(regexp_replace(line, '^> ?', ''), {TRIM}) WHEN 'heading' THEN trim(regexp_replace(line, '^#+ ', ''), {TRIM}) WHEN 'bullet' THEN trim(substr(line, 3), {TRIM})
   WHEN 'numbered' THEN trim(regexp_replace(line, '^[0-9]+[.)] ', ''), {TRIM}) WHEN 'para' THEN line END, ' ' ORDER BY line_no) AS text
  FROM b WHERE kind NOT IN ('blank', 'quote break', 'delimiter') GROUP BY doc_id, block_no, kind)),
trow AS (SELECT doc_id, block_no, CAST(row_number() OVER (PARTITION BY doc_id, block_no ORDER BY line_no) - 1 AS BIGINT) AS row_no,
  list_transform(string_split(replace(regexp_replace(regexp_replace(line, '^\|', ''), '\|[ ]*$', ''), '\|', chr(1)), '|'), lambda c: trim(replace(c, chr(1), '|'), {TRIM})) AS cs FROM b WHERE kind = 'table'),
cells AS (SELECT * REPLACE ({duck_flat("text")} AS text) FROM (SELECT doc_id, block_no, row_no, unnest(range(0, len(cs))) AS col_no, unnest(cs) AS text FROM trow))"""


@query("markdown_blocks_w13", f"WITH {_BLOCKS} SELECT * FROM blocks")
def markdown_blocks(spark, sf_dir):
    return M.blocks(markdown_documents(spark, sf_dir))


@query("table_cells_w14", f"WITH {_BLOCKS} SELECT * FROM cells")
def table_cells(spark, sf_dir):
    return M.cells(markdown_documents(spark, sf_dir))


_SHEET = f"""{_BLOCKS}, fb AS (SELECT doc_id, min(block_no) AS block_no FROM cells GROUP BY doc_id),
dl AS (SELECT doc_id, CASE WHEN contains(text, chr(9)) THEN chr(9) ELSE ',' END AS d, list_filter(string_split(text, chr(10)), lambda x: trim(x, {TRIM}) <> '') AS ls FROM md WHERE doc_id NOT IN (SELECT doc_id FROM fb)),
dr AS (SELECT doc_id, d, unnest(range(0, len(ls))) AS row_no, unnest(ls) AS line FROM dl),
sheet AS (SELECT doc_id, row_no, col_no, text FROM cells JOIN fb USING (doc_id, block_no)
 UNION ALL SELECT doc_id, row_no, unnest(range(0, len(string_split(line, d)))), trim(unnest(string_split(line, d)), {TRIM}) FROM dr)"""


@query("sheet_rows_w15", f"WITH {_SHEET} SELECT * FROM sheet")
def sheet_rows(spark, sf_dir):
    return M.sheet_rows(markdown_documents(spark, sf_dir))


@query(
    "column_widths_a14",
    f"""WITH {_SHEET} SELECT doc_id, col_no, CAST(greatest(9, least(60, max(length(text) + length(regexp_replace(text, '[^{WIDE}]+', '', 'g'))) + 2)) AS BIGINT) AS width FROM sheet GROUP BY ALL""",
)
def column_widths(spark, sf_dir):
    return M.column_widths(M.sheet_rows(markdown_documents(spark, sf_dir)))


@query(
    "list_runs_w18",
    f"""WITH {_BLOCKS}, i AS (SELECT *, kind IN ('bullet', 'numbered') AND kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY block_no) AS starts FROM blocks),
r AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS run FROM i),
n AS (SELECT *, first_value(coalesce(ordinal, 1)) OVER w AS start, row_number() OVER w AS pos FROM r WHERE kind IN ('bullet', 'numbered') WINDOW w AS (PARTITION BY doc_id, run ORDER BY block_no))
SELECT doc_id, block_no, CAST(run AS BIGINT) AS run, start + pos - 1 AS ordinal FROM n""",
)
def list_runs(spark, sf_dir):
    return M.list_runs(M.blocks(markdown_documents(spark, sf_dir)))


@query(
    "heading_styles_w19",
    f"""WITH {_BLOCKS}, h AS (SELECT doc_id, block_no, least(level, 3) AS wanted, CASE WHEN doc_id % 9 < 8 THEN doc_id % 9 END AS t FROM blocks WHERE kind = 'heading')
SELECT doc_id, block_no, CASE WHEN t IS NULL THEN 'Heading' || wanted WHEN wanted >= 3 AND t >= 4 THEN 'Heading3' WHEN wanted >= 2 AND (t // 2) % 2 = 1 THEN 'Heading2' WHEN t % 2 = 1 THEN 'Heading1' END AS style FROM h""",
)
def heading_styles(spark, sf_dir):
    """Eight templates, one for each set of defined levels, and documents without one."""
    headings = M.blocks(markdown_documents(spark, sf_dir)).where("kind = 'heading'").select(
        "doc_id", "block_no", "level", F.when(F.col("doc_id") % 9 < 8, F.col("doc_id") % 9).alias("template_id")
    )
    levels = F.array_compact(F.array(*[
        F.when(F.floor(F.col("t") / 2 ** i) % 2 == 1, F.lit(i + 1)) for i in range(3)
    ]))
    templates = table(spark, sf_dir, "documents").select((F.col("doc_id") % 9).alias("t")).where("t < 8").distinct().select(
        F.col("t").alias("template_id"), F.explode(levels.cast("array<bigint>")).alias("level")
    )
    return M.heading_styles(headings, templates)


_SLIDES = f"""{_BLOCKS}, filled AS (SELECT DISTINCT doc_id, block_no FROM cells WHERE text <> ''),
lv AS (SELECT doc_id, level, count(*) AS n FROM blocks WHERE kind = 'heading' GROUP BY ALL),
tops AS (SELECT doc_id, coalesce(min(level) FILTER (n > 1), min(level)) AS top FROM lv GROUP BY doc_id),
said AS (SELECT b.*, coalesce(top, 1) AS top, CASE WHEN kind = 'numbered' THEN ordinal || '. ' || text ELSE text END AS line FROM blocks b LEFT JOIN tops USING (doc_id)
  WHERE kind <> 'rule' AND (CASE WHEN kind = 'table' THEN (doc_id, block_no) IN (SELECT (doc_id, block_no) FROM filled) ELSE kind = 'heading' OR text <> '' END)),
op AS (SELECT *, (kind = 'heading' AND level = top) OR (kind <> 'table' AND row_number() OVER (PARTITION BY doc_id ORDER BY block_no) = 1) AS opener FROM said),
st AS (SELECT *, opener OR (kind = 'table' AND NOT coalesce(lag(opener) OVER (PARTITION BY doc_id ORDER BY block_no), false)) AS starts FROM op),
sl AS (SELECT *, CAST(sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER w - 1 AS BIGINT) AS slide_no,
  coalesce(last_value(CASE WHEN opener THEN line END IGNORE NULLS) OVER w, '') AS title FROM st WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
slides AS (SELECT doc_id, slide_no, title, coalesce(string_agg(CASE WHEN NOT opener AND kind <> 'table' THEN line END, '|' ORDER BY block_no), '') AS bullets, max(CASE WHEN kind = 'table' THEN block_no END) AS table_block
  FROM sl GROUP BY ALL)"""


@query("slides_w16", f"WITH {_SLIDES} SELECT * FROM slides")
def slides(spark, sf_dir):
    return M.slides(markdown_documents(spark, sf_dir)).withColumn("bullets", F.array_join("bullets", "|"))


@query("paginated_bullets_w17")
def paginated_bullets(spark, sf_dir):
    return M.paginated_bullets(M.slides(markdown_documents(spark, sf_dir))).withColumn("bullets", F.array_join("bullets", "|"))


@query(
    "paginated_tables_w17",
    f"""WITH {_SLIDES}, x AS (SELECT c.*, slide_no, title FROM cells c JOIN slides s ON s.doc_id = c.doc_id AND s.table_block = c.block_no),
parts AS (SELECT doc_id, block_no, unnest(range(0, n + 1)) AS part FROM (SELECT doc_id, block_no, CAST(greatest(0, (max(row_no) - 1) // 8) AS BIGINT) AS n FROM cells GROUP BY doc_id, block_no))
SELECT doc_id, slide_no, part, CASE WHEN part > 0 THEN title || ' (cont.)' ELSE title END AS title, row_no, col_no, text
FROM x JOIN parts USING (doc_id, block_no) WHERE row_no = 0 OR (row_no - 1) // 8 = part""",
)
def paginated_tables(spark, sf_dir):
    docs = markdown_documents(spark, sf_dir)
    return M.paginated_tables(M.slides(docs), M.cells(docs))


_MARKS = 100  # a limit that some of the documents pass


def bounded_documents(spark, sf_dir):
    """Markdown with lines nested deep and paragraphs full of stray marks, in and out of fences."""
    d = F.col("doc_id")
    deep = F.repeat(F.lit("> "), (d % 30).cast("int"))
    stars = F.repeat(F.lit("*"), (d % 7 * 30).cast("int"))
    return markdown_documents(spark, sf_dir).select(
        "doc_id",
        F.concat(
            F.lit("```\n"), deep, stars, F.lit("\n~~~\n```\n"), deep, F.lit("quoted\n\n"), stars, F.lit(" x\n"), stars,
            F.lit("\n\n"), F.replace("text", F.lit("*"), F.lit("")),
        ).alias("text"),
    )


@query(
    "markdown_bounds_v5",
    """SELECT doc_id, 'nesting' AS rule, 5 AS line_no FROM documents WHERE doc_id % 30 > 20
UNION ALL SELECT doc_id, 'emphasis', NULL FROM documents WHERE doc_id % 7 * 60 > 100""",
)
def markdown_bounds(spark, sf_dir):
    bounds = bounded_documents(spark, sf_dir).select("doc_id", MF.markdown_bounds(F.col("text"), max_delimiters=_MARKS).alias("b"))
    rows = F.concat(
        F.transform("b.nested", lambda n: F.struct(F.lit("nesting").alias("rule"), n.alias("line_no"))),
        F.when(F.col("b.delimiters") > _MARKS, F.array(F.struct(F.lit("emphasis").alias("rule"), F.lit(None).cast("int").alias("line_no"))))
        .otherwise(F.array()),
    )
    return bounds.select("doc_id", F.inline(rows))
