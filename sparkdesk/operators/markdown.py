"""Markdown as tables: blocks, cells, columns, list runs, slides.

Everything is ordered within one document, whose text is one value, so the
windows here are partitioned by ``doc_id`` and share one shuffle of its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.functions import markdown as M
from sparkdesk.functions.text import display_width, flatten_inline, trimmed

LINES_PER_SLIDE = 10
CHARS_PER_LINE = 60
ROWS_PER_SLIDE = 8
SPAN = 256
PADDING, MIN_WIDTH, MAX_WIDTH = 2, 9, 60


def lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) with the line trimmed."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")).select(
        "doc_id", "line_no", trimmed(F.col("raw")).alias("line")
    )


def placed_lines(documents: DataFrame) -> DataFrame:
    """Lines with their kind and block: (doc_id, block_no, line_no, kind, line, header).

    A table starts at the first plain line with a pipe that has a delimiter row
    below it, and takes every line that has a pipe from there on, whatever else
    it would be. So a line is in a table when the last line that could start
    one came after the last line without a pipe.
    """
    w = Window.partitionBy("doc_id").orderBy("line_no")
    piped = F.contains("line", F.lit("|"))
    kind = F.col("kind")
    return (
        lines(documents)
        .withColumns({"kind": M.plain_kind(F.col("line")), "piped": piped, "rule_row": M.is_delimiter_row(F.col("line"))})
        .withColumn("opens", (kind == "para") & F.col("piped") & F.coalesce(F.lead("rule_row").over(w), F.lit(False)))
        .withColumns({
            "last_open": F.coalesce(F.max(F.when(F.col("opens"), F.col("line_no"))).over(w), F.lit(-1)),
            "last_plain": F.coalesce(F.max(F.when(~F.col("piped"), F.col("line_no"))).over(w), F.lit(-1)),
        })
        .withColumn("in_table", F.col("last_open") > F.col("last_plain"))
        .withColumn("header", F.col("in_table") & ~F.coalesce(F.lag("in_table").over(w), F.lit(False)))
        .withColumn(
            "kind",
            F.when(F.coalesce(F.lag("header").over(w), F.lit(False)) & F.col("in_table"), "delimiter")
            .when(F.col("in_table"), "table").otherwise(kind),
        )
        .withColumn("before", F.coalesce(F.lag("kind").over(w), F.lit("blank")))
        .withColumn(
            "starts",
            F.when(kind.isin("rule", "heading", "bullet", "numbered"), True)
            .when(kind == "table", F.col("header"))
            .when(kind.isin("para", "quote"), F.col("before") != kind)
            .otherwise(False),
        )
        .withColumn("block_no", F.sum(F.col("starts").cast("long")).over(w) - 1)
        .where(~kind.isin("blank", "quote break", "delimiter"))
        .select("doc_id", "block_no", "line_no", "kind", "line", "header")
    )


def blocks(documents: DataFrame) -> DataFrame:
    """(doc_id, block_no, kind, level, ordinal, text); a table's text is in its cells."""
    kind, line = F.col("kind"), F.col("line")
    piece = F.when(~kind.isin("table", "rule"), M.line_text(kind, line))
    return (
        placed_lines(documents)
        .withColumn("piece", piece)
        .groupBy("doc_id", "block_no", "kind")
        .agg(
            F.max(F.when(kind == "heading", F.length(F.regexp_extract("line", "^(#+)", 1)))).cast("long").alias("level"),
            F.max(F.when(kind == "numbered", F.regexp_extract("line", "^([0-9]+)", 1).try_cast("long"))).alias("ordinal"),
            F.expr("listagg(piece, ' ') WITHIN GROUP (ORDER BY line_no)").alias("text"),
        )
        .withColumn("text", flatten_inline(F.col("text")))
    )


def cells(documents: DataFrame) -> DataFrame:
    """(doc_id, block_no, row_no, col_no, text) of every table, the header being row 0."""
    rows = placed_lines(documents).where("kind = 'table'")
    w = Window.partitionBy("doc_id", "block_no").orderBy("line_no")
    return (
        rows.withColumn("row_no", F.row_number().over(w).cast("long") - 1)
        .select("doc_id", "block_no", "row_no", F.posexplode(M.cells(F.col("line"))).alias("col_no", "cell"))
        .select("doc_id", "block_no", "row_no", F.col("col_no").cast("long").alias("col_no"), flatten_inline(F.col("cell")).alias("text"))
    )


def sheet_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, row_no, col_no, text): the first table of a document, else its
    lines as delimited text, a tab anywhere winning over commas."""
    tables = cells(documents)
    first = Window.partitionBy("doc_id")
    from_table = (
        tables.withColumn("first_block", F.min("block_no").over(first)).where("block_no = first_block")
        .select("doc_id", "row_no", "col_no", "text")
    )
    without = documents.join(from_table.select("doc_id").distinct(), "doc_id", "left_anti")
    delimiter = F.when(F.contains("text", F.lit("\t")), "\t").otherwise(",")
    kept = F.filter(F.split("text", "\n"), lambda s: trimmed(s) != "")
    delimited = (
        without.select("doc_id", delimiter.alias("delimiter"), F.posexplode(kept).alias("row_no", "line"))
        .select("doc_id", "row_no", F.posexplode(F.split("line", F.col("delimiter"))).alias("col_no", "cell"))
        .select("doc_id", F.col("row_no").cast("long").alias("row_no"), F.col("col_no").cast("long").alias("col_no"), trimmed(F.col("cell")).alias("text"))
    )
    return from_table.unionByName(delimited)


def column_widths(rows: DataFrame) -> DataFrame:
    """(doc_id, col_no, width): the widest value with padding, kept within bounds."""
    widest = F.max(display_width(F.col("text")))
    return rows.groupBy("doc_id", "col_no").agg(
        F.greatest(F.lit(MIN_WIDTH), F.least(F.lit(MAX_WIDTH), widest + PADDING)).cast("long").alias("width")
    )


def list_runs(document_blocks: DataFrame) -> DataFrame:
    """(doc_id, block_no, run, ordinal) of list items. Items of one kind in a
    row are one run; a run counts on from the number its first item carries."""
    w = Window.partitionBy("doc_id").orderBy("block_no")
    item = F.col("kind").isin("bullet", "numbered")
    starts = item & ~F.coalesce(F.lag("kind").over(w) == F.col("kind"), F.lit(False))
    numbered = document_blocks.select("doc_id", "block_no", "kind", "ordinal", starts.alias("starts")).withColumns({
        "run": F.sum(F.col("starts").cast("long")).over(w) - 1,
        # the block and number of the run's first item
        "first": F.max(F.when(F.col("starts"), F.struct("block_no", F.coalesce("ordinal", F.lit(1).cast("long")).alias("start")))).over(w),
    })
    # a run is consecutive blocks, so the distance from its first is the position
    return numbered.where(item).select(
        "doc_id", "block_no", "run", (F.col("first.start") + F.col("block_no") - F.col("first.block_no")).alias("ordinal")
    )


def heading_styles(headings: DataFrame, templates: DataFrame) -> DataFrame:
    """The style for each heading (doc_id, block_no, level, template_id): the
    wanted level, at most 3, or the nearest shallower one its template defines;
    null where it defines none. Without a template every level is defined."""
    wanted = F.greatest(F.lit(1), F.least(F.lit(3), F.col("level")))
    defined = templates.select(F.col("template_id").alias("t"), F.col("level").alias("has"))
    return (
        headings.withColumn("wanted", wanted)
        .join(defined, (F.col("template_id") == F.col("t")) & (F.col("has") <= F.col("wanted")), "left")
        .groupBy("doc_id", "block_no", "wanted", "template_id")
        .agg(F.max("has").alias("has"))
        .select("doc_id", "block_no", F.concat(
            F.lit("Heading"), F.when(F.col("template_id").isNull(), F.col("wanted")).otherwise(F.col("has")).cast("string")
        ).alias("style"))
    )


def slides(documents: DataFrame) -> DataFrame:
    """(doc_id, slide_no, title, bullets, table_block).

    The shallowest heading level used more than once, else the shallowest used,
    starts a slide. What comes before any slide titles the first one. A table
    fills a slide that only has its title, else it gets one with the same title.
    """
    doc = Window.partitionBy("doc_id")
    w = doc.orderBy("block_no")
    used = [F.count_if(F.col("level") == n).over(doc) for n in range(1, 7)]
    top = F.coalesce(
        *[F.when(u > 1, n) for n, u in enumerate(used, 1)], *[F.when(u > 0, n) for n, u in enumerate(used, 1)], F.lit(1)
    )
    text = F.when(F.col("kind") == "numbered", F.concat_ws(". ", F.col("ordinal").cast("string"), "text")).otherwise(F.col("text"))
    filled = (
        cells(documents).groupBy("doc_id", "block_no").agg(F.bool_or(trimmed(F.col("text")) != "").alias("filled")).where("filled")
    )
    said = (
        blocks(documents).where("kind <> 'rule'")
        .join(filled, ["doc_id", "block_no"], "left")
        .where("(kind = 'table' AND filled) OR (kind <> 'table' AND (text <> '' OR kind = 'heading'))")
        .withColumns({"line": text, "top": top})
    )
    table = F.col("kind") == "table"
    first = F.row_number().over(w) == 1
    return (
        said.withColumn("opener", ((F.col("kind") == "heading") & (F.col("level") == F.col("top"))) | (first & ~table))
        .withColumn("starts", F.col("opener") | (table & ~F.coalesce(F.lag("opener").over(w), F.lit(False))))
        .withColumns({
            "slide_no": F.sum(F.col("starts").cast("long")).over(w) - 1,
            "title": F.coalesce(F.max(F.when(F.col("opener"), F.struct("block_no", "line"))).over(w)["line"], F.lit("")),
        })
        .groupBy("doc_id", "slide_no", "title")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.when(~F.col("opener") & ~table, F.struct("block_no", "line")))), lambda x: x["line"]
            ).alias("bullets"),
            F.max(F.when(table, F.col("block_no"))).alias("table_block"),
        )
    )


def paginated_bullets(
    deck: DataFrame, per_slide: int = LINES_PER_SLIDE, per_line: int = CHARS_PER_LINE, span: int = SPAN
) -> DataFrame:
    """(doc_id, slide_no, part, title, bullets): slides without a table, cut so
    that each part fits; a title with nothing under it is still a slide.

    Whether a piece goes on the next part depends on what filled this one, so a
    slide's pieces are walked in order. They are walked twice in blocks of
    ``span``: once for the state in which each block is entered, carrying two
    numbers, then inside each block for the part of every piece. So no array
    grows beyond a block or the number of blocks. (doc_id, slide_no) is unique.
    """
    zero = F.lit(0).cast("long")

    def state(part: Column, filled: Column) -> Column:
        return F.struct(part.alias("part"), filled.alias("filled"))

    def place(at: Column, piece: Column) -> Column:
        over = (at["filled"] > 0) & (at["filled"] + piece["cost"] > per_slide)
        return state(at["part"] + over.cast("long"), F.when(over, zero).otherwise(at["filled"]) + piece["cost"])

    def passed(steps: Column, start: Column, step) -> Column:
        """The state before each step, and the last one."""
        return F.aggregate(steps, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    pieces = F.flatten(F.transform("bullets", lambda b: M.split_long(b, per_slide * per_line)))
    sized = F.transform(pieces, lambda p: F.struct(
        p.alias("text"), F.greatest(F.lit(1), F.ceil(display_width(p) / per_line)).cast("long").alias("cost")))
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("pieces") - 1) / span).cast("int")))
    entries = passed(F.col("blocks"), state(zero, zero), lambda at, block: F.aggregate(block, at, place))
    walked = (
        deck.where("table_block IS NULL").select("doc_id", "slide_no", "title", sized.alias("pieces"))
        .select("doc_id", "slide_no", "title", F.transform(numbers, lambda i: F.slice("pieces", i * span + 1, span)).alias("blocks"))
        .select("doc_id", "slide_no", "title", F.posexplode(F.arrays_zip(
            "blocks", F.slice(entries, F.lit(1), F.size("blocks")).alias("entry"))).alias("block", "b"))
    )
    parts = F.transform(F.slice(passed(F.col("b.blocks"), F.col("b.entry"), place), 2, span), lambda at: at["part"])
    placed = walked.select("doc_id", "slide_no", "title", "block", F.posexplode_outer(F.arrays_zip(
        F.transform("b.blocks", lambda p: p["text"]).alias("text"), parts.alias("part"))).alias("no", "p"))
    return (
        placed.groupBy("doc_id", "slide_no", F.coalesce("p.part", zero).alias("part"))
        .agg(
            F.any_value("title").alias("title"),
            F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("block", "no", "p.text")))).alias("own"),
        )
        .select(
            "doc_id", "slide_no", "part",
            F.when(F.col("part") > 0, F.concat("title", F.lit(" (cont.)"))).otherwise(F.col("title")).alias("title"),
            F.transform("own", lambda x: x["text"]).alias("bullets"),
        )
    )


def paginated_tables(deck: DataFrame, table_cells: DataFrame, per_slide: int = ROWS_PER_SLIDE) -> DataFrame:
    """(doc_id, slide_no, part, title, row_no, col_no, text): slides with a
    table, cut by rows, the header (row 0) repeated on every part."""
    shown = deck.where("table_block IS NOT NULL").select("doc_id", F.col("table_block").alias("block_no"), "slide_no", "title")
    body = table_cells.join(shown, ["doc_id", "block_no"])
    part = F.floor((F.col("row_no") - 1) / per_slide).cast("long")
    last = F.greatest(F.lit(0).cast("long"), F.floor((F.max("row_no") - 1) / per_slide).cast("long"))
    parts = table_cells.groupBy("doc_id", "block_no").agg(last.alias("last"))
    header = body.where("row_no = 0").join(parts, ["doc_id", "block_no"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last")))
    ).drop("last")
    title = F.when(F.col("part") > 0, F.concat("title", F.lit(" (cont.)"))).otherwise(F.col("title"))
    return header.unionByName(body.where("row_no > 0").withColumn("part", part)).select(
        "doc_id", "slide_no", "part", title.alias("title"), "row_no", "col_no", "text"
    )
