"""Page-level accounting of document text, and the comparison of two readers.

Pages are (doc_id, page_no, text, error) with exactly one of the last two set.
A document's text starts as one value and ends as one, so what is gathered per
document here (page numbers, its assembled text) is bounded by one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.functions import pages as P
from sparkdesk.functions.text import is_readable
from sparkdesk.plans.blocked import order_statistic

MAX_OCR_PAGES = 20


def align_readers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer join of two readers' pages."""
    left = a.select("doc_id", "page_no", F.col("text").alias("a_text"), F.col("error").alias("a_error"), F.lit(True).alias("in_a"))
    right = b.select("doc_id", "page_no", F.col("text").alias("b_text"), F.col("error").alias("b_error"), F.lit(True).alias("in_b"))
    return left.join(right, ["doc_id", "page_no"], "full_outer").withColumns(
        {"in_a": F.coalesce("in_a", F.lit(False)), "in_b": F.coalesce("in_b", F.lit(False))}
    )


def categorised(aligned: DataFrame) -> DataFrame:
    """(doc_id, page_no, in_a, in_b, category), category null where a reader
    lacks the page. Each text is split once, before it is compared."""
    both = F.col("in_a") & F.col("in_b")
    a, b = (F.coalesce(c, F.lit("")) for c in ("a_text", "b_text"))
    return aligned.select(
        "doc_id", "page_no", "in_a", "in_b", "b_error",
        is_readable(a).alias("a_readable"), P.words(a).alias("a_words"),
        is_readable(b).alias("b_readable"), P.words(b).alias("b_words"),
    ).select(
        "doc_id", "page_no", "in_a", "in_b",
        F.when(both, P.page_category(
            F.col("a_readable"), F.col("a_words"), F.col("b_readable"), F.col("b_words"), F.col("b_error")
        )).alias("category"),
    )


def page_categories(aligned: DataFrame) -> DataFrame:
    return categorised(aligned.where("in_a AND in_b")).select("doc_id", "page_no", "category")


def compared_documents(aligned: DataFrame, document_errors: DataFrame) -> DataFrame:
    """Uncertain pages per document: (doc_id, pages, reasons, inconclusive).

    A document that a reader failed on, or whose page counts differ, is
    inconclusive, which is never the same as clean.
    """
    uncertain = F.when(F.col("category").isin(P.UNCERTAIN), F.col("category"))
    failed = document_errors.select("doc_id").distinct().withColumn("failed", F.lit(True))
    return (
        categorised(aligned).withColumn("__why", uncertain)
        .groupBy("doc_id")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("__why").isNotNull(), F.col("page_no")))).alias("pages"),
            F.array_sort(F.collect_set("__why")).alias("reasons"),
            (F.count_if("in_a") != F.count_if("in_b")).alias("mismatch"),
        )
        .join(failed, "doc_id", "left")
        .withColumn("inconclusive", F.col("mismatch") | F.coalesce("failed", F.lit(False)))
        .select(
            "doc_id",
            F.when(F.col("inconclusive"), "").otherwise(P.joined(F.col("pages"))).alias("pages"),
            F.when(F.col("inconclusive"), "").otherwise(P.joined(F.col("reasons"))).alias("reasons"),
            "mismatch", "inconclusive",
        )
    )


def category_counts(aligned: DataFrame, document_errors: DataFrame, group: Column) -> DataFrame:
    """Page categories of completed comparisons per group of documents, and how
    many documents were attempted, failed to open, or differ in page count."""
    failed = document_errors.select("doc_id").distinct().withColumn("failed", F.lit(True))
    one = lambda c: F.when(c, 1).otherwise(0)
    per_doc = (
        categorised(aligned).groupBy("doc_id")
        .agg(
            *[F.count_if(F.col("category") == c).alias(c) for c in P.CATEGORIES],
            (F.count_if("in_a") != F.count_if("in_b")).alias("mismatch"),
        )
        .join(failed, "doc_id", "left")
        .withColumn("failed", F.coalesce("failed", F.lit(False)))
    )
    compared = ~F.col("failed") & ~F.col("mismatch")
    return per_doc.groupBy(group.alias("grp")).agg(
        F.count(F.lit(1)).alias("attempted"),
        F.sum(one(F.col("failed"))).alias("document_errors"),
        F.sum(one(F.col("mismatch") & ~F.col("failed"))).alias("page_count_mismatches"),
        *[F.sum(F.when(compared, F.col(c)).otherwise(0)).alias(c) for c in P.CATEGORIES],
    )


OUTCOMES = ["timeout", "process_error", "protocol_error", "refused", "partial_warning", "scan_ocr", "digital_without_warning"]
SUCCESSFUL = ["partial_warning", "scan_ocr", "digital_without_warning"]


def outcome_summary(results: DataFrame, *by: str) -> DataFrame:
    """Outcome counts; the warning fraction is over successful documents only
    and null where there are none."""
    good = F.count_if(F.col("outcome").isin(SUCCESSFUL))
    partial = F.count_if(F.col("outcome") == "partial_warning")
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("attempted"),
        good.alias("successful"),
        (F.count(F.lit(1)) - good).alias("failed"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        F.try_divide(partial, good).alias("partial_fraction"),
    )


def corpus_table(results: DataFrame) -> DataFrame:
    """Documents, pages and outcomes per group, with a row of totals (null group)."""
    per_group = results.groupBy("grp").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("pages").alias("pages"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in SUCCESSFUL],
    )
    return per_group.rollup("grp").agg(
        *[F.sum(c).alias(c) for c in ["documents", "pages", *SUCCESSFUL]]
    )


def rule_quality(documents: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Each flagging rule against the review: (rule, caught, omissions,
    false_positives, clean, precision, recall, flagged, share_flagged).

    ``documents`` has a ``verdict``; unreviewed ones count only in the share.
    """
    bad = F.col("verdict") == "material_omission"
    clean = F.col("verdict") == "no_material_omission_found"
    entries = F.array(*[F.struct(F.lit(n).alias("rule"), c.alias("flag")) for n, c in rules.items()])
    return (
        documents.select("verdict", F.inline(entries))
        .groupBy("rule")
        .agg(
            F.count_if(F.col("flag") & bad).alias("caught"),
            F.count_if(bad).alias("omissions"),
            F.count_if(F.col("flag") & clean).alias("false_positives"),
            F.count_if(clean).alias("clean"),
            F.count_if("flag").alias("flagged"),
            F.count(F.lit(1)).alias("documents"),
        )
        .withColumn("precision", F.try_divide("caught", F.col("caught") + F.col("false_positives")))
        .withColumn("recall", F.try_divide("caught", F.col("omissions")))
        .withColumn("share_flagged", F.try_divide("flagged", F.col("documents")))
    )


def reader_timing(runs: DataFrame, bucket_ms: float = 64.0) -> DataFrame:
    """Median of each reader's time (the middle of the sorted values, not an
    interpolation) and the largest extra time: (reader, n, median_ms, max_ms)."""
    long = runs.select(F.inline(F.array(
        F.struct(F.lit("current").alias("reader"), F.col("current_ms").alias("ms")),
        F.struct(F.lit("extra").alias("reader"), F.col("extra_ms").alias("ms")),
    )))
    return order_statistic(long, ["reader"], "ms", F.floor(F.col("n") / 2), bucket_ms, "median_ms").withColumnRenamed("largest", "max_ms")


def overlay_recognised(pages: DataFrame, recognised: DataFrame) -> DataFrame:
    """Put recognised text on unread pages, and the recogniser's reason where it
    failed; only in documents that have some digital text. Adds ``recognised``."""
    readable = pages.where("text IS NOT NULL").select("doc_id").distinct()
    usable = recognised.join(readable, "doc_id", "left_semi").select(
        "doc_id", "page_no", F.col("text").alias("r_text"), F.col("error").alias("r_error"), F.lit(True).alias("tried")
    )
    tried = F.coalesce("tried", F.lit(False)) & F.col("text").isNull()
    return pages.join(usable, ["doc_id", "page_no"], "left").select(
        *[c for c in pages.columns if c not in ("text", "error")],
        F.when(tried, F.col("r_text")).otherwise(F.col("text")).alias("text"),
        F.when(tried, F.col("r_error")).otherwise(F.col("error")).alias("error"),
        (tried & F.col("r_text").isNotNull()).alias("recognised"),
    )


def assemble(pages: DataFrame, graphics: DataFrame) -> DataFrame:
    """Document text from its pages: (doc_id, text, partial).

    Where a page was unread or recognised, or graphics may hide content, the
    text opens with a warning that names those pages and every page is
    labelled. A document without any text has none.
    """
    docs = (
        pages.groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(F.struct("page_no", "text", "error", "recognised"))).alias("p"))
        .where(F.exists("p", lambda x: x["text"].isNotNull()))
        .join(graphics.select("doc_id", "graphics"), "doc_id", "left")
    )

    def numbers(keep) -> Column:
        return P.joined(F.transform(F.filter("p", keep), lambda x: x["page_no"]))

    missing, read = numbers(lambda x: x["text"].isNull()), numbers(lambda x: x["recognised"])
    partial = F.coalesce("graphics", F.lit(False)) | (missing != "") | (read != "")
    warning = F.concat(
        F.when(read == "", P.PREAMBLE).otherwise(P.PREAMBLE_RECOGNISED),
        F.when(read != "", F.concat(F.lit(" Pages read from a picture: "), read, F.lit("."))).otherwise(""),
        F.when(missing != "", F.concat(F.lit(" Pages without readable digital text: "), missing, F.lit("."))).otherwise(""),
        F.lit(" Do not treat this as the complete document.]\n\n"),
    )

    def label(x: Column) -> Column:
        at = F.concat(F.lit("[Page "), x["page_no"].cast("string"))
        return (
            F.when(x["text"].isNull(), F.concat(at, F.lit("] could not be read: "), x["error"], F.lit(".")))
            .when(~F.col("partial"), x["text"])
            .when(x["recognised"], F.concat(at, F.lit(", read from a picture]\n"), x["text"]))
            .otherwise(F.concat(at, F.lit("]\n"), x["text"]))
        )

    return docs.withColumn("partial", partial).select(
        "doc_id",
        F.concat(F.when(F.col("partial"), warning).otherwise(""), F.array_join(F.transform("p", label), "\n\n")).alias("text"),
        "partial",
    )


_LABEL = r"(?m)^\[Page ([0-9]+)(?:, read from a picture)?\]"


def unaccounted_pages(pages: DataFrame, assembled: DataFrame) -> DataFrame:
    """Pages of labelled documents that the text does not name exactly once: (doc_id, page_no, named)."""
    numbers = F.regexp_extract_all("text", F.lit(_LABEL), F.lit(1)).cast("array<bigint>")
    # names and pages meet in one aggregate: a page has ``here``, a label in the text counts
    labels = assembled.where("partial").select("doc_id", F.explode(numbers).alias("page_no"), F.lit(1).alias("one"), F.lit(False).alias("here"))
    shown = assembled.where("partial").select("doc_id")
    own = pages.join(shown, "doc_id", "left_semi").select("doc_id", "page_no", F.lit(0).alias("one"), F.lit(True).alias("here"))
    return (
        own.unionByName(labels).groupBy("doc_id", "page_no").agg(F.sum("one").alias("named"), F.bool_or("here").alias("here"))
        .where("here AND named <> 1").select("doc_id", "page_no", "named")
    )


def failure_runs(pages: DataFrame) -> DataFrame:
    """Runs of consecutive pages that failed for the same reason:
    (doc_id, first_page, last_page, error, said)."""
    failed = pages.where("error IS NOT NULL").select("doc_id", "page_no", "error")
    w = Window.partitionBy("doc_id", "error").orderBy("page_no")
    runs = failed.withColumn("__island", F.col("page_no") - F.row_number().over(w)).groupBy("doc_id", "error", "__island").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")
    )
    first, last = F.col("first_page").cast("string"), F.col("last_page").cast("string")
    span = F.col("last_page") - F.col("first_page")
    where = (
        F.when(span == 0, F.concat(F.lit("page "), first))
        .when(span == 1, F.concat(F.lit("pages "), first, F.lit(" and "), last))
        .otherwise(F.concat(F.lit("pages "), first, F.lit("–"), last))
    )
    return runs.select("doc_id", "first_page", "last_page", "error", F.concat(where, F.lit(": "), F.col("error")).alias("said"))


def recognition_plan(unread: DataFrame, budget: int = MAX_OCR_PAGES) -> DataFrame:
    """The first ``budget`` unread pages of each document, and how many there
    are. The rank limit applies before the shuffle, so a long document sends
    no more than the budget from any partition."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    chosen = unread.select("doc_id", "page_no").withColumn("rank", rank).where(F.col("rank") <= budget)
    totals = unread.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    note = F.when(
        F.col("total") > budget,
        F.concat(F.lit(f"first {budget} of "), F.col("total").cast("string")),
    )
    return chosen.drop("rank").join(totals, "doc_id").withColumn("note", note)


def page_pictures(images: DataFrame) -> DataFrame:
    """Which picture is the page: the largest, refused where another exceeds a
    quarter of it. Only the two largest matter, and the rank limit keeps two
    per page and partition before the shuffle."""
    area = F.col("width") * F.col("height")
    w = Window.partitionBy("page_id").orderBy(F.desc("area"), F.desc("image_id"))
    top = images.withColumn("area", area).withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    best = F.max(F.when(F.col("rank") == 1, F.struct("image_id", "area")))
    rival = F.max(F.when(F.col("rank") == 2, F.col("area")))
    return top.groupBy("page_id").agg(best.alias("best"), rival.alias("rival")).select(
        "page_id",
        F.when(F.coalesce(F.col("rival") * 4 > F.col("best.area"), F.lit(False)), None)
        .otherwise(F.col("best.image_id")).alias("image_id"),
        F.coalesce(F.col("rival") * 4 > F.col("best.area"), F.lit(False)).alias("refused"),
    )


def warning_kinds(pages: DataFrame, graphics: DataFrame) -> DataFrame:
    """Why each document carries a warning, unread pages before recognised
    pages before graphics: (doc_id, kind), kind null without a warning."""
    flags = pages.groupBy("doc_id").agg(
        F.bool_or(F.col("text").isNull()).alias("unread"), F.bool_or("recognised").alias("recognised")
    )
    return flags.join(graphics, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("unread"), "unread pages").when(F.col("recognised"), "recognised pages")
        .when(F.coalesce("graphics", F.lit(False)), "graphics only").alias("kind"),
    )


def word_set_differences(aligned: DataFrame) -> DataFrame:
    """Pages whose word sets differ, in compatibility form and without case, with the words either side lacks.

    Equal texts have equal words, so only pages whose texts differ are folded;
    the words are in a generator, so that they are found once and not again to
    tell whether any is left.
    """
    a_text, b_text = (F.coalesce(c, F.lit("")) for c in ("a_text", "b_text"))
    lacking = F.transform(
        F.array(F.struct(P.token_set(F.col("__a")).alias("a"), P.token_set(F.col("__b")).alias("b"))),
        lambda w: F.struct(*(
            F.array_join(F.array_sort(F.array_except(w[x], w[y])), " ").alias(f"only_{x}") for x, y in (("a", "b"), ("b", "a"))
        )),
    )
    return (
        aligned.where(a_text != b_text)
        .withColumns({"__a": P.folded(F.col("a_text")), "__b": P.folded(F.col("b_text"))})
        .select("doc_id", "page_no", F.inline(F.filter(lacking, lambda d: (d["only_a"] != "") | (d["only_b"] != ""))))
    )


def completed_in_both(first: DataFrame, second: DataFrame) -> DataFrame:
    """Documents completed in both runs and whether their output is identical."""
    done = second.where("completed").select("doc_id", F.col("digest").alias("other"))
    return first.where("completed").join(done, "doc_id").select("doc_id", F.col("digest").eqNullSafe(F.col("other")).alias("identical"))


def stable_sample(paths: DataFrame, salt: str, n: int) -> DataFrame:
    """The ``n`` paths with the smallest SHA-256 of salt and path."""
    return (
        paths.withColumn("digest", F.sha2(F.concat(F.lit(salt), F.col("path")), 256)).orderBy("digest", "path").limit(n)
    )
