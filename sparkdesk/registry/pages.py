"""Queries over page-level document text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdesk.functions import pages as P, text as X
from sparkdesk.functions.classes import UNREADABLE, WHITE
from sparkdesk.operators import pages as G
from sparkdesk.plans.derive import DUCK_LINES, document_lines, run
from sparkdesk.registry.core import query, table
from sparkdesk.registry.text import TRIM

_NO_TEXT, _NOT_EXTRACTED = "no digital text was found", "could not be extracted"

# one text line is one page; every eleventh page is an error, as is an unreadable one
DUCK_PAGES = f"""SELECT doc_id, page_no, element, CASE WHEN bad THEN NULL ELSE trim(element, {TRIM}) END AS text,
 CASE WHEN bad THEN CASE WHEN page_no % 2 = 0 THEN '{_NO_TEXT}' ELSE '{_NOT_EXTRACTED}' END END AS error
 FROM (SELECT *, (doc_id + page_no) % 11 = 0 OR NOT regexp_matches(element, '[^{UNREADABLE}]') AS bad FROM ({DUCK_LINES}))"""


def page_outcomes(spark, sf_dir):
    bad = ((F.col("doc_id") + F.col("page_no")) % 11 == 0) | ~X.is_readable(F.col("element"))
    reason = F.when(F.col("page_no") % 2 == 0, _NO_TEXT).otherwise(_NOT_EXTRACTED)
    return document_lines(spark, sf_dir).select(
        "doc_id", "page_no", "element", F.when(~bad, X.trimmed(F.col("element"))).alias("text"), F.when(bad, reason).alias("error")
    )


_MIX = "(doc_id + 2 * page_no) % 13"
DUCK_B = f"""SELECT doc_id, page_no, CASE WHEN {_MIX} = 3 THEN NULL WHEN text IS NULL THEN CASE WHEN page_no % 2 = 0 THEN '' ELSE element END
 ELSE CASE {_MIX} WHEN 0 THEN array_to_string(list_reverse(string_split(text, ' ')), ' ') WHEN 1 THEN replace(text, ' ', '')
 WHEN 2 THEN regexp_replace(text, ' [^ ]*$', '') WHEN 4 THEN '' ELSE text END END AS text,
 CASE WHEN {_MIX} = 3 THEN 'reader failed' END AS error
FROM p WHERE doc_id % 29 > 0 OR page_no < (SELECT max(page_no) FROM p q WHERE q.doc_id = p.doc_id)"""


def second_reader(pages):
    """The other reader's pages: reordered, joined, shortened, failed or blank
    by page, and without the last page of every 29th document."""
    k, t = (F.col("doc_id") + 2 * F.col("page_no")) % 13, F.col("text")
    text = (
        F.when(k == 3, None)
        .when(t.isNull(), F.when(F.col("page_no") % 2 == 0, "").otherwise(F.col("element")))
        .when(k == 0, F.array_join(F.reverse(F.split("text", " ")), " "))
        .when(k == 1, F.replace(t, F.lit(" "), F.lit("")))
        .when(k == 2, F.regexp_replace(t, " [^ ]*$", ""))
        .when(k == 4, "")
        .otherwise(t)
    )
    last = pages.where("doc_id % 29 = 0").groupBy("doc_id").agg(F.max("page_no").alias("page_no"))
    return (
        pages.join(last, ["doc_id", "page_no"], "left_anti")
        .select("doc_id", "page_no", text.alias("text"), F.when(k == 3, "reader failed").alias("error"))
    )


def readers(spark, sf_dir):
    pages = page_outcomes(spark, sf_dir)
    return G.align_readers(pages, second_reader(pages))


def document_errors(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 31 = 0").select("doc_id")


def _duck_words(c):
    return f"CASE WHEN trim({c}, {TRIM}) = '' THEN [] ELSE string_split_regex(trim({c}, {TRIM}), '[{WHITE}]+') END"


_ALIGNED = f"""WITH p AS ({DUCK_PAGES}), b AS ({DUCK_B}),
j AS (SELECT coalesce(p.doc_id, b.doc_id) AS doc_id, coalesce(p.page_no, b.page_no) AS page_no, p.text AS a_text, b.text AS b_text, b.error AS b_error,
  p.doc_id IS NOT NULL AS in_a, b.doc_id IS NOT NULL AS in_b FROM p FULL JOIN b ON p.doc_id = b.doc_id AND p.page_no = b.page_no),
w AS (SELECT *, regexp_matches(coalesce(a_text, ''), '[^{UNREADABLE}]') AS ra, regexp_matches(coalesce(b_text, ''), '[^{UNREADABLE}]') AS rb,
  {_duck_words("coalesce(a_text, '')")} AS wa, {_duck_words("coalesce(b_text, '')")} AS wb FROM j),
cat AS (SELECT doc_id, page_no, in_a, in_b, CASE WHEN NOT (in_a AND in_b) THEN NULL WHEN b_error IS NOT NULL THEN 'native_page_error'
  WHEN NOT ra AND NOT rb THEN 'neither_readable' WHEN NOT ra THEN 'native_only_readable' WHEN NOT rb THEN 'current_only_readable'
  WHEN wa = wb THEN 'same_words_in_order' WHEN list_sort(wa) = list_sort(wb) THEN 'same_words_reordered'
  WHEN array_to_string(wa, '') = array_to_string(wb, '') THEN 'spacing_only' ELSE 'other_difference' END AS category FROM w),
docs AS (SELECT doc_id, count(*) FILTER (in_a) <> count(*) FILTER (in_b) AS mismatch, doc_id % 31 = 0 AS failed FROM cat GROUP BY doc_id)
"""


@query("aligned_pages_j5", _ALIGNED + "SELECT doc_id, page_no, in_a, in_b FROM j")
def aligned_pages(spark, sf_dir):
    return readers(spark, sf_dir).select("doc_id", "page_no", "in_a", "in_b")


@query("page_categories_k1", _ALIGNED + "SELECT doc_id, page_no, category FROM cat WHERE category IS NOT NULL")
def page_categories(spark, sf_dir):
    return G.page_categories(readers(spark, sf_dir))


_UNCERTAIN = ", ".join(f"'{c}'" for c in P.UNCERTAIN)


@query(
    "uncertain_pages_k2",
    _ALIGNED + f"""SELECT doc_id, CASE WHEN mismatch OR failed THEN '' ELSE coalesce(pages, '') END AS pages,
 CASE WHEN mismatch OR failed THEN '' ELSE coalesce(reasons, '') END AS reasons, mismatch, mismatch OR failed AS inconclusive
FROM docs LEFT JOIN (SELECT doc_id, string_agg(page_no, ', ' ORDER BY page_no) AS pages, string_agg(DISTINCT category, ', ' ORDER BY category) AS reasons
 FROM cat WHERE category IN ({_UNCERTAIN}) GROUP BY doc_id) USING (doc_id)""",
)
def uncertain_pages(spark, sf_dir):
    return G.compared_documents(readers(spark, sf_dir), document_errors(spark, sf_dir))


def _category_counts_sql():
    counts = ", ".join(
        f"count(*) FILTER (category = '{c}' AND NOT failed AND NOT mismatch) AS {c}" for c in P.CATEGORIES
    )
    return _ALIGNED + f"""SELECT d.*, {", ".join(P.CATEGORIES)} FROM
 (SELECT doc_id % 7 AS grp, count(*) AS attempted, count(*) FILTER (failed) AS document_errors, count(*) FILTER (mismatch AND NOT failed) AS page_count_mismatches FROM docs GROUP BY ALL) d
 JOIN (SELECT doc_id % 7 AS grp, {counts} FROM cat JOIN docs USING (doc_id) GROUP BY ALL) c USING (grp)"""


@query("category_counts_a8", _category_counts_sql())
def category_counts(spark, sf_dir):
    return G.category_counts(readers(spark, sf_dir), document_errors(spark, sf_dir), F.col("doc_id") % 7)


@query(
    "word_set_triage_k7",
    _ALIGNED + f"""SELECT * FROM (SELECT doc_id, page_no,
 array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ' ') AS only_a,
 array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ' ') AS only_b
 FROM (SELECT doc_id, page_no, list_distinct({_duck_words("replace(lower(coalesce(a_text, '')), 'ß', 'ss')")}) AS a, list_distinct({_duck_words("replace(lower(coalesce(b_text, '')), 'ß', 'ss')")}) AS b FROM j))
WHERE only_a <> '' OR only_b <> ''""",
)
def word_set_triage(spark, sf_dir):
    return G.word_set_differences(readers(spark, sf_dir))


# --- process outcomes over a corpus -----------------------------------------

_PROCESS = """SELECT doc_id, doc_id % 7 AS grp, text,
 CASE doc_id % 17 WHEN 3 THEN 33 WHEN 4 THEN 1 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 0 END AS status,
 CASE doc_id % 17 WHEN 1 THEN 'SIGKILL' END AS signal, CASE doc_id % 17 WHEN 0 THEN 'ETIMEDOUT' END AS error_code,
 CASE doc_id % 17 WHEN 2 THEN text WHEN 5 THEN concat('PDF-TEXT/1', chr(10), '  ')
  WHEN 6 THEN concat('PDF-TEXT/1', chr(13), chr(10), '[PDF partly read: x.]', chr(10), text) WHEN 7 THEN concat('PDF-TEXT/1', chr(10), '[PDF partly read: x.]', text)
  WHEN 8 THEN concat('PDF-TEXT/1', chr(10), '[This document is a scan.]', text) WHEN 9 THEN concat('PDF-TEXT/1', chr(10), 'quoted: [PDF partly read: x.]', text)
  ELSE concat('PDF-TEXT/1', chr(10), text) END AS stdout FROM documents"""
_OUTCOME = """CASE WHEN k = 0 THEN 'timeout' WHEN k = 1 THEN 'process_error' WHEN k = 2 THEN 'protocol_error' WHEN k = 3 THEN 'refused'
 WHEN k = 4 THEN 'process_error' WHEN k = 5 THEN 'protocol_error' WHEN k IN (6, 7) THEN 'partial_warning' WHEN k = 8 THEN 'scan_ocr'
 ELSE 'digital_without_warning' END"""
_DUCK_OUTCOMES = f"""r AS (SELECT doc_id, doc_id % 7 AS grp, {_OUTCOME} AS outcome, len(string_split(text, chr(10))) AS pages, lang
 FROM (SELECT *, doc_id % 17 AS k FROM documents))"""


def outcomes(spark, sf_dir):
    return run(spark, sf_dir, _PROCESS.replace("FROM documents", ", lang FROM documents"), "documents").select(
        "doc_id", "grp", "lang", F.size(F.split("text", "\n")).cast("long").alias("pages"),
        P.extraction_outcome(F.col("status"), F.col("signal"), F.col("error_code"), F.col("stdout")).alias("outcome"),
    )


@query("extraction_outcomes_k3", f"WITH {_DUCK_OUTCOMES} SELECT doc_id, outcome FROM r")
def extraction_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select("doc_id", "outcome")


_OUTCOME_COUNTS = ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in G.OUTCOMES)
_GOOD = "count(*) FILTER (outcome IN ('partial_warning','scan_ocr','digital_without_warning'))"


@query(
    "outcome_summary_a7",
    f"""WITH {_DUCK_OUTCOMES} SELECT lang, count(*) AS attempted, {_GOOD} AS successful, count(*) - {_GOOD} AS failed, {_OUTCOME_COUNTS},
 round(count(*) FILTER (outcome = 'partial_warning') / nullif({_GOOD}, 0), 6) AS partial_fraction FROM r GROUP BY lang""",
)
def outcome_summary(spark, sf_dir):
    return G.outcome_summary(outcomes(spark, sf_dir), "lang").withColumn("partial_fraction", F.round("partial_fraction", 6))


@query(
    "corpus_table_a9",
    f"""WITH {_DUCK_OUTCOMES} SELECT grp, count(*) AS documents, CAST(sum(pages) AS BIGINT) AS pages,
 count(*) FILTER (outcome = 'partial_warning') AS partial_warning, count(*) FILTER (outcome = 'scan_ocr') AS scan_ocr,
 count(*) FILTER (outcome = 'digital_without_warning') AS digital_without_warning FROM r GROUP BY ROLLUP(grp)""",
)
def corpus_table(spark, sf_dir):
    return G.corpus_table(outcomes(spark, sf_dir))


_VERDICT = """CASE WHEN doc_id % 10 = 0 THEN 'material_omission' WHEN doc_id % 10 < 5 THEN 'no_material_omission_found' ELSE 'unreviewed' END"""


def _rule_quality_sql():
    rows = []
    for name, cond in (
        ("both", "category IN ('neither_readable','other_difference')"),
        ("neither_readable", "category = 'neither_readable'"),
        ("other_difference", "category = 'other_difference'"),
    ):
        rows.append(f"SELECT doc_id, '{name}' AS rule, coalesce(bool_or({cond}), false) AS flag FROM cat GROUP BY doc_id")
    return _ALIGNED + f""", f AS (SELECT *, {_VERDICT} AS verdict FROM ({" UNION ALL ".join(rows)})),
 q AS (SELECT rule, count(*) FILTER (flag AND verdict = 'material_omission') AS caught, count(*) FILTER (verdict = 'material_omission') AS omissions,
 count(*) FILTER (flag AND verdict = 'no_material_omission_found') AS false_positives, count(*) FILTER (verdict = 'no_material_omission_found') AS clean,
 count(*) FILTER (flag) AS flagged, count(*) AS documents FROM f GROUP BY rule)
SELECT *, round(caught / nullif(caught + false_positives, 0), 6) AS precision, round(caught / nullif(omissions, 0), 6) AS recall,
 round(flagged / documents, 6) AS share_flagged FROM q"""


@query("rule_quality_a10", _rule_quality_sql())
def rule_quality(spark, sf_dir):
    docs = (
        G.categorised(readers(spark, sf_dir)).groupBy("doc_id")
        .agg(
            F.coalesce(F.bool_or(F.col("category") == "neither_readable"), F.lit(False)).alias("neither"),
            F.coalesce(F.bool_or(F.col("category") == "other_difference"), F.lit(False)).alias("other"),
        )
        .withColumn("verdict", F.expr(_VERDICT))
    )
    rules = {"neither_readable": F.col("neither"), "other_difference": F.col("other"), "both": F.col("neither") | F.col("other")}
    out = G.rule_quality(docs, rules)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "share_flagged")})


@query(
    "reader_timing_a12",
    """WITH t AS (SELECT 'current' AS reader, n_chars % 500 + 10 AS ms FROM documents UNION ALL SELECT 'extra', n_chars % 77 FROM documents)
SELECT reader, count(*) AS n, list_sort(list(ms))[count(*) // 2 + 1] AS median_ms, max(ms) AS max_ms FROM t GROUP BY reader""",
)
def reader_timing(spark, sf_dir):
    return G.reader_timing(run(
        spark, sf_dir, "SELECT doc_id, n_chars % 500 + 10 AS current_ms, n_chars % 77 AS extra_ms FROM documents", "documents"))


# --- one reader: recognition, assembly, accounting ----------------------------

_FAX = "it uses fax compression"


def recognised_pages(pages):
    return pages.where("error IS NOT NULL AND page_no % 3 = 0").select(
        "doc_id", "page_no",
        F.when(F.col("page_no") % 6 != 0, F.concat(F.lit("seen "), F.col("page_no").cast("string"))).alias("text"),
        F.when(F.col("page_no") % 6 == 0, _FAX).alias("error"),
    )


def overlaid(spark, sf_dir):
    pages = page_outcomes(spark, sf_dir).select("doc_id", "page_no", "text", "error")
    return G.overlay_recognised(pages, recognised_pages(pages))


def graphics(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 == 0).alias("graphics"))


_OVERLAID = f"""WITH p AS ({DUCK_PAGES}), d AS (SELECT doc_id, bool_or(text IS NOT NULL) AS any_text FROM p GROUP BY doc_id),
o AS (SELECT doc_id, page_no, CASE WHEN tried AND page_no % 6 <> 0 THEN concat('seen ', page_no) WHEN tried THEN NULL ELSE text END AS text,
 CASE WHEN tried THEN CASE WHEN page_no % 6 = 0 THEN '{_FAX}' END ELSE error END AS error, tried AND page_no % 6 <> 0 AS recognised
 FROM (SELECT p.*, any_text AND error IS NOT NULL AND page_no % 3 = 0 AS tried FROM p JOIN d USING (doc_id)))"""


@query("recognised_overlay_k6", _OVERLAID + " SELECT * FROM o")
def recognised_overlay(spark, sf_dir):
    return overlaid(spark, sf_dir)


_ASSEMBLED = _OVERLAID + f""", g AS (SELECT doc_id, string_agg(page_no, ', ' ORDER BY page_no) FILTER (text IS NULL) AS missing,
  string_agg(page_no, ', ' ORDER BY page_no) FILTER (recognised) AS seen, doc_id % 3 = 0 AS graphics FROM o GROUP BY doc_id HAVING bool_or(text IS NOT NULL)),
h AS (SELECT *, graphics OR missing IS NOT NULL OR seen IS NOT NULL AS partial FROM g),
body AS (SELECT o.doc_id, string_agg(CASE WHEN text IS NULL THEN concat('[Page ', page_no, '] could not be read: ', error, '.') WHEN NOT partial THEN text
  WHEN recognised THEN concat('[Page ', page_no, ', read from a picture]', chr(10), text) ELSE concat('[Page ', page_no, ']', chr(10), text) END,
  chr(10) || chr(10) ORDER BY page_no) AS body FROM o JOIN h USING (doc_id) GROUP BY o.doc_id),
assembled AS (SELECT doc_id, CASE WHEN NOT partial THEN body ELSE concat(CASE WHEN seen IS NULL THEN '{P.PREAMBLE}' ELSE '{P.PREAMBLE_RECOGNISED}' END,
  CASE WHEN seen IS NOT NULL THEN concat(' Pages read from a picture: ', seen, '.') ELSE '' END,
  CASE WHEN missing IS NOT NULL THEN concat(' Pages without readable digital text: ', missing, '.') ELSE '' END,
  ' Do not treat this as the complete document.]', chr(10), chr(10), body) END AS text, partial FROM h JOIN body USING (doc_id))"""


@query("assembled_documents_a15", _ASSEMBLED + " SELECT * FROM assembled")
def assembled_documents(spark, sf_dir):
    return G.assemble(overlaid(spark, sf_dir), graphics(spark, sf_dir))


@query(
    "warned_pages_p17",
    _OVERLAID + """ SELECT doc_id, coalesce(string_agg(page_no, '|' ORDER BY page_no) FILTER (text IS NULL), '') AS missing,
 coalesce(string_agg(page_no, '|' ORDER BY page_no) FILTER (recognised), '') AS recognised,
 coalesce(string_agg(page_no, '|' ORDER BY page_no) FILTER (text IS NULL), '') AS unreadable
FROM o GROUP BY doc_id HAVING bool_or(text IS NOT NULL)""",
)
def warned_pages(spark, sf_dir):
    docs = assembled_documents(spark, sf_dir)
    scan = F.concat(F.lit(X.SCAN_MARK + ".]\n\n"), F.col("text"))
    join = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return docs.select(
        "doc_id", join(X.missing_pages(F.col("text"))).alias("missing"),
        join(X.recognised_pages(F.col("text"))).alias("recognised"), join(X.unreadable_pages(scan)).alias("unreadable"),
    )


@query(
    "unaccounted_pages_v9",
    _ASSEMBLED + """ SELECT o.doc_id, page_no, CAST(CASE page_no WHEN 2 THEN 0 ELSE 2 END AS BIGINT) AS named
FROM o JOIN assembled USING (doc_id) WHERE partial AND ((o.doc_id % 17 = 0 AND page_no = 2) OR (o.doc_id % 19 = 0 AND page_no = 1))""",
)
def unaccounted_pages(spark, sf_dir):
    """Texts that lost page 2's label, or name page 1 twice."""
    lost = F.regexp_replace("text", r"(?m)^\[Page 2(, read from a picture)?\]", "")
    docs = assembled_documents(spark, sf_dir).withColumn(
        "text", F.when(F.col("doc_id") % 17 == 0, lost).otherwise(F.col("text"))
    ).withColumn("text", F.when(F.col("doc_id") % 19 == 0, F.concat("text", F.lit("\n\n[Page 1]\n"))).otherwise(F.col("text")))
    return G.unaccounted_pages(overlaid(spark, sf_dir), docs)


@query(
    "warning_kinds_k4",
    _OVERLAID + """ SELECT kind, count(*) AS documents FROM (SELECT doc_id, CASE WHEN bool_or(text IS NULL) THEN 'unread pages' WHEN bool_or(recognised) THEN 'recognised pages'
 WHEN doc_id % 3 = 0 THEN 'graphics only' END AS kind FROM o GROUP BY doc_id) GROUP BY kind""",
)
def warning_kinds(spark, sf_dir):
    return G.warning_kinds(overlaid(spark, sf_dir), graphics(spark, sf_dir)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("documents")
    )


_SCANNED = f"""SELECT doc_id, page_no, CASE WHEN doc_id % 5 = 0 AND page_no % 7 < 5 THEN 'no text could be made out' WHEN doc_id % 5 = 0 THEN '{_FAX}' ELSE error END AS error FROM ({DUCK_PAGES})"""


def scanned_pages(spark, sf_dir):
    whole = F.when(F.col("page_no") % 7 < 5, "no text could be made out").otherwise(_FAX)
    return page_outcomes(spark, sf_dir).select(
        "doc_id", "page_no", F.when(F.col("doc_id") % 5 == 0, whole).otherwise(F.col("error")).alias("error")
    )


@query(
    "failure_runs_w9",
    f"""WITH f AS (SELECT *, page_no - row_number() OVER (PARTITION BY doc_id, error ORDER BY page_no) AS g FROM ({_SCANNED}) WHERE error IS NOT NULL),
r AS (SELECT doc_id, min(page_no) AS first_page, max(page_no) AS last_page, error FROM f GROUP BY doc_id, error, g)
SELECT *, concat(CASE last_page - first_page WHEN 0 THEN concat('page ', first_page) WHEN 1 THEN concat('pages ', first_page, ' and ', last_page)
 ELSE concat('pages ', first_page, '–', last_page) END, ': ', error) AS said FROM r""",
)
def failure_runs(spark, sf_dir):
    return G.failure_runs(scanned_pages(spark, sf_dir))


@query(
    "recognition_plan_w10",
    f"""WITH u AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS r, count(*) OVER (PARTITION BY doc_id) AS total
 FROM ({_SCANNED}) WHERE error IS NOT NULL)
SELECT doc_id, page_no, total, CASE WHEN total > 20 THEN concat('first 20 of ', total) END AS note FROM u WHERE r <= 20""",
)
def recognition_plan(spark, sf_dir):
    return G.recognition_plan(scanned_pages(spark, sf_dir).where("error IS NOT NULL"))


_IMAGES = """SELECT l_orderkey AS page_id, l_linenumber * 1000000 + l_partkey AS image_id, CAST(l_quantity * (1 + l_linenumber * l_linenumber) AS BIGINT) AS width,
 CAST(l_quantity AS BIGINT) AS height FROM lineitem"""


@query(
    "page_pictures_w11",
    f"""WITH r AS (SELECT *, width * height AS area, row_number() OVER (PARTITION BY page_id ORDER BY width * height DESC, image_id DESC) AS r FROM ({_IMAGES})),
b AS (SELECT page_id, max(image_id) FILTER (r = 1) AS image_id, coalesce(max(area) FILTER (r = 2) * 4 > max(area) FILTER (r = 1), false) AS refused FROM r GROUP BY page_id)
SELECT page_id, CASE WHEN NOT refused THEN image_id END AS image_id, refused FROM b""",
)
def page_pictures(spark, sf_dir):
    return G.page_pictures(run(spark, sf_dir, _IMAGES, "lineitem"))


_RUNS = """SELECT doc_id, doc_id % 19 > 0 AS first_done, doc_id % 23 > 0 AS second_done, text,
 CASE WHEN doc_id % 13 = 0 THEN concat(text, ' ') ELSE text END AS second_text FROM documents"""


@query(
    "completed_in_both_j13",
    f"SELECT doc_id, text = second_text AS identical FROM ({_RUNS}) WHERE first_done AND second_done",
)
def completed_in_both(spark, sf_dir):
    r = run(spark, sf_dir, _RUNS, "documents")
    first = r.select("doc_id", F.col("first_done").alias("completed"), F.sha2("text", 256).alias("digest"))
    second = r.select("doc_id", F.col("second_done").alias("completed"), F.sha2("second_text", 256).alias("digest"))
    return G.completed_in_both(first, second)


@query(
    "stable_sample_w21",
    """SELECT path, digest FROM (SELECT url AS path, sha256(concat('corpus-sample:', url)) AS digest FROM pages) ORDER BY digest, path LIMIT 60""",
)
def stable_sample(spark, sf_dir):
    return G.stable_sample(run(spark, sf_dir, "SELECT url AS path FROM pages", "pages"), "corpus-sample:", 60)


@query("text_lines_s10", f"SELECT doc_id, page_no AS line_no, element AS line FROM ({DUCK_LINES})")
def text_lines(spark, sf_dir):
    return document_lines(spark, sf_dir).select("doc_id", F.col("page_no").alias("line_no"), F.col("element").alias("line"))
