"""Column functions over page texts, warnings and process results."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from sparkdesk.functions.classes import J_NOT_WHITE
from sparkdesk.functions.text import PARTIAL_MARK, SCAN_MARK, trimmed

# fixed values: what a partly read document says before its text
PREAMBLE = (
    "[PDF partly read: only digital text was extracted. Images and scanned content were not read. "
    "PDF forms and other graphics may also be omitted."
)
PREAMBLE_RECOGNISED = (
    "[PDF partly read: digital text was extracted, and pages that had none were read from the pictures on them by "
    "this device. Recognised text can contain mistakes, and words, figures or whole lines can be missing from it "
    "without anything marking where. Other images and graphics were not read."
)
CATEGORIES = [
    "native_page_error", "neither_readable", "native_only_readable", "current_only_readable", "same_words_in_order",
    "same_words_reordered", "spacing_only", "other_difference",
]
UNCERTAIN = [
    "neither_readable", "other_difference", "native_page_error", "current_only_readable", "native_only_readable",
]
FRAME = "PDF-TEXT/1"
REFUSED_STATUS = 33


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"[{J_NOT_WHITE}]+"), F.lit(0))


def page_category(a_readable: Column, a_words: Column, b_readable: Column, b_words: Column, native_error: Column) -> Column:
    """How two readers' texts of a page differ. Repeats, case and punctuation
    count, so an amount that one reader saw twice is a difference."""
    return (
        F.when(native_error.isNotNull(), "native_page_error")
        .when(~a_readable & ~b_readable, "neither_readable")
        .when(~a_readable, "native_only_readable")
        .when(~b_readable, "current_only_readable")
        .when(a_words == b_words, "same_words_in_order")
        .when(F.array_sort(a_words) == F.array_sort(b_words), "same_words_reordered")
        .when(F.array_join(a_words, "") == F.array_join(b_words, ""), "spacing_only")
        .otherwise("other_difference")
    )


def extraction_outcome(status: Column, signal: Column, error: Column, stdout: Column, frame: str = FRAME) -> Column:
    """The process is judged before its text: a failed one can leave a
    convincing prefix behind."""
    head = rf"^{frame}\r?\n"
    framed = F.coalesce(stdout, F.lit("")).rlike(head)
    body = F.regexp_replace(stdout, head, "")
    return (
        F.when(error == "ETIMEDOUT", "timeout")
        .when(error.isNotNull() | signal.isNotNull(), "process_error")
        .when(~framed, "protocol_error")
        .when(status == REFUSED_STATUS, "refused")
        .when(status.isNull() | (status != 0), "process_error")
        .when(trimmed(body) == "", "protocol_error")
        .when(body.startswith(PARTIAL_MARK), "partial_warning")
        .when(body.startswith(SCAN_MARK), "scan_ocr")
        .otherwise("digital_without_warning")
    )


def folded(c: Column) -> Column:
    """Text in compatibility form without case, so that a ligature is its letters and ``ß`` is ``ss``.

    Spark has no such function; only texts beyond ASCII go to Python, in Arrow batches.
    """

    def fold(texts):
        from unicodedata import normalize

        return texts.map(lambda t: normalize("NFKC", t).casefold(), na_action="ignore")

    beyond = F.pandas_udf(fold, StringType())(F.when(c.rlike(r"[^\x{0}-\x{7F}]"), c))
    return F.coalesce(beyond, F.lower(c))


def token_set(c: Column) -> Column:
    """Distinct words of a folded text."""
    return F.array_distinct(words(F.coalesce(c, F.lit(""))))


def joined(c: Column, sep: str = ", ") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)
