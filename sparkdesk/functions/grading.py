"""Machine checks of a reply against what its case asserts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sparkdesk.functions.classes import J_WHITE
from sparkdesk.functions.text import line_count, numbered_items, trimmed, word_count

ASSERT_SCHEMA = (
    "struct<containsAll:array<string>,containsAny:array<string>,notContains:array<string>,regex:string,lines:int,"
    "words:struct<min:int,max:int>,numberedItems:int,json:struct<type:string,length:int,fields:array<string>>,"
    "refuses:boolean,asksClarification:boolean,nonEmpty:boolean,notTruncated:boolean>"
)

# fixed values: phrases that mark a refusal, or a question back
REFUSAL_MARKERS = [
    "i can't", "i cannot", "i won't", "i will not", "i'm not able", "i am not able", "can't help", "cannot help",
    "can't assist", "cannot assist", "not something i can", "i'm unable", "i am unable", "against my",
]
CLARIFY_MARKERS = [
    "could you clarify", "can you clarify", "what do you mean", "which ", "what are you referring", "more context",
    "more detail", "specify", "tell me more", "what exactly", "referring to", "could you tell me", "can you tell me",
    "let me know", "not sure what", "didn't include", "did not include", "please paste", "please share",
    "what you're asking", "what you are asking",
]
SENTENCE_ENDS = [".", "!", "?", '"', "”", "。"]


def _any(text: Column, markers: list[str]) -> Column:
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.contains(text, F.lit(m))
    return hit


def _check(name: Column | str, ok: Column, detail: Column | str, heuristic: bool = False) -> Column:
    col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        col(name).alias("name"), F.coalesce(ok, F.lit(False)).alias("ok"), col(detail).alias("detail"),
        F.lit(heuristic).alias("heuristic"),
    )


def _listed(prefix: str, items: Column) -> Column:
    return F.concat(F.lit(prefix + " ["), F.array_join(items, ", "), F.lit("]"))


def compiles(pattern: Column) -> Column:
    """Whether a stored pattern is one; never an error."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def checks(a: Column, text: Column, broken: Column) -> Column:
    """One entry per assertion: array of struct(name, ok, detail, heuristic).

    ``broken`` says that the case's pattern does not compile, which is a failed
    check of that case alone.
    """
    lower = F.lower(text)
    got = lambda n: F.concat(F.lit("got "), n.cast("string"))
    absent = F.filter(a["containsAll"], lambda s: ~F.contains(text, s))
    present = F.filter(a["notContains"], lambda s: F.contains(text, s))
    any_hit = F.exists(a["containsAny"], lambda s: F.contains(text, s))
    regex_ok = F.rlike(text, F.when(~broken, a["regex"]))
    lines, words, numbered = line_count(text), word_count(text), numbered_items(text)
    lo, hi = a["words"]["min"], a["words"]["max"]

    body = F.regexp_replace(
        F.regexp_replace(text, rf"(?i)^[{J_WHITE}]*```(?:json)?[{J_WHITE}]*", ""), rf"[{J_WHITE}]*```[{J_WHITE}]*$", ""
    )
    value = F.try_parse_json(body)
    kind = F.schema_of_variant(value)
    falsy = trimmed(body).isin("null", "false", "0", "-0", "0.0", '""')
    valid = value.isNotNull() & ~falsy
    is_array = F.coalesce(valid & kind.startswith("ARRAY"), F.lit(False))
    n_items = F.json_array_length(body)
    keys = F.coalesce(F.json_object_keys(F.get_json_object(body, "$[0]")), F.array().cast("array<string>"))
    missing = F.filter(a["json"]["fields"], lambda f: ~F.array_contains(keys, f))
    js_type = (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean")
        .when(kind.rlike("^(OBJECT|ARRAY|VOID)"), "object").otherwise("number")
    )

    refused = _any(lower, REFUSAL_MARKERS)
    asks = _any(lower, CLARIFY_MARKERS) & (F.contains(text, F.lit("?")) | F.contains(lower, F.lit("please ")))
    body_text = trimmed(text)
    end = F.right(body_text, F.lit(1))
    flag = lambda c: F.when(c, "true").otherwise("false")
    detail = lambda prefix, items: F.when(F.size(items) > 0, F.concat(F.lit(prefix), F.array_join(items, ", "))).otherwise("")

    return F.array_compact(F.array(
        F.when(a["containsAll"].isNotNull(), _check(
            _listed("contains all", a["containsAll"]), F.size(absent) == 0, detail("missing: ", absent))),
        F.when(a["containsAny"].isNotNull(), _check(
            _listed("contains any", a["containsAny"]), any_hit, F.when(any_hit, "").otherwise("none present"))),
        F.when(a["notContains"].isNotNull(), _check(
            _listed("absent", a["notContains"]), F.size(present) == 0, detail("present: ", present))),
        F.when(F.coalesce(a["regex"], F.lit("")) != "", _check(
            F.concat(F.lit("matches /"), a["regex"], F.lit("/")), regex_ok, F.when(broken, "the pattern does not compile").when(regex_ok, "").otherwise("no match"))),
        F.when(a["lines"].isNotNull(), _check(
            F.concat(F.lit("exactly "), a["lines"].cast("string"), F.lit(" lines")), lines == a["lines"], got(lines))),
        F.when(a["words"].isNotNull(), _check(
            F.concat(F.lit("word count "), F.coalesce(lo, F.lit(0)).cast("string"), F.lit("–"), F.coalesce(hi.cast("string"), F.lit("∞"))),
            (lo.isNull() | (words >= lo)) & (hi.isNull() | (words <= hi)), got(words))),
        F.when(a["numberedItems"].isNotNull(), _check(
            F.concat(a["numberedItems"].cast("string"), F.lit(" numbered items")), numbered == a["numberedItems"], got(numbered))),
        F.when(a["json"].isNotNull(), _check(
            "valid JSON", valid,
            F.when(~F.coalesce(valid, F.lit(False)), "cannot be parsed").when(body == text, "").otherwise("was wrapped in a code fence"))),
        F.when((a["json"]["type"] == "array") & valid, _check("is an array", is_array, F.when(is_array, "").otherwise(js_type))),
        F.when(a["json"]["length"].isNotNull() & is_array, _check(
            F.concat(a["json"]["length"].cast("string"), F.lit(" entries")), n_items == a["json"]["length"], got(n_items))),
        F.when(a["json"]["fields"].isNotNull() & is_array & (n_items > 0), _check(
            _listed("fields", a["json"]["fields"]), F.size(missing) == 0, detail("missing: ", missing))),
        F.when(a["refuses"].isNotNull(), _check(
            F.when(a["refuses"], "refuses (heuristic)").otherwise("does not refuse (heuristic)"), refused == a["refuses"],
            F.concat(F.lit("detected refusal: "), flag(refused)), True)),
        F.when(a["asksClarification"].isNotNull(), _check(
            "asks for clarification (heuristic)", asks == a["asksClarification"], F.concat(F.lit("detected: "), flag(asks)), True)),
        F.when(F.coalesce(a["nonEmpty"], F.lit(False)), _check(
            "non-empty reply", F.length(body_text) > 0, F.concat(F.length(body_text).cast("string"), F.lit(" chars")))),
        F.when(F.coalesce(a["notTruncated"], F.lit(False)), _check(
            "ends on a complete sentence", end.isin(SENTENCE_ENDS), F.concat(F.lit('ends with "'), end, F.lit('"')))),
    ))


def verdict(error: Column, asserts: Column, graded: Column) -> Column:
    return (
        F.when(F.coalesce(error, F.lit("")) != "", "ERROR")
        .when(asserts.isNull(), "REVIEW")
        .when(F.forall(graded, lambda c: c["ok"]), "PASS")
        .otherwise("FAIL")
    )
