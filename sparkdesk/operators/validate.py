"""Validation reports: one row per rule broken."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.plans.prices import KNOWN_CURRENCIES, MAX_PLAUSIBLE_RATE
from sparkdesk.operators.markdown import lines
from sparkdesk.operators.web import address_problem
from sparkdesk.sources.conversations import CONVERSATION_SCHEMA, CURRENT_SCHEMA


def _known(c: Column) -> Column:
    return F.upper(F.trim(c)).isin(KNOWN_CURRENCIES)


def _rate_rule(value: Column) -> Column:
    return (
        F.when(F.isnan(value) | (F.abs(value) == float("inf")), "rate not a number")
        .when(value < 0, "rate negative")
        .when(value > MAX_PLAUSIBLE_RATE, "rate implausible")
    )


def price_table_problems(tables: DataFrame, current_collected: str) -> DataFrame:
    """(table_id, rule, item) for every rule a price table breaks.

    All rules of a table are one array over its parsed form, so tables are read
    and parsed once, and nothing is shuffled.
    """
    price = F.col("price")

    def said(rule: Column, item: Column) -> Column:
        return F.struct(rule.alias("rule"), item.cast("string").alias("item"))

    def each(entries: Column, rules: Callable[[Column, Column], list[Column]]) -> Column:
        found = F.flatten(F.transform(F.map_entries(entries), lambda e: F.array(*rules(e["key"], e["value"]))))
        return F.coalesce(found, F.array().cast("array<struct<rule:string,item:string>>"))

    def unknown(currency: Column) -> Column:
        return F.when(~_known(currency), "currency unknown")

    def rate(*values: str) -> Callable[[Column, Column], list[Column]]:
        return lambda name, r: [
            *[said(_rate_rule(r[v]), name) for v in values], said(unknown(F.coalesce(r["currency"], F.lit("EUR"))), name),
        ]

    own = F.array(
        said(F.when(F.col("oversized"), "file too large"), F.lit("file")),
        said(unknown(price["display_currency"]), F.lit("display_currency")),
        said(F.when(price["collected"] < current_collected, "older than current"), price["collected"]),
    )
    listed = [
        each(price["fx"], lambda c, mult: [said(unknown(c), c), said(F.when(mult == 0, "fx zero").otherwise(_rate_rule(mult)), c)]),
        each(price["ai"], rate("input_per_mtok", "output_per_mtok")), each(price["image"], rate("per_unit")), each(price["search"], rate("per_unit")),
        each(price["sources"], lambda provider, url: [said(F.when(F.trim(url) != "", F.concat(F.lit("link "), address_problem(F.trim(url)))), provider)]),
    ]
    return tables.select("table_id", F.inline(F.concat(own, *listed))).where("rule IS NOT NULL")


ROLES = ["user", "assistant", "system"]
MAX_MESSAGES = 20_000


def import_problems(files: DataFrame, max_messages: int = MAX_MESSAGES) -> DataFrame:
    """(file_id, rule) for each reason a conversation file (file_id, json) is refused."""
    v = F.try_parse_json("json")
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    listed = F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.messages", "variant")).startswith("ARRAY"), F.lit(False))
    c = F.col("c")
    messages = F.coalesce(c["messages"], F.array())
    parsed = files.withColumns({"is_object": is_object, "listed": listed}).withColumn("c", F.from_json("json", CONVERSATION_SCHEMA))

    def any_message(test) -> Column:
        return F.coalesce(F.exists(messages, test), F.lit(False))

    remote = any_message(lambda m: F.exists(
        F.coalesce(m["attachments"], F.array()),
        lambda a: (a["kind"] == "image") & ~F.coalesce(a["dataUrl"].startswith("data:image/"), F.lit(False)),
    ))
    shows = any_message(lambda m: (F.coalesce(m["text"], F.lit("")) != "") | (F.size(F.coalesce(m["attachments"], F.array())) > 0))
    api = any_message(lambda m: m["content"].isNotNull())
    usable = F.col("is_object") & F.col("listed")
    rules = F.array_compact(F.array(
        F.when(~F.col("is_object"), "not a conversation"),
        F.when(F.col("is_object") & ~F.col("listed"), "no messages"),
        F.when(F.coalesce(c["schema"], F.lit(CURRENT_SCHEMA)) > CURRENT_SCHEMA, "newer schema"),
        F.when(usable & (F.size(messages) > max_messages), "too many messages"),
        F.when(usable & any_message(lambda m: m["role"].isNull()), "no sender"),
        F.when(usable & any_message(lambda m: ~m["role"].isin(ROLES)), "unknown sender"),
        F.when(usable & remote, "image not inline"),
        F.when(usable & ~shows & api, "content instead of text"),
        F.when(usable & ~shows & ~api, "nothing to show"),
    ))
    return parsed.select("file_id", F.explode(rules).alias("rule"))


_SEPARATOR = r"^\|[\s|:-]+\|$"


def broken_tables(documents: DataFrame) -> DataFrame:
    """(doc_id, line_no, separators): table rows after a blank line below a
    table, which render as text; ``separators`` counts the tables above."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines(documents).withColumn("row", F.col("line").startswith("|")).withColumn(
        "separator", F.col("line").rlike(_SEPARATOR) & F.coalesce(F.lag("row").over(w), F.lit(False))
    )
    # separators so far, and how many there were when the run of rows began
    counted = rows.withColumn("seen", F.sum(F.col("separator").cast("long")).over(w)).withColumn(
        "at_start", F.coalesce(F.max(F.when(~F.col("row"), F.col("seen"))).over(w), F.lit(0))
    )
    said = counted.where("line <> ''")
    return said.withColumns({
        "above": F.lag(F.struct("row", "line_no", "seen", "at_start")).over(w),
    }).where("row AND above.row AND line_no - above.line_no > 1 AND above.seen > above.at_start").select(
        "doc_id", (F.col("line_no") + 1).alias("line_no"), (F.col("above.seen") - F.col("above.at_start")).alias("separators")
    )


# fixed values: the mark that ends the public part, words that give a draft or a maintainer's heading away, brackets that are meant
PUBLIC_END = "<!-- public:end -->"
DRAFT_STATUS = ["outline", "draft", "not yet publish", "not yet a publish"]
MAINTAINER_WORDS = ["reviewer", "checklist", "for review", "internal", "todo"]
MEANT_BRACKETS = ["[GAP]", "[FAQ]", "[PLACEHOLDER]"]


def _has_word(line: Column, words: list[str], whole: bool = True) -> Column:
    """Whether a lower-case line holds one of the words, not as part of another."""
    end = r"\b" if whole else ""
    return line.rlike(r"\b(?:" + "|".join(w.replace(" ", r"\s") for w in words) + ")" + end)


def text_markers(documents: DataFrame, references: list[str], withheld: list[str]) -> DataFrame:
    """(doc_id, line_no, rule, found) for what must not be published, in one pass over the public lines.

    Notes to the author in brackets, draft banners, headings for maintainers,
    references that must not ship, and links to withheld names. What stands
    after the end of the public part never ships and is not looked at.
    """
    public = F.substring_index("text", PUBLIC_END, 1)
    raw = documents.select("doc_id", F.posexplode(F.split(public, "\n")).alias("pos", "line"))
    line, low = F.col("line"), F.lower("line")
    quote = lambda s: "".join("\\" + ch if not ch.isalnum() else ch for ch in s)

    def every(rule: str, items: Column) -> Column:
        return F.transform(items, lambda m: F.struct(F.lit(rule).alias("rule"), m.alias("found")))

    def once(rule: str, holds: Column) -> Column:
        return every(rule, F.when(holds, F.array(line)).otherwise(F.array().cast("array<string>")))

    # a bracket of five characters or more that opens with a capital, and is no link
    brackets = F.regexp_extract_all("line", F.lit(r"\[[^\]]*\]\(?"), F.lit(0))
    notes = F.filter(brackets, lambda b: b.rlike(r"\A\[[A-Z]") & (F.length(b) >= 7) & ~b.endswith("(") & ~b.isin(MEANT_BRACKETS))
    # links are cut at their brackets; the last part of the address without its anchor is the name
    links = F.regexp_extract_all("line", F.lit(r"\[[^\]]+\]\([^)]*\)"), F.lit(0))
    name = lambda m: F.regexp_extract(m, r"([^/(#]*)(?:#[^)]*)?\)\z", 1)
    banner = (low.startswith("# ") & _has_word(low, ["outline"])) | (low.startswith("**status:") & _has_word(low, DRAFT_STATUS, whole=False))
    found = F.concat(
        every("placeholder", notes), once("draft banner", banner),
        once("maintainer heading", low.rlike(r"\A#{1,6}\s") & _has_word(low, MAINTAINER_WORDS)),
        *[every("reference", F.regexp_extract_all("line", F.lit(quote(r)), F.lit(0))) for r in references],
        every("withheld link", F.filter(links, lambda m: name(m).isin(withheld) if withheld else F.lit(False))),
    )
    return raw.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.inline(found))
