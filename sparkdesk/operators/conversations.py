"""Stored conversations: titles, artifacts, context size, search, export.

Messages are (conv_id, turn, role, text), ``turn`` being the message's position
in its conversation. One conversation may hold a large share of all messages:
per-conversation facts are partial aggregates, neighbours are reached by an
equi-join on (conv_id, turn), and ordered totals go through the block scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkdesk.functions import text as X
from sparkdesk.plans.blocked import BLOCK, Scan, block_of, scan


def artifacts(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, lang, title, code, pending) of assistant replies."""
    return (
        messages.where("role = 'assistant'")
        .withColumn("__clean", X.clean_reply(F.col("text")))
        .select("conv_id", "turn", F.posexplode(X.message_parts(F.col("__clean"))).alias("pos", "a"))
        .select("conv_id", "turn", "pos", "a.lang", "a.title", "a.code", "a.pending")
    )


def artifact_index(messages: DataFrame, block_size: int = BLOCK) -> DataFrame:
    """Finished artifacts numbered from 0 across each conversation."""
    done = artifacts(messages).where(~F.col("pending")).select(
        "conv_id", "turn", "pos", "lang", X.artifact_title(F.col("lang"), F.col("title"), F.col("code")).alias("title")
    )
    return scan(
        done, ["conv_id"], ["turn", "pos"], block_of(F.col("turn"), block_size),
        [Scan("artifact_no", "count", F.lit(1), "before")],
    )


def titles(messages: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """One title per conversation: its first user text, unless one was chosen."""
    said = F.when((F.col("role") == "user") & (F.col("text") != ""), F.struct("turn", "text"))
    derived = messages.groupBy("conv_id").agg(F.min(said).alias("first")).select(
        "conv_id",
        F.left(X.trimmed(F.coalesce("first.text", F.lit("New chat"))), F.lit(60)).alias("derived"),
    )
    if chosen is None:
        return derived.withColumnRenamed("derived", "title")
    return derived.join(chosen.select("conv_id", "title_custom"), "conv_id", "left").select(
        "conv_id", F.coalesce("title_custom", "derived").alias("title")
    )


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each conversation (conv_id, updated_at, …)."""
    rest = [c for c in snapshots.columns if c != "conv_id"]
    order = F.struct("updated_at", *[c for c in rest if c != "updated_at"])
    return snapshots.groupBy("conv_id").agg(F.max(order).alias("s")).select("conv_id", *[f"s.{c}" for c in rest])


def provenance(messages: DataFrame) -> DataFrame:
    """How each user turn was really sent.

    A record of an image turn counts only where the next message is an
    assistant's picture; without a usable record the picture decides.
    Messages carry ``sent_as`` (JSON) and ``has_image``.
    """
    reply = messages.where((F.col("role") == "assistant") & F.col("has_image")).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.lit(True).alias("produced")
    )
    plain = F.struct(
        F.lit("chat").alias("mode"), F.lit(False).alias("web_search"), F.lit(False).alias("force"),
        F.lit(False).alias("quick"),
    )
    image = F.struct(
        F.lit("image").alias("mode"), F.lit(False).alias("web_search"), F.lit(False).alias("force"),
        F.lit(False).alias("quick"),
    )
    seen = F.when(F.coalesce("produced", F.lit(False)), image).otherwise(plain)
    stored = F.col("stored")
    return (
        messages.where("role = 'user'")
        .join(reply, ["conv_id", "turn"], "left")
        .withColumn("stored", X.sent_as(F.col("sent_as")))
        .withColumn("sent", F.when(stored.isNull() | (stored["mode"] == "image"), seen).otherwise(stored))
        .select("conv_id", "turn", "sent.*")
    )


def memory_scan(messages: DataFrame) -> DataFrame:
    """Transcript rows of conversations with at least two user turns of text."""
    said = X.trimmed(F.col("text")) != ""
    eligible = (
        messages.where((F.col("role") == "user") & said).groupBy("conv_id").count().where("count >= 2").select("conv_id")
    )
    return (
        messages.where(F.col("role").isin("user", "assistant") & said)
        .join(eligible, "conv_id", "left_semi")
        .select("conv_id", "turn", "role", "text")
    )


def context_plan(messages: DataFrame, budget: int, block_size: int = BLOCK) -> DataFrame:
    """Tokens from each turn to the end of its conversation; the oldest turns
    that do not fit the budget are to be condensed."""
    sized = messages.select("conv_id", "turn", X.estimate_tokens(F.col("text")).alias("tokens"))
    return scan(
        sized, ["conv_id"], ["turn"], block_of(F.col("turn"), block_size),
        [Scan("running", "sum", F.col("tokens"), "onward")],
    ).withColumn("condense", F.col("running") > budget)


def recency(conversations: DataFrame, today: str) -> DataFrame:
    """Add the history bucket of ``updated_at`` seen from ``today``."""
    days = F.datediff(F.lit(today).cast("date"), F.to_date("updated_at"))
    return conversations.withColumn(
        "bucket",
        F.when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, "Previous 7 days")
        .when(days < 30, "Previous 30 days").otherwise("Older"),
    )


def known_projects(conversations: DataFrame, projects: DataFrame) -> DataFrame:
    """Null the project of conversations whose project no longer exists."""
    known = projects.select(F.col("project_id").alias("known_id")).distinct()
    return conversations.join(known, F.col("project_id") == F.col("known_id"), "left").select(
        *[c for c in conversations.columns if c != "project_id"], F.col("known_id").alias("project_id")
    )


def dangling(conversations: DataFrame, projects: DataFrame) -> DataFrame:
    return conversations.where("project_id IS NOT NULL").join(
        projects.select("project_id").distinct(), "project_id", "left_anti"
    )


def fresh_facts(proposed: DataFrame, held: DataFrame) -> DataFrame:
    """Proposed facts not held yet, whatever their case."""
    seen = held.select(F.lower("fact").alias("__seen")).distinct()
    return proposed.join(seen, F.lower("fact") == F.col("__seen"), "left_anti")


def deduplicated_calls(calls: DataFrame, cap: int) -> DataFrame:
    """Tool calls (turn_id, call_id, tool, arguments) that are really made:
    an identical call in a turn is answered once, and only the first ``cap``
    searches of a turn are allowed. Other tools are not capped.

    Both steps keep the smallest call ids: the first is a partial aggregate,
    the second a rank limit that Spark applies before it shuffles.
    """
    once = calls.groupBy("turn_id", "tool", "arguments").agg(F.min("call_id").alias("call_id"))
    searches, others = once.where("tool = 'search'"), once.where("tool <> 'search'")
    rank = F.row_number().over(Window.partitionBy("turn_id").orderBy("call_id"))
    return (
        searches.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank").unionByName(others)
        .select("turn_id", "call_id", "tool", "arguments")
    )


def apply_edits(messages: DataFrame, edits: DataFrame) -> DataFrame:
    """Edit user turns (conv_id, edit_no, edit_turn, new_text, attachments) one after another.

    The turn and everything after it go, the new text takes the turn's place,
    and all else the turn had stays with it. An edit with nothing to send, of
    another role's turn, or of a turn that an earlier edit removed changes
    nothing. So the edit of the earliest turn stands, the last one of them if
    there are several, and one row per chat is joined. ``replaced`` counts the
    messages that were below the edited one at that time.
    """
    sendable = edits.where((X.trimmed(F.col("new_text")) != "") | (F.col("attachments") > 0))
    target = messages.where("role = 'user'").select("conv_id", F.col("turn").alias("edit_turn"))
    valid = sendable.join(target, ["conv_id", "edit_turn"])
    last = F.max(F.struct(-F.col("edit_turn"), "edit_no", "edit_turn", "new_text")).alias("e")
    final = valid.groupBy("conv_id").agg(last).select("conv_id", "e.edit_no", "e.edit_turn", "e.new_text")
    before = valid.select("conv_id", F.col("edit_no").alias("n"), F.col("edit_turn").alias("t")).join(final, "conv_id").where("n < edit_no")
    final = final.join(before.groupBy("conv_id").agg(F.min("t").alias("earlier")), "conv_id", "left")
    joined = messages.join(final, "conv_id", "left")
    # messages between this turn and the one an earlier edit had left as the last
    below = (
        joined.where("turn > edit_turn AND (earlier IS NULL OR turn <= earlier)").groupBy("conv_id")
        .agg(F.count(F.lit(1)).alias("__below"))
    )
    kept = joined.where("edit_turn IS NULL OR turn < edit_turn").select(*messages.columns, F.lit(None).cast("long").alias("replaced"))
    resent = joined.where("turn = edit_turn").withColumn("text", F.col("new_text")).join(below, "conv_id", "left").select(
        *messages.columns, F.coalesce("__below", F.lit(0).cast("long")).alias("replaced")
    )
    return kept.unionByName(resent)


def search(conversations: DataFrame, messages: DataFrame, needle: str, around: int = 40) -> DataFrame:
    """Conversations that contain ``needle``, case ignored, newest first.

    Message text, attachment names and attached text are searched (never image
    data), and titles. The snippet comes from the first message that matches.
    ``conversations`` has (conv_id, title, updated_at, readable); a file that
    cannot be read is searched by title only.
    """
    q = needle.lower()
    parts = F.concat(
        F.array(F.col("text")),
        F.flatten(F.transform(
            F.coalesce("attachments", F.array()),
            lambda a: F.when(a["kind"] == "text", F.array(a["name"], a["content"])).otherwise(F.array(a["name"])),
        )),
    )
    # found in the text as written: lower case may have another length
    found_at = rf"(?isu)\A(.*?)({re.escape(needle)})"
    at = F.length(F.regexp_extract("part", found_at, 1)) + 1
    found = F.regexp_extract("part", found_at, 2)
    snippet = F.struct(
        F.substring(F.col("part"), F.greatest(F.lit(1), at - around), F.least(at - 1, F.lit(around))).alias("before"),
        found.alias("match"),
        F.substring(F.col("part"), at + F.length(found), F.lit(around)).alias("after"),
    )
    hit = (
        messages.select("conv_id", "turn", F.posexplode(parts).alias("pos", "part"))
        .where(F.col("part").rlike(rf"(?iu){re.escape(needle)}"))
        .select("conv_id", F.struct("turn", "pos", snippet.alias("snippet")).alias("hit"))
        .groupBy("conv_id").agg(F.min("hit").alias("hit"))
    )
    title_matched = F.contains(F.lower("title"), F.lit(q))
    found = conversations.join(hit, "conv_id", "left").withColumn("hit", F.when(F.col("readable"), F.col("hit")))
    return found.where(F.col("hit").isNotNull() | title_matched).select(
        "conv_id", "title", "updated_at",
        F.coalesce("hit.snippet.before", F.lit("")).alias("snippet_before"),
        F.coalesce("hit.snippet.match", F.lit("")).alias("snippet_match"),
        F.coalesce("hit.snippet.after", F.lit("")).alias("snippet_after"),
        title_matched.alias("title_matched"),
    )


TRANSCRIPT_PART = 200


def transcripts(messages: DataFrame, part_turns: int = TRANSCRIPT_PART) -> DataFrame:
    """Conversations as text to read: (conv_id, part, transcript).

    A part holds ``part_turns`` turns at most, so no row grows with its
    conversation; parts in order make the whole. Images are named, not embedded.
    """
    who = F.initcap("role")
    images = F.transform(
        F.filter(F.coalesce("attachments", F.array()), lambda a: a["kind"] == "image"),
        lambda a: F.concat(F.lit("[image: "), a["name"], F.lit("]")),
    )
    body = F.concat_ws("\n\n", F.concat(F.lit("## "), who), F.nullif(X.trimmed(F.col("text")), F.lit("")),
                       F.nullif(F.array_join(images, "\n"), F.lit("")))
    return (
        messages.select("conv_id", "turn", F.floor(F.col("turn") / part_turns).cast("long").alias("part"), body.alias("body"))
        .groupBy("conv_id", "part")
        .agg(F.expr("listagg(body, '\\n\\n') WITHIN GROUP (ORDER BY turn)").alias("transcript"))
    )


def payload(messages: DataFrame) -> DataFrame:
    """Messages as a model is sent them: (conv_id, turn, role, vision, content).

    Attached text is folded in as named blocks, a picture routes to the vision
    model, a reply that is only a picture gets a stand-in, empty rows go.
    """
    usable = F.filter(F.coalesce("attachments", F.array()), lambda a: a["kind"] != "error")

    def block(a: Column) -> Column:
        return F.concat(F.lit("File: "), a["name"], F.lit("\n```\n"), a["content"], F.lit("\n```"))

    has_image = F.exists(usable, lambda a: a["kind"] == "image")
    said = F.coalesce("text", F.lit(""))
    folded = X.trimmed(F.concat(
        said, F.array_join(F.transform(usable, lambda a: F.concat(F.lit("\n\n"), block(a))), "")))
    parts = F.concat(
        F.when(said != "", F.array(said)).otherwise(F.array().cast("array<string>")),
        F.transform(usable, lambda a: F.when(a["kind"] == "image", F.concat(F.lit("image_url: "), a["dataUrl"])).otherwise(block(a))),
    )
    reply = F.when(
        (said == "") & F.coalesce("has_image", F.lit(False)),
        F.lit("[Generated the requested image — it is displayed in the chat.]"),
    ).otherwise(said)
    assistant = F.col("role") == "assistant"
    content = F.when(assistant, reply).when(has_image, F.array_join(parts, "\n")).otherwise(folded)
    return (
        messages.select("conv_id", "turn", "role", (has_image & ~assistant).alias("vision"), content.alias("content"))
        .where(X.trimmed(F.col("content")) != "")
    )


def attachment_totals(messages: DataFrame) -> DataFrame:
    """Add count, image_bytes and text_chars of a message's attachments; rows
    marked as errors are messages to the reader and are not counted."""

    def total(value) -> Column:
        return F.aggregate(F.transform(counted, value), F.lit(0).cast("long"), lambda a, x: a + x)

    def data_bytes(url: Column) -> Column:
        comma = F.instr(url, ",")
        return F.when(comma > 0, F.floor((F.length(url) - comma) * 3 / 4)).otherwise(0).cast("long")

    counted = F.filter(F.coalesce("attachments", F.array()), lambda a: a["kind"] != "error")
    is_image = lambda a: (a["kind"] == "image") & (F.coalesce(a["dataUrl"], F.lit("")) != "")
    return messages.select(
        "*",
        F.size(counted).cast("long").alias("count"),
        total(lambda a: F.when(is_image(a), data_bytes(a["dataUrl"])).otherwise(F.lit(0).cast("long"))).alias("image_bytes"),
        total(lambda a: F.when(is_image(a), F.lit(0)).otherwise(F.coalesce(F.length(a["content"]), F.lit(0))).cast("long")).alias("text_chars"),
    )


MAX_ATTACHMENTS = 20
MAX_IMAGE_BYTES = 48 * 1024 * 1024
MAX_TEXT_CHARS = 300_000


def admit_attachments(
    messages: DataFrame,
    max_items: int = MAX_ATTACHMENTS,
    max_image_bytes: int = MAX_IMAGE_BYTES,
    max_text_chars: int = MAX_TEXT_CHARS,
) -> DataFrame:
    """Take a message's candidates (kind, bytes, chars) in arrival order.

    Whether one is taken depends on what was taken before it, and a refused one
    uses no budget, so this is a fold over the message's own array. What the
    fold carries is bounded: totals, and the positions of the taken items.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(
        zero.alias("image_bytes"), zero.alias("text_chars"), F.array().cast("array<int>").alias("taken"),
        zero.alias("too_many"), zero.alias("images_too_big"), zero.alias("text_too_long"),
    )

    def step(acc: Column, x: Column) -> Column:
        image = F.when(x["kind"] == "image", x["bytes"]).otherwise(zero)
        chars = F.when(x["kind"] == "image", zero).otherwise(x["chars"])
        full = F.size(acc["taken"]) >= max_items
        big = ~full & (image > 0) & (acc["image_bytes"] + image > max_image_bytes)
        long_ = ~full & ~big & (chars > 0) & (acc["text_chars"] + chars > max_text_chars)
        ok = ~(full | big | long_)
        one = lambda c: F.when(c, F.lit(1)).otherwise(0).cast("long")
        return F.struct(
            F.when(ok, acc["image_bytes"] + image).otherwise(acc["image_bytes"]).alias("image_bytes"),
            F.when(ok, acc["text_chars"] + chars).otherwise(acc["text_chars"]).alias("text_chars"),
            F.when(ok, F.concat(acc["taken"], F.array(x["pos"]))).otherwise(acc["taken"]).alias("taken"),
            (acc["too_many"] + one(full)).alias("too_many"),
            (acc["images_too_big"] + one(big)).alias("images_too_big"),
            (acc["text_too_long"] + one(long_)).alias("text_too_long"),
        )

    numbered = F.transform(F.col("candidates"), lambda c, i: F.struct(
        i.alias("pos"), c["kind"].alias("kind"), c["bytes"].cast("long").alias("bytes"), c["chars"].cast("long").alias("chars")))
    kept = [c for c in messages.columns if c != "candidates"]
    return messages.select(*kept, F.aggregate(numbered, start, step).alias("r")).select(*kept, "r.*")
