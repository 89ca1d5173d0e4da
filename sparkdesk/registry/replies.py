"""Queries over captured reply streams."""

from __future__ import annotations

from sparkdesk.operators import replies as R
from sparkdesk.plans.reply_lines import DUCK_TOKENS, reply_lines
from sparkdesk.registry.core import query


@query("decoded_replies_t1", f"WITH {DUCK_TOKENS} SELECT * FROM ev")
def decoded_replies(spark, sf_dir):
    return R.decode(reply_lines(spark, sf_dir)).drop("pos")


_CAP = 400

DUCK_REPLIES = f"""WITH {DUCK_TOKENS}, s AS (SELECT *, coalesce(sum(strlen(token)) OVER (PARTITION BY request_id ORDER BY seq), 0) AS bytes FROM ev),
k AS (SELECT *, bytes <= {{cap}} AS kept FROM s)
SELECT request_id, coalesce(string_agg(token, '' ORDER BY seq) FILTER (kept AND token IS NOT NULL), '') AS reply,
 bool_or(NOT kept OR kind = 'truncated') AS truncated, false AS failed,
 max(prompt) FILTER (kept) AS prompt, max(completion) FILTER (kept) AS completion FROM k GROUP BY request_id"""


@query("assembled_replies_t2", DUCK_REPLIES.replace("{cap}", str(R.MAX_REPLY_BYTES)))
def assembled_replies(spark, sf_dir):
    return R.assemble(reply_lines(spark, sf_dir))


@query("capped_replies_t2", DUCK_REPLIES.replace("{cap}", str(_CAP)))
def capped_replies(spark, sf_dir):
    """The same with a cap that most replies reach."""
    return R.assemble(reply_lines(spark, sf_dir), max_bytes=_CAP)
