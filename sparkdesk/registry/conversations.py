"""Queries over stored conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdesk.functions.classes import ARTIFACT_LABELS, WHITE, WIDE
from sparkdesk.operators import conversations as C
from sparkdesk.plans.derive import MESSAGES_MARKED_SQL, messages_marked, run
from sparkdesk.registry.core import query, table
from sparkdesk.registry.text import DUCK_CLEAN, DUCK_SENT, SENT_AS_SQL, TRIM, quoted

_FENCE = r"(?s)```([^\n]*)\n(.*?)```"
_OPEN = r"(?s)```([^\n]*)\n(.*)$"


def _label(info):
    return f"CASE WHEN trim({info}, {TRIM}) = '' THEN 'text' ELSE lower(regexp_extract(trim({info}, {TRIM}), '^([^{WHITE}]+)', 1)) END"


def _fence_title(info):
    return f"trim(regexp_extract(trim({info}, {TRIM}), '(?s)^[^{WHITE}]+[{WHITE}](.*)$', 1), {TRIM})"


_ARTIFACTS = f"""
WITH m AS ({MESSAGES_MARKED_SQL}), c AS (SELECT conv_id, turn, {DUCK_CLEAN} AS t FROM m WHERE role = 'assistant'),
f AS (SELECT *, regexp_extract_all(t, '{_FENCE}') AS whole, regexp_extract_all(t, '{_FENCE}', 1) AS infos,
  regexp_extract_all(t, '{_FENCE}', 2) AS codes, string_split_regex(t, '{_FENCE}') AS gaps FROM c),
g AS (SELECT *, list_transform(infos, lambda x: {_label('x')} IN ({quoted(ARTIFACT_LABELS)})) AS shown FROM f),
h AS (SELECT *, coalesce(list_max(list_transform(range(1, len(shown) + 1), lambda i: CASE WHEN shown[i] THEN i ELSE 0 END)), 0) AS k FROM g),
r AS (SELECT *, substr(t, CAST(coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0)
   + coalesce(list_sum(list_transform(whole[1:k], lambda x: length(x))), 0) + 1 AS BIGINT)) AS rest FROM h),
closed AS (SELECT conv_id, turn, unnest(range(1, len(whole) + 1)) AS i, unnest(infos) AS info, unnest(codes) AS code, unnest(shown) AS ok FROM r),
arts AS (
 SELECT conv_id, turn, i, {_label('info')} AS lang, {_fence_title('info')} AS title, code, false AS pending FROM closed WHERE ok
 UNION ALL
 SELECT conv_id, turn, 1000000, {_label(f"regexp_extract(rest, '{_OPEN}', 1)")}, {_fence_title(f"regexp_extract(rest, '{_OPEN}', 1)")},
  regexp_extract(rest, '{_OPEN}', 2), true FROM r
  WHERE regexp_matches(rest, '{_OPEN}') AND {_label(f"regexp_extract(rest, '{_OPEN}', 1)")} IN ({quoted(ARTIFACT_LABELS)})),
parts AS (SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS BIGINT) AS pos, lang, title, code, pending FROM arts)
"""


@query("artifacts_w1", _ARTIFACTS + "SELECT * FROM parts")
def artifacts(spark, sf_dir):
    return C.artifacts(messages_marked(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


@query(
    "artifact_index_w2",
    _ARTIFACTS + """SELECT conv_id, turn, pos, lang, CASE WHEN title <> '' THEN title ELSE upper(lang) END AS title,
 CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) - 1 AS BIGINT) AS artifact_no FROM parts WHERE NOT pending""",
)
def artifact_index(spark, sf_dir):
    return C.artifact_index(messages_marked(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long"))


_TITLES = f"""titles AS (SELECT conv_id, left(trim(coalesce(arg_min(text, turn) FILTER (role = 'user' AND text <> ''), 'New chat'), {TRIM}), 60) AS derived
 FROM conversations GROUP BY conv_id),
named AS (SELECT conv_id, CASE WHEN conv_id % 10 = 0 THEN 'Renamed ' || conv_id ELSE derived END AS title FROM titles)"""


def _chosen(spark, sf_dir):
    return run(
        spark, sf_dir,
        "SELECT DISTINCT conv_id, concat('Renamed ', conv_id) AS title_custom FROM conversations WHERE conv_id % 10 = 0",
        "conversations",
    )


@query("conversation_titles_w3", f"WITH {_TITLES} SELECT * FROM named")
def conversation_titles(spark, sf_dir):
    return C.titles(table(spark, sf_dir, "conversations"), _chosen(spark, sf_dir))


_SNAPSHOTS = """SELECT conv_id, concat('2024-', substr(concat('0', CAST(1 + (conv_id * 7 + turn * 5) % 12 AS VARCHAR(4))), -2), '-',
  substr(concat('0', CAST(1 + (conv_id + turn) % 28 AS VARCHAR(4))), -2), 'T00:00:00Z') AS updated_at, turn AS n_messages FROM conversations"""


@query(
    "latest_snapshots_w4",
    f"""SELECT conv_id, updated_at, n_messages FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY updated_at DESC, n_messages DESC) AS r
FROM ({_SNAPSHOTS})) WHERE r = 1""",
)
def latest_snapshots(spark, sf_dir):
    return C.latest_snapshots(run(spark, sf_dir, _SNAPSHOTS, "conversations")).orderBy(F.desc("updated_at"), "conv_id")


_PICTURED = f"""SELECT conv_id, turn, role, {SENT_AS_SQL} AS sent_as, role = 'assistant' AND (conv_id + turn) % 6 = 1 AS has_image,
 CASE WHEN role = 'assistant' AND (conv_id + turn) % 12 = 1 THEN '' ELSE text END AS text FROM conversations"""


@query(
    "turn_provenance_w5",
    f"""WITH m AS ({_PICTURED}), n AS (SELECT *, coalesce(lead(has_image) OVER (PARTITION BY conv_id ORDER BY turn), false) AS produced FROM m)
SELECT conv_id, turn, CASE WHEN s.mode IS NULL OR s.mode = 'image' THEN CASE WHEN produced THEN 'image' ELSE 'chat' END ELSE s.mode END AS mode,
 coalesce(s.web_search, false) AS web_search, coalesce(s.force, false) AS force, coalesce(s.quick, false) AS quick
FROM n LEFT JOIN ({DUCK_SENT}) s ON conv_id % 7 = s.k WHERE role = 'user'""",
)
def turn_provenance(spark, sf_dir):
    return C.provenance(run(spark, sf_dir, _PICTURED, "conversations"))


@query(
    "memory_scan_w6",
    f"""WITH m AS (SELECT * FROM conversations WHERE trim(text, {TRIM}) <> '')
SELECT conv_id, turn, role, text FROM m WHERE role IN ('user','assistant')
 AND conv_id IN (SELECT conv_id FROM m WHERE role = 'user' GROUP BY conv_id HAVING count(*) >= 2)""",
)
def memory_scan(spark, sf_dir):
    return C.memory_scan(table(spark, sf_dir, "conversations"))


@query(
    "context_plan_w7",
    f"""WITH n AS (SELECT conv_id, turn, length(text) AS n, length(regexp_replace(text, '[^\\x{{0}}-\\x{{7F}}]+', '', 'g')) AS a,
  length(regexp_replace(text, '[^{WIDE}]+', '', 'g')) AS w FROM conversations),
t AS (SELECT conv_id, turn, CAST(ceil(a / 4.0) + w + ceil((n - a - w) / 2.0) AS BIGINT) AS tokens FROM n)
SELECT *, running > 150 AS condense FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS running FROM t)""",
)
def context_plan(spark, sf_dir):
    return C.context_plan(table(spark, sf_dir, "conversations"), budget=150)


_META = """SELECT DISTINCT conv_id, date_add(DATE '2024-03-31', CAST(-(conv_id % 45) AS INT)) AS updated_at,
 CASE WHEN conv_id % 4 > 0 THEN concat('p', CAST(conv_id % 9 AS VARCHAR(4))) END AS project_id FROM conversations"""
_DUCK_META = """SELECT DISTINCT conv_id, DATE '2024-03-31' - CAST(conv_id % 45 AS INT) AS updated_at,
 CASE WHEN conv_id % 4 > 0 THEN concat('p', CAST(conv_id % 9 AS VARCHAR(4))) END AS project_id FROM conversations"""


@query(
    "recency_buckets_w20",
    f"""SELECT conv_id, CASE WHEN d <= 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 7 THEN 'Previous 7 days' WHEN d < 30 THEN 'Previous 30 days' ELSE 'Older' END AS bucket
FROM (SELECT conv_id, date_diff('day', updated_at, DATE '2024-03-30') AS d FROM ({_DUCK_META}))""",
)
def recency_buckets(spark, sf_dir):
    return C.recency(run(spark, sf_dir, _META, "conversations"), "2024-03-30").select("conv_id", "bucket")


def _projects(spark, sf_dir):
    return run(spark, sf_dir, "SELECT DISTINCT concat('p', CAST(conv_id % 9 AS VARCHAR(4))) AS project_id FROM conversations WHERE conv_id % 9 < 6", "conversations")


@query(
    "dangling_projects_j7",
    f"SELECT conv_id, project_id FROM ({_DUCK_META}) WHERE project_id IS NOT NULL AND CAST(substr(project_id, 2) AS INT) >= 6",
)
def dangling_projects(spark, sf_dir):
    return C.dangling(run(spark, sf_dir, _META, "conversations"), _projects(spark, sf_dir)).select("conv_id", "project_id")


@query(
    "known_projects_j7",
    f"SELECT conv_id, CASE WHEN CAST(substr(project_id, 2) AS INT) < 6 THEN project_id END AS project_id FROM ({_DUCK_META})",
)
def known_projects(spark, sf_dir):
    return C.known_projects(run(spark, sf_dir, _META, "conversations"), _projects(spark, sf_dir)).select("conv_id", "project_id")


@query(
    "fresh_facts_j8",
    """WITH held AS (SELECT DISTINCT lower(text) AS t FROM conversations WHERE role = 'user' AND conv_id % 3 > 0)
SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN lower(text) ELSE text END AS fact FROM conversations WHERE role = 'user' AND lower(text) NOT IN (SELECT t FROM held)""",
)
def fresh_facts(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    return C.fresh_facts(
        said.select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, F.lower("text")).otherwise(F.col("text")).alias("fact")),
        said.where("conv_id % 3 > 0").select(F.col("text").alias("fact")),
    )


_CALLS = """SELECT user_id AS turn_id, event_id AS call_id, CASE WHEN event_type IN ('view', 'click') THEN 'search' ELSE 'fetch' END AS tool,
 concat(event_type, props) AS arguments FROM events"""


@query(
    "deduplicated_calls_w23",
    f"""WITH o AS (SELECT turn_id, tool, arguments, min(call_id) AS call_id FROM ({_CALLS}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY turn_id, tool ORDER BY call_id) AS n FROM o)
SELECT turn_id, call_id, tool, arguments FROM r WHERE tool <> 'search' OR n <= 8""",
)
def deduplicated_calls(spark, sf_dir):
    return C.deduplicated_calls(run(spark, sf_dir, _CALLS, "events"), cap=8)


_EDITS = """SELECT conv_id, 1 AS edit_no, turn AS edit_turn, CASE WHEN conv_id % 3 = 0 THEN '  ' ELSE concat('Again: ', text) END AS new_text,
 CASE WHEN conv_id % 6 = 0 THEN 1 ELSE 0 END AS attachments FROM conversations WHERE conv_id % 2 = 0 AND turn = 1 + conv_id % 4
 UNION ALL SELECT conv_id, 2, turn, concat('Once more: ', text), 0 FROM conversations WHERE conv_id % 5 < 3 AND turn <= 2 AND turn % 3 = conv_id % 3"""


@query(
    "edited_turns_w25",
    f"""WITH e AS (SELECT x.* FROM ({_EDITS}) x JOIN conversations c ON c.conv_id = x.conv_id AND c.turn = x.edit_turn AND c.role = 'user'
  WHERE trim(new_text) <> '' OR attachments > 0),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY edit_turn, edit_no DESC) = 1),
g AS (SELECT f.*, (SELECT min(edit_turn) FROM e WHERE e.conv_id = f.conv_id AND e.edit_no < f.edit_no) AS earlier FROM f)
SELECT c.conv_id, turn, role, text, NULL::BIGINT AS replaced FROM conversations c LEFT JOIN g USING (conv_id) WHERE edit_turn IS NULL OR turn < edit_turn
UNION ALL SELECT conv_id, edit_turn, 'user', new_text,
 (SELECT count(*) FROM conversations c WHERE c.conv_id = g.conv_id AND c.turn > g.edit_turn AND (g.earlier IS NULL OR c.turn <= g.earlier)) FROM g""",
)
def edited_turns(spark, sf_dir):
    return C.apply_edits(table(spark, sf_dir, "conversations"), run(spark, sf_dir, _EDITS, "conversations"))


def _with_attachments(spark, sf_dir):
    """Messages with no attachment, a text, an image, or an error and a text."""
    k = (F.col("conv_id") + F.col("turn")) % 4

    def item(kind, name, content=None, url=None):
        null = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), name.alias("name"), (content if content is not None else null).alias("content"),
            (url if url is not None else null).alias("dataUrl"),
        )

    note = item("text", F.concat(F.lit("note-"), F.col("turn"), F.lit(".txt")), F.reverse("text"))
    size = (4 * F.col("turn") + F.col("conv_id") % 50).cast("int")
    shot = item("image", F.concat(F.lit("shot-"), F.col("conv_id"), F.lit(".png")), None,
                F.concat(F.lit("data:image/png;base64,"), F.repeat(F.lit("A"), size)))
    bad = item("error", F.lit("too big"))
    return run(spark, sf_dir, _PICTURED, "conversations").withColumn(
        "attachments",
        F.when(k == 1, F.array(note)).when(k == 2, F.array(shot, note)).when(k == 3, F.array(bad, shot)),
    )


_K = "(conv_id + turn) % 4"


@query(
    "attachment_totals_a6",
    f"""SELECT conv_id, turn, CAST(CASE {_K} WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS BIGINT) AS count,
 CAST(CASE WHEN {_K} >= 2 THEN floor((4 * turn + conv_id % 50) * 3 / 4.0) ELSE 0 END AS BIGINT) AS image_bytes,
 CASE WHEN {_K} IN (1, 2) THEN length(text) ELSE 0 END AS text_chars FROM ({_PICTURED})""",
)
def attachment_totals(spark, sf_dir):
    return C.attachment_totals(_with_attachments(spark, sf_dir)).select("conv_id", "turn", "count", "image_bytes", "text_chars")


_BLOCK = "concat('File: note-', turn, '.txt', chr(10), '```', chr(10), reverse(text), chr(10), '```')"
_SHOT = "concat('image_url: data:image/png;base64,', repeat('A', CAST(4 * turn + conv_id % 50 AS INT)))"


@query(
    "model_payload_p14",
    f"""SELECT * FROM (SELECT conv_id, turn, role, role <> 'assistant' AND {_K} >= 2 AS vision, CASE
  WHEN role = 'assistant' AND text = '' AND has_image THEN '[Generated the requested image — it is displayed in the chat.]'
  WHEN role = 'assistant' THEN text WHEN {_K} = 0 THEN trim(text, {TRIM})
  WHEN {_K} = 1 THEN trim(concat(text, chr(10), chr(10), {_BLOCK}), {TRIM})
  WHEN {_K} = 2 THEN concat(CASE WHEN text <> '' THEN concat(text, chr(10)) ELSE '' END, {_SHOT}, chr(10), {_BLOCK})
  ELSE concat(CASE WHEN text <> '' THEN concat(text, chr(10)) ELSE '' END, {_SHOT}) END AS content FROM ({_PICTURED})) WHERE trim(content, {TRIM}) <> ''""",
)
def model_payload(spark, sf_dir):
    return C.payload(_with_attachments(spark, sf_dir))


_FULL = "a.n >= 20"
_BIG = f"(NOT {_FULL} AND x.bytes > 0 AND a.image_bytes + x.bytes > 50331648)"
_LONG = f"(NOT {_FULL} AND NOT {_BIG} AND x.chars > 0 AND a.text_chars + x.chars > 300000)"
_TAKE = f"NOT ({_FULL} OR {_BIG} OR {_LONG})"


@query(
    "admitted_attachments_w8",
    f"""WITH c AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda s, i: {{'pos': (i - 1)::BIGINT,
  'bytes': CASE WHEN (i - 1) % 3 = 1 THEN ((i - 1) * 7 + 1) % 6 * 2097152 ELSE 0 END::BIGINT,
  'chars': CASE WHEN (i - 1) % 3 = 1 THEN 0 ELSE length(s) * 40 END::BIGINT}}) AS l FROM documents),
f AS (SELECT doc_id, list_reduce(l, lambda a, x: {{
  'n': a.n + CASE WHEN {_TAKE} THEN 1 ELSE 0 END, 'image_bytes': a.image_bytes + CASE WHEN {_TAKE} THEN x.bytes ELSE 0 END,
  'text_chars': a.text_chars + CASE WHEN {_TAKE} THEN x.chars ELSE 0 END,
  'taken': CASE WHEN {_TAKE} THEN concat(a.taken, CASE WHEN a.n > 0 THEN ',' ELSE '' END, x.pos) ELSE a.taken END,
  'too_many': a.too_many + CASE WHEN {_FULL} THEN 1 ELSE 0 END, 'images_too_big': a.images_too_big + CASE WHEN {_BIG} THEN 1 ELSE 0 END,
  'text_too_long': a.text_too_long + CASE WHEN {_LONG} THEN 1 ELSE 0 END}},
  {{'n': 0::BIGINT, 'image_bytes': 0::BIGINT, 'text_chars': 0::BIGINT, 'taken': '', 'too_many': 0::BIGINT, 'images_too_big': 0::BIGINT, 'text_too_long': 0::BIGINT}}) AS r FROM c)
SELECT doc_id, r.image_bytes, r.text_chars, r.taken, r.too_many, r.images_too_big, r.text_too_long FROM f""",
)
def admitted_attachments(spark, sf_dir):
    """Every document's lines as a message's candidates."""
    lines = F.split("text", "\n")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.transform(lines, lambda s, i: F.struct(
            F.when(i % 3 == 1, "image").otherwise("text").alias("kind"),
            ((i * 7 + 1) % 6 * 2 * 1024 * 1024).cast("long").alias("bytes"),
            (F.length(s) * 40).cast("long").alias("chars"),
        )).alias("candidates"),
    )
    out = C.admit_attachments(docs)
    return out.withColumn("taken", F.array_join(F.transform("taken", lambda x: x.cast("string")), ","))


_HITS = f"""WITH {_TITLES}, meta AS ({_DUCK_META}),
parts AS (SELECT conv_id, turn, 0 AS pos, text AS part FROM ({_PICTURED})
 UNION ALL SELECT conv_id, turn, CASE WHEN {_K} = 2 THEN 2 ELSE 1 END, concat('note-', turn, '.txt') FROM ({_PICTURED}) WHERE {_K} IN (1, 2)
 UNION ALL SELECT conv_id, turn, CASE WHEN {_K} = 2 THEN 3 ELSE 2 END, reverse(text) FROM ({_PICTURED}) WHERE {_K} IN (1, 2)
 UNION ALL SELECT conv_id, turn, CASE WHEN {_K} = 2 THEN 1 ELSE 2 END, concat('shot-', conv_id, '.png') FROM ({_PICTURED}) WHERE {_K} >= 2),
hits AS (SELECT *, instr(lower(part), 'tion') AS i FROM parts WHERE contains(lower(part), 'tion')),
first AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) = 1)
SELECT n.conv_id, n.title, CAST(m.updated_at AS VARCHAR) AS updated_at,
 CASE WHEN i IS NULL OR n.conv_id % 13 = 0 THEN '' ELSE substr(part, greatest(1, i - 40), least(i - 1, 40)) END AS snippet_before,
 CASE WHEN i IS NULL OR n.conv_id % 13 = 0 THEN '' ELSE substr(part, i, 4) END AS snippet_match,
 CASE WHEN i IS NULL OR n.conv_id % 13 = 0 THEN '' ELSE substr(part, i + 4, 40) END AS snippet_after,
 contains(lower(n.title), 'tion') AS title_matched
FROM named n JOIN meta m USING (conv_id) LEFT JOIN first f USING (conv_id)
WHERE (i IS NOT NULL AND n.conv_id % 13 <> 0) OR contains(lower(n.title), 'tion')"""


def _searchable(spark, sf_dir):
    meta = run(spark, sf_dir, _META, "conversations")
    return C.titles(table(spark, sf_dir, "conversations"), _chosen(spark, sf_dir)).join(meta, "conv_id").select(
        "conv_id", "title", F.col("updated_at").cast("string").alias("updated_at"), (F.col("conv_id") % 13 != 0).alias("readable")
    )


@query("chat_search_k15", _HITS)
def chat_search(spark, sf_dir):
    return C.search(_searchable(spark, sf_dir), _with_attachments(spark, sf_dir), "tion").orderBy(F.desc("updated_at"), "conv_id")


@query("chat_search_unread_k15", "SELECT count(DISTINCT conv_id) AS unread FROM conversations WHERE conv_id % 13 = 0")
def chat_search_unread(spark, sf_dir):
    """How many conversations could be searched by title only."""
    return _searchable(spark, sf_dir).where("NOT readable").agg(F.count(F.lit(1)).alias("unread"))


@query(
    "transcripts_a19",
    f"""SELECT conv_id, CAST(turn // 200 AS BIGINT) AS part, string_agg(concat('## ', upper(left(role, 1)), substr(role, 2),
  CASE WHEN trim(text, {TRIM}) <> '' THEN concat(chr(10), chr(10), trim(text, {TRIM})) ELSE '' END,
  CASE WHEN {_K} >= 2 THEN concat(chr(10), chr(10), '[image: shot-', conv_id, '.png]') ELSE '' END), chr(10) || chr(10) ORDER BY turn) AS transcript
FROM ({_PICTURED}) GROUP BY ALL""",
)
def transcripts(spark, sf_dir):
    return C.transcripts(_with_attachments(spark, sf_dir))
