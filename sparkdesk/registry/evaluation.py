"""Queries that grade replies; every assistant turn is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdesk.functions.classes import WHITE
from sparkdesk.functions.grading import CLARIFY_MARKERS, REFUSAL_MARKERS, SENTENCE_ENDS
from sparkdesk.operators import evaluation as E
from sparkdesk.plans.derive import run
from sparkdesk.registry.core import query, table
from sparkdesk.registry.text import TRIM
from sparkdesk.session import new_path
from sparkdesk.sources import evaluation as S

_RESULTS = """SELECT concat(CAST(conv_id AS VARCHAR(20)), '.', CAST(turn AS VARCHAR(20))) AS id, conv_id, turn, concat('group ', CAST(conv_id % 6 AS VARCHAR(4))) AS category,
 CASE WHEN conv_id % 6 = 3 AND turn % 4 = 1 THEN concat('```json', chr(10), '[{"id":1,"name":"x"},{"id":2}]', chr(10), '```')
      WHEN conv_id % 6 = 3 AND turn % 4 = 3 THEN '[{"id":1}]' WHEN conv_id % 6 = 4 AND turn % 4 = 1 THEN concat('I cannot. 1. which one? ', text)
      WHEN conv_id % 6 = 4 THEN concat('1. a', chr(10), '2) b', chr(10), text) ELSE text END AS text,
 CASE WHEN conv_id % 17 = 0 THEN concat('timed out: ', text) END AS error,
 length(text) % 5000 AS ms, turn * 10 AS input_tokens, length(text) AS output_tokens, (length(text) % 977) / CAST(4096 AS DOUBLE) AS cost
FROM conversations WHERE role = 'assistant'"""

_ASSERTS = [
    '{"containsAll":["e","a"],"notContains":["tion"],"words":{"min":5,"max":60}}',
    '{"containsAny":["tion","ung"],"lines":2,"nonEmpty":true}',
    '{"regex":"[A-Z][a-z]+ (de|the|der)","notTruncated":true}',
    '{"json":{"type":"array","length":2,"fields":["id","name"]}}',
    '{"refuses":true,"asksClarification":false,"numberedItems":2}',
]
_BROKEN = '{"regex":"([","notTruncated":true}'  # does not compile


def results(spark, sf_dir):
    return run(spark, sf_dir, _RESULTS, "conversations").select(
        "id", "category", "text", "error", F.col("ms").cast("long").alias("ms"),
        F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").cast("long").alias("outputTokens"), "cost",
        (F.col("conv_id") % 3).alias("run"),
    )


def cases(spark, sf_dir):
    k = F.col("conv_id") % 6
    spec = F.lit(None).cast("string")
    for i, a in enumerate(_ASSERTS):
        spec = F.when(k == i, F.lit(a)).otherwise(spec)
    spec = F.when((k == 2) & (F.col("turn") % 4 == 3), F.lit(_BROKEN)).otherwise(spec)
    return (
        run(spark, sf_dir, "SELECT conv_id, turn FROM conversations WHERE role = 'assistant'", "conversations")
        .where("conv_id % 6 <> 5 OR turn % 4 = 1")
        .select(
            F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
            F.from_json(spec, S.ASSERT_SCHEMA).alias("assert"),
            F.when(k == 5, "read it").alias("review"), (k == 5).alias("appLevel"),
        )
    )


def graded(spark, sf_dir):
    return E.graded(results(spark, sf_dir), cases(spark, sf_dir))


def _list(items):
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


_T = f"trim(text, {TRIM})"
_CHECKS = f"""WITH r AS (SELECT *, conv_id % 6 AS k FROM ({_RESULTS})),
m AS (SELECT *, len(regexp_extract_all(text, '[^{WHITE}]+')) AS words,
  len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {TRIM}) <> '')) AS lines,
  len(regexp_extract_all(text, '(?m)^[{WHITE}]*[0-9]+[.)][{WHITE}]+')) AS numbered, right({_T}, 1) AS tail,
  len(list_filter([{_list(REFUSAL_MARKERS)}], lambda p: contains(lower(text), p))) > 0 AS refused,
  len(list_filter([{_list(CLARIFY_MARKERS)}], lambda p: contains(lower(text), p))) > 0 AND (contains(text, '?') OR contains(lower(text), 'please ')) AS asks,
  k = 3 AND turn % 4 IN (1, 3) AS is_json FROM r),
c AS (
 SELECT id, 'contains all [e, a]' AS name, contains(text, 'e') AND contains(text, 'a') AS ok,
  CASE WHEN contains(text, 'e') AND contains(text, 'a') THEN '' ELSE concat('missing: ', array_to_string(list_filter(['e', 'a'], lambda x: NOT contains(text, x)), ', ')) END AS detail, false AS heuristic FROM m WHERE k = 0
 UNION ALL SELECT id, 'absent [tion]', NOT contains(text, 'tion'), CASE WHEN contains(text, 'tion') THEN 'present: tion' ELSE '' END, false FROM m WHERE k = 0
 UNION ALL SELECT id, 'word count 5–60', words BETWEEN 5 AND 60, concat('got ', words), false FROM m WHERE k = 0
 UNION ALL SELECT id, 'contains any [tion, ung]', contains(text, 'tion') OR contains(text, 'ung'), CASE WHEN contains(text, 'tion') OR contains(text, 'ung') THEN '' ELSE 'none present' END, false FROM m WHERE k = 1
 UNION ALL SELECT id, 'exactly 2 lines', lines = 2, concat('got ', lines), false FROM m WHERE k = 1
 UNION ALL SELECT id, 'non-empty reply', length({_T}) > 0, concat(length({_T}), ' chars'), false FROM m WHERE k = 1
 UNION ALL SELECT id, 'matches /[A-Z][a-z]+ (de|the|der)/', regexp_matches(text, '[A-Z][a-z]+ (de|the|der)'), CASE WHEN regexp_matches(text, '[A-Z][a-z]+ (de|the|der)') THEN '' ELSE 'no match' END, false FROM m WHERE k = 2 AND turn % 4 <> 3
 UNION ALL SELECT id, 'matches /([/', false, 'the pattern does not compile', false FROM m WHERE k = 2 AND turn % 4 = 3
 UNION ALL SELECT id, 'ends on a complete sentence', tail IN ({_list(SENTENCE_ENDS)}), concat('ends with "', tail, '"'), false FROM m WHERE k = 2
 UNION ALL SELECT id, 'valid JSON', is_json, CASE WHEN NOT is_json THEN 'cannot be parsed' WHEN turn % 4 = 1 THEN 'was wrapped in a code fence' ELSE '' END, false FROM m WHERE k = 3
 UNION ALL SELECT id, 'is an array', true, '', false FROM m WHERE is_json
 UNION ALL SELECT id, '2 entries', turn % 4 = 1, CASE WHEN turn % 4 = 1 THEN 'got 2' ELSE 'got 1' END, false FROM m WHERE is_json
 UNION ALL SELECT id, 'fields [id, name]', turn % 4 = 1, CASE WHEN turn % 4 = 1 THEN '' ELSE 'missing: name' END, false FROM m WHERE is_json
 UNION ALL SELECT id, '2 numbered items', numbered = 2, concat('got ', numbered), false FROM m WHERE k = 4
 UNION ALL SELECT id, 'refuses (heuristic)', refused, concat('detected refusal: ', refused), true FROM m WHERE k = 4
 UNION ALL SELECT id, 'asks for clarification (heuristic)', NOT asks, concat('detected: ', asks), true FROM m WHERE k = 4),
checks AS (SELECT c.* FROM c JOIN r USING (id) WHERE error IS NULL),
verdicts AS (SELECT r.*, CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN k = 5 THEN 'REVIEW' WHEN NOT EXISTS (SELECT 1 FROM checks c WHERE c.id = r.id AND NOT ok) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r)
"""


@query(
    "results_with_case_j4",
    f"SELECT id, CASE WHEN conv_id % 6 = 5 AND turn % 4 = 1 THEN 'read it' END AS review, conv_id % 6 = 5 AND turn % 4 = 1 AS app_level FROM ({_RESULTS})",
)
def results_with_case(spark, sf_dir):
    return graded(spark, sf_dir).select("id", "review", "app_level")


@query("check_rows_k8", _CHECKS + "SELECT * FROM checks")
def check_rows(spark, sf_dir):
    return E.check_rows(graded(spark, sf_dir))


@query("case_verdicts_k9", _CHECKS + "SELECT id, verdict FROM verdicts")
def case_verdicts(spark, sf_dir):
    return graded(spark, sf_dir).select("id", "verdict")


@query(
    "run_summary_a11",
    _CHECKS + """SELECT conv_id % 3 AS run, count(*) AS requests, count(*) FILTER (verdict = 'PASS') AS pass, count(*) FILTER (verdict = 'FAIL') AS fail,
 count(*) FILTER (verdict = 'REVIEW') AS review, count(*) FILTER (verdict = 'ERROR') AS error, round(sum(cost), 6) AS cost, max(ms) AS slowest_ms,
 list_sort(list(ms))[count(*) // 2 + 1] AS median_ms FROM verdicts GROUP BY ALL""",
)
def run_summary(spark, sf_dir):
    return E.run_summary(graded(spark, sf_dir))


@query(
    "report_rows_a18",
    _CHECKS + """, f AS (SELECT id, string_agg(CASE WHEN NOT ok THEN concat(name, ' — ', detail) END, '; ' ORDER BY n) AS failed,
  string_agg(CASE WHEN heuristic THEN concat(name, ': ', CASE WHEN ok THEN 'as expected' ELSE 'MISMATCH' END) END, ', ' ORDER BY n) AS heuristic
  FROM (SELECT *, CASE WHEN name LIKE 'contains%' THEN 1 WHEN name LIKE 'absent%' THEN 2 WHEN name LIKE 'matches%' THEN 3 WHEN name LIKE 'exactly%' THEN 4 WHEN name LIKE 'word%' THEN 5
   WHEN name LIKE '%numbered%' THEN 6 WHEN name = 'valid JSON' THEN 7 WHEN name LIKE '%entries' THEN 8 WHEN name LIKE 'fields%' THEN 9 WHEN name LIKE 'refuses%' THEN 10
   WHEN name LIKE 'asks%' THEN 11 ELSE 12 END AS n FROM checks) GROUP BY id)
SELECT id, verdict, CASE WHEN error IS NOT NULL THEN left(error, 80) ELSE coalesce(failed, '') END AS failed,
 CASE WHEN k = 5 AND turn % 4 = 1 THEN 'read it' END AS needs_review, coalesce(heuristic, '') AS heuristic FROM verdicts LEFT JOIN f USING (id)""",
)
def report_rows(spark, sf_dir):
    return E.report_rows(graded(spark, sf_dir))


@query(
    "cost_hotspots_w22",
    f"SELECT id, cost, input_tokens AS \"inputTokens\", output_tokens AS \"outputTokens\" FROM ({_RESULTS}) ORDER BY cost DESC, id LIMIT 5",
)
def cost_hotspots(spark, sf_dir):
    return E.hotspots(results(spark, sf_dir))


def _spec(spark, sf_dir):
    """A case per document: every third is a conversation of its lines, some
    lack an id, a prompt or a judgement, and some repeat an id."""
    d = F.col("doc_id")
    null = F.lit(None).cast("string")
    case_id = F.when(d % 50 == 7, "").when(d % 40 == 3, F.concat(F.lit("same-"), F.col("lang"))).otherwise(F.concat(F.lit("c"), d))
    talk = F.transform(F.split("text", "\n"), lambda s, i: F.struct(
        F.concat(F.lit("c"), d, F.lit("."), i).alias("id"), s.alias("prompt"), F.lit("look").alias("review")))
    case = F.struct(
        case_id.alias("id"), F.col("lang").alias("category"), F.when(d % 60 != 11, F.col("source")).otherwise(null).alias("prompt"),
        F.when(d % 5 > 0, F.struct(F.lit(True).alias("nonEmpty"))).alias("assert"),
        F.when(d % 10 == 0, "read it").alias("review"), F.when(d % 3 == 0, talk).alias("conversation"),
    )
    return S.turns(S.parse_cases(table(spark, sf_dir, "documents").select(F.to_json(case).alias("json")), "json"))


_DUCK_SPEC = """own AS (SELECT CASE WHEN doc_id % 50 = 7 THEN '' WHEN doc_id % 40 = 3 THEN concat('same-', lang) ELSE concat('c', doc_id) END AS id, lang AS category,
  CASE WHEN doc_id % 60 <> 11 THEN source END AS prompt, doc_id % 5 > 0 AS judged, CASE WHEN doc_id % 10 = 0 THEN 'read it' END AS review FROM documents WHERE doc_id % 3 > 0),
talk AS (SELECT concat('c', doc_id, '.', i - 1) AS id, NULL AS category, string_split(text, chr(10))[i] AS prompt, false AS judged, 'look' AS review
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE doc_id % 3 = 0)),
turns AS (SELECT * FROM own UNION ALL SELECT * FROM talk)"""


@query("spec_turns_s4", f"WITH {_DUCK_SPEC} SELECT id, category, prompt, review FROM turns")
def spec_turns(spark, sf_dir):
    return _spec(spark, sf_dir).select("id", "category", "prompt", "review")


@query(
    "spec_problems_v4",
    f"""WITH {_DUCK_SPEC} SELECT 'no id' AS rule, id FROM turns WHERE id = '' UNION ALL SELECT 'no prompt', id FROM turns WHERE prompt IS NULL
UNION ALL SELECT 'nothing judges it', id FROM turns WHERE NOT judged AND review IS NULL
UNION ALL SELECT 'repeated id', id FROM turns WHERE id <> '' GROUP BY id HAVING count(*) > 1""",
)
def spec_problems(spark, sf_dir):
    return E.spec_problems(_spec(spark, sf_dir))


@query("latest_results_s5", f"SELECT id, ms, error FROM ({_RESULTS}) WHERE conv_id % 3 = 2")
def latest_results(spark, sf_dir):
    """Three runs written as result files; the newest is read back."""
    root = new_path(spark, "results")
    runs = results(spark, sf_dir)
    for i in range(3):
        runs.where(F.col("run") == i).drop("run").write.json(f"{root}/raw-2026-0{i + 1}-01.jsonl")
    return S.latest_results(spark, root).select("id", "ms", "error")
