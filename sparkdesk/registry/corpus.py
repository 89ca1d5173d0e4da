"""Queries over corpora, packages, inventories and page layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdesk.operators import corpus as K, layout as Y, packages as G, validate as V
from sparkdesk.plans.derive import DUCK_LINES, run
from sparkdesk.registry.core import query, table
from sparkdesk.registry.pages import _DUCK_OUTCOMES, outcomes
from sparkdesk.registry.text import TRIM
from sparkdesk.session import new_path
from sparkdesk.sources import conversations as SC, corpus as S


# --- stored conversations ------------------------------------------------------

def conversation_json(spark, sf_dir):
    """(doc_id, json): each document as a stored conversation, its lines as turns."""
    d = F.col("doc_id")
    turns = F.transform(F.split("text", "\n"), lambda s, i: F.struct(
        F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), s.alias("text"), (i * 1000).cast("long").alias("at"),
        F.when(i % 5 == 0, F.array(F.struct(F.lit("text").alias("kind"), F.lit("a.txt").alias("name"), s.alias("content")))).alias("attachments"),
    ))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(
        F.when(d % 20 == 3, 2).otherwise(1).alias("schema"), F.concat(F.lit("c"), d).alias("id"), F.lit("t").alias("title"),
        F.lit("2024-01-01T00:00:00Z").alias("updated_at"), turns.alias("messages"),
    )).alias("json"))


@query(
    "stored_messages_s1",
    f"""SELECT concat('c', doc_id) AS conv_id, page_no - 1 AS turn, CASE WHEN page_no % 2 = 1 THEN 'user' ELSE 'assistant' END AS role, element AS text,
 CASE WHEN (page_no - 1) % 5 = 0 THEN 1 ELSE 0 END AS n_attachments, (page_no - 1) * 1000 AS at FROM ({DUCK_LINES}) WHERE doc_id % 20 <> 3""",
)
def stored_messages(spark, sf_dir):
    """Written as JSON text and read back through the source; newer files are left out."""
    path = new_path(spark, "conversations")
    conversation_json(spark, sf_dir).select(F.col("json").alias("value")).write.text(path)
    return SC.messages(SC.read_conversations(spark, path, one_per_file=False)).select(
        "conv_id", "turn", "role", "text", F.size(F.coalesce("attachments", F.array())).alias("n_attachments"), "at"
    )


@query(
    "import_problems_v3",
    """SELECT * FROM (SELECT doc_id AS file_id, CASE doc_id % 12 WHEN 0 THEN 'not a conversation' WHEN 1 THEN 'no messages' WHEN 2 THEN 'newer schema' WHEN 3 THEN 'no sender'
 WHEN 4 THEN 'unknown sender' WHEN 5 THEN 'image not inline' WHEN 6 THEN 'content instead of text' WHEN 7 THEN 'nothing to show' WHEN 8 THEN 'not a conversation' END AS rule FROM documents) WHERE rule IS NOT NULL
 UNION ALL SELECT doc_id, 'too many messages' FROM documents WHERE doc_id % 120 = 9""",
)
def import_problems(spark, sf_dir):
    """With a message limit that some of the files pass."""
    k, doc = F.col("doc_id") % 12, F.to_json(F.struct(F.col("text").alias("text")))
    body = F.substr(doc, F.lit(2), F.length(doc) - 2)

    def one(fields):
        return F.concat(F.lit('{"schema":1,"messages":[{'), fields, F.lit("}]}"))

    many = F.concat(F.lit('{"messages":['), F.repeat(F.lit('{"role":"user","text":"x"},'), 40), F.lit('{"role":"user","text":"x"}]}'))
    json = (
        F.when(k == 0, F.concat(F.lit("# "), F.col("lang"))).when(k == 8, F.concat(F.lit("["), doc, F.lit("]")))
        .when(k == 1, F.concat(F.lit('{"messages":'), doc, F.lit("}")))
        .when(k == 2, F.concat(F.lit('{"schema":2,"messages":[{"role":"user",'), body, F.lit("}]}")))
        .when(k == 3, one(body)).when(k == 4, one(F.concat(F.lit('"role":"tool",'), body)))
        .when(k == 5, one(F.concat(F.lit('"role":"user","attachments":[{"kind":"image","name":"x","dataUrl":"https://example.com/x.png"}],'), body)))
        .when(k == 6, one(F.concat(F.lit('"role":"user",'), F.replace(body, F.lit('"text":'), F.lit('"content":')))))
        .when(k == 7, one(F.lit('"role":"user"')))
        .when(F.col("doc_id") % 120 == 9, many)
        .otherwise(one(F.concat(F.lit('"role":"user","attachments":[{"kind":"image","name":"x","dataUrl":"data:image/png;base64,AA"}],'), body)))
    )
    return V.import_problems(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), json.alias("json")), max_messages=40)


# --- corpus manifests ------------------------------------------------------------

def manifest_rows(spark, sf_dir):
    d = F.col("doc_id")
    content = F.encode(F.when(d % 13 == 1, F.col("text")).otherwise(F.concat(F.lit("%PDF-1.7\n"), F.when(d % 17 == 1, F.lit("the same")).otherwise(F.concat("text", d)))), "utf-8")
    sha = F.sha2(content, 256)
    return table(spark, sf_dir, "documents").select(
        F.when(d % 23 == 1, F.concat(F.lit("bad id "), d)).when(d % 19 == 1, F.concat(F.lit("same-"), "lang")).otherwise(F.concat(F.lit("d-"), d)).alias("id"),
        F.concat("source", F.lit("/"), d).alias("path"), "source", F.col("lang").alias("category"),
        F.when(d % 29 != 1, "crawl").alias("provenance"),
        F.when(d % 31 == 1, F.upper(sha)).when(d % 37 == 1, F.sha2(F.lit(b"x"), 256)).otherwise(sha).alias("sha256"),
        content.alias("content"), d.alias("doc_id"),
    )


_MANIFEST = """m AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 23 = 1 THEN concat('bad id ', doc_id) WHEN doc_id % 19 = 1 THEN concat('same-', lang) ELSE concat('d-', doc_id) END AS id,
  CASE WHEN doc_id % 29 <> 1 THEN 'crawl' END AS provenance, CASE WHEN doc_id % 13 = 1 THEN text ELSE concat('%PDF-1.7', chr(10), CASE WHEN doc_id % 17 = 1 THEN 'the same' ELSE concat(text, doc_id) END) END AS content FROM documents),
h AS (SELECT *, CASE WHEN doc_id % 31 = 1 THEN upper(sha256(content)) WHEN doc_id % 37 = 1 THEN sha256('x') ELSE sha256(content) END AS sha FROM m)"""


@query(
    "manifest_problems_v2",
    f"""WITH {_MANIFEST} SELECT 'invalid id' AS rule, id FROM h WHERE id LIKE 'bad id%' UNION ALL SELECT 'missing field', id FROM h WHERE provenance IS NULL
UNION ALL SELECT 'bad hash form', id FROM h WHERE NOT regexp_full_match(sha, '[a-f0-9]{{64}}') UNION ALL SELECT 'too large', id FROM h WHERE strlen(content) > 4000
UNION ALL SELECT 'not a PDF', id FROM h WHERE strlen(content) <= 4000 AND NOT contains(left(content, 1024), '%PDF-')
UNION ALL SELECT 'hash mismatch', id FROM h WHERE strlen(content) <= 4000 AND sha = lower(sha) AND sha <> sha256(content)
UNION ALL SELECT 'repeated id', id FROM h GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'repeated bytes', min(id) FROM h GROUP BY sha HAVING count(*) > 1""",
)
def manifest_problems(spark, sf_dir):
    """With a size limit that some of the documents pass."""
    return K.manifest_problems(manifest_rows(spark, sf_dir), max_bytes=4000)


@query(
    "manifest_documents_s7",
    f"WITH {_MANIFEST} SELECT doc_id AS manifest_id, id, lang AS category, sha AS sha256 FROM h WHERE doc_id % 10 > 0 UNION ALL SELECT doc_id, 'extra', lang, NULL FROM h WHERE doc_id % 10 > 0",
)
def manifest_documents(spark, sf_dir):
    rows = manifest_rows(spark, sf_dir)
    doc = F.struct("id", "path", "source", "category", "provenance", "sha256")
    extra = F.struct(F.lit("extra").alias("id"), F.col("path"), F.col("source"), F.col("category"), F.col("provenance"), F.lit(None).cast("string").alias("sha256"))
    json = F.to_json(F.struct(F.when(F.col("doc_id") % 10 == 0, 2).otherwise(1).alias("version"), F.array(doc, extra).alias("documents")))
    return S.parse_manifests(rows.select("doc_id", json.alias("json")), "doc_id", "json").select("manifest_id", "id", "category", "sha256")


_FILES = """SELECT concat(lang, '/', CASE WHEN doc_id % 15 = 0 THEN '.cache' ELSE source END, CASE WHEN doc_id % 16 = 1 THEN '/.hidden-' ELSE '/doc-' END, CAST(doc_id AS VARCHAR(20)), '.txt') AS path, length(text) AS size FROM documents"""
_INVENTORY = f"""f AS (SELECT * FROM ({_FILES}) WHERE NOT regexp_matches(path, '(^|/)\\.')),
 i AS (SELECT path, false AS is_dir, size FROM f UNION SELECT string_split(path, '/')[1], true, 0 FROM f UNION SELECT concat(string_split(path, '/')[1], '/', string_split(path, '/')[2]), true, 0 FROM f)"""


@query("file_inventory_s9", f"WITH {_INVENTORY} SELECT * FROM i ORDER BY path LIMIT 400")
def file_inventory(spark, sf_dir):
    return S.inventory(run(spark, sf_dir, _FILES, "documents"))


@query("whole_inventory_s9", f"WITH {_INVENTORY} SELECT * FROM i")
def whole_inventory(spark, sf_dir):
    return S.inventory(run(spark, sf_dir, _FILES, "documents"), limit=None)


@query(
    "review_sheet_s11",
    f"WITH {_DUCK_OUTCOMES} SELECT concat('d', doc_id) AS id, sha256(concat('d', doc_id)) AS sha256, outcome, 'unreviewed' AS verdict FROM r",
)
def review_sheet(spark, sf_dir):
    """A run's outputs written, then its review sheet read back."""
    results = outcomes(spark, sf_dir).select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.sha2(F.concat(F.lit("d"), "doc_id"), 256).alias("sha256"), "outcome"
    )
    path = new_path(spark, "run")
    S.write_run(results, results.groupBy("outcome").count(), path)
    return spark.read.schema("id string, sha256 string, outcome string, verdict string").json(f"{path}/review")


# --- reader records ---------------------------------------------------------------

# what the runs send, by document number modulo ten: c, p readers (C, P with nothing readable), e the end, b a broken line,
# l a list, n a note, o another reader, s a body of plain strings, t a negative time
_SEQUENCES = ["cpe", "ccpe", "pce", "cep", "cpec", "cbpe", "lCn", "Cos", "cp", "cte"]
_ERRORS = [
    [None] * 3, [None, "reader repeated", None, None], ["optional reader first", None, None],
    [None, "end too early", None], [None, None, None, "after the end"], [None, "malformed", None, None],
    ["not an object", None, "unknown record"], [None, "invalid reader", "invalid reader"], [None, None],
    [None, "invalid reader", "end too early"],
]


def _values(rows):
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({k}, {i}, {lit(x)})" for k, seq in enumerate(rows) for i, x in enumerate(seq))


def record_lines(spark, sf_dir):
    """Every document is a run of two readers over its lines as pages; every 11th page fails, in every 8th document
    all do, and the second reader misses the last page of every third document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    d, n = F.col("doc_id"), F.size("lines")

    def page(x, i):
        failed = (d % 8 == 0) | ((d + i) % 11 == 0)
        return F.when(failed, F.to_json(F.struct(F.lit("no text").alias("Err")))).otherwise(F.to_json(F.struct(x.alias("Ok"))))

    def blank(x, i):
        return F.lit('{"Ok":"  "}')

    def body(name, ms, ok):
        return F.concat(F.lit(f'{{"record":"reader","reader":"{name}","elapsedMs":{ms},"result":{{"Ok":'), ok, F.lit("}}"))

    def current(of):
        pairs = F.transform("lines", lambda x, i: F.concat(F.lit("["), i + 1, F.lit(","), of(x, i + 1), F.lit("]")))
        return body("current", 5.0, F.concat(F.lit("[["), F.array_join(pairs, ","), F.lit("],true]")))

    def optional(of, ms=2.5):
        seen = F.slice("lines", F.lit(1), F.when(d % 3 == 0, n - 1).otherwise(n))
        return body("pdfkit", ms, F.concat(F.lit("["), F.array_join(F.transform(seen, lambda x, i: of(x, i + 1)), ","), F.lit("]")))

    sent = {
        "c": current(page), "C": current(blank), "p": optional(page), "P": optional(blank), "e": F.lit('{"record":"end","readers":2}'),
        "b": F.lit('{"record":'), "l": F.lit("[1]"), "n": F.lit('{"record":"note"}'), "o": body("other", 1.0, F.lit("[]")),
        "s": body("current", 5.0, F.to_json("lines")), "t": optional(page, -1.0),
    }
    kind = F.element_at(F.array(*[F.lit(x) for x in _SEQUENCES]), (d % 10 + 1).cast("int"))
    each = docs.select("doc_id", "lines", F.posexplode(F.regexp_extract_all(kind, F.lit("."), F.lit(0))).alias("seq", "kind"))
    line = F.lit(None).cast("string")
    for k, v in sent.items():
        line = F.when(F.col("kind") == k, v).otherwise(line)
    return each.select(F.col("doc_id").alias("run_id"), "seq", line.alias("line"))


_RUNS = f"""k AS (SELECT doc_id, text, unnest(string_split(s, '')) AS kind, unnest(range(0, len(s))) AS seq FROM documents
  JOIN (VALUES {", ".join(f"({i}, '{x}')" for i, x in enumerate(_SEQUENCES))}) AS v(m, s) ON doc_id % 10 = m),
pages AS (SELECT doc_id, page_no, element, doc_id % 8 = 0 OR (doc_id + page_no) % 11 = 0 AS failed, count(*) OVER (PARTITION BY doc_id) AS n FROM ({DUCK_LINES})),
seen AS (SELECT doc_id, bool_or(regexp_matches(element, '[^\\s]')) AS c, bool_or(regexp_matches(element, '[^\\s]') AND NOT (doc_id % 3 = 0 AND page_no = n)) AS p
  FROM pages WHERE NOT failed GROUP BY doc_id)"""


@query(
    "parsed_records_s8",
    f"""WITH {_RUNS} SELECT doc_id AS run_id, seq, CASE kind WHEN 'b' THEN 'malformed' WHEN 'l' THEN 'not an object' END AS problem,
 CASE WHEN kind IN ('c', 'C', 's') THEN 'current' WHEN kind IN ('p', 't') THEN 'pdfkit' WHEN kind = 'o' THEN 'other' END AS reader,
 CASE WHEN kind IN ('c', 'C') THEN len(string_split(text, chr(10))) WHEN kind IN ('p', 't') THEN len(string_split(text, chr(10))) - CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END END AS pages
FROM k""",
)
def parsed_records(spark, sf_dir):
    return S.parse_records(record_lines(spark, sf_dir)).select(
        "run_id", "seq", "problem", F.col("r.reader").alias("reader"), F.size("r.result.pages").cast("long").alias("pages")
    )


@query(
    "record_errors_w24",
    f"SELECT doc_id AS run_id, seq, error FROM documents JOIN (VALUES {_values(_ERRORS)}) AS v(k, seq, error) ON doc_id % 10 = k",
)
def record_errors(spark, sf_dir):
    return K.record_states(S.parse_records(record_lines(spark, sf_dir))).select("run_id", "seq", "error")


@query(
    "comparison_classes_k5",
    f"""WITH {_RUNS} SELECT d.doc_id AS run_id, CASE WHEN d.doc_id % 10 = 0 AND d.doc_id % 7 <> 0 THEN 'success'
 WHEN d.doc_id % 10 IN (6, 7) THEN 'failed' WHEN coalesce(seen.c, false) OR (d.doc_id % 10 <> 9 AND coalesce(seen.p, false)) THEN 'partial' ELSE 'failed' END AS class
 FROM documents d LEFT JOIN seen USING (doc_id)""",
)
def comparison_classes(spark, sf_dir):
    states = K.record_states(S.parse_records(record_lines(spark, sf_dir)))
    processes = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("run_id"), F.lit(0).alias("status"), F.when(F.col("doc_id") % 7 == 0, "SIGKILL").alias("signal"),
        F.lit(None).cast("string").alias("reason"), F.lit(True).alias("exit_confirmed"),
    )
    return K.comparison_classes(states, processes).select("run_id", "class")


# --- packages and trees ---------------------------------------------------------------

_ITEMS = "(SELECT DISTINCT l_orderkey AS p, l_linenumber AS n FROM lineitem)"


@query(
    "package_problems_j9",
    f"""WITH i AS (SELECT * FROM {_ITEMS})
SELECT p AS package_id, 'undeclared part' AS rule, concat('word/item', n, '.xml') AS item FROM i WHERE n <> 6 AND n = 3 AND p % 3 > 0
UNION ALL SELECT p, 'declared but missing', concat('/word/item', n, '.xml') FROM i WHERE n = 6
UNION ALL SELECT p, 'dangling target', CASE n WHEN 4 THEN 'gone4.xml -> word/gone4.xml' ELSE 'http://example.com/x -> word/http:/example.com/x' END FROM i WHERE n IN (4, 7)
UNION ALL SELECT DISTINCT p, 'undeclared relationship', 'word/document.xml: rId99' FROM i WHERE p % 4 = 0""",
)
def package_problems(spark, sf_dir):
    """Every order is a package whose lines are its parts."""
    i = run(spark, sf_dir, "SELECT DISTINCT l_orderkey AS package_id, l_linenumber AS n FROM lineitem", "lineitem")
    n = F.col("n")
    item = F.concat(F.lit("word/item"), n, F.lit(".xml"))
    packages = i.select("package_id").distinct()
    fixed = packages.select("package_id", F.explode(F.array(*[F.lit(x) for x in ("word/document.xml", "word/_rels/document.xml.rels", G.CONTENT_TYPES)])).alias("name"))
    parts = i.where("n <> 6").select("package_id", item.alias("name")).unionByName(fixed)
    overrides = i.where("n <> 3").select("package_id", F.concat(F.lit("/"), item).alias("part_name")).unionByName(
        packages.select("package_id", F.lit("/word/document.xml").alias("part_name")))
    defaults = packages.select("package_id", F.lit("rels").alias("extension")).unionByName(
        packages.where("package_id % 3 = 0").select("package_id", F.lit("xml").alias("extension")))
    target = (
        F.when(n == 1, "item1.xml").when(n == 2, "/word/item2.xml").when(n == 3, "../word/./item3.xml").when(n == 4, "gone4.xml")
        .when((n == 5) | (n == 7), "http://example.com/x").otherwise("document.xml")
    )
    rels = i.select(
        "package_id", F.lit("word/_rels/document.xml.rels").alias("rels_name"), F.concat(F.lit("rId"), n).alias("rel_id"),
        target.alias("target"), (n == 5).alias("external"))
    uses = i.select("package_id", F.lit("word/document.xml").alias("part"), F.concat(F.lit("rId"), n).alias("rel_id")).unionByName(
        packages.where("package_id % 4 = 0").select("package_id", F.lit("word/document.xml").alias("part"), F.lit("rId99").alias("rel_id")))
    return G.package_problems(parts, overrides, defaults, rels, uses)


_PATHS = "SELECT concat(lang, '/', source, '/doc-', CAST(doc_id AS VARCHAR(20)), '.md') AS path, lang, source, doc_id FROM documents"
_RULES = """SELECT DISTINCT concat(lang, '/') AS rule, 'public' AS list FROM documents WHERE lang IN ('en', 'fr')
UNION ALL SELECT DISTINCT concat(lang, '/', source, '/'), 'withheld' FROM documents WHERE source IN ('src1', 'src2')
UNION ALL SELECT concat(lang, '/', source, '/doc-', CAST(doc_id AS VARCHAR(20)), '.md'), 'public' FROM documents WHERE doc_id % 50 = 0
UNION ALL SELECT DISTINCT concat('old/', source, '/'), 'public' FROM documents"""


def _publishing(spark, sf_dir):
    return run(spark, sf_dir, _PATHS, "documents"), run(spark, sf_dir, _RULES, "documents")


@query(
    "publication_status_j10",
    f"""SELECT path, CASE WHEN source IN ('src1', 'src2') THEN 'withheld' WHEN lang IN ('en', 'fr') OR doc_id % 50 = 0 THEN 'public' ELSE 'unclassified' END AS status FROM ({_PATHS})""",
)
def publication_status(spark, sf_dir):
    return G.publication(*_publishing(spark, sf_dir))


@query("dead_rules_j10", "SELECT DISTINCT concat('old/', source, '/') AS rule, 'public' AS list FROM documents")
def dead_rules(spark, sf_dir):
    return G.dead_rules(*_publishing(spark, sf_dir))


@query(
    "payload_digests_a16",
    """WITH e AS (SELECT doc_id // 100 AS set_id, concat(source, '/', doc_id) AS path, encode(concat(source, '/', doc_id)) || '\\x00'::BLOB
   || encode(CASE WHEN doc_id % 3 = 0 THEN '100755' ELSE '100644' END) || '\\x00'::BLOB || unhex(sha256(text)) AS entry FROM documents),
l AS (SELECT set_id, count(*) AS files, list(entry ORDER BY path) AS l FROM e GROUP BY set_id)
SELECT set_id, files, sha256(list_reduce(l, lambda a, b: a || b)) AS digest FROM l""",
)
def payload_digests(spark, sf_dir):
    """Sets of a hundred documents."""
    return G.payload_digests(table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 100).alias("set_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        (F.col("doc_id") % 3 == 0).alias("executable"), F.encode("text", "utf-8").alias("content"),
    ))


_PACKAGES = """SELECT concat('pkg-', CAST(l_partkey % 500 AS VARCHAR(20))) AS name, concat('1.', CAST(l_linenumber AS VARCHAR(4))) AS version, l_returnflag AS target,
 CASE WHEN l_suppkey % 5 > 0 THEN concat('licence ', CAST(l_suppkey % 5 AS VARCHAR(4))) END AS license,
 CASE WHEN l_suppkey % 2 = 0 THEN concat('git+https://example.com/', CAST(l_partkey % 500 AS VARCHAR(20)), '.git') END AS repository FROM lineitem"""
_DUCK_INVENTORY = f"""inv AS (SELECT name, version, coalesce(license, 'UNKNOWN') AS license, regexp_replace(regexp_replace(coalesce(repository, ''), '^git\\+', ''), '\\.git$', '') AS repository
 FROM (SELECT *, row_number() OVER (PARTITION BY name, version ORDER BY target DESC, coalesce(license, '') DESC, coalesce(repository, '') DESC) AS r FROM ({_PACKAGES})) WHERE r = 1)"""


@query("package_inventory_a17", f"WITH {_DUCK_INVENTORY} SELECT * FROM inv")
def package_inventory(spark, sf_dir):
    return G.package_inventory(run(spark, sf_dir, _PACKAGES, "lineitem"))


@query("inventory_summary_a17", f"WITH {_DUCK_INVENTORY} SELECT count(*) AS packages, count(*) FILTER (license = 'UNKNOWN') AS unknown FROM inv")
def inventory_summary(spark, sf_dir):
    return G.inventory_summary(G.package_inventory(run(spark, sf_dir, _PACKAGES, "lineitem")))


@query(
    "unlisted_dependencies_a17",
    "SELECT concat('pkg-', p_partkey % 700) AS name, p_partkey FROM part WHERE p_partkey % 700 NOT IN (SELECT l_partkey % 500 FROM lineitem)",
)
def unlisted_dependencies(spark, sf_dir):
    direct = table(spark, sf_dir, "part").select(F.concat(F.lit("pkg-"), F.col("p_partkey") % 700).alias("name"), "p_partkey")
    return G.unlisted_dependencies(direct, G.package_inventory(run(spark, sf_dir, _PACKAGES, "lineitem")))


# --- text checks --------------------------------------------------------------------

@query(
    "text_markers_v7",
    r"""SELECT * FROM (
 SELECT doc_id, 1 AS line_no, CASE doc_id % 9 WHEN 0 THEN 'draft banner' WHEN 1 THEN 'maintainer heading' WHEN 2 THEN 'reference' END AS rule,
  CASE doc_id % 9 WHEN 0 THEN concat('# ', source, ' outline') WHEN 1 THEN concat('# ', source, ' reviewer checklist') WHEN 2 THEN 'private/repo' END AS found FROM documents
 UNION ALL SELECT doc_id, 2, CASE doc_id % 7 WHEN 0 THEN 'placeholder' WHEN 1 THEN 'draft banner' WHEN 2 THEN 'withheld link' END,
  CASE doc_id % 7 WHEN 0 THEN '[Confirm this date]' WHEN 1 THEN '**Status: draft**' WHEN 2 THEN '[notes](../docs/NOTES.md#a)' END FROM documents) WHERE rule IS NOT NULL""",
)
def text_markers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit("# "), "source",
            F.when(F.col("doc_id") % 9 == 0, " outline").when(F.col("doc_id") % 9 == 1, " reviewer checklist")
            .when(F.col("doc_id") % 9 == 2, " see private/repo").otherwise(""), F.lit("\n"),
            F.when(F.col("doc_id") % 7 == 0, "[Confirm this date] and [GAP] and [x] and [Link text](a.md)")
            .when(F.col("doc_id") % 7 == 1, "**Status: draft**").when(F.col("doc_id") % 7 == 2, "see [notes](../docs/NOTES.md#a) now").otherwise("plain"),
            F.lit(f"\n{V.PUBLIC_END}\n# internal todo\n"), "text",
        ).alias("text"),
    )
    # the given text as it is, before and after the end of the public part
    given = table(spark, sf_dir, "documents").select((-F.col("doc_id") - 1).alias("doc_id"), "text")
    return V.text_markers(docs.unionByName(given), ["private/repo"], ["NOTES.md", "PLAN.md"])


_HEAD = "concat(text, chr(10), chr(10), '|a|b|', chr(10), '|---|:-:|', chr(10), '|1|2|'"
_TABLED = f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {_HEAD}, chr(10), '|3|4|', chr(10), 'end') WHEN 1 THEN {_HEAD}, chr(10), chr(10), '|3|4|', chr(10))
 WHEN 2 THEN {_HEAD}, chr(10), '| - | - |', chr(10), '|5|6|', chr(10), chr(10), ' |7|8|') ELSE {_HEAD}, chr(10), chr(10), 'prose | here', chr(10), chr(10), '|9|') END AS text FROM documents
UNION ALL SELECT -doc_id - 1 AS doc_id, text FROM documents
UNION ALL SELECT doc_id + 1000000000 AS doc_id, replace(replace(text, ' ', ' | '), '. ', concat('.', chr(10), chr(10), '| ')) AS text FROM documents"""


@query(
    "broken_tables_v6",
    rf"""WITH l AS (SELECT doc_id, i - 1 AS line_no, trim(raw, {TRIM}) AS line FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS raw FROM ({_TABLED}))),
r AS (SELECT *, line LIKE '|%' AS is_row, regexp_matches(line, '^\|[\s|:-]+\|$') AND coalesce(lag(line LIKE '|%') OVER (PARTITION BY doc_id ORDER BY line_no), false) AS separator FROM l),
s AS (SELECT *, sum(CASE WHEN separator THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS seen FROM r),
c AS (SELECT *, coalesce(max(seen) FILTER (NOT is_row) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS at_start FROM s),
a AS (SELECT doc_id, line_no, is_row, lag(is_row) OVER w AS above, lag(line_no) OVER w AS above_no, lag(seen) OVER w - lag(at_start) OVER w AS tables FROM c WHERE line <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no + 1 AS line_no, CAST(tables AS BIGINT) AS separators FROM a WHERE is_row AND above AND line_no - above_no > 1 AND tables > 0""",
)
def broken_tables(spark, sf_dir):
    """Tables below the given text whole, cut once, two in one and cut, and followed by prose; the given text alone, and with rows made of it."""
    return V.broken_tables(run(spark, sf_dir, _TABLED, "documents"))


# --- page layout ----------------------------------------------------------------------

def fragments(spark, sf_dir):
    """Words of a document laid out eight to a line and forty lines to a page;
    every sixth document is in two columns."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    i = F.col("i")
    col, line = i % 8, F.floor(i / 8)
    wide = F.when((F.col("doc_id") % 6 == 0) & (col >= 4), 0.13).otherwise(0.0)
    left = 0.02 + col * 0.1 + wide
    top = 0.98 - (line % 40) * 0.024 + (i % 3) * 0.001
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("i", "text")).select(
        (F.col("doc_id") * 1000 + F.floor(line / 40)).alias("page_id"), (top - 0.018).alias("min_y"), top.alias("max_y"),
        left.alias("min_x"), (left + 0.09).alias("max_x"), "text",
    )


_WORDS = f"""w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, doc_id * 1000 + (i - 1) // 320 AS page_id, (i - 1) // 8 AS line, ws[i] AS word, i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
ln AS (SELECT doc_id, page_id, line, count(*) AS n, string_agg(trim(word, {TRIM}), ' ' ORDER BY i) AS text FROM x GROUP BY ALL),
pg AS (SELECT doc_id, page_id, count(*) FILTER (n > 4) AS wide, string_agg(text, chr(10) ORDER BY line) AS text FROM ln GROUP BY ALL)"""


@query("reading_order_w12", f"WITH {_WORDS} SELECT page_id, CASE WHEN NOT (doc_id % 6 = 0 AND wide >= 3) THEN text END AS text, CASE WHEN doc_id % 6 = 0 AND wide >= 3 THEN '{Y.MANY_COLUMNS}' END AS error FROM pg")
def reading_order(spark, sf_dir):
    return Y.reading_order(fragments(spark, sf_dir))


@query("column_gutters_j12", f"WITH {_WORDS} SELECT page_id, CAST(wide AS BIGINT) AS aligned FROM pg WHERE doc_id % 6 = 0 AND wide >= 3")
def column_gutters(spark, sf_dir):
    rows = Y.text_lines(Y.line_pieces(fragments(spark, sf_dir)))
    return Y.gutters(rows.select("page_id", F.explode("gaps").alias("gap"))).groupBy("page_id").agg(F.max("aligned").alias("aligned"))
