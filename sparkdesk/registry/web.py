"""Queries over web pages and captured connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdesk.operators import network as N, web as W
from sparkdesk.plans.derive import run
from sparkdesk.registry.core import query, table
from sparkdesk.registry.text import TRIM, quoted
from sparkdesk.session import new_path
from sparkdesk.sources.captures import read_captures

_LINKS = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN concat('https://u:p@', host, '/') WHEN 1 THEN concat('https://', host, ':8443/x') WHEN 2 THEN 'javascript:alert(1)'
 WHEN 3 THEN concat('ftp://', host, '/f') WHEN 4 THEN 'no address at all' WHEN 5 THEN concat('  https://', host, '/ok  ') WHEN 6 THEN 'https:///path' ELSE url END AS url
 FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?://', ''), '[/?#].*$', '') AS host FROM pages) AS p"""
_PROBLEM = """CASE page_id % 8 WHEN 0 THEN 'carries credentials' WHEN 1 THEN {one} WHEN 2 THEN {not_scheme} WHEN 3 THEN {not_scheme}
 WHEN 4 THEN 'is not a valid address' WHEN 5 THEN {five} WHEN 6 THEN 'names no host' ELSE CASE WHEN url LIKE 'http://%' THEN {plain} ELSE {five} END END"""


@query(
    "vetted_links_k11",
    "SELECT page_id, " + _PROBLEM.format(one="NULL", not_scheme="'not https or http'", five="NULL", plain="NULL")
    + f" AS problem FROM ({_LINKS})",
)
def vetted_links(spark, sf_dir):
    return W.vetted(run(spark, sf_dir, _LINKS, "pages"), "url", schemes=("https", "http")).select("page_id", "problem")


@query(
    "pinned_links_k11",
    "SELECT page_id, " + _PROBLEM.format(one="'names another host'", not_scheme="'not https'", five="'names another host'", plain="'not https'")
    + f" AS problem FROM ({_LINKS})",
)
def pinned_links(spark, sf_dir):
    return W.vetted(run(spark, sf_dir, _LINKS, "pages"), "url", pinned_host="downloads.example.org").select("page_id", "problem")


_ANCHORED = """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(html, 'href="/', 'href="mailto:') WHEN page_id % 2 = 0
  THEN replace(html, 'href="/', concat('href="HTTPS://Site', CAST(page_id % 7 AS VARCHAR(4)), '.example.com:443/a/long/way/to/somewhere/in/the/archive/of/pages/', CAST(page_id AS VARCHAR(9)), '/'))
  ELSE html END AS html FROM pages"""
_ODD = r"""[^\x{21}-\x{7E}]|["<>`{}^]"""


@query(
    "anchors_k12",
    rf"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s(?:[^>]*\s)?href\s*=\s*"([^"]*)"', 1) AS hs FROM ({_ANCHORED})),
a AS (SELECT page_id, CAST(i - 1 AS INT) AS pos, hs[i] AS href FROM (SELECT *, unnest(range(1, len(hs) + 1)) AS i FROM h)),
p AS (SELECT *, CASE WHEN href LIKE 'HTTPS://%' THEN lower(regexp_extract(href, '^HTTPS://([^/:]*)', 1)) END AS host,
 CASE WHEN href LIKE 'HTTPS://%' THEN array_to_string(list_transform(regexp_extract_all(regexp_extract(href, '^HTTPS://[^/]*([^?#]*)', 1), '(?s).'),
   lambda c: CASE WHEN regexp_matches(c, '{_ODD}') THEN url_encode(c) ELSE c END), '') WHEN href LIKE 'mailto:%' THEN regexp_extract(href, '^mailto:([^?#]*)', 1) END AS path FROM a)
SELECT *, CASE WHEN path IS NULL THEN NULL WHEN length(concat(host, path)) > 80 THEN concat('Opens ', left(concat(host, path), 80), '…') ELSE concat('Opens ', host, path) END AS label,
 href NOT LIKE 'mailto:%' AS allowed FROM p""",
)
def anchors(spark, sf_dir):
    return W.anchors(run(spark, sf_dir, _ANCHORED, "pages"))


_BARE = r"""regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)(<(?:script|style)\b[^>]*>).*?</(?:script|style)\s*>', '\1', 'g')"""


@query(
    "disallowed_markup_k13",
    rf"""WITH t AS (SELECT page_id, unnest(regexp_extract_all({_BARE}, '<[a-zA-Z][^>]*>')) AS tag FROM pages),
n AS (SELECT page_id, 'tag' AS kind, lower(regexp_extract(tag, '^<([a-zA-Z][a-zA-Z0-9:-]*)', 1)) AS name FROM t
 UNION ALL SELECT page_id, 'attribute', lower(unnest(regexp_extract_all(regexp_replace(tag, '"[^"]*"|''[^'']*''', '', 'g'), '[\s/]([a-zA-Z_:@][^\s=/>]*)', 1))) FROM t)
SELECT page_id, kind, name, count(*) AS count FROM n
WHERE NOT (CASE WHEN kind = 'tag' THEN name IN ({quoted(W.ALLOWED_TAGS)}) ELSE name IN ({quoted(W.ALLOWED_ATTRIBUTES)}) END) GROUP BY ALL""",
)
def disallowed_markup(spark, sf_dir):
    return W.disallowed_markup(table(spark, sf_dir, "pages"))


_NESTED = "SELECT page_id, CASE WHEN page_id % 40 = 0 THEN concat(repeat('<div>', 600), html) ELSE html END AS html FROM pages"
_DECODE = "t"
for _e, _c in W._ENTITIES:
    _DECODE = f"replace({_DECODE}, '{_e}', '{_c if _c != chr(39) else chr(39) * 2}')"


@query(
    "readable_pages_k14",
    rf"""WITH d AS (SELECT page_id, html, CASE WHEN strlen(html) > 8000 THEN 'too large' WHEN page_id % 40 = 0 THEN 'nested too deep' END AS refused FROM ({_NESTED})),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
  '(?is)<(?:script|style|head)\b[^>]*>.*?</(?:script|style|head)\s*>', '', 'g'),
  '(?i)<(?:br|/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|nav|footer|section|header))\b[^>]*>', chr(10), 'g'), '<[a-zA-Z/!][^>]*>', '', 'g') AS t FROM d),
e AS (SELECT *, regexp_replace({_DECODE}, '[ \t\r]+', ' ', 'g') AS u FROM s)
SELECT page_id, CASE WHEN refused IS NULL THEN trim(regexp_replace(u, ' ?\n[ \n]*', chr(10), 'g'), {TRIM}) END AS text, refused FROM e""",
)
def readable_pages(spark, sf_dir):
    """With a size limit that some of the pages pass."""
    return W.readable_pages(run(spark, sf_dir, _NESTED, "pages"), max_bytes=8000)


# --- captured connections ----------------------------------------------------

_NETS = ["10.0.0.", "100.64.0.", "192.168.1.", "203.0.113.", "51.15.0.", "140.82.112."]
_IP = "concat(CASE user_id % 6 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NETS)) + " END, CAST(user_id % 250 AS VARCHAR(4)))"
_CAPTURES = f"""SELECT CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'chat' WHEN 'error' THEN 'document' WHEN 'signup' THEN 'pricing' ELSE 'web-search' END AS phase,
 CASE WHEN user_id % 50 = 0 THEN 'webview' ELSE 'rust' END AS source, concat({_IP}, ':443') AS remote, user_id, {_IP} AS ip FROM events"""
# of an address's hosts and reverse names the first listed counts, which is not the first by alphabet
_EXPECTED = f"""SELECT DISTINCT {_IP} AS ip, CASE l WHEN 1 THEN 'chat.example.com' WHEN 2 THEN 'api.example.com' ELSE 'zone.example.com' END AS host,
 CASE l WHEN 1 THEN 'chat' ELSE 'other' END AS what, l AS listed FROM events CROSS JOIN (SELECT 1 AS l UNION ALL SELECT 2 UNION ALL SELECT 3) AS n WHERE user_id % 6 = 4 AND user_id % 250 % 4 = 0"""
_REVERSE = f"""SELECT DISTINCT {_IP} AS ip, l AS listed, CASE WHEN l = 2 THEN 'a.icloud.example' WHEN user_id % 6 = 5 THEN 'lb-140.github.com' WHEN user_id % 6 = 4 THEN 'x.scw.cloud' WHEN user_id % 6 = 1 THEN 'e1.icloud.example' ELSE 'host.example.net' END AS name
 FROM events CROSS JOIN (SELECT 1 AS l UNION ALL SELECT 2) AS n WHERE user_id % 5 > 0"""
_CLASSED = f"""c AS (SELECT *, CASE WHEN user_id % 6 = 4 AND user_id % 250 % 4 = 0 THEN 'EXPECTED' WHEN user_id % 5 = 0 THEN 'UNEXPLAINED' WHEN user_id % 6 IN (4, 5) THEN 'EXPECTED' WHEN user_id % 6 = 1 THEN 'OS' ELSE 'UNEXPLAINED' END AS class,
 CASE WHEN user_id % 6 = 4 AND user_id % 250 % 4 = 0 THEN 'chat.example.com — chat' WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 6 = 5 THEN 'GitHub (by reverse name)' WHEN user_id % 6 = 4 THEN 'Scaleway (by reverse name)'
  WHEN user_id % 6 = 1 THEN 'Apple — certificate checks, not the app' END AS what FROM ({_CAPTURES}))"""


def _captures(spark, sf_dir):
    return run(spark, sf_dir, _CAPTURES, "events")


def _maps(spark, sf_dir):
    return run(spark, sf_dir, _EXPECTED, "events"), run(spark, sf_dir, _REVERSE, "events")


@query(
    "capture_rows_s6",
    f"SELECT phase, source, remote, strftime(ts, '%H:%M:%S') AS time FROM ({_CAPTURES.replace('FROM events', ', ts FROM events')})",
)
def capture_rows(spark, sf_dir):
    """Captures written as text with comments and repeated headers, read back."""
    rows = run(spark, sf_dir, _CAPTURES.replace("FROM events", ", ts FROM events"), "events").select(
        F.explode(F.array(
            F.when(F.col("user_id") % 40 == 0, "# app\ta comment"), F.when(F.col("user_id") % 30 == 0, "phase\ttime\tsource\tremote"),
            F.concat_ws("\t", "phase", F.date_format("ts", "HH:mm:ss"), "source", "remote"),
        )).alias("value")
    ).where("value IS NOT NULL")
    path = new_path(spark, "captures")
    rows.write.text(path)
    return read_captures(spark, path)


@query("explained_captures_j6", f"WITH {_CLASSED} SELECT phase, source, remote, class, what FROM c")
def explained_captures(spark, sf_dir):
    return N.explained(_captures(spark, sf_dir), *_maps(spark, sf_dir)).select("phase", "source", "remote", "class", "what")


@query(
    "endpoint_report_k10",
    f"""WITH {_CLASSED} SELECT DISTINCT phase, source, remote, class, what,
 CASE WHEN source = 'webview' AND phase = 'idle' THEN 'webview contact, idle contact' WHEN source = 'webview' THEN 'webview contact' WHEN phase = 'idle' THEN 'idle contact' END AS finding FROM c""",
)
def endpoint_report(spark, sf_dir):
    return N.endpoint_report(_captures(spark, sf_dir), *_maps(spark, sf_dir))


@query(
    "capture_verdict_a13",
    f"""WITH {_CLASSED}, e AS (SELECT DISTINCT remote, class FROM c)
SELECT count(*) AS endpoints, count(*) FILTER (class = 'UNEXPLAINED') AS unexplained, CASE WHEN count(*) FILTER (class = 'UNEXPLAINED') = 0 THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM e""",
)
def capture_verdict(spark, sf_dir):
    return N.capture_verdict(_captures(spark, sf_dir), *_maps(spark, sf_dir))


_FIRST = "CASE event_id % 16 WHEN 0 THEN '10' WHEN 1 THEN '172' WHEN 2 THEN '192' WHEN 3 THEN '100' WHEN 4 THEN '8' WHEN 5 THEN '198' WHEN 6 THEN '230' WHEN 7 THEN '255' ELSE '127' END"
_QUAD = f"concat({_FIRST}, '.', CAST(event_id % 256 AS VARCHAR(4)), '.', CAST(event_id % 5 AS VARCHAR(4)), '.', CAST(user_id % 256 AS VARCHAR(4)))"
_V6 = ["::1", "0:0:0:0:0:0:0:1", "FE80::1", "fe80:0:0::1%eth0", "fd00::2", "fec0::1", "2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "2002:a00::1", "2606:4700::1111", "2001:0:4136::1",
       "2001:0000:0000:0000:1:2:3:4", "ff02::1", "64:ff9b::a00:1", "64:ff9b::10.0.0.1", "[::1]", "[2606:4700:4700::64]", "2a00:1450:4001:81b::200e", "1:2:3:4:5:6:7::", "::"]
_NO = ["300.1.2.3", "1.2.3", "01.2.3.4", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1", "::1.2.3.256", "[::1", "host", "", "::1%", "1:2:3:4:5:6:7::8"]
_CASES = " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_V6 + _NO))
# v4 addresses, plain and carried by v6 in two spellings, and v6 spellings and mistakes
_ADDRESSES = f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE event_id % 35 {_CASES} END WHEN event_id % 3 = 1 THEN quad ELSE CASE event_id % 6
 WHEN 2 THEN concat('::ffff:', quad) ELSE concat('0:0:0:0:0:FFFF:', quad) END END AS address FROM (SELECT event_id, {_QUAD} AS quad FROM events) AS e"""
_RANGES = ", ".join(f"('{n}', {b}, '{w}')" for n, b, w in N.PRIVATE_V4)
_SIX = ", ".join(f"('{n}', '{1 << (128 - b)}'::UHUGEINT, '{w}')" for n, b, w in N.PRIVATE_V6)


def _num(c):
    return " + ".join(f"CAST(string_split({c}, '.')[{i + 1}] AS BIGINT) * {256 ** (3 - i)}" for i in range(4))


# groups of an IPv6 address as a number of 128 bits, with a dotted quad at its end made two groups
_GROUPS = rf"""g0 AS (SELECT *, regexp_replace(regexp_replace(lower(address), '^\[(.*:.*)\]$', '\1'), '%[^%]+$', '') AS bare FROM a),
q AS (SELECT *, regexp_matches(bare, '^(\d+\.){{3}}\d+$') AS plain, regexp_extract(bare, '^(.*:)((\d+\.){{3}}\d+)$', 2) AS tail FROM g0),
o AS (SELECT *, CASE WHEN plain THEN bare WHEN tail <> '' THEN tail END AS dotted FROM q),
d AS (SELECT *, CASE WHEN dotted IS NULL THEN true ELSE len(list_filter(string_split(dotted, '.'), lambda x: TRY_CAST(x AS INT) BETWEEN 0 AND 255 AND (x = '0' OR x[1] <> '0'))) = 4 END AS quad_ok FROM o),
n4 AS (SELECT *, CASE WHEN dotted IS NOT NULL AND quad_ok THEN {_num('dotted')} END AS v4 FROM d),
t AS (SELECT *, CASE WHEN plain THEN NULL WHEN tail <> '' THEN concat(left(bare, length(bare) - length(tail)), lower(to_hex(v4 // 65536)), ':', lower(to_hex(v4 % 65536))) ELSE bare END AS six FROM n4),
s AS (SELECT *, string_split(six, '::') AS sides FROM t),
e AS (SELECT *, CASE WHEN sides[1] = '' THEN [] ELSE string_split(sides[1], ':') END AS l, CASE WHEN len(sides) < 2 OR sides[2] = '' THEN [] ELSE string_split(sides[2], ':') END AS r FROM s),
f AS (SELECT *, CASE WHEN len(sides) = 1 AND len(l) = 8 OR len(sides) = 2 AND len(l) + len(r) < 8 THEN list_concat(l, list_transform(range(0, 8 - len(l) - len(r)), lambda x: '0'), r) END AS gs FROM e),
h AS (SELECT *, quad_ok AND gs IS NOT NULL AND len(list_filter(gs, lambda x: regexp_full_match(x, '[0-9a-f]{{1,4}}'))) = 8 AS is6 FROM f),
m AS (SELECT *, CASE WHEN is6 THEN list_reduce(list_prepend(0::UHUGEINT, list_transform(gs, lambda x: CAST(concat('0x', x) AS BIGINT)::UHUGEINT)), lambda acc, x: acc * 65536 + x) END AS v6 FROM h),
v AS (SELECT event_id, address, CASE WHEN plain AND quad_ok THEN v4 WHEN v6 // 4294967296 = 65535 OR (v6 < 4294967296 AND v6 > 1) THEN CAST(v6 % 4294967296 AS BIGINT) END AS n4, v6 FROM m)"""
_NETS6 = rf"""x6 AS (SELECT size, why, list_reduce(list_prepend(0::UHUGEINT, list_transform(list_concat(l, list_transform(range(0, 8 - len(l)), lambda x: '0')), lambda x: CAST(concat('0x', x) AS BIGINT)::UHUGEINT)), lambda acc, x: acc * 65536 + x) AS lo
 FROM (SELECT *, list_filter(string_split(replace(net, '::', ''), ':'), lambda x: x <> '') AS l FROM (VALUES {_SIX}) AS x(net, size, why)))"""


@query(
    "vetted_addresses_j11",
    f"""WITH a AS ({_ADDRESSES}), {_GROUPS}, {_NETS6},
r AS (SELECT {_num('net')} AS lo, {_num('net')} + CAST(2 ** (32 - bits) AS BIGINT) - 1 AS hi, why FROM (VALUES {_RANGES}) AS x(net, bits, why))
SELECT event_id, address, CASE WHEN n4 IS NULL AND v6 IS NULL THEN 'not an address' WHEN n4 IS NOT NULL THEN r.why ELSE x6.why END AS reason
FROM v LEFT JOIN r ON n4 BETWEEN r.lo AND r.hi
 LEFT JOIN x6 ON n4 IS NULL AND v6 >= x6.lo AND v6 - x6.lo < x6.size""",
)
def vetted_addresses(spark, sf_dir):
    return N.vetted_addresses(run(spark, sf_dir, _ADDRESSES, "events"), N.private_ranges(spark))
