"""Usage and cost queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkdesk.operators import usage as U, validate as V
from sparkdesk.plans.derive import USAGE_EVENTS_SQL, run, usage_events
from sparkdesk.plans.prices import PROVIDER_NAMES, REVISIONS
from sparkdesk.registry.core import query
from sparkdesk.sources import ledger as L, prices as P

# the price list in DuckDB's terms
_RATES = """
rates(kind, name, rin, rout, unit, currency) AS (VALUES
 ('ai','default',1.80::DOUBLE,5.50::DOUBLE,NULL::DOUBLE,'EUR'),('ai','glm-5.3',1.80,5.50,NULL,'EUR'),
 ('ai','glm-5.2',1.80,5.50,NULL,'EUR'),('ai','mistral-small-3.2-24b-instruct-2506',0.15,0.35,NULL,'EUR'),
 ('image','default',NULL,NULL,0.04,'USD'),('image','flux-pro-1.1',NULL,NULL,0.04,'USD'),
 ('image','ovh-sdxl',NULL,NULL,0.004,'EUR'),('image','custom',NULL,NULL,0.0,'EUR'),
 ('search','default',NULL,NULL,0.0,'EUR'),('search','linkup',NULL,NULL,0.005,'USD'),
 ('search','staan',NULL,NULL,0.001,'EUR'),('search','searxng',NULL,NULL,0.0,'EUR')),
fx(currency, mult) AS (VALUES ('EUR',1.0::DOUBLE),('USD',0.92::DOUBLE))"""

_PRICED = f"""
WITH {_RATES}, events AS ({USAGE_EVENTS_SQL}),
rated AS (
 SELECT e.*, coalesce(r.rin,d.rin) rin, coalesce(r.rout,d.rout) rout, coalesce(r.unit,d.unit) unit,
        coalesce(r.currency,d.currency) cur
 FROM events e LEFT JOIN rates r ON r.kind=e.kind AND r.name=e.price_key
 LEFT JOIN rates d ON d.kind=e.kind AND d.name='default'),
costed AS (
 SELECT rated.*, CASE WHEN kind='ai' THEN input_tokens/1e6::DOUBLE*rin + output_tokens/1e6::DOUBLE*rout ELSE units*unit END
        * CASE WHEN cur='EUR' THEN 1.0::DOUBLE ELSE coalesce(fx.mult,1.0) END AS cost
 FROM rated LEFT JOIN fx ON fx.currency=cur),
counted AS (SELECT *, strftime(ts,'%Y-%m') AS month FROM costed
 WHERE CASE WHEN kind='ai' THEN input_tokens>0 OR output_tokens>0 ELSE units>0 END)
"""


def _costed(spark, sf_dir):
    rates, fx = P.current_price_list(spark)
    return U.priced(usage_events(spark, sf_dir), rates, fx)


@query("event_cost_j1", _PRICED + "SELECT event_id, kind, price_key, round(cost,8) AS cost FROM costed")
def event_cost(spark, sf_dir):
    return _costed(spark, sf_dir).select("event_id", "kind", "price_key", U.money(F.col("cost")).alias("cost"))


@query(
    "to_display_currency_j2",
    """SELECT o_orderkey AS event_id, CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'XYZ' END AS currency,
  round(o_totalprice * CASE o_orderkey % 4 WHEN 1 THEN 0.92::DOUBLE ELSE 1.0::DOUBLE END, 8) AS amount FROM orders""",
)
def to_display_currency(spark, sf_dir):
    orders = run(
        spark, sf_dir,
        """SELECT o_orderkey AS event_id, o_totalprice,
           CASE o_orderkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' ELSE 'XYZ' END AS currency
           FROM orders""", "orders")
    _, fx = P.current_price_list(spark)
    return U.to_display(orders, fx, "currency", "EUR").select(
        "event_id", "currency", U.money(F.col("o_totalprice") * F.col("mult")).alias("amount")
    )


@query(
    "monthly_ledger_a1",
    _PRICED + """SELECT month, kind AS category, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(CASE WHEN kind='image' THEN units ELSE 0 END) AS BIGINT) AS images,
  CAST(sum(CASE WHEN kind='search' THEN units ELSE 0 END) AS BIGINT) AS searches, round(sum(cost),8) AS cost
FROM counted GROUP BY month, kind""",
)
def monthly_ledger(spark, sf_dir):
    return U.monthly_ledger(_costed(spark, sf_dir))


@query(
    "provider_tally_a2",
    _PRICED + """SELECT month, kind AS category, provider, CAST(sum(units) AS BIGINT) AS count, round(sum(cost),8) AS cost
FROM counted WHERE kind <> 'ai' GROUP BY ALL""",
)
def provider_tally(spark, sf_dir):
    return U.provider_tally(_costed(spark, sf_dir))


@query(
    "all_time_rollup_a3",
    _PRICED + """SELECT month, kind AS category, provider, CAST(grouping(month, kind, provider) AS BIGINT) AS level,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(units) AS BIGINT) AS units, round(sum(cost),8) AS cost
FROM counted GROUP BY ROLLUP(month, kind, provider)""",
)
def all_time_rollup(spark, sf_dir):
    return U.all_time(_costed(spark, sf_dir))


_NOW = "1999-03"


def _summary_sql():
    cols = []
    for period, cond in (("month", f"month='{_NOW}'"), ("all_time", "true")):
        for c in U.CATEGORIES:
            cols.append(f"round(coalesce(sum(cost) FILTER ({cond} AND kind='{c}'),0),8) AS {period}_{c}_cost")
        cols.append(f"round(coalesce(sum(cost) FILTER ({cond}),0),8) AS {period}_cost")
        cols.append(f"CAST(coalesce(sum(input_tokens+output_tokens) FILTER ({cond}),0) AS BIGINT) AS {period}_tokens")
        cols.append(f"CAST(coalesce(sum(units) FILTER ({cond}),0) AS BIGINT) AS {period}_units")
    return _PRICED + "SELECT " + ", ".join(cols) + " FROM counted"


@query("usage_summary_a4", _summary_sql())
def usage_summary(spark, sf_dir):
    return U.summary(_costed(spark, sf_dir), _NOW)


def _names_sql():
    return "names(category, provider, name) AS (VALUES " + ",".join(str(n) for n in PROVIDER_NAMES) + ")"


@query(
    "provider_breakdown_a5",
    _PRICED + f""", {_names_sql()}, tally AS (SELECT month, kind AS category, provider, CAST(sum(units) AS BIGINT) AS n
  FROM counted WHERE kind <> 'ai' GROUP BY ALL)
SELECT month, t.category, string_agg(coalesce(name, t.provider) || ' ' || n, ' · ' ORDER BY t.provider) AS line
FROM tally t LEFT JOIN names USING (category, provider) WHERE n > 0 GROUP BY ALL""",
)
def provider_breakdown(spark, sf_dir):
    values = ",".join(str(n) for n in PROVIDER_NAMES)
    names = spark.sql(f"SELECT * FROM VALUES {values} AS names(category, provider, name)")
    return U.breakdown(U.provider_tally(_costed(spark, sf_dir)), names)


@query(
    "price_as_of_j3",
    f"""WITH {_RATES}, versions(version, collected, factor) AS (VALUES
 {",".join(f"({i}::BIGINT, DATE '{d}', {f}::DOUBLE)" for i, (d, f) in enumerate(REVISIONS))}),
events AS ({USAGE_EVENTS_SQL}),
picked AS (SELECT e.*, coalesce(v.version, 0) AS version, v.version IS NULL AS before_first
 FROM events e ASOF LEFT JOIN versions v ON e.ts >= v.collected),
rated AS (SELECT p.*, f.factor, coalesce(r.rin,d.rin) rin, coalesce(r.rout,d.rout) rout, coalesce(r.unit,d.unit) unit,
  coalesce(r.currency,d.currency) cur
 FROM picked p JOIN versions f USING (version) LEFT JOIN rates r ON r.kind=p.kind AND r.name=p.price_key
 LEFT JOIN rates d ON d.kind=p.kind AND d.name='default')
SELECT event_id, version, before_first,
 round(CASE WHEN kind='ai' THEN input_tokens/1e6::DOUBLE*(rin*factor) + output_tokens/1e6::DOUBLE*(rout*factor) ELSE units*(unit*factor) END
  * CASE WHEN cur='USD' THEN 0.92::DOUBLE ELSE 1.0 END, 10) AS cost FROM rated""",
)
def price_as_of(spark, sf_dir):
    rates, fx = P.current_price_list(spark)
    values = ",".join(f"({i}L, DATE '{d}')" for i, (d, _) in enumerate(REVISIONS))
    revisions = spark.sql(f"SELECT * FROM VALUES {values} AS v(version, collected)")
    each = F.array(*[F.struct(F.lit(i).cast("long").alias("version"), F.lit(f).alias("factor")) for i, (_, f) in enumerate(REVISIONS)])
    scaled = rates.select("*", F.inline(each))
    for c in ("input_per_mtok", "output_per_mtok", "per_unit"):
        scaled = scaled.withColumn(c, F.col(c) * F.col("factor"))
    history = U.price_history(scaled.drop("factor"), revisions)
    return U.priced_as_of(usage_events(spark, sf_dir), history, fx).select(
        "event_id", "version", "before_first", F.round("cost", 10).alias("cost")
    )


_SUPPLIER_PRICES = """
SELECT s_suppkey AS id, to_json(named_struct(
  'version', concat('v', s_suppkey),
  'collected', CASE WHEN s_suppkey % 10 = 7 THEN '2025-06-01' ELSE concat('2026-01-', lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0')) END,
  'display_currency', CASE WHEN s_suppkey % 10 = 8 THEN 'XXX' ELSE 'EUR' END,
  'fx', map('EUR', CAST(1.0 AS DOUBLE), 'USD', CASE WHEN s_suppkey % 10 = 3 THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.92 AS DOUBLE) END),
  'ai', map('default', named_struct('input_per_mtok', CAST(1.8 AS DOUBLE), 'output_per_mtok', CAST(5.5 AS DOUBLE), 'currency', 'EUR'),
            concat('model-', s_suppkey), named_struct(
               'input_per_mtok', CASE s_suppkey % 10 WHEN 1 THEN CAST(-1.0 AS DOUBLE) WHEN 5 THEN CAST(20000.0 AS DOUBLE) ELSE abs(s_acctbal) / 1000 END,
               'output_per_mtok', CAST(2.0 AS DOUBLE), 'currency', CASE WHEN s_suppkey % 3 = 0 THEN 'usd' END)),
  'image', map('default', named_struct('per_unit', CAST(0.04 AS DOUBLE), 'currency', CASE WHEN s_suppkey % 10 = 2 THEN 'ZZZ' ELSE 'USD' END)),
  'search', map(concat('find-', s_suppkey % 4), named_struct('per_unit', CAST(s_suppkey % 10 AS DOUBLE) / 1000, 'currency', CAST(NULL AS STRING))),
  'sources', map('list', CASE s_suppkey % 10 WHEN 4 THEN 'http://prices.example.com/' WHEN 6 THEN 'https://user:pw@prices.example.com/'
                 WHEN 9 THEN '' ELSE concat('https://prices.example.com/', s_suppkey) END),
  'free', map('list', 'none'))) AS json
FROM supplier
"""


def _price_tables(spark, sf_dir):
    return P.parse_price_tables(run(spark, sf_dir, _SUPPLIER_PRICES, "supplier"), "id", "json")


@query(
    "price_rates_s2",
    """SELECT s_suppkey AS table_id, 'ai' AS kind, 'default' AS name, 1.8::DOUBLE AS input_per_mtok, 5.5::DOUBLE AS output_per_mtok, NULL::DOUBLE AS per_unit, 'EUR' AS currency FROM supplier
UNION ALL SELECT s_suppkey, 'ai', 'model-'||s_suppkey, round(CASE s_suppkey % 10 WHEN 1 THEN -1.0::DOUBLE WHEN 5 THEN 20000.0 ELSE abs(s_acctbal)/1000 END, 8), 2.0, NULL, CASE WHEN s_suppkey % 3 = 0 THEN 'usd' ELSE 'EUR' END FROM supplier
UNION ALL SELECT s_suppkey, 'image', 'default', NULL, NULL, 0.04, CASE WHEN s_suppkey % 10 = 2 THEN 'ZZZ' ELSE 'USD' END FROM supplier
UNION ALL SELECT s_suppkey, 'search', 'find-'||(s_suppkey % 4), NULL, NULL, round((s_suppkey % 10)/1000, 8), 'EUR' FROM supplier""",
)
def price_rates(spark, sf_dir):
    return P.rates(_price_tables(spark, sf_dir)).withColumns(
        {"input_per_mtok": U.money(F.col("input_per_mtok")), "per_unit": U.money(F.col("per_unit"))}
    )


@query(
    "exchange_rates_s2",
    """SELECT s_suppkey AS table_id, 'EUR' AS currency, 1.0::DOUBLE AS mult FROM supplier
UNION ALL SELECT s_suppkey, 'USD', CASE WHEN s_suppkey % 10 = 3 THEN 0.0 ELSE 0.92 END FROM supplier""",
)
def exchange_rates(spark, sf_dir):
    return P.exchange(_price_tables(spark, sf_dir))


@query(
    "price_table_problems_v1",
    """SELECT * FROM (
 SELECT s_suppkey AS table_id, CASE s_suppkey % 10
   WHEN 1 THEN 'rate negative' WHEN 2 THEN 'currency unknown' WHEN 3 THEN 'fx zero' WHEN 4 THEN 'link not https'
   WHEN 5 THEN 'rate implausible' WHEN 6 THEN 'link carries credentials' WHEN 7 THEN 'older than current' WHEN 8 THEN 'currency unknown' END AS rule,
  CASE s_suppkey % 10 WHEN 1 THEN 'model-'||s_suppkey WHEN 2 THEN 'default' WHEN 3 THEN 'USD' WHEN 4 THEN 'list'
   WHEN 5 THEN 'model-'||s_suppkey WHEN 6 THEN 'list' WHEN 7 THEN '2025-06-01' WHEN 8 THEN 'display_currency' END AS item
 FROM supplier) WHERE rule IS NOT NULL""",
)
def price_table_problems(spark, sf_dir):
    return V.price_table_problems(_price_tables(spark, sf_dir), current_collected="2026-01-01")


_LEDGERS = """
SELECT event_id AS id, to_json(named_struct('months', map(date_format(ts, 'yyyy-MM'), named_struct(
  'ai', CASE WHEN kind = 'ai' THEN named_struct('input_tokens', input_tokens, 'output_tokens', output_tokens, 'cost', input_tokens / 1e6D) END,
  'image', CASE WHEN kind = 'image' THEN named_struct('images', units, 'cost', units * 0.5D) END,
  'search', CASE WHEN kind = 'search' THEN named_struct('searches', units, 'cost', units * 0.25D) END,
  'image_by_provider', CASE WHEN kind = 'image' THEN map(provider, named_struct('count', units, 'cost', units * 0.5D)) END,
  'search_by_provider', CASE WHEN kind = 'search' THEN map(provider, named_struct('count', units, 'cost', units * 0.25D)) END)))) AS json
FROM usage_events
"""


@query(
    "ledger_rows_s3",
    f"""WITH e AS (SELECT *, strftime(ts,'%Y-%m') AS month FROM ({USAGE_EVENTS_SQL})), r AS (
 SELECT month, kind AS category, NULL AS provider, CASE WHEN kind='ai' THEN 0 ELSE units END AS n, input_tokens, output_tokens,
  CASE kind WHEN 'ai' THEN input_tokens/1e6::DOUBLE WHEN 'image' THEN units*0.5::DOUBLE ELSE units*0.25::DOUBLE END AS cost FROM e
 UNION ALL SELECT month, kind, provider, units, 0, 0, CASE kind WHEN 'image' THEN units*0.5 ELSE units*0.25 END FROM e WHERE kind <> 'ai')
SELECT month, category, provider, CAST(sum(n) AS BIGINT) AS count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(sum(cost),8) AS cost FROM r GROUP BY month, category, provider""",
)
def ledger_rows(spark, sf_dir):
    json = spark.sql(_LEDGERS.replace("usage_events", "{e}"), e=usage_events(spark, sf_dir))
    return (
        L.ledger_rows(L.parse_ledgers(json, "id", "json"))
        .groupBy("month", "category", "provider")
        .agg(
            F.sum("count").alias("count"), F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"), U.money(F.sum("cost")).alias("cost"),
        )
    )


_MIGRATION = f"""e AS (SELECT *, strftime(ts,'%Y-%m') AS month FROM ({USAGE_EVENTS_SQL}) WHERE kind <> 'ai')"""


@query(
    "migrate_ledger_v8",
    f"""WITH {_MIGRATION} SELECT month, kind AS category, CAST(sum(units) AS BIGINT) AS units, round(sum(units*0.5::DOUBLE),8) AS cost
FROM e WHERE event_id % 3 = 0 OR event_id % 11 < 8 GROUP BY ALL""",
)
def migrate_ledger(spark, sf_dir):
    events = usage_events(spark, sf_dir).where("kind <> 'ai'").select(
        "event_id", U.month_of("ts").alias("month"), F.col("kind").alias("category"), "units",
        (F.col("units") * 0.5).alias("cost"), (F.col("event_id") % 11).alias("source_id"),
    )
    current, legacy = events.where("event_id % 3 = 0"), events.where("event_id % 3 <> 0")
    merged = events.where("event_id % 11 >= 8").select("source_id")
    return U.migrate_ledgers(current, legacy, merged)
