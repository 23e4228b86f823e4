"""SQL fragments shared by the check queries; they mirror ``furrow.sources.tables``."""

from __future__ import annotations

from furrow import dims
from furrow.sources import tables as T


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    """``name(columns) AS (VALUES ...)`` for a fixed table."""
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def case_map(expr: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def pick(expr: str, choices: list) -> str:
    return case_map(expr, dict(enumerate(choices)))


def rnd(expr: str, digits: int = 0) -> str:
    scale = f"CAST({float(10**digits)!r} AS DOUBLE)"
    return f"(CAST(floor(({expr}) * {scale} + CAST(0.5 AS DOUBLE)) AS DOUBLE) / {scale})"


def whole(expr: str) -> str:
    return f"CAST(floor(({expr}) + CAST(0.5 AS DOUBLE)) AS BIGINT)"


def rs(expr: str) -> str:
    return f"(CAST({expr} AS DOUBLE) / CAST(100.0 AS DOUBLE))"


def initcap(expr: str) -> str:
    return (f"array_to_string(list_transform(string_split({expr}, ' '), "
            f"lambda w: upper(w[1]) || lower(w[2:])), ' ')")


QUOTE_LINES = """quote_lines AS (
 SELECT l_orderkey, l_linenumber, p_type, p_brand, n_nationkey, n_name, CAST(l_shipdate AS DATE) AS ds,
  l_discount, l_tax, CAST(floor(l_extendedprice * 100 / l_quantity + CAST(0.5 AS DOUBLE)) AS BIGINT) AS modal_cents
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey),
quote_rows AS (
 SELECT *, CAST(floor(modal_cents * (1 - l_discount) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS min_cents,
  CAST(floor(modal_cents * (1 + l_tax) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS max_cents FROM quote_lines)"""

QUOTES = QUOTE_LINES + """,
quotes AS (SELECT ds, lower(p_type) AS crop, n_name AS state, p_brand AS market,
  modal_cents, min_cents, max_cents FROM quote_rows)"""


def daily_from(quotes: str, name: str = "daily") -> str:
    return f"""{name}_sums AS (
 SELECT ds, crop, state, CAST(sum(modal_cents) AS BIGINT) AS s, count(*) AS n,
  CAST(sum(CASE WHEN min_cents > 0 THEN min_cents END) AS BIGINT) AS smin, count(CASE WHEN min_cents > 0 THEN 1 END) AS nmin,
  CAST(sum(CASE WHEN max_cents > 0 THEN max_cents END) AS BIGINT) AS smax, count(CASE WHEN max_cents > 0 THEN 1 END) AS nmax
 FROM {quotes} GROUP BY ds, crop, state),
{name} AS (
 SELECT ds, crop, state, {whole('CAST(s AS DOUBLE) / n')} AS y_cents,
  CASE WHEN nmin > 0 THEN {whole('CAST(smin AS DOUBLE) / nmin')} ELSE 0 END AS min_cents,
  CASE WHEN nmax > 0 THEN {whole('CAST(smax AS DOUBLE) / nmax')} ELSE 0 END AS max_cents,
  n AS market_count,
  CASE WHEN nmin > 0 AND nmax > 0 THEN {whole('CAST(smax AS DOUBLE) / nmax')} - {whole('CAST(smin AS DOUBLE) / nmin')} ELSE 0 END AS range_cents
 FROM {name}_sums)"""


DAILY = QUOTES + ",\n" + daily_from("quotes")

_PRICE = "CAST(CAST(floor({0} / CAST(100.0 AS DOUBLE)) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST({0} % 100 AS VARCHAR), 2, '0')"

RAW_QUOTES = QUOTE_LINES + f""",
raw_quotes AS (
 SELECT l_orderkey * 10 + l_linenumber AS quote_id,
  '  ' || upper({pick('n_nationkey', T.NATION_SPELLINGS)}) || ' ' AS State,
  {case_map('p_type', T.TYPE_COMMODITIES)} AS Commodity, p_brand AS Market,
  CASE l_linenumber % 3 WHEN 0 THEN strftime(ds, '%Y-%m-%d') WHEN 1 THEN strftime(ds, '%d/%m/%Y')
   ELSE strftime(ds, '%d-%m-%Y') END AS Arrival_Date, ds AS true_ds,
  CASE WHEN l_orderkey % 79 = 0 THEN '' ELSE
   {_PRICE.format('(CASE WHEN l_orderkey % 83 = 0 THEN max_cents ELSE min_cents END)')} END AS Min_Price,
  {_PRICE.format('(CASE WHEN l_orderkey % 83 = 0 THEN min_cents ELSE max_cents END)')} AS Max_Price,
  CASE WHEN l_orderkey % 97 = 0 THEN '' WHEN l_orderkey % 89 = 0 THEN '-' || {_PRICE.format('modal_cents')}
   ELSE {_PRICE.format('modal_cents')} END AS Modal_Price
 FROM quote_rows)"""

CLIMATE = """climate AS (
 SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(month(o_orderdate) AS BIGINT) AS month,
  CAST(CAST(sum(CAST(floor(o_totalprice * CAST(100.0 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS BIGINT) AS DOUBLE)
   / count(*) / CAST(1000000.0 AS DOUBLE) AS avg_temp, CAST(count(*) AS DOUBLE) AS total_rainfall
 FROM orders GROUP BY 1, 2)"""

SPACES = r"[\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def strip_markup(expr: str) -> str:
    return f"trim(regexp_replace(regexp_replace({expr}, '<[^>]+>', ' ', 'g'), '{SPACES}', ' ', 'g'))"


ARTICLES_RAW = """articles_raw AS (
 SELECT doc_id,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, 1, instr(text, chr(10)) - 1) ELSE text END AS title,
  CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS description,
  'doc/' || doc_id AS link,
  CASE WHEN doc_id % 17 = 0 THEN NULL
   WHEN doc_id % 4 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) + to_hours(doc_id % 24) - INTERVAL 330 MINUTE
   WHEN doc_id % 4 = 3 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER))
   ELSE TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 90 AS INTEGER)) + to_hours(doc_id % 24) END AS true_ts,
  source AS source_id, 'Outlet ' || source AS source_name,
  'TIER_' || (CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) % 4 + 1) AS tier
 FROM documents)"""

SIGNALS = f"""signals AS (
 SELECT event_id, ts, 'S' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 20) AS state,
  {pick('user_id % 6', list(T.TYPE_CROPS.values()))} AS crop, 'source ' || (user_id % 7) AS source_name,
  {pick('user_id % 7', ["TIER_1_OFFICIAL", "TIER_2_AGRI_RESEARCH", "TIER_3_BUSINESS_MARKET", "TIER_4_GENERAL_MEDIA",
                        "TIER_1_OFFICIAL", "TIER_4_GENERAL_MEDIA", "DISCOVERY_ONLY"])} AS tier,
  {pick('user_id % 7', [1.0, 0.8, 0.6, 0.4, 1.0, 0.4, 0.2])} AS credibility_weight,
  CASE event_type WHEN 'click' THEN 'RISK_DECREASED' WHEN 'error' THEN 'RISK_INCREASED' WHEN 'purchase' THEN 'RISK_ELEVATED'
   WHEN 'signup' THEN 'NEUTRAL' WHEN 'view' THEN 'NEGATIVE' END AS direction,
  date_diff('day', CAST(ts AS DATE), DATE '2024-03-15') AS age_days FROM events)"""

REQUESTS = f"""requests AS (
 SELECT c_custkey AS request_id, ' ' || upper({pick('c_nationkey', T.NATION_SPELLINGS)}) AS state,
  {case_map('c_mktsegment', T.SEGMENT_PLACES)} AS district, {pick('c_custkey % 4', T.REQUEST_SEASONS)} AS season,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(4.0 AS DOUBLE) + (c_custkey % 50) / CAST(10.0 AS DOUBLE) END AS soil_ph,
  CASE WHEN c_custkey % 5 <> 0 THEN greatest(c_acctbal, CAST(0.0 AS DOUBLE)) END AS water_available_mm,
  {pick('c_custkey % 6', T.PREVIOUS_CROPS)} AS previous_crop, CAST(c_custkey % 320 AS DOUBLE) AS n,
  CAST(c_custkey % 90 AS DOUBLE) AS p, CAST(c_custkey % 110 AS DOUBLE) AS k,
  CAST(8.0 AS DOUBLE) + (c_custkey % 27) AS lat, CAST(69.0 AS DOUBLE) + (c_custkey % 28) AS lon FROM customer)"""

CULTIVATION = f"""cultivation AS (
 SELECT district, state, crop, crop_year, CASE WHEN crop IN ('Wheat', 'Potato') THEN 'Rabi' WHEN crop = 'Rice' THEN 'Kharif' ELSE season END AS season, production FROM (
 SELECT {case_map('c_mktsegment', T.SEGMENT_PLACES)} AS district, {pick('c_nationkey', T.NATION_SPELLINGS)} AS state,
  {case_map('p_type', T.TYPE_CROPS)} AS crop, CAST(year(o_orderdate) AS BIGINT) AS crop_year,
  CASE WHEN month(o_orderdate) IN (6,7,8,9,10) THEN 'Kharif' WHEN month(o_orderdate) IN (4,5) THEN 'Summer' ELSE 'Rabi' END AS season,
  CAST(l_quantity AS BIGINT) AS production
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey))"""

STATE_MAP = values("state_map", "spelling, canonical", dims.STATE_SPELLINGS.items())
CROP_MAP = values("crop_map", "commodity, crop", dims.COMMODITY_CROPS.items())
