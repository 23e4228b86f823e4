"""Registry, log, status and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.operators import forecast as fc
from furrow.operators import prices
from furrow.operators import registry as rg
from furrow.plans import features as PF
from furrow.plans import prices as PR
from furrow.plans import sql as S
from furrow.operators import features as ft
from furrow.plans.prices import daily
from furrow.sources import tables as T


def versions(spark, sf):
    """One model version per crop and year: error of the naive forecast in that year."""
    f = ft.lag_features(daily(spark, sf), PF.SPANS)
    m = fc.regression_metrics(f.withColumn("yhat", F.col("lag_1")).withColumn("version", F.col("year")), ["crop", "version"])
    return m.select("crop", "version", F.make_date(F.col("version").cast("int"), F.lit(12), F.lit(31)).alias("trained_on"), "mae")


def registry_history(spark, sf):
    return rg.judge_versions(versions(spark, sf), 1.10)


def registry_current(spark, sf):
    return rg.current_models(registry_history(spark, sf))


def registry_as_of(spark, sf):
    back = spark.createDataFrame([("promo", 1998), ("small", 1998)], "crop string, version bigint")
    return rg.current_models(registry_history(spark, sf), F.lit("1998-12-31").cast("date"), back)


def stage_status(spark, sf):
    o = T.table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("OK").alias("status"))
    return rg.stage_status(o)


def audit_log_tail(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "ts", "event_type")
    return rg.log_tail(e, "ts", "event_id", 1000).select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("logged_at"), "event_type")


def quality_report(spark, sf):
    """The data-quality document as one JSON text."""
    q = prices.data_quality(T.quotes(spark, sf), "modal_cents")
    n = PR.coverage_totals(spark, sf)
    one = F.lit(1)
    both = q.withColumn("one", one).join(n.withColumn("one", one), "one")
    return both.select(F.to_json(F.struct(
        "total_records", "duplicate_records", "date_span", "data_quality_status",
        F.struct("adequate_pairs", "limited_pairs", "insufficient_pairs", "no_data_pairs").alias("coverage"))).alias("document"))


QUERIES = {f.__name__: f for f in [registry_history, registry_current, registry_as_of, stage_status, audit_log_tail, quality_report]}

# ------------------------------------------------------------------ check SQL
_HIST = PF.FEATURES + f""", vers AS (SELECT crop, year AS version, make_date(year, 12, 31) AS trained_on, {S.rnd('avg(abs(y - lag_1))', 2)} AS mae FROM feats GROUP BY 1, 2),
nv AS (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY version) AS k FROM vers),
walk AS (SELECT crop, version, trained_on, mae, 'PROMOTED' AS status, mae AS live, k FROM nv WHERE k = 1
 UNION ALL SELECT n.crop, n.version, n.trained_on, n.mae, CASE WHEN n.mae > w.live * CAST(1.10 AS DOUBLE) THEN 'REJECTED' ELSE 'PROMOTED' END,
  CASE WHEN n.mae > w.live * CAST(1.10 AS DOUBLE) THEN w.live ELSE n.mae END, n.k FROM walk w JOIN nv n ON n.crop = w.crop AND n.k = w.k + 1),
hist AS (SELECT crop, version, trained_on, mae, status FROM walk)"""

ORACLES = {
    "registry_history": f"WITH RECURSIVE {_HIST} SELECT * FROM hist",
    "registry_current": f"WITH RECURSIVE {_HIST} SELECT crop, version, trained_on, mae FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY version DESC) AS rn FROM hist WHERE status = 'PROMOTED') WHERE rn = 1",
    "registry_as_of": f"""WITH RECURSIVE {_HIST} SELECT crop, version, trained_on, mae FROM (SELECT *, row_number() OVER (PARTITION BY crop ORDER BY version DESC) AS rn FROM hist
 WHERE status = 'PROMOTED' AND trained_on <= DATE '1998-12-31' AND NOT (crop IN ('promo', 'small') AND version = 1998)) WHERE rn = 1""",
    "stage_status": """WITH g AS (SELECT o_custkey AS run_id, count(*) AS stages, count(*) FILTER (o_orderstatus = 'F') AS failed_stages FROM orders GROUP BY 1)
 SELECT *, CASE WHEN failed_stages = 0 THEN 'SUCCESS' WHEN failed_stages < 4 THEN 'PARTIAL' ELSE 'FAILED' END AS pipeline_status FROM g""",
    "audit_log_tail": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000)",
    "quality_report": f"""WITH {S.DAILY}, {PR.GRID}, t AS (SELECT count(*) AS a, count(*) - (SELECT count(*) FROM (SELECT DISTINCT ds, crop, state FROM quotes)) AS b, count(*) FILTER (modal_cents <= 0) AS z,
 strftime(min(ds), '%Y-%m-%d') || ' to ' || strftime(max(ds), '%Y-%m-%d') AS c FROM quotes),
 v AS (SELECT count(*) FILTER (coverage_status = 'ADEQUATE') AS p, count(*) FILTER (coverage_status = 'LIMITED') AS q, count(*) FILTER (coverage_status = 'INSUFFICIENT') AS r, count(*) FILTER (coverage_status = 'NO_DATA') AS s FROM graded)
 SELECT '{{"total_records":' || a || ',"duplicate_records":' || b || ',"date_span":"' || c || '","data_quality_status":"' || (CASE WHEN b = 0 AND z = 0 THEN 'PASS' ELSE 'WARNING' END)
 || '","coverage":{{"adequate_pairs":' || p || ',"limited_pairs":' || q || ',"insufficient_pairs":' || r || ',"no_data_pairs":' || s || '}}}}' AS document FROM t, v""",
}
