"""Fitted-model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.functions import numeric as N
from furrow.operators import features as ft
from furrow.operators import forecast as fc
from furrow.operators import models as md
from furrow.plans import features as PF
from furrow.plans import outlook as PO
from furrow.plans import sql as S
from furrow.plans.prices import daily, stored_daily
from furrow.session import cut_lineage
from furrow.sources import tables as T

LABELS = [str(i) for i in range(10)]
COLUMNS = [f"f{i}" for i in range(7)]


def _features(spark, sf):
    return ft.encoded_features(stored_daily(spark, sf), PF.SPANS)


def _ridge(spark, sf):
    """The features, windowed once and stored, and the models fitted on those before the split."""
    f = cut_lineage(ft.lag_features(daily(spark, sf), PF.SPANS), "ridge")
    return f, fc.ridge_by_crop(f.where(F.col("ds") < F.lit(T.SPLIT_DATE).cast("date")))


def ridge_models(spark, sf):
    """Coefficients of every crop, rounded to eight digits."""
    m = _ridge(spark, sf)[1]
    return m.select("crop", N.round_to(F.col("intercept"), 6).alias("intercept"), *[N.round_to(F.get("coefficients", F.lit(i)), 8).alias(f"w_{t}") for i, t in enumerate(fc.LINEAR_TERMS)])


def ridge_holdout(spark, sf):
    """Multi-lag ridge per crop against the naive forecast on the holdout days."""
    f, models = _ridge(spark, sf)
    test = fc.with_linear_prediction(f.where(F.col("ds") >= F.lit(T.SPLIT_DATE).cast("date")), models)
    both = fc.long_predictions(test, {"multi_lag_ridge": "yhat", "naive_lag1": "lag_1"})
    return fc.regression_metrics(both, ["crop", "model"])


def ridge_forecast(spark, sf):
    """Thirty days by the fitted ridge of every series."""
    return PO.path_rows(spark, sf)


def tree_holdout(spark, sf):
    """State-aware and crop-only boosted trees per crop on the holdout days."""
    return fc.regression_metrics(md.tree_holdout(_features(spark, sf), T.SPLIT_DATE), ["crop", "model"])


def tree_forecast(spark, sf):
    """Thirty days by boosted trees of every series."""
    rows = _features(spark, sf)
    cut = F.lit(T.SPLIT_DATE).cast("date")
    nodes = md.fit_nodes(rows.where(F.col("ds") < cut)).toPandas()
    codes = rows.groupBy("crop", "state").agg(F.min("state_enc").alias("state_enc"))
    s = PO.seeds(spark, sf).join(codes, ["crop", "state"], "left")
    return fc.dated_path(md.tree_forecast(s, nodes, T.SPLIT_DATE, 30, PF.SPANS), cut)


def tree_grid_search(spark, sf):
    """The published 27 points on the older eleven features."""
    return md.grid_search(PF.cascade_features(spark, sf), T.SPLIT_DATE)


def stratified_folds(spark, sf):
    return md.stratified_folds(T.class_rows(spark, sf)).select("vec_id", "label", "fold")


def class_probabilities(spark, sf):
    folded = cut_lineage(md.stratified_folds(T.class_rows(spark, sf)), "folds")
    return md.class_probabilities(folded.where("fold <> 0"), folded.where("fold = 0"), COLUMNS, "vec_id")


def classifier_cross_validation(spark, sf):
    """The ten scans of the fold table read it as stored."""
    return md.cross_validate(cut_lineage(md.stratified_folds(T.class_rows(spark, sf)), "folds"), COLUMNS)


def forest_report(spark, sf):
    """Precision, recall, F1 and support per class of the fitted forest on the fold it was not fitted on."""
    called = class_probabilities(spark, sf).where(F.col("candidate") == F.col("predicted"))
    return md.class_report(called)


def _called(spark, sf):
    """A simple nearest-sign rule stands for a classifier, so the report itself can be checked."""
    c = T.class_rows(spark, sf)
    shift = F.when((F.col("f0") > 0.05) & (F.col("f1") < 0), 1).when(F.col("f2") < -0.1, 3).otherwise(0)
    return c.select("label", ((F.col("label").cast("bigint") + shift) % 10).cast("string").alias("predicted"))


def classification_report(spark, sf):
    return md.class_report(_called(spark, sf))


def classification_summary(spark, sf):
    return md.weighted_report(md.class_report(_called(spark, sf)))


def confusion_matrix(spark, sf):
    return md.confusion_matrix(_called(spark, sf), LABELS)


QUERIES = {f.__name__: f for f in [
    ridge_models, ridge_holdout, ridge_forecast, tree_holdout, tree_forecast, tree_grid_search, stratified_folds, class_probabilities,
    classifier_cross_validation, forest_report, classification_report, classification_summary, confusion_matrix]}

# ------------------------------------------------------------------ check SQL
_CALLED = """called AS (SELECT CAST(label AS VARCHAR) AS label, CAST((label + CASE WHEN CAST(embedding[1] AS DOUBLE) > 0.05 AND embedding[2] < 0 THEN 1
 WHEN CAST(embedding[3] AS DOUBLE) < -0.1 THEN 3 ELSE 0 END) % 10 AS VARCHAR) AS predicted FROM embeddings),
sup AS (SELECT label AS class, count(*) AS support, count(*) FILTER (label = predicted) AS hit FROM called GROUP BY 1),
cal AS (SELECT predicted AS class, count(*) AS called FROM called GROUP BY 1),
rep0 AS (SELECT coalesce(s.class, c.class) AS class, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit,
 coalesce(coalesce(hit, 0) / nullif(CAST(coalesce(called, 0) AS DOUBLE), 0), 0) AS precision, coalesce(coalesce(hit, 0) / nullif(CAST(coalesce(support, 0) AS DOUBLE), 0), 0) AS recall FROM sup s FULL JOIN cal c ON c.class = s.class),
rep AS (SELECT class, support, hit, precision, recall, coalesce(CAST(2.0 AS DOUBLE) * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM rep0)"""

ORACLES = {
    "ridge_models": f"""WITH {PO.FITTED} SELECT crop, {S.rnd('intercept', 6)} AS intercept, {', '.join(f"{S.rnd(f'c[{i + 1}]', 8)} AS w_{t}" for i, t in enumerate(fc.LINEAR_TERMS))} FROM beta""",
    "ridge_holdout": f"""WITH {PO.FITTED}, rp AS (SELECT f.crop, 'multi_lag_ridge' AS model, y, intercept + {PO.TERMS} AS yhat FROM feats f JOIN beta b ON b.crop = f.crop WHERE ds >= DATE '{T.SPLIT_DATE}'
 UNION ALL SELECT f.crop, 'naive_lag1', y, lag_1 FROM feats f JOIN beta b ON b.crop = f.crop WHERE ds >= DATE '{T.SPLIT_DATE}') {PO._metrics('rp', 'crop, model')}""",
    "ridge_forecast": f"WITH {PO.FITTED}, {PO.PATHS} SELECT * FROM fcast",
    "stratified_folds": """WITH b AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 12) AS BIGINT) AS mark FROM embeddings)
 SELECT vec_id, label, (row_number() OVER (PARTITION BY label ORDER BY mark, vec_id) - 1) % 5 AS fold FROM b""",
    "classification_report": f"WITH {_CALLED} SELECT * FROM rep",
    "classification_summary": f"""WITH {_CALLED} SELECT CAST(sum(support) AS BIGINT) AS row_count, {S.rnd('sum(hit) / CAST(sum(support) AS DOUBLE)', 4)} AS accuracy,
 {', '.join(f"{S.rnd(f'sum({c} * support) / CAST(sum(support) AS DOUBLE)', 4)} AS weighted_{c}" for c in ('precision', 'recall', 'f1'))} FROM rep""",
    "confusion_matrix": f"WITH {_CALLED} SELECT label AS class, {', '.join(f'''count(*) FILTER (predicted = '{x}') AS as_{x}''' for x in LABELS)} FROM called GROUP BY 1",
}
