"""Fitted models: boosted trees per crop, class forests, folds and reports.

Price series are rolled up to days before, so a crop's training rows are bounded by
days x states; its trees are fitted in one task, all crops and grid points side by side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow.functions import boosting
from furrow.functions import numeric as N

# Order of the model features.  Fixed values.
FEATURE_COLUMNS = ["state_enc", "lag_1", "lag_7", "lag_14", "lag_30", "rolling_7", "rolling_30", "rolling_std_7", "price_range",
                   "day_of_year", "month", "day_of_week", "year", "black_swan"]
NODE_FIELDS = ["crop", "tree", "node", "feature", "threshold", "left", "right", "value"]


# The price model's parameters and the grid of the older one.  Fixed values.
ROUNDS, DEPTH, STEP, SUBSAMPLE, COLUMN_SHARE = 250, 6, 0.04, 0.8, 0.8
#: Tasks that fits are dealt to.  Fits are long and their rows few, so small partitions must not be merged.
FIT_TASKS = 64
GRID = {"depth": (3, 5, 7), "step": (0.03, 0.05, 0.1), "rounds": (100, 150, 200)}
# The older model's eleven features, in order.  Fixed values.
GRID_COLUMNS = ["lag_1", "lag_7", "lag_14", "lag_30", "rolling_mean_7", "rolling_mean_30", "month", "season", "monthly_avg_temp", "monthly_total_rainfall", "black_swan"]


def per_crop(crops: Sequence, job, parallel: int = 4) -> list:
    """Run ``job`` for a short list, a few at a time."""
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(job, crops))


def _matrix(pdf: pd.DataFrame, columns: Sequence[str]) -> np.ndarray:
    return pdf[list(columns)].to_numpy(float)


def tree_holdout(features: DataFrame, cut: str, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP) -> DataFrame:
    """Holdout predictions of the state-aware and the crop-only trees of every crop, as long rows.

    A group is one crop and one of the two models.  Its rows are bounded by days x
    states whatever the number of quotes, since the series are rolled up before.
    """
    sets = {"state_aware_trees": FEATURE_COLUMNS, "crop_only_trees": [c for c in FEATURE_COLUMNS if c != "state_enc"]}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ds", "state"])
        old = (pd.to_datetime(pdf["ds"]) < pd.Timestamp(cut)).to_numpy()
        x, test = _matrix(pdf, sets[key[1]]), pdf[~old]
        start, trees = boosting.boost(x[old], pdf["y"].to_numpy(float)[old], rounds, depth, step, SUBSAMPLE, COLUMN_SHARE)
        return pd.DataFrame({"crop": test["crop"], "state": test["state"], "ds": test["ds"], "y": test["y"], "model": key[1], "yhat": boosting.predict(start, trees, x[~old])})

    each = features.withColumn("model", F.explode(F.array(*map(F.lit, sets))))
    return each.repartition(FIT_TASKS, "crop", "model").groupBy("crop", "model").applyInPandas(run, "crop string, state string, ds date, y double, model string, yhat double")


def grid_search(features: DataFrame, cut: str, grid: dict[str, Sequence] | None = None, columns: Sequence[str] = tuple(GRID_COLUMNS)) -> DataFrame:
    """Holdout mean absolute error of every grid point per crop on a chronological split, the best one flagged.

    A group is one crop, depth and step; fewer rounds are a prefix of more, so each is
    fitted once with the most rounds and judged at all.
    """
    grid = grid or GRID
    points = [(d, s) for d in grid["depth"] for s in grid["step"]]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ds", "state"])
        old = (pd.to_datetime(pdf["ds"]) < pd.Timestamp(cut)).to_numpy()
        x, y = _matrix(pdf, columns), pdf["y"].to_numpy(float)
        start, trees = boosting.boost(x[old], y[old], max(grid["rounds"]), int(key[1]), float(key[2]))
        found = []
        for rounds in grid["rounds"]:
            error = np.abs(boosting.predict(start, trees[:rounds], x[~old]) - y[~old])
            found.append((key[0], rounds, int(key[1]), float(key[2]), float(error.mean()) if len(error) else None))
        return pd.DataFrame(found, columns=["crop", "rounds", "depth", "step", "mae"])

    each = features.withColumn("point", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(float(s)).alias("step")) for d, s in points])))
    table = each.select("*", "point.depth", "point.step").drop("point").repartition(FIT_TASKS, "crop", "depth", "step").groupBy("crop", "depth", "step").applyInPandas(run, "crop string, rounds bigint, depth bigint, step double, mae double")
    first = F.row_number().over(W.partitionBy("crop").orderBy(F.col("mae").asc_nulls_last(), "depth", "step", "rounds"))
    return table.withColumn("is_best", first == 1)


# ----------------------------------------------------------- forecasts by trees
def fit_nodes(train: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, step: float = STEP) -> DataFrame:
    """Trees of every crop as node rows (``NODE_FIELDS``): at most rounds x 2^(depth+1) per crop, and a root that holds the start value."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ds", "state"])
        start, trees = boosting.boost(_matrix(pdf, FEATURE_COLUMNS), pdf["y"].to_numpy(float), rounds, depth, step, SUBSAMPLE, COLUMN_SHARE)
        base = boosting.Tree(np.array([0]), np.array([0.0]), np.array([-1]), np.array([-1]), np.array([start]))
        return pd.concat([pd.DataFrame({"crop": key[0], "tree": k, "node": np.arange(len(t.value)), "feature": t.feature, "threshold": t.threshold, "left": t.left, "right": t.right, "value": t.value})
                          for k, t in enumerate([base, *trees])], ignore_index=True)

    return train.repartition(FIT_TASKS, "crop").groupBy("crop").applyInPandas(run, "crop string, tree int, node int, feature int, threshold double, left int, right int, value double")


def _forest(nodes: pd.DataFrame) -> dict[str, list[boosting.Tree]]:
    """The trees of every crop in order."""
    out: dict[str, list[boosting.Tree]] = {}
    for (crop, _), t in nodes.sort_values(["crop", "tree", "node"]).groupby(["crop", "tree"], sort=False):
        out.setdefault(crop, []).append(boosting.Tree(*(t[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value"))))
    return out


def tree_forecast(seeds: DataFrame, nodes: pd.DataFrame, start: str, horizon: int = 30,
                  intervals: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Recursive path of each series by its crop's trees; a series without a state code, or a crop without trees, stays at its last price.

    ``seeds``: crop, state, state_enc, prices, mean_range.  The nodes are bounded
    by the model size and shipped as one broadcast variable; series are
    evaluated in Arrow batches, all rows of a batch together at every step.
    """
    shipped = seeds.sparkSession.sparkContext.broadcast(_forest(nodes))
    spans = [(pd.Timestamp(a), pd.Timestamp(b)) for a, b in intervals]
    days = pd.date_range(start, periods=horizon)

    def path_of(trees: list[boosting.Tree], g: pd.DataFrame) -> np.ndarray:
        prices = np.stack([np.asarray(p, dtype=float)[-30:] for p in g["prices"]])
        fixed_state, fixed_range = g["state_enc"].to_numpy(float), g["mean_range"].to_numpy(float)
        path = []
        for d in days:
            last7 = prices[:, -7:]
            flag = float(any(a <= d <= b for a, b in spans))
            cal = np.tile([d.dayofyear, d.month, d.dayofweek, d.year, flag], (len(g), 1))
            x = np.column_stack([fixed_state, prices[:, -1], prices[:, -7], prices[:, -14], prices[:, -30], last7.mean(axis=1),
                                 prices[:, -30:].mean(axis=1), last7.std(axis=1, ddof=1), fixed_range, cal])
            path.append(boosting.predict(0.0, trees, x))
            prices = np.column_stack([prices, path[-1]])
        return np.column_stack(path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for crop, g in pdf.groupby("crop"):
                long = g["state_enc"].notna().to_numpy() & (g["prices"].map(len) >= 30).to_numpy() & (crop in shipped.value)
                last = np.array([float(p[-1]) if len(p) else np.nan for p in g["prices"]])
                path = np.repeat(last[:, None], horizon, axis=1)
                if long.any():
                    path[long] = path_of(shipped.value[crop], g[long])
                yield pd.DataFrame({"crop": g["crop"].to_numpy(), "state": g["state"].to_numpy(), "path": list(path)})

    return seeds.select("crop", "state", "state_enc", "prices", "mean_range").mapInPandas(run, "crop string, state string, path array<double>")


# ------------------------------------------------------------------ classifier
def fold_position(df: DataFrame, label: str, key: str, bucket_rows: int = 20_000) -> DataFrame:
    """Exact running number of each row within its label, in hashed order.

    Rows are numbered inside (label, range of hashes) and shifted by the totals of
    the ranges before, so a label with most of the rows is never numbered in one
    task.  The number of ranges follows the row count; the numbers do not depend on it.
    """
    bits = (df.count() // bucket_rows).bit_length()
    mark = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 12), 16, 10).cast("bigint")
    b = df.withColumn("mark", mark).withColumn("bucket", F.shiftright("mark", 48 - bits))
    totals = b.groupBy(label, "bucket").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(W.partitionBy(label).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = totals.select(label, "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    rn = F.row_number().over(W.partitionBy(label, "bucket").orderBy("mark", key))
    return b.withColumn("rn", rn).join(offsets, [label, "bucket"]).withColumn("position", F.col("offset") + F.col("rn")).drop("rn", "offset", "bucket", "mark")


def stratified_folds(df: DataFrame, label: str = "label", key: str = "vec_id", folds: int = 5) -> DataFrame:
    """Adds ``fold``: every label is spread evenly over the folds."""
    return fold_position(df, label, key).withColumn("fold", (F.col("position") - 1) % folds).drop("position")


def dealt(rows: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """``rows`` in one task for each ``rows_per_task`` of them; no more than that stay as they lie.

    Narrow rows fill few files, and a forest makes a pass over all of them for every few thousand nodes.  The number
    of tasks follows the rows alone, since the forest's bags depend on how rows are dealt; every task holds a
    pass's statistics, so it is not larger than needed.
    """
    tasks = -(-rows.count() // rows_per_task)
    return rows.repartition(tasks) if tasks > 1 else rows


def _fit_classes(train: DataFrame, columns: Sequence[str], label: str, trees: int, depth: int, seed: int):
    """Fitted forest and the names of the classes it was trained on, in the order of its probabilities."""
    train = dealt(train)
    indexer = StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)
    stages = [indexer, VectorAssembler(inputCols=list(columns), outputCol="features"),
              RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(train), list(indexer.labels)


def _with_names(scored: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds ``predicted``, the name of the predicted class; the place kept for unseen labels is never the name of a class."""
    return scored.withColumn("predicted", F.get(F.array(*map(F.lit, names)), F.col("prediction").cast("int")))


def class_probabilities(train: DataFrame, rows: DataFrame, columns: Sequence[str], key: str, label: str = "label",
                        trees: int = 100, depth: int = 12, seed: int = 42) -> DataFrame:
    """Probability of every class of the training rows for every row, long form, with the predicted class."""
    fitted, names = _fit_classes(train, columns, label, trees, depth, seed)
    out = _with_names(fitted.transform(rows), names)
    known = F.arrays_zip(F.array(*map(F.lit, names)).alias("candidate"), F.slice(vector_to_array("probability"), 1, len(names)).alias("probability"))
    return out.select(key, label, "predicted", F.explode(known).alias("c")).select(key, label, "predicted", F.col("c")["candidate"].alias("candidate"), F.col("c")["probability"].alias("probability"))


def cross_validate(folded: DataFrame, columns: Sequence[str], label: str = "label", folds: int = 5, trees: int = 100,
                   depth: int = 12, seed: int = 42, parallel: int = 5) -> DataFrame:
    """Accuracy per fold, then mean and deviation, as one row."""
    def one(k: int) -> tuple:
        model, names = _fit_classes(folded.where(F.col("fold") != k), columns, label, trees, depth, seed)
        scored = _with_names(model.transform(folded.where(F.col("fold") == k)), names)
        return (k, scored.agg(F.avg(F.coalesce(F.col("predicted") == F.col(label), F.lit(False)).cast("double")).alias("a")).first()["a"])

    table = folded.sparkSession.createDataFrame(per_crop(list(range(folds)), one, parallel), "fold bigint, accuracy double")
    return table.agg(F.count(F.lit(1)).alias("folds"), F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))


def class_report(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    cells = predictions.groupBy(F.col(label).alias("a"), F.col(predicted).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                        F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("hit")).unionByName(
        cells.select(F.col("b").alias("class"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"), F.lit(0).alias("hit")))
    g = both.groupBy("class").agg(F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))

    def ratio(top: Column, under: Column) -> Column:
        return F.coalesce(top / F.nullif(under.cast("double"), F.lit(0.0)), F.lit(0.0))

    p, r = ratio(F.col("hit"), F.col("called")), ratio(F.col("hit"), F.col("support"))
    return g.select("class", "support", "hit", p.alias("precision"), r.alias("recall"), ratio(F.lit(2.0) * p * r, p + r).alias("f1"))


def weighted_report(report: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, one row."""
    n = F.sum("support").cast("double")
    return report.agg(
        F.sum("support").alias("row_count"), N.round_to(F.sum("hit") / n, 4).alias("accuracy"),
        *[N.round_to(F.sum(F.col(c) * F.col("support")) / n, 4).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def confusion_matrix(predictions: DataFrame, labels: Sequence[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row per class with a column per predicted class (the list is given)."""
    m = predictions.groupBy(label).pivot(predicted, list(labels)).agg(F.count(F.lit(1)))
    return m.select(F.col(label).alias("class"), *[F.coalesce(F.col(f"`{x}`"), F.lit(0).cast("bigint")).alias(f"as_{x}") for x in labels])
