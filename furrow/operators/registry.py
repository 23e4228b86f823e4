"""Model registry as an append-only table, audit logs and stage status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judge_versions(versions: DataFrame, slack: float = 1.10) -> DataFrame:
    """Status of each version: promoted unless its error exceeds the production model's by the slack.

    The production model is the last promoted version, so a rejected one is no
    yardstick for those after it.  ``versions``: crop, version, trained_on, mae;
    a crop's few versions are folded in order.
    """
    def step(done: Column, v: Column) -> Column:
        worse = F.coalesce(v["mae"] > done["mae"] * F.lit(slack), F.lit(False))
        judged = F.struct(v["version"].alias("version"), v["trained_on"].alias("trained_on"), v["mae"].alias("mae"),
                          F.when(worse, "REJECTED").otherwise("PROMOTED").alias("status"))
        return F.struct(F.when(worse, done["mae"]).otherwise(v["mae"]).alias("mae"), F.concat(done["rows"], F.array(judged)).alias("rows"))

    kinds = {f.name: f.dataType.simpleString() for f in versions.schema}
    none = F.array().cast(f"array<struct<version:{kinds['version']},trained_on:{kinds['trained_on']},mae:{kinds['mae']},status:string>>")
    start = F.struct(F.lit(None).cast(kinds["mae"]).alias("mae"), none.alias("rows"))
    ordered = versions.groupBy("crop").agg(F.array_sort(F.collect_list(F.struct("version", "trained_on", "mae"))).alias("v"))
    return ordered.select("crop", F.explode(F.aggregate("v", start, step)["rows"]).alias("r")).select("crop", "r.*")


def current_models(history: DataFrame, as_of: Column | None = None, rolled_back: DataFrame | None = None) -> DataFrame:
    """Latest promoted version per crop, optionally as of a day and without rolled-back versions."""
    h = history.where(F.col("status") == "PROMOTED")
    if as_of is not None:
        h = h.where(F.col("trained_on") <= as_of)
    if rolled_back is not None:
        h = h.join(rolled_back.select("crop", "version"), ["crop", "version"], "left_anti")
    best = h.groupBy("crop").agg(F.max_by(F.struct("version", "trained_on", "mae"), "version").alias("m"))
    return best.select("crop", "m.version", "m.trained_on", "m.mae")


def log_tail(log: DataFrame, order: str, tie: str, keep: int = 1000) -> DataFrame:
    """Latest entries of an append-only log; a top-k, so no single task sees the whole log."""
    return log.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(keep)


def stage_status(stages: DataFrame, run: str = "run_id") -> DataFrame:
    """Failed stages and verdict per run: none SUCCESS, fewer than four PARTIAL, else FAILED.

    ``stages``: run, status.
    """
    g = stages.groupBy(run).agg(F.count(F.lit(1)).alias("stages"), F.count_if(F.col("status") == "FAILED").alias("failed_stages"))
    verdict = F.when(F.col("failed_stages") == 0, "SUCCESS").when(F.col("failed_stages") < 4, "PARTIAL").otherwise("FAILED")
    return g.withColumn("pipeline_status", verdict)
