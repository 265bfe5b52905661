"""Parameter sweeps: trial table, joint runs over cached blocks, scores, pruning, best trial."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plotweave.operators.fit import BETA_STEP, GAMMA_STEP, Blocks, Fit, Settings, fit_many
from plotweave.operators.ranks import exact_median
from plotweave.operators.reduce import matrix

CRASH_SCORE = -1e6

# The two search spaces. ("log" | "uniform", low, high) or ("choice", values).
SPACE_V1 = {
    "lambda_collapse": ("log", 0.05, 5.0),
    "entropy_weight": ("log", 5e-4, 5e-3),
    "lam_g": ("log", 1e-4, 2e-3),
    "beta_max": ("choice", (4.0, 5.0, 6.0)),
    "gamma_max": ("choice", (1.0, 1.5, 2.0)),
    "anneal_step": ("choice", (5, 10)),
    "prune_delay_epoch": ("choice", (20, 40, 60, 80)),
    "prune_every": ("choice", (10, 20)),
}
SPACE_V2 = {
    "lambda_collapse": ("log", 5e-4, 5e-2),
    "entropy_weight": ("log", 2e-4, 2e-3),
    "lr": ("log", 5e-4, 3e-3),
    "beta_max": ("uniform", 5.0, 8.0),
    "prune_delay_epoch": ("choice", (60, 80, 100)),
    "prune_every": ("choice", (10, 20)),
}
FIXED_V1 = {"lr": 1e-3}
FIXED_V2 = {"lam_g": 1e-3, "gamma_max": 2.0, "anneal_step": 10}
# The generalised golden ratio of dimension 8; its powers spread points evenly over the cube.
RATIO = 1.0845446615546516


def unit_draw(trial: Column, dimension: int, seed: int = 42) -> Column:
    """Number in [0, 1) from trial, dimension and seed alone, so any trial can be drawn again."""
    step = RATIO ** -(dimension + 1)
    raw = F.lit((seed * 0.6180339887498949) % 1.0) + (trial + 1) * F.lit(step)
    return raw - F.floor(raw)


def trial_space(trials: DataFrame, space: dict, fixed: dict | None = None, seed: int = 42) -> DataFrame:
    """One column per parameter for every row `(trial)`."""
    out = {}
    for d, (name, (kind, *bounds)) in enumerate(space.items()):
        u = unit_draw(F.col("trial"), d, seed)
        if kind == "choice":
            values = bounds[0]
            out[name] = F.array(*[F.lit(v) for v in values])[F.floor(u * len(values)).cast("int")]
        elif kind == "log":
            out[name] = F.lit(bounds[0]) * F.pow(F.lit(bounds[1] / bounds[0]), u)
        else:
            out[name] = F.lit(bounds[0]) + (bounds[1] - bounds[0]) * u
    out.update({name: F.lit(v) for name, v in (fixed or {}).items()})
    return trials.withColumns(out)


def settings_of(row, base: Settings) -> Settings:
    """Settings of one trial row on top of a base."""
    step = int(row["anneal_step"])
    return replace(
        base,
        lambda_collapse=row["lambda_collapse"],
        entropy_weight=row["entropy_weight"],
        lam_g=row["lam_g"],
        lr=row["lr"],
        beta=(2.0, float(row["beta_max"]), step),
        gamma=(1.0, float(row["gamma_max"]), step),
        prune_delay_epoch=int(row["prune_delay_epoch"]),
        prune_every=int(row["prune_every"]),
    )


def schedule_table(trials: DataFrame, epochs: int) -> DataFrame:
    """`(trial, epoch, beta, gamma, prunes)` for epochs 1 to `epochs` of all trials: the rule of
    `operators.fit.schedule` as columns, for settings drawn by `trial_space`."""
    rows = trials.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    steps = F.floor((F.col("epoch") - 1) / F.col("anneal_step"))
    beta = F.least(F.lit(2.0) + F.lit(BETA_STEP) * steps, F.greatest(F.col("beta_max"), F.lit(2.0)))
    gamma = F.least(F.pow(F.lit(GAMMA_STEP), steps), F.greatest(F.col("gamma_max"), F.lit(1.0)))
    prunes = (F.col("epoch") % F.col("prune_every") == 0) & (F.col("epoch") >= F.col("prune_delay_epoch"))
    return rows.select("trial", "epoch", beta.alias("beta"), gamma.alias("gamma"), prunes.alias("prunes"))


def score(q: Column, clusters: Column, version: int) -> Column:
    """Modularity with penalties for too few or too many clusters; no result scores a crash."""
    if version == 1:
        value = F.when((clusters < 5) | (clusters > 60), q - 1000.0).otherwise(q)
    elif version == 2:
        value = F.when(clusters < 5, q - 500.0).when(clusters < 10, q - 100.0).otherwise(q)
    else:
        raise ValueError(f"no scoring version {version}")
    return F.coalesce(value, F.lit(CRASH_SCORE))


def median_stops(history: DataFrame, warmup: int, startup: int = 5) -> DataFrame:
    """`(trial, stop)`: the first step after the warm-up at which the best value of a trial so
    far lies below the median over all trials at that step. The first `startup` trials run on.

    Values are reduced to one per trial and step before anything is ordered, so a trial never
    holds more rows than there are steps.
    """
    per_step = history.groupBy("trial", "step").agg(F.max("value").alias("value"))
    median = exact_median(per_step, "step", "value")
    so_far = Window.partitionBy("trial").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    best = per_step.withColumn("best", F.max("value").over(so_far))
    weak = best.join(median, "step").filter((F.col("step") > warmup) & (F.col("trial") >= startup) & (F.col("best") < F.col("median")))
    return weak.groupBy("trial").agg(F.min("step").alias("stop"))


def best_trial(results: DataFrame) -> DataFrame:
    """The row with the highest score; the earliest trial wins ties."""
    packed = F.struct(*results.columns)
    row = results.agg(F.max_by(packed, F.struct(F.col("score"), -F.col("trial"))).alias("r"))
    return row.select("r.*")


RESULTS = "trial long, q double, clusters long, score double"


def finished_trials(spark: SparkSession, store: str) -> DataFrame:
    """`(trial, q, clusters, score)` of all trials in a stored table; empty if there is none yet."""
    try:
        return spark.read.schema(RESULTS).parquet(store)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RESULTS)


def run_trials(
    blocks: Blocks, pivots: DataFrame, trials: DataFrame, base: Settings, version: int = 2, store: str | None = None, together: int = 16
) -> tuple[DataFrame, dict[int, Fit]]:
    """Fit all trials of a trial table, `together` at a time in joint passes, and score them.

    Returns `(trial, q, clusters, score, parameters...)` and the fits by trial. Clusters in use are
    counted per trial from the pivot embeddings `(id, features)`. A trial that fails scores as a crash
    and does not end the others: trials whose joint fit fails are repeated one by one. With `store`,
    results are appended to that Parquet table after each portion, and trials found there are not run
    again, so a sweep that was cut off goes on where it stopped.
    """
    spark: SparkSession = pivots.sparkSession
    known = {r["trial"] for r in finished_trials(spark, store).select("trial").collect()} if store else set()
    rows = [r for r in trials.orderBy("trial").collect() if r["trial"] not in known]
    warmup = 20 if version == 1 else 30
    fits: dict[int, Fit] = {}
    parts = [] if store else [spark.createDataFrame([], RESULTS)]
    for lo in range(0, len(rows), together):
        part = rows[lo : lo + together]
        found = dict(zip([r["trial"] for r in part], _fitted(blocks, [settings_of(r, base) for r in part], warmup)))
        fits.update({k: f for k, f in found.items() if f is not None})
        used = _clusters_used(pivots, {k: f for k, f in found.items() if f is not None})
        values = [(int(k), float(f.best_q) if f is not None and math.isfinite(f.best_q) else None, used.get(k, 0)) for k, f in found.items()]
        scored = spark.createDataFrame(values, "trial long, q double, clusters long").withColumn("score", score(F.col("q"), F.col("clusters"), version))
        if store:
            scored.coalesce(1).write.mode("append").parquet(store)
        else:
            parts.append(scored)
    results = finished_trials(spark, store) if store else reduce(DataFrame.union, parts)
    return results.join(trials, "trial"), fits


def _fitted(blocks: Blocks, settings: list[Settings], warmup: int) -> list[Fit | None]:
    """Joint fits; if they fail, each alone, and None for those that fail again."""
    try:
        return list(fit_many(blocks, settings, warmup=warmup))
    except Exception as error:
        if len(settings) == 1:
            print(f"trial failed: {error}")
            return [None]
        return [f for s in settings for f in _fitted(blocks, [s], warmup)]


def _clusters_used(pivots: DataFrame, fits: dict[int, Fit]) -> dict[int, int]:
    """Clusters that some pivot belongs to most, per trial; one pass over the pivots for all trials."""
    if not fits:
        return {}
    heads = {k: f.best for k, f in fits.items()}

    def best(batches):
        for batch in batches:
            h = matrix(batch.column(0))
            for k, own in heads.items():
                used = np.unique(own.soft("Y", h).argmax(axis=1)) if len(h) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), k), pa.int64()), pa.array(used, pa.int64())], ["trial", "k"])

    found = pivots.select("features").mapInArrow(best, "trial long, k long")
    return {r["trial"]: r["n"] for r in found.groupBy("trial").agg(F.count_distinct("k").alias("n")).collect()}


def settings_of_best(results: DataFrame, base: Settings) -> Settings:
    """Settings of the best trial of a result table, for the final fit."""
    return settings_of(best_trial(results).first(), base)
