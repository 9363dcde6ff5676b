"""Queries of the tree ensembles. Their draws have no SQL; tests hold them to bounds of error on known tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import dynamics as D
from tessella.operators import trees as T
from tessella.plans import views as V
from tessella.plans.regression_queries import _syd
from tessella.plans.registry import query
from tessella.plans.shaping_queries import r


@query()
def m11_tree_classifier(spark, sf):
    """Users' days: whether the next day's value falls, by five figures of the days so far."""
    p = V.panel_ud(spark, sf)
    rows = D.growths(p).select("unit", "t", (F.col("growth_next") < 0).cast("int").alias("y"), "value", "growth", "vol_3", F.col("n").cast("double").alias("n"), F.col("kinds").cast("double").alias("kinds"))
    return r(T.chosen_classifier(rows, "y", ["value", "growth", "vol_3", "n", "kinds"], trees=15), "auc", "brier", "objective", "test_auc", "test_brier", digits=4)


@query()
def m8_tree_holdout(spark, sf):
    kinds = [f"{m}_{e}" for m in ("forest", "linear", "mean", "persistence") for e in ("rmse", "mae", "r2")]
    return r(T.tree_holdout(_syd(spark, sf), "y", ["y", "x"], 1999, trees=15), *kinds, "gain", digits=4)


@query()
def k22_forest_double_ml(spark, sf):
    found = T.forest_double_ml(_syd(spark, sf).withColumn("period", F.col("t").cast("double")), "y", "did", ["x", "period"], trees=15)
    return r(found.select("term", "coef", "stderr", "n_obs", "n_clusters"), "coef", "stderr", digits=4)
