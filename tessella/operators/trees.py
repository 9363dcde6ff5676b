"""Tree ensembles for classifiers, hold-outs and nuisances. Spark trains them; draws have fixed seeds, and rows are dealt and ordered by key, so that reruns agree."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import quantiles
from tessella.operators.estimators import grams, linear, solved
from tessella.operators.learning import balanced_weights, errors, lead_target, logistic
from tessella.operators.metrics import auc
from tessella.operators.regression import ols
from tessella.sources.tables import Stages

SEED, PARTS = 42, 16
#: Weight of the Brier score against AUC in the choice of a classifier; fixed value.
BRIER = 0.15


def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in the same parts and order at each run: what bootstrap draws go by."""
    return df.repartition(PARTS, *keys).sortWithinPartitions(*keys)


def filled(train: DataFrame, others: list[DataFrame], xs: list[str]) -> list[DataFrame]:
    """``train`` and the others with nulls and NaN of ``xs`` as the training median; a column without any value is 0. Medians are taken of columns with gaps only."""
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    every = reduce(DataFrame.union, [d.select(*[known(c).alias(c) for c in xs]) for d in (train, *others)])
    gaps = every.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in xs]).first()
    medians = {c: quantiles(train.select(known(c).alias("x")), "x", [0.5])[0] or 0.0 for c in xs if gaps[c]}
    return [d.withColumns({c: F.coalesce(known(c), F.lit(medians.get(c))) for c in xs}) for d in (train, *others)]


def with_vector(df: DataFrame, xs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=xs, outputCol="_x").transform(df)


def classifier(train: DataFrame, dealt: DataFrame, y: str, xs: list[str], learner: str, weight: str, trees: int) -> Callable[[DataFrame], DataFrame]:
    """What adds to a table p, the chance of y = 1 by a model of ``train`` (``dealt``: the same rows in order, with _x and _y): ``logit``, ``forest`` or ``boosting``."""
    if learner == "logit":
        beta = logistic(train, y, xs, F.col(weight))
        return lambda t: t.withColumn("p", 1 / (1 + F.exp(-linear(beta, xs))))
    common = {"featuresCol": "_x", "labelCol": "_y", "weightCol": weight, "seed": SEED}
    if learner == "forest":
        model = RandomForestClassifier(numTrees=trees, maxDepth=8, minInstancesPerNode=10, **common)
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=2, stepSize=0.1, subsamplingRate=0.9, **common)
    fit = model.fit(dealt.select("_x", "_y", weight))
    return lambda t: fit.transform(with_vector(t, xs)).withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def chosen_classifier(panel: DataFrame, y: str, xs: list[str], learners: tuple[str, ...] = ("logit", "forest", "boosting"), keys: tuple[str, ...] = ("unit", "t"), trees: int = 40) -> DataFrame:
    """By learner and weights (none; balanced classes): AUC, Brier score and objective AUC - BRIER * Brier in the last period but one, of models of the periods before; and of the
    best of these (ties: the first by name), AUC and Brier score in the last period, that had no say in the choice.

    Rows without ``y`` go; nulls of ``xs`` are the median of the rows learned from. Needs three periods, and both classes to learn from, else no rows.
    """
    stages = Stages(panel.sparkSession, "classifier")
    d = stages.cut(panel.filter(F.col(y).isNotNull()).select(*keys, y, *[F.col(c).cast("double").alias(c) for c in xs]), "rows")
    times = [r.t for r in d.select("t").distinct().orderBy(F.desc("t")).limit(3).collect()]
    schema = "learner string, weights string, auc double, brier double, objective double, chosen int, test_auc double, test_brier double, n_train long"
    train = d.filter(F.col("t") < times[1]) if len(times) == 3 else d.limit(0)
    n, kinds = train.agg(F.count("*"), F.countDistinct(y)).first()
    if kinds < 2:
        return panel.sparkSession.createDataFrame([], schema)
    weights = {"none": F.lit(1.0), "balanced": balanced_weights(train, y)}
    train, *later = filled(train, [d.filter(F.col("t") == times[1]), d.filter(F.col("t") == times[0])], xs)
    train = stages.cut(train.withColumns({"_y": F.col(y).cast("double")} | weights), "train")
    check, test = (stages.cut(rows, name) for rows, name in zip(later, ("check", "test"), strict=True))  # a period each, read by every model
    dealt = ordered(with_vector(train, xs), list(keys)).select("_x", "_y", *weights).persist()  # dealt and sorted once for all models

    def figures(score: Callable[[DataFrame], DataFrame], rows: DataFrame, name: str) -> tuple:
        scored = stages.cut(score(rows).select(y, "p"), name)
        return (*auc(scored, y, "p").select("auc").first(), *scored.agg(F.avg(F.pow(F.col("p") - F.col(y), 2))).first())

    found, scores = [], {}
    for learner in learners:
        for name in weights:
            scores[learner, name] = classifier(train, dealt, y, xs, learner, name, trees)
            auc_, brier = figures(scores[learner, name], check, f"{learner}_{name}")
            found.append((learner, name, auc_, brier, None if auc_ is None else auc_ - BRIER * brier))
    dealt.unpersist()
    best = max(found, key=lambda r: (-np.inf if r[4] is None else round(r[4], 9), [-ord(c) for c in r[0] + r[1]]))
    last = figures(scores[best[:2]], test, "last")
    rows = [(*r, int(r is best), *(last if r is best else (None, None)), n) for r in found]
    return panel.sparkSession.createDataFrame(rows, schema)


def forest(train: DataFrame, tests: list[DataFrame], y: str, xs: list[str], name: str, keys: list[str], trees: int) -> list[DataFrame]:
    """``tests`` with ``name``: y by a random forest of ``train``."""
    rows = ordered(with_vector(train.withColumn("_y", F.col(y).cast("double")), xs), keys).select("_x", "_y")
    fit = RandomForestRegressor(featuresCol="_x", labelCol="_y", predictionCol=name, numTrees=trees, maxDepth=8, minInstancesPerNode=5, seed=SEED).fit(rows)
    return [fit.transform(with_vector(t, xs)).drop("_x") for t in tests]


def tree_holdout(panel: DataFrame, y: str, xs: list[str], split: int, trees: int = 40) -> DataFrame:
    """One row: errors of next-period forecasts after ``split`` by a random forest and a linear model of the rows up to it, the training mean, and the present value, and the
    forest's gain in rmse over the linear model. Rows without a next value or with nulls in ``xs`` go; none to learn from or to test: no row."""
    rows = lead_target(panel, y).na.drop(subset=["target", *xs])
    d = Stages(panel.sparkSession, "tree_holdout").cut(rows.select("unit", "t", y, "target", *[c for c in xs if c != y]), "rows")
    train, test = d.filter(F.col("t") <= split), d.filter(F.col("t") > split)
    gram = grams(train.withColumn("_k", F.lit(0)), [*xs, "target"], "_k").get(0)
    if gram is None or test.isEmpty():
        empty = test.agg(F.count("*").alias("n_test"), *errors("target", y, "forest"), *errors("target", y, "linear"), *errors("target", y, "mean"), *errors("target", y, "persistence"), F.lit(0.0).alias("gain"))
        return empty.filter("n_test < 0")
    (found,) = forest(train, [test], "target", xs, "forest", ["unit", "t"], trees)
    found = found.withColumn("linear", linear(solved(gram), xs)).withColumn("mean", F.lit(float(gram[0, -1] / gram[0, 0])))
    e = found.agg(F.count("*").alias("n_test"), *errors("target", "forest", "forest"), *errors("target", "linear", "linear"), *errors("target", "mean", "mean"), *errors("target", y, "persistence"))
    return e.withColumn("gain", F.col("linear_rmse") - F.col("forest_rmse"))


def forest_double_ml(panel: DataFrame, y: str, d: str, xs: list[str], cluster: str = "cl", folds: int = 3, trees: int = 30) -> DataFrame:
    """The partially linear effect of ``d`` on ``y``: both less what forests of the other folds (of whole clusters, by hash) say by ``xs``, then least squares of one rest on the other
    with clustered errors. term, coef, stderr, t_value, n_obs, n_clusters. Rows with nulls go; folds without others to learn from are left out."""
    rows = panel.select("unit", cluster, "t", *dict.fromkeys([y, d, *xs])).na.drop()
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(F.col(cluster).cast("string")), F.lit(folds)).cast("int"))
    rows = Stages(panel.sparkSession, "forest_dml").cut(rows, "rows")
    out = None
    present = sorted(r[0] for r in rows.select("_fold").distinct().collect())
    for k in present if len(present) > 1 else []:
        train, test = rows.filter(F.col("_fold") != k), rows.filter(F.col("_fold") == k)
        (a,) = forest(train, [test], y, xs, "_py", ["unit", "t"], trees)
        (b,) = forest(train, [a], d, xs, "_pd", ["unit", "t"], trees)
        part = b.select(F.col(cluster), (F.col(y) - F.col("_py")).alias("ry"), (F.col(d) - F.col("_pd")).alias("rd"))
        out = part if out is None else out.union(part)
    if out is None:
        return ols(rows.limit(0).select(cluster, F.lit(0.0).alias("ry"), F.lit(0.0).alias("rd")), "ry", ["rd"], cluster).filter("n_obs > 0")
    return ols(Stages(panel.sparkSession, "forest_rest").cut(out, "rows"), "ry", ["rd"], cluster)
