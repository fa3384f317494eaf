"""Feature matrices, preprocessing, linear and tree models, household-grouped validation, persistence, transfer (M rows)."""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scan import exact_quantiles
from .aggregate import scale_free
from .linear import gram, held_out_mse, solve_linear, sub_gram


# ------------------------------------------------------------------ features and preprocessing
def feature_matrix(raw: DataFrame, key: str, anchors: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Scale-free columns in a fixed order plus the size anchors; infinities become NULL. Columns a data set lacks are NULL."""
    cols = scale_free(raw.columns) if columns is None else columns
    clean = lambda c: F.when(F.abs(F.col(f"`{c}`")) != float("inf"), F.col(f"`{c}`")).alias(c)
    have = set(raw.columns)
    d = raw.select(key, *[clean(c) if c in have else F.lit(None).cast("double").alias(c) for c in cols])
    a = anchors.select(key, *[F.col(c).cast("double").alias(f"Feature Scale_{c}") for c in anchors.columns if c != key])
    return d.join(a, key)


def fit_prep(train: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Median, mean and population sd of each feature per key, fitted on the given rows only; a feature without values has median 0."""
    long = train.select(*keys, F.explode(F.create_map(*[x for f in features for x in (F.lit(f), F.col(f"`{f}`").cast("double"))])).alias("feature", "x"))
    med = exact_quantiles(long, [*keys, "feature"], "x", {"median": 0.5}, cuts=16).drop("n")
    base = long.groupBy(*keys, "feature").agg(F.count("*").alias("_n"), F.count("x").alias("_k"), F.sum("x").alias("_s"), F.sum(F.col("x") * F.col("x")).alias("_q"))
    m = F.coalesce("median", F.lit(0.0))
    miss = F.col("_n") - F.col("_k")
    mean = (F.coalesce("_s", F.lit(0.0)) + miss * m) / F.col("_n")
    var = (F.coalesce("_q", F.lit(0.0)) + miss * m * m) / F.col("_n") - mean * mean
    return base.join(med, [*keys, "feature"], "left").select(*keys, "feature", m.alias("median"), mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))


def apply_prep(df: DataFrame, prep: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Imputed and standardised features (a constant feature becomes 0). The parameters are one row per key."""
    p = prep.groupBy(*keys).pivot("feature", features).agg(F.first("median").alias("m"), F.first("mean").alias("a"), F.first("sd").alias("s"))
    j = df.join(p, keys) if keys else df.join(F.broadcast(p))      # without keys the parameters are one row
    z = lambda f: (F.coalesce(F.col(f"`{f}`").cast("double"), F.col(f"`{f}_m`")) - F.col(f"`{f}_a`")) / F.when(F.col(f"`{f}_s`") > 1e-12, F.col(f"`{f}_s`"))
    rest = [c for c in df.columns if c not in features]
    return j.select(*rest, *[F.coalesce(z(f), F.lit(0.0)).alias(f) for f in features])


def to_target(y: Column, kind: str) -> Column:
    return F.log(y) if kind == "log" else y


def from_target(p: Column, kind: str, clip: bool = True) -> Column:
    """Prediction back on the kW scale, without smearing, clipped at 0."""
    v = F.exp(p) if kind == "log" else p
    return F.greatest(v, F.lit(0.0)) if clip else v


# ------------------------------------------------------------------ grouped validation of the linear family
def linear_grid(alphas=(0.01, 0.1, 1.0, 10.0), ratios=(0.2, 0.5, 0.8), components=(1, 2, 3)) -> list[tuple[str, dict]]:
    return ([("linear", {})] + [("ridge", {"alpha": a}) for a in alphas] + [("lasso", {"alpha": a}) for a in alphas]
            + [("elasticnet", {"alpha": a, "l1_ratio": r}) for a in alphas for r in ratios] + [("pls", {"k": k}) for k in components])


def tune_linear(inner: DataFrame, final: DataFrame, keys: list[str], fold: str, features: list[str], y: str, grid: list[tuple[str, dict]]) -> DataFrame:
    """Household-grouped validation of every candidate: the loss of a candidate is the mean over folds of its error on the fold it was not
    fitted on. One pass adds up the Gram rows per fold; all candidates, folds and refits are solved from them.
    Returns keys, kind, params, cv_mse, best (per kind), coef (refit on `final`)."""
    g = gram(inner, [*keys, fold], features, y).select(*keys, F.col(fold).cast("int").alias("_f"), "g")
    t = gram(final, keys, features, y).select(*keys, F.lit(-1).alias("_f"), "g")

    def per_key(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, A = pdf[pdf["_f"] >= 0], np.vstack(pdf[pdf["_f"] >= 0]["g"].to_numpy())
        full, f, out = pdf[pdf["_f"] < 0]["g"].iloc[0], rows["_f"].to_numpy(), []
        for kind, opt in grid:
            loss = np.mean([held_out_mse(solve_linear(A[f != k].sum(0), kind, **opt), A[f == k].sum(0)) for k in np.unique(f)])
            out.append((kind, str(sorted(opt.items())), float(loss), solve_linear(full, kind, **opt).tolist()))
        r = pd.DataFrame(out, columns=["kind", "params", "cv_mse", "coef"])
        r["best"] = r.groupby("kind")["cv_mse"].transform("min") == r["cv_mse"]
        for k in keys:
            r[k] = pdf[k].iloc[0]
        return r[[*keys, "kind", "params", "cv_mse", "best", "coef"]]

    types = dict(inner.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    # one task holds a key's Gram rows: folds x (p+1)^2 numbers
    return g.unionByName(t).groupBy(*keys).applyInPandas(per_key, f"{schema}, kind string, params string, cv_mse double, best boolean, coef array<double>")


def out_of_fold(inner: DataFrame, keys: list[str], fold: str, features: list[str], y: str, kind: str, **opt) -> DataFrame:
    """Predictions of each row by a model fitted without its fold."""
    g = gram(inner, [*keys, fold], features, y)
    k = (len(features) + 2) * (len(features) + 3) // 2
    outs = g.select(*keys, F.col(fold).alias("_out")).distinct()
    tot = g.join(outs, keys).where(F.col(fold) != F.col("_out")).groupBy(*keys, "_out").agg(*[F.sum(F.col("g")[i]).alias(f"_{i}") for i in range(k)])
    from .linear import solver
    s = solver("ols" if kind == "linear" else kind, **opt)
    c = tot.select(*keys, F.col("_out").alias(fold), s(F.array(*[F.col(f"_{i}") for i in range(k)])).alias("coef"))
    x = reduce(lambda a, i: a + F.col("coef")[i + 1] * F.col(features[i]), range(len(features)), F.col("coef")[0])
    return inner.join(c, [*keys, fold]).withColumn("oof", x).drop("coef")


# ------------------------------------------------------------------ trees
def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def tree_model(kind: str, seed: int = 0, **opt):
    """Random forest, or gradient-boosted trees that stop early on rows flagged in the column `is_stop`."""
    if kind == "forest":
        return RandomForestRegressor(featuresCol="features", labelCol="y", seed=seed, numTrees=opt.get("trees", 20), maxDepth=opt.get("depth", 5), subsamplingRate=opt.get("rate", 1.0))
    return GBTRegressor(featuresCol="features", labelCol="y", seed=seed, maxIter=opt.get("iters", 20), maxDepth=opt.get("depth", 3), stepSize=opt.get("step", 0.1),
                        validationIndicatorCol="is_stop", validationTol=opt.get("tol", 0.01))


def tune_trees(inner: DataFrame, final: DataFrame, fold: str, n_folds: int, candidates: list[tuple[str, dict]], seed: int = 0):
    """For each candidate: fit without the fold and its successor, stop early on the successor, score on the fold; the best candidate
    is refitted on all train rows at the median number of trees. Returns (model, table of losses, out-of-fold predictions)."""
    spark, runs, best = inner.sparkSession, [], None
    for kind, opt in candidates:
        losses, iters, oofs = [], [], []
        for k in range(n_folds):
            nxt = (k + 1) % n_folds
            d = inner.withColumn("is_stop", F.col(fold) == nxt)
            m = tree_model(kind, seed, **opt).fit(d.where(F.col(fold) != k))      # the stopping fold is only read for the stop
            p = m.transform(d.where(F.col(fold) == k)).withColumnRenamed("prediction", "oof")
            losses.append(p.agg(F.avg(F.pow(F.col("oof") - F.col("y"), 2))).first()[0])
            iters.append(m.getNumTrees)
            oofs.append(p)
        loss = float(np.mean([x for x in losses if x is not None]))
        runs.append((kind, str(sorted(opt.items())), loss, int(np.median(iters))))
        if best is None or loss < best[0]:
            best = (loss, kind, {**opt, "iters": int(np.median(iters))}, reduce(lambda a, b: a.unionByName(b), oofs))
    model = tree_model(best[1], seed, **best[2]).fit(final.withColumn("is_stop", F.lit(False))) if best[1] == "forest" else GBTRegressor(
        featuresCol="features", labelCol="y", seed=seed, maxIter=best[2]["iters"], maxDepth=best[2].get("depth", 3), stepSize=best[2].get("step", 0.1)).fit(final)
    table = spark.createDataFrame(runs, "kind string, params string, cv_mse double, iters int")
    return model, table, best[3]


def plain_search(df: DataFrame, fold: str, n_folds: int, regs=(0.0, 0.1), nets=(0.0, 1.0), metric: str = "rmse"):
    """Plain K-fold search over a parameter grid on a given fold column."""
    lr = LinearRegression(featuresCol="features", labelCol="y", standardization=False)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(regs)).addGrid(lr.elasticNetParam, list(nets)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y", metricName=metric), numFolds=n_folds, foldCol=fold, parallelism=2)
    return cv.fit(df)


def importances(inner: DataFrame, fold: str, n_folds: int, features: list[str], seed: int = 0) -> DataFrame:
    """Feature importances of a forest fitted without each fold, averaged over folds."""
    out = []
    for k in range(n_folds):
        m = tree_model("forest", seed).fit(inner.where(F.col(fold) != k))
        out.append(m.featureImportances.toArray())
    mean = np.mean(out, axis=0)
    return inner.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, mean)], "feature string, importance double")


def selection_curve(inner: DataFrame, fold: str, order: list[str], y: str, alpha: float = 1.0) -> DataFrame:
    """Validation error of the first k features of an order, k = 1..p, with its standard error over folds; every k is a sub-matrix of
    the same Gram rows."""
    g = gram(inner, [fold], order, y).select(F.col(fold).cast("int").alias("_f"), "g")

    def curve(pdf: pd.DataFrame) -> pd.DataFrame:
        f, A, out = pdf["_f"].to_numpy(), np.vstack(pdf["g"].to_numpy()), []
        for k in range(1, len(order) + 1):
            keep = list(range(k))
            e = [np.sqrt(held_out_mse(solve_linear(sub_gram(A[f != j].sum(0), keep), "ridge", alpha=alpha), sub_gram(A[f == j].sum(0), keep))) for j in np.unique(f)]
            out.append((k, float(np.mean(e)), float(np.std(e, ddof=1) / np.sqrt(len(e)))))
        return pd.DataFrame(out, columns=["k", "mean", "se"])
    return g.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda p: curve(p), "k int, mean double, se double")


# ------------------------------------------------------------------ specs, persistence, transfer
def specs(methods: DataFrame, anchors: list[str], sets: list[str], modes: list[str], transforms: list[str], residual_only_log: bool = True) -> DataFrame:
    """All (method, anchor, feature set, mode, transform) specs that the restrictions allow; residual modes always use the log target."""
    ex = lambda d, n, v: d.withColumn(n, F.explode(F.array(*[F.lit(x) for x in v])))
    d = ex(ex(ex(ex(methods, "anchor", anchors), "feature_set", sets), "mode", modes), "target_transform", transforms)
    ok = F.lit(True)
    if residual_only_log:
        ok = ok & ((F.col("mode") != "residual") | (F.col("target_transform") == "log"))
    ok = ok & ((F.col("feature_set") != "-") | (F.col("anchor") != "none"))       # a spec without features needs an anchor
    return d.where(ok)


def save_model(model: PipelineModel, path: str, manifest: DataFrame) -> None:
    model.write().overwrite().save(f"{path}/model")
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")


def reload_check(saved: DataFrame, again: DataFrame, key: str, pred: str, tol: float = 1e-9) -> DataFrame:
    j = saved.select(key, F.col(pred).alias("_a")).join(again.select(key, F.col(pred).alias("_b")), key, "full_outer")
    rel = F.abs(F.col("_a") - F.col("_b")) / F.greatest(F.abs("_a"), F.lit(1e-12))
    return j.agg(F.count("*").alias("n"), F.max(rel).alias("max_rel"), F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("n_unmatched")).withColumn(
        "passed", (F.coalesce("max_rel", F.lit(0.0)) <= tol) & (F.col("n_unmatched") == 0))


def fit_pipeline(train: DataFrame, features: list[str], stage) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), stage]).fit(train)


def vector_columns(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    a = vector_to_array(F.col(col))
    return df.select(*[c for c in df.columns if c != col], *[a[i].alias(n) for i, n in enumerate(names)])
