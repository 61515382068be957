"""Learning: forests on features and parameters, boosting, ablation, and the three phases of conditional parameter optimisation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import portfolio
from .joins import shifted


def balanced(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights that make both classes count alike."""
    n = df.agg(F.count(F.lit(1)).alias("__n"), F.sum(label).alias("__p"))
    w = F.when(F.col(label) == 1, F.col("__n") / (2 * F.greatest("__p", F.lit(1)))).otherwise(F.col("__n") / (2 * F.greatest(F.col("__n") - F.col("__p"), F.lit(1))))
    return df.crossJoin(F.broadcast(n)).withColumn(name, w).drop("__n", "__p")


def forest(df: DataFrame, features: list[str], label: str, *, trees: int = 200, depth: int = 5, seed: int = 42):
    """A balanced forest; missing features take their median."""
    filled = [f"{f}__f" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features"), RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(balanced(df, label))


def predict(model, df: DataFrame, name: str = "p_profitable") -> DataFrame:
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def boosted(df: DataFrame, features: list[str], label: str, *, rounds: int = 20, seed: int = 42):
    filled = [f"{f}__f" for f in features]
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="features"), GBTRegressor(labelCol=label, maxIter=rounds, seed=seed, lossType="absolute")]).fit(df)


def auc(df: DataFrame, prob: str, label: str) -> float:
    return BinaryClassificationEvaluator(rawPredictionCol=prob, labelCol=label).evaluate(df)


def ablation(train: DataFrame, test: DataFrame, groups: dict[str, list[str]], label: str, **options) -> dict[str, float]:
    """AUC with all features and without each group of them."""
    every = sorted({f for fs in groups.values() for f in fs})
    out = {"all": auc(predict(forest(train, every, label, **options), test), "p_profitable", label)}
    for name, left_out in groups.items():
        kept = [f for f in every if f not in left_out]
        if kept:
            out[f"without {name}"] = auc(predict(forest(train, kept, label, **options), test), "p_profitable", label)
    return out


# --- conditional parameter optimisation -----------------------------------------------------------------------


def grid_returns(days: DataFrame, configs: DataFrame, run: Callable[[pd.DataFrame, dict], float], *, model: str, day: str) -> DataFrame:
    """Phase 2: the return of every model, day and configuration.

    ``run(bars_of_the_day, config) -> return``.  A task holds the bars of one
    model and day and walks through the configurations there, so bars are not
    multiplied by configurations.
    """
    params = [c for c in configs.columns if c != "config_id"]
    listed = configs.select("config_id", *params).toPandas().to_dict("records")  # the grid is a literal table
    kind = lambda c: days.schema[c].dataType.simpleString()
    sent = days.sparkSession.sparkContext.broadcast(listed)

    def each(g: pd.DataFrame) -> pd.DataFrame:
        head = (g[model].iloc[0], g[day].iloc[0])
        return pd.DataFrame([(*head, c["config_id"], float(run(g, c))) for c in sent.value], columns=[model, day, "config_id", "daily_return"])

    return days.groupBy(model, day).applyInPandas(each, f"`{model}` {kind(model)}, `{day}` {kind(day)}, config_id long, daily_return double")


def training_rows(features: DataFrame, returns: DataFrame, configs: DataFrame, *, model: str, day: str) -> DataFrame:
    """Features of a day and a configuration with the sign of its next day's return."""
    rows = shifted(features, returns, keys=[model], day=day)
    return rows.join(configs, "config_id").withColumn("label", (F.col("daily_return") > 0).cast("double"))


def keep_models(returns: DataFrame, *, model: str, group: str, floor: float = 0.0) -> DataFrame:
    """Models of the groups whose mean of mean returns is above the floor."""
    m = returns.groupBy(model, group).agg(F.avg("daily_return").alias("r"))
    good = m.groupBy(group).agg(F.avg("r").alias("g")).where(F.col("g") > floor).select(group)
    return m.join(good, group, "left_semi").select(model)


def choose(scored: DataFrame, *, model: str, day: str, prob: str = "p_profitable") -> DataFrame:
    """The most probable configuration of each model and day."""
    best = F.max_by(F.struct("config_id", F.col(prob).alias("p")), F.struct(prob, -F.col("config_id")))
    return scored.groupBy(model, day).agg(best.alias("b")).select(model, day, "b.config_id", F.col("b.p").alias(prob))


def out_of_sample(chosen: DataFrame, returns: DataFrame, *, model: str, day: str, gate: float = 0.5, leverage: float = 1.0, cap: float = 0.25) -> DataFrame:
    """Phase 4 with equal weights: the gate, the weights and the profit of each day, as one window."""
    gated = portfolio.gated_equal_weight(chosen, day=day, prob="p_profitable", gate=gate, leverage=leverage, cap=cap)
    rows = gated.join(returns, [model, day, "config_id"]).withColumn("pnl", F.col("weight") * F.col("daily_return"))
    days = rows.groupBy(day).agg(F.sum("pnl").alias("pnl"), F.sum(F.col("active").cast("int")).alias("active"))
    w = Window.orderBy(day)  # one row a day
    return days.withColumn("cumulative", F.sum("pnl").over(w.rowsBetween(Window.unboundedPreceding, 0)))
