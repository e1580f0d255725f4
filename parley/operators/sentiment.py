"""Sentiment trajectories and what they have to do with conversion."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import correlation_p

FEATURES = ("mean", "final", "min", "max_drop", "slope", "neg_run_len", "start_to_end", "n_client_turns")


def _turn():
    return Window.partitionBy("conversation_id").orderBy("turn_index")


def _up_to():
    return _turn().rowsBetween(Window.unboundedPreceding, 0)


def _client(signals: DataFrame) -> DataFrame:
    return signals.where("role = 'client' and sentiment is not null")


def trajectory_features(signals: DataFrame) -> DataFrame:
    """Eight numbers of each conversation's client sentiments: one shuffle by conversation."""
    rows = _client(signals).select("conversation_id", "turn_index", F.col("sentiment").alias("v"), (F.row_number().over(_turn()) - 1).alias("i"))
    v, i = F.col("v"), F.col("i")
    rows = rows.withColumns({"drop": F.max(v).over(_up_to()) - v, "last_ok": F.max(F.when(v >= 0, i)).over(_up_to())})
    return rows.groupBy("conversation_id").agg(
        F.avg(v).alias("mean"), F.max_by(v, i).alias("final"), F.min(v).alias("min"), F.max("drop").alias("max_drop"),
        F.coalesce(F.regr_slope(v, i), F.lit(0.0)).alias("slope"), F.coalesce(F.max(F.when(v < 0, i - F.coalesce("last_ok", F.lit(-1)))), F.lit(0)).alias("neg_run_len"),
        (F.max_by(v, i) - F.min_by(v, i)).alias("start_to_end"), F.count("*").alias("n_client_turns"),
    )


def avg_trajectory(signals: DataFrame, convs: DataFrame, bins: int = 10) -> DataFrame:
    """Mean sentiment by share of the conversation gone, for converted and other ones."""
    rows = _client(signals).select("conversation_id", "turn_index", "sentiment").join(convs.select("conversation_id", "converted"), "conversation_id")
    i, n = F.row_number().over(_turn()) - 1, F.count("*").over(Window.partitionBy("conversation_id"))
    rows = rows.select("converted", "sentiment", F.when(n > 1, F.least((i / n * bins).cast("int"), F.lit(bins - 1))).otherwise(0).alias("bin"))
    return rows.groupBy("bin", "converted").agg(F.avg("sentiment").alias("mean"), F.count("*").alias("n"))


def correlations(features: DataFrame, convs: DataFrame) -> DataFrame:
    """Correlation of each feature with conversion, p-value, and Benjamini-Hochberg's. All sums
    come from one aggregation; its eight results are ranked on the driver."""
    both = features.select("conversation_id", *FEATURES).join(convs.select("conversation_id", F.col("converted").cast("double").alias("y")), "conversation_id")
    row = both.agg(F.count("*").alias("n"), F.stddev_pop("y").alias("sy"), *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES], *[F.covar_pop(f, "y").alias(f"c_{f}") for f in FEATURES]).first()
    found = []
    for f in FEATURES:
        flat = not row.sy or not row[f"s_{f}"] or row[f"s_{f}"] < 1e-12
        r = 0.0 if flat else max(-1.0, min(1.0, row[f"c_{f}"] / (row[f"s_{f}"] * row.sy)))
        found.append((f, float(r), 1.0 if flat else correlation_p(r, row.n)))
    found.sort(key=lambda x: x[2])
    adjusted, least = [], 1.0
    for k in range(len(found), 0, -1):
        least = min(least, found[k - 1][2] * len(found) / k)
        adjusted.append(least)
    rows = [(f, r, p, q, "higher → converts" if r >= 0 else "higher → loses") for (f, r, p), q in zip(found, reversed(adjusted), strict=True)]
    return features.sparkSession.createDataFrame(rows, "feature string, r double, p_value double, p_adj double, direction string").orderBy(F.desc(F.abs("r")), "feature")


def trajectory_summary(features: DataFrame, convs: DataFrame) -> DataFrame:
    both = features.join(convs.select("conversation_id", "converted"), "conversation_id")
    return both.agg(F.count("*").alias("n"), F.count_if("converted").alias("converted"), F.count_if(~F.col("converted")).alias("lost"))


def stratified(rows: DataFrame, folds: int, buckets: int = 64) -> DataFrame:
    """rows (conversation_id, y, ...) with `fold`: in the order of a hash, the rows of each class are
    dealt in turn, so that folds differ by one row of a class at most. Rows are ranked in buckets of the
    hash; only the buckets' counts are summed over a whole class."""
    h = F.xxhash64("conversation_id")
    rows = rows.withColumn("_b", F.pmod(h, F.lit(buckets)))
    sums = Window.partitionBy("y").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("y", "_b").agg(F.count("*").alias("_n")).select("y", "_b", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("y", "_b").orderBy(h, "conversation_id"))
    ranked = rows.withColumn("_r", own).join(before, ["y", "_b"])
    return ranked.withColumn("fold", F.pmod(F.col("_before") + F.col("_r"), F.lit(folds))).drop("_b", "_r", "_before")


def logistic_auc(features: DataFrame, convs: DataFrame, folds: int = 5) -> DataFrame:
    """Mean area under the ROC curve of a logistic model over the features, by stratified folds; NaN
    with one class or under ten conversations."""
    both = features.select("conversation_id", *FEATURES).join(convs.select("conversation_id", F.col("converted").cast("double").alias("y")), "conversation_id")
    both = stratified(both, folds)
    size = both.agg(F.count("*").alias("n"), F.countDistinct("y").alias("k")).first()
    if size.n < 10 or size.k < 2:
        return features.sparkSession.range(1).select(F.lit(float("nan")).alias("auc"), F.lit(size.n).cast("long").alias("n"))
    x = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(both)
    x = StandardScaler(withMean=True, inputCol="raw", outputCol="x").fit(x).transform(x).select("x", "y", "fold").cache()
    scores, judge = [], BinaryClassificationEvaluator(labelCol="y")
    for k in range(folds):
        train, test = x.where(F.col("fold") != k), x.where(F.col("fold") == k)
        if train.select("y").distinct().count() < 2 or test.select("y").distinct().count() < 2:
            continue
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / train.count(), standardization=False).fit(train)
        scores.append(judge.evaluate(model.transform(test)))
    x.unpersist()
    auc = sum(scores) / len(scores) if scores else float("nan")
    return features.sparkSession.range(1).select(F.lit(auc).alias("auc"), F.lit(size.n).cast("long").alias("n"))
