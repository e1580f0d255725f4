"""Conversation archetypes: TF-IDF of intent n-grams, clusters, and their summary."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _turn():
    return Window.partitionBy("conversation_id").orderBy("turn_index")


def terms(signals: DataFrame) -> DataFrame:
    """(conversation_id, term): every intent, and every two that follow one another."""
    rows = signals.select("conversation_id", F.lower("intent").alias("a"), F.lower(F.lead("intent").over(_turn())).alias("b"))
    return rows.select("conversation_id", F.explode(F.array_compact(F.array("a", F.when(F.col("b").isNotNull(), F.concat_ws(" ", "a", "b"))))).alias("term"))


def intent_tfidf(signals: DataFrame) -> DataFrame:
    """(conversation_id, term, weight): counts times ln((1 + n) / (1 + df)) + 1, of unit length."""
    tf = terms(signals).groupBy("conversation_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = signals.select("conversation_id").distinct().agg(F.count("*").alias("n"))
    w = tf.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("conversation_id")))
    return w.select("conversation_id", "term", (F.col("w") / length).alias("weight"))


def tfidf_vectors(signals: DataFrame, vocabulary: int = 1 << 18) -> DataFrame:
    """(conversation_id, features): intent_tfidf as unit vectors. `vocabulary` bounds the terms that the
    driver holds; there are at most as many as intents and pairs of intents."""
    docs = terms(signals).groupBy("conversation_id").agg(F.collect_list("term").alias("terms"))
    tf = CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=vocabulary).fit(docs).transform(docs)
    idf = IDF(inputCol="tf", outputCol="_").fit(tf).idf.toArray() + 1
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="w").transform(tf)
    return Normalizer(inputCol="w", outputCol="features").transform(scaled).select("conversation_id", "features")


def archetypes(signals: DataFrame, ks: range = range(3, 9), starts: int = 3) -> DataFrame:
    """(conversation_id, cluster) by k-means over TF-IDF vectors: for each k the best of so many starts,
    of the ks the one with the best silhouette, the least of equals; 0 for all where none fits."""
    x = tfidf_vectors(signals).cache()
    # no more clusters than different vectors
    n, distinct = x.count(), x.select("features").distinct().count()
    ks = sorted({min(k, distinct) for k in ks if k < n and distinct > 1})
    best, judge = None, ClusteringEvaluator()
    for k in ks:
        model = min((KMeans(k=k, seed=seed, initSteps=2).fit(x) for seed in range(42, 42 + starts)), key=lambda m: m.summary.trainingCost)
        made = model.transform(x)
        if made.select("prediction").distinct().count() < 2:
            continue
        score = judge.evaluate(made)
        if best is None or score > best[0] + 1e-12:
            best = (score, made)
    out = best[1].select("conversation_id", F.col("prediction").alias("cluster")) if best else x.select("conversation_id", F.lit(0).alias("cluster"))
    x.unpersist()
    return out


def archetype_members(assigned: DataFrame, convs: DataFrame) -> DataFrame:
    return assigned.join(convs.select("conversation_id", "outcome"), "conversation_id")


def archetype_summary(assigned: DataFrame, convs: DataFrame, signals: DataFrame, top: int = 4) -> DataFrame:
    """Size, conversion rate and commonest intents of each cluster."""
    both = assigned.join(convs.select("conversation_id", "converted"), "conversation_id")
    sizes = both.groupBy("cluster").agg(F.count("*").alias("size"), F.avg(F.col("converted").cast("double")).alias("conv_rate"))
    counts = signals.join(both.select("conversation_id", "cluster"), "conversation_id").groupBy("cluster", "intent").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "intent"))
    named = counts.withColumn("r", rank).where(F.col("r") <= top).groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "intent"))), lambda x: x["intent"]), ", ").alias("top_intents"))
    return sizes.join(named, "cluster", "left").select("cluster", "size", F.round("conv_rate", 6).alias("conv_rate"), F.coalesce("top_intents", F.lit("")).alias("top_intents")).orderBy("conv_rate", "cluster")
