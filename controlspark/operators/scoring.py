"""TF-IDF ranking of masters for requirements: a token equi-join is the inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textnorm import tokens


def weights(masters: DataFrame, requirements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, token, w) of each side, L2-normed; idf from masters, 1.0 for tokens they lack."""
    count = lambda df: df.select("id", F.explode(tokens(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))
    m, r = count(masters), count(requirements)
    n = masters.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"))
    idf = m.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("token", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def normed(side: DataFrame) -> DataFrame:
        raw = side.join(idf, "token", "left").select("id", "token", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(1.0))).alias("w"))
        norm = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return raw.join(norm, "id").select("id", "token", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("w"))

    return normed(m), normed(r)


def scores(masters: DataFrame, requirements: DataFrame) -> DataFrame:
    m, r = weights(masters, requirements)
    both = r.select(F.col("id").alias("requirement"), "token", F.col("w").alias("a")).join(m.select(F.col("id").alias("master"), "token", F.col("w").alias("b")), "token")
    return both.groupBy("requirement", "master").agg(F.sum(F.col("a") * F.col("b")).alias("raw"))


def top_k(masters: DataFrame, requirements: DataFrame, k: int = 3, least: float = 0.25) -> DataFrame:
    """requirement, rank, master, score: the threshold holds before rounding, ties go to the smaller id."""
    found = scores(masters, requirements).where(F.col("raw") >= least).withColumn("score", F.round("raw", 4))
    order = Window.partitionBy("requirement").orderBy(F.desc("score"), "master")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("requirement", F.col("rank").cast("bigint").alias("rank"), "master", "score")


def evidence_terms(masters: DataFrame, requirements: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """requirement, master, evidence of each pair: the shared tokens that add most to its score, the heaviest first, ties by name."""
    m, r = weights(masters, requirements)
    r = r.select(F.col("id").alias("requirement"), "token", F.col("w").alias("a"))
    m = m.select(F.col("id").alias("master"), "token", F.col("w").alias("b"))
    both = pairs.select("requirement", "master").join(r, "requirement").join(m, ["master", "token"])
    heavy = F.array_sort(F.collect_list(F.struct((-F.col("a") * F.col("b")).alias("w"), "token")))
    return both.groupBy("requirement", "master").agg(F.array_join(F.slice(heavy, 1, most)["token"], ", ").alias("evidence"))
