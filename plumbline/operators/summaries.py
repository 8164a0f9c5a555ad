"""Summaries of experiments' records: agreement of scores with causes, generation by arm, accuracy of causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_agreement(records: DataFrame, score: str, failed: Column, threshold: float) -> DataFrame:
    """(r, kappa, n, agreement) in one row: a score against failures, as it is and as the rule "below the threshold".

    Null where there is no variance, or nothing beyond chance to agree on.
    """
    rows = records.select(F.col(score).cast("double").alias("x"), failed.alias("b")).where("x is not null and b is not null").select("x", F.col("b").cast("double").alias("y"), (F.col("x") < threshold).cast("double").alias("a"))
    m = rows.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("r"), F.avg((F.col("a") == F.col("y")).cast("double")).alias("po"), F.avg("a").alias("pa"), F.avg("y").alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return m.select(F.round("r", 4).alias("r"), F.round((F.col("po") - chance) / F.nullif(1 - chance, F.lit(0.0)), 4).alias("kappa"), "n", F.round("po", 4).alias("agreement"))


def by_arm(records: DataFrame, arm: str, main: str, metrics: list[str], places: int = 4) -> DataFrame:
    """Records of each arm, those with the main metric, and means of all metrics; missing values don't count."""
    return records.groupBy(arm).agg(F.count(F.lit(1)).alias("n"), F.count(main).alias("n_scored"), *[F.round(F.avg(m), places).alias(m) for m in metrics])


def accuracy_by_cause(records: DataFrame, expected: str, found: str, healthy: str) -> DataFrame:
    """(expected, n, correct, detected, accuracy) by the expected cause and over all records (null); detected: any cause was found."""
    same = F.col(expected) == F.col(found)
    return records.rollup(expected).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("correct"), F.count_if(F.col(found) != healthy).alias("detected"), F.round(F.avg(same.cast("int")), 4).alias("accuracy"))
