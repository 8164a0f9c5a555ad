"""Ranking, generation and system metrics; null means that a metric isn't defined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (5, 10, 20)


def gold_ranks(ranking: DataFrame, gold: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, n_gold, gold ranks): one row for each query; n_gold 0 where nothing is gold."""
    sizes = gold.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_gold"))
    hits = ranking.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(
        F.array_sort(F.collect_list("rank")).alias("ranks"))
    out = queries.select("query_id").join(sizes, "query_id", "left").join(hits, "query_id", "left")
    return out.select("query_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"))


def label_ranks(ranking: DataFrame, labels: DataFrame, queries: DataFrame) -> DataFrame:
    """gold_ranks() where all rows of a query's label but its own are gold. labels: doc_id, label; queries: query_id, label, which are among the labelled rows.

    No pair of a query and a gold row is made: a label's rows are counted, and only ranked rows are looked at.
    """
    known = labels.where(F.col("label").isNotNull()).select("doc_id", "label").distinct()
    sizes = known.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    hits = ranking.join(known, "doc_id").join(queries.select("query_id", "label"), ["query_id", "label"], "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    out = queries.select("query_id", "label").join(sizes, "label", "left").join(hits, "query_id", "left")
    return out.select("query_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.coalesce("ranks", F.array().cast("array<int>")).alias("ranks"))


def within(k: int) -> Column:
    return F.filter("ranks", lambda r: r <= k)


def recall_at(k: int) -> Column:
    return F.round(F.size(within(k)) / F.nullif(F.col("n_gold"), F.lit(0)), 4)


def hit_at(k: int) -> Column:
    return F.when(F.col("n_gold") > 0, F.when(F.size(within(k)) > 0, 1.0).otherwise(0.0))


def reciprocal_rank() -> Column:
    return F.when(F.col("n_gold") > 0, F.round(F.coalesce(1.0 / F.array_min("ranks"), F.lit(0.0)), 4))


def _gain(ranks: Column) -> Column:
    return F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1))


def ndcg_at(k: int) -> Column:
    ideal = _gain(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n_gold").cast("int"), F.lit(k)))))
    return F.when(F.col("n_gold") > 0, F.round(_gain(within(k)) / ideal, 4))


def retrieval_panel(ranks: DataFrame) -> DataFrame:
    """All ranking metrics of gold_ranks() in one pass."""
    return ranks.select(
        "query_id", "n_gold", *[recall_at(k).alias(f"recall_at_{k}") for k in CUTS], hit_at(10).alias("hit_at_10"),
        reciprocal_rank().alias("mrr"), ndcg_at(10).alias("ndcg_at_10"),
        F.when(F.col("n_gold") > 0, F.size("ranks") == F.col("n_gold")).alias("all_gold_found"))


def average_precision(flags: DataFrame) -> DataFrame:
    """(query_id, context_precision) of (query_id, rank, relevant): mean precision at the relevant ranks; null if any flag is, 0 if none is relevant."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = flags.withColumn("hits", F.sum(F.col("relevant").cast("int")).over(w))
    mean = F.avg(F.when(F.col("relevant"), F.col("hits") / F.col("rank")))
    return seen.groupBy("query_id").agg(F.when(F.count_if(F.col("relevant").isNull()) > 0, None).otherwise(F.round(F.coalesce(mean, F.lit(0.0)), 4)).alias("context_precision"))


def flag_mean(flags: DataFrame, name: str = "context_relevancy") -> DataFrame:
    """Mean of judged flags, null if any is null."""
    return flags.groupBy("query_id").agg(F.when(F.count_if(F.col("relevant").isNull()) > 0, None).otherwise(F.round(F.avg(F.col("relevant").cast("int")), 4)).alias(name))


def generation_rates(summary: DataFrame) -> DataFrame:
    """Rates of a verification summary (supported, partial, unsupported, contradicted, not_verifiable, total); null without claims."""
    n = F.nullif(F.col("total"), F.lit(0))
    rate = lambda x: F.round(x / n, 4)
    return summary.withColumns({
        "faithfulness": rate(F.col("supported")), "weighted_faithfulness": rate(F.col("supported") + 0.5 * F.col("partial")),
        "hallucination_rate": rate(F.col("unsupported") + F.col("contradicted")), "contradiction_rate": rate(F.col("contradicted")),
        "unsupported_rate": rate(F.col("unsupported"))})


def f1(p: Column, r: Column) -> Column:
    return F.when(p.isNull() | r.isNull(), None).otherwise(F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 4))


def answer_correctness(f: Column, similarity: Column) -> Column:
    return F.round(0.75 * f + 0.25 * similarity, 4)


def mean_by(df: DataFrame, keys: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Means without nulls and NaN, rounded, with group sizes."""
    clean = lambda m: F.when(F.isnan(m), None).otherwise(F.col(m))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(clean(m)), digits).alias(m) for m in metrics])


def deltas_from(df: DataFrame, arm: str, baseline: str, keys: list[str], metric: str) -> DataFrame:
    """Mean paired difference of each arm from the baseline arm, over keys that both have with a value."""
    base = df.where(F.col(arm) == baseline).select(*keys, F.col(metric).alias("base"))
    return df.where(F.col(arm) != baseline).join(base, keys).where(F.col(metric).isNotNull() & F.col("base").isNotNull()).groupBy(arm).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(F.col(metric) - F.col("base")), 4).alias("mean_delta"))
