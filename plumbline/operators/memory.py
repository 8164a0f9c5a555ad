"""Conversational memory: ranking, rings, sessions and summaries. Time enters as a parameter, never as now()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import TOPIC_STOP, WORD, matches

# Weights, thresholds and limits.
WEIGHTS = {"semantic": 0.5, "recency": 0.2, "frequency": 0.2, "importance": 0.1}
MIN_SCORE, RING, SUMMARY_AT, TOP_K = 0.4, 10, 20, 5


def semantic_score(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - distance / 2)


def recency_score(ts: Column, as_of: Column) -> Column:
    """exp(-0.693 h / 24); a future time counts as now, a missing one as 0.5."""
    us = lambda x: F.unix_micros(x.cast("timestamp"))
    hours = F.greatest(F.lit(0.0), (us(as_of) - us(ts)) / 3.6e9)
    return F.when(ts.isNull(), 0.5).otherwise(F.exp(-0.693 * hours / 24))


def frequency_score(n: Column, most: Column) -> Column:
    return F.when(n <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log1p(F.greatest(most, F.lit(1)).cast("double"))))


def ranked_memories(found: DataFrame, as_of: Column, top_k: int = TOP_K, min_score: float = MIN_SCORE) -> DataFrame:
    """Rank candidates (query_id, memory_id, distance, ts, access_count, importance): the nearest 2 k of each query are scored, the best k above the least score kept."""
    near = Window.partitionBy("query_id").orderBy(F.round("distance", 6), "memory_id")
    pool = found.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= 2 * top_k)
    most = F.max("access_count").over(Window.partitionBy("query_id"))
    scored = pool.withColumn("semantic", semantic_score(F.col("distance"))).withColumn("recency", recency_score(F.col("ts"), as_of)).withColumn(
        "frequency", frequency_score(F.col("access_count"), most)).withColumn("capped", F.least(F.lit(1.0), F.col("importance")))
    final = sum((w * F.col({"importance": "capped"}.get(k, k)) for k, w in WEIGHTS.items()), F.lit(0.0))
    best = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "memory_id")
    rows = scored.withColumn("score", final).where(F.round("score", 6) >= min_score).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    return rows.select("query_id", "memory_id", "rank", "score", "semantic", "recency", "frequency", F.col("capped").alias("importance"), reason().alias("reason"))


def reason() -> Column:
    s = F.col("semantic")
    text = F.concat_ws(
        "; ", F.when(s > 0.7, F.concat(F.lit("High semantic match ("), F.format_string("%.2f", s), F.lit(")"))).when(s > 0.5, F.concat(F.lit("Moderate semantic match ("), F.format_string("%.2f", s), F.lit(")"))),
        F.when(F.col("recency") > 0.8, "Recent conversation"), F.when(F.col("frequency") > 0.5, "Frequently referenced"), F.when(F.col("capped") > 0.8, "High importance"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Relevant memory"))


def access_updates(hits: DataFrame, as_of: Column) -> DataFrame:
    """How often each memory was returned; reads stay pure, a sink applies this."""
    return hits.groupBy("memory_id").agg(F.count(F.lit(1)).alias("accesses"), as_of.alias("last_accessed"))


def ring(entries: DataFrame, key: str, order: list[str], size: int = RING) -> DataFrame:
    """The last `size` entries of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return entries.withColumn("age", F.row_number().over(w)).where(F.col("age") <= size)


def sessions(entries: DataFrame, key: str = "session_id", ts: str = "ts") -> DataFrame:
    return entries.groupBy(key).agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_activity"), F.count(F.lit(1)).alias("memory_count"))


def summary_batch(entries: DataFrame, key: str, order: list[str], at: int = SUMMARY_AT) -> DataFrame:
    """The older half of each session that has reached `at` entries."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return entries.withColumn("_n", n).withColumn("place", place).where((F.col("_n") >= at) & (F.col("place") <= F.floor(F.col("_n") / 2))).drop("_n")


def topics(texts: DataFrame, key: str, order: str, text: str = "text", limit: int = 7) -> DataFrame:
    """(key, rank, term, n): most frequent words over two letters, the first seen on ties."""
    words = texts.select(key, F.col(order).alias("_o"), F.posexplode(matches(F.lower(F.col(text)), WORD)).alias("_p", "term")).where((F.length("term") > 2) & ~F.col("term").isin(TOPIC_STOP))
    counts = words.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_o", "_p")).alias("_first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "_first")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(key, "rank", "term", "n")


def exchanges(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    w = Window.partitionBy(key).orderBy("turn")
    rows = turns.withColumn("_r", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return rows.where("role = 'user' and _r = 'assistant'").select(key, "turn", F.col("text").alias("question"), "answer")


def messages(memories: DataFrame) -> DataFrame:
    """Two rows for each memory, the user's before the assistant's."""
    return memories.select("session_id", "memory_id", F.posexplode(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("text")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("text")))).alias("part", "m")).select("session_id", "memory_id", "part", "m.*")


def encoded(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Q: "), question, F.lit("\nA: "), answer)


def decoded(document: Column) -> Column:
    parts = F.split(document, "\nA: ", 2)
    return F.struct(F.regexp_replace(F.get(parts, F.lit(0)), "^Q: ", "").alias("question"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("answer"))


def context(found: DataFrame, session: Column) -> DataFrame:
    """(query_id, context): ranked memories as a prompt's text, those of the current session named so.

    found: query_id, rank, session_id, question, answer, score. A query without memories has no row.
    """
    kind = F.when(F.col("session_id") == session, "Current Session Interaction").otherwise("Previous conversation")
    text = F.concat(F.lit("--- "), kind, F.lit(" "), F.col("rank").cast("string"), F.lit(" (Relevance: "), F.format_string("%.2f", "score"), F.lit(") ---\nQ: "), "question", F.lit("\nA: "), "answer", F.lit("\n"))
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("t")))).alias("l"))
    return rows.select("query_id", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("context"))


def cascaded(memories: DataFrame, dependents: dict[str, DataFrame], sessions: DataFrame) -> dict[str, DataFrame]:
    """Memories and the tables that hang on them (by memory_id, or by session_id where they have no memory_id) without some sessions (session_id)."""
    gone = memories.join(sessions.select("session_id").distinct(), "session_id", "left_semi").select("memory_id")
    keys = {name: "memory_id" if "memory_id" in df.columns else "session_id" for name, df in dependents.items()}
    kept = {name: without(df, gone if keys[name] == "memory_id" else sessions, keys[name]) for name, df in dependents.items()}
    return {"memories": without(memories, sessions, "session_id")} | kept


def without(table: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A table after a cascading delete."""
    return table.join(removed.select(key).distinct(), key, "left_anti")
