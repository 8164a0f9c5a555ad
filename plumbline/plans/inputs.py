"""How the test tables stand for the library's concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d, *more: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", *more)


def questions(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def vector_questions(spark, d) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return vectors(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("q_label"))


def answers(spark, d) -> DataFrame:
    """trace_id, question, answer: user turns with the assistant turn after them; a trace's document has its conversation's number."""
    from plumbline.operators.memory import exchanges

    rows = exchanges(table(spark, d, "conversations"))
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("trace_id"), "conv_id", "question", "answer")


ANSWERS_SQL = """answers AS (SELECT conv_id * 100 + turn AS trace_id, conv_id, text AS question, nt AS answer FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant')"""


def _share(x: Column, times: int, of: int) -> Column:
    return ((x * times) % of) / float(of)


def claim_scores(spark, d) -> DataFrame:
    """Verified claims with derived scores: one claim for each event, a trace for each user."""
    from plumbline.operators.verification import confidence, status

    e = table(spark, d, "events").select(F.col("user_id").alias("trace_id"), F.col("event_id").alias("claim_id"))
    t, i = F.col("trace_id"), F.col("claim_id")
    ent, contra = _share(i, 37, 101), F.when((i * 7 + t) % 11 == 0, _share(i, 53, 97)).otherwise(0.0)
    rows = e.select("trace_id", "claim_id", F.when(t % 9 == 0, ent * 0.3).otherwise(ent).alias("ent"), contra.alias("contra"))
    neutral = F.greatest(F.lit(0.0), 1 - F.col("ent") - F.col("contra"))
    return rows.withColumn("neutral", neutral).select("*", status(F.col("ent"), F.col("contra"), F.col("neutral")).alias("status"), confidence(F.col("ent"), F.col("contra")).alias("confidence"),
                                                       F.concat_ws("_", t.cast("string"), (i % 4).cast("string")).alias("best_chunk_id"))


def traces(spark, d) -> DataFrame:
    t = F.col("trace_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("trace_id")).distinct()
    config = F.create_map(F.lit("bm25_enabled"), F.when(t % 2 == 0, "true").otherwise("false"), F.lit("reranker_enabled"), F.when(t % 3 == 0, "true").otherwise("false"), F.lit("temperature"), F.when(t % 5 == 0, "0.0").otherwise("0.2"))
    return rows.select("trace_id", F.when(t % 7 != 0, _share(t, 13, 100)).alias("min_distance"), (20 + t % 21).alias("pool_size"), config.alias("config"))


def refs(spark, d) -> DataFrame:
    t, i = F.col("trace_id"), F.col("i")
    rows = table(spark, d, "events").select(F.col("user_id").alias("trace_id")).distinct().select("trace_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    score = F.when(t % 4 == 0, 0.4 * _share(t * 31 + i, 17, 100)).otherwise(_share(t * 31 + i, 17, 100))
    return rows.select("trace_id", (i + 1).alias("rank"), F.concat_ws("_", t.cast("string"), i.cast("string")).alias("chunk_id"), F.when((t + i) % 13 != 0, F.concat(F.lit("d"), F.floor(i / 3).cast("string"))).alias("parent_id"),
                       F.when(t % 6 == 0, i * 3).otherwise(i).cast("int").alias("chunk_index"), score.alias("similarity"))


TRACES_SQL = """
scores0 AS (SELECT user_id AS trace_id, event_id AS claim_id, CASE WHEN user_id % 9 = 0 THEN ((event_id * 37) % 101) / 101.0::DOUBLE * 0.3 ELSE ((event_id * 37) % 101) / 101.0::DOUBLE END AS ent,
  CASE WHEN (event_id * 7 + user_id) % 11 = 0 THEN ((event_id * 53) % 97) / 97.0::DOUBLE ELSE 0.0::DOUBLE END AS contra FROM events),
scores AS (SELECT *, greatest(0.0::DOUBLE, 1 - ent - contra) AS neutral FROM scores0),
verified AS (SELECT *, CASE WHEN contra >= 0.7 THEN 'CONTRADICTED' WHEN ent >= 0.7 THEN 'SUPPORTED' WHEN ent >= 0.4 THEN 'PARTIALLY_SUPPORTED' WHEN neutral >= 0.8 THEN 'UNSUPPORTED' ELSE 'NOT_VERIFIABLE' END AS status,
  greatest(ent, contra) AS confidence, trace_id::VARCHAR || '_' || (claim_id % 4)::VARCHAR AS best_chunk_id FROM scores),
traces AS (SELECT trace_id, CASE WHEN trace_id % 7 <> 0 THEN ((trace_id * 13) % 100) / 100.0::DOUBLE END AS min_distance, 20 + trace_id % 21 AS pool_size,
  CASE WHEN trace_id % 2 = 0 THEN 'true' ELSE 'false' END AS bm25, CASE WHEN trace_id % 3 = 0 THEN 'true' ELSE 'false' END AS rerank, CASE WHEN trace_id % 5 = 0 THEN '0.0' ELSE '0.2' END AS temp FROM (SELECT DISTINCT user_id AS trace_id FROM events)),
refs AS (SELECT trace_id, i + 1 AS rank, trace_id::VARCHAR || '_' || i::VARCHAR AS chunk_id, CASE WHEN (trace_id + i) % 13 <> 0 THEN 'd' || (i // 3)::VARCHAR END AS parent_id,
  CASE WHEN trace_id % 6 = 0 THEN i * 3 ELSE i END AS chunk_index,
  CASE WHEN trace_id % 4 = 0 THEN 0.4 * ((((trace_id * 31 + i) * 17) % 100) / 100.0::DOUBLE) ELSE (((trace_id * 31 + i) * 17) % 100) / 100.0::DOUBLE END AS similarity
  FROM traces, (SELECT unnest(range(6)) AS i)),
boundary AS (SELECT DISTINCT v.trace_id, v.claim_id FROM verified v JOIN refs r ON r.trace_id = v.trace_id AND r.chunk_id = v.best_chunk_id
  JOIN refs o ON o.trace_id = r.trace_id AND o.parent_id = r.parent_id AND abs(o.chunk_index - r.chunk_index) = 1 AND o.chunk_id <> r.chunk_id WHERE v.status = 'PARTIALLY_SUPPORTED'),
facts AS (SELECT t.*, c.* EXCLUDE (trace_id), r.* EXCLUDE (trace_id), coalesce(b.n, 0) AS boundary_claims FROM traces t
  LEFT JOIN (SELECT trace_id, count(*) AS n_claims, count(*) FILTER (status = 'SUPPORTED') AS supported, count(*) FILTER (status = 'PARTIALLY_SUPPORTED') AS partial, count(*) FILTER (status = 'UNSUPPORTED') AS unsupported,
    count(*) FILTER (status = 'CONTRADICTED') AS contradicted, count(*) FILTER (status = 'NOT_VERIFIABLE') AS not_verifiable,
    count(DISTINCT CASE WHEN status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED') THEN best_chunk_id END) AS chunks_used, count(DISTINCT best_chunk_id) AS chunks_cited FROM verified GROUP BY 1) c USING (trace_id)
  LEFT JOIN (SELECT trace_id, count(DISTINCT chunk_id) AS chunks_retrieved, max(similarity) AS max_score FROM refs GROUP BY 1) r USING (trace_id)
  LEFT JOIN (SELECT trace_id, count(*) AS n FROM boundary GROUP BY 1) b USING (trace_id)),
matrix AS (
  SELECT trace_id, 'CORPUS' AS stage, 1 AS stage_order, CASE WHEN min_distance IS NULL THEN 'UNKNOWN' WHEN min_distance > 0.75 THEN 'FAIL' WHEN supported + partial > 0 THEN 'PASS' ELSE 'UNKNOWN' END AS status,
    CASE WHEN min_distance IS NULL THEN 1.0 WHEN min_distance > 0.75 THEN 0.85 WHEN supported + partial > 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM facts
  UNION ALL SELECT trace_id, 'RETRIEVER', 2, CASE WHEN supported + partial > 0 THEN 'PASS' WHEN unsupported = n_claims AND max_score < 0.5 THEN 'FAIL' ELSE 'UNKNOWN' END,
    CASE WHEN supported + partial > 0 THEN 0.95 WHEN unsupported = n_claims AND max_score < 0.5 THEN 0.85 ELSE 0.5 END FROM facts
  UNION ALL SELECT trace_id, 'CHUNKING', 3, 'FAIL', 0.8 FROM facts WHERE boundary_claims > 0
  UNION ALL SELECT trace_id, 'GENERATOR', 4, CASE WHEN not_verifiable = n_claims THEN 'UNKNOWN' WHEN unsupported > 0 AND max_score >= 0.5 THEN 'FAIL' WHEN unsupported > 0 THEN 'UNKNOWN' ELSE 'PASS' END,
    CASE WHEN not_verifiable = n_claims THEN 0.5 WHEN unsupported > 0 AND max_score >= 0.5 THEN 0.85 WHEN unsupported > 0 THEN 0.5 ELSE 0.95 END FROM facts
  UNION ALL SELECT trace_id, 'GROUNDING', 5, CASE WHEN contradicted > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN contradicted > 0 THEN 0.95 ELSE 0.9 END FROM facts),
named AS (SELECT *, ['MISSING_CORPUS', 'RETRIEVAL_MISS', 'CHUNK_BOUNDARY', 'UNSUPPORTED_GENERATION', 'GROUNDING_FAILURE'][stage_order] AS cause FROM matrix),
causes AS (SELECT trace_id, coalesce(list(cause ORDER BY stage_order) FILTER (status = 'FAIL'), []) AS failed, round(coalesce(avg(confidence) FILTER (status <> 'UNKNOWN'), 0), 2) AS confidence FROM named GROUP BY 1)
"""
