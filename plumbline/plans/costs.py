"""Queries over chunk records, costs, panels and label mappings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import chunking as C
from plumbline.operators import records as K
from plumbline.operators import verification as V
from plumbline.plans import corpus as PC
from plumbline.plans import inputs as I

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


@query("chunk_records", f"""WITH {PC._windows_sql(512, 100)} SELECT substr(sha256(doc_id::VARCHAR || ':' || chunk_index::VARCHAR), 1, 32) AS chunk_id, doc_id::VARCHAR AS parent_document_id, source AS source_file, (row_number() OVER (ORDER BY doc_id, chunk_index) - 1)::INTEGER AS running_index,
  length(array_to_string(ws, ' '))::BIGINT AS text_length FROM win""")
def chunk_records(s, d):
    """The running index counts all chunks, not those of a document."""
    w = C.windows(I.documents(s, d, "source"), keep=("doc_id", "source")).select("doc_id", F.col("chunk_index").alias("ordinal"), "text", F.col("source").alias("source_file"), F.lit(None).cast("string").alias("page"))
    r = K.chunk_records(w, C.SIZE, C.OVERLAP)
    return r.select("chunk_id", "parent_document_id", "source_file", F.col("chunk_index").alias("running_index"), F.col("text_length").cast("long").alias("text_length"))


@query("system_metrics", f"""WITH {I.ANSWERS_SQL} SELECT trace_id, round(trace_id % 7 / 10.0::DOUBLE + length(answer) / 1000.0::DOUBLE, 3) AS total_latency_s, (trace_id % 3 + 1)::BIGINT AS llm_calls, greatest(trace_id % 4, 1)::BIGINT AS retrieval_calls, length(answer) // 4 AS answer_tokens_estimate,
  length(text)::BIGINT AS context_chars FROM answers JOIN documents ON doc_id = conv_id""")
def system_metrics(s, d):
    t = F.col("trace_id")
    a = I.answers(s, d).select("trace_id", "conv_id", "answer", (t % 7 / 10.0).alias("retrieval_s"), (F.length("answer") / 1000.0).alias("generation_s"), F.lit(None).cast("double").alias("verification_ms"), (t % 3).alias("planner_calls"), (t % 4).alias("retrieval_calls"))
    chunks = a.join(I.documents(s, d), F.col("conv_id") == F.col("doc_id")).select("trace_id", "text")
    return K.system_metrics(a, chunks).drop("verification_latency_s")


@query("metric_panel", f"""WITH {I.TRACES_SQL}, sm AS (SELECT trace_id, count(*) AS total, count(*) FILTER (status = 'SUPPORTED') AS sup, count(*) FILTER (status IN ('UNSUPPORTED', 'CONTRADICTED')) AS bad, round(avg((status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED'))::INT), 4) AS rec FROM verified GROUP BY 1),
p AS (SELECT trace_id, round(sup / total::DOUBLE, 4) AS p, round(bad / total::DOUBLE, 4) AS h, CASE WHEN trace_id % 3 <> 0 THEN rec END AS r FROM sm)
SELECT trace_id, p AS faithfulness, p AS precision, h AS hallucination, r AS recall, CASE WHEN r IS NULL THEN NULL ELSE round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) END AS f1 FROM p""")
def metric_panel(s, d):
    """Recall is there for two traces in three; the others' F1 stays null."""
    v = I.claim_scores(s, d)
    return K.metric_panel(V.summary(v), K.gold_recall(v.where("trace_id % 3 <> 0")))


@query("mapped_accuracy", f"""WITH {I.TRACES_SQL}, m AS (SELECT status, ['SUPPORTS', 'REFUTES', 'NOT ENOUGH INFO'][claim_id % 3 + 1] AS label FROM verified)
SELECT label, count(*) AS n, round(avg(CASE label WHEN 'SUPPORTS' THEN status = 'SUPPORTED' WHEN 'REFUTES' THEN status = 'CONTRADICTED' ELSE status IN ('PARTIALLY_SUPPORTED', 'UNSUPPORTED', 'NOT_VERIFIABLE') END::INT), 6) AS accuracy FROM m GROUP BY 1""")
def mapped_accuracy(s, d):
    names = F.array(F.lit("SUPPORTS"), F.lit("REFUTES"), F.lit("NOT ENOUGH INFO"))
    return K.mapped_accuracy(I.claim_scores(s, d).select("status", F.get(names, (F.col("claim_id") % 3).cast("int")).alias("label")), "label", "status")


@query("speedups", "SELECT round(avg(p_size), 4) AS own, round(avg(p_retailprice), 4) AS other, round(avg(p_retailprice) / avg(p_size), 4) AS other_speedup, count(*) FILTER (p_size > 25) AS n_usable, count(*) FILTER (p_size <= 25) AS n_failed FROM part")
def speedups(s, d):
    p = I.table(s, d, "part").select(F.col("p_size").alias("own"), F.col("p_retailprice").alias("other"), (F.col("p_size") > 25).alias("ok"))
    return K.speedups(p, "own", ["other"], "ok")


@query("best_chunks", """WITH c AS (SELECT o_custkey AS doc_id, ['headnote', 'held', 'body', 'issue', 'body'][o_custkey % 4 + o_orderkey % 2 + 1] AS section, o_orderkey AS ordinal FROM orders), s AS (SELECT *, CASE section WHEN 'headnote' THEN 1 WHEN 'held' THEN 2 WHEN 'issue' THEN 3 END AS s FROM c), a AS (SELECT *, max(s) OVER (PARTITION BY doc_id) IS NOT NULL AS found FROM s)
SELECT doc_id, ordinal AS chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(s, 0), ordinal) AS rank FROM a WHERE s IS NOT NULL OR NOT found QUALIFY rank <= CASE WHEN found THEN 6 ELSE 3 END""")
def best_chunks(s, d):
    names = F.array(*[F.lit(x) for x in ("headnote", "held", "body", "issue", "body")])
    o = I.table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.get(names, (F.col("o_custkey") % 4 + F.col("o_orderkey") % 2).cast("int")).alias("section"), F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").alias("chunk_id"))
    return K.best_chunks(o).withColumn("rank", F.col("rank").cast("long"))


@query("answer_relevancy", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS trace_id, round(avg(list_cosine_similarity(a.v, b.v)), 4) AS answer_relevancy FROM v a JOIN v b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 3 GROUP BY 1")
def answer_relevancy(s, d):
    """The three next vectors stand for generated questions."""
    v = I.table(s, d, "embeddings")
    own = v.select(F.col("vec_id").alias("trace_id"), F.col("embedding").alias("question_vector"), F.explode(F.array(*[F.col("vec_id") + i for i in (1, 2, 3)])).alias("vec_id"))
    return K.answer_relevancy(own.join(v.select("vec_id", F.col("embedding").alias("generated_vector")), "vec_id"))


@query("source_urls", "SELECT page_id, 'https://x.example/data/pdf/year=' || (2000 + page_id % 20) || CASE WHEN page_id % 2 = 0 THEN '/english/' ELSE '/court=delhi/' END || page_id || '.pdf' AS url FROM pages")
def source_urls(s, d):
    p = F.col("page_id").cast("string")
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "a\\supreme_court\\").otherwise("a/hc_delhi/"), (2000 + F.col("page_id") % 20).cast("string"), F.lit("/"), p, F.lit(".pdf"))
    return I.table(s, d, "pages").select("page_id", K.source_url(F.lit("https://x.example"), path).alias("url"))


@query("turn_events", """WITH t AS (SELECT conv_id * 100 + turn AS turn_id, turn, text FROM conversations WHERE role = 'assistant'), k AS (SELECT turn_id, i AS place, w[i + 1] AS token FROM (SELECT turn_id, regexp_extract_all(text, '[\\p{L}]+') AS w FROM t), unnest(range(len(w)::BIGINT)) x(i))
SELECT turn_id, phase, place, event, data FROM (SELECT turn_id, unnest([{'phase': 0, 'event': 'stage', 'data': 'memory'}, {'phase': 1, 'event': 'memory', 'data': turn::VARCHAR}, {'phase': 2, 'event': 'stage', 'data': 'retrieval'}, {'phase': 3, 'event': 'meta', 'data': '{}'}, {'phase': 4, 'event': 'chunks', 'data': '6'}, {'phase': 5, 'event': 'stage', 'data': 'generation'}, {'phase': 7, 'event': 'evaluation', 'data': '{}'},
  CASE WHEN turn_id % 10 = 3 THEN {'phase': 8, 'event': 'error', 'data': 'lost'} ELSE {'phase': 8, 'event': 'done', 'data': ''} END], recursive := true), 0::INTEGER AS place FROM t) UNION ALL SELECT turn_id, 6, place::INTEGER, 'token', token FROM k""")
def turn_events(s, d):
    t = I.table(s, d, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), F.col("turn").alias("n_memories"), F.lit(6).alias("n_chunks"), "text")
    t = t.withColumn("error", F.when(F.col("turn_id") % 10 == 3, "lost"))
    k = t.select("turn_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}]+"), F.lit(0))).alias("place", "token"))
    return K.turn_events(t, k)
