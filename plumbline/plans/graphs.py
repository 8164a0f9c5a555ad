"""Queries over link graphs, citations and memory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators import memory as Y
from plumbline.plans import inputs as I

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


# --- pages as documents, their links as citations; orders and line items as typed edges ---

_LINKS = """lk AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS key FROM pages)"""


def links(s, d):
    return I.table(s, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))).alias("key"))


@query("citation_extract", f"WITH {_LINKS} SELECT page_id, key FROM lk")
def citation_extract(s, d):
    return links(s, d)


_VERDICT = f"""{_LINKS}, ev AS (SELECT page_id + 1 AS page_id, key FROM lk), co AS (SELECT DISTINCT key FROM lk WHERE page_id % 3 = 0),
vd AS (SELECT lk.page_id AS answer_id, lk.key, CASE WHEN ev.key IS NOT NULL THEN 'GROUNDED' WHEN co.key IS NOT NULL THEN 'IN_CORPUS_NOT_RETRIEVED' ELSE 'UNVERIFIABLE' END AS status FROM lk LEFT JOIN ev USING (page_id, key) LEFT JOIN co ON co.key = lk.key)"""


def _verdicts(s, d):
    lk = links(s, d).withColumnRenamed("page_id", "answer_id")
    return G.verdicts(lk, lk.withColumn("answer_id", F.col("answer_id") + 1), lk.where("answer_id % 3 = 0").select("key"))


query("citation_verdicts", f"WITH {_VERDICT} SELECT * FROM vd")(_verdicts)
query("citation_rates", f"WITH {_VERDICT} SELECT answer_id, count(*) AS n_citations, count(*) FILTER (status = 'GROUNDED') AS grounded, count(*) FILTER (status = 'IN_CORPUS_NOT_RETRIEVED') AS in_corpus, count(*) FILTER (status = 'UNVERIFIABLE') AS unverifiable, round(count(*) FILTER (status = 'GROUNDED') / count(*)::DOUBLE, 4) AS citation_precision, round(count(*) FILTER (status <> 'UNVERIFIABLE') / count(*)::DOUBLE, 4) AS citation_correctness, round(count(*) FILTER (status = 'UNVERIFIABLE') / count(*)::DOUBLE, 4) AS fabrication_rate FROM vd GROUP BY 1")(lambda s, d: G.citation_rates(_verdicts(s, d)))

_EDGES = """eg AS (SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'PLACED_BY' AS relation FROM orders UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION' FROM nation
  UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'HAS_PART' FROM lineitem),
nd AS (SELECT 'customer:' || c_custkey AS id FROM customer UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'region:' || r_regionkey FROM region UNION ALL SELECT 'part:' || p_partkey FROM part WHERE p_partkey % 2 = 0)"""


def edges(s, d):
    e = lambda t, a, x, b, y, r: I.table(s, d, t).select(F.concat(F.lit(a + ":"), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b + ":"), F.col(y).cast("string")).alias("dst"), F.lit(r).alias("relation"))
    return e("orders", "order", "o_orderkey", "customer", "o_custkey", "PLACED_BY").unionByName(e("customer", "customer", "c_custkey", "nation", "c_nationkey", "IN_NATION")).unionByName(
        e("nation", "nation", "n_nationkey", "region", "n_regionkey", "IN_REGION")).unionByName(e("lineitem", "order", "l_orderkey", "part", "l_partkey", "HAS_PART").distinct())


def nodes(s, d):
    n = lambda t, a, x: I.table(s, d, t).select(F.concat(F.lit(a + ":"), F.col(x).cast("string")).alias("id"))
    return n("customer", "customer", "c_custkey").unionByName(n("nation", "nation", "n_nationkey")).unionByName(n("region", "region", "r_regionkey")).unionByName(
        I.table(s, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id")))


query("graph_edges", f"WITH {_EDGES} SELECT src, dst, relation FROM eg")(edges)
query("graph_degree", f"WITH {_EDGES} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM eg UNION ALL SELECT dst, 0, 1 FROM eg) GROUP BY 1")(lambda s, d: G.degrees(edges(s, d)))
query("graph_statistics", f"WITH {_EDGES} SELECT relation, count(*) AS n_edges, count(id) AS n_held, count(*) FILTER (id IS NULL) AS n_dangling FROM eg LEFT JOIN nd ON id = dst GROUP BY 1")(lambda s, d: G.statistics(nodes(s, d), edges(s, d)))


@query("graph_reverse", f"WITH {_EDGES} SELECT src, dst, relation FROM eg WHERE dst IN (SELECT 'nation:' || n_nationkey FROM nation)")
def graph_reverse(s, d):
    t = I.table(s, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("dst"))
    return G.reverse(edges(s, d), t).select("src", "dst", "relation")


@query("graph_two_hop", f"""WITH RECURSIVE {_EDGES}, r(seed, id, hop) AS (SELECT 'order:' || o_orderkey, 'order:' || o_orderkey, 0 FROM orders WHERE o_orderkey % 50 = 0 UNION SELECT seed, dst, hop + 1 FROM r JOIN eg ON src = id WHERE hop < 2) SELECT seed, id, min(hop)::INTEGER AS hop FROM r GROUP BY 1, 2""")
def graph_two_hop(s, d):
    """The stated seeds: every order whose key is divisible by 50."""
    seeds = I.table(s, d, "orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("seed"))
    return G.reach(edges(s, d), seeds)


@query("citation_chain", f"WITH {_EDGES}, u AS (SELECT DISTINCT src, dst FROM eg) SELECT x.src AS a, min((x.dst, y.dst))[1] AS b, min((x.dst, y.dst))[2] AS c FROM u x JOIN u y ON y.src = x.dst WHERE x.src <> x.dst AND x.dst <> y.dst AND x.src <> y.dst GROUP BY 1")
def citation_chain(s, d):
    return G.chains(edges(s, d))


@query("temporal_edges", "WITH e AS (SELECT page_id AS src, (page_id * 7 + 1) % (SELECT count(*) FROM pages) AS dst FROM pages), y AS (SELECT page_id AS id, (length(html) % 30 + 1990)::INTEGER AS year FROM pages) SELECT e.src, e.dst, a.year AS src_year, b.year AS dst_year FROM e JOIN y a ON a.id = e.src JOIN y b ON b.id = e.dst WHERE a.year > b.year")
def temporal_edges(s, d):
    pages = I.table(s, d, "pages")
    n = pages.agg(F.count(F.lit(1)).alias("n"))
    e = pages.crossJoin(F.broadcast(n)).select(F.col("page_id").alias("src"), ((F.col("page_id") * 7 + 1) % F.col("n")).alias("dst"))  # one row
    return G.temporal(e, pages.select(F.col("page_id").alias("id"), (F.length("html") % 30 + 1990).cast("int").alias("year"))).select("src", "dst", "src_year", "dst_year")


@query("benchmark_questions", f"""WITH {_EDGES}, q AS (SELECT 'one_hop' AS type, src AS a, dst AS b, NULL AS c FROM eg WHERE relation = 'IN_NATION' UNION ALL SELECT 'two_hop', x.src, x.dst, y.dst FROM eg x JOIN eg y ON y.src = x.dst WHERE x.relation = 'IN_NATION'
  UNION ALL SELECT 'reverse', dst, src, NULL FROM eg WHERE relation = 'IN_REGION')
SELECT type, a, b, c FROM q QUALIFY row_number() OVER (PARTITION BY type ORDER BY sha256(type || ':' || a || ':' || b || ':' || coalesce(c, ''))) <= 6""")
def benchmark_questions(s, d):
    """Up to six questions of each type from graph patterns, in hash order."""
    e = edges(s, d)
    none = F.lit(None).cast("string").alias("c")
    one = e.where("relation = 'IN_NATION'")
    two = one.select(F.col("src").alias("a"), F.col("dst").alias("b")).join(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b")
    q = one.select(F.lit("one_hop").alias("type"), F.col("src").alias("a"), F.col("dst").alias("b"), none).unionByName(two.select(F.lit("two_hop").alias("type"), "a", "b", "c")).unionByName(
        e.where("relation = 'IN_REGION'").select(F.lit("reverse").alias("type"), F.col("dst").alias("a"), F.col("src").alias("b"), none))
    h = F.sha2(F.concat_ws(":", "type", "a", "b", F.coalesce("c", F.lit(""))), 256)
    return q.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy(h))).where("_n <= 6").drop("_n")


# --- memory ---

_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
_MEM = f"""mem AS (SELECT q.vec_id AS query_id, m.vec_id AS memory_id, 1 - list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]) AS distance, e.ts, (m.vec_id * 7) % 23 AS access_count, ((m.vec_id * 13) % 120) / 100.0::DOUBLE AS importance
  FROM embeddings q JOIN embeddings m ON q.vec_id <> m.vec_id JOIN events e ON e.event_id = m.vec_id WHERE q.vec_id % 50 = 0),
pool AS (SELECT * FROM mem QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 6), memory_id) <= 10),
sc AS (SELECT *, greatest(0, 1 - distance / 2) AS semantic, exp(-0.693 * greatest(0, (epoch_us({_AS_OF}) - epoch_us(ts)) / 3.6e9) / 24) AS recency, CASE WHEN access_count <= 0 THEN 0 ELSE least(1, ln(1 + access_count) / ln(1 + greatest(max(access_count) OVER (PARTITION BY query_id), 1))) END AS frequency, least(1, importance) AS capped FROM pool),
fin AS (SELECT *, 0.5 * semantic + 0.2 * recency + 0.2 * frequency + 0.1 * capped AS score FROM sc)"""


@query("memory_rank", f"WITH {_MEM} SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, memory_id) AS rank, round(score, 6) AS score FROM fin WHERE round(score, 6) >= 0.4 QUALIFY rank <= 5")
def memory_rank(s, d):
    """Vectors are memories, times come from the events of the same number; queries are ids divisible by 50."""
    from plumbline.operators.retrieval import dense_ranking

    ev = I.table(s, d, "events").select(F.col("event_id").alias("memory_id"), "ts")
    held = I.vectors(s, d).join(ev.select(F.col("memory_id").alias("doc_id")), "doc_id", "left_semi")
    near = dense_ranking(held, I.vector_questions(s, d), 2 * Y.TOP_K).select("query_id", F.col("doc_id").alias("memory_id"), "distance")
    found = near.join(ev, "memory_id").withColumn("access_count", (F.col("memory_id") * 7) % 23).withColumn("importance", ((F.col("memory_id") * 13) % 120) / 100.0)
    return Y.ranked_memories(found, F.lit("2024-02-01 00:00:00").cast("timestamp")).select("query_id", "memory_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("recency_score", f"SELECT event_id, round(exp(-0.693 * greatest(0, (epoch_us({_AS_OF}) - epoch_us(ts)) / 3.6e9) / 24), 6) AS recency FROM events")
def recency_score(s, d):
    return I.table(s, d, "events").select("event_id", F.round(Y.recency_score(F.col("ts").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp")), 6).alias("recency"))


@query("frequency_score", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, n, round(least(1, ln(1 + n) / ln(1 + greatest((SELECT max(n) FROM c), 1))), 6) AS frequency FROM c")
def frequency_score(s, d):
    c = I.table(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.max("n").alias("most")))).select("user_id", "n", F.round(Y.frequency_score(F.col("n"), F.col("most")), 6).alias("frequency"))  # one row


@query("short_term_ring", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events QUALIFY age <= 10")
def short_term_ring(s, d):
    return Y.ring(I.table(s, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("age").cast("long").alias("age"))


@query("session_tail", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 3")
def session_tail(s, d):
    return Y.ring(I.table(s, d, "conversations"), "conv_id", ["turn", "role"], 3).select("conv_id", "turn", "role")


@query("session_list", "SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS memory_count FROM events GROUP BY 1")
def session_list(s, d):
    return I.table(s, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count(F.lit(1)).alias("memory_count"))


@query("current_session", "SELECT user_id AS session_id FROM events GROUP BY 1 ORDER BY max(ts) DESC, 1 LIMIT 1")
def current_session(s, d):
    e = I.table(s, d, "events").select(F.col("user_id").alias("session_id"), "ts")
    return Y.sessions(e).orderBy(F.desc("last_activity"), "session_id").limit(1).select("session_id")


_TOPIC = ", ".join(f"'{w}'" for w in Y.TOPIC_STOP)


@query("topic_terms", f"""WITH w AS (SELECT conv_id, turn, i, ws[i + 1] AS term FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM conversations), unnest(range(len(ws)::BIGINT)) t(i)),
c AS (SELECT conv_id, term, count(*) AS n, min(turn * 100000 + i) AS first FROM w WHERE length(term) > 2 AND term NOT IN ({_TOPIC}) GROUP BY 1, 2) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first) AS rank, term, n FROM c QUALIFY rank <= 7""")
def topic_terms(s, d):
    return Y.topics(I.table(s, d, "conversations"), "conv_id", "turn").withColumn("rank", F.col("rank").cast("long"))


@query("auto_summary_batch", "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n >= 20 AND place <= n // 2")
def auto_summary_batch(s, d):
    return Y.summary_batch(I.table(s, d, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("exchanges", f"WITH {I.ANSWERS_SQL} SELECT trace_id, 'Q: ' || question || chr(10) || 'A: ' || answer AS document FROM answers")
def exchanges(s, d):
    return I.answers(s, d).select("trace_id", Y.encoded(F.col("question"), F.col("answer")).alias("document"))


@query("session_messages", f"WITH {I.ANSWERS_SQL} SELECT trace_id, 0 AS part, 'user' AS role, question AS text FROM answers UNION ALL SELECT trace_id, 1, 'assistant', answer FROM answers")
def session_messages(s, d):
    m = I.answers(s, d).select(F.col("conv_id").alias("session_id"), F.col("trace_id").alias("memory_id"), "question", "answer")
    return Y.messages(m).select(F.col("memory_id").alias("trace_id"), "part", "role", "text")
