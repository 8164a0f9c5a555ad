"""Queries over retrieval, fusion and ranking metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions.text import lexical_tokens
from plumbline.operators import lexical_index as X
from plumbline.operators import metrics as M
from plumbline.operators import retrieval as R
from plumbline.operators import vector_index as V
from plumbline.plans import inputs as I
from plumbline.session import remove, shared_folder, written

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


_STOP = ", ".join(f"'{w}'" for w in __import__("plumbline.functions.text", fromlist=["RETRIEVAL_STOP"]).RETRIEVAL_STOP)
_TOK = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({_STOP}))"
_BM25 = f"""
toks AS (SELECT doc_id, lang, {_TOK} AS tokens FROM documents),
tok AS (SELECT doc_id, unnest(tokens) AS term FROM toks),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1),
n AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS qn FROM (SELECT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
scores AS (SELECT query_id, tf.doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))) AS score FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN toks ON toks.doc_id = tf.doc_id, n GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM scores WHERE score > 0 QUALIFY rank <= 40)"""
_DENSE = """
vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings),
dense AS (SELECT q.doc_id AS query_id, d.doc_id, 1 - list_cosine_similarity(q.v, d.v) AS distance, q.label AS q_label, d.label, row_number() OVER (PARTITION BY q.doc_id ORDER BY round(1 - list_cosine_similarity(q.v, d.v), 6), d.doc_id) AS rank
  FROM vec q JOIN vec d ON q.doc_id <> d.doc_id WHERE q.doc_id % 50 = 0 QUALIFY rank <= 40)"""
#: A second arm over documents and benchmark: the share of the question's distinct words in the text.
_OVER = f"""
over0 AS (SELECT a.query_id, tf.doc_id, count(*) / max(s.n)::DOUBLE AS score FROM asked a JOIN tf USING (term) JOIN (SELECT query_id, count(*) AS n FROM asked GROUP BY 1) s ON s.query_id = a.query_id GROUP BY 1, 2),
second AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM over0 QUALIFY rank <= 40)"""


def _index(s, d):
    """The stored index of the documents, which all lexical queries of an application share."""
    return X.stored(I.documents(s, d))


def _bm25(s, d, limit=R.POOL):
    return _index(s, d).search(I.questions(s, d), limit)


def _second(s, d):
    """The second arm: overlap of distinct words."""
    return _index(s, d).overlap(I.questions(s, d))


def _dense(s, d, limit=R.POOL):
    return R.dense_ranking(I.vectors(s, d), I.vector_questions(s, d), limit)


@query("token_stats", f"""SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_terms FROM (SELECT doc_id, {_TOK} AS t FROM documents)""")
def token_stats(s, d):
    return I.documents(s, d).select("doc_id", lexical_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


#: Each document gives a term once; the mean is taken beside the rows, so that the words are read once.
_IDF = f"""WITH w AS (SELECT unnest(list_distinct({_TOK})) AS term FROM documents), c AS (SELECT term, count(*) AS df FROM w GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM c, n), m AS (SELECT term, df, raw, avg(raw) OVER () AS mean FROM r)
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END, 6) AS idf FROM m"""


@query("bm25_idf", _IDF)
def bm25_idf(s, d):
    return _index(s, d).terms().select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 10")
def bm25_topk(s, d):
    """Flagship: the ten best documents of every benchmark item."""
    return _bm25(s, d, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("lexical_index_build", f"WITH t AS (SELECT doc_id, {_TOK} AS t FROM documents), w AS (SELECT doc_id, unnest(t) AS term FROM t) SELECT (SELECT count(*) FROM t) AS n_docs, (SELECT round(avg(len(t)), 6) FROM t) AS mean_dl, (SELECT count(DISTINCT term) FROM w) AS n_terms, (SELECT count(*) FROM (SELECT DISTINCT doc_id, term FROM w)) AS n_postings")
def lexical_index_build(s, d):
    """An index of all documents from scratch, and what it holds; the folder goes again."""
    index = X.LexicalIndex(s, f"{shared_folder(s)}/lexical-{uuid.uuid4().hex[:12]}")
    index.add(I.documents(s, d))
    held = index.terms().agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))
    out = written(index.counts().select("n_docs", F.round("mean_dl", 6).alias("mean_dl")).crossJoin(F.broadcast(held)), "lexical-build")  # one row
    remove(s, index.path)
    return out


@query("lexical_index_audit", f"WITH {_BM25} SELECT (SELECT count(*) FROM (SELECT DISTINCT query_id FROM sparse)) AS n_questions, (SELECT count(*) FROM sparse WHERE rank <= 10) AS n_rows, TRUE AS same_rows, TRUE AS skips_blocks")
def lexical_index_audit(s, d):
    """The two-phase search against scoring all postings: as many rows, all the same, from fewer blocks."""
    index, q = _index(s, d), I.questions(s, d)
    found = index.search(q, 10).select("query_id", "doc_id", "rank")
    whole = R.ranked(index.scores(q), ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], 10).select("query_id", "doc_id", "rank")
    met = found.withColumn("a", F.lit(1)).join(whole.withColumn("b", F.lit(1)), ["query_id", "doc_id", "rank"], "full")
    rows = met.agg(F.countDistinct("query_id").alias("n_questions"), F.count("a").alias("n_rows"), F.coalesce(F.every(F.col("a").isNotNull() & F.col("b").isNotNull()), F.lit(True)).alias("same_rows"))
    blocks = index.bounds(q).agg(F.sum("n_blocks").alias("every")).crossJoin(F.broadcast(index.reached(q, 10).agg(F.sum("n_blocks").alias("read"))))  # one row
    return rows.crossJoin(F.broadcast(blocks.select((F.col("read") < F.col("every")).alias("skips_blocks"))))  # one row


@query("lexical_index_segments", f"WITH {_BM25.replace('FROM documents)', 'FROM documents WHERE doc_id % 7 <> 3)')} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM sparse WHERE rank <= 5")
def lexical_index_segments(s, d):
    """Three segments one after the other, from which documents are then deleted; some of those come back in a fourth and go again."""
    docs, index = I.documents(s, d), X.LexicalIndex(s, f"{shared_folder(s)}/lexical-{uuid.uuid4().hex[:12]}")
    for k in range(3):
        index.add(docs.where(F.col("doc_id") % 3 == k))
    index.delete(docs.where("doc_id % 7 = 3"))
    index.add(docs.where("doc_id % 14 = 3"))
    index.delete(docs.where("doc_id % 14 = 3"))
    out = written(index.search(I.questions(s, d), 5).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score")), "lexical-segments")
    remove(s, index.path)
    return out


@query("dense_topk", f"WITH {_DENSE} SELECT query_id, doc_id, rank, round(distance, 6) AS distance FROM dense WHERE rank <= 10")
def dense_topk(s, d):
    return _dense(s, d, 10).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def _vectors(s, d):
    return V.stored(I.vectors(s, d))


def _near(s, d, limit=10):
    return _vectors(s, d).search(I.vector_questions(s, d), limit)


@query("ivf_topk")
def ivf_topk(s, d):
    """About the ten nearest vectors by the index; ivf_recall holds them against exact search."""
    return _near(s, d).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


def _recalls(s, d):
    exact, found = _dense(s, d, 10).select("query_id", "doc_id"), _near(s, d).select("query_id", "doc_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall_at_10"))


@query("ivf_recall")
def ivf_recall(s, d):
    """The share of each question's ten nearest vectors that the index finds."""
    return _recalls(s, d)


@query("ivf_audit", "SELECT count(*) FILTER (vec_id % 50 = 0) AS n_questions, TRUE AS recall_reached, (SELECT count(*) FROM embeddings) AS n_indexed FROM embeddings")
def ivf_audit(s, d):
    """A mean recall of 0.9 is reached, and every vector is filed."""
    return _recalls(s, d).agg(F.count(F.lit(1)).alias("n_questions"), (F.avg("recall_at_10") >= 0.9).alias("recall_reached")).crossJoin(F.broadcast(_vectors(s, d).vectors().agg(F.count(F.lit(1)).alias("n_indexed"))))  # one row


@query("ivf_changes", """SELECT vec_id AS doc_id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 9 <> 4 AND vec_id % 40 <> 7
UNION ALL SELECT vec_id, -1, round(-embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id % 40 = 7""")
def ivf_changes(s, d):
    """An index from which vectors are deleted and into which others are put in other vectors' place, and what it then holds."""
    index, rows = V.VectorIndex(s, f"{shared_folder(s)}/vectors-{uuid.uuid4().hex[:12]}"), I.vectors(s, d)
    index.build(rows)
    index.delete(rows.where("doc_id % 9 = 4"))
    index.upsert(rows.where("doc_id % 40 = 7").withColumn("v", F.transform("v", lambda x: -x)).withColumn("label", F.lit(-1)))
    out = written(index.vectors().select("doc_id", "label", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("first")), "vectors-held")
    remove(s, index.path)
    return out


@query("dense_min_distance", f"WITH {_DENSE} SELECT query_id, count(*) AS pool_size, round(min(distance), 6) AS min_distance FROM dense GROUP BY 1")
def dense_min_distance(s, d):
    return R.pool_statistics(_dense(s, d), None).select("query_id", "pool_size", F.round("min_distance", 6).alias("min_distance"))


def _fusion_sql(arms: str) -> str:
    join = {"hybrid": "second a FULL JOIN sparse b ON a.query_id = b.query_id AND a.doc_id = b.doc_id", "vector": "second a LEFT JOIN sparse b ON FALSE", "bm25": "sparse b LEFT JOIN second a ON FALSE"}[arms]
    return f"""WITH {_BM25}, {_OVER}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.rank::BIGINT AS dense_rank, b.rank::BIGINT AS sparse_rank,
  coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s FROM {join})
SELECT query_id, doc_id, dense_rank, sparse_rank, round(s, 9) AS rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= 20"""


def _fused(s, d, mode):
    out = R.candidates(mode, _second(s, d), _bm25(s, d))
    return out.select("query_id", "doc_id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("sparse_rank").cast("long").alias("sparse_rank"), F.round("rrf_score", 9).alias("rrf_score"), F.col("rank").cast("long").alias("rank"))


for _m, _n in (("hybrid", "rrf_fusion"), ("vector", "retrieval_mode_vector"), ("bm25", "retrieval_mode_bm25")):
    query(_n, _fusion_sql(_m))(lambda s, d, m=_m: _fused(s, d, m))


@query("pool_statistics", f"WITH {_BM25}, {_OVER} SELECT query_id, count(DISTINCT doc_id) AS pool_size FROM (SELECT query_id, doc_id FROM sparse UNION ALL SELECT query_id, doc_id FROM second) GROUP BY 1")
def pool_statistics(s, d):
    return R.pool_statistics(_second(s, d).withColumn("distance", 1 - F.col("score")), _bm25(s, d)).select("query_id", "pool_size")


@query("two_corpus_merge", f"""WITH {_BM25}, half AS (SELECT s.query_id, s.doc_id, s.score, t.lang = 'en' AS en, row_number() OVER (PARTITION BY s.query_id, t.lang = 'en' ORDER BY round(s.score, 6) DESC, s.doc_id) AS r FROM scores s JOIN toks t ON t.doc_id = s.doc_id WHERE score > 0)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM half WHERE r <= 20 QUALIFY rank <= 5""")
def two_corpus_merge(s, d):
    """Results among English documents and among the others, merged (scored over the whole collection)."""
    scored = _index(s, d).scores(I.questions(s, d)).join(I.table(s, d, "documents").select("doc_id", (F.col("lang") == "en").alias("en")), "doc_id")
    halves = [R.ranked(scored.where(w).drop("en"), ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], 20) for w in ("en", "not en")]
    return R.merged_corpora(*halves).select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("rerank_lexical", f"""WITH {_BM25}, {_OVER}, pool AS (SELECT s.query_id, s.doc_id, s.rank, o.score FROM sparse s JOIN over0 o ON o.query_id = s.query_id AND o.doc_id = s.doc_id WHERE s.rank <= 20)
SELECT query_id, doc_id, rank AS prior_rank, round(score, 6) AS reranker_score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, rank) AS rank_now FROM pool QUALIFY rank_now <= 6""")
def rerank_lexical(s, d):
    asked = I.questions(s, d).select("query_id", F.array_distinct(lexical_tokens(F.col("question"))).alias("q"))
    pool = _bm25(s, d, R.RERANK_WINDOW).join(_index(s, d).documents().select("doc_id", "terms"), "doc_id").join(asked, "query_id")
    out = R.reranked(pool.withColumn("reranker_score", R.word_overlap(F.col("q"), F.col("terms"))))
    return out.select("query_id", "doc_id", F.col("prior_rank").cast("long").alias("prior_rank"), F.round("reranker_score", 6).alias("reranker_score"), F.col("rank").cast("long").alias("rank_now"))


_GOLD = """
sh AS (SELECT DISTINCT item_id AS query_id, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark), unnest(range(1, greatest(len(w) - 6, 1)::BIGINT)) t(i)),
dsh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents), unnest(range(1, greatest(len(w) - 6, 1)::BIGINT)) t(i)),
gold AS (SELECT DISTINCT query_id, doc_id FROM sh JOIN dsh USING (s))"""


@query("gold_shingles", f"WITH {_GOLD} SELECT query_id, doc_id FROM gold")
def gold_shingles(s, d):
    return R.shingle_gold(I.documents(s, d), I.questions(s, d))


@query("gold_theta_join", """SELECT d.doc_id, p.r_regionkey AS region FROM documents d JOIN region p ON contains(d.source, p.r_regionkey::VARCHAR) AND regexp_matches(d.text, '(?m)^[A-Z]')""")
def gold_theta_join(s, d):
    """Weak gold labels: a name is contained and a line begins as asked. The dimension is five rows."""
    dim = I.table(s, d, "region").select(F.col("r_regionkey").alias("region"))
    docs = I.documents(s, d, "source").where(F.col("text").rlike("(?m)^[A-Z]"))
    return docs.join(dim, F.contains("source", F.col("region").cast("string"))).select("doc_id", "region")


_PHRASE = 5
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"


@query("phrase_containment", f"""WITH b AS (SELECT item_id, {_W} AS w FROM benchmark), p AS (SELECT item_id, i AS place, ' ' || array_to_string(w[i * {_PHRASE} + 1 : i * {_PHRASE} + {_PHRASE}], ' ') || ' ' AS phrase FROM b, unnest(range(((len(w) + {_PHRASE - 1}) // {_PHRASE})::BIGINT)) t(i) WHERE i * {_PHRASE} < len(w)),
d AS (SELECT doc_id, ' ' || array_to_string({_W}, ' ') || ' ' AS line FROM documents) SELECT item_id, place, doc_id FROM p JOIN d ON contains(line, phrase)""")
def phrase_containment(s, d):
    """Every phrase of five words of the benchmark's texts against all documents."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    b = I.table(s, d, "benchmark").select("item_id", w.alias("w")).where(F.size("w") > 0)
    p = b.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / _PHRASE))).alias("place")).select("item_id", F.col("place").cast("long").alias("place"), F.array_join(F.slice("w", (F.col("place") * _PHRASE + 1).cast("int"), F.lit(_PHRASE)), " ").alias("phrase"))
    return R.contained_phrases(I.documents(s, d), p, ["item_id", "place"])


_PANEL = """g AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
h AS (SELECT query_id, list(rank ORDER BY rank) AS ranks FROM ranking JOIN gold USING (query_id, doc_id) GROUP BY 1),
p AS (SELECT q.query_id, coalesce(n_gold, 0) AS n_gold, coalesce(ranks, []) AS ranks FROM queries q LEFT JOIN g USING (query_id) LEFT JOIN h USING (query_id)),
panel AS (SELECT query_id, n_gold, """ + ", ".join(f"CASE WHEN n_gold > 0 THEN round(len(list_filter(ranks, lambda r: r <= {k})) / n_gold::DOUBLE, 4) END AS recall_at_{k}" for k in (5, 10, 20)) + """,
  CASE WHEN n_gold > 0 THEN CASE WHEN list_min(ranks) <= 10 THEN 1.0 ELSE 0.0 END END::DOUBLE AS hit_at_10, CASE WHEN n_gold > 0 THEN round(coalesce(1.0::DOUBLE / list_min(ranks), 0), 4) END AS mrr,
  CASE WHEN n_gold > 0 THEN round(coalesce(list_sum(list_transform(list_filter(ranks, lambda r: r <= 10), lambda r: 1.0 / log2((r + 1)::DOUBLE))), 0) / list_sum(list_transform(range(1, least(n_gold, 10)::BIGINT + 1), lambda r: 1.0 / log2((r + 1)::DOUBLE))), 4) END AS ndcg_at_10,
  CASE WHEN n_gold > 0 THEN len(ranks) = n_gold END AS all_gold_found FROM p)"""
_DOC_PANEL = f"WITH {_BM25}, {_GOLD}, ranking AS (SELECT * FROM sparse), queries AS (SELECT item_id AS query_id FROM benchmark), {_PANEL}"
_VEC_GOLD = f"{_DENSE}, gold AS (SELECT q.doc_id AS query_id, d.doc_id FROM vec q JOIN vec d ON q.doc_id <> d.doc_id AND q.label = d.label WHERE q.doc_id % 50 = 0), ranking AS (SELECT * FROM dense), queries AS (SELECT doc_id AS query_id FROM vec WHERE doc_id % 50 = 0)"


def _doc_ranks(s, d):
    q = I.questions(s, d)
    return M.gold_ranks(_bm25(s, d), R.shingle_gold(I.documents(s, d), q), q)


def _vec_ranks(s, d):
    asked = I.vector_questions(s, d).select("query_id", F.col("q_label").alias("label"))
    return M.label_ranks(_dense(s, d), I.vectors(s, d), asked)


def _wide(panel):
    return panel.select("query_id", F.col("n_gold").cast("long").alias("n_gold"), "recall_at_5", "recall_at_10", "recall_at_20", "hit_at_10", "mrr", "ndcg_at_10", "all_gold_found")


@query("retrieval_panel", f"{_DOC_PANEL} SELECT * FROM panel")
def retrieval_panel(s, d):
    return _wide(M.retrieval_panel(_doc_ranks(s, d)))


@query("retrieval_panel_vectors", f"WITH {_VEC_GOLD}, {_PANEL} SELECT * FROM panel")
def retrieval_panel_vectors(s, d):
    return _wide(M.retrieval_panel(_vec_ranks(s, d)))


for _metric, _cols in (("recall_at_k", ["recall_at_5", "recall_at_10", "recall_at_20"]), ("hit_at_k", ["hit_at_10"]), ("mrr", ["mrr"]), ("ndcg_at_10", ["ndcg_at_10"])):
    query(_metric, f"WITH {_VEC_GOLD}, {_PANEL} SELECT query_id, {', '.join(_cols)} FROM panel")(lambda s, d, c=tuple(_cols): M.retrieval_panel(_vec_ranks(s, d)).select("query_id", *c))


@query("retrieval_by_group", f"WITH {_VEC_GOLD}, {_PANEL} SELECT label, count(*) AS n, round(avg(recall_at_10), 6) AS recall_at_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg_at_10), 6) AS ndcg_at_10 FROM panel JOIN vec ON doc_id = query_id GROUP BY 1")
def retrieval_by_group(s, d):
    panel = M.retrieval_panel(_vec_ranks(s, d)).join(I.vector_questions(s, d).select("query_id", F.col("q_label").alias("label")), "query_id")
    # six places: means of values with four places often end in a half at the fifth, which engines round differently
    return M.mean_by(panel, ["label"], ["recall_at_10", "mrr", "ndcg_at_10"], 6)


_FLAGS = "flags AS (SELECT query_id, rank, CASE WHEN query_id % 150 = 0 AND rank = 3 THEN NULL ELSE q_label = label END AS relevant FROM dense WHERE rank <= 10)"


def _flags(s, d):
    """Judged flags of the ten nearest; one query in three has an unjudged one."""
    near = _dense(s, d, 10).join(I.vectors(s, d).select("doc_id", "label"), "doc_id").join(I.vector_questions(s, d).select("query_id", "q_label"), "query_id")
    return near.select("query_id", "rank", F.when(~((F.col("query_id") % 150 == 0) & (F.col("rank") == 3)), F.col("q_label") == F.col("label")).alias("relevant"))


@query("average_precision", f"""WITH {_DENSE}, {_FLAGS}, r AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM flags)
SELECT query_id, CASE WHEN count(*) FILTER (relevant IS NULL) > 0 THEN NULL ELSE round(coalesce(avg(CASE WHEN relevant THEN hits / rank::DOUBLE END), 0), 4) END AS context_precision FROM r GROUP BY 1""")
def average_precision(s, d):
    return M.average_precision(_flags(s, d))


@query("context_relevancy", f"WITH {_DENSE}, {_FLAGS} SELECT query_id, CASE WHEN count(*) FILTER (relevant IS NULL) > 0 THEN NULL ELSE round(avg(relevant::INT), 4) END AS context_relevancy FROM flags GROUP BY 1")
def context_relevancy(s, d):
    return M.flag_mean(_flags(s, d))


_ARMS = f"""{_BM25}, {_OVER}, {_GOLD}, arms AS (SELECT 'bm25' AS arm, query_id, doc_id, rank FROM sparse UNION ALL SELECT 'overlap', query_id, doc_id, rank FROM second),
g AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
m AS (SELECT a.arm, g.query_id, round(count(gold.doc_id) FILTER (a.rank <= 10) / max(n)::DOUBLE, 4) AS recall FROM arms a JOIN g USING (query_id) LEFT JOIN gold ON gold.query_id = a.query_id AND gold.doc_id = a.doc_id GROUP BY 1, 2)"""


def _arms(s, d):
    gold = R.shingle_gold(I.documents(s, d), I.questions(s, d))
    arms = _bm25(s, d).select(F.lit("bm25").alias("arm"), "query_id", "doc_id", "rank").unionByName(_second(s, d).select(F.lit("overlap").alias("arm"), "query_id", "doc_id", "rank"))
    sizes = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = arms.join(sizes, "query_id").join(gold.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    return hits.groupBy("arm", "query_id").agg(F.round(F.count_if((F.col("rank") <= 10) & (F.col("hit") == 1)) / F.max("n"), 4).alias("recall"))


@query("arm_delta_vs_baseline", f"WITH {_ARMS} SELECT a.arm, count(*) AS n_pairs, round(avg(a.recall - b.recall), 4) AS mean_delta FROM m a JOIN m b ON a.query_id = b.query_id AND b.arm = 'bm25' WHERE a.arm <> 'bm25' GROUP BY 1")
def arm_delta_vs_baseline(s, d):
    return M.deltas_from(_arms(s, d), "arm", "bm25", ["query_id"], "recall")


@query("arm_cube", f"WITH {_ARMS} SELECT arm, CASE WHEN grouping(query_id % 3) = 0 THEN query_id % 3 END AS kind, count(*) AS n, round(avg(recall), 4) AS recall FROM m GROUP BY CUBE (arm, query_id % 3)")
def arm_cube(s, d):
    return _arms(s, d).withColumn("kind", F.col("query_id") % 3).cube("arm", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 4).alias("recall"))


@query("best_arm", f"WITH {_ARMS}, t AS (SELECT arm, avg(recall) AS r FROM m GROUP BY 1) SELECT arm AS best_arm FROM t ORDER BY round(coalesce(r, 0), 6) DESC, arm LIMIT 1")
def best_arm(s, d):
    t = _arms(s, d).groupBy("arm").agg(F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 6).alias("r"))
    return t.orderBy(F.desc("r"), "arm").limit(1).select(F.col("arm").alias("best_arm"))
