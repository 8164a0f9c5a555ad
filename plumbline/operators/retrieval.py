"""Lexical and dense retrieval, fusion, reranking: all questions at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import lexical_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
POOL, RERANK_WINDOW, FINAL, TOP_K = 40, 20, 6, 5
RRF_K = 60
MODES = ("vector", "bm25", "hybrid")


#: Up to this many rows of a short key are broadcast, after counting them.
_BROADCAST_ROWS = 500_000


def small(keys: DataFrame) -> DataFrame:
    """Keys (one short column) marked for broadcasting if a count shows that they are few; else as they are, for a shuffled join."""
    return F.broadcast(keys) if keys.limit(_BROADCAST_ROWS + 1).count() <= _BROADCAST_ROWS else keys


def ranked(df: DataFrame, group: list[str], order: list[Column], limit: int | None = None, name: str = "rank") -> DataFrame:
    """row_number() from 1 within each group; `order` must end with a unique key."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out if limit is None else out.where(F.col(name) <= limit)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, dl, tokens). Each reader splits the texts anew; a stored index (lexical_index) does it once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), lexical_tokens(F.col(text_col)).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("dl"), "tokens")


def _term_weights(tokens: DataFrame) -> DataFrame:
    terms = tokens.select(F.explode(F.array_distinct("tokens")).alias("term"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = tokens.agg(F.count(F.lit(1)).alias("n_docs"))
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))  # one row


def bm25_terms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, df, idf) over the whole collection; idf that would be negative is EPSILON times the mean one."""
    return _term_weights(docs.select(F.col(id_col).alias("doc_id"), lexical_tokens(F.col(text_col)).alias("tokens")))


def asked_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, qn): how often each question has each of its terms."""
    return questions.select("query_id", F.explode(lexical_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))


def postings(tokens: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, dl, term, tf) of the terms that some question has; other words are dropped where they are read."""
    words = tokens.select("doc_id", "dl", F.explode("tokens").alias("term"))
    return words.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for documents that share a term; a repeated query term counts each time.

    docs: doc_id, text, or tokenized() ones. questions: query_id, question. Only
    postings of query terms are shuffled; document lengths travel with them.
    """
    tokens = docs if "tokens" in docs.columns else tokenized(docs)
    asked = asked_terms(questions)
    mean = tokens.agg(F.avg("dl").alias("avgdl"))
    tf = postings(tokens, asked)
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weights = _term_weights(tokens).join(small(asked.select("term").distinct()), "term", "left_semi")
    weighed = tf.join(weights, "term").crossJoin(F.broadcast(mean)).select("doc_id", "term", weight.alias("w"))  # one row
    return asked.join(weighed, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qn") * F.col("w")).alias("score"))


def bm25_ranking(docs: DataFrame, questions: DataFrame, limit: int = POOL) -> DataFrame:
    scored = bm25_scores(docs, questions).where("score > 0")
    return ranked(scored, ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], limit)


def overlap_ranking(docs: DataFrame, questions: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, doc_id, score, rank): the share of the question's distinct words that the document has, found through the terms."""
    tokens = docs if "tokens" in docs.columns else tokenized(docs)
    asked = asked_terms(questions)
    sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    hits = postings(tokens, asked).join(asked, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("c")).join(sizes, "query_id")
    return ranked(hits.select("query_id", "doc_id", (F.col("c") / F.col("n")).alias("score")), ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], limit)


def cosine(x: Column, y: Column) -> Column:
    """Cosine similarity in double precision; 0 where a vector has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.coalesce(dot(x, y) / F.nullif(norm, F.lit(0.0)), F.lit(0.0))


#: Rows of a block of vectors and of a block of questions.
_BLOCK, _ASKED = 2048, 512
#: Up to this many questions are broadcast, after counting them.
_BROADCAST_QUESTIONS = 50_000
#: Rows of questions' nearest that a task holds before it gives them out.
_KEPT = 1 << 20


def _blocks(df: DataFrame, id_col: str, vector: str, n: int, name: str) -> DataFrame:
    """n blocks by a hash of the id: (name_block, name_ids, name_vectors)."""
    keyed = df.select(F.pmod(F.xxhash64(id_col), F.lit(n)).alias(f"{name}_block"), F.struct(F.col(id_col).alias("i"), F.col(vector).cast("array<double>").alias("v")).alias("x"))
    return keyed.groupBy(f"{name}_block").agg(F.collect_list("x").alias("l")).select(f"{name}_block", F.transform("l", lambda x: x["i"]).alias(f"{name}_ids"), F.transform("l", lambda x: x["v"]).alias(f"{name}_vectors"))


def _nearest(asked: np.ndarray, ids: np.ndarray, far: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Without rows that `limit` others of their question come before, by distance at six places and then id; a row that may be rounded either way pushes none out."""
    low, high = (np.floor(far * 1e6 + 0.5 + e).astype(np.int64) for e in (-1e-6, 1e-6))
    order = np.lexsort((ids.astype(str) if ids.dtype == object else ids, low, asked.astype(str) if asked.dtype == object else asked))
    asked, ids, far, sure = asked[order], ids[order], far[order], (low == high)[order]
    first = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]])) if len(asked) else np.zeros(0, int)
    before = np.cumsum(sure) - sure
    before -= np.repeat(before[first], np.diff([*first, len(asked)]))
    kept = before < limit
    return asked[kept], ids[kept], far[kept]


def _rows(near: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("query_id", "doc_id", "distance"), near)))


def _nearest_in_block(limit: int):
    def unit(rows) -> np.ndarray:
        m = np.array([np.asarray(r, float) for r in rows])
        length = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, length, out=np.zeros_like(m), where=length > 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for frame in frames:
            for b in frame.itertuples(index=False):
                ids, asked = np.array(b.v_ids), np.array(b.q_ids)
                far = 1 - unit(b.q_vectors) @ unit(b.v_vectors).T
                far[asked[:, None] == ids[None, :]] = np.inf
                k = min(limit, far.shape[1]) - 1
                edge = np.partition(far, k, axis=1)[:, k : k + 1]
                q, v = np.nonzero((far <= edge + 2e-6) & np.isfinite(far))  # with all that may tie at six places
                new = (asked[q], ids[v], far[q, v])
                best[b.q_block] = _nearest(*(map(np.concatenate, zip(best[b.q_block], new)) if b.q_block in best else new), limit)
                if sum(len(x[0]) for x in best.values()) > _KEPT:
                    yield from map(_rows, best.values())
                    best = {}
        yield from map(_rows, best.values())

    return run


def dense_ranking(vectors: DataFrame, questions: DataFrame, limit: int = POOL) -> DataFrame:
    """(query_id, doc_id, distance, rank): nearest vectors by cosine distance, exactly; a vector without length is at distance 1.

    questions: query_id, q; a stated set of queries against all vectors. Each
    block of questions meets each block of vectors, of bounded size both; a pair
    of blocks is one product of matrices, and a task gives only each question's
    nearest of all its pairs. Vectors are shuffled once, into their blocks.
    """
    kinds = {k: t for k, t in [*vectors.select(F.col("doc_id").alias("doc_id")).dtypes, *questions.select("query_id").dtypes]}
    n = max(1, -(-vectors.count() // _BLOCK))
    n_asked = questions.count()
    m = max(1, -(-n_asked // _ASKED))
    asked = _blocks(questions, "query_id", "q", m, "q")
    asked = F.broadcast(asked) if n_asked <= _BROADCAST_QUESTIONS else asked
    # each block of vectors names the blocks of questions it meets, so that none of these is copied
    met = _blocks(vectors, "doc_id", "v", n, "v").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    pairs = met.join(asked, "q_block")
    near = pairs.mapInPandas(_nearest_in_block(limit), f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, distance double")
    return ranked(near, ["query_id"], [F.round("distance", 6), F.col("doc_id")], limit)


def rrf(dense: DataFrame | None, sparse: DataFrame | None, limit: int = RERANK_WINDOW, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of the arms given: (query_id, doc_id, dense_rank, sparse_rank, rrf_score, rank)."""
    arm = lambda d, name: d.select("query_id", "doc_id", F.col("rank").alias(name))
    if dense is None and sparse is None:
        raise ValueError("no arm given")
    if dense is None:
        both = arm(sparse, "sparse_rank").withColumn("dense_rank", F.lit(None).cast("int"))
    elif sparse is None:
        both = arm(dense, "dense_rank").withColumn("sparse_rank", F.lit(None).cast("int"))
    else:
        both = arm(dense, "dense_rank").join(arm(sparse, "sparse_rank"), ["query_id", "doc_id"], "full")
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    scored = both.select("query_id", "doc_id", "dense_rank", "sparse_rank", (part("dense_rank") + part("sparse_rank")).alias("rrf_score"))
    return ranked(scored, ["query_id"], [F.round("rrf_score", 9).desc(), F.col("doc_id")], limit)


def candidates(mode: str, dense: DataFrame, sparse: DataFrame, limit: int = RERANK_WINDOW) -> DataFrame:
    """One arm or both; an arm that isn't asked for isn't planned."""
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode {mode!r}; one of {MODES}")
    return rrf(dense if mode != "bm25" else None, sparse if mode != "vector" else None, limit)


def pool_statistics(dense: DataFrame | None, sparse: DataFrame | None) -> DataFrame:
    """(query_id, pool_size, min_distance): distinct candidates, and the least distance (null without a dense arm)."""
    rows = []
    if dense is not None:
        rows.append(dense.select("query_id", "doc_id", "distance"))
    if sparse is not None:
        rows.append(sparse.select("query_id", "doc_id", F.lit(None).cast("double").alias("distance")))
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return both.groupBy("query_id").agg(F.countDistinct("doc_id").alias("pool_size"), F.min("distance").alias("min_distance"))


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that the text has: the default reranker."""
    return word_overlap(F.array_distinct(lexical_tokens(question)), lexical_tokens(text))


def word_overlap(asked: Column, words: Column) -> Column:
    """overlap_score() of a question's distinct words and a text's words."""
    return F.coalesce(F.size(F.array_intersect(asked, words)) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def reranked(pool: DataFrame, limit: int = FINAL) -> DataFrame:
    """Order a pool (query_id, doc_id, rank, reranker_score) by the reranker, prior rank on ties; new ranks."""
    prior = pool.withColumnRenamed("rank", "prior_rank")
    return ranked(prior, ["query_id"], [F.round("reranker_score", 6).desc(), F.col("prior_rank")], limit)


def merged_corpora(one: DataFrame, two: DataFrame, limit: int = TOP_K) -> DataFrame:
    """Results of two corpora in one ranking by score."""
    both = one.unionByName(two)
    return ranked(both.drop("rank"), ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], limit)


def prompt_order(chunks: DataFrame) -> DataFrame:
    """(query_id, context): chunk texts with the best one last."""
    rows = chunks.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("r"), "text")), asc=False).alias("c"))
    return rows.select("query_id", F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("context"))


def shingle_gold(docs: DataFrame, questions: DataFrame, n: int = 8) -> DataFrame:
    """(query_id, doc_id): documents that share a run of n words with the question."""
    def runs(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
        each = F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, n)))))
        return F.explode(F.array_distinct(F.get(each, F.lit(0))))

    q = questions.select("query_id", runs(F.col("question")).alias("s"))
    d = docs.select("doc_id", runs(F.col("text")).alias("s"))
    return d.join(q, "s").select("query_id", "doc_id").distinct()


def _word_grams(words: Column) -> Column:
    """Different words of an array, and different pairs of neighbours."""
    each = F.transform(F.array(words), lambda w: F.array_distinct(F.concat(w, F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))))
    return F.get(each, F.lit(0))


def contained_phrases(docs: DataFrame, phrases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doc_id): documents that hold a phrase as a run of whole words, in any case. docs: doc_id, text; phrases: keys, phrase.

    A phrase is filed under that of its words and pairs of neighbouring words
    which the fewest documents have, so that it meets those documents only; then
    the runs are compared. Phrases without a word are held by none, and repeated
    ones are one. No pair of a phrase and a document is made but through a gram.
    """
    split = lambda text: F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    asked = phrases.select(*keys, split(F.col("phrase")).alias("w")).where(F.size("w") > 0).distinct()
    grams = asked.select(*keys, "w", F.explode(_word_grams(F.col("w"))).alias("gram"))
    known = small(grams.select("gram").distinct())
    words = docs.select("doc_id", split(F.col("text")).alias("dw")).where(F.size("dw") > 0)
    seen = words.select("doc_id", F.explode(_word_grams(F.col("dw"))).alias("gram")).join(known, "gram", "left_semi")
    counts = seen.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that no document has leaves its phrase without any
    rarest = grams.join(counts, "gram", "left").groupBy(*keys, "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).where("r.n > 0").select(*keys, "w", "r.gram")
    met = words.join(seen.join(rarest, "gram").select("doc_id", *keys, "w"), "doc_id")
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return met.where(F.contains(line("dw"), line("w"))).select(*keys, "doc_id").distinct()
