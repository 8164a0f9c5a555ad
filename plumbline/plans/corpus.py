"""Queries over chunking, corpus quality and reranker windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions.text import lexical_tokens
from plumbline.operators import chunking as C
from plumbline.operators import retrieval as R
from plumbline.plans import inputs as I
from plumbline.plans import retrieval as Q

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


_W = "list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '')"


def _windows_sql(size: int, overlap: int) -> str:
    return f"""win AS (SELECT doc_id, source, i AS chunk_index, i * {size - overlap} AS start, w[i * {size - overlap} + 1 : i * {size - overlap} + {size}] AS ws FROM (SELECT doc_id, source, {_W} AS w FROM documents), unnest(range((greatest(0, len(w) - {overlap} - 1) // {size - overlap} + 1)::BIGINT)) t(i) WHERE len(w) > 0)"""


@query("chunk_windows", f"WITH {_windows_sql(512, 100)} SELECT doc_id, chunk_index, start, len(ws)::BIGINT AS n_words, md5(array_to_string(ws, ' ')) AS digest FROM win")
def chunk_windows(s, d):
    rows = C.windows(I.documents(s, d))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.md5("text").alias("digest"))


@query("chunk_hierarchical", f"""WITH w AS (SELECT doc_id, {_W} AS w FROM documents), a AS (SELECT doc_id, i AS level1, w[i * 2048 + 1 : i * 2048 + 2048] AS w FROM w, unnest(range(((len(w) - 1) // 2048 + 1)::BIGINT)) t(i) WHERE len(w) > 0),
b AS (SELECT doc_id, level1, i AS level2, w[i * 512 + 1 : i * 512 + 512] AS w FROM a, unnest(range(((len(w) - 1) // 512 + 1)::BIGINT)) t(i)), c AS (SELECT doc_id, level1, level2, i AS level3, w[i * 128 + 1 : i * 128 + 128] AS w FROM b, unnest(range(((len(w) - 1) // 128 + 1)::BIGINT)) t(i))
SELECT doc_id, level1, level2, level3, len(w)::BIGINT AS n_words FROM c""")
def chunk_hierarchical(s, d):
    return C.hierarchical(I.documents(s, d)).select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("level1", "level2", "level3", "n_words")])


@query("chunk_pack", """WITH RECURSIVE l AS (SELECT doc_id, i AS o, ls[i + 1] AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls)::BIGINT)) t(i)),
f(doc_id, o, g, used) AS (SELECT doc_id, o, 0::BIGINT, length(t)::BIGINT FROM l WHERE o = 0 UNION ALL
  SELECT l.doc_id, l.o, CASE WHEN used > 0 AND used + length(t) > 2000 THEN g + 1 ELSE g END, CASE WHEN used > 0 AND used + length(t) > 2000 THEN length(t) ELSE used + length(t) END FROM f JOIN l ON l.doc_id = f.doc_id AND l.o = f.o + 1)
SELECT f.doc_id, g AS chunk_index, min(f.o) AS first_part, count(*) AS n_parts, sum(length(t))::BIGINT AS n_chars FROM f JOIN l ON l.doc_id = f.doc_id AND l.o = f.o GROUP BY 1, 2""")
def chunk_pack(s, d):
    """Lines packed up to the budget of characters, in order."""
    lines = I.documents(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("o", "t"))
    out = C.packed(lines, ["doc_id"], "o", "t", C.LEGAL_BUDGET, joint="")
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "first_part", "n_parts", F.length("text").cast("long").alias("n_chars"))


@query("chunk_sentences", """WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(trim(text, ' '), '([.!?])[ \\t\\n\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, e' \\t\\n\\r')), lambda s: s <> '') AS ss FROM documents),
n AS (SELECT doc_id, ss, list_transform(ss, lambda x: len(list_filter(string_split_regex(x, '[ \\t\\n\\r\\x0b\\f]+'), lambda w: w <> ''))) AS z FROM s WHERE len(ss) > 0),
p AS (SELECT doc_id, ss, len(z) AS n, list_transform(range(0, len(z) + 1), lambda i: coalesce(list_sum(z[1:i]), 0)) AS c FROM n),
r(doc_id, k, a, b) AS (SELECT doc_id, 0, 0::BIGINT, list_max(list_filter(range(1, n + 1), lambda e: e = 1 OR c[e + 1] - c[1] <= 512)) FROM p UNION ALL
  SELECT doc_id, k + 1, a2, list_max(list_filter(range(b + 1, n + 1), lambda e: e = b + 1 OR c[e + 1] - c[a2 + 1] <= 512)) FROM (SELECT r.doc_id, k, b, n, c, list_min(list_filter(range(a + 1, b + 1), lambda j: j = b OR (c[b + 1] - c[j + 1] <= 100 AND c[b + 2] - c[j + 1] <= 512))) AS a2 FROM r JOIN p ON p.doc_id = r.doc_id WHERE b < n))
SELECT r.doc_id, k AS chunk_index, a AS first_part, b - a AS n_parts, md5(array_to_string(ss[a + 1 : b], ' ')) AS digest FROM r JOIN p USING (doc_id)""")
def chunk_sentences(s, d):
    """Whole sentences up to 512 words, with those of 100 words at most from the chunk before."""
    return C.sentence_windows(I.documents(s, d), C.SIZE, C.OVERLAP).select("doc_id", "chunk_index", "first_part", "n_parts", F.md5("text").alias("digest"))


@query("chunk_buffered", "SELECT conv_id AS doc_id, turn AS number, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)) AS digest FROM conversations")
def chunk_buffered(s, d):
    """Turns stand for sentences."""
    c = I.table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("number"), "text")
    return C.buffered(c).select("doc_id", "number", F.md5("text").alias("digest"))


@query("chunk_semantic", """WITH v AS (SELECT label AS doc_id, vec_id AS number, embedding::DOUBLE[] AS v FROM embeddings), g AS (SELECT doc_id, number, 1 - list_cosine_similarity(v, lag(v) OVER (PARTITION BY doc_id ORDER BY number)) AS gap FROM v),
c AS (SELECT doc_id, quantile_cont(gap, 0.95) AS cut FROM g GROUP BY 1) SELECT doc_id, number, round(gap, 6) AS gap, (sum(coalesce((gap > cut)::INT, 0)) OVER (PARTITION BY doc_id ORDER BY number))::BIGINT AS "group" FROM g JOIN c USING (doc_id)""")
def chunk_semantic(s, d):
    """Vectors in id order stand for a document's sentences (a document for each label)."""
    v = I.vectors(s, d).select(F.col("label").alias("doc_id"), F.col("doc_id").alias("number"), "v")
    return C.semantic(v).select("doc_id", "number", F.round("gap", 6).alias("gap"), "group")


_RE = {"toc": C.TOC_LINE, "heading": C.HEADING_LINE, "furniture": C.FURNITURE}


def _features_sql() -> str:
    q = lambda p: "'" + p.replace("'", "''") + "'"
    hits = lambda terms: " + ".join(f"contains(lower(text), '{t}')::INT" for t in terms)
    share = lambda a, b: f"coalesce({a} / nullif({b}, 0)::DOUBLE, 0)"
    n = lambda p: f"len(list_filter(ls, lambda x: regexp_matches(x, {q(p)})))"
    return f"""fe0 AS (SELECT doc_id, source, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ls, len(regexp_extract_all(text, '[A-Za-z'']+'))::BIGINT AS n_words FROM documents),
fe AS (SELECT doc_id, source, n_words, len(ls)::BIGINT AS n_lines, {share(n(_RE['toc']), 'len(ls)')} AS toc_share, {share(n(_RE['heading']), 'len(ls)')} AS heading_share, {share('n_words', 'len(ls)')} AS mean_line_words,
  {share("100.0 * len(regexp_extract_all(text, '[0-9]+[A-Z]?[ \\t\\n\\r]*[.(]'))", 'n_words')} AS section_refs0, {hits(C.OPERATIVE)} AS operative, {hits(C.BOILERPLATE)} AS boilerplate, {n(_RE['furniture'])}::BIGINT AS furniture_lines, {share(n(_RE['furniture']), 'len(ls)')} AS furniture_share FROM fe0),
cl AS (SELECT *, CASE WHEN n_words < 20 THEN 'FRAGMENT' WHEN boilerplate >= 1 AND operative = 0 THEN 'BOILERPLATE' WHEN (toc_share >= 0.5 AND mean_line_words <= 12) OR (mean_line_words <= 4.5 AND n_lines >= 8 AND operative <= 1) THEN 'TOC_LIKE'
  WHEN heading_share >= 0.6 THEN 'HEADING_ONLY' ELSE 'PROVISION' END AS class FROM fe)"""


@query("chunk_features", f"WITH {_features_sql()} SELECT doc_id, n_words, n_lines, round(toc_share, 6) AS toc_share, round(heading_share, 6) AS heading_share, round(mean_line_words, 6) AS mean_line_words, operative::BIGINT AS operative, boilerplate::BIGINT AS boilerplate, furniture_lines FROM fe")
def chunk_features(s, d):
    f = C.classified(I.documents(s, d))
    return f.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_words", "n_lines", "operative", "boilerplate", "furniture_lines")], *[F.round(c, 6).alias(c) for c in ("toc_share", "heading_share", "mean_line_words")])


@query("chunk_class", f"WITH {_features_sql()} SELECT doc_id, class FROM cl")
def chunk_class(s, d):
    return C.classified(I.documents(s, d)).select("doc_id", "class")


@query("corpus_composition", f"WITH {_features_sql()} SELECT source, class, count(*) AS n, round(avg(furniture_share), 6) AS furniture FROM cl GROUP BY ROLLUP (source, class)")
def corpus_composition(s, d):
    return C.composition(C.classified(I.documents(s, d, "source"), ("doc_id", "source")))


@query("answerable_fraction", f"WITH {_features_sql()} SELECT source, round(avg((class = 'PROVISION')::INT), 6) AS answerable, count(*) AS n FROM cl GROUP BY 1")
def answerable_fraction(s, d):
    return C.classified(I.documents(s, d, "source"), ("doc_id", "source")).groupBy("source").agg(F.round(F.avg((F.col("class") == "PROVISION").cast("int")), 6).alias("answerable"), F.count(F.lit(1)).alias("n"))


@query("corpus_statistics", f"WITH {_windows_sql(512, 100)} SELECT count(DISTINCT doc_id) AS n_documents, count(*) AS n_chunks, coalesce(round(avg(len(ws)), 2), 0) AS avg_length, coalesce(max(len(ws)), 0)::BIGINT AS max_length, coalesce(min(len(ws)), 0)::BIGINT AS min_length FROM win")
def corpus_statistics(s, d):
    return C.corpus_statistics(C.windows(I.documents(s, d)).withColumn("n", F.col("n_words").cast("long")), "doc_id", "n")


@query("title_harvest", "WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) SELECT DISTINCT trim(regexp_extract(line, '^([A-Z][^ \\t\\r]*(?: [^ \\t\\r]+){0,7})', 1)) AS title FROM l WHERE length(trim(regexp_extract(line, '^([A-Z][^ \\t\\r]*(?: [^ \\t\\r]+){0,7})', 1))) > 12")
def title_harvest(s, d):
    return C.titles(I.documents(s, d))


_SLOTS = f"WITH {Q._BM25}, {Q._GOLD}, {_features_sql()}, sl AS (SELECT s.query_id, s.rank, c.class = 'PROVISION' AS answering, g.doc_id IS NOT NULL AS gold FROM sparse s JOIN cl c ON c.doc_id = s.doc_id LEFT JOIN gold g ON g.query_id = s.query_id AND g.doc_id = s.doc_id)"


@query("slot_waste", f"""{_SLOTS}, r AS (SELECT *, sum(answering::INT) OVER (PARTITION BY query_id ORDER BY rank) AS clean_rank FROM sl)
SELECT query_id, round(count(*) FILTER (rank <= 6 AND NOT answering) / nullif(count(*) FILTER (rank <= 6), 0)::DOUBLE, 6) AS waste_rate, min(CASE WHEN answering THEN rank END) AS first_answering_rank, count(*) FILTER (gold AND answering AND clean_rank <= 6 AND rank > 6) AS gold_displaced FROM r GROUP BY 1""")
def slot_waste(s, d):
    ranks = Q._bm25(s, d).join(C.classified(I.documents(s, d)).select("doc_id", (F.col("class") == "PROVISION").alias("answering")), "doc_id")
    gold = R.shingle_gold(I.documents(s, d), I.questions(s, d)).withColumn("gold", F.lit(True))
    rows = ranks.join(gold, ["query_id", "doc_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))
    return C.slot_metrics(rows).withColumn("first_answering_rank", F.col("first_answering_rank").cast("long"))


#: Reranker window sizes for each number of final chunks.
_GRID = sorted({(n, int(n * r)) for n in (3, 6) for r in (1, 1.25, 1.5, 2, 2.5, 3.5, 5, 6.5)})
_GRID_SQL = "grid(top_n, win) AS (VALUES " + ", ".join(f"({n}, {w})" for n, w in _GRID) + ")"
#: Overlap reranks the BM25 pool; gold are documents with the query's shingles.
_SWEEP = f"""WITH {Q._BM25}, {Q._OVER}, {Q._GOLD}, {_GRID_SQL}, pool AS (SELECT s.query_id, s.doc_id, s.rank, o.score, g.doc_id IS NOT NULL AS gold FROM sparse s JOIN over0 o ON o.query_id = s.query_id AND o.doc_id = s.doc_id LEFT JOIN gold g ON g.query_id = s.query_id AND g.doc_id = s.doc_id),
re AS (SELECT top_n, win, pool.*, row_number() OVER (PARTITION BY top_n, win, query_id ORDER BY round(score, 6) DESC, rank) AS new_rank FROM pool JOIN grid ON rank <= win),
sw AS (SELECT top_n::BIGINT AS top_n, win::BIGINT AS win, count(*) AS pairs, count(*) FILTER (new_rank <= top_n AND rank > top_n) AS rescued, count(*) FILTER (new_rank <= top_n AND gold) AS gold_in, count(*) FILTER (new_rank <= top_n AND rank > top_n AND gold) AS gold_rescued,
  count(*) FILTER (new_rank > top_n AND rank <= top_n AND gold) AS gold_lost, round(avg(CASE WHEN new_rank <= top_n THEN abs(new_rank - rank) END), 6) AS displacement FROM re GROUP BY 1, 2)"""


def _sweep(s, d):
    asked = I.questions(s, d).select("query_id", F.array_distinct(lexical_tokens(F.col("question"))).alias("q"))
    pool = Q._bm25(s, d).join(Q._index(s, d).documents().select("doc_id", "terms"), "doc_id").join(asked, "query_id").withColumn("over", R.word_overlap(F.col("q"), F.col("terms")))
    gold = R.shingle_gold(I.documents(s, d), I.questions(s, d)).withColumn("gold", F.lit(True))
    pool = pool.join(gold, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "rank", "over", F.coalesce("gold", F.lit(False)).alias("gold"))
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("top_n"), F.lit(w).alias("win")) for n, w in _GRID])).alias("g")
    wide = pool.select("*", grid).select("query_id", "doc_id", "rank", "over", "gold", "g.*").where("rank <= win")
    w = Window.partitionBy("top_n", "win", "query_id").orderBy(F.round("over", 6).desc(), "rank")
    r = wide.withColumn("new_rank", F.row_number().over(w))
    kept, had = F.col("new_rank") <= F.col("top_n"), F.col("rank") <= F.col("top_n")
    return r.groupBy(F.col("top_n").cast("long").alias("top_n"), F.col("win").cast("long").alias("win")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(kept & ~had).alias("rescued"), F.count_if(kept & F.col("gold")).alias("gold_in"), F.count_if(kept & ~had & F.col("gold")).alias("gold_rescued"),
        F.count_if(~kept & had & F.col("gold")).alias("gold_lost"), F.round(F.avg(F.when(kept, F.abs(F.col("new_rank") - F.col("rank")))), 6).alias("displacement"))


query("window_sweep", f"{_SWEEP} SELECT * FROM sw")(_sweep)


@query("knee_rule", f"""{_SWEEP}, k AS (SELECT top_n, win, (gold_in - lag(gold_in) OVER w) / nullif(pairs - lag(pairs) OVER w, 0)::DOUBLE AS slope FROM sw WINDOW w AS (PARTITION BY top_n ORDER BY win)) SELECT top_n, min(win) FILTER (slope < 0.005) AS knee FROM k GROUP BY 1""")
def knee_rule(s, d):
    """The first window at which more cost finds hardly more gold."""
    w = Window.partitionBy("top_n").orderBy("win")
    slope = (F.col("gold_in") - F.lag("gold_in").over(w)) / F.nullif(F.col("pairs") - F.lag("pairs").over(w), F.lit(0))
    return _sweep(s, d).withColumn("slope", slope).groupBy("top_n").agg(F.min(F.when(F.col("slope") < 0.005, F.col("win"))).alias("knee"))


@query("gold_depth", f"WITH {Q._BM25}, {Q._GOLD} SELECT CASE WHEN rank IS NULL THEN 'absent' WHEN rank <= 6 THEN '1-6' WHEN rank <= 20 THEN '7-20' ELSE '21-40' END AS depth, count(*) AS n FROM gold g LEFT JOIN sparse s ON s.query_id = g.query_id AND s.doc_id = g.doc_id GROUP BY 1")
def gold_depth(s, d):
    gold = R.shingle_gold(I.documents(s, d), I.questions(s, d)).join(Q._bm25(s, d), ["query_id", "doc_id"], "left")
    r = F.col("rank")
    return gold.groupBy(F.when(r.isNull(), "absent").when(r <= 6, "1-6").when(r <= 20, "7-20").otherwise("21-40").alias("depth")).agg(F.count(F.lit(1)).alias("n"))


@query("contamination_grid", f"""{_SLOTS.replace('rank, c.class', 'rank, s.doc_id, c.class')}, fr AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS fraction), pl AS (SELECT fraction, query_id, rank, gold, NOT ((('0x' || substr(sha256(query_id::VARCHAR || ':' || doc_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < fraction) AS clean FROM sl, fr WHERE rank <= 30)
SELECT fraction, count(*) AS n_slots, round(count(*) FILTER (rank <= 6 AND NOT clean) / nullif(count(*) FILTER (rank <= 6), 0)::DOUBLE, 6) AS waste_rate FROM pl GROUP BY 1""")
def contamination_grid(s, d):
    """A share of the chunks, drawn by hash, stands for non-answering ones."""
    ranks = Q._bm25(s, d, 30)
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("query_id").cast("string"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
    rows = ranks.select("rank", draw.alias("u"), F.explode(F.array(*[F.lit(x) for x in (0.0, 0.1, 0.2, 0.3, 0.5)])).alias("fraction"))
    inside = F.col("rank") <= 6
    return rows.groupBy("fraction").agg(F.count(F.lit(1)).alias("n_slots"), F.round(F.count_if(inside & (F.col("u") < F.col("fraction"))) / F.nullif(F.count_if(inside), F.lit(0)), 6).alias("waste_rate"))
