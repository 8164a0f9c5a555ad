"""Queries over sentences, claims, evidence and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import metrics as M
from plumbline.operators import verification as V
from plumbline.plans import inputs as I

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: White space as \s has it in Java.
_WS, _BLANKS = "[ \\t\\n\\x0B\\f\\r]", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _split_sql(text: str, pattern: str, back: str) -> str:
    """RE2 has no lookbehind, so a separator is put in and split on: chr(1) and s. A text's own chr(1) has an x after it meanwhile."""
    marked = f"regexp_replace(replace({text}, chr(1), chr(1) || 'x'), '{pattern}', {back}, 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1) || 's'), lambda s: trim(replace(s, chr(1) || 'x', chr(1)), {_BLANKS})), lambda s: s <> '')"


_SIMPLE = _split_sql("trim({t}, ' ')", f"([.!?]){_WS}+", "'\\1' || chr(1) || 's'")
_CAPITAL = _split_sql("{t}", f"([.!?]){_WS}+([A-Z])", "'\\1' || chr(1) || 's' || '\\2'")
#: lower() of İ is i and a combining dot.
_CONTENT = f"list_filter(regexp_extract_all(lower(replace({{t}}, chr(304), 'i' || chr(775))), '[a-z0-9'']+'), lambda tw: tw NOT IN ({_quoted(T.CLAIM_STOP)}))"


@query("sentence_split", f"SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_CAPITAL.format(t='text')} AS s FROM documents)")
def sentence_split(s, d):
    return I.documents(s, d).select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("sentence_split_simple", f"SELECT doc_id, len(s)::BIGINT AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SIMPLE.format(t='text')} AS s FROM documents)")
def sentence_split_simple(s, d):
    return I.documents(s, d).select("doc_id", T.simple_sentences(F.col("text")).alias("s")).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


_CLEAN = f"trim(regexp_replace(trim(regexp_replace(s, '[*_`#>]|^{_WS}*[-•]{_WS}*|^{_WS}*[0-9]+\\.{_WS}*', ' ', 'g'), ' '), '\\[[^\\]]*\\]', ' ', 'g'), ' ')"
#: RE2's (?i) also takes ſ for s and the Kelvin sign for k, its \s lacks \x0B, and it has no lookahead, which only ends the alternatives here.
_NON_ASSERTIVE = T.NON_ASSERTIVE.replace("'", "''").replace(r"(?![\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)").replace(r"\s", _WS)
_CLAIMS = f"""{I.ANSWERS_SQL}, cl0 AS (SELECT trace_id, conv_id, list_filter(list_transform({_SIMPLE.format(t='answer')}, lambda s: {_CLEAN}), lambda s: len({_CONTENT.format(t='s')}) >= 3 AND NOT regexp_matches(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_NON_ASSERTIVE}')) AS cs FROM answers),
claims AS (SELECT trace_id, conv_id, i AS claim_no, cs[i + 1] AS claim FROM cl0, unnest(range(len(cs)::BIGINT)) t(i))"""


def claims_of(answers, *keys: str):
    rows = answers.select(*keys, F.posexplode(T.claims(F.col("answer"))).alias("claim_no", "claim"))
    return rows.withColumn("claim_no", F.col("claim_no").cast("long"))


def claim_rows(s, d):
    return claims_of(I.answers(s, d), "trace_id", "conv_id")


@query("extract_claims", f"WITH {_CLAIMS} SELECT trace_id, claim_no, claim FROM claims")
def extract_claims(s, d):
    return claim_rows(s, d).select("trace_id", "claim_no", "claim")


@query("claim_dedupe", f"WITH {_CLAIMS} SELECT conv_id, min_by(claim, trace_id * 1000 + claim_no) AS claim, sha256(lower(trim(min_by(claim, trace_id * 1000 + claim_no)))) AS claim_hash FROM claims GROUP BY conv_id, lower(trim(claim))")
def claim_dedupe(s, d):
    rows = claim_rows(s, d).withColumn("o", F.col("trace_id") * 1000 + F.col("claim_no"))
    return V.distinct_claims(rows, "conv_id", "claim", "o").select("conv_id", "claim", T.text_hash(F.col("claim")).alias("claim_hash"))


@query("text_hash_dedupe", "SELECT sha256(lower(trim(text))) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def text_hash_dedupe(s, d):
    return I.documents(s, d).groupBy(T.text_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


_SUPPORT = f"coalesce(len(list_filter(list_distinct({_CONTENT.format(t='{c}')}), lambda cw: list_contains({{w}}, cw))) / nullif(len(list_distinct({_CONTENT.format(t='{c}')})), 0)::DOUBLE, 0)"


@query("lexical_support", f"""WITH {_CLAIMS}, ctx AS (SELECT doc_id, {_CONTENT.format(t='text')} AS w FROM documents)
SELECT trace_id, claim_no, round(x, 6) AS support, x >= 0.55 AS supported FROM (SELECT trace_id, claim_no, {_SUPPORT.format(c='claim', w='w')} AS x FROM claims JOIN ctx ON doc_id = conv_id)""")
def lexical_support(s, d):
    rows = claim_rows(s, d).join(I.documents(s, d), F.col("conv_id") == F.col("doc_id")).select("trace_id", "claim_no", V.lexical_support(F.col("claim"), F.col("text")).alias("x"))
    return rows.select("trace_id", "claim_no", F.round("x", 6).alias("support"), (F.col("x") >= V.LEXICAL_SUPPORT).alias("supported"))


@query("groundedness", f"""WITH {I.ANSWERS_SQL}, f AS (SELECT trace_id, c, unnest(fr) AS s, len(fr) AS n FROM (SELECT trace_id, lower(text) AS c, list_filter(list_transform(string_split_regex(lower(answer), '[.!?\\n]+'), lambda s: trim(s, e' \\t\\n\\r')), lambda s: length(s) > 15) AS fr FROM answers JOIN documents ON doc_id = conv_id)),
g AS (SELECT trace_id, n, c, list_filter(list_filter(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 4), lambda w: w NOT IN ({_quoted(T.GROUNDED_STOP)})) AS w FROM f)
SELECT a.trace_id, r.groundedness FROM answers a JOIN documents ON doc_id = conv_id LEFT JOIN (SELECT trace_id, round(count(*) FILTER (len(w) > 0 AND len(list_filter(w, lambda x: contains(c, x))) / greatest(len(w), 1)::DOUBLE >= 0.45) / max(n)::DOUBLE, 4) AS groundedness FROM g GROUP BY 1) r USING (trace_id)""")
def groundedness(s, d):
    rows = I.answers(s, d).join(I.documents(s, d), F.col("conv_id") == F.col("doc_id"))
    return rows.select("trace_id", V.groundedness(F.col("answer"), F.col("text")).alias("groundedness"))


#: RE2's \\b knows ASCII letters only and would find the word no in noñ.
_NEG = r"(?:^|[^\p{L}\p{N}_])(?:not|no|never|none|cannot)(?:[^\p{L}\p{N}_]|$)"
_EVIDENCE = f"""{_CLAIMS}, sents AS (SELECT doc_id, i AS sentence_no, ss[i + 1] AS sentence FROM (SELECT doc_id, {_SIMPLE.format(t='text')} AS ss FROM documents WHERE doc_id IN (SELECT conv_id FROM claims)), unnest(range(len(ss)::BIGINT)) t(i)),
sw AS (SELECT *, {_CONTENT.format(t='sentence')} AS w FROM sents),
ev0 AS (SELECT trace_id, claim_no, sentence_no, sentence, {_SUPPORT.format(c='claim', w='w')} AS sup, regexp_matches(lower(claim), '{_NEG}') <> regexp_matches(lower(sentence), '{_NEG}') AS differs FROM claims JOIN sw ON doc_id = conv_id),
ev AS (SELECT *, CASE WHEN differs THEN 0.0::DOUBLE ELSE sup END AS ent, CASE WHEN differs THEN sup ELSE 0.0::DOUBLE END AS contra, greatest(0.0::DOUBLE, 1 - sup) AS neutral FROM ev0),
top3 AS (SELECT *, row_number() OVER (PARTITION BY trace_id, claim_no ORDER BY round(ent, 6) DESC, sentence_no) AS evidence_rank FROM ev QUALIFY evidence_rank <= 3)"""
_STATUS = "CASE WHEN ent IS NULL THEN 'UNSUPPORTED' WHEN contra >= 0.7 THEN 'CONTRADICTED' WHEN ent >= 0.7 THEN 'SUPPORTED' WHEN ent >= 0.4 THEN 'PARTIALLY_SUPPORTED' WHEN neutral >= 0.8 THEN 'UNSUPPORTED' ELSE 'NOT_VERIFIABLE' END"


def evidence(s, d):
    """Sentences of a trace's document against each of its claims."""
    claims = claim_rows(s, d).select("trace_id", "claim_no", F.col("conv_id").alias("doc_id"), V.described(F.col("claim")).alias("c"))
    asked = I.documents(s, d).join(claims.select("doc_id"), "doc_id", "left_semi")
    docs = asked.select("doc_id", F.posexplode(T.simple_sentences(F.col("text"))).alias("sentence_no", "sentence")).withColumn("s", V.described(F.col("sentence")))
    rows = claims.join(docs, "doc_id")
    scored = rows.select("trace_id", "claim_no", F.lit(1).alias("chunk_rank"), F.col("sentence_no").cast("long").alias("sentence_no"), "sentence", V.described_scores(F.col("c"), F.col("s")).alias("x"))
    return scored.select("trace_id", "claim_no", "chunk_rank", "sentence_no", "sentence", "x.*")


_KEY = ["trace_id", "claim_no"]


@query("evidence_top3", f"WITH {_EVIDENCE} SELECT trace_id, claim_no, evidence_rank, sentence_no, round(ent, 6) AS ent, round(contra, 6) AS contra FROM top3")
def evidence_top3(s, d):
    return V.top_evidence(evidence(s, d), _KEY).select("trace_id", "claim_no", F.col("evidence_rank").cast("long").alias("evidence_rank"), "sentence_no", F.round("ent", 6).alias("ent"), F.round("contra", 6).alias("contra"))


@query("claim_status", f"WITH {_EVIDENCE}, t AS (SELECT c.trace_id, c.claim_no, ent, contra, neutral FROM claims c LEFT JOIN top3 e ON e.trace_id = c.trace_id AND e.claim_no = c.claim_no AND evidence_rank = 1) SELECT trace_id, claim_no, {_STATUS} AS status, round(coalesce(greatest(ent, contra), 0), 6) AS confidence FROM t")
def claim_status(s, d):
    best = V.pooled(V.top_evidence(evidence(s, d), _KEY), _KEY)
    rows = claim_rows(s, d).select(*_KEY).join(best, _KEY, "left")
    return rows.select(*_KEY, V.status(F.col("ent"), F.col("contra"), F.col("neutral")).alias("status"), F.round(V.confidence(F.col("ent"), F.col("contra")), 6).alias("confidence"))


@query("aggregation_strategies", f"""WITH {_EVIDENCE}, a AS (SELECT 'top1' AS strategy, trace_id, claim_no, ent, contra, neutral FROM top3 WHERE evidence_rank = 1
UNION ALL SELECT 'max_pool_top3', trace_id, claim_no, ent, contra, neutral FROM top3 QUALIFY row_number() OVER (PARTITION BY trace_id, claim_no ORDER BY greatest(ent, contra) DESC, evidence_rank) = 1
UNION ALL SELECT 'independent', trace_id, claim_no, max(ent), max(contra), max(neutral) FROM top3 GROUP BY 2, 3)
SELECT strategy, {_STATUS} AS status, count(*) AS n FROM a GROUP BY 1, 2""")
def aggregation_strategies(s, d):
    """Statuses under the strategies, all from one scoring."""
    top = V.top_evidence(evidence(s, d), _KEY)
    parts = [V.pooled(top, _KEY, n).withColumn("strategy", F.lit(n)) for n in ("top1", "max_pool_top3")] + [V.independent_maxima(top, _KEY).withColumn("strategy", F.lit("independent"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("strategy", V.status(F.col("ent"), F.col("contra"), F.col("neutral")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("concat_strategy", f"""WITH {_EVIDENCE}, j AS (SELECT trace_id, claim_no, string_agg(sentence, ' ' ORDER BY evidence_rank) AS sentence FROM top3 GROUP BY 1, 2), w AS (SELECT j.*, claim, {_CONTENT.format(t='sentence')} AS w FROM j JOIN claims USING (trace_id, claim_no))
SELECT trace_id, claim_no, round({_SUPPORT.format(c='claim', w='w')}, 6) AS support FROM w""")
def concat_strategy(s, d):
    joined = V.pooled(V.top_evidence(evidence(s, d), _KEY), _KEY, "concat_top3").join(claim_rows(s, d).select(*_KEY, "claim"), _KEY)
    return joined.select(*_KEY, F.round(V.lexical_support(F.col("claim"), F.col("sentence")), 6).alias("support"))


_SUMMARY = f"""WITH {I.TRACES_SQL}, sm AS (SELECT trace_id, count(*) AS total, count(*) FILTER (status = 'SUPPORTED') AS supported, count(*) FILTER (status = 'PARTIALLY_SUPPORTED') AS partial, count(*) FILTER (status = 'UNSUPPORTED') AS unsupported,
  count(*) FILTER (status = 'CONTRADICTED') AS contradicted, count(*) FILTER (status = 'NOT_VERIFIABLE') AS not_verifiable, round(avg(ent), 6) AS mean_entailment FROM verified GROUP BY 1)"""


@query("verification_summary", f"{_SUMMARY} SELECT * FROM sm")
def verification_summary(s, d):
    return V.summary(I.claim_scores(s, d))


@query("generation_metrics", f"""{_SUMMARY} SELECT trace_id, round(supported / total::DOUBLE, 4) AS faithfulness, round((supported + 0.5 * partial) / total::DOUBLE, 4) AS weighted_faithfulness, round((unsupported + contradicted) / total::DOUBLE, 4) AS hallucination_rate,
  round(contradicted / total::DOUBLE, 4) AS contradiction_rate, round(unsupported / total::DOUBLE, 4) AS unsupported_rate FROM sm""")
def generation_metrics(s, d):
    return M.generation_rates(V.summary(I.claim_scores(s, d))).select("trace_id", "faithfulness", "weighted_faithfulness", "hallucination_rate", "contradiction_rate", "unsupported_rate")


_FAITH = f"""WITH {_CLAIMS}, ctx AS (SELECT doc_id, {_CONTENT.format(t='text')} AS w FROM documents), k AS (SELECT trace_id, count(*) AS n, count(*) FILTER ({_SUPPORT.format(c='claim', w='w')} >= 0.1) AS sup FROM claims JOIN ctx ON doc_id = conv_id GROUP BY 1)
SELECT a.trace_id, coalesce(n, 0) AS n_claims, coalesce(sup, 0) AS n_supported, CASE WHEN n IS NULL THEN 1.0 ELSE round(sup / n::DOUBLE, 6) END::DOUBLE AS conventional, round(sup / n::DOUBLE, 6) AS undefined_on_empty FROM answers a LEFT JOIN k USING (trace_id)"""


@query("faithfulness_conventions", _FAITH)
def faithfulness_conventions(s, d):
    """An answer without claims scores 1 by convention, and nothing by the honest reading."""
    rows = claim_rows(s, d).join(I.documents(s, d), F.col("conv_id") == F.col("doc_id")).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(V.lexical_support(F.col("claim"), F.col("text")) >= 0.1).alias("k"))
    rate = F.round(F.col("k") / F.col("n"), 6)
    return I.answers(s, d).select("trace_id").join(rows, "trace_id", "left").select("trace_id", F.coalesce("n", F.lit(0)).alias("n_claims"), F.coalesce("k", F.lit(0)).alias("n_supported"), F.when(F.col("n").isNull(), 1.0).otherwise(rate).alias("conventional"), rate.alias("undefined_on_empty"))


@query("answer_similarity", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def answer_similarity(s, d):
    from plumbline.operators.retrieval import cosine

    v = I.table(s, d, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("context_recall", f"WITH {_EVIDENCE} SELECT trace_id, round(avg((m >= 0.5)::INT), 4) AS context_recall FROM (SELECT trace_id, claim_no, max(ent) AS m FROM ev GROUP BY 1, 2) GROUP BY 1")
def context_recall(s, d):
    best = evidence(s, d).groupBy(*_KEY).agg(F.max("ent").alias("m"))
    return best.groupBy("trace_id").agg(F.round(F.avg((F.col("m") >= V.METRIC_ENTAIL).cast("int")), 4).alias("context_recall"))


@query("answer_correctness", f"{_SUMMARY} SELECT trace_id, round(0.75 * f + 0.25 * sim, 4) AS answer_correctness FROM (SELECT trace_id, mean_entailment AS sim, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f FROM (SELECT trace_id, mean_entailment, round(supported / total::DOUBLE, 4) AS p, round((supported + partial) / total::DOUBLE, 4) AS r FROM sm))")
def answer_correctness(s, d):
    rows = V.summary(I.claim_scores(s, d))
    p, r = F.round(F.col("supported") / F.col("total"), 4), F.round((F.col("supported") + F.col("partial")) / F.col("total"), 4)
    return rows.select("trace_id", M.answer_correctness(M.f1(p, r), F.col("mean_entailment")).alias("answer_correctness"))


@query("citation_checks", f"WITH {I.ANSWERS_SQL} SELECT trace_id, list_contains(regexp_extract_all(answer, '(?i)\\[(?:Chunk-ID:\\s*|Chunk:\\s*)([a-f0-9\\-]+)\\]', 1), '') AS odd, len(regexp_extract_all(answer, '(?i)\\[(?:Chunk-ID:\\s*|Chunk:\\s*)([a-f0-9\\-]+)\\]', 1))::BIGINT AS n_cited FROM answers")
def citation_checks(s, d):
    c = T.chunk_citations(F.col("answer"))
    return I.answers(s, d).select("trace_id", F.array_contains(c, "").alias("odd"), F.size(c).cast("long").alias("n_cited"))


