"""Hand-computed values and invariants of the operators."""

import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import statistics as S
from plumbline.functions import text as T
from plumbline.operators import chunking as C
from plumbline.operators import diagnosis as D
from plumbline.operators import faults as X
from plumbline.operators import graph as G
from plumbline.operators import legal as L
from plumbline.operators import memory as Y
from plumbline.operators import metrics as M
from plumbline.operators import retrieval as R
from plumbline.operators import strategies as St
from plumbline.operators import verification as V


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_ranking_metrics(spark):
    ranking = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate("abcdef")] + [("e", "a", 1)], "query_id string, doc_id string, rank int")
    gold = spark.createDataFrame([("q", "c"), ("q", "z")], "query_id string, doc_id string")
    rows = {r.query_id: r for r in M.retrieval_panel(M.gold_ranks(ranking, gold, spark.createDataFrame([("q",), ("e",)], "query_id string"))).collect()}
    assert (rows["q"].recall_at_5, rows["q"].mrr, rows["q"].hit_at_10, rows["q"].all_gold_found) == (0.5, 0.3333, 1.0, False)
    assert rows["e"].recall_at_5 is None and rows["e"].mrr is None and rows["e"].ndcg_at_10 is None


def test_bm25_prefers_the_document_with_the_terms(spark):
    docs = spark.createDataFrame([(1, "Alpha bravo charlie."), (2, "Delta echo foxtrot."), (3, "Golf hotel india.")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "alpha bravo")], "query_id long, question string")
    got = R.bm25_ranking(docs, q).collect()
    assert [r.doc_id for r in got] == [1]
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert got[0].score == pytest.approx(2 * idf)


def test_fusion(spark):
    arm = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id string, rank int")
    got = {r.doc_id: r.rrf_score for r in R.rrf(arm([(1, "a", 1), (1, "b", 2)]), arm([(1, "b", 1)])).collect()}
    assert got["a"] == pytest.approx(1 / 61) and got["b"] == pytest.approx(1 / 62 + 1 / 61)
    with pytest.raises(ValueError):
        R.candidates("other", None, None)


def test_average_precision(spark):
    rows = [("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, False), ("c", 1, None), ("c", 2, True)]
    got = {r.query_id: r.context_precision for r in M.average_precision(spark.createDataFrame(rows, "query_id string, rank int, relevant boolean")).collect()}
    assert got == {"a": 0.8333, "b": 0.0, "c": None}


def test_agreement(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "a boolean, b boolean")
    assert S.kappa(df, "a", "b").first().kappa == 0.5
    same = spark.createDataFrame([("x", "x")] * 3, "a string, b string")
    assert S.kappa(same, "a", "b").first().kappa == 1.0
    nums = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.0, 1.0), (3.0, float("nan"), 1.0), (4.0, 8.0, 1.0)], "x double, y double, z double")
    assert S.pearson(nums, "x", "y").first().r == 1.0
    assert S.pearson(nums, "x", "z").first().r is None
    assert S.spearman(nums, "x", "y").first().rho == 1.0
    assert S.pearson(nums.limit(0), "x", "y").first().r is None


def test_wilson(spark):
    lo, hi = S.wilson(F.lit(5), F.lit(10))
    r = one(spark, lo=lo, hi=hi)
    assert (r.lo, r.hi) == (pytest.approx(0.23659, abs=1e-5), pytest.approx(0.76341, abs=1e-5))
    lo, hi = S.wilson(F.lit(0), F.lit(0))
    assert one(spark, lo=lo).lo is None


@pytest.mark.parametrize("scores,expected", [((0.9, 0.05, 0.05), "SUPPORTED"), ((0.9, 0.7, 0.0), "CONTRADICTED"), ((0.5, 0.1, 0.4), "PARTIALLY_SUPPORTED"), ((0.1, 0.05, 0.85), "UNSUPPORTED"), ((0.3, 0.3, 0.4), "NOT_VERIFIABLE"), ((None, None, None), "UNSUPPORTED")])
def test_status_rule(spark, scores, expected):
    assert one(spark, s=V.status(*[F.lit(x).cast("double") for x in scores])).s == expected


def _facts(spark, statuses, distance=0.3, score=0.8, refs=None):
    traces = spark.createDataFrame([(1, distance, 20, {"bm25_enabled": "false", "temperature": "0.2"})], "trace_id long, min_distance double, pool_size int, config map<string,string>")
    refs = spark.createDataFrame(refs or [(1, "c1", "p", 0, score)], "trace_id long, chunk_id string, parent_id string, chunk_index int, similarity double")
    ver = spark.createDataFrame([(1, i, s, "c1", 0.5) for i, s in enumerate(statuses)], "trace_id long, claim_id int, status string, best_chunk_id string, ent double")
    return D.trace_facts(traces, refs, ver)


@pytest.mark.parametrize("statuses,args,cause", [
    (["SUPPORTED"], {}, "UNKNOWN"), (["UNSUPPORTED"], {"score": 0.2}, "RETRIEVAL_MISS"), (["UNSUPPORTED", "SUPPORTED"], {}, "UNSUPPORTED_GENERATION"),
    (["CONTRADICTED"], {}, "GROUNDING_FAILURE"), (["SUPPORTED"], {"distance": 0.9}, "MISSING_CORPUS"), ([], {"distance": None}, "UNKNOWN"),
    (["PARTIALLY_SUPPORTED"], {"refs": [(1, "c1", "p", 3, 0.8), (1, "c2", "p", 4, 0.8)]}, "CHUNK_BOUNDARY"),
    (["PARTIALLY_SUPPORTED"], {"refs": [(1, "c1", "p", 3, 0.8), (1, "c2", "p", 5, 0.8)]}, "UNKNOWN")])
def test_stage_rules(spark, statuses, args, cause):
    matrix = D.stage_matrix(_facts(spark, statuses, **args))
    assert D.root_causes(matrix).first().primary_cause == cause
    stages = {r.stage for r in matrix.collect()}
    assert ("CHUNKING" in stages) == (cause == "CHUNK_BOUNDARY")


def test_actions_skip_what_is_deployed(spark):
    facts = _facts(spark, ["UNSUPPORTED"], score=0.42)
    causes = D.root_causes(D.stage_matrix(facts))
    titles = [r.title for r in D.corrective_actions(causes, facts).orderBy("action_order").collect()]
    assert titles == ["Increase Retrieval Top-K", "Implement Hybrid Search (Dense + Sparse)", "Deploy Cross-Encoder Reranker"]
    on = facts.withColumn("config", F.create_map(F.lit("bm25_enabled"), F.lit("true")))
    got = D.corrective_actions(causes, on).orderBy("action_order").collect()
    assert [r.action_order for r in got] == [1, 3] and "0.420" in got[0].evidence


def test_single_faults_are_recovered_and_controls_are_clean(spark):
    traces, refs, verified = X.injected(X.cases(spark.range(102).withColumnRenamed("id", "case_id"), (0, 1)))
    causes = D.root_causes(D.stage_matrix(D.trace_facts(traces, refs, verified))).join(traces, "trace_id")
    assert causes.where("primary_cause <> expected_cause").count() == 0


def test_health(spark):
    parts = {"grounding": F.lit(0.8), "context_precision": F.lit(None).cast("double"), "answer_relevancy": F.lit(0.5), "context_recall": F.lit(None).cast("double")}
    assert one(spark, h=D.weighted_health(parts)).h == round((0.5 * 0.8 + 0.2 * 0.5) / 0.7, 4)
    assert one(spark, h=D.weighted_health({k: F.lit(None).cast("double") for k in parts})).h == 0.0


def test_text(spark):
    r = one(spark, a=T.sentences(F.lit("One two. Three? four! Five")), b=T.is_refusal(F.lit("I don't know that")), c=T.claims(F.lit("However, this is so. The red fox jumps high [Chunk-ID: ab]. Ok.")),
            d=T.year_range(F.lit("2020-2022,2026,2021")), e=T.chunk_citations(F.lit("x [Chunk-ID: AB1] y [Chunk: ab1]")), f=T.accepted_rewrite(F.lit("why?"), F.lit(" ")), g=T.yes_no(F.lit("Yes. ")),
            h=T.verdict(F.lit("STATUS: supported\nREASON: it says so")), i=T.answer_parts(F.lit("<thinking>hm</thinking><answer>yes</answer>")), j=T.first_year(F.lit("in 1987 and 2020")))
    assert r.a == ["One two.", "Three? four!", "Five"] and r.b and r.c == ["The red fox jumps high  ."] and r.d == [2020, 2021, 2022, 2026] and r.e == ["ab1"] and r.f == "why?" and r.g is True
    assert (r.h.status, r.h.reason) == ("SUPPORTED", "it says so") and (r.i.thinking, r.i.answer) == ("hm", "yes") and r.j == 1987


def test_nulls_in_text_functions(spark):
    n = F.lit(None).cast("string")
    r = one(spark, a=T.lexical_tokens(n), b=T.is_refusal(n), c=T.chunk_citations(n), d=V.lexical_support(n, n))
    assert (r.a, r.b, r.c, r.d) == ([], False, [], 0.0)


def test_chunks(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(1000)))), (2, ""), (3, None)], "doc_id int, text string")
    got = C.windows(docs).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.start, r.n_words) for r in got] == [(1, 0, 512), (1, 412, 512), (1, 824, 176)]
    with pytest.raises(ValueError):
        C.chunks(docs, "other")
    parts = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate([900, 900, 900, 2500, 10])], "doc_id int, n int, t string")
    assert [r.n_parts for r in C.packed(parts, ["doc_id"], "n", "t", 2000).orderBy("chunk_index").collect()] == [2, 1, 1, 1]


def test_citations_and_paragraphs(spark):
    text = "As in (2013) 5 SCC 762 and [2020] 3 S.C.R. 15, also 2021 INSC 44, AIR 1973 SC 1461, (2013) 5 SCC 762 and Article 32."
    r = one(spark, c=F.transform(L.citations(F.lit(text)), lambda x: x["key"]), p=L.paragraphs(F.lit("1. One here\nmore\n2. Two")), s=L.sections(F.lit("Title\nHeadnotes\nabc\nCase Law Citied\nxyz\nHeadnotes\ndef")))
    assert r.c == ["SCR:2020:3:15", "INSC:2021:44", "SCC:2013:5:762", "AIR:1973:1461", "ARTICLE:32"]
    assert [(p.number, p.text) for p in r.p] == [(1, "1. One here\nmore"), (2, "2. Two")]
    assert r.s == {"caption": "Title", "headnote": "abc\ndef", "case_law_cited": "xyz"}


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "CITES", 0), ("a", "b", "CITES", 1), ("b", "c", "CITES", 2), ("c", "a", "CITES", 3)], "src string, dst string, relation string, ordinal int")
    new = G.relabelled(edges, spark.createDataFrame([("a", "b", "OVERRULES")], "src string, dst string, relation string"))
    assert sorted(r.relation for r in new.where("src = 'a'").collect()) == ["CITES", "OVERRULES"]
    reach = {(r.id, r.hop) for r in G.reach(edges, spark.createDataFrame([("a",)], "seed string")).collect()}
    assert reach == {("a", 0), ("b", 1), ("c", 2)}


def test_citation_rates(spark):
    rows = [(1, "k1", "GROUNDED"), (1, "k2", "GROUNDED"), (1, "k3", "IN_CORPUS_NOT_RETRIEVED"), (1, "k4", "UNVERIFIABLE")]
    r = G.citation_rates(spark.createDataFrame(rows, "answer_id int, key string, status string")).first()
    assert (r.citation_precision, r.citation_correctness, r.fabrication_rate) == (0.5, 0.75, 0.25)


def test_memory_scores(spark):
    t = lambda x: F.lit(x).cast("timestamp")
    r = one(spark, a=Y.recency_score(t("2024-01-01 00:00:00"), t("2024-01-02 00:00:00")), b=Y.recency_score(t("2024-01-03 00:00:00"), t("2024-01-02 00:00:00")), c=Y.recency_score(t(None), t("2024-01-02 00:00:00")), d=Y.frequency_score(F.lit(0), F.lit(5)), e=Y.frequency_score(F.lit(5), F.lit(5)), f=Y.decoded(Y.encoded(F.lit("q"), F.lit("a"))))
    assert r.a == pytest.approx(math.exp(-0.693)) and r.b == 1.0 and r.c == 0.5 and r.d == 0.0 and r.e == 1.0 and (r.f.question, r.f.answer) == ("q", "a")


def _store(spark, tmp_path):
    n = iter(range(1000))

    def keep(df, name):
        path = f"{tmp_path}/{name}-{next(n)}"
        df.write.parquet(path)
        return spark.read.parquet(path)

    return keep


def test_ircot_reasons(spark, tmp_path):
    q = spark.createDataFrame([(1, "start"), (2, "start"), (3, "start")], "query_id int, question string")
    hits = {"start": ["a", "b"], "more": ["c", "a"], "same": ["a"]}
    table = spark.createDataFrame([(k, d, i + 1, 1.0 / (i + 1)) for k, ds in hits.items() for i, d in enumerate(ds)], "question string, doc_id string, rank int, score double")
    retrieve = lambda qs: qs.join(table, "question").select("query_id", "doc_id", "rank", "score")
    script = spark.createDataFrame([(1, 1, "more", False), (1, 2, None, True), (2, 1, "Start", False), (3, 1, "same", False)], "query_id int, i int, follow_up string, enough boolean")
    plan = lambda ev, i: script.where(F.col("i") == i).drop("i")
    evidence, steps = St.ircot(q, retrieve, plan, _store(spark, tmp_path))
    ends = {r.query_id: r.termination for r in steps.where("termination is not null").collect()}
    assert ends == {1: "enough", 2: "repeated_query", 3: "no_new_evidence"}
    assert {r.doc_id for r in evidence.where("query_id = 1").collect()} == {"a", "b", "c"}


def test_agentic_reasons(spark, tmp_path):
    q = spark.createDataFrame([(1, "x"), (2, "x")], "query_id int, question string")
    search = lambda qs: qs.select("query_id", F.concat(F.lit("d_"), "question").alias("doc_id"), F.lit(1.0).alias("score"))
    script = spark.createDataFrame([(1, 1, "lexical_search", "y"), (1, 2, "stop", None), (2, 1, "dance", None)], "query_id int, i int, action string, argument string")
    evidence, steps = St.agentic(q, {"semantic_search": search, "lexical_search": search}, lambda ev, i: script.where(F.col("i") == i).drop("i"), _store(spark, tmp_path))
    ends = {r.query_id: r.termination for r in steps.where("termination is not null").collect()}
    assert ends == {1: "stop", 2: "invalid_action"} and evidence.where("query_id = 1").count() == 2
