"""Claims, legal parsing, graphs, reports, sessions and experiments."""

import pytest
from pyspark.sql import functions as F

from plumbline import api, report
from plumbline.experiments import Experiment, FaultRecovery, PlanError, Suite
from plumbline.functions.text import recovered_json
from plumbline.operators import claims as K
from plumbline.operators import graph as G
from plumbline.operators import legal as L
from plumbline.operators import strategies as St
from plumbline.plans import diagnosis as PD
from plumbline.plans import inputs as I


def test_located_claims(spark):
    answers = spark.createDataFrame([(1, "The red fox jumps over it. The dog sleeps all day long.")], "trace_id int, answer string")
    rows = [(1, 0, " The red fox jumps over it. "), (1, 1, "the red fox jumps over it."), (1, 2, "The dog slept all day long."), (1, 3, "Quantum zebra marmalade 0123456789"), (1, 4, "  ")]
    got = {r.claim_no: r for r in K.located(spark.createDataFrame(rows, "trace_id int, claim_no int, claim string"), answers).collect()}
    assert set(got) == {0, 2, 3}
    assert (got[0].claim_id, got[0].character_start, got[0].match_type) == ("1_C001", 0, "exact")
    assert got[2].match_type == "fuzzy" and got[2].character_start == 27 and got[3].sentence_id == "S_unresolved_3"
    stats = K.claim_statistics(spark.createDataFrame(list(got.values()))).first()
    assert (stats.total_claims, stats.total_sentences, stats.claims_per_sentence) == (3, 2, 1.5)


@pytest.mark.parametrize("text,n", [('[{"k": 1}, {"k": 2}]', 2), ('```json\n[{"k": 1}]\n```', 1), ('So: [{"k": 1}] there', 1), ('[{"k": 1}, {"k"', 1), ('so [{"k": 1}, {"k": 2', 2), ('```\n[{"k": 1}, {"k": 2}', 2)])
def test_recovered_json(spark, text, n):
    assert spark.range(1).select(F.size(recovered_json(F.lit(text), "array<struct<k:int>>")).alias("n")).first().n == n


@pytest.mark.parametrize("text,want", [
    ('[{"a": [1, {"b": "}"', [("[1,{\"b\":\"}\"}]",)]), ('x [{"a": ["[{", "]"], "c": {"d": [2', [('["[{","]"]',)]), ('[{"a": "q\\"}]"}, {"a": "z}", "b": [', [('q"}]',), ("z}",)]), ('[{"a": "one"}, {"a": "two}"}, {"a": "thr', [("one",), ("two}",)]),
    ('[\n  {"a": "First.", "s": "S1"},\n  {"a": "Second.", "s": "S2"},\n  {"a": "Third, inc', [("First.",), ("Second.",)]), ("This is not JSON.", None), ("", None), ("[", None), ('[{"a": "x"}]]', [("x",)]),
])
def test_json_is_closed_by_nesting(spark, text, want):
    got = spark.range(1).select(recovered_json(F.lit(text), "array<struct<a:string>>").alias("j")).first().j
    assert (None if got is None else [tuple(x) for x in got]) == want


def test_treatments_and_knowledge_graph(spark):
    lines = spark.createDataFrame([("A", "(2013) 5 SCC 762  relied on  para 12\nshort\n(2014) 1 SCC 9 not followed\nno citation here")], "doc_id string, text string")
    assert {(r.key, r.relation) for r in G.treatments(lines).collect()} == {("SCC:2013:5:762", "CASE_FOLLOWS_CASE"), ("SCC:2014:1:9", "CASE_DOES_NOT_FOLLOW_CASE")}
    cases = spark.createDataFrame([("A", "SCC:2020:1:1", "SC"), ("B", "SCC:2013:5:762", None)], "doc_id string, key string, court string")
    cited = spark.createDataFrame([("A", "headnote", "SCC", "SCC:2013:5:762", 0), ("A", "headnote", "ARTICLE", "ARTICLE:32", 1), ("A", "body", "SCC", "SCC:2020:1:1", 2), ("B", "body", "SCC", "SCC:1999:9:9", 3)], "doc_id string, section string, kind string, key string, ordinal int")
    nodes, edges = G.knowledge_graph(cases, cited)
    got = {(r.src, r.dst, r.relation) for r in edges.collect()}
    assert ("CASE:SCC:2020:1:1", "CASE:SCC:2013:5:762", "CASE_CITES_CASE") in got and ("CASE:SCC:2020:1:1", "ARTICLE:32", "CASE_INTERPRETS_SECTION") in got
    assert not any(s == d for s, d, _ in got) and ("CASE:SCC:2013:5:762", "COURT:Unknown Court", "CASE_DECIDED_BY_COURT") in got
    assert {r.id for r in nodes.where("type = 'CASE' and not in_corpus").collect()} == {"CASE:SCC:1999:9:9"}


def test_memory_graph(spark):
    obs = spark.createDataFrame([(1, "s1", "p", "T", '["c"]', '["a/x.py"]', "broken", 10), (2, None, "q", None, "[]", None, '["x.py"]', 20)], "id int, session_id string, project string, title string, concepts string, files_read string, files_modified string, epoch int")
    sessions = spark.createDataFrame([("s1", None)], "session_id string, title string")
    nodes, edges = G.memory_graph(obs, sessions)
    assert {(r.source, r.target, r.kind) for r in edges.collect()} == {("session::s1", "obs::1", "contains"), ("obs::1", "concept::c", "tagged"), ("obs::1", "file::x.py", "read"), ("obs::2", "file::x.py", "modified")}
    assert nodes.count() == 5 and nodes.where("id = 'obs::2'").first().label == "#2"
    assert G.memory_graph(obs, sessions, project="q")[0].count() == 2


def test_old_layout_and_legal_chunks(spark):
    text = "A v. B\n[X and Y, JJ.]\nThis headnote is long enough to be kept whole. HELD: The appeal is allowed.\nCase Law Reference\n(2013) 5 SCC 762 relied on\nCIVIL APPELLATE JURISDICTION: Appeal 5\nJ U D G M E N T\n1. One."
    s = spark.range(1).select(L.old_layout(F.lit(text)).alias("s")).first().s
    assert set(s) == {"caption", "headnote", "held", "case_law_cited", "case_arising_from", "judgment"} and s["held"].startswith("HELD:") and s["case_law_cited"] == "(2013) 5 SCC 762 relied on"
    assert spark.range(1).select(L.old_layout(F.lit("short")).alias("s")).first().s == {"body": "short"}
    j = spark.createDataFrame([(1, {"headnote": "h" * 50, "keywords": "k" * 50, "held": "x"}, [(1, "a" * 1500), (2, "b" * 1500), (3, "c")])], "doc_id int, sections map<string,string>, paragraphs array<struct<number:int,text:string>>")
    got = [(r.section, r.first_number) for r in L.legal_chunks(j).orderBy("section", "first_number").collect()]
    assert got == [("headnote", None), ("judgment", 1), ("judgment", 2)]


def test_view_keeps_linked_nodes(spark):
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(100)], "id string")
    edges = spark.createDataFrame([("n000", "n001", "x")], "src string, dst string, relation string")
    got = G.view(nodes, edges, 12).collect()
    assert {"n000", "n001"} <= {r.id for r in got} and len(got) <= 13 and got[0].truncated


def test_reports(spark, data):
    d = api.Diagnoses(I.traces(spark, data), I.refs(spark, data), I.claim_scores(spark, data))
    t = d.facts.first().trace_id
    assert d.report(t).startswith("# Report") and "<h2>Summary</h2>" in d.report(t, "html") and "SUMMARY" in d.report(t, "console")
    with pytest.raises(KeyError):
        d.report(10**9)
    with pytest.raises(ValueError):
        d.report("../x")
    with pytest.raises(ValueError):
        report.rendered({}, "docx")
    paper = d.report(t, "pdf")
    assert paper.startswith(b"%PDF-1.4") and paper.endswith(b"%%EOF\n") and b"(SUMMARY) Tj" in paper
    at = int(paper.split(b"startxref\n")[1].split(b"\n")[0])
    assert paper[at : at + 4] == b"xref" and report.pdf("x\n" * 130).count(b"/Type /Page ") == 3
    assert "| m | 2 | 0.5000 |" in report.of_comparison(spark.createDataFrame([("m", 2, 0.5)], "metric string, n long, mean double"))
    assert "1 of 2 experiments" in report.of_suite([{"key": "a", "status": "complete", "summary": {"r": 1.0}}, {"key": "b", "status": "failed", "error": "no"}])
    assert set(d.artifacts(t)) == {"facts", "matrix", "causes", "actions", "chains"}
    assert PD.facts(spark, data).count() == d.facts.count()


def test_sessions(spark):
    m = spark.createDataFrame([("s", "m1", "q", "a", "2024-01-01"), ("t", "m2", "q", "a", "2024-01-02")], "session_id string, memory_id string, question string, answer string, ts string")
    s = api.Sessions(m)
    assert [r.session_id for r in s.list().collect()] == ["t", "s"] and s.messages("s").count() == 2 and s.deleted("s").list().count() == 1
    assert s.recent(1).first().memory_id == "m2" and s.imported(m, "new").list().count() == 3
    assert api.health(spark)["status"] == "ok" and "I_full" in api.config()["arms"] and api.version()["version"]


class _Broken(Experiment):
    key, number = "broken", 2

    def plan(self, spark):
        return spark.createDataFrame([("a",), ("a",)], "example_id string")

    def run_examples(self, pending):
        return pending

    def summarize(self, records):
        return {}


def test_experiments_resume_and_refuse(spark, tmp_path):
    folder = f"file://{tmp_path}"
    first = FaultRecovery().run(spark, folder)
    assert first["accuracy_by_faults"]["0"] == first["accuracy_by_faults"]["1"] == 1.0
    kept = spark.read.parquet(f"{folder}/fault_recovery/records")
    half = kept.where(F.xxhash64("example_id") % 2 == 0).collect()
    spark.createDataFrame(half, kept.schema).write.mode("overwrite").parquet(f"{folder}/fault_recovery/records")
    assert FaultRecovery().run(spark, folder) == first
    with pytest.raises(PlanError):
        FaultRecovery().run(spark, folder, seed=1)
    out = Suite([FaultRecovery(), _Broken()]).run(spark, folder, small=True)
    assert [x["status"] for x in out] == ["complete", "failed"]
    assert Suite([FaultRecovery()]).status(spark, folder)[0]["state"]["status"] == "complete"


def test_run_arm(spark):
    r = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "query_id int, doc_id string, rank int")
    edges = spark.createDataFrame([("a", "z", "CITES")], "src string, dst string, relation string")
    chunks = spark.createDataFrame([("z", "z0")], "id string, chunk_id string")
    got = St.run_arm("F_graphrag", {"rerank_hybrid": r("ab")}, edges, chunks).orderBy("rank").collect()
    assert [(x.doc_id, x.rank) for x in got] == [("a", 1), ("b", 2), ("z", 3)]
    got = St.run_arm("I_full", {"ircot": r("ab")}, edges, chunks, r("bcd")).orderBy("rank").collect()
    assert [x.doc_id for x in got] == ["a", "b", "z", "c", "d"]
    assert St.ranking_name(St.ARMS["C_fixed_chunking"]) == "fixed_rerank_hybrid" and len(St.ARMS) == 11
    bm25 = lambda qs: qs.select("query_id", F.lit("c").alias("doc_id"), F.lit(1).alias("rank"))
    adverse = edges.withColumn("relation", F.lit("CASE_DOUBTS_CASE"))
    found = St.contradictions(spark.createDataFrame([(1, "q")], "query_id int, question string"), bm25, r("ab"), adverse, chunks).orderBy("rank").collect()
    assert [x.doc_id for x in found] == ["c", "z"]
    ctx = St.planner_context(spark.createDataFrame([(1, i + 1, "x" * 1000) for i in range(9)], "query_id int, rank int, text string")).first()
    assert len(ctx.context) == 6 * 400 + 5 and ctx.n_left_out == 3
