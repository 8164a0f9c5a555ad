"""Judgments as they are printed: citations, sections and claim places by hand, and the dense search against numpy."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import chunking as C
from plumbline.operators import graph as G
from plumbline.operators import legal as L
from plumbline.operators import memory as Y
from plumbline.operators import retrieval as R


@pytest.mark.parametrize("text,keys", [
    ("[1950] 1 S. C. R. 88 and [2020] 3 s.c.r. 15, [1999] 2 SCR 7", ["SCR:1950:1:88", "SCR:2020:3:15", "SCR:1999:2:7"]),
    ("12021 INSC 44; 2021 INSC 45x; 2021  INSC 46", ["INSC:2021:46"]),
    ("(2013)5SCC762, (2013) 5 scc 9", ["SCC:2013:5:762"]),
    ("AIR 1973 SC 1461, FAIR 1973 SC 2", ["AIR:1973:1461"]),
    ("s. 302 and ss. 34, Sections 10A(2), section 9 of the Code", ["SECTION:302", "SECTION:34", "SECTION:10A", "SECTION:9"]),
    ("Section 138 of the Negotiable  Instruments Act, 1881; Section 5, Limitation Act, 1963", ["ACT:NEGOTIABLE INSTRUMENTS ACT, 1881:S138", "ACT:LIMITATION ACT, 1963:S5"]),
    ("Article 32, Articles 14 and article 19", ["ARTICLE:32", "ARTICLE:14"]),
    ("Articles 21A (2013) 5 SCC 1, (2013) 5 SCC 1 and Section 2", ["SCC:2013:5:1", "SECTION:2", "ARTICLE:21A"]),
    ("", []),
])
def test_citations(spark, text, keys):
    assert spark.range(1).select(F.transform(L.citations(F.lit(text)), lambda x: x["key"]).alias("k")).first().k == keys


def test_citations_of_nothing(spark):
    assert spark.range(1).select(L.citations(F.lit(None).cast("string")).alias("k")).first().k == []


def test_thousands_of_citations_take_little_time(spark):
    """3,000 citations, each twice: as many keys, in the order of the text."""
    def timed(n):
        text = "; ".join(f"(2013) {i % 12 + 1} SCC {i} and Article {i}" for i in [*range(n // 2)] * 2)
        rows = spark.createDataFrame([(text,)], "text string").coalesce(1).select(F.transform(L.citations(F.col("text")), lambda x: x["key"]).alias("k"))
        began = time.perf_counter()
        return rows.first().k, time.perf_counter() - began

    _, idle = timed(2)  # planning and the start of a job
    keys, took = timed(3000)
    assert keys == [f"SCC:2013:{i % 12 + 1}:{i}" for i in range(1500)] + [f"ARTICLE:{i}" for i in range(1500)]
    assert took - idle < 1


MODERN = """[2021] 4 S.C.R. 9
Alpha v. Beta
Issue for Consideration
Whether the notice was in time.
  Headnotes
Limitation - the notice was late.
Case Law Citied
(2001) 2 SCC 3 - followed
Appearances for Parties
A. B., Adv.
Headnotes
Costs follow the event.
Judgment/Order of the Supreme Court
1. Leave granted.
Headnotes in a line of text stay.
"""


def test_modern_sections(spark):
    s = spark.range(1).select(L.sections(F.lit(MODERN)).alias("s")).first().s
    assert s == {
        "caption": "[2021] 4 S.C.R. 9\nAlpha v. Beta", "issue": "Whether the notice was in time.", "headnote": "Limitation - the notice was late.\nCosts follow the event.",
        "case_law_cited": "(2001) 2 SCC 3 - followed", "appearances": "A. B., Adv.", "judgment": "1. Leave granted.\nHeadnotes in a line of text stay."}


OLD = "GAMMA v. DELTA\n[RAY AND SEN, JJ.]\n"


@pytest.mark.parametrize("text,want", [
    (OLD + "A headnote that is long enough to be kept as one.\nORDER\n1. Dismissed.", {"caption": OLD.strip(), "headnote": "A headnote that is long enough to be kept as one.", "judgment": "ORDER\n1. Dismissed."}),
    (OLD + "Too short.\nCase Law Reference\n(2001) 2 SCC 3\nJ U D G M E N T\n1. Allowed.", {"caption": OLD.strip(), "case_law_cited": "(2001) 2 SCC 3", "judgment": "J U D G M E N T\n1. Allowed."}),
    (OLD + "Nothing more is here.", {"caption": OLD.strip(), "body": (OLD + "Nothing more is here.").strip()}),
    ("CRIMINAL APPELLATE JURISDICTION: Appeal 5\nfrom below\nThe Judgment of the Court was delivered by X\n1. So.", {"case_arising_from": "CRIMINAL APPELLATE JURISDICTION: Appeal 5\nfrom below", "judgment": "The Judgment of the Court was delivered by X\n1. So."}),
    ("plain text", {"body": "plain text"}),
])
def test_old_sections(spark, text, want):
    assert spark.range(1).select(L.sections(F.lit(text)).alias("s")).first().s == want


def test_dense_ranking_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(R, "_BLOCK", 40)
    monkeypatch.setattr(R, "_ASKED", 3)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[7] = 0
    v[20] = v[21] = v[22]
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "doc_id long, v array<double>")
    asked = rows.where("doc_id % 31 = 0 or doc_id = 7 or doc_id = 21").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    got = {}
    for r in R.dense_ranking(rows, asked, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    for q, ids in got.items():
        far = 1 - unit @ unit[q]
        assert ids == sorted((i for i in range(300) if i != q), key=lambda i: (round(far[i], 6), i))[:5]
    assert len(got) == asked.count()


def test_sentence_chunks_equal_a_loop(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(" ".join(["w"] * int(n)) + "." for n in rng.integers(1, 40, rng.integers(1, 60)))) for i in range(20)] + [(90, ""), (91, None), (92, "w " * 300 + "end. x. y.")]

    def chunks(sizes, size, overlap):
        out, first, at, used = [], 0, 0, 0
        for i, s in enumerate(sizes):
            if used and used + s > size:
                out.append((first, i - first))
                back, words = 0, 0
                while first + back + 1 < i and words + sizes[i - 1 - back] <= min(overlap, size - s):
                    words += sizes[i - 1 - back]
                    back += 1
                first, used = i - back, words
            used += s
        return out + [(first, len(sizes) - first)] if sizes else []

    for size, overlap in ((100, 30), (64, 0)):
        got = {}
        for r in C.sentence_windows(spark.createDataFrame(docs, "doc_id int, text string"), size, overlap).orderBy("doc_id", "chunk_index").collect():
            got.setdefault(r.doc_id, []).append((r.first_part, r.n_parts))
        for i, text in docs:
            sizes = [len(s.split()) for s in (text or "").replace(". ", ".|").split("|") if s.strip()]
            assert got.get(i, []) == chunks(sizes, size, overlap)


def test_graph_save_and_memory_cascade(spark, tmp_path):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b", "CITES")], "src string, dst string, relation string")
    G.saved(nodes, edges, str(tmp_path / "g"))
    assert [tuple(r) for r in G.loaded(spark, str(tmp_path / "g"))[1].collect()] == [("a", "b", "CITES")]
    G.saved(nodes.limit(1), edges, str(tmp_path / "h"))
    with pytest.raises(ValueError):
        G.loaded(spark, str(tmp_path / "h"))
    found = spark.createDataFrame([(1, 1, "s", "q1", "a1", 0.5), (1, 2, "t", "q2", "a2", 0.25)], "query_id int, rank int, session_id string, question string, answer string, score double")
    assert Y.context(found, F.lit("t")).first().context == "--- Previous conversation 1 (Relevance: 0.50) ---\nQ: q1\nA: a1\n\n--- Current Session Interaction 2 (Relevance: 0.25) ---\nQ: q2\nA: a2\n"


def test_short_texts_have_a_failure_row(spark):
    rows = spark.createDataFrame([(1, "Short."), (2, None), (3, MODERN * 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in L.parsed(rows).collect()}
    assert got[1].failure == "text of 6 characters" and got[2].failure == "text of 0 characters" and got[1].sections is None
    assert got[3].failure is None and got[3].sections["judgment"]


def test_texts_without_chunks_are_cut_by_length(spark):
    docs = spark.createDataFrame([(1, "x" * 4500), (2, "Headnotes\n" + "y" * 60), (3, " ")], "doc_id long, text string")
    judged = docs.select("doc_id", L.sections(F.col("text")).alias("sections"), F.array().cast("array<struct<number:int,text:string>>").alias("paragraphs")).where("doc_id <> 1")
    got = sorted((r.doc_id, r.section, len(r.text)) for r in L.chunks(judged, docs).collect())
    assert got == [(1, "body", 900), (1, "body", 2000), (1, "body", 2000), (2, "headnote", 60)]
