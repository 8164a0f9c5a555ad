"""The dense search: a task gives each question's nearest of all its blocks, and ranks stay exact."""

import numpy as np
import pandas as pd

from plumbline.operators import retrieval as R


def _pair(q_block, asked, ids, points):
    return {"v_block": 0, "v_ids": ids, "v_vectors": [points[i] for i in ids], "q_block": q_block, "q_ids": asked, "q_vectors": [points[i] for i in asked]}


def test_a_task_gives_each_questions_nearest_once(monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 6))
    points[200:260] = points[7]  # copies, ranked by id
    blocks = [np.arange(a, 400, 8)[::-1] for a in range(8)]
    asked = [np.arange(0, 20), np.arange(190, 215)]
    frames = [pd.DataFrame([_pair(b, q, v, points) for b, q in enumerate(asked)]) for v in blocks]
    found = pd.concat(R._nearest_in_block(5)(iter(frames)))
    assert len(found) == 5 * 45  # before: of every block, and all that tie
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    for q, rows in found.groupby("query_id"):
        far = np.round(1 - unit @ unit[q], 6)
        want = sorted((abs(d), i) for i, d in enumerate(far) if i != q)[:5]
        assert sorted(rows.doc_id) == sorted(i for _, i in want)
    monkeypatch.setattr(R, "_KEPT", 60)  # given out early, none is lost
    early = pd.concat(R._nearest_in_block(5)(iter(frames)))
    assert set(zip(found.query_id, found.doc_id)) <= set(zip(early.query_id, early.doc_id))


def test_a_row_that_may_be_rounded_either_way_pushes_none_out():
    asked, ids = np.zeros(4, int), np.array([1, 2, 3, 4])
    far = np.array([0.1234565, 0.1234565, 0.123456, 0.2])
    assert sorted(R._nearest(asked, ids, far, 1)[1]) == [1, 2, 3]
    assert [len(x) for x in R._nearest(asked[:0], ids[:0], far[:0], 3)] == [0, 0, 0]


def test_ids_of_any_type(spark):
    rows = [(f"d{i}", [float(i % 7), float(i % 5), 1.0]) for i in range(40)]
    vectors = spark.createDataFrame(rows, "doc_id string, v array<double>")
    asked = vectors.where("doc_id in ('d1', 'd36')").selectExpr("doc_id as query_id", "v as q")
    got = sorted((r.query_id, r["rank"], r.doc_id) for r in R.dense_ranking(vectors, asked, 3).collect())
    assert [g[2] for g in got if g[0] == "d1"][0] == "d36" and len(got) == 6


def test_blocks_of_questions_are_not_copied(spark, data):
    """Before, a block of questions was copied for every block of vectors, and the copies were broadcast whole."""
    from plumbline.plans import inputs as I

    found = R.dense_ranking(I.vectors(spark, data), I.vector_questions(spark, data), 5)
    made = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate explode" in x]
    assert len(made) == 1 and "[q_block#" in made[0]  # by a block of vectors, for the names of those it meets
