"""The vector index: recall against exact search, and changes by cells."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import vector_index as X
from plumbline.plans import inputs as I
from plumbline.session import shared_folder


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    return [(i, (centres[i % 30] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)] + [(3000, [0.0] * 16)]


@pytest.fixture(scope="module")
def built(spark, rows):
    index = X.VectorIndex(spark, f"{shared_folder(spark)}/vectors-test-{uuid.uuid4().hex[:8]}")
    index.build(spark.createDataFrame(rows, "doc_id long, v array<float>"))
    return index


def exactly(rows, ids, k):
    m = np.array([v for _, v in rows], np.float32).astype(float)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    m = np.divide(m, length, out=np.zeros_like(m), where=length > 0)
    known = {i: n for n, (i, _) in enumerate(rows)}
    out = {}
    for i in ids:
        far = sorted((round(1 - float(m[known[i]] @ m[n]), 6), j) for n, (j, _) in enumerate(rows) if j != i)
        out[i] = [j for _, j in far[:k]]
    return out


def found(index, spark, rows, ids, k=10):
    known = dict(rows)
    q = spark.createDataFrame([(i, known[i]) for i in ids], "query_id long, q array<float>")
    out = {i: [] for i in ids}
    for r in index.search(q, k).orderBy("query_id", "rank").collect():
        out[r.query_id].append(r.doc_id)
    return out


def recall(got, want):
    return np.mean([len(set(got[i]) & set(want[i])) / len(want[i]) for i in want])


def test_recall_and_changes(spark, rows, built):
    ids = [*range(0, 1500, 40)]
    assert recall(found(built, spark, rows, ids), exactly(rows, ids, 10)) >= 0.9
    assert all(i not in near for i, near in found(built, spark, rows, ids).items())
    before = X.cells_recorded(built)
    gone = [i for i, _ in rows if i % 300 == 7]
    cells = built.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
    after = X.cells_recorded(built)
    assert len(cells) < len(before) and {n for n in before if before[n] != after.get(n)} == {f"cell={c}" for c in cells}
    moved = [(11, rows[900][1]), (5000, rows[901][1])]
    cells = built.upsert(spark.createDataFrame(moved, "doc_id long, v array<float>"))
    assert {n for n in {**after, **X.cells_recorded(built)} if after.get(n) != X.cells_recorded(built).get(n)} == {f"cell={c}" for c in cells}
    now = [(i, dict(moved).get(i, v)) for i, v in rows if i not in gone] + [moved[1]]
    assert built.get(spark.createDataFrame([(11,), (7,), (5000,)], "doc_id long")).count() == 2
    assert sorted(r.doc_id for r in built._lists().select("doc_id").collect()) == sorted(i for i, _ in now)
    ids = [i for i in ids if i not in gone]
    assert recall(found(built, spark, now, ids), exactly(now, ids, 10)) >= 0.9


def test_rows_that_cannot_be_indexed(spark, built):
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [None] * 16), (None, [1.0] * 16), (4, [float("nan")] * 16), (6, [0.5] * 16)], "doc_id long, v array<float>")
    assert sorted(str(r.doc_id) for r in built.rejected(odd).collect()) == ["1", "2", "3", "4", "None"]
    with pytest.raises(ValueError):
        built.upsert(odd)
    with pytest.raises(ValueError):
        X.VectorIndex(spark, built.path + "-none").build(odd.limit(0))


def test_workers_hold_and_give_little(spark, built, rows, monkeypatch):
    """Batches of a worker are bounded, and bounds that are met at once leave the result as it is."""
    ids = [i for i, _ in rows][::25]
    want = found(built, spark, rows, ids)
    plain = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema, *a, **k: plain(self, lambda batches: sized(f, batches), schema, *a, **k))

    def sized(f, batches):
        for b in f(batches):
            assert b.num_rows <= 256
            yield b

    for name, value in (("MATRIX", 256), ("GIVEN", 256), ("HELD", 300)):
        monkeypatch.setattr(X, name, value)
    assert found(built, spark, rows, ids) == want
