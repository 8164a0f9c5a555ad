"""Hard negatives against a plain ranking of all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import negatives as N
from plumbline.llm.queries import ORACLE, QUERIES

from compare import same

SCHEMA = "vec_id long, embedding array<float>, label int"


def plainly(rows, anchors):
    """The result by ranking all pairs of each anchor."""
    sound = lambda rows: [(i, [math.floor(256 * float(np.float32(e))) for e in v], y) for i, v, y in rows if None not in (i, v, y) and all(e is not None and math.isfinite(e) for e in v)]
    kept, first, out = sound(rows), {}, []
    for a in sorted(sound(anchors), key=lambda r: (r[0], r[2], r[1])):
        first.setdefault(a[0], a)
    for i, x, y in first.values():
        pairs = sorted((-sum(p * q for p, q in zip(x, v)), j, z == y) for j, v, z in kept if j != i)
        for ps, p, _ in [r for r in pairs if r[2]][:5]:
            inside = [(s, j) for s, j, own in pairs if not own and 30 * -ps <= 100 * -s <= 90 * -ps]
            out += [(i, p, r + 1, j, -ps, -s) for r, (s, j) in enumerate(inside[:10])]
    return sorted(out)


def test_query_equals_sql(spark, data, duck):
    same(QUERIES["op12_hard_negatives"](spark, data), duck.sql(ORACLE["op12_hard_negatives"]))


def test_keys_sort_as_the_pairs_do():
    rng = np.random.default_rng(1)
    rows = [tuple(map(int, rng.integers(-5, 5, 3))) for _ in range(300)] + [(-(2**62), 2**61, -7), (2**62, -(2**61), 2**62)]
    a, s, i = (np.array(c) for c in zip(*rows))
    keys = N.packed_keys(a, s, i).to_pylist()
    assert [N.unpacked(k) for k in keys] == rows
    assert [N.unpacked(k) for k in sorted(keys)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))


def test_many_slices_and_blocks(spark, monkeypatch):
    """Small integer vectors: many equal scores, zero and negative positives, rows over many slices."""
    monkeypatch.setattr(N, "SLICE_ROWS", 37)
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.integers(-2, 3, 3) / 256).tolist(), int(rng.integers(0, 3))) for i in rng.permutation(400)]
    rows += [(402, [0.0] * 3, 1), (405, [0.0] * 3, 7), (408, [0.0] * 3, 7)]  # all scores zero; few of a label
    anchors = [r for r in rows if r[0] % 3 == 0]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = N.hard_negatives(df, df.where("vec_id % 3 = 0")).collect()
    want = plainly(rows, anchors)
    assert sorted(map(tuple, got)) == want and {r[4] > 0 for r in want} == {True, False}


def test_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.integers(-40, 60, 4) / 256).tolist(), i % 2) for i in range(60)]
    rows += [(100, None, 1), (101, [1.0, None], 1), (102, [float("nan"), 1.0], 1), (103, [float("-inf")], 0), (104, [1.0], None), (None, [1.0], 1), (None, None, None)]
    rows += [(105, [], 0), (106, [0.5], 1), (107, [0.25] * 6, 0), (0, [0.125] * 4, 0), (0, [0.125] * 4, 1)]  # other lengths, an id that repeats
    rows += [(110, [0.125] * 4, 1)] * 25 + [(20, [0.25] * 4, 0)] * 3  # repeated rows
    names = ["x", "slice", "kind", "key", "positive", "anchor_id", "one"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("z").alias(n) for n in names]).repartition(4)
    anchors = df.where("vec_id % 20 = 0 or vec_id in (105, 106, 107) or vec_id is null")
    got = sorted(map(tuple, N.hard_negatives(df, anchors).collect()))
    assert got == plainly(rows, [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] in (105, 106, 107)])
    assert N.hard_negatives(df.limit(0), df.limit(0)).count() == 0 and N.hard_negatives(df, df.limit(0)).count() == 0
    assert N.hard_negatives(df.where("vec_id = 5"), df.where("vec_id = 5")).count() == 0
