"""Centroid clustering against a plain run of the rounds."""

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import clusters as C
from plumbline.llm.queries import ORACLE, QUERIES

from compare import same

SCHEMA = "vec_id long, embedding array<float>, label int"


def plainly(rows, k=8, rounds=10):
    """[(vec_id, cluster, distance)] and the centroids, by comparing every vector with every centroid in each round."""
    kept = [(i, [math.floor(1024 * float(np.float32(e))) for e in v]) for i, v in rows if v is not None and len(v) == 64 and all(e is not None and math.isfinite(e) for e in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(x) for _, x in first[:k]]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min(range(len(centroids)), key=lambda c: (dist(x, centroids[c]), c))
    for _ in range(rounds):
        of = [nearest(x) for _, x in kept]
        for c in range(len(centroids)):
            own = [x for (_, x), o in zip(kept, of) if o == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own)]
    return [(i, c := nearest(x), dist(x, centroids[c])) for i, x in kept], centroids


def order(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


def test_query_equals_sql(spark, data, duck):
    same(QUERIES["op11_clusters"](spark, data), duck.sql(ORACLE["op11_clusters"]))


def test_clusters_equal_plain_rounds(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").limit(150)
    want, centroids = plainly([(r.vec_id, r.embedding) for r in rows.collect()])
    found, got = C.clusters(rows)
    assert order(map(tuple, found.collect())) == order(want) and got.tolist() == centroids


def test_odd_vectors(spark):
    rng = np.random.default_rng(2)
    some = [(i, rng.normal(size=64).tolist()) for i in range(40)]
    odd = [(50, None), (51, []), (52, [1.0] * 63), (53, [None] + [1.0] * 63), (54, [float("nan")] + [1.0] * 63), (55, [float("inf")] * 64), (None, [0.5] * 64), (None, None)]
    copies = [(60, [0.25] * 64)] * 30 + [(61, [0.25] * 64)] * 5  # ties and repeated rows
    rows = some + odd + copies
    names = ["x", "norm", "dots", "cluster", "place", "h", "n"]
    df = spark.createDataFrame([(i, v, None) for i, v in rows], SCHEMA).select("*", *[F.lit("z").alias(n) for n in names]).repartition(5)
    want, centroids = plainly(rows)
    found, got = C.clusters(df)
    assert got.tolist() == centroids and order(map(tuple, found.collect())) == order(want)
    few = df.where("vec_id < 3")
    assert {r.distance for r in C.clusters(few)[0].collect()} == {0}
    assert C.clusters(df.where("vec_id = 50"))[0].count() == 0 and C.clusters(df.limit(0))[0].count() == 0


def test_an_emptied_cluster_stays(spark):
    """Two equal first centroids: the second gets no vector and keeps its place."""
    rows = [(i, [float(i % 2)] * 64) for i in range(9)]
    found, got = C.clusters(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    want, centroids = plainly(rows)
    assert got.tolist() == centroids and order(map(tuple, found.collect())) == order(want)
