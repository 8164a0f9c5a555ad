"""Centroid clustering on exact integers, with the distance matrix kept up to date.

Every vector carries its inner products with all centroids, as exact integers,
in a table of the shared folder. When the centroids move, only the components
that changed are used: a centroid's product with a vector grows by the change
of each such component times the vector's own. The squared distance then needs
no pass over the other components, and the nearest centroid is found anew. A
round writes the table again, so a lost executor costs one round's tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import discard, integer_vectors, table, written
from plumbline.session import ship

CENTROIDS = 8
ROUNDS = 10
COMPONENTS = 64
SCALE = 1024
#: Integers beyond this would not leave squared distances of 64 components within a long.
_LARGEST = 1 << 27

_STATE = "vec_id long, x array<int>, norm long, dots array<long>, cluster int"


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()).cast(kind))


def _step(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The state under the centroids `after`; its products are those with `before`, or absent (as with zeros)."""
    k, width = after.shape
    places = [np.flatnonzero(row) for row in after - before]
    moved = [(c, at, (after - before)[c, at]) for c, at in enumerate(places) if len(at)]
    squares = (after * after).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            if len(x) and np.abs(x).max() > _LARGEST:
                raise ValueError(f"a vector has a component beyond {_LARGEST} units; its distances don't fit a long")
            fresh = "dots" not in batch.schema.names
            norm = (x * x).sum(axis=1) if fresh else batch.column("norm").to_numpy(zero_copy_only=False)
            dots = np.zeros((len(x), k), np.int64) if fresh else _matrix(batch.column("dots"), k).copy()
            for c, at, change in moved:
                dots[:, c] += x[:, at] @ change
            cluster = np.argmin(squares - 2 * dots, axis=1) if len(x) else np.zeros(0, np.int64)  # the first of equals
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _lists(x, pa.int32()), pa.array(norm, pa.int64()), _lists(dots, pa.int64()), pa.array(cluster.astype(np.int32))],
                ["vec_id", "x", "norm", "dots", "cluster"])

    return state.mapInArrow(run, _STATE)


def _sums(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(count, component sums) of every cluster; a task sends one row a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            cluster, x = batch.column("cluster").to_numpy(zero_copy_only=False), _matrix(batch.column("x"), width)
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), _lists(total, pa.int64())], ["cluster", "n", "total"])

    parts = state.select("cluster", "x").mapInArrow(run, "cluster int, n long, total array<long>").where("n > 0")
    rows = parts.select("cluster", "n", F.posexplode("total").alias("place", "value")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    for r in rows.collect():  # k times width rows
        count[r.cluster], total[r.cluster, r.place] = r.n, r.value
    return count, total


def first_centroids(vectors: DataFrame, k: int, salt: str = "3:") -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in ascending order of the hash; equal hashes go by their components, null ids last."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(name.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r.x for r in rows], np.int64)


def clusters(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, size: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector of `size` components after `rounds` rounds, and the final centroids.

    Vectors of another size, null, or with a null or non-finite component take
    no part. Rows that repeat are vectors each, a null id keeps its row (and is
    last in line as a first centroid), and other columns play no part. With
    fewer than k vectors there are as many centroids; an empty table gives no
    row. Components beyond 2^27 units raise, since distances are longs. Once
    a round moves no centroid, the later ones can't either and are left out.
    """
    ship(df.sparkSession)
    rows = integer_vectors(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("_v")), scale, size, "vec_id", "_v").select("vec_id", "x")
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), np.zeros((0, size), np.int64)
    state = written(_step(rows, np.zeros_like(centroids), centroids), "distances")
    for _ in range(rounds):
        count, total = _sums(state, *centroids.shape)
        moved = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], centroids)
        if (moved == centroids).all():
            break
        newer = written(_step(state, centroids, moved), "distances")
        discard(state)
        state, centroids = newer, moved
    squares = F.array(*[F.lit(int(s)) for s in (centroids * centroids).sum(axis=1)])
    at = F.col("cluster")
    distance = F.col("norm") + F.get(squares, at) - 2 * F.get("dots", at)
    return state.select("vec_id", "cluster", distance.alias("distance")), centroids


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings with their inertia; edge cases as in clusters."""
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    shares = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a centroid
    rows = [(c, shares.get(c, 0), sum(shares.values()), hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()) for c, centroid in enumerate(centroids.tolist())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_sql() -> str:
    """The rounds one after the other, over components as rows."""
    nearest = "SELECT vec_id, k FROM (SELECT v.vec_id, c.k, row_number() OVER (PARTITION BY v.vec_id ORDER BY sum((v.x - c.x) * (v.x - c.x)), c.k) AS r FROM vectors v JOIN c{0} c USING (j) GROUP BY 1, 2) WHERE r = 1"
    parts = [
        """kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS xs FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        "vectors AS MATERIALIZED (SELECT vec_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM kept)",
        "c0 AS MATERIALIZED (SELECT k, unnest(xs) AS x, generate_subscripts(xs, 1) AS j FROM (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, xs FROM kept ORDER BY k LIMIT 8))",
        f"a0 AS MATERIALIZED ({nearest.format(0)})",
    ]
    for r in range(1, ROUNDS + 1):
        parts.append(f"""c{r} AS MATERIALIZED (SELECT c.k, c.j, coalesce(m.x, c.x) AS x FROM c{r - 1} c LEFT JOIN
  (SELECT k, j, (s - ((s % n) + n) % n) // n AS x FROM (SELECT a.k, v.j, sum(v.x)::BIGINT AS s, count(*) AS n FROM vectors v JOIN a{r - 1} a USING (vec_id) GROUP BY 1, 2)) m USING (k, j))""")
        parts.append(f"a{r} AS MATERIALIZED ({nearest.format(r)})")
    parts.append(f"d AS (SELECT v.vec_id, a.k, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM vectors v JOIN a{ROUNDS} a USING (vec_id) JOIN c{ROUNDS} c USING (k, j) GROUP BY 1, 2)")
    parts.append(f"h AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY 1)")
    return "WITH " + ",\n".join(parts) + """
SELECT vec_id, k::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM d JOIN h USING (k)"""
