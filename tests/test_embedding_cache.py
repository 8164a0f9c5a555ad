"""Vectors by content: computed once, found again."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import embedding_cache as E
from plumbline.session import shared_folder, subfolders


def models():
    """Two models; made in a function, so that they travel to the workers by value."""

    class Lengths(E.BatchModel):
        name, size, batch = "lengths", 2, 3

        def load(self):
            def embed(texts):
                assert len(texts) <= 3
                return np.array([[len(t), sum(map(ord, t)) % 97] for t in texts])

            return embed

    class Wrong(Lengths):
        name, size = "wrong", 3

    return Lengths(), Wrong()


def test_a_second_run_computes_nothing(spark):
    path = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex[:8]}"
    lengths, wrong = models()
    cache = E.VectorCache(path, lengths)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", None, "", "long text " * 50, "é"])], "id int, text string").withColumn("hash", F.lit(1)).repartition(3)
    want = {i: [float(len(t or "")), float(sum(map(ord, t or "")) % 97)] for i, t in ((r.id, r.text) for r in rows.collect())}
    one = cache.vectors(rows).collect()
    assert {r.id: list(r.vector) for r in one} == want and not any(r.hit for r in one)
    two = cache.vectors(rows.unionByName(spark.createDataFrame([(9, "new", 1)], rows.schema))).collect()
    assert {r.id for r in two if not r.hit} == {9} and {r.id: list(r.vector) for r in two if r.hit} == want
    parts = [spark.read.parquet(f"{path}/{n}").count() for n in subfolders(spark, path)]
    assert sorted(parts) == [1, 5]
    assert cache.vectors(rows.limit(0)).count() == 0
    other = E.VectorCache(path, E.HashedWords())
    assert not any(r.hit for r in other.vectors(rows).collect())  # another model's vectors are others
    with pytest.raises(Exception, match="gave vectors of 2 numbers"):
        E.VectorCache(path + "-w", wrong).vectors(rows)


def test_hashed_words():
    embed = E.HashedWords().load()
    a, b, c, none = embed(["Cats and dogs", "dogs, cats!", "zebra", "of the"])
    assert np.allclose(a, b) and abs(np.linalg.norm(c) - 1) < 1e-9 and not none.any()
