"""The stored lexical index against BM25 over the texts."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.operators import lexical_index as X
from plumbline.operators import retrieval as R
from plumbline.plans import inputs as I
from plumbline.session import shared_folder, subfolders


def words(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.choice((3, 8, 30, 200)))) for i in range(900)] + [(2000, None), (2001, ""), (2002, "the of and")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def questions(spark):
    rng = random.Random(5)
    return spark.createDataFrame([(i, words(rng, rng.randint(1, 6))) for i in range(25)] + [(90, "nowhere"), (91, None), (92, "w1 w1 w3")], "query_id long, question string")


def fresh(spark):
    return X.LexicalIndex(spark, f"{shared_folder(spark)}/lexical-test-{uuid.uuid4().hex[:8]}")


def ranks(df):
    return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 5)) for r in df.collect())


def test_term_counts(spark):
    row = spark.range(1).select(X.term_counts(F.array(*map(F.lit, "b a b c b a".split()))).alias("c"), X.term_counts(F.array().cast("array<string>")).alias("e")).first()
    assert [tuple(x) for x in row.c] == [("a", 2), ("b", 3), ("c", 1)] and row.e == []


def test_search_equals_scoring_all(spark, docs, questions, monkeypatch):
    monkeypatch.setattr(X, "RANGE_DOCS", 16)
    index = fresh(spark)
    index.add(docs)
    assert ranks(index.search(questions, 5)) == ranks(R.bm25_ranking(docs, questions, 5))
    every, read = index.bounds(questions).count(), index.reached(questions, 5).count()
    assert read < 0.8 * every  # ranges are left out
    assert ranks(index.overlap(questions, 7)) == ranks(R.overlap_ranking(docs, questions, 7))
    got = {r.term: (r.df, round(r.idf, 6)) for r in index.terms().collect()}
    assert got == {r.term: (r.df, round(r.idf, 6)) for r in R.bm25_terms(docs).collect()}


def test_segments_and_deletions(spark, docs, questions, monkeypatch):
    monkeypatch.setattr(X, "RANGE_DOCS", 16)
    index = fresh(spark)
    parts = [docs.where(f"doc_id % 3 = {k}") for k in range(3)]
    index.add(parts[0])
    index.add(parts[1])
    files = lambda: {(n, part, f) for n in "01" for part in ("documents", "blocks", "terms", "counts") for f in subfolders(spark, f"{index.path}/segments/{n}/{part}")}
    before = files()
    index.add(parts[2])
    assert index.segments() == [0, 1, 2] and files() == before
    assert ranks(index.search(questions, 5)) == ranks(R.bm25_ranking(docs, questions, 5))
    index.delete(docs.where("doc_id % 4 = 1"))
    index.delete(docs.where("doc_id % 8 = 1"))  # again
    left = docs.where("doc_id % 4 <> 1")
    assert files() == before and ranks(index.search(questions, 5)) == ranks(R.bm25_ranking(left, questions, 5))
    changed = docs.where("doc_id % 8 = 1 or doc_id % 8 = 2").withColumn("text", F.concat("text", F.lit(" w2 w2 w59")))
    index.upsert(changed)
    now = left.where("doc_id % 8 <> 2").unionByName(changed)
    assert ranks(index.search(questions, 5)) == ranks(R.bm25_ranking(now, questions, 5))
    assert {r.doc_id for r in index.documents().select("doc_id").collect()} == {r.doc_id for r in now.select("doc_id").collect()}


def test_an_index_is_found_again(spark, data, docs):
    table = I.documents(spark, data)
    one = X.stored(table)
    assert X.stored(I.documents(spark, data)).path == one.path and one.segments() == [0]
    with pytest.raises(ValueError):
        fresh(spark).counts().collect()
    empty = fresh(spark)
    empty.add(docs.limit(0))
    assert empty.search(spark.createDataFrame([(1, "w1")], "query_id long, question string")).count() == 0


def test_pairs_of_question_and_document_stay_where_they_are_made(spark, data):
    """Postings are dealt by document; counts and scores of all pairs need no exchange of their own."""
    import re

    index, q = X.stored(I.documents(spark, data)), I.questions(spark, data)
    for found in (index.overlap(q), index.scores(q)):
        assert not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", found._jdf.queryExecution().executedPlan().toString())


def test_blocks_are_made_of_whole_ranges(spark, docs, monkeypatch):
    """Documents are dealt by range, and a task turns a range around: each term has one block in it, over texts of bounded size."""
    monkeypatch.setattr(X, "RANGE_WORDS", 1000)
    index = fresh(spark)
    index.add(docs)
    blocks = index._read("blocks")
    each = blocks.select("term", "range", F.explode("postings").alias("p")).select("term", "range", "p.*")
    held = each.select("range", "doc_id", "dl").distinct().groupBy("range").agg(F.sum("dl").alias("words"), F.count(F.lit(1)).alias("n"))
    assert max(r.words for r in held.where("n > 1").collect()) < 3000
    want = index._read("documents").select("doc_id", "dl", F.explode("terms").alias("t")).select("t.term", "doc_id", "t.tf", "dl")
    assert sorted(map(tuple, each.select("term", "doc_id", "tf", "dl").collect())) == sorted(map(tuple, want.collect()))
    sums = each.groupBy("term", "range").agg(F.count(F.lit(1)), F.max("tf"), F.min("dl")).collect()
    assert sorted(map(tuple, blocks.select("term", "range", "n", "max_tf", "min_dl").collect())) == sorted(map(tuple, sums))
    assert each.select("range", "doc_id").distinct().count() == each.select("doc_id").distinct().count()
