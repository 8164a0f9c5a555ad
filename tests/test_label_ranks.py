"""Gold by labels without pairs: as by pairs, and in plans that join no rows by label alone."""

from plumbline.operators import metrics as M
from plumbline.plans import inputs as I
from plumbline.plans import retrieval as PR


def test_as_by_pairs(spark):
    rows = [(i, None if i % 11 == 0 else i % 3) for i in range(60)] + [(60, 9)]
    labels = spark.createDataFrame(rows, "doc_id long, label int")
    queries = spark.createDataFrame([(i, dict(rows)[i]) for i in (0, 1, 20, 33, 60)], "query_id long, label int")
    ranking = spark.createDataFrame([(q, (q + 7 * r) % 61, r) for q in (0, 1, 20, 60) for r in range(1, 9)], "query_id long, doc_id long, rank int")
    gold = queries.join(labels, "label").where("doc_id <> query_id").select("query_id", "doc_id")
    by_id = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert by_id(M.label_ranks(ranking, labels, queries)) == by_id(M.gold_ranks(ranking, gold, queries))


def test_no_row_of_a_pair_is_made(spark, data):
    """The panel's ranks make no more rows in any join than a query's ranked ones (before: all rows of its label)."""
    n = I.vector_questions(spark, data).count()
    ranks = PR._vec_ranks(spark, data)
    plan = ranks._jdf.queryExecution().optimizedPlan().toString()
    assert ranks.count() == n and "(label" in plan and "NOT (doc_id" not in plan
