"""Shapes of physical plans that the operators rely on."""

import pytest

from plumbline.operators import retrieval as R
from plumbline.plans import catalogue
from plumbline.plans import inputs as I


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_cut_before_the_shuffle(spark, data):
    text = plan(catalogue.QUERIES["bm25_topk"](spark, data))
    assert text.count("WindowGroupLimit") == 4 and "CartesianProduct" not in text  # of the ranges that set the threshold, and of the result
    assert "BroadcastNestedLoopJoin BuildRight, Cross" in text and "BroadcastNestedLoopJoin BuildRight, Inner" not in text  # one row of counts


def test_scans_read_the_columns_used(spark, data):
    text = plan(R.bm25_ranking(I.documents(spark, data), I.questions(spark, data)))
    schemas = {x.split("ReadSchema: ")[1].split(">")[0] for x in text.split("\n") if "ReadSchema" in x and "documents" in x}
    assert schemas <= {"struct<doc_id:bigint,text:string", "struct<text:string", "struct<"}


def test_filters_reach_the_scan(spark, data):
    text = plan(I.table(spark, data, "events").where("user_id = 3").select("event_id"))
    assert "EqualTo(user_id,3)" in text


def test_small_keys_are_counted_before_broadcasting(spark, monkeypatch):
    keys = spark.range(100).withColumnRenamed("id", "k")
    big = spark.range(10**6).withColumnRenamed("id", "k")
    assert "BroadcastHashJoin" in plan(big.join(R.small(keys), "k", "left_semi"))
    monkeypatch.setattr(R, "_BROADCAST_ROWS", 10)
    assert "hints" not in R.small(keys)._jdf.queryExecution().logical().toString()


@pytest.mark.parametrize("name", ["phrase_containment", "dense_topk", "stage_matrix", "root_cause", "boundary_adjacency", "graph_two_hop", "claim_status", "topic_terms"])
def test_no_pairing_of_all_rows(name, spark, data):
    text = plan(catalogue.QUERIES[name](spark, data))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
