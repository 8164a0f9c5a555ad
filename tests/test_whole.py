"""Queries read all rows and whole texts."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.plans import catalogue


@pytest.mark.parametrize("name", ["evidence_top3", "claim_status", "concat_strategy"])
def test_every_claim_is_scored(name, spark, data):
    assert catalogue.QUERIES[name](spark, data).where("claim_no >= 2").count() > 0


def test_context_recall_counts_a_third_claim(spark, data, monkeypatch):
    from plumbline.plans import claims

    known = "The river crosses the northern valley. The old bridge was built from granite stones."
    answers = spark.createDataFrame([(1, 1, known + " Seventeen purple dragons guard hidden treasure.")], "trace_id long, conv_id long, answer string")
    docs = spark.createDataFrame([(1, known)], "doc_id long, text string")
    monkeypatch.setattr(claims.I, "answers", lambda s, d: answers)
    monkeypatch.setattr(claims.I, "documents", lambda s, d, *more: docs)
    assert [tuple(r) for r in claims.context_recall(spark, data).collect()] == [(1, pytest.approx(2 / 3, abs=1e-4))]


def test_every_row_is_read(spark, data):
    parts = spark.read.parquet(f"{data}/part.parquet").count()
    assert catalogue.QUERIES["kendall_tau"](spark, data).agg({"n_items": "sum"}).first()[0] == parts
    nations = spark.read.parquet(f"{data}/customer.parquet").select("c_nationkey").distinct().count()
    assert catalogue.QUERIES["graph_reverse"](spark, data).select("dst").distinct().count() == nations


def test_kendall_equals_pairs_with_ties(spark):
    from plumbline.functions import statistics as S

    rng = random.Random(3)
    rows = [(k, i, rng.randrange(span), rng.randrange(span)) for k, n, span in (("a", 90, 40), ("b", 70, 1000), ("c", 1, 5), (None, 8, 3), ("d", 6, 1)) for i in range(n)]
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        sign = lambda a: (a > 0) - (a < 0)
        total = sum(sign((a[2] - b[2]) * (a[3] - b[3])) for a, b in itertools.combinations(own, 2))
        want[k] = (len(own), round(total / (len(own) * (len(own) - 1) / 2), 6) if len(own) > 1 else None)
    got = S.kendall(spark.createDataFrame(rows, "k string, i int, x int, y int"), ["k"], "i", "x", "y").collect()
    assert {r.k: (r.n_items, r.tau) for r in got} == want


def test_one_key_of_all_rows_is_spread(spark):
    """Kendall's tau of 60,000 items under one key: windows are by block, and the value is that of a count by merging."""
    from plumbline.functions import statistics as S

    rng = random.Random(9)
    ys = [rng.randrange(20_000) for _ in range(60_000)]
    df = spark.createDataFrame(list(enumerate(ys)), "x long, y int").withColumn("k", F.lit("all"))

    def inversions(v):
        if len(v) < 2:
            return v, 0
        (a, m), (b, n) = inversions(v[: len(v) // 2]), inversions(v[len(v) // 2 :])
        out, i, total = [], 0, m + n
        for y in b:
            while i < len(a) and a[i] <= y:
                out.append(a[i])
                i += 1
            total += len(a) - i
            out.append(y)
        return out + a[i:], total

    counts = Counter(ys)
    pairs, less = len(ys) * (len(ys) - 1) // 2, inversions(ys)[1]
    ties = sum(c * (c - 1) // 2 for c in counts.values())
    found = S.kendall(df, ["k"], "x", "x", "y")
    assert found.first().tau == pytest.approx((pairs - ties - 2 * less) / pairs, abs=1e-6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert all("_b#" in line for line in plan.split("\n") if "Window [" in line and "_y#" in line)


def test_ranks_share_ties_over_blocks(spark):
    from plumbline.functions import statistics as S

    rng = random.Random(11)
    values = [rng.choice([None, 5.0, 5.0, *map(float, range(300))]) for _ in range(3000)]
    got = sorted((r.v, r.rank) for r in S.average_ranks(spark.createDataFrame([(v,) for v in values], "v double"), "v", "rank").collect() if r.v is not None)
    known = sorted(v for v in values if v is not None)
    first, count = {v: i for i, v in reversed(list(enumerate(known)))}, Counter(known)
    assert got == [(v, first[v] + (count[v] + 1) / 2) for v in known]


def test_texts_are_whole(spark, data):
    words = spark.read.parquet(f"{data}/conversations.parquet").where("role = 'assistant'").selectExpr("sum(regexp_count(text, '[\\\\p{L}]+'))").first()[0]
    assert catalogue.QUERIES["turn_events"](spark, data).where("event = 'token'").count() == words
