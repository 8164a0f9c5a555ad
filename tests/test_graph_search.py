"""Searches of many seeds at once, and chains through hubs."""

import random
import time

from plumbline.operators import graph as G


def plainly(edges, seeds, hops):
    """{(seed, id): hop} seed by seed."""
    out = {}
    for s in seeds:
        near, front = {s: 0}, {s}
        for hop in range(1, hops + 1):
            front = {d for a, d in edges if a in front} - near.keys()
            near |= dict.fromkeys(front, hop)
        out |= {(s, i): h for i, h in near.items()}
    return out


def test_reach_equals_a_search_of_each_seed(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(260)] + [(5, 5), (5, 6), (5, 6)]
    seeds = [*range(0, 120), 5, 500]  # more than a word's, one twice, one without edges
    df = spark.createDataFrame(edges, "src long, dst long")
    asked = spark.createDataFrame([(s,) for s in seeds] + [(None,)], "seed long")
    for hops in (0, 1, 3, 6):
        got = [tuple(r) for r in G.reach(df, asked, hops).collect()]
        assert len(got) == len(set(got)) and {(s, i): h for s, i, h in got} == plainly(edges, sorted(set(seeds)), hops)


def test_a_chain_of_edges_is_followed_to_its_end(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    got = {r.id: r.hop for r in G.reach(df, spark.createDataFrame([(0,)], "seed long"), 20).collect()}
    assert got == {i: i for i in range(10)}


def test_chains_equal_all_paths(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(60)]
    want = {}
    for a, b in edges:
        for b2, c in edges:
            if b == b2 and len({a, b, c}) == 3:
                want[a] = min(want.get(a, (b, c)), (b, c))
    got = {r.a: (r.b, r.c) for r in G.chains(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == want


def test_a_hub_costs_its_edges(spark):
    """100,000 edges into a node and as many out of it."""
    n = 100_000
    df = spark.range(2 * n).selectExpr(f"if(id < {n}, id + 10, 1) as src", f"if(id < {n}, 1, id + 10) as dst")
    began = time.perf_counter()
    rows = G.chains(df)
    assert rows.count() == n and rows.where(f"b <> 1 or c <> {n + 10}").count() == 0
    assert time.perf_counter() - began < 60
