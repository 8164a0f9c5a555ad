"""Iterative retrieval strategies and the table of named arms.

A driver loop with a fixed bound moves all queries forward together; each round
is one plan, and its state is written where the caller says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.graph import ADVERSE, expand
from plumbline.operators.retrieval import FINAL

# Bounds of the loops and the arms.
ITERATIONS, FOLLOW_UP = 4, 3
AGENT_STEPS, AGENT_RETRIEVALS = 6, 5
GRAPH_SEEDS, GRAPH_CHUNKS, CONTRADICTION_CHUNKS, BASE = 6, 6, 4, 10
ACTIONS = ("semantic_search", "lexical_search", "graph_expand", "find_citing_cases", "contradiction_search", "stop")
RETRIEVING = ("semantic_search", "lexical_search", "contradiction_search")
CONTRADICTION_TERMS = "overruled distinguished not applicable does not apply contrary view per incuriam"
_FIELDS = ("chunking", "mode", "rerank", "strategy", "graph", "graph_expand", "contradiction")
_ROWS = [
    ("A_vector", "legal", "vector", False, "plain", None, False, False),
    ("A_bm25", "legal", "bm25", False, "plain", None, False, False),
    ("B_hybrid", "legal", "hybrid", False, "plain", None, False, False),
    ("C_hybrid_rerank", "legal", "hybrid", True, "plain", None, False, False),
    ("C_fixed_chunking", "fixed", "hybrid", True, "plain", None, False, False),
    ("D_ircot", "legal", "hybrid", True, "ircot", None, False, False),
    ("E_agentic", "legal", "hybrid", True, "agentic", False, False, False),
    ("F_graphrag", "legal", "hybrid", True, "plain", None, True, False),
    ("G_ircot_graph", "legal", "hybrid", True, "ircot", None, True, False),
    ("H_agentic_graph", "legal", "hybrid", True, "agentic", True, False, False),
    ("I_full", "legal", "hybrid", True, "ircot", None, True, True),
]
ARMS = {name: dict(zip(_FIELDS, row)) for name, *row in _ROWS}
Retrieve = Callable[[DataFrame], DataFrame]
Plan = Callable[[DataFrame, int], DataFrame]
Keep = Callable[[DataFrame, str], DataFrame]


def ircot(questions: DataFrame, retrieve: Retrieve, plan: Plan, keep: Keep, iterations: int = ITERATIONS, follow_up: int = FOLLOW_UP) -> tuple[DataFrame, DataFrame]:
    """Interleaved retrieval: (evidence, steps) of all queries.

    questions: query_id, question. retrieve(questions) gives query_id, doc_id,
    rank, score. plan(evidence, iteration) gives query_id, follow_up (null on
    error), enough. A query stops with an error, when it has enough, when it
    repeats a query (ignoring case), when a round finds nothing new, or at the
    bound. keep(df, name) stores a table durably and gives it back.
    """
    first = retrieve(questions).select("query_id", "doc_id", "score", F.lit(0).alias("iteration"))
    evidence = keep(first, "evidence-0")
    asked = keep(questions.select("query_id", F.lower(F.trim("question")).alias("q")), "asked-0")
    live = questions.select("query_id")
    steps = None
    for i in range(1, iterations + 1):
        planned = plan(evidence.join(live, "query_id", "left_semi"), i).join(live, "query_id", "left_semi").withColumn("q", F.lower(F.trim("follow_up")))
        old = asked.select("query_id", "q", F.lit(True).alias("repeated"))
        judged = planned.join(old, ["query_id", "q"], "left").withColumn(
            "stop", F.when(F.col("follow_up").isNull() & ~F.col("enough"), "planner_error").when(F.col("enough"), "enough").when(F.col("repeated"), "repeated_query"))
        judged = keep(judged.select("query_id", "follow_up", "q", "stop"), f"plan-{i}")
        next_ = judged.where("stop is null").select("query_id", F.col("follow_up").alias("question"))
        found = retrieve(next_).where(F.col("rank") <= follow_up).join(evidence.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        found = keep(found.select("query_id", "doc_id", "score", F.lit(i).alias("iteration")), f"found-{i}")
        gained = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_new"))
        step = judged.join(gained, "query_id", "left").select(
            "query_id", F.lit(i).alias("iteration"), "follow_up", F.coalesce("n_new", F.lit(0)).alias("n_new"),
            F.coalesce("stop", F.when(F.coalesce("n_new", F.lit(0)) < 1, "no_new_evidence"), F.when(F.lit(i == iterations), "max_iterations")).alias("termination"))
        step = keep(step, f"step-{i}")
        steps = step if steps is None else steps.unionByName(step)
        evidence = evidence.unionByName(found)  # the rounds' own tables; none is written twice
        asked = asked.unionByName(judged.where("stop is null").select("query_id", "q"))
        live = step.where("termination is null").select("query_id")
        if live.isEmpty():
            break
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "doc_id")
    return evidence.withColumn("rank", F.row_number().over(w)), steps


def agentic(questions: DataFrame, tools: dict[str, Retrieve], plan: Plan, keep: Keep, max_steps: int = AGENT_STEPS, max_retrievals: int = AGENT_RETRIEVALS) -> tuple[DataFrame, DataFrame]:
    """Planner-controlled retrieval: a first search always runs; then each step takes the planned action (query_id, action, argument).

    An unknown action or a planner's null ends a query, as do `stop` and the bounds
    on steps and retrievals. tools has a function for each action allowed; an
    arm without the graph leaves its tools out.
    """
    evidence = keep(tools["semantic_search"](questions).select("query_id", "doc_id", "score", F.lit(0).alias("step")), "agent-evidence-0")
    live = keep(questions.select("query_id", F.lit(1).alias("used")), "agent-live-0")
    steps = None
    for i in range(1, max_steps + 1):
        planned = plan(evidence, i).join(live, "query_id").withColumn(
            "termination", F.when(F.col("action").isNull(), "planner_error").when(~F.col("action").isin("stop", *tools), "invalid_action").when(F.col("action") == "stop", "stop")
            .when((F.col("used") >= max_retrievals) & F.col("action").isin(*RETRIEVING), "max_retrievals").when(F.lit(i == max_steps), "max_steps"))
        planned = keep(planned.select("query_id", "action", "argument", "used", "termination"), f"agent-plan-{i}")
        parts = [tool(planned.where((F.col("action") == name) & F.col("termination").isNull()).select("query_id", F.col("argument").alias("question"))).select("query_id", "doc_id", "score") for name, tool in tools.items()]
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        found = keep(found.dropDuplicates(["query_id", "doc_id"]).join(evidence, ["query_id", "doc_id"], "left_anti").withColumn("step", F.lit(i)), f"agent-found-{i}")
        gained = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_new"))
        step = keep(planned.join(gained, "query_id", "left").select("query_id", F.lit(i).alias("step"), "action", F.coalesce("n_new", F.lit(0)).alias("n_new"), "termination", "used"), f"agent-step-{i}")
        steps = step if steps is None else steps.unionByName(step)
        evidence = evidence.unionByName(found)
        more = F.when(F.col("action").isin(*RETRIEVING), 1).otherwise(0)
        live = step.where("termination is null").select("query_id", (F.col("used") + more).alias("used"))
        if live.isEmpty():
            break
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "doc_id")
    return evidence.withColumn("rank", F.row_number().over(w)), steps.drop("used")


def appended(base: DataFrame, extra: DataFrame, limit: int) -> DataFrame:
    """The base ranking, then at most `limit` chunks of `extra` that it doesn't have, in their order; ranks count on."""
    new = extra.join(base.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    new = new.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    size = base.groupBy("query_id").agg(F.max("rank").alias("size"))
    placed = new.join(size, "query_id", "left").select("query_id", "doc_id", (F.coalesce("size", F.lit(0)) + F.col("n")).alias("rank"))
    return base.select("query_id", "doc_id", "rank").unionByName(placed)


def ranking_name(arm: dict) -> str:
    """Which ranking an arm starts from: its loop, or its mode with or without reranking; of its own chunks where these aren't the usual ones."""
    name = arm["strategy"] + ("_graph" if arm.get("graph") else "") if arm["strategy"] != "plain" else ("rerank_" if arm["rerank"] else "") + arm["mode"]
    return name if arm["chunking"] == "legal" else f"{arm['chunking']}_{name}"


def run_arm(name: str, rankings: dict[str, DataFrame], edges: DataFrame | None = None, chunks: DataFrame | None = None, contradictions: DataFrame | None = None) -> DataFrame:
    """An arm's final chunks: the ranking of its mode (or loop), then graph expansion of its first chunks, then contradicting ones."""
    arm = ARMS[name]
    out = rankings[ranking_name(arm)].where(F.col("rank") <= BASE).select("query_id", "doc_id", "rank")
    if arm.get("graph_expand"):
        first = out.where(F.col("rank") <= GRAPH_SEEDS)
        near = expand(edges, first.select(F.col("doc_id").alias("seed")).distinct(), chunks, limit=GRAPH_CHUNKS)
        extra = first.join(near.select(F.col("seed").alias("doc_id"), F.col("id").alias("to"), F.col("hop")), "doc_id").groupBy("query_id", "to").agg(F.min(F.col("hop") * 100 + F.col("rank")).alias("rank"))
        out = appended(out, extra.select("query_id", F.col("to").alias("doc_id"), "rank"), GRAPH_CHUNKS)
    if arm.get("contradiction"):
        out = appended(out, contradictions, CONTRADICTION_CHUNKS)
    return out


def planner_context(evidence: DataFrame, snippet: int = 400, budget: int = 2600) -> DataFrame:
    """(query_id, context, n_left_out): snippets in rank order within a budget of characters."""
    text = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, snippet)
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = evidence.select("query_id", "rank", text.alias("s")).withColumn("total", F.sum(F.length("s")).over(w))
    inside = F.col("total") <= budget
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("rank", "s")))), lambda x: x["s"]), "\n").alias("context"), F.count_if(~inside).alias("n_left_out"))


DEFAULT_FINAL = FINAL


def contradictions(questions: DataFrame, retrieve: Retrieve, evidence: DataFrame, edges: DataFrame, chunks: DataFrame, limit: int = CONTRADICTION_CHUNKS) -> DataFrame:
    """(query_id, doc_id, rank): a lexical probe with fixed terms of doubt, then cases with adverse edges from the first five pieces of evidence."""
    probe = questions.select("query_id", F.concat("question", F.lit(" " + CONTRADICTION_TERMS)).alias("question"))
    found = retrieve(probe).where(F.col("rank") <= FOLLOW_UP).select("query_id", "doc_id", "rank")
    first = evidence.where(F.col("rank") <= 5).select("query_id", F.col("doc_id").alias("seed"), "rank")
    near = expand(edges, first.select("seed").distinct(), chunks, limit=limit, relations=list(ADVERSE))
    linked = first.join(near.select("seed", F.col("id").alias("doc_id"), F.col("hop")), "seed").groupBy("query_id", "doc_id").agg(F.min(100 + F.col("hop") * 10 + F.col("rank")).alias("rank"))
    both = found.unionByName(linked).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
