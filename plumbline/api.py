"""The service surface as functions over tables: each call is one plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import __version__, report
from plumbline.functions.text import SAFE_ID
from plumbline.operators import diagnosis as D
from plumbline.operators import memory as Y
from plumbline.operators.strategies import ARMS


def health(spark: SparkSession) -> dict:
    return {"status": "ok", "spark": spark.version}


def version() -> dict:
    return {"version": __version__}


def config() -> dict:
    return {"arms": sorted(ARMS)}


def safe_id(value) -> str:
    if not re.match(SAFE_ID, str(value)):
        raise ValueError("not an identifier")
    return str(value)


class Diagnoses:
    """All artifacts of a set of traces; tables are computed once, where they are asked for."""

    def __init__(self, traces: DataFrame, refs: DataFrame, verified: DataFrame):
        self.facts = D.trace_facts(traces, refs, verified)
        self.matrix = D.stage_matrix(self.facts)
        self.causes = D.root_causes(self.matrix)
        self.actions = D.corrective_actions(self.causes, self.facts)
        self.chains = D.reasoning_chain(self.matrix)
        parts = {"grounding": D.grounding()} | {k: F.lit(None).cast("double") for k in ("context_precision", "answer_relevancy", "context_recall")}
        self.rollup = self.facts.withColumn("health", D.weighted_health(parts)).join(self.causes.select("trace_id", F.col("primary_cause").alias("primary_issue")), "trace_id").withColumn("grounding_score", D.grounding())

    def artifacts(self, trace_id) -> dict[str, DataFrame]:
        safe_id(trace_id)
        return {name: getattr(self, name).where(F.col("trace_id") == trace_id) for name in ("facts", "matrix", "causes", "actions", "chains")}

    def report(self, trace_id, kind: str = "markdown") -> str:
        safe_id(trace_id)
        return report.rendered(report.of_trace(self.rollup, self.actions, self.chains, trace_id), kind)


class Sessions:
    """Conversation sessions over a table of memories: session_id, memory_id, question, answer, ts. Every change gives a new table."""

    def __init__(self, memories: DataFrame):
        self.memories = memories

    def list(self) -> DataFrame:
        return Y.sessions(self.memories).orderBy(F.desc("last_activity"), "session_id")

    def messages(self, session_id) -> DataFrame:
        return Y.messages(self.memories.where(F.col("session_id") == session_id))

    def saved(self, new: DataFrame) -> Sessions:
        return Sessions(self.memories.unionByName(new, allowMissingColumns=True))

    def deleted(self, session_id) -> Sessions:
        return Sessions(self.memories.where(F.col("session_id") != session_id))

    def recent(self, limit: int = 30) -> DataFrame:
        """The memory listing without a search: latest first, scores 0."""
        return self.memories.orderBy(F.desc("ts"), "memory_id").limit(limit).withColumn("score", F.lit(0.0))

    def imported(self, other: DataFrame, session_id) -> Sessions:
        """Another table's rows as a new session, with fresh deterministic ids."""
        fresh = other.withColumn("memory_id", F.substring(F.sha2(F.concat_ws(":", F.lit(str(session_id)), F.col("memory_id").cast("string")), 256), 1, 16)).withColumn("session_id", F.lit(session_id))
        return Sessions(self.memories.withColumn("memory_id", F.col("memory_id").cast("string")).unionByName(fresh, allowMissingColumns=True))
