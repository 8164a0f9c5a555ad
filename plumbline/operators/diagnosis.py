"""Stage rules, root causes, corrective actions and report rollups over whole tables of traces.

traces: trace_id, min_distance (nullable), pool_size, config map.
refs: trace_id, chunk_id, parent_id, chunk_index, similarity.
verified: trace_id, claim_id, status, best_chunk_id, ent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Thresholds, stage order, causes and their confidences.
RETRIEVAL_SCORE, CORPUS_DISTANCE, EFFICIENCY = 0.5, 0.75, 0.4
STAGES = ("CORPUS", "RETRIEVER", "CHUNKING", "GENERATOR", "GROUNDING")
CAUSES = ("MISSING_CORPUS", "RETRIEVAL_MISS", "CHUNK_BOUNDARY", "UNSUPPORTED_GENERATION", "GROUNDING_FAILURE")
HEALTH_WEIGHTS = {"grounding": 0.5, "context_precision": 0.2, "answer_relevancy": 0.2, "context_recall": 0.1}
#: Actions for each cause in order: title, category, priority, evidence and success texts with placeholders, and the setting that makes it needless.
ACTIONS = [
    ("MISSING_CORPUS", 1, "Ingest Missing Domain Knowledge", "CORPUS", "immediate", "closest of {pool_size} candidates at distance {min_distance}", None, None),
    ("RETRIEVAL_MISS", 1, "Increase Retrieval Top-K", "RETRIEVAL", "immediate", "max retrieval score {max_score}, threshold {threshold}", None, None),
    ("RETRIEVAL_MISS", 2, "Implement Hybrid Search (Dense + Sparse)", "RETRIEVAL", "short_term", "exact terms fail semantic retrieval", "bm25_enabled", "true"),
    ("RETRIEVAL_MISS", 3, "Deploy Cross-Encoder Reranker", "RETRIEVAL", "experimental", "top chunks share vocabulary, not meaning", "reranker_enabled", "true"),
    ("CHUNK_BOUNDARY", 1, "Increase Chunk Overlap", "CHUNKING", "immediate", "{boundary_claims} partially supported claims at a boundary", None, None),
    ("UNSUPPORTED_GENERATION", 1, "Lower Sampling Temperature", "GENERATION", "immediate", "{unsupported} unsupported claims", "temperature", "0.0"),
    ("UNSUPPORTED_GENERATION", 2, "Strict Prompt Grounding", "GENERATION", "short_term", "answers where the context is irrelevant", None, None),
    ("GROUNDING_FAILURE", 1, "Require Explicit Citations", "GENERATION", "experimental", "{contradicted} contradicted claims", None, None),
]


def boundary_claims(verified: DataFrame, refs: DataFrame) -> DataFrame:
    """(trace_id, claim_id): partially supported claims whose best chunk has a retrieved neighbour in the same document.

    The neighbourhood is two equi-joins, on the index before and the one after.
    """
    placed = refs.where("parent_id is not null and chunk_index is not null")
    partial = verified.where("status = 'PARTIALLY_SUPPORTED' and best_chunk_id is not null").select("trace_id", "claim_id", F.col("best_chunk_id").alias("chunk_id"))
    own = partial.join(placed.select("trace_id", "chunk_id", "parent_id", "chunk_index"), ["trace_id", "chunk_id"])
    beside = own.select("trace_id", "claim_id", "chunk_id", "parent_id", F.explode(F.array(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index"))
    other = placed.select("trace_id", "parent_id", "chunk_index", F.col("chunk_id").alias("other_id"))
    return beside.join(other, ["trace_id", "parent_id", "chunk_index"]).where("other_id <> chunk_id").select("trace_id", "claim_id").distinct()


def trace_facts(traces: DataFrame, refs: DataFrame, verified: DataFrame) -> DataFrame:
    """One row for each trace with all that the stage rules read."""
    is_ = lambda *s: F.col("status").isin(*s)
    claims = verified.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("n_claims"), F.count_if(is_("SUPPORTED")).alias("supported"), F.count_if(is_("PARTIALLY_SUPPORTED")).alias("partial"),
        F.count_if(is_("UNSUPPORTED")).alias("unsupported"), F.count_if(is_("CONTRADICTED")).alias("contradicted"), F.count_if(is_("NOT_VERIFIABLE")).alias("not_verifiable"),
        F.countDistinct(F.when(is_("SUPPORTED", "PARTIALLY_SUPPORTED"), F.col("best_chunk_id"))).alias("chunks_used"), F.countDistinct("best_chunk_id").alias("chunks_cited"))
    chunks = refs.groupBy("trace_id").agg(F.countDistinct("chunk_id").alias("chunks_retrieved"), F.max("similarity").alias("max_score"))
    edges = boundary_claims(verified, refs).groupBy("trace_id").agg(F.count(F.lit(1)).alias("boundary_claims"))
    out = traces.join(claims, "trace_id", "left").join(chunks, "trace_id", "left").join(edges, "trace_id", "left")
    zero = ["n_claims", "supported", "partial", "unsupported", "contradicted", "not_verifiable", "chunks_used", "chunks_cited", "chunks_retrieved", "boundary_claims"]
    return out.fillna(0, zero).fillna(0.0, ["max_score"])


def stage_matrix(facts: DataFrame, min_unsupported_fraction: float | None = None, score_threshold: float = RETRIEVAL_SCORE) -> DataFrame:
    """(trace_id, stage, stage_order, status, confidence) for the stages that have a state; CHUNKING has one only when it fails."""
    c = F.col
    any_support = c("supported") + c("partial") > 0
    all_unsupported = (c("n_claims") > 0) & (c("unsupported") == c("n_claims"))
    some = c("unsupported") > 0
    signal = some if min_unsupported_fraction is None else F.coalesce(c("unsupported") / F.nullif(c("n_claims"), F.lit(0)), F.lit(0.0)) > min_unsupported_fraction

    def state(order: int, *cases: tuple[Column, str, float]) -> Column:
        what, sure = None, None
        for when, s, conf in cases[:-1]:
            what = F.when(when, s) if what is None else what.when(when, s)
            sure = F.when(when, conf) if sure is None else sure.when(when, conf)
        _, s, conf = cases[-1]
        what, sure = (what.otherwise(s), sure.otherwise(conf)) if what is not None else (F.lit(s), F.lit(conf))
        return F.struct(F.lit(STAGES[order - 1]).alias("stage"), F.lit(order).alias("stage_order"), what.alias("status"), sure.alias("confidence"))

    end = F.lit(True)
    states = F.array(
        state(1, (c("min_distance").isNull(), "UNKNOWN", 1.0), (c("min_distance") > CORPUS_DISTANCE, "FAIL", 0.85), (any_support, "PASS", 0.9), (end, "UNKNOWN", 0.5)),
        state(2, (any_support, "PASS", 0.95), (all_unsupported & (c("max_score") < score_threshold), "FAIL", 0.85), (end, "UNKNOWN", 0.5)),
        F.when(c("boundary_claims") > 0, state(3, (end, "FAIL", 0.8))),
        state(4, ((c("n_claims") == 0) | (c("not_verifiable") == c("n_claims")), "UNKNOWN", 0.5), (signal & (c("max_score") >= score_threshold), "FAIL", 0.85), (some, "UNKNOWN", 0.5), (end, "PASS", 0.95)),
        state(5, (c("contradicted") > 0, "FAIL", 0.95), (c("n_claims") == 0, "UNKNOWN", 0.5), (end, "PASS", 0.9)))
    return facts.select("trace_id", F.explode(F.filter(states, lambda s: s.isNotNull())).alias("s")).select("trace_id", "s.*")


def cause_of(stage: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in zip(STAGES, CAUSES) for x in pair]), stage)


def root_causes(matrix: DataFrame) -> DataFrame:
    """Earliest failing stage in causal order; the others are secondary effects; confidence is the mean over stages that passed or failed."""
    fails = F.array_sort(F.collect_list(F.when(F.col("status") == "FAIL", F.struct("stage_order", cause_of(F.col("stage")).alias("cause")))))
    known = F.avg(F.when(F.col("status") != "UNKNOWN", F.col("confidence")))
    out = matrix.groupBy("trace_id").agg(fails.alias("f"), F.round(F.coalesce(known, F.lit(0.0)), 2).alias("confidence"))
    names = F.transform("f", lambda x: x["cause"])
    return out.select("trace_id", F.coalesce(F.get(names, F.lit(0)), F.lit("UNKNOWN")).alias("primary_cause"),
                      F.when(F.size("f") > 1, F.slice(names, 2, 5)).otherwise(F.array().cast("array<string>")).alias("secondary_effects"), "confidence", (F.size("f") > 0).alias("recommendations_needed"))


def reasoning_chain(matrix: DataFrame) -> DataFrame:
    """(trace_id, chain): a line for each stage in causal order, absent stages included."""
    rows = matrix.groupBy("trace_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", F.struct("status", "confidence").alias("v")))).alias("m"))
    def line(stage: str, cause: str) -> Column:
        s = F.element_at("m", stage)
        sure = F.format_string("%.2f", s["confidence"])
        return (F.when(s.isNull(), f"Skipping {stage}: no observable state.").when(s["status"] == "UNKNOWN", f"Skipping {stage}: insufficient evidence.")
                .when(s["status"] == "FAIL", F.concat(F.lit(f"Failure at {stage}: {cause} (confidence="), sure, F.lit(")."))).otherwise(F.concat(F.lit(f"{stage} passed (confidence="), sure, F.lit(")."))))
    return rows.select("trace_id", F.array(*[line(s, c) for s, c in zip(STAGES, CAUSES)]).alias("chain"))


def most_confident_cause(matrix: DataFrame) -> DataFrame:
    """The baseline: the failing stage with the highest confidence, the earliest on ties."""
    best = F.max_by("stage", F.struct("confidence", -F.col("stage_order")))
    return matrix.select("trace_id").distinct().join(matrix.where("status = 'FAIL'").groupBy("trace_id").agg(cause_of(best).alias("cause")), "trace_id", "left").select(
        "trace_id", F.coalesce("cause", F.lit("UNKNOWN")).alias("ranked_cause"))


def threshold_attribution(context: Column, hallucination: Column, faithfulness: Column) -> Column:
    """Rules over evaluator scores, NaN read as missing: low context, then hallucination, then low faithfulness; null without scores."""
    ok = lambda x: F.when(~F.isnan(x), x)
    c, h, f = ok(context), ok(hallucination), ok(faithfulness)
    return (F.when(c.isNull() & h.isNull() & f.isNull(), None).when(c < 0.5, "RETRIEVAL_MISS").when(h > 0.5, "GROUNDING_FAILURE").when(f < 0.7, "UNSUPPORTED_GENERATION").otherwise("UNKNOWN"))


def action_table(spark: SparkSession) -> DataFrame:
    """The actions as a dimension of eight rows."""
    return spark.createDataFrame(ACTIONS, "cause string, action_order int, title string, category string, priority string, evidence string, guard_key string, guard_value string")


def corrective_actions(causes: DataFrame, facts: DataFrame) -> DataFrame:
    """Actions for the primary and secondary causes in order, without those that the trace's settings already have."""
    from plumbline.functions.text import interpolated

    listed = causes.select("trace_id", F.posexplode(F.array_distinct(F.concat(F.array("primary_cause"), "secondary_effects"))).alias("cause_order", "cause"))
    actions = F.broadcast(action_table(causes.sparkSession))  # eight rows
    number = lambda name: F.format_string("%.3f", F.col(name))
    rows = listed.join(actions, "cause").join(facts.select("trace_id", "config", "pool_size", "min_distance", "max_score", "boundary_claims", "unsupported", "contradicted"), "trace_id")
    rows = rows.where(F.col("guard_key").isNull() | (F.element_at("config", F.coalesce("guard_key", F.lit(""))) != F.col("guard_value")) | F.element_at("config", F.coalesce("guard_key", F.lit(""))).isNull())
    text = interpolated(F.col("evidence"), {
        "pool_size": F.col("pool_size").cast("string"), "min_distance": number("min_distance"), "max_score": number("max_score"), "threshold": F.lit(f"{RETRIEVAL_SCORE:.3f}"),
        "boundary_claims": F.col("boundary_claims").cast("string"), "unsupported": F.col("unsupported").cast("string"), "contradicted": F.col("contradicted").cast("string")})
    return rows.select("trace_id", "cause_order", "action_order", "cause", "title", "category", "priority", text.alias("evidence"))


def efficiency_advisories(facts: DataFrame) -> DataFrame:
    """Traces that use few of the chunks they retrieve."""
    rate = F.col("chunks_used") / F.nullif(F.col("chunks_retrieved"), F.lit(0))
    return facts.select("trace_id", "chunks_used", "chunks_retrieved", F.round(rate, 6).alias("chunk_utilization")).where(rate < EFFICIENCY)


def grounding() -> Column:
    return (F.col("supported") + 0.5 * F.col("partial")) / F.nullif(F.col("n_claims"), F.lit(0))


def weighted_health(parts: dict[str, Column]) -> Column:
    """Weighted mean of the parts that are there, 0 if none is."""
    total = sum((F.coalesce(parts[k] * w, F.lit(0.0)) for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(parts[k].isNotNull(), w).otherwise(0.0) for k, w in HEALTH_WEIGHTS.items()), F.lit(0.0))
    return F.round(F.coalesce(total / F.nullif(weight, F.lit(0.0)), F.lit(0.0)), 4)


def advice(health: Column) -> Column:
    return F.when(health > 0.8, "healthy").when(health > 0.5, "improve").otherwise("inspect")


def report_status(present: list[Column], required: int) -> Column:
    """COMPLETED with every artifact, PARTIAL with the first `required`, else FAILED."""
    some = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in present), F.lit(0))
    first = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in present[:required]), F.lit(0))
    return F.when(some == len(present), "COMPLETED").when(first == required, "PARTIAL").otherwise("FAILED")


def consistency(causes: DataFrame, matrix: DataFrame) -> DataFrame:
    """Whether the primary cause's stage failed, and whether every failing stage is named."""
    fails = matrix.where("status = 'FAIL'").groupBy("trace_id").agg(F.collect_set(cause_of(F.col("stage"))).alias("failed"))
    named = F.concat(F.array("primary_cause"), "secondary_effects")
    rows = causes.join(fails, "trace_id", "left").withColumn("failed", F.coalesce("failed", F.array().cast("array<string>")))
    return rows.select("trace_id", ((F.col("primary_cause") == "UNKNOWN") & (F.size("failed") == 0) | F.array_contains("failed", F.col("primary_cause"))).alias("primary_failed"),
                       (F.size(F.array_except("failed", named)) == 0).alias("all_named"))
