"""Deterministic fault injection: ground truth by construction, for whole plans of cases at once.

Every draw is a SHA-256 of (seed, purpose, case, item), so that any engine makes the same cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.diagnosis import CAUSES

SEED = 20260801
FAULTS = ("corpus", "rank", "boundary", "dilution", "contradiction")
N_CHUNKS, N_CLAIMS = 6, 6


def uniform(purpose: str, *parts: Column) -> Column:
    """A number in [0, 1) from 8 hex digits of the hash."""
    text = F.concat_ws(":", F.lit(str(SEED)), F.lit(purpose), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def normal(purpose: str, *parts: Column) -> Column:
    """A standard normal number from two uniform ones."""
    u, v = uniform(purpose + ":u", *parts), uniform(purpose + ":v", *parts)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)


def pareto(shape: float, purpose: str, *parts: Column) -> Column:
    """A Pareto number of at least one."""
    return F.pow(1 - uniform(purpose, *parts), F.lit(-1.0 / shape))


def cases(traces: DataFrame, sizes: tuple[int, ...] = (0, 1, 2, 3, 4, 5)) -> DataFrame:
    """case_id, mask, n_faults, repeat, near_threshold: each trace (case_id, whole numbers from 0) with one of the subsets of the five faults of the sizes given, in turn."""
    masks = [m for m in range(1 << len(FAULTS)) if m.bit_count() in sizes]
    case = F.col("case_id")
    rows = traces.select("case_id", F.get(F.array(*map(F.lit, masks)), F.pmod(case, F.lit(len(masks))).cast("int")).alias("mask"), F.floor(case / len(masks)).alias("repeat"))
    return rows.withColumn("n_faults", F.bit_count("mask")).withColumn("near_threshold", F.col("repeat") % 4 == 3)


def has(fault: str) -> Column:
    return F.col("mask").bitwiseAND(F.lit(1 << FAULTS.index(fault))) != 0


def expected_cause() -> Column:
    """The cause of the shallowest fault; UNKNOWN for a healthy case."""
    out = None
    for f, c in zip(FAULTS, CAUSES):
        out = F.when(has(f), c) if out is None else out.when(has(f), c)
    return out.otherwise("UNKNOWN")


def injected(plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(traces, refs, verified) of the cases: healthy ones first, then each fault changes what it is about.

    corpus: distances beyond the threshold. rank: low scores and all claims
    unsupported. boundary: a partial claim whose best chunk has a neighbour.
    dilution: an unsupported claim under high scores. contradiction: a
    contradicted claim. rank outweighs the others' claims, as upstream faults do.
    """
    edge = F.when(F.col("near_threshold"), 0.02).otherwise(0.2)
    u = lambda p, *x: uniform(p, F.col("case_id"), *x)
    traces = plan.select(
        F.col("case_id").alias("trace_id"), "mask", "n_faults", "near_threshold", expected_cause().alias("expected_cause"), F.lit(40).alias("pool_size"),
        F.round(F.when(has("corpus"), 0.75 + edge * (0.1 + 0.9 * u("far"))).otherwise(0.2 + 0.3 * u("near")), 6).alias("min_distance"),
        F.create_map(F.lit("bm25_enabled"), F.lit("true"), F.lit("temperature"), F.lit("0.2")).alias("config"))
    chunk = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_CHUNKS - 1))).alias("i"))
    refs = chunk.select(
        F.col("case_id").alias("trace_id"), F.concat_ws("_", F.col("case_id").cast("string"), F.col("i").cast("string")).alias("chunk_id"),
        F.concat(F.lit("d"), F.when(F.col("i") < 2, 0).otherwise(F.col("i")).cast("string")).alias("parent_id"),
        F.when((F.col("i") == 1) & has("boundary"), 1).otherwise(F.col("i") * 10).alias("chunk_index"),
        F.round(F.when(has("rank"), 0.5 - edge * (0.1 + 0.9 * u("low", F.col("i")))).otherwise(0.6 + 0.35 * u("high", F.col("i"))), 6).alias("similarity"))
    claim = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(N_CLAIMS - 1))).alias("i"))
    status = (F.when(has("contradiction") & (F.col("i") == 3), "CONTRADICTED").when(has("rank"), "UNSUPPORTED").when(has("boundary") & (F.col("i") == 1), "PARTIALLY_SUPPORTED")
              .when(has("dilution") & (F.col("i") == 2), "UNSUPPORTED").otherwise("SUPPORTED"))
    verified = claim.select(
        F.col("case_id").alias("trace_id"), F.col("i").alias("claim_id"), status.alias("status"),
        F.concat_ws("_", F.col("case_id").cast("string"), F.when(status == "PARTIALLY_SUPPORTED", 0).otherwise(F.col("i")).cast("string")).alias("best_chunk_id"),
        F.round(F.when(status == "SUPPORTED", 0.7 + 0.3 * u("ent", F.col("i"))).when(status == "PARTIALLY_SUPPORTED", 0.4 + 0.3 * u("ent", F.col("i"))).otherwise(0.4 * u("ent", F.col("i"))), 6).alias("ent"))
    return traces, refs, verified


def depth_sweep(refs: DataFrame, verified: DataFrame, depths: tuple[int, ...] = (0, 1, 2, 3, 4, 5, 8, 12)) -> tuple[DataFrame, DataFrame]:
    """Neutral chunks appended to every trace at each depth: refs and verified with trace_id = trace_id * 100 + depth."""
    grid = F.explode(F.array(*[F.lit(d) for d in depths])).alias("depth")
    key = (F.col("trace_id") * 100 + F.col("depth")).alias("trace_id")
    old = refs.select("*", grid).select(key, "depth", "chunk_id", "parent_id", "chunk_index", "similarity")
    spare = refs.select("trace_id").distinct().select("*", grid).where("depth > 0").select("trace_id", "depth", F.explode(F.sequence(F.lit(1), F.col("depth"))).alias("j"))
    new = spare.select(key, "depth", F.concat(F.lit("neutral_"), F.col("j").cast("string")).alias("chunk_id"), F.lit("neutral").alias("parent_id"), (F.col("j") * 10).alias("chunk_index"), F.lit(0.3).alias("similarity"))
    return old.unionByName(new), verified.select("*", grid).select(key, "depth", "claim_id", "status", "best_chunk_id", "ent")
