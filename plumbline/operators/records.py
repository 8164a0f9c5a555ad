"""Records of chunks, costs and panels: running numbers, system metrics, gold chunks, label mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import written

#: Statuses that count as right for each external label (fixed values).
ACCEPTED = {"SUPPORTS": ["SUPPORTED"], "REFUTES": ["CONTRADICTED"], "NOT ENOUGH INFO": ["PARTIALLY_SUPPORTED", "UNSUPPORTED", "NOT_VERIFIABLE"]}
#: Sections that state what a case decided, in order (fixed values).
DECISIVE = ["headnote", "held", "issue"]
CHARS_A_TOKEN = 4


def numbered(df: DataFrame, order: list[str], name: str = "chunk_index") -> DataFrame:
    """A running number from 0 over all rows in order, without one task that sees them all.

    Rows are dealt to ranges; each range counts its own, and starts at the
    sum of the ranges before it. `order` must be unique.
    """
    parts = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")  # both readers see the same ranges
    own = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_s"))
    before = sizes.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row for each range
    return own.join(F.broadcast(before), "_p").withColumn(name, F.col("_b") + F.col("_i") - 1).drop("_p", "_i", "_b")


def chunk_records(nodes: DataFrame, size: int, overlap: int) -> DataFrame:
    """Registry records of chunk nodes (doc_id, ordinal, text, source_file, page): running index over all nodes, sizes, and unknowns spelled out."""
    rows = numbered(nodes, ["doc_id", "ordinal"])
    return rows.select(
        F.substring(F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("ordinal").cast("string")), 256), 1, 32).alias("chunk_id"), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")).alias("parent_document_id"),
        F.coalesce("source_file", F.lit("unknown")).alias("source_file"), F.coalesce("page", F.lit("unknown")).alias("page_number"), F.col("chunk_index").cast("int").alias("chunk_index"),
        F.lit(size).alias("configured_chunk_size"), F.lit(overlap).alias("configured_chunk_overlap"), F.length("text").alias("text_length"), "text")


def system_metrics(traces: DataFrame, chunks: DataFrame, key: str = "trace_id") -> DataFrame:
    """What each answer cost. traces: key, answer, retrieval_s, generation_s, verification_ms, planner_calls, retrieval_calls; chunks: key, text."""
    context = chunks.groupBy(key).agg(F.sum(F.length("text")).alias("context_chars"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return traces.join(context, key, "left").select(
        key, F.round(z("retrieval_s") + z("generation_s"), 3).alias("total_latency_s"), F.round(z("verification_ms") / 1000.0, 3).alias("verification_latency_s"), (z("planner_calls") + 1).alias("llm_calls"),
        F.greatest(z("retrieval_calls"), F.lit(1)).alias("retrieval_calls"), F.floor(F.length(F.coalesce("answer", F.lit(""))) / CHARS_A_TOKEN).alias("answer_tokens_estimate"), z("context_chars").alias("context_chars"))


def best_chunks(chunks: DataFrame) -> DataFrame:
    """Gold chunks of each document: those of the decisive sections in order, six at most, else its first three. chunks: doc_id, section, ordinal, chunk_id."""
    place = F.array_position(F.array(*[F.lit(s) for s in DECISIVE]), F.col("section"))
    rows = chunks.withColumn("_s", F.when(place > 0, place)).withColumn("_any", F.max("_s").over(Window.partitionBy("doc_id")).isNotNull())
    rows = rows.where(F.col("_s").isNotNull() | ~F.col("_any"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.coalesce("_s", F.lit(0)), "ordinal"))
    return rows.withColumn("rank", n).where(F.col("rank") <= F.when(F.col("_any"), 6).otherwise(3)).select("doc_id", "rank", "chunk_id")


def mapped_accuracy(rows: DataFrame, label: str, status: str) -> DataFrame:
    """Accuracy by external label, a status counting as right if the label accepts it."""
    ok = F.lit(False)
    for name, accepted in ACCEPTED.items():
        ok = F.when(F.col(label) == name, F.col(status).isin(*accepted)).otherwise(ok)
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok.cast("int")), 6).alias("accuracy"))


def speedups(rows: DataFrame, own: str, others: list[str], usable: str | None = None) -> DataFrame:
    """Mean latencies, and how many times longer each other system takes; rows without a usable score are counted apart, not pooled."""
    mean = F.avg(own)
    out = [F.round(mean, 4).alias(own)] + [F.round(F.avg(o), 4).alias(o) for o in others] + [F.round(F.avg(o) / F.nullif(mean, F.lit(0.0)), 4).alias(f"{o}_speedup") for o in others]
    if usable:
        out += [F.count_if(usable).alias("n_usable"), F.count_if(~F.col(usable)).alias("n_failed")]
    return rows.agg(*out)


def metric_panel(summary: DataFrame, recall: DataFrame, key: str = "trace_id") -> DataFrame:
    """Faithfulness, precision, hallucination, recall and F1 of each trace; null is "not computed" and never 0. recall: key, claim_recall."""
    from plumbline.operators.metrics import f1

    n = F.nullif(F.col("total"), F.lit(0))
    rows = summary.join(recall, key, "left").select(
        key, F.round(F.col("supported") / n, 4).alias("precision"), F.round((F.col("unsupported") + F.col("contradicted")) / n, 4).alias("hallucination"), F.round("claim_recall", 4).alias("recall"))
    return rows.select(key, F.col("precision").alias("faithfulness"), "precision", "hallucination", "recall", f1(F.col("precision"), F.col("recall")).alias("f1"))


def gold_recall(statuses: DataFrame, key: str = "trace_id") -> DataFrame:
    """claim_recall of each trace: gold claims that the answer supports, at least in part; 0 without any."""
    return statuses.groupBy(key).agg(F.round(F.coalesce(F.avg(F.col("status").isin("SUPPORTED", "PARTIALLY_SUPPORTED").cast("int")), F.lit(0.0)), 4).alias("claim_recall"))


def answer_relevancy(pairs: DataFrame, key: str = "trace_id") -> DataFrame:
    """Mean cosine of a question and the questions generated from its answer. pairs: key, question_vector, generated_vector."""
    from plumbline.operators.retrieval import cosine

    return pairs.groupBy(key).agg(F.round(F.avg(cosine(F.col("question_vector"), F.col("generated_vector"))), 4).alias("answer_relevancy"))


def source_url(base: Column, path: Column) -> Column:
    """The public address of a mirrored file: base/data/pdf/year=Y/(english | court=C)/name."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    name, year = F.element_at(parts, -1), F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    court = F.coalesce(F.get(F.filter(parts, lambda p: p.startswith("hc_")), F.lit(0)), F.lit(""))
    tail = F.when(path.contains("supreme_court"), F.lit("english")).otherwise(F.concat(F.lit("court="), F.regexp_replace(court, "hc_", "")))
    return F.concat(base, F.lit("/data/pdf/year="), year, F.lit("/"), tail, F.lit("/"), name)


def turn_events(turns: DataFrame, tokens: DataFrame) -> DataFrame:
    """The event stream of each turn as rows in a fixed order: stages, memory, meta, chunks, tokens, evaluation, end. turns: turn_id, n_memories, n_chunks, error; tokens: turn_id, place, token."""
    kinds = [(0, "stage", F.lit("memory")), (1, "memory", F.col("n_memories").cast("string")), (2, "stage", F.lit("retrieval")), (3, "meta", F.lit("{}")), (4, "chunks", F.col("n_chunks").cast("string")), (5, "stage", F.lit("generation")), (7, "evaluation", F.lit("{}"))]
    fixed = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(0).alias("place"), F.lit(k).alias("event"), v.alias("data")) for p, k, v in kinds], F.struct(F.lit(8).alias("phase"), F.lit(0).alias("place"), F.when(F.col("error").isNull(), "done").otherwise("error").alias("event"), F.coalesce("error", F.lit("")).alias("data")))
    rows = turns.select("turn_id", F.explode(fixed).alias("e")).select("turn_id", "e.*")
    return rows.unionByName(tokens.select("turn_id", F.lit(6).alias("phase"), F.col("place").cast("int").alias("place"), F.lit("token").alias("event"), F.col("token").alias("data")))
