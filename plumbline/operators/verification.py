"""Claims against evidence: scores, status, strategies and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import CLAIM_STOP, GROUNDED_STOP, content_words, long_fragments, matches

# Thresholds of the status rule and of the lexical measures.
ENTAIL, CONTRA, PARTIAL, NEUTRAL = 0.7, 0.7, 0.4, 0.8
LEXICAL_SUPPORT, GROUNDED, METRIC_ENTAIL = 0.55, 0.45, 0.5
STATUSES = ("SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED", "CONTRADICTED", "NOT_VERIFIABLE")
#: Whole words of Unicode letters; what \b takes for a letter differs between versions of Java and between engines. A search may begin
#: at the second half of a surrogate pair, and a lookbehind sees no more than that; it is no character of its own.
NEGATION = r"(?:^|[^\p{L}\p{N}_\p{Cs}])(?:not|no|never|none|cannot)(?![\p{L}\p{N}_])"
STRATEGIES = ("top1", "max_pool_top3", "concat_top3")


def lexical_support(claim: Column, context: Column) -> Column:
    """Share of the claim's distinct content words found in the context; 0 without words."""
    words = F.array_distinct(content_words(claim))
    return F.coalesce(F.size(F.array_intersect(words, content_words(context))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def lexical_scores(claim: Column, sentence: Column) -> Column:
    """(ent, contra, neutral) by the default provider: support, which counts against the claim where only one side is negated."""
    support = lexical_support(claim, sentence)
    differs = claim.rlike(f"(?i){NEGATION}") != sentence.rlike(f"(?i){NEGATION}")
    ent, contra = F.when(differs, 0.0).otherwise(support), F.when(differs, support).otherwise(0.0)
    return F.struct(ent.alias("ent"), contra.alias("contra"), F.greatest(F.lit(0.0), 1 - ent - contra).alias("neutral"))


def described(text: Column) -> Column:
    """(words, negated): what lexical scores take of a claim or a sentence, found once for each."""
    return F.struct(F.array_distinct(content_words(text)).alias("words"), text.rlike(f"(?i){NEGATION}").alias("negated"))


def described_scores(claim: Column, sentence: Column) -> Column:
    """lexical_scores() of a claim and a sentence as described() gives them."""
    support = F.coalesce(F.size(F.array_intersect(claim["words"], sentence["words"])) / F.nullif(F.size(claim["words"]), F.lit(0)), F.lit(0.0))
    differs = claim["negated"] != sentence["negated"]
    ent, contra = F.when(differs, 0.0).otherwise(support), F.when(differs, support).otherwise(0.0)
    return F.struct(ent.alias("ent"), contra.alias("contra"), F.greatest(F.lit(0.0), 1 - ent - contra).alias("neutral"))


def status(ent: Column, contra: Column, neutral: Column) -> Column:
    """The ordered status rule; a claim without evidence (null scores) is unsupported."""
    return (F.when(ent.isNull(), "UNSUPPORTED").when(contra >= CONTRA, "CONTRADICTED").when(ent >= ENTAIL, "SUPPORTED").when(ent >= PARTIAL, "PARTIALLY_SUPPORTED")
            .when(neutral >= NEUTRAL, "UNSUPPORTED").otherwise("NOT_VERIFIABLE"))


def confidence(ent: Column, contra: Column) -> Column:
    return F.coalesce(F.greatest(ent, contra), F.lit(0.0))


def top_evidence(evidence: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """Best sentences of each claim by entailment; rows have chunk_rank and sentence_no for ties."""
    w = Window.partitionBy(*keys).orderBy(F.round("ent", 6).desc(), "chunk_rank", "sentence_no")
    return evidence.withColumn("evidence_rank", F.row_number().over(w)).where(F.col("evidence_rank") <= limit)


def pooled(top: DataFrame, keys: list[str], strategy: str = "top1") -> DataFrame:
    """Scores of each claim under a strategy; concat_top3 needs a second scoring of the joined sentences and gives their text."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {STRATEGIES}")
    best = lambda c: F.min_by(c, "evidence_rank").alias(c)
    if strategy == "top1":
        return top.groupBy(*keys).agg(best("ent"), best("contra"), best("neutral"))
    if strategy == "max_pool_top3":
        strongest = F.max_by(F.struct("ent", "contra", "neutral"), F.struct(F.greatest("ent", "contra"), -F.col("evidence_rank")))
        return top.groupBy(*keys).agg(strongest.alias("s")).select(*keys, "s.*")
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("evidence_rank", "sentence"))), lambda x: x["sentence"]), " ").alias("sentence"))


def independent_maxima(top: DataFrame, keys: list[str]) -> DataFrame:
    """The other reading of max_pool_top3: each score's own maximum."""
    return top.groupBy(*keys).agg(F.max("ent").alias("ent"), F.max("contra").alias("contra"), F.max("neutral").alias("neutral"))


def summary(verified: DataFrame, key: str = "trace_id") -> DataFrame:
    """Counts by status and mean entailment of each trace."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return verified.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), is_("SUPPORTED").alias("supported"), is_("PARTIALLY_SUPPORTED").alias("partial"), is_("UNSUPPORTED").alias("unsupported"),
        is_("CONTRADICTED").alias("contradicted"), is_("NOT_VERIFIABLE").alias("not_verifiable"), F.round(F.avg("ent"), 6).alias("mean_entailment"))


def unrecoverable(status_: Column, missing: Column) -> Column:
    """UNSUPPORTED becomes NOT_VERIFIABLE where evidence can't be recovered."""
    return F.when(missing & (status_ == "UNSUPPORTED"), "NOT_VERIFIABLE").otherwise(status_)


def escalated(status_: Column, judged: Column) -> Column:
    """A judge's status for undecided claims, if it gave a known one."""
    return F.when(status_.isin("PARTIALLY_SUPPORTED", "NOT_VERIFIABLE") & judged.isin(*STATUSES), judged).otherwise(status_)


def groundedness(answer: Column, context: Column) -> Column:
    """Share of long fragments with enough of their long words inside the context as substrings; null without fragments."""
    c = F.lower(context)

    def grounded(s: Column) -> Column:
        words = F.filter(matches(s, r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_]{4,}"), lambda w: ~w.isin(GROUNDED_STOP))
        return (F.size(words) > 0) & (F.size(F.filter(words, lambda w: c.contains(w))) / F.greatest(F.size(words), F.lit(1)) >= GROUNDED)

    parts = long_fragments(F.lower(answer))
    each = F.transform(F.array(parts), lambda p: F.round(F.size(F.filter(p, grounded)) / F.nullif(F.size(p), F.lit(0)), 4))
    return F.get(each, F.lit(0))


def distinct_claims(claims: DataFrame, key: str = "trace_id", text: str = "claim", order: str = "claim_no") -> DataFrame:
    """The first of the claims of a trace that differ only in case and outer blanks."""
    w = Window.partitionBy(key, F.lower(F.trim(text))).orderBy(order)
    return claims.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


__all__ = [n for n in globals() if not n.startswith("_")] + ["CLAIM_STOP"]
