"""Interfaces for models: each is one batch function over columns, with a deterministic default.

A model-backed provider subclasses one of these and returns a pandas-UDF
column (Arrow batches, the model loaded once in each worker); the defaults are
plain expressions, so that every query runs without a model.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import claims, keyword_query, lexical_tokens, simple_sentences
from plumbline.operators.retrieval import overlap_score
from plumbline.operators.verification import lexical_scores


class EmbeddingProvider:
    """Text to a vector of `size` numbers: hashed words with signs, of unit length."""

    size = 64

    def embed(self, text: Column) -> Column:
        h = lambda w: F.xxhash64(w)
        words = lexical_tokens(text)
        raw = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: F.lit(0.0))
        summed = F.aggregate(words, raw, lambda a, w: F.transform(a, lambda x, i: x + F.when(F.pmod(h(w), F.lit(self.size)) == i, F.when(h(w) < 0, -1.0).otherwise(1.0)).otherwise(0.0)))
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        each = F.transform(F.array(summed), lambda v: F.transform(v, lambda x: F.coalesce(x / F.nullif(norm(v), F.lit(0.0)), F.lit(0.0))))
        return F.get(each, F.lit(0))


class RerankProvider:
    def score(self, question: Column, text: Column) -> Column:
        return overlap_score(question, text)


class NliProvider:
    """(ent, contra, neutral) of a claim against a sentence."""

    def score(self, claim: Column, sentence: Column) -> Column:
        return lexical_scores(claim, sentence)


class PlannerProvider:
    """The next query of an iterative strategy; null when there is nothing to ask."""

    def follow_up(self, question: Column, evidence: Column) -> Column:
        missing = F.array_except(lexical_tokens(question), lexical_tokens(evidence))
        return F.nullif(F.array_join(missing, " "), F.lit(""))


class GeneratorProvider:
    """Answers, claims, rewrites and summaries, extractively."""

    def answer(self, question: Column, context: Column) -> Column:
        """The sentence of the context that has the most of the question's words."""
        scored = F.transform(simple_sentences(context), lambda s: F.struct(overlap_score(question, s).alias("o"), s.alias("s")))
        return F.coalesce(F.array_max(scored)["s"], F.lit(""))

    def decompose(self, answer: Column) -> Column:
        return claims(answer)

    def condense(self, question: Column) -> Column:
        return keyword_query(question)
