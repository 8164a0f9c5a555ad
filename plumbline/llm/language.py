"""Language identification with language-bitmask n-gram filters.

A Bloom filter is kept for each language, all of the same size and hashes, and
stored bit-sliced: slot i holds bit i of every language's filter. Reading an
n-gram's slots and taking their conjunction gives every language that may hold
the n-gram at once. A text's n-grams are counted for each language, the
expected number of false positives is taken off, and the largest count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.session import ship

SLOT_BITS = 19
HASHES = 3
ORDERS = (2, 3, 4)
#: Training rows of each language at most, about.
FIT_ROWS_A_LANGUAGE = 2_500
#: An n-gram belongs to a language if it is in this share of its training texts, and in two of them at least.
LEAST_SHARE = 0.01
_TOGETHER = 400_000
UNKNOWN = "und"
#: Odd multipliers (any will do).
_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, other than letters as 0, each text followed by a 0; and the ends."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in lower])
    return np.where(_letters()[np.minimum(codes, 0x10FFFF)], codes, 0).astype(np.uint64), ends


def _grams(codes: np.ndarray, order: int) -> np.ndarray:
    """A hash of the n-gram that ends at each place (0 where it holds a 0 inside, so that n-grams stay in a word and its edges)."""
    n = len(codes)
    h = np.zeros(n, np.uint64)
    if n < order:
        return h
    last = n - order + 1
    acc = codes[:last] + np.uint64(order)
    good = codes[1 : 1 + last] != 0 if order > 1 else codes[:last] != 0
    for k in range(1, order):
        acc = (acc * _MULTIPLIERS[3]) ^ codes[k : k + last]
        if 0 < k < order - 1:
            good &= codes[k : k + last] != 0
    if order == 2:
        good = (codes[:last] != 0) | (codes[1:] != 0)
    h[order - 1 :] = np.where(good, acc | np.uint64(1), np.uint64(0))
    return h


def _slots(grams: np.ndarray, k: int) -> np.ndarray:
    return ((grams * _MULTIPLIERS[k]) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Filters:
    """languages in order; slots[i, L // 64] has bit L % 64 set if bit i of language L's filter is."""

    languages: list[str]
    slots: np.ndarray

    def false_rates(self) -> np.ndarray:
        """How often each filter says yes to an n-gram that it doesn't hold."""
        fill = [float(((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(self.languages))]
        return np.array(fill) ** HASHES

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        false = self.false_rates()
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and (not held or size + len(texts[at] or "") <= _TOGETHER):
                held.append(texts[at] or "")
                size += len(held[-1])
                at += 1
            got = self._counts(held)
            lettered, hits, total = got
            if not self.languages:
                names += [UNKNOWN] * len(held)
                scores += [0.0] * len(held)
                continue
            true = np.maximum(0, (hits - total[:, None] * false) / np.maximum(1e-9, 1 - false))
            best = true.argmax(axis=1)
            top = true[np.arange(len(held)), best]
            share = np.where(top > 0, top / np.maximum(1e-9, np.sum(np.sort(true, axis=1)[:, -2:], axis=1)), 1 / len(self.languages))
            for b, s, ok in zip(best, share, lettered):
                names.append(self.languages[b] if ok else UNKNOWN)
                scores.append(float(min(1.0, s)) if ok else 0.0)
        return names, scores

    def _counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: whether it has a letter, how many n-grams each language holds, and how many there are.

        A text longer than _TOGETHER is read in overlapping pieces, so that the arrays stay small.
        """
        L = max(1, len(self.languages))
        hits, total = np.zeros((len(texts), L)), np.zeros(len(texts))
        lettered = np.zeros(len(texts), bool)
        pieces = [(i, t[max(0, k - max(ORDERS) + 1) : k + _TOGETHER], min(k, max(ORDERS) - 1)) for i, t in enumerate(texts) for k in range(0, max(1, len(t)), _TOGETHER)]
        groups, size = [[]], 0
        for p in pieces:
            if size and size + len(p[1]) > 2 * _TOGETHER:
                groups.append([])
                size = 0
            groups[-1].append(p)
            size += len(p[1])
        for group in groups:
            codes, ends = _codes([p[1] for p in group])
            starts = np.r_[0, ends[:-1]]
            of = np.array([p[0] for p in group])
            np.logical_or.at(lettered, of, np.logical_or.reduceat(codes != 0, starts))
            fresh = np.ones(len(codes), bool)
            for s, p in zip(starts, group):
                fresh[s : s + p[2]] = False
            for order in ORDERS:
                grams = _grams(codes, order)
                real = (grams != 0) & fresh
                masks = self.slots[_slots(grams, 0)]
                for k in range(1, HASHES):
                    masks = masks & self.slots[_slots(grams, k)]
                masks[~real] = 0
                np.add.at(total, of, np.add.reduceat(real.astype(np.int32), starts))
                for i in range(len(self.languages)):
                    np.add.at(hits[:, i], of, np.add.reduceat(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int32), starts))
        return lettered, hits, total


def fit_filters(docs: DataFrame, rows: int = FIT_ROWS_A_LANGUAGE) -> Filters:
    """Learn filters from `text` and `lang` of the rows of docs; rows without either are passed over.

    About `rows` rows of each language are used, chosen by a hash of the row, so
    that the fit costs the same at any size, also where many texts are copies;
    rows that repeat as a whole count once. A slot has one 64-bit word for every
    64 languages: 4 MB for so many.
    """
    ship(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id", "text", F.lit(3)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    languages = sorted(sizes)
    slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 64))), np.uint64)
    if not languages:
        return Filters([], slots)
    cut = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, rows / sizes[name]) * 2**31))])
    sample = known.where(F.pmod("h", F.lit(2**31)) <= cut[F.col("lang")]).dropDuplicates(["lang", "h"]).select("text", "lang")
    used = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    place = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[int, list[np.ndarray]] = {}
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for text, lang in zip(texts, langs):
                codes, _ = _codes([text])
                found = np.unique(np.concatenate([_grams(codes, order) for order in ORDERS]))
                by.setdefault(place[lang], []).append(found[found != 0])
            for i, lists in by.items():
                grams, n = np.unique(np.concatenate(lists), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i, np.int32)), pa.array(grams.view(np.int64)), pa.array(n)], ["l", "gram", "n"])

    counted = sample.mapInArrow(run, "l int, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map(*[F.lit(x) for name in languages for x in (place[name], float(max(2, LEAST_SHARE * used.get(name, 0))))])
    # at most (n-grams of a text) / LEAST_SHARE rows of each language pass
    common = counted.where(F.col("n") >= least[F.col("l")]).select("l", "gram").toArrow()
    grams, which = common.column("gram").to_numpy().view(np.uint64), common.column("l").to_numpy()
    for k in range(HASHES):
        np.bitwise_or.at(slots, (_slots(grams, k), which // 64), np.uint64(1) << (which % 64).astype(np.uint64))
    return Filters(languages, slots)


def predicted_languages(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score), one row for each row of docs; `und` and 0 for a text that is null or has no letter.

    Of languages with equal counts the first by name is taken, with score 0.5
    where two tie; a text none of whose n-grams is known gets the first language
    and one over the number of languages. A null doc_id stays null, rows that
    repeat are judged alike, very long texts are read in pieces, other columns
    play no part. Filters without languages say `und`.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = filters.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def held_out(doc_id):
    """Whether a document is in the fold that the fit never sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned outside the held-out fold; edge cases as in predicted_languages."""
    docs = table(spark, sf_dir, "documents")
    filters = fit_filters(docs.where(~held_out(F.col("doc_id"))))
    return predicted_languages(docs, filters).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
