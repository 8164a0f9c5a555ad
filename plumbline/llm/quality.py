"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight for each hashed text feature is shared by all grades; ordered
thresholds turn the sum into P(grade <= k) = 1 / (1 + exp(sum - threshold_k)).
The result is an expected grade, and the tail probability of the grades that
are good enough, on which documents are selected.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import alone, bounded_sample, discard, table, texts_of, written
from plumbline.session import ship

BUCKETS = 1 << 18
#: Labelled documents that the fit uses at most.
FIT_ROWS = 8_000
#: Distinct features that the fit uses at most: those that tell the grades apart best.
FIT_FEATURES = 4_096
#: Of the sound labelled documents, the share that the fitted cutoff of the tail probability keeps.
KEEP_SOUND = 0.99
#: The cutoff where fewer sound labels than LEAST_SOUND speak for one, and the range of fitted ones.
KEEP_TAIL, LEAST_SOUND, CUTOFFS = 0.6, 50, (0.5, 0.95)
#: A feature tells grades apart if its sum over a grade lies this many standard deviations from chance, and at this correlation.
LEAST_Z, LEAST_EFFECT = 4.5, 0.05
_REMEMBER = 200_000
_SHAPES = ("plain", "symbols", "capitals", "digits", "bare mark")
_MARKS = frozenset("#*$%&|<>!?=~^")


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def _shape(word: str) -> int:
    if not any(c.isalnum() for c in word):
        return 4
    if len(word) > 1 and word[-1] in _MARKS and word[-2] in _MARKS:
        return 1
    if word.isupper() and sum(c.isalpha() for c in word) > 1:
        return 2
    return 3 if any(c.isdigit() for c in word) else 0


class _Words(dict):
    """What a word stands for, found once and remembered; `find` maps a word to (shape, value of its feature)."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word):
        if len(self) >= _REMEMBER:
            self.clear()
        self[word] = value = self.find(word)
        return value


def _plain(word: str) -> str:
    return word.strip(".,;:!?\"'()[]#*$%&|<>").lower()


def _shares(words: list[str], shapes: list[int]) -> list[float]:
    """Root shares of each shape but the plain one, of words that repeat the one before, and of distinct words."""
    n = max(1, len(words))
    counts = np.bincount(np.array(shapes, np.int64), minlength=len(_SHAPES))[1:]
    echo = sum(map(operator.eq, words, words[1:]))
    return [float(x) for x in np.sqrt(np.r_[counts, echo, len(set(words))] / n)]


_SHARE_BUCKETS = [_bucket(f"\x00share {s}") for s in (*_SHAPES[1:], "echo", "distinct")]


def features(text: str | None, known: _Words) -> tuple[list[int], list[float]]:
    """Hashed features of a text: each distinct word once, and the shares."""
    words = (text or "").split()
    found = [known[w] for w in words]
    buckets = sorted({b for _, b in found})
    return buckets + _SHARE_BUCKETS, [1.0] * len(buckets) + _shares(words, [s for s, _ in found])


@dataclass
class CumulativeLink:
    """weights by bucket; thresholds in increasing order, one fewer than the grades; documents are kept at `cutoff`."""

    weights: np.ndarray
    thresholds: np.ndarray
    cutoff: float = KEEP_TAIL

    @staticmethod
    def fit(grades: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray], n_grades: int = 3,
            rounds: int = 600, ridge: float = 2e-4, least_z: float = LEAST_Z, least_effect: float = LEAST_EFFECT) -> CumulativeLink:
        """Penalised maximum likelihood by Adam, over features that pass a score test.

        A feature enters if three texts have it, its correlation with some grade
        is `least_effect`, and its sum over that grade's texts lies `least_z`
        standard deviations from what chance would give; the others keep weight
        zero. Words that only a few toxic texts have pass, since a grade's own
        spread is what they are held against. Without rows, all weights are
        zero and every text is put in the top grade.
        """
        weights = np.zeros(BUCKETS, np.float32)
        if not len(grades):
            return CumulativeLink(weights, np.full(n_grades - 1, -50.0))
        sizes = np.array([len(c) for c in columns])
        row = np.repeat(np.arange(len(grades)), sizes)
        col, val = np.concatenate(columns), np.concatenate(values).astype(np.float64)
        total, squares = np.bincount(col, weights=val, minlength=BUCKETS), np.bincount(col, weights=val * val, minlength=BUCKETS)
        spread = np.sqrt(np.maximum(squares - total**2 / len(grades), 1e-9))
        z = np.zeros(BUCKETS)
        for k in range(n_grades):
            mine = (grades == k) - np.mean(grades == k)
            z = np.maximum(z, np.abs(np.bincount(col, weights=val * mine[row], minlength=BUCKETS)) / (spread * max(1e-9, float(np.std(mine)))))
        z[np.bincount(col, minlength=BUCKETS) < 3] = 0
        used = np.flatnonzero(z >= max(least_z, least_effect * np.sqrt(len(grades))))
        place = np.full(BUCKETS, -1)
        place[used] = np.arange(len(used))
        inside = place[col] >= 0
        row, col, val = row[inside], place[col[inside]], val[inside]
        share = np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / len(grades)
        share = np.clip(share, 1e-3, 1 - 1e-3)
        theta = np.log(share / (1 - share))
        gaps = np.log(np.maximum(np.diff(theta), 1e-2))
        p = np.concatenate([np.zeros(len(used)), theta[:1], gaps])
        m, v = np.zeros_like(p), np.zeros_like(p)
        k = len(used)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for t in range(1, rounds + 1):
            cuts = np.concatenate([[-np.inf], p[k] + np.r_[0, np.cumsum(np.exp(p[k + 1 :]))], [np.inf]])
            score = np.bincount(row, weights=val * p[col], minlength=len(grades))
            hi, lo = sigmoid(cuts[grades + 1] - score), sigmoid(cuts[grades] - score)
            hi, lo = np.where(grades == n_grades - 1, 1.0, hi), np.where(grades == 0, 0.0, lo)
            chance = np.maximum(hi - lo, 1e-9)
            d_hi, d_lo = hi * (1 - hi) / chance, lo * (1 - lo) / chance
            g = np.empty_like(p)
            g[:k] = np.bincount(col, weights=val * (d_hi - d_lo)[row], minlength=k)[:k] / len(grades) + ridge * p[:k]
            d_cut = np.array([(d_lo[grades == j + 1].sum() - d_hi[grades == j].sum()) for j in range(n_grades - 1)]) / len(grades)
            g[k] = d_cut.sum()
            g[k + 1 :] = [np.exp(p[k + 1 + j]) * d_cut[j + 1 :].sum() for j in range(n_grades - 2)]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= 0.15 * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        weights[used] = p[:k]
        return CumulativeLink(weights, p[k] + np.r_[0, np.cumsum(np.exp(p[k + 1 :]))])

    def predict(self, score: np.ndarray, least_grade: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected grades, and probabilities of `least_grade` or above."""
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))
        return above.sum(axis=1), above[:, least_grade - 1]


def grade(quality, toxic):
    """The graded rating of a label: 0 toxic, 1 low quality, 2 sound; null without a quality.

    Toxic is the lowest grade, of whatever quality: one sum serves all grades,
    and many toxic words must be able to lower it without end.
    """
    return F.when(quality.isNull(), None).when(F.coalesce(toxic, F.lit(0)) > 0, 0).when(quality <= 0, 1).otherwise(2)


def fit_grades(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> CumulativeLink:
    """Fit on a sample of `rows` labelled documents at most, whose features are found on the executors.

    A doc_id with several grades counts once for each; of rows that share a
    doc_id one is read, and texts with the same features count once. Labels
    without a quality or a doc_id are passed over.
    """
    ship(docs.sparkSession)
    graded = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade(F.col("quality"), F.col("toxic")).alias("grade")).where(
        "grade is not null and doc_id is not null")
    chosen = bounded_sample(graded, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(lambda w: (_shape(w), _bucket(_plain(w))))
        for batch in batches:
            found = [features(t, known) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                ["grade", "cols", "vals"])

    rated = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(chosen), "doc_id")  # `rows` rows of two numbers at most
    once = rated.groupBy("doc_id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = written(once.select("grade", "text").mapInArrow(run, "grade int, cols array<int>, vals array<float>").distinct(), "rated-features")  # copies count once
    telling = np.array(sorted(r.col for r in telling_features(found).collect()), np.int32)

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols, vals, keep = [], [], np.isin
            for c, v in zip(batch.column(1), batch.column(2)):
                c, v = c.values.to_numpy(), v.values.to_numpy()
                inside = keep(c, telling)
                cols.append(c[inside])
                vals.append(v[inside])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.float32()))], ["grade", "cols", "vals"])

    # FIT_ROWS rows of FIT_FEATURES features of 8 bytes at most; few texts have more than a hundred of them
    got = found.orderBy(F.xxhash64("grade", "cols", "vals"), "grade", "cols").mapInArrow(narrowed, "grade int, cols array<int>, vals array<float>").toArrow()
    discard(found)
    lists = lambda c: np.split(got.column(c).combine_chunks().flatten().to_numpy(), np.cumsum(got.column(c).combine_chunks().value_lengths().to_numpy())[:-1])
    if not got.num_rows:
        return CumulativeLink.fit(np.zeros(0, int), [], [])
    return fit_with_cutoff(got.column("grade").to_numpy().astype(np.int64), lists("cols"), lists("vals"))


def telling_features(found: DataFrame, n_grades: int = 3, features: int = FIT_FEATURES) -> DataFrame:
    """(col, z): the features of rated texts (grade, cols, vals) that pass the score test of CumulativeLink.fit, `features` at most."""
    sizes = {r.grade: r.n for r in found.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a grade
    n = sum(sizes.values())
    each = found.select("grade", F.explode(F.arrays_zip("cols", "vals")).alias("x")).select("grade", F.col("x.cols").alias("col"), F.col("x.vals").cast("double").alias("v"))
    at = lambda k: F.when(F.col("grade") == k, F.col("v")).otherwise(0.0)
    sums = each.groupBy("col").agg(F.count(F.lit(1)).alias("texts"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), *[F.sum(at(k)).alias(f"s{k}") for k in range(n_grades)])
    spread = F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s") / max(n, 1), F.lit(1e-9)))
    share = [sizes.get(k, 0) / max(n, 1) for k in range(n_grades)]
    z = F.greatest(*[F.abs(F.col(f"s{k}") - p * F.col("s")) / (spread * max(1e-9, (p * (1 - p)) ** 0.5)) for k, p in enumerate(share)])
    passed = sums.where("texts >= 3").select("col", z.alias("z")).where(F.col("z") >= max(LEAST_Z, LEAST_EFFECT * n**0.5) - 1e-6)
    return passed.orderBy(F.desc("z"), "col").limit(features)


def fit_with_cutoff(grades: np.ndarray, columns: list[np.ndarray], values: list[np.ndarray]) -> CumulativeLink:
    """A fit on all rows; its cutoff keeps KEEP_SOUND of the sound ones, as fits on either half judge the other."""
    half, tails = np.arange(len(grades)) % 2, []
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero((half != h) & (grades == grades.max()))
        model = CumulativeLink.fit(grades[own], [columns[i] for i in own], [values[i] for i in own], rounds=300)
        tails.append(model.predict(np.array([model.weights[columns[i]].astype(float) @ values[i] for i in other]), 2)[1])
    model = CumulativeLink.fit(grades, columns, values)
    sound = np.concatenate(tails)
    if len(sound) >= LEAST_SOUND:
        model.cutoff = float(np.clip(np.quantile(sound, 1 - KEEP_SOUND), *CUTOFFS))
    return model


def _weigher(weights: np.ndarray):
    """Maps a word to (shape, weight, plain form); the many words without weight share one value for each shape."""
    empty = [(i, 0.0, "") for i in range(len(_SHAPES))]

    def find(word: str):
        plain = _plain(word)
        x = float(weights[_bucket(plain)])
        return (_shape(word), x, plain) if x else empty[_shape(word)]

    return find


def _score(text: str, known: _Words, shared: np.ndarray) -> float:
    """The sum of a text's weights: each plain form once, and the shares."""
    words = text.split()
    found = [known[w] for w in words]
    return sum({p: x for _, x, p in found if x}.values()) + float(shared @ _shares(words, [s for s, _, _ in found]))


def predicted_grades(docs: DataFrame, model: CumulativeLink, keep_tail: float | None = None, least_grade: int = 2) -> DataFrame:
    """doc_id, expected_grade, tail_prob and keep, one row for each row of docs.

    Null texts are judged as empty ones, a null doc_id stays null, rows that
    repeat and texts of the same words are judged alike, very long texts are one
    list of words in memory, other columns play no part, and an empty table
    gives no row. A tail probability equal to keep_tail (by default the model's
    cutoff) is kept.
    """
    ship(docs.sparkSession)
    weights, top = model.weights, least_grade
    keep_tail = model.cutoff if keep_tail is None else keep_tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("quality")
        known = _Words(_weigher(weights))
        shared = weights[_SHARE_BUCKETS].astype(np.float64)
        for batch in batches:
            scores = [_score(text, known, shared) for texts in texts_of(batch, batch.num_columns - 1) for text in texts]
            expected, tail = model.predict(np.array(scores, np.float64), top)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(expected), pa.array(tail), pa.array(tail >= keep_tail)],
                [*batch.schema.names[:-1], "expected_grade", "tail_prob", "keep"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_prob double, keep boolean")


def kept_documents(docs: DataFrame, model: CumulativeLink, keep_tail: float | None = None, least_grade: int = 2) -> DataFrame:
    """The documents that the model keeps, with all their columns as they were.

    Nulls, repeated rows, very long texts and ties at the cutoff are judged as
    by predicted_grades; an empty table stays empty.
    """
    ship(docs.sparkSession)
    weights = model.weights
    keep_tail = model.cutoff if keep_tail is None else keep_tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("quality")
        known = _Words(_weigher(weights))
        shared = weights[_SHARE_BUCKETS].astype(np.float64)
        for batch in batches:
            scores = [_score(text, known, shared) for texts in texts_of(batch, batch.schema.get_field_index("text")) for text in texts]
            yield batch.filter(pa.array(model.predict(np.array(scores, np.float64), least_grade)[1] >= keep_tail))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grades and verdicts of all documents; edge cases as in predicted_grades."""
    docs = table(spark, sf_dir, "documents")
    return predicted_grades(docs, fit_grades(docs, table(spark, sf_dir, "labels")))
