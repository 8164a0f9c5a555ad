"""Hard-negative mining by a secondary-sort shuffle.

An anchor's pairs carry keys of 24 bytes in which the anchor, the falling score
and the id follow one another, so that a shuffle that sorts by the key hands
each anchor's pairs to one iterator, best first. The iterator opens a window at
each of the anchor's first positives and emits the negatives that fall in open
windows; it holds an anchor's windows and never its pairs.

Anchors are a stated query set, which meets all rows in blocks: rows lie in
slices of bounded size, and blocks of anchors stream past each slice, so that a
pair of a slice and a block is one product of matrices. Before the shuffle a
slice cuts what it can't need: of an anchor's positives its own first five, and
of the negatives the first ten of each window. The windows come from the
positives of all slices, hence two passes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm.common import discard, integer_vectors, table, written
from plumbline.session import ship

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of its positive's.
FROM, TO = 30, 90
#: Rows of a slice, which one task holds as a matrix of integers.
SLICE_ROWS = 32_768
#: Anchors that meet a slice at a time.
BLOCK_ANCHORS = 64
#: Scores below this are exact in doubles, and a hundred times as much fits a long.
_EXACT = 1 << 53
_SIGN = np.uint64(1 << 63)


def packed_keys(anchor: np.ndarray, score: np.ndarray, other: np.ndarray) -> pa.Array:
    """Keys of 24 bytes that sort by anchor, then by falling score, then by id."""
    parts = np.empty((len(anchor), 3), ">u8")
    for at, part in enumerate((anchor, ~score, other)):
        parts[:, at] = part.astype(np.int64).view(np.uint64) ^ _SIGN
    offsets = np.arange(len(anchor) + 1, dtype=np.int32) * 24
    return pa.Array.from_buffers(pa.binary(), len(anchor), [None, pa.py_buffer(offsets), pa.py_buffer(parts.tobytes())])


def unpacked(key: bytes) -> tuple[int, int, int]:
    """(anchor, score, id) of a key."""
    a, s, i = (int.from_bytes(key[at : at + 8]) - (1 << 63) for at in (0, 8, 16))
    return a, ~s, i


def _wide(column: pa.ListArray) -> np.ndarray:
    """The vectors as rows of a matrix; shorter ones end in zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class _Slice:
    """The rows of one slice, by id, and their scores against blocks of anchors."""

    def __init__(self, batches: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.ids = rows["vec_id"].to_numpy()
        order = np.argsort(self.ids, kind="stable")
        self.ids, self.labels = self.ids[order], rows["label"].to_numpy()[order]
        self.x = _wide(rows["x"].chunk(0))[order] if len(order) else np.zeros((0, 0))
        self.most = np.abs(self.x).max(initial=0.0)

    def scores(self, anchors: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """A row of scores for each anchor, of all rows or of these."""
        width = min(anchors.shape[1], self.x.shape[1])
        if np.abs(anchors).max(initial=0.0) * self.most * width >= _EXACT:
            raise ValueError("scores beyond 2^53 are not exact; scale the vectors down")
        return (anchors[:, :width] @ self.x[rows, :width].T).astype(np.int64)


def _first(scores: np.ndarray, n: int) -> np.ndarray:
    """The places of the n greatest scores (all, if fewer), of equals the first ones."""
    if len(scores) <= n:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - n)[len(scores) - n]
    above = np.flatnonzero(scores > least)
    return np.r_[above, np.flatnonzero(scores == least)[: n - len(above)]]


def _met(vectors: DataFrame, anchors: DataFrame, slices: int, found, schema: str) -> DataFrame:
    """found(slice, block of anchors) for each slice of the vectors and each block of anchors.

    Both sides are dealt by slice and sorted, a slice's rows before its anchors,
    so a task holds one slice and one block at a time.
    """
    side = [c for c in anchors.columns if c not in vectors.columns]
    kinds = dict(anchors.dtypes)
    rows = vectors.withColumns({c: F.lit(None).cast(kinds[c]) for c in side} | {"kind": F.lit(0)})
    against = anchors.withColumn("kind", F.lit(1)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    dealt = rows.unionByName(against).repartition("slice").sortWithinPartitions("slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None

        def meet(part: pa.Table) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(part), BLOCK_ANCHORS):
                yield from found(ready, part.slice(at, BLOCK_ANCHORS).combine_chunks())

        for batch in batches:
            at = 0
            keys = batch.column("slice").to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column("kind").to_numpy(zero_copy_only=False)
            for end in [*(np.flatnonzero(np.diff(keys)) + 1), len(keys)] if len(keys) else []:
                which, kind = divmod(int(keys[at]), 2)
                part = batch.slice(at, end - at)
                if which != now:
                    now, held, ready = which, [], None
                if kind == 0:
                    held.append(part)
                elif held:
                    if ready is None:
                        ready, held = _Slice(held), [True]
                    yield from meet(pa.Table.from_batches([part]))
                at = end

    return dealt.mapInArrow(run, schema)


def _positives(part: _Slice, block: pa.Table) -> Iterator[pa.RecordBatch]:
    """The slice's own first positives of each anchor."""
    ids, labels, x = block["vec_id"].to_numpy(), block["label"].to_numpy(), _wide(block["x"].chunk(0))
    anchor, other, score = [], [], []
    for label in np.unique(labels):
        own = np.flatnonzero(labels == label)
        same = np.flatnonzero(part.labels == label)
        for a, scores in zip(ids[own], part.scores(x[own], same)):
            others = np.flatnonzero(part.ids[same] != a)
            best = others[_first(scores[others], POSITIVES)]
            anchor.append(np.full(len(best), a))
            other.append(part.ids[same][best])
            score.append(scores[best])
    if anchor:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v), pa.int64()) for v in (anchor, other, score)], ["anchor_id", "positive_id", "positive_score"])


def _windowed(part: _Slice, block: pa.Table) -> Iterator[pa.RecordBatch]:
    """Keys of the slice's own first negatives in each window of each anchor."""
    ids, labels, x = block["vec_id"].to_numpy(), block["label"].to_numpy(), _wide(block["x"].chunk(0))
    anchor, other, score = [], [], []
    for a, label, windows, scores in zip(ids, labels, block["positive_scores"].to_pylist(), part.scores(x)):
        rest = np.flatnonzero((part.labels != label) & (part.ids != a))
        scores, chosen = scores[rest], []
        hundred = 100 * scores
        for p in set(windows):
            inside = np.flatnonzero((hundred >= FROM * p) & (hundred <= TO * p))
            chosen.append(inside[_first(scores[inside], NEGATIVES)])
        best = np.unique(np.concatenate(chosen))
        anchor.append(np.full(len(best), a))
        other.append(part.ids[rest][best])
        score.append(scores[best])
    if anchor:
        keys = packed_keys(*(np.concatenate(v) for v in (anchor, score, other)))
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.zeros(len(keys), bool))], ["key", "positive"])


def emitted(pairs: Iterable[tuple[bytes, bool]], negatives: int = NEGATIVES) -> Iterator[tuple]:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from pairs that come sorted by key.

    A positive opens its window when it passes. Windows lie below their
    positives' scores but for a score of zero, whose window is zero itself:
    hence the first negatives of score zero are kept for positives to come.
    """
    now, windows, zeros = None, [], []
    for key, positive in pairs:
        a, score, other = unpacked(key)
        if a != now:
            now, windows, zeros = a, [], []
        if positive:
            if score < 0:
                continue  # an empty window
            window = [other, score, 0]
            windows.append(window)
            for negative in zeros if score == 0 else ():
                window[2] += 1
                yield a, other, window[2], negative, 0, 0
            continue
        if score == 0 and len(zeros) < negatives:
            zeros.append(other)
        for window in windows:
            p = window[1]
            if window[2] < negatives and FROM * p <= 100 * score <= TO * p:
                window[2] += 1
                yield a, window[0], window[2], other, p, score


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(vectors: DataFrame, anchors: DataFrame, scale: int = SCALE) -> DataFrame:
    """RESULT: for each anchor and each of its first positives the first negatives whose score is in the positive's window.

    Both tables have vec_id, embedding and label; anchors are few beside the
    vectors, among which they are too. Rows with a null id, label or vector, or
    with a null or non-finite component, take no part. Vectors of other lengths
    score as if the shorter one ended in zeros. Rows that repeat are rows each,
    and an anchor's others are the rows with another id; of anchors that share
    an id the one with the smallest label and vector counts. Other columns play
    no part, and empty tables give no row. Scores of 2^53 or more raise.
    """
    spark = vectors.sparkSession
    ship(spark)

    def sound(df: DataFrame) -> DataFrame:
        rows = integer_vectors(df.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").where("vec_id is not null and label is not null"), scale)
        return rows.select("vec_id", "label", "x")

    rows = written(sound(vectors), "vectors")
    slices = max(1, -(-rows.count() // SLICE_ROWS))
    # dealt round about by the place of a row, so that copies don't meet in one slice
    sliced = rows.withColumn("slice", F.pmod(F.monotonically_increasing_id(), F.lit(slices)).cast("int"))
    once = sound(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("one"))
    asked = written(once.select("vec_id", "one.label", "one.x"), "anchors")
    local = _met(sliced, asked, slices, _positives, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = written(local.withColumn("r", F.row_number().over(best)).where(F.col("r") <= POSITIVES).drop("r"), "positives")
    opened = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list("positive_score").alias("positive_scores"))  # five at most
    negatives = _met(sliced, asked.join(opened, "vec_id"), slices, _windowed, "key binary, positive boolean")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = packed_keys(*(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 1)))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.ones(len(keys), bool))], ["key", "positive"])

    pairs = written(negatives.unionByName(positives.mapInArrow(keyed, "key binary, positive boolean")), "pairs")
    for used in (rows, asked, positives):
        discard(used)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_pairs = pairs.rdd.map(lambda r: (bytes(r[0]), r[1])).repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(sorted_pairs.mapPartitions(emitted), RESULT, verifySchema=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings whose id is divisible by 100, against all rows; edge cases as in hard_negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


OP12_SQL = """WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = len(embedding)),
pairs AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 10"""
