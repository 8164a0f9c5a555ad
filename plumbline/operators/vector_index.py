"""An approximate vector index: coarse cells, residual product codes, exact re-ranking.

Centres of cells and the codebooks of the residuals are fitted by k-means on a
bounded sample; every vector is then assigned to its nearest cell and coded, a
byte for each part of its residual. Inverted lists are Parquet files by cell. A
search picks each question's nearest cells, looks the codes of their vectors up
in the question's distance tables, and takes the exact distance of the best
ones. Upserting and deleting rewrite the cells concerned only.

Vectors have unit length inside, so that squared distance is twice the cosine
distance; a vector without length is at distance 1 of all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.retrieval import cosine
from plumbline.session import discard, file_key, remove, shared_folder, ship, subfolders, written

#: Vectors that the fit uses at most, chosen by a hash of the row.
SAMPLE = 20_000
PARTS = 16
CODES = 256
#: Candidates for each result that are re-ranked exactly.
OVERSAMPLE = 12
#: A question looks into as many cells as hold this share of the nearest TUNED_TOP vectors of TUNED questions, in the sample.
REACHED, TUNED, TUNED_TOP = 0.96, 256, 10
_ROUNDS = 12
#: Rows of a file of a cell, and of a part of a cell that meets questions at a time, about.
FILE_ROWS, PART_ROWS = 500_000, 32_768
#: Questions that meet a part at a time, about.
PACK = 256
#: Numbers of one matrix in a worker, and rows that it gives at a time, about: what it needs doesn't grow with its batches.
MATRIX, GIVEN = 1 << 20, 1 << 14
#: Candidates that a task holds for its questions together; beyond that it gives them on and begins anew.
HELD = 1 << 22


def _means(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means from different points; fewer where there are fewer. An emptied centre takes the point farthest from its own."""
    points = np.asarray(points, np.float64)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(_ROUNDS):
        far = (centres**2).sum(axis=1) - 2 * points @ centres.T
        near = far.argmin(axis=1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        lost = np.flatnonzero(count == 0)
        if len(lost):
            centres[lost] = points[np.argsort(-(far[np.arange(len(points)), near] + (points**2).sum(axis=1)))[: len(lost)]]
    return centres


@dataclass
class Quantiser:
    """centres: cells x size; books: parts x codes x size of a part. `size` is a multiple of the parts. probes: cells to look into."""

    centres: np.ndarray
    books: np.ndarray
    probes: int = 1

    @staticmethod
    def fit(sample: np.ndarray, cells: int, seed: int = 0) -> Quantiser:
        rng = np.random.default_rng(seed)
        parts = next(p for p in range(min(PARTS, sample.shape[1]), 0, -1) if sample.shape[1] % p == 0)
        centres = _means(sample, cells, rng)
        rest = sample - centres[Quantiser._nearest(sample, centres)]
        books = [_means(part, CODES, rng) for part in np.split(rest, parts, axis=1)]
        # of the sample's own first points: in how many of their nearest cells their nearest points lie
        asked = sample[:TUNED]
        far = (sample**2).sum(axis=1) - 2 * asked @ sample.T
        far[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        near = np.argsort(far, axis=1, kind="stable")[:, : min(TUNED_TOP, len(sample) - 1)]
        order = np.argsort((centres**2).sum(axis=1) - 2 * asked @ centres.T, axis=1, kind="stable")
        place = np.argsort(order, axis=1)[np.arange(len(asked))[:, None], Quantiser._nearest(sample, centres)[near]]
        return Quantiser(centres, np.stack(books), int(np.quantile(place, REACHED, method="higher")) + 1 if place.size else 1)

    @staticmethod
    def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)

    def cells(self, points: np.ndarray) -> np.ndarray:
        return self._nearest(points, self.centres)

    def codes(self, points: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """A byte for each part of the residual."""
        rest = np.split(points - self.centres[cell], len(self.books), axis=1)
        return np.stack([self._nearest(r, b) for r, b in zip(rest, self.books)], axis=1).astype(np.uint8)

    def tables(self, question: np.ndarray, cell: int) -> np.ndarray:
        """parts x codes: squared distances of the question's residual parts and the codes'."""
        rest = np.split(question - self.centres[cell], len(self.books))
        return np.stack([((b - r) ** 2).sum(axis=1) for r, b in zip(rest, self.books)])

    def nearest_cells(self, points: np.ndarray, probes: int) -> np.ndarray:
        """points x probes, nearest first."""
        far = (self.centres**2).sum(axis=1) - 2 * points @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :probes]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of this size at most; empty ones are dropped."""
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, rows)):
            yield batch.slice(at, max(1, rows))


def _unit(column: pa.ListArray, size: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


class VectorIndex:
    """An index under a folder that all executors share. Vectors have doc_id (long) and v (numbers); other columns go with them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # --- the model ---

    def _save(self, quantiser: Quantiser, size: int) -> None:
        said = json.dumps({"size": size, "probes": quantiser.probes, "centres": quantiser.centres.tolist(), "books": quantiser.books.tolist()})
        self.spark.createDataFrame([(said,)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/model")

    def _model(self) -> tuple[Quantiser, int]:
        said = json.loads(self.spark.read.parquet(f"{self.path}/model").first().model)
        return Quantiser(np.array(said["centres"]), np.array(said["books"]), said["probes"]), said["size"]

    # --- writing ---

    def build(self, vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> None:
        """Fit on `sample` vectors at most, and file all of them. `cells` is by default about the square root of their number, 4,096 at most.

        Rows with a null id, or whose vector is null, has a null or non-finite
        component or another size than the most frequent one, raise: see rejected().
        """
        sound, counts = self._sound(vectors), vectors.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c"))
        best = counts.where("n > 0").orderBy(F.desc("c"), "n").first()
        if best is None:
            raise ValueError("no vectors to index")
        n = sound.count()
        some = sound.where(F.size("v") == best.n).select(F.col("v").cast("array<double>").alias("v"), F.xxhash64("doc_id", "v").alias("h")).orderBy("h").limit(sample).toArrow()
        points = _unit(some.column("v").combine_chunks(), best.n)
        cells = cells or int(min(4096, max(1, n**0.5), max(1, len(points) // 8)))
        self._save(Quantiser.fit(points, cells), best.n)
        if not self.rejected(vectors).isEmpty():
            raise ValueError("some rows can't be indexed; see rejected()")
        remove(self.spark, f"{self.path}/lists")
        self._filed(vectors, max(1, -(-n // (cells * FILE_ROWS)))).write.partitionBy("cell").parquet(f"{self.path}/lists")

    @staticmethod
    def _sound(vectors: DataFrame) -> DataFrame:
        return vectors.where(F.col("doc_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))))

    def rejected(self, vectors: DataFrame) -> DataFrame:
        """Rows that the index can't hold."""
        size = self._model()[1]
        ok = F.col("doc_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") == size) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
        return vectors.where(~F.coalesce(ok, F.lit(False)))

    def _coded(self, vectors: DataFrame) -> DataFrame:
        """The rows with their cell and code."""
        ship(self.spark)
        quantiser, size = self._model()
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields] + ["cell int", "code binary"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, MATRIX // max(CODES, len(quantiser.centres))):
                points = _unit(batch.column("v"), size)
                cell = quantiser.cells(points)
                code = quantiser.codes(points, cell)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], [*batch.schema.names, "cell", "code"])

        return vectors.mapInArrow(run, schema)

    def _filed(self, vectors: DataFrame, files: int) -> DataFrame:
        """Coded rows, dealt so that a cell has this many files (the exchange is one that adaptive plans may split for a cell with many more)."""
        return self._coded(vectors).hint("rebalance", "cell") if files == 1 else self._coded(vectors).repartition(F.col("cell"), F.pmod(F.xxhash64("doc_id"), F.lit(files)))

    def _lists(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lists")

    def _rewritten(self, cells: list[int], keep: DataFrame) -> None:
        """Put these rows in place of the given cells; other cells' files stay."""
        keep.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("cell").parquet(f"{self.path}/lists")
        filled = {r.cell for r in keep.select("cell").distinct().collect()}
        for cell in set(cells) - filled:
            remove(self.spark, f"{self.path}/lists/cell={cell}")

    def _cells_of(self, ids: DataFrame) -> list[int]:
        """The cells that hold these ids, at most as many as there are cells."""
        return [r.cell for r in self._lists().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("cell").distinct().collect()]

    def upsert(self, vectors: DataFrame) -> list[int]:
        """File these vectors in place of what has their ids; the cells that were rewritten."""
        if not self.rejected(vectors).isEmpty():
            raise ValueError("some rows can't be indexed; see rejected()")
        new = written(self._coded(vectors), "coded")
        cells = sorted({*self._cells_of(new), *(r.cell for r in new.select("cell").distinct().collect())})
        old = self._lists().where(F.col("cell").isin(cells)).join(new.select("doc_id").distinct(), "doc_id", "left_anti")
        both = written(old.select(*new.columns).unionByName(new).repartition("cell"), "cells")  # read before it is overwritten
        self._rewritten(cells, both)
        discard(new)
        discard(both)
        return cells

    def delete(self, ids: DataFrame) -> list[int]:
        """Drop these ids (column doc_id); the cells that were rewritten."""
        cells = sorted(self._cells_of(ids))
        if cells:
            kept = written(self._lists().where(F.col("cell").isin(cells)).join(ids.select("doc_id").distinct(), "doc_id", "left_anti").repartition("cell"), "cells")
            self._rewritten(cells, kept)
            discard(kept)
        return cells

    # --- reading ---

    def vectors(self) -> DataFrame:
        """All stored rows."""
        return self._lists().drop("cell", "code")

    def get(self, ids: DataFrame) -> DataFrame:
        """The stored rows of these ids (column doc_id)."""
        return self._lists().join(ids.select("doc_id").distinct(), "doc_id", "left_semi").drop("cell", "code")

    def search(self, questions: DataFrame, limit: int = 10, probes: int | None = None, oversample: int = OVERSAMPLE) -> DataFrame:
        """(query_id, doc_id, distance, rank): about the nearest vectors by cosine distance, ties at six places by id; never the question's own id.

        questions: query_id, q. `probes` is by default what the fit found. Questions go to their cells, and the vectors of a
        cell stay where they are: of a task's cells only each question's best
        candidates go on.
        """
        ship(self.spark)
        quantiser, size = self._model()
        probes = min(probes or quantiser.probes, len(quantiser.centres))
        keep = limit * oversample

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches, GIVEN // probes):
                points = _unit(batch.column("q"), size)
                near = quantiser.nearest_cells(points, probes)
                take = pa.array(np.repeat(np.arange(len(points)), probes))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(near.ravel().astype(np.int32))], ["query_id", "q", "cell"])

        q = questions.select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
        asked = q.mapInArrow(routed, "query_id long, q array<double>, cell int")
        # a cell's questions, in lists of bounded size
        packs = asked.withColumn("pack", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-questions.count() // PACK))))).groupBy("cell", "pack").agg(F.collect_list(F.struct("query_id", "q")).alias("asked"))
        sizes = {r.cell: -(-r.n // PART_ROWS) for r in self._lists().groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cell
        parts = F.create_map(*[F.lit(x) for pair in (sizes or {0: 1}).items() for x in pair])
        lists = self._lists().select("cell", F.struct("doc_id", "code").alias("x")).withColumn("part", F.pmod(F.xxhash64("x.doc_id"), parts[F.col("cell")]))
        held = lists.groupBy("cell", "part").agg(F.collect_list("x").alias("held"))
        met = held.join(packs, "cell").select("cell", "held", "asked")

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, n = {}, 0  # of each question, over the task's cells
            for batch in _slices(batches, 1):
                cell, rows, asked = batch.column(0)[0].as_py(), batch.column(1).flatten(), batch.column(2).flatten()
                ids, codes = rows.field("doc_id").to_numpy(), np.frombuffer(b"".join(rows.field("code").to_pylist()), np.uint8).reshape(len(rows), -1)
                for name, point in zip(asked.field("query_id").to_numpy().tolist(), _unit(asked.field("q"), size)):
                    tables = quantiser.tables(point, cell)
                    far = np.where(ids == name, np.inf, tables[np.arange(len(tables)), codes].sum(axis=1))
                    had = best.get(name)
                    at = np.flatnonzero(far <= had[1][-1] if had is not None and len(had[0]) == keep else np.isfinite(far))
                    some, near = (ids[at], far[at]) if had is None else (np.concatenate([had[0], ids[at]]), np.concatenate([had[1], far[at]]))
                    if len(near) > keep:  # with all that tie with the last
                        at = np.flatnonzero(near <= np.partition(near, keep - 1)[keep - 1])
                        some, near = some[at], near[at]
                    order = np.lexsort((some, near))[:keep]
                    best[name] = some[order], near[order]
                    n += len(order) - (0 if had is None else len(had[0]))
                if n >= HELD:
                    yield from given(best)
                    best, n = {}, 0
            yield from given(best)

        def given(best: dict) -> Iterator[pa.RecordBatch]:
            names, step = list(best), max(1, GIVEN // keep)
            for at in range(0, len(names), step):
                some = names[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, [len(best[q][0]) for q in some]).astype(np.int64)), pa.array(np.concatenate([best[q][0] for q in some])), pa.array(np.concatenate([best[q][1] for q in some]))], ["query_id", "doc_id", "about"])

        about = met.mapInArrow(looked_up, "query_id long, doc_id long, about double")
        w = Window.partitionBy("query_id").orderBy("about", "doc_id")
        best = about.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).select("query_id", "doc_id")
        exact = self._lists().select("doc_id", "v").join(best, "doc_id").join(q, "query_id").select("query_id", "doc_id", (1 - cosine(F.col("q"), F.col("v"))).alias("distance"))
        order = Window.partitionBy("query_id").orderBy(F.round("distance", 6), "doc_id")
        return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def stored(vectors: DataFrame) -> VectorIndex:
    """The index of a stored table's vectors, built at its first use in this application and found again later."""
    spark = vectors.sparkSession
    index = VectorIndex(spark, f"{shared_folder(spark)}/vectors-{file_key(vectors)}")
    if not subfolders(spark, f"{index.path}/lists", "_SUCCESS"):
        index.build(vectors)
    return index


def cells_recorded(index: VectorIndex) -> dict[str, list[str]]:
    """The files of each cell."""
    return {n: sorted(subfolders(index.spark, f"{index.path}/lists/{n}")) for n in subfolders(index.spark, f"{index.path}/lists") if n.startswith("cell=")}
