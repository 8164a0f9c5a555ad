"""Embeddings in batches by a model that a worker loads once, and a table of vectors by content that grows with each run."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import RETRIEVAL_STOP
from plumbline.session import ship, subfolders

Model = Callable[[list[str]], np.ndarray]


class BatchModel:
    """Names its vectors, their size and its batches; load() gives the function from texts to rows of a matrix."""

    name = "none"
    size = 0
    batch = 64

    def load(self) -> Model:
        raise NotImplementedError


class HashedWords(BatchModel):
    """The default: words by a hash, with signs, at unit length; a text without words is zero."""

    name, size, batch = "hashed-words-64", 64, 256

    def load(self) -> Model:
        words, stop = re.compile(r"\w+"), frozenset(RETRIEVAL_STOP)

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), self.size))
            for row, text in zip(out, texts):
                codes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words.findall(text.lower()) if w not in stop], np.int64)
                np.add.at(row, codes % self.size, np.where(codes & (1 << 31), -1.0, 1.0))
            length = np.linalg.norm(out, axis=1, keepdims=True)
            return np.divide(out, length, out=np.zeros_like(out), where=length > 0)

        return embed


_loaded: dict[str, Model] = {}


def _model(model: BatchModel) -> Model:
    if model.name not in _loaded:
        _loaded.clear()  # a worker holds one model at a time
        _loaded[model.name] = model.load()
    return _loaded[model.name]


def embedded(texts: DataFrame, model: BatchModel) -> DataFrame:
    """(hash, vector) of rows (hash, text): texts of about equal length share a batch, so that padding models waste little."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = _model(model)
        for rows in batches:
            said = [t or "" for t in rows.column(1).to_pylist()]
            order = sorted(range(len(said)), key=lambda i: len(said[i]))
            for at in range(0, len(order), model.batch):
                some = order[at : at + model.batch]
                vectors = np.asarray(embed([said[i] for i in some]), np.float32).reshape(len(some), -1)
                if vectors.shape[1] != model.size:
                    raise ValueError(f"{model.name} gave vectors of {vectors.shape[1]} numbers, not {model.size}")
                offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * model.size)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(some)), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], ["hash", "vector"])

    return texts.select("hash", "text").mapInArrow(run, "hash string, vector array<float>")


class VectorCache:
    """Vectors by the hash of model and text, under a folder that all executors share; a run adds a part, which counts once it is whole."""

    def __init__(self, path: str, model: BatchModel):
        self.path, self.model = path, model

    def _key(self, text):
        return F.sha2(F.concat_ws("\u0001", F.lit(self.model.name), F.coalesce(text, F.lit(""))), 256)

    def held(self, spark) -> DataFrame:
        """(hash, vector, run): each hash once, from the run that has the smallest name, should several have computed it at a time."""
        runs = [n for n in subfolders(spark, self.path) if subfolders(spark, f"{self.path}/{n}", "_SUCCESS")]
        rows = None
        for n in runs:
            one = spark.read.parquet(f"{self.path}/{n}").withColumn("run", F.lit(n))
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return spark.createDataFrame([], "hash string, vector array<float>, run string")
        return rows if len(runs) == 1 else rows.groupBy("hash").agg(F.min(F.struct("run", "vector")).alias("x")).select("hash", "x.vector", "x.run")

    def vectors(self, rows: DataFrame, text_col: str = "text") -> DataFrame:
        """rows with `vector`, and `hit`: whether it was there before this run. Texts that repeat are embedded once, null ones as empty."""
        spark = rows.sparkSession
        keyed = rows.withColumn("_hash", self._key(F.col(text_col)))
        texts = keyed.select(F.col("_hash").alias("hash"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).dropDuplicates(["hash"])
        missing = texts.join(self.held(spark).select("hash"), "hash", "left_anti")
        run = f"run-{uuid.uuid4().hex[:12]}"
        embedded(missing.sortWithinPartitions(F.length("text")), self.model).write.parquet(f"{self.path}/{run}")
        found = self.held(spark).withColumnRenamed("hash", "_hash")
        return keyed.join(found, "_hash").withColumn("hit", F.col("run") != run).drop("_hash", "run")
