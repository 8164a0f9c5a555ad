"""Shared plumbing: inputs, durable intermediate tables and text helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import shared_folder, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts lineage, survives lost executors, and gives the planner true
    sizes, so that a join broadcasts only what is measured to be small.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables-" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_REMEMBERED: dict[str, Callable[[], object]] = {}


def remembers(operator: str, forget: Callable[[], object]) -> None:
    """Say how a worker forgets what this operator keeps between tasks."""
    _REMEMBERED[operator] = forget


def alone(operator: str) -> None:
    """Called where a task begins: the worker forgets what other operators left in its memory."""
    for other, forget in _REMEMBERED.items():
        if other != operator:
            forget()


def texts_of(batch, column: int, rows: int = 1024):
    """Lists of a batch's texts, `rows` at a time; null ones are empty."""
    for at in range(0, batch.num_rows, rows):
        yield [t or "" for t in batch.column(column).slice(at, rows).to_pylist()]


def whole(text: str = "text"):
    """The text, with null read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def bounded_sample(df: DataFrame, rows: int) -> DataFrame:
    """`rows` different rows of df at most, chosen by a hash of the whole row: the same ones on every run.

    Rows that repeat count once, and the bound is hard: every task keeps its
    `rows` smallest hashes, and those of all tasks are cut again.
    """
    return df.distinct().orderBy(F.xxhash64(*df.columns, F.lit(17)), *df.columns).limit(rows)


def integer_vectors(df: DataFrame, scale: int, size: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """df with `x`, each vector's components as integers floor(scale * component), components read as doubles.

    Rows whose vector is null, holds a null, NaN or infinite component, or has
    another number of components than `size` (where given) are left out.
    """
    v = F.col(vector_col)
    sound = v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    if size is not None:
        sound &= F.size(v) == size
    return df.where(sound).withColumn("x", F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("long")))
