"""Session defaults, and shipping this package to the executors' Python workers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "plumbline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries rely on (UTC, adaptive plans); conf overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in the cluster's shared checkpoint folder (`spark.checkpoint.dir`).

    Where that is unset, a folder under /tmp serves a local session; any other
    session raises, since its executors could not read each other's files.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file:///tmp/checkpoints/{sc.applicationId}"
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tables-{sc.applicationId}"
    if getattr(sc, "_plumbline_folder", None) != path:  # what an application wrote for itself goes when it ends
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        sc._plumbline_folder = path
    return path


def subfolders(spark: SparkSession, path: str, name: str | None = None) -> list[str]:
    """Names in a folder of any store that Spark reads, or those equal to `name`; none where it isn't there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
    return [n for n in found if name in (None, n)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it, if it is there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def file_key(df: DataFrame) -> str:
    """A name for what a stored table holds: of its columns and of its files' names, sizes and times."""
    conf, seen = df.sparkSession.sparkContext._jsc.hadoopConfiguration(), list(df.columns)
    for name in sorted(df.inputFiles()):
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        state = path.getFileSystem(conf).getFileStatus(path)
        seen.append(f"{name}:{state.getLen()}:{state.getModificationTime()}")
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(seen)).hex[:16]


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written(), once nothing reads it."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tables-" in name:
            remove(df.sparkSession, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, read by each who needs it, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each context; Spark's own file server carries it."""
    sc = spark.sparkContext
    if getattr(sc, "_plumbline_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="plumbline-"), "plumbline_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._plumbline_shipped = True
