"""Sources and sinks: directories, JSON lines, dated traces, upserts, checkpoints."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SUFFIXES = ("txt", "md", "html", "pdf")


def read_directory(spark: SparkSession, path: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, source_file, suffix, text, error): files of a folder tree by suffix, in any case.

    Binary kinds and bytes that aren't UTF-8 have an error and no text; the
    others are read all the same. A missing folder raises.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    text = F.when(suffix != "pdf", F.try_validate_utf8(F.col("content").cast("string")))
    out = rows.withColumn("suffix", suffix).where(F.col("suffix").isin(*suffixes)).select("path", F.element_at(F.split("path", "/"), -1).alias("source_file"), "suffix", text.alias("text"))
    return out.withColumn("error", F.when(F.col("suffix") == "pdf", "no PDF reader").when(F.col("text").isNull(), "not UTF-8"))


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; blank lines are passed over, broken ones come back in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_traces(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Saved traces under date=... folders: those with an answer, and the unreadable ones."""
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    parsed = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})
    rows = files.withColumn("t", parsed).drop("value")
    good = rows.where("t._corrupt_record is null and t.generated_answer is not null")
    return good.select("t.*", *[c for c in rows.columns if c != "t"]).drop("_corrupt_record"), failures(rows.where("t._corrupt_record is not null"), F.col("path"), F.lit("unreadable"))


def write_traces(df: DataFrame, path: str, date: str = "date") -> None:
    df.write.mode("append").partitionBy(date).json(path)


def failures(rows: DataFrame, path: Column, why: Column) -> DataFrame:
    """The dead-letter table of rows that couldn't be used."""
    return rows.select(path.alias("path"), why.alias("reason"))


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return df.where(F.col(group).isNotNull()).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def read_partitions(spark: SparkSession, path: str, group: str, order: str, limit: int, where: str | None = None) -> DataFrame:
    """Rows of a table in key=value folders: those under the partitions asked for (only they are listed), `limit` of each group, none without a group."""
    rows = spark.read.parquet(path)
    return first_per_group(rows.where(where) if where else rows, group, order, limit)


def top(df: DataFrame, order: Column, key: str, n: int) -> DataFrame:
    """The n best rows over all, by the key on ties."""
    return df.orderBy(order, key).limit(n)


def widened(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows appended under the union of both headers."""
    return old.unionByName(new, allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows take the place of old ones with the same key (compared as strings)."""
    fresh = new.select(F.col(key).cast("string").alias("_k")).distinct()
    return widened(old.join(fresh, F.col(key).cast("string") == F.col("_k"), "left_anti"), new)


def pending(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a plan that aren't done yet."""
    return plan.join(done.select(key).distinct(), key, "left_anti")


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right, common): whether two id sets are equal, before anything is published."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("common"))


def publish(chunks: DataFrame, vectors: DataFrame, path: str, key: str = "chunk_id") -> str:
    """Write chunks with their vectors as a new version under `path`, verify it, and make it the current one.

    Nothing is published if there is nothing, if the id sets differ, or if the
    version as stored lacks an id; readers of the old version keep it.
    """
    got = set_differences(chunks, vectors, key).first()
    if not got["common"] or got["only_left"] or got["only_right"]:
        raise ValueError(f"refused: {got['common']} common ids, {got['only_left']} and {got['only_right']} on one side only")
    spark = chunks.sparkSession
    version = f"v{_now(spark)}-{uuid.uuid4().hex[:8]}"
    chunks.join(vectors, key).write.parquet(f"{path}/versions/{version}")
    stored = set_differences(chunks, spark.read.parquet(f"{path}/versions/{version}"), key).first()
    if stored["only_left"] or stored["only_right"]:
        raise ValueError(f"the new version is incomplete ({stored['only_left']} ids are missing); the old one stays")
    _point(spark, path, version)
    return version


def _now(spark: SparkSession) -> str:
    return spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMddHHmmssSSS")).first()[0]


def _point(spark: SparkSession, path: str, version: str) -> None:
    """A pointer is a folder with the next number, which only one of several publishers can create; readers take the newest whole one.

    Whoever comes second raises: what that publication was compared with isn't current any more.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{path}/pointers")
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    number = f"{max([0, *_numbers(files, place)]) + 1:012d}"
    # a file that must not be there yet: creating it fails for the second
    try:
        files.create(hadoop.Path(f"{path}/pointers/{number}-claim"), False).close()
    except Exception as e:
        raise RuntimeError(f"another version was published meanwhile (number {int(number)}); publish again") from e
    spark.createDataFrame([(int(number), version)], "at long, version string").coalesce(1).write.json(f"{path}/pointers/{number}-version")


def _numbers(files, place) -> list[int]:
    return [int(s.getPath().getName().split("-")[0]) for s in files.listStatus(place)]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Published versions, the current one last; a version that was restored counts anew."""
    rows = spark.read.schema("at long, version string").json(f"{path}/pointers/*-version").where("version is not null").orderBy("at", "version").collect()  # one row for each publication
    return [r["version"] for r in rows]


def published(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/versions/{version or versions(spark, path)[-1]}")


def restored(spark: SparkSession, path: str, version: str) -> None:
    """Make an earlier version current again."""
    if version not in versions(spark, path):
        raise ValueError(f"no version {version!r}")
    _point(spark, path, version)


def obsolete_ids(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids of the old version that the new one no longer has."""
    return old.select(key).distinct().join(new.select(key), key, "left_anti")


def pruned(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete the files of all but the last `keep` versions, obsolete ids with them; the names of those deleted."""
    order = list(dict.fromkeys(reversed(versions(spark, path))))
    gone = [v for v in order[max(1, keep):] if _exists(spark, f"{path}/versions/{v}")]
    for v in gone:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{v}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def registry_index(records: DataFrame) -> DataFrame:
    """(parent_document_id, chunk_ids): the index by document of a chunk registry, rebuilt from its records; ids in the order of chunk_index."""
    rows = records.groupBy("parent_document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("l"))
    return rows.select("parent_document_id", F.transform("l", lambda x: x["chunk_id"]).alias("chunk_ids"))


def checkpoint_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of append-only JSON lines files, without a torn last line; a broken line before a file's last raises.

    A large file is read by many tasks, each from the first line that begins in
    its bytes. Which line is a file's last is found from the places of the
    files' bytes and of the lines in them, a row a file. A last line that is no
    record was torn while it was written.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("_path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i")).alias("_at"),
        F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}).alias("_r"), F.substring("value", 1, 80).alias("_begins"))
    last = lines.groupBy("_path").agg(F.max("_at").alias("_last"))
    broken = F.col("_r._corrupt_record").isNotNull()
    # hashed, since the planner takes an error that is cast for a null
    inside = F.xxhash64(F.raise_error(F.concat(F.lit("corrupt record inside "), F.col("_path"), F.lit(", in the bytes from "), F.col("_at.block").cast("string"), F.lit(": "), F.col("_begins")))) == 0
    rows = lines.join(last, "_path")
    return rows.where(F.when(broken & (F.col("_at") != F.col("_last")), inside).otherwise(~broken)).select("_r.*").drop("_corrupt_record")


def bad_vectors(vectors: DataFrame, v: str = "embedding") -> DataFrame:
    """Rows with a number that isn't finite or without length, to be embedded again."""
    finite = F.forall(F.col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.where(~F.coalesce(finite, F.lit(False)) | (norm == 0))


def repaired(vectors: DataFrame, again: DataFrame, key: str, v: str = "embedding") -> DataFrame:
    """`vectors` with those of bad_vectors() embedded anew (key, v); all other columns as they were, and a vector that isn't there again stays."""
    bad = bad_vectors(vectors, v).select(key).join(again.select(key, F.col(v).alias("_v")), key)
    return vectors.join(bad, key, "left").withColumn(v, F.coalesce("_v", v)).select(*vectors.columns)


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a store by id."""
    return table.join(ids.select(key).distinct(), key, "left_semi")


def cache_split(texts: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses) of a content-addressed embedding cache."""
    return texts.join(cache, key), texts.join(cache.select(key), key, "left_anti").dropDuplicates([key])


def failure_counts(log: DataFrame, line: str = "line", first: int = 10) -> DataFrame:
    """(baseline, n, eval_ids): counts of a failure log's lines and the first ids of each, in log order.

    Counts are sums, and each task cuts its own first lines before they are shuffled, so a baseline with most of the log is no task's alone.
    """
    rows = log.select("line_no", F.regexp_extract(line, r"eval_id=(\S+)", 1).alias("eval_id"), F.regexp_extract(line, r"baseline=([^:\s]+)", 1).alias("baseline")).where("baseline <> ''")
    counts = rows.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("baseline").orderBy("line_no")
    few = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= first)
    named = few.groupBy("baseline").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "eval_id"))), lambda x: x["eval_id"]).alias("eval_ids"))
    return counts.join(named, "baseline")


def evaluator_rows(traces: DataFrame, refs: DataFrame, chunks: DataFrame, need_gold: bool = False) -> DataFrame:
    """trace_id, question, answer, contexts in rank order, gold: what an external evaluator takes."""
    texts = refs.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    out = traces.join(texts, "trace_id", "left").select("trace_id", "question", "answer", F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts"), "gold")
    return out.where("gold is not null") if need_gold else out


def framework_means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, n, mean): nulls skipped, NaN not."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def backfilled(traces: DataFrame, registries: list[DataFrame], length: int = 400) -> DataFrame:
    """Chunk texts of traces: the prompt's own, else the first registry that has one, else empty."""
    out = traces
    for i, r in enumerate(registries):
        out = out.join(r.select("chunk_id", F.col("text").alias(f"_t{i}")), "chunk_id", "left")
    names = [f"_t{i}" for i in range(len(registries))]
    return out.withColumn("text", F.substring(F.coalesce("prompt_text", *names, F.lit("")), 1, length)).drop(*names, "prompt_text")


def recent(rows: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    """The last n rows by time."""
    return rows.orderBy(F.desc(ts), key).limit(n)


def united(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, the first source's where keys meet."""
    tagged = [p.withColumn("_s", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy(key).orderBy("_s")
    return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_s")


def session_export(messages: DataFrame, kind: str) -> DataFrame:
    """(session_id, document): a session's messages as JSON, Markdown or CSV text."""
    line = {
        "json": F.to_json(F.struct("role", "text")),
        "markdown": F.concat(F.lit("**"), F.col("role"), F.lit("**: "), F.col("text")),
        "csv": F.to_csv(F.struct("role", "text")),
    }[kind]
    rows = messages.select("session_id", F.struct("ordinal", line.alias("l")).alias("x")).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "," if kind == "json" else "\n").alias("d"))
    head = {"json": F.concat(F.lit("["), F.col("d"), F.lit("]")), "markdown": F.concat(F.lit("# "), F.col("session_id").cast("string"), F.lit("\n\n"), F.col("d")), "csv": F.concat(F.lit("role,text\n"), F.col("d"))}
    return rows.select("session_id", head[kind].alias("document"))
