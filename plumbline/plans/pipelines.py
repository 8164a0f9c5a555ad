"""Queries over sources, sinks, resume, sampling, JSON and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import embedding_cache as E
from plumbline.plans import inputs as I
from plumbline.session import shared_folder
from plumbline.sources import datasources as D
from plumbline.sources import tables as S
from plumbline.streaming import traces as Z

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


@query("publish_set_check", "SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right, count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS common FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def publish_set_check(s, d):
    return S.set_differences(I.documents(s, d), I.table(s, d, "labels"), "doc_id")


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(s, d):
    return S.pending(I.documents(s, d).select("doc_id"), I.table(s, d, "labels"), "doc_id")


@query("manifest_left_join", "SELECT d.doc_id, source, quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def manifest_left_join(s, d):
    return I.documents(s, d, "source").join(I.table(s, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality")


@query("upsert_by_key", "SELECT doc_id, 1 AS quality FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id % 2 <> 0")
def upsert_by_key(s, d):
    old = I.table(s, d, "labels").select("doc_id", "quality")
    return S.upserted(old, old.where("doc_id % 2 = 0").select("doc_id", F.lit(1).alias("quality")), "doc_id")


@query("stratified_sample", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('7:' || doc_id::VARCHAR)) <= 20")
def stratified_sample(s, d):
    """A sampling operator: twenty of each label in hash order."""
    from plumbline.operators.retrieval import ranked

    rows = I.documents(s, d, "lang").select("lang", "doc_id", F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256).alias("h"))
    return ranked(rows, ["lang"], [F.col("h")], 20).select("lang", "doc_id")


@query("stride_sample", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) % 5 = 0")
def stride_sample(s, d):
    from plumbline.operators.retrieval import ranked

    return ranked(I.documents(s, d, "source"), ["source"], [F.col("doc_id")]).where("rank % 5 = 0").select("source", "doc_id")


@query("first_per_group", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3")
def first_per_group(s, d):
    return S.first_per_group(I.documents(s, d, "source"), "source", "doc_id", 3).select("source", "doc_id")


@query("json_props", "SELECT event_id, (props->>'k')::INTEGER AS k FROM events")
def json_props(s, d):
    return I.table(s, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("json_recovery")
def json_recovery(s, d):
    """Replies with fences, prose around the array, or a lost end are read all the same."""
    e = I.table(s, d, "events").select("event_id", "props")
    p = F.col("props")
    two = F.concat(F.lit("["), p, F.lit(", "), p)
    reply = F.when(F.col("event_id") % 4 == 0, F.concat(two, F.lit("]"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), two, F.lit("]\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("Here: "), two, F.lit("] done"))).otherwise(F.concat(two, F.lit(", {\"k\"")))
    return e.select("event_id", F.transform(T.recovered_json(reply, "array<struct<k:int>>"), lambda x: x["k"]).alias("ks")).select("event_id", F.size("ks").cast("long").alias("n"), F.get("ks", F.lit(0)).alias("k"))


@query("json_nested_recovery", "SELECT event_id, 'ends } ' || event_id || ' [' AS first, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 2 END AS n FROM events")
def json_nested_recovery(s, d):
    """Replies that break off inside nested arrays and objects, with brackets and quotes in their strings."""
    i = F.col("event_id").cast("string")
    first = F.concat(F.lit('[{"k": "ends } '), i, F.lit(' [", "l": ["\\"]", {"m": 1}]}, '))
    lost = F.when(F.col("event_id") % 3 == 0, '{"k": "b", "l": [[1, {"m": "}]"').when(F.col("event_id") % 3 == 1, '{"k": "b}"}, {"k": "c').otherwise('{"k')
    got = T.recovered_json(F.concat(first, lost), "array<struct<k:string>>")
    return I.table(s, d, "events").select("event_id", got.alias("g")).select("event_id", F.get("g", F.lit(0))["k"].alias("first"), F.size("g").alias("n"))


ORACLE["json_recovery"] = "SELECT event_id, 2::BIGINT AS n, (props->>'k')::INTEGER AS k FROM events"


@query("bad_vectors", "SELECT vec_id FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x * x)) = 0")
def bad_vectors(s, d):
    return S.bad_vectors(I.table(s, d, "embeddings")).select("vec_id")


@query("cache_misses", "SELECT count(DISTINCT md5('m:' || text)) FILTER (NOT hit) AS misses, count(*) FILTER (hit) AS hits FROM (SELECT text, md5('m:' || text) IN (SELECT md5('m:' || text) FROM documents WHERE doc_id % 2 = 0) AS hit FROM documents)")
def cache_misses(s, d):
    docs = I.documents(s, d).select("doc_id", T.cache_key(F.lit("m"), F.col("text")).alias("key"))
    hits, misses = S.cache_split(docs, docs.where("doc_id % 2 = 0").select("key").distinct(), "key")
    return misses.agg(F.count(F.lit(1)).alias("misses")).crossJoin(hits.agg(F.count(F.lit(1)).alias("hits")))


@query("failure_log", "WITH l AS (SELECT event_id, 'eval_id=e' || event_id || ' baseline=' || event_type || ': failed' AS line FROM events WHERE event_type IN ('error', 'click')) SELECT regexp_extract(line, 'baseline=([^: ]+)', 1) AS baseline, count(*) AS n FROM l GROUP BY 1")
def failure_log(s, d):
    e = I.table(s, d, "events").where("event_type in ('error', 'click')")
    log = e.select(F.col("event_id").alias("line_no"), F.concat(F.lit("eval_id=e"), F.col("event_id").cast("string"), F.lit(" baseline="), F.col("event_type"), F.lit(": failed")).alias("line"))
    return S.failure_counts(log).select("baseline", "n")


@query("framework_means", "SELECT metric, count(value) AS n, round(avg(value), 4) AS mean FROM (SELECT 'p_size' AS metric, p_size::DOUBLE AS value FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) GROUP BY 1")
def framework_means(s, d):
    return S.framework_means(I.table(s, d, "part"), ["p_size", "p_retailprice"])


@query("document_hashes", "SELECT doc_id, substr(sha256(text), 1, 32) AS document_hash, CASE WHEN regexp_extract(text, '((?:19|20)[0-9][0-9])', 1) = '' THEN NULL ELSE regexp_extract(text, '((?:19|20)[0-9][0-9])', 1)::INTEGER END AS year, rtrim(substr(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 220)) AS snippet FROM documents")
def document_hashes(s, d):
    t = F.col("text")
    return I.documents(s, d).select("doc_id", T.document_hash(t).alias("document_hash"), T.first_year(t).alias("year"), T.clean_snippet(t).alias("snippet"))


@query("rate_limit_window", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS calls FROM events")
def rate_limit_window(s, d):
    """Calls of a user in the hour up to each call."""
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-3_600_000_000, Window.currentRow)
    return I.table(s, d, "events").select("user_id", "event_id", us.alias("us")).select("user_id", "event_id", F.count(F.lit(1)).over(w).alias("calls"))


@query("session_windows", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n_events, epoch_us(min(ts)) AS start_us FROM n GROUP BY user_id, k")
def session_windows(s, d):
    e = I.table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    w = F.session_window("ts", "6 hours")
    return e.groupBy("user_id", w).agg(F.count(F.lit(1)).alias("n_events")).select("user_id", "n_events", F.unix_micros("session_window.start").alias("start_us"))


def _folder(s, name: str) -> str:
    """A folder of this run in the cluster's shared checkpoint folder (of our own in tests)."""
    return f"{shared_folder(s)}/streams/{name}-{uuid.uuid4().hex[:10]}"


@query("stream_resume", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_resume(s, d):
    """The stream's rows, run to its end twice under one checkpoint: each key is written once."""
    I.table(s, d, "events")
    at = _folder(s, "resume")
    for _ in range(2):
        rows = Z.source(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        Z.to_table(Z.resumed(rows, "event_id", "ts").select("event_id", "event_type"), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_windows", """WITH w AS (SELECT event_type, (epoch_us(ts) // 300000000) * 300000000 AS start_us, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, start_us, n FROM w WHERE start_us + 300000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""")
def stream_windows(s, d):
    """Counts in five-minute windows, of windows that the watermark has closed."""
    I.table(s, d, "events")
    at = _folder(s, "windows")
    rows = Z.source(s, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    Z.to_table(Z.window_counts(rows, "ts", keys=("event_type",)), f"{at}/out", f"{at}/state")
    closed = s.read.schema("event_type string, start timestamp, n long").parquet(f"{at}/out")
    return closed.select("event_type", F.unix_micros("start").alias("start_us"), "n")


@query("stream_ring", "SELECT user_id, count(*) AS seen, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) FILTER (age <= 10) AS items FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS age FROM events) GROUP BY 1")
def stream_ring(s, d):
    """The last ten events of each user from the store of a stateful stream."""
    I.table(s, d, "events")
    at = _folder(s, "ring")
    rows = Z.source(s, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    states = Z.ring_states(rows, "user_id", "ts", "event_id")
    q = states.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{at}/out")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = s.read.parquet(f"{at}/out").groupBy("user_id").agg(F.max_by(F.struct("items", "seen"), "batch").alias("x"))
    return last.select("user_id", "x.seen", F.array_join(F.transform("x.items", lambda i: i.cast("string")), ",").alias("items"))


_SPLIT = "length(text) // 2"


@query("stream_tags", f"SELECT conv_id * 1000 + turn AS reply, substr(text, 1, ({_SPLIT})) AS thinking, ltrim(substr(text, ({_SPLIT}) + 1), ' ' || chr(10)) AS answer FROM conversations WHERE role = 'assistant'")
def stream_tags(s, d):
    """All assistant turns as tagged replies, cut in pieces whose length varies from reply to reply, through the stateful splitter."""
    t = I.table(s, d, "conversations").where("role = 'assistant'")
    half = F.floor(F.length("text") / 2).cast("int")
    reply = F.concat(F.lit("<thinking>"), F.substring(F.col("text"), F.lit(1), half), F.lit("</thinking>\n<answer>"), F.substring(F.col("text"), half + 1, F.length("text")), F.lit("</answer>"))
    size = (3 + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(23))).cast("int")
    cut = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply"), reply.alias("r"), size.alias("size"))
    cut = cut.select("reply", "r", "size", F.posexplode(F.sequence(F.lit(1), F.length("r"), F.col("size"))).alias("place", "at")).select("reply", F.col("place").cast("long").alias("place"), F.expr("substring(r, at, size)").alias("token"))
    at = _folder(s, "tags")
    for k in range(4):  # four files, one for each batch, in order
        cut.where(f"place >= {150 * k}" + (f" and place < {150 * (k + 1)}" if k < 3 else "")).coalesce(1).write.mode("append").parquet(f"{at}/in")
    rows = s.readStream.schema("reply long, place long, token string").option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    name, before = "spark.sql.streaming.stateStore.providerClass", s.conf.get("spark.sql.streaming.stateStore.providerClass")
    s.conf.set(name, Z.ROCKSDB)
    try:
        Z.to_table(Z.split_tags(rows, "reply", "place", "token"), f"{at}/out", f"{at}/state")
    finally:
        s.conf.set(name, before)
    said = s.read.schema("reply long, n long, kind string, text string").parquet(f"{at}/out")
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("n", "text")))), lambda x: x["text"]), "")
    return said.groupBy("reply").agg(of("thinking").alias("thinking"), F.ltrim(of("answer"), F.lit(" \n")).alias("answer"))


@query("memory_database", "SELECT event_id AS id, 's' || user_id AS session_id, event_type AS title, event_id * 10 AS epoch FROM events WHERE event_id >= 5 AND event_type <> 'click' AND event_id % 1000 < 700")
def memory_database(s, d):
    """Observations written to database files by the tasks that hold them, and read by ranges of row ids under pushed filters."""
    D.register(s)
    at = _folder(s, "memory")
    e = I.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("title"), (F.col("event_id") * 10).alias("epoch"))
    s.range(1).write.parquet(f"{at}/made")  # the folder
    D.write_databases(e, at)
    read = s.read.format("memory_database").option("path", at).option("rows", "2000").load()
    return read.where("id >= 5 and title <> 'click' and id % 1000 < 700")


@query("stream_log", "SELECT user_id, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def stream_log(s, d):
    """Logs of all events, one for each hundred users, read by bytes in two runs under one checkpoint; the last lines are torn."""
    D.register(s)
    at = _folder(s, "log")
    e = I.table(s, d, "events").select((F.col("user_id") % 100).alias("u"), F.to_json(F.struct("user_id", "event_id")).alias("value"))
    e.repartition("u").write.partitionBy("u").text(f"{at}/in")
    s.createDataFrame([(100, '{"user_id": 1, "ev')], "u int, value string").coalesce(1).write.mode("append").option("lineSep", " ").partitionBy("u").text(f"{at}/in")
    for _ in range(2):
        Z.to_table(s.readStream.format("appended_lines").option("path", f"{at}/in").option("bytes", str(1 << 20)).load(), f"{at}/out", f"{at}/state")
    rows = s.read.schema("path string, at long, line string").parquet(f"{at}/out").select(F.from_json("line", "user_id long, event_id long").alias("r")).select("r.*")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("cached_embeddings", "SELECT doc_id, FALSE AS first_hit, TRUE AS second_hit, TRUE AS equal, FALSE AS changed_hit FROM documents")
def cached_embeddings(s, d):
    """All documents embedded twice, then with every text changed: the second run computes nothing, the third everything."""
    cache, docs = E.VectorCache(_folder(s, "vectors"), E.HashedWords()), I.documents(s, d)
    first = cache.vectors(docs).select("doc_id", F.col("vector").alias("v1"), F.col("hit").alias("first_hit"))
    second = cache.vectors(docs).select("doc_id", F.col("vector").alias("v2"), F.col("hit").alias("second_hit"))
    third = cache.vectors(docs.withColumn("text", F.concat("text", F.lit(" \u0001"), F.col("doc_id").cast("string")))).select("doc_id", F.col("hit").alias("changed_hit"))
    return first.join(second, "doc_id").join(third, "doc_id").select("doc_id", "first_hit", "second_hit", (F.col("v1") == F.col("v2")).alias("equal"), "changed_hit")
