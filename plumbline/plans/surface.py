"""Queries over text scalars, sources and sinks, memory upkeep, strategies and summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import chunking as C
from plumbline.operators import faults as X
from plumbline.operators import memory as Y
from plumbline.operators import strategies as St
from plumbline.operators import summaries as U
from plumbline.operators import verification as V
from plumbline.plans import inputs as I
from plumbline.plans import retrieval as PR
from plumbline.session import shared_folder
from plumbline.sources import tables as S

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def _folder(s, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex[:10]}"


def _pick(i, *values):
    return F.get(F.array(*[v if hasattr(v, "alias") else F.lit(v) for v in values]), (i % len(values)).cast("int"))


# --- text scalars over planted replies ---


@query("generation_errors", "SELECT event_id, event_id % 4 < 3 AS failed FROM events")
def generation_errors(s, d):
    i = F.col("event_id")
    reply = _pick(i, "Error generating answer: x", "  error: late", "{'message': 'x'}", "The error: none")
    return I.table(s, d, "events").select("event_id", T.is_generation_error(reply).alias("failed"))


@query("context_blocks", "SELECT event_id, 'c' || event_id AS chunk_id, 'line ' || event_id || chr(10) || 'second' AS text FROM events UNION ALL SELECT event_id, 'd' || user_id, 'other' FROM events")
def context_blocks(s, d):
    """Two blocks of a prompt snapshot, the last before the question."""
    prompt = F.format_string("Rules\n--- Context chunk 1 [Chunk-ID: c%d] ---\nline %d\nsecond\n--- Context chunk 2 [Chunk-ID: d%d] ---\nother\n\nQuestion: why?", F.col("event_id"), F.col("event_id"), F.col("user_id"))
    return I.table(s, d, "events").select("event_id", F.explode(T.context_blocks(prompt)).alias("b")).select("event_id", "b.chunk_id", "b.text")


@query("page_numbers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 's1' WHEN 1 THEN 'l2' WHEN 2 THEN 'n3' ELSE 'unknown' END AS page, ['source', 'page_label', 'page_number', 'unknown'][event_id % 4 + 1] AS key FROM events")
def page_numbers(s, d):
    k = F.col("event_id") % 4
    p = T.page_number(F.when(k == 0, "s1"), F.when(k <= 1, "l2"), F.when(k <= 2, "n3"))
    return I.table(s, d, "events").select("event_id", p["page"].alias("page"), p["key"].alias("key"))


@query("payload_hashes", """SELECT event_id, substr(sha256('{"a":' || event_id || ',"b":"' || event_type || '"}'), 1, 16) AS hash FROM events""")
def payload_hashes(s, d):
    return I.table(s, d, "events").select("event_id", T.payload_hash(F.struct(F.col("event_id").alias("a"), F.col("event_type").alias("b"))).alias("hash"))


@query("year_ranges", "SELECT event_id, list_sort(list_distinct(list_concat(range(2000 + event_id % 5, 2003 + event_id % 5), [2001, 2020 + event_id % 3])))::INTEGER[] AS years FROM events")
def year_ranges(s, d):
    a = F.col("event_id") % 5
    spec = F.format_string("%d-%d, 2001,%d", 2000 + a, 2002 + a, 2020 + F.col("event_id") % 3)
    return I.table(s, d, "events").select("event_id", T.year_range(spec).alias("years"))


@query("keyword_queries", f"SELECT item_id, coalesce(nullif(array_to_string({PR._TOK}, ' '), ''), text) AS keywords FROM benchmark UNION ALL SELECT -1, 'What is it'")
def keyword_queries(s, d):
    q = I.table(s, d, "benchmark").select("item_id", "text").unionByName(s.createDataFrame([(-1, "What is it")], "item_id long, text string"))
    return q.select("item_id", T.keyword_query(F.col("text")).alias("keywords"))


@query("condensing", "SELECT event_id, event_id % 5 < 3 AS needed, CASE event_id % 4 WHEN 0 THEN 'rewritten ' || event_id ELSE 'the old question' END AS question FROM events")
def condensing(s, d):
    """Short, referring and cued follow-ups need a rewrite; an empty, missing or endless rewrite isn't taken."""
    i = F.col("event_id")
    asked = _pick(i, "And the second one?", "What did the court say about them in the last case", "Tell me more about the former president of the court", "Which judgment overruled the decision of the High Court in 1990", "How is a writ petition filed before the Supreme Court today")
    new = _pick(i, F.concat(F.lit(" rewritten "), i.cast("string"), F.lit(" ")), F.lit("  "), F.lit(None).cast("string"), F.repeat(F.lit("x"), 300))
    return I.table(s, d, "events").select("event_id", T.needs_condensing(asked, ["it", "them", "that"], ["tell me more"]).alias("needed"), T.accepted_rewrite(F.lit("the old question"), new).alias("question"))


@query("compare_keys", "SELECT page_id, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS key FROM pages")
def compare_keys(s, d):
    return I.table(s, d, "pages").select("page_id", T.compare_key(F.col("url")).alias("key"))


@query("templates", """SELECT p_partkey, 'Part ' || p_partkey || ' at ' || printf('%.3f', p_retailprice) || ' with 2 sizes, of ' || CASE WHEN p_partkey % 3 = 0 THEN 'N/A' ELSE p_brand END || ' N/A' AS text FROM part""")
def templates(s, d):
    """Fractions with three places, the number of an array's items, and N/A for what is missing."""
    p = I.table(s, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.array(F.lit(1), F.lit(2)).alias("sizes"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).alias("brand"))
    return p.select("p_partkey", T.interpolated(F.lit("Part {p_partkey} at {price} with {sizes_count} sizes, of {brand} {nothing}"), T.template_values(p, p.columns)).alias("text"))


@query("reply_parts", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'so ' || event_id ELSE '' END AS thinking, CASE event_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'plain ' || event_id ELSE 'open' END AS answer,
  CASE WHEN event_id % 2 = 0 THEN 'SUPPORTED' END AS status, CASE WHEN event_id % 2 = 0 THEN 'it says ' || event_id END AS reason, CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS agreed FROM events""")
def reply_parts(s, d):
    """Thinking and answer, a judge's status and reason, and a yes or no, of model replies."""
    i, n = F.col("event_id"), F.col("event_id").cast("string")
    reply = _pick(i, F.concat(F.lit("<thinking>so "), n, F.lit("</thinking>\n<answer>yes</answer>")), F.concat(F.lit(" plain "), n), F.lit("<answer> open"))
    judged = _pick(i, F.concat(F.lit("STATUS: supported\nREASON: it says "), n), F.lit("no idea"))
    a, v = T.answer_parts(reply), T.verdict(judged)
    return I.table(s, d, "events").select("event_id", a["thinking"].alias("thinking"), a["answer"].alias("answer"), v["status"].alias("status"), v["reason"].alias("reason"), T.yes_no(_pick(i, "Yes.", " no! ", "maybe")).alias("agreed"))


@query("safe_ids", "SELECT event_id, event_id % 3 = 0 AS safe FROM events")
def safe_ids(s, d):
    i = F.col("event_id").cast("string")
    return I.table(s, d, "events").select("event_id", _pick(F.col("event_id"), F.concat(F.lit("trace_"), i), F.concat(F.lit("../"), i), F.repeat(F.lit("a"), 129)).rlike(T.SAFE_ID).alias("safe"))


@query("first_present", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN 1 END, CASE WHEN c_custkey % 3 = 0 THEN 2 END, c_nationkey)::BIGINT AS value FROM customer")
def first_present(s, d):
    k = F.col("c_custkey")
    return I.table(s, d, "customer").select("c_custkey", T.first_present(F.when(k % 2 == 0, F.lit(1).cast("long")), F.when(k % 3 == 0, F.lit(2).cast("long")), F.col("c_nationkey").cast("long")).alias("value"))


@query("synthetic_toc", "SELECT r_regionkey, '3. ' || r_name || '.' || chr(10) || '4. Part ' || r_regionkey || '.' AS toc FROM region")
def synthetic_toc(s, d):
    return I.table(s, d, "region").select("r_regionkey", C.synthetic_toc(F.array("r_name", F.concat(F.lit("Part "), F.col("r_regionkey").cast("string"))), 3).alias("toc"))


@query("fault_uniforms", f"SELECT event_id, round(('0x' || substr(sha256('{X.SEED}:noise:' || event_id || ':' || user_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 9) AS u FROM events")
def fault_uniforms(s, d):
    return I.table(s, d, "events").select("event_id", F.round(X.uniform("noise", F.col("event_id"), F.col("user_id")), 9).alias("u"))


def _draw(p: str) -> str:
    return f"(('0x' || substr(sha256('{X.SEED}:{p}:' || event_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("simulated_draws", f"SELECT event_id, round(sqrt(-2 * ln(1 - {_draw('noise:u')})) * cos(2 * pi() * {_draw('noise:v')}), 6) AS noise, round(pow(1 - {_draw('depth')}, -1 / 1.5::DOUBLE), 6) AS depth FROM events")
def simulated_draws(s, d):
    """Gaussian noise and Pareto depths from hashes, the same in any engine."""
    i = F.col("event_id")
    return I.table(s, d, "events").select("event_id", F.round(X.normal("noise", i), 6).alias("noise"), F.round(X.pareto(1.5, "depth", i), 6).alias("depth"))


@query("rate_limit_waits", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r(user_id, event_id, i, l, wait, ok) AS (SELECT user_id, event_id, i, [us], 0::BIGINT, TRUE FROM e WHERE i = 1 UNION ALL
  SELECT user_id, event_id, i, CASE WHEN w <= 20 * 3600000000 THEN list_append(l, us + w)[-2:] ELSE l END, w, w <= 20 * 3600000000 FROM (SELECT e.*, l, greatest(0, CASE WHEN len(l) >= 2 THEN l[1] + 86400000000 - us ELSE 0 END)::BIGINT AS w FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1))
SELECT user_id, event_id, wait AS wait_us, CASE WHEN wait = 0 THEN 1 WHEN wait <= 2 * 3600000000 THEN 2 WHEN wait <= 6 * 3600000000 THEN 3 WHEN wait <= 12 * 3600000000 THEN 4 ELSE 5 END::INTEGER AS attempts, ok AS admitted FROM r""")
def rate_limit_waits(s, d):
    """Two calls a day for each user; retries two, four, six and eight hours after the one before."""
    from plumbline.streaming import traces as Z

    at = _folder(s, "waits")
    I.table(s, d, "events")
    rows = Z.source(s, f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    Z.to_table(Z.admissions(rows, "user_id", "ts", "event_id", 2, 86_400, 4, 7_200), f"{at}/out", f"{at}/state")
    return s.read.parquet(f"{at}/out").select("user_id", "event_id", "wait_us", "attempts", "admitted")


# --- claims: escalation, missing evidence, backfill ---


@query("claim_escalation", f"""WITH {I.TRACES_SQL}, j AS (SELECT claim_id, status, ['SUPPORTED', 'CERTAIN', NULL, 'CONTRADICTED'][claim_id % 4 + 1] AS judged FROM verified)
SELECT claim_id, CASE WHEN status IN ('PARTIALLY_SUPPORTED', 'NOT_VERIFIABLE') AND judged IN ('SUPPORTED', 'CONTRADICTED') THEN judged ELSE status END AS escalated, CASE WHEN status = 'UNSUPPORTED' AND claim_id % 3 = 0 THEN 'NOT_VERIFIABLE' ELSE status END AS honest FROM j""")
def claim_escalation(s, d):
    """A judge decides what is undecided, if it names a status; unsupported without recoverable evidence is not verifiable."""
    i, st = F.col("claim_id"), F.col("status")
    judged = _pick(i, F.lit("SUPPORTED"), F.lit("CERTAIN"), F.lit(None).cast("string"), F.lit("CONTRADICTED"))
    return I.claim_scores(s, d).select("claim_id", V.escalated(st, judged).alias("escalated"), V.unrecoverable(st, i % 3 == 0).alias("honest"))


@query("evidence_backfill", "SELECT doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'prompt ' || doc_id WHEN doc_id % 4 = 1 THEN 'second' WHEN doc_id % 4 = 2 THEN substr(text, 1, 400) ELSE '' END AS text FROM documents")
def evidence_backfill(s, d):
    """A chunk's text from the prompt, else the first registry that has it, else none."""
    docs = I.documents(s, d)
    k = F.col("doc_id") % 4
    traces = docs.select(F.col("doc_id").alias("chunk_id"), F.when(k == 0, F.concat(F.lit("prompt "), F.col("doc_id").cast("string"))).alias("prompt_text"))
    one = docs.where(k == 1).select(F.col("doc_id").alias("chunk_id"), F.lit("second").alias("text"))
    two = docs.where((k == 1) | (k == 2)).select(F.col("doc_id").alias("chunk_id"), "text")
    return S.backfilled(traces, [one, two]).select("chunk_id", "text")


# --- sources and sinks, written and read back ---


@query("source_csv", "SELECT doc_id, md5(text) AS digest FROM documents")
def source_csv(s, d):
    """Texts with line ends and quotes through a CSV file."""
    path = _folder(s, "csv")
    I.documents(s, d).write.option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return S.read_csv(s, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("digest"))


@query("source_json_array", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def source_json_array(s, d):
    """Each language's documents as one JSON array (a file is one text to its task, as the format has it)."""
    path = _folder(s, "arrays")
    rows = I.documents(s, d, "lang").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")).agg(F.to_json(F.collect_list(F.struct("doc_id", "text", "lang"))).alias("value"))
    rows.repartition("part").select("part", "value").write.partitionBy("part").text(path)
    return S.read_json_array(s, path, "doc_id long, text string, lang string, part int").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("source_json_lines", "SELECT event_id % 3 = 1 AS broken, count(*) AS n, sum(CASE WHEN event_id % 3 <> 1 THEN event_id END)::BIGINT AS ids FROM events GROUP BY 1")
def source_json_lines(s, d):
    """Good and broken lines, with blank ones between them."""
    path = _folder(s, "lines")
    i = F.col("event_id")
    line = F.when(i % 3 == 1, F.concat(F.lit('{"id": '), i.cast("string"))).otherwise(F.to_json(F.struct(i.alias("id"))))
    I.table(s, d, "events").select(F.concat(line, F.when(i % 2 == 0, "\n").otherwise("")).alias("value")).write.text(path)
    rows = S.read_json_lines(s, path, "id long").select("id", F.col("_corrupt_record").isNotNull().alias("broken"))
    return rows.groupBy("broken").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~F.col("broken"), F.col("id"))).alias("ids"))


@query("source_directory", "SELECT r_regionkey, r_name || chr(10) AS text, 'txt' AS suffix, NULL::VARCHAR AS error FROM region")
def source_directory(s, d):
    path = _folder(s, "files")
    I.table(s, d, "region").select("r_regionkey", "r_name").repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    rows = S.read_directory(s, path)
    return rows.select(F.regexp_extract("path", r"r_regionkey=(\d+)", 1).cast(dict(I.table(s, d, "region").dtypes)["r_regionkey"]).alias("r_regionkey"), "text", "suffix", "error")


@query("source_traces", f"WITH {I.ANSWERS_SQL} SELECT trace_id, answer AS generated_answer, 'd' || (conv_id % 3) AS date FROM answers WHERE trace_id % 5 <> 0")
def source_traces(s, d):
    """Dated traces; those without an answer are passed over."""
    path = _folder(s, "dated")
    a = I.answers(s, d).select("trace_id", F.when(F.col("trace_id") % 5 != 0, F.col("answer")).alias("generated_answer"), F.concat(F.lit("d"), (F.col("conv_id") % 3).cast("string")).alias("date"))
    S.write_traces(a.repartition(64, "trace_id").withColumn("one", F.col("trace_id")).drop("one"), path)
    lines = S.read_json_lines(s, path, "trace_id long, generated_answer string, date string")
    return lines.where("generated_answer is not null").select("trace_id", "generated_answer", "date")


@query("source_widened", "SELECT doc_id, quality, NULL::INTEGER AS toxic FROM labels UNION ALL SELECT doc_id, NULL, toxic FROM labels")
def source_widened(s, d):
    rows = I.table(s, d, "labels")
    kinds = dict(rows.dtypes)
    return S.widened(rows.select("doc_id", "quality"), rows.select("doc_id", "toxic")).select("doc_id", F.col("quality").cast(kinds["quality"]).alias("quality"), F.col("toxic").cast("int").alias("toxic"))


@query("source_united", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' WHEN doc_id % 3 = 0 THEN 'second' ELSE 'third' END AS origin FROM documents")
def source_united(s, d):
    docs = I.documents(s, d).select("doc_id")
    return S.united([docs.where(w).withColumn("origin", F.lit(n)) for n, w in (("first", "doc_id % 2 = 0"), ("second", "doc_id % 3 = 0"), ("third", "true"))], "doc_id").select("doc_id", "origin")


@query("session_exports", """SELECT conv_id AS session_id, '# ' || conv_id || chr(10) || chr(10) || string_agg('**' || role || '**: ' || text, chr(10) ORDER BY turn) AS document FROM conversations GROUP BY 1""")
def session_exports(s, d):
    m = I.table(s, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("ordinal"), "role", "text")
    return S.session_export(m, "markdown")


@query("registry_publish", "SELECT l.doc_id AS chunk_id, 2 AS version, 'kept' AS state FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 2 = 0) l UNION ALL SELECT doc_id, 1, 'obsolete' FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id % 2 <> 0)")
def registry_publish(s, d):
    """A second version with half the ids: what it holds, and what it made obsolete."""
    path = _folder(s, "registry")
    c = I.table(s, d, "labels").select(F.col("doc_id").alias("chunk_id")).distinct()
    v = c.withColumn("v", F.col("chunk_id") * 2)
    old = S.publish(c.withColumn("version", F.lit(1)), v, path)
    S.publish(c.where("chunk_id % 2 = 0").withColumn("version", F.lit(2)), v.where("chunk_id % 2 = 0"), path)
    now, before = S.published(s, path), S.published(s, path, old)
    return now.select("chunk_id", "version", F.lit("kept").alias("state")).unionByName(S.obsolete_ids(before, now).select("chunk_id", F.lit(1).alias("version"), F.lit("obsolete").alias("state")))


@query("registry_index", "SELECT conv_id AS parent_document_id, array_to_string(list(conv_id || '_' || turn ORDER BY turn), ',') AS chunk_ids FROM conversations GROUP BY 1")
def registry_index(s, d):
    c = I.table(s, d, "conversations").select(F.col("conv_id").alias("parent_document_id"), F.col("turn").alias("chunk_index"), F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("chunk_id"))
    return S.registry_index(c).select("parent_document_id", F.array_join("chunk_ids", ",").alias("chunk_ids"))


@query("checkpoint_repair", "SELECT user_id, count(*) AS n FROM events GROUP BY 1")
def checkpoint_repair(s, d):
    """Files of records, one for about each hundred users, each with a torn last line; all whole records come back."""
    path = _folder(s, "records")
    e = I.table(s, d, "events")
    users = e.agg(F.approx_count_distinct("user_id")).first()[0]
    u = F.pmod(F.xxhash64("user_id"), F.lit(max(1, -(-users // 100)))).alias("u")
    lines = e.select(u, F.lit(0).alias("torn"), F.to_json(F.struct(F.col("event_id").alias("example_id"), "user_id")).alias("value"))
    torn = e.select(u).distinct().select("u", F.lit(1).alias("torn"), F.lit('{"example_id": 1, "us').alias("value"))
    lines.unionByName(torn).repartition("u").sortWithinPartitions("u", "torn").select("u", "value").write.partitionBy("u").text(path)
    return S.checkpoint_records(s, path, "example_id long, user_id long").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("source_partitions", "SELECT doc_id, lang, doc_id % 3 AS year FROM documents WHERE doc_id % 3 <> 1 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5")
def source_partitions(s, d):
    """The first five of each language from two of three years' folders."""
    path = _folder(s, "years")
    I.documents(s, d, "lang").select("doc_id", "lang", (F.col("doc_id") % 3).alias("year"), F.col("lang").alias("court")).repartition("year", "court").write.partitionBy("year", "court").parquet(path)
    return S.read_partitions(s, path, "court", "doc_id", 5, "year <> 1").select("doc_id", "lang", F.col("year").cast("long").alias("year"))


@query("vector_store", "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 100 ELSE label END AS label, round(CASE WHEN vec_id % 10 = 4 THEN 0.5 ELSE embedding[1]::DOUBLE END, 6) AS first FROM embeddings WHERE vec_id % 7 <> 0 AND vec_id % 2 = 0")
def vector_store(s, d):
    """Upserts, broken vectors embedded again, a deletion, and a look at the even ids."""
    v = I.table(s, d, "embeddings").withColumn("label", F.col("label").cast("long"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), 64)
    store = v.withColumn("embedding", F.when(F.col("vec_id") % 10 == 4, zero).otherwise(F.col("embedding")))
    store = S.upserted(store, store.where("vec_id % 3 = 0").withColumn("label", F.lit(100).cast("long")), "vec_id")
    store = S.repaired(store, v.select("vec_id", F.array_repeat(F.lit(0.5).cast("float"), 64).alias("embedding")), "vec_id")
    store = Y.without(store, v.where("vec_id % 7 = 0").select("vec_id"), "vec_id")
    got = S.by_ids(store, v.where("vec_id % 2 = 0"), "vec_id")
    kind = dict(I.table(s, d, "embeddings").dtypes)["label"]
    return got.select("vec_id", F.col("label").cast(kind).alias("label"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("top_documents", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def top_documents(s, d):
    """A report of the twenty longest."""
    return S.top(I.documents(s, d, "n_chars"), F.desc("n_chars"), "doc_id", 20).select("doc_id", "n_chars")


# --- memory upkeep ---


def _found(s, d):
    """Memories with given scores: an event is a memory of its user, asked for by the user's number."""
    e = I.table(s, d, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where("rank <= 5")
    return e.select(F.col("user_id").alias("query_id"), "rank", F.col("event_id").alias("memory_id"), (F.col("event_id") % 2).alias("session_id"), F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("question"), F.col("event_type").alias("answer"), (F.col("event_id") % 64 / 64.0).alias("score"))


@query("memory_context", """WITH f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events QUALIFY rank <= 5)
SELECT user_id AS query_id, string_agg('--- ' || CASE WHEN event_id % 2 = 1 THEN 'Current Session Interaction' ELSE 'Previous conversation' END || ' ' || rank || ' (Relevance: ' || printf('%d.%02d', (floor(event_id % 64 / 64.0 * 100 + 0.5)::BIGINT // 100), floor(event_id % 64 / 64.0 * 100 + 0.5)::BIGINT % 100) || ') ---' || chr(10) || 'Q: q' || event_id || chr(10) || 'A: ' || event_type || chr(10), chr(10) ORDER BY rank) AS context FROM f GROUP BY 1""")
def memory_context(s, d):
    """The odd session is the current one."""
    return Y.context(_found(s, d), F.lit(1))


@query("memory_reasons", """SELECT event_id, coalesce(nullif(concat_ws('; ', CASE WHEN event_id % 101 > 70 THEN printf('High semantic match (0.%02d)', event_id % 101) WHEN event_id % 101 > 50 THEN printf('Moderate semantic match (0.%02d)', event_id % 101) END,
  CASE WHEN event_id % 10 > 8 THEN 'Recent conversation' END, CASE WHEN event_id % 4 > 2 THEN 'Frequently referenced' END, CASE WHEN event_id % 5 > 3 THEN 'High importance' END), ''), 'Relevant memory') AS reason FROM events WHERE event_id % 101 < 100""")
def memory_reasons(s, d):
    i = F.col("event_id")
    e = I.table(s, d, "events").where(i % 101 < 100)
    return e.select("event_id", (i % 101 / 100.0).alias("semantic"), F.when(i % 10 > 8, 0.9).otherwise(0.1).alias("recency"), F.when(i % 4 > 2, 0.6).otherwise(0.2).alias("frequency"), F.when(i % 5 > 3, 0.9).otherwise(0.3).alias("capped")).select("event_id", Y.reason().alias("reason"))


@query("memory_access", "SELECT event_id % 100 AS memory_id, count(*) AS accesses, TIMESTAMP '2024-02-01 00:00:00' AS last_accessed FROM events GROUP BY 1")
def memory_access(s, d):
    hits = I.table(s, d, "events").select((F.col("event_id") % 100).alias("memory_id"))
    return Y.access_updates(hits, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query("memory_cascade", "SELECT 'memories' AS name, count(*) FILTER (user_id % 3 <> 0) AS n, sum(CASE WHEN user_id % 3 <> 0 THEN event_id END)::BIGINT AS ids FROM events UNION ALL SELECT 'vectors', count(*) FILTER (user_id % 3 <> 0), sum(CASE WHEN user_id % 3 <> 0 THEN event_id END)::BIGINT FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'sessions', count(DISTINCT user_id), sum(DISTINCT user_id)::BIGINT FROM events WHERE user_id % 3 <> 0")
def memory_cascade(s, d):
    """Sessions divisible by three go, with their memories and these memories' vectors."""
    e = I.table(s, d, "events").select(F.col("event_id").alias("memory_id"), F.col("user_id").alias("session_id"))
    gone = e.where("session_id % 3 = 0").select("session_id").distinct()
    left = Y.cascaded(e, {"vectors": e.where("memory_id % 2 = 0").select("memory_id"), "sessions": e.select("session_id").distinct()}, gone)
    rows = [df.select(F.lit(name).alias("name"), F.col("memory_id" if "memory_id" in df.columns else "session_id").alias("id")) for name, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("session_import", "SELECT CASE WHEN user_id % 2 = 0 THEN 'new' ELSE user_id::VARCHAR END AS session_id, count(*) AS memory_count FROM events WHERE user_id % 2 = 0 OR user_id % 3 <> 0 GROUP BY 1")
def session_import(s, d):
    """Even users' memories imported into one new session, the odd ones kept but for those divisible by three."""
    from plumbline.api import Sessions

    m = I.table(s, d, "events").select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("memory_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"), "ts", "user_id")
    kept = Sessions(m.where("user_id % 2 <> 0 and user_id % 3 <> 0"))
    return kept.imported(m.where("user_id % 2 = 0"), "new").list().select("session_id", "memory_count")


# --- strategies ---


def _held(s, d):
    """Customers as documents, nations as questions."""
    c = I.table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("query_id"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))


def _rounds(s):
    from plumbline.session import written

    return written


_HELD = "cu AS (SELECT c_custkey AS doc_id, c_nationkey AS query_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer)"


@query("agent_steps", f"""WITH {_HELD}, ev AS (SELECT query_id, doc_id FROM cu WHERE rank <= 3), lx AS (SELECT n_nationkey AS query_id, c_custkey AS doc_id FROM nation JOIN customer ON c_custkey % 25 = (n_nationkey + 1) % 25 AND c_custkey < 60),
n AS (SELECT n_nationkey AS query_id, (SELECT count(*) FROM lx WHERE lx.query_id = n_nationkey AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.query_id = lx.query_id AND ev.doc_id = lx.doc_id)) AS n_new FROM nation WHERE n_nationkey IN (SELECT query_id FROM ev))
SELECT query_id, 1 AS step, 'lexical_search' AS action, n_new, NULL AS termination FROM n UNION ALL SELECT query_id, 2, ['stop', NULL, 'dance'][query_id % 3 + 1], 0, ['stop', 'planner_error', 'invalid_action'][query_id % 3 + 1] FROM n""")
def agent_steps(s, d):
    """A first search, a planned lexical search, and three ways to end."""
    held = _held(s, d)
    q = held.select("query_id").distinct().withColumn("question", F.lit("x"))
    first = lambda qs: qs.join(held.where("rank <= 3"), "query_id").select("query_id", "doc_id", (1.0 / F.col("rank")).alias("score"))
    numbers = held.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 25).cast("string").alias("question"))
    lexical = lambda qs: qs.join(numbers, "question").select("query_id", "doc_id", F.lit(0.5).alias("score"))

    def plan(evidence, i):
        k = F.col("query_id") % 3
        action = F.lit("lexical_search") if i == 1 else F.when(k == 0, "stop").when(k == 2, "dance")
        return evidence.select("query_id").distinct().select("query_id", action.alias("action"), ((F.col("query_id") + 1) % 25).cast("string").alias("argument"))

    return St.agentic(q, {"semantic_search": first, "lexical_search": lexical}, plan, _rounds(s))[1].select("query_id", "step", "action", "n_new", "termination")


@query("contradictions", f"""WITH {_HELD}, mx AS (SELECT max(c_custkey) AS m FROM customer), ed AS (SELECT c_custkey AS src, (c_custkey * 3 + 1) % m + 1 AS dst FROM customer, mx WHERE c_custkey % 2 = 0),
pr AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS o FROM cu WHERE doc_id % 7 = 0 QUALIFY o <= 3), se AS (SELECT query_id, doc_id AS seed, rank FROM cu WHERE rank <= 5),
hp AS (SELECT seed, id, min(hop) AS hop FROM (SELECT seed, dst AS id, 1 AS hop FROM (SELECT DISTINCT seed FROM se) JOIN ed ON src = seed UNION ALL SELECT seed, y.dst, 2 FROM (SELECT DISTINCT seed FROM se) JOIN ed x ON x.src = seed JOIN ed y ON y.src = x.dst) WHERE id <> seed GROUP BY 1, 2),
li AS (SELECT query_id, id AS doc_id, min(100 + hop * 10 + rank) AS rank FROM se JOIN hp USING (seed) GROUP BY 1, 2), al AS (SELECT query_id, doc_id, min(o) AS o FROM (SELECT * FROM pr UNION ALL SELECT * FROM li) GROUP BY 1, 2)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY o, doc_id) AS rank FROM al QUALIFY rank <= 4""")
def contradictions(s, d):
    """A probe's first three, then cases with adverse edges within two steps of the first five."""
    held = _held(s, d)
    most = held.agg(F.max("doc_id").alias("m"))
    edges = held.where("doc_id % 2 = 0").crossJoin(F.broadcast(most)).select(F.col("doc_id").alias("src"), ((F.col("doc_id") * 3 + 1) % F.col("m") + 1).alias("dst"), F.lit("CASE_DOUBTS_CASE").alias("relation"))  # one row
    probe = held.where("doc_id % 7 = 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    chunks = held.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("chunk_id"))
    q = held.select("query_id").distinct().withColumn("question", F.lit("x"))
    out = St.contradictions(q, lambda qs: qs.join(probe, "query_id").select("query_id", "doc_id", "rank"), held, edges, chunks)
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


_ARM_SQL = f"{PR._BM25}, {PR._OVER}, f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS s FROM second a FULL JOIN sparse b ON a.query_id = b.query_id AND a.doc_id = b.doc_id), h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM f)"


@query("arm_runs", f"WITH {_ARM_SQL} SELECT 'A_bm25' AS arm, query_id, doc_id, rank FROM sparse WHERE rank <= 10 UNION ALL SELECT 'A_vector', query_id, doc_id, rank FROM second WHERE rank <= 10 UNION ALL SELECT 'B_hybrid', query_id, doc_id, rank FROM h WHERE rank <= 10")
def arm_runs(s, d):
    """The three arms without a reranker or a loop, from one set of rankings."""
    from plumbline.operators.retrieval import rrf

    sparse, second = PR._bm25(s, d), PR._second(s, d)
    rankings = {"bm25": sparse, "vector": second, "hybrid": rrf(second, sparse)}
    out = [St.run_arm(a, rankings).select(F.lit(a).alias("arm"), "query_id", "doc_id", F.col("rank").cast("long").alias("rank")) for a in ("A_bm25", "A_vector", "B_hybrid")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("appended_chunks", f"WITH {PR._BM25}, {PR._OVER}, b AS (SELECT query_id, doc_id, rank FROM sparse WHERE rank <= 4), z AS (SELECT query_id, max(rank) AS size FROM b GROUP BY 1), x AS (SELECT s.query_id, s.doc_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.rank, s.doc_id) AS n FROM second s ANTI JOIN b ON b.query_id = s.query_id AND b.doc_id = s.doc_id QUALIFY n <= 2) SELECT * FROM b UNION ALL SELECT x.query_id, x.doc_id, coalesce(size, 0) + n FROM x LEFT JOIN z USING (query_id)")
def appended_chunks(s, d):
    """Four chunks of one arm, then two new ones of the other."""
    out = St.appended(PR._bm25(s, d, 4), PR._second(s, d), 2)
    return out.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))


# --- summaries of experiments ---

_ROWS = "xr AS (SELECT event_id AS example_id, event_type AS arm, (event_id % 17) / 16.0::DOUBLE AS score, ['A', 'B', 'C'][event_id % 3 + 1] AS expected, ['A', 'B', 'C'][event_id % 4 % 3 + 1] AS found, CASE WHEN event_id % 5 <> 0 THEN (event_id % 11) / 10.0::DOUBLE END AS faithfulness FROM events)"


def _examples(s, d):
    i = F.col("event_id")
    return I.table(s, d, "events").select(i.alias("example_id"), F.col("event_type").alias("arm"), (i % 17 / 16.0).alias("score"), _pick(i, "A", "B", "C").alias("expected"), _pick(i % 4, "A", "B", "C").alias("found"), F.when(i % 5 != 0, i % 11 / 10.0).alias("faithfulness"))


@query("score_cause_agreement", f"""WITH {_ROWS}, p AS (SELECT score AS x, (expected <> 'A')::INT::DOUBLE AS y, score < 0.5 AS a, expected <> 'A' AS b FROM xr), m AS (SELECT *, avg(x) OVER () AS mx, avg(y) OVER () AS my FROM p),
k AS (SELECT count(*)::DOUBLE AS n, avg((a = b)::INT) AS po, avg(a::INT) * avg(b::INT) + (1 - avg(a::INT)) * (1 - avg(b::INT)) AS pe FROM p)
SELECT (SELECT round(sum((x - mx) * (y - my)) / (sqrt(sum((x - mx) ^ 2)) * sqrt(sum((y - my) ^ 2))), 4) FROM m) AS r, round((po - pe) / (1 - pe), 4) AS kappa, n::BIGINT AS n, round(po, 4) AS agreement FROM k""")
def score_cause_agreement(s, d):
    """Whether a low score tells that a cause was found."""
    return U.score_agreement(_examples(s, d), "score", F.col("expected") != "A", 0.5)


@query("generation_by_arm", f"WITH {_ROWS} SELECT arm, count(*) AS n, count(faithfulness) AS n_scored, round(avg(faithfulness), 4) AS faithfulness, round(avg(score), 4) AS score FROM xr GROUP BY 1")
def generation_by_arm(s, d):
    return U.by_arm(_examples(s, d), "arm", "faithfulness", ["faithfulness", "score"])


@query("live_accuracy", f"WITH {_ROWS} SELECT expected, count(*) AS n, count(*) FILTER (expected = found) AS correct, count(*) FILTER (found <> 'A') AS detected, round(avg((expected = found)::INT), 4) AS accuracy FROM xr GROUP BY ROLLUP (expected)")
def live_accuracy(s, d):
    """Accuracy of found causes by the expected one, and over all (null)."""
    return U.accuracy_by_cause(_examples(s, d), "expected", "found", "A")
