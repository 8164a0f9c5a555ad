"""Queries over claim places, strategies, views and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import claims as K
from plumbline.operators import graph as G
from plumbline.operators import retrieval as R
from plumbline.operators import strategies as St
from plumbline.plans import claims as PC
from plumbline.plans import graphs as PG
from plumbline.plans import inputs as I
from plumbline.plans import retrieval as PR
from plumbline.session import shared_folder

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


_LOCATED = f"""WITH {PC._CLAIMS}, one AS (SELECT trace_id, claim_no, trim(claim) AS claim FROM claims WHERE trim(claim) <> '' QUALIFY row_number() OVER (PARTITION BY trace_id, lower(trim(claim)) ORDER BY claim_no) = 1),
pl AS (SELECT o.trace_id, claim_no, claim, strpos(answer, claim) - 1 AS pos FROM one o JOIN answers a USING (trace_id))"""


def _claims_and_answers(s, d):
    """Dealt by trace before claims are taken out, so that these repeat and meet their answer where they are.

    A claim has three words, so shorter answers have none; said here, this keeps both sides' shuffle the same one.
    """
    answers = K.dealt(I.answers(s, d).select("trace_id", "answer").where(F.length("answer") >= K.GRAM), "trace_id")
    return PC.claims_of(answers, "trace_id"), answers


@query("claim_places", f"{_LOCATED} SELECT trace_id, trace_id::VARCHAR || '_C' || lpad((claim_no + 1)::VARCHAR, 3, '0') AS claim_id, pos::INTEGER AS character_start, (pos + length(claim))::INTEGER AS character_end, sha256(lower(trim(claim))) AS claim_hash FROM pl WHERE pos >= 0")
def claim_places(s, d):
    found = K.located(*_claims_and_answers(s, d))
    return found.where("match_type = 'exact'").select("trace_id", "claim_id", "character_start", "character_end", "claim_hash")


#: Letters of more than one byte in the texts, which the comparison's edit distance would count by bytes; each stands for a control character.
_WIDE = "éèêçöäüßñóíáúÉÈÊÇÖÄÜÑÓÍÁÚ"
_NARROW = " || ".join(f"chr({i})" for i in [*range(1, 9), 11, 12, *range(14, 28)][: len(_WIDE)])


def _fuzzy_sql(rows: str) -> str:
    """CTEs that end in fz (trace_id, claim_no, pos, ratio), from rows (trace_id, claim_no, claim, answer)."""
    return f"""fr AS (SELECT *, length(claim) AS n, greatest(length(answer) - length(claim), 0) AS last, greatest(length(claim) // 8, {K.BAND}) AS width, translate(claim, '{_WIDE}', {_NARROW}) AS c1, translate(answer, '{_WIDE}', {_NARROW}) AS a1 FROM ({rows}) WHERE length(claim) >= {K.GRAM}),
go AS (SELECT trace_id, claim_no, last, width, p, substr(claim, p + 1, {K.GRAM}) AS gram FROM fr, unnest(range(n - {K.GRAM - 1})) t(p)),
ga AS (SELECT trace_id, a, substr(answer, a + 1, {K.GRAM}) AS gram FROM (SELECT DISTINCT trace_id, answer FROM fr), unnest(range(length(answer) - {K.GRAM - 1})) t(a)),
vo AS (SELECT trace_id, claim_no, band, count(*) AS votes FROM (SELECT DISTINCT go.trace_id, claim_no, a, least(greatest(a - p, 0), last) // width AS band FROM ga JOIN go ON go.trace_id = ga.trace_id AND go.gram = ga.gram) GROUP BY 1, 2, 3),
bb AS (SELECT trace_id, claim_no, band FROM vo QUALIFY row_number() OVER (PARTITION BY trace_id, claim_no ORDER BY votes DESC, band) <= {K.BANDS}),
st AS (SELECT fr.*, band, unnest(range(band * width, least(band * width + width - 1, last) + 1)) AS pos FROM fr JOIN bb ON bb.trace_id = fr.trace_id AND bb.claim_no = fr.claim_no),
di AS (SELECT trace_id, claim_no, pos, 1 - levenshtein(substr(a1, pos + 1, n), c1) / greatest(n, length(substr(a1, pos + 1, n)))::DOUBLE AS ratio FROM st),
fz AS (SELECT * FROM di WHERE ratio >= {K.LEAST_RATIO} QUALIFY row_number() OVER (PARTITION BY trace_id, claim_no ORDER BY ratio DESC, pos) = 1)"""


@query("claim_statistics", f"""{_LOCATED}, {_fuzzy_sql("SELECT pl.trace_id, pl.claim_no, pl.claim, answer FROM pl JOIN answers USING (trace_id) WHERE pos < 0")},
al AS (SELECT trace_id, pos FROM pl WHERE pos >= 0 UNION ALL SELECT pl.trace_id, fz.pos FROM pl LEFT JOIN fz ON fz.trace_id = pl.trace_id AND fz.claim_no = pl.claim_no WHERE pl.pos < 0)
SELECT trace_id, count(*) AS total_claims, count(DISTINCT pos) AS total_sentences, round(coalesce(count(*) / nullif(count(DISTINCT pos), 0)::DOUBLE, 0), 2) AS claims_per_sentence FROM al GROUP BY 1""")
def claim_statistics(s, d):
    return K.claim_statistics(K.located(*_claims_and_answers(s, d)))


#: Claims are reworded: every second one loses letters, the others have some exchanged and a word put in.
_REWORDED = """SELECT trace_id, claim_no, CASE WHEN claim_no % 2 = 0 THEN replace(replace(claim, 'on', 'o'), 'er', 'e') ELSE replace(replace(claim, 'e ', 'a '), 't', 'th') || ' indeed' END AS claim, answer FROM pl JOIN answers USING (trace_id)"""


@query("claim_fuzzy_places", f"{_LOCATED.replace('claim, strpos', 'o.claim, strpos')}, {_fuzzy_sql(_REWORDED.replace('SELECT trace_id, claim_no', 'SELECT pl.trace_id, pl.claim_no').replace('answer FROM', 'answers.answer FROM'))} SELECT trace_id, claim_no, pos::INTEGER AS character_start, round(ratio, 6) AS ratio FROM fz")
def claim_fuzzy_places(s, d):
    """Where reworded claims come from in their answers."""
    claims, answers = _claims_and_answers(s, d)
    less = F.replace(F.replace("claim", F.lit("on"), F.lit("o")), F.lit("er"), F.lit("e"))
    more = F.concat(F.replace(F.replace("claim", F.lit("e "), F.lit("a ")), F.lit("t"), F.lit("th")), F.lit(" indeed"))
    reworded = K.own_claims(claims).select("trace_id", "claim_no", F.when(F.col("claim_no") % 2 == 0, less).otherwise(more).alias("claim")).join(answers, "trace_id")
    return K.fuzzy_places(reworded, stay=True).select("trace_id", "claim_no", F.col("at").alias("character_start"), F.round("ratio", 6).alias("ratio"))


@query("prompt_context", f"WITH {PR._BM25} SELECT query_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank DESC)) AS digest FROM sparse JOIN documents USING (doc_id) WHERE rank <= 6 GROUP BY 1")
def prompt_context(s, d):
    """Chunks in the order of a prompt: the best one last."""
    top = PR._bm25(s, d, 6).join(I.documents(s, d), "doc_id").select("query_id", "rank", "text")
    return R.prompt_order(top).select("query_id", F.md5("context").alias("digest"))


@query("planner_context", f"""WITH {PR._BM25}, e AS (SELECT query_id, rank, substr(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 400) AS s FROM sparse JOIN documents USING (doc_id) WHERE rank <= 20),
t AS (SELECT *, sum(length(s)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM e) SELECT query_id, count(*) FILTER (total > 2600) AS n_left_out, md5(coalesce(string_agg(s, chr(10) ORDER BY rank) FILTER (total <= 2600), '')) AS digest FROM t GROUP BY 1""")
def planner_context(s, d):
    top = PR._bm25(s, d, 20).join(I.documents(s, d), "doc_id")
    return St.planner_context(top.select("query_id", "rank", "text")).select("query_id", "n_left_out", F.md5("context").alias("digest"))


def _keep(s):
    """Tables of a loop's rounds in the cluster's shared checkpoint folder."""
    base = shared_folder(s)

    def keep(df, name):
        path = f"{base}/rounds/{name}-{uuid.uuid4().hex[:10]}"
        df.write.parquet(path)
        return s.read.schema(df.schema).parquet(path)

    return keep


def _ircot_sql() -> str:
    """The loop's iterations one after the other; follow-ups have words of their questions only, so the questions' postings serve them all."""
    parts = [f"""qw AS (SELECT query_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS words FROM (SELECT item_id AS query_id, {PR._TOK} AS t FROM benchmark)),
a0 AS (SELECT item_id AS query_id, lower(trim(text)) AS q FROM benchmark), e0 AS (SELECT query_id, doc_id FROM sparse WHERE rank <= {R.FINAL}), l0 AS (SELECT query_id FROM qw)"""]
    for i in range(1, St.ITERATIONS + 1):
        last = "'max_iterations'" if i == St.ITERATIONS else "NULL"
        parts.append(f"""m{i} AS (SELECT query_id, list_filter(any_value(words), lambda x: NOT list_contains(flatten(list(seen)), x)) AS missing FROM (SELECT e.query_id, words, list_filter(words, lambda x: list_contains(tokens, x)) AS seen FROM e{i - 1} e JOIN l{i - 1} USING (query_id) JOIN toks ON toks.doc_id = e.doc_id JOIN qw ON qw.query_id = e.query_id) GROUP BY 1),
j{i} AS (SELECT query_id, missing, CASE WHEN len(missing) > 0 THEN array_to_string(missing, ' ') END AS follow_up, CASE WHEN len(missing) = 0 THEN 'enough' WHEN (query_id, array_to_string(missing, ' ')) IN (SELECT (query_id, q) FROM a{i - 1}) THEN 'repeated_query' END AS stop FROM m{i}),
r{i} AS (SELECT query_id, tf.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(tokens) / avgdl))), 6) DESC, tf.doc_id) AS rank FROM (SELECT query_id, unnest(missing) AS term FROM j{i} WHERE stop IS NULL) w JOIN tf USING (term) JOIN idf USING (term) JOIN toks ON toks.doc_id = tf.doc_id, n GROUP BY query_id, tf.doc_id, n.n HAVING sum(idf * tf) > 0),
w{i} AS (SELECT query_id, doc_id FROM r{i} WHERE rank <= {St.FOLLOW_UP} EXCEPT SELECT query_id, doc_id FROM e{i - 1}),
s{i} AS (SELECT query_id, {i} AS iteration, follow_up, coalesce(c, 0) AS n_new, CASE WHEN stop IS NOT NULL THEN stop WHEN coalesce(c, 0) < 1 THEN 'no_new_evidence' ELSE {last} END AS termination FROM j{i} LEFT JOIN (SELECT query_id, count(*) AS c FROM w{i} GROUP BY 1) USING (query_id)),
e{i} AS (SELECT * FROM e{i - 1} UNION ALL SELECT * FROM w{i}), a{i} AS (SELECT * FROM a{i - 1} UNION ALL SELECT query_id, follow_up FROM j{i} WHERE stop IS NULL), l{i} AS (SELECT query_id FROM s{i} WHERE termination IS NULL)""")
    return f"WITH {PR._BM25}, " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, St.ITERATIONS + 1))


@query("ircot_steps", _ircot_sql())
def ircot_steps(s, d):
    """Interleaved retrieval; the default planner asks for the question's words that the evidence lacks."""
    from plumbline.functions.text import lexical_tokens

    index, q = PR._index(s, d), I.questions(s, d)
    tokens, retrieve = index.documents(), lambda qs: index.search(qs, R.FINAL)

    def plan(evidence, i):
        seen = evidence.select("query_id", "doc_id").join(tokens, "doc_id").join(q, "query_id").select("query_id", F.array_intersect(lexical_tokens(F.col("question")), "terms").alias("w"))
        found = seen.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("w"))).alias("w"))
        missing = F.array_except(F.array_distinct(lexical_tokens(F.col("question"))), "w")
        return q.join(found, "query_id").select("query_id", F.when(F.size(missing) > 0, F.array_join(missing, " ")).alias("follow_up"), (F.size(missing) == 0).alias("enough"))

    return St.ircot(q, retrieve, plan, _keep(s))[1]


@query("view_graph", f"WITH {PG._EDGES}, d AS (SELECT id, sum(n)::BIGINT AS degree FROM (SELECT src AS id, count(*) AS n FROM eg GROUP BY 1 UNION ALL SELECT dst, count(*) FROM eg GROUP BY 1) GROUP BY 1) SELECT nd.id, degree FROM nd JOIN d ON d.id = nd.id")
def view_graph(s, d):
    """The nodes of the view that have edges (the view keeps them all)."""
    return G.view(PG.nodes(s, d), PG.edges(s, d), 150).where("degree > 0").select("id", "degree")


@query("memory_graph_edges", """WITH o AS (SELECT event_id AS id, 's' || user_id AS sid, event_type AS c, event_id % 7 AS f FROM events ORDER BY event_id DESC LIMIT 150)
SELECT 'session::' || sid AS source, 'obs::' || id AS target, 'contains' AS kind FROM o UNION ALL SELECT 'obs::' || id, 'concept::' || c, 'tagged' FROM o UNION ALL SELECT 'obs::' || id, 'file::f' || f || '.py', 'read' FROM o""")
def memory_graph_edges(s, d):
    e = I.table(s, d, "events")
    obs = e.select(F.col("event_id").alias("id"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.lit("p").alias("project"), F.lit(None).cast("string").alias("title"), F.to_json(F.array("event_type")).alias("concepts"),
                   F.to_json(F.array(F.concat(F.lit("a/f"), (F.col("event_id") % 7).cast("string"), F.lit(".py")))).alias("files_read"), F.lit("[]").alias("files_modified"), F.col("event_id").alias("epoch"))
    return G.memory_graph(obs, obs.select("session_id", F.lit("t").alias("title")).distinct())[1]


@query("knowledge_edges", "WITH c AS (SELECT page_id, 'SCC:2000:1:' || page_id AS k FROM pages), x AS (SELECT page_id, 'SCC:2000:1:' || ((page_id * 3 + 1) % 400) AS k FROM pages) SELECT 'CASE:' || c.k AS src, 'CASE:' || x.k AS dst FROM c JOIN x USING (page_id) WHERE c.k <> x.k")
def knowledge_edges(s, d):
    """Citations of numbered cases, some of them not held."""
    p = I.table(s, d, "pages").select(F.col("page_id").alias("doc_id"))
    key = lambda x: F.concat(F.lit("SCC:2000:1:"), x.cast("string"))
    cited = p.select("doc_id", F.lit("body").alias("section"), F.lit("SCC").alias("kind"), key((F.col("doc_id") * 3 + 1) % 400).alias("key"), F.lit(0).alias("ordinal"))
    _, edges = G.knowledge_graph(p.select("doc_id", key(F.col("doc_id")).alias("key"), F.lit("SC").alias("court")), cited)
    return edges.where("relation = 'CASE_CITES_CASE'").select("src", "dst")


@query("evaluator_export", f"""WITH {I.TRACES_SQL}, p AS (SELECT r.trace_id, r.rank, text FROM refs r JOIN documents d ON d.doc_id = (r.trace_id * 6 + r.rank) % (SELECT count(*) FROM documents)) SELECT trace_id, len(list(text))::BIGINT AS n_contexts, md5(string_agg(text, '|' ORDER BY rank)) AS digest FROM p GROUP BY 1""")
def evaluator_export(s, d):
    from plumbline.sources.tables import evaluator_rows

    docs = I.documents(s, d)
    n = docs.count()
    refs = I.refs(s, d).select("trace_id", "rank", ((F.col("trace_id") * 6 + F.col("rank")) % n).alias("chunk_id"))
    traces = I.traces(s, d).select("trace_id", F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit("g").alias("gold"))
    rows = evaluator_rows(traces, refs, docs.select(F.col("doc_id").alias("chunk_id"), "text"), True)
    return rows.select("trace_id", F.size("contexts").cast("long").alias("n_contexts"), F.md5(F.array_join("contexts", "|")).alias("digest"))
