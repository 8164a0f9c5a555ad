"""Queries over stage rules, causes, actions, reports and injected faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import diagnosis as D
from plumbline.operators import faults as X
from plumbline.plans import inputs as I

QUERIES, ORACLE = {}, {}
_T = f"WITH {I.TRACES_SQL}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


def facts(s, d):
    return D.trace_facts(I.traces(s, d), I.refs(s, d), I.claim_scores(s, d))


def matrix(s, d):
    return D.stage_matrix(facts(s, d))


@query("chunk_utilization", f"{_T} SELECT trace_id, chunks_used, chunks_retrieved, round(chunks_used / nullif(chunks_retrieved, 0)::DOUBLE, 6) AS chunk_utilization FROM facts")
def chunk_utilization(s, d):
    return facts(s, d).select("trace_id", "chunks_used", "chunks_retrieved", F.round(F.col("chunks_used") / F.nullif(F.col("chunks_retrieved"), F.lit(0)), 6).alias("chunk_utilization"))


@query("boundary_adjacency", f"{_T} SELECT trace_id, claim_id FROM boundary")
def boundary_adjacency(s, d):
    return D.boundary_claims(I.claim_scores(s, d), I.refs(s, d))


@query("stage_matrix", f"{_T} SELECT trace_id, stage, stage_order::BIGINT AS stage_order, status, confidence FROM matrix")
def stage_matrix(s, d):
    return matrix(s, d).withColumn("stage_order", F.col("stage_order").cast("long"))


@query("root_cause", f"{_T} SELECT trace_id, coalesce(failed[1], 'UNKNOWN') AS primary_cause, confidence, len(failed) > 0 AS recommendations_needed FROM causes")
def root_cause(s, d):
    return D.root_causes(matrix(s, d)).select("trace_id", "primary_cause", "confidence", "recommendations_needed")


@query("secondary_effects", f"{_T} SELECT trace_id, array_to_string(failed[2:], ',') AS secondary_effects FROM causes")
def secondary_effects(s, d):
    return D.root_causes(matrix(s, d)).select("trace_id", F.array_join("secondary_effects", ",").alias("secondary_effects"))


@query("reasoning_chain", f"""{_T}, st(stage, o, cause) AS (VALUES ('CORPUS', 1, 'MISSING_CORPUS'), ('RETRIEVER', 2, 'RETRIEVAL_MISS'), ('CHUNKING', 3, 'CHUNK_BOUNDARY'), ('GENERATOR', 4, 'UNSUPPORTED_GENERATION'), ('GROUNDING', 5, 'GROUNDING_FAILURE'))
SELECT t.trace_id, string_agg(CASE WHEN m.status IS NULL THEN 'Skipping ' || st.stage || ': no observable state.' WHEN m.status = 'UNKNOWN' THEN 'Skipping ' || st.stage || ': insufficient evidence.'
  WHEN m.status = 'FAIL' THEN 'Failure at ' || st.stage || ': ' || cause || ' (confidence=' || printf('%.2f', m.confidence) || ').' ELSE st.stage || ' passed (confidence=' || printf('%.2f', m.confidence) || ').' END, ' ' ORDER BY o) AS chain
FROM traces t CROSS JOIN st LEFT JOIN matrix m ON m.trace_id = t.trace_id AND m.stage = st.stage GROUP BY 1""")
def reasoning_chain(s, d):
    return D.reasoning_chain(matrix(s, d)).select("trace_id", F.array_join("chain", " ").alias("chain"))


@query("confidence_ranked_cause", f"{_T} SELECT trace_id, coalesce((list(cause ORDER BY confidence DESC, stage_order) FILTER (status = 'FAIL'))[1], 'UNKNOWN') AS ranked_cause FROM named GROUP BY 1")
def confidence_ranked_cause(s, d):
    return D.most_confident_cause(matrix(s, d))


@query("baseline_attribution", f"""{_T}, sc AS (SELECT trace_id, CASE WHEN trace_id % 11 = 0 THEN NULL ELSE chunks_used / chunks_retrieved::DOUBLE END AS c, CASE WHEN trace_id % 11 = 0 THEN NULL ELSE (unsupported + contradicted) / n_claims::DOUBLE END AS h, CASE WHEN trace_id % 11 = 0 THEN NULL ELSE supported / n_claims::DOUBLE END AS f FROM facts)
SELECT trace_id, CASE WHEN c IS NULL AND h IS NULL AND f IS NULL THEN NULL WHEN c < 0.5 THEN 'RETRIEVAL_MISS' WHEN h > 0.5 THEN 'GROUNDING_FAILURE' WHEN f < 0.7 THEN 'UNSUPPORTED_GENERATION' ELSE 'UNKNOWN' END AS attributed FROM sc""")
def baseline_attribution(s, d):
    c = lambda x: F.when(F.col("trace_id") % 11 != 0, x)
    n = F.col("n_claims")
    return facts(s, d).select("trace_id", D.threshold_attribution(c(F.col("chunks_used") / F.col("chunks_retrieved")), c((F.col("unsupported") + F.col("contradicted")) / n), c(F.col("supported") / n)).alias("attributed"))


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


@query("corrective_actions", f"""{_T}, a(cause, action_order, title, category, priority, evidence, gk, gv) AS (VALUES {_values(D.ACTIONS)}),
l AS (SELECT trace_id, i AS cause_order, failed[i + 1] AS cause FROM causes, unnest(range(len(failed)::BIGINT)) t(i))
SELECT l.trace_id, cause_order, action_order::BIGINT AS action_order, cause, title, category, priority,
  replace(replace(replace(replace(replace(replace(replace(evidence, '{{pool_size}}', coalesce(pool_size::VARCHAR, 'N/A')), '{{min_distance}}', coalesce(printf('%.3f', min_distance), 'N/A')), '{{max_score}}', printf('%.3f', max_score)), '{{threshold}}', '0.500'),
  '{{boundary_claims}}', boundary_claims::VARCHAR), '{{unsupported}}', unsupported::VARCHAR), '{{contradicted}}', contradicted::VARCHAR) AS evidence
FROM l JOIN a USING (cause) JOIN facts f ON f.trace_id = l.trace_id WHERE gk IS NULL OR CASE gk WHEN 'bm25_enabled' THEN bm25 WHEN 'reranker_enabled' THEN rerank ELSE temp END <> gv""")
def corrective_actions(s, d):
    f = facts(s, d)
    rows = D.corrective_actions(D.root_causes(D.stage_matrix(f)), f)
    return rows.withColumns({"cause_order": F.col("cause_order").cast("long"), "action_order": F.col("action_order").cast("long")})


@query("efficiency_advisory", f"{_T} SELECT trace_id, chunks_used, chunks_retrieved, round(chunks_used / nullif(chunks_retrieved, 0)::DOUBLE, 6) AS chunk_utilization FROM facts WHERE chunks_used / nullif(chunks_retrieved, 0)::DOUBLE < 0.4")
def efficiency_advisory(s, d):
    return D.efficiency_advisories(facts(s, d))


_HEALTH = """h AS (SELECT trace_id, n_claims, supported, partial, chunks_cited, chunks_retrieved, (supported + 0.5::DOUBLE * partial) / nullif(n_claims, 0) AS g, CASE WHEN trace_id % 2 = 0 THEN max_score END AS cp, CASE WHEN trace_id % 3 = 0 THEN 1 - min_distance END AS ar FROM facts),
hh AS (SELECT *, round((coalesce(0.5 * g, 0) + coalesce(0.2 * cp, 0) + coalesce(0.2 * ar, 0)) / (CASE WHEN g IS NULL THEN 0 ELSE 0.5 END + CASE WHEN cp IS NULL THEN 0 ELSE 0.2 END + CASE WHEN ar IS NULL THEN 0 ELSE 0.2 END)::DOUBLE, 4) AS health FROM h)"""


def _health(s, d):
    f = facts(s, d)
    parts = {"grounding": D.grounding(), "context_precision": F.when(F.col("trace_id") % 2 == 0, F.col("max_score")), "answer_relevancy": F.when(F.col("trace_id") % 3 == 0, 1 - F.col("min_distance")), "context_recall": F.lit(None).cast("double")}
    return f.withColumn("health", D.weighted_health(parts))


@query("health_score", f"{_T}, {_HEALTH} SELECT trace_id, health, CASE WHEN health > 0.8 THEN 'healthy' WHEN health > 0.5 THEN 'improve' ELSE 'inspect' END AS advice FROM hh")
def health_score(s, d):
    return _health(s, d).select("trace_id", "health", D.advice(F.col("health")).alias("advice"))


@query("report_rollup", f"{_T}, {_HEALTH} SELECT trace_id, n_claims, supported, partial, round(g, 6) AS grounding_score, round(chunks_cited / greatest(1, chunks_retrieved)::DOUBLE, 6) AS evidence_coverage, health, CASE WHEN len(failed) > 0 THEN failed[1] ELSE 'UNKNOWN' END AS primary_issue FROM hh JOIN causes USING (trace_id)")
def report_rollup(s, d):
    causes = D.root_causes(matrix(s, d)).select("trace_id", F.col("primary_cause").alias("primary_issue"))
    return _health(s, d).join(causes, "trace_id").select("trace_id", "n_claims", "supported", "partial", F.round(D.grounding(), 6).alias("grounding_score"), F.round(F.col("chunks_cited") / F.greatest(F.lit(1), F.col("chunks_retrieved")), 6).alias("evidence_coverage"), "health", "primary_issue")


@query("report_status", f"{_T} SELECT trace_id, CASE WHEN min_distance IS NOT NULL AND bm25 IS NOT NULL THEN 'COMPLETED' WHEN bm25 IS NOT NULL THEN 'PARTIAL' ELSE 'FAILED' END AS report_status FROM traces")
def report_status(s, d):
    return I.traces(s, d).select("trace_id", D.report_status([F.element_at("config", "bm25_enabled"), F.col("min_distance")], 1).alias("report_status"))


@query("consistency_check", f"{_T} SELECT trace_id, TRUE AS primary_failed, TRUE AS all_named FROM causes")
def consistency_check(s, d):
    m = matrix(s, d)
    return D.consistency(D.root_causes(m), m)


@query("generator_rule_sweep", f"""{_T}, fr AS (SELECT unnest([0.15, 0.25, 0.34, 0.5, 0.75]::DOUBLE[]) AS fraction) SELECT fraction, count(*) FILTER (unsupported / n_claims::DOUBLE > fraction AND max_score >= 0.5 AND not_verifiable < n_claims) AS n_fail FROM facts, fr GROUP BY 1""")
def generator_rule_sweep(s, d):
    f = facts(s, d)
    parts = [D.stage_matrix(f, x).where("stage = 'GENERATOR'").groupBy().agg(F.count_if(F.col("status") == "FAIL").alias("n_fail")).withColumn("fraction", F.lit(x)) for x in (0.15, 0.25, 0.34, 0.5, 0.75)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _u(p: str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{X.SEED}:{p}'", *[f"({x})::VARCHAR" for x in parts]])
    return f"(('0x' || substr(sha256({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _faults_sql(sizes: tuple[int, ...] = (0, 1, 2, 3, 4, 5)) -> str:
    masks = [m for m in range(32) if m.bit_count() in sizes]
    has = lambda i: f"(mask & {1 << i} <> 0)"
    edge = "(CASE WHEN near THEN 0.02::DOUBLE ELSE 0.2::DOUBLE END)"
    return f"""plan AS (SELECT case_id, mask, bit_count(mask)::INT AS n_faults, (case_id // {len(masks)}) % 4 = 3 AS near FROM (SELECT case_id, {masks}[case_id % {len(masks)} + 1]::INT AS mask FROM (SELECT DISTINCT user_id AS case_id FROM events))),
ftraces AS (SELECT case_id AS trace_id, mask, n_faults, CASE {' '.join(f"WHEN {has(i)} THEN '{c}'" for i, c in enumerate(D.CAUSES))} ELSE 'UNKNOWN' END AS expected_cause,
  round(CASE WHEN {has(0)} THEN 0.75 + {edge} * (0.1 + 0.9 * {_u('far', 'case_id')}) ELSE 0.2 + 0.3 * {_u('near', 'case_id')} END, 6) AS min_distance FROM plan),
frefs AS (SELECT case_id AS trace_id, i, round(CASE WHEN {has(1)} THEN 0.5 - {edge} * (0.1 + 0.9 * {_u('low', 'case_id', 'i')}) ELSE 0.6 + 0.35 * {_u('high', 'case_id', 'i')} END, 6) AS similarity FROM plan, (SELECT unnest(range(6)) AS i)),
fver AS (SELECT case_id AS trace_id, i AS claim_id, CASE WHEN {has(4)} AND i = 3 THEN 'CONTRADICTED' WHEN {has(1)} THEN 'UNSUPPORTED' WHEN {has(2)} AND i = 1 THEN 'PARTIALLY_SUPPORTED' WHEN {has(3)} AND i = 2 THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS status FROM plan, (SELECT unnest(range(6)) AS i)),
ffacts AS (SELECT t.*, s.*, r.max_score FROM ftraces t JOIN (SELECT trace_id AS tid, count(*) AS n, count(*) FILTER (status IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) AS ok, count(*) FILTER (status = 'UNSUPPORTED') AS uns, count(*) FILTER (status = 'CONTRADICTED') AS con, count(*) FILTER (status = 'PARTIALLY_SUPPORTED') AS par FROM fver GROUP BY 1) s ON s.tid = t.trace_id
  JOIN (SELECT trace_id AS rid, max(similarity) AS max_score FROM frefs GROUP BY 1) r ON r.rid = t.trace_id),
fcause AS (SELECT trace_id, mask, n_faults, expected_cause, CASE WHEN min_distance > 0.75 THEN 'MISSING_CORPUS' WHEN ok = 0 AND uns = n AND max_score < 0.5 THEN 'RETRIEVAL_MISS' WHEN par > 0 THEN 'CHUNK_BOUNDARY' WHEN uns > 0 AND max_score >= 0.5 THEN 'UNSUPPORTED_GENERATION' WHEN con > 0 THEN 'GROUNDING_FAILURE' ELSE 'UNKNOWN' END AS primary_cause FROM ffacts)"""


def _cases(s, d, sizes=(0, 1, 2, 3, 4, 5)):
    """Every user's trace gets a set of faults."""
    return X.cases(I.table(s, d, "events").select(F.col("user_id").alias("case_id")).distinct(), sizes)


def _diagnosed(s, d, sizes):
    traces, refs, verified = X.injected(_cases(s, d, sizes))
    causes = D.root_causes(D.stage_matrix(D.trace_facts(traces, refs, verified)))
    return traces.join(causes, "trace_id")


@query("fault_cases", f"WITH {_faults_sql()} SELECT trace_id, n_faults, expected_cause, min_distance FROM ftraces")
def fault_cases(s, d):
    traces, _, _ = X.injected(_cases(s, d))
    return traces.select("trace_id", "n_faults", "expected_cause", "min_distance")


@query("fault_diagnosis", f"WITH {_faults_sql((0, 1))} SELECT trace_id, expected_cause, primary_cause FROM fcause")
def fault_diagnosis(s, d):
    return _diagnosed(s, d, (0, 1)).select("trace_id", "expected_cause", "primary_cause")


@query("compound_faults", f"WITH {_faults_sql((2,))} SELECT mask, count(*) AS n, round(avg((expected_cause = primary_cause)::INT), 4) AS accuracy FROM fcause GROUP BY 1")
def compound_faults(s, d):
    return _diagnosed(s, d, (2,)).groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("expected_cause") == F.col("primary_cause")).cast("int")), 4).alias("accuracy"))


@query("nway_faults", f"WITH {_faults_sql((2, 3, 4, 5))} SELECT n_faults, count(*) AS n, round(avg((expected_cause = primary_cause)::INT), 4) AS accuracy FROM fcause GROUP BY 1")
def nway_faults(s, d):
    return _diagnosed(s, d, (2, 3, 4, 5)).groupBy("n_faults").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("expected_cause") == F.col("primary_cause")).cast("int")), 4).alias("accuracy"))


@query("depth_sweep", f"WITH {_faults_sql((1,))}, dp AS (SELECT unnest([0, 1, 2, 3, 4, 5, 8, 12]) AS depth) SELECT depth, count(*) AS n, round(avg((expected_cause = primary_cause)::INT), 4) AS accuracy FROM fcause, dp GROUP BY 1")
def depth_sweep(s, d):
    """Neutral chunks far from the others change no verdict."""
    traces, refs, verified = X.injected(_cases(s, d, (1,)))
    r, v = X.depth_sweep(refs, verified)
    grid = r.select("trace_id", "depth").distinct()
    t = grid.join(traces.withColumnRenamed("trace_id", "case_id"), F.floor(F.col("trace_id") / 100) == F.col("case_id"))
    causes = D.root_causes(D.stage_matrix(D.trace_facts(t, r.drop("depth"), v.drop("depth"))))
    return causes.join(t.select("trace_id", "depth", "expected_cause"), "trace_id").groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("expected_cause") == F.col("primary_cause")).cast("int")), 4).alias("accuracy"))
