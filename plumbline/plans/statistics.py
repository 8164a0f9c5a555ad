"""Queries over agreement, correlation and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import statistics as S
from plumbline.functions.text import is_refusal
from plumbline.plans import inputs as I

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


_WORDS = "len(list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda w: w <> ''))"
_RULES = f"""rated AS (SELECT l.doc_id, l.quality, l.toxic, n_chars, {_WORDS} AS n_words,
  CASE WHEN regexp_matches(text, '[#*$%&|!]{{2}}') THEN 0 ELSE 1 END AS pred,
  least(1.0::DOUBLE, len(list_distinct(string_split_regex(text, '[ \\t\\n\\r]+'))) / 200.0::DOUBLE) AS conf,
  CASE WHEN quality = 0 THEN 'low' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS truth3,
  CASE WHEN regexp_matches(text, '[#*$%&|!]{{2}}') THEN 'low' WHEN regexp_matches(lower(text), 'idiot|trash|stupid|moron') THEN 'toxic' ELSE 'clean' END AS pred3
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def rated(s, d):
    """Labelled documents with a rule's prediction and confidence."""
    t = F.col("text")
    parts = F.split(t, r"[ \t\n\r]+")
    rows = I.table(s, d, "labels").join(I.documents(s, d, "n_chars"), "doc_id")
    marks = t.rlike(r"[#*$%&|!]{2}")
    return rows.select(
        "doc_id", "quality", "toxic", "n_chars", F.size(F.filter(parts, lambda w: w != "")).alias("n_words"), F.when(marks, 0).otherwise(1).alias("pred"),
        F.least(F.lit(1.0), F.size(F.array_distinct(parts)) / 200.0).alias("conf"),
        F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("truth3"),
        F.when(marks, "low").when(F.lower(t).rlike("idiot|trash|stupid|moron"), "toxic").otherwise("clean").alias("pred3"))


_PEARSON = "count(*) AS n_pairs, round(CASE WHEN count(*) >= 2 THEN sum((x - mx) * (y - my)) / nullif(sqrt(sum((x - mx) ^ 2)) * sqrt(sum((y - my) ^ 2)), 0) END, 6)"


@query("pearson_r", f"WITH p AS (SELECT n_chars::DOUBLE AS x, {_WORDS}::DOUBLE AS y, avg(n_chars) OVER () AS mx, avg({_WORDS}) OVER () AS my FROM documents) SELECT {_PEARSON} AS r FROM p")
def pearson_r(s, d):
    rows = I.documents(s, d, "n_chars").select("n_chars", F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("n_words"))
    return S.pearson(rows, "n_chars", "n_words")


@query("pearson_by_group", f"WITH p AS (SELECT p_type, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y, avg(p_size) OVER w AS mx, avg(p_retailprice) OVER w AS my FROM part WINDOW w AS (PARTITION BY p_type)) SELECT p_type, {_PEARSON} AS r FROM p GROUP BY 1")
def pearson_by_group(s, d):
    return S.pearson(I.table(s, d, "part"), "p_size", "p_retailprice", ["p_type"])


@query("spearman_rho", f"""WITH p AS (SELECT n_chars, {_WORDS} AS w FROM documents),
r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0::DOUBLE AS y FROM p),
q AS (SELECT x, y, avg(x) OVER () AS mx, avg(y) OVER () AS my FROM r) SELECT {_PEARSON} AS rho FROM q""")
def spearman_rho(s, d):
    rows = I.documents(s, d, "n_chars").select("n_chars", F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).alias("n_words"))
    return S.spearman(rows, "n_chars", "n_words")


@query("kendall_tau", """WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS y FROM part)
SELECT a.p_brand, max(n) AS n_items, round(coalesce(sum(sign((a.x - b.x) * (a.y - b.y))), 0) / nullif(max(n) * (max(n) - 1) / 2.0::DOUBLE, 0), 6) AS tau
FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM r) a LEFT JOIN r b ON a.p_brand = b.p_brand AND b.p_partkey > a.p_partkey GROUP BY 1""")
def kendall_tau(s, d):
    from plumbline.operators.retrieval import ranked

    rows = I.table(s, d, "part")
    rows = ranked(rows, ["p_brand"], [F.col("p_retailprice"), F.col("p_partkey")], name="x")
    return S.kendall(ranked(rows, ["p_brand"], [F.col("p_size"), F.col("p_partkey")], name="y"), ["p_brand"], "p_partkey", "x", "y")


def _kappa_sql(a, b):
    return f"""WITH {_RULES}, c AS (SELECT {a} AS a, {b} AS b, count(*) AS c FROM rated GROUP BY 1, 2), t AS (SELECT sum(c)::BIGINT AS n, sum(CASE WHEN a = b THEN c ELSE 0 END) / sum(c)::DOUBLE AS po FROM c),
e AS (SELECT sum(x.s * y.s)::DOUBLE AS e FROM (SELECT a AS l, sum(c) AS s FROM c GROUP BY 1) x JOIN (SELECT b AS l, sum(c) AS s FROM c GROUP BY 1) y USING (l))
SELECT n, round(po, 6) AS observed, round((po - e / (n::DOUBLE * n)) / (1 - e / (n::DOUBLE * n)), 6) AS kappa FROM t, e"""


query("binary_kappa", _kappa_sql("quality", "pred"))(lambda s, d: S.kappa(rated(s, d), "quality", "pred"))
query("multiclass_kappa", _kappa_sql("truth3", "pred3"))(lambda s, d: S.kappa(rated(s, d), "truth3", "pred3"))


@query("confusion_2x2", f"WITH {_RULES} SELECT count(*) FILTER (quality = 1 AND pred = 1) AS both_true, count(*) FILTER (quality = 1 AND pred = 0) AS first_only, count(*) FILTER (quality = 0 AND pred = 1) AS second_only, count(*) FILTER (quality = 0 AND pred = 0) AS both_false FROM rated")
def confusion_2x2(s, d):
    q, p = F.col("quality") == 1, F.col("pred") == 1
    return rated(s, d).agg(F.count_if(q & p).alias("both_true"), F.count_if(q & ~p).alias("first_only"), F.count_if(~q & p).alias("second_only"), F.count_if(~q & ~p).alias("both_false"))


@query("confusion_full", f"""WITH {_RULES}, l AS (SELECT truth3 AS l FROM rated UNION SELECT pred3 FROM rated), c AS (SELECT truth3 AS truth, pred3 AS predicted, count(*) AS c FROM rated GROUP BY 1, 2)
SELECT a.l AS truth, b.l AS predicted, coalesce(c, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON truth = a.l AND predicted = b.l""")
def confusion_full(s, d):
    return S.confusion(rated(s, d), "truth3", "pred3")


def _prf_sql(empty: str) -> str:
    return f"""WITH {_RULES}, l AS (SELECT truth3 AS label FROM rated UNION SELECT pred3 FROM rated UNION SELECT 'other' WHERE FALSE),
c AS (SELECT label, count(*) FILTER (truth3 = label) AS support, count(*) FILTER (pred3 = label) AS n_pred, count(*) FILTER (truth3 = label AND pred3 = label) AS tp FROM l, rated GROUP BY 1),
p AS (SELECT *, coalesce(tp / nullif(n_pred, 0)::DOUBLE, {empty}) AS p, coalesce(tp / nullif(support, 0)::DOUBLE, {empty}) AS r FROM c)
SELECT label, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), {empty}), 4) AS f1, support FROM p"""


query("per_label_prf", _prf_sql("0.0"))(lambda s, d: S.label_scores(rated(s, d), "truth3", "pred3"))
query("per_label_prf_nullable", _prf_sql("NULL"))(lambda s, d: S.label_scores(rated(s, d), "truth3", "pred3", nullable=True))


@query("macro_f1", f"SELECT round(avg(f1), 4) AS macro_f1, count(*) AS n_labels FROM ({_prf_sql('0.0')}) WHERE support > 0")
def macro_f1(s, d):
    return S.label_scores(rated(s, d), "truth3", "pred3").where("support > 0").agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.count(F.lit(1)).alias("n_labels"))


@query("accuracy", f"WITH {_RULES} SELECT round(avg((truth3 = pred3)::INT), 6) AS accuracy, count(*) AS n FROM rated")
def accuracy(s, d):
    return rated(s, d).agg(F.round(F.avg((F.col("truth3") == F.col("pred3")).cast("int")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


_WILSON = "round(greatest(0, least(1, (h / n + 1.96 * 1.96 / (2 * n) {sign} 1.96 * sqrt(h / n * (1 - h / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n))), 6)"


@query("wilson_interval", "WITH c AS (SELECT event_type, count(*)::DOUBLE AS n, count(*) FILTER (value > 20)::DOUBLE AS h FROM events GROUP BY 1) SELECT event_type, n::BIGINT AS n, h::BIGINT AS hits, " + _WILSON.format(sign="-") + " AS lo, " + _WILSON.format(sign="+") + " AS hi FROM c")
def wilson_interval(s, d):
    rows = I.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 20).alias("hits"))
    lo, hi = S.wilson(F.col("hits"), F.col("n"))
    return rows.select("event_type", "n", "hits", lo.alias("lo"), hi.alias("hi"))


_BINS = f"""WITH {_RULES}, b(bin, lo, hi) AS (VALUES (0, 0.0::DOUBLE, 0.5::DOUBLE), (1, 0.5, 0.7), (2, 0.7, 0.85), (3, 0.85, 0.95), (4, 0.95, 1.01)),
bins AS (SELECT bin, lo, hi, count(doc_id) AS n, round(avg(conf), 3) AS mean_confidence, round(avg((quality = pred)::INT), 3) AS accuracy FROM b LEFT JOIN rated ON conf >= lo AND conf < hi GROUP BY ALL)"""


def _bins(s, d):
    return S.calibration(rated(s, d).withColumn("right", F.col("quality") == F.col("pred")), "conf", "right")


query("calibration_bins", f"{_BINS} SELECT * FROM bins")(_bins)
query("ece", f"{_BINS} SELECT round(sum(n * abs(mean_confidence - accuracy)) / sum(n), 4) AS ece, sum(n)::BIGINT AS n FROM bins WHERE n > 0")(lambda s, d: S.expected_calibration_error(_bins(s, d)))

_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.7, 0.9]


@query("threshold_sweep", f"""WITH {_RULES}, c AS (SELECT t.threshold, count(*) FILTER (conf >= threshold AND quality = 1) AS tp, count(*) FILTER (conf >= threshold AND quality = 0) AS fp, count(*) FILTER (conf < threshold AND quality = 1) AS fn
  FROM rated, (SELECT unnest({_THRESHOLDS}::DOUBLE[]) AS threshold) t GROUP BY 1),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM c)
SELECT threshold, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM p""")
def threshold_sweep(s, d):
    return S.threshold_sweep(rated(s, d), "conf", "quality", _THRESHOLDS)


@query("refusal_calibration", "WITH c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT role = 'system' AS t, regexp_matches(text, '(?i)you (?:are|do)|not enough information|cannot') AS p FROM conversations)) SELECT tp, fp, fn, tn, round(fp / nullif(fp + tn, 0)::DOUBLE, 6) AS over_rate, round(fn / nullif(tp + fn, 0)::DOUBLE, 6) AS under_rate FROM c")
def refusal_calibration(s, d):
    """A phrase rule against the role, as refusals against what should be refused."""
    t, p = F.col("role") == "system", F.col("text").rlike("(?i)you (?:are|do)|not enough information|cannot")
    c = I.table(s, d, "conversations").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return c.select("*", F.round(F.col("fp") / F.nullif(F.col("fp") + F.col("tn"), F.lit(0)), 6).alias("over_rate"), F.round(F.col("fn") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6).alias("under_rate"))


@query("refusals", "SELECT conv_id, turn, regexp_matches(text, '(?i)not enough information|cannot (?:answer|determine|be answered)|i (?:do not|don''?t) know') AS refusal FROM conversations")
def refusals(s, d):
    return I.table(s, d, "conversations").select("conv_id", "turn", is_refusal(F.col("text")).alias("refusal"))


@query("disagreement_rows", f"WITH {_RULES} SELECT doc_id, quality, pred FROM rated WHERE quality <> pred")
def disagreement_rows(s, d):
    return rated(s, d).where("quality <> pred").select("doc_id", "quality", "pred")


@query("latency_report", """SELECT count(*) AS n, count(CASE WHEN event_type = 'click' THEN value END) AS n_retrieval, round(avg(CASE WHEN event_type = 'click' THEN value END), 1) AS retrieval_ms, round(avg(CASE WHEN event_type = 'view' THEN value END), 1) AS generation_ms,
  round(avg(CASE WHEN event_type = 'purchase' THEN value END), 1) AS verification_ms FROM events""")
def latency_report(s, d):
    v = lambda t: F.when(F.col("event_type") == t, F.col("value"))
    return I.table(s, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count(v("click")).alias("n_retrieval"), F.round(F.avg(v("click")), 1).alias("retrieval_ms"), F.round(F.avg(v("view")), 1).alias("generation_ms"), F.round(F.avg(v("purchase")), 1).alias("verification_ms"))


@query("sample_deviation", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS deviation FROM part GROUP BY 1")
def sample_deviation(s, d):
    return I.table(s, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.stddev_samp("p_retailprice"), 6).alias("deviation"))


@query("monotonic_levels", "WITH m AS (SELECT p_type, p_size, avg(p_retailprice) AS v FROM part GROUP BY 1, 2), l AS (SELECT p_type, v >= lag(v) OVER (PARTITION BY p_type ORDER BY p_size) - 1e-9 AS up FROM m) SELECT p_type, bool_and(coalesce(up, TRUE)) AS monotonic, count(*) AS n_levels FROM l GROUP BY 1")
def monotonic_levels(s, d):
    from pyspark.sql import Window

    m = I.table(s, d, "part").groupBy("p_type", "p_size").agg(F.avg("p_retailprice").alias("v"))
    up = F.coalesce(F.col("v") >= F.lag("v").over(Window.partitionBy("p_type").orderBy("p_size")) - 1e-9, F.lit(True))
    return m.select("p_type", up.alias("up")).groupBy("p_type").agg(F.bool_and("up").alias("monotonic"), F.count(F.lit(1)).alias("n_levels"))


@query("common_wrong_label", f"WITH {_RULES} SELECT truth3, pred3 AS wrong, count(*) AS n FROM rated WHERE truth3 <> pred3 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY truth3 ORDER BY count(*) DESC, pred3) = 1")
def common_wrong_label(s, d):
    from plumbline.operators.retrieval import ranked

    c = rated(s, d).where("truth3 <> pred3").groupBy("truth3", F.col("pred3").alias("wrong")).agg(F.count(F.lit(1)).alias("n"))
    return ranked(c, ["truth3"], [F.desc("n"), F.col("wrong")], 1).drop("rank")


