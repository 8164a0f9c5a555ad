"""Mixing to target weights by soft membership. DataFrame functions only.

A logistic classifier learned from the labelled table gives every document a
posterior over domains. Document rates r >= 0 are then fitted so that the
expected tokens of each domain, the sum of tokens * posterior * rate, match
the targets in the least-squares sense: projected gradient steps, whose sums
over all documents are computed by the cluster.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_sample, discard, table, whole, written

#: Domains, as the labels (quality, toxic) name them, with the target share of the tokens.
DOMAINS = ("sound", "toxic", "poor", "poor_toxic")
TARGETS = {"sound": 0.94, "toxic": 0.02, "poor": 0.035, "poor_toxic": 0.005}
#: Labelled rows for the classifier at most; and features that it keeps.
FIT_ROWS = 20_000
FEATURES = 192
LEAST_Z = 6.0
MAX_RATE = 4.0
#: Steps at most, those between two written tables of rates, and what ends the fit: a residual (share of all tokens), and a gain in the square of it.
STEPS = 24
ROUND = 4
TOLERANCE = 1e-4
GAIN = 0.001
#: Dampings of the metric and lengths of a step that are tried.
DAMPINGS = (1e-6, 1e-4, 1e-2)
LENGTHS = (1.0, 0.3, 0.1, 0.03)


def domain(quality: Column, toxic: Column) -> Column:
    """The number of a label's domain; null without a quality."""
    bad = F.coalesce(toxic, F.lit(0)) > 0
    return F.when(quality.isNull(), None).when(quality > 0, F.when(bad, 1).otherwise(0)).otherwise(F.when(bad, 3).otherwise(2))


def _features(text: Column) -> tuple[Column, Column]:
    """The distinct words and coarse shares of a text as strings; and how many words it has."""
    w = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    n, chars = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length("_t"), F.lit(1))
    level = lambda name, x: F.concat(F.lit(f"\x00{name} "), F.ceil(F.least(x, F.lit(1.0)) * 10).cast("string"))
    own = [
        level("distinct", F.size("_d") / n),
        level("marks", 4 * F.regexp_count(F.col("_t"), F.lit(r"[#*$%&|<>!]")) / chars),
        level("capitals", F.regexp_count(F.col("_t"), F.lit(r"\p{Lu}{2}")) / n),
    ]
    return w, F.array(*own)


def described(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, tokens (words), and feats (distinct features) of every document; a null text has none."""
    w, own = _features(F.col("_t"))
    rows = docs.select(*keep, whole().alias("_t")).select(*keep, "_t", w.alias("_w")).select(*keep, "_t", "_w", F.array_distinct("_w").alias("_d"))
    return rows.select(*keep, F.size("_w").cast("long").alias("tokens"), F.concat(own, F.col("_d")).alias("feats"))


class Classifier:
    """base[d] + the sum of gain[word][d] over the features present is a domain's log-posterior, up to a constant."""

    def __init__(self, base: list[float], gain: dict[str, list[float]]):
        self.base, self.gain = base, gain

    def posteriors(self, feats: Column) -> Column:
        """An array with the posterior of each domain."""
        if not self.gain:
            top = max(self.base)
            each = [math.exp(b - top) for b in self.base]
            return F.array(*[F.lit(x / sum(each)) for x in each])
        present = F.array_intersect(feats, F.array(*[F.lit(w) for w in self.gain]))
        gains = F.create_map(*[x for w, g in self.gain.items() for x in (F.lit(w), F.array(*[F.lit(v) for v in g]))])
        start = F.array(*[F.lit(b) for b in self.base])
        logs = F.aggregate(present, start, lambda a, w: F.zip_with(a, F.element_at(gains, w), lambda x, y: x + y))
        exps = F.transform(F.array(logs), lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a))))
        return F.get(F.transform(exps, lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))), F.lit(0))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Classifier:
    """Fit on a sample of `rows` labelled documents at most; without labels all documents are in the first domain.

    The cluster counts features by domain, keeps those that tell domains apart
    best (FEATURES at most), and fits a multinomial logistic regression to them.
    """
    rated = labels.select(F.col("doc_id").alias("_id"), domain(F.col("quality"), F.col("toxic")).alias("_dom")).where("_dom is not null and _id is not null")
    chosen = bounded_sample(rated, rows)
    k = len(DOMAINS)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # `rows` rows of two numbers at most
    # of rows that share a doc_id one stays, so that the sample is bounded in texts too
    once = joined.groupBy("doc_id", "_dom").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    held = written(described(once, ["_dom"]), "labelled-features")
    sizes = {r["_dom"]: r["count"] for r in held.groupBy("_dom").count().collect()}
    n = sum(sizes.values())
    if not n:
        return Classifier([0.0] + [-50.0] * (k - 1), {})
    counts = [F.sum((F.col("_dom") == d).cast("long")).alias(f"c{d}") for d in range(k)]
    words = held.select("_dom", F.explode("feats").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"), *counts).where("n >= 5")
    z = [F.abs(F.col(f"c{d}") - F.col("n") * (sizes[d] / n)) / F.sqrt(F.col("n") * (1 - F.col("n") / F.lit(float(n + 1))) * (sizes[d] / n) * (1 - sizes[d] / n) + 1e-9)
         for d in range(k) if 0 < sizes.get(d, 0) < n]
    if not z:
        return Classifier([math.log(sizes.get(d, 0) + 1e-9) for d in range(k)], {})
    best = [r["w"] for r in words.withColumn("z", F.greatest(*z, F.lit(0.0))).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "w").limit(FEATURES).collect()]
    priors = [math.log((sizes.get(d, 0) + 0.5) / (n + 0.5 * k)) for d in range(k)]
    if not best:
        return Classifier(priors, {})
    found = written(held.select("_dom", F.array_intersect("feats", F.array(*[F.lit(w) for w in best])).alias("hits")).coalesce(8), "labelled-hits")
    present = F.transform(F.array(*[F.lit(w) for w in best]), lambda w: F.array_contains("hits", w).cast("double"))
    rows_in = found.select(F.col("_dom").cast("double").alias("label"), array_to_vector(present).alias("features"))
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=2e-3, elasticNetParam=0.5, standardization=False).fit(rows_in)
    weights, start = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    # the model has the domains up to the largest one labelled; the others stay as rare as the labels say
    base = [float(start[d]) if d < len(start) else min(map(float, start)) + priors[d] for d in range(k)]
    gain = {w: [float(weights[d][i]) if d < len(start) else 0.0 for d in range(k)] for i, w in enumerate(best)}
    return Classifier(base, {w: g for w, g in gain.items() if any(g)})


def _array(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _along(v: Column) -> Column:
    """The sum of p * v over the domains. Values stay in an array, so that the code compiled for one step serves all."""
    return F.aggregate(F.zip_with("p", v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _moved(rate: Column, gradient: Column, move: Column, max_rate: float) -> Column:
    """A rate after a step, projected to [0, max_rate]; one at a bound that the gradient presses against it stays."""
    return F.when(_pressed(rate, gradient, max_rate), rate).otherwise(F.least(F.greatest(rate - _along(move), F.lit(0.0)), F.lit(max_rate)))


def _pressed(rate: Column, gradient: Column, max_rate: float) -> Column:
    slope = _along(gradient)
    return ((rate <= 0) & (slope >= 0)) | ((rate >= max_rate) & (slope <= 0))


def with_rates(members: DataFrame, steps: list[tuple[list[float], list[float]]], max_rate: float = MAX_RATE) -> DataFrame:
    """`members` (p, rate) with the rate after these steps (gradient, move)."""
    if not steps:
        return members
    each = F.array(*[F.struct(_array(g).alias("g"), _array(m).alias("m")) for g, m in steps])
    return members.withColumn("rate", F.aggregate(each, F.col("rate"), lambda r, s: _moved(r, s["g"], s["m"], max_rate)))


def _inverse(m: list[list[float]]) -> list[list[float]]:
    n = len(m)
    a = [[*row, *[float(i == j) for j in range(n)]] for i, row in enumerate(m)]
    for i in range(n):
        j = max(range(i, n), key=lambda k: abs(a[k][i]))
        a[i], a[j] = a[j], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for k in range(n):
            if k != i:
                a[k] = [x - a[k][i] * y for x, y in zip(a[k], a[i])]
    return [row[n:] for row in a]


def fit_rates(members: DataFrame, targets: dict[str, float], spare: float | None = None, max_rate: float = MAX_RATE) -> list[tuple[list[float], list[float]]]:
    """The steps that fit rates of `members` (tokens, p) to the targets, from a rate of one; a written table is best.

    `targets` are shares of all tokens. With `spare` the first domain is to have
    `spare` times its own tokens, and each other domain its share beside that,
    but no more than it has, so that what is scarce is not repeated.

    Every step is a projected gradient step for half the squared residual of
    the domains' tokens, in two metrics: rates that the gradient presses against
    a bound stay, the others move along the gradient times the inverse Gram
    matrix of their own posteriors. A few lengths and dampings are tried in one
    sum over the documents and the best is taken, so the residual falls with
    every step. It ends at the tolerance, where nothing improves by GAIN, or
    after STEPS; each step takes two sums over the documents.
    """
    k = len(DOMAINS)
    p = [F.get("p", F.lit(d)) for d in range(k)]
    t = F.col("tokens").cast("double")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    now = [x or 0.0 for x in members.agg(*[F.sum(t * x) for x in p]).first()]
    total = sum(now)
    if total <= 0:
        return []
    weight = [targets[d] / sum(targets.values()) for d in DOMAINS]
    goal = [w * total for w in weight]
    if spare is not None:
        goal = [spare * now[0], *[min(now[d], weight[d] * spare * now[0] / weight[0]) for d in range(1, k)]]
    rest = [(a - b) / total for a, b in zip(now, goal)]
    steps: list[tuple[list[float], list[float]]] = []
    rated, since = members.select("tokens", "p", F.lit(1.0).alias("rate")), 0
    tables: list[DataFrame] = []
    while max(map(abs, rest)) > TOLERANCE and len(steps) < STEPS:
        here, gradient = with_rates(rated, steps[since:], max_rate), _array(rest)
        free = here.where(~_pressed(F.col("rate"), gradient, max_rate))
        gram = [[0.0] * k for _ in range(k)]
        for (i, j), x in zip(pairs, free.agg(*[F.sum(t * p[i] * p[j]) for i, j in pairs]).first()):
            gram[i][j] = gram[j][i] = (x or 0.0) / total
        moves = []
        for damping in DAMPINGS:
            metric = _inverse([[x + (i == j) * damping for j, x in enumerate(row)] for i, row in enumerate(gram)])
            direction = [sum(metric[i][j] * rest[j] for j in range(k)) for i in range(k)]
            moves += [[size * x for x in direction] for size in LENGTHS]
        tried = F.transform(F.array(*map(_array, moves)), lambda m: _moved(F.col("rate"), gradient, m, max_rate))
        sums = here.select("tokens", "p", F.posexplode(tried).alias("i", "r")).groupBy("i").agg(*[F.sum(t * x * F.col("r")).alias(f"s{d}") for d, x in enumerate(p)]).collect()
        after = {row["i"]: [(row[f"s{d}"] - goal[d]) / total for d in range(k)] for row in sums}
        squares = {i: sum(x * x for x in e) for i, e in after.items()}
        best = min(sorted(squares), key=squares.__getitem__)
        if squares[best] >= (1 - GAIN) * sum(x * x for x in rest):
            break
        steps.append((rest, moves[best]))
        rest = after[best]
        if len(steps) - since == ROUND:
            rated, since = written(with_rates(rated, steps[since:], max_rate), "rates"), len(steps)
            tables.append(rated)
    for done in tables:
        discard(done)
    return steps


def _members(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """`keep`, tokens, posteriors p and a rate of one for every document."""
    return described(docs, keep).select(*keep, "tokens", model.posteriors(F.col("feats")).alias("p"), F.lit(1.0).alias("rate"))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, spare: float | None = None) -> DataFrame:
    """doc_id, tokens, the posterior of each domain and rate: one row for each row of docs.

    A rate says how often a document is to be read in a pass over the mixture,
    on average. Documents without words (null or empty texts) have the rate of
    their posterior and add nothing to the sums. A null doc_id stays null and has
    no label; rows that repeat have the same rate; of a doc_id with several
    labels each kind counts once; very long texts are one array of distinct words
    in memory; other columns play no part. Without documents there are no rows,
    without labels all documents are in the first domain.
    """
    members = written(_members(docs, fit(docs, labels), ["doc_id"]), "memberships")
    rated = with_rates(members, fit_rates(members, targets or TARGETS, spare))
    return rated.select("doc_id", "tokens", *[F.get("p", F.lit(d)).alias(f"p_{name}") for d, name in enumerate(DOMAINS)], "rate")


def mixed_documents(docs: DataFrame, model: Classifier, targets: dict[str, float], spare: float) -> DataFrame:
    """The documents, each as often as its rate says: whole times, and once more with the chance of the rest.

    The chance is a hash of the document, so that a second run mixes the same;
    rows that repeat as a whole share it. The documents are written with their
    token counts and posteriors, so that texts are scored once; the fit reads
    the two columns only. A null text is scored as an empty one, very long texts
    are scored whole, and an empty table stays empty.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "text")  # names of other columns can't clash
    members = written(_members(rows, model, ["_doc"]), "memberships")
    rated = with_rates(members, fit_rates(members, targets, spare))
    chance = F.pmod(F.xxhash64("_doc.doc_id", "_doc.text", F.lit(29)), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("rate") + chance).cast("int")
    return rated.withColumn("_times", times).where("_times >= 1").select("_doc", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_n")).select("_doc.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for TARGETS; edge cases as in mixing_rates."""
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
