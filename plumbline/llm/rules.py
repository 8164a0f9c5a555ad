"""Quality rules with risk-controlled cutoffs. DataFrame functions only.

Labelled documents of good quality are a holdout: for every stratum and rule,
cutoffs are tried from the loosest to the strictest, and the strictest is taken
up to which every one passes an exact binomial test of "this rule rejects more
than `risk` of good documents". Trying them in a fixed order and stopping at
the first failure needs no correction along the order; the level is divided by
the number of rules and strata (Bonferroni).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table, whole, written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Share of good documents that one rule may reject in a stratum (all five together: five times that), and the chance that any rule exceeds its share.
RISK = 0.01
LEVEL = 0.05
#: Cutoffs of each rule from the loosest to the strictest; a document fails above the cutoff.
CUTOFFS = {
    "symbols": [0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.03, 0.02, 0.01],
    "dup_lines": [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "repeats": [0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.05, 0.03],
    "few_distinct": [0.98, 0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5, 0.4],
    "long_words": [40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 10.0, 9.0, 8.0],
}
#: Cutoffs of this many strata at most are broadcast (a few dozen bytes each).
_BROADCAST_STRATA = 5_000


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it inside further lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(w: Column) -> Column:
    """How many words lie in windows of eight that the text has twice or more.

    Almost all texts end at the test whether any hash of a window repeats. For
    the others, windows with equal hashes are found next to each other in sorted
    order; their words, sorted alike, tell which are really equal, and each of
    these adds the words that the one before it doesn't cover.
    """
    def repeated(keyed: Column) -> Column:
        """Places, in order, whose key another place has; keyed: array of (key, place)."""
        def places(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["key"] == e["key"], F.lit(False))
            return F.array_sort(F.filter(F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"])), lambda i: i.isNotNull()))

        return let(F.array_sort(keyed), places)

    def covered(at: Column) -> Column:
        return F.aggregate(
            at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])

    def count(v: Column, h: Column) -> Column:
        alike = repeated(F.transform(h, lambda x, i: F.struct(x.alias("key"), i.alias("i"))))
        equal = repeated(F.transform(alike, lambda i: F.struct(F.slice(v, i + 1, WINDOW).alias("key"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(equal))

    hashes = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(v, i, WINDOW)))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(w, lambda v: let(hashes(v), lambda h: count(v, h)))).cast("long")


def statistics(docs: DataFrame, stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, text_id, counts): one row for each document; null texts have no words, null strata are `und`.

    `text_id` is a hash of the text, by which copies are known.
    """
    text = whole()
    w, lines = F.col("_w"), F.filter(F.split(F.col("_t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select("doc_id", F.coalesce(F.col(stratum_col).cast("string"), F.lit("und")).alias("stratum"), text.alias("_t"))
    rows = rows.select("doc_id", "stratum", "_t", words(F.col("_t")).alias("_w"), let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_l"))
    return rows.select(
        "doc_id", "stratum", F.xxhash64("_t").alias("text_id"), F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_t"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"), F.col("_l.n").cast("long").alias("n_lines"),
        repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


def _rates() -> dict[str, Column]:
    one = F.lit(1)
    return {
        "symbols": F.col("n_symbols") / F.greatest(one, F.col("word_chars")),
        "dup_lines": F.col("n_dup_lines") / F.greatest(one, F.col("n_lines")),
        "repeats": F.col("n_repeat_words") / F.greatest(one, F.col("n_words")),
        "few_distinct": F.lit(1.0) - F.col("n_distinct") / F.greatest(one, F.col("n_words")),
        "long_words": F.col("word_chars") / F.greatest(one, F.col("n_words")),
    }


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), each term in logarithms from the one before; 1 where k is not below n p (no test passes there)."""
    import math

    step = math.log(p / (1 - p))
    start = F.struct((n * math.log1p(-p)).alias("t"), F.exp(n * math.log1p(-p)).alias("s"))

    def add(a: Column, j: Column) -> Column:
        t = a["t"] + F.log((n - j + 1) / j) + step
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    some = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, 1.0).otherwise(F.aggregate(some, start, add, lambda a: a["s"]))


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(stratum, one column for each rule): the chosen cutoffs; null where no cutoff is shown to be safe.

    A document counts as good if all its labels say quality 1. Documents with
    the same text are one trial of a stratum, since the binomial bound holds for
    independent ones. `risk` bounds each rule: documents rejected by any of the
    rules are len(CUTOFFS) * risk of the good ones at most.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = stats.join(good, "doc_id", "left_semi").dropDuplicates(["stratum", "text_id"])
    # for each rule: how many of its cutoffs the document stays at or under
    passed = [F.struct(F.lit(r).alias("rule"), sum((F.when(x <= c, 1).otherwise(0) for c in CUTOFFS[r]), F.lit(0)).alias("passes")) for r, x in _rates().items()]
    counted = held.select("stratum", F.explode(F.array(*passed)).alias("p")).groupBy("stratum", "p.rule", "p.passes").count()
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("i"), F.lit(c).alias("cutoff")) for r, cs in CUTOFFS.items() for i, c in enumerate(cs)])
    strata = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    grid_rows = strata.select("stratum", "n", F.explode(grid).alias("g")).select("stratum", "n", "g.*")
    # cutoffs fall, so a document that passes m of them fails those from number m on
    fails = counted.withColumnRenamed("passes", "i")
    run = Window.partitionBy("stratum", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tested = grid_rows.join(fails, ["stratum", "rule", "i"], "left").withColumn("k", F.sum(F.coalesce("count", F.lit(0))).over(run))
    n_strata = strata.agg(F.count(F.lit(1)).alias("n_strata"))
    tested = tested.crossJoin(F.broadcast(n_strata))  # one row
    safe = binomial_cdf(F.col("k"), F.col("n"), risk) <= F.lit(level) / (len(CUTOFFS) * F.greatest(F.lit(1), F.col("n_strata")))
    chosen = tested.withColumn("safe", F.min(safe).over(run)).where("safe").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return strata.select("stratum").join(chosen.groupBy("stratum").pivot("rule", list(CUTOFFS)).agg(F.min("cutoff")), "stratum", "left")


def judged_documents(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL, stratum_col: str = "lang") -> DataFrame:
    """Statistics, base_failed and kept of every document.

    Where labels show no cutoff to be safe (few labels, or none), only the base rules reject.
    One row for each row of docs: null and empty texts have no words and fail the
    base rules, a null doc_id stays null and has no label, rows that repeat are
    judged alike, a very long text is one array of words in memory, and other
    columns play no part. An empty table gives no row.
    """
    stats = written(statistics(docs, stratum_col), "rule-statistics")
    names = {r: f"cutoff_{r}" for r in CUTOFFS}
    chosen = written(cutoffs(stats, labels, risk, level).withColumnsRenamed(names), "cutoffs")
    small = chosen.count() <= _BROADCAST_STRATA
    rows = stats.join(F.broadcast(chosen) if small else chosen, "stratum", "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    over = [F.coalesce(x > F.col(names[r]), F.lit(False)) for r, x in _rates().items()]
    broken = over[0]
    for x in over[1:]:
        broken = broken | x
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & ~broken).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents; edge cases as in judged_documents."""
    return judged_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
