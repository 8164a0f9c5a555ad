"""Agreement, correlation and calibration as aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96
CALIBRATION_EDGES = (0.0, 0.5, 0.7, 0.85, 0.95, 1.01)


def finite(x: Column) -> Column:
    """x as a double, null where it isn't finite."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _moments(x: Column, y: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(x * y).alias("mxy"), F.avg(x * x).alias("mxx"), F.avg(y * y).alias("myy")]


def pearson(df: DataFrame, x: str, y: str, keys: list[str] | None = None, name: str = "r") -> DataFrame:
    """Pearson's r over pairs with two finite values: centred in a second pass; null under two pairs or without variance."""
    keys = keys or []
    pairs = df.select(*keys, finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).where("x is not null and y is not null")
    if keys:
        means = pairs.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        centred = pairs.join(means, keys)
    else:
        centred = pairs.crossJoin(F.broadcast(pairs.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))))  # one row
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    sums = centred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(dx * dy).alias("sxy"), F.sum(dx * dx).alias("sxx"), F.sum(dy * dy).alias("syy"))
    r = F.when(F.col("n") >= 2, F.col("sxy") / F.nullif(F.sqrt("sxx") * F.sqrt("syy"), F.lit(0.0)))
    return sums.select(*keys, F.col("n").alias("n_pairs"), F.round(r, 6).alias(name))


#: Blocks into which values are dealt for running sums.
BLOCKS = 64


def _bounds(df: DataFrame, value: str) -> DataFrame:
    """One row: about evenly spaced values between blocks, from a sketch."""
    shares = F.array(*[F.lit(i / BLOCKS) for i in range(1, BLOCKS)])
    return df.agg(F.coalesce(F.percentile_approx(F.col(value).cast("double"), shares, 1000), F.array().cast("array<double>")).alias("_bounds"))


def _block(value: str) -> Column:
    return F.size(F.filter("_bounds", lambda b: b < F.col(value).cast("double")))


def _ranks(values: DataFrame, value: str, name: str) -> DataFrame:
    """(value, mean rank) of different values with counts _c: running sums in blocks of values, and the sums of the blocks before.

    No table is written, and no task sees more than a block.
    """
    dealt = values.crossJoin(F.broadcast(_bounds(values, value))).select(value, "_c", _block(value).alias("_b"))  # one row
    sizes = dealt.groupBy("_b").agg(F.sum("_c").alias("_s"))
    before = sizes.select("_b", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each block
    inner = F.sum("_c").over(Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("_i", inner).join(F.broadcast(before), "_b").select(value, (F.col("_before") + F.col("_i") - (F.col("_c") - 1) / 2).alias(name))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Fractional ranks over all rows, equal values sharing their mean rank; null values have none."""
    values = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    return df.join(_ranks(values, value, name), value, "left")


def spearman(df: DataFrame, x: str, y: str, name: str = "rho") -> DataFrame:
    """Spearman's rho over pairs with two finite values; null under two pairs or where one side doesn't vary.

    Pairs are counted once, and everything else is taken from the counts: a
    value's rank from running sums, and the mean rank from the number of pairs.
    """
    pairs = df.select(finite(F.col(x)).alias("x"), finite(F.col(y)).alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("_c"))
    side = lambda v, r: _ranks(pairs.groupBy(v).agg(F.sum("_c").alias("_c")), v, r)
    ranked = pairs.join(side("x", "rx"), "x").join(side("y", "ry"), "y").crossJoin(F.broadcast(pairs.agg(F.sum("_c").alias("n"))))  # one row
    mean = (F.col("n") + 1) / 2
    dx, dy, c = F.col("rx") - mean, F.col("ry") - mean, F.col("_c")
    sums = ranked.agg(F.coalesce(F.sum(c), F.lit(0)).alias("n"), F.sum(c * dx * dy).alias("sxy"), F.sum(c * dx * dx).alias("sxx"), F.sum(c * dy * dy).alias("syy"))
    r = F.when(F.col("n") >= 2, F.col("sxy") / F.nullif(F.sqrt("sxx") * F.sqrt("syy"), F.lit(0.0)))
    return sums.select(F.col("n").alias("n_pairs"), F.round(r, 6).alias(name))


def kendall(df: DataFrame, keys: list[str], item: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-a of two rankings of the same items within each key; x holds whole numbers from 0, y numbers, ties count as neither.

    Two items with different x part at one binary digit of x, below a common
    prefix. For each digit the items of a prefix meet the sums of those with a
    smaller y: rows are items times digits, not pairs. A prefix's items are
    dealt to blocks by y, of which each counts its own and is given the sums of
    the blocks before, so a key of any size is spread over tasks.
    """
    items = df.select(*keys, F.col(x).cast("long").alias("_x"), F.col(y).alias("_y"))
    tops = items.groupBy(*keys).agg(F.max("_x").alias("_top"), F.count(F.lit(1)).alias("n_items"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    named = tops.select(*[F.col(k).alias(f"_{k}") for k in keys], "_top")
    dealt = items.crossJoin(F.broadcast(_bounds(items, "_y"))).withColumn("_b", _block("_y")).drop("_bounds")  # one row
    digits = dealt.join(named, same).select(*keys, "_x", "_y", "_b", F.explode(F.sequence(F.lit(0), F.length(F.bin("_top")) - 1)).alias("_k"))
    bit = F.expr("shiftright(_x, _k) & 1L")
    met = digits.groupBy(*keys, "_k", F.expr("shiftright(_x, _k + 1)").alias("_p"), "_b", "_y").agg(F.sum(bit).alias("_o"), F.sum(1 - bit).alias("_z"))
    group = [*keys, "_k", "_p"]
    inside = Window.partitionBy(*group, "_b").orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    part = met.select(*group, "_b", "_o", "_z", (F.col("_o") * so_far("_z", inside) - F.col("_z") * so_far("_o", inside)).alias("_s"))
    blocks = part.groupBy(*group, "_b").agg(F.sum("_o").alias("_o"), F.sum("_z").alias("_z"), F.sum("_s").alias("_s"))  # a row for each prefix and block
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = blocks.select(*group, (F.col("_s") + F.col("_o") * so_far("_z", before) - F.col("_z") * so_far("_o", before)).alias("_s"))
    sums = whole.groupBy(*keys).agg(F.sum("_s").alias("_s"))
    n = F.col("n_items")
    out = sums.join(tops.select(*[F.col(k).alias(f"_{k}") for k in keys], "n_items"), same)
    return out.select(*keys, "n_items", F.round(F.col("_s") / F.nullif(n * (n - 1) / 2.0, F.lit(0.0)), 6).alias("tau"))


def kappa(df: DataFrame, a: str, b: str, name: str = "kappa") -> DataFrame:
    """Cohen's kappa of two label columns; 1 or 0 where chance agreement is complete, null without rows."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("c"))
    total = rows.agg(F.sum("c").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("c")).otherwise(0)).alias("same"))
    left = rows.groupBy(F.col(a).alias("l")).agg(F.sum("c").alias("ca"))
    right = rows.groupBy(F.col(b).alias("l")).agg(F.sum("c").alias("cb"))
    chance = left.join(right, "l").agg(F.coalesce(F.sum(F.col("ca").cast("double") * F.col("cb")), F.lit(0.0)).alias("e"))
    out = total.crossJoin(F.broadcast(chance))  # one row and one row
    po, pe = F.col("same") / F.col("n"), F.col("e") / (F.col("n") * F.col("n"))
    k = F.when(F.col("n").isNull(), None).when(F.abs(pe - 1) < 1e-12, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), F.round(po, 6).alias("observed"), F.round(k, 6).alias(name))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts for every pair of labels found on either side, zeros included (labels are few)."""
    labels = df.select(F.col(truth).alias("l")).union(df.select(predicted)).where("l is not null").distinct()
    cells = df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("c"))
    grid = labels.select(F.col("l").alias("truth")).crossJoin(labels.select(F.col("l").alias("predicted")))
    return grid.join(cells, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("c", F.lit(0)).alias("n"))


def label_scores(df: DataFrame, truth: str, predicted: str, nullable: bool = False) -> DataFrame:
    """Precision, recall, F1 and support of each label; undefined ones are 0, or null if `nullable`."""
    sides = df.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("s"),
                      (F.col(truth) == F.col(predicted)).cast("int").alias("hit")).select("s.*", "hit")
    sums = sides.where("label is not null").groupBy("label").agg(F.sum("t").alias("support"), F.sum("p").alias("n_pred"), F.sum(F.col("hit") * F.col("t")).alias("tp"))
    undefined = F.lit(None).cast("double") if nullable else F.lit(0.0)
    p = F.coalesce(F.col("tp") / F.nullif(F.col("n_pred"), F.lit(0)), undefined)
    r = F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), undefined)
    f = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), undefined)
    return sums.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"), "support")


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1]; null for n = 0."""
    m = F.nullif(n, F.lit(0)).cast("double")
    p = hits / m
    mid, half = p + Z * Z / (2 * m), Z * F.sqrt(p * (1 - p) / m + Z * Z / (4 * m * m))
    scale = 1 + Z * Z / m
    clamp = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 6)
    return F.when(m.isNotNull(), clamp((mid - half) / scale)), F.when(m.isNotNull(), clamp((mid + half) / scale))


def calibration(df: DataFrame, confidence: str, correct: str) -> DataFrame:
    """A row for each confidence bin, empty ones too."""
    bins = df.sparkSession.createDataFrame(list(zip(range(5), CALIBRATION_EDGES, CALIBRATION_EDGES[1:])), "bin int, lo double, hi double")
    c = F.col(confidence)
    at = F.lit(None).cast("int")
    for i in reversed(range(5)):
        at = F.when((c >= CALIBRATION_EDGES[i]) & (c < CALIBRATION_EDGES[i + 1]), i).otherwise(at)
    sums = df.withColumn("bin", at).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 3).alias("mean_confidence"), F.round(F.avg(F.col(correct).cast("int")), 3).alias("accuracy"))
    return bins.join(sums, "bin", "left").select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    filled = bins.where("n > 0")
    return filled.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("accuracy"))) / F.sum("n"), 4).alias("ece"), F.sum("n").alias("n"))


def threshold_sweep(df: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Precision, recall and F1 of score >= threshold, for all thresholds in one pass."""
    rows = df.select(F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"), F.col(score).alias("s"), F.col(truth).cast("boolean").alias("t"))
    hit = F.col("s") >= F.col("threshold")
    sums = rows.groupBy("threshold").agg(F.count_if(hit & F.col("t")).alias("tp"), F.count_if(hit & ~F.col("t")).alias("fp"), F.count_if(~hit & F.col("t")).alias("fn"))
    p = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return sums.select("threshold", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 4).alias("f1"))
