"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Every whole text is searched for candidates of four kinds. The hashes of their
values are counted by distinct repositories and owners over the corpus: a value
found with many owners or in many repositories is a widely copied example; any
other is owner-specific and, if it looks like a secret, taken for a live
credential. Unassigned values look so if they are long, with letters and digits;
assigned ones at any counted length, if they have both or stand in quotes.
Placeholders and values of very few different characters never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import table, whole, written

KINDS = ("assign", "access", "hex", "token")
#: Base patterns (fixed values); the last is a candidate of the method's own.
PATTERNS = {
    "assign": r"""((?i)password|passwd|secret|token|api_?key(?-i))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "token": r"(?:gh[opsu]_|xox[abp]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
LEAST_ASSIGNED = 6
#: A value found with more owners than this is a copied example.
MAX_OWNERS = 2
#: So is one found in more repositories than this, whoever owns them.
MAX_REPOS = 10
#: For unassigned values; what is assigned to a name such as `password` may be shorter.
LEAST_LIVE_LENGTH = 16
#: Values that say themselves that they stand for something else, or of fewer different characters than this, are never live.
PLACEHOLDER = r"(?i)example|placeholder|change_?me|your[_-]|redacted"
LEAST_DISTINCT = 5
#: An assigned value in quotes, which is a literal and no name or expression.
_QUOTED = r"""[:=]\x20*["'][A-Za-z0-9+/_.=-]+$"""
MASK = "[redacted]"


def _found(text: Column, kind: str) -> Column:
    """A kind's matches in order: the length of the text before each since the last, the match, and its value."""
    rx = PATTERNS[kind]
    gaps = F.transform(F.split(text, rx, -1), F.length)
    hits = F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rx), F.lit(2)) if kind == "assign" else hits
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    return F.filter(zipped, lambda r: r["hit"].isNotNull())


def scanned(docs: DataFrame, repo_col: str, owner_col: str, whole_rows: bool = False) -> DataFrame:
    """A written table of all documents: row, repo, owner, the matches of each kind (null where there are none), and doc: doc_id, or the whole row."""
    text = F.col("_text")
    any_kind = text.rlike("|".join(f"(?:{rx})" for rx in PATTERNS.values()))
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), _found(text, k).alias("found")) for i, k in enumerate(KINDS)])
    rows = docs.select(
        F.struct(*(docs.columns if whole_rows else ["doc_id"])).alias("_doc"), F.col(repo_col).cast("string").alias("_repo"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("_owner"),
        whole().alias("_text"), F.monotonically_increasing_id().alias("_row"))
    return written(rows.select("_doc", "_row", "_repo", "_owner", F.when(any_kind, kinds).alias("_kinds")), "scanned")


def candidates(scan: DataFrame) -> DataFrame:
    """One row for each candidate that counts: row, kind, start, end (code points), hash of the value, whether it looks like a secret."""
    each = scan.where("_kinds is not null").select("_row", "_repo", "_owner", F.explode("_kinds").alias("k"))
    each = each.select("_row", "_repo", "_owner", F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("at", "m"))
    order = Window.partitionBy("_row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size, value = F.length("m.hit"), F.col("m.value")
    placed = each.withColumn("end", F.sum(F.col("m.gap") + size).over(order)).withColumn("start", F.col("end") - size)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    filled = value.rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split(value, ""))) < LEAST_DISTINCT)
    random = F.when(F.col("kind") == 0, mixed | F.col("m.hit").rlike(_QUOTED)).otherwise(mixed & (F.length(value) >= LEAST_LIVE_LENGTH))
    return placed.where((F.col("kind") != 0) | (F.length(value) >= LEAST_ASSIGNED)).select(
        "_row", "_repo", "_owner", "kind", "start", "end", F.sha2(value, 256).alias("hash"), (random & ~filled).alias("random"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners): distinct repositories and owners of each value, by sums of partial counts."""
    by_repo = found.groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "_owner").agg(F.count("one").alias("repos"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(found: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """Candidates with n_repos, n_owners and live; `found` must be a written table, so that a very common value can be split."""
    counts = written(ownership(found), "ownership")
    return found.join(counts, "hash").withColumn("live", F.col("random") & (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def secret_spans(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, base counts and spans of every document, with all spans, in how many repositories the value of each is (span_repos), and how many are live or copied.

    Spans of the base kinds stay whatever their ownership; credentials of the
    kind `token` are added where they are owner-specific and touch no base span.
    One row for each row of docs: a null text has none; a null owner counts as
    one owner, a null repository as none; a null doc_id stays null; rows that
    repeat are scanned each and count their repository once; spans with the same
    start are in the order of their kinds; very long texts are scanned whole;
    other columns play no part. An empty table gives no row.
    """
    scan = scanned(docs, repo_col, owner_col)
    found = written(candidates(scan), "candidates")
    spans = judged(found, max_owners, max_repos).groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "n_repos"))).alias("s"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean,n_repos:bigint>>")
    rows = scan.where("_kinds is not null").select("_row", "_doc.doc_id").join(spans, "_row", "left")
    rows = rows.select("doc_id", F.coalesce("s", none).alias("s")).unionByName(scan.where("_kinds is null").select("_doc.doc_id", none.alias("s")))
    base = F.filter("s", lambda x: x["kind"] < 3)
    touches = lambda x: F.exists(F.col("base"), lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    everything = F.filter("s", lambda x: (x["kind"] < 3) | (x["live"] & ~touches(x)))
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    out = rows.withColumn("base", base).withColumn("every", everything)
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(text("base"), 256).alias("base_sha256"), text("every").alias("spans"),
        F.array_join(F.transform("every", lambda x: x["n_repos"].cast("string")), ",").alias("span_repos"),
        F.size(F.filter("every", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("every", lambda x: ~x["live"])).cast("long").alias("n_copied"))


def without_live_secrets(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """The documents with every live credential masked in the text (and n_chars, if there, set anew); widely copied examples stay.

    A null text stays null, rows that repeat are masked each, very long texts
    are scanned whole, other columns stay whatever their names are, and an empty
    table stays empty. Spans that overlap are masked as one.
    """
    scan = scanned(docs, repo_col, owner_col, whole_rows=True)
    live = judged(written(candidates(scan), "candidates"), max_owners, max_repos).where("live")
    before = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    opened = live.select("_row", "start", "end", F.coalesce(F.max("end").over(before), F.lit(-1)).alias("reach"))
    run = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = opened.withColumn("n", F.sum((F.col("start") > F.col("reach")).cast("int")).over(run)).groupBy("_row", "n").agg(
        F.min("start").alias("start"), F.max("end").alias("end"))
    masks = merged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("m"))
    text, m = F.col("_doc.text"), F.col("m")
    ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(m, lambda x: x["end"]))
    starts = F.concat(F.transform(m, lambda x: x["start"]), F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(ends, starts, lambda e, s: F.substring(text, (e + 1).cast("int"), (s - e).cast("int")))
    hit = scan.where("_kinds is not null").join(masks, "_row", "left").withColumn("_new", F.when(m.isNull(), text).otherwise(F.array_join(kept, MASK)))
    fresh = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        old = F.col("_doc.n_chars")
        fresh["n_chars"] = F.when(m.isNull(), old).otherwise(F.length("_new").cast(docs.schema["n_chars"].dataType))
    masked = hit.select(*[fresh.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
    return scan.where("_kinds is null").select("_doc.*").unionByName(masked)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents; edge cases as in secret_spans."""
    return secret_spans(table(spark, sf_dir, "documents"))
