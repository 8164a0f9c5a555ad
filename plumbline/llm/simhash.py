"""SimHash near-duplicate classes by pigeonhole blocks.

A fingerprint is split into four blocks of 16 bits. Two fingerprints that
differ in at most two bits agree on at least two of the four blocks, so each
fingerprint is filed under the six pairs of its blocks; fingerprints that meet
in a bucket are compared. Buckets with many fingerprints take another exact
way, which never compares all pairs: see `_hot_links`.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import alone, discard, table, texts_of, written
from plumbline.session import ship

#: A bucket with more distinct fingerprints than this is linked through midpoints.
HOT_BUCKET = 24
SHINGLE_WORDS = 3
SEED = 42
_BLOCK_PAIRS = list(combinations(range(4), 2))
#: Below this many hot buckets their keys are broadcast (16 bytes each).
_BROADCAST_KEYS = 200_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's three-word shingles, as a signed integer.

    Null and wordless texts give zero; fewer than three words make one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(words, words[1:], words[2:])))
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 15):  # a bounded piece of a very long text
        part = shingles[at : at + (1 << 15)]
        hashes = np.fromiter((digest(s, SEED) for s in part), np.uint64, len(part))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row for each document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("simhash")
        for batch in batches:
            fps = [fingerprint(t) for texts in texts_of(batch, 1) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _block(fp, i: int):
    return F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))


def _filed(fps: DataFrame) -> DataFrame:
    """(bucket, fp): each fingerprint under its six pairs of blocks."""
    fp = F.col("fp")
    keys = [
        F.lit(t << 32).bitwiseOR(F.shiftleft(_block(fp, i), 16)).bitwiseOR(_block(fp, j))
        for t, (i, j) in enumerate(_BLOCK_PAIRS)
    ]
    return fps.select(F.explode(F.array(*keys)).alias("bucket"), "fp")


def _hot_links(filed: DataFrame, bits: int) -> DataFrame:
    """Links in large buckets, in rows linear in the bucket's size.

    Members of a bucket differ only outside its two blocks, in 32 places. Each
    member names itself and its 32 one-bit neighbours; two members differ in at
    most two bits exactly if they name a common point. A point has 33 namers at
    most, which are tied to the smallest of them.
    """
    if bits not in (1, 2):
        raise ValueError("midpoints serve one or two differing bits")
    fp = F.col("fp")
    outside = [[16 * b + k for b in range(4) if b not in pair for k in range(16)] for pair in _BLOCK_PAIRS]
    masks = F.array(*[F.array(*[F.lit(0), *[F.lit(int(np.int64(np.uint64(1 << k)))) for k in ks]]) for ks in outside])
    named = filed.select(
        "bucket", "fp", F.explode(F.element_at(masks, (F.shiftright("bucket", 32) + 1).cast("int"))).alias("mask")
    ).select("bucket", "fp", fp.bitwiseXOR(F.col("mask")).alias("point"))
    met = named.groupBy("bucket", "point").agg(F.collect_list("fp").alias("near")).where(F.size("near") > 1)
    tied = met.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a < b")
    return tied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b), a < b: enough links between distinct fingerprints to connect all that differ in `bits` bits or fewer."""
    filed = _filed(fps)
    hot = written(filed.groupBy("bucket").count().where(F.col("count") > HOT_BUCKET).select("bucket"), "hot-buckets")
    n_hot = hot.count()
    cold = filed
    if n_hot:
        keys = F.broadcast(hot) if n_hot <= _BROADCAST_KEYS else hot
        cold = filed.join(keys, "bucket", "left_anti")
    x, y = cold.alias("x"), cold.alias("y")
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.fp") < F.col("y.fp"))
                   & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits))
    out = pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if n_hot:
        out = out.unionByName(_hot_links(filed.join(keys, "bucket", "left_semi"), bits))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being the smallest node reachable.

    Alternating large and small stars: a node's larger neighbours are tied to
    its smallest one, then its smaller neighbours are, until only stars are
    left. Chains halve in every round, so the rounds grow with the logarithm of
    the longest one. A round's tables lie in the shared folder. Only sums by
    key and joins with a written table of one row for each key are used, so
    that a node with very many links can be spread over tasks.
    """
    def starred(links: DataFrame, both_ways: bool) -> DataFrame:
        """Ends above the node (both_ways), or the node and its smaller ends, tied to the smallest."""
        ends = links.union(links.select("b", "a")) if both_ways else links
        least = written(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
        tied = ends.where("b > a" if both_ways else "true").join(least, "a")
        if both_ways:
            new = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            new = tied.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b")
        out = written(new.distinct(), "stars")
        discard(least)
        return out

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first())

    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(links)
    while before[0]:
        large = starred(links, True)
        small = starred(large, False)
        discard(links)
        discard(large)
        links, after = small, state(small)
        if after == before:
            break
        before = after
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each document.

    Documents whose fingerprints differ in `bits` bits or fewer are linked, and
    a component's id is its smallest doc_id. Null and empty texts have
    fingerprint zero and are linked like any other. A null doc_id is never a
    component's id unless the component has no other. Rows that repeat have a row
    each; very long texts are hashed a bounded piece at a time; columns of other
    names play no part; an empty table gives no row.
    """
    hashed = written(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = written(hashed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "groups")
    roots = components(links(groups.select("fp"), bits))
    tied = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = written(tied.where("root is not null").select("fp", "first", "root"), "linked")
    least = written(linked.groupBy("root").agg(F.min("first").alias("component_id")), "components")
    classes = written(
        linked.join(least, "root").select("fp", "component_id")
        .unionByName(tied.where("root is null and n > 1").select("fp", F.col("first").alias("component_id"))), "classes")
    discard(linked)
    discard(least)
    discard(groups)
    return hashed.join(classes, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, bits: int = 2) -> DataFrame:
    """The documents, one of each class of near duplicates: the one with the smallest doc_id.

    Of rows that repeat that doc_id one stays. Documents without a doc_id stay.
    """
    classes = written(near_duplicates(docs.select("doc_id", "text"), bits).select("doc_id", "component_id"), "near-duplicates")
    extra = classes.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    # texts are dealt out by doc_id at every size: the ids to drop grow with the documents
    # (documents without an id take no part, and so don't meet in one task)
    named = docs.where("doc_id is not null").join(extra.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    kept = named.unionByName(docs.where("doc_id is null"))
    repeated = classes.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and classes of all documents; edge cases as in near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
