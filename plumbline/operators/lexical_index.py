"""A stored inverted index for BM25: blocks of postings with bounds, in segments.

A segment holds some documents and is never changed. Its documents lie in
ranges of bounded size, which are alike in length; a block has the postings of
one term in one range, and beside them the greatest frequency and the least
length in it, from which a bound of its scores follows for any average length.
Deleted documents are named in tombstones, with what they take from the counts.

A search has two phases. The bounds of a question's blocks are added up for
each range (no postings are read); the best ranges are scored, and the score of
their k-th document is a threshold. Only ranges whose bound reaches it are
scored then. The result is exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.text import lexical_tokens
from plumbline.operators.retrieval import EPSILON, K1, POOL, B, asked_terms, ranked, small
from plumbline.session import file_key, remove, shared_folder, ship, subfolders

#: Documents of a range, and so postings of a block, on average at most.
RANGE_DOCS = 256
#: Words of a range's documents, on average at most; it is held by a task while its blocks are made.
RANGE_WORDS = 1 << 22
#: Ranges that a question scores to get its threshold.
PILOT_RANGES = 2
#: Scores are compared at six places.
_MARGIN = 1e-6


def term_counts(tokens: Column) -> Column:
    """[(term, tf)] of an array of words, sorted by term, in time n log n: equal words stand side by side once sorted."""
    starts = lambda s: F.filter(F.transform(s, lambda x, i: i), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
    pairs = lambda s: F.transform(F.array(starts(s)), lambda at: F.transform(at, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - i).alias("tf"))))
    return F.get(F.get(F.transform(F.array(F.sort_array(tokens)), pairs), F.lit(0)), F.lit(0))


def weight(tf: Column, dl: Column, mean_dl: Column) -> Column:
    """BM25's weight of a term without its idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean_dl))


def _range_blocks(documents: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The blocks of one range's documents: (term, range, n, max_tf, min_dl, postings)."""
    rows = pa.Table.from_batches(documents).combine_chunks()
    lists = rows.column("terms").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    entries = lists.flatten()
    terms = entries.field("term").dictionary_encode()
    code, n = terms.indices.to_numpy(), np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary))
    order = np.argsort(code, kind="stable")
    row = np.repeat(np.arange(len(sizes)), sizes)[order]
    starts = np.concatenate([[0], np.cumsum(n)])
    tf, dl = entries.field("tf").to_numpy()[order], rows.column("dl").to_numpy()[row]
    ids = rows.column("doc_id").combine_chunks().take(pa.array(row))
    postings = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([ids, pa.array(tf), pa.array(dl)], ["doc_id", "tf", "dl"]))
    most, least = (f.reduceat(x, starts[:-1]) if len(n) else x for f, x in ((np.maximum, tf), (np.minimum, dl)))
    place = np.full(len(n), rows.column("range")[0].as_py(), np.int64)
    return pa.RecordBatch.from_arrays([terms.dictionary, *map(pa.array, (place, n.astype(np.int64), most, least)), postings], ["term", "range", "n", "max_tf", "min_dl", "postings"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents that arrive range by range, each range whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        place = batch.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1), len(place)] if len(place) else []
        for start, end in zip(cuts, cuts[1:]):
            if held and held[0].column("range")[0].as_py() != place[start]:
                yield _range_blocks(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield _range_blocks(held)


class LexicalIndex:
    """An index under a folder that all executors share. Documents have doc_id and text."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    # --- writing ---

    def segments(self) -> list[int]:
        """Numbers of the complete segments."""
        return sorted(int(n) for n in subfolders(self.spark, f"{self.path}/segments") if subfolders(self.spark, f"{self.path}/segments/{n}/counts", "_SUCCESS"))

    def add(self, docs: DataFrame) -> int:
        """Index these documents as a new segment, which counts once it is whole; its number. Earlier segments aren't touched.

        A null text has no words; a document with a null doc_id is left out.
        """
        number = max([-1, *map(int, subfolders(self.spark, f"{self.path}/segments"))]) + 1
        at = f"{self.path}/segments/{number}"
        rows = docs.where("doc_id is not null").select("doc_id", term_counts(lexical_tokens(F.col("text"))).alias("terms"))
        length = F.coalesce(F.aggregate("terms", F.lit(0), lambda n, t: n + t["tf"]), F.lit(0))
        rows.select("doc_id", length.alias("dl"), "terms").write.parquet(f"{at}/documents")
        kept = self.spark.read.parquet(f"{at}/documents")
        # lengths fall into about a hundred classes at most; each has ranges for its number of documents and words
        size = F.floor(4 * F.log2(F.col("dl") + 1.0)).cast("int")
        held = kept.groupBy(size.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).collect()
        classes = {r.c: max(-(-r.n // RANGE_DOCS), -(-r.words // RANGE_WORDS)) for r in held}
        spans = F.create_map(*[F.lit(x) for pair in classes.items() for x in pair]) if classes else F.create_map().cast("map<int,int>")
        place = F.shiftleft(size.cast("long"), 32) + F.pmod(F.xxhash64("doc_id"), spans[size].cast("long"))
        # documents are dealt, not postings: a range lies in one task, which turns it around
        ship(self.spark)
        dealt = kept.select("doc_id", "dl", place.alias("range"), "terms").repartition("range").sortWithinPartitions("range")
        kind = dict(kept.dtypes)["doc_id"]
        dealt.mapInArrow(_blocks, f"term string, range long, n long, max_tf int, min_dl int, postings array<struct<doc_id:{kind},tf:int,dl:int>>").write.parquet(f"{at}/blocks")
        self.spark.read.parquet(f"{at}/blocks").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{at}/terms")
        kept.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("n_words")).write.parquet(f"{at}/counts")
        return number

    def delete(self, ids: DataFrame) -> None:
        """Documents with these ids (column doc_id) are found no more; segments stay as they are, and ids may be added again later."""
        segments = self.segments()
        gone = self._documents(segments).join(small(ids.select("doc_id").distinct()), "doc_id", "left_semi")
        at = f"{self.path}/tombstones/{uuid.uuid4().hex[:12]}"
        gone.select("doc_id", F.col("segment").alias("dead_in"), "dl", "terms").write.parquet(f"{at}/documents")
        kept = self.spark.read.parquet(f"{at}/documents")
        kept.select(F.explode("terms.term").alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("df")).write.parquet(f"{at}/terms")
        kept.agg((-F.count(F.lit(1))).alias("n_docs"), (-F.coalesce(F.sum("dl"), F.lit(0))).alias("n_words")).write.parquet(f"{at}/counts")

    def upsert(self, docs: DataFrame) -> int:
        """Replace the documents of these ids, or add them."""
        self.delete(docs)
        return self.add(docs)

    # --- reading ---

    def _dead(self) -> list[str]:
        return [f"{self.path}/tombstones/{n}" for n in subfolders(self.spark, f"{self.path}/tombstones") if subfolders(self.spark, f"{self.path}/tombstones/{n}/counts", "_SUCCESS")]

    def _read(self, part: str, segments: list[int] | None = None) -> DataFrame:
        out = None
        for n in self.segments() if segments is None else segments:
            one = self.spark.read.parquet(f"{self.path}/segments/{n}/{part}").withColumn("segment", F.lit(n))
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError(f"no index at {self.path}")
        return out

    def _alive(self, rows: DataFrame) -> DataFrame:
        """rows (doc_id, segment) without deleted documents."""
        for at in self._dead():
            gone = self.spark.read.parquet(f"{at}/documents").select("doc_id", F.col("dead_in").alias("segment"))
            rows = rows.join(gone, ["doc_id", "segment"], "left_anti")
        return rows

    def _documents(self, segments: list[int]) -> DataFrame:
        return self._alive(self._read("documents", segments))

    def documents(self) -> DataFrame:
        """(doc_id, dl, terms) of the documents that are found."""
        return self._documents(self.segments()).select("doc_id", "dl", F.col("terms.term").alias("terms"))

    def counts(self) -> DataFrame:
        """One row: n_docs and mean_dl."""
        rows = self._read("counts").drop("segment")
        for at in self._dead():
            rows = rows.unionByName(self.spark.read.parquet(f"{at}/counts"))
        total = rows.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n_words"))
        return total.select("n_docs", (F.col("n_words") / F.nullif(F.col("n_docs"), F.lit(0))).alias("mean_dl"))

    def terms(self) -> DataFrame:
        """(term, df, idf) over all documents; an idf that would be negative is EPSILON times the mean one."""
        rows = self._read("terms").drop("segment")
        dead = self._dead()
        for at in dead:
            rows = rows.unionByName(self.spark.read.parquet(f"{at}/terms"))
        if dead or len(self.segments()) > 1:
            rows = rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        raw = rows.crossJoin(F.broadcast(self.counts())).withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
        mean = raw.agg(F.avg("raw").alias("mean_idf"))
        return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))  # one row

    def _asked(self, questions: DataFrame) -> DataFrame:
        """(query_id, term, w): terms of the questions that the index has, their idf times how often they are asked."""
        asked = asked_terms(questions)
        own = self.terms().join(small(asked.select("term").distinct()), "term", "left_semi")
        return asked.join(own, "term").select("query_id", "term", (F.col("qn") * F.col("idf")).alias("w"))

    def bounds(self, questions: DataFrame) -> DataFrame:
        """(query_id, segment, range, n_blocks, bound): what a document of the range can score at most."""
        asked = self._asked(questions)
        blocks = self._read("blocks").select("segment", "term", "range", "max_tf", "min_dl").join(small(asked.select("term").distinct()), "term", "left_semi")
        most = F.greatest(F.lit(0.0), F.col("w") * weight(F.col("max_tf"), F.col("min_dl"), F.col("mean_dl")))
        rows = blocks.join(asked, "term").crossJoin(F.broadcast(self.counts()))  # one row
        return rows.groupBy("query_id", "segment", "range").agg(F.count(F.lit(1)).alias("n_blocks"), F.sum(most).alias("bound"))

    def _by_document(self, blocks: DataFrame, more: list[str]) -> DataFrame:
        """(term, segment, doc_id, more) of these blocks, dealt by document.

        Questions that meet them then add up without another exchange, and a task cuts to
        its own best of each question: what is shuffled are postings, not pairs of a question and a document.
        """
        each = blocks.select("term", "segment", F.explode("postings").alias("p")).select("term", "segment", "p.doc_id", *[f"p.{c}" for c in more])
        return self._alive(each).repartition("doc_id")

    def _scored(self, questions: DataFrame, ranges: DataFrame | None) -> DataFrame:
        """(query_id, doc_id, score) of documents that share a term, in these (query_id, segment, range) or all."""
        asked = self._asked(questions)
        blocks = self._read("blocks").join(small(asked.select("term").distinct()), "term", "left_semi").select("segment", "term", "range", "postings")
        if ranges is None:
            each = self._by_document(blocks, ["tf", "dl"]).join(small(asked), "term")
        else:
            met = blocks.join(asked.join(ranges, "query_id"), ["term", "segment", "range"])
            each = self._alive(met.select("query_id", "segment", "w", F.explode("postings").alias("p")).select("query_id", "segment", "w", "p.*"))
        rows = each.crossJoin(F.broadcast(self.counts()))  # one row
        return rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * weight(F.col("tf"), F.col("dl"), F.col("mean_dl"))).alias("score")).where("score > 0")

    def scores(self, questions: DataFrame) -> DataFrame:
        """(query_id, doc_id, score) of all documents with a score above zero."""
        return self._scored(questions, None)

    def reached(self, questions: DataFrame, limit: int = POOL) -> DataFrame:
        """The bounds() rows that a search reads, with `threshold` (null: fewer than `limit` documents in the best ranges)."""
        every = self.bounds(questions)
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range")
        pilot = every.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= PILOT_RANGES).select("query_id", "segment", "range")
        least = Window.partitionBy("query_id").orderBy(F.desc("score"))
        threshold = self._scored(questions, pilot).withColumn("_r", F.row_number().over(least)).where(F.col("_r") == limit).select("query_id", F.col("score").alias("threshold"))
        return every.join(threshold, "query_id", "left").where(F.col("threshold").isNull() | (F.col("bound") >= F.col("threshold") - _MARGIN))

    def search(self, questions: DataFrame, limit: int = POOL) -> DataFrame:
        """(query_id, doc_id, score, rank): the best documents of each question, ties by doc_id."""
        scored = self._scored(questions, self.reached(questions, limit).select("query_id", "segment", "range"))
        return ranked(scored, ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], limit)

    def overlap(self, questions: DataFrame, limit: int = POOL) -> DataFrame:
        """(query_id, doc_id, score, rank): the share of the question's distinct words that the document has."""
        asked = asked_terms(questions)
        sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        blocks = self._read("blocks").join(small(asked.select("term").distinct()), "term", "left_semi")
        each = self._by_document(blocks, []).join(small(asked.select("query_id", "term")), "term")
        hits = each.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("c")).join(small(sizes), "query_id")
        return ranked(hits.select("query_id", "doc_id", (F.col("c") / F.col("n")).alias("score")), ["query_id"], [F.round("score", 6).desc(), F.col("doc_id")], limit)


def stored(docs: DataFrame) -> LexicalIndex:
    """The index of a stored table's documents, built at its first use in this application and found again later."""
    spark = docs.sparkSession
    index = LexicalIndex(spark, f"{shared_folder(spark)}/lexical-{file_key(docs)}")
    if not index.segments():
        remove(spark, index.path)  # of a build that broke off
        index.add(docs)
    return index
