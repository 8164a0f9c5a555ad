"""The pipeline's stages, each against what its operator says of its own input."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from plumbline.llm import packing, simhash
from test_operators import odd_documents, reference_components, reference_fingerprint


@pytest.fixture(scope="module")
def stages(spark, data):
    """Each stage's input and output, as rows."""
    docs, seen = spark.read.parquet(f"{data}/documents.parquet"), []
    for i, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, data).cache()
        seen.append((docs, out))
        docs = out
    return seen


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_classifier_keeps_rows_as_they_were(stages):
    before, after = (set(map(tuple, x.collect())) for x in stages[0])
    assert after <= before and 0.6 * len(before) < len(after) < len(before)


def test_one_of_each_class_stays(stages):
    rows, kept = (x.collect() for x in stages[1])
    classes = reference_components([(r.doc_id, reference_fingerprint(r.text)) for r in rows])
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in classes})


def test_secrets_stage_keeps_every_document(stages):
    before, after = ({r.doc_id: r for r in x.collect()} for x in stages[2])
    assert set(before) == set(after)
    changed = [d for d in before if before[d].text != after[d].text]
    assert all("[redacted]" in after[d].text and after[d].n_chars == len(after[d].text) for d in changed)


def test_mixing_rereads_but_rarely_drops(stages):
    before, after = (x.collect() for x in stages[3])
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert len({r.doc_id for r in after}) > 0.9 * len(before)


def test_packed_sequences(stages):
    docs, out = stages[4]
    rows = docs.collect()
    texts = {r.doc_id: r.text for r in rows}
    found = packing.WordIds(public_tokenizers.path(packing.VOCABULARY)).encoded(list(texts.values()))
    ids = {d: x + (1).to_bytes(4, "little") for d, x in zip(texts, found)}
    pieces = out.collect()
    assert sum(r.length for r in pieces) == sum(len(ids[r.doc_id]) // 4 for r in rows)
    once = {}
    for r in pieces:
        once.setdefault((r.doc_id, r.start), r)
    assert {d for d, _ in once} == set(ids)


def test_odd_documents_pass_through(spark, data):
    docs = odd_documents(spark)
    for name, stage in P.STAGES[:4]:
        assert stage(spark, docs, data).columns == docs.columns
    assert P.STAGES[4][1](spark, docs, data).count() >= docs.count()
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_run_on_odd_documents_among_others(spark, data, tmp_path):
    """All five stages over odd rows among the usual ones: what the classifier keeps is packed, and extra columns do no harm."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = odd_documents(spark)
    extra = [c for c in odd.columns if c not in docs.columns]
    both = docs.withColumn("doc_id", F.col("doc_id") + 10_000).select(*docs.columns, *[F.lit(None).cast("int").alias(c) for c in extra]).unionByName(odd, allowMissingColumns=True)
    both.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 10_000)
    labels.unionByName(spark.createDataFrame([(100, 1, 0), (None, 1, 0), (3, None, None), (101, 1, 0), (101, 0, 1)], labels.schema)).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    d = str(tmp_path)
    kept = P.classify_quality(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    pieces = P.run(spark, d).collect()
    assert {r.doc_id for r in pieces} <= {r.doc_id for r in kept.select("doc_id").collect()}
    assert len({r.doc_id for r in pieces if (r.doc_id or 0) >= 10_000}) > 0.5 * docs.count()
    by_seq = {}
    for r in pieces:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_on_empty_tables(spark, data, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{data}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run(spark, data):
    assert P.run(spark, data).count() > 0
    assert P.ORACLE_SQL is None
