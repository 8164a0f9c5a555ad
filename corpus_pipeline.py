"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and reads what the one before kept. All
but the last return the columns of documents.

In every stage a null text counts as an empty one, a null doc_id stays null,
rows that repeat are documents each (but for the near duplicates, of which one
stays), very long texts are read whole, other columns go along whatever their
names are, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import mixing, packing, quality, secrets, simhash
from plumbline.llm.common import discard, table, written

#: Shares of the tokens to aim for beside the sound documents, which are read 1.05 times on average.
TARGETS = {"sound": 0.93, "toxic": 0.03, "poor": 0.03, "poor_toxic": 0.01}
SPARE = 1.05


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, as they were; one at the cutoff is kept, and without labels all are."""
    model = quality.fit_grades(docs, table(spark, sf_dir, "labels"))
    return quality.kept_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live credentials masked in their texts."""
    return secrets.without_live_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say; a document that is read twice has two rows.

    The domains are learned from all labelled documents, those rejected before included.
    """
    model = mixing.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixing.mixed_documents(docs, model, TARGETS, SPARE)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality classifier", classify_quality),
    ("near duplicates", drop_near_duplicates),
    ("secret scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models, hashing and tokenizers are out of SQL's reach; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again, and go when the next one's are there."""
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if kept is not None:
            discard(kept)
        docs = kept = done
    return STAGES[-1][1](spark, docs, sf_dir)
