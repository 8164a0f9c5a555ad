"""Packing documents into sequences: first-fit decreasing over a tournament tree.

Each document is cut into pieces no longer than a sequence. Documents are
dealt to groups by a hash; every group is packed by itself, longest piece
first, into the first sequence with room for it, which a tree of the
sequences' largest remaining room finds in logarithmic time.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import alone, remembers, table, texts_of
from plumbline.llm.tokens import vocabulary_path
from plumbline.session import ship

VOCABULARY = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 1
#: Documents in a group, on average.
GROUP_DOCS = 2048
#: Distinct words whose ids a worker remembers at most.
_REMEMBER = 450_000
_TOGETHER = 1_000_000
_ASCII_SPACE = re.compile(r"[ \t\n\v\f\r]+")
_CUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def first_fit_decreasing(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """For each length, its bin and its offset there; bins count from 0 without gaps.

    Longer ones come first and equal ones in the order given; each goes to the
    first bin with room. A length above `room` raises ValueError.
    """
    if lengths and max(lengths) > room:
        raise ValueError("a piece is longer than a sequence")
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    best = [room] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need, at = lengths[i], 1
        while at < leaves:
            at *= 2
            if best[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, room - best[at]
        best[at] -= need
        while at > 1:
            at //= 2
            most = max(best[2 * at], best[2 * at + 1])
            if best[at] == most:
                break
            best[at] = most
    return bins, offsets


class WordIds:
    """Token ids of texts, encoded by the tokenizers library a word at a time.

    The vocabulary's normaliser and pre-tokenizer never join across white
    space, so a text's ids are those of its words in order; each distinct word
    is encoded once and remembered.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = "<|endoftext|>"
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        if self.mark_id is None:
            raise ValueError(f"the vocabulary has no {self.mark}")
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()

    @staticmethod
    def words(text: str) -> list[str]:
        """Pieces between white space; the four separators that only str.split() drops are kept."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [w for w in _ASCII_SPACE.split(text) if w]
        return text.split()

    def _learn(self, words: list[str]) -> None:
        """Encode words 64 at a time, with a special token between them, which the library cuts out before all else."""
        odd = [w for w in words if "<|" in w]
        plain = [w for w in words if "<|" not in w] if odd else words
        joined = [self.mark.join(plain[i : i + 64]) for i in range(0, len(plain), 64)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            cuts, raw = np.flatnonzero(ids == self.mark_id), ids.tobytes()
            starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            self.known.update(zip(plain[64 * i : 64 * i + 64], (raw[a:b] for a, b in zip(starts, ends)), strict=True))
        for word, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[word] = np.array(e.ids, "<u4").tobytes()

    def encoded(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and (not held or size + len(texts[at]) <= _TOGETHER):
                held.append(self.words(texts[at]))
                size += len(texts[at])
                at += 1
            wanted = set().union(*held)
            new = wanted.difference(self.known)
            self.again |= wanted.difference(new)
            if new and len(self.known) + len(new) > _REMEMBER:
                # words met in a second lot of texts stay, unless they alone are too many
                stay = self.again if 2 * len(self.again) <= _REMEMBER else wanted.difference(new)
                self.known = {w: self.known[w] for w in stay}
                self.again = set()
            listed = list(new)
            for k in range(0, len(listed), 1 << 14):
                self._learn(listed[k : k + (1 << 14)])
            for words in held:
                yield b"".join(map(self.known.__getitem__, words))


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


remembers("packing", _word_ids.cache_clear)


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, end_id: int = END_ID,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the closing id, cut at every `length` ids, with doc_hash, a hash of all its ids.

    Null and empty texts have the closing id only. A very long text is one row
    of ids in memory while it is cut. Rows that repeat give equal pieces.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("packing")
        ids = _word_ids(vocabulary_path(vocabulary))
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[], [], [], [], [], []]
            found_ids = (found for texts in texts_of(batch, 1) for found in ids.encoded(texts))
            for doc, found in zip(batch.column(0).to_pylist(), found_ids):
                found += end
                total, own = len(found) // 4, xxhash.xxh64_intdigest(found) - (1 << 63)
                for start in range(0, total, length):
                    part = found[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (doc, start, len(part) // 4, zlib.crc32(part), total, own)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [*_COLUMNS, "doc_hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{_CUT}, doc_hash long")


def pack(cut: DataFrame, n_docs: int, length: int = LENGTH, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Adds sequence_id and offset to pieces.

    A document's group follows from its id, its ids' hash and, where the same
    document is there many times, the number of the lot of `group_docs` copies;
    so groups stay near their mean size whatever repeats, and neither the
    number of partitions nor the size of batches moves a piece. Equal pieces
    are counted first and told apart by their number alone. Equal lengths are
    taken in the order of the hash, doc_id, copy and start.
    """
    ship(cut.sparkSession)
    groups = max(1, -(-n_docs // group_docs))
    counted = cut.groupBy(*_COLUMNS, "doc_hash").agg(F.count(F.lit(1)).alias("n"))
    lots = counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / group_docs))))
    keyed = lots.withColumn("h", F.xxhash64("doc_id", "doc_hash", "lot", F.lit(5)))
    keyed = keyed.withColumn("g", F.pmod("h", F.lit(groups))).repartition("g")
    last = F.least(F.col("n"), (F.col("lot") + 1) * group_docs) - 1
    each = keyed.withColumn("copy", F.explode(F.sequence(F.col("lot") * group_docs, last)))
    ordered = each.sortWithinPartitions("g", "h", "doc_id", "copy", "start").select(*_COLUMNS, "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def packed() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            bins, offsets = first_fit_decreasing(rows.column("length").to_pylist(), length)
            ids = [group * (1 << 32) + b for b in bins]
            out = rows.select(_COLUMNS).append_column("sequence_id", pa.array(ids, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            g = np.asarray(batch.column(5))
            edges = np.flatnonzero(np.diff(g)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(g)]):
                if hi == lo:
                    continue
                if held and g[lo] != group:
                    yield packed()
                    held = []
                group = int(g[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield packed()

    return ordered.mapInArrow(run, f"{_CUT}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, length: int = LENGTH, n_docs: int | None = None) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most `length` ids: one row for each piece, none for an empty table.

    Null and empty texts are pieces of the closing id; a null doc_id stays null
    and its rows are packed like any other; rows that repeat are packed as
    often as they are there. Other columns of `docs` play no part.
    """
    return pack(pieces(docs, length), docs.count() if n_docs is None else n_docs, length)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids; edge cases as in packed_documents."""
    return packed_documents(table(spark, sf_dir, "documents"))
