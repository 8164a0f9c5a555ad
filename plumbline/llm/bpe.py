"""BPE encoding and decoding with a lexicon of frequent words.

Pre-tokens are counted over all documents, and the most frequent ones are
compiled with their ids into a minimal acyclic transducer, a file that Spark
carries to the executors and that their workers map into memory. Encoding looks
a batch's distinct pre-tokens up in it, all at once, and merges those that it
lacks exactly, by ranks. The lexicon only saves merging: ids are the same with
any lexicon or none.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import alone, discard, remembers, table, written
from plumbline.llm.tokens import VOCABULARY, RankMerger, _byte_symbols, vocabulary_path
from plumbline.llm.transducer import Transducer, compiled
from plumbline.session import shared_folder, ship

#: Words of the lexicon, the most frequent ones; rarer ones are merged.
LEXICON_WORDS = 100_000
#: Words that the documents have fewer times aren't worth a place there.
LEAST_COUNT = 8
#: Bytes of a lexicon's word at most.
LEXICON_BYTES = 48
#: Distinct pre-tokens that a task counts before it hands its counts on.
_COUNTED = 200_000
#: Distinct pre-tokens whose ids a worker remembers at most.
_REMEMBER = 300_000
#: Pre-tokens with more bytes than this are merged by themselves.
_LONG = 512
#: Characters of texts that are worked on together, beyond a single text.
_TOGETHER = 1_000_000


def _together(sizes: np.ndarray, most: int = _TOGETHER) -> Iterator[tuple[int, int]]:
    """Spans of rows that together have `most` units, or one row with more."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, end
        at = end


def _texts(column: pa.StringArray) -> Iterator[tuple[int, int, list[str]]]:
    """(from, to, texts) of a column in spans of bounded size; null texts are empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for at, end in _together(sizes):
        yield at, end, [t or "" for t in column.slice(at, end - at).to_pylist()]


class BytePairs:
    """Encodes texts to ids and decodes ids to texts, under a byte-level vocabulary file."""

    def __init__(self, path: str, lexicon: str | None = None):
        self.merger = RankMerger(path)
        self.lexicon = Transducer(lexicon) if lexicon else None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: int(t["id"]) for t in spec["added_tokens"]}
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[list[str] | str]:
        """The text's pre-tokens in lists, and between them the special strings that it holds."""
        find = self.merger.pattern.findall
        if not any(s in text for s in self.special):
            return [find(text)]
        out, at = [], 0
        for m in self.merger.special.finditer(text):
            out += [find(text[at : m.start()]), m.group()]
            at = m.end()
        return [*out, find(text[at:])]

    def _merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of words of some bytes each, merging each word's pair of lowest rank in every round."""
        m = self.merger
        symbols = m.start[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(symbols):
            inside = owner[:-1] == owner[1:]
            ranks = np.append(np.where(inside, m._ranks(symbols[:-1], symbols[1:]), m.none), m.none)
            first = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(ranks, first)
            best = np.repeat(lowest, np.diff(np.r_[first, len(symbols)]))
            over = best == m.none  # words without a pair left
            done.append(symbols[over])
            owners.append(owner[over])
            chosen = np.flatnonzero((ranks == best) & ~over)
            # in a run of overlapping occurrences every second one is taken, from the left
            run = np.maximum.accumulate(np.where(np.diff(chosen, prepend=-2) > 1, chosen, 0)) if len(chosen) else chosen
            chosen = chosen[(chosen - run) % 2 == 0]
            symbols[chosen] = m.made[ranks[chosen]]
            stays = ~over
            stays[chosen + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        who = np.concatenate(owners)
        return np.bincount(who, minlength=len(words)), np.concatenate(done)[np.argsort(who, kind="stable")]

    def _merged_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: pairs wait in a heap by rank and place, in time n log n."""
        m = self.merger
        symbols = m.start[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        rank_of = self._rank_of
        heap = [(r[0], i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank_of.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # merged meanwhile
            symbols[i], symbols[j], after[i] = rank_of[a, b][1], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank_of.get((symbols[x], symbols[y]))):
                    heapq.heappush(heap, (r[0], x, symbols[x], symbols[y]))
        return np.array([s for s in symbols if s >= 0], np.int32)

    @cached_property
    def _rank_of(self) -> dict[tuple[int, int], tuple[int, int]]:
        m = self.merger
        return {(k >> 20, k & 0xFFFFF): (r, int(m.made[r])) for k, r in zip(m.keys.tolist(), m.rank.tolist())}

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word as 32-bit numbers, from the lexicon or else by merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list[bytes] = [b""] * len(raw)

        def put(places: list[int], sizes: np.ndarray, numbers: np.ndarray) -> None:
            packed, ends = numbers.astype("<i4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            for i, start, end in zip(places, [0, *ends], ends):
                out[i] = packed[start:end]

        rest = range(len(raw))
        if self.lexicon is not None:
            found, sizes, numbers = self.lexicon.lookup([b if len(b) <= LEXICON_BYTES else b"" for b in raw])
            put(np.flatnonzero(found).tolist(), sizes[found], numbers)
            rest = np.flatnonzero(~found).tolist()
        short = [i for i in rest if len(raw[i]) <= _LONG]
        for at in range(0, len(short), 1 << 14):
            some = short[at : at + (1 << 14)]
            put(some, *self._merged([raw[i] for i in some]))
        for i in rest:
            if len(raw[i]) > _LONG:
                out[i] = self._merged_long(raw[i]).astype("<i4").tobytes()
        return out

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if new and len(self.known) + len(new) > _REMEMBER:
            self.known.clear()
            new = words
        listed = list(new)
        self.known.update(zip(listed, self.word_ids(listed)))

    def encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        held = [self.pieces(t) for t in texts]
        self._learn(set().union(*(part for parts in held for part in parts if not isinstance(part, str))))
        ids = self.known.__getitem__
        for parts in held:
            yield np.frombuffer(b"".join([self.special[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(ids, p)) for p in parts]), "<i4")


class TokenBytes:
    """What each id of a byte-level vocabulary file stands for, end to end in one array of bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: int(t["id"]) for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"] | special
        of_char = {c: b for b, c in enumerate(_byte_symbols())}
        known = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known[i] = token.encode() if token in special else bytes([of_char[c] for c in token])
        self.sizes = np.array([len(b) for b in known], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(known), np.uint8)

    def decoded(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ids that lie end to end, `sizes` of them a text; bytes that are no character become U+FFFD, unknown ids nothing."""
        inside = (ids >= 0) & (ids < len(self.sizes))
        ids = np.where(inside, ids, 0)
        lengths = np.where(inside, self.sizes[ids], 0)
        before = np.cumsum(lengths) - lengths
        raw = self.pool[np.repeat(self.first[ids] - before, lengths) + np.arange(lengths.sum())].tobytes()
        ends = np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(sizes)]].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=1)
def _codec(path: str, lexicon: str | None) -> BytePairs:
    return BytePairs(path, SparkFiles.get(lexicon) if lexicon else None)


@lru_cache(maxsize=1)
def _token_bytes(path: str) -> TokenBytes:
    return TokenBytes(path)


remembers("bpe", _codec.cache_clear)


def frequent_words(docs: DataFrame, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS, text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the most frequent pre-tokens of all documents as bytes, with their counts.

    Words of about equal counts (in one of classes of 4 %) go together; with the
    next class there would be more than `words`.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("bpe")
        codec = _codec(vocabulary_path(vocabulary), None)
        seen: Counter = Counter()

        def counts() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in seen], pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, _, texts in _texts(batch.column(0)):
                for text in texts:
                    for part in codec.pieces(text):
                        if not isinstance(part, str):
                            seen.update(part)
                if len(seen) > _COUNTED:
                    yield counts()
        yield counts()

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word binary, n long")
    counted = found.where(F.length("word") <= LEXICON_BYTES).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counted = written(counted.withColumn("size", F.floor(16 * F.log2("n")).cast("int")), "word-counts")
    # counts fall into classes of about 4 %, a thousand at most; as many of the greatest classes as fit are taken
    room, lowest = words, None
    for r in sorted(counted.groupBy("size").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.size):
        room -= r.words
        if room < 0:
            break
        lowest = r.size
    return counted.where(F.col("size") >= (lowest if lowest is not None else 1 << 20)).select("word", "n")


def lexicon(docs: DataFrame, vocabulary: str = VOCABULARY, words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """The name, to Spark's file server, of a lexicon of the documents' most frequent words.

    The words (at most `words` of LEXICON_BYTES bytes) are compiled by the
    driver; the file lies in the shared folder and executors fetch it once.
    """
    spark = docs.sparkSession
    frequent = frequent_words(docs, vocabulary, words, text_col)
    rows = sorted(bytes(r.word) for r in frequent.collect())
    discard(frequent)
    ids = BytePairs(vocabulary_path(vocabulary)).word_ids([w.decode() for w in rows])
    content = compiled((w, tuple(np.frombuffer(i, "<i4").tolist())) for w, i in zip(rows, ids))
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:16]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    out.write(content)
    out.close()
    spark.sparkContext.addFile(f"{shared_folder(spark)}/{name}")
    return name


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, lexicon_name: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every whole text, one row for each row of docs.

    A null text has no ids, a null doc_id stays null, rows that repeat are
    encoded each, other columns play no part, and an empty table gives no row.
    Special strings inside a text are one id each, as by the library's default.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("bpe")
        codec = _codec(vocabulary_path(vocabulary), lexicon_name)
        for batch in batches:
            for at, end, texts in _texts(batch.column(1)):
                ids = list(codec.encoded(texts))
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), flat], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(ids: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with `text`, what their `ids` say, in place of ids; null ids give an empty text, null or unknown ones nothing."""
    ship(ids.sparkSession)
    rest = [f for f in ids.schema.fields if f.name not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _token_bytes(vocabulary_path(vocabulary))
        for batch in batches:
            lists = batch.column("ids")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at, end in _together(sizes):
                ids = pc.fill_null(lists.slice(at, end - at).flatten(), -1).to_numpy(zero_copy_only=False)
                texts = pa.array(known.decoded(ids, sizes[at:end]), pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(at, end - at) for f in rest], texts], [*[f.name for f in rest], "text"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "text string"])
    return ids.select(*[f.name for f in rest], "ids").mapInArrow(run, schema)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, and of the texts that they decode to; edge cases as in encoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encoded(docs, lexicon_name=lexicon(docs))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    back = decoded(rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids"))
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
