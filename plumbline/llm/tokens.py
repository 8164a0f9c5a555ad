"""Token counts by rank-synchronous merging.

The distinct pre-tokens of a batch lie end to end in one array of symbols. In
every round each pre-token finds its pair of lowest rank and all of its
occurrences are merged at once, in all pre-tokens together; pre-tokens with no
pair left drop out. A pair that holds a merged symbol always ranks after the
merge that made the symbol, so this equals merging one pair at a time.

A long pre-token has thousands of rounds, each of which would pass over all its
symbols; it is merged by itself, with the places of each rank kept in lists, so
that a round touches only the places that it merges and their neighbours.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import alone, remembers, table
from plumbline.session import ship

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
#: White space as the tokenizer's regular expressions have it (fixed values).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The public byte-level pattern (fixed value), with that white space.
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + _SPACE + r"\p{L}\p{N}]+|[" + _SPACE + r"]+(?![^" + _SPACE + r"])|[" + _SPACE + r"]+"
)
#: Distinct pre-tokens whose counts a worker remembers at most.
_REMEMBER = 800_000
#: Pre-tokens with more bytes than this are merged by themselves.
_LONG = 512
#: Characters of texts whose pre-tokens are held at a time, beyond a single text.
_TOGETHER = 3_000_000


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Counts the tokens of texts under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.none = len(merges)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_texts = special
        self.pattern = regex.compile(_PATTERN)
        self.known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none)

    def merged_length(self, word: bytes) -> int:
        """The number of symbols that survive in one word, in time that grows with its merges."""
        n = len(word)
        symbols = self.start[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n, self.none)  # of the pair that begins at each place
        rank[:-1] = self._ranks(symbols[:-1], symbols[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] < self.none]
            places = places[np.argsort(rank[places], kind="stable")]
            edges = np.flatnonzero(np.diff(rank[places])) + 1
            for part in np.split(places, edges) if len(places) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(part)

        wait(np.arange(n - 1))
        left = n
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]  # places whose pair is still that one
            if not len(at):
                continue
            # in a run of overlapping occurrences every second one is taken, from the left
            order = np.arange(len(at))
            runs = np.maximum.accumulate(np.where(np.r_[True, after[at[:-1]] != at[1:]], order, 0))
            at = at[(order - runs) % 2 == 0]
            gone = after[at]
            symbols[at] = self.made[r]
            rank[gone] = self.none
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            left -= len(at)
            fresh = np.unique(np.r_[at, before[at][before[at] >= 0]])
            ends = after[fresh]
            has = ends < n
            rank[fresh] = self.none
            rank[fresh[has]] = self._ranks(symbols[fresh[has]], symbols[ends[has]])
            wait(fresh[has])
        return left

    def merged_lengths(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols that survive in each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        result = sizes.copy()
        symbols = self.start[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols) > 1:
            inside = owner[:-1] == owner[1:]
            ranks = np.where(inside, self._ranks(symbols[:-1], symbols[1:]), self.none)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[ranks, self.none], first)
            spans = np.diff(np.r_[first, len(symbols)])
            best = np.repeat(lowest, spans)
            chosen = np.flatnonzero((ranks < self.none) & (ranks == best[:-1]))
            if not len(chosen):
                break
            # in a run of overlapping occurrences every second one is taken, from the left
            breaks = np.r_[True, np.diff(chosen) > 1]
            run = np.maximum.accumulate(np.where(breaks, chosen, 0))
            chosen = chosen[(chosen - run) % 2 == 0]
            symbols[chosen] = self.made[ranks[chosen]]
            stays = np.ones(len(symbols), bool)
            stays[chosen + 1] = False
            result -= np.bincount(owner[chosen], minlength=len(words))
            stays &= np.repeat(lowest < self.none, spans)  # finished words drop out
            symbols, owner = symbols[stays], owner[stays]
        return result

    def _learn(self, words: set[str]) -> None:
        """Remember the counts of these words; forget all others when there are too many."""
        new = words.difference(self.known)
        if new and len(self.known) + len(new) > _REMEMBER:
            self.known.clear()
            new = words
        listed = list(new)
        for at in range(0, len(listed), 1 << 16):
            some = listed[at : at + (1 << 16)]
            raw = [w.encode("utf-8", "surrogatepass") for w in some]
            self.known.update(zip(some, self.merged_lengths([b if len(b) <= _LONG else b"" for b in raw]).tolist()))
            self.known.update((w, self.merged_length(b)) for w, b in zip(some, raw) if len(b) > _LONG)

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text, taking about _TOGETHER characters of texts at a time."""
        find, out, at = self.pattern.findall, [], 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and (not held or size + len(texts[at]) <= _TOGETHER):
                text = texts[at]
                n, parts = 0, [text]
                if any(s in text for s in self.special_texts):
                    parts = self.special.split(text)
                    n = len(parts) - 1
                held.append((n, [w for p in parts for w in find(p)] if n else find(text)))
                size += len(text)
                at += 1
            self._learn(set().union(*(words for _, words in held)))
            count = self.known.__getitem__
            out += [n + sum(map(count, words)) for n, words in held]
        return out


@lru_cache(maxsize=4)
def _merger(path: str) -> RankMerger:
    return RankMerger(path)


remembers("tokens", _merger.cache_clear)


def vocabulary_path(name: str) -> str:
    """Where the named public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text, one row for each row of docs.

    A null text counts as empty, a null doc_id stays null, rows that repeat are
    counted each, other columns play no part, and an empty table gives no row.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("tokens")
        merger = _merger(path or vocabulary_path(vocabulary))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            counts = np.array(merger.counts(texts), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts), pa.array(counts > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; edge cases as in token_counts."""
    return token_counts(table(spark, sf_dir, "documents"))
