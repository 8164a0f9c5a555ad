"""Claim sets: identity, place in the answer, and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import text_hash
from plumbline.session import ship

LEAST_RATIO = 0.6


def claim_id(trace_id: Column, number: Column) -> Column:
    """TRACE_C001 and so on, from the claim's place."""
    return F.concat(trace_id.cast("string"), F.lit("_C"), F.lpad((number + 1).cast("string"), 3, "0"))


#: Letters of a gram; a band of starts has an eighth of the claim's length, BAND at least; bands that are searched.
GRAM, BAND, BANDS = 3, 8, 3
#: Claims of one answer that are dealt together; letters of a claim up to which it is compared side by side with others.
LOT, SHORT = 32, 512
#: What a worker holds at once: letters of answers and claims; pairs of places; letters of stretches side by side; bits of a long claim's stretches.
HELD, PAIRS, CELLS, BITS = 1 << 22, 1 << 20, 1 << 21, 1 << 20


def dealt(rows: DataFrame, *by: Column | str) -> DataFrame:
    """Rows dealt by a number of partitions that is kept: few bytes, but much to compute for each."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def fuzzy_places(rows: DataFrame, key: str = "trace_id", stay: bool = False) -> DataFrame:
    """(key, claim_no, at, ratio): the stretch of the answer, as long as the claim, that is most like it. rows: key, claim_no, claim, answer.

    Grams of the answer vote for bands of starts: a gram at place a that the
    claim has at place p speaks, once for each band, for the band of a - p
    (moved to the first or last possible start). In the three bands with most
    votes the likest start is taken; likeness is one less the edit distance over the
    claim's length, ties go to the first. A claim
    with fewer letters than a gram, or none of whose grams the answer has, has no row,
    nor has one whose likeness is under LEAST_RATIO. A row is shuffled once, as it
    is, or not at all where it may stay (rows that are dealt already); its grams,
    votes and distances stay in its task.
    """
    ship(rows.sparkSession)
    asked = rows.select(key, "claim_no", "claim", "answer").dropna().where((F.length("claim") >= GRAM) & (F.length("answer") >= GRAM))
    if not stay:  # an answer's claims lie side by side, but not all of a long one's
        asked = dealt(asked, key, F.floor(F.col("claim_no") / LOT))
    kinds = dict(asked.dtypes)
    found = asked.mapInArrow(_placed, f"{key} {kinds[key]}, claim_no {kinds['claim_no']}, n int, at int, d int")
    return found.select(key, "claim_no", "at", (1 - F.col("d") / F.col("n")).alias("ratio")).where(F.col("ratio") >= LEAST_RATIO)


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, number, length, place and distance of each claim (key, claim_no, claim, answer) that has a place."""
    text = lambda x: x.as_py().decode("utf-8", "replace")  # noqa: E731  Spark's strings can hold any bytes
    for batch in batches:
        found, held, size = [], [], 0
        claim_column, answers = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary()).dictionary_encode()
        of = answers.indices.to_numpy()
        for number, rows in groupby(np.argsort(of, kind="stable").tolist(), of.__getitem__):
            rows, answer = list(rows), text(answers.dictionary[int(number)])
            letters = _letters(answer)
            known, said = np.unique(letters, return_inverse=True)
            said, size = said.astype(np.int32), size + len(letters)
            for k in range(0, len(rows), LOT):
                claims = [text(claim_column[i]) for i in rows[k : k + LOT]]
                codes = [_letters(c) for c in claims]
                held += [_Search(i, claim, code, answer, known, said, starts) for i, claim, code, starts in zip(rows[k:], claims, codes, _starts(codes, letters))]
                size += sum(len(x.code) + len(x.starts) for x in held[-len(claims) :])
                if size >= HELD:
                    found += _searched(held)
                    held, size = [], 0
        found += _searched(held)
        i, *rest = (pa.array([x[k] for x in found], pa.int32()) for k in range(4))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(i), batch.column(1).take(i), *rest], [*batch.schema.names[:2], "n", "at", "d"])


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _grams(letters: np.ndarray) -> np.ndarray:
    """The grams by place, each as one number."""
    return sum(letters[i : max(len(letters) - GRAM + 1, 0) + i] << 21 * i for i in range(GRAM))


def _starts(claims: list[np.ndarray], answer: np.ndarray) -> list[np.ndarray]:
    """The starts in the bands with most votes (of equals the first), ascending, for each claim of an answer."""
    grams = _grams(answer)
    places = np.argsort(grams, kind="stable")
    grams = grams[places]
    n = np.array([len(c) for c in claims])
    last, width = np.maximum(len(answer) - n, 0), np.maximum(n // 8, BAND)
    first = np.concatenate([[0], np.cumsum(last // width + 1)])  # of each claim's bands
    each = [_grams(c) for c in claims]
    of, p, own = np.repeat(np.arange(len(n)), [len(x) for x in each]), np.concatenate([np.arange(len(x)) for x in each]), np.concatenate(each)
    order = np.lexsort((own, of))
    again = (own[order[1:]] == own[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    before = np.full(len(own), -1)  # the claim's place before with the same gram
    before[order[1:][again]] = p[order[:-1][again]]
    low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
    ends, votes, start = np.cumsum(high - low), np.zeros(first[-1], np.int64), 0
    while start < len(own):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        met = high[start:stop] - low[start:stop]
        k = np.repeat(np.arange(start, stop), met)
        a = places[np.arange(len(k)) + np.repeat(low[start:stop] - np.cumsum(met) + met, met)]
        most, wide = last[of][k], width[of][k]
        # later places have earlier bands, so a band that was spoken for is that of the place before
        spoken, had = (np.clip(a - x[k], 0, most) // wide for x in (p, before))
        votes += np.bincount((first[of][k] + spoken)[(before[k] < 0) | (spoken != had)], minlength=len(votes))
        start = stop
    out = []
    for i, wide in enumerate(width):
        mine = votes[first[i] : first[i + 1]]
        best = np.argsort(-mine, kind="stable")[:BANDS]
        found = (np.sort(best[mine[best] > 0])[:, None] * wide + np.arange(wide)).ravel()
        out.append(found[found <= last[i]])
    return out


class _Search:
    """A claim's search for the first start with the least distance.

    Moving a stretch by k letters changes its distance by 2k at most. So
    starts that are multiples of higher powers of two are asked for first, and one
    that is known to be too far leaves out its neighbours.
    """

    def __init__(self, row: int, claim: str, code: np.ndarray, answer: str, known: np.ndarray, said: np.ndarray, starts: np.ndarray):
        """known: the answer's different letters, ascending; said: the answer as numbers of these."""
        self.row, self.claim, self.code, self.answer, self.known, self.said, self.starts = row, claim, code, answer, known, said, starts
        self.least = np.zeros(len(starts), np.int64)  # that a start's distance can be
        self.d, self.at = int((1 - LEAST_RATIO) * len(claim)) + 1, -1  # nothing that is farther counts
        self.step = 1 << (max(len(claim) // 8, BAND).bit_length() - 1)

    def asked(self) -> np.ndarray:
        """The next starts that can be the best; step is 0 after the last ones."""
        some = self.starts[(self.starts % self.step == 0) & ((self.least < self.d) | ((self.least == self.d) & (self.starts < self.at)))]
        self.step = self.step // 4 or int(self.step > 1)
        return some

    def told(self, starts: np.ndarray, d: np.ndarray) -> None:
        i = int(d.argmin())
        self.d, self.at = min((self.d, self.at), (int(d[i]), int(starts[i])))
        if self.step:
            self.least = np.maximum(self.least, (d[:, None] - 2 * np.abs(self.starts - starts[:, None])).max(0))


def _searched(held: list[_Search]) -> list[tuple[int, int, int, int]]:
    """(row, n, at, d) of those that found a start."""
    alone = lambda x: len(x.claim) > min(SHORT, len(x.answer))
    left = sorted(held, key=lambda x: -len(x.claim))
    while left:
        lot = []
        for x in left:
            some = x.asked()
            if alone(x):
                for part in np.split(some, range(at := max(1, BITS // len(x.claim)), len(some), at)):
                    if len(part):
                        x.told(part, np.array(_alone(x.claim, x.answer, part.tolist())))
            elif len(some):
                if lot and len(lot[0][0].claim) * (size + len(some)) > CELLS:
                    _tell(lot)
                    lot = []
                size = len(some) + (size if lot else 0)
                lot.append((x, some))
        _tell(lot)
        left = [x for x in left if x.step]
    return [(x.row, len(x.claim), x.at, x.d) for x in held if x.at >= 0]


def _tell(lot: list[tuple[_Search, np.ndarray]]) -> None:
    """Tells searches, those of longer claims first, the distances of starts.

    Myers' bit vectors, a word for 64 letters of a claim: the stretches of all claims lie side by side and move on by a letter in the same operations.
    """
    if not lot:
        return
    one, top, none = np.uint64(1), np.uint64(63), np.uint64(0)
    n, lots = np.array([len(x.code) for x, _ in lot]), np.array([len(s) for _, s in lot])
    ends, cells = np.cumsum(lots), np.cumsum([0, *(len(x.known) for x, _ in lot)])
    words = -(-int(n[0]) // 64)
    table, asked = np.zeros((words, cells[-1]), np.uint64), np.zeros((n[0], ends[-1]), np.int32)
    for (x, starts), cell, end in zip(lot, cells, ends):
        place = np.minimum(np.searchsorted(x.known, x.code), len(x.known) - 1)
        i = np.flatnonzero(x.known[place] == x.code)
        np.bitwise_or.at(table, (i // 64, cell + place[i]), one << (i % 64).astype(np.uint64))
        asked[: len(x.code), end - len(starts) : end] = x.said[np.arange(len(x.code))[:, None] + starts] + cell
    more, less = np.full((words, ends[-1]), ~none), np.zeros((words, ends[-1]), np.uint64)
    longer = lambda k: int(ends[m - 1]) if (m := int(np.searchsorted(-n, -k))) else 0  # noqa: E731  stretches of claims of more than k letters
    within = [longer(64 * w) for w in range(words)]
    for j in range(n[0]):
        still, up_in, down_in = longer(j), one, none
        for w in range(words):
            if w and within[w] < still:
                still = within[w]
                up_in, down_in = up_in[:still], down_in[:still]
            same, m, l = table[w].take(asked[j, :still]), more[w, :still], less[w, :still]
            either = same | l
            same |= down_in
            across = (((same & m) + m) ^ m) | same
            up, down = l | ~(across | m), m & across
            up_out, down_out = up >> top, down >> top
            up, down = up << one | up_in, down << one | down_in
            more[w, :still], less[w, :still] = down | ~(either | up), up & either
            up_in, down_in = up_out, down_out
    d = np.repeat(n, lots)
    for w, k in enumerate(within):
        bits = np.repeat(~none >> np.maximum(64 * (w + 1) - n, 0).astype(np.uint64), lots)[:k]  # of the claim in this word
        d[:k] += np.bitwise_count(more[w, :k] & bits).astype(np.int64) - np.bitwise_count(less[w, :k] & bits)
    for (x, starts), end in zip(lot, ends):
        x.told(starts, d[end - len(starts) : end])


def _alone(claim: str, answer: str, starts: list[int]) -> list[int]:
    """Edit distances of a claim, long or longer than its answer, and the answer's stretches from these places, ascending.

    Myers' bit vectors: a stretch has a lane of n bits and one for the carry in a long
    number, so all move on by a letter in the same few operations. Stretches
    whose starts follow each other hand down their letters, and only the last one's is looked up.
    """
    n, lane = len(claim), len(claim) + 1
    letters: dict[str, int] = {}
    for i, c in enumerate(claim):
        letters[c] = letters.get(c, 0) | 1 << i
    handed = [k for k in range(len(starts) - 1) if starts[k + 1] == starts[k] + 1]
    looked = sorted({*range(len(starts))} - {*handed})
    ones = lambda lanes: sum(1 << lane * k for k in lanes)
    low = ones(range(len(starts)))
    full, keep = (low << n) - low, ((down := ones(handed)) << n) - down
    same = sum(letters.get(answer[starts[k]], 0) << lane * (k + 1) for k in handed)
    more, less = full, 0
    for column in zip(*(answer[starts[k] : starts[k] + n] for k in looked)):
        same = same >> lane & keep
        for k, c in zip(looked, column):
            if c in letters:
                same |= letters[c] << lane * k
        across = (((same & more) + more) ^ more) | same
        up = (less | ((across | more) ^ full) & full) << 1 | low
        either = same | less
        more, less = ((more & across) << 1 | (either | up) ^ full) & full, either & up
    lanes = lambda x, k: (x >> lane * k & (1 << n) - 1).bit_count()
    return [min(n, len(answer)) + lanes(more, k) - lanes(less, k) for k in range(len(starts))]


def own_claims(claims: DataFrame, key: str = "trace_id") -> DataFrame:
    """Claims, trimmed, without empty ones; of those that repeat in any case the first."""
    text = F.trim("claim")
    first = Window.partitionBy(key, F.lower(text)).orderBy("claim_no")
    return claims.where(text != "").withColumn("claim", text).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def located(claims: DataFrame, answers: DataFrame, key: str = "trace_id") -> DataFrame:
    """Claims (key, claim_no, claim) without empty and repeated ones, with ids, hashes and places in the answer.

    A claim that the answer holds has an exact place; the others, and only
    they, are matched approximately (fuzzy_places); a claim without a place has -1.
    """
    rows = own_claims(claims, key).join(answers.select(key, "answer"), key).withColumn("at", F.instr(F.col("answer"), F.col("claim")) - 1)
    exact = rows.where("at >= 0").select(key, "claim_no", "claim", "at", F.lit("exact").alias("match_type"), F.lit(1.0).alias("match_confidence"))
    rest = rows.where("at < 0").drop("at")
    near = F.col("ratio").isNotNull()
    other = rest.join(fuzzy_places(rest, key), [key, "claim_no"], "left").select(
        key, "claim_no", "claim", F.coalesce("at", F.lit(-1)).alias("at"), F.when(near, "fuzzy").otherwise("none").alias("match_type"), F.when(near, F.round("ratio", 3)).otherwise(0.0).alias("match_confidence"))
    out = exact.unionByName(other)
    return out.select(
        key, claim_id(F.col(key), F.col("claim_no")).alias("claim_id"), "claim_no", "claim", F.when(F.col("at") >= 0, F.concat(F.lit("S"), F.col("at").cast("string"))).otherwise(F.concat(F.lit("S_unresolved_"), F.col("claim_no").cast("string"))).alias("sentence_id"),
        F.col("at").cast("int").alias("character_start"), F.when(F.col("at") >= 0, F.col("at") + F.length("claim")).otherwise(-1).cast("int").alias("character_end"), text_hash(F.col("claim")).alias("claim_hash"), "match_type", "match_confidence")


def claim_statistics(found: DataFrame, key: str = "trace_id") -> DataFrame:
    """Claims, resolved sentences, and claims for each sentence of a trace."""
    sentences = F.countDistinct(F.when(F.col("character_start") >= 0, F.col("sentence_id")))
    n = F.count(F.lit(1))
    return found.groupBy(key).agg(n.alias("total_claims"), sentences.alias("total_sentences"), F.round(F.coalesce(n / F.nullif(sentences, F.lit(0)), F.lit(0.0)), 2).alias("claims_per_sentence"))
