"""Approximate places of claims against all stretches of their answers."""

import random
import time

import pyarrow as pa
import pytest

from plumbline.operators import claims as K

SCHEMA = "trace_id int, claim_no int, claim string, answer string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def best_of_all(claim, answer):
    """(ratio, -start) over every stretch of the claim's length."""
    n = len(claim)
    return max((1 - distance(answer[at : at + n], claim) / max(n, len(answer[at : at + n])), -at) for at in range(max(len(answer) - n, 0) + 1))


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstué") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_reworded_claims_are_found_as_by_all_stretches(spark):
    rng = random.Random(7)
    rows = []
    for t in range(12):
        answer = words(rng, 40)
        at = rng.randrange(len(answer) - 40)
        claim = [c for i, c in enumerate(answer[at : at + 40]) if i % 11 != 3]
        claim.insert(20, "zz")
        rows.append((t, 0, "".join(claim), answer))
    got = {r.trace_id: r for r in K.fuzzy_places(spark.createDataFrame(rows, SCHEMA)).collect()}
    for t, _, claim, answer in rows:
        ratio, start = best_of_all(claim, answer)
        assert got[t].ratio == pytest.approx(ratio) and got[t]["at"] == -start


def test_claims_without_a_place(spark):
    rows = [(1, 0, "Water boils around 100 degrees Celsius", "The sky is blue. Water boils at 100 degrees Celsius when at sea level."), (2, 0, "qqq www xxx zzz", "The sky is blue."), (3, 0, "ab", "abab"), (4, 0, "abc", ""), (5, 0, "", "abc"),
            (6, 0, None, "abc"), (7, 0, "abc def", None), (8, 0, "the sky is blue today", "the sky is blue"), (9, 0, "aaaa", "aaaaaaaa"), (9, 1, "aaab", "aaaaaaaa")]
    got = {(r.trace_id, r.claim_no): (r["at"], round(r.ratio, 3)) for r in K.fuzzy_places(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {(1, 0), (8, 0), (9, 0), (9, 1)}
    assert got[1, 0] == (17, 0.816) or got[1, 0][1] >= 0.6
    assert got[8, 0] == (0, 0.714) and got[9, 0] == (0, 1.0) and got[9, 1] == (0, 0.75)


def test_long_repetitive_answers(spark):
    """20,000 characters of a few words, twenty claims: a tenth of a second each where cores are free."""
    rng = random.Random(1)
    answer = " ".join(rng.choice(["the", "court", "held", "that", "and"]) for _ in range(4000))[:20_000]
    rows = [(1, i, answer[i * 700 : i * 700 + 90].replace("h", "k", 4), answer) for i in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).cache()
    df.count()
    K.fuzzy_places(df).collect()
    began = time.perf_counter()
    assert len(K.fuzzy_places(df).collect()) == 20
    assert time.perf_counter() - began < 12
    df.unpersist()


def test_long_claims_try_few_starts(spark):
    """Claims of 3,000 letters have bands of 375 starts, of which few need a distance."""
    rng = random.Random(3)
    answer = words(rng, 3600)[:20_000]
    rows = [(1, i, "".join(c for j, c in enumerate(answer[at : at + 3100]) if j % 31), answer) for i, at in enumerate((0, 8_123, 16_800))]
    df = spark.createDataFrame(rows, SCHEMA)
    began = time.perf_counter()
    got = {r.claim_no: r for r in K.fuzzy_places(df).collect()}
    assert time.perf_counter() - began < 30
    for i, at in enumerate((0, 8_123, 16_800)):
        assert abs(got[i]["at"] - at) <= 101 and got[i].ratio > 0.93


def test_same_as_every_start_of_the_bands(spark):
    """Repeats, ties and claims longer than their answers: the first of the least distances in the three bands."""
    rng = random.Random(11)
    rows = []
    for t in range(60):
        answer = "".join(rng.choice("abcd "[: rng.randint(2, 5)]) for _ in range(rng.randint(3, 160)))
        at = rng.randrange(len(answer))
        claim = "".join(c for c in answer[at : at + rng.randint(3, 120)] if rng.random() > 0.1) + rng.choice(["", "zz", "abab"])
        rows.append((t, 0, claim, answer))
    got = {r.trace_id: (r["at"], r.ratio) for r in K.fuzzy_places(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {}
    for t, _, claim, answer in rows:
        n, last = len(claim), max(len(answer) - len(claim), 0)
        width, votes = max(n // 8, K.BAND), {}
        for a in range(len(answer) - 2):
            for b in {min(max(a - p, 0), last) // width for p in range(n - 2) if claim[p : p + 3] == answer[a : a + 3]}:
                votes[b] = votes.get(b, 0) + 1
        bands = sorted(votes, key=lambda b: (-votes[b], b))[: K.BANDS]
        tried = [(distance(answer[s : s + n], claim), s) for b in bands for s in range(b * width, min(b * width + width - 1, last) + 1)]
        if n >= 3 and tried and 1 - min(tried)[0] / n >= K.LEAST_RATIO:
            want[t] = (min(tried)[1], pytest.approx(1 - min(tried)[0] / n))
    assert got == want and len(want) > 20


def written_mb(spark, group, f):
    """What f's stages wrote to shuffles, spills and tables."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        f()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, told = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {s for job in told.getJobIdsForGroup(group) for s in told.getJobInfo(job).stageIds if told.getStageInfo(s)}
    done = [store.lastStageAttempt(s) for s in stages]
    return sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in done) / 1e6


def test_only_the_rows_go_to_disk(spark):
    """Grams and votes, a row for each letter of an answer and of its claims, were shuffled and sorted: 2.1 MB for 0.2 MB of texts here."""
    rng = random.Random(5)
    rows = []
    for t in range(60):
        answer = words(rng, 400)[:2_000]
        rows += [(t, i, answer[i * 160 : i * 160 + 120].replace("a", "oo"), answer) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(4).cache()
    texts = sum(len(r[2]) for r in rows) + 60 * 2_000
    assert df.count() == len(rows)
    found = []
    mb = written_mb(spark, "claims on disk", lambda: found.extend(K.fuzzy_places(df).collect()))
    df.unpersist()
    assert len(found) == len(rows) and mb < 2 * texts / 1e6, mb


def by_every_start(claim, answer):
    """(at, distance) by the rule's own words: votes, three bands, all their starts."""
    n, last = len(claim), max(len(answer) - len(claim), 0)
    width, votes = max(n // 8, K.BAND), {}
    places = {}
    for p in range(n - 2):
        places.setdefault(claim[p : p + 3], []).append(p)
    for a in range(len(answer) - 2):
        for b in {min(max(a - p, 0), last) // width for p in places.get(answer[a : a + 3], ())}:
            votes[b] = votes.get(b, 0) + 1
    bands = sorted(votes, key=lambda b: (-votes[b], b))[: K.BANDS]
    tried = [(distance(answer[s : s + n], claim), s) for b in bands for s in range(b * width, min(b * width + width - 1, last) + 1)]
    return min(tried)[::-1] if tried and 1 - min(tried)[0] / n >= K.LEAST_RATIO else None


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(17)
    rows = []
    for t, n in enumerate([3, 4, 31, 62, 63, 64, 65, 90, 127, 128, 129, 150, 191, 192, 193]):  # about whole words of 64 letters
        letters = ["ab", "abcde ", "abcdefghijklmnopqrstuvwxyz é", "aé漢\U0001f600\U0001f601 b"][t % 4]
        answer = "".join(rng.choice(letters) for _ in range(n + rng.choice([0, 1, 40, 150])))
        for k, at in enumerate((0, rng.randrange(len(answer)), max(len(answer) - n, 0))):
            claim = "".join(c for c in answer[at : at + n] if rng.random() > 0.08)
            rows.append((t, k, (claim + "".join(rng.choice(letters + "xyz") for _ in range(n)))[:n], answer))
        rows.append((t, 3, "".join(rng.choice("0123456789") for _ in range(n)), answer))
        rows.append((t, 4, answer + "xy", answer))
    return rows, {(t, k): found for t, k, claim, answer in rows if (found := by_every_start(claim, answer))}


@pytest.mark.parametrize("limits", [{}, {"SHORT": 0}, {"SHORT": 100, "BITS": 400}, {"PAIRS": 5}, {"CELLS": 1}, {"HELD": 1, "LOT": 2}])
def test_however_much_a_worker_holds(monkeypatch, odd_rows, limits):
    """Claims side by side and alone, in lots of any size, whichever order an answer's claims come in: as by every start."""
    rows, want = odd_rows
    for name, value in limits.items():
        monkeypatch.setattr(K, name, value)
    rows = random.Random(2).sample(rows, len(rows))
    batches = [pa.RecordBatch.from_pylist([dict(zip(("trace_id", "claim_no", "claim", "answer"), r)) for r in part]) for part in (rows[:50], rows[50:])]
    got = {(r["trace_id"], r["claim_no"]): (r["at"], r["d"]) for b in K._placed(iter([*batches, batches[0].slice(0, 0)])) for r in b.to_pylist() if 1 - r["d"] / r["n"] >= K.LEAST_RATIO}
    assert got == want and len(want) > 40


def test_texts_that_are_not_utf_8(spark):
    """Spark's strings can hold any bytes; such rows neither fail nor harm others."""
    text = lambda b: f"cast(unhex('{b.hex()}') as string)"
    odd = [(b"caf\xe9 and the river", b"the caf\xe9 and the rivers \xff"), (b"\x80\x80\x80", b"\x80\x80\x80\x80"), (b"\xe2\x82\xe2\x82\xe2\x82", b"abc"), (b"the sky is blu", b"and the sky is blue")]
    df = spark.sql(" union all ".join(f"select {i} as trace_id, 0 as claim_no, {text(c)} as claim, {text(a)} as answer" for i, (c, a) in enumerate(odd)))
    got = {r.trace_id: (r["at"], r.ratio) for r in K.fuzzy_places(df).collect()}
    assert got[3] == (4, 1.0) and got[0] == (4, 1.0)
