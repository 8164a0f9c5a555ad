"""Encoding and decoding against the library, and the transducer against a dictionary."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.queries import QUERIES
from plumbline.llm.transducer import Transducer, compiled

from test_operators import ODD, odd_documents


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 5), max_size=5).map(tuple), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_transducer_equals_a_dictionary(tmp_path_factory, known, others):
    path = tmp_path_factory.mktemp("t") / "lexicon.bin"
    path.write_bytes(compiled(sorted(known.items())))
    words = [*known, *others]
    found, sizes, numbers = Transducer(str(path)).lookup(words)
    parts = np.split(numbers, np.cumsum(sizes)[:-1]) if words else []
    assert found.tolist() == [w in known for w in words]
    assert [tuple(p.tolist()) for p in parts] == [known.get(w, ()) for w in words]


def test_suffixes_and_outputs_are_shared(tmp_path):
    """26 x 26 words with one ending: a state for each letter that matters, not one for each prefix."""
    letters = [bytes([c]) for c in range(97, 123)]
    words = {a + b + b"ing": (a[0], b[0], 7) for a in letters for b in letters}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(compiled(sorted(words.items())))
    t = Transducer(str(path))
    assert len(t.ends) == 6 and len(t.arcs) == 26 + 26 + 3
    with pytest.raises(ValueError):
        compiled([(b"b", ()), (b"a", ())])


def test_ids_and_texts_equal_the_library(spark, data, library):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()] + ODD
    texts += ["a" + chr(i) + " " + chr(i) + "b" + chr(i) + "1  " + chr(i) * 2 for i in range(0, 0x30000, 7) if not 0xD800 <= i < 0xE000]
    rng = np.random.default_rng(0)
    letters = lambda n, a: "".join(rng.choice(list(a), n))
    texts += [letters(20_000, "abcdefghijklmnopqrstuvwxyz"), letters(3000, "aab"), "ab" * 3000 + "a", "é" * 3000, letters(900, "theandof"), "a" * 511, "a" * 513]
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    import public_tokenizers

    codec = bpe.BytePairs(public_tokenizers.path(bpe.VOCABULARY))
    assert [x.tolist() for x in codec.encoded([t or "" for t in texts])] == want
    some = want + [rng.integers(0, library.get_vocab_size(), rng.integers(0, 12)).tolist() for _ in range(3000)]  # also bytes that are no text
    got = bpe.TokenBytes(public_tokenizers.path(bpe.VOCABULARY)).decoded(np.concatenate(some).astype(int), np.array([len(i) for i in some]))
    assert got == library.decode_batch(some, skip_special_tokens=False)


def test_query_equals_the_library(spark, data, library):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, QUERIES["op13_bpe"](spark, data).collect())) == sorted(want)


def test_any_lexicon_gives_the_same_ids(spark, library):
    docs = odd_documents(spark).withColumn("ids", F.lit("z")).withColumn("n", F.lit(0)).repartition(3)
    small = bpe.lexicon(docs, words=5)
    key = lambda r: tuple(map(str, r))
    plain = sorted(map(tuple, bpe.encoded(docs).collect()), key=key)
    assert plain == sorted(map(tuple, bpe.encoded(docs, lexicon_name=small).collect()), key=key) == sorted(map(tuple, bpe.encoded(docs, lexicon_name=bpe.lexicon(docs)).collect()), key=key)
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.encoded(docs, lexicon_name=small)).collect() if r.doc_id is not None}
    assert back == {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    assert bpe.encoded(docs.limit(0), lexicon_name=bpe.lexicon(docs.limit(0))).count() == 0


def test_frequent_words_are_counted_over_all(spark):
    docs = spark.createDataFrame([(i, " b a" if i % 2 else " a") for i in range(50)] + [(99, None)], "doc_id long, text string").repartition(4)
    counts = lambda **k: {bytes(r.word): r.n for r in bpe.frequent_words(docs, **k).collect()}
    assert counts(words=2) == {b" a": 50, b" b": 25} and counts(words=1) == {b" a": 50} == counts(least=26) and counts(words=0) == {}
    assert bpe.decoded(spark.createDataFrame([(1, None), (2, [None, 10**6, 64])], "doc_id long, ids array<int>")).collect()[1].text == "a"
