"""Claims and their evidence obey one rule in the library and in its SQL, whatever characters stand beside the words."""

import pytest
from compare import same

from plumbline.plans import claims as PC

ODD = [" ", " ", "\x0b", "\x0c", "\x01", "\x01s", "\x01x", "ñ", "ſ", "K", "İ", "\U00010400", "\U0001f600", "_", "7", "́", "-", "\n", "\t", "'", "•"]
ANSWER = ("{c}Alpha beta gamma nin{c}e.{c} There is no{c} delta epsilon zeta eta.{c}However{c} alpha {c}beta gamma theta. I{c} do not alpha beta gamma kappa! Note that{c}alpha be{c}ta ga{c}mma de{c}lta."
          " -{c}Alpha beta gamma delta. 1.{c}Beta gamma delta zeta?{c} Gamma [x{c}y] delta zeta NO{c}T kappa{c}. {c}no alpha beta gamma. Pleaſe{c} alpha beta gamma. THIN{c} K beta zeta NOT alpha.")
TEXT = "{c}Alpha beta gamma nin{c}e is{c}not.{c}Delta epsilon{c}zeta eta no{c} there.{c} Be{c}ta gamma {c}delta zeta!{c}Omega{c} psi chi{c}. Gamma delta zeta kappa NO{c}T. {c}no alpha beta."


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    turns = [(i, t, ("user", "assistant")[t], ("q", ANSWER.replace("{c}", c))[t]) for i, c in enumerate(ODD) for t in (0, 1)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(i, TEXT.replace("{c}", c)) for i, c in enumerate(ODD)], "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["context_recall", "extract_claims", "evidence_top3", "sentence_split_simple", "sentence_split"])
def test_one_rule(name, spark, odd):
    import duckdb

    c = duckdb.connect()
    for t in ("conversations", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    same(PC.QUERIES[name](spark, odd), c.sql(PC.ORACLE[name]))
