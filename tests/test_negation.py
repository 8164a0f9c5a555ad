"""Negations are whole words of Unicode letters, in the library and in its SQL."""

from pyspark.sql import functions as F

from plumbline.operators import verification as V
from plumbline.plans import claims as PC

TEXTS = ["noñmentellar", "el ñno", "no", "es no.", "it is Not so", "cannot", "knot", "nót", "no_one", "no-one", "never!", "", "нет no", "no2", "2 no"]


def test_parts_of_words_are_no_negations(spark, duck):
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").orderBy("i").select(F.lower("t").rlike(V.NEGATION).alias("x")).collect()]
    own = duck.cursor()
    sql = [own.execute(f"SELECT regexp_matches(lower(?), '{PC._NEG}')", [t]).fetchall()[0][0] for t in TEXTS]
    assert got == sql == [t in ("no", "es no.", "it is Not so", "cannot", "no-one", "never!", "нет no", "2 no") for t in TEXTS]
