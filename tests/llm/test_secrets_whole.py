"""Verdicts of the secret scan: many repositories of one owner, and short assigned values."""

from plumbline.llm import secrets

SCHEMA = "doc_id long, text string, source string"
KEY = "token = \"f33e61083db5dbdf4bd2369d2f80176e57f7fda2\""


def test_many_repositories_of_one_owner_make_a_copied_example(spark):
    n = secrets.MAX_REPOS
    rows = [(i, KEY, "hot") for i in range(n + 1)] + [(100 + i, KEY.replace("f33e", "0bad"), "hot") for i in range(n)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for r in secrets.secret_spans(docs).collect():
        copied = r.doc_id < 100
        assert (r.n_live, r.n_copied) == ((0, 2) if copied else (2, 0))
        assert r.span_repos == ",".join([str(n + 1 if copied else n)] * 2)
    text = {r.doc_id: r.text for r in secrets.without_live_secrets(docs).collect()}
    assert text[0] == KEY and text[100] == "[redacted]\""


def test_short_assigned_values(spark):
    live = ["password=hunter2", "passwd: 'correcthorse", "secret = \"12345678", "api_key: aB3dE6"]
    other = ["password = required", "token = self.token", "token: 12345678", "secret=abc1"]
    got = secrets.secret_spans(spark.createDataFrame([(i, t, "mine") for i, t in enumerate(live + other)], SCHEMA)).collect()
    assert {r.doc_id: r.n_live for r in got} == {i: int(i < len(live)) for i in range(len(live + other))}
