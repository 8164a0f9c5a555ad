"""Licence texts whose sentences the readings cut."""

import textwrap

from plumbline.llm import licenses


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r for r in licenses.licensed(docs).orderBy("doc_id").collect()]


def test_every_known_sentence_is_found(spark):
    own = [(name, s) for name, forms in licenses.SENTENCES.items() for s in forms]
    rows = found(spark, [s for _, s in own] + ["Some words first. " + s + "\nOther words." for _, s in own])
    assert [r.sentence_ids for r in rows] == [name for name, _ in own] * 2


def test_every_rule_is_found(spark):
    for join in ("\n", " "):
        rows = found(spark, [join.join(licenses.SENTENCES[i][0] for i in ids) for *_, ids in licenses.RULES])
        assert [(r.licenses, r.category) for r in rows] == [(name, kind) for _, name, kind, _ in licenses.RULES]


def test_pieces_alone_are_no_sentence(spark):
    grant, note = licenses.SENTENCES["gpl-grant"][0], licenses.SENTENCES["mpl-note"][0]
    rows = found(spark, [grant.split(": ")[1], grant.split(": ")[0] + ": and then y" + grant.split(": y")[1], note.replace(" 2.0", " 1.1")])
    assert [r.sentence_ids for r in rows] == ["", "", ""]


def wrapped(ids, first, other, blank):
    """The sentences hard-wrapped, each a paragraph: `first` before its first line, `other` before the rest, `blank` between paragraphs."""
    paragraphs = [textwrap.wrap(licenses.SENTENCES[i][0], 50) for i in ids]
    return blank.join("".join(f"{other if k else first}{line}\n" for k, line in enumerate(lines)) for lines in paragraphs)


def test_indented_and_commented_texts(spark):
    styles = [("", "  ", "\n"), ("    ", "    ", "\n"), (" * ", " * ", " *\n"), ("// ", "// ", "//\n"), ("# ", "# ", "#\n"), ("\t", "\t", "\r\n"), ("  * ", "    ", "\n"), ("", "", "\n")]
    texts, want = [], []
    for _, name, kind, ids in licenses.RULES:
        for first, other, blank in styles:
            head, tail = ("/*\n", " */\n\nint x;\n") if first == " * " else ("", "")
            texts.append(head + wrapped(ids, first, other, blank) + tail)
            want.append((",".join(ids), name, kind))
    assert [(r.sentence_ids, r.licenses, r.category) for r in found(spark, texts)] == want


def test_heading_before_an_indented_paragraph(spark):
    lines = textwrap.wrap(licenses.SENTENCES["isc-grant"][0], 50)
    text = "The ISC License\n  " + "\n".join(lines)
    assert [r.licenses for r in found(spark, [text])] == ["ISC"]
