"""Judgment parsing: sections, paragraphs and citations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Citation patterns, headings of the printed reports, and the marks of the older layout.
CITATIONS = {
    "SCR": r"(?i)\[(\d{4})\]\s*(\d+)\s*S\.?\s?C\.?\s?R\.?\s*(\d+)",
    "INSC": r"\b(\d{4})\s+INSC\s+(\d+)\b",
    "SCC": r"\((\d{4})\)\s*(\d+)\s*SCC\s*(\d+)",
    "AIR": r"\bAIR\s+(\d{4})\s+SC\s+(\d+)\b",
}
STATUTE = r"\b(?:[Ss]ections?|[Ss]s?\.)\s*(\d+[A-Z]?)(?:\s*\(\d+\))?(?:\s*(?:of|,)\s*(?:the\s+)?([A-Z][A-Za-z'()\. ]{4,70}?Act,?\s*\d{4}))?"
ARTICLE = r"\bArticles?\s*(\d+[A-Z]?)\b"
SECTION_HEADINGS = {
    "Issue for Consideration": "issue",
    "Headnotes": "headnote",
    "Case Law Cited": "case_law_cited",
    "Case Law Citied": "case_law_cited",
    "List of Acts": "acts_cited",
    "List of Keywords": "keywords",
    "Case Arising From": "case_arising_from",
    "Appearances for Parties": "appearances",
    "Judgment / Order of the Supreme Court": "judgment",
    "Judgment/Order of the Supreme Court": "judgment",
}
PARAGRAPH = r"(?m)(?=^[ \t]*\d{1,3}\s*[.)]\s)"
BENCH = r"\[[^\]\n]{5,160}?JJ?\.\s*\]"
OLD_BLOCKS = {
    "judgment": r"(?m)(?:The Judgment of the Court was delivered|^\s*J\s?U\s?D\s?G\s?M\s?E\s?N\s?T\s*$|^\s*O\s?R\s?D\s?E\s?R\s*$)",
    "case_law_cited": r"(?m)^\s*Case Law Reference\s*:?\s*$",
    "case_arising_from": r"(?m)^\s*(?:CIVIL|CRIMINAL)\s+(?:APPELLATE|ORIGINAL)\s+JURISDICTION.*$",
}
#: Sections that are no chunks of their own (the judgment's paragraphs are), and the least length of a section's chunk.
NOT_RETRIEVABLE = ("appearances", "keywords", "judgment")
SECTION_MINIMUM = 40


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _found(text: Column, pattern: str, groups: int) -> Column:
    """The matches of a pattern with their groups g0, g1, ...; an absent group is empty."""
    return F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i)).alias(f"g{i}") for i in range(groups + 1)])


def citations(text: Column) -> Column:
    """(kind, key, raw) of cases, statutes and articles, each key once: patterns in their order, and each in the order of the text.

    A case's key joins its reporter and numbers. A section with a named act has
    the key ACT:<act in capitals>:S<number> and the kind ACT, one without
    SECTION:<number>.
    """
    row = lambda kind, key, raw: F.struct(kind.alias("kind"), key.alias("key"), _bare(raw).alias("raw"))

    def case(kind: str) -> Column:
        n = re.compile(CITATIONS[kind]).groups
        return F.transform(_found(text, CITATIONS[kind], n), lambda z: row(F.lit(kind), F.concat_ws(":", F.lit(kind), *[z[f"g{i}"] for i in range(1, n + 1)]), z["g0"]))

    parts = [case(kind) for kind in CITATIONS]
    act = lambda z: F.upper(_bare(F.regexp_replace(z["g2"], r"\s+", " ")))
    parts.append(F.transform(_found(text, STATUTE, 2), lambda z: row(
        F.when(z["g2"] == "", "SECTION").otherwise("ACT"), F.when(z["g2"] == "", F.concat(F.lit("SECTION:"), z["g1"])).otherwise(F.concat(F.lit("ACT:"), act(z), F.lit(":S"), z["g1"])), z["g0"])))
    parts.append(F.transform(_found(text, ARTICLE, 1), lambda z: row(F.lit("ARTICLE"), F.concat(F.lit("ARTICLE:"), z["g1"]), z["g0"])))
    none = F.array().cast("array<struct<kind:string,key:string,raw:string>>")
    every = F.transform(F.concat(*[F.coalesce(x, none) for x in parts]), lambda x, i: F.struct(x["key"].alias("key"), i.alias("place"), x["kind"].alias("kind"), x["raw"].alias("raw")))
    # sorted by key, so that each first one stands beside what comes before it; every step is bound once and reads the array once
    first = F.transform(F.array(F.array_sort(every)), lambda s: F.filter(s, lambda x, i: ~x["key"].eqNullSafe(F.get(s, i - 1)["key"])))
    ordered = F.array_sort(F.transform(F.get(first, F.lit(0)), lambda x: F.struct(x["place"], x["kind"], x["key"], x["raw"])))
    return F.transform(ordered, lambda x: F.struct(x["kind"].alias("kind"), x["key"].alias("key"), x["raw"].alias("raw")))


def paragraphs(text: Column, preamble: int = 200) -> Column:
    """(number, text) of numbered paragraphs; a long text before the first is paragraph 0; without numbers all is paragraph 0."""
    parts = F.filter(F.transform(F.split(text, PARAGRAPH), _bare), lambda p: p != "")
    pick = lambda p: F.nullif(F.regexp_extract(p, r"^(\d{1,3})\s*[.)]\s", 1), F.lit("")).cast("int")
    rows = F.transform(parts, lambda p: F.struct(F.coalesce(pick(p), F.lit(0)).alias("number"), p.alias("text")))
    numbered = F.exists(rows, lambda r: r["number"] > 0)
    return F.when(numbered, F.filter(rows, lambda r: (r["number"] > 0) | (F.length(r["text"]) > preamble))).otherwise(rows)


def sections(text: Column) -> Column:
    """A map from section to text: by headings on lines of their own, else by the older layout's marks.

    Parts under the same section are joined, empty ones left out; what stands
    before the first heading is the caption.
    """
    any_ = "|".join(h.replace("/", "[/]") for h in SECTION_HEADINGS)
    head = rf"^[ \t]*({any_})[ \t]*(?:\r?\n|\z)"
    keys_of = F.create_map(*[F.lit(x) for pair in SECTION_HEADINGS.items() for x in pair])
    parts = F.split(text, rf"(?m)(?=^[ \t]*(?:{any_})[ \t]*\r?$)")
    rows = F.transform(parts, lambda p: F.struct(F.coalesce(F.element_at(keys_of, F.nullif(F.regexp_extract(p, head, 1), F.lit(""))), F.lit("caption")).alias("h"), _bare(F.regexp_replace(p, head, "")).alias("t")))
    rows = F.filter(rows, lambda r: r["t"] != "")
    keys = F.array_distinct(F.transform(rows, lambda r: r["h"]))
    joined = F.transform(keys, lambda k: F.array_join(F.transform(F.filter(rows, lambda r: r["h"] == k), lambda r: r["t"]), "\n"))
    return F.when(text.rlike(rf"(?m)^[ \t]*(?:{any_})[ \t]*\r?$"), F.map_from_arrays(keys, joined)).otherwise(old_layout(text))


def old_layout(text: Column) -> Column:
    """Sections of the older print layout, by place.

    The caption ends with the bench line. The headnote runs from there to the
    first block of the reporter, if it is long enough; its holding is a section
    too. The case law reference ends where a later block begins, the
    jurisdiction line's block with the judgment, and the judgment with the text.
    A text with neither headnote nor judgment is kept whole as the body.
    """
    bench = F.regexp_extract(text, rf"(?s)^(.*?{BENCH})", 1)
    # a mark that is no blank keeps the rest of the bench's line from looking like a line of its own
    rest = F.concat(F.when(bench == "", "").otherwise("\u0001"), F.substring(text, F.length(bench) + 1, F.length(text)))
    span = F.struct(rest.alias("t"), F.length(rest).alias("n"), *[F.regexp_instr(rest, F.lit(rx)).alias(k) for k, rx in OLD_BLOCKS.items()],
                    F.length(F.regexp_extract(rest, OLD_BLOCKS["case_law_cited"], 0)).alias("mark"))

    def found(x: Column) -> Column:
        at = {k: F.nullif(x[k], F.lit(0)) for k in OLD_BLOCKS}
        cut = lambda a, b: _bare(F.replace(F.substring(x["t"], a, b - a), F.lit("\u0001")))
        end = x["n"] + 1
        law = at["case_law_cited"] + x["mark"]
        later = lambda k, a: F.when(at[k] > a, at[k])
        head = cut(F.lit(1), F.coalesce(F.array_min(F.array(*at.values())), end))
        head = F.when(F.length(head) >= SECTION_MINIMUM, head)
        return F.array(
            F.struct(F.lit("caption").alias("k"), F.nullif(_bare(bench), F.lit("")).alias("v")), F.struct(F.lit("headnote").alias("k"), head.alias("v")),
            F.struct(F.lit("held").alias("k"), F.nullif(F.regexp_extract(head, r"(?s)(\bHELD\s*:.*)", 1), F.lit("")).alias("v")),
            F.struct(F.lit("case_law_cited").alias("k"), F.nullif(cut(law, F.coalesce(F.least(later("case_arising_from", law), later("judgment", law)), end)), F.lit("")).alias("v")),
            F.struct(F.lit("case_arising_from").alias("k"), cut(at["case_arising_from"], F.coalesce(later("judgment", at["case_arising_from"]), end)).alias("v")),
            F.struct(F.lit("judgment").alias("k"), cut(at["judgment"], end).alias("v")))

    rows = F.filter(F.get(F.transform(F.array(span), found), F.lit(0)), lambda r: r["v"].isNotNull())
    whole = F.array(F.struct(F.lit("body").alias("k"), _bare(text).alias("v")))
    rows = F.when(F.exists(rows, lambda r: r["k"].isin("headnote", "judgment")), rows).otherwise(F.concat(rows, whole))
    return F.map_from_entries(rows)


def research_value(n_cases: Column, n_statutes: Column, n_sections: Column, n_paragraphs: Column) -> Column:
    return 2 * n_cases + n_statutes + 3 * n_sections + 0.25 * F.least(n_paragraphs, F.lit(40))


SHORTEST = 500


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, sections, paragraphs, citations and failure: one row for each document.

    A text of fewer than SHORTEST characters (or none) is no judgment: its row says so in
    `failure` and has no parts.
    """
    short = F.coalesce(F.length("text"), F.lit(0)) < SHORTEST
    part = lambda x: F.when(~short, x)
    return docs.select("doc_id", part(sections(F.col("text"))).alias("sections"), part(paragraphs(F.col("text"))).alias("paragraphs"), part(citations(F.col("text"))).alias("citations"),
                       F.when(short, F.concat(F.lit("text of "), F.coalesce(F.length("text"), F.lit(0)).cast("string"), F.lit(" characters"))).alias("failure"))


def chunks(judgments: DataFrame, docs: DataFrame, budget: int = 2000, window: int = 2000, overlap: int = 200) -> DataFrame:
    """legal_chunks() of the judgments; a document whose text gives none is cut into fixed windows (section `body`)."""
    own = legal_chunks(judgments, budget)
    rest = docs.join(own.select("doc_id").distinct(), "doc_id", "left_anti").where(F.length(_bare(F.col("text"))) > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - overlap), F.lit(window - overlap))
    cut = rest.select("doc_id", F.explode(starts).alias("at"), "text").select("doc_id", F.lit("body").alias("section"), F.lit(None).cast("int").alias("first_number"), F.expr(f"substring(text, at, {window})").alias("text"))
    return own.unionByName(cut.select("doc_id", "section", "first_number", "text"))


def legal_chunks(judgments: DataFrame, budget: int = 2000) -> DataFrame:
    """doc_id, section, first_part, text: headnote-family sections whole, then paragraphs packed to the budget; never across sections.

    judgments: doc_id, sections map, paragraphs array of (number, text).
    """
    from plumbline.operators.chunking import packed

    whole = judgments.select("doc_id", F.explode("sections").alias("section", "text")).where(~F.lower("section").isin(*NOT_RETRIEVABLE) & (F.length("text") >= SECTION_MINIMUM))
    body = judgments.select("doc_id", F.posexplode("paragraphs").alias("o", "p")).select("doc_id", "o", "p.*")
    groups = packed(body, ["doc_id"], "o", "text", budget)
    first = groups.join(body.select("doc_id", F.col("o").cast("long").alias("first_part"), "number"), ["doc_id", "first_part"]).select("doc_id", F.lit("judgment").alias("section"), F.col("number").alias("first_number"), "text")
    return whole.select("doc_id", "section", F.lit(None).cast("int").alias("first_number"), "text").unionByName(first)
