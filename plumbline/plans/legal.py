"""Queries over planted judgments and case graphs, whose results the SQL derives from row numbers alone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.operators import legal as L
from plumbline.plans import inputs as I
from plumbline.session import shared_folder

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f
    return add


#: Two print layouts; {p} page, {y} year, {v} volume, {n} page and one, {s} and {a} section and article numbers.
_NEW = """[{y}] {v} S.C.R. {n} : {y} INSC {n}
A{p} v. B{p}
Issue for Consideration
Whether item {p} was due.
Headnotes
Code - s. {s}(3) - relief under Article {a} is available.
Case Law Cited
A v. B ({y}) {v} SCC {n} - relied on; AIR {y} SC {n} - referred to; not 1{y} INSC {n}.
Headnotes
Section {s} of the Negotiable Instruments Act, 1881 is not attracted.
List of Keywords
one; two; three
Judgment / Order of the Supreme Court
1.\tThe appellant challenges the order {p} of the High Court.
2.\tThe appeal of [{y}] {v} s.c.r. {n} is allowed.
"""
_OLD = """[{y}] {v} S. C. R. {n}
PARTY {p} v. UNION OF INDIA
[RAO AND IYER, JJ.]
Amendment Act - the scheme {p} is examined at length in this report.
HELD: the amendment {p} is void.
Case Law Reference:
({y}) {v} SCC {n}  relied on  para 12
CIVIL ORIGINAL JURISDICTION: Writ Petition No. {n} of {y}
The Judgment of the Court was delivered by RAO, J.
1.\tThe petitions challenge {p}.
"""


def _numbers():
    p = F.col("page_id")
    return {"p": p, "y": 1950 + p % 70, "v": p % 12 + 1, "n": p + 1, "s": p % 300 + 1, "a": p % 395 + 1}


def _filled(template: str):
    out = F.lit(template)
    for name, value in _numbers().items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def judgments(s, d):
    """page_id, text: every third page in the old layout."""
    return I.table(s, d, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, _filled(_OLD)).otherwise(_filled(_NEW)).alias("text"))


_N = "nb AS (SELECT page_id, page_id::VARCHAR AS p, (1950 + page_id % 70)::VARCHAR AS y, (page_id % 12 + 1)::VARCHAR AS v, (page_id + 1)::VARCHAR AS n, (page_id % 300 + 1)::VARCHAR AS s, (page_id % 395 + 1)::VARCHAR AS a, page_id % 3 = 0 AS old FROM pages)"


@query("legal_citations", f"""WITH {_N}, c AS (SELECT page_id, CASE WHEN old THEN ['SCR:' || y || ':' || v || ':' || n, 'SCC:' || y || ':' || v || ':' || n] ELSE ['SCR:' || y || ':' || v || ':' || n, 'INSC:' || y || ':' || n, 'SCC:' || y || ':' || v || ':' || n, 'AIR:' || y || ':' || n,
  'SECTION:' || s, 'ACT:NEGOTIABLE INSTRUMENTS ACT, 1881:S' || s, 'ARTICLE:' || a] END AS ks FROM nb) SELECT page_id, i - 1 AS place, ks[i] AS key, string_split(ks[i], ':')[1] AS kind FROM c, unnest(range(1, 8)) t(i) WHERE i <= len(ks)""")
def legal_citations(s, d):
    """Keys of cases, sections, acts and articles, each once, in the order of the patterns."""
    rows = judgments(s, d).select("page_id", F.posexplode(L.citations(F.col("text"))).alias("place", "c"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), "c.key", "c.kind")


_SECTIONS = f"""WITH {_N}, x AS (SELECT page_id, unnest(CASE WHEN old THEN [
  {{'section': 'caption', 'text': '[' || y || '] ' || v || ' S. C. R. ' || n || chr(10) || 'PARTY ' || p || ' v. UNION OF INDIA' || chr(10) || '[RAO AND IYER, JJ.]'}},
  {{'section': 'headnote', 'text': 'Amendment Act - the scheme ' || p || ' is examined at length in this report.' || chr(10) || 'HELD: the amendment ' || p || ' is void.'}}, {{'section': 'held', 'text': 'HELD: the amendment ' || p || ' is void.'}},
  {{'section': 'case_law_cited', 'text': '(' || y || ') ' || v || ' SCC ' || n || '  relied on  para 12'}}, {{'section': 'case_arising_from', 'text': 'CIVIL ORIGINAL JURISDICTION: Writ Petition No. ' || n || ' of ' || y}},
  {{'section': 'judgment', 'text': 'The Judgment of the Court was delivered by RAO, J.' || chr(10) || '1.' || chr(9) || 'The petitions challenge ' || p || '.'}}]
ELSE [{{'section': 'caption', 'text': '[' || y || '] ' || v || ' S.C.R. ' || n || ' : ' || y || ' INSC ' || n || chr(10) || 'A' || p || ' v. B' || p}}, {{'section': 'issue', 'text': 'Whether item ' || p || ' was due.'}},
  {{'section': 'headnote', 'text': 'Code - s. ' || s || '(3) - relief under Article ' || a || ' is available.' || chr(10) || 'Section ' || s || ' of the Negotiable Instruments Act, 1881 is not attracted.'}},
  {{'section': 'case_law_cited', 'text': 'A v. B (' || y || ') ' || v || ' SCC ' || n || ' - relied on; AIR ' || y || ' SC ' || n || ' - referred to; not 1' || y || ' INSC ' || n || '.'}}, {{'section': 'keywords', 'text': 'one; two; three'}},
  {{'section': 'judgment', 'text': '1.' || chr(9) || 'The appellant challenges the order ' || p || ' of the High Court.' || chr(10) || '2.' || chr(9) || 'The appeal of [' || y || '] ' || v || ' s.c.r. ' || n || ' is allowed.'}}] END, recursive := true) FROM nb)"""


def _sections(s, d):
    return judgments(s, d).select("page_id", F.explode(L.sections(F.col("text"))).alias("section", "text"))


@query("legal_sections", f"{_SECTIONS} SELECT page_id, section, text FROM x")
def legal_sections(s, d):
    return _sections(s, d)


@query("legal_paragraphs", f"""{_SECTIONS} SELECT page_id, 1 AS number, CASE WHEN page_id % 3 = 0 THEN '1.' || chr(9) || 'The petitions challenge ' || page_id || '.' ELSE string_split(text, chr(10))[1] END AS text FROM x WHERE section = 'judgment'
UNION ALL SELECT page_id, 2, string_split(text, chr(10))[2] FROM x WHERE section = 'judgment' AND page_id % 3 <> 0""")
def legal_paragraphs(s, d):
    """Numbered paragraphs of the judgment section; the short line before the first of an old one is dropped."""
    rows = _sections(s, d).where("section = 'judgment'").select("page_id", F.explode(L.paragraphs(F.col("text"))).alias("p"))
    return rows.select("page_id", "p.number", "p.text")


@query("legal_chunks", f"""{_SECTIONS}, b AS (SELECT page_id, section, NULL::INTEGER AS first_number, length(text)::BIGINT AS n_chars FROM x WHERE section NOT IN ('keywords', 'judgment', 'appearances') AND length(text) >= 40)
SELECT * FROM b UNION ALL SELECT page_id, 'judgment', 1, CASE WHEN page_id % 3 = 0 THEN length(string_split(text, chr(10))[2]) ELSE length(text) + 1 END::BIGINT FROM x WHERE section = 'judgment'""")
def legal_chunks(s, d):
    """Sections of 40 characters whole, and the paragraphs packed (two blank lines between them)."""
    j = judgments(s, d).select(F.col("page_id").alias("doc_id"), L.sections(F.col("text")).alias("sections"))
    j = j.withColumn("paragraphs", L.paragraphs(F.col("sections")["judgment"]))
    return L.legal_chunks(j).select(F.col("doc_id").alias("page_id"), "section", "first_number", F.length("text").cast("long").alias("n_chars"))


@query("legal_value", f"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 2 * 2 + 0 + 3 * 6 + 0.25 * 1 ELSE 2 * 4 + 3 + 3 * 6 + 0.25 * 2 END::DOUBLE AS value FROM pages")
def legal_value(s, d):
    """The research value of a judgment from its cases, statutes, sections and paragraphs."""
    x = judgments(s, d).select("page_id", L.citations(F.col("text")).alias("c"), L.sections(F.col("text")).alias("s"))
    kinds = F.transform("c", lambda c: c["kind"])
    statutes = F.size(F.filter(kinds, lambda k: k.isin("SECTION", "ACT", "ARTICLE")))
    return x.select("page_id", L.research_value(F.size("c") - statutes, statutes, F.size("s"), F.size(L.paragraphs(F.col("s")["judgment"]))).cast("double").alias("value"))


_WORDS = ["overruled", "is not good law", "distinguished", "doubted", "not followed", "followed", "relied upon", "approved", "referred to", "mentioned"]


@query("graph_treatments", f"""WITH {_N} SELECT page_id AS doc_id, 'SCC:' || y || ':' || v || ':' || n AS key, ['CASE_OVERRULES_CASE', 'CASE_OVERRULES_CASE', 'CASE_DISTINGUISHES_CASE', 'CASE_DOUBTS_CASE', 'CASE_DOES_NOT_FOLLOW_CASE', 'CASE_FOLLOWS_CASE', 'CASE_FOLLOWS_CASE', 'CASE_APPROVES_CASE', 'CASE_CITES_CASE', 'CASE_CITES_CASE'][page_id % 10 + 1] AS relation FROM nb""")
def graph_treatments(s, d):
    """One line of a case law table for each page, with short and empty lines about it."""
    n = _numbers()
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), (F.col("page_id") % 10).cast("int"))
    line = F.format_string("short\n\n(%d) %d SCC %d  %s  para 9\nno citation stands here", n["y"], n["v"], n["n"], word)
    return G.treatments(I.table(s, d, "pages").select(F.col("page_id").alias("doc_id"), line.alias("text"))).select("doc_id", "key", "relation")


_CASES = """li AS (SELECT l_suppkey AS doc_id, l_orderkey AS o, l_linenumber AS l, l_partkey % 10 AS w, l_orderkey % 4 = 0 AS air, 1950 + l_orderkey % 70 AS y, l_linenumber + 1 AS v, l_orderkey AS n FROM lineitem),
ke AS (SELECT *, CASE WHEN air THEN 'AIR:' || y || ':' || n ELSE 'SCC:' || y || ':' || v || ':' || n END AS key FROM li)"""


def case_tables(s, d):
    """doc_id, text: a table of cases for each supplier, a line for each of its items: reporters and words of treatment vary from line to line, and keys repeat."""
    o, y = F.col("l_orderkey"), 1950 + F.col("l_orderkey") % 70
    case = F.when(o % 4 == 0, F.format_string("AIR %d SC %d", y, o)).otherwise(F.format_string("(%d) %d SCC %d", y, F.col("l_linenumber") + 1, o))
    word = F.get(F.array(*[F.lit(w) for w in _WORDS]), (F.col("l_partkey") % 10).cast("int"))
    rows = I.table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.struct(o, "l_linenumber", F.concat_ws("  ", case, word).alias("line")).alias("x"))
    # a supplier has about 600 items at every scale
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))


@query("case_table_citations", f"""WITH {_CASES}, f AS (SELECT doc_id, key, air, min((o, l)) AS first FROM ke GROUP BY 1, 2, 3)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY air, first) - 1 AS place, key FROM f""")
def case_table_citations(s, d):
    """Texts with hundreds of citations: each key once, by pattern and first place."""
    rows = case_tables(s, d).select("doc_id", F.posexplode(L.citations(F.col("text"))).alias("place", "c"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), "c.key")


@query("case_table_treatments", f"""WITH {_CASES} SELECT doc_id, key, ['CASE_OVERRULES_CASE', 'CASE_OVERRULES_CASE', 'CASE_DISTINGUISHES_CASE', 'CASE_DOUBTS_CASE', 'CASE_DOES_NOT_FOLLOW_CASE', 'CASE_FOLLOWS_CASE', 'CASE_FOLLOWS_CASE', 'CASE_APPROVES_CASE', 'CASE_CITES_CASE', 'CASE_CITES_CASE'][w + 1] AS relation, count(*) AS n FROM ke GROUP BY 1, 2, 3""")
def case_table_treatments(s, d):
    return G.treatments(case_tables(s, d)).groupBy("doc_id", "key", "relation").agg(F.count(F.lit(1)).alias("n"))


_CITES = "ct AS (SELECT page_id AS src, (page_id * 7 + k) % (SELECT count(*) FROM pages) AS dst, CASE WHEN k = 2 THEN 'SAME_COURT' ELSE 'CITES' END AS relation, page_id * 3 + k AS ordinal FROM pages, (SELECT unnest([0, 1, 1, 2]) AS k, unnest([0, 1, 2, 3]) AS j))"


def _cites(s, d):
    p = I.table(s, d, "pages")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    each = p.select("page_id", F.explode(F.array(*map(F.lit, (0, 1, 1, 2)))).alias("k")).crossJoin(F.broadcast(n))  # one row
    return each.select(F.col("page_id").alias("src"), ((F.col("page_id") * 7 + F.col("k")) % F.col("n")).alias("dst"), F.when(F.col("k") == 2, "SAME_COURT").otherwise("CITES").alias("relation"), (F.col("page_id") * 3 + F.col("k")).alias("ordinal"))


@query("graph_relabelled", f"""WITH {_CITES}, r AS (SELECT *, row_number() OVER (PARTITION BY src, dst, relation ORDER BY ordinal) AS i FROM ct)
SELECT src, dst, CASE WHEN relation = 'CITES' AND i = 1 AND src % 2 = 0 THEN 'DOUBTS' ELSE relation END AS relation, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def graph_relabelled(s, d):
    """The first of a pair's citing edges takes the treatment that even pages give."""
    e = _cites(s, d)
    t = e.where("src % 2 = 0").select("src", "dst", F.lit("DOUBTS").alias("relation")).distinct()
    return G.relabelled(e, t).groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("n"))


@query("graph_provenance", "WITH c AS (SELECT conv_id AS doc_id, arg_min(turn, turn) AS chunk_id, substr(arg_min(text, turn), 1, 400) AS source_text FROM conversations GROUP BY 1), e AS (SELECT DISTINCT conv_id AS src, conv_id + 1 AS dst, conv_id + conv_id % 2 AS doc_id FROM conversations) SELECT src, dst, e.doc_id, chunk_id, source_text FROM e LEFT JOIN c USING (doc_id)")
def graph_provenance(s, d):
    c = I.table(s, d, "conversations")
    e = c.select(F.col("conv_id").alias("src"), (F.col("conv_id") + 1).alias("dst"), (F.col("conv_id") + F.col("conv_id") % 2).alias("doc_id")).distinct()
    return G.provenance(e, c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), F.col("turn").alias("chunk_id"), "text"))


@query("graph_saved", f"WITH {_CITES} SELECT src, dst, relation, count(*) AS n FROM ct GROUP BY 1, 2, 3")
def graph_saved(s, d):
    """A graph written and read back."""
    path = f"{shared_folder(s)}/graph-{uuid.uuid4().hex[:10]}"
    e = _cites(s, d)
    G.saved(e.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), e, path)
    return G.loaded(s, path)[1].groupBy("src", "dst", "relation").agg(F.count(F.lit(1)).alias("n"))


_BENCH = f"""{_N}, ca AS (SELECT page_id AS id, CASE WHEN page_id % 4 <> 0 THEN y END AS citation, CASE WHEN page_id % 5 = 0 THEN n END AS neutral, (1950 + page_id % 70) AS year, page_id % 9 <> 0 AS held FROM nb),
e AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, relation FROM (SELECT page_id AS src, (page_id * 7 + 1) % (SELECT count(*) FROM pages) AS dst, ['CASE_CITES_CASE', 'CASE_FOLLOWS_CASE', 'CASE_APPROVES_CASE', 'CASE_OVERRULES_CASE', 'CASE_DOUBTS_CASE', 'CASE_CITES_CASE', 'CASE_CITES_CASE'][page_id % 7 + 1] AS relation FROM pages)),
st AS (SELECT id::VARCHAR AS src, 'S:' || (id % 11) AS dst, id % 2 = 0 AS construed FROM ca WHERE held), h AS (SELECT id::VARCHAR AS id, citation, neutral, year FROM ca WHERE held),
b AS (SELECT e.*, x.year AS y1, z.year AS y2 FROM e JOIN h x ON x.id = e.src JOIN h z ON z.id = e.dst WHERE e.src <> e.dst),
ci AS (SELECT DISTINCT src, dst FROM b WHERE relation IN ('CASE_CITES_CASE', 'CASE_FOLLOWS_CASE', 'CASE_APPROVES_CASE')), onw AS (SELECT DISTINCT src, dst FROM b WHERE relation IN ('CASE_CITES_CASE', 'CASE_FOLLOWS_CASE')),
q AS (SELECT 'exact_citation' AS type, 1 AS hops, id AS subject, [id] AS gold FROM h WHERE citation IS NOT NULL UNION ALL SELECT 'lexical_mismatch', 1, id, [id] FROM h WHERE id::BIGINT % 3 = 0 UNION ALL SELECT 'single_hop', 1, id, [id] FROM h WHERE id::BIGINT % 3 <> 0
  UNION ALL SELECT 'case_to_case', 2, dst, [src, dst] FROM ci UNION ALL SELECT 'case_to_statute', 1, min(dst), [src] FROM st WHERE construed GROUP BY src UNION ALL SELECT 'statute_to_cases', 2, dst, (list(DISTINCT src ORDER BY src))[1:4] FROM st GROUP BY dst HAVING count(DISTINCT src) >= 3
  UNION ALL SELECT 'citation_chain', 3, ci.src, [ci.src, ci.dst, min(onw.dst)] FROM ci JOIN onw ON onw.src = ci.dst AND onw.dst <> ci.src GROUP BY ci.src, ci.dst
  UNION ALL SELECT 'contradictory', 2, e.dst, list_filter([x.id, z.id], lambda v: v IS NOT NULL) FROM e LEFT JOIN h x ON x.id = e.src LEFT JOIN h z ON z.id = e.dst WHERE e.relation IN ('CASE_OVERRULES_CASE', 'CASE_DISTINGUISHES_CASE', 'CASE_DOUBTS_CASE', 'CASE_DOES_NOT_FOLLOW_CASE') AND (x.id IS NOT NULL OR z.id IS NOT NULL)
  UNION ALL SELECT DISTINCT 'temporal', 2, dst, [dst, src] FROM b WHERE y1 > y2 UNION ALL SELECT 'entity_resolution', 1, id, [id] FROM h WHERE citation IS NOT NULL AND neutral IS NOT NULL)"""


@query("benchmark_types", f"WITH {_BENCH} SELECT type, hops, subject, array_to_string(gold, ',') AS gold FROM q QUALIFY row_number() OVER (PARTITION BY type ORDER BY sha256('7:' || type || ':' || subject || ':' || array_to_string(gold, ',')), subject, gold) <= 6")
def benchmark_types(s, d):
    """Up to six questions of each of the ten types, in hash order, from a graph of pages as cases."""
    p = I.table(s, d, "pages").select("page_id")
    n = p.agg(F.count(F.lit(1)).alias("n"))
    i, t = F.col("page_id"), lambda x: x.cast("string")
    relations = F.array(*[F.lit(f"CASE_{x}_CASE") for x in ("CITES", "FOLLOWS", "APPROVES", "OVERRULES", "DOUBTS", "CITES", "CITES")])
    cases = p.select(t(i).alias("id"), F.when(i % 4 != 0, t(1950 + i % 70)).alias("citation"), F.when(i % 5 == 0, t(i + 1)).alias("neutral_citation"), (1950 + i % 70).alias("year"))
    held = p.where("page_id % 9 <> 0")
    sections = held.select(t(i).alias("id"), F.when(i % 3 == 0, "issue").otherwise("headnote").alias("section"), F.repeat(F.lit("x"), 90).alias("text"))
    edges = p.crossJoin(F.broadcast(n)).select(t(i).alias("src"), t((i * 7 + 1) % F.col("n")).alias("dst"), F.get(relations, (i % 7).cast("int")).alias("relation"))  # one row
    statutes = held.select(t(i).alias("src"), F.concat(F.lit("S:"), t(i % 11)).alias("dst"), F.when(i % 2 == 0, "CASE_INTERPRETS_SECTION").otherwise("CASE_CITES_STATUTE").alias("relation"))
    return G.benchmark(cases, sections, edges.unionByName(statutes), seed="7").withColumn("gold", F.array_join("gold", ","))
