"""Citation and link graphs: nodes (id, ...), edges (src, dst, relation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.records import numbered
from plumbline.session import discard, written


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges by relation, and how many end in a node that is held or dangle."""
    held = nodes.select(F.col("id").alias("dst")).distinct().withColumn("_held", F.lit(True))
    rows = edges.join(held, "dst", "left")
    return rows.groupBy("relation").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("_held")).alias("n_held"), F.count_if(F.col("_held").isNull()).alias("n_dangling"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) by one sum over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def reverse(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges into the targets (column dst)."""
    return edges.join(targets.select("dst").distinct(), "dst", "left_semi")


#: Seeds that share a long, a bit each.
_BITS = 64


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 2, relations: list[str] | None = None) -> DataFrame:
    """(seed, id, hop): nodes within `hops` edges of each seed, at their least distance; the seed itself at 0.

    All seeds are searched at once: a node's row has a mask with a bit for each
    of 64 seeds that reached it, so a hop joins the newly reached rows with
    their edges and takes the union of masks by node. It shuffles a row for an
    edge and a word of seeds at most, before the map-side union. Each hop is
    written, and the search ends when a hop reaches nothing new. Seeds that
    repeat count once, null ones not at all.
    """
    used = edges if relations is None else edges.where(F.col("relation").isin(relations))
    used = used.select("src", "dst")
    named = numbered(seeds.where("seed is not null").select("seed").distinct(), ["seed"], "_n").select("seed", F.floor(F.col("_n") / _BITS).alias("word"), (F.col("_n") % _BITS).cast("int").alias("bit"))
    named = written(named, "seeds")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    front = written(named.groupBy(F.col("seed").alias("id"), "word").agg(F.bit_or(mask).alias("mask")), "reached")
    levels, seen = [front], front
    for _ in range(hops):
        met = front.join(used, front["id"] == used["src"]).groupBy(F.col("dst").alias("id"), "word").agg(F.bit_or("mask").alias("mask"))
        new = F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("_old", F.lit(0).cast("long"))))
        fresh = met.where("id is not null").join(seen.withColumnRenamed("mask", "_old"), ["id", "word"], "left").select("id", "word", new.alias("mask")).where("mask <> 0")
        front = written(fresh, "reached")
        if front.isEmpty():
            break
        levels.append(front)
        if len(levels) <= hops:
            newer = written(seen.unionByName(front).groupBy("id", "word").agg(F.bit_or("mask").alias("mask")), "seen")
            if seen is not levels[0]:
                discard(seen)
            seen = newer
    rows = None
    for hop, level in enumerate(levels):
        one = level.withColumn("hop", F.lit(hop))
        rows = one if rows is None else rows.unionByName(one)
    bits = F.filter(F.sequence(F.lit(0), F.lit(_BITS - 1)), lambda b: F.call_function("shiftright", F.col("mask"), b).bitwiseAND(F.lit(1).cast("long")) != 0)
    return rows.select("id", "hop", "word", F.explode(bits).alias("bit")).join(named, ["word", "bit"]).select("seed", "id", "hop")


def expand(edges: DataFrame, seeds: DataFrame, chunks: DataFrame, hops: int = 2, limit: int = 3, relations: list[str] | None = None) -> DataFrame:
    """Chunks (id, chunk_id) of the nodes reached from each seed, nearest first, the seed's own left out."""
    near = reach(edges, seeds, hops, relations).where("hop > 0").join(chunks, "id")
    w = Window.partitionBy("seed").orderBy("hop", "id", "chunk_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _least(df: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """(key, least): the n least different values of each key in order; each task cuts its own before the shuffle."""
    order = Window.partitionBy(key).orderBy(value)
    few = df.select(key, value).distinct().withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return few.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("least"))


def _onward(edges: DataFrame, ends: DataFrame, start: str, middle: str, name: str) -> DataFrame:
    """edges with the least of their middle's ends that isn't their start: of the two least, one is another node. ends: middle, least."""
    return edges.join(ends, middle).withColumn(name, F.get(F.filter("least", lambda x: x != F.col(start)), F.lit(0))).where(F.col(name).isNotNull()).drop("least")


def chains(edges: DataFrame) -> DataFrame:
    """(a, b, c) with edges a-b and b-c of three different nodes, the first for each a.

    A node's two least ends stand for all of them, so that a hub costs as many rows as it has edges.
    """
    e = edges.where("src <> dst").distinct()
    ends = _least(e.select(F.col("src").alias("b"), F.col("dst").alias("c")), "b", "c", 2)
    paths = _onward(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), ends, "a", "b", "c")
    return paths.groupBy("a").agg(F.min(F.struct("b", "c")).alias("p")).select("a", "p.b", "p.c")


def temporal(edges: DataFrame, years: DataFrame) -> DataFrame:
    """Edges whose source is of a later year than their target."""
    y = years.select("id", "year")
    return edges.join(y.select(F.col("id").alias("src"), F.col("year").alias("src_year")), "src").join(y.select(F.col("id").alias("dst"), F.col("year").alias("dst_year")), "dst").where("src_year > dst_year")


def relabelled(edges: DataFrame, treatments: DataFrame) -> DataFrame:
    """The first CITES edge of each (src, dst) takes the treatment's relation; the others stay."""
    w = Window.partitionBy("src", "dst", "relation").orderBy("ordinal")
    rows = edges.withColumn("_n", F.row_number().over(w)).join(treatments.select("src", "dst", F.col("relation").alias("_t")), ["src", "dst"], "left")
    new = F.when((F.col("relation") == "CITES") & (F.col("_n") == 1), F.coalesce("_t", "relation")).otherwise(F.col("relation"))
    return rows.withColumn("relation", new).drop("_n", "_t")


def provenance(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each edge with the first chunk of its document (doc_id, ordinal, chunk_id, text)."""
    first = chunks.groupBy("doc_id").agg(F.min_by(F.struct("chunk_id", F.substring("text", 1, 400).alias("source_text")), "ordinal").alias("p"))
    return edges.join(first, "doc_id", "left").select(*edges.columns, "p.*")


def verdicts(cited: DataFrame, evidence: DataFrame, corpus: DataFrame) -> DataFrame:
    """Status of each citation (answer_id, key): grounded in its evidence, in the corpus only, or unverifiable."""
    e = evidence.select("answer_id", "key").distinct().withColumn("_e", F.lit(True))
    c = corpus.select("key").distinct().withColumn("_c", F.lit(True))
    rows = cited.join(e, ["answer_id", "key"], "left").join(c, "key", "left")
    return rows.select("answer_id", "key", F.when(F.col("_e"), "GROUNDED").when(F.col("_c"), "IN_CORPUS_NOT_RETRIEVED").otherwise("UNVERIFIABLE").alias("status"))


def citation_rates(judged: DataFrame) -> DataFrame:
    """Counts and rates of each answer's citations."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    n = F.count(F.lit(1))
    return judged.groupBy("answer_id").agg(
        n.alias("n_citations"), is_("GROUNDED").alias("grounded"), is_("IN_CORPUS_NOT_RETRIEVED").alias("in_corpus"), is_("UNVERIFIABLE").alias("unverifiable"),
        F.round(is_("GROUNDED") / n, 4).alias("citation_precision"), F.round((is_("GROUNDED") + is_("IN_CORPUS_NOT_RETRIEVED")) / n, 4).alias("citation_correctness"), F.round(is_("UNVERIFIABLE") / n, 4).alias("fabrication_rate"))


def view(nodes: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """At most about `cap` nodes for display: those with edges first, the rest by an even stride over their order."""
    d = degrees(edges)
    rows = nodes.join(d, "id", "left").withColumn("degree", F.coalesce(F.col("out_degree") + F.col("in_degree"), F.lit(0)))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("degree") > 0).alias("linked"))
    step = F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("linked")) / F.greatest(F.lit(1), F.lit(cap) - F.col("linked"))))
    rest = numbered(rows.where("degree = 0"), ["id"], "_n").crossJoin(F.broadcast(total)).where((F.col("_n") + 1) % step == 0)  # one row
    kept = rows.where("degree > 0").crossJoin(F.broadcast(total)).unionByName(rest.drop("_n"))  # one row
    return kept.select(*nodes.columns, "degree", (F.col("n") > cap).alias("truncated"))


def saved(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph as two tables under `path`."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def loaded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as saved; edges whose ends aren't nodes raise when they are read."""
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    if not ends.isEmpty():
        raise ValueError("edges end in nodes that aren't there")
    return nodes, edges


#: The ten types of questions that a case graph gives, with their hops (fixed values).
QUESTION_TYPES = {
    "exact_citation": 1, "lexical_mismatch": 1, "single_hop": 1, "case_to_case": 2, "case_to_statute": 1, "statute_to_cases": 2,
    "citation_chain": 3, "contradictory": 2, "temporal": 2, "entity_resolution": 1,
}


def benchmark(cases: DataFrame, sections: DataFrame, edges: DataFrame, per_type: int = 6, seed: str = "0") -> DataFrame:
    """(type, hops, subject, gold): up to `per_type` questions of each of ten types, in the order of a hash.

    cases: id, citation, neutral_citation, year. sections: id, section, text.
    edges: src, dst, relation between cases and statutes. `subject` is what a
    question asks about (a case, or a statute), `gold` the cases that answer it.
    Only cases with sections can be gold.
    """
    held = cases.join(sections.select("id").distinct(), "id", "left_semi")
    row = lambda kind, df, subject, *gold: df.select(F.lit(kind).alias("type"), subject.alias("subject"), F.array(*gold).alias("gold"))
    c = F.col
    both = edges.where("src <> dst").join(held.select(c("id").alias("src"), c("year").alias("src_year")), "src").join(held.select(c("id").alias("dst"), c("year").alias("dst_year")), "dst")
    citing = both.where(c("relation").isin("CASE_CITES_CASE", "CASE_FOLLOWS_CASE", "CASE_APPROVES_CASE")).select("src", "dst").distinct()
    onward = both.where(c("relation").isin("CASE_CITES_CASE", "CASE_FOLLOWS_CASE")).select(c("src").alias("dst"), c("dst").alias("third"))
    chains = _onward(citing, _least(onward, "dst", "third", 2), "src", "dst", "third")
    statutes = edges.where(c("relation").isin("CASE_INTERPRETS_SECTION", "CASE_CITES_STATUTE")).join(held.select(c("id").alias("src")), "src")
    construed = statutes.where("relation = 'CASE_INTERPRETS_SECTION'").groupBy("src").agg(F.min("dst").alias("dst"))
    shared = _least(statutes, "dst", "src", 4).withColumnRenamed("least", "cases").where(F.size("cases") >= 3)
    adverse = edges.where(c("relation").isin(*ADVERSE)).join(held.select(c("id").alias("src"), F.lit(True).alias("s")), "src", "left").join(held.select(c("id").alias("dst"), F.lit(True).alias("d")), "dst", "left").where("s or d")
    named = lambda s: sections.where(c("section") == s).groupBy("id").agg(F.max(F.length("text")).alias("n")).join(held.select("id"), "id", "left_semi")
    parts = [
        row("exact_citation", held.where("citation is not null"), c("id"), c("id")), row("lexical_mismatch", named("issue").where("n > 80"), c("id"), c("id")),
        row("single_hop", named("headnote"), c("id"), c("id")), row("case_to_case", citing, c("dst"), c("src"), c("dst")), row("case_to_statute", construed, c("dst"), c("src")),
        shared.select(F.lit("statute_to_cases").alias("type"), c("dst").alias("subject"), c("cases").alias("gold")),
        row("citation_chain", chains, c("src"), c("src"), c("dst"), c("third")),
        adverse.select(F.lit("contradictory").alias("type"), c("dst").alias("subject"), F.filter(F.array(F.when(c("s"), c("src")), F.when(c("d"), c("dst"))), lambda x: x.isNotNull()).alias("gold")),
        row("temporal", both.where(c("relation").startswith("CASE_") & (c("src_year") > c("dst_year"))).select("src", "dst").distinct(), c("dst"), c("dst"), c("src")),
        row("entity_resolution", held.where("citation is not null and neutral_citation is not null"), c("id"), c("id")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    order = F.sha2(F.concat_ws(":", F.lit(seed), "type", "subject", F.array_join("gold", ",")), 256)
    w = Window.partitionBy("type").orderBy(order, "subject", "gold")
    hops = F.create_map(*[F.lit(x) for pair in QUESTION_TYPES.items() for x in pair])
    return every.withColumn("_n", F.row_number().over(w)).where(c("_n") <= per_type).select("type", hops[c("type")].alias("hops"), "subject", "gold")


# Words of treatment in order of strength, and sections in which a statute is construed.
TREATMENTS = [
    ("CASE_OVERRULES_CASE", r"\boverrul(?:ed|ing)\b"), ("CASE_OVERRULES_CASE", r"\bnot\s+good\s+law\b"), ("CASE_DISTINGUISHES_CASE", r"\bdistinguish(?:ed|ing)\b"), ("CASE_DOUBTS_CASE", r"\bdoubted\b"),
    ("CASE_DOES_NOT_FOLLOW_CASE", r"\bnot\s+follow(?:ed)?\b"), ("CASE_FOLLOWS_CASE", r"\bfollow(?:ed|ing)\b"), ("CASE_FOLLOWS_CASE", r"\breli(?:ed|ance)\s+(?:on|upon)\b"), ("CASE_APPROVES_CASE", r"\bapproved\b"),
    ("CASE_CITES_CASE", r"\breferred\s+to\b"), ("CASE_CITES_CASE", r"\bcited\b"),
]
INTERPRETIVE = ("headnote", "held", "issue")
ADVERSE = ("CASE_OVERRULES_CASE", "CASE_DISTINGUISHES_CASE", "CASE_DOUBTS_CASE", "CASE_DOES_NOT_FOLLOW_CASE")


def treatments(lines: DataFrame) -> DataFrame:
    """(doc_id, key, relation, text): each citation of a line with the strongest treatment named there; `lines`: doc_id, text."""
    from plumbline.operators.legal import citations

    each = lines.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.trim("line")) >= 8)
    relation = None
    for name, pattern in TREATMENTS:
        hit = F.col("line").rlike(f"(?i){pattern}")
        relation = F.when(hit, name) if relation is None else relation.when(hit, name)
    found = each.select("doc_id", "line", relation.otherwise("CASE_CITES_CASE").alias("relation"), F.explode(citations(F.col("line"))).alias("c"))
    return found.where(~F.col("c.kind").isin("SECTION", "ARTICLE")).select("doc_id", F.col("c.key").alias("key"), "relation", F.trim("line").alias("text"))


def knowledge_graph(cases: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a case collection.

    cases: doc_id, key (own citation or null), court. cited: doc_id, section,
    kind, key, ordinal. A case's node is its own citation, else its document;
    a case's citation of itself is left out; one that no document has is a
    dangling node. Statutes cited in interpretive sections are construed.
    """
    own = cases.select("doc_id", F.concat(F.lit("CASE:"), F.coalesce("key", F.concat(F.lit("DOC:"), F.col("doc_id").cast("string")))).alias("id"), "key", F.coalesce("court", F.lit("Unknown Court")).alias("court"))
    decided = own.select(F.col("id").alias("src"), F.concat(F.lit("COURT:"), F.col("court")).alias("dst"), F.lit("CASE_DECIDED_BY_COURT").alias("relation"), "doc_id", F.lit("caption").alias("section"), F.lit(-1).cast("long").alias("ordinal"))
    rows = cited.join(own.select("doc_id", F.col("id").alias("src"), F.col("key").alias("own_key")), "doc_id")
    is_case = ~F.col("kind").isin("SECTION", "ARTICLE", "ACT")
    target = F.when(is_case, F.concat(F.lit("CASE:"), F.col("key"))).otherwise(F.col("key"))
    relation = F.when(is_case, "CASE_CITES_CASE").when(F.col("section").isin(*INTERPRETIVE), "CASE_INTERPRETS_SECTION").otherwise("CASE_CITES_STATUTE")
    links = rows.where(~is_case | F.col("own_key").isNull() | (F.col("key") != F.col("own_key"))).select("src", target.alias("dst"), relation.alias("relation"), "doc_id", "section", F.col("ordinal").cast("long").alias("ordinal"))
    parents = rows.where(F.col("kind") == "ACT").select(F.col("key").alias("src"), F.concat(F.lit("STATUTE:"), F.get(F.split("key", ":"), F.lit(1))).alias("dst"), F.lit("SECTION_OF_STATUTE").alias("relation"), F.lit(None).cast(dict(cases.dtypes)["doc_id"]).alias("doc_id"), F.lit(None).cast("string").alias("section"), F.col("ordinal").cast("long").alias("ordinal"))
    edges = decided.unionByName(links).unionByName(parents)
    held = own.select("id", "doc_id", F.lit(True).alias("in_corpus"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(held.select("id"), "id", "left_anti")
    nodes = held.unionByName(ends.select("id", F.lit(None).cast(dict(cases.dtypes)["doc_id"]).alias("doc_id"), F.lit(False).alias("in_corpus")))
    return nodes.withColumn("type", F.get(F.split("id", ":"), F.lit(0))), edges


def memory_graph(observations: DataFrame, sessions: DataFrame, limit: int = 150, project: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the latest observations with their sessions, concepts and files.

    observations: id, session_id, project, title, concepts, files_read,
    files_modified (JSON arrays, broken ones read as empty), epoch. sessions:
    session_id, title. `limit` is part of the view.
    """
    rows = observations if project is None else observations.where(F.col("project") == project)
    rows = rows.orderBy(F.desc("epoch"), "id").limit(limit)
    obs = F.concat(F.lit("obs::"), F.col("id").cast("string"))
    items = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))

    def links(column: str, kind: str, prefix: str, label) -> DataFrame:
        each = rows.select(obs.alias("source"), F.explode(items(column)).alias("x"))
        return each.select("source", F.concat(F.lit(prefix), label(F.col("x"))).alias("target"), F.lit(kind).alias("kind"), label(F.col("x")).alias("label"))

    base = lambda x: F.element_at(F.split(x, "/"), -1)
    contains = rows.where("session_id is not null").join(sessions.withColumnRenamed("title", "session_title"), "session_id", "left").select(
        F.concat(F.lit("session::"), F.col("session_id")).alias("source"), obs.alias("target"), F.lit("contains").alias("kind"), F.coalesce("session_title", F.substring("session_id", 1, 8)).alias("label"))
    parts = [links("concepts", "tagged", "concept::", lambda x: x), links("files_read", "read", "file::", base), links("files_modified", "modified", "file::", base)]
    edges = contains
    for p in parts:
        edges = edges.unionByName(p)
    nodes = rows.select(obs.alias("id"), F.lit("observation").alias("type"), F.substring(F.coalesce("title", F.concat(F.lit("#"), F.col("id").cast("string"))), 1, 30).alias("label"))
    nodes = nodes.unionByName(contains.select(F.col("source").alias("id"), F.lit("session").alias("type"), F.substring("label", 1, 28).alias("label")).distinct())
    for p in parts:
        nodes = nodes.unionByName(p.select(F.col("target").alias("id"), F.regexp_extract("target", "^([a-z]+)::", 1).alias("type"), "label").distinct())
    return nodes.dropDuplicates(["id"]), edges.select("source", "target", "kind")
