"""Chunking and corpus quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 512, 100
LEGAL_BUDGET, LEGAL_MINIMUM = 2000, 40
# Patterns and terms of the chunk classes.
TOC_LINE = r"^\s*\d+[A-Z]?\.\s*[A-Z][^.]{2,70}\.?\s*$"
HEADING_LINE = r"^\s*(?:CHAPTER\s+[IVXLC\d]+|PART\s+[IVXLC\d]+|SCHEDULE|ARRANGEMENT OF SECTIONS|OF\s+[A-Z][A-Z\s,]+|[A-Z][A-Z\s,'-]{6,})\s*$"
FURNITURE = r"(?i)the gazette of india|extraordinary|registered no\.|printed by the manager|government of india press|published by the controller"
BOILERPLATE = ["be it enacted by parliament", "ministry of law and justice", "legislative department", "received the assent of the president", "the following act of parliament"]
OPERATIVE = ["shall", "means", "whoever", "may", "is said to", "punished", "liable", "provided that", "shall be", "is guilty", "extend to", "deemed"]
STRATEGIES = ("sentence", "semantic", "hierarchical", "legal")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"\s+"), "")


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Overlapping windows of words: keep, chunk_index, start, text. A document without words has no chunk."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    rows = docs.select(*keep, words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - overlap - 1), F.lit(size - overlap))
    cut = rows.select(*keep, "_w", F.posexplode(starts).alias("chunk_index", "start"))
    return cut.select(*keep, "chunk_index", "start", F.size(F.slice("_w", F.col("start") + 1, size)).alias("n_words"), F.array_join(F.slice("_w", F.col("start") + 1, size), " ").alias("text"))


def sentence_windows(docs: DataFrame, size: int = SIZE, overlap: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Whole sentences up to `size` words: keep, chunk_index, first_part, n_parts, text; a longer sentence stands alone.

    A chunk begins with the last sentences of the one before that have `overlap`
    words at most and leave room for the next sentence.
    """
    from plumbline.functions.text import simple_sentences

    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    lists = docs.select(*keep, F.transform(simple_sentences(F.col("text")), lambda t, i: F.struct(i.cast("bigint").alias("o"), F.size(words(t)).alias("s"), t.alias("t"))).alias("l"))
    sized = lists.select(*keep, "l", F.transform("l", lambda x: x["s"]).alias("s"))
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("used"), F.array().cast("array<struct<a:int,b:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        s, i = x["s"], x["i"]
        # of the chunk's sentences, from its last backwards: how many fit the overlap, and how many words they have
        tail = F.aggregate(
            F.reverse(F.slice("s", F.greatest(a["first"], i - overlap) + 1, i - F.greatest(a["first"], i - overlap))),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("w"), F.lit(True).alias("open")),
            lambda c, w: F.when(c["open"] & (c["w"] + w <= F.least(F.lit(overlap), size - s)) & (a["first"] + c["n"] + 1 < i), F.struct((c["n"] + 1).alias("n"), (c["w"] + w).alias("w"), F.lit(True).alias("open")))
            .otherwise(F.struct(c["n"].alias("n"), c["w"].alias("w"), F.lit(False).alias("open"))))
        closed = F.get(F.transform(F.array(tail), lambda t: F.struct((i - t["n"]).alias("first"), (t["w"] + s).alias("used"), F.concat(a["out"], F.array(F.struct(a["first"].alias("a"), i.alias("b")))).alias("out"))), F.lit(0))
        return F.when((a["used"] > 0) & (a["used"] + s > size), closed).otherwise(F.struct(a["first"].alias("first"), (a["used"] + s).alias("used"), a["out"].alias("out")))

    each = F.transform("s", lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    spans = F.aggregate(each, start, step, lambda a: F.concat(a["out"], F.array(F.struct(a["first"].alias("a"), F.size("s").alias("b")))))
    rows = sized.where(F.size("s") > 0).select(*keep, "l", spans.alias("spans"))
    return _cut(rows, list(keep), F.transform("spans", lambda x: F.struct(x["a"].alias("a"), (x["b"] - x["a"]).alias("n"))), " ")


def _cut(rows: DataFrame, keys: list[str], spans: Column, joint: str) -> DataFrame:
    """keys, chunk_index, first_part, n_parts, text of spans (a, n) of the list l of parts (o, t)."""
    chunk = lambda x: F.struct(F.get("l", x["a"])["o"].alias("first_part"), x["n"].cast("bigint").alias("n_parts"), F.array_join(F.transform(F.slice("l", x["a"] + 1, x["n"]), lambda p: p["t"]), joint).alias("text"))
    return rows.select(*keys, F.posexplode(F.transform(spans, chunk)).alias("chunk_index", "x")).select(*keys, "chunk_index", "x.*")


def packed(parts: DataFrame, keys: list[str], order: str, text: str, budget: int, size: Column | None = None, joint: str = "\n\n") -> DataFrame:
    """Greedy packing in order: a group ends where the next part would exceed the budget; parts are never split.

    The fold runs inside each key's list of parts (a document's), with
    higher-order functions, and notes where groups begin; parts of one document
    are held together.
    """
    size = F.length(text) if size is None else size
    lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), size.cast("int").alias("s"), F.col(text).alias("t")))).alias("l"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        new = (F.size(a["out"]) == 0) | ((a["used"] > 0) & (a["used"] + x["s"] > budget))
        return F.when(new, F.struct(x["s"].alias("used"), F.concat(a["out"], F.array(x["i"])).alias("out"))).otherwise(F.struct((a["used"] + x["s"]).alias("used"), a["out"].alias("out")))

    each = F.transform("l", lambda x, i: F.struct(x["s"].alias("s"), i.alias("i")))
    rows = lists.select(*keys, "l", F.aggregate(each, start, step, lambda a: a["out"]).alias("begins"))
    return _cut(rows, keys, F.transform("begins", lambda b, i: F.struct(b.alias("a"), (F.coalesce(F.get("begins", i + 1), F.size("l")) - b).alias("n"))), joint)


def hierarchical(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Leaves of three levels of windows (2048, size, a quarter of it and 64 at least), with their parents' numbers."""
    sizes = (2048, size, max(size // 4, 64))
    out = windows(docs, sizes[0], 0, ("doc_id",)).select("doc_id", F.col("chunk_index").alias("level1"), "text")
    out = windows(out, sizes[1], 0, ("doc_id", "level1")).select("doc_id", "level1", F.col("chunk_index").alias("level2"), "text")
    return windows(out, sizes[2], 0, ("doc_id", "level1", "level2")).select("doc_id", "level1", "level2", F.col("chunk_index").alias("level3"), "n_words", "text")


def buffered(sentences: DataFrame, buffer: int = 1) -> DataFrame:
    """doc_id, number, text with each sentence's neighbours within `buffer` beside it: what is to be embedded for semantic()."""
    w = Window.partitionBy("doc_id").orderBy("number").rowsBetween(-buffer, buffer)
    return sentences.withColumn("text", F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text")).over(w)), lambda x: x["text"]), " "))


def semantic(sentences: DataFrame, percentile: float = 0.95) -> DataFrame:
    """Groups of a document's sentences that break at its largest embedding distances: doc_id, number, v -> group.

    v is the embedding of a sentence with its neighbours (see buffered).
    """
    from plumbline.operators.retrieval import cosine

    w = Window.partitionBy("doc_id").orderBy("number")
    gaps = sentences.withColumn("_p", F.lag("v").over(w)).withColumn("gap", F.when(F.col("_p").isNotNull(), 1 - cosine(F.col("v"), F.col("_p"))))
    cut = gaps.groupBy("doc_id").agg(F.percentile("gap", percentile).alias("cut"))
    broken = gaps.join(cut, "doc_id").withColumn("_b", F.coalesce((F.col("gap") > F.col("cut")).cast("int"), F.lit(0)))
    return broken.withColumn("group", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_p", "_b")


def chunks(docs: DataFrame, strategy: str = "sentence") -> DataFrame:
    """Dispatch by name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; one of {STRATEGIES}")
    if strategy == "sentence":
        return sentence_windows(docs, SIZE, OVERLAP)
    if strategy == "hierarchical":
        return hierarchical(docs)
    if strategy == "semantic":
        raise ValueError("semantic chunking takes embedded sentences: use semantic()")
    from plumbline.operators.legal import paragraphs

    return packed(docs.select("doc_id", F.explode(paragraphs(F.col("text"))).alias("p")).select("doc_id", "p.*"), ["doc_id"], "number", "text", LEGAL_BUDGET)


def features(text: Column) -> dict[str, Column]:
    """Typographic features of a chunk, by name."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    n_words = F.coalesce(F.regexp_count(text, F.lit(r"[A-Za-z']+")), F.lit(0))
    n_lines = F.coalesce(F.size(lines), F.lit(0))
    count = lambda p: F.size(F.filter(lines, lambda x: x.rlike(p)))
    hits = lambda terms: sum((F.lower(text).contains(t).cast("int") for t in terms), F.lit(0))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return {
        "n_words": n_words, "n_lines": n_lines, "toc_share": share(count(TOC_LINE), n_lines), "heading_share": share(count(HEADING_LINE), n_lines),
        "mean_line_words": share(n_words, n_lines), "section_refs": share(100.0 * F.regexp_count(text, F.lit(r"\b\d+[A-Z]?\s*[.(]")), n_words),
        "operative": hits(OPERATIVE), "boilerplate": hits(BOILERPLATE), "furniture_lines": count(FURNITURE), "furniture_share": share(count(FURNITURE), n_lines)}


def chunk_class() -> Column:
    """The ordered class rule over the columns of features()."""
    c = F.col
    toc = (c("toc_share") >= 0.5) & (c("mean_line_words") <= 12) | (c("mean_line_words") <= 4.5) & (c("n_lines") >= 8) & (c("operative") <= 1)
    return (F.when(c("n_words") < 20, "FRAGMENT").when((c("boilerplate") >= 1) & (c("operative") == 0), "BOILERPLATE").when(toc, "TOC_LIKE")
            .when(c("heading_share") >= 0.6, "HEADING_ONLY").otherwise("PROVISION"))


def classified(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, features and class of each chunk."""
    return docs.select(*keep, *[e.alias(n) for n, e in features(F.coalesce(F.col("text"), F.lit(""))).items()]).withColumn("class", chunk_class())


def corpus_statistics(df: DataFrame, doc: str, length: str) -> DataFrame:
    z = lambda x: F.coalesce(x, F.lit(0))
    return df.agg(F.countDistinct(doc).alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.round(F.avg(length), 2), F.lit(0.0)).alias("avg_length"), z(F.max(length)).alias("max_length"), z(F.min(length)).alias("min_length"))


def composition(classes: DataFrame, source: str = "source") -> DataFrame:
    """Counts by source and class with both levels of totals."""
    return classes.rollup(source, "class").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("furniture_share"), 6).alias("furniture")).where(f"{source} is not null or class is null")


def titles(docs: DataFrame) -> DataFrame:
    """Distinct line openings of eight words, longer than 12 characters, of lines that begin with a capital."""
    line = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    head = F.regexp_extract("line", r"^([A-Z][^\s]*(?: [^\s]+){0,7})", 1)
    return line.select(F.trim(head).alias("title")).where(F.length("title") > 12).distinct()


def synthetic_toc(title_list: Column, start: int = 1) -> Column:
    """A table of contents made of titles."""
    return F.array_join(F.transform(title_list, lambda t, i: F.concat((i + start).cast("string"), F.lit(". "), t, F.lit("."))), "\n")


def slot_metrics(ranking: DataFrame, limit: int = 6) -> DataFrame:
    """Wasted slots, first answering rank, and gold displaced: of (query_id, rank, answering, gold).

    Gold is displaced if it would be among the slots with the non-answering chunks taken out, and is not.
    """
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = ranking.withColumn("clean_rank", F.sum(F.col("answering").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    inside = F.col("rank") <= limit
    return rows.groupBy("query_id").agg(
        F.round(F.count_if(inside & ~F.col("answering")) / F.nullif(F.count_if(inside), F.lit(0)), 6).alias("waste_rate"),
        F.min(F.when(F.col("answering"), F.col("rank"))).alias("first_answering_rank"),
        F.count_if(F.col("gold") & F.col("answering") & (F.col("clean_rank") <= limit) & ~inside).alias("gold_displaced"))
