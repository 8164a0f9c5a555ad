"""Text scalars as Column functions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

# Stop lists, patterns and limits that results depend on.
RETRIEVAL_STOP = (
    "what does do is a an the in on at to for of and or talk about with by as it this that are was were be has have had not how why who"
).split()
CLAIM_STOP = (
    "a an the of to in on at for and or is are was were be been by as it its this that with from which who whom shall may any such not "
    "if then under means person he she they"
).split()
GROUNDED_STOP = "that this with from which under shall have been about there their".split()
TOPIC_STOP = (
    "what does do is a an the in on at to for of and or with by as it this that are was were be has have had not how why who can about which would could"
).split()
WORD = r"[\p{L}\p{N}_]+"
CONTENT_WORD = r"[a-z0-9']+"
REFUSAL = (
    r"do(?:es)? not have enough information|don'?t have enough information|not enough information|insufficient information"
    r"|unable to (?:answer|determine|find)|cannot (?:answer|determine|be answered)|can'?t (?:answer|determine)"
    r"|no (?:relevant )?information (?:is )?(?:available|provided|found)|the (?:retrieved )?context does not (?:contain|provide|mention)"
    r"|i (?:do not|don'?t) know"
)
GENERATION_ERROR = r"^\s*(?:error generating answer|error:|\{'message':)"
#: Whole words of Unicode letters, in either case of A-Z; what \b takes for a letter differs between versions of Java and between engines.
NON_ASSERTIVE = (
    r"^\s*(?:i (?:do not|don'?t|cannot|can'?t)(?![\p{L}\p{N}_])|(?:the )?(?:retrieved )?context (?:does not|doesn'?t)(?![\p{L}\p{N}_])"
    r"|(?:however|unfortunately|please|note that|in summary|let me know)(?![\p{L}\p{N}_])|there (?:is|are) no(?![\p{L}\p{N}_]))"
)
CONTEXT_BLOCK = r"(?s)--- Context chunk \d+ \[Chunk-ID: ([^\]]*)\] ---\n(.*?)(?=\n--- Context chunk |\n\nQuestion: |\z)"
CHUNK_CITATION = r"(?i)\[(?:Chunk-ID:\s*|Chunk:\s*)([a-f0-9\-]+)\]"
SAFE_ID = r"^[A-Za-z0-9_-]{1,128}$"


def literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _without(found: Column, stop: list[str]) -> Column:
    return F.filter(found, lambda w: ~w.isin(stop))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def lexical_tokens(text: Column) -> Column:
    """Lower-case Unicode words without the retrieval stop words, in order and with repeats."""
    return _without(matches(F.lower(text), WORD), RETRIEVAL_STOP)


def content_words(text: Column) -> Column:
    return _without(matches(F.lower(text), CONTENT_WORD), CLAIM_STOP)


def sentences(text: Column) -> Column:
    """Split after . ! or ? where a capital follows; trimmed, none empty."""
    return _trimmed(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"))


def simple_sentences(text: Column) -> Column:
    """Split after . ! or ?; trimmed, none empty."""
    return _trimmed(F.split(F.trim(text), r"(?<=[.!?])\s+"))


def long_fragments(text: Column, more_than: int = 15) -> Column:
    """Pieces between sentence marks and line ends that are longer than `more_than` characters."""
    return F.filter(_trimmed(F.split(text, r"[.!?\n]+")), lambda s: F.length(s) > more_than)


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def is_refusal(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i){REFUSAL}"), F.lit(False))


def is_generation_error(text: Column) -> Column:
    return F.coalesce(text.rlike(f"(?i){GENERATION_ERROR}"), F.lit(False))


def claims(answer: Column) -> Column:
    """Assertive sentences without markdown and bracketed citations, with three content words at least."""
    cleaned = F.transform(simple_sentences(answer), lambda s: F.trim(F.regexp_replace(F.trim(F.regexp_replace(s, r"[*_`#>]|^\s*[-•]\s*|^\s*\d+\.\s*", " ")), r"\[[^\]]*\]", " ")))
    return F.filter(cleaned, lambda s: (F.size(content_words(s)) >= 3) & ~s.rlike(f"(?i){NON_ASSERTIVE}"))


def context_blocks(prompt: Column) -> Column:
    """(chunk_id, text) of the context blocks in a prompt snapshot."""
    return F.arrays_zip(matches(prompt, CONTEXT_BLOCK, 1).alias("chunk_id"), matches(prompt, CONTEXT_BLOCK, 2).alias("text"))


def chunk_citations(answer: Column) -> Column:
    """Distinct chunk ids cited, in order of first mention."""
    return F.array_distinct(F.transform(matches(answer, CHUNK_CITATION, 1), F.lower))


def text_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased, trimmed text."""
    return F.sha2(F.lower(F.trim(text)), 256)


def document_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def cache_key(model: Column, text: Column) -> Column:
    return F.md5(F.concat_ws(":", model, text))


def payload_hash(payload: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a struct's JSON; order its fields by name for a stable hash."""
    return F.substring(F.sha2(F.to_json(payload), 256), 1, 16)


def clean_snippet(text: Column, length: int = 220) -> Column:
    return F.rtrim(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, length))


def ellipsis(text: Column, length: int) -> Column:
    return F.when(F.length(text) <= length, text).otherwise(F.concat(F.substring(text, 1, length - 3), F.lit("...")))


def first_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"((?:19|20)\d\d)", 1), F.lit("")).cast("int")


def year_range(spec: Column) -> Column:
    """2020-2024,2026 as sorted distinct years."""
    part = lambda p, i: F.trim(F.get(F.split(p, "-"), F.lit(i))).cast("int")
    each = F.transform(F.split(spec, ","), lambda p: F.sequence(part(p, 0), F.coalesce(part(p, 1), part(p, 0))))
    return F.array_sort(F.array_distinct(F.flatten(each)))


def keyword_query(question: Column) -> Column:
    """The question's words less the stop list; the question itself if none is left."""
    return F.coalesce(F.nullif(F.array_join(_without(matches(F.lower(question), WORD), RETRIEVAL_STOP), " "), F.lit("")), question)


def needs_condensing(question: Column, referring: list[str], cues: list[str]) -> Column:
    """Four words or fewer, a referring word, or a cue phrase."""
    words = F.filter(F.split(F.lower(F.trim(question)), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    cue = F.exists(literals(cues), lambda c: F.lower(question).contains(c))
    return (F.size(words) <= 4) | F.arrays_overlap(bare, literals(referring)) | cue


def accepted_rewrite(question: Column, rewritten: Column) -> Column:
    """A condensed question, or the question itself where the rewrite is empty or far too long."""
    clean = F.trim(rewritten)
    bad = rewritten.isNull() | (clean == "") | (F.length(clean) > 4 * F.length(question) + 200)
    return F.when(bad, question).otherwise(clean)


def compare_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def verdict(reply: Column) -> Column:
    """(status, reason) of a judge's reply; nulls where they are missing."""
    pick = lambda p: F.nullif(F.trim(F.regexp_extract(reply, p, 1)), F.lit(""))
    return F.struct(F.upper(pick(r"STATUS:\s*(\w+)")).alias("status"), pick(r"REASON:\s*(.+)").alias("reason"))


def yes_no(reply: Column) -> Column:
    word = F.upper(F.regexp_replace(F.trim(reply), r"[.! ]+$", ""))
    return F.when(word == "YES", True).when(word == "NO", False)


def answer_parts(reply: Column) -> Column:
    """(thinking, answer) of a tagged reply; untagged text is the answer."""
    think = F.regexp_extract(reply, r"(?s)<thinking>(.*?)</thinking>", 1)
    tagged = F.regexp_extract(reply, r"(?s)<answer>(.*?)(?:</answer>|\z)", 1)
    rest = F.regexp_replace(reply, r"(?s)<thinking>.*?(?:</thinking>|\z)", "")
    return F.struct(F.trim(think).alias("thinking"), F.trim(F.when(reply.contains("<answer>"), tagged).otherwise(rest)).alias("answer"))


def open_brackets(text: Column) -> Column:
    """(closers, upto, then) of JSON text that may break off: what closes its open brackets, innermost first; and how
    many characters reach to its last whole object, and what closes the text there.

    One pass over the characters with a stack of closers; brackets inside strings, and quotes escaped there, don't count.
    """
    start = F.struct(F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit("").alias("stack"), F.lit(0).alias("n"), F.lit(0).alias("upto"), F.lit("").alias("then"))

    def step(s: Column, c: Column) -> Column:
        inside = s["quoted"]
        closes = ~inside & c.isin("}", "]") & (F.substring(s["stack"], 1, 1) == c)
        stack = F.when(~inside & (c == "{"), F.concat(F.lit("}"), s["stack"])).when(~inside & (c == "["), F.concat(F.lit("]"), s["stack"])).when(closes, F.substring(s["stack"], F.lit(2), F.length(s["stack"]))).otherwise(s["stack"])
        quote = (c == '"') & ~s["escaped"]
        object_ = closes & (c == "}")
        n = s["n"] + 1
        return F.struct((inside != quote).alias("quoted"), (inside & (c == "\\") & ~s["escaped"]).alias("escaped"), stack.alias("stack"), n.alias("n"), F.when(object_, n).otherwise(s["upto"]).alias("upto"), F.when(object_, stack).otherwise(s["then"]).alias("then"))

    return F.aggregate(F.split(text, ""), start, step, lambda s: F.struct(s["stack"].alias("closers"), s["upto"].alias("upto"), s["then"].alias("then")))


def recovered_json(reply: Column, schema: str) -> Column:
    """An array parsed from a model's reply: as it is, without code fences, from the first [ to the last ], with its open brackets closed, or cut after the last whole object."""
    bare = F.regexp_replace(reply, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    widest = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    inner = F.regexp_extract(bare, r"(?s)(\[.*)", 1)
    ends = lambda x: F.array(F.concat(x["t"], x["e"]["closers"]), F.when(x["e"]["upto"] > 0, F.concat(F.substring(x["t"], F.lit(1), x["e"]["upto"]), x["e"]["then"])).otherwise(""))
    both = F.get(F.transform(F.array(F.struct(inner.alias("t"), open_brackets(inner).alias("e"))), ends), F.lit(0))
    tries = []
    for text in (reply, bare, widest, F.get(both, F.lit(0)), F.get(both, F.lit(1))):
        parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
        tries.append(F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$") & (F.size(F.filter(parsed, lambda x: x.isNotNull())) > 0), parsed))
    return F.coalesce(*tries)


def page_number(source: Column, label: Column, number: Column) -> Column:
    """(page, key used): the first that is present, else unknown."""
    return F.struct(F.coalesce(source, label, number, F.lit("unknown")).alias("page"),
                    F.when(source.isNotNull(), "source").when(label.isNotNull(), "page_label").when(number.isNotNull(), "page_number").otherwise("unknown").alias("key"))


def template_values(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Columns as a template's values: fractions with three places, the number of an array's items under <name>_count, all else as text."""
    out = {}
    for name in columns:
        kind, c = df.schema[name].dataType, F.col(name)
        if isinstance(kind, (DoubleType, FloatType)):
            out[name] = F.when(c.isNotNull(), F.format_string("%.3f", c.cast("double")))
        elif isinstance(kind, ArrayType):
            out[f"{name}_count"] = F.when(c.isNotNull(), F.size(c).cast("string"))
        else:
            out[name] = c.cast("string")
    return out


def first_present(*columns: Column) -> Column:
    """The first value that isn't null."""
    return F.coalesce(*columns)


def interpolated(template: Column, values: dict[str, Column]) -> Column:
    """{name} placeholders filled in; N/A where a value is null."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("N/A")))
    return F.regexp_replace(out, r"\{[a-z_]+\}", "N/A")
