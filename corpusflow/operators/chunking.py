"""Chunking of documents, by size, by overlap, by paragraph and by headings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import count_tokens, once, tokens

CHUNKS = "document_id string, chunk_id string, section string, ordinal int, approximate_token_count int, content string"
CHUNKS_OR_ERROR = f"{CHUNKS}, error string"


def chunk_id(document_id: Column, ordinal: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\n", document_id, ordinal.cast("string"), text), 256)


def _windows(docs: DataFrame, size: int, stride: int, stop: Column) -> DataFrame:
    starts = F.when(F.size("w") > 0, F.sequence(F.lit(0), stop, F.lit(stride)))
    rows = docs.select("document_id", tokens(F.col("content")).alias("w")).select(
        "document_id", "w", F.posexplode(starts).alias("ordinal", "at")
    )
    rows = rows.withColumn("content", F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " "))
    counted = F.least(F.lit(size), F.size("w") - F.col("at")).alias("approximate_token_count")
    return rows.select(
        "document_id", chunk_id(F.col("document_id"), F.col("ordinal"), F.col("content")).alias("chunk_id"),
        F.lit(None).cast("string").alias("section"), "ordinal", counted, "content"
    )


def chunk_fixed(docs: DataFrame, size: int = 512) -> DataFrame:
    """Windows of `size` tokens, the last one shorter. A document without tokens has none."""
    if size < 1:
        raise ValueError("size must be positive")
    return _windows(docs, size, size, F.size("w") - 1)


def chunk_overlap(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Windows of `size` tokens that share `overlap` with the next; none lies within another."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    return _windows(docs, size, size - overlap, F.greatest(F.size("w") - 1 - overlap, F.lit(0)))


def chunk_paragraph(docs: DataFrame) -> DataFrame:
    """One chunk a line that isn't blank."""
    lines = F.filter(F.transform(F.split("content", r"\n+"), lambda x: F.trim(x)), lambda x: x.rlike(r"(?U)\S"))
    rows = docs.select("document_id", F.posexplode(lines).alias("ordinal", "content"))
    return rows.select(
        "document_id", chunk_id(F.col("document_id"), F.col("ordinal"), F.col("content")).alias("chunk_id"),
        F.lit(None).cast("string").alias("section"), "ordinal",
        count_tokens(F.col("content")).alias("approximate_token_count"), "content"
    )


#: A code fence from the line that opens it to the line that closes it, or to the end; else one line.
#: Possessive, so that long fences need no stack.
ELEMENT = r"(?dm)^```[^\n]*+(?:\n(?!```)[^\n]*+)*+(?:\n```[^\n]*+)?+|^[^\n]*+"


def _strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)(?<!\s)\s++\z", "")


def _places(items: Column, condition: Callable[[Column], Column]) -> Column:
    """Positions, from 0, of the items of an array that meet a condition."""
    marked = F.transform(items, lambda x, i: F.when(condition(x), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _runs(items: Column, breaks: Column) -> Column:
    """The runs of items before, between and after the positions of breaks; runs may be empty."""
    starts = F.concat(F.array(F.lit(-1)), breaks)
    ends = F.concat(breaks, F.array(F.size(items)))
    return F.zip_with(starts, ends, lambda a, b: F.slice(items, a + 2, b - a - 1))


def _units(elements: Column, title: Column) -> Column:
    """Bodies of the runs of elements between blank lines and the title's own line."""
    is_break = lambda x: ~x.rlike(r"(?U)\S") | (~x.startswith("```") & (_strip(x) == F.concat(F.lit("# "), title)))
    runs = once(_places(elements, is_break), lambda at: _runs(elements, at))
    return F.filter(F.transform(runs, lambda run: _strip(F.array_join(run, "\n"))), lambda body: body != "")


def sections(title: Column, text: Column) -> Column:
    """Sections (name, units) of a text, in order. `## ` opens a section and a blank line ends a unit, both
    outside fences (which open and close at column 0); the title's own line is dropped; what
    precedes the first section joins the first that isn't empty; the name is null before any.

    Fences are taken whole by one pattern, so every element is read once; headings and blank lines
    are positions, and sections and units slices between them."""
    title = F.coalesce(title, F.lit(""))
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))

    def cut(elements: Column) -> Column:
        heads = _places(elements, lambda x: x.startswith("## "))
        return once(heads, lambda at: F.transform(_runs(elements, at), lambda run, i: F.struct(
            F.when(i > 0, _strip(F.substr(F.get(elements, F.get(at, i - 1)), F.lit(4)))).alias("name"),
            _units(run, title).alias("units"),
        )))

    def joined(found: Column) -> Column:
        preamble = F.get(found, 0)
        full = F.filter(found, lambda s, i: (i > 0) & (F.size(s["units"]) > 0))
        first = lambda named: F.struct(
            F.get(named, 0)["name"].alias("name"), F.concat(preamble["units"], F.get(named, 0)["units"]).alias("units")
        )
        return F.when(F.size(preamble["units"]) == 0, full).otherwise(
            once(full, lambda named: F.when(F.size(named) == 0, F.array(preamble)).otherwise(
                F.concat(F.array(first(named)), F.slice(named, F.lit(2), F.size(named)))
            ))
        )

    return once(once(F.regexp_extract_all(plain, F.lit(ELEMENT), F.lit(0)), cut), joined)


def _pieces(unit: Column, budget: Column, overlap: int) -> Column:
    """A unit that fits, unchanged; else runs of budget - overlap tokens, one at least."""
    step = F.greatest(F.lit(1), budget - overlap)

    def cut(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 1, step)
        runs = F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, step), " "))
        return F.when(F.size(w) <= budget, F.array(unit)).otherwise(runs)

    return once(tokens(unit), cut)


def pack(units: Column, budget: Column, overlap: int) -> Column:
    """Bodies of at most `budget` tokens; each starts with the last tokens of the one before,
    as many as overlap and the next unit leave room for. A fold; what is held is never over the budget."""
    texts = F.array().cast("array<string>")
    start = F.struct(texts.alias("bodies"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(acc: Column, unit: Column) -> Column:
        def placed(size: Column) -> Column:
            room = F.least(F.lit(overlap), F.greatest(F.lit(0), budget - size))
            tail = once(tokens(acc["held"]), lambda w: F.when(room > 0, F.slice(
                w, F.greatest(F.size(w) - room, F.lit(0)) + 1, room
            )).otherwise(texts))
            ended = lambda t: F.struct(
                F.concat(acc["bodies"], F.array(acc["held"])).alias("bodies"),
                F.concat(F.array_join(t, " "), F.when(F.size(t) > 0, "\n\n").otherwise(""), unit).alias("held"),
                (F.size(t) + size).alias("n")
            )
            more = F.struct(
                acc["bodies"].alias("bodies"),
                F.concat(acc["held"], F.when(acc["held"] != "", "\n\n").otherwise(""), unit).alias("held"),
                (acc["n"] + size).alias("n")
            )
            return F.when((acc["held"] != "") & (acc["n"] + size > budget), once(tail, ended)).otherwise(more)

        return once(count_tokens(unit), placed)

    last = lambda acc: F.when(acc["held"] != "", F.concat(acc["bodies"], F.array(acc["held"]))).otherwise(acc["bodies"])
    return F.aggregate(units, start, step, last)


def chunk_heading_aware(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of documents (document_id, title, content) along their headings; each starts with its
    title and section. Packing depends on the order of units, so a document's are folded where they
    are, by JVM expressions and without a shuffle. A document whose title and section leave no room for a
    body token is one row with an error; null and blank texts have no chunks."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to size - 1")
    name = lambda s: F.when(s["name"] != "", s["name"])
    prefix = lambda s: F.concat(F.lit("# "), _strip(F.coalesce("title", F.lit(""))), F.coalesce(F.concat(F.lit("\n\n## "), name(s)), F.lit("")))
    headed = F.transform(sections(F.col("title"), F.col("content")), lambda s: F.struct(
        name(s).alias("section"), prefix(s).alias("prefix"), (size - count_tokens(prefix(s))).alias("budget"), s["units"].alias("units")
    ))

    def chunks(s: Column) -> Column:
        fitting = F.flatten(F.transform(s["units"], lambda u: _pieces(u, s["budget"], overlap)))
        return F.transform(pack(fitting, s["budget"], overlap), lambda body: F.struct(
            s["section"].alias("section"), F.concat(s["prefix"], F.lit("\n\n"), body).alias("content"), F.lit(None).cast("string").alias("error")
        ))

    def rows(found: Column) -> Column:
        tight = F.filter(found, lambda s: s["budget"] < 1)
        said = f"size {size} leaves no room for a body token after the title and section"
        error = lambda s: F.struct(s["section"].alias("section"), F.lit(None).cast("string").alias("content"), F.lit(said).alias("error"))
        return once(tight, lambda t: F.when(F.size(t) > 0, F.transform(F.slice(t, 1, 1), error)).otherwise(
            F.flatten(F.transform(found, chunks))
        ))

    cut = docs.select("document_id", F.posexplode(once(headed, rows)).alias("n", "c")).select("document_id", "n", "c.*")
    fine = F.col("error").isNull()
    return cut.select(
        "document_id", F.when(fine, chunk_id(F.col("document_id"), F.col("n"), F.col("content"))).alias("chunk_id"),
        "section", F.when(fine, F.col("n")).alias("ordinal"),
        F.when(fine, count_tokens(F.col("content"))).alias("approximate_token_count"), "content", "error"
    )


def split_sections(docs: DataFrame) -> DataFrame:
    """document_id, section (null before any), section_ordinal, unit_ordinal and unit."""
    found = docs.select(
        "document_id", F.posexplode(sections(F.col("title"), F.col("content"))).alias("section_ordinal", "s")
    )
    return found.select(
        "document_id", F.col("s.name").alias("section"), "section_ordinal", F.posexplode("s.units").alias("unit_ordinal", "unit")
    )


def split_units(units: DataFrame, budget: int, overlap: int) -> DataFrame:
    """units (document_id, unit_ordinal, unit) with oversized ones cut into runs of tokens."""
    pieces = _pieces(F.col("unit"), F.lit(budget), overlap)
    return units.select("document_id", "unit_ordinal", F.posexplode(pieces).alias("piece", "content"))


def chunk_profile(chunked: dict[str, DataFrame]) -> DataFrame:
    """Tokens per chunk by strategy: n_chunks, n_documents, min, avg, max and median."""
    rows = reduce(
        DataFrame.unionByName,
        [
            c.select(F.lit(name).alias("strategy"), "document_id", "approximate_token_count") for name,
            c in chunked.items()
        ]
    )
    n = F.col("approximate_token_count")
    return rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"), F.min(n).alias("min_tokens"),
        F.round(F.avg(n), 6).alias("avg_tokens"), F.max(n).alias("max_tokens"), F.round(F.percentile(n, F.lit(0.5)), 6).alias("median_tokens"),
    )


def chunk_matrix(chunked: dict[str, DataFrame]) -> DataFrame:
    """Chunks and tokens by strategy and document, by strategy, by document, and over all, in one
    pass; all_strategies and all_documents say what a row is summed over. A document's chunks are
    summed up before they are shuffled."""
    rows = reduce(
        DataFrame.unionByName,
        [
            c.select(F.lit(name).alias("strategy"), "document_id", "approximate_token_count") for name,
            c in chunked.items()
        ]
    )
    n = F.col("approximate_token_count")
    return rows.cube("strategy", "document_id").agg(
        F.grouping("strategy").cast("int").alias("all_strategies"), F.grouping("document_id").cast("int").alias("all_documents"),
        F.count(F.lit(1)).alias("n_chunks"), F.sum(n).alias("n_tokens"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens")
    )


def process_summary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row from two of one row each."""
    return docs.agg(F.count(F.lit(1)).alias("documents")).join(
        chunks.agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("document_id").alias("chunked_documents"))
    )
