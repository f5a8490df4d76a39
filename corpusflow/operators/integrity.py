"""Integrity rules. Each gives a violations table: rule, key, detail (strings)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import count_tokens, is_blank
from corpusflow.operators.chunking import chunk_id

HASH = "^[0-9a-f]{64}$"
#: Fixed values of the question set: categories and the status each asks for.
CATEGORY_STATUS = {"InCorpus": "Answered", "NoEvidence": "InsufficientEvidence", "OutOfDomain": "OutOfDomain"}


def _rows(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def union(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)


def check_unique(df: DataFrame, keys: list[str], rule: str, ignore_case: bool = False) -> DataFrame:
    """A row for each key that occurs more than once; detail is how often."""
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    found = df.groupBy((F.lower(key) if ignore_case else key).alias("k")).count().where("count > 1")
    return _rows(found, rule, F.col("k"), F.col("count"))


def check_references(child: DataFrame, parent: DataFrame, key: str, child_key: str, rule: str) -> DataFrame:
    """A row for each child without its parent."""
    return _rows(
        child.join(parent.select(key).distinct().hint("merge"), key, "left_anti"), rule, F.col(child_key), F.col(key)
    )


def check_presence(tables: dict[str, DataFrame], key: str, needs: dict[str, list[str]]) -> DataFrame:
    """A row for each key of a table that isn't in another one which it needs (`chunks` to
    `[documents]`), by one aggregate over all tables' keys: a bit a table, summed up before the one
    shuffle, instead of a join a rule. Null keys are nobody's."""
    bit = {name: 1 << i for i, name in enumerate(tables)}
    keys = reduce(
        DataFrame.unionByName,
        [t.select(F.col(key).cast("string").alias("k"), F.lit(bit[name]).alias("b")) for name, t in tables.items()]
    )
    seen = keys.groupBy("k").agg(F.bit_or("b").alias("b"))
    has = lambda name: F.col("b").bitwiseAND(bit[name]) != 0
    rules = [
        F.when(has(name) & (F.col("k").isNull() | ~has(other)), F.lit(f"{name}_without_{other}"))
        for name, others in needs.items() for other in others
    ]
    found = seen.select("k", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    return found.select("rule", F.col("k").alias("key"), F.lit(None).cast("string").alias("detail"))


def _broken(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each rule (name to condition and detail) whose condition a row meets, by one pass over the
    table, in which rows that meet none are left out first."""
    found = [
        F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))
        for rule, (bad, detail) in rules.items()
    ]
    rows = df.where(reduce(Column.__or__, [bad for bad, _ in rules.values()]))
    broken = rows.select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("x"))
    return broken.select("x.rule", "key", "x.detail")


def _unmet(rules: dict[str, Column]) -> dict[str, tuple[Column, Column]]:
    """Conditions that must hold, as rules of _broken; null counts as broken."""
    return {name: (~F.coalesce(test, F.lit(False)), F.lit(None)) for name, test in rules.items()}


def _document_hashes() -> dict[str, tuple[Column, Column]]:
    return {"content_hash": (F.lower("content_hash") != F.sha2("content", 256), F.col("content_hash"))}


def _chunk_hashes() -> dict[str, tuple[Column, Column]]:
    own = chunk_id(F.col("document_id"), F.col("ordinal"), F.col("content"))
    n = F.col("approximate_token_count")
    return {
        "chunk_id": (F.lower("chunk_id") != own, F.col("ordinal")), "token_count": (n != count_tokens(F.col("content")), n)
    }


def check_hashes(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Content hashes (any case), chunk ids and token counts against recomputed ones."""
    return union(
        _broken(documents, "document_id", _document_hashes()), _broken(chunks, "chunk_id", _chunk_hashes())
    )


def check_denormalised(chunks: DataFrame, documents: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Chunk columns that differ from their document's; columns: chunk column to document's. One join
    compares all columns, so chunks' ids are shuffled once."""
    theirs = documents.select("document_id", *(F.col(d).alias(f"__{c}") for c, d in columns.items()))
    rows = chunks.select("document_id", "chunk_id", *columns).join(theirs.hint("merge"), "document_id")
    differ = {f"{c}_differs": (~F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)) for c in columns}
    return _broken(rows, "chunk_id", differ)


def check_constraints(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule (name to condition) that a row breaks; null counts as broken. One
    pass over the table."""
    return _broken(df, key, _unmet(rules))


def chunk_rules() -> dict[str, Column]:
    return {
        "blank_text": ~is_blank(F.col("content")), "ordinal": F.col("ordinal") >= 0,
        "tokens": F.col("approximate_token_count") > 0, "id_format": F.col("chunk_id").rlike(HASH)
    }


def document_rules() -> dict[str, Column]:
    return {
        "blank_text": ~is_blank(F.col("content")), "blank_title": ~is_blank(F.col("title")),
        "hash_format": F.col("content_hash").rlike(HASH), "blank_url": ~is_blank(F.col("canonical_url"))
    }


def manifest_rules() -> dict[str, Column]:
    """Fields of a manifest's entries. A file name is one path element, so that no file outside is read."""
    given = {f"blank_{c}": ~is_blank(F.col(c)) for c in ("document_id", "canonical_url", "title", "content_hash", "file_name")}
    return given | {
        "no_time": F.col("retrieved_at").isNotNull(),
        "unsafe_file_name": ~F.col("file_name").rlike(r"[/\\]|^\.{1,2}$|^[A-Za-z]:"),
    }


def check_manifest(manifest: DataFrame, version: int = 1) -> DataFrame:
    """All rules of a manifest: version 1, entries at all, unique ids, unique file names in any case, and
    the entries' fields. An empty manifest is one row without a key."""
    empty = manifest.agg(F.count(F.lit(1)).alias("n")).where((F.col("n") == 0) | (F.lit(version) != 1))
    rule = F.when(F.lit(version) != 1, "manifest_version").otherwise("manifest_empty")
    none = F.lit(None).cast("string")
    return union(
        empty.select(rule.alias("rule"), none.alias("key"), none.alias("detail")),
        check_unique(manifest, ["document_id"], "repeated_document"),
        check_unique(manifest, ["file_name"], "repeated_file", ignore_case=True),
        check_constraints(manifest, "document_id", manifest_rules()),
    )


def check_headers(a: DataFrame, b: DataFrame) -> DataFrame:
    """Headers (version, corpus_version, chunk_size, overlap; one row each) of two artifacts."""
    valid = (F.col("version") == 1) & (F.col("chunk_size") > 0) & (F.col("overlap") >= 0) & (F.col("overlap") < F.col("chunk_size"))
    bad = a.withColumn("side", F.lit("documents")).unionByName(b.withColumn("side", F.lit("chunks"))).where(~F.coalesce(valid, F.lit(False)))
    differ = a.alias("a").join(
        b.alias("b"),
        (F.col("a.version") != F.col("b.version")) | (
            F.col("a.corpus_version") != F.col("b.corpus_version")
        ) | (F.col("a.chunk_size") != F.col("b.chunk_size")) | (F.col("a.overlap") != F.col("b.overlap"))
    )
    return union(
        _rows(bad, "header_invalid", F.col("side"), F.col("version")),
        _rows(differ, "headers_differ", F.lit("documents"), F.lit("chunks"))
    )


def check_pairing(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks without their document, and documents without any chunk."""
    tables = {"chunks": chunks, "documents": documents}
    return check_presence(tables, "document_id", {"chunks": ["documents"], "documents": ["chunks"]})


def check_artifacts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """All rules of a pair of artifacts: unique ids, references, hashes and counts, columns that
    chunks take over from their documents, and the formats of both. Texts are read once a side."""
    taken = {
        "source_url": "canonical_url", "document_title": "title", "version": "version",
        "processed_content_hash": "content_hash"
    }
    return union(
        check_unique(
            documents, ["document_id"], "repeated_document"
        ), check_unique(chunks, ["chunk_id"], "repeated_chunk"),
        check_unique(chunks, ["document_id", "ordinal"], "repeated_ordinal"), check_pairing(documents, chunks),
        check_denormalised(chunks, documents, taken), _broken(chunks, "chunk_id", _chunk_hashes() | _unmet(chunk_rules())),
        _broken(documents, "document_id", _document_hashes() | _unmet(document_rules())),
    )


def check_questions(questions: DataFrame) -> DataFrame:
    """Rules of a question set, one row for each that a question breaks, ids in any case."""
    status = F.create_map(*(F.lit(x) for kv in CATEGORY_STATUS.items() for x in kv))
    answered = F.col("expected_status") == "Answered"
    urls, facts = F.size("expected_urls"), F.size("expected_facts")
    rules = {
        "language": F.col("language").isin("ru", "en"),
        "category": F.col("category").isin(*CATEGORY_STATUS),
        "status_of_category": F.try_element_at(status, F.col("category")) == F.col("expected_status"),
        "blank_text": ~is_blank(F.col("text")),
        "answered_needs_evidence": ~answered | ((urls > 0) & (facts > 0)),
        "refusal_has_evidence": answered | ((urls <= 0) & (facts <= 0)),
        "multi_source": ~F.col("requires_multiple_sources") | (urls >= 2),
        "url_scheme": F.forall("expected_urls", lambda u: u.rlike("^(?i)https?://[^/]")),
    }
    return check_constraints(questions, "question_id", rules).unionByName(
        check_unique(questions, ["question_id"], "repeated_id", ignore_case=True)
    )
