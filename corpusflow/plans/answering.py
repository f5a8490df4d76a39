"""Queries over questions, candidates, responses and runs; streaming jobs run to their end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import answers, chunking, traces
from corpusflow.plans.base import MANIFEST, fixed_sql, manifest, processed, query, raw_pages, table
from corpusflow.plans.search import _top, top_sql
from corpusflow.sources import corpus
from corpusflow.sources.scratch import materialize, scratch_path
from corpusflow.streaming import jobs

Spark = SparkSession
WORDS = "list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: lower(w))"
LANGUAGE = rf"CASE WHEN regexp_matches(text, '{T.UNSUPPORTED_SCRIPT}') THEN NULL WHEN regexp_matches(text, '{T.CYRILLIC}') THEN 'Russian' WHEN list_has_any({WORDS}, {T.ENGLISH_INDICATORS}) OR regexp_matches(text, '{T.IDENTIFIER}') THEN 'English' END"


@query(
    "SELECT conv_id, turn, CASE WHEN text IS NULL OR NOT regexp_matches(text, '\\S') THEN 'Blank' WHEN length(text) > 2000 THEN 'TooLong' END AS rejected FROM conversations"
)
def validate_questions(spark: Spark, sf: str) -> DataFrame:
    return answers.validate_questions(table(spark, sf, "conversations")).select("conv_id", "turn", "rejected")


@query(f"SELECT doc_id, {LANGUAGE} AS language FROM documents")
def detect_language(spark: Spark, sf: str) -> DataFrame:
    return answers.with_language(table(spark, sf, "documents")).select("doc_id", "language")


@query(
    f"WITH d AS (SELECT source, {LANGUAGE} AS l FROM documents) SELECT source, count(*) FILTER (l = 'Russian') AS n_ru, count(*) FILTER (l = 'English') AS n_en, count(*) FILTER (l IS NULL) AS n_null FROM d GROUP BY 1"
)
def language_profile(spark: Spark, sf: str) -> DataFrame:
    return answers.language_profile(table(spark, sf, "documents"))


@query(
    f"WITH d AS (SELECT source, lang, {LANGUAGE} AS l FROM documents) SELECT source, lang, grouping(source)::INTEGER AS all_keys, grouping(lang)::INTEGER AS all_labels, count(*) AS n, count(*) FILTER (l = 'Russian') AS n_ru, count(*) FILTER (l = 'English') AS n_en, count(*) FILTER (l IS NULL) AS n_null, count(*) FILTER (l = 'Russian' AND lower(lang) = 'ru' OR l = 'English' AND lower(lang) = 'en') AS n_agree FROM d GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())"
)
def language_matrix(spark: Spark, sf: str) -> DataFrame:
    return answers.language_matrix(table(spark, sf, "documents"))


def _questions(spark: Spark, sf: str) -> DataFrame:
    """Query vectors as questions whose text is the document of the same id."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), "text")
    rows = table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("question_id"))
    return answers.with_language(rows.join(docs.hint("merge"), "question_id"))


def _candidates(spark: Spark, sf: str) -> DataFrame:
    """The ten nearest other vectors of each question, with their documents."""
    near = _top(spark, sf, 11).where("chunk_id <> query_id").withColumnRenamed("query_id", "question_id").drop("initial_rank")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("title"), F.col("lang").alias("section"),
        F.concat(F.lit("https://corpus.example/"), "doc_id").alias("url"), F.col("text").alias("content"),
        F.col("source").alias("document_id")
    )
    return near.join(docs.hint("merge"), "chunk_id").withColumn(
        "initial_rank",
        F.expr("cast(row_number() over (partition by question_id order by similarity desc, chunk_id) as int)")
    )


CANDIDATES = f"{top_sql(11)}, questions AS (SELECT doc_id AS question_id, text, {LANGUAGE} AS language FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0)), candidates AS (SELECT query_id AS question_id, chunk_id, similarity, source AS document_id, lang AS section, text AS content, 'https://corpus.example/' || doc_id AS url, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS initial_rank FROM top JOIN documents ON doc_id = chunk_id WHERE chunk_id <> query_id)"
#: Thresholds for the test vectors, whose neighbours are mostly between 0.2 and 0.6.
LOW, HIGH = 0.3, 0.4
GATED = f"{CANDIDATES}, gated AS (SELECT q.question_id, language, max(similarity) AS best, CASE WHEN language IS NULL THEN 'UnsupportedLanguage' WHEN coalesce(max(similarity) < {LOW}, true) THEN 'OutOfDomain' WHEN max(similarity) < {HIGH} THEN 'InsufficientEvidence' ELSE 'Eligible' END AS status FROM questions q LEFT JOIN candidates c USING (question_id) GROUP BY 1, 2)"


def _gated(spark: Spark, sf: str) -> DataFrame:
    return answers.gate_questions(_questions(spark, sf), _candidates(spark, sf), LOW, HIGH)


@query(f"WITH {GATED} SELECT question_id, language, best, status FROM gated")
def gate_questions(spark: Spark, sf: str) -> DataFrame:
    return _gated(spark, sf).select("question_id", "language", "best", "status")


@query(
    f"WITH {GATED} SELECT question_id, chunk_id, similarity FROM candidates JOIN gated USING (question_id) WHERE status = 'Eligible' AND similarity >= {HIGH}"
)
def eligible_candidates(spark: Spark, sf: str) -> DataFrame:
    return answers.eligible_candidates(
        _candidates(spark, sf), _gated(spark, sf), HIGH
    ).select("question_id", "chunk_id", "similarity")


@query(
    rf"WITH {CANDIDATES}, a AS (SELECT * FROM candidates WHERE similarity >= 0.1 AND len(regexp_extract_all(content, '\S+')) >= 20 QUALIFY row_number() OVER (PARTITION BY question_id, sha256(content) ORDER BY similarity DESC, chunk_id) = 1) SELECT question_id, chunk_id, document_id FROM a QUALIFY row_number() OVER (PARTITION BY question_id, document_id ORDER BY similarity DESC, chunk_id) <= 1"
)
def context_filter(spark: Spark, sf: str) -> DataFrame:
    return answers.context_filter(_candidates(spark, sf), 0.1, 1, 20).select("question_id", "chunk_id", "document_id")


@query(
    rf"WITH {CANDIDATES}, a AS (SELECT * FROM candidates WHERE section = 'en' AND similarity >= 0.1 AND len(regexp_extract_all(content, '\S+')) >= 20 QUALIFY row_number() OVER (PARTITION BY question_id, sha256(content) ORDER BY similarity DESC, chunk_id) = 1) SELECT question_id, chunk_id, document_id FROM a QUALIFY row_number() OVER (PARTITION BY question_id, document_id ORDER BY similarity DESC, chunk_id) <= 1"
)
def context_filter_metadata(spark: Spark, sf: str) -> DataFrame:
    found = answers.context_filter(_candidates(spark, sf), 0.1, 1, 20, F.col("section") == "en")
    return found.select("question_id", "chunk_id", "document_id")


#: Words that stand for questions: a window that has the word is a candidate.
ASKED = ("that", "die", "pour")
WINDOW, SHARED = 64, 8
#: By single tokens: the positions that candidates cover, and runs of them.
MERGED = f"""{fixed_sql(WINDOW, WINDOW - SHARED, f"greatest(len(w) - 1 - {SHARED}, 0)")}, found AS (SELECT question_id, document_id, ordinal, ordinal * {WINDOW - SHARED} AS start, approximate_token_count AS n, len(list_filter(string_split(lower(content), ' '), lambda x: x = question_id)) / approximate_token_count AS similarity FROM chunks, (SELECT unnest({list(ASKED)}) AS question_id) WHERE list_contains(string_split(lower(content), ' '), question_id)),
places AS (SELECT DISTINCT question_id, document_id, unnest(range(start, start + n)) AS pos FROM found),
runs AS (SELECT question_id, document_id, min(pos) AS start, count(*) AS n_tokens FROM (SELECT *, pos - row_number() OVER (PARTITION BY question_id, document_id ORDER BY pos) AS island FROM places) GROUP BY question_id, document_id, island)"""


@query(
    f"WITH {MERGED} SELECT question_id, document_id, r.start::INTEGER AS start, r.n_tokens::INTEGER AS n_tokens, count(*)::INTEGER AS n_chunks, round(max(similarity), 6) AS best, any_value(array_to_string(w[r.start + 1 : r.start + r.n_tokens], ' ')) AS content FROM runs r JOIN found f USING (question_id, document_id) JOIN docs USING (document_id) WHERE f.start BETWEEN r.start AND r.start + r.n_tokens - 1 GROUP BY question_id, document_id, r.start, r.n_tokens"
)
def merge_context(spark: Spark, sf: str) -> DataFrame:
    """Overlapping windows of all documents that hold a word; similarity is the word's share."""
    windows = chunking.chunk_overlap(processed(spark, sf), WINDOW, SHARED)
    said = F.filter(F.split(F.lower("content"), " "), lambda x: x == F.col("question_id"))
    found = windows.select("*", F.explode(F.array(*map(F.lit, ASKED))).alias("question_id")).withColumn(
        "similarity", F.size(said) / F.col("approximate_token_count")
    ).where("similarity > 0")
    return answers.merge_context(found, WINDOW, SHARED).withColumn("best", F.round("best", 6))


@query(rf"""WITH {CANDIDATES}, doc AS (SELECT question_id, chunk_id, list_transform(regexp_extract_all(content, '[^\s\x{{00A0}}\x{{0085}}\p{{Z}}]+'), lambda x: lower(x)) AS w FROM candidates),
sized AS (SELECT *, len(w) AS n, avg(len(w)) OVER (PARTITION BY question_id) AS avg_len, count(*) OVER (PARTITION BY question_id) AS docs FROM doc),
terms AS (SELECT DISTINCT question_id, unnest(list_transform(regexp_extract_all(text, '[^\s\x{{00A0}}\x{{0085}}\p{{Z}}]+'), lambda x: lower(x))) AS t FROM questions),
tf AS (SELECT question_id, chunk_id, n, avg_len, docs, t, count(*) AS tf FROM (SELECT *, unnest(w) AS t FROM sized) GROUP BY ALL),
met AS (SELECT tf.*, count(*) OVER (PARTITION BY question_id, t) AS df FROM tf JOIN terms USING (question_id, t)),
s AS (SELECT question_id, chunk_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))) AS s FROM met GROUP BY 1, 2)
SELECT question_id, chunk_id, round(coalesce(s, 0), 6) AS reranker_score FROM candidates LEFT JOIN s USING (question_id, chunk_id)""")
def score_lexical(spark: Spark, sf: str) -> DataFrame:
    return answers.score_lexical(_questions(spark, sf), _candidates(spark, sf))


def _reranked(spark: Spark, sf: str) -> DataFrame:
    """Candidates in reverse order, as a model might have answered."""
    found = _candidates(spark, sf)
    order = found.groupBy("question_id").agg(
        F.sort_array(F.collect_list("initial_rank"), asc=False).alias("permutation")
    )
    return answers.apply_ranking(found, order)


RERANKED = f"{CANDIDATES}, reranked AS (SELECT *, count(*) OVER (PARTITION BY question_id) - initial_rank + 1 AS final_rank, CASE WHEN count(*) OVER (PARTITION BY question_id) = 1 THEN 1 ELSE round(1 - (count(*) OVER (PARTITION BY question_id) - initial_rank) / (count(*) OVER (PARTITION BY question_id) - 1), 6) END AS reranker_score FROM candidates)"


@query(f"WITH {RERANKED} SELECT question_id, chunk_id, initial_rank, final_rank, reranker_score FROM reranked")
def apply_ranking(spark: Spark, sf: str) -> DataFrame:
    return _reranked(spark, sf).select("question_id", "chunk_id", "initial_rank", "final_rank", "reranker_score")


@query(f"WITH {RERANKED} SELECT question_id, chunk_id, initial_rank - final_rank AS rise FROM reranked")
def rank_shift(spark: Spark, sf: str) -> DataFrame:
    return answers.rank_shift(_reranked(spark, sf))


@query(
    f"WITH {RERANKED}, best AS (SELECT question_id, min(CASE WHEN r.document_id = d.source THEN initial_rank END) AS a, min(CASE WHEN r.document_id = d.source THEN final_rank END) AS b FROM reranked r LEFT JOIN documents d ON d.doc_id = question_id GROUP BY 1), m AS (SELECT question_id, coalesce(round(1 / a, 6), 0) AS rr_before, coalesce(round(1 / b, 6), 0) AS rr_after, coalesce((a <= 3)::INTEGER, 0) AS hit_before, coalesce((b <= 3)::INTEGER, 0) AS hit_after FROM best) SELECT question_id, rr_before, rr_after, round(rr_after - rr_before, 6) AS rr_delta, hit_before, hit_after, hit_after - hit_before AS hit_delta FROM m"
)
def rank_effect(spark: Spark, sf: str) -> DataFrame:
    """Relevant are candidates of the question's own source."""
    ranked = materialize(_reranked(spark, sf), "reranked")
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("question_id"), F.col("source").alias("own"))
    relevant = ranked.join(own.hint("merge"), "question_id").where("document_id = own")
    return answers.rank_effect(ranked, relevant)


@query(f"WITH {RERANKED} SELECT question_id, chunk_id, final_rank FROM reranked WHERE final_rank <= 3")
def top_evidence(spark: Spark, sf: str) -> DataFrame:
    return answers.top_evidence(_reranked(spark, sf)).select("question_id", "chunk_id", "final_rank")


def _prompt_sql(cte: str, rules: str, tell: str, rank: str, fields: dict[str, str], tail: str) -> str:
    """Prompts by string_agg; fields: name to column."""
    lines = " || ".join(
        f"chr(10) || '{name}: ' || to_json(coalesce({column}, ''))::VARCHAR" for name, column in fields.items()
    )
    return f"""WITH {cte}, sources AS (SELECT question_id, string_agg('SOURCE ' || n || {lines}, chr(10) || chr(10) ORDER BY n) AS listed, count(*)::INTEGER AS source_count
  FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {rank}) AS n FROM picked) GROUP BY 1)
SELECT question_id, '{rules}' {tell} AS system, 'Question: ' || to_json(text)::VARCHAR || chr(10) || chr(10) || listed {tail} AS "user", source_count FROM questions JOIN sources USING (question_id)"""


@query(
    _prompt_sql(
        f"{CANDIDATES}, picked AS (SELECT * FROM candidates)", answers.RANK_RULES, "", "initial_rank",
        {"title": "document_id", "section": "section", "text": "content"}, ""
    )
)
def build_rerank_prompt(spark: Spark, sf: str) -> DataFrame:
    return answers.build_rerank_prompt(_questions(spark, sf), _candidates(spark, sf))


TELL = "|| CASE language WHEN 'Russian' THEN chr(10) || 'Answer strictly in Russian.' WHEN 'English' THEN chr(10) || 'Answer strictly in English.' ELSE '' END"
AGAIN = "|| chr(10) || chr(10) || 'The question again: ' || to_json(text)::VARCHAR"


@query(
    _prompt_sql(
        f"{RERANKED}, picked AS (SELECT * FROM reranked WHERE final_rank <= 3)", answers.ANSWER_RULES, TELL,
        "final_rank", {"title": "document_id", "section": "section", "url": "url", "text": "content"}, AGAIN
    )
)
def build_answer_prompt(spark: Spark, sf: str) -> DataFrame:
    return answers.build_answer_prompt(_questions(spark, sf), answers.top_evidence(_reranked(spark, sf)))


def _cases(cases: list[str]) -> Column:
    """The case of a turn, by the length of its text."""
    return F.get(F.array(*map(F.lit, cases)), F.length("text") % len(cases))


#: Responses for three sources: content to the reason of its rejection.
RANK_CASES = {
    '{"rankedSourceNumbers": [2, 1, 3]}': None, '{"rankedSourceNumbers": [1, 1, 3]}': "Duplicate", '{"rankedSourceNumbers": [1, 2]}': "Incomplete", '{"rankedSourceNumbers": [1, 2, 4]}': "Range",
    '{"rankedSourceNumbers": [1, 2, 3], "why": ""}': "Shape", "not json": "Malformed", "[1, 2, 3]": "Shape", '{"rankedSourceNumbers": [1, 2.5, 3]}': "Range",
    '{"rankedSourceNumbers": [1,2,3]} trailing': "Malformed", '{"rankedSourceNumbers": ["1",2,3]}': "Range", "{'rankedSourceNumbers': [1,2,3]}": "Malformed", '{"rankedSourceNumbers": [1,2,3]}{}': "Malformed",
    '{"rankedSourceNumbers": [1,2,3], "rankedSourceNumbers": [1,2,3]}': "Shape", '{"rankedSourceNumbers": [1,1,9]}': "Duplicate", '{"rankedSourceNumbers": [9,1,1]}': "Range", '{"rankedSourceNumbers": [[1],2,3]}': "Range",
    '{"rankedSourceNumbers": [1,2,3,]}': "Malformed", '{"rankedSourceNumbers": {"a": [1,2,3]}}': "Shape", '{"rankedSourceNumbers": "[1,2,3]"}': "Shape", '{"rankedSourceNumbers": [1.0,2,3]}': "Range",
    '{"rankedSourceNumbers": [01,2,3]}': "Malformed", '{"rankedSourceNumbers": [1,2,null]}': "Range", '{"rankedSourceNumbers": []}': "Incomplete", '{"rankedSourceNumbers": [-1,2,3]}': "Range",
    '{"ranked\\u0053ourceNumbers":\t[3,2,1]}\r\n': None, "{}": "Shape", "": "Malformed", '{"rankedSourceNumbers": [1,2,3]}] , [{}': "Malformed",
}
ANSWER_CASES = {
    '{"sufficientEvidence": true, "answer": "A full answer.", "citedSourceNumbers": [2, 1]}': None,
    '{"sufficientEvidence": false, "answer": "", "citedSourceNumbers": []}': None,
    '{"sufficientEvidence": true, "answer": "Yes.", "citedSourceNumbers": [1]}': None,
    "{broken": "StructuredJsonMalformed",
    " ": "MessageContentMissing",
    '{"sufficientEvidence": true, "answer": "x"}': "StructuredShapeInvalid",
    '{"sufficientEvidence": "true", "answer": "x", "citedSourceNumbers": [1]}': "StructuredShapeInvalid",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": [9]}': "CitationNumberInvalid",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": [1, 1]}': "CitationNumberDuplicate",
    '{"sufficientEvidence": true, "answer": " ", "citedSourceNumbers": [1]}': "AnswerMissing",
    '{"sufficientEvidence": true, "answer": "see HTTP://x.y/z", "citedSourceNumbers": [1]}': "AnswerUrlForbidden",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": []}': "CitationMissing",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": ["1"]}': "CitationNumberInvalid",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": [1]} x': "StructuredJsonMalformed",
    "{'sufficientEvidence': true, 'answer': 'x', 'citedSourceNumbers': [1]}": "StructuredJsonMalformed",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": [1.5]}': "CitationNumberInvalid",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": [2e0]}': "CitationNumberInvalid",
    '{"sufficientEvidence": true, "answer": "x", "answer": "y", "citedSourceNumbers": [1]}': "StructuredShapeInvalid",
    '{"citedSourceNumbers": [9], "answer": 1, "sufficientEvidence": true}': "CitationNumberInvalid",
    '{"answer": 1, "citedSourceNumbers": [9], "sufficientEvidence": true}': "StructuredShapeInvalid",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": [{"a": 1, "a": [2]}, 1]}': "CitationNumberInvalid",
    '{"sufficientEvidence": true, "answer": {"a": "x"}, "citedSourceNumbers": [1]}': "StructuredShapeInvalid",
    '{"sufficientEvidence": true, "answer": "x", "citedSourceNumbers": [1], "more": null}': "StructuredShapeInvalid",
    '{"sufficientEvidence": null, "answer": "x", "citedSourceNumbers": [1]}': "StructuredShapeInvalid",
    '{"citedSourceNumbers": [3], "answer": "Full \\"quote\\", {1}.", "sufficientEvidence": true}': None,
    '"text"': "StructuredShapeInvalid",
    '{"sufficientEvidence": true, "answer": "a\\q", "citedSourceNumbers": [1]}': "StructuredJsonMalformed",
}
_N = len(ANSWER_CASES)
#: Of answers that are accepted, by their place among the cases: text and citations.
ACCEPTED = {0: ("A full answer.", "2,1"), 1: ("", ""), 2: ("Yes.", "1"), 24: ('Full "quote", {1}.', "3")}


def _pick(values: list) -> str:
    """SQL for the value of a turn's case."""
    return "CASE length(text) % " + str(len(values)) + "".join(
        f" WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None
    ) + " END"


def _responses(spark: Spark, sf: str, cases: dict) -> DataFrame:
    rows = table(spark, sf, "conversations")
    return rows.select(
        F.concat("conv_id", F.lit("-"), "turn").alias("question_id"), F.lit(1).alias("attempt"),
        F.lit(3).alias("source_count"), "text", _cases(list(cases)).alias("content")
    )


@query(
    f"SELECT conv_id || '-' || turn AS question_id, {_pick(list(RANK_CASES.values()))} AS reason, {_pick(['2,1,3', *[None] * 23, '3,2,1', *[None] * 3])} AS permutation FROM conversations"
)
def parse_rank_response(spark: Spark, sf: str) -> DataFrame:
    found = answers.parse_rank_response(_responses(spark, sf, RANK_CASES))
    return found.select("question_id", "reason", F.array_join("permutation", ",").alias("permutation"))


@query(
    f"SELECT conv_id || '-' || turn AS question_id, {_pick(list(ANSWER_CASES.values()))} AS reason, {_pick([ACCEPTED.get(i, (None,))[0] for i in range(_N)])} AS answer, {_pick([ACCEPTED.get(i, (None, None))[1] for i in range(_N)])} AS cited FROM conversations"
)
def parse_answer_response(spark: Spark, sf: str) -> DataFrame:
    found = answers.parse_answer_response(_responses(spark, sf, ANSWER_CASES))
    return found.select("question_id", "reason", "answer", F.array_join("cited", ",").alias("cited"))


@query(
    f"SELECT conv_id || '-' || turn AS question_id, {_pick(['uninformative' if i == 2 else 'malformed' if r == 'StructuredJsonMalformed' else None for i, r in enumerate(ANSWER_CASES.values())])} AS why FROM conversations WHERE length(text) % {_N} IN ({', '.join(str(i) for i, r in enumerate(ANSWER_CASES.values()) if i == 2 or r == 'StructuredJsonMalformed')})"
)
def needs_retry(spark: Spark, sf: str) -> DataFrame:
    return answers.needs_retry(answers.parse_answer_response(_responses(spark, sf, ANSWER_CASES)))


@query(
    f"SELECT conv_id || '-' || turn AS question_id, 1 AS attempt, {_pick([None, None, 'NonSubstantiveAnswer', *list(ANSWER_CASES.values())[3:]])} AS reason FROM conversations"
)
def final_responses(spark: Spark, sf: str) -> DataFrame:
    return answers.final_responses(
        answers.parse_answer_response(_responses(spark, sf, ANSWER_CASES))
    ).select("question_id", "attempt", "reason")


@query(
    """
WITH said AS (
  SELECT conv_id, turn, regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s*[.!?]$', '') AS t FROM conversations
), numbers AS (
  SELECT conv_id, turn, t, CASE WHEN starts_with(t, 'source') THEN ltrim(substr(t, 7), E' \\t\\n\\r') ELSE t END AS r FROM said
)
SELECT conv_id, turn, t IN ('yes', 'no', 'да', 'нет')
  OR (r = t OR NOT starts_with(r, '#')) AND (len(r) > 0 AND translate(r, '0123456789', '') = '' OR regexp_full_match(r, '\\[[0-9]+\\]'))
  OR r <> t AND starts_with(r, '#') AND regexp_full_match(substr(r, 2), '\\s*[0-9]+') AS uninformative
FROM numbers
"""
)
def uninformative(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", T.uninformative(F.col("text")).alias("uninformative")
    )


def _answered(spark: Spark, sf: str) -> DataFrame:
    """Every question answered from the second and first evidence."""
    rows = _questions(spark, sf).select(
        "question_id", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("sufficient"),
        F.lit("An answer.").alias("answer"), F.array(F.lit(2), F.lit(1)).alias("cited")
    )
    return answers.attach_citations(rows, answers.top_evidence(_reranked(spark, sf)))


@query(
    f"WITH {RERANKED} SELECT q.question_id, string_agg(r.url, ' ' ORDER BY final_rank DESC) AS urls FROM questions q LEFT JOIN reranked r ON r.question_id = q.question_id AND final_rank <= 2 GROUP BY 1"
)
def attach_citations(spark: Spark, sf: str) -> DataFrame:
    return _answered(spark, sf).select(
        "question_id", F.array_join(F.transform("citations", lambda c: c["url"]), " ").alias("urls")
    )


REFUSALS = answers.Texts()


@query(
    f"WITH {GATED} SELECT question_id, CASE status WHEN 'Eligible' THEN 'Answered' ELSE status END AS status, language, CASE status WHEN 'Eligible' THEN 'An answer.' WHEN 'OutOfDomain' THEN CASE language WHEN 'Russian' THEN '{REFUSALS.out_of_domain_ru}' ELSE '{REFUSALS.out_of_domain_en}' END WHEN 'InsufficientEvidence' THEN CASE language WHEN 'Russian' THEN '{REFUSALS.insufficient_ru}' ELSE '{REFUSALS.insufficient_en}' END END AS text FROM gated"
)
def finalize_answers(spark: Spark, sf: str) -> DataFrame:
    return answers.finalize_answers(_gated(spark, sf), _answered(spark, sf)).drop("citations")


@query(
    "SELECT doc_id, CASE WHEN length(t) > 512 THEN substr(t, 1, 512) || '…' ELSE t END AS text FROM (SELECT doc_id, translate(replace(text, source, '[redacted]'), chr(13) || chr(10), '  ') AS t FROM documents)"
)
def redact(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.redact(F.col("text"), [F.col("source")]).alias("text"))


@query(
    f"WITH {GATED} SELECT question_id, chunk_id, unnest(['model-a', 'model-b']) AS model FROM candidates JOIN gated USING (question_id) WHERE status = 'Eligible'"
)
def fan_out_models(spark: Spark, sf: str) -> DataFrame:
    return traces.fan_out_models(
        _candidates(spark, sf), _gated(spark, sf), ["model-a", "model-b"]
    ).select("question_id", "chunk_id", "model")


def _runs(spark: Spark, sf: str) -> DataFrame:
    """Events as model runs: a user's day is the run, the event type the model, the value its time;
    errors have no status."""
    status = F.when(F.col("event_type") != "error", "Answered")
    return table(spark, sf, "events").select(
        "event_id", (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("run_id"), F.col("event_type").alias("model"),
        status.alias("status"), (F.col("value") - 10).alias("seconds"), F.col("ts").alias("completed_at")
    )


@query(
    "SELECT user_id * 100 + day(ts) AS run_id, event_type AS model, CASE WHEN event_type <> 'error' THEN 'Answered' ELSE 'Failed' END AS status, greatest(0, coalesce(value - 10, 0)) AS seconds FROM events"
)
def model_outcomes(spark: Spark, sf: str) -> DataFrame:
    return traces.model_outcomes(_runs(spark, sf))


@query(
    "WITH o AS (SELECT user_id * 100 + day(ts) AS run_id, event_type AS model, greatest(0, coalesce(value - 10, 0)) AS seconds FROM events WHERE event_type <> 'error'), s AS (SELECT run_id, count(*) AS n, min({'s': seconds, 'm': model}) AS best, max(seconds) AS worst FROM o GROUP BY 1) SELECT run_id, best.m AS faster, CASE WHEN best.s > 0 THEN round(worst / best.s, 6) END AS ratio FROM s WHERE n = 2"
)
def faster_model(spark: Spark, sf: str) -> DataFrame:
    return traces.faster_model(traces.model_outcomes(_runs(spark, sf)))


@query(
    "SELECT user_id * 100 + day(ts) AS run_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS model, max(ts) AS completed_at FROM events GROUP BY 1"
)
def load_latest_snapshot(spark: Spark, sf: str) -> DataFrame:
    """Runs saved to a snapshot table, then the latest of each."""
    path = scratch_path(spark, "runs")
    corpus.save_snapshot(_runs(spark, sf), path)
    return traces.latest_run(spark.read.parquet(path)).select("run_id", "model", "completed_at")


def _traces(spark: Spark, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.select(
        F.col("user_id").alias("trace_id"), F.col("event_type").alias("stage"),
        F.get_json_object("props", "$.k").alias("source"), F.col("value").alias("similarity")
    )


@query(
    "SELECT user_id AS trace_id, event_type AS stage, count(*) AS n, count(DISTINCT json_extract_string(props, '$.k')) AS sources, max(value) AS best, min(value) AS worst FROM events GROUP BY 1, 2"
)
def trace_rollup(spark: Spark, sf: str) -> DataFrame:
    return traces.trace_rollup(_traces(spark, sf))


def _spans(spark: Spark, sf: str) -> DataFrame:
    """Events as spans of four stages; errors failed."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("stage-"), F.col("user_id") % 4).alias("stage"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.col("ts").alias("started"), F.col("value").alias("duration")
    )


@query(
    "SELECT 'stage-' || user_id % 4 AS stage, ts::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, round(sum(value), 6) AS total, min(value) AS least, max(value) AS longest FROM events GROUP BY 1, 2"
)
def stage_durations(spark: Spark, sf: str) -> DataFrame:
    found = traces.stage_durations(_spans(spark, sf)).drop("sketch")
    return found.withColumn("total", F.round("total", 6)).withColumn("day", F.col("day").cast("string"))


@query()
def duration_quantiles(spark: Spark, sf: str) -> DataFrame:
    return traces.duration_quantiles(traces.stage_durations(_spans(spark, sf)), ["stage"])


@query(
    "SELECT trace_id, stage, position, similarity FROM (SELECT user_id AS trace_id, event_type AS stage, value AS similarity, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, json_extract_string(props, '$.k')) AS position FROM events) WHERE position <= 20"
)
def similarity_by_rank(spark: Spark, sf: str) -> DataFrame:
    return traces.similarity_by_rank(_traces(spark, sf))


@query(
    "SELECT user_id AS trace_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) AS n FROM events GROUP BY 1"
)
def stage_counts(spark: Spark, sf: str) -> DataFrame:
    return traces.stage_counts(_traces(spark, sf), ["click", "view", "purchase"])


@query(
    "SELECT user_id AS trace_id, count(*) AS n FROM events WHERE ('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 10000 < 2500 GROUP BY 1"
)
def sample_traces(spark: Spark, sf: str) -> DataFrame:
    return traces.sample_traces(_traces(spark, sf), 0.25).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"))


LAST = "row_number() OVER (PARTITION BY document_id ORDER BY content_hash DESC NULLS LAST) = 1"


@query(
    f"WITH {MANIFEST}, r AS (SELECT * FROM raw QUALIFY {LAST}), m AS (SELECT * FROM manifest QUALIFY {LAST}) SELECT coalesce(r.document_id, m.document_id) AS document_id, CASE WHEN r.canonical_url IS NOT NULL THEN r.content_hash ELSE m.content_hash END AS content_hash, CASE WHEN m.document_id IS NULL THEN r.document_id || '.html' ELSE m.document_id || '.html' END AS file_name, CASE WHEN r.canonical_url IS NOT NULL THEN 'new title' ELSE m.title END AS title FROM r FULL JOIN m ON r.document_id = m.document_id"
)
def stream_ingest_changes(spark: Spark, sf: str) -> DataFrame:
    """The manifest after a stream of two files: the earlier pages, then all of today's. Of pages with one id
    in a file, which arrive together, that with the larger hash counts."""
    source, root = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    columns = ["document_id", "canonical_url", "title", "content_hash", "retrieved_at"]
    schema = jobs.MANIFEST.rpartition(",")[0]
    raw_pages(spark, sf).select(columns).write.parquet(f"{source}/b")
    manifest(spark, sf).select(columns).write.parquet(f"{source}/a")
    for part in "ab":  # one after the other; the second goes on from the first's manifest
        stream = jobs.file_stream(spark, f"{source}/{part}", schema, files=1_000_000)
        jobs.stream_ingest_changes(
            stream, f"{root}/manifest", f"{root}/checkpoint-{part}", first_batch=int(part == "b")
        ).awaitTermination()
    return jobs.read_manifest(spark, f"{root}/manifest").select("document_id", "content_hash", "file_name", "title")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL")
def stream_dedup(spark: Spark, sf: str) -> DataFrame:
    """All events as one stream, first of each user and type within a delay of their span."""
    out, events = scratch_path(spark, "dedup"), materialize(table(spark, sf, "events"), "events")
    stream = jobs.file_stream(spark, events.inputFiles()[0].rpartition("/")[0], events.schema, files=1_000_000)
    found = jobs.stream_dedup(stream, ["user_id", "event_type"], "ts", "3650 days")
    found.writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", f"{out}-checkpoint"
    ).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
