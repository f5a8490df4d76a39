"""Queries over vectors: retrieval, evaluation, index maintenance, embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import approximate, embedding, evaluation, index, retrieval
from corpusflow.plans.base import query, table
from corpusflow.sources.scratch import scratch_path

Spark = SparkSession
K = 20


def _vectors(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _queries(spark: Spark, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(
        F.col("vec_id").alias("query_id"), "embedding"
    )


def _top(spark: Spark, sf: str, k: int = K, threshold: float | None = 0.0) -> DataFrame:
    return retrieval.retrieve_topk(_queries(spark, sf), _vectors(spark, sf), k, threshold)


def top_sql(k: int = K, threshold: float = 0.0) -> str:
    return f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
scored AS (SELECT query_id, vec_id AS chunk_id, label, list_cosine_similarity(q.e, i.embedding::DOUBLE[]) AS full_similarity, round(full_similarity, 6) AS similarity FROM q, embeddings i),
top AS (SELECT * EXCLUDE (full_similarity), row_number() OVER (PARTITION BY query_id ORDER BY round(full_similarity, 12) DESC, chunk_id) AS initial_rank FROM scored WHERE similarity >= {threshold} QUALIFY initial_rank <= {k})"""


@query(f"WITH {top_sql(5)} SELECT query_id, chunk_id, similarity, initial_rank FROM top")
def retrieve_topk(spark: Spark, sf: str) -> DataFrame:
    return _top(spark, sf, 5)


@query("SELECT (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) * count(*) AS pairs, true AS no_more_multiplied FROM embeddings")
def topk_work(spark: Spark, sf: str) -> DataFrame:
    """Pairs that exact retrieval looks at; those that it multiplies in full are no more."""
    done = retrieval.topk_work(_queries(spark, sf), _vectors(spark, sf), 5).agg(
        F.sum("pairs").alias("pairs"), F.sum("multiplied").alias("multiplied")
    )
    return done.select("pairs", (F.col("multiplied") <= F.col("pairs")).alias("no_more_multiplied"))


@query(
    "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS similarity FROM embeddings"
)
def cosine_similarity(spark: Spark, sf: str) -> DataFrame:
    """Each vector against its own reverse."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.round(retrieval.cosine_similarity(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity")
    )


def _profiled(spark: Spark, sf: str) -> DataFrame:
    """Vectors in two profiles, by whether their label is below 5."""
    key = lambda name: T.profile_key(F.lit(" Local "), F.lit(name), F.size("embedding"))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.when(F.col("label") < 5, key("Model-A")).otherwise(key("Model-B")).alias("profile_key"),
        F.size("embedding").alias("dimension"), "embedding"
    )


@query("SELECT vec_id AS chunk_id, 'local:model-a:' || len(embedding) AS profile_key FROM embeddings WHERE label < 5")
def filter_profile(spark: Spark, sf: str) -> DataFrame:
    return retrieval.filter_profile(_profiled(spark, sf), "local:model-a:64", 64).select("chunk_id", "profile_key")


@query(
    "SELECT vec_id AS chunk_id, 'local:model-' || CASE WHEN label < 5 THEN 'a' ELSE 'b' END || ':' || len(embedding) AS profile_key FROM embeddings"
)
def profile_key(spark: Spark, sf: str) -> DataFrame:
    return _profiled(spark, sf).select("chunk_id", "profile_key")


@query(
    f"WITH {top_sql(5)} SELECT query_id, t.chunk_id, initial_rank, d.source AS title, length(d.text) AS n_chars FROM top t JOIN documents d ON d.doc_id = t.chunk_id"
)
def join_chunk_metadata(spark: Spark, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    chunks = docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.length("text").alias("n_chars")
    )
    documents = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("title"))
    return retrieval.join_chunk_metadata(_top(spark, sf, 5), chunks, documents).select(
        "query_id", "chunk_id", "initial_rank", "title", "n_chars"
    )


def _embedded(spark: Spark, sf: str) -> DataFrame:
    return embedding.embed_hashing(table(spark, sf, "documents")).select(F.col("doc_id").alias("chunk_id"), "embedding")


@query()
def semantic_search(spark: Spark, sf: str) -> DataFrame:
    """Benchmark items as questions over documents, both by the hashing embedder."""
    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    return retrieval.semantic_search(questions, embedding.embed_hashing, _embedded(spark, sf), 5)


@query()
def embed_hashing(spark: Spark, sf: str) -> DataFrame:
    return _embedded(spark, sf)


@query(
    "SELECT doc_id, length(text)::FLOAT AS first, len(regexp_extract_all(text, 'e'))::FLOAT AS second FROM documents"
)
def embed(spark: Spark, sf: str) -> DataFrame:
    """A plug-in model of two features, batches of 8."""

    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), t.count("e")] for t in texts], np.float32)

    found = embedding.embed(table(spark, sf, "documents"), make)
    return found.select("doc_id", F.col("embedding")[0].alias("first"), F.col("embedding")[1].alias("second"))


@query(
    "SELECT doc_id, 'title: none | text: ' || text AS document, 'task: search result | query: ' || text AS query, text AS plain FROM documents"
)
def format_embedding_input(spark: Spark, sf: str) -> DataFrame:
    made = lambda role, model: T.format_embedding_input(F.col("text"), role, F.lit(model))
    return table(spark, sf, "documents").select(
        "doc_id", made("document", " embeddinggemma:latest ").alias("document"),
        made("query", "EmbeddingGemma:Q4_0").alias("query"), made("query", "other").alias("plain")
    )


@query(
    "WITH e AS (SELECT vec_id || '|local:model-b:64' AS key, label FROM embeddings) SELECT 'vector_length' AS rule, key, '64' AS detail FROM e WHERE label = 9 UNION ALL SELECT 'not_finite', key, '64' FROM e WHERE label = 8 UNION ALL SELECT 'zero_vector', key, '64' FROM e WHERE label = 7 UNION ALL SELECT 'repeated', key, '2' FROM e WHERE label = 6"
)
def validate_embeddings(spark: Spark, sf: str) -> DataFrame:
    """Vectors damaged by label: 9 too short, 8 infinite, 7 zero, 6 twice."""
    rows = _profiled(spark, sf).join(
        table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label").hint("merge"), "chunk_id"
    )
    bad = F.when(F.col("label") == 9, F.slice("embedding", 1, 63)).when(
        F.col("label") == 8, F.transform("embedding", lambda x: F.lit(float("inf")).cast("float"))
    ).when(F.col("label") == 7, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
    rows = rows.withColumn("embedding", F.coalesce(bad, "embedding"))
    rows = rows.unionByName(rows.where("label = 6")).drop("label")
    return embedding.validate_embeddings(rows, rows.select("profile_key", "dimension").distinct())


@query(
    "SELECT 'local:model-' || CASE WHEN label < 5 THEN 'a' ELSE 'b' END || ':64' AS profile_key, len(embedding) AS dimension, count(DISTINCT vec_id) AS chunks, count(*) AS embeddings FROM embeddings GROUP BY 1, 2"
)
def index_summary(spark: Spark, sf: str) -> DataFrame:
    return embedding.index_summary(_profiled(spark, sf))


@query()
def retrieve_approx(spark: Spark, sf: str) -> DataFrame:
    return approximate.retrieve_approx(_queries(spark, sf), _vectors(spark, sf), 5)


@query()
def ann_recall_of_lists(spark: Spark, sf: str) -> DataFrame:
    """Recall of retrieve_approx against the exact result."""
    return retrieval.ann_recall(
        approximate.retrieve_approx(_queries(spark, sf), _vectors(spark, sf), 5), _top(spark, sf, 5, None)
    )


@query(
    f"WITH {top_sql(5, -1)}, half AS (SELECT query_id, chunk_id FROM scored WHERE label < 5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(full_similarity, 12) DESC, chunk_id) <= 5) SELECT t.query_id, round(avg((h.chunk_id IS NOT NULL)::INTEGER), 6) AS recall FROM top t LEFT JOIN half h USING (query_id, chunk_id) GROUP BY 1"
)
def ann_recall(spark: Spark, sf: str) -> DataFrame:
    """Recall of a search that knows only the vectors of labels below 5."""
    half = table(spark, sf, "embeddings").where("label < 5").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.ann_recall(retrieval.retrieve_topk(_queries(spark, sf), half, 5, None), _top(spark, sf, 5, None))


@query(
    f"WITH {top_sql()}, t AS (SELECT query_id, similarity, unnest([0.25, 0.35, 0.45, 0.6])::DOUBLE AS threshold FROM top), p AS (SELECT threshold, query_id, count(*) FILTER (similarity >= threshold) AS n FROM t GROUP BY 1, 2) SELECT threshold, sum(n)::BIGINT AS kept, count(*) FILTER (n > 0) AS answered, count(*) FILTER (n = 0) AS refused FROM p GROUP BY 1"
)
def threshold_sweep(spark: Spark, sf: str) -> DataFrame:
    return retrieval.threshold_sweep(_top(spark, sf), [0.25, 0.35, 0.45, 0.6])


def _url(label):
    return F.concat(F.lit("label-"), label.cast("string"))


def _questions(spark: Spark, sf: str) -> DataFrame:
    """Query vectors as questions: their own label's URL and the next one's are expected;
    those of label 0 are expected to be refused."""
    rows = table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    status = F.when(F.col("label") == 0, "OutOfDomain").otherwise("Answered")
    urls = F.array(_url(F.col("label")), _url((F.col("label") + 1) % 10))
    return rows.select(
        F.col("vec_id").alias("question_id"), (F.col("vec_id") / 100).cast("long").alias("position"),
        F.concat(F.lit("c"), F.col("label") % 3).alias("category"), status.alias("expected_status"),
        urls.alias("expected_urls")
    )


def _ranked(spark: Spark, sf: str, threshold: float = 0.0) -> DataFrame:
    labels = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), _url(F.col("label")).alias("url"))
    return _top(spark, sf, K, threshold).join(labels.hint("merge"), "chunk_id").select(
        F.col("query_id").alias("question_id"), F.col("initial_rank").alias("rank"), "url", "similarity", "chunk_id"
    )


def metrics_sql(threshold: float = 0.0) -> str:
    per = ", ".join(
        f"CASE WHEN first <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_{k}, round(c{k} / 2, 6) AS coverage_{k}, CASE WHEN c{k} = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS all_hit_{k}, round(coalesce(p{k}, 0), 6) AS precision_{k}"
        for k in evaluation.KS
    )
    sums = ", ".join(
        f"count(DISTINCT CASE WHEN hit AND rank <= {k} THEN chunk_label END) AS c{k}, avg(CASE WHEN rank <= {k} THEN hit::INTEGER END) AS p{k}" for k in evaluation.KS
    )
    return f"""{top_sql(K, threshold)}, questions AS (SELECT vec_id AS question_id, label FROM embeddings WHERE vec_id % 100 = 0),
hits AS (SELECT question_id, initial_rank AS rank, t.label AS chunk_label, coalesce(t.label IN (q.label, (q.label + 1) % 10), false) AS hit FROM questions q LEFT JOIN top t ON t.query_id = q.question_id WHERE q.label <> 0),
sums AS (SELECT question_id, min(CASE WHEN hit THEN rank END) AS first, {sums} FROM hits GROUP BY 1),
metrics AS (SELECT q.question_id, CASE WHEN s.question_id IS NOT NULL THEN round(coalesce(1 / first, 0), 6) END AS reciprocal_rank, {per.replace('CASE WHEN first', 'CASE WHEN s.question_id IS NULL THEN NULL WHEN first').replace('CASE WHEN c', 'CASE WHEN s.question_id IS NULL THEN NULL WHEN c').replace('round(coalesce(p', 'round(CASE WHEN s.question_id IS NOT NULL THEN 1 END * coalesce(p')} FROM questions q LEFT JOIN sums s USING (question_id))"""


NAMES = ["reciprocal_rank", *(f"{n}_{k}" for k in evaluation.KS for n in ("hit", "coverage", "all_hit", "precision"))]


def _metrics(spark: Spark, sf: str, threshold: float = 0.0) -> DataFrame:
    return evaluation.per_question(_questions(spark, sf), _ranked(spark, sf, threshold))


@query(f"WITH {metrics_sql()} SELECT * FROM metrics")
def retrieval_report(spark: Spark, sf: str) -> DataFrame:
    """Reciprocal rank, hit, coverage, all-sources hit and precision of every question."""
    return _metrics(spark, sf)


@query(
    f"WITH {metrics_sql()} SELECT count(*) AS questions, count(reciprocal_rank) AS answered, {', '.join(f'round(avg({n}), 6) AS mean_{n}' for n in NAMES)} FROM metrics"
)
def retrieval_summary(spark: Spark, sf: str) -> DataFrame:
    return evaluation.summarize(_metrics(spark, sf))


def _single(name: str):
    columns = [n for n in NAMES if n.rpartition("_")[0] == name]

    @query(f"WITH {metrics_sql()} SELECT question_id, {', '.join(columns)} FROM metrics")
    def at_k(spark: Spark, sf: str) -> DataFrame:
        return _metrics(spark, sf).select("question_id", *columns)

    return at_k


def _register_single(stem: str, query_name: str) -> None:
    from corpusflow.plans import base

    f = _single(stem)
    f.__name__ = query_name
    base.QUERIES[query_name] = base.QUERIES.pop("at_k")
    base.ORACLES[query_name] = base.ORACLES.pop("at_k")


for _stem, _name in (
    ("hit", "hit_at_k"), ("coverage", "source_coverage_at_k"), ("all_hit", "all_sources_hit_at_k"),
    ("precision", "precision_at_k")
):
    _register_single(_stem, _name)


@query(f"WITH {metrics_sql()} SELECT question_id, reciprocal_rank FROM metrics")
def reciprocal_rank(spark: Spark, sf: str) -> DataFrame:
    return _metrics(spark, sf).select("question_id", "reciprocal_rank")


@query(f"WITH {metrics_sql()} SELECT round(avg(reciprocal_rank), 6) AS mrr FROM metrics")
def mean_reciprocal_rank(spark: Spark, sf: str) -> DataFrame:
    return evaluation.summarize(_metrics(spark, sf)).select(F.col("mean_reciprocal_rank").alias("mrr"))


@query(
    f"WITH {metrics_sql()} " + " UNION ALL ".join(
        f"SELECT {k} AS k, " + ", ".join(
            f"round(avg({n}_{k}), 6) AS mean_{n}" for n in ("hit", "coverage", "all_hit", "precision")
        ) + " FROM metrics" for k in evaluation.KS
    )
)
def topk_sweep(spark: Spark, sf: str) -> DataFrame:
    return evaluation.metrics_by_k(_metrics(spark, sf))


@query(
    f"WITH a AS (WITH {metrics_sql()} SELECT * FROM metrics), b AS (WITH {metrics_sql(0.2)} SELECT * FROM metrics) SELECT question_id, round(b.reciprocal_rank - a.reciprocal_rank, 6) AS delta_reciprocal_rank, round(b.precision_20 - a.precision_20, 6) AS delta_precision_20 FROM a JOIN b USING (question_id)"
)
def compare_runs(spark: Spark, sf: str) -> DataFrame:
    """Thresholds 0 and 0.2."""
    return evaluation.compare_runs(_metrics(spark, sf), _metrics(spark, sf, 0.2), ["reciprocal_rank", "precision_20"])


def _results(spark: Spark, sf: str) -> DataFrame:
    """Questions with the status that a gate at 0.5 gives them."""
    rows = _questions(spark, sf).join(
        _top(spark, sf, 2).where("chunk_id <> query_id").groupBy(F.col("query_id").alias("question_id")).agg(F.max("similarity").alias("best")).hint("merge"),
        "question_id", "left"
    )
    return rows.withColumn(
        "status", F.when(F.coalesce(F.col("best") >= 0.5, F.lit(False)), "Answered").otherwise("OutOfDomain")
    )


RESULTS = f"{top_sql(2)}, results AS (SELECT e.vec_id AS question_id, e.vec_id // 100 AS position, 'c' || e.label % 3 AS category, CASE WHEN e.label = 0 THEN 'OutOfDomain' ELSE 'Answered' END AS expected_status, CASE WHEN coalesce((SELECT max(similarity) FROM top t WHERE t.query_id = e.vec_id AND t.chunk_id <> t.query_id) >= 0.5, false) THEN 'Answered' ELSE 'OutOfDomain' END AS status FROM embeddings e WHERE vec_id % 100 = 0)"


@query(f"WITH {RESULTS} SELECT round(avg((status = expected_status)::INTEGER), 6) AS status_match_rate FROM results")
def status_match_rate(spark: Spark, sf: str) -> DataFrame:
    return evaluation.status_match_rate(_results(spark, sf))


@query(
    f"WITH {RESULTS} SELECT category, count(*) AS n, sum((status = expected_status)::INTEGER)::BIGINT AS matched, round(avg((status = expected_status)::INTEGER), 6) AS rate, min(position) AS first_position FROM results GROUP BY 1"
)
def ask_report(spark: Spark, sf: str) -> DataFrame:
    return evaluation.ask_report(_results(spark, sf))


def _turns(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.concat(F.lit("q"), "item_id").alias("question_id"), F.col("item_id").alias("position"), "text"
    )


@query(
    "SELECT 'q' || item_id AS question_id, item_id AS position FROM benchmark WHERE item_id > (SELECT max(item_id) FROM benchmark) / 3"
)
def resume_remaining(spark: Spark, sf: str) -> DataFrame:
    rows = _turns(spark, sf)
    last = rows.agg(F.max("position")).first()[0]
    return evaluation.resume_remaining(
        rows, rows.where(F.col("position") <= last / 3)
    ).select("question_id", "position")


@query("SELECT 'q' || item_id AS question_id, item_id AS position FROM benchmark")
def append_completed(spark: Spark, sf: str) -> DataFrame:
    rows = _turns(spark, sf)
    last = rows.agg(F.max("position")).first()[0]
    return evaluation.append_completed(
        rows.where(F.col("position") <= last / 3), rows.where(F.col("position") > last / 3)
    ).select("question_id", "position")


def _old_new(spark: Spark, sf: str) -> tuple[dict, dict]:
    """An index of documents of sources before src5 with two chunks each, and a batch of all
    documents with one chunk each."""
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), "source", F.sha2("text", 256).alias("content_hash")
    )
    chunk = lambda d, i: d.select(
        F.concat("document_id", F.lit(f"-{i}")).alias("chunk_id"), "document_id", F.lit(i).alias("ordinal")
    )
    vector = lambda c, p: c.select(
        "chunk_id", F.lit(p).alias("profile_key"), F.array(F.col("ordinal").cast("float")).alias("embedding")
    )
    old = docs.where("source < 'src5'")
    stamp = lambda d, t: d.select(
        "document_id", "content_hash", F.lit(t).alias("created_at"), F.lit(t).alias("updated_at")
    )
    profile = lambda p: spark.range(1).select(F.lit(p).alias("profile_key"), F.lit(1).alias("dimension"))
    old_chunks, new_chunks = chunk(old, 0).unionByName(chunk(old, 1)), chunk(docs, 0)
    before = {
        "profiles": profile("p1"), "documents": stamp(old, 1), "chunks": old_chunks,
        "embeddings": vector(old_chunks, "p1")
    }
    batch = {
        "profiles": profile("p2"), "documents": stamp(docs, 2), "chunks": new_chunks,
        "embeddings": vector(new_chunks, "p2")
    }
    return before, batch


@query(
    "SELECT doc_id AS document_id, sha256(text) AS content_hash, CASE WHEN source < 'src5' THEN 1 ELSE 2 END AS created_at, 2 AS updated_at FROM documents"
)
def upsert_documents(spark: Spark, sf: str) -> DataFrame:
    old, batch = _old_new(spark, sf)
    return index.upsert_documents(old["documents"], batch["documents"])


@query(
    "SELECT 'local:model-' || label || ':' || len(embedding) AS profile_key, CASE WHEN label >= 4 THEN 'batch' ELSE 'index' END AS origin, max(len(embedding)) AS dimension FROM embeddings GROUP BY 1, 2"
)
def upsert_profiles(spark: Spark, sf: str) -> DataFrame:
    """A profile for each label; the index knows those below 6, the batch brings those from 4 on."""
    rows = table(spark, sf, "embeddings")
    key = T.profile_key(F.lit("local"), F.concat(F.lit("Model-"), "label"), F.size("embedding"))
    profiles = lambda some, origin: rows.where(some).groupBy(key.alias("profile_key")).agg(
        F.max(F.size("embedding")).alias("dimension")
    ).withColumn("origin", F.lit(origin))
    return index.upsert_profiles(profiles("label < 6", "index"), profiles("label >= 4", "batch"))


@query("SELECT doc_id || '-0' AS chunk_id, doc_id AS document_id, 0 AS ordinal FROM documents WHERE source < 'src5'")
def delete_stale_chunks(spark: Spark, sf: str) -> DataFrame:
    old, batch = _old_new(spark, sf)
    return index.delete_stale_chunks(old["chunks"], batch["documents"], batch["chunks"])


@query("SELECT doc_id || '-0' AS chunk_id, doc_id AS document_id, 0 AS ordinal FROM documents")
def upsert_chunks(spark: Spark, sf: str) -> DataFrame:
    old, batch = _old_new(spark, sf)
    return index.upsert_chunks(old["chunks"], batch["documents"], batch["chunks"])


@query("SELECT doc_id || '-0' AS chunk_id, 'p1' AS profile_key FROM documents WHERE source < 'src5'")
def cascade_embeddings(spark: Spark, sf: str) -> DataFrame:
    old, batch = _old_new(spark, sf)
    return index.cascade_embeddings(
        old["embeddings"], index.upsert_chunks(old["chunks"], batch["documents"], batch["chunks"])
    ).select("chunk_id", "profile_key")


SNAPSHOT = "SELECT doc_id || '-0' AS chunk_id, 'p2' AS profile_key FROM documents UNION ALL SELECT doc_id || '-{0}', 'p1' FROM documents WHERE source < 'src5'"


@query(SNAPSHOT.format(0) + " UNION ALL SELECT doc_id || '-1', 'p1' FROM documents WHERE source < 'src5'")
def upsert_embeddings(spark: Spark, sf: str) -> DataFrame:
    old, batch = _old_new(spark, sf)
    return index.upsert_embeddings(old["embeddings"], batch["embeddings"]).select("chunk_id", "profile_key")


@query(SNAPSHOT.format(0))
def apply_index_batch(spark: Spark, sf: str) -> DataFrame:
    """The published snapshot's embeddings after the batch."""
    old, batch = _old_new(spark, sf)
    root = scratch_path(spark, "index")
    index.publish_snapshot(spark, root, old, 1)
    index.apply_index_batch(spark, root, batch, [], 2)
    return index.read_snapshot(spark, root)["embeddings"].select("chunk_id", "profile_key")
