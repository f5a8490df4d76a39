"""Exact nearest neighbours by cosine similarity, for tables of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.operators.embedding import norm
from corpusflow.sources.scratch import materialize

#: Bytes of the queries' vectors that one pass over the index takes, as sent to every task.
PASS_BYTES = 32 << 20
#: Scores of one tile: queries of a pass times rows of a slice. A task has few tables of this size at once.
TILE = 512 << 10
#: Components of the rows that a task takes from a batch at once, whatever the vectors' length.
SLICE = 1 << 20
#: Decimals of a similarity that count for its rank; more would be the noise of its sum.
RANK_DIGITS = 12
#: Directions whose part of a product is taken first; the rest is bounded by what is left of both lengths.
HEAD = 16
#: Rows of a batch that are multiplied first, so that the others meet a floor.
FIRST_ROWS = 1024
#: Room for the error of bounds, which are sums of floats of 32 bits.
SLACK = 1e-5


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine as a double; null for a zero vector."""
    dot = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x
    )
    return F.try_divide(dot, norm(a) * norm(b))


def filter_profile(embeddings: DataFrame, profile_key: str, dimension: int) -> DataFrame:
    """One profile's vectors; with profile_key as partition column only its files are read."""
    return embeddings.where((F.col("profile_key") == profile_key) & (F.col("dimension") == dimension))


def _rank(scored: DataFrame, k: int, digits: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    ranked = scored.withColumn("initial_rank", F.row_number().over(best)).where(F.col("initial_rank") <= k)
    return ranked.withColumn("similarity", F.round("similarity", digits))


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of length 1; not-a-numbers for zero vectors."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    table = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return table / np.linalg.norm(table, axis=1, keepdims=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of SLICE components at most (or of one row); column 1 has the vectors."""
    for batch in batches:
        width = len(batch.column(1).flatten()) // max(1, batch.num_rows)
        step = max(1, SLICE // max(1, width))
        yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))


def _best(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row that reach its floor; of equal scores the
    first columns."""
    k = min(k, scores.shape[1])
    least = np.maximum(np.partition(scores, -k, axis=1)[:, -k], floor)
    met = (scores >= least[:, None]) & (scores > -np.inf)
    for i in np.flatnonzero(met.sum(1) > k):  # ties at the end
        at = np.flatnonzero(met[i])
        met[i] = False
        met[i, at[np.argsort(-scores[i, at], kind="stable")[:k]]] = True
    return np.nonzero(met)


def _by_id(column: pa.Array) -> np.ndarray:
    """Order of the ids, so that equal scores go to the least id."""
    return np.argsort(np.array(column.to_pylist(), object if pa.types.is_string(column.type) else None), kind="stable")


def directions(vectors: np.ndarray) -> np.ndarray | None:
    """The HEAD orthonormal directions that hold most of the queries' lengths, as columns; None where too
    few queries or components are given for bounds to pay."""
    if vectors.shape[0] <= 2 * HEAD or vectors.shape[1] < 2 * HEAD:
        return None
    known = np.nan_to_num(vectors)
    return np.linalg.eigh(known.T @ known)[1][:, -HEAD:]


def _headed(unit: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Parts of unit vectors along the directions, then the length of what is left: the product of
    two such rows is no less than that of their vectors."""
    head = unit @ along
    left = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", head, head), 0))
    return np.column_stack([head, left]).astype(np.float32)


def _exact(vectors: np.ndarray, unit: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Products of the pairs (row, column), some at a time."""
    step = max(1, TILE // vectors.shape[1])
    parts = [
        np.einsum("ij,ij->i", vectors[row[i : i + step]], unit[column[i : i + step]]) for i in range(0, len(row), step)
    ]
    return np.round(np.concatenate(parts), RANK_DIGITS) if parts else np.zeros(0)


def _first_of_each(row: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, rows in order; of equal scores the first ones."""
    order = np.lexsort((np.arange(len(row)), -scores, row))
    own = row[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


def _scored(
    ids: pa.Array, vectors: np.ndarray, chunk: pa.Array, unit: np.ndarray, k: int, threshold: float | None, digits: int,
    floors: np.ndarray, along: np.ndarray | None, heads: np.ndarray | None, work: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """query_id, chunk_id and similarity of each query's k best chunks of a batch, tile by tile.
    floors: each query's k-th score so far (columns are its k best), which batches raise. along and
    heads: directions and the queries' parts along them. work: pairs, and those multiplied in full."""
    order = _by_id(chunk)
    chunk, unit = chunk.take(pa.array(order)), unit[order]
    own_heads = None if along is None else _headed(unit, along)
    low_end = -np.inf if threshold is None else threshold - 10.0**-digits
    cuts = [0, len(chunk)] if along is None else sorted({0, min(FIRST_ROWS, len(chunk)), len(chunk)})
    for first, stop in zip(cuts, cuts[1:], strict=False):
        rows = unit[first:stop]
        step = max(1, TILE // max(1, len(rows)))
        for i in range(0, len(ids), step):
            mine, floor = vectors[i : i + step], np.maximum(floors[i : i + step, 0], low_end)
            work[0] += len(mine) * len(rows)
            met = None
            if along is not None and np.isfinite(floor).any():
                with np.errstate(invalid="ignore"):
                    bound = heads[i : i + step] @ own_heads[first:stop].T
                met = np.flatnonzero(bound >= (floor - SLACK).astype(np.float32)[:, None])
            if met is not None and 8 * len(met) < len(mine) * len(rows):
                work[1] += len(met)
                row, column = np.divmod(met, len(rows))
                found = _exact(mine, rows, row, column)
                kept = found >= floor[row]
                if threshold is not None:
                    kept &= np.round(found, digits) >= threshold
                row, column, found = row[kept], column[kept], found[kept]
                best = _first_of_each(row, found, k)
                row, column, found = row[best], column[best], found[best]
            else:
                work[1] += len(mine) * len(rows)
                with np.errstate(invalid="ignore"):
                    scores = mine @ rows.T
                    np.round(scores, RANK_DIGITS, out=scores)
                low = np.isnan(scores)
                if threshold is not None:
                    low |= np.round(scores, digits) < threshold
                scores[low] = -np.inf
                row, column = _best(scores, k, floors[i : i + step, 0])
                found = scores[row, column]
            if len(row):
                both = np.full((len(mine), 2 * k), -np.inf)
                both[:, :k] = floors[i : i + step]
                both[row, k + np.arange(len(row)) - np.searchsorted(row, row)] = found
                floors[i : i + step] = np.sort(both, axis=1)[:, k:]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + i)), chunk.take(pa.array(column + first)), pa.array(found)],
                    names=["query_id", "chunk_id", "similarity"]
                )


def topk_work(queries: DataFrame, index: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """pairs of queries and chunks that retrieve_topk looks at, those it multiplies in full, and the share
    that bounds skip: one row a task. Queries are those of one pass (PASS_BYTES)."""
    block = queries.where("embedding is not null").select("query_id", "embedding").toArrow()
    ids, vectors = block.column("query_id").combine_chunks(), _unit(block.column("embedding"))
    along = directions(vectors)
    sent = queries.sparkSession.sparkContext.broadcast(
        (ids, vectors, along, None if along is None else _headed(vectors, along))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, along, heads = sent.value
        floors, work = np.full((len(ids), k), -np.inf), np.zeros(2, np.int64)
        for rows in _slices(batches):
            own = rows.column(0), _unit(rows.column(1)), k, threshold, 6, floors, along, heads, work
            for _ in _scored(ids, vectors, *own):
                pass
        yield pa.RecordBatch.from_arrays([pa.array(work[:1]), pa.array(work[1:])], names=["pairs", "multiplied"])

    found = index.where("embedding is not null").select("chunk_id", "embedding").mapInArrow(run, "pairs long, multiplied long")
    return found.withColumn("skipped", F.try_divide(F.col("pairs") - F.col("multiplied"), F.col("pairs")))


def retrieve_topk(
    queries: DataFrame, index: DataFrame, k: int, threshold: float | None = None, digits: int = 6
) -> DataFrame:
    """query_id, chunk_id, similarity and initial_rank of the k nearest chunks of each query.

    queries: query_id, embedding; index: chunk_id, embedding. Ordered by similarity descending, ties
    by chunk_id; similarities are rounded after that, and rounded ones below the threshold are left
    out (null keeps all).

    A pass over the index takes queries of PASS_BYTES at most, which are sent to every task; if
    there are more, each pass's result is written before the next one's queries are fetched. A task
    multiplies them with slices of the index tile by tile, and passes on what may be among a
    query's k best; no pair of rows is ever formed outside a task. Beside the pass's queries a task
    holds a few tables of TILE scores or SLICE components, however many rows and queries there are.
    """
    spark = queries.sparkSession
    queries = queries.where("embedding is not null").select("query_id", "embedding")
    size = queries.agg(F.coalesce(F.sum(4 * F.size("embedding")), F.lit(0)).alias("n")).first().n
    passes = max(1, -(-size // PASS_BYTES))
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *index.schema]}
    schema = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, similarity double"
    rows = index.where("embedding is not null").select("chunk_id", "embedding")

    def one(block: DataFrame) -> DataFrame:
        block = block.toArrow()
        if not block.num_rows:
            return spark.createDataFrame([], schema)
        vectors = _unit(block.column("embedding"))
        along = directions(vectors)
        heads = None if along is None else _headed(vectors, along)
        sent = spark.sparkContext.broadcast((block.column("query_id").combine_chunks(), vectors, along, heads))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, along, heads = sent.value
            floors, work = np.full((len(ids), k), -np.inf), np.zeros(2, np.int64)
            for part in _slices(batches):
                own = part.column(0), _unit(part.column(1)), k, threshold, digits, floors, along, heads, work
                yield from _scored(ids, vectors, *own)

        found = rows.mapInArrow(run, schema)
        if passes == 1:
            return found
        found = materialize(_rank(found, k, RANK_DIGITS).drop("initial_rank"), "topk")
        sent.destroy()
        return found

    dealt = F.pmod(F.xxhash64("query_id"), F.lit(passes))
    return _rank(
        reduce(
            DataFrame.unionByName, [one(queries if passes == 1 else queries.where(dealt == i)) for i in range(passes)]
        ),
        k, digits
    )


def join_chunk_metadata(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds the chunk's and its document's columns after ranking, so text never passes a sort."""
    return ranked.join(chunks.hint("merge"), "chunk_id").join(documents.hint("merge"), "document_id")


def semantic_search(
    questions: DataFrame, embed_fn: Callable[[DataFrame], DataFrame], index: DataFrame, k: int,
    threshold: float | None = None
) -> DataFrame:
    """Embeds questions (question_id, text) by embed_fn, which adds `embedding`, then retrieves."""
    return retrieve_topk(
        embed_fn(questions).select(F.col("question_id").alias("query_id"), "embedding"), index, k, threshold
    )


def ann_recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id and recall: the share of the exact chunks that the approximate result has."""
    met = approx.select("query_id", "chunk_id", F.lit(1).alias("met"))
    return exact.join(met.hint("merge"), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.round(F.avg(F.coalesce("met", F.lit(0))), 6).alias("recall")
    )


def threshold_sweep(candidates: DataFrame, thresholds: list[float]) -> DataFrame:
    """threshold, kept rows, and questions answered or refused, for each threshold."""
    each = candidates.select("query_id", "similarity", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    per = each.groupBy("threshold", "query_id").agg(F.count_if(F.col("similarity") >= F.col("threshold")).alias("n"))
    return per.groupBy("threshold").agg(
        F.sum("n").alias("kept"), F.count_if(F.col("n") > 0).alias("answered"),
        F.count_if(F.col("n") == 0).alias("refused")
    )
