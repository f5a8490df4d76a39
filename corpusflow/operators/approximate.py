"""Approximate nearest neighbours by residual product quantisation.

A vector is coded by the list of its nearest centre and one byte for each four components of what
is left beside the centre. The coded index is stored by list, so a search reads the codes of the
lists that its queries probe, and later the vectors of candidates' lists only. Scores of codes are
sums of a query's inner products with the code books, from tables made once a query. The best few
by these are compared exactly.

Queries come in passes of bounded size, whose vectors are sent to every task; codes are read where
they lie, and no group of rows or queries is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.operators import retrieval
from corpusflow.operators.embedding import norm
from corpusflow.operators.retrieval import _best, _by_id, _rank, _unit
from corpusflow.sources.scratch import materialize, scratch_path

#: Components that share a byte of code, and entries of a code book.
WIDTH, BOOK = 4, 256
#: Bytes of the tables of one pass's queries in a task.
PASS_BYTES = 32 << 20


@dataclass(frozen=True)
class Quantiser:
    """centres: a row a list; books: for each four components the entries that a byte names."""

    centres: np.ndarray
    books: np.ndarray

    def residual(self, unit: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return _cut(unit - self.centres[lists])

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector of length 1."""
        lists = _nearest(unit, self.centres)
        rest = self.residual(unit, lists)
        return lists, np.stack([_nearest(rest[:, m], b) for m, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def tables(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of vectors with the centres, and with each entry of the books."""
        cut = _cut(unit).astype(np.float32)
        return unit @ self.centres.T, np.einsum("qmw,mbw->qmb", cut, self.books.astype(np.float32))


def _cut(rows: np.ndarray) -> np.ndarray:
    """Rows in groups of WIDTH components, with zeros after the last."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % WIDTH))).reshape(len(rows), -1, WIDTH)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (rows @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


def _means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """k means of a bounded sample; with fewer rows than k, some repeat."""
    centres = rows[np.resize(rng.permutation(len(rows)), k)].copy()
    for _ in range(rounds):
        at = _nearest(rows, centres)
        count = np.bincount(at, minlength=k)
        total = np.stack([np.bincount(at, column, k) for column in rows.T], axis=1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def train_quantiser(index: DataFrame, sample: int = 20_000, rows_per_list: int = 64, seed: int = 7) -> Quantiser:
    """Learns lists and books from the `sample` rows with the least id hashes, which come to the
    driver: a bounded number. A list for each rows_per_list rows of the sample."""
    known = index.where("embedding is not null").where(norm(F.col("embedding")) > 0)
    rows = known.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow()
    if not rows.num_rows:
        return Quantiser(np.zeros((0, 0)), np.zeros((0, BOOK, WIDTH)))
    unit, rng = _unit(rows.column(0)), np.random.default_rng(seed)
    centres = _means(unit, max(1, len(unit) // rows_per_list), rng)
    rest = Quantiser(centres, np.zeros((0, BOOK, WIDTH))).residual(unit, _nearest(unit, centres))
    return Quantiser(centres, np.stack([_means(rest[:, m], BOOK, rng) for m in range(rest.shape[1])]))


def code_index(index: DataFrame, quantiser: Quantiser) -> DataFrame:
    """chunk_id, embedding, code and list of every vector but null and zero ones, stored by list.
    Large lists are cut into files of like size, small ones share a task."""
    spark, kind = index.sparkSession, {f.name: f.dataType.simpleString() for f in index.schema}
    sent = spark.sparkContext.broadcast(quantiser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(batch.column(1)) if batch.num_rows else np.zeros((0, 1))
            good = np.flatnonzero(np.isfinite(unit).all(axis=1))
            if len(good):
                lists, codes = sent.value.encode(unit[good])
                at = pa.py_buffer(np.arange(len(good) + 1, dtype=np.int32) * codes.shape[1])
                code = pa.Array.from_buffers(pa.binary(), len(good), [None, at, pa.py_buffer(codes.tobytes())])
                held = pa.array(good)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(held), batch.column(1).take(held), code, pa.array(lists, pa.int32())],
                    names=["chunk_id", "embedding", "code", "list"]
                )

    schema = f"chunk_id {kind['chunk_id']}, embedding {kind['embedding']}, code binary, list int"
    coded = index.where("embedding is not null").select("chunk_id", "embedding").mapInArrow(run, schema)
    path = scratch_path(spark, "ann-codes")
    coded.hint("rebalance", "list").write.partitionBy("list").parquet(path)
    return spark.read.schema(schema).parquet(path)


class _Asked:
    """The queries of one pass, and which of them probe each list."""

    def __init__(self, unit: np.ndarray, quantiser: Quantiser, probes: int):
        self.unit = unit
        self.near, self.tables = quantiser.tables(unit)
        lists = np.argsort(-self.near, axis=1, kind="stable")[:, :probes]
        query = np.repeat(np.arange(len(unit)), lists.shape[1])
        order = np.argsort(lists.ravel(), kind="stable")
        self.query, self.at = query[order], np.searchsorted(lists.ravel()[order], np.arange(self.near.shape[1] + 1))

    def of(self, list_: int) -> np.ndarray:
        return self.query[self.at[list_] : self.at[list_ + 1]]

    @property
    def probed(self) -> list[int]:
        return np.flatnonzero(np.diff(self.at)).tolist()

    def scores(self, queries: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        out = np.repeat(self.near[queries, list_][:, None].astype(np.float32), len(codes), axis=1)
        for m in range(codes.shape[1]):
            out += self.tables[queries, m][:, codes[:, m]]
        return out


def _candidates(coded: DataFrame, asked: _Asked, few: int) -> DataFrame:
    """q, chunk_id and list of each query's `few` best codes."""
    kind, sent = coded.schema["chunk_id"].dataType.simpleString(), coded.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        floors = np.full(len(asked.unit), -np.inf)
        best = np.full((len(asked.unit), few), -np.inf)
        for batch in batches:
            order = _by_id(batch.column(0)) if batch.num_rows else np.zeros(0, int)
            ids, lists = batch.column(0).take(pa.array(order)), batch.column(2).to_numpy()[order]
            codes = np.frombuffer(b"".join(batch.column(1).take(pa.array(order)).to_pylist()), np.uint8)
            codes = codes.reshape(len(order), -1)
            for list_ in np.unique(lists).tolist():
                here, queries = np.flatnonzero(lists == list_), asked.of(list_)
                step = max(1, retrieval.TILE // max(1, len(here)))
                for i in range(0, len(queries), step):
                    some = queries[i : i + step]
                    scores = asked.scores(some, list_, codes[here])
                    row, column = _best(scores, few, floors[some])
                    if not len(row):
                        continue
                    found = scores[row, column]
                    both = np.full((len(some), 2 * few), -np.inf)
                    both[:, :few], place = best[some], np.arange(len(row)) - np.searchsorted(row, row)
                    both[row, few + place] = found
                    best[some] = np.sort(both, axis=1)[:, few:]
                    floors[some] = best[some, 0]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some[row], pa.int32()), ids.take(pa.array(here[column])),
                            pa.array(found, pa.float64()), pa.array(np.full(len(row), list_), pa.int32())
                        ], names=["query_id", "chunk_id", "similarity", "list"]
                    )

    rows = coded.where(F.col("list").isin(asked.probed)).select("chunk_id", "code", "list")
    scored = rows.mapInArrow(run, f"query_id int, chunk_id {kind}, similarity double, list int")
    return _rank(scored, few, 6).select(F.col("query_id").alias("q"), "chunk_id", "list")


def _exact(coded: DataFrame, found: DataFrame, asked: _Asked, ids: pa.Array, kind: str) -> DataFrame:
    """query_id, chunk_id and similarity of candidates, whose vectors are read from their lists."""
    held = {f.name: f.dataType.simpleString() for f in coded.schema}
    sent = coded.sparkSession.sparkContext.broadcast((asked.unit, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids = sent.value
        for batch in batches:
            if batch.num_rows:
                q = batch.column(0).to_numpy()
                score = np.round(np.einsum("ij,ij->i", unit[q], _unit(batch.column(2))), retrieval.RANK_DIGITS)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(q)), batch.column(1), pa.array(score)], names=["query_id", "chunk_id", "similarity"]
                )

    lists = [r.list for r in found.select("list").distinct().collect()]  # as many as there are lists
    vectors = coded.where(F.col("list").isin(lists)).select("chunk_id", "list", "embedding")
    # A pass has a bounded number of queries, and each of them a fixed number of candidates.
    met = vectors.join(F.broadcast(found), ["chunk_id", "list"]).select("q", "chunk_id", "embedding")
    return met.mapInArrow(run, f"query_id {kind}, chunk_id {held['chunk_id']}, similarity double")


def retrieve_approx(
    queries: DataFrame, index: DataFrame, k: int, probe_share: float = 0.5, rerank: int = 16, digits: int = 6,
    quantiser: Quantiser | None = None, coded: DataFrame | None = None
) -> DataFrame:
    """Approximate top k, as retrieve_topk returns it: the rerank * k best codes among the probed
    share of the lists are compared exactly. Every index row is coded; quantiser and coded (see
    train_quantiser and code_index) may be those of an earlier call."""
    spark = queries.sparkSession
    quantiser = quantiser or train_quantiser(index)
    kind = {f.name: f.dataType.simpleString() for f in [*queries.schema, *index.schema]}
    schema = f"query_id {kind['query_id']}, chunk_id {kind['chunk_id']}, similarity double"
    if not len(quantiser.centres):
        return _rank(spark.createDataFrame([], schema), k, digits)
    coded = code_index(index, quantiser) if coded is None else coded
    known = queries.where("embedding is not null").select("query_id", "embedding")
    passes = max(1, -(-known.count() * quantiser.books.size // WIDTH * 4 // PASS_BYTES))
    found = []
    for i in range(passes):
        block = known.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow()
        unit = _unit(block.column("embedding")) if block.num_rows else np.zeros((0, 1))
        good = np.flatnonzero(np.isfinite(unit).all(axis=1))
        if len(good):
            asked = _Asked(unit[good], quantiser, max(1, round(probe_share * len(quantiser.centres))))
            ids = block.column("query_id").combine_chunks().take(pa.array(good))
            few = materialize(_candidates(coded, asked, rerank * k), "ann-candidates")
            one = _exact(coded, few, asked, ids, kind["query_id"])
            found.append(one if passes == 1 else materialize(_rank(one, k, retrieval.RANK_DIGITS).drop("initial_rank"), "ann-pass"))
    return _rank(reduce(DataFrame.unionByName, found, spark.createDataFrame([], schema)), k, digits)
