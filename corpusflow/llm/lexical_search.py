"""Ranked lexical search by bit-sliced Bloom signatures.

The index has a row for each block of documents. Documents of like size share a block, whose
signatures are as wide as its largest document needs. A document's terms, and each power of two
that a term's occurrences reach, set bits; the bits are stored in slices, one bitmap over the
block's documents for each bit position. ANDing a term's slices gives a bitmap that may hold
too many documents, never too few.

A search adds up, for each query and document, the weights of the terms whose bitmaps have the
document, each with the most that its power of two allows at the document's length: an upper
bound of the score. Documents whose bound is below the k-th best score that the task has seen
are excluded; all others are scored exactly from the terms and counts stored in the same row.
Corpus statistics come first, from the whole index. Each task passes on k rows a query.

Terms are told apart by 64-bit hashes. Queries are taken in passes of bounded size.

Defined results: null texts and texts without terms are never found and don't count as documents;
queries without terms find nothing; each query row is a query of its own, even if ids repeat or
are null; documents that repeat are found each; of equal scores the smaller id comes first, a
null id last; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.scan import distinct, mix, scans
from corpusflow.sources.batches import bound_batches
from corpusflow.sources.scratch import materialize

U = np.uint64
#: Bytes that aren't in terms: ASCII other than letters and digits.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    SEPARATOR[a : b + 1] = False
#: Powers of two of a term's occurrences that have bits: 1, 2, 4 and 8 or more.
LEVELS = 4
_LEVEL, _TURN = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)
#: (query, document) entries that are added up at once.
STEP = 1 << 18
#: Bits of terms' bitmaps that are unpacked at once.
CELLS = 1 << 20
#: Entries of a block's largest document, at most so many times those of its smallest or of a document of so many.
SPREAD, SMALL = 4, 64
#: Bytes of a row group of the stored index.
ROW_GROUP = 4 << 20


@dataclass(frozen=True)
class Signatures:
    """Blocks of at most `docs` documents of like size and `terms` terms (but for one larger document), with
    `bits` bits or more for each entry of the largest one, of which each entry sets `hashes`."""

    docs: int = 1024
    terms: int = 1 << 16
    bits: int = 10
    hashes: int = 3


def positions(terms: np.ndarray, level: int, width: int, hashes: int) -> np.ndarray:
    """Bits of terms at a level: a row a term."""
    base = terms.view(U)[:, None] + np.full(1, level, U) * _LEVEL
    return (mix(base + np.arange(1, hashes + 1, dtype=U) * _TURN) & U(width - 1)).astype(np.int64)


def slices(doc: np.ndarray, terms: np.ndarray, tf: np.ndarray, n: int, width: int, hashes: int) -> np.ndarray:
    """Bit slices of n documents: row i has the bitmap of bit i, eight documents a byte."""
    out = np.zeros((width, -(-n // 8)), np.uint8)
    for level in range(LEVELS):
        met = tf >= 1 << level
        at, d = positions(terms[met], level, width, hashes), doc[met]
        for i in range(hashes):
            np.bitwise_or.at(out, (at[:, i], d >> 3), (1 << (d & 7)).astype(np.uint8))
    return out


@dataclass
class Block:
    """ids and lengths of documents; terms and tf of document i from starts[i] to starts[i + 1]."""

    ids: list
    n: np.ndarray
    width: int
    bits: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    tf: np.ndarray


def _blocks(column: pa.Array, how: Signatures) -> Iterator[tuple]:
    """Documents (places in the column), lengths, width, slices, starts, terms and tf of each block."""
    doc, terms, tf, lengths, firsts = [], [], [], [], []
    for scan in scans(column, SEPARATOR):
        d, h, c = distinct(scan.doc, scan.word_hashes(lower=True))
        doc.append(d + scan.first)
        terms.append(h.view(np.int64))
        tf.append(c.astype(np.int32))
        lengths.append(scan.per_doc(scan.doc))
        firsts.append(scan.first)
    if not doc:
        return
    doc, terms, tf, lengths = map(np.concatenate, (doc, terms, tf, lengths))
    count = np.bincount(doc, minlength=len(lengths))
    entries = count + sum(np.bincount(doc[tf >= 1 << x], minlength=len(lengths)) for x in range(1, LEVELS))
    begin = np.concatenate([[0], np.cumsum(count)])
    order = np.argsort(entries, kind="stable")
    order = order[count[order] > 0]
    i = 0
    while i < len(order):
        some = order[i : i + how.docs]
        some = some[: max(1, int(np.searchsorted(np.cumsum(count[some]), how.terms, "right")))]
        some = some[: int(np.searchsorted(entries[some], SPREAD * max(SMALL, int(entries[some[0]])), "right"))]
        i += len(some)
        size = count[some]
        starts = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin[some] - starts[:-1], size) + np.arange(starts[-1])
        width = 1 << max(6, math.ceil(math.log2(how.bits * int(entries[some].max()))))
        local = np.repeat(np.arange(len(some)), size)
        yield some, lengths[some], width, slices(local, terms[at], tf[at], len(some), width, how.hashes), starts, terms[at], tf[at]


def build_index(docs: DataFrame, how: Signatures = Signatures()) -> DataFrame:
    """The stored index of documents (doc_id, text): a row a block. Rows are large, so they are written in
    small row groups, one or a few of which a task holds while it writes or reads; numbers are
    stored as bytes: starts in 64 bits, terms in 64, tf in 32."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, n, width, bits, starts, terms, tf in _blocks(batch.column(1), how):
                one = lambda values, t: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(t))
                ids = batch.column(0).take(pa.array(some))
                raw = lambda values: pa.array([values.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([len(some)], pa.int64()), pa.array([int(n.sum())], pa.int64()), one(ids, ids.type),
                        one(pa.array(n), pa.int64()), pa.array([width], pa.int32()), raw(bits), raw(starts), raw(terms), raw(tf)
                    ], names=["n_docs", "n_terms", "ids", "n", "width", "bits", "starts", "terms", "tf"]
                )

    return materialize(
        docs.select("doc_id", "text").mapInArrow(
            run, f"n_docs long, n_terms long, ids array<{kind}>, n array<long>, width int, bits binary, "
            "starts binary, terms binary, tf binary"
        ), "signatures", row_group=ROW_GROUP
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """q (a number of its own), item_id and terms, the distinct hashes, of queries (item_id, text)."""
    kind = queries.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[int]] = []
            for scan in scans(batch.column(2), SEPARATOR):
                d, h, _ = distinct(scan.doc, scan.word_hashes(lower=True))
                out += [x.tolist() for x in np.split(h.view(np.int64), np.searchsorted(d, np.arange(1, scan.n)))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], names=["q", "item_id", "terms"]
            )

    numbered = materialize(queries.select(F.monotonically_increasing_id().alias("q"), "item_id", "text"), "search-queries")
    return materialize(numbered.mapInArrow(run, f"q long, item_id {kind}, terms array<long>"), "query-terms")


@dataclass
class Lookup:
    """Sorted terms with their weights; term t is in queries of[at[t]:at[t + 1]]."""

    terms: np.ndarray
    weight: np.ndarray
    at: np.ndarray
    of: np.ndarray
    n: int

    def add(self, t: np.ndarray, d: np.ndarray, value: np.ndarray, total: np.ndarray) -> None:
        """Adds the value of each (term, document) to the terms' queries in total: queries x
        documents. Sums stay below 2^53 up to 100,000 terms a query, and so are exact."""
        each, flat = self.at[t + 1] - self.at[t], total.reshape(-1)
        cut = np.searchsorted(np.cumsum(each), np.arange(STEP, each.sum() + STEP, STEP), "left") + 1
        for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
            e = each[a:b]
            if not len(e):
                continue
            stop = np.cumsum(e)
            query = self.of[np.repeat(self.at[t[a:b]] - stop + e, e) + np.arange(stop[-1])]
            np.add.at(flat, query * total.shape[1] + np.repeat(d[a:b], e), np.repeat(value[a:b], e).astype(float))


def factor(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def bounds(block: Block, look: Lookup, m: np.ndarray, hashes: int) -> np.ndarray:
    """Upper bounds of all queries' scores in a block's documents, from its slices alone; some terms
    at a time."""
    width = len(block.n)
    total, step = np.zeros((look.n, width)), max(1, CELLS // width)
    for i in range(0, len(look.terms), step):
        before = 0
        for level in range(LEVELS):
            at = positions(look.terms[i : i + step], level, block.width, hashes)
            maps = block.bits[at[:, 0]]
            for k in range(1, hashes):
                maps &= block.bits[at[:, k]]
            some = np.flatnonzero(maps.any(axis=1))
            if not len(some):
                break
            t, d = np.nonzero(np.unpackbits(maps[some], axis=1, count=width, bitorder="little"))
            most = factor((2 << level) - 1, m) if level < LEVELS - 1 else np.full(width, 1_000_000)
            look.add(some[t] + i, d, look.weight[some + i][t] * (most - before)[d], total)
            before = most
    return total


def exact(block: Block, look: Lookup, m: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Scores of the wanted (query, document) pairs; only those documents' terms are read."""
    docs = np.flatnonzero(wanted.any(axis=0))
    size = block.starts[docs + 1] - block.starts[docs]
    stop = np.cumsum(size)
    place = np.repeat(block.starts[docs] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)
    d, terms, tf = np.repeat(docs, size), block.terms[place], block.tf[place]
    t = np.minimum(np.searchsorted(look.terms, terms), len(look.terms) - 1)
    met = look.terms[t] == terms
    t, d, tf = t[met], d[met], tf[met]
    total = np.zeros(wanted.shape)
    look.add(t, d, look.weight[t] * factor(tf.astype(np.int64), m[d]), total)
    np.putmask(total, ~wanted, -1)
    return total


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.floor, self.rows = k, np.ones(n), [[] for _ in range(n)]

    def take(self, scores: np.ndarray, ids: list) -> None:
        q, d = np.nonzero(scores >= self.floor[:, None])
        for a in np.flatnonzero(np.diff(q, prepend=-1)).tolist():
            query = q[a]
            mine = d[a : np.searchsorted(q, query, "right")]
            rows = self.rows[query] + [(-int(scores[query, i]), ids[i] is None, ids[i]) for i in mine.tolist()]
            self.rows[query] = sorted(rows)[: self.k]
            if len(self.rows[query]) == self.k:
                self.floor[query] = max(1, -self.rows[query][-1][0])


def search_block(block: Block, look: Lookup, m: np.ndarray, best: Best, hashes: int) -> int:
    """Adds a block's documents to the best; returns how many pairs were scored. The k highest
    bounds of each query are scored first, for they raise its floor."""
    bound, scored = bounds(block, look, m, hashes), 0
    left = bound >= best.floor[:, None]
    k = min(best.k, len(block.n))
    high = np.concatenate([np.partition(bound[i : i + 64], -k, axis=1)[:, -k] for i in range(0, len(bound), 64)])[:, None]
    for first in (True, False):
        wanted = left & (bound >= high) if first else left & (bound < high) & (bound >= best.floor[:, None])
        if wanted.any():
            best.take(exact(block, look, m, wanted), block.ids)
            scored += int(wanted.sum())
    return scored


def _read(batch: pa.RecordBatch, i: int) -> Block:
    part = {n: batch.column(k).slice(i, 1) for k, n in enumerate(batch.schema.names)}
    flat = lambda n: part[n].flatten().to_numpy(zero_copy_only=False)
    width = part["width"][0].as_py()
    raw = lambda n, kind: np.frombuffer(part[n][0].as_buffer(), kind)
    return Block(
        part["ids"].flatten().to_pylist(), flat("n"), width, raw("bits", np.uint8).reshape(width, -1),
        raw("starts", np.int64), raw("terms", np.int64), raw("tf", np.int32)
    )


def document_frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the (sorted) terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for here in (np.frombuffer(x.as_buffer(), np.int64) for batch in batches for x in batch.column(0)):
            at = np.minimum(np.searchsorted(terms, here), len(terms) - 1)
            total += np.bincount(at[terms[at] == here], minlength=len(terms))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[some]), pa.array(total[some])], names=["term", "df"])

    found = index.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in found.collect()}


def _pass(index: DataFrame, asked: DataFrame, n: int, length: int, k: int, hashes: int) -> DataFrame:
    """q, doc_id and score: the k best of each task for the queries of one pass, which are collected."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    rows = asked.collect()
    terms = np.unique(np.array([t for r in rows for t in r.terms], np.int64))
    df = document_frequencies(index, terms) if len(terms) else {}
    terms = np.array(sorted(df), np.int64)
    if not len(terms):
        return index.sparkSession.createDataFrame([], f"q long, doc_id {kind}, score long")
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms.tolist()], np.int64)
    pairs = np.array([(np.searchsorted(terms, t), q) for q, r in enumerate(rows) for t in r.terms if t in df], np.int64)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    look = Lookup(terms, weight, np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1], len(rows))
    sent = index.sparkSession.sparkContext.broadcast((look, np.array([r.q for r in rows], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, number = sent.value
        best, kept = Best(look.n, k), None
        for batch in batches:
            kept = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                block = _read(batch, i)
                search_block(block, look, 10 + (90 * block.n * n) // length, best, hashes)
        if kept is not None:
            found = [(number[q], x[2], -x[0]) for q, rows in enumerate(best.rows) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], kept),
                    pa.array([x[2] for x in found], pa.int64())
                ], names=["q", "doc_id", "score"]
            )

    return index.select("ids", "n", "width", "bits", "starts", "terms", "tf").mapInArrow(
        run, f"q long, doc_id {kind}, score long"
    )


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, pass_queries: int = 2048, pass_terms: int = 1 << 18,
    how: Signatures = Signatures()
) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents with a score above 0 of each query
    (item_id, text). A pass takes about pass_queries queries and pass_terms terms, which are sent to
    every task; it reads the index twice, once for its terms' document frequencies."""
    bound_batches(index.sparkSession)
    asked = query_terms(queries)
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("terms")).first()
    total = index.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")
    ).first()
    passes = max(1, -(-size.n // pass_queries), -(-size.terms // pass_terms))
    dealt = F.pmod(F.xxhash64("q"), F.lit(passes))
    found = [_pass(index, asked.where(dealt == i), total.n, total.terms, k, how.hashes) for i in range(passes)]
    if passes > 1:
        found = [materialize(f, "search-pass") for f in found]
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(asked.select("q", "item_id").hint("merge"), "q").select("item_id", "rank", "doc_id", "score")
