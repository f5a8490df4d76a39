"""Quality rules by distribution divergence.

A document's histograms of character classes and of common words are compared with the
histograms of each language by the Jensen-Shannon distance (the root of the divergence in
bits, 0 to 1). A document is kept if it is near at least one language in both respects.

Defined results: null and empty texts have no words and fail the base rule; a document under
the minimum length isn't judged by histograms (the base rule rejects it); rows that repeat are
judged each for itself; without any labelled language only the base rule decides; columns
beyond doc_id, text and lang are passed through by `filter_documents` and never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.scan import SPACE, Scan, distinct, scans, windows
from corpusflow.sources.batches import bound_batches
from corpusflow.sources.scratch import materialize

#: The symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
#: Character classes, in order: lower case, upper case, digit, space, newline, sentence
#: punctuation, symbols, other ASCII, code points outside ASCII.
CLASSES = 9
_class = np.full(256, 7, np.int64)
_class[97:123], _class[65:91], _class[48:58] = 0, 1, 2
_class[[32, 9]], _class[10] = 3, 4
_class[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_class[[ord(c) for c in SYMBOLS]] = 6
_class[192:] = 8
_class[128:192] = -1  # continuation bytes aren't characters
CLASS = _class


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. Below min_words nothing but the base rule judges; below full_words the
    limits of both distances grow to widen more. Labelled prose of 100 words or more stays below 0.23
    in classes and 0.25 in words, and of 50 to 100 words below 0.28 and 0.32; text with none of a
    language's common words lies at 0.32 at least."""

    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 16
    class_distance: float = 0.28
    word_distance: float = 0.30
    full_words: int = 100
    widen: float = 0.06

    def wider(self, n_words: np.ndarray) -> np.ndarray:
        """What short texts get on top of either limit."""
        return self.widen * np.clip((self.full_words - n_words) / (self.full_words - self.min_words), 0, 1)


@dataclass
class References:
    """Histograms of each language: classes (languages x CLASSES), the common words' hashes and
    words (languages x common words and one bin for all others)."""

    langs: list[str] = field(default_factory=list)
    classes: np.ndarray | None = None
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    words: np.ndarray | None = None


#: Distinct words of a language that a task holds before it passes their counts on.
HELD = 1 << 20


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: of every word (its hash), and, with a null word, of all words and of
    the character classes."""
    words: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    classes: dict[str, np.ndarray] = {}

    def rows(lang: str, word: pa.Array, n: np.ndarray, counts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(n), pa.string()), word, pa.array(n), counts], names=["lang", "word", "n", "counts"]
        )

    def passed(lang: str) -> pa.RecordBatch:
        h, n = words.pop(lang)
        return rows(lang, pa.array(h.view(np.int64)), n, pa.nulls(len(n), pa.list_(pa.int64())))

    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for scan in scans(batch.column(0)):
            own, hashes, counts = langs[scan.first : scan.first + scan.n], scan.word_hashes(lower=False), class_histograms(scan)
            for lang in set(own):
                h, n = np.unique(hashes[(own == lang)[scan.doc]], return_counts=True)
                if lang in words:
                    before, often = words[lang]
                    h, at = np.unique(np.concatenate([h, before]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([n, often])).astype(np.int64)
                words[lang] = h, n
                classes[lang] = classes.get(lang, 0) + counts[own == lang].sum(0)
                if len(h) > HELD:
                    yield passed(lang)
    for lang in list(words):
        yield passed(lang)
    for lang, n in classes.items():
        yield rows(lang, pa.nulls(1, pa.int64()), np.zeros(1, np.int64), pa.array([n.tolist()], pa.list_(pa.int64())))


def _columns(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Index of each word in the (sorted) vocabulary; its length for any other word."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
    return np.where(
        vocabulary[at] == hashes, at, len(vocabulary)
    ) if len(vocabulary) else np.zeros(len(hashes), np.int64)


def class_histograms(scan: Scan) -> np.ndarray:
    """Documents x CLASSES counts of characters."""
    kind = CLASS[scan.data]
    doc = np.repeat(np.arange(scan.n), np.diff(scan.offsets))
    seen = kind >= 0
    return np.bincount(doc[seen] * CLASSES + kind[seen], minlength=scan.n * CLASSES).reshape(scan.n, CLASSES)


def learn_references(docs: DataFrame, rules: Rules = Rules()) -> References:
    """Histograms over all documents with a language, from exact counts of all their words, so
    they don't depend on partitions. What comes to the driver is a row for each language and common
    word; equally common words are taken by hash."""
    bound_batches(docs.sparkSession)
    known = docs.where("lang is not null and text is not null").select("text", "lang")
    counted = known.mapInArrow(_counts, "lang string, word long, n long, counts array<long>")
    sums = [F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(CLASSES)]
    counted = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n"), *sums), "quality-words")
    classes = {r.lang: [r[f"c{i}"] for i in range(CLASSES)] for r in counted.where("word is null").collect()}
    total = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(lang for lang, counts in classes.items() if sum(counts))
    if not langs:
        return References()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = counted.where("word is not null").select("lang", "word", "n").withColumn("rank", rank)
    rows = common.where(F.col("rank") <= rules.common_words).collect()
    vocabulary = np.unique(np.array([r.word for r in rows], np.int64).view(np.uint64))
    words = np.zeros((len(langs), len(vocabulary) + 1))
    for r in rows:
        if r.lang in langs:
            words[
                langs.index(r.lang), np.searchsorted(vocabulary, np.int64(r.word).view(np.uint64))
            ] = r.n / total[r.lang]
    words[:, -1] = 1 - words.sum(1)
    table = np.array([classes[x] for x in langs], float)
    return References(langs, table / table.sum(1, keepdims=True), vocabulary, words)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance of each row of p from q: the root of the divergence in bits."""
    m = (p + q) / 2

    def half(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(1) / 2

    return np.sqrt(np.clip(half(p) + half(np.broadcast_to(q, p.shape)), 0, 1))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(1, keepdims=True), 1)


def measure(scan: Scan, refs: References, rules: Rules) -> dict[str, np.ndarray]:
    """All columns of the verdict for the documents of one scan."""
    n_words = scan.per_doc(scan.doc)
    character = (scan.data & 0xC0) != 0x80
    symbol = np.isin(scan.data, np.frombuffer(SYMBOLS.encode(), np.uint8))
    hashes = scan.word_hashes(lower=False)

    start, stop, line_doc = scan.lines()
    inside = np.concatenate([[0], np.cumsum(~SPACE[scan.data])])
    worded = inside[stop] > inside[start]
    start, stop, line_doc = start[worded], stop[worded], line_doc[worded]
    n_lines = scan.per_doc(line_doc)
    kinds, _, _ = distinct(line_doc, scan.hashes(start, stop, lower=False))

    h, first = windows(scan, hashes, 3)
    order = np.lexsort((h, scan.doc[first]))
    h, first = h[order], first[order]
    same = (h[1:] == h[:-1]) & (scan.doc[first[1:]] == scan.doc[first[:-1]])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    covered = np.zeros(len(scan.start), bool)
    for i in range(3):
        covered[first[twice] + i] = True
    out = {
        "n_words": n_words,
        "word_chars": scan.bytes_per_doc(character & ~SPACE[scan.data]),
        "n_symbols": scan.bytes_per_doc(symbol),
        "n_dup_lines": n_lines - scan.per_doc(kinds),
        "n_repeat_words": scan.per_doc(scan.doc[covered]),
    }
    out["base_failed"] = (n_words < rules.min_words) | (
        100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words
    )
    classes = class_histograms(scan)
    near, class_d, word_d = np.ones(scan.n, bool), np.zeros(scan.n), np.zeros(scan.n)
    if refs.langs:
        column = _columns(hashes, refs.vocabulary)
        wide = len(refs.vocabulary) + 1
        words = np.bincount(scan.doc * wide + column, minlength=scan.n * wide).reshape(scan.n, wide)
        p, w = _shares(classes), _shares(words)
        each = []
        for i in range(len(refs.langs)):
            own = np.append(np.flatnonzero(refs.words[i, :-1] > 0), wide - 1)
            mine = np.concatenate([w[:, own[:-1]], 1 - w[:, own[:-1]].sum(1, keepdims=True)], 1)
            each.append((jensen_shannon(p, refs.classes[i]), jensen_shannon(np.maximum(mine, 0), refs.words[i, own])))
        c, d = np.array([x[0] for x in each]), np.array([x[1] for x in each])
        more = rules.wider(n_words)
        fine = (c <= rules.class_distance + more) & (d <= rules.word_distance + more) | (n_words < rules.min_words)
        near, best = fine.any(0), np.argmin(c + d, 0)
        class_d, word_d = c[best, np.arange(scan.n)], d[best, np.arange(scan.n)]
    out["kept"] = ~out["base_failed"] & near
    return out | {"class_distance": class_d, "word_distance": word_d}


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "base_failed": "boolean", "kept": "boolean", "class_distance": "double", "word_distance": "double"
}


def judge(docs: DataFrame, refs: References | None = None, rules: Rules = Rules()) -> DataFrame:
    """doc_id and the columns of COLUMNS for every row of docs."""
    refs = learn_references(docs, rules) if refs is None else refs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan in scans(batch.column(1)):
                found = measure(scan, refs, rules)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(scan.first, scan.n), *(pa.array(found[k]) for k in COLUMNS)],
                    names=["doc_id", *COLUMNS]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items())
    )


def filter_documents(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that are kept, with all their columns, in one pass after the
    references are learned."""
    refs = learn_references(docs, rules)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan in scans(batch.column(at)):
                yield batch.slice(scan.first, scan.n).filter(pa.array(measure(scan, refs, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
