"""Language identification by compression.

Each language has a raw-content dictionary for Zstandard, made of a bounded sample of labelled
text: all labelled documents are cut into blocks, and the distinct blocks with the least hashes are
taken, so neither copies nor partitions nor a document's length change what is learned. A text is cut into blocks of equal size that are compressed with every dictionary;
the language whose dictionary gives the smallest total wins. The margin by which it is smaller
than the runner-up is the score; a text is rejected if the margin is narrow.

Defined results: a null text or one without a letter is `und` with score 0 and is rejected;
equal sizes go to the first language by name; with one language every text with a letter is
that language with score 1; without labelled documents all texts are `und`; rows that repeat
get equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.sources.batches import bound_batches

#: Letters in the sense of the rule in learn: fractions and superscripts are none.
LETTER = regex.compile(r"\p{L}")
OTHER = regex.compile(r"\P{L}+")
#: Groups by hash in which blocks are ranked before a language's ranks.
GROUPS = 64


def plain(text: str) -> str:
    """Lower-cased letters with single spaces between runs of them: what is compressed."""
    return OTHER.sub(" ", text.lower())


@dataclass(frozen=True)
class Settings:
    """A language's dictionary is made of `sample_blocks` blocks of at most `block` characters. If
    there are so many languages that all dictionaries would have more than `total_blocks` blocks,
    each gets fewer, one at least. min_margin: texts whose best size is within this share of the
    runner-up's are rejected."""

    sample_blocks: int = 96
    total_blocks: int = 8192
    block: int = 4096
    level: int = 6
    min_margin: float = 0.005


def held_out(modulus: int = 4, remainder: int = 2):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def learn(labelled: DataFrame, settings: Settings = Settings()) -> dict[str, bytes]:
    """A dictionary for each language of labelled (text, lang): the distinct blocks with the least
    hashes. Hashes are ranked alone; then the chosen blocks' texts are fetched, one row each."""
    known = labelled.where("lang is not null").where(F.col("text").rlike(r"\p{L}")).select("lang", "text")
    size = settings.block
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size)),
        lambda i: F.substring("text", i * size + 1, F.lit(size))
    )
    hashed = F.transform(blocks, lambda b: F.xxhash64(b))
    found = known.select("lang", F.explode(hashed).alias("h")).distinct()
    langs = sorted(r.lang for r in known.select("lang").distinct().collect())  # a row a language
    room = max(1, min(settings.sample_blocks, settings.total_blocks // max(len(langs), 1)))
    # Ranked in groups by hash first, so that a language's blocks don't all meet in one task.
    group = Window.partitionBy("lang", F.pmod("h", F.lit(GROUPS))).orderBy("h")
    some = found.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= room)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    ranked = some.withColumn("rank", rank).where(F.col("rank") <= room)
    chosen = {(r.lang, r.h): r["rank"] for r in ranked.collect()}  # total_blocks rows or a row a language
    if not chosen:
        return {}
    wanted = labelled.sparkSession.createDataFrame(list(chosen), "lang string, h long")
    some = known.select("lang", F.explode(blocks).alias("b")).withColumn("h", F.xxhash64("b"))
    some = some.join(F.broadcast(wanted), ["lang", "h"]).groupBy("lang", "h").agg(F.min("b").alias("b"))
    texts = {(r.lang, r.h): r.b for r in some.collect()}  # as many rows
    return {
        lang: "\n".join(
            plain(texts[k]) for k in sorted((k for k in chosen if k[0] == lang), key=chosen.get, reverse=True)
        ).encode("utf-8", "replace") for lang in langs
    }


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], settings: Settings):
        self.settings, self.langs = settings, list(dictionaries)
        self.compressors = []
        for data in dictionaries.values():
            held = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=settings.level)
            self.compressors.append(
                zstd.ZstdCompressor(dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)
            )

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected."""
        if text is None or not self.langs or not LETTER.search(text):
            return "und", 0.0, True
        data, size = plain(text).encode("utf-8", "replace"), self.settings.block
        blocks = [data[i : i + size] for i in range(0, len(data), size)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best, *others = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        margin = 1 - sizes[best] / sizes[others[0]] if others else 1.0
        return self.langs[best], margin, margin < self.settings.min_margin


def classify(docs: DataFrame, dictionaries: dict[str, bytes], settings: Settings = Settings()) -> DataFrame:
    """doc_id, lang_pred, score and rejected for every row of docs; only text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, settings)
        for batch in batches:
            found = [model(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(
                        pa.array([r[i] for r in found], kind) for i,
                        kind in enumerate((pa.string(), pa.float64(), pa.bool_()))
                    )
                ],
                names=["doc_id", "lang_pred", "score", "rejected"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, rejected boolean"
    )


def filter_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs whose language isn't rejected, with their columns. Dictionaries are
    learned from all labelled documents' sample."""
    bound_batches(docs.sparkSession)
    dictionaries, at = learn(docs, settings), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries, settings)
        for batch in batches:
            yield batch.filter(pa.array([not model(x.as_py())[2] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict_held_out(
    docs: DataFrame, settings: Settings = Settings(), modulus: int = 4, remainder: int = 2
) -> DataFrame:
    """Learns from the documents outside the fold, predicts all: doc_id, held_out, lang_pred,
    score, rejected."""
    dictionaries = learn(docs.where(~held_out(modulus, remainder)), settings)
    found = classify(docs, dictionaries, settings)
    return found.select("doc_id", held_out(modulus, remainder).alias("held_out"), "lang_pred", "score", "rejected")
