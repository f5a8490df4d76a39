"""Token counts as an exact histogram of encoded lengths.

Documents are encoded with a public byte-pair vocabulary and counted by length. Suffix sums over
the lengths then answer, for every context limit, how many tokens there are in all, how many
remain if each document is cut at the limit, and which length a share of documents stays below.

Defined results: null and empty texts have 0 tokens; strings that name special tokens are
ordinary text; an empty table gives an empty histogram; rows that repeat count each; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the vocabulary's makers cut text before pairs are merged (a fixed value of the format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of PATTERN, in runs too long for the library's matcher, which nests with their length.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
#: Lengths of one bucket: suffix sums are taken over buckets, then within each.
BUCKET = 1024


def encoded_length(coder: tiktoken.Encoding, text: str) -> int:
    """Tokens of a text. PATTERN takes a run of white space as one unit, but for its last character
    if something follows; so long runs are cut out at these places and merged on their own."""
    total, at = 0, 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(coder.encode_ordinary(text[at : run.start()]))
        total += len(coder._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(coder.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of every document. The vocabulary is read on the driver and sent to
    the tasks; it has a fixed size of under 1 MB."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [encoded_length(coder, x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(counts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row a length: n_docs, and over all documents docs_ge and tokens_ge (of that length
    or more), share_le (of documents up to it) and truncated_total (tokens left if documents
    are cut at that length)."""
    n = F.col(length)
    bars = counts.groupBy(n.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    bars = bars.withColumn(
        "bucket", F.floor(F.col("n_tokens") / BUCKET)
    ).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    # As many buckets as the longest document has thousands of tokens.
    above = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    buckets = bars.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    buckets = buckets.select(
        F.col("bucket").alias("b"), F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("bucket").orderBy(F.desc("n_tokens"))
    out = bars.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum("tokens").over(within)).join(
        buckets.hint("merge"), F.col("bucket") == F.col("b")
    )
    docs_ge, tokens_ge = F.col("d") + F.col("docs_above"), F.col("t") + F.col("tokens_above")
    return out.select(
        "n_tokens", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"),
        ((F.col("all_docs") - docs_ge + F.col("n_docs")) / F.col("all_docs")).alias("share_le"),
        (F.col("all_tokens") - tokens_ge + F.col("n_tokens") * docs_ge).alias("truncated_total"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens that remain if every document is cut at `limit`."""
    longer = F.col("n_tokens") >= limit
    row = histogram.agg(
        F.sum(F.when(~longer, F.col("n_tokens") * F.col("n_docs"))).alias("t"),
        F.sum(F.when(longer, F.col("n_docs"))).alias("d")
    ).first()
    return (row.t or 0) + limit * (row.d or 0)


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length up to which at least `share` of the documents go; None if there are none."""
    return histogram.where(F.col("share_le") >= share).agg(F.min("n_tokens").alias("n")).first().n
