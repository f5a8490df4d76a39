"""Benchmark decontamination by winnowing.

Every run of 13 words of a document or item is a window of 7 hashes of 7 consecutive words;
its fingerprint is the least of them, the rightmost among equals. Equal windows have equal
fingerprints, so joining fingerprints misses no shared window. A document's
fingerprint that an item has is then extended to the windows that hold it, which are joined by what
they cover, so a passage costs a document one row, however many items hold it in whatever surroundings. Items of fewer words are looked up as
whole runs of their own length. All of it is DataFrame functions.

Defined results: null and empty texts have no words and no hits; an item without words is
never found; items or documents that repeat give the same row each time; an empty benchmark
hits nothing; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.sources.scratch import materialize

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
GRAM = 7
#: A key holds the high bits of a hash above a position counted down.
PLACE = (1 << 28) - 1
#: What two equal windows have in common.
WINDOW_KEY = ["print", "first", "last"]
#: Tables of fingerprints or windows of at most this many rows (about 150 bytes each) are broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text, an empty array for null."""
    parts = F.array_remove(F.split(F.translate(text, UPPER, LOWER), SEPARATOR), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def _shifted(a: str, b: str, by: int, f) -> Column:
    """f of each a[i] and b[i + by], as long as b goes."""
    n = F.greatest(F.size(b) - by, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(by + 1), n), f)


def with_grams(texts: DataFrame, k: int, out: str) -> DataFrame:
    """texts with the hash of each run of k words of the array `words`: runs of 1, 2, 4 ... words are
    hashed first, each from two of half its length, then put together."""
    texts, sizes = texts.withColumn("__1", F.transform("words", lambda w: F.xxhash64(w))), [1]
    while 2 * sizes[-1] <= k:
        sizes.append(2 * sizes[-1])
        texts = texts.withColumn(
            f"__{sizes[-1]}", _shifted(f"__{sizes[-2]}", f"__{sizes[-2]}", sizes[-2], lambda x, y: F.xxhash64(x, y))
        )
    size = sizes[-1]
    for more in [s for s in reversed(sizes[:-1]) if (k - sizes[-1]) & s]:
        texts = texts.withColumn(
            f"__{size + more}", _shifted(f"__{size}", f"__{more}", size, lambda x, y: F.xxhash64(x, y))
        )
        size += more
    return texts.withColumn(out, F.col(f"__{k}")).drop(
        *(c for c in texts.columns if c.startswith("__") and c[2:].isdigit())
    )


def fingerprints(texts: DataFrame, keep: list[str]) -> DataFrame:
    """keep, place and print (position and hash of each fingerprint), the hashes from 6 before
    to 6 after it (around), and the number of those before it (before)."""
    reach = WINDOW - GRAM
    key = lambda h, i: F.shiftleft(F.shiftright(h, 28), 28) + (PLACE - i)
    rows, size = with_grams(texts, GRAM, "hashes").withColumn("least1", F.transform("hashes", key)), 1
    while size <= reach:  # minima of runs of 2, 4 ... and last reach + 1 keys
        more = min(size, reach + 1 - size)
        rows = rows.withColumn(
            f"least{size + more}", _shifted(f"least{size}", f"least{size}", more, lambda x, y: F.least(x, y))
        )
        size += more
    place = (F.lit(PLACE) - F.col("key").bitwiseAND(F.lit(PLACE))).cast("int")
    return (
        rows.select(*keep, "hashes", F.explode(F.array_distinct(f"least{reach + 1}")).alias("key"))
        .withColumn("place", place)
        .withColumn("before", F.least(F.col("place"), F.lit(reach)))
        .select(
            *keep, "place", F.get("hashes", F.col("place")).alias("print"),
            F.slice("hashes", F.col("place") - F.col("before") + 1, F.col("before") + reach + 1).alias("around"),
            "before"
        )
    )


def _grouped(prints: DataFrame, by: list) -> DataFrame:
    """by, and the ids of the items that have it, under the name of their group: hits carry the name
    alone, however many items share a passage."""
    found = prints.groupBy(*by).agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return found.withColumn("items_key", F.xxhash64("items"))


def item_windows(items: DataFrame) -> DataFrame:
    """Distinct windows of items by their first and last hash, with their fingerprint, items and
    items_key. A passage that many items hold in different surroundings is one window of all of them."""
    reach = WINDOW - GRAM
    spans = F.explode(F.transform("offsets", lambda o: F.struct(*_ends(o, "around", "before"))))
    own = fingerprints(items, ["item_id"]).withColumn("offsets", _offsets("around", "before", reach))
    return _grouped(own.select("item_id", "print", spans.alias("w")).select("item_id", "print", "w.*"), WINDOW_KEY)


def _offsets(around: str, before: str, reach: int) -> Column:
    """How far before the fingerprint the windows that hold it start."""
    first = F.greatest(F.col(before) + reach + 1 - F.size(around), F.lit(0))
    return F.sequence(first, F.least(F.col(before), F.lit(reach)))


def _ends(o: Column, around: str, before: str) -> tuple[Column, Column]:
    """First and last hash of the window that starts o before the fingerprint; together they cover it."""
    at = F.col(before) - o
    return F.get(around, at).alias("first"), F.get(around, at + (WINDOW - GRAM)).alias("last")


def _small(table: DataFrame) -> DataFrame:
    return table.hint("broadcast" if table.count() <= BROADCAST_ROWS else "merge")


def hits(docs: DataFrame, benchmark: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """keys, start, length and items_key of every document window that some item has; and the
    items of each items_key."""
    items = materialize(
        benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0), "items"
    )
    spoken = docs.select(*keys, words(F.col("text")).alias("words"))
    windows = materialize(item_windows(items), "item-windows")
    groups = windows.select("items_key", "items")
    # Fingerprints that an item has are kept; each is then extended to the windows that hold it, and
    # a window meets one row at most, however many items have it.
    met = fingerprints(spoken, keys).join(_small(windows.select("print").distinct()), "print", "left_semi")
    spans = F.transform(
        _offsets("around", "before", WINDOW - GRAM),
        lambda o: F.struct((F.col("place") - o).alias("start"), *_ends(o, "around", "before"))
    )
    tried = met.select(*keys, "print", F.explode(spans).alias("w")).select(*keys, "print", "w.*")
    found = tried.join(_small(windows.drop("items")), WINDOW_KEY).select(
        *keys, "start", F.lit(WINDOW).alias("length"), "items_key"
    )
    short = items.where(F.size("words") < WINDOW)
    for row in short.select(F.size("words").alias("n")).distinct().orderBy("n").collect():  # at most 12 lengths
        whole = with_grams(
            short.where(F.size("words") == row.n), row.n, "runs"
        ).withColumn("print", F.get("runs", F.lit(0)))
        wanted = materialize(_grouped(whole, ["print"]), "short-items")
        groups = groups.unionByName(wanted.select("items_key", "items"))
        runs = with_grams(spoken, row.n, "runs").select(*keys, F.posexplode("runs").alias("start", "print"))
        found = found.unionByName(
            runs.join(_small(wanted.drop("items")), "print").select(
                *keys, "start", F.lit(row.n).alias("length"), "items_key"
            )
        )
    return found, groups.dropDuplicates(["items_key"])


def _covered(spans: Column) -> Column:
    """Number of words inside the union of sorted (start, length) spans."""
    step = lambda acc, s: F.struct(
        (
            acc["words"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(s["start"], acc["stop"]))
        ).alias("words"),
        F.greatest(acc["stop"], s["start"] + s["length"]).alias("stop"),
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("words"), F.lit(0).alias("stop")), step, lambda acc: acc["words"])


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    A document is contaminated if it has hit words and they are at least one in `share`.
    """
    mark = F.xxhash64("doc_id", "text")
    found, groups = hits(docs.withColumn("__mark", mark), benchmark, ["doc_id", "__mark"])
    by_doc = found.groupBy("doc_id", "__mark").agg(
        F.array_sort(F.collect_set(F.struct("start", "length"))).alias("spans"), F.collect_set("items_key").alias("all")
    )
    by_doc = materialize(by_doc, "hit-spans")
    ids = by_doc.select("doc_id", "__mark", F.explode("all").alias("items_key")).join(groups.hint("merge"), "items_key")
    ids = ids.groupBy("doc_id", "__mark").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("ids"))
    ids = ids.select(F.col("doc_id").alias("i"), F.col("__mark").alias("m"), "ids").hint("merge")
    by_doc = by_doc.join(ids, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("__mark").eqNullSafe(F.col("m")))
    ids = F.array_sort(F.transform("ids", lambda x: x.cast("string")))
    by_doc = materialize(
        by_doc.select(
            F.col("doc_id").alias("__id"), F.col("__mark").alias("__key"),
            _covered(F.col("spans")).cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ","), 256).alias("items_sha256")
        ),
        "hit-docs",
    )
    counted = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), mark.alias("__mark"))
    joined = counted.join(
        by_doc.hint("merge"), F.col("__mark").eqNullSafe(F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")),
        "left"
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows of docs that aren't contaminated, with their columns."""
    found, _ = hits(docs.withColumn("__mark", F.xxhash64("doc_id", "text")), benchmark, ["doc_id", "__mark"])
    by_doc = found.groupBy("doc_id", "__mark").agg(
        _covered(F.array_sort(F.collect_set(F.struct("start", "length")))).alias("__hit")
    )
    by_doc = materialize(by_doc.withColumnsRenamed({"doc_id": "__id", "__mark": "__key"}), "hit-docs")
    gone = (F.col("__hit") > 0) & (share * F.col("__hit") >= F.size(words(F.col("text"))))
    on = F.xxhash64("doc_id", "text").eqNullSafe(F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.join(by_doc.hint("merge"), on & gone, "left_anti")
