"""Mixing sources to target weights by Sainte-Laguë apportionment.

The house has as many blocks of equal size as all documents' words fill. Sources compete for them:
one with target t claims its k-th block (k = 0, 1, ...) with the quotient t / (2k + 1), and the
highest quotients of all win. Each source's documents are dealt into shards, which compete for the
source's blocks in the same way; that gives integer quotas. A shard's words form a stream in seeded
order that is cut into blocks. A quota over the shard's size means whole passes and then a seeded
choice of single blocks. Equal quotients go to the first source, or shard.

Only quotients near the last that wins are listed, two a claimant at most on average: the others'
number is known from bounds of the divisor.

Defined results: null and empty texts have size 0 and are never taken; null sources form one
source, ordered last; documents with a null id are dealt by their texts; rows that repeat are separate documents; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.sources.scratch import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Two primes: the one that doesn't divide a shard's number of blocks permutes them.
STEPS = (1000003, 998244353)
#: Source tables up to this many rows are broadcast, larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """Targets by source from (source, source_size, n_docs).

    Weights repeat along the sources in code point order, null last. A target stops at `cap`
    times its source's size; the excess goes to the others by weight. Sorted by cap / weight,
    the first source whose share of the rest fits below its cap sets the level for all that
    follow, so one pass over the sorted sources finds the fixed point.
    """
    everything = Window.orderBy(F.asc_nulls_last("source"))
    pick = F.array(*map(F.lit, weights))
    ranked = sizes.withColumn("source_rank", F.row_number().over(everything)).withColumn(
        "weight", F.get(pick, (F.col("source_rank") - 1) % len(weights))
    )
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "source_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    filled = ranked.withColumn("limit", cap * F.col("source_size")).withColumn("level", level)
    fit = F.when(
        F.col("level") <= F.col("limit") / F.col("weight"),
        F.struct((F.col("limit") / F.col("weight")).alias("r"), "source_rank", "level")
    )
    filled = filled.withColumn("chosen", F.min(fit).over(Window.partitionBy())["level"])
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.col("chosen"))
    return filled.select(
        "source", "source_rank", "source_size", "n_docs", F.coalesce(target, F.lit(0.0)).alias("target")
    )


def _number(key: Column) -> Column:
    """The first 32 bits of an md5 in hex."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


def apportion(claims: DataFrame, key: str, group: list[str] | None = None) -> DataFrame:
    """group, key and seats of every row of claims (group, key, share, house), where each group has
    `house` seats (the same number in all its rows).

    Of all quotients share / (2k + 1) the `house` highest win. With T the sum and S the number of
    a group's shares, rounding every share / d gives T / d seats give or take S / 2. So more than
    `house` quotients reach the divisor T / (house + S/2 + 1), and fewer reach T / (house - S/2 - 1):
    those are sure, and the ones between are ranked.
    """
    group = group or []
    all_rows = Window.partitionBy(*group)
    t, total = F.col("share"), F.col("__total")
    slack = F.col("__n") / 2 + 1
    rows = claims.select(*group, key, "share", "house").withColumn(
        "__total", F.sum("share").over(all_rows)
    ).withColumn("__n", F.count_if(t > 0).over(all_rows))
    rows = rows.withColumn(
        "__sure",
        F.when(
            (total > 0) & (F.col("house") > slack), F.floor(t * (F.col("house") - slack) / total + 0.5)
        ).otherwise(0).cast("long")
    )
    rows = rows.withColumn(
        "__most", F.when(total > 0, F.floor(t * (F.col("house") + slack) / total + 0.5)).otherwise(0).cast("long")
    )
    rows = rows.withColumn("__left", F.col("house") - F.sum("__sure").over(all_rows))
    near = F.explode_outer(F.when(F.col("__most") > F.col("__sure"), F.sequence("__sure", F.col("__most") - 1)))
    quotients = rows.select(
        *group, key, "__sure", "__left", "share", near.alias("__k")
    ).withColumn("__quotient", t / (2 * F.col("__k") + 1))
    rank = F.row_number().over(all_rows.orderBy(F.desc_nulls_last("__quotient"), key))
    won = F.count_if(F.col("__k").isNotNull() & (F.col("__rank") <= F.col("__left")))
    return quotients.withColumn("__rank", rank).groupBy(*group, key).agg((F.first("__sure") + won).alias("seats"))


def _sized(table: DataFrame) -> DataFrame:
    return table.hint("broadcast" if table.count() <= BROADCAST_ROWS else "merge")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 16, shard_docs: int = 4096,
    seed: int = 7, keep: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, size, source_size, target, taken, passes, quota_blocks and the columns of keep for each
    document.

    `taken` counts the words that the mix takes of a document, repeats included: whole passes
    over its shard, and its part of the chosen blocks. A source's taken words differ from its
    target by at most about one block a shard.
    """
    col, b = F.col, F.lit(block)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(col("doc_id").cast("string"), F.md5("text"), F.lit(""))))
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *keep), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = materialize(source_targets(sizes, weights, cap), "mix-sources")
    house = F.floor(F.sum("source_size").over(Window.partitionBy()) / b + F.lit(0.5))
    seats = apportion(sources.select("source_rank", col("target").alias("share"), house.alias("house")), "source_rank")
    sources = materialize(
        sources.join(seats.hint("merge"), "source_rank").withColumn("shards", F.ceil(col("n_docs") / shard_docs)),
        "mix-quotas"
    )
    dealt = sized.join(
        _sized(sources.withColumnRenamed("source", "its_source")), col("source").eqNullSafe(col("its_source"))
    )
    dealt = dealt.withColumn("shard", F.pmod(_number(col("key")), col("shards")))
    shards = dealt.groupBy("source_rank", "shard").agg(
        F.sum("size").alias("shard_size"), *(F.first(c).alias(c) for c in ("target", "source_size", "seats"))
    )
    share = F.when(col("source_size") > 0, col("target") * col("shard_size") / col("source_size")).otherwise(F.lit(0.0))
    shards = materialize(shards.withColumn("share", share), "mix-shards")
    quotas = apportion(
        shards.select("source_rank", "shard", "share", col("seats").alias("house")), "shard", ["source_rank"]
    )
    quotas = materialize(
        shards.select("source_rank", "shard", "shard_size")
        .join(quotas.hint("merge"), ["source_rank", "shard"])
        .withColumnRenamed("seats", "quota_blocks")
        .withColumn("words", col("quota_blocks") * b)
        .withColumn(
            "passes",
            F.when(
                col("shard_size") > 0, F.least(F.lit(cap).cast("long"), F.floor(col("words") / col("shard_size")))
            ).otherwise(F.lit(0))
        )
        .withColumn("blocks", F.ceil(col("shard_size") / b))
        .withColumn(
            "rest",
            F.when(col("passes") >= cap, F.lit(0)).otherwise(
                F.floor((col("words") - col("passes") * col("shard_size")) / b + F.lit(0.5))
            )
        )
        .withColumn(
            "step", F.when(col("blocks") % STEPS[0] == 0, F.lit(STEPS[1])).otherwise(F.lit(STEPS[0])).cast("long")
        )
        .withColumn(
            "offset", _number(F.md5(F.concat(F.lit(f"{seed}:"), col("source_rank"), F.lit(":"), col("shard"))))
        ),
        "mix-shard-quotas",
    )
    stream = Window.partitionBy("source_rank", "shard").orderBy("key", "size", "doc_id").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = dealt.join(
        _sized(quotas), ["source_rank", "shard"]
    ).withColumn("stop", F.sum("size").over(stream)).withColumn("start", col("stop") - col("size"))
    last = F.greatest(col("stop") - 1, col("start"))
    part = F.aggregate(
        F.sequence(F.floor(col("start") / b), F.floor(last / b)),
        F.lit(0).cast("long"),
        lambda total, j: total
        + F.when(
            (col("step") * j + col("offset")) % F.greatest(col("blocks"), F.lit(1)) < col("rest"),
            F.least(col("stop"), (j + 1) * b) - F.greatest(col("start"), j * b)
        ).otherwise(F.lit(0)),
    )
    taken = col("passes") * col("size") + F.when((col("size") > 0) & (col("rest") > 0), part).otherwise(F.lit(0))
    return placed.select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), col("passes").cast("long"),
        col("quota_blocks").cast("long"), *keep
    )
