"""Embedding: the model is a plug-in column function, its results are validated."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from corpusflow.functions.text import tokens


def embed(
    texts: DataFrame, make_fn: Callable[[], Callable[[np.ndarray], np.ndarray]], column: str = "text",
    batch_size: int = 8
) -> DataFrame:
    """Adds `embedding`: make_fn gives each worker a function from a batch of texts to an array
    of vectors. Rows keep their order; batches never mix partitions."""
    return texts.withColumn(
        "embedding", predict_batch_udf(make_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)(column)
    )


def embed_hashing(texts: DataFrame, column: str = "text", dimension: int = 64) -> DataFrame:
    """Adds `embedding`, a deterministic stand-in for a model: hashed counts of lower-case
    tokens, scaled to length 1. No tokens give the first unit vector, as a zero vector has no
    direction. All in the JVM."""
    words = texts.withColumn("__w", tokens(F.lower(column)))
    counted = HashingTF(inputCol="__w", outputCol="__tf", numFeatures=dimension).transform(words)
    unit = F.array(F.lit(1.0), *[F.lit(0.0)] * (dimension - 1)).cast("array<float>")
    scaled = Normalizer(inputCol="__tf", outputCol="__v").transform(counted).withColumn(
        "embedding", F.when(F.size("__w") > 0, vector_to_array("__v", "float32")).otherwise(unit)
    )
    return scaled.drop("__w", "__tf", "__v")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def validate_embeddings(embeddings: DataFrame, profiles: DataFrame) -> DataFrame:
    """rule, key and detail of every violation: unknown profile, dimension out of 1 to 2000 or
    other than the profile's, length, values that aren't finite, zero length, repeats."""
    known = profiles.select("profile_key", F.col("dimension").alias("__d"))
    rows = embeddings.join(known.hint("merge"), "profile_key", "left")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rules = {
        "profile_unknown": F.col("__d").isNull(),
        "dimension_range": ~F.col("dimension").between(1, 2000),
        "dimension_mismatch": F.col("dimension") != F.col("__d"),
        "vector_length": F.size("embedding") != F.col("dimension"),
        "not_finite": ~finite,
        "zero_vector": finite & (norm(F.col("embedding")) == 0),
    }
    broken = F.array_compact(
        F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()))
    )
    key = F.concat_ws("|", F.col("chunk_id").cast("string"), "profile_key")
    found = rows.select(
        F.explode(broken).alias("rule"), key.alias("key"), F.col("dimension").cast("string").alias("detail")
    )
    repeats = embeddings.groupBy("chunk_id", "profile_key").count().where("count > 1")
    return found.unionByName(
        repeats.select(F.lit("repeated").alias("rule"), key.alias("key"), F.col("count").cast("string").alias("detail"))
    )


def index_summary(embeddings: DataFrame) -> DataFrame:
    return embeddings.groupBy("profile_key", "dimension").agg(
        F.countDistinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("embeddings")
    )
