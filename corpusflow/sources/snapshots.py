"""Tables kept as a bucketed base and the changes since, behind one pointer a version.

A base is a Spark table bucketed and sorted by its key, with as many buckets as its bytes ask for,
so its side of a join by the key needs no exchange. A batch adds a small folder of changed rows,
with a mark where a key goes; it never rewrites what it doesn't change. Readers take the newest
row of each key. `compact` makes a new base once changes have piled up.

A version is visible when its pointer, a folder with a row for each live part, has been written;
until then readers see the version before.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.sources.scratch import materialize

POINTER = "name string, place int, folder string, buckets int, columns string"
#: Bytes of Parquet that a bucket of a base should hold.
BUCKET_BYTES = 128 << 20
GONE, AT = "__gone", "__at"


@dataclass(frozen=True)
class Part:
    """A base (buckets of at least 1) or a folder of changes (0 buckets), with its columns as DDL."""

    folder: str
    buckets: int
    columns: str


Parts = dict[str, list[Part]]


def pointer(spark: SparkSession, root: str, before: int | None = None) -> Parts:
    """The parts of each table at the last version (or the last before a given one), base first."""
    try:
        rows = spark.read.schema(f"{POINTER}, version long").parquet(f"{root}/pointer")
    except Exception as missing:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return {}
    rows = rows if before is None else rows.where(F.col("version") < before)
    last = rows.agg(F.max("version").alias("v")).first().v
    found: Parts = {}
    for r in rows.where(F.col("version") == last).orderBy("name", "place").collect() if last is not None else ():
        found.setdefault(r["name"], []).append(Part(r.folder, r.buckets, r["columns"]))
    return found


def publish(spark: SparkSession, root: str, version: int, parts: Parts) -> None:
    """Makes a version visible. Versions must grow; one that is published again replaces itself."""
    rows = [(name, i, p.folder, p.buckets, p.columns) for name, held in parts.items() for i, p in enumerate(held)]
    spark.createDataFrame(rows, POINTER).coalesce(1).write.mode("overwrite").parquet(f"{root}/pointer/version={version}")


def columns_of(table: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in table.drop(GONE).dtypes)


def _table(spark: SparkSession, part: Part, keys: list[str]) -> DataFrame:
    """A base as a bucketed table, known to this session's catalogue by its folder's name."""
    name = "base_" + part.folder.rpartition("-")[2]
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({part.columns}) USING parquet OPTIONS (path '{part.folder}') "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {part.buckets} BUCKETS"
    )
    return spark.table(name)


def stored_bytes(table: DataFrame) -> int:
    """Bytes of the files that a stored table reads."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def write_base(table: DataFrame, root: str, name: str, keys: list[str], bucket_bytes: int = BUCKET_BYTES) -> Part:
    """table as a base: a file a bucket, of about bucket_bytes, for keys are spread by hash."""
    spark, staged = table.sparkSession, materialize(table, f"base-{name}")
    buckets = max(1, -(-stored_bytes(staged) // bucket_bytes))
    part = Part(f"{root}/{name}-{uuid.uuid4().hex}", buckets, columns_of(table))
    writer = staged.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    written = "written_" + part.folder.rpartition("-")[2]
    writer.option("path", part.folder).saveAsTable(written)
    spark.sql(f"DROP TABLE {written}")  # the folder stays: its table has a path of its own
    return part


def write_changes(rows: DataFrame, root: str, name: str, gone: DataFrame | None = None) -> Part:
    """A batch's changes: rows that are new or replaced, and the keys of `gone`, which aren't there
    any more. Written in proportion to the batch."""
    columns = columns_of(rows)
    rows = rows.withColumn(GONE, F.lit(False))
    if gone is not None:
        rows = rows.unionByName(gone.withColumn(GONE, F.lit(True)), allowMissingColumns=True)
    folder = f"{root}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return Part(folder, 0, columns)


def changes(spark: SparkSession, parts: Iterable[Part], keys: list[str]) -> DataFrame | None:
    """The newest change of each key; None if there are no changes."""
    found = None
    for i, part in enumerate(p for p in parts if not p.buckets):
        rows = spark.read.schema(f"{part.columns}, {GONE} boolean").parquet(part.folder).withColumn(AT, F.lit(i))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return None
    newest = found.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in found.columns if c not in keys)), AT).alias("r"))
    return newest.select(*keys, "r.*").drop(AT)


def read(spark: SparkSession, parts: list[Part], keys: list[str], schema: str | None = None) -> DataFrame:
    """A table at a pointer's version; without parts an empty one of the schema."""
    if not parts:
        return spark.createDataFrame([], schema)
    base = _table(spark, parts[0], keys)
    newest = changes(spark, parts, keys)
    if newest is None:
        return base
    kept = base.join(newest.select(*keys).hint("merge"), keys, "left_anti")
    return kept.unionByName(newest.where(~F.col(GONE)).select(*base.columns))


def known(spark: SparkSession, parts: list[Part], keys: list[str], some: DataFrame, by: list[str], schema: str | None = None) -> DataFrame:
    """Rows of a table whose columns `by` are among those of `some`, a batch's rows: a base that is
    bucketed by them isn't moved, nor sorted."""
    return read(spark, parts, keys, schema).join(some.select(*by).distinct().hint("merge"), by, "left_semi")


def compact(
    spark: SparkSession, root: str, version: int, keys: dict[str, list[str]], bucket_bytes: int = BUCKET_BYTES
) -> None:
    """Publishes a version with new bases, which hold the same rows, and no changes."""
    found = pointer(spark, root)
    made = {
        name: [write_base(read(spark, held, keys[name]), root, name, keys[name], bucket_bytes)] if len(held) > 1 else held
        for name, held in found.items()
    }
    publish(spark, root, version, made)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Deletes pointers but the last `keep`, and folders that no pointer left names. For when no
    reader has an older version open. Returns the number of folders deleted."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(conf)
    rows = spark.read.schema(f"{POINTER}, version long").parquet(f"{root}/pointer")
    versions = sorted(r.version for r in rows.select("version").distinct().collect())[-keep:]
    live = {r.folder.rpartition("/")[2] for r in rows.where(F.col("version").isin(versions)).select("folder").collect()}
    gone = 0
    for folder, stays in ((f"{root}/pointer", {f"version={v}" for v in versions}), (root, live | {"pointer"})):
        for status in files.listStatus(path(folder)):
            name = status.getPath().getName()
            if status.isDirectory() and name not in stays and (folder != root or len(name.rpartition("-")[2]) == 32):
                files.delete(status.getPath(), True)
                gone += 1
    return gone
