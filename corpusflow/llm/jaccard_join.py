"""Near-duplicate groups by an exact metric-space join under the Jaccard distance.

Documents are sets of word n-grams; two link when their distance is at most r. Equal sets are
one point from the start. The join then narrows regions:

1. First regions. Unrelated texts all lie at distance 1 from any document, so documents can't
   serve as pivots for the whole space. Its pivots are the projections of documents: the space
   of n-grams is cut by hash into m subspaces, more than the n-grams by which linked sets of
   that size can differ. Then linked documents agree entirely in some subspace, that is, they
   lie at distance 0 from the same pivot there. Sizes are cut into rings; a ring is also given
   the smaller documents beyond its edge that the triangle inequality (a distance is at least
   1 - smaller size / larger size) doesn't exclude.
2. Pivot regions. In each first region the document that shares most with others becomes its
   pivot, and the distance of every member to it is computed. Links to pivots are final. The
   members of all first regions with the same pivot are one region from here on.
3. Rings. A region is cut into rings of width r around its pivot; each ring is also given the
   next one's members, for by the triangle inequality linked documents' distances to the
   pivot differ by r at most. Large rings take a new pivot and are cut again, recursively.
   Rings whose members are already in one component are done.
4. What is left is compared pair by pair in blocks of bounded size, as a product of sparse
   rows; only links that join two components leave a block.

Voronoi cells with guests within 2r, tried first in place of step 3, replicate nearly every
member of a group of near copies into every cell, as distances there are all within 2r.

Distances are counted on the n-gram sets themselves (64-bit hashes). Links go to connected
components; nothing passes the driver.

Defined results: null texts and texts without words have an empty set and link with nothing;
with fewer words than an n-gram has, the whole sequence is one n-gram; equal sets are linked
whatever their texts; rows that repeat get equal rows; a null doc_id belongs to its group, but
isn't its smallest id unless all are null; an empty table gives an empty one; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.components import components
from corpusflow.llm.scan import Scan, distinct, mix, scans, whole, windows
from corpusflow.sources.batches import bound_batches
from corpusflow.sources.scratch import materialize

U = np.uint64


@dataclass(frozen=True)
class Join:
    """Sets of `words`-word n-grams link when 100 * intersection >= percent * union. Regions of
    more than block members are cut into rings again, up to `depth` times and while that makes
    them smaller; what can't be cut is compared in blocks."""

    words: int = 5
    percent: int = 80
    block: int = 256
    depth: int = 6

    @property
    def radius(self) -> float:
        return 1 - self.percent / 100

    @property
    def ring(self) -> float:
        """Ratio of the largest to the smallest size of a ring."""
        return 1 + 2.5 * (1 - self.percent / 100)


def sets(scan: Scan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct n-gram, in order of document, then hash."""
    words = scan.word_hashes(lower=True)
    h, first = windows(scan, words, k)
    n = scan.per_doc(scan.doc)
    few = np.flatnonzero((n > 0) & (n < k))
    doc = np.concatenate([scan.doc[first], few])
    doc, h, _ = distinct(doc, np.concatenate([h, whole(scan, words, few)]))
    return doc, h


def signatures(n: int, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit signature of each of n documents' sets."""
    size, total = np.bincount(doc, minlength=n), np.zeros(n, U)
    np.add.at(total, doc, mix(h ^ U(0x5851F42D4C957F2D)))
    return size, mix(total + size.astype(U)).view(np.int64)


class Rings:
    """Rings of set sizes. For ring i: least and largest size, differing n-grams that linked
    sets can have (most), subspaces (m)."""

    def __init__(self, join: Join, largest: int):
        t, start, self.low, self.most, self.m = join.percent / 100, 1, [], [], []
        while start <= max(largest, 1):
            end = max(start, int(start * join.ring))
            most = int((1 - t) / (1 + t) * 2 * end + 1e-9)
            m = most + 1
            for _ in range(20):  # subspaces that are likely empty come on top
                empty = m * exp(-t * start / m)
                m = most + 1 + most // 10 + ceil(empty + 2 * sqrt(empty))
            self.low.append(start)
            self.most.append(most)
            self.m.append(m if most else 0)
            start = end + 1
        self.threshold = t
        self.low, self.most, self.m = np.array(self.low), np.array(self.most), np.array(self.m)

    def of(self, size: np.ndarray, above: int) -> np.ndarray:
        """Ring of each size, or the ring that many above if a set of that size can link into
        it; -1 otherwise."""
        own = np.searchsorted(self.low, size, "right") - 1
        ring = own + above
        fits = (own >= 0) & (ring < len(self.low))
        ring = np.where(fits, ring, 0)
        fits &= (above == 0) | (size >= self.threshold * self.low[ring] - 1e-9)
        return np.where(fits, ring, -1)


def cells(join: Join, n: int, doc: np.ndarray, h: np.ndarray) -> Iterator[
    tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
]:
    """Document and cell (64 bits, the last 8 of them the ring) of each projection, ring by ring
    above the documents' own; then each document's ring (-1: none) and the number of cells
    that it shares at least with any document that it links with there."""
    size = np.bincount(doc, minlength=n)
    rings = Rings(join, int(size.max(initial=0) / join.percent * 100) + 1)
    value, place = mix(h ^ U(0x14057B7EF767814F)), (mix(h ^ U(0x2545F4914F6CDD1D)) >> U(32)).astype(np.int64)
    for above in range(len(rings.low)):
        ring = rings.of(size, above)
        if not (ring >= 0).any():
            return
        m = np.where(ring >= 0, rings.m[ring], 0)
        base = np.concatenate([[0], np.cumsum(m)])
        used = m[doc] > 0
        at = base[doc[used]] + ((place[used] * m[doc[used]]) >> 32)
        total, count = np.zeros(base[-1], U), np.bincount(at, minlength=base[-1])
        np.add.at(total, at, value[used])
        owner = np.repeat(np.arange(n), m)
        empty = np.bincount(owner[count == 0], minlength=n)
        # Agreeing in an empty subspace counts only if no other agreement is certain. Of two linked
        # sets one may emit its empty subspaces and the other not, so a sparse set can count on one
        # cell only: its partner, if it isn't sparse, has a filled one in common with it.
        sparse = empty >= m - rings.most[ring]
        emit = (count > 0) | sparse[owner]
        label = mix((ring[owner].astype(U) << U(32)) + (np.arange(base[-1]) - base[owner]).astype(U))
        cell = mix(total[emit] + label[emit] + count[emit].astype(U)) & ~U(255) | ring[owner[emit]].astype(U) & U(255)
        least = np.where(sparse, 1, m - rings.most[ring] - empty)
        yield owner[emit], cell.view(np.int64), np.where(m > 0, ring, -1), least


def measure(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n_shingles, set (the set's signature) and text_hash of every row, written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan in scans(batch.column(1)):
                size, signature = signatures(scan.n, *sets(scan, join.words))
                own = [batch.column(c).slice(scan.first, scan.n) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays(
                    [own[0], pa.array(size), pa.array(signature), own[1]],
                    names=["doc_id", "n_shingles", "set", "text_hash"]
                )

    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return materialize(
        hashed.mapInArrow(run, f"doc_id {kind}, n_shingles long, set long, text_hash long"), "jaccard-sets"
    )


def first_regions(docs: DataFrame, join: Join) -> DataFrame:
    """cell and set of every cell that more than one set has, of sets that share as many as a
    link takes; written out. A task names a set once, so copies add no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for scan in scans(batch.column(0)):
                doc, h = sets(scan, join.words)
                size, signature = signatures(scan.n, doc, h)
                fresh = np.zeros(scan.n, bool)
                for i in np.flatnonzero(size):
                    if signature[i] not in seen:
                        seen.add(signature[i])
                        fresh[i] = True
                keep = fresh[doc]
                for owner, cell, _, _ in cells(join, scan.n, doc[keep], h[keep]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell), pa.array(signature[owner])], names=["cell", "set"]
                    )

    # Computed twice instead of written: most cells have one set, and all of them would fill disks. A
    # cell's sets are counted first; then the rows of cells with several are fetched by a plain
    # shuffle, which is split where a cell is hot. (Copies in other tasks count here; they leave
    # with the next step.)
    rows = docs.select("text").mapInArrow(run, "cell long, set long")
    several = materialize(rows.groupBy("cell").count().where("count > 1").select("cell"), "jaccard-several")
    found = materialize(rows.join(several.hint("merge"), "cell", "left_semi").distinct(), "jaccard-cells")
    # Linked sets share a number of cells, not just one: what shares fewer in a ring leaves it.
    needs = materialize(shared_cells(docs, join), "jaccard-needs")
    for _ in range(2):
        found = materialize(_several(found).withColumn("ring", F.col("cell").bitwiseAND(F.lit(255))), "jaccard-cells")
        enough = found.groupBy("set", "ring").count().join(needs.hint("merge"), ["set", "ring"]).where("count >= need").select("set", "ring")
        found = materialize(found.join(enough.hint("merge"), ["set", "ring"]).select("cell", "set"), "jaccard-cells")
    return materialize(_several(found), "jaccard-cells")


def _several(rows: DataFrame) -> DataFrame:
    """Those of rows (cell, set) whose cell has more than one set."""
    shared = rows.groupBy("cell").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a <> b").select("cell")
    return rows.join(shared.hint("merge"), "cell", "left_semi")


def shared_cells(docs: DataFrame, join: Join) -> DataFrame:
    """set, ring and need: the cells of a ring that a set shares with any set it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scan in scans(batch.column(0)):
                doc, h = sets(scan, join.words)
                _, signature = signatures(scan.n, doc, h)
                for _, _, ring, least in cells(join, scan.n, doc, h):
                    own = ring >= 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signature[own]), pa.array(ring[own] & 255), pa.array(least[own])],
                        names=["set", "ring", "need"]
                    )

    return docs.select("text").mapInArrow(run, "set long, ring long, need long").groupBy("set", "ring").agg(F.min("need").alias("need"))


def set_items(docs: DataFrame, measured: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """set and items (its n-gram hashes) of the wanted sets, each from one document."""
    one = measured.join(wanted.hint("merge"), "set").groupBy("set").agg(
        F.min(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("t"))).alias("one")
    )
    same = F.col("doc_id").eqNullSafe(F.col("one.id")) & (F.xxhash64("text") == F.col("one.t"))
    texts = docs.select("doc_id", "text").join(one.hint("merge"), same).select("text", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False)
            for scan in scans(batch.column(0)):
                doc, h = sets(scan, join.words)
                _, signature = signatures(scan.n, doc, h)
                cuts = np.searchsorted(doc, np.arange(scan.n + 1)).astype(np.int32)
                right = pa.array(signature == wanted[scan.first : scan.first + scan.n])
                items = pa.ListArray.from_arrays(pa.array(cuts), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(signature), items], names=["set", "items"]).filter(right)

    return materialize(texts.mapInArrow(run, "set long, items array<long>").dropDuplicates(["set"]), "jaccard-items")


def distances(pairs: DataFrame, items: DataFrame, join: Join) -> DataFrame:
    """set, pivot, distance and linked of the distinct pairs (set, pivot). A pivot may be hot;
    both joins are plain shuffles, which adaptive execution splits."""
    # Both joins with items are by set, so that they share one shuffle of them; only pivots'
    # items are then sent to their pairs.
    full = items.hint("merge")
    pivots = pairs.select(F.col("pivot").alias("set")).distinct().join(full, "set").select(
        F.col("set").alias("pivot"), F.col("items").alias("y")
    ).hint("merge")
    shared = F.size(F.array_intersect("items", "y"))
    found = pairs.join(full, "set").join(pivots, "pivot").select(
        "set", "pivot", shared.alias("i"), (F.size("items") + F.size("y") - shared).alias("u")
    )
    linked = 100 * F.col("i") >= join.percent * F.col("u")
    return materialize(
        found.select("set", "pivot", (1 - F.col("i") / F.col("u")).alias("distance"), linked.alias("linked")),
        "jaccard-distances"
    )


def hubs(cells: DataFrame) -> DataFrame:
    """pivot and set for each first region's pivot and each member: the pivot is the member
    that shares its regions with most others. Distinct, without the pivot itself."""
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    weights = cells.join(sizes.hint("merge"), "cell").groupBy("set").agg(F.sum("n").alias("weight"))
    pivots = cells.join(weights.hint("merge"), "set").groupBy("cell").agg(
        F.max_by("set", F.struct("weight", "set")).alias("pivot")
    )
    return materialize(
        cells.join(pivots.hint("merge"), "cell").where("set <> pivot").select("pivot", "set").distinct(), "jaccard-hubs"
    )


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows (set, ...) with the root of each set's component so far."""
    known = roots.select(F.col("node").alias("set"), F.col("root").alias("__root"))
    rows = rows.drop("root").join(known.hint("merge"), "set", "left")
    return rows.withColumn("root", F.coalesce("__root", "set")).drop("__root")


def unsettled(rows: DataFrame) -> DataFrame:
    """rows of the regions with several components, with the region's number of rows n."""
    sums = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("p"), F.max("root").alias("q"))
    sums = sums.where("p <> q").select(F.col("region").alias("r"), "n")
    return rows.drop("n").join(sums.hint("merge"), F.col("region") == F.col("r")).drop("r")


def rings(rows: DataFrame, radius: float) -> DataFrame:
    """rows (region, set, distance) in the region of their ring and of the next inner one."""
    ring = F.floor(F.col("distance") / F.lit(radius + 1e-9)).cast("long")
    both = F.explode(F.array_distinct(F.array(F.greatest(ring - 1, F.lit(0)), ring)))
    return rows.withColumn("ring", both).withColumn("region", F.xxhash64("region", "ring")).select("region", "set")


def _link_rows(join: Join, roots: list[int], items: list[np.ndarray], sides: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows that link and join components. Rows of different sides are compared, or
    all if there is one side."""
    sizes = np.array([len(x) for x in items])
    _, code, often = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(items)), sizes)
    shared = np.zeros((len(items), len(items)), np.float32)
    common = np.flatnonzero(often > 1)
    column = np.full(len(often), -1)
    column[common] = np.arange(len(common))
    code = column[code]
    for i in range(0, len(common), 4096):
        part = (code >= i) & (code < i + 4096)
        table = np.zeros((len(items), min(4096, len(common) - i)), np.float32)
        table[row[part], code[part] - i] = 1
        shared += table @ table.T
    union = sizes[:, None] + sizes[None, :] - shared
    near = np.triu(100 * shared >= join.percent * union, 1)
    if sides.any():
        near &= sides[:, None] != sides[None, :]
    parent = {r: r for r in roots}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(*np.nonzero(near), strict=True):
        x, y = find(roots[a]), find(roots[b])
        if x != y:
            parent[x] = y
            yield a, b


def compare_blocks(rows: DataFrame, items: DataFrame, join: Join) -> DataFrame:
    """Links (a, b) between sets of the same region (region, set, root, n). A region's rows are
    dealt into blocks by hash; each pair of blocks is one bounded group."""
    blocks = F.ceil(F.col("n") / join.block)
    own = F.pmod(F.xxhash64("set", F.lit(1)), blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = rows.withColumn("own", own).select("region", "set", "root", "own", other.alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    keyed = dealt.select(
        F.struct("region", low.alias("i"), high.alias("j")).alias("key"), "set", "root",
        (F.col("own") > F.col("other")).alias("side")
    )
    full = keyed.join(items.hint("merge"), "set").select("key", "set", "root", "side", "items").repartition("key").sortWithinPartitions("key")

    def compare(group: list[dict]) -> pa.RecordBatch:
        # Within one block every pair of rows counts: there all sides are equal.
        sides = np.array([r["side"] for r in group])
        across = group[0]["key"]["i"] != group[0]["key"]["j"]
        found = list(
            _link_rows(
                join, [r["root"] for r in group], [r["items"] for r in group],
                sides if across else np.zeros(len(group), bool)
            )
        )
        a, b = ([group[x[i]]["set"] for x in found] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "set", "root", "side")]
            cuts, values = batch.column("items").offsets.to_numpy(), batch.column("items").values.to_numpy()
            for i, (key, name, root, side) in enumerate(zip(*columns, strict=True)):
                if group and group[-1]["key"] != key:
                    yield compare(group)
                    group = []
                group.append(
                    {"key": key, "set": name, "root": root, "side": side, "items": values[cuts[i] : cuts[i + 1]].copy()}
                )
        if group:
            yield compare(group)

    return materialize(full.mapInArrow(run, "a long, b long"), "jaccard-links")


def links(docs: DataFrame, measured: DataFrame, join: Join) -> DataFrame:
    """node and root for every set with a link to a different set."""
    first = first_regions(docs, join)
    items = set_items(docs, measured, first.select("set").distinct(), join)
    members = hubs(first)
    near = distances(members, items, join)
    found = near.where("linked").select(F.col("set").alias("a"), F.col("pivot").alias("b"))
    roots = components(found)
    rows = near.select(F.col("pivot").alias("region"), "set", "distance")
    work = None
    for _ in range(join.depth):
        rows = unsettled(with_roots(rows, roots))
        rows = materialize(unsettled(with_roots(rings(rows, join.radius), roots)), "jaccard-rings")
        large = rows.where(F.col("n") > join.block)
        before, work = work, large.agg(F.sum("n").alias("n")).first().n
        if not work or before and work > 0.8 * before:
            break
        chosen = large.groupBy("region").agg(
            F.min_by("set", F.xxhash64("set", "region")).alias("pivot")
        ).select(F.col("region").alias("r"), "pivot")
        again = materialize(
            large.join(
                chosen.hint("merge"), F.col("region") == F.col("r")
            ).where("set <> pivot").select("region", "set", "pivot"),
            "jaccard-pivots"
        )
        near = distances(again.select("set", "pivot").distinct(), items, join)
        found = found.unionByName(near.where("linked").select(F.col("set").alias("a"), F.col("pivot").alias("b")))
        small = rows.where(F.col("n") <= join.block)
        found = found.unionByName(compare_blocks(small, items, join))
        roots = components(found)
        rows = again.join(
            near.select("set", "pivot", "distance").hint("merge"), ["set", "pivot"]
        ).select("region", "set", "distance")
    else:
        rows = materialize(unsettled(with_roots(rings(rows, join.radius), roots)), "jaccard-rings")
    found = found.unionByName(compare_blocks(rows, items, join))
    return components(found)


def groups(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of its group) of every row."""
    measured = measure(docs, join)
    roots = links(docs, measured, join).select(F.col("node").alias("set"), "root")
    classes = measured.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    rooted = classes.join(roots.hint("merge"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    rooted = materialize(rooted, "jaccard-classes")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = materialize(
        rooted.join(smallest.hint("merge"), "root").select(F.col("set").alias("its"), "component_id"), "jaccard-labels"
    )
    out = measured.join(labels.hint("merge"), (F.col("set") == F.col("its")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """One row of docs for each group, that of the smallest doc_id, with all columns. If rows
    share this id, each text stays once; rows without an id stay once a text."""
    found = groups(docs, join).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(found.hint("merge"), "doc_id").select(*docs.columns).withColumn("__text", F.xxhash64("text"))
    once = F.row_number().over(Window.partitionBy("doc_id", "__text").orderBy(F.lit(1)))
    kept = kept.withColumn("__n", once).where("__n = 1").select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null").dropDuplicates(["text"]))
