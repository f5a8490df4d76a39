"""Packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents are encoded, end with one separator and are cut only if longer than a sequence. Pieces
are dealt by hash into shards of bounded size, and each shard is evolved on several islands. A
genome says which bin each piece is in. Crossover injects whole well-filled bins of one parent
into the other, drops the other's bins that hold the same pieces, and puts the displaced ones
where they fit best. After each epoch an island's best genome migrates to the next island, through
a stored table. The least filled bins of each shard, a quarter of its pieces at most, are then
dissolved, and their pieces dealt and evolved again across shards until one shard is left; so
what cutting into shards costs is about a bin for the whole table rather than one a shard.

A shard whose genome needs no more bins than its tokens do is done at once. No result depends on
the layout of the input but for which equally good sequences are found.

Texts are encoded in parts: the vocabulary's pattern never joins across ASCII white space, or ASCII
letters with signs, and the vocabulary knows no case. So distinct parts are encoded once and their
ids laid out in the texts' order (parts are told apart by 64-bit hashes).

Defined results: null and empty texts have one token, the separator; names of special tokens get
their ids, as the vocabulary's library does by itself; rows that repeat, or share
an id, or have none, are packed each; an empty table gives an empty one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, replace
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusflow.llm.scan import SPACE, Scan, scans
from corpusflow.sources.scratch import materialize

VOCABULARY = "word_bpe_49k.json"
SEPARATOR = 0
#: A character that ASCII white space never touches once words are joined by it and spaces.
MARK = "\x01"
#: How the vocabulary marks tokens that end a unit of its pattern.
END = "</w>"


@dataclass(frozen=True)
class Packing:
    """Sequences of `limit` tokens; shards of about `shard` pieces, each on `islands` islands with
    `population` genomes, of which `children` are bred in each of `epochs` epochs. Bins filled to
    less than `closed`, with a share of `again` of a shard's pieces, are dealt across shards again."""

    limit: int = 2048
    shard: int = 2048
    islands: int = 3
    population: int = 4
    children: int = 12
    epochs: int = 3
    closed: float = 0.999
    again: float = 0.25
    seed: int = 11


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes: white space, letters, digits, signs, and what takes a look around: apostrophes,
#: bars (which names of special tokens have) and all above ASCII.
_SPACE, _LETTER, _DIGIT, _SIGN, _QUOTE, _HIGH = range(6)
_KIND, BAR = np.full(256, _SIGN, np.uint8), 124
_KIND[SPACE], _KIND[128:], _KIND[[39, BAR]] = _SPACE, _HIGH, _QUOTE
_KIND[48:58], _KIND[65:91], _KIND[97:123] = _DIGIT, _LETTER, _LETTER


def parts(scan: Scan) -> tuple[Scan, np.ndarray]:
    """A scan of parts of words that are encoded alike wherever they stand, and whether each is one
    unit of the vocabulary's pattern. Beside white space the pattern never joins ASCII letters and
    signs, nor a digit with anything."""
    kind = _KIND[scan.data]
    word, cut = kind != _SPACE, np.zeros(len(kind) + 1, bool)
    a, b = kind[:-1], kind[1:]
    cut[1:-1] = ((a == _LETTER) & (b == _SIGN)) | ((a == _SIGN) & (b == _LETTER)) | (
        ((a == _DIGIT) | (b == _DIGIT)) & (a != _HIGH) & (b != _HIGH)
    )
    cut[scan.offsets] = True
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    end[:-1] &= ~word[1:] | cut[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    odd = np.concatenate([[0], np.cumsum((kind == _QUOTE) | (kind == _HIGH), dtype=np.int64)])
    doc = np.searchsorted(scan.offsets, start, "right") - 1
    return replace(scan, start=start, end=end, doc=doc), odd[end] == odd[start]


class Coder:
    """Ids of parts of words, each distinct one encoded once while the cache holds it."""

    def __init__(self, vocabulary: bytes, most: int = 1 << 20):
        self.tokenizer, self.most = Tokenizer.from_buffer(vocabulary), most
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(END)]] = True
        self.mark = self._encode(MARK)
        self._clear()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted
        self.place = np.zeros(0, np.int64)  # of each known part in start and count
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of some units one after another, and how many each has: the last is one that ends words."""
        ids = np.array(self._encode(" ".join(words)), np.uint32)
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _others(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for any parts, by marks between them; those that hold the mark go one by one."""
        odd = [len(self.mark) != 1 or MARK in w for w in words]
        ids = np.array(self._encode(f" {MARK} ".join("" if o else w for w, o in zip(words, odd, strict=True))), np.uint32)
        cut = np.flatnonzero(ids == self.mark[0])
        each = np.split(np.delete(ids, cut), cut - np.arange(len(cut)))
        each = [np.array(self._encode(w), np.uint32) if o else p for w, o, p in zip(words, odd, each, strict=True)]
        return np.concatenate(each), np.array([len(p) for p in each])

    def _learn(self, scan: Scan, units: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
        data, known, starts, counts, ids = scan.data.tobytes(), [self.known], [self.start], [self.count], [self.ids]
        for mine, encode in ((units[first], self._units), (~units[first], self._others)):
            at = np.flatnonzero(mine)
            for i in range(0, len(at), 1 << 15):
                some = at[i : i + (1 << 15)]
                a, b = scan.start[first[some]].tolist(), scan.end[first[some]].tolist()
                got, count = encode([data[x:y].decode() for x, y in zip(a, b, strict=True)])
                starts.append(sum(map(len, ids)) + np.cumsum(count) - count)
                ids.append(got)
                counts.append(count)
                known.append(hashes[some])
        self.ids, self.start, self.count = np.concatenate(ids), np.concatenate(starts), np.concatenate(counts)
        place = np.concatenate([self.place, np.arange(len(self.place), len(self.start))])
        all_known = np.concatenate(known)
        order = np.argsort(all_known, kind="stable")
        self.known, self.place = all_known[order], place[order]

    def encode(self, scan: Scan, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all parts of a scan, in order, and how many each has."""
        h = scan.word_hashes(lower=True)
        if (scan.data == BAR).any():  # names of special tokens have their case
            bars = np.concatenate([[0], np.cumsum(scan.data == BAR)])
            some = np.flatnonzero(bars[scan.end] > bars[scan.start])
            h[some] = ~scan.hashes(scan.start[some], scan.end[some], lower=False)
        words, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        at = np.searchsorted(self.known, words)
        new = np.ones(len(words), bool)
        new[at < len(self.known)] = self.known[at[at < len(self.known)]] != words[at < len(self.known)]
        if new.any():
            self._learn(scan, units, words[new], first[new])
        place = self.place[np.searchsorted(self.known, words)][which]
        count = self.count[place]
        stop = np.cumsum(count)
        return self.ids[np.repeat(self.start[place] - stop + count, count) + np.arange(stop[-1] if len(stop) else 0)], count


def encoded(coder: Coder, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """ids of a scan's documents, each with the separator at its end, and where each begins."""
    scan, units = parts(scan)
    ids, count = coder.encode(scan, units) if len(scan.start) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    length = np.bincount(scan.doc, count, scan.n).astype(np.int64) + 1
    begin = np.concatenate([[0], np.cumsum(length)])
    out = np.full(begin[-1], SEPARATOR, np.uint32)
    inner = np.ones(len(out), bool)
    inner[begin[1:] - 1] = False
    out[inner] = ids
    return out, begin


def pieces(docs: DataFrame, how: Packing = Packing(), vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and uid (a number of its own) of every piece, stored."""
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or vocabulary_path()).read_bytes())
    kind, limit = docs.schema["doc_id"].dataType.simpleString(), how.limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, n = Coder(sent.value), TaskContext.get().partitionId() << 36
        for batch in batches:
            for scan in scans(batch.column(1), size=4 << 20):
                ids, begin = encoded(coder, scan)
                length = np.diff(begin)
                parts = -(-length // limit)
                doc = np.repeat(np.arange(scan.n), parts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * limit
                size = np.minimum(length[doc] - start, limit)
                a, view = begin[doc] + start, memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(a.tolist(), (a + size).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + scan.first)), pa.array(piece, pa.int32()), pa.array(start),
                        pa.array(size), pa.array(crc, pa.int64()), pa.array(n + np.arange(len(doc)))
                    ], names=["doc_id", "piece", "start", "length", "ids_crc32", "uid"]
                )
                n += len(doc)

    return materialize(
        docs.select("doc_id", "text").mapInArrow(
            run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, uid long"
        ), "pieces"
    )


Genome = np.ndarray  # bin of each piece, numbered from 0 without gaps


def rated(genome: Genome, lengths: np.ndarray) -> tuple[int, int]:
    """Bins, and minus the sum of squared fills: the less, the better."""
    fill = np.bincount(genome, lengths).astype(np.int64)
    return len(fill), -int((fill * fill).sum())


def best_fit(genome: Genome, loose: np.ndarray, lengths: np.ndarray, limit: int) -> Genome:
    """genome with its loose pieces (bin -1), in the order given, each in the fullest bin that has
    room for it, or in a new one."""
    placed = genome >= 0
    fill = np.bincount(genome[placed], lengths[placed]).astype(np.int64) if placed.any() else np.zeros(0, np.int64)
    n = len(fill)
    open_ = np.flatnonzero(fill < limit)
    room = sorted(((limit - fill[open_]) << 32 | open_).tolist())
    for i, size in zip(loose.tolist(), lengths[loose].tolist(), strict=True):
        at = bisect_left(room, size << 32)
        if at == len(room):
            left, b, n = limit, n, n + 1
        else:
            x = room.pop(at)
            left, b = x >> 32, x & 0xFFFFFFFF
        genome[i] = b
        if left > size:
            insort(room, (left - size) << 32 | b)
    return genome


def crossed(a: Genome, b: Genome, lengths: np.ndarray, limit: int, rng: np.random.Generator) -> Genome:
    """a with some of b's well-filled bins injected whole: a's bins that hold one of their pieces go,
    and what these held besides is put back by best fit, largest first."""
    fill = np.bincount(b, lengths)
    order = np.argsort(-(fill + rng.random(len(fill))))
    some = order[: max(1, int(len(order) * rng.uniform(0.2, 0.7)))]
    chosen = np.zeros(len(fill), bool)
    chosen[some[rng.random(len(some)) < 0.7]] = True
    injected = chosen[b]
    gone = np.zeros(a.max() + 1, bool)
    gone[a[injected]] = True
    # Of a's other bins the least filled few are dissolved too.
    kept = np.flatnonzero(~gone)
    if len(kept):
        worst = kept[np.argsort(np.bincount(a, lengths)[kept])[: max(1, len(kept) // 20)]]
        gone[worst] = True
    loose = np.flatnonzero(gone[a] & ~injected)
    child = np.where(injected, a.max() + 1 + b, a)
    child[loose] = -1
    stays = child >= 0
    child[stays] = np.unique(child[stays], return_inverse=True)[1]
    return best_fit(child, loose[np.argsort(-lengths[loose], kind="stable")], lengths, limit)


def founders(lengths: np.ndarray, how: Packing, rng: np.random.Generator) -> list[Genome]:
    """First population: best fit by falling lengths, exact and blurred."""
    found = []
    for i in range(how.population):
        blur = lengths * rng.uniform(0.8, 1.2, len(lengths)) if i else lengths
        order = np.argsort(-blur, kind="stable")
        found.append(best_fit(np.full(len(lengths), -1, np.int64), order, lengths, how.limit))
        if found[-1].max() + 1 == -(-int(lengths.sum()) // how.limit):
            break
    return found


def evolved(
    lengths: np.ndarray, population: list[Genome], how: Packing, rng: np.random.Generator
) -> list[Genome]:
    """The best `population` genomes after an epoch, best first; it ends early where the tokens need
    as many bins."""
    least = -(-int(lengths.sum()) // how.limit)
    pool = sorted(((rated(g, lengths), i, g) for i, g in enumerate(population)), key=lambda x: x[:2])
    for n in range(how.children):
        if pool[0][0][0] <= least or len(pool) < 2:
            break
        i, j = sorted(rng.choice(len(pool), 2, replace=False))
        a, b = (pool[i][2], pool[j][2]) if rng.random() < 0.5 else (pool[j][2], pool[i][2])
        child = crossed(a, b, lengths, how.limit, rng)
        rate = rated(child, lengths)
        if all(rate != r for r, _, _ in pool):
            pool = sorted([*pool, (rate, len(population) + n, child)], key=lambda x: x[:2])[: how.population]
    return [g for _, _, g in pool]


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(kind))


STATE = "shard long, island int, lengths array<int>, bins array<array<int>>"


def _epoch(how: Packing, salt: int):
    """Rows shard, island, lengths and bins (the population; empty at first) after an epoch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                lengths = one.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                rng = np.random.default_rng([how.seed, salt, one.column(0)[0].as_py(), one.column(1)[0].as_py()])
                flat = one.column(3).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                known = list(flat.reshape(-1, len(lengths))) if len(flat) else founders(lengths, how, rng)
                found = evolved(lengths, known, how, rng)
                bins = pa.array([[g.tolist() for g in found]], pa.list_(pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*(one.column(k) for k in range(3)), bins], names=["shard", "island", "lengths", "bins"])

    return run


def _evolve(shards: DataFrame, how: Packing, name: str) -> DataFrame:
    """shard and bins, the best genome of any island, of shards (shard, lengths)."""
    dealt = shards.select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(how.islands - 1))).alias("island"), "lengths",
        F.array().cast("array<array<int>>").alias("bins")
    ).repartition("shard", "island")
    state = materialize(dealt.mapInArrow(_epoch(how, 0), STATE), name)
    for epoch in range(1, how.epochs):
        elite = state.select(
            "shard", ((F.col("island") + 1) % how.islands).alias("island"), F.slice("bins", 1, 1).alias("elite")
        )
        met = state.join(elite.hint("merge"), ["shard", "island"])
        met = met.select("shard", "island", "lengths", F.array_distinct(F.concat("bins", "elite")).alias("bins"))
        state = materialize(met.mapInArrow(_epoch(how, epoch), STATE), name)
    best = F.col("bins")[0]
    used = F.array_max(best)
    return state.groupBy("shard").agg(F.min_by(best, F.struct(used, "island")).alias("bins"))


def _placed(shards: DataFrame, level: int, how: Packing) -> DataFrame:
    """uid, length, sequence_id, offset and loose (whether to deal it again) of each piece of shards
    (shard, uids, lengths, bins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                uid, length, bins = (
                    batch.column(k).slice(i, 1).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3)
                )
                order = np.argsort(bins, kind="stable")
                uid, length, bins = uid[order], length[order], bins[order]
                fill = np.bincount(bins, length).astype(np.int64)
                before = np.concatenate([[0], np.cumsum(fill)])[:-1]
                number = ((level << 40) + batch.column(0)[i].as_py() << 14) + bins
                size = np.bincount(bins)
                rank = np.argsort(fill, kind="stable")
                few = np.cumsum(size[rank]) <= max(how.again * len(bins), size[rank[0]])
                loose = np.zeros(len(fill), bool)
                loose[rank[few]] = fill[rank[few]] < how.closed * how.limit
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (uid, length, number, np.cumsum(length) - length - before[bins], loose[bins])],
                    names=["uid", "length", "sequence_id", "offset", "loose"]
                )

    return shards.select("shard", "uids", "lengths", "bins").mapInArrow(
        run, "uid long, length long, sequence_id long, offset long, loose boolean"
    )


def pack(cut: DataFrame, how: Packing = Packing()) -> DataFrame:
    """uid, sequence_id and offset of every piece (uid, length) of a stored table."""
    whole = F.col("length") == how.limit
    done = [cut.where(whole).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest, level = cut.where(~whole).select("uid", "length"), 0
    n = rest.count()
    while n:
        shards = -(-n // how.shard)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)))
        listed = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("length", "uid"))).alias("l"))
        listed = materialize(
            listed.select("shard", F.col("l.uid").alias("uids"), F.col("l.length").cast("array<int>").alias("lengths")),
            "pack-shards"
        )
        best = _evolve(listed.select("shard", "lengths"), how, "pack-islands")
        placed = materialize(_placed(listed.join(best.hint("merge"), "shard"), level, how), "packed")
        loose = placed.where("loose")
        left = loose.count() if shards > 1 else 0
        if not 0 < 2 * left <= n:
            done.append(placed.select("uid", "sequence_id", "offset"))
            break
        done.append(placed.where("not loose").select("uid", "sequence_id", "offset"))
        rest, n, level = loose.select("uid", "length"), left, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, how: Packing = Packing(), vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of documents
    (doc_id, text)."""
    cut = pieces(docs, how, vocabulary)
    return cut.join(pack(cut, how).hint("merge"), "uid").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
