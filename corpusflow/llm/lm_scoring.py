"""Language-model scores by online logistic context mixing.

A text and an end mark are coded byte by byte as walks down the Huffman tree of the byte before;
each step is a bit. Several predictors (contexts: the last one, two, three and four bytes, the
current word's last six bytes) give the odds of a bit from how often the tree node was left either
way in the context. Their log odds are combined by weights, of which a gate picks a set; a second
stage refines the mix. Weights start equal and are adapted online while a block of BLOCK bytes is
coded, a mini-batch of STEP bits at a time; each block starts anew, so a block's cost doesn't
depend on how documents are dealt to tasks.

Everything that a predictor needs to know of a byte is its key: the byte, the four before it, up to
six if they are of the current word, and how many of these there are. A stretch of text has far fewer distinct keys than bytes, so
odds are looked up once a distinct key and then gathered. Distinct keys are sorted by byte, the
byte before it, and so on: then all keys with the same byte and context are neighbours.

Contexts are counted exactly over all training documents, in a table that grows with the corpus:
a count for each predictor, context and byte, which gives the counts of all tree nodes. Frequent
contexts are looked up in a bounded broadcast table; all others are joined, a row for each piece
of PIECE bytes and context in it.

Beside it stands the add-one unigram score of the contract, whose counts are exact: words
frequent in the corpus are looked up in a bounded broadcast table, all others are joined.

Defined results: a null or empty text is its end mark alone; a null doc_id counts as the empty
text in the hold-out rule; rows that repeat get equal rows; an empty table gives an empty one;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.scan import SPACE, parts, scans
from corpusflow.sources.batches import bound_batches
from corpusflow.sources.scratch import drop_part, materialize

ORDERS = 5
WIDTH = 8  # of a step's row of inputs: 32 bytes are gathered faster than what is used of them
BLOCK = 4096
STEP = 64  # a power of 2
GATES = 8
RATE, REFINE_RATE = 0.004, 0.002
START_WEIGHT = 0.35
#: Words, and pairs of context and byte, in broadcast tables; all others are joined.
FREQUENT_WORDS = 1 << 17
FREQUENT_PAIRS = 1 << 20
#: Bytes of text whose contexts are joined together (a longer document is a piece of its own), and
#: twice those of text that is worked on at a time.
PIECE = 1 << 23
STRETCH = 1 << 23
#: Bytes of a row group of the stored pieces, beyond which a piece has one of its own.
ROW_GROUP = 1 << 20
#: Pairs whose tree nodes are counted at a time (a context's pairs stay together).
NODE_PAIRS = 1 << 17
#: Pairs of a task's pieces that are added up before they are written.
MERGED = 1 << 22
#: Distinct keys, or pairs, whose steps are looked up at a time.
LOOKUPS = 1 << 14
#: Bits of a key that are the byte and so many before it.
KNOWN = (1 << (8 * np.arange(7) + 8)) - 1
#: Hash of the end token, which no word has: words are never empty.
END = -1


def held_out(modulus: int = 7, remainder: int = 2):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def huffman(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """Walk of each of the 256 bytes down their Huffman tree: inner nodes (0 to 254) and bits."""
    heap = [(int(c) + 1, s, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    for new in range(256, 511):
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (new, 0), (new, 1)
        heapq.heappush(heap, (a + b, new, new))
    walks = []
    for s in range(256):
        walk, at = [], s
        while at in parent:
            at, bit = parent[at]
            walk.append((at - 256, bit))
        walks.append(walk[::-1])
    return walks


class Trees:
    """A Huffman tree for each byte before. For a symbol (byte before << 8 | byte): the length of
    its walk, the place of its first step in the flat tables and, there, each step's bit, the node
    it leaves and its gate (depth, 3 at most, and whether the byte before is no space or mark)."""

    def __init__(self, counts: np.ndarray):
        every = huffman(counts.sum(0))
        walks = [w for row in counts for w in (huffman(row) if row.any() else every)]
        self.length = np.array([len(w) for w in walks])
        self.at = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.nodes = np.array([n for w in walks for n, _ in w], np.uint8)
        self.bits = np.array([b for w in walks for _, b in w], np.int8)
        self.gates = np.array(
            [min(i, 3) + 4 * (s >> 8 > 96) for s, w in enumerate(walks) for i in range(len(w))], np.int8
        )

    def walk(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First step of each symbol, and each step's place in the flat tables."""
        length = self.length[symbols]
        first = np.concatenate([[0], np.cumsum(length)])
        return first, np.arange(first[-1]) + np.repeat(self.at[symbols] - first[:-1], length)


def with_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' bytes with an end mark (0) after each, and their new offsets."""
    n = len(offsets) - 1
    at = offsets + np.arange(n + 1)
    out = np.zeros(at[-1], np.uint8)
    keep = np.ones(at[-1], bool)
    keep[at[1:] - 1] = False
    out[keep] = data
    return out, at


def stretches(offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document, first byte and end of each block, stretch by stretch; blocks lie end to end."""
    n_blocks = -(-np.diff(offsets) // BLOCK)
    doc = np.repeat(np.arange(len(n_blocks)), n_blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    starts = offsets[doc] + nth * BLOCK
    stops = np.minimum(starts + BLOCK, offsets[doc + 1])
    i = 0
    while i < len(doc):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + STRETCH // 2, "right")))
        yield doc[i:j], starts[i:j], stops[i:j]
        i = j


def byte_keys(data: np.ndarray, offsets: np.ndarray, first: int, stop: int) -> np.ndarray:
    """Key of each byte from first (the start of a block) to stop: the byte (8 bits), those before it
    that a predictor knows (48 bits; the last four, up to six of the current word; 0 beyond the document's
    start) and how many of these there are (3 bits). Its low 16 bits are the byte's symbol."""
    before = data[max(0, first - 7) : first]
    full = np.concatenate([np.zeros(7 - len(before), np.uint8), before, data[first:stop]])
    n = stop - first
    keys = np.ndarray(n, "<i8", full[::-1].tobytes(), n - 1, (-1,)).astype(np.int64)  # a byte and the seven before
    space = (full == 32) | (full >= 9) & (full <= 13)
    apart = space[6 : 6 + n]
    for i in range(2, 6):
        apart = apart | space[7 - i : 7 - i + n]
    known = 6 - apart.view(np.int8)  # the fifth byte before is of another word, or is none of a word
    known -= (apart | space[1 : 1 + n]).view(np.int8)
    own = slice(np.searchsorted(offsets, first), np.searchsorted(offsets, stop))
    begins, ends = offsets[own] - first, np.append(offsets, offsets[-1])[own.start + 1 : own.stop + 1] - first
    for i in range(6):
        at = begins[ends - begins > i] + i
        at = at[at < n]
        known[at] = np.minimum(known[at], i)
    for i in range(0, n, LOOKUPS):  # some at a time, in the cache
        part, of = keys[i : i + LOOKUPS], known[i : i + LOOKUPS]
        part &= KNOWN.take(of)
        part |= of.astype(np.int64) << 56
    return keys


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ordered by byte, byte before, and so on, and each key's place among them; by
    hash, so that only the distinct ones are sorted."""
    found = pa.array(keys).dictionary_encode()
    del keys
    pa.default_memory_pool().release_unused()  # the table of hashes, which is larger than the keys
    own = found.dictionary.to_numpy()
    order = np.argsort(own.view(np.uint64).byteswap())
    place = np.empty(len(own), np.int32)
    place[order] = np.arange(len(own))
    return own[order], place.take(found.indices.to_numpy())


def firsts(values: np.ndarray) -> np.ndarray:
    """Whether each value differs from the one before it."""
    return np.append(True, values[1:] != values[:-1])[: len(values)]


def contexts(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Each predictor's context of each key, one to one: predictor, number of bytes known (3 bits)
    and those bytes (48 bits). The word's context is the byte before where no word has begun (7)."""
    six, size = keys >> 8 & ((1 << 48) - 1), keys >> 56
    for i in range(4):
        yield six & ((1 << (8 * i + 8)) - 1) | np.minimum(size, i + 1) << 48 | i << 51
    own, known, alive = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.ones(len(keys), bool)
    for i in range(6):
        byte = six >> (8 * i) & 255
        alive = alive & (size > i) & ~SPACE[byte]
        own |= (byte << (8 * i)) * alive
        known += alive
    between = (known == 0) & (size > 0)
    yield np.where(between, six & 255 | 7 << 48, own | known << 48) | 4 << 51


def add_up(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of each."""
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(firsts(keys))
    return keys[first], np.add.reduceat(n, first, dtype=np.int64) if len(first) else n.astype(np.int64)


def merge(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """add_up() of all; one alone is in order already, unless it is a stretch's."""
    return found[0] if len(found) == 1 and (np.diff(found[0][0]) > 0).all() else add_up(*map(np.concatenate, zip(*found, strict=True)))


def in_parts(pairs: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs and their counts in order, some contexts at a time."""
    order, i = np.argsort(pairs), 0
    pairs, n = pairs[order], n[order]
    while i < len(pairs):
        last = pairs[min(i + NODE_PAIRS, len(pairs)) - 1]
        stop = int(np.searchsorted(pairs, (last >> 8) + 1 << 8))
        yield pairs[i:stop], n[i:stop]
        i = stop


def joined_in_parts(right: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same from contexts with lists of (count << 8 | byte)."""
    lists, context = right.column("bytes").combine_chunks(), right.column("context").to_numpy()
    order = np.argsort(context)
    step = max(1, NODE_PAIRS * len(order) // max(1, len(lists.values)))
    for i in range(0, len(order), step):
        own = lists.take(pa.array(order[i : i + step]))
        values = own.flatten().to_numpy()
        pairs = np.repeat(context[order[i : i + step]], np.diff(own.offsets.to_numpy())) << 8 | values & 255
        within = np.argsort(pairs)
        yield pairs[within], values[within] >> 8


class Odds:
    """Log odds of tree nodes in contexts, from counts of (context << 8 | byte). They come in parts in
    order of context, none of which is in two parts, so that only the odds are held for all."""

    def __init__(self, trees: Trees, parts: Iterable[tuple[np.ndarray, np.ndarray]]):
        node, odds = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
        for pairs, n in parts:
            for into, values in zip((node, odds), self._count(trees, pairs, n), strict=True):
                into.append(values)
        self.node = np.concatenate(node)
        del node
        self.odds = np.concatenate(odds)

    @staticmethod
    def _count(trees: Trees, pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, step = trees.walk(pairs & 0xFFFF)
        length = np.diff(first)
        node, at = np.unique(np.repeat(pairs >> 8 << 8, length) | trees.nodes[step], return_inverse=True)
        n, bit = np.repeat(n, length), trees.bits[step]
        ones, both = np.bincount(at, n * bit, len(node)), np.bincount(at, n, len(node))
        return node, np.log((ones + 0.4) / (both - ones + 0.4)).astype(np.float32)

    def look_up(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes are here, and the odds of these."""
        if not len(self.node):
            return np.zeros(len(nodes), bool), self.odds
        at = np.minimum(np.searchsorted(self.node, nodes), len(self.node) - 1)
        met = self.node.take(at) == nodes
        return met, self.odds.take(at[met])


class Steps:
    """The steps of each distinct key: the first one, number, gate, and inputs: each predictor's log
    odds of the bit that is taken (0 for nodes never seen), then 1 or -1 for a one or zero, then 0.
    One more step, of zeros, stands for places beyond a block's end."""

    def __init__(self, trees: Trees, known: list[Odds], keys: np.ndarray):
        self.length = trees.length[keys & 0xFFFF]
        self.first = np.concatenate([[0], np.cumsum(self.length)])
        self.gate = np.zeros(self.first[-1] + 1, np.int8)
        self.inputs = np.zeros((self.first[-1] + 1, WIDTH), np.float32)
        found = [self._odds(trees, known, own << 8 | keys & 255) for own in contexts(keys)]
        # Some keys at a time: their inputs stay in the cache, and what they take meanwhile is small.
        for i in range(0, len(keys), LOOKUPS):
            part = slice(i, i + LOOKUPS)
            first, step = trees.walk(keys[part] & 0xFFFF)
            own = slice(self.first[i], self.first[i] + first[-1])
            self.gate[own] = trees.gates[step]
            self.inputs[own, ORDERS] = trees.bits[step] * 2 - 1
            length, place = self.length[part], np.arange(first[-1])
            for k, (start, odds) in enumerate(found):
                self.inputs[own, k] = odds.take(np.repeat(start[part] - first[:-1], length) + place)

    @staticmethod
    def _odds(trees: Trees, known: list[Odds], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key's steps start among those of the distinct pairs, and the log odds of these."""
        new = firsts(pairs)
        at, pairs = np.cumsum(new) - 1, pairs[new]
        order = np.argsort(pairs)  # for the tables are searched faster in order
        pairs = pairs[order]
        begin = np.concatenate([[0], np.cumsum(trees.length[pairs & 0xFFFF])])
        odds = np.zeros(begin[-1], np.float32)
        for i in range(0, len(pairs), LOOKUPS):
            part = pairs[i : i + LOOKUPS]
            first, walk = trees.walk(part & 0xFFFF)
            nodes = np.repeat(part >> 8 << 8, np.diff(first)) | trees.nodes.take(walk)
            own, left = odds[begin[i] : begin[i] + len(nodes)], np.arange(len(nodes))
            for table in known:  # a node is in one of them
                met, values = table.look_up(nodes)
                own[left[met]] = values
                left, nodes = left[~met], nodes[~met]
            own *= trees.bits.take(walk) * 2 - 1
        start = np.empty(len(order), np.int32)
        start[order] = begin[:-1]
        return start.take(at), odds


def gathered(batches: Iterable[pa.RecordBatch], size: int, column: int = 1) -> Iterator[pa.Table]:
    """Batches of texts (in that column), so many together as hold size bytes at most, or one."""
    held, n = [], 0
    for batch in batches:
        own = pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if held and n + own > size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        held.append(batch)
        n += own
    if held:
        yield pa.Table.from_batches(held)


def pieces(docs: DataFrame) -> DataFrame:
    """Documents by pieces of about PIECE bytes, written out: piece, ids, held (out), offsets and
    packed (the bytes, end marks included). Pieces are large rows, so a row group holds one or a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstd.ZstdCompressor(level=1)
        for table in gathered(batches, PIECE):
            ids, held = (table.column(c).combine_chunks() for c in (0, 2))
            for i, data, offsets in parts(table.column(1), PIECE):
                data, offsets = with_ends(data, offsets)
                row = lambda of: pa.ListArray.from_arrays(pa.array([0, len(of)], pa.int32()), of)
                own = [row(x.slice(i, len(offsets) - 1)) for x in (ids, held)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *own, row(pa.array(offsets, pa.int64())),
                        pa.array([packer.compress(data.tobytes())], pa.binary())
                    ],
                    names=["ids", "held", "offsets", "packed"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", "held_out").mapInArrow(
        run, f"ids array<{kind}>, held array<boolean>, offsets array<long>, packed binary"
    )
    return materialize(found.withColumn("piece", F.monotonically_increasing_id()), "lm-pieces", row_group=ROW_GROUP)


def unpack(packed: pa.Scalar, offsets: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    data = zstd.ZstdDecompressor().decompress(packed.as_py()) if offsets.values[-1].as_py() else b""
    return np.frombuffer(data, np.uint8), offsets.values.to_numpy()


def count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs (context << 8 | byte) with their number n in training documents, if there is
    any, of one or more pieces; each piece's distinct contexts with n = 0: piece, key, n."""

    def rows(piece: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 100_000):
            part = keys[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), piece)), pa.array(part), pa.array(n[i : i + 100_000])], names=["piece", "key", "n"]
            )

    total: list[list] = [[] for _ in range(ORDERS)]  # each predictor's, which are added up by themselves
    merged, last = 0, 0
    for batch in batches:
        for piece, packed, offsets, out in zip(
            batch.column("piece"), batch.column("packed"), batch.column("offsets"), batch.column("held"), strict=True
        ):
            (data, offsets), used = unpack(packed, offsets), ~np.array(out.as_py(), bool)
            held: list[list] = [[] for _ in range(ORDERS)]
            for doc, starts, stops in stretches(offsets):
                mine = np.repeat(used[doc], stops - starts)
                keys, at = distinct(byte_keys(data, offsets, starts[0], stops[-1]))
                often = np.bincount(at[mine], minlength=len(keys))
                del at, mine
                for met, own in zip(held, contexts(keys), strict=True):
                    pairs = own << 8 | keys & 255
                    new = np.flatnonzero(firsts(pairs))
                    met.append((pairs[new], np.add.reduceat(often, new).astype(np.int32)))  # a stretch is small
                del keys, often, own, pairs, new  # else they are held while the next stretch's are made
            last = piece.as_py()
            for k in range(ORDERS):
                (pairs, n), held[k] = merge(held[k]), []
                own = pairs >> 8  # in order, as pairs are
                own = own[firsts(own)]
                yield from rows(last, own, np.zeros(len(own), np.int64))
                total[k].append((pairs[n > 0], n[n > 0]))
                merged += len(total[k][-1][0])
            if merged >= MERGED:
                for own in total:
                    yield from rows(last, *merge(own))
                    own.clear()
                merged = 0
    for own in total if merged else []:
        yield from rows(last, *merge(own))


def mix_cost(steps: Steps, step: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bits that each block costs, whose steps lie end to end, the longest block first. Blocks are
    coded side by side, a mini-batch of each at a time."""
    n, rounds, cost = len(length), -(-int(length[0]) // STEP), np.zeros(len(length))
    place = np.full((n, rounds * STEP), len(steps.gate) - 1)
    place[np.arange(rounds * STEP) < length[:, None]] = step
    base = np.arange(n * STEP).reshape(n, STEP) * GATES  # slots are (block, bit, gate)
    # The weights of the sign and beyond are 0: it has its part in the second stage alone.
    weights = np.zeros((n, GATES, WIDTH), np.float32)
    weights[:, :, :ORDERS] = START_WEIGHT
    learns = np.zeros(WIDTH, np.float32)
    learns[:ORDERS] = RATE
    scale, shift = np.ones(n, np.float32), np.zeros(n, np.float32)
    for r in range(rounds):
        live = int(np.searchsorted(-length, -r * STEP))
        at = place[:live, r * STEP : (r + 1) * STEP]
        # No place is out of range; clipping is the faster check.
        own, slot = steps.inputs.take(at, axis=0, mode="clip"), steps.gate.take(at, mode="clip") + base[:live]
        both = weights[:live] * -scale[:live, None, None]  # both stages in one
        both[:, :, ORDERS] = -shift[:live, None]
        # Odds against the bit taken, by each gate's weights, of which its own gate's count.
        against = (own @ both.transpose(0, 2, 1)).take(slot, mode="clip")
        np.exp(np.minimum(against, 30, out=against), out=against)
        against += 1
        cost[:live] += np.log(against).sum(1)
        miss = 1 - 1 / against
        by_gate = np.zeros((live, STEP, GATES), np.float32)
        by_gate.reshape(-1)[slot.reshape(-1)] = miss.reshape(-1)
        change = by_gate.transpose(0, 2, 1) @ own  # of the sign: the sum of misses of ones, less that of zeros
        scale[:live] += REFINE_RATE * np.vecdot(weights[:live].reshape(live, -1), change.reshape(live, -1))
        shift[:live] += REFINE_RATE * change[:, :, ORDERS].sum(1)
        weights[:live] += change * learns
    return cost / np.log(2) - (-length % STEP)  # a bit for each place beyond the end


def text_bits(trees: Trees, known: list[Odds], data: np.ndarray, offsets: np.ndarray, group: int = 64) -> np.ndarray:
    """Bits of each document, end marks included. known: tables that hold all contexts' odds.
    Blocks are coded group by group, those of like length together."""
    total = np.zeros(len(offsets) - 1)
    for doc, starts, stops in stretches(offsets):
        keys, at = distinct(byte_keys(data, offsets, starts[0], stops[-1]))
        steps = Steps(trees, known, keys)
        starts, stops = starts - starts[0], stops - starts[0]
        lengths, begins = steps.length.astype(np.int16), steps.first.astype(np.int32)  # small, for the cache
        size = np.add.reduceat(lengths.take(at), starts, dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        for g in range(0, len(order), group):
            own = order[g : g + group]
            part = np.concatenate([at[starts[i] : stops[i]] for i in own])
            length, first = lengths.take(part), begins.take(part)
            step = np.ones(size[own].sum(), np.int32)  # on from the one before, but for a byte's first
            step[0] = first[0]
            step[np.cumsum(length[:-1], dtype=np.int32)] += first[1:] - first[:-1] - length[:-1]
            np.cumsum(step, out=step)
            total += np.bincount(doc[own], mix_cost(steps, step, size[own]), len(total))
            del part, length, first, step
        del keys, at, steps  # else they are held while the next stretch's are made
    return total


def word_counts(training: DataFrame) -> DataFrame:
    """word (64-bit hash) and count over all training documents, end tokens not included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, PIECE, 0):
            words = [(x.word_hashes(lower=True) >> np.uint64(1)).astype(np.int64) for x in scans(table.column(0))]
            if words:
                found = pa.array(np.concatenate(words)).value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])

    return training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, room: int, size: str = "1") -> DataFrame:
    """The rows of counts with the largest n whose sizes add up to room at most: all from the least
    count on with which they fit, by quarters of powers of 2."""
    grade, least = F.floor(4 * F.log2("n")), None
    sums = counts.groupBy(grade.alias("g")).agg(F.sum(F.expr(size)).alias("size"))
    for r in sorted(sums.collect(), key=lambda r: -r.g):  # at most 256 rows
        room -= r["size"]
        if room < 0:
            break
        least = r.g
    return counts.where(grade >= (least if least is not None else 256))


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    bits_per_byte of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(modulus, remainder))
    training = docs.where(~F.col("held_out"))
    counts = materialize(word_counts(training), "lm-words")
    n_docs = training.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("n").alias("v")).first()
    tokens, kinds = (sums.n or 0) + n_docs, sums.v + (n_docs > 0)
    top = most_frequent(counts, FREQUENT_WORDS).toArrow().sort_by("word")
    words, often = (top.column(c).to_numpy() for c in ("word", "n"))
    cut = pieces(docs)
    met = cut.mapInArrow(count_contexts, "piece long, key long, n long").withColumn("counted", F.col("n") > 0)
    met = materialize(met, "lm-met", by="counted")
    pairs = materialize(met.where("counted").groupBy(F.col("key").alias("pair")).agg(F.sum("n").alias("n")), "lm-pairs")
    drop_part(met, "counted", "true")  # the largest table, which nothing reads again
    pairs = pairs.select(F.shiftright("pair", 8).alias("context"), "pair", "n")
    symbols = np.zeros(1 << 16, np.int64)
    for r in pairs.where(F.col("pair") < 1 << 59).collect():  # the first predictor's: at most 65,792 rows
        symbols[r.pair & 0xFFFF] += r.n
    trees = Trees(symbols.reshape(256, 256))
    by_context = pairs.groupBy("context").agg(F.sum("n").alias("n"), F.count("n").alias("pairs"))
    often_met = materialize(most_frequent(by_context, FREQUENT_PAIRS, "pairs").select("context"), "lm-frequent")
    held = pairs.join(F.broadcast(often_met), "context").select("pair", "n").toArrow()  # FREQUENT_PAIRS rows at most
    held = [held.column(c).to_numpy() for c in ("pair", "n")]
    model = spark.sparkContext.broadcast((Odds(trees, in_parts(*held)), words, often))
    rare = met.where("not counted").select("piece", F.col("key").alias("context")).join(
        F.broadcast(often_met), "context", "left_anti"
    )
    # No context here is among the most frequent ones, so none is hot; one has 256 bytes at most.
    packed = pairs.groupBy("context").agg(
        F.collect_list(F.shiftleft("n", 8).bitwiseOR(F.col("pair").bitwiseAND(F.lit(255)))).alias("bytes")
    )
    rest_odds = rare.join(packed.hint("merge"), "context").select("piece", "context", "bytes")
    total = float(np.log10(tokens + 1 * (kinds + 1)))
    end = float(np.log10(n_docs + 1)) - total

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        odds, word, count = model.value
        own = Odds(trees, joined_in_parts(right))
        found = []
        for row in range(left.num_rows):
            at = {c: left.column(c)[row] for c in left.column_names}
            data, offsets = unpack(at["packed"], at["offsets"])
            cost = text_bits(trees, [odds, own], data, offsets)
            keep = np.ones(len(data), bool)
            keep[offsets[1:] - 1] = False
            bare = offsets - np.arange(len(offsets))
            texts = pa.LargeStringArray.from_buffers(len(bare) - 1, pa.py_buffer(bare), pa.py_buffer(data[keep]))
            for scan in scans(texts):
                part = slice(scan.first, scan.first + scan.n)
                h = pa.array((scan.word_hashes(lower=True) >> np.uint64(1)).astype(np.int64)).dictionary_encode()
                kinds, h = h.dictionary.to_numpy(), h.indices.to_numpy()
                at_word = np.minimum(np.searchsorted(word, kinds), max(len(word) - 1, 0))
                frequent = word[at_word] == kinds if len(word) else np.zeros(len(kinds), bool)
                part_of = np.zeros(len(kinds))
                part_of[frequent] = np.log10(count[at_word[frequent]] + 1) - total
                met = frequent.take(h)
                n_words, n_met = scan.per_doc(scan.doc), scan.per_doc(scan.doc[met])
                base = np.bincount(scan.doc, part_of.take(h), scan.n) + end
                rest, tf = np.unique(scan.doc[~met] * len(kinds) + h[~met], return_counts=True)
                doc, kind = np.divmod(rest, max(len(kinds), 1))
                cuts = pa.array(np.concatenate([[0], np.cumsum(scan.per_doc(doc))]).astype(np.int32))
                found.append(pa.Table.from_arrays(
                    [at["ids"].values.slice(scan.first, scan.n), at["held"].values.slice(scan.first, scan.n), pa.array(n_words + 1), pa.array(n_met + int(n_docs > 0)), pa.array(base),
                     pa.array(cost[part] * -np.log10(2)), pa.array(
                         cost[part] / (np.diff(scan.offsets) + 1)
                     ), *(pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (kinds[kind], tf))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte", "word", "tf"],
                ))
        return pa.concat_tables(found)

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = cut.groupBy("piece").cogroup(rest_odds.groupBy("piece")).applyInArrow(
        run,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double, word array<long>, tf array<long>"
    )
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    # Rare words, exactly: no word here is among the most frequent ones, so none is hot.
    rare = scored.select("row", F.inline(F.arrays_zip("word", "tf")))
    rare = rare.join(counts.hint("merge"), "word", "left")
    n = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("known"),
        F.sum(F.col("tf") * (F.log10(n + 1) - total)).alias("part")
    )
    return scored.join(sums.hint("merge"), "row", "left").select(
        "doc_id", "held_out", "n_tokens", (
            F.col("n_known") + F.coalesce("known", F.lit(0))
        ).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("part", F.lit(0.0))).alias("base_score"), "score", "bits_per_byte",
    )
