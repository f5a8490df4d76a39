"""Clustering, lexical search and packing against brute force, on odd rows and on shards."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

pytest.importorskip("corpusflow.llm")

import numpy as np  # noqa: E402

from corpusflow.llm import centroids, lexical_search, packing, registry, sql  # noqa: E402

SF = "/root/testdata/sf0.001"


def clusters_by_force(rows, k=8, rounds=10, size=64):
    kept = []
    for i, v in rows:
        if v is None or len(v) != size or any(x is None or not math.isfinite(x) or abs(x) >= 2**17 for x in v):
            continue
        kept.append((i, [math.floor(1024 * x) for x in v]))
    name = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centre = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(centre)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centre)):
            mine = [v for (_, v), (_, c) in zip(kept, at, strict=True) if c == j]
            if mine:
                centre[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    at, inertia = assign(), collections.Counter()
    for d, c in at:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centre]
    return sorted(
        (str(i), c, d, inertia[c], sum(inertia.values()), digest[c]) for (i, _), (d, c) in zip(kept, at, strict=True)
    )


def test_clusters_by_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(i % 5, 0.6) for _ in range(64)]) for i in range(160)]
    rows += [(7, rows[9][1]), (8, rows[9][1]), (None, rows[4][1]), (None, None), (900, None), (901, []), (902, [0.5] * 63)]
    rows += [(903, [float("nan")] + [0.1] * 63), (904, [float("inf")] * 64), (905, [None] + [0.1] * 63), (906, [1e30] * 64)]
    rows += [(1000 + i, [0.0] * 64) for i in range(5)] + [(2000, [1.5] * 65), (2001, [-0.0001] * 64)]
    table = spark.createDataFrame(
        [(i, v, 1, "x", [1]) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string, p array<int>"
    )
    # What the table holds are floats.
    held = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = centroids.cluster(table.repartition(3)).collect()
    assert sorted((str(a), *b) for a, *b in found) == clusters_by_force(held)
    assert found[0].asDict().keys() == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"}
    assert centroids.cluster(table.where("vec_id = 1")).count() == 1
    none = centroids.cluster(table.where("vec_id = 900"))
    assert none.count() == 0 and none.schema.simpleString() == centroids.cluster(table).schema.simpleString()


def test_pivots_exclude_centroids_and_lose_none():
    rng = np.random.default_rng(1)
    middle = rng.integers(-4000, 4000, (8, 64))
    rows = middle[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 64))
    pivots = centroids.choose_pivots(rows[:200], 12)
    best, distance, measured = centroids.nearest(
        rows, centroids.pivot_rows(rows, pivots), middle, centroids.pivot_rows(middle, pivots)
    )
    every = np.stack([centroids.squares(rows, c) for c in middle], axis=1)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert measured < 0.2 * every.size
    big = rng.integers(0, 2**62, 2000)
    assert [math.isqrt(int(x)) for x in big] == centroids.roots(big).tolist()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked_by_force(docs, items, k=10):
    held = [(i, collections.Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall(lower(text or "")))
        scores = []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(str(item), r + 1, str(x[3]), -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out)


def search_case():
    r = random.Random(8)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(30_000)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(i, text(r.choice([1, 5, 30, 200]))) for i in range(400)]
    docs += [(5, "w1 W1-w2"), (6, "w1 w1 w2"), (6, "w1 w1 w2"), (None, "w1 w2 w3"), (None, None), (500, ""), (501, " .,- ")]
    docs += [(502, "Straße straße STRASSE Ünï"), (503, "w2 " * 40_000), (504, text(20_000)), (505, "ünï x" * 3), (506, "W77 w77")]
    items = [(i, text(12)) for i in range(8)] + [(90, None), (91, "?!"), (92, "straße ÜNÏ"), (93, "nowhere"), (94, "w1 w1 w2"), (None, "w77")]
    return docs, items


def test_search_by_force(spark):
    docs, items = search_case()
    table = spark.createDataFrame([(i, t, 1, [2], "x") for i, t in docs], "doc_id long, text string, n int, terms array<int>, q string")
    asked = spark.createDataFrame([(i, t, 3, 4) for i, t in items], "item_id long, text string, q int, doc_id int")
    force = ranked_by_force(docs, items)
    for how in (lexical_search.Signatures(), lexical_search.Signatures(docs=16, terms=64, bits=2, hashes=2)):
        index = lexical_search.build_index(table.repartition(3), how)
        for limit in (2048, 5):
            found = lexical_search.search(index, asked, pass_queries=limit, how=how)
            assert sorted((str(r.item_id), r.rank, str(r.doc_id), r.score) for r in found.collect()) == force
    assert lexical_search.search(lexical_search.build_index(table.where("false")), asked).count() == 0
    assert lexical_search.search(index, asked.where("false"), how=how).count() == 0


def test_bounds_are_never_too_low_and_exclude():
    docs, items = search_case()
    how, texts = lexical_search.Signatures(), [t for _, t in docs]
    import pyarrow as pa

    blocks = [
        lexical_search.Block([docs[i][0] for i in some], n, width, bits, starts, terms, tf)
        for some, n, width, bits, starts, terms, tf in lexical_search._blocks(pa.array(texts), how)
    ]
    query = [[h for b in lexical_search._blocks(pa.array([t]), how) for h in b[5].tolist()] for _, t in items]
    terms = np.unique(np.array([h for q in query for h in q]))
    pairs = np.array(sorted((int(np.searchsorted(terms, h)), i) for i, q in enumerate(query) for h in q))
    look = lexical_search.Lookup(
        terms, np.full(len(terms), 700), np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1], len(items)
    )
    best, scored, all_pairs = lexical_search.Best(len(items), 3), 0, 0
    for block in blocks:
        m = 10 + block.n // 2
        bound = lexical_search.bounds(block, look, m, how.hashes)
        whole = lexical_search.exact(block, look, m, np.ones(bound.shape, bool))
        assert (bound >= whole).all() and bound.sum() < 3 * whole.sum()
        scored += lexical_search.search_block(block, look, m, best, how.hashes)
        all_pairs += (whole > 0).sum()
    assert scored < 0.5 * all_pairs


def test_blocks_hold_documents_of_like_size():
    """A large document doesn't widen the signatures of small ones."""
    import pyarrow as pa

    texts = [f"few words {i}" for i in range(1000)] + [" ".join(map(str, range(50_000)))]
    blocks = list(lexical_search._blocks(pa.array(texts), lexical_search.Signatures()))
    assert sorted(i for b in blocks for i in b[0].tolist()) == list(range(1001))
    assert sum(b[3].nbytes for b in blocks) < 2_000_000


def test_index_is_stored_in_small_row_groups(spark):
    """Of an index's large rows, a task that writes or reads them holds a few."""
    import pyarrow.parquet as pq

    texts = [(i, " ".join(f"{i}x{j}" for j in range(60_000))) for i in range(20)]
    index = lexical_search.build_index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    sizes = [f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
    assert sum(sizes) > 16 << 20 and max(sizes) < 8 << 20
    found = lexical_search.search(index, spark.createDataFrame([(1, "3x7 3x8 19x5")], "item_id long, text string"))
    assert [r.doc_id for r in found.orderBy("rank").collect()] == [3, 19]


def test_bounds_take_little_memory():
    """Beside the sums, a block's bounds take some MB, however many terms and queries there are."""
    import tracemalloc

    import pyarrow as pa

    r, how = random.Random(5), lexical_search.Signatures()
    texts = [" ".join(str(r.randrange(20_000)) for _ in range(60)) for _ in range(1024)]
    ((some, n, width, bits, starts, terms, tf),) = lexical_search._blocks(pa.array(texts), how)
    block = lexical_search.Block(some.tolist(), n, width, bits, starts, terms, tf)
    every = np.unique(terms)
    of = np.concatenate([(np.arange(50) * 7 + i) % 500 for i in range(len(every))])
    look = lexical_search.Lookup(every, np.full(len(every), 700), np.arange(len(every) + 1) * 50, of, 500)
    tracemalloc.start()
    bound = lexical_search.bounds(block, look, np.full(len(n), 100), how.hashes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < bound.nbytes + (48 << 20)
    assert (bound >= lexical_search.exact(block, look, np.full(len(n), 100), np.ones(bound.shape, bool))).all()


ODD = [
    None, "", " \n\t ", "word", "Don't we'll 'tis it's,'s 12 345 a1b2", "a\x01b \x01 x\x01\x01", "é é ́x a ́",
    "no break space\u0085line", "İstanbul ΣΑΣ ΟΔΟΣ ς", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a|b|c |d", "漢字かな交じり文 🙂👩‍👩‍👧 ﬁ",
    "x" * 30_000, "tab\x0bvt\x0cff\x1fus", " " * 5000 + "end", "a.b.c...!!! ??", "ẞß ǅ"
]


def test_ids_are_the_tokenizers(spark):
    import pyarrow as pa
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    r = random.Random(4)
    marks = ["'", "s", "S", "re", " ", "́", "9", ".", "\x01", "é", "\n", " ", "ll", "-", "<|endoftext|>", "|", "<|EndOfText|>", "T", "K", "🙂"]
    texts = ODD + ["".join(r.choice(marks) for _ in range(60)) for _ in range(300)]
    with open(packing.vocabulary_path(), "rb") as f:
        vocabulary = f.read()
    for most in (1 << 20, 3):
        coder, found = packing.Coder(vocabulary, most), []
        for scan in packing.scans(pa.array(texts), size=2000):
            ids, begin = packing.encoded(coder, scan)
            found += [ids[a:b].tolist() for a, b in zip(begin, begin[1:], strict=False)]
        assert found == [plain.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def check_packed(rows, limit):
    """Sequences are gapless and within the limit; returns their number."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= limit
    return len(by)


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.vocabulary_path())
    rows = list(enumerate(ODD)) + [(3, "word"), (None, "word"), (None, None), (77, "hello big world " * 3000)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, uid int, length int, piece string")
    found = packing.pack_documents(docs.repartition(3)).collect()
    expected = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            expected.append((str(i), p // 2048, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    assert check_packed(found, 2048) == -(-sum(r.length for r in found) // 2048)
    assert packing.pack_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("kind,size", [("mixed", 100), ("mixed", 2048), ("large", 100), ("thirds", 200), ("one", 100)])
def test_packing_over_shards(spark, kind, size):
    r = random.Random(kind)
    draw = {
        "mixed": lambda: r.choice([r.randint(1, 80), r.randint(1, 100)]), "large": lambda: r.randint(51, 99),
        "thirds": lambda: r.choice([33, 34, 35, 66, 64, 20]), "one": lambda: 100
    }[kind]
    lengths = [draw() for _ in range(1500)]
    from corpusflow.sources.scratch import materialize

    cut = materialize(spark.createDataFrame(list(enumerate(lengths)), "uid long, length long"), "test-pieces")
    how = packing.Packing(limit=100, shard=size)
    out = packing.pack(cut, how).join(cut, "uid").collect()
    assert sorted(x.uid for x in out) == list(range(1500))
    used = check_packed(out, 100)
    alone = packing.best_fit(np.full(1500, -1, np.int64), np.argsort(-np.array(lengths)), np.array(lengths), 100).max() + 1
    assert -(-sum(lengths) // 100) <= used <= alone + (0 if size > 1500 else alone // 66)


def test_crossover_keeps_pieces_and_epochs_improve():
    rng = np.random.default_rng(5)
    lengths = rng.choice([30, 33, 36, 41, 47, 52, 61], 300)
    how = packing.Packing(limit=100, population=6, children=60)
    pool = packing.founders(lengths, how, rng)
    child = packing.crossed(pool[1], pool[2], lengths, 100, rng)
    assert np.bincount(child, lengths).max() <= 100 and len(np.unique(child)) == child.max() + 1
    before = min(packing.rated(g, lengths) for g in pool)
    for _ in range(3):
        pool = packing.evolved(lengths, pool, how, rng)
    assert packing.rated(pool[0], lengths) < before


@pytest.mark.parametrize("name", ["op11_centroid_clustering", "op12_lexical_search"])
def test_new_queries_against_sql(spark, oracle, name):
    assert oracle(registry.queries()[name](spark, SF), sql.ORACLES[name], SF) > 0
