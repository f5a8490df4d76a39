"""Small fixtures: rules that the test tables never reach."""

import hashlib
import math
import random
import re
import time
import tracemalloc
from pathlib import Path

import chunk_loops
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions.urls import Rules, resolve_url, url_allowed
from corpusflow.operators import answers, approximate, blocks, chunking, embedding, evaluation, index, ingest, integrity, links, retrieval
from corpusflow.plans.registry import oracle_sql, queries
from corpusflow.sources import corpus, snapshots
from corpusflow.streaming import jobs


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Как переместить?", "Russian"), ("how do I move it", "English"), ("Transform.Translate", "English"),
        ("Що це є?", None), ("你好 how", None), ("Bonjour monde", None), ("Γειά the", None)
    ]
)
def test_language(spark, text, want):
    assert one(spark, T.detect_language, text) == want


def test_normalize(spark):
    given_text = "One  two\t\n\n\n\n\n```py\nif  x:\t \n\n\n\n\n  y\n```\n\n three  "
    assert one(spark, T.normalize_text, given_text) == "One two\n\n\n```py\nif  x:\n\n\n\n\n  y\n```\n\n three"
    assert one(spark, T.count_tokens, "a b c d") == 4
    assert one(
        spark, T.normalize_service_line, " Inherits  from:Behaviour\n/ Implemented in:Core "
    ) == "Inherits from: Behaviour / Implemented in: Core"


@pytest.mark.parametrize(
    "answer,want",
    [
        ("1", True), ("SOURCE 1", True), ("[1]", True), ("Да.", True), ("Нет", True), ("yes", True), ("NO!", True),
        ("Use Move.", False)
    ]
)
def test_uninformative(spark, answer, want):
    assert one(spark, T.uninformative, answer) is want


@pytest.mark.parametrize(
    "href,want",
    [
        ("../x.html", "https://h.example/a/x.html"), ("x.html", "https://h.example/a/b/x.html"),
        ("/x", "https://h.example/x"), ("//o.example/x", "https://o.example/x"), ("mailto:a@b", None),
        ("#f", "https://h.example/a/b/c.html#f"), ("http://z.example/", "http://z.example/")
    ]
)
def test_resolve(spark, href, want):
    assert one(spark, lambda c: resolve_url(F.lit("https://h.example/a/b/c.html"), c), href) == want


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://H.example:443/d/x.HTML", True), ("http://h.example/d/x.html", False),
        ("https://h.example:444/d/x.html", False), ("https://u@h.example/d/x.html", False),
        ("https://h.example/d/x.html?q", False), ("https://h.example/e/x.html", False), ("nonsense", False),
        (None, False)
    ]
)
def test_allowed(spark, url, want):
    assert one(spark, lambda c: url_allowed(c, Rules("h.example", "/d/")), url) is want


MEMBERS = """<div class="section"><div class="subsection"><h3>Properties</h3><table class="list"><tr><td><a href="a.html">a</a></td></tr></table></div>
<div class="subsection"><h3>Inherited Members</h3><table class="list"><tr><td><a href="b.html">b</a></td></tr></table></div>
<div class="subsection"><h3>Public Methods</h3><div class="subsection"><table class="list"><tr><td><a href="c.html">c</a></td></tr></table></div><table class="list"><tr><td><a href="d.html">d</a></td></tr></table></div></div><a href="e.html">e</a>"""


def test_member_links(spark):
    assert links.member_hrefs(MEMBERS) == ["a.html", "d.html"]
    assert links.member_hrefs(None) == links.member_hrefs("no [closing part") == []
    pages = spark.createDataFrame(
        [("https://h.example/d/p.html", MEMBERS), ("https://h.example/d/a.html", "<a")], "url string, html string"
    )
    found = links.extract_links(pages, Rules("h.example", "/d/")).collect()
    assert sorted(r.target for r in found) == ["https://h.example/d/a.html", "https://h.example/d/d.html"]


def test_titles(spark):
    rows = [
        ("https://h/x/A.html", "<h1>  Game <em>Class</em> </h1><title>No</title>"),
        ("https://h/B.html", "<title>  Vector API </title>"), ("https://h/Quat%20X.html", "<p>none</p>"),
        ("https://host.example/", "")
    ]
    found = {r.url: r.title for r in links.page_title(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert list(found.values()) == [
        "Game Class", "Vector API", "Quat X", "host.example"
    ] or set(found.values()) == {"Game Class", "Vector API", "Quat X", "host.example"}


PAGE = """<div id="content-wrap"><h1>T</h1><div class="section"><nav>menu</nav><div class="mb20"><p>Inherits from:<a>Base</a></p><p>/</p></div>
<div class="subsection"><h2>Description</h2><p>One<br>two <code>x</code></p><ol><li>first</li></ol>
<table class="list"><tr><th>h</th></tr><tr><td>n</td><td>d</td></tr></table><table><tr><td>dropped</td></tr></table>
<div class="subsection"><h3>Inherited</h3><pre>    <span>public</span><span>void</span> M()<br>        x;</pre></div></div><form>f</form></div></div>"""


def test_blocks(spark):
    pages = spark.createDataFrame([("p", PAGE), ("q", "<h1>No content</h1>")], "document_id string, html string")
    found = blocks.html_blocks(pages).orderBy("document_id", "pos").collect()
    texts = [r.text for r in found if r.document_id == "p"]
    assert texts == [
        "Inherits from: Base", "# Description", "One\ntwo `x`", "- first", "- n — d", "### Inherited",
        "```csharp\npublic void M()\n    x;\n```"
    ]
    titles = spark.createDataFrame([("p", "T"), ("q", "U")], "document_id string, title string")
    done = {r.document_id: r for r in blocks.process_documents(blocks.html_blocks(pages), titles).collect()}
    assert done["p"].content.startswith(
        "# T\n\nInherits from: Base\n\n# Description"
    ) and done["q"].error == "main content not found"


def chunks(spark, text, size, overlap=0, title="Tides"):
    docs = spark.createDataFrame([("d", title, text)], "document_id string, title string, content string")
    return [tuple(r) for r in chunking.chunk_heading_aware(docs, size, overlap).orderBy("ordinal").collect()]


def test_heading_chunks(spark):
    long = " ".join(f"t{i}" for i in range(41))
    found = chunks(spark, f"# Tides\n\n## Springs and neaps\n\n{long}", 11, 3)
    assert all(
        c[4] <= 11 and c[5].startswith("# Tides\n\n## Springs and neaps\n\n") for c in found
    ) and [c[3] for c in found] == list(range(len(found)))
    said = [w for c in found for w in c[5].split()[6:]]
    assert set(said) == set(long.split()) and len(said) > 41
    assert [c[2] for c in chunks(spark, "## Nothing here\n\n## Moon\n\nfull", 9)] == ["Moon"]
    (whole,) = chunks(spark, "before any\n\nheading\n\n## Sun\n\nweaker", 30)
    assert whole[2] == "Sun" and whole[5].endswith("before any\n\nheading\n\nweaker")
    assert chunks(spark, "plain", 9)[0][2] is None
    units = "\n\n".join(" ".join(f"{n}{i}" for i in range(6)) for n in "abc")
    assert max(c[4] for c in chunks(spark, units, 8, 4)) <= 8
    fence = "~~~\n".replace("~", "`") + "## in a fence\n\nleft whole\n" + "```"
    assert any(fence in c[5] for c in chunks(spark, f"## Code\n\n{' '.join('x' * 30)}\n\n{fence}", 16, 2))
    (error,) = chunks(spark, "## Of the sea\n\nx", 6)
    assert error[:2] == ("d", None) and "no room" in error[-1]


def marked_up(n, seed):
    """Texts of headings, fences that may not end, title lines, blank lines and words, in any order."""
    lots = random.Random(seed)
    line = lambda: lots.choice([
        "", "", " ", "\u00a0", "## ", "## Sea  floor ", "##no", " ## in", "# T", "  # T ", "```", "```py", " ```", "\t```",
        "- \u00e9t\u00e9", " ".join(f"w{lots.randrange(99)}" for _ in range(lots.randrange(1, 30)))
    ])
    ends = ["\n", "\n", "\n", "\r\n"]
    return ["".join(line() + lots.choice(ends) for _ in range(lots.randrange(16))) + line() for _ in range(n)]


def test_heading_chunks_are_those_of_a_loop(spark):
    texts = marked_up(400, 5) + [None, "", "```", "# T", "## a"]
    rows = [(f"d{i}", None if i % 17 == 3 else "T", x) for i, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, "document_id string, title string, content string")
    key = lambda r: (r[0], -1 if r[3] is None else r[3])
    for size, overlap in ((4, 0), (6, 2), (12, 5), (40, 39)):
        found = sorted((tuple(r) for r in chunking.chunk_heading_aware(docs, size, overlap).collect()), key=key)
        want = [c for d, t, x in rows for c in chunk_loops.heading_chunks(d, t or "", x or "", size, overlap)]
        assert found == sorted(want, key=key)
    units = {(r[0], r[2], r[3]): (r[1], r[4]) for r in chunking.split_sections(docs).collect()}
    assert units == {
        (d, i, j): (name, unit) for d, t, x in rows
        for i, (name, held) in enumerate(chunk_loops.sections(t or "", x or "")) for j, unit in enumerate(held)
    }


def test_heading_chunks_of_pages(spark):
    """Documents with headings, made from pages; the plan has no Python and no exchange."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(F.col("url").alias("document_id"), "html")
    lines = F.regexp_replace(F.regexp_replace("html", "<h[1-6][^>]*>", "\n\n## "), "</?(p|div|li|h[1-6])[^>]*>", "\n\n")
    docs = pages.select("document_id", F.lit("T").alias("title"), lines.alias("content"))
    found = sorted(tuple(r) for r in chunking.chunk_heading_aware(docs, 64, 8).collect())
    rows = docs.collect()
    assert found == sorted(c for d in rows for c in chunk_loops.heading_chunks(d[0], d[1], d[2], 64, 8)) and len(found) > len(rows)
    plan = chunking.chunk_heading_aware(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_manifest_rules(spark):
    row = lambda d, f, title="t": (d, "https://h/a", title, "ab" * 32, f, "2024-01-01")
    columns = "document_id string, canonical_url string, title string, content_hash string, file_name string, at string"
    make = lambda rows: spark.createDataFrame(rows, columns).withColumn("retrieved_at", F.to_timestamp("at"))
    raw = spark.createDataFrame([("a", "x")], "document_id string, content string")
    bad = [row("a", "F.html"), row("a", "f.HTML"), row("b", "../x"), row("c", ".."), row("d", "C:x"), row("e", "..x", " ")]
    found = {(r.rule, r.key) for r in integrity.check_manifest(make(bad)).collect()}
    assert found == {("repeated_document", "a"), ("repeated_file", "f.html"), ("blank_title", "e")} | {("unsafe_file_name", x) for x in "bcd"}
    assert [r.rule for r in integrity.check_manifest(make([])).collect()] == ["manifest_empty"]
    assert [r.rule for r in integrity.check_manifest(make([row("a", "f")]), 2).collect()] == ["manifest_version"]
    with pytest.raises(ValueError, match="invalid manifest"):
        corpus.load_corpus(make(bad), raw, strict=True)


def test_merged_context_by_loop(spark):
    """Every subset of windows, some of them twice: runs of covered tokens."""
    lots = random.Random(4)
    words = [f"w{i}" for i in range(61)]
    docs = spark.createDataFrame([("d", " ".join(words))], "document_id string, content string")
    windows = [r.asDict() for r in chunking.chunk_overlap(docs, 7, 2).collect()]
    picked = {q: [w for w in windows if lots.random() < 0.5] for q in range(20)} | {98: windows, 99: windows[:1] * 3}
    rows = [(q, w["document_id"], w["ordinal"], float(w["ordinal"]), w["approximate_token_count"], w["content"]) for q, ws in picked.items() for w in ws]
    frame = spark.createDataFrame(rows, "question_id int, document_id string, ordinal int, similarity double, approximate_token_count int, content string")
    want = set()
    for q, ws in picked.items():
        covered = {i for w in ws for i in range(w["ordinal"] * 5, w["ordinal"] * 5 + w["approximate_token_count"])}
        for start in sorted(i for i in covered if i - 1 not in covered):
            stop = next(i for i in range(start, 99) if i not in covered)
            inside = {w["ordinal"] for w in ws if start <= w["ordinal"] * 5 < stop}
            want.add((q, "d", start, stop - start, len(inside), float(max(inside)), " ".join(words[start:stop])))
    assert {tuple(r) for r in answers.merge_context(frame, 7, 2).collect()} == want


def test_rank_effect(spark):
    ranked = spark.createDataFrame(
        [(1, 1, 1, 4), (1, 2, 2, 1), (1, 3, 3, None), (2, 9, 1, 1)], "question_id int, chunk_id int, initial_rank int, final_rank int"
    )
    good = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (7, 1)], "question_id int, chunk_id int")
    rows = [tuple(r) for r in answers.rank_effect(ranked, good, 1).orderBy("question_id").collect()]
    assert rows == [(1, 0.5, 1.0, 0.5, 0, 1, 1), (2, 0.0, 0.0, 0.0, 0, 0, 0)]


def test_long_fences_and_lines(spark):
    """A fence of many lines, one of a single line, and a unit of many words: linear, and no deep stack."""
    long = "```\n" + "code line\n\n" * 100_000 + "```\n\n" + "w " * 300_000 + "\n\n```" + "x" * 1_000_000
    found = chunks(spark, long, 512, 64)
    assert [c[3] for c in found] == list(range(len(found))) and max(c[4] for c in found) <= 512
    assert sum(c[5].split().count("line") for c in found) >= 100_000


def test_chunk_options(spark):
    docs = spark.createDataFrame(
        [("d", "t", "a b c d e"), ("e", "t", None), ("f", "t", "")], "document_id string, title string, content string"
    )
    assert [r.content for r in chunking.chunk_overlap(docs, 3, 1).orderBy("ordinal").collect()] == ["a b c", "c d e"]
    assert chunking.chunk_fixed(docs, 2).count() == 3 and chunking.chunk_heading_aware(docs, 8, 1).count() == 1
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_overlap(docs, *bad)


def test_changes(spark):
    schema = "document_id string, canonical_url string, title string, content_hash string, retrieved_at timestamp, file_name string"
    old = spark.createDataFrame(
        [("a", "u", "t", "AB", None, "fa"), ("b", "u", "t", "cd", None, "fb"), ("z", "u", "t", "zz", None, "fz")],
        schema
    )
    new = spark.createDataFrame(
        [("a", "u2", "t2", "ab", None), ("b", "u", "t", "ef", None), ("c", "u", "t", "gh", None)],
        schema.rpartition(",")[0]
    )
    kinds = {r.document_id: r.change for r in ingest.classify_changes(old, new).collect()}
    assert kinds == {"a": "Unchanged", "b": "Updated", "c": "New"}
    merged = ingest.merge_manifest(old, new)
    rows = {r.document_id: r for r in merged.collect()}
    assert rows["a"].title == "t2" and rows["a"].file_name == "fa" and rows["z"].content_hash == "zz" and rows["c"].file_name == "c.html"
    again = ingest.merge_manifest(merged, new)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))
    with pytest.raises(Exception, match="no documents"):
        ingest.ingest_summary(ingest.classify_changes(old, new).where("false")).collect()


def test_cosine(spark):
    table = spark.createDataFrame(
        [("a", [1.0, 0.0, 0.0]), ("b", [0.8, 0.6, 0.0]), ("c", [0.0, 1.0, 0.0]), ("z", [0.0, 0.0, 0.0])],
        "chunk_id string, embedding array<float>"
    )
    ask = spark.createDataFrame([("q", [1.0, 0.0, 0.0])], "query_id string, embedding array<float>")
    top = [
        (
            r.chunk_id, r.similarity, r.initial_rank
        ) for r in retrieval.retrieve_topk(ask, table, 3).orderBy("initial_rank").collect()
    ]
    assert top == [("a", 1.0, 1), ("b", 0.8, 2), ("c", 0.0, 3)]
    assert retrieval.retrieve_topk(ask, table, 3, 0.9).count() == 1
    assert retrieval.retrieve_topk(ask.where("false"), table, 3).count() == 0


def test_window_group_limit(spark):
    plan = retrieval._rank(
        spark.range(10).selectExpr("id % 2 as query_id", "id as chunk_id", "cast(id as double) as similarity"), 2, 6
    )
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_recall(spark):
    from corpusflow.plans.registry import queries

    assert queries()["ann_recall_of_lists"](spark, "/root/testdata/sf0.01").agg(F.avg("recall")).first()[0] >= 0.9


def test_metrics(spark):
    questions = spark.createDataFrame(
        [("A", "Answered", ["a", "b"]), ("N", "OutOfDomain", [])],
        "question_id string, expected_status string, expected_urls array<string>"
    )
    ranked = spark.createDataFrame(
        [("A", 1, "other"), ("A", 2, "other"), ("A", 3, "b"), ("A", 4, "b")], "question_id string, rank int, url string"
    )
    rows = {r.question_id: r for r in evaluation.per_question(questions, ranked, (2, 3)).collect()}
    assert rows["A"].hit_2 == 0 and rows["A"].hit_3 == 1 and rows["A"].reciprocal_rank == 0.333333 and rows["A"].coverage_3 == 0.5
    assert rows["N"].reciprocal_rank is None
    assert evaluation.status_match_rate(
        spark.createDataFrame([], "status string, expected_status string")
    ).first()[0] is None
    done = questions.selectExpr("question_id", "0 as position").where("question_id = 'N'")
    with pytest.raises(ValueError):
        evaluation.resume_remaining(questions.selectExpr("question_id", "1 as position"), done)


def test_ranking(spark):
    found = spark.createDataFrame(
        [("q", i, f"c{i}") for i in (1, 2, 3)], "question_id string, initial_rank int, chunk_id string"
    )
    order = spark.createDataFrame([("q", [3, 1, 2])], "question_id string, permutation array<int>")
    rows = sorted((r.final_rank, r.chunk_id, r.reranker_score) for r in answers.apply_ranking(found, order).collect())
    assert rows == [(1, "c3", 1.0), (2, "c1", 0.5), (3, "c2", 0.0)]
    bad = spark.createDataFrame([("q", [1, 1, 2])], "question_id string, permutation array<int>")
    assert answers.apply_ranking(found, bad).where("final_rank is not null").count() == 0


def test_snapshot_is_all_or_nothing(spark, tmp_path):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tables = {
        "profiles": frame([("p", 1)], "profile_key string, dimension int"),
        "documents": frame(
            [("d", "h", 1, 1)], "document_id string, content_hash string, created_at int, updated_at int"
        ),
        "chunks": frame([("c", "d", 0)], "chunk_id string, document_id string, ordinal int"),
        "embeddings": frame([("c", "p", [1.0])], "chunk_id string, profile_key string, embedding array<float>")
    }
    root = str(tmp_path / "index")
    index.publish_snapshot(spark, root, tables, 1)
    bad = frame([("r", "k", "x")], "rule string, key string, detail string")
    with pytest.raises(ValueError):
        index.apply_index_batch(spark, root, tables | {"chunks": tables["chunks"].where("false")}, [bad], 2)
    assert index.read_snapshot(spark, root)["chunks"].count() == 1


def test_replay(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u", "t", "h1", None)], jobs.MANIFEST.rpartition(",")[0])
    root = str(tmp_path / "m")
    for batch in (0, 0, 1):
        jobs.ingest_batch(rows, batch, root)
    assert jobs.read_manifest(spark, root).count() == 1
    assert [r.change for r in spark.read.parquet(f"{root}/changes/batch=1").collect()] == ["Unchanged"]


def test_hashing_embedder(spark):
    rows = embedding.embed_hashing(spark.createDataFrame([("a b",), ("",), (None,)], "text string")).collect()
    assert all(abs(sum(x * x for x in r.embedding) - 1) < 1e-5 for r in rows)


def normal_by_loop(text):
    """normalize_text, line by line."""
    out, fence, blank = [], False, 0
    for line in text.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        bare = line.rstrip()
        clean = bare if fence else re.sub("[\t \u00a0]+", " ", bare)
        empty = not fence and not clean
        if not empty or out and blank < 2:
            out.append(clean)
            blank = blank + 1 if empty else 0
        fence ^= bare.lstrip(" ").startswith("```")
    return "\n".join(out).strip(" \n\t")


def test_normalize_by_loop(spark):
    r = random.Random(4)
    pieces = [
        "a", "b  c", "\t", " ", "  ", "\u00a0", "\n", "\n", "\n\n", "\r\n", "\r", "```", "```cs\n", "\n```\n", " ```",
        "x```", "é \u2003", "\n\n\n\n\n"
    ]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(30))) for _ in range(3000)] + [
        "```\n" * 20_000, " " * 200_000 + "x", "a\n" * 100_000, "```" + "\n\n" * 50_000
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select(
        "i", "text", T.normalize_text(F.col("text")).alias("found")
    ).collect()
    assert all(x.found == normal_by_loop(x.text) for x in rows)


@pytest.mark.parametrize(
    "answer,want",
    [
        ("source #12", True), ("Source [3]!", True), ("  7 ? ", True), ("source", False), ("#3", False),
        ("yes yes", False), ("[1", False), ("source#[1]", False), ("", False), ("нет !", True), ("1 2", False)
    ]
)
def test_uninformative_more(spark, answer, want):
    assert one(spark, T.uninformative, answer) is want


@pytest.mark.parametrize(
    "href,want",
    [
        ("x/../y.html", "https://h.example/a/b/y.html"), ("/a/../b.html", "https://h.example/b.html"),
        ("..", "https://h.example/a/"), (".", "https://h.example/a/b/"), ("../../../../z", "https://h.example/z"),
        ("./d/./e/../f?q=../x#/./y", "https://h.example/a/b/d/f?q=../x#/./y"),
        ("http://z.example/a/../b", "http://z.example/b"), ("a..b/.c", "https://h.example/a/b/a..b/.c"),
        ("//o.example/./x", "https://o.example/x")
    ]
)
def test_resolve_dots(spark, href, want):
    assert one(spark, lambda c: resolve_url(F.lit("https://h.example/a/b/c.html"), c), href) == want


def test_deep_pages(spark):
    """Deeper nesting than Python's calls allow."""
    deep = '<div id="content-wrap"><div class="section">' + "<div>" * 5000 + "<p>text <code>x" + "<b>" * 3000 + "y" + "</b>" * 3000 + "</code></p><pre>" + "<i>" * 3000 + "code" + "</pre>"
    found = blocks.html_blocks(spark.createDataFrame([("p", deep)], "document_id string, html string")).collect()
    assert [r.text for r in found] == ["text `xy`", "```csharp\ncode\n```"]


def test_chunk_errors_are_rows(spark):
    docs = spark.createDataFrame(
        [("a", "one two three four", "body"), ("b", "t", "body")], "document_id string, title string, content string"
    )
    rows = {r.document_id: r for r in chunking.chunk_heading_aware(docs, 4, 0).collect()}
    assert "no room" in rows["a"].error and rows["a"].content is None and rows["b"].error is None and rows["b"].content == "# t\n\nbody"


def test_title_entities(spark):
    rows = [("u", "<h1>A&eacute;&#8211;&#x41; &lt;T&gt; &amp;lt;</h1>")]
    assert links.page_title(spark.createDataFrame(rows, "url string, html string")).first().title == "Aé–A <T> &lt;"


def test_titles_are_those_of_their_sql(spark, oracle, tmp_path):
    heads = [
        "<h1>A &amp&amp; b&amp</h1>", "<h1>&notit; &notin; &no; &; &#; &bogus; &NotEqualTilde;x&nbsp;</h1>", "<h1>&#x80;&#65 &#x1F600;&#0;&#xD800;&#1;&#99999999999;.</h1>",
        "<h1> &nbsp;\u2003 </h1><title>T &lt;i&gt; &amp;amp;</title>", "<H1 class='x'>it's <b>b</b>\u0085c</H1 >", "<h1></h1><title> </title>", "none", None
    ]
    rows = [(i, f"https://host.example/d/{name}", h) for h in heads for i, name in enumerate(["", "A+b%20c.html", "50%.html"])]
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    assert oracle(queries()["page_title"](spark, str(tmp_path)), oracle_sql()["page_title"], str(tmp_path)) == len(rows)


def test_streamed_manifest_has_one_row_an_id_as_its_sql(spark, oracle, tmp_path):
    urls = ["https://h/a", "https://h/a", "https://h/b?q", "https://h/b?q", "http://h/c", "http://h/c", "http://h/d"]
    rows = [(i, url, f"<p>{i * 7 % 5}</p>") for i, url in enumerate(urls)]
    pd.DataFrame(rows, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    found = queries()["stream_ingest_changes"](spark, str(tmp_path))
    assert oracle(found, oracle_sql()["stream_ingest_changes"], str(tmp_path)) == 4


def test_topk_by_loop(spark, monkeypatch):
    """Ties by id, zero vectors, thresholds, several passes and tiles against a plain loop."""
    r = random.Random(3)
    base = [[r.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(3)] for _ in range(60)]
    rows = [(f"c{i:03d}", base[i % 60]) for i in range(300)] + [("z", [0.0] * 3), ("n", None)]
    asked = [(i, [r.random() - 0.5 for _ in range(3)]) for i in range(30)] + [(99, [0.0] * 3), (98, None)]
    index_rows, queries = spark.createDataFrame(
        rows, "chunk_id string, embedding array<float>"
    ).repartition(5), spark.createDataFrame(asked, "query_id int, embedding array<float>")
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    for threshold in (None, 0.2):
        want = set()
        for q, v in asked:
            if not v or not norm(v):
                continue
            scores = [
                (round(sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w), 9), c) for c,
                w in rows if w and norm(w)
            ]
            best = sorted(((-s, c) for s, c in scores if threshold is None or round(s, 6) >= threshold))[:7]
            want |= {(q, c, n) for n, (_, c) in enumerate(best, 1)}
        for size, tile in ((32 << 20, 4 << 20), (100, 40)):
            monkeypatch.setattr(retrieval, "PASS_BYTES", size)
            monkeypatch.setattr(retrieval, "TILE", tile)
            found = retrieval.retrieve_topk(queries, index_rows, 7, threshold).collect()
            assert {(x.query_id, x.chunk_id, x.initial_rank) for x in found} == want
            assert all(x.similarity == round(x.similarity, 6) for x in found)


def test_codes_find_most_and_compare_few(spark):
    """Recall of 0.9 or more on all stated queries; at most 5 % of the vectors are compared."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").alias("chunk_id"), "embedding")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    quantiser = approximate.train_quantiser(vectors)
    coded = approximate.code_index(vectors, quantiser)
    assert coded.count() == vectors.count() and coded.select("code").first().code.__len__() == 16
    exact = retrieval.retrieve_topk(queries, vectors, 5)
    approx = approximate.retrieve_approx(queries, vectors, 5, quantiser=quantiser, coded=coded)
    recall = retrieval.ann_recall(approx, exact).agg(F.avg("recall")).first()[0]
    unit = retrieval._unit(queries.select("embedding").toArrow().column(0))
    asked = approximate._Asked(unit, quantiser, max(1, round(0.5 * len(quantiser.centres))))
    few = approximate._candidates(coded, asked, 80)
    assert recall >= 0.9 and few.count() <= 0.05 * vectors.count() * queries.count()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list#" in plan and "ReadSchema: struct<chunk_id:bigint,code:binary>" in plan
    similar = approx.join(exact.withColumnRenamed("similarity", "s").drop("initial_rank"), ["query_id", "chunk_id"])
    assert similar.where("similarity <> s").count() == 0


def test_codes_on_odd_rows_and_passes(spark, monkeypatch):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(500)] + [(900, None), (901, [0.0] * 6), (902, [1.0] * 6), (903, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "chunk_id long, embedding array<float>, list int, code int").repartition(3)
    asked = table.where("chunk_id % 50 = 0 or chunk_id > 890").select(F.col("chunk_id").alias("query_id"), "embedding")
    exact = retrieval.retrieve_topk(asked, table, 3)
    want = sorted(map(tuple, exact.collect()))
    for size in (32 << 20, 5000):
        monkeypatch.setattr(approximate, "PASS_BYTES", size)
        found = approximate.retrieve_approx(asked, table, 3, probe_share=1.0, rerank=40)
        assert sorted(map(tuple, found.collect())) == want
    assert approximate.retrieve_approx(asked, table.where("false"), 3).count() == 0
    assert approximate.retrieve_approx(asked.where("false"), table, 3).count() == 0
    assert approximate.retrieve_approx(asked, table.where("chunk_id = 902"), 3).where("chunk_id <> 902").count() == 0
    hot = spark.createDataFrame([(i, [1.0, float(i % 3 == 0)]) for i in range(3000)], "chunk_id int, embedding array<float>")
    few = approximate.retrieve_approx(hot.where("chunk_id < 4").withColumnRenamed("chunk_id", "query_id"), hot, 3)
    assert {(x.query_id, x.chunk_id) for x in few.collect()} == {(q, c) for q in range(4) for c in ((0, 3, 6) if q % 3 == 0 else (1, 2, 4))}


def files_of(root):
    return {str(p.relative_to(root)) for p in Path(root).rglob("*.parquet")}


def test_small_batch_writes_its_own_rows_only(spark, tmp_path):
    root, n = str(tmp_path / "index"), 300
    docs = spark.createDataFrame(
        [(f"d{i}", "h", 1, 1) for i in range(n)],
        "document_id string, content_hash string, created_at int, updated_at int"
    )
    rows = spark.createDataFrame(
        [(f"c{i}-{j}", f"d{i}", j) for i in range(n) for j in range(2)],
        "chunk_id string, document_id string, ordinal int"
    )
    vectors = rows.select("chunk_id", F.lit("p").alias("profile_key"), F.array(F.lit(1.0)).alias("embedding"))
    profiles = spark.createDataFrame([("p", 1)], "profile_key string, dimension int")
    index.publish_snapshot(
        spark, root, {"profiles": profiles, "documents": docs, "chunks": rows, "embeddings": vectors}, 1, bucket_bytes=4000
    )
    before = files_of(root)
    batch = {
        "profiles": profiles, "documents": docs.where("document_id = 'd7'").withColumn("updated_at", F.lit(2)),
        "chunks": rows.where("chunk_id = 'c7-0'"), "embeddings": vectors.where("chunk_id = 'c7-0'")
    }
    index.apply_index_batch(spark, root, batch, [], 2)
    new = files_of(root) - before
    assert before < files_of(root) and {p.split("-")[0].split("/")[0] for p in new} == {"chunks", "documents", "embeddings", "profiles", "pointer"}
    assert sum((Path(root) / p).stat().st_size for p in new) < 40_000
    after = index.read_snapshot(spark, root)
    assert after["documents"].count() == n and after["documents"].where("updated_at = 2").select("document_id", "created_at").collect() == [("d7", 1)]
    assert {
        r.chunk_id for r in after["chunks"].where("document_id = 'd7'").collect()
    } == {"c7-0"} and after["chunks"].count() == after["embeddings"].count() == 2 * n - 1
    with pytest.raises(ValueError, match="repeated_chunks"):
        index.apply_index_batch(spark, root, batch | {"chunks": batch["chunks"].unionByName(batch["chunks"])}, [], 3)
    with pytest.raises(ValueError, match="null_documents"):
        index.apply_index_batch(
            spark, root,
            batch | {"documents": batch["documents"].withColumn("document_id", F.lit(None).cast("string"))}, [], 3
        )
    gone = batch | {"chunks": batch["chunks"].where("false"), "embeddings": batch["embeddings"].where("false")}
    index.apply_index_batch(spark, root, gone, [], 3)
    assert index.read_snapshot(spark, root)["chunks"].count() == index.read_snapshot(spark, root)["embeddings"].count() == 2 * n - 2
    index.apply_index_batch(spark, root, batch, [], 4)
    rows_of = lambda: {t: sorted(map(str, d.collect())) for t, d in index.read_snapshot(spark, root).items()}
    held = rows_of()
    assert len(held["chunks"]) == 2 * n - 1
    index.compact_index(spark, root, 5)
    assert rows_of() == held and all(len(p) == 1 for p in snapshots.pointer(spark, root).values())
    assert snapshots.vacuum(spark, root, keep=1) > 8 and rows_of() == held


def test_index_side_of_joins_has_no_exchange(spark, tmp_path):
    root, n = str(tmp_path / "t"), 4000
    rows = spark.range(n).select(F.col("id").cast("string").alias("document_id"), F.lit("x").alias("v"))
    part = snapshots.write_base(rows, root, "documents", ["document_id"], bucket_bytes=4000)
    assert part.buckets > 4
    change = snapshots.write_changes(rows.where("document_id < '2'").withColumn("v", F.lit("y")), root, "documents", rows.where("document_id = '77'").select("document_id"))
    snapshots.publish(spark, root, 1, {"documents": [part, change]})
    parts = snapshots.pointer(spark, root)["documents"]
    found = snapshots.known(spark, parts, ["document_id"], rows.where("document_id like '1%'"), ["document_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "Bucketed: true" in line)
    above = plan.splitlines()[: plan.splitlines().index(scan)]
    # From the scan up to its join there are filters, projections and perhaps a sort, but no exchange.
    depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
    near, at = [], depth(scan)
    for line in reversed(above):
        if depth(line) < at:
            near.append(line)
            at = depth(line)
    joins = [i for i, line in enumerate(near) if "SortMergeJoin" in line]
    assert joins and not any("Exchange" in line for line in near[: joins[0]])
    whole = snapshots.read(spark, parts, ["document_id"])
    assert whole.count() == n - 1 and whole.where("v = 'y'").count() == rows.where("document_id < '2'").count()


def test_manifest_batches_write_their_own_rows(spark, tmp_path):
    root, schema = str(tmp_path / "m"), jobs.MANIFEST.rpartition(",")[0]
    jobs.ingest_batch(spark.createDataFrame([(f"d{i}", "u", "t", "h", None) for i in range(200)], schema), 0, root)
    before = files_of(root)
    jobs.ingest_batch(
        spark.createDataFrame([("d3", "u", "t", "h2", None), ("new", "u", "t", "h", None)], schema), 1, root
    )
    new = [p for p in files_of(root) - before if p.startswith("manifest")]
    assert before < files_of(root) and sum(spark.read.parquet(f"{root}/{p}").count() for p in new) == 2
    assert jobs.read_manifest(spark, root).count() == 201 and jobs.read_manifest(spark, root, before=1).count() == 200
    assert sorted(
        (r.document_id, r.change) for r in spark.read.parquet(f"{root}/changes/batch=1").collect()
    ) == [("d3", "Updated"), ("new", "New")]


def test_artifacts_are_checked(spark, tmp_path):
    text = "some words here"
    docs = spark.createDataFrame(
        [("d", "t", "1", "u", text, hashlib.sha256(text.encode()).hexdigest())],
        "document_id string, title string, version string, canonical_url string, content string, content_hash string"
    )
    rows, header = chunking.chunk_fixed(docs, 2), {"version": 1, "corpus_version": 1, "chunk_size": 2, "overlap": 0}
    corpus.write_artifacts(docs, rows, header, str(tmp_path / "a"))
    found = corpus.read_artifacts(spark, str(tmp_path / "a"))
    assert [r.ordinal for r in found[1].collect()] == [0, 1]
    for bad_docs, bad_rows, bad_header in (
        (docs.withColumn("content_hash", F.lit("0" * 64)), rows, header), (docs, rows.unionByName(rows), header),
        (docs, rows.withColumn("ordinal", F.lit(0)), header), (docs, rows, header | {"version": 2}),
        (docs.unionByName(docs.withColumn("document_id", F.lit("childless"))), rows, header),
        (docs.withColumn("title", F.lit(" ")), rows, header),
        (docs, rows.unionByName(rows.withColumn("document_id", F.lit("nobody")).withColumn("chunk_id", F.lit("x"))), header)
    ):
        with pytest.raises(ValueError, match="invalid artifacts"):
            corpus.write_artifacts(bad_docs, bad_rows, bad_header, str(tmp_path / "b"))
    spark.range(1).selectExpr(
        "1 version", "2 corpus_version", "2 chunk_size", "0 overlap"
    ).write.mode("overwrite").json(str(tmp_path / "a" / "header-chunks"))
    with pytest.raises(ValueError, match="headers_differ"):
        corpus.read_artifacts(spark, str(tmp_path / "a"))


def test_artifacts_move_texts_once(spark, tmp_path):
    """Texts pass one exchange on their way to the file, and all columns are compared by one join; rows are
    those of the join, in order. Chunks that break a rule don't stay."""
    made = [(f"d{i:02d}", f"t{i}", "1", f"u{i}", "w " * (i % 7 + 1)) for i in range(40)]
    docs = spark.createDataFrame(made, "document_id string, title string, version string, canonical_url string, content string")
    docs = docs.withColumn("content_hash", F.sha2("content", 256)).repartition(3)
    rows, header = chunking.chunk_fixed(docs, 2), {"version": 1, "corpus_version": 1, "chunk_size": 2, "overlap": 0}
    exchanged = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanged(corpus._denormalised_in_order(docs, rows)) == exchanged(docs) + exchanged(rows) + 1
    corpus.write_artifacts(docs, rows, header, str(tmp_path / "a"))
    written = spark.read.parquet(str(tmp_path / "a" / "chunks"))
    assert sorted(written.collect()) == sorted(corpus.denormalise(docs, rows).withColumn("section", F.lit(None)).collect())
    for part in (tmp_path / "a" / "chunks").glob("part-*"):
        order = [(r.document_id, r.ordinal) for r in spark.read.parquet(str(part)).collect()]
        assert order == sorted(order)
    with pytest.raises(ValueError, match="repeated_"):
        corpus.write_artifacts(docs, rows.withColumn("ordinal", F.lit(0)), header, str(tmp_path / "b"))
    assert not (tmp_path / "b" / "chunks").exists() and not (tmp_path / "b" / "documents").exists()
    found = integrity.check_denormalised(written, docs, {"source_url": "canonical_url", "document_title": "title", "version": "version"})
    assert found._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1


def test_artifacts_leave_out_documents_without_tokens(spark, oracle, tmp_path):
    """The query's rows are those of its SQL where some texts are null, empty or white space; the sink itself
    refuses such documents, and chunks without document, and leaves nothing."""
    texts = ["some words", None, "", " \n\t\u00a0\u3000", "w " * 200]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "source": "s"}).to_parquet(tmp_path / "documents.parquet")
    assert oracle(queries()["artifacts_round_trip"](spark, str(tmp_path)), oracle_sql()["artifacts_round_trip"], str(tmp_path)) == 5
    docs = spark.createDataFrame([("a", "t", "1", "u", "x y"), ("b", "t", "1", "u", " ")], "document_id string, title string, version string, canonical_url string, content string")
    docs, header = docs.withColumn("content_hash", F.sha2("content", 256)), {"version": 1, "corpus_version": 1, "chunk_size": 2, "overlap": 0}
    rows = chunking.chunk_fixed(docs, 2)
    for bad in (docs, docs.where("document_id = 'b'")):
        with pytest.raises(ValueError, match="_without_"):
            corpus.write_artifacts(bad, rows, header, str(tmp_path / "out"))
        assert not (tmp_path / "out" / "chunks").exists() and not (tmp_path / "out" / "documents").exists()


def test_artifact_checks_read_texts_once(spark, tmp_path):
    """One scan with texts a side, for the same violations as rule by rule; a check's shuffle files go with it."""
    docs = spark.createDataFrame([(f"d{i}", "t" * (i % 3), "1", "u", "w " * (i + 1)) for i in range(20)], "document_id string, title string, version string, canonical_url string, content string")
    docs = docs.withColumn("content_hash", F.sha2(F.concat("content", F.when(F.length("title") == 1, "x").otherwise("")), 256))
    rows = corpus.denormalise(docs, chunking.chunk_fixed(docs, 4)).withColumn("approximate_token_count", F.col("approximate_token_count") - 1)
    for table, name in ((docs, "docs"), (rows.withColumn("content", F.when(F.col("ordinal") == 2, " ").otherwise(F.col("content"))), "rows")):
        table.write.parquet(str(tmp_path / name))
    docs, rows = (spark.read.parquet(str(tmp_path / name)) for name in ("docs", "rows"))
    found = integrity.check_artifacts(docs, rows)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert sum(bool(re.search(r"\bcontent#", columns)) for columns in scans) == 2
    single = integrity.union(
        integrity.check_hashes(docs, rows), integrity.check_constraints(rows, "chunk_id", integrity.chunk_rules()),
        integrity.check_constraints(docs, "document_id", integrity.document_rules())
    )
    assert sorted(map(str, found.collect())) == sorted(map(str, single.collect())) and single.select("rule").distinct().count() == 6
    blocks_on_disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks_on_disk.getAllFiles().mkString(" ")))
    before = shuffled()
    with pytest.raises(ValueError, match="blank_title|content_hash|chunk_id|token_count|blank_text"):
        corpus._reject(integrity.check_artifacts(docs, rows))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before


def test_checkpoint_identity(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 1)], "question_id string, position int")
    saved = evaluation.checkpoint_identity(rows, {"k": 3}, "/out")
    assert evaluation.resume_remaining(rows, rows.where("position = 0"), saved, {"k": 3}, "/out").count() == 1
    for other, config, out in (
        (rows, {"k": 4}, "/out"), (rows, {"k": 3}, "/elsewhere"),
        (rows.withColumn("position", 1 - F.col("position")), {"k": 3}, "/out")
    ):
        with pytest.raises(ValueError, match="saved run"):
            evaluation.resume_remaining(other, rows.where("false"), saved, config, out)


def test_scratch(spark):
    from corpusflow.sources import scratch

    made = scratch.materialize(spark.range(3))
    assert made.count() == 3 and spark.conf.get(scratch.CLEANUP) in (None, "false")


def test_strip_boilerplate(spark):
    page = '<nav>x</nav><div id="content-wrap"><div class="a section"><p>one</p><aside>a<aside>b</aside>c</aside><div class="suggest">s<div>t</div></div><!-- <nav> --><img src=x><p>two</p><script>"<nav>"</script></div>after</div>'
    rows = {
        r.document_id: r for r in blocks.strip_boilerplate(
            spark.createDataFrame([("p", page), ("q", "<p>none"), ("r", None)], "document_id string, html string")
        ).collect()
    }
    assert rows["p"].html == "<p>one</p><!-- <nav> --><p>two</p>" and rows["p"].error is None
    assert rows["q"].html is None and rows["q"].error == rows["r"].error == "main content not found"
    assert blocks.main_html(
        "a<nav>b<nav>c</nav>d</nav>e<input>f", None
    ) == "aef" and blocks.main_html("a<form>b", None) == "a"
    assert blocks.main_html("<a b " * 100_000, None) == "<a b " * 100_000


def test_strict_json(spark):
    """Against the json module, which needs its leniency taken away."""
    import json
    import random

    r = random.Random(2)
    parts = ['{', '}', '[', ']', ',', ':', '"a"', '"b\\n"', '1', '-0', '01', '1.5e3', 'true', 'null', ' ', "'x'", '"', 'NaN', '"\\u00e9"', '\\q']

    def value(depth):
        kind = r.randint(0, 7 if depth else 5)
        if kind < 6:
            return r.choice(['"x"', '""', '"q\\"[{"', '12', '-3.5', 'true', 'false', 'null', '1E+9', '"\\\\"'])
        inner = [value(depth - 1) for _ in range(r.randint(0, 3))]
        pad = r.choice(["", " ", "\n"])
        return f"[{pad}{(pad + ',').join(inner)}]" if kind == 6 else "{" + ",".join(f'"k"{pad}:{x}' for x in inner) + "}"

    texts = [value(4) for _ in range(300)] + ["".join(r.choice(parts) for _ in range(r.randint(1, 7))) for _ in range(1500)]
    texts += [t + e for t in texts[:60] for e in (" ", "x", "1", ",", "{}", "]")] + ["{'a': 1}", '{"a": 1,}', "[1 2]", '"a\tb"', "", " "]
    texts += ["[" * 64 + "]" * 64, "[" * 65 + "]" * 65, '{"a":' * 64 + "1" + "}" * 64, '{"a":' * 65 + "1" + "}" * 65]
    texts += ["[" + "1," * 50_000 + "1]", '["' + "\\n" * 50_000 + '"]', '{"k":' + '"' + "x" * 200_000 + '"}']

    def strict(t):
        if t.count("[") > 64 and len(t) < 200 or t.count("{") > 64 and len(t) < 900:
            return None

        def refuse(x):
            raise ValueError(x)

        try:
            found = json.loads(t.strip(" \t\r\n"), parse_constant=refuse, object_pairs_hook=lambda p: ("object", [v for _, v in p]))
        except ValueError:
            return None
        sign = lambda v: "\x06" if isinstance(v, tuple) else "\x05" if isinstance(v, list) else "\x04" if v is None else "\x03" if isinstance(v, bool) else "\x01" if isinstance(v, str) else "\x02"
        return [sign(v) for v in found[1]] if isinstance(found, tuple) else []

    found = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", answers.json_kinds(F.col("t")).alias("k"))
    got = {x.i: x.k for x in found.collect()}
    for i, t in enumerate(texts):
        assert got[i] == strict(t), t[:100]
    assert answers.json_kinds(F.lit(None).cast("string")) is not None


def test_responses_with_odd_rows(spark):
    rows = [(1, None, 3, 'x'), (2, '{"rankedSourceNumbers": [1]}', 1, 'x'), (3, '{"rankedSourceNumbers": []}', 0, 'x')]
    table = spark.createDataFrame(rows, "question_id int, content string, source_count int, reason string")
    assert [(r.reason, r.permutation) for r in answers.parse_rank_response(table).orderBy("question_id").collect()] == [
        ("Malformed", None), (None, [1]), (None, [])
    ]
    assert {r.reason for r in answers.parse_answer_response(table).collect()} == {"MessageContentMissing", "StructuredShapeInvalid"}


def test_odd_mark_up_is_read_in_linear_time(spark):
    import time

    main = lambda x: blocks.main_html(x, None)
    assert main("<script>x='<script>'</script><p>b</p>") == "<p>b</p>"
    assert main("<div><header>menu<p>x</div><p>b</p>") == "<div></div><p>b</p>"
    assert main("<style>a > b {}</STYLE><p>b</p><textarea><p></textarea>c") == "<p>b</p>c"
    assert main("<nav><nav>x</nav>y</nav>z<!-- <nav> -->w") == "z<!-- <nav> -->w"
    pages = spark.createDataFrame([("a", "<p>a</p><![foo[ x ]]><p>b</p>"), ("b", "<p>fine</p>")], "document_id string, html string")
    rows = [(r.document_id, r.kind, r.text) for r in blocks.html_blocks(pages, container=None).orderBy("document_id", "pos").collect()]
    assert rows in ([("a", "error", "page can't be parsed"), ("b", "paragraph", "fine")], [("a", "paragraph", "a"), ("a", "paragraph", "b"), ("b", "paragraph", "fine")])
    for read, text in (
        (main, "<!--" * 200_000), (main, "<script>" * 100_000), (blocks.page_blocks, "<b>" * 40_000 + "</x>" * 40_000),
        (links.member_hrefs, "<div>" * 40_000 + "x</y>" * 40_000)
    ):
        began = time.time()
        read(text)
        assert time.time() - began < 5
    page = spark.createDataFrame([("https://a.b/c", "<a href='/x?a=1&amp;b=2'>x</a>")], "url string, html string")
    assert [r.target for r in links.all_links(page).collect()] == ["https://a.b/x?a=1&b=2"]


def test_daily_sketches_answer_quantiles(spark):
    from corpusflow.operators import traces

    r = random.Random(12)
    rows = [(f"s{i % 2}", r.choice(["ok", "ok", "failed", None]), f"2024-01-{1 + i % 9:02d} 10:00:00", r.expovariate(0.1)) for i in range(20_000)]
    rows += [("idle", "ok", "2024-01-01 00:00:00", None)]
    spans = spark.createDataFrame(rows, "stage string, status string, started string, duration double")
    daily = traces.stage_durations(spans)
    assert daily.count() == 19
    for keys in (["stage"], ["stage", "day"]):
        for x in traces.duration_quantiles(daily, keys).collect():
            mine = sorted(d for s, _, t, d in rows if s == x.stage and d is not None and ("day" not in keys or t[:10] == str(x.day)))
            failed = sum(s == x.stage and st != "ok" and ("day" not in keys or t[:10] == str(x.day)) for s, st, t, _ in rows)
            assert x.n_failed == failed and (x.least, x.longest) == ((mine[0], mine[-1]) if mine else (None, None))
            for q, found in ((0.5, x.p50), (0.95, x.p95)):
                if mine:
                    assert abs(sum(d <= found for d in mine) / len(mine) - q) < 0.02
                else:
                    assert found is None


def test_topk_skips_pairs_by_bounds(spark):
    """Rows are those of all products, with ties, zero vectors and a threshold; of vectors with few main
    directions most pairs are never multiplied in full."""
    r = np.random.default_rng(5)
    for decay, least in ((0.8, 0.8), (1.0, 0.0)):
        base = (r.normal(size=(6000, 64)) * decay ** np.arange(64)).astype(np.float32)
        base[3000:3500] = base[:500]
        base[17] = 0
        asked = base[::40].copy()  # the zero vector isn't among them
        asked[3] = 0
        rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "chunk_id int, embedding array<float>").repartition(2)
        queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "query_id int, embedding array<float>")
        unit = lambda v: v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
        scores = np.round(unit(asked) @ unit(base).T, 9)
        scores[3], scores[:, 17] = -9, -9
        for threshold in (None, 0.9):
            low = -8 if threshold is None else threshold
            want = set()
            for q, own in enumerate(scores):
                best = [c for c in np.lexsort((np.arange(len(own)), -own))[:6] if own[c] >= low]
                want |= {(q, int(c), n) for n, c in enumerate(best, 1)}
            found = retrieval.retrieve_topk(queries, rows, 6, threshold).collect()
            assert {(x.query_id, x.chunk_id, x.initial_rank) for x in found} == want
            work = retrieval.topk_work(queries, rows, 6, threshold).agg(F.sum("pairs").alias("p"), F.sum("multiplied").alias("m")).first()
            assert work.p == len(asked) * len(base) and 1 - work.m / work.p >= (least if threshold else min(least, 0.5))


def test_topk_task_holds_bounded_tables():
    """What a task holds beside queries and rows doesn't grow with either's number, nor with their length."""
    r, peaks = np.random.default_rng(6), []
    for n_queries, n_rows, width in ((200, 4000, 64), (2000, 12000, 64), (50, 12000, 768)):
        vectors = r.normal(size=(n_queries, width))
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        rows = pa.array(r.normal(size=(n_rows, width)).astype(np.float32).tolist(), pa.list_(pa.float32()))
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n_rows)), rows], names=["chunk_id", "embedding"])
        floors, work, found = np.full((n_queries, 20), -np.inf), np.zeros(2, np.int64), 0
        along = retrieval.directions(vectors)
        heads = retrieval._headed(vectors, along)
        tracemalloc.start()
        for part in retrieval._slices([batch]):
            own = part.column(0), retrieval._unit(part.column(1)), 20, 0.0, 6, floors, along, heads, work
            found += sum(len(x) for x in retrieval._scored(pa.array(np.arange(n_queries)), vectors, *own))
        peaks.append(tracemalloc.get_traced_memory()[1] / 2**20)
        tracemalloc.stop()
        assert work[0] == n_queries * n_rows and found >= 20 * n_queries
    assert max(peaks) < 64, peaks


def test_semantic_search_by_loop(spark):
    """Questions meet the chunks that products of the same hashed vectors rank first; texts without
    tokens have the first direction."""
    texts = ["alpha beta gamma", "beta gamma delta", "delta epsilon", "zeta eta theta", "alpha alpha beta", "", None]
    chunks = embedding.embed_hashing(spark.createDataFrame(list(enumerate(texts)), "chunk_id int, text string"))
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "epsilon delta"), (3, ""), (4, None)], "question_id int, text string")
    index = {x.chunk_id: x.embedding for x in chunks.collect() if x.embedding and any(x.embedding)}
    want = set()
    for x in embedding.embed_hashing(asked).collect():
        if x.embedding and any(x.embedding):
            dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
            score = {c: dot(x.embedding, v) / math.sqrt(dot(x.embedding, x.embedding) * dot(v, v)) for c, v in index.items()}
            best = sorted(score, key=lambda c: (-round(score[c], 9), c))[:2]
            want |= {(x.question_id, c, n) for n, c in enumerate(best, 1)}
    found = retrieval.semantic_search(asked, embedding.embed_hashing, chunks.select("chunk_id", "embedding"), 2).collect()
    assert {(x.query_id, x.chunk_id, x.initial_rank) for x in found} == want and {x[0] for x in want} == {1, 2, 3, 4}
