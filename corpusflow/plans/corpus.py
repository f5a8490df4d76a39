"""Queries over pages and documents: sources, links, changes, text, chunks, integrity."""

from __future__ import annotations

import html as entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.functions.urls import ABSOLUTE, Rules, resolve_url, url_allowed
from corpusflow.operators import blocks, chunking, ingest, integrity, links
from corpusflow.plans.base import DOCS, MANIFEST, RAW, TOKENS, fixed_sql, manifest, processed, query, raw_pages, table
from corpusflow.sources import corpus
from corpusflow.sources.scratch import scratch_path

Spark = SparkSession
SIZE, OVERLAP = 64, 8
FIXED = fixed_sql(SIZE, SIZE, "len(w) - 1")
OVERLAPPED = fixed_sql(SIZE, SIZE - OVERLAP, f"greatest(len(w) - 1 - {OVERLAP}, 0)")
CHUNK_ID = "sha256(document_id || chr(10) || ordinal || chr(10) || content)"


@query("SELECT page_id, url, length(html) AS n_chars FROM pages")
def load_pages(spark: Spark, sf: str) -> DataFrame:
    return corpus.load_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").alias("n_chars"))


@query(
    f"WITH {MANIFEST} SELECT m.document_id, m.file_name, CASE WHEN r.content IS NULL THEN 'MissingContent' WHEN lower(m.content_hash) <> r.content_hash THEN 'HashMismatch' END AS violation FROM manifest m LEFT JOIN raw r USING (document_id)"
)
def load_corpus(spark: Spark, sf: str) -> DataFrame:
    return corpus.load_corpus(manifest(spark, sf), raw_pages(spark, sf)).select("document_id", "file_name", "violation")


@query(
    f"WITH {RAW}, m AS (SELECT document_id, canonical_url, regexp_extract(canonical_url, '[^/]*$') AS file_name FROM raw) SELECT 'repeated_document' AS rule, document_id AS key, count(*)::VARCHAR AS detail FROM m GROUP BY document_id HAVING count(*) > 1 UNION ALL SELECT 'repeated_file', lower(file_name), count(*)::VARCHAR FROM m GROUP BY lower(file_name) HAVING count(*) > 1 UNION ALL SELECT 'blank_file_name', document_id, NULL FROM m WHERE trim(file_name) = ''"
)
def check_manifest(spark: Spark, sf: str) -> DataFrame:
    """All pages as a manifest whose file names are the last elements of their paths."""
    name = F.regexp_extract("canonical_url", "[^/]*$", 0)
    return integrity.check_manifest(raw_pages(spark, sf).withColumn("file_name", name))


@query(
    "SELECT page_id, sha256(url) AS document_id, sha256(html) AS content_hash, url AS canonical_url, url AS source, 'text/html' AS content_type FROM pages"
)
def document_identity(spark: Spark, sf: str) -> DataFrame:
    found = ingest.document_identity(table(spark, sf, "pages"), optional={"etag": F.lit(None)})
    return found.select(
        "page_id", "document_id", "content_hash", "canonical_url", F.col("metadata")["source"].alias("source"),
        F.col("metadata")["contentType"].alias("content_type")
    )


@query(
    f"WITH {MANIFEST} SELECT r.document_id, CASE WHEN m.document_id IS NULL THEN 'New' WHEN lower(m.content_hash) = r.content_hash THEN 'Unchanged' ELSE 'Updated' END AS change FROM raw r LEFT JOIN manifest m USING (document_id)"
)
def classify_changes(spark: Spark, sf: str) -> DataFrame:
    return ingest.classify_changes(manifest(spark, sf), raw_pages(spark, sf)).select("document_id", "change")


@query(
    f"WITH {MANIFEST} SELECT r.document_id, r.canonical_url, 'new title' AS title, r.content_hash, coalesce(m.file_name, r.document_id || '.html') AS file_name FROM raw r LEFT JOIN manifest m USING (document_id)"
)
def merge_manifest(spark: Spark, sf: str) -> DataFrame:
    return ingest.merge_manifest(manifest(spark, sf), raw_pages(spark, sf)).drop("retrieved_at")


@query(
    f"WITH {MANIFEST} SELECT r.document_id, length(r.content) AS n_chars FROM raw r LEFT JOIN manifest m USING (document_id) WHERE m.document_id IS NULL OR lower(m.content_hash) <> r.content_hash"
)
def changed_content(spark: Spark, sf: str) -> DataFrame:
    changes = ingest.classify_changes(manifest(spark, sf), raw_pages(spark, sf))
    return ingest.changed_content(changes).select("document_id", F.length("content").alias("n_chars"))


@query(
    f"WITH {MANIFEST}, c AS (SELECT CASE WHEN m.document_id IS NULL THEN 'New' WHEN lower(m.content_hash) = r.content_hash THEN 'Unchanged' ELSE 'Updated' END AS change FROM raw r LEFT JOIN manifest m USING (document_id)) SELECT count(*) AS retrieved, count(*) FILTER (change = 'New') AS new, count(*) FILTER (change = 'Updated') AS updated, count(*) FILTER (change = 'Unchanged') AS unchanged FROM c"
)
def ingest_summary(spark: Spark, sf: str) -> DataFrame:
    return ingest.ingest_summary(ingest.classify_changes(manifest(spark, sf), raw_pages(spark, sf)))


@query(f"WITH {MANIFEST} SELECT document_id, file_name FROM manifest WHERE canonical_url LIKE '%#%'")
def missing_content(spark: Spark, sf: str) -> DataFrame:
    """Pages with a fragment in their URL have lost their content."""
    raw = raw_pages(spark, sf).withColumn("content", F.when(~F.col("canonical_url").contains("#"), F.col("content")))
    return ingest.missing_content(manifest(spark, sf), raw).select("document_id", "file_name")


@query(
    "SELECT doc_id, min(doc_id) OVER w AS keeper, count(*) OVER w AS n_copies, doc_id <> min(doc_id) OVER w AS is_duplicate FROM documents WINDOW w AS (PARTITION BY sha256(text))"
)
def exact_duplicates(spark: Spark, sf: str) -> DataFrame:
    return ingest.exact_duplicates(table(spark, sf, "documents"), "doc_id", F.sha2("text", 256))


ANCHORS = r"anchors AS (SELECT DISTINCT url, CASE WHEN h LIKE 'http%://%' THEN h WHEN h LIKE '/%' THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || h END AS target FROM (SELECT url, replace(replace(replace(replace(replace(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*[\x22'']([^\x22'']*)[\x22'']', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&') AS h FROM pages))"


@query(f"WITH {ANCHORS} SELECT url, target FROM anchors")
def extract_all_links(spark: Spark, sf: str) -> DataFrame:
    return links.all_links(table(spark, sf, "pages"))


@query(
    f"WITH {ANCHORS}, h AS (SELECT min(regexp_extract(url, '^https://([^/?#]*)', 1)) AS host FROM pages WHERE url LIKE 'https://%') SELECT DISTINCT url, target FROM anchors, h WHERE target LIKE 'https://' || host || '/%' AND target NOT LIKE '%?%' AND target NOT LIKE '%#%' AND target <> url"
)
def extract_links(spark: Spark, sf: str) -> DataFrame:
    """Each page's anchors put into a table of direct members; links to the first host by name."""
    pages = table(spark, sf, "pages")
    secure = pages.where(F.col("url").startswith("https://"))
    host = secure.agg(F.min(F.regexp_extract("url", "^https://([^/?#]*)", 1)).alias("h")).first().h
    anchors = F.array_join(
        F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0)), "</td></tr><tr><td>"
    )
    head, tail = '<div class="section"><div class="subsection"><h3>Public Methods</h3><table class="list"><tr><td>', "</td></tr></table></div></div>"
    made = pages.select("url", F.concat(F.lit(head), anchors, F.lit(tail)).alias("html"))
    return links.extract_links(made, Rules(host or "", suffix=""))


@query(
    r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/up.html' AS rooted, regexp_extract(url, '^([a-z]+://[^?#]*/)', 1) || 'next.html' AS relative, regexp_extract(url, '^([a-z]+):', 1) || '://other.example/x' AS other, regexp_extract(url, '^([^?#]*)', 1) || '?p=2' AS queried FROM pages"
)
def resolve_urls(spark: Spark, sf: str) -> DataFrame:
    to = lambda href: resolve_url(F.col("url"), F.lit(href))
    return table(spark, sf, "pages").select(
        "page_id", to("/up.html").alias("rooted"), to("./next.html").alias("relative"),
        to("//other.example/x").alias("other"), to("?p=2").alias("queried")
    )


@query(
    "SELECT page_id, url LIKE 'https://tionsh.example.net/%.html' AND url NOT LIKE '%?%' AND url NOT LIKE '%#%' AS allowed FROM pages"
)
def url_allowlist(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", url_allowed(F.col("url"), Rules("TIONSH.example.net")).alias("allowed")
    )


@query(
    f"WITH {ANCHORS} SELECT url, 1 AS tier, row_number() OVER (ORDER BY url) AS position FROM (SELECT DISTINCT target AS url FROM anchors) QUALIFY position <= 75"
)
def select_frontier(spark: Spark, sf: str) -> DataFrame:
    return links.select_frontier(links.all_links(table(spark, sf, "pages")), None, 75)


@query(
    f"WITH {ANCHORS}, seeds AS (SELECT DISTINCT url FROM pages WHERE url LIKE 'https://%.html'), members AS (SELECT DISTINCT target AS url FROM anchors WHERE url IN (FROM seeds)), c AS (SELECT url, 0 AS tier FROM seeds UNION ALL SELECT url, 1 FROM members WHERE url NOT IN (FROM seeds)) SELECT url, tier, row_number() OVER (ORDER BY tier, url) AS position FROM c QUALIFY position <= 75"
)
def select_frontier_from_seeds(spark: Spark, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    seeds = pages.where(F.col("url").startswith("https://") & F.col("url").endswith(".html"))
    return links.select_frontier(links.all_links(pages), seeds, 75)


@query(
    f"WITH {ANCHORS}, o AS (SELECT url, count(DISTINCT target) AS n FROM anchors GROUP BY url), i AS (SELECT target AS url, count(DISTINCT url) AS n FROM anchors GROUP BY target) SELECT coalesce(o.url, i.url) AS url, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM o FULL JOIN i ON o.url = i.url"
)
def link_graph_stats(spark: Spark, sf: str) -> DataFrame:
    return links.link_graph_stats(links.all_links(table(spark, sf, "pages")))


#: A character reference, as HTML's rules find it.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Numbers that may stand for another character, or none, by HTML's rules.
NUMBERS = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(plane << 16 | n for plane in range(17) for n in (0xFFFE, 0xFFFF))]


def _values(pairs: dict) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({quote(a)}, {quote(b)})" for a, b in pairs.items())


def title_sql() -> str:
    """Titles by HTML's own tables of references: of a name that is none, the longest start that is one counts."""
    odd = {n: said for n in NUMBERS if (said := entities.unescape(f"&#{n};")) != chr(n)}
    element = lambda name: rf"regexp_replace(regexp_extract(html, '(?is)<{name}(?:[\t-\r ][^>]*)?>(.*?)</{name}[\t-\r ]*>', 1), '(?s)<[^>]*>', '', 'g')"
    decoded = lambda x: f"array_to_string(list_transform(regexp_extract_all({x}, '{REFERENCE}'), lambda r, i: string_split_regex({x}, '{REFERENCE}')[i] || said[r]), '') || string_split_regex({x}, '{REFERENCE}')[-1]"
    title = lambda x: rf"nullif(trim(regexp_replace({decoded(x)}, '[\t-\r\x{{85}}\p{{Z}}]+', ' ', 'g')), '')"
    part = lambda group: rf"regexp_extract(url, '{ABSOLUTE}', {group})"
    stem = rf"replace(regexp_replace(regexp_extract({part(3)}, '[^/]*$'), '\.[^.]*$', ''), '+', ' ')"
    shown = lambda x: rf"CASE WHEN regexp_matches({x}, '[^\t-\r\x{{85}}\p{{Z}}]') THEN {x} END"
    return rf"""WITH names(name, said) AS (VALUES {_values(entities.entities.html5)}), numbers(n, said) AS (VALUES {_values(odd)}),
plain AS (SELECT url, {element("h1")} AS h1, {element("title")} AS title, {stem} AS stem, {part(2)} AS host FROM pages),
refs AS (SELECT DISTINCT unnest(regexp_extract_all(h1, '{REFERENCE}') || regexp_extract_all(title, '{REFERENCE}')) AS ref FROM plain),
numbered AS (SELECT ref, coalesce(TRY_CAST(CASE WHEN lower(ref[3]) = 'x' THEN '0x' || rtrim(ref[4:], ';') ELSE rtrim(ref[3:], ';') END AS BIGINT), 1114112) AS n FROM refs WHERE ref LIKE '&#%'),
named AS (SELECT ref, name, names.said FROM refs LEFT JOIN names ON starts_with(ref[2:], name) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY len(name) DESC NULLS LAST) = 1),
known AS (SELECT ref, CASE WHEN numbers.n IS NOT NULL THEN said WHEN n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) ELSE chr(n::INTEGER) END AS said FROM numbered LEFT JOIN numbers USING (n) UNION ALL SELECT ref, coalesce(said || ref[len(name) + 2:], ref) FROM named WHERE ref NOT LIKE '&#%'),
known_map AS (SELECT coalesce(map_from_entries(list((ref, said))), MAP {{}}) AS said FROM known),
choices AS (SELECT url, {title("h1")} AS h1, {title("title")} AS title, CASE WHEN regexp_replace(stem, '%[0-9A-Fa-f]{{2}}', '', 'g') NOT LIKE '%\%%' ESCAPE '\' THEN url_decode(stem) END AS stem, host FROM plain, known_map)
SELECT url, coalesce(h1, title, {shown("stem")}, {shown("host")}) AS title FROM choices"""


@query(title_sql())
def page_title(spark: Spark, sf: str) -> DataFrame:
    return links.page_title(table(spark, sf, "pages"))


@query(
    r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<nav\b[^>]*>.*?</nav\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', '', 'g'), '(?i)<(?:img|input)\b[^>]*>', '', 'g') AS html FROM pages"
)
def strip_boilerplate(spark: Spark, sf: str) -> DataFrame:
    return blocks.strip_boilerplate(table(spark, sf, "pages"), "page_id", container=None).drop("error")


@query()
def html_blocks(spark: Spark, sf: str) -> DataFrame:
    return blocks.html_blocks(table(spark, sf, "pages"), "page_id", container=None)


@query()
def process_documents(spark: Spark, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    titles = pages.select("page_id", "url").join(
        links.page_title(pages).hint("merge"), "url"
    ).select("page_id", "title")
    return blocks.process_documents(blocks.html_blocks(pages, "page_id", container=None), titles, "page_id")


@query(
    r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x{00A0}]+(\n|$)', '\1', 'g'), '[\t \x{00A0}]+', ' ', 'g'), '\n{4,}', E'\n\n\n', 'g'), '^[ \n\t]+|[ \n\t]+$', '', 'g') AS text FROM documents"
)
def normalize_text(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(
    r"SELECT doc_id, 'Inherits from: ' || trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g')) AS line FROM documents"
)
def normalize_service_line(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", T.normalize_service_line(F.concat(F.lit("Inherits from: \n "), F.ltrim("text"))).alias("line")
    )


@query(f"SELECT doc_id, len({TOKENS})::INTEGER AS n_tokens FROM documents")
def count_tokens(spark: Spark, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


COLUMNS = ["document_id", "chunk_id", "ordinal", "approximate_token_count", "content"]


@query(
    f"WITH {FIXED} SELECT document_id, {CHUNK_ID} AS chunk_id, ordinal, approximate_token_count, content FROM chunks"
)
def chunk_fixed(spark: Spark, sf: str) -> DataFrame:
    return chunking.chunk_fixed(processed(spark, sf), SIZE).select(COLUMNS)


@query(
    f"WITH {OVERLAPPED} SELECT document_id, {CHUNK_ID} AS chunk_id, ordinal, approximate_token_count, content FROM chunks"
)
def chunk_overlap(spark: Spark, sf: str) -> DataFrame:
    return chunking.chunk_overlap(processed(spark, sf), SIZE, OVERLAP).select(COLUMNS)


PARAGRAPHS = rf"{DOCS}, lines AS (SELECT document_id, list_filter(list_transform(string_split_regex(content, '\n+'), lambda x: trim(x)), lambda x: len(x) > 0) AS l FROM docs), chunks AS (SELECT document_id, unnest(range(0, len(l)))::INTEGER AS ordinal, unnest(l) AS content FROM lines)"


@query(
    rf"WITH {PARAGRAPHS} SELECT document_id, {CHUNK_ID} AS chunk_id, ordinal, len(regexp_extract_all(content, '[^\s\x{{00A0}}\x{{0085}}\p{{Z}}]+'))::INTEGER AS approximate_token_count, content FROM chunks"
)
def chunk_paragraph(spark: Spark, sf: str) -> DataFrame:
    return chunking.chunk_paragraph(processed(spark, sf)).select(COLUMNS)


@query()
def chunk_heading_aware(spark: Spark, sf: str) -> DataFrame:
    return chunking.chunk_heading_aware(processed(spark, sf), 512, 64)


@query(
    r"SELECT 'doc-' || doc_id AS document_id, NULL::VARCHAR AS section, 0 AS section_ordinal, 0 AS unit_ordinal, trim(text, E' \n\t\r') AS unit FROM documents WHERE trim(text, E' \n\t\r') <> ''"
)
def split_sections(spark: Spark, sf: str) -> DataFrame:
    return chunking.split_sections(processed(spark, sf))


def headed(spark: Spark, sf: str) -> DataFrame:
    """Documents with headings, a title line, fences and paragraphs, all derived from their sentences."""
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))
    text = F.regexp_replace(text, "\n([A-M][a-z]*) ", "\n## $1 and more\n")
    text = F.regexp_replace(text, "\n([N-S])", "\n```\n\n$1")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("document_id"), F.concat(F.lit("Title "), F.col("doc_id") % 3).alias("title"),
        F.concat(F.lit("# Title 1\n"), text).alias("content")
    )


HEADED = r"""headed AS (SELECT 'doc-' || doc_id AS document_id, 'Title ' || (doc_id % 3) AS title, E'# Title 1\n' || regexp_replace(regexp_replace(replace(text, '. ', E'.\n\n'), '\n([A-M][a-z]*) ', E'\n## \\1 and more\n', 'g'), '\n([N-S])', E'\n```\n\n\\1', 'g') AS content FROM documents)"""


@query(
    rf"""WITH {HEADED}, lines AS (SELECT document_id, title, unnest(l) AS line, unnest(range(len(l))) AS i FROM (SELECT document_id, title, string_split(replace(content, E'\r\n', E'\n'), E'\n') AS l FROM headed)),
    fences AS (SELECT *, sum(starts_with(line, '```')::INT) OVER (PARTITION BY document_id ORDER BY i) % 2 AS after, (sum(starts_with(line, '```')::INT) OVER (PARTITION BY document_id ORDER BY i) - starts_with(line, '```')::INT) % 2 AS before FROM lines),
    kinds AS (SELECT *, before = 0 AND starts_with(line, '## ') AS head, (before = 0 AND (starts_with(line, '## ') OR trim(line) = '# ' || title)) OR (after = 0 AND trim(line) = '') AS brk FROM fences),
    placed AS (SELECT *, sum(head::INT) OVER (PARTITION BY document_id ORDER BY i) AS sec, sum(brk::INT) OVER (PARTITION BY document_id ORDER BY i) AS run FROM kinds),
    names AS (SELECT document_id, sec, trim(line[4:]) AS section FROM placed WHERE head),
    units AS (SELECT document_id, sec, run, trim(string_agg(line, E'\n' ORDER BY i), E' \n\t\r') AS unit FROM placed WHERE NOT brk GROUP BY ALL HAVING unit <> ''),
    homes AS (SELECT *, CASE WHEN sec > 0 THEN sec ELSE coalesce(min(sec) FILTER (sec > 0) OVER (PARTITION BY document_id), 0) END AS home FROM units)
    SELECT h.document_id, section, (dense_rank() OVER (PARTITION BY h.document_id ORDER BY home) - 1)::INTEGER AS section_ordinal, (row_number() OVER (PARTITION BY h.document_id, home ORDER BY h.sec, run) - 1)::INTEGER AS unit_ordinal, unit FROM homes h LEFT JOIN names n ON n.document_id = h.document_id AND n.sec = home"""
)
def split_headed_sections(spark: Spark, sf: str) -> DataFrame:
    """Sections and units of documents with headings, fences that may not end and title lines."""
    return chunking.split_sections(headed(spark, sf))


@query()
def chunk_headed_documents(spark: Spark, sf: str) -> DataFrame:
    return chunking.chunk_heading_aware(headed(spark, sf), SIZE, OVERLAP)


@query(
    f"WITH {DOCS}, s AS (SELECT document_id, content, w, CASE WHEN len(w) <= 64 THEN [0] ELSE range(0, len(w), 56) END AS offs FROM docs) SELECT document_id, (i - 1)::INTEGER AS piece, CASE WHEN len(w) <= 64 THEN content ELSE array_to_string(w[offs[i] + 1 : offs[i] + 56], ' ') END AS content FROM (SELECT *, unnest(range(1, len(offs) + 1)) AS i FROM s)"
)
def split_oversized(spark: Spark, sf: str) -> DataFrame:
    units = processed(spark, sf).select("document_id", F.lit(0).alias("unit_ordinal"), F.col("content").alias("unit"))
    return chunking.split_units(units, SIZE, OVERLAP).drop("unit_ordinal")


def _profile(name: str, cte: str) -> str:
    return f"SELECT '{name}' AS strategy, count(*) AS n_chunks, count(DISTINCT document_id) AS n_documents, min(approximate_token_count) AS min_tokens, round(avg(approximate_token_count), 6) AS avg_tokens, max(approximate_token_count) AS max_tokens, round(quantile_cont(approximate_token_count, 0.5), 6) AS median_tokens FROM (WITH {cte} SELECT * FROM chunks)"


@query(_profile("fixed", FIXED) + " UNION ALL " + _profile("overlap", OVERLAPPED))
def chunk_profile(spark: Spark, sf: str) -> DataFrame:
    docs = processed(spark, sf)
    return chunking.chunk_profile(
        {"fixed": chunking.chunk_fixed(docs, SIZE), "overlap": chunking.chunk_overlap(docs, SIZE, OVERLAP)}
    )


@query(
    f"WITH c AS (SELECT 'fixed' AS strategy, document_id, approximate_token_count AS n FROM (WITH {FIXED} SELECT * FROM chunks) UNION ALL SELECT 'overlap', document_id, approximate_token_count FROM (WITH {OVERLAPPED} SELECT * FROM chunks)) SELECT strategy, document_id, grouping(strategy)::INTEGER AS all_strategies, grouping(document_id)::INTEGER AS all_documents, count(*) AS n_chunks, sum(n)::BIGINT AS n_tokens, min(n) AS min_tokens, max(n) AS max_tokens FROM c GROUP BY GROUPING SETS ((strategy, document_id), (strategy), (document_id), ())"
)
def chunk_matrix(spark: Spark, sf: str) -> DataFrame:
    docs = processed(spark, sf)
    return chunking.chunk_matrix(
        {"fixed": chunking.chunk_fixed(docs, SIZE), "overlap": chunking.chunk_overlap(docs, SIZE, OVERLAP)}
    )


@query(
    "SELECT 'documents_without_labels' AS rule, doc_id::VARCHAR AS key, NULL::VARCHAR AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'documents_without_vectors', doc_id::VARCHAR, NULL FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'vectors_without_labels', vec_id::VARCHAR, NULL FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'labels_without_documents', doc_id::VARCHAR, NULL FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"
)
def check_presence(spark: Spark, sf: str) -> DataFrame:
    """Which of documents, labels and vectors an id lacks."""
    tables = {
        "documents": table(spark, sf, "documents").select("doc_id"), "labels": table(spark, sf, "labels").select("doc_id"),
        "vectors": table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"))
    }
    needs = {"documents": ["labels", "vectors"], "vectors": ["labels"], "labels": ["documents"]}
    return integrity.check_presence(tables, "doc_id", needs)


@query(
    f"WITH {FIXED} SELECT (SELECT count(*) FROM docs) AS documents, count(*) AS chunks, count(DISTINCT document_id) AS chunked_documents FROM chunks"
)
def process_summary(spark: Spark, sf: str) -> DataFrame:
    docs = processed(spark, sf)
    return chunking.process_summary(docs, chunking.chunk_fixed(docs, SIZE))


@query(
    f"WITH {FIXED} SELECT document_id, ordinal, {CHUNK_ID} AS chunk_id, canonical_url AS source_url, title AS document_title, '1' AS version, content_hash AS processed_content_hash, approximate_token_count, content FROM chunks"
)
def artifacts_round_trip(spark: Spark, sf: str) -> DataFrame:
    """write_artifacts, then read_artifacts. A document without tokens has no chunk, which artifacts
    refuse, so it isn't among theirs."""
    docs, root = processed(spark, sf).where(~T.is_blank(F.col("content"))), scratch_path(spark, "artifacts")
    corpus.write_artifacts(
        docs, chunking.chunk_fixed(docs, SIZE), {"version": 1, "corpus_version": 1, "chunk_size": SIZE, "overlap": 0},
        root
    )
    return corpus.read_artifacts(spark, root)[1].drop("section")


@query("SELECT item_id AS position, 'q' || item_id AS question_id, text FROM benchmark")
def load_questions(spark: Spark, sf: str) -> DataFrame:
    """The benchmark written as a question file and loaded again."""
    rows = table(spark, sf, "benchmark").withColumns(
        {
            "id": F.concat(F.lit("q"), "item_id"), "language": F.lit("en"), "category": F.lit("NoEvidence"),
            "expectedStatus": F.lit("InsufficientEvidence"), "requiresMultipleSources": F.lit(False)
        }
    )
    fields = ["id", "language", "category", "text", "expectedStatus", "requiresMultipleSources"]
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("item_id", *fields))).alias("q"))
    path = scratch_path(spark, "questions")
    listed.select(
        F.lit(1).alias("version"),
        F.transform("q", lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("questions")
    ).write.json(path)
    return corpus.load_questions(spark, path).select(F.col("position").cast("long"), "question_id", "text")


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def write_new_report(spark: Spark, sf: str) -> DataFrame:
    path = scratch_path(spark, "report")
    corpus.write_new_report(table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("source string, n long").json(path)


def _damaged(spark: Spark, sf: str) -> DataFrame:
    """Fixed chunks of which the first of each document has a wrong token count."""
    chunks = chunking.chunk_fixed(processed(spark, sf), SIZE)
    return chunks.withColumn(
        "approximate_token_count", F.when(F.col("ordinal") == 0, 0).otherwise(F.col("approximate_token_count"))
    )


@query(
    "SELECT 'repeated_text' AS rule, sha256(text) AS key, count(*)::VARCHAR AS detail FROM documents GROUP BY 2 HAVING count(*) > 1"
)
def check_unique(spark: Spark, sf: str) -> DataFrame:
    return integrity.check_unique(processed(spark, sf), ["content_hash"], "repeated_text")


LOST = "SELECT '{rule}' AS rule, {key}::VARCHAR AS key, {key}::VARCHAR AS detail FROM {child} WHERE {key} NOT IN (SELECT {other} FROM {parent})"
REFERENCES = [
    ("document_without_label", "documents", "doc_id", "labels", "doc_id"),
    ("chunk_without_document", "benchmark", "item_id", "documents", "doc_id"),
    ("embedding_without_chunk", "embeddings", "vec_id", "benchmark", "item_id"),
    ("chunk_without_embedding", "documents", "doc_id", "embeddings", "vec_id"),
]


@query(" UNION ALL ".join(LOST.format(rule=r, child=c, key=k, parent=p, other=o) for r, c, k, p, o in REFERENCES))
def check_references(spark: Spark, sf: str) -> DataFrame:
    """The rules of an index, with given tables in the place of its own."""
    return integrity.union(
        *(
            integrity.check_references(table(spark, sf, c), table(spark, sf, p).withColumnRenamed(o, k), k, k, r) for r,
            c, k, p, o in REFERENCES
        )
    )


@query(f"WITH {FIXED} SELECT 'token_count' AS rule, {CHUNK_ID} AS key, '0' AS detail FROM chunks WHERE ordinal = 0")
def check_hashes(spark: Spark, sf: str) -> DataFrame:
    return integrity.check_hashes(processed(spark, sf), _damaged(spark, sf))


@query(
    f"WITH {FIXED} SELECT 'source_url_differs' AS rule, {CHUNK_ID} AS key, 'elsewhere' AS detail FROM chunks WHERE ordinal = 1"
)
def check_denormalised(spark: Spark, sf: str) -> DataFrame:
    docs = processed(spark, sf)
    rows = corpus.denormalise(docs, chunking.chunk_fixed(docs, SIZE)).withColumn(
        "source_url", F.when(F.col("ordinal") == 1, "elsewhere").otherwise(F.col("source_url"))
    )
    return integrity.check_denormalised(
        rows, docs, {"source_url": "canonical_url", "document_title": "title", "processed_content_hash": "content_hash"}
    )


@query(
    f"WITH {FIXED} SELECT 'tokens' AS rule, {CHUNK_ID} AS key, NULL::VARCHAR AS detail FROM chunks WHERE ordinal = 0"
)
def check_constraints(spark: Spark, sf: str) -> DataFrame:
    return integrity.check_constraints(_damaged(spark, sf), "chunk_id", integrity.chunk_rules())


HEADERS = "heads AS (SELECT 'documents' AS side, (SELECT count(DISTINCT source) FROM documents) AS corpus_version, (SELECT max(len(embedding)) FROM embeddings) AS chunk_size, (SELECT max(turn) FROM conversations) AS overlap UNION ALL SELECT 'chunks', (SELECT count(DISTINCT lang) FROM documents), (SELECT min(label) FROM embeddings), (SELECT max(turn) FROM conversations))"


@query(
    f"WITH {HEADERS} SELECT 'header_invalid' AS rule, side AS key, '1' AS detail FROM heads WHERE NOT (chunk_size > 0 AND overlap >= 0 AND overlap < chunk_size) UNION ALL SELECT 'headers_differ', 'documents', 'chunks' FROM heads a JOIN heads b ON a.side = 'documents' AND b.side = 'chunks' AND (a.corpus_version, a.chunk_size, a.overlap) <> (b.corpus_version, b.chunk_size, b.overlap)"
)
def check_headers(spark: Spark, sf: str) -> DataFrame:
    """Headers whose numbers are counted from the tables."""
    docs, vectors, turns = (table(spark, sf, t) for t in ("documents", "embeddings", "conversations"))
    overlap = turns.agg(F.max("turn").cast("int").alias("overlap"))

    def header(column: str, size):
        # One row a side.
        return docs.agg(F.countDistinct(column).alias("corpus_version")).join(
            vectors.agg(size.cast("int").alias("chunk_size"))
        ).join(overlap).withColumn("version", F.lit(1))

    return integrity.check_headers(header("source", F.max(F.size("embedding"))), header("lang", F.min("label")))


@query(
    "SELECT rule, 'c' || conv_id || '-' || turn AS key, NULL::VARCHAR AS detail FROM conversations, (VALUES ('category', 'system'), ('answered_needs_evidence', 'assistant')) r(rule, who) WHERE role = who UNION ALL SELECT 'status_of_category', 'c' || conv_id || '-' || turn, NULL FROM conversations WHERE role <> 'user'"
)
def check_questions(spark: Spark, sf: str) -> DataFrame:
    """Turns as questions: a system turn has no known category, an assistant's claims an answer
    without evidence in a category of refusals."""
    role = F.col("role")
    rows = table(spark, sf, "conversations").select(
        F.concat(
            F.lit("c"), "conv_id", F.lit("-"), "turn"
        ).alias("question_id"), F.lit("en").alias("language"), "text", F.when(role == "system", "Other").otherwise("NoEvidence").alias("category"),
        F.when(role == "assistant", "Answered").otherwise("InsufficientEvidence").alias("expected_status"), F.lit(False).alias("requires_multiple_sources"), F.array().cast("array<string>").alias("expected_urls"), F.array().cast("array<string>").alias("expected_facts"),
    )
    return integrity.check_questions(rows)
