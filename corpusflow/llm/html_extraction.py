"""Main text of pages by differencing each page with its nearest neighbour by URL.

Pages of a host are sorted by URL path. A page's neighbour is the nearest page before or after it
that has other text lines (a copy shows nothing of the template), whichever shares the longer
start of the path. Both pages' text lines (blocks) are aligned by
longest common subsequence and the shared lines, which a site's template repeats, are deleted.
What the mark-up says is checked next: lines in menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments go even if they are unique. Lines inside an <article>
or <main> are the core. An article's lines and those in elements of prose (headings, paragraphs,
list items, cells and the like) stay even if the neighbour has them too, for texts quote each other.
Other lines of a <main>, in plain containers, are aligned with the neighbour's core, and go if
shared, unless they make up most of both cores' text, for copies are no template. If a page has a
core, lines outside it go, unless the core holds under CORE_SHARE of what the page has for itself.

Defined results: a null or empty html gives an empty text; a page alone on its host has no
neighbour, nor have pages whose host has only copies of them, so only the mark-up decides; pages with equal URLs are ordered by page_id; unclosed
and stray tags are tolerated; rows that repeat get equal rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.sources.scratch import materialize

#: Elements whose content is never main text, and elements that end a block.
NOISE = set(
    "nav header footer aside form script style noscript template button select textarea input svg iframe object canvas dialog head menu".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements whose lines are text of the page rather than of its site's frame, if they are in its core.
PROSE = HEADINGS | set("article blockquote caption dd dt figcaption li p pre summary td th".split())
#: Kinds of lines.
NOISY, LOOSE, FRAME, TEXT = range(4)
#: Words of class and id names that mark noise, and words that may stand beside them in a name:
#: "ad-slot" and "comment-list" are marks, "related-work" and "share-prices" aren't.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice popup promo promoted related replies reply share sharing sidebar signup social sponsor sponsored subscribe widget gdpr modal overlay toolbar skip".split()
)
BESIDE = set(
    "area articles bar block bottom box button buttons col column container count footer form global group inner item items left link links list main message middle outer page panel post posts right rail section site slot thread top unit user users wrap wrapper".split()
)
ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
#: Every alternative either fails at the next "<" or consumes what it read, so a scan is linear.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^<>]*+>|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Below this share of a page's own text, a core doesn't rule out lines outside it.
CORE_SHARE = 1 / 3
CORES = {"article", "main", "body"}
#: Elements that an element of the same kind closes, and those within which it does so.
LISTED = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",)
}
LISTS = {k: {"ul", "ol", "dl", "table", "tr", "select", "menu"} - {k} for k in LISTED}
RAW_END = {
    t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in (
        "script", "style", "textarea", "title", "noscript", "template", "svg", "iframe"
    )
}


def is_mark(value: str) -> bool:
    """Whether a name of a class or id attribute's value marks noise."""
    for name in value.split():
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+", name)]
        if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE or w.isdigit() for w in words):
            return True
    return False


def _noisy(name: str, attrs: str, inside: bool) -> bool:
    if name in NOISE and not (name == "header" and inside):
        return True
    for kind, value in ATTRIBUTE.findall(attrs) if attrs else ():
        value = value.strip("\"'")
        if kind.lower() == "role":
            if value.lower() in ROLES:
                return True
        elif name not in ("html", "body", "article", "main") and is_mark(value):
            return True
    return False


def page_lines(html: str | None) -> tuple[list[str], list[int]]:
    """Text blocks in page order, and for each its kind: NOISY, LOOSE (in no core), or in a core FRAME
    (in plain containers) or TEXT (in an article, or an element of prose)."""
    lines: list[str] = []
    kinds: list[int] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, noise, main
    noise = main = 0

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            lines.append(text)
            prose = main and any(open_at.get(x) for x in PROSE)
            kinds.append(NOISY if noise else TEXT if prose else FRAME if main else LOOSE)

    open_at: dict[str, list[int]] = {}  # places in the stack by name
    blocks: list[int] = []  # places of block elements

    def pop() -> None:
        nonlocal noise, main
        name, a, b = stack.pop()
        noise, main = noise - a, main - b
        open_at[name].pop()
        if blocks and blocks[-1] == len(stack):
            blocks.pop()

    def innermost(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)

    def close(names, until) -> None:
        """Closes the innermost open element of names, unless one of until is nearer."""
        at = innermost(names)
        if at >= 0 and at > innermost(until):
            while len(stack) > at:
                pop()

    source, at = html or "", 0
    while at < len(source):
        found = TOKEN.search(source, at)
        if found is None:
            held.append(entities.unescape(source[at:]))
            break
        if found.start() > at:
            held.append(entities.unescape(source[at : found.start()]))
        at = found.end()
        if found["cdata"] is not None:
            held.append(found["cdata"])
        if not found["name"]:
            continue
        name = found["name"].lower()
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            flush()
        if found["close"]:
            close((name,), CORES - {name} if name in CORES else CORES)
            continue
        if name in RAW_END:
            end = RAW_END[name].search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in VOID or found["attrs"].rstrip().endswith("/") and name not in BLOCKS:
            continue
        if name in BLOCKS and open_at.get("p") and blocks[-1] == open_at["p"][-1]:
            close(("p",), ())
        if name in LISTED:
            close(LISTED[name], LISTS[name])
        dirty = _noisy(name, found["attrs"], main > 0)
        core = name in ("article", "main") and not noise
        open_at.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append((name, dirty, core))
        noise, main = noise + dirty, main + core
    flush()
    return lines, kinds


#: Cells of the largest table by which common lines are found in one go.
CELLS = 1 << 22


def _lengths(x: np.ndarray, y: np.ndarray) -> Iterator[np.ndarray]:
    """For each start of x, the lengths of its longest common subsequences with all starts of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for item in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (y == item)))
        yield row


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mask of the items of x that a longest common subsequence with y takes. Where the table of
    lengths would be large, x is halved at the place of y where both halves have most in common, so
    that memory grows with the lines and not with their pairs."""
    taken = np.zeros(len(x), bool)
    at = np.flatnonzero(np.isin(x, y))  # others are in no common subsequence
    x, y = x[at], y[np.isin(y, x)]
    if not len(x):
        return taken
    if len(x) > 1 and len(x) * len(y) > CELLS:
        half = len(x) // 2
        before, after = None, None
        for before in _lengths(x[:half], y):
            pass
        for after in _lengths(x[half:][::-1], y[::-1]):
            pass
        cut = int(np.argmax(before + after[::-1]))
        taken[at] = np.concatenate([_common(x[:half], y[:cut]), _common(x[half:], y[cut:])])
        return taken
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, row in enumerate(_lengths(x, y)):
        table[i + 1] = row
    i, j = len(x), len(y)
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            taken[at[i - 1]] = True
            i, j = i - 1, j - 1
    return taken


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mask of the lines of a that a longest common subsequence with b takes. Equal starts and
    ends always belong to one."""
    taken = np.zeros(len(a), bool)
    n = min(len(a), len(b))
    head = int(np.argmin(np.append(a[:n] == b[:n], False)))
    n -= head
    tail = int(np.argmin(np.append(a[::-1][:n] == b[::-1][:n], False)))
    taken[:head] = True
    taken[len(a) - tail :] = True
    taken[head : len(a) - tail] = _common(a[head : len(a) - tail], b[head : len(b) - tail])
    return taken


def template_lines(
    a: np.ndarray, kinds: np.ndarray, sizes: np.ndarray, b: np.ndarray, their_kinds: np.ndarray, their_sizes: np.ndarray
) -> np.ndarray:
    """Numbers of the FRAME lines of a page that its neighbour repeats in its core (or, without
    one, unmarked); none if they are most of both cores' text. a, b: the pages' line hashes."""
    core = np.flatnonzero(kinds >= FRAME)
    theirs = their_kinds >= FRAME
    theirs = theirs if theirs.any() else their_kinds == LOOSE
    met = core[common_lines(a[core], b[theirs])]
    met = met[kinds[met] == FRAME]
    both = 2 * sizes[met].sum()
    copied = both > sizes[core].sum() and both > their_sizes[theirs].sum()
    return met[:0] if copied else met


def main_lines(lines: list[str], kinds: list[int], shared: set[int], template: set[int]) -> list[str]:
    """The lines that stay. shared: lines in common with the neighbour; template: core lines
    that its template repeats."""
    core = [i for i, k in enumerate(kinds) if k >= FRAME and i not in template]
    loose = [i for i, k in enumerate(kinds) if k == LOOSE and i not in shared]
    inside, outside = (sum(len(lines[i]) for i in x) for x in (core, loose))
    if any(k >= FRAME for k in kinds) and inside >= CORE_SHARE * (inside + outside):
        loose = []
    return [lines[i] for i in sorted(core + loose)]


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?(.*)$", 1)


def neighbours(keyed: DataFrame) -> DataFrame:
    """row and its neighbour's row, from (row, host, path, content). All pages are range-sorted
    once; consecutive pages of a host with equal content are a run, and a row's candidates are the
    end of the run before and the start of the run after its own. Within a sorted part they are
    found by windows; across parts by the parts' edges, one row a part. So no host is gathered in
    one task."""
    parts = keyed.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    parts = materialize(parts.withColumn("part", F.spark_partition_id()), "html-order")
    place = F.struct("host", "path", "row")
    order = Window.partitionBy("part").orderBy("host", "path", "row")
    back = Window.partitionBy("part").orderBy(F.desc("host"), F.desc("path"), F.desc("row"))
    earlier = (Window.unboundedPreceding, -1)
    run = F.struct("host", "content")
    runs = parts.withColumn(
        "starts", ~run.eqNullSafe(F.lag(run).over(order))
    ).withColumn("ends", ~run.eqNullSafe(F.lead(run).over(order)))
    runs = runs.withColumn(
        "before", F.last(F.when(F.col("ends"), place), ignorenulls=True).over(order.rowsBetween(*earlier))
    )
    runs = materialize(
        runs.withColumn(
            "after", F.last(F.when(F.col("starts"), place), ignorenulls=True).over(back.rowsBetween(*earlier))
        ),
        "html-runs"
    )
    edge = F.struct(run.alias("run"), place.alias("place"), "before", "after")
    edges = runs.groupBy("part").agg(F.min_by(edge, place).alias("first"), F.max_by(edge, place).alias("last")).orderBy("part").collect()  # one row a part
    found: dict[int, list] = {e.part: [e.part, None, None] for e in edges}
    for e, f in zip(edges, edges[1:], strict=False):
        found[f.part][1] = e.last.place if e.last.run != f.first.run else e.last.before or found[e.part][1]
    for e, f in reversed(list(zip(edges, edges[1:], strict=False))):
        found[e.part][2] = f.first.place if e.last.run != f.first.run else f.first.after or found[f.part][2]
    kind = runs.schema["before"].dataType.simpleString()
    across = keyed.sparkSession.createDataFrame(
        list(found.values()), f"part int, part_before {kind}, part_after {kind}"
    )
    placed = runs.join(F.broadcast(across), "part")
    before, after = F.coalesce("before", "part_before"), F.coalesce("after", "part_after")
    placed = placed.select("row", "host", "path", before.alias("before"), after.alias("after"))

    def shared(other: str) -> Column:
        """Length of the common start of both paths; -1 on another host."""
        theirs = F.split(F.col(f"{other}.path"), "")
        ours = F.split("path", "")
        differ = F.array_position(F.zip_with(ours, theirs, lambda a, b: F.coalesce(a == b, F.lit(False))), False)
        return F.when(
            F.col(f"{other}.host") == F.col("host"), F.when(differ > 0, differ - 1).otherwise(F.size(ours))
        ).otherwise(-1)

    placed = placed.withColumn("b", shared("before")).withColumn("a", shared("after"))
    nearest = F.when(
        (F.col("b") >= 0) & (F.col("b") >= F.col("a")), F.col("before.row")
    ).when(F.col("a") >= 0, F.col("after.row"))
    return placed.select("row", nearest.alias("neighbour"))


def row_key() -> Column:
    """Names a page by its id and content; rows that repeat share it."""
    return F.struct(F.col("page_id").alias("id"), F.xxhash64("url", "html").alias("n"))


def line_hashes(pages: DataFrame) -> DataFrame:
    """row, host, path and hashes, kinds and sizes (of the text lines) of each distinct page,
    written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_lines(x.as_py()) for x in batch.column("html")]
            lines, kinds = pa.array(
                [x for x, _ in found], pa.list_(pa.string())
            ), pa.array([k for _, k in found], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["html"]).columns, lines, kinds], names=["row", "host", "path", "lines", "kinds"]
            )

    keyed = pages.select(
        row_key().alias("row"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html"
    )
    kind = pages.schema["page_id"].dataType.simpleString()
    parsed = keyed.mapInArrow(
        run, f"row struct<id: {kind}, n: bigint>, host string, path string, lines array<string>, kinds array<tinyint>"
    )
    hashed = parsed.select(
        "row", "host", "path", F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), "kinds",
        F.transform("lines", F.length).alias("sizes")
    )
    return materialize(hashed.dropDuplicates(["row"]), "html-hashes")


def shared_lines(hashed: DataFrame) -> DataFrame:
    """its (row), neighbour, shared (line numbers) and template (line numbers, see
    template_lines) of each page with a neighbour."""
    near = neighbours(
        hashed.select("row", "host", "path", F.xxhash64("hashes").alias("content"))
    ).where("neighbour is not null")
    lines = F.struct("hashes", "kinds", "sizes")
    own = hashed.select("row", lines.alias("ours")).hint("merge")
    other = hashed.select(F.col("row").alias("neighbour"), lines.alias("theirs")).hint("merge")
    both = near.join(other, "neighbour").join(own, "row").select("row", "neighbour", "ours", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, template = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                (a, *ours), (b, *theirs) = (
                    [np.array(p[c].as_py(), np.int64) for c in ("hashes", "kinds", "sizes")] for p in (x, y)
                )
                shared.append(np.flatnonzero(common_lines(a, b)))
                template.append(template_lines(a, *ours, b, *theirs))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(shared, pa.list_(pa.int32())),
                    pa.array(template, pa.list_(pa.int32()))
                ],
                names=["its", "neighbour", "shared", "template"]
            )

    kind = hashed.schema["row"].dataType.simpleString()
    return materialize(
        both.mapInArrow(run, f"its {kind}, neighbour {kind}, shared array<int>, template array<int>"), "html-shared"
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines, n_shared (lines shared with the neighbour) and
    neighbour (its page_id) of every page.

    Pages are parsed twice: first for the lines' hashes, which are all that differencing needs,
    then for the lines themselves, which are compressed for the one shuffle they pass."""
    shared = shared_lines(line_hashes(pages))
    kind = pages.schema["page_id"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstd.ZstdCompressor(level=3)
        for batch in batches:
            packed = [
                packer.compress(
                    json.dumps(page_lines(x.as_py()), ensure_ascii=False, separators=(",", ":")).encode()
                ) for x in batch.column("html")
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.drop_columns(["html"]).columns, pa.array(packed, pa.binary())],
                names=["page_id", "url", "row", "packed"]
            )

    parsed = pages.select("page_id", "url", row_key().alias("row"), "html").mapInArrow(
        parse, f"page_id {kind}, url string, row struct<id: {kind}, n: bigint>, packed binary"
    )
    both = parsed.join(shared.hint("merge"), F.col("row") == F.col("its"), "left").select(
        "page_id", "url", "packed", "shared", "template", F.col("neighbour.id").alias("neighbour")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstd.ZstdDecompressor()
        for batch in batches:
            texts, n_lines, n_shared = [], [], []
            for packed, met, repeated in zip(
                batch.column("packed"), batch.column("shared"), batch.column("template"), strict=True
            ):
                lines, kinds = json.loads(unpacker.decompress(packed.as_py()))
                gone = set(met.as_py() or ())
                texts.append("\n".join(main_lines(lines, kinds, gone, set(repeated.as_py() or ()))))
                n_lines.append(len(lines))
                n_shared.append(len(gone))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array(n_lines, pa.int64()),
                    pa.array(n_shared, pa.int64()), batch.column("neighbour")
                ],
                names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared", "neighbour"]
            )

    return both.mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long, n_lines long, n_shared long, neighbour {kind}"
    )
