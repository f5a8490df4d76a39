"""Column expressions over URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSOLUTE = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, group: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment of an absolute URL; '' if absent."""
    return F.regexp_extract(url, ABSOLUTE, group)


def remove_dots(path: Column) -> Column:
    """A path without its dot segments: "." names its folder, ".." the folder above, the root's
    being the root."""
    start = F.array().cast("array<string>")
    up = lambda out: F.when(F.size(out) > 1, F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
    step = lambda out, s: F.when(s == ".", out).when(s == "..", up(out)).otherwise(F.concat(out, F.array(s)))
    segments = F.split(path, "/")
    open_end = F.element_at(segments, -1).isin(".", "..")
    kept = F.aggregate(segments, start, step)
    joined = F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), joined).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """href made absolute against base: whole URLs, //host, /path, ?query, #fragment and relative
    paths, without dot segments in the path; null if it isn't a web link."""
    href = F.trim(href)
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    path = part(base, 3)
    folder = F.when(path.contains("/"), F.regexp_extract(path, "^(.*/)[^/]*$", 1)).otherwise(F.lit("/"))
    query = F.when(part(base, 4) != "", F.concat(F.lit("?"), part(base, 4))).otherwise(F.lit(""))
    whole = (
        F.when(href.rlike(r"^(?i)https?://"), href)
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:") | (href == ""), F.lit(None))
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when(href.startswith("#"), F.concat(origin, path, query, href))
        .otherwise(F.concat(origin, folder, href))
    )
    at, rest = part(whole, 3), F.regexp_extract(whole, r"^[^?#]*(.*)$", 1)
    clean = F.concat(part(whole, 1), F.lit("://"), part(whole, 2), remove_dots(at), rest)
    return F.when(at.contains("/."), clean).otherwise(whole)


@dataclass(frozen=True)
class Rules:
    """A page is allowed over https, on one host (any case) at its default port, without user,
    query or fragment, below a path prefix and with a suffix (any case)."""

    host: str
    prefix: str = "/"
    suffix: str = ".html"


def url_allowed(url: Column, rules: Rules) -> Column:
    authority = F.regexp_replace(F.lower(part(url, 2)), ":443$", "")
    path = part(url, 3)
    fine = (F.lower(part(url, 1)) == "https") & (authority == rules.host.lower()) & ~url.contains("?") & ~url.contains("#")
    return F.coalesce(fine & path.startswith(rules.prefix) & F.lower(path).endswith(rules.suffix.lower()), F.lit(False))


def file_stem(url: Column) -> Column:
    """The last path segment without its extension, unescaped."""
    return F.try_url_decode(F.regexp_replace(F.regexp_extract(part(url, 3), "([^/]*)$", 1), r"\.[^.]*$", ""))
