"""Column expressions over text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a run of characters that aren't white space in Unicode's sense.
TOKEN = r"(?U)\S+"
SPACES = r"(?U)\s+"

#: From a line that starts a code fence to the line that ends it, or to the text's end.
FENCED = r"(?dms)^ *```[^\n]*+(?:\z|\n.*?(?:^ *```[^\n]*+|\z))"
#: Bare answers that say nothing by themselves.
BARE_ANSWERS = ("yes", "no", "да", "нет")

#: Fixed values of the language gate: words that mark an English question.
ENGLISH_INDICATORS = [
    "a", "an", "and", "are", "can", "do", "does", "for", "get", "how", "i", "in", "is", "it", "method", "of", "on",
    "the", "to", "use", "using", "what", "when", "where", "which", "why", "with"
]
#: Greek, Arabic, two blocks of ideographs, kana and Hangul; letters that Russian lacks.
UNSUPPORTED_SCRIPT = r"[Ͱ-Ͽ؀-ۿ一-鿿㐀-䶿぀-ヿ가-힯іїєґІЇЄҐ]"
CYRILLIC = r"[Ѐ-ԯ]"
#: Fixed value of the gate: a qualified name, as code has it.
IDENTIFIER = r"\b[A-Z][A-Za-z0-9]*\.[A-Z][A-Za-z0-9]*\b"


def tokens(text: Column) -> Column:
    """The tokens of a text, in order; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def count_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_text(text: Column) -> Column:
    """Collapses blanks outside code fences, drops those at line ends, keeps at most two blank
    lines in a row outside fences, trims the whole.

    Fenced stretches (a fence line up to the next one, or to the end) are cut out by one pattern;
    what lies between is cleaned by patterns that read each character a bounded number of times.
    """
    plain = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    blanks = lambda x: F.regexp_replace(x, "[\t \u00a0]+", " ")
    ends = lambda x: F.regexp_replace(x, r"(?U)(?<![\s&&[^\n]])[\s&&[^\n]]++(?=\n|\z)", "")
    between = lambda x: F.regexp_replace(ends(blanks(x)), r"\n{4,}+", "\n\n\n")
    first = lambda x: F.regexp_extract(x, r"^[^\n]*", 0)
    fenced = lambda x: ends(F.concat(blanks(first(x)), F.substring(x, F.length(first(x)) + 1, F.length(x))))
    inside = F.regexp_extract_all(plain, F.lit(FENCED), F.lit(0))
    pieces = F.zip_with(
        F.split(plain, FENCED), inside, lambda x, y: F.concat(between(x), F.coalesce(fenced(y), F.lit("")))
    )
    whole = F.when(plain.contains("```"), F.array_join(pieces, "")).otherwise(between(plain))
    return F.btrim(whole, F.lit(" \n\t"))


def normalize_service_line(text: Column) -> Column:
    """White space collapsed, one space after the two labels of service lines."""
    return F.regexp_replace(squeeze(text), r"(?i)\b(Implemented in|Inherits from):\s*", "$1: ")


def detect_language(text: Column) -> Column:
    """Russian, English or null. Unsupported scripts are refused first, any Cyrillic letter
    then means Russian, an identifier or an indicator word English."""
    words = F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w))
    english = text.rlike(IDENTIFIER) | F.arrays_overlap(words, F.array(*map(F.lit, ENGLISH_INDICATORS)))
    return F.when(
        text.rlike(UNSUPPORTED_SCRIPT), F.lit(None)
    ).when(text.rlike(CYRILLIC), "Russian").when(english, "English")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), 0)


def uninformative(answer: Column, bare: tuple[str, ...] = BARE_ANSWERS) -> Column:
    """Whether an answer is only a bare word, or the number of a source: digits alone or in
    brackets, after "source" or not, with "#" only after it; one end mark is allowed."""
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)(?<!\s)\s++\z", "")
    cut = lambda x, first, left: F.substring(x, F.lit(first), F.length(x) - left)
    unmarked = lambda x: F.when(F.right(x, F.lit(1)).isin(".", "!", "?"), cut(x, 1, 1)).otherwise(x)

    def number(rest: Column) -> Column:
        quoted = rest.startswith("[") & rest.endswith("]")
        return F.when(quoted, cut(rest, 2, 2)).otherwise(rest).rlike(r"^\d+$")

    def named(rest: Column) -> Column:
        return F.when(rest.startswith("#"), strip(cut(rest, 2, 1)).rlike(r"^\d+$")).otherwise(number(rest))

    def judged(said: Column) -> Column:
        source = F.when(said.startswith("source"), once(strip(cut(said, 7, 6)), named)).otherwise(number(said))
        return said.isin(*bare) | source

    return once(strip(once(F.lower(strip(answer)), unmarked)), judged)


def redact(text: Column, secrets: list[Column], limit: int = 512, marker: str = "[redacted]") -> Column:
    """Secrets replaced, newlines flattened, cut at limit with an ellipsis."""
    for secret in secrets:
        text = F.when(F.length(secret) > 0, F.replace(text, secret, F.lit(marker))).otherwise(text)
    flat = F.translate(text, "\r\n", "  ")
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def profile_key(provider: Column, model: Column, dimension: Column) -> Column:
    return F.concat_ws(":", F.lower(F.trim(provider)), F.lower(F.trim(model)), dimension.cast("string"))


def format_embedding_input(text: Column, role: str, model: Column) -> Column:
    """Prefixes the text as one family of models expects; other models take it unchanged."""
    prefix = {"document": "title: none | text: ", "query": "task: search result | query: "}[role]
    return F.when(F.lower(F.trim(model)).rlike("^embeddinggemma(:.*)?$"), F.concat(F.lit(prefix), text)).otherwise(text)
