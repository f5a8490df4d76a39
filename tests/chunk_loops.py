"""Heading-aware chunking as plain loops, a document at a time: what the DataFrame operators are held against."""

from __future__ import annotations

import hashlib
import re


def sections(title: str, text: str) -> list[tuple[str | None, list[str]]]:
    """Sections and their units. `## ` opens a section and a blank line ends a unit, both
    outside fences (which open and close at column 0); the title's own line is dropped; what
    precedes the first section joins the first that isn't empty."""
    found: list[tuple[str | None, list[str]]] = [(None, [])]
    unit: list[str] = []
    fenced = False

    def flush() -> None:
        body = "\n".join(unit).strip()
        unit.clear()
        if body:
            found[-1][1].append(body)

    for line in text.replace("\r\n", "\n").split("\n"):
        if not fenced and line.startswith("## "):
            flush()
            found.append((line[3:].strip(), []))
        elif not fenced and line.strip() == f"# {title}":
            flush()
        else:
            fenced ^= line.startswith("```")
            if fenced or line.strip():
                if unit or line:
                    unit.append(line)
            else:
                flush()
    flush()
    (_, preamble), *named = found
    full = [s for s in named if s[1]]
    if full:
        return [(full[0][0], preamble + full[0][1]), *full[1:]]
    return [(None, preamble)] if preamble else []


def split_oversized(unit: str, budget: int, overlap: int) -> list[str]:
    """A unit that fits, unchanged; else runs of budget - overlap tokens, one at least."""
    words = re.findall(r"\S+", unit)
    if len(words) <= budget:
        return [unit]
    step = max(1, budget - overlap)
    return [" ".join(words[i : i + step]) for i in range(0, len(words), step)]


def pack(units: list[str], budget: int, overlap: int) -> list[str]:
    """Bodies of at most `budget` tokens; each starts with the last tokens of the one before,
    as many as overlap and the next unit leave room for."""
    bodies: list[str] = []
    held: list[str] = []
    count = 0
    for unit in units:
        size = len(unit.split())
        if held and count + size > budget:
            bodies.append("\n\n".join(held))
            room = min(overlap, max(0, budget - size))
            tail = bodies[-1].split()[-room:] if room else []
            held, count = [" ".join(tail)] if tail else [], len(tail)
        held.append(unit)
        count += size
    return bodies + (["\n\n".join(held)] if held else [])


def heading_chunks(document_id: str, title: str, text: str, size: int, overlap: int) -> list[tuple]:
    """Rows of CHUNKS_OR_ERROR of one document; each chunk starts with its title and section. A
    title and section that leave no room for a body token make the document one row that says so."""
    out = []
    for name, units in sections(title, text):
        prefix = f"# {title.strip()}" + (f"\n\n## {name}" if name else "")
        budget = size - len(prefix.split())
        if budget < 1:
            return [
                (
                    document_id, None, name or None, None, None, None,
                    f"size {size} leaves no room for a body token after the title and section"
                )
            ]
        fitting = [x for unit in units for x in split_oversized(unit, budget, overlap)]
        for body in pack(fitting, budget, overlap):
            content, n = f"{prefix}\n\n{body.strip()}", len(out)
            name_hash = hashlib.sha256(f"{document_id}\n{n}\n{content}".encode()).hexdigest()
            out.append((document_id, name_hash, name or None, n, len(content.split()), content, None))
    return out
