"""Small per-document helpers for Markdown's sequential rules, after the CommonMark text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

#: Lines that matter for headings: code fences, and ATX headings; both indented by three spaces at most.
_LINE = re.compile(r"^ {0,3}(?:(?P<fence>`{3,}|~{3,})(?P<info>[^\n]*)|(?P<marks>#{1,6})(?P<text>(?:[ \t][^\n]*)?))$", re.M)


def _code(fences: Iterable[re.Match]) -> Iterator[tuple[int, float]]:
    """[start, end) of each fenced block; a block without a closing fence has no end."""
    opened = None
    for f in fences:
        if opened is None:
            if "`" not in f["fence"] or "`" not in f["info"]:
                opened = f
        elif f["fence"].startswith(opened["fence"]) and f["info"].isspace() | (f["info"] == ""):
            yield opened.start(), f.end()
            opened = None
    if opened is not None:
        yield opened.start(), float("inf")


def headings(body: str) -> list[tuple[int, int, str]]:
    """(offset of its line, level, text) of each ATX heading outside fenced code; an empty heading shows its marks."""
    lines = list(_LINE.finditer(body))
    code = list(_code(m for m in lines if m["fence"]))
    begins = [a for a, _ in code]
    out = []
    for m in lines:
        before = bisect_right(begins, m.start()) - 1
        if m["fence"] or (before >= 0 and m.start() < code[before][1]):
            continue
        # A closing run of marks counts only behind a blank.
        words = m["text"].rstrip()
        bare = words.rstrip("#")
        text = (bare if bare[-1:] in (" ", "\t") else words).strip()
        out.append((m.start(), len(m["marks"]), text or m["marks"]))
    return out


def chunks(body: str, target: int = 1800, overlap: int = 200) -> list[tuple[int, int]]:
    """[start, end) of chunks that cover a body, each beginning within the one before or at its end.

    Ends are drawn back to a paragraph's end in the target's second half, starts to
    a paragraph's beginning within the chunk before.
    """
    target = max(1, target)
    overlap = min(target - 1, max(0, overlap))
    paragraphs = [m.start() for m in re.finditer(r"(?=\n\n)", body)]

    def paragraph(least: int, most: int, otherwise: int) -> int:
        """Behind the last blank line that begins in [least, most]."""
        i = bisect_right(paragraphs, most)
        return paragraphs[i - 1] + 2 if i and paragraphs[i - 1] >= least else otherwise

    spans, start = [], 0
    while not spans or spans[-1][1] < len(body):
        end = min(len(body), start + target)
        if end < len(body):
            end = paragraph(start + target // 2, end, end)
        spans.append((start, end))
        back = max(start + 1, end - overlap)
        start = min(end, paragraph(start, back, back))
    return spans


_SECTION = re.compile(r"^(#{1,4})[ \t]+(.*?)[ \t]*$", re.M)
_BLANK = "\n\n"


def _windows(text: str, target: int) -> Iterator[str]:
    """Runs of whole paragraphs of at most ``target`` characters; a longer paragraph is one of its own."""
    held: list[str] = []
    for paragraph in re.split(r"\n\s*\n", text):
        if held and len(_BLANK.join([*held, paragraph])) > target:
            yield _BLANK.join(held)
            held = []
        held.append(paragraph)
    yield _BLANK.join(held)


def sections(text: str, target: int = 2800, least: int = 120) -> list[tuple[str, str]]:
    """(path, chunk) of a Markdown file: split at headings of levels one to four, long sections by paragraphs, fragments joined."""
    text = text.replace("\r\n", "\n")
    marks = list(_SECTION.finditer(text))
    trail: dict[int, str] = {}
    paths = [""]
    for m in marks:
        trail = {level: name for level, name in trail.items() if level < len(m[1])} | {len(m[1]): m[2]}
        paths.append(" > ".join(trail.values()))
    edges = [0, *(m.start() for m in marks), len(text)]
    out: list[tuple[str, str]] = []
    for path, a, b in zip(paths, edges, edges[1:], strict=False):
        for piece in _windows(text[a:b].strip(), target):
            if not piece.strip():
                continue
            last = out[-1] if out else None
            # A fragment goes with what stands before it, under both paths.
            if last and min(len(last[1]), len(piece)) < least and len(last[1]) + len(_BLANK) + len(piece) <= target:
                names = dict.fromkeys(name for name in (last[0], path) if name)
                out[-1] = (" | ".join(names), last[1] + _BLANK + piece)
            else:
                out.append((path, piece))
    return out
