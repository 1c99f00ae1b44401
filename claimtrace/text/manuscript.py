"""What a manuscript is made of besides its numbers: title, counts, bibliography, dates and durations, bindings put in."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from claimtrace.text import analyze as T

WINDOW = 160  # fixed: characters on each side of an atom that a hint looks at
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATED = re.compile(rf"(?i)\b(?:\d{{1,2}}(?:st|nd|rd|th)?\s+{MONTH}|{MONTH}\s+\d{{1,4}})\b|\b\d{{4}}-\d{{2}}-\d{{2}}\b")
LASTING = re.compile(r"(?i)\b(?:days?|weeks?|months?|years?|follow-?\s?up|wash-?out|look-?\s?back|baseline period|enrol\w*|censor\w*|grace period|horizon)\b")
REFERENCES = re.compile(r"\s{0,3}(?:#{1,6}\s*)?(?:\*\*)?(?:\d+\.?\s*)?(?:references|bibliography|literature cited|works cited)(?:\*\*)?\s*:?\s*", re.I)
ENTRY = re.compile(r"\s*[A-Z][\w'’-]+, [A-Z][\w.'’-]*.{0,200}?\b(?:19|20)\d\d[a-z]?\b")
ABSTRACT = re.compile(r"(?i)\s*(?:structured )?(?:abstract|summary)\s*$")
TABLE_USED, FIGURE_USED = (re.compile(rf"\{{\{{\s*{x}\.[a-z0-9_.]+\s*\}}\}}") for x in ("table", "figure"))


def window(text: str, start: int, end: int, within: int = WINDOW) -> str:
    """An atom with what stands around it, on one line."""
    return text[max(0, start - within) : end + within].replace("\n", " ")


def hint(around: str) -> str:
    """Which advice an unbound number gets: date, duration, or value."""
    return "date" if DATED.search(around) else "duration" if LASTING.search(around) else "value"


def without_front_matter(text: str) -> tuple[str, str]:
    """The body, and the title that the front matter declares ('' if none)."""
    end, title = T.front_matter(text), ""
    for line in text[:end].split("\n"):
        if line.strip().startswith("title:"):
            title = line.partition(":")[2].strip().strip("\"'")
            break
    return (text[end:].lstrip("\n") if end else text), title


def without_bibliography(text: str) -> str:
    """The text before the first line that is only a heading of references."""
    at = 0
    for line in text.splitlines(keepends=True):
        if REFERENCES.fullmatch(line.rstrip("\r\n")):
            return text[:at].removesuffix("\n")
        at += len(line)
    return text


def is_reference(line: str) -> bool:
    """Whether a line looks like an entry of a reference list: a name, a first name, and a year soon after."""
    return bool(ENTRY.match(line))


@dataclass(frozen=True)
class Counts:
    abstract_words: int
    main_words: int
    total_words: int
    tables: int
    figures: int
    sections: tuple[str, ...]


def measured(text: str) -> Counts:
    """Words of the abstract and of the rest without references, and tables and figures that are placed."""
    abstract = main = 0
    found = T.sections(text)
    heads = T.headings(text)
    lead = text[T.front_matter(text) : heads[0][0]] if heads else text[T.front_matter(text) :]
    main += T.count_words(lead)
    for title, _, body in found:
        n = T.count_words(body)
        if ABSTRACT.match(title):
            abstract += n
        elif not REFERENCES.fullmatch(title):
            main += n + T.count_words(title)
    return Counts(abstract, main, abstract + main, len(TABLE_USED.findall(text)), len(FIGURE_USED.findall(text)), tuple(t for t, _, _ in found if t))


def spliced(text: str, changes: Iterable[tuple[int, int, str]]) -> str:
    """The text with each ``start, end`` replaced. Of changes that overlap the first stays."""
    out, at = [], 0
    for start, end, new in sorted(changes):
        if start >= at:
            out += [text[at:start], new]
            at = end
    return "".join([*out, text[at:]])


LABEL = re.compile(r"[A-Za-z]{1,3}\s*=\s*")
NUMBER = re.compile(r"\d[\d,]*(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+")
LINKS = "-–—/±:x×"
SIDE = r"[\d.,%\s ]*\d[\d.,%\s ]*"
COMPOUND = re.compile(rf"{SIDE}(?:[{LINKS}]{SIDE})+")


def numbers_of(atom: str) -> list[str]:
    """The numbers that an atom stands for, as written: the ends of a range, both sides of a ratio, else itself."""
    bare = atom.strip().strip("()[]")
    label = LABEL.match(bare)
    bare = bare[label.end() :] if label else bare
    return NUMBER.findall(bare) if COMPOUND.fullmatch(bare) else [bare]
