"""Paragraphs that go out as a document and come back edited: identifiers, and the way of new wording into the source."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Sequence

#: What an editor of the built document doesn't own: bindings and bracketed citations.
OWNED = re.compile(r"\{\{[^}]*\}\}|\[@[^\]]*\]")
BREAK = re.compile(r"\n\s*\n")
MARKS = re.compile(r"[*_`]")


#: Fixed form of a file's part of an identifier: so many characters of its name, then so many digits of a digest.
NAME_CHARS, DIGEST_CHARS = 12, 6


def file_slug(path: str) -> str:
    """What stands for a file in identifiers: readable, and unique since the digest is of the whole path."""
    name = path[path.rfind("/") + 1 :]
    stem = name[: name.rfind(".")] if "." in name else name
    runs = re.findall("[A-Za-z0-9]+|[^A-Za-z0-9]+", stem)
    short = "".join(x if re.match("[A-Za-z0-9]", x) else "_" for x in runs)[:NAME_CHARS].strip("_")
    return (short or "f") + hashlib.sha256(path.encode()).hexdigest()[:DIGEST_CHARS]


def paragraphs(path: str, text: str, start: int = 0, prefix: str = "ct-p-") -> list[tuple[str, str, int]]:
    """Identifier, text and offset of each paragraph of prose from ``start`` on, which is behind the front matter.

    Blocks and the breaks between them are counted alike, so a heading or a placeholder takes a number without having
    an identifier.
    """
    out, at, number, slug = [], start, 0, file_slug(path)
    ends = [(m.start(), m.end()) for m in BREAK.finditer(text, start)] + [(len(text), len(text))]
    for end, following in ends:
        block = text[at:end]
        body = block.strip()
        if body and not body.startswith("#") and not re.fullmatch(r"\{\{[^}]*\}\}", body):
            out.append((f"{prefix}{slug}-{number}", body, at + block.index(body)))
        at, number = following, number + 2
    return out


def plain(text: str) -> str:
    """Prose as the built document shows it: no emphasis marks, single spaces."""
    return " ".join(MARKS.sub("", text).split())


def _fields(pieces: Sequence[str], text: str) -> list[str] | None:
    """What stands between ``pieces`` where ``text`` is these in order with something in each gap; else ``None``. Both
    are plain, so the first place of each piece will do."""
    if not text.startswith(pieces[0]) or not text.endswith(pieces[-1]):
        return None
    out, at, last = [], len(pieces[0]), len(text) - len(pieces[-1])
    for i, piece in enumerate(pieces[1:], 1):
        least = at + (text[at : at + 1] == " ") + 1
        end = last if i == len(pieces) - 1 else text.find(piece, least, last)
        if end < least:
            return None
        out.append(text[at:end].strip())
        at = end + len(piece)
    return out


def _alone(text: str, start: int, end: int) -> bool:
    """Whether ``text[start:end]`` isn't part of a longer word or number."""
    joins = lambda a, b: a.isalnum() and b.isalnum()
    if start and joins(text[start - 1], text[start]) or end < len(text) and joins(text[end - 1], text[end]):
        return False
    before = start > 1 and text[start].isdigit() and text[start - 1] in ".,−-" and text[start - 2].isdigit()
    return not before and not (text[end - 1].isdigit() and re.match(r"[.,]\d", text[end : end + 2]))


def _same(a: Sequence[str], b: Sequence[str], i: int, j: int, step: int) -> int:
    """How many words are equal from ``a[i]`` and ``b[j]`` on, forwards or backwards."""
    n = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and a[i] == b[j]:
        n, i, j = n + 1, i + step, j + step
    return n


def _places(shown: Sequence[str], prose: Sequence[str], returned: str) -> list[int] | None:
    """Where each of ``shown`` stands in ``returned``, in their order and as words of their own; else ``None``.

    What is shown may stand in the prose too, so of all such places those are taken that have most words around them in
    common with ``prose``, the first of equals.
    """
    spots = [[at for m in re.finditer(f"(?={re.escape(x)})", returned) if _alone(returned, at := m.start(), at + len(x))] for x in shown]
    if all(len(x) == 1 for x in spots):
        weights = [[0]] * len(shown)
    else:
        words = [(m.start(), MARKS.sub("", m[0])) for m in re.finditer(r"\S+", returned)]
        starts, words = [x for x, _ in words], [x for _, x in words]
        around = [plain(p).split() for p in prose]
        weights = []
        for i, x in enumerate(shown):
            pair = []
            for at in spots[i]:
                # a mark that stands close to what is shown, as a bracket, counts as a word like any other
                before, behind = bisect_left(starts, at), bisect_left(starts, at + len(x))
                ahead = [MARKS.sub("", returned[starts[before - 1] : at].strip())] if before else []
                after = [MARKS.sub("", returned[at + len(x) : starts[behind] if behind < len(starts) else len(returned)].strip())]
                last, first = around[i][-1:], around[i + 1][:1]
                n = m = 0
                if ahead == last:
                    n = bool(last) + _same(around[i], words, len(around[i]) - 2, before - 2, -1)
                if after == [""]:
                    m = _same(around[i + 1], words, 0, behind, 1)
                elif after == first:
                    m = 1 + _same(around[i + 1], words, 1, behind, 1)
                pair.append(n + m)
            weights.append(pair)
    best: list[list[tuple[int, int]]] = []  # of each place the sum up to it, and the place before
    for i, x in enumerate(shown):
        here, k, top = [], 0, (0, -1) if i == 0 else None
        for at, w in zip(spots[i], weights[i], strict=True):
            while i and k < len(spots[i - 1]) and spots[i - 1][k] + len(shown[i - 1]) <= at:
                before = best[i - 1][k]
                if before is not None and (top is None or before[0] > top[0]):
                    top = (before[0], k)
                k += 1
            here.append(None if top is None else (top[0] + w, top[1]))
        best.append(here)
    ends = [(s[0], -k) for k, s in enumerate(best[-1]) if s is not None]
    if not ends:
        return None
    k, out = -max(ends)[1], []
    for i in range(len(shown) - 1, -1, -1):
        out.append(spots[i][k])
        k = best[i][k][1]
    return out[::-1]


def realigned(source: str, rendered: str, returned: str) -> str | None:
    """``source`` with the wording of ``returned`` and its own bindings and citations; ``None`` where one of these
    came back changed, or in another order. Stretches that nobody reworded keep their emphasis.

    The source without its own parts is a shape with gaps: laid over what was built it shows what each own part became,
    and these are looked up, in order, in what came back; the new wording is between them.
    """
    owned = list(OWNED.finditer(source))
    if not owned:
        return returned.strip() or None
    edges = [0, *(x for m in owned for x in m.span()), len(source)]
    prose = [source[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
    if any(not plain(p) for p in prose[1:-1]):
        return None  # own parts side by side can't be told apart
    shown = _fields([plain(p) for p in prose], plain(rendered))
    places = shown and _places(shown, prose, returned)
    if not places:
        return None
    cuts = [0, *(x for at, s in zip(places, shown, strict=True) for x in (at, at + len(s))), len(returned)]
    out = []
    for i, new in enumerate(returned[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)):
        out.append(prose[i] if plain(prose[i]) == plain(new) else new)
        out.append(owned[i][0] if i < len(owned) else "")
    return "".join(out).strip() or None


def moved(before: Sequence[str], after: Sequence[str]) -> list[tuple[str, int, int]]:
    """Identifiers that came back elsewhere, with their places among those that both orders have.

    What stays in order is the longest run of increasing old places; all else moved.
    """
    shared = set(before) & set(after)
    place = {x: i for i, x in enumerate(x for x in before if x in shared)}
    now = [x for x in after if x in shared]
    ends: list[int] = []  # the smallest last place of a run of each length
    at: list[int] = []  # where that run ends
    previous = [-1] * len(now)
    for i, x in enumerate(now):
        n = bisect_left(ends, place[x])
        previous[i] = at[n - 1] if n else -1
        ends[n : n + 1], at[n : n + 1] = [place[x]], [i]
    still, i = set(), at[-1] if at else -1
    while i >= 0:
        still.add(now[i])
        i = previous[i]
    return [(x, place[x], i) for i, x in enumerate(now) if x not in still]
