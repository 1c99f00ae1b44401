"""SentencePiece encoding and decoding: distinct sampled segmentations by Gumbel top-k.

All segmentations of a text are the paths of a lattice. Each has a probability, the product of its pieces' shares at
the places that it passes. A perturbed A* search draws without replacement: the set of all segmentations has a Gumbel
value; the segmentation drawn from a set takes the set's value over, and what remains is split into disjoint sets,
one for each piece: same path up to there, another piece at that place. Each gets a Gumbel value that its set's value
bounds, and the set with the largest is the next to be drawn from. The values that come out are the largest of all
perturbed log probabilities, in order, without any but the drawn segmentations being listed.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.llm.common import give_back, mix64, unit, unused, whole

#: Units (a word with the spaces before it) whose lattices a Python worker keeps; and edges of theirs.
KEPT, KEPT_EDGES = 110_000, 2_200_000
#: Texts are handled in groups of at most so many characters (or one text).
CHARS_AT_ONCE = 200_000
BASE = np.uint64(0x100000001B3)
#: The cumulated share of a state's last edge, and of no other.
FULL = 0xFFFFFFFF
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Hashes are looked up in bitmaps of so many bits before they are searched.
FILTER_BITS = 21


class Vocabulary:
    """The pieces of a model file, written with spaces instead of the mark that such files use for them.

    A piece's log weight is that of Zipf's law at its rank: minus the logarithm of rank + ``shift``, times ``theta``.
    A character without a piece is spelled in byte pieces, each as unlikely as the last rank.
    """

    def __init__(self, path: str, theta: float, shift: int = 8):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        surface = [b""] * n
        self.byte_ids = np.zeros(256, dtype=np.int32)
        names, ids = [], []
        for i in range(n):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(name[3:5], 16)
                self.byte_ids[b], surface[i] = i, bytes([b])
            elif name and not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                name = name.replace("▁", " ")
                surface[i] = name.encode("utf-8")
                names.append(name)
                ids.append(i)
        self.id_bytes = 2 if n <= 1 << 16 else 4
        self.surface, self.sizes = np.frombuffer(b"".join(surface), dtype=np.uint8), np.array(list(map(len, surface)))
        self.begin = np.cumsum(self.sizes) - self.sizes
        order = np.argsort([-model.get_score(i) for i in ids], kind="stable")
        weight = np.zeros(n)
        for rank, k in enumerate(order):
            weight[ids[k]] = -theta * np.log(rank + shift)
        self.byte_weight = -theta * np.log(len(ids) + shift)
        #: whether spaces stand at the beginning of pieces only, so that no piece reaches from one unit into the next
        self.by_unit = all(" " not in p.lstrip(" ") for p in names)
        self.longest = max(map(len, names))
        hashes = np.array([_hash_of(p) for p in names], dtype=np.uint64)
        at = np.argsort(hashes)
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError(f"{path}: two pieces have one hash")
        self.hashes, self.ids = hashes[at], np.array(ids, dtype=np.int32)[at]
        self.weights = weight[self.ids]
        #: the place in ``hashes`` of the piece with a hash's slot; -1: none, -2: several
        slots, self.place = _slots(self.hashes), np.full(1 << FILTER_BITS, -1, dtype=np.int32)
        self.place[slots] = np.arange(len(slots))
        taken, times = np.unique(slots, return_counts=True)
        self.place[taken[times > 1]] = -2
        #: beginnings of longer pieces: where no piece goes on, none needs to be looked for
        self.longer = _filter(np.array(sorted({_hash_of(p[:i]) for p in names for i in range(1, len(p))}), dtype=np.uint64))
        marks = "".join(map(re.escape, sorted(_marks(names))))
        self.units = re.compile(rf" *[^ {marks}]+| *[{marks}]+| +" if self.by_unit else r"(?s).+").findall

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of sequences of pieces that end at ``ends``, without the space that encoding puts before."""
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        data = self.surface[np.repeat(self.begin[ids] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        cut = np.concatenate([[0], upto])[np.concatenate([[0], ends])].tolist()
        return [data[a + 1 : b] if b > a else b"" for a, b in zip(cut, cut[1:], strict=False)]


def _marks(names: list[str]) -> set[str]:
    """ASCII control characters and punctuation, and what shares pieces with them, where letters don't: no piece
    reaches from a run of these into a run of other characters."""
    group: dict[str, str] = {}

    def root(c: str) -> str:
        while group.setdefault(c, c) != c:
            c = group[c]
        return c

    for name in names:
        name = name.lstrip(" ")
        for a, b in zip(name, name[1:], strict=False):
            group[root(a)] = root(b)
    letters = {root(chr(c)) for c in range(128) if chr(c).isalnum()}
    marks = {root(chr(c)) for c in range(128) if not chr(c).isalnum() and c != 32} - letters - {root(" ")}
    return {c for c in [*group, *map(chr, range(128))] if root(c) in marks}


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _slots(hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes * GOLDEN) >> np.uint64(64 - FILTER_BITS)


def _filter(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, dtype=bool)
    out[_slots(hashes)] = True
    return out


class Lattices:
    """Lattices of units in flat arrays: a state is a place in a unit, and its edges are the pieces that start there,
    the likeliest first."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self._room: dict[str, np.ndarray] = {}
        #: units by number, in the order in which they were met
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.built = 0
        self.start = np.zeros(0, dtype=np.int64)  # of each unit its first state
        self.met = np.zeros(0, dtype=np.int64)  # and how often it was met, of late
        self.unit = np.zeros(0, dtype=np.int32)  # of each state its unit
        self.first = np.zeros(1, dtype=np.int64)  # of each state its first edge, and one behind the last
        self.share = np.zeros(0, dtype=np.uint32)  # of the state's edges up to this one, less 2**-32
        self.next = np.zeros(0, dtype=np.int32)  # the state behind the piece; -1 at the end of the unit
        self.piece = np.zeros(0, dtype=np.int32)  # its id; a character that several bytes spell: -1 - code point
        self.logp = np.zeros(0)

    def _append(self, name: str, new: np.ndarray) -> None:
        """Arrays grow within larger buffers, so that growing costs no copy each time."""
        old = getattr(self, name)
        n, room = len(old) + len(new), self._room.get(name)
        if room is None or n > len(room):
            room = self._room[name] = np.empty(n + n // 4, dtype=old.dtype)
            room[: len(old)] = old
        room[len(old) : n] = new
        setattr(self, name, room[:n])

    def build(self, units: list[str]) -> None:
        """Lattices of new units. States are numbered by how far the end of the unit is, so that the masses of all
        paths from a state to the end can be summed for all units at once, one distance after the other."""
        v, base, base_edges = self.vocabulary, len(self.first) - 1, len(self.logp)
        sizes = np.array([len(u) for u in units])
        chars = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        total = len(chars)
        behind = np.repeat(np.cumsum(sizes), sizes)  # the place behind each place's unit
        places = np.arange(total)
        left = behind - places
        by_left = np.argsort(left, kind="stable")
        levels = np.searchsorted(left[by_left], np.arange(1, sizes.max() + 2)).tolist()
        state = np.empty(total, dtype=np.int64)
        state[by_left] = places
        live, h = places, np.zeros(total, dtype=np.uint64)
        single, counts = np.zeros(total, dtype=bool), np.zeros(total, dtype=np.int64)
        found = []

        def edges(start: np.ndarray, n: int, ids: np.ndarray, weights: np.ndarray) -> None:
            s, end = state[start], start + n
            last = end == behind[start]
            found.append((s, counts[s], np.where(last, total, state[np.where(last, start, end)]), ids, weights))
            counts[s] += 1

        for n in range(1, v.longest + 1):
            with np.errstate(over="ignore"):
                h = h * BASE + chars[live + n - 1] + np.uint64(1)
            slots = _slots(h)
            at = v.place[slots]
            hit = np.flatnonzero(at != -1)
            at, own = at[hit], h[hit]
            several = np.flatnonzero(at == -2)
            at[several] = np.minimum(np.searchsorted(v.hashes, own[several]), len(v.hashes) - 1)
            true = v.hashes[at] == own
            start, at = live[hit[true]], at[true]
            edges(start, n, v.ids[at], v.weights[at])
            if n == 1:
                single[start] = True
            on = np.flatnonzero(v.longer[slots] & (live + n < behind[live]))
            if not len(on):
                break
            live, h = live[on], h[on]
        bare = places[~single]
        code = chars[bare].astype(np.int64)
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        edges(bare, 1, np.where(code < 0x80, v.byte_ids[code % 0x80], -1 - code).astype(np.int32), n_bytes * v.byte_weight)
        first = np.concatenate([[0], np.cumsum(counts)])
        n_edges = int(first[-1])
        end, piece, logp, rank = np.empty(n_edges, dtype=np.int64), np.empty(n_edges, dtype=np.int32), np.empty(n_edges), np.empty(n_edges, dtype=np.int64)
        for s, r, e, ids, weights in found:
            at = first[s] + r
            end[at], piece[at], logp[at], rank[at] = e, ids, weights, r
        beta = np.zeros(total + 1)  # the last is the end of any unit
        for low, high in zip(levels, levels[1:], strict=False):
            a, b = first[low], first[high]
            offset, many = first[low:high] - a, counts[low:high]
            x = logp[a:b]
            x += beta[end[a:b]]
            top = np.maximum.reduceat(x, offset)
            beta[low:high] = top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, many)), offset))
            x -= np.repeat(beta[low:high], many)
        np.minimum(logp, 0.0, out=logp)
        owner = np.repeat(places, counts)
        logp[counts[owner] == 1] = 0.0
        # shares as whole numbers, so that they don't depend on what else is built
        part = np.rint(np.exp(logp) * 2.0**32).astype(np.int64)
        order = np.argsort((owner << 34) | ((1 << 32) - part >> 4 << 5) | rank)
        end, piece, logp, part = end[order], piece[order], logp[order], part[order]
        upto = np.concatenate([[0], np.cumsum(part)])
        share = np.clip(upto[1:] - np.repeat(upto[first[:-1]], counts) - 1, 0, FULL - 1).astype(np.uint32)
        share[first[1:] - 1] = FULL
        last = end == total
        unit = np.repeat(np.arange(len(self.start), len(self.start) + len(units)), sizes)[by_left]
        for name, new in (
            ("start", base + state[np.cumsum(sizes) - sizes]), ("met", np.zeros(len(units))), ("unit", unit), ("first", base_edges + first[1:]), ("share", share), ("piece", piece),
            ("next", np.where(last, -1, end + base)), ("logp", logp),
        ):
            self._append(name, new)

    def starts(self, texts: list[str]) -> list[np.ndarray]:
        """The first states of each text's units. Lattices of new units are built, all at once."""
        split, number = self.vocabulary.units, self.number.__getitem__
        found = [np.fromiter(map(number, split(" " + t)), dtype=np.int64) if t else np.zeros(0, dtype=np.int64) for t in texts]
        if len(self.number) > self.built:
            self.build(list(self.number)[self.built :])
            self.built = len(self.number)
        if found:
            self.met += np.bincount(np.concatenate(found), minlength=self.built)
        return [self.start[x] for x in found]

    def forget(self) -> None:
        """Called between groups of texts: keeps memory bounded. Of units that are too many the most often met stay, up to
        half of the bounds, and needn't be built again; numbers of all units, states and edges change."""
        if len(self.number) <= KEPT and len(self.logp) <= KEPT_EDGES:
            return
        counts = np.diff(self.first)
        order = np.argsort(-self.met, kind="stable")
        edges = np.bincount(self.unit, weights=counts, minlength=len(self.start))[order]
        stays = np.zeros(len(self.start), dtype=bool)
        stays[order[: KEPT // 2][np.cumsum(edges)[: KEPT // 2] <= KEPT_EDGES // 2]] = True
        names = [u for u, x in zip(self.number, stays.tolist(), strict=True) if x]
        states = stays[self.unit]
        live, state, unit = np.repeat(states, counts), np.cumsum(states) - 1, np.cumsum(stays) - 1
        behind = self.next[live]
        self._replace("next", np.where(behind < 0, -1, state[behind]))
        self._replace("first", np.concatenate([[0], np.cumsum(counts[states])]))
        self._replace("start", state[self.start[stays]])
        self._replace("unit", unit[self.unit[states]])
        self._replace("met", self.met[stays] // 2)
        for name in ("share", "piece", "logp"):
            self._replace(name, getattr(self, name)[live])
        self.number.clear()
        self.number.update(zip(names, range(len(names)), strict=True))
        self.built = len(names)

    def _replace(self, name: str, new: np.ndarray) -> None:
        """An array's values by fewer ones, in the same buffer."""
        self._room[name][: len(new)] = new
        setattr(self, name, self._room[name][: len(new)])

    def walk(self, states: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draws each state's unit to its end: the edges in order, and how many each state got.

        The draw of a step depends on the state's seed, its place and the number of the step only.
        """
        steps, live, now = [], np.arange(len(states)), states
        with np.errstate(over="ignore"):
            keys = seeds + places.astype(np.uint64) * GOLDEN
        taken = np.zeros(len(states), dtype=np.int64)
        while len(live):
            draw = (mix64(keys) >> np.uint64(32)).astype(np.uint32)
            e = self.first[now]
            on = np.flatnonzero(draw > self.share[e])
            while len(on):
                e[on] += 1
                on = on[draw[on] > self.share[e[on]]]
            steps.append((live, e))
            now = self.next[e]
            taken[live[np.flatnonzero(now < 0)]] = len(steps)
            on = np.flatnonzero(now >= 0)
            with np.errstate(over="ignore"):
                live, now, keys = live[on], now[on], keys[on] + np.uint64(0xD1342543DE82EF95)
        upto = np.cumsum(taken)
        edges, at = np.empty(upto[-1] if len(upto) else 0, dtype=np.int64), upto - taken
        for i, (who, e) in enumerate(steps):
            edges[at[who] + i] = e
        return edges, taken

    def ids(self, edges: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces of sequences of edges that end at ``ends``, and where the ids of each end."""
        piece = self.piece[edges]
        spelled = np.flatnonzero(piece < 0)
        if not len(spelled):
            return piece, ends
        own = [self.vocabulary.byte_ids[list(chr(-1 - p).encode("utf-8"))] for p in piece[spelled].tolist()]
        many = np.ones(len(piece), dtype=np.int64)
        many[spelled] = list(map(len, own))
        upto = np.cumsum(many)
        out = np.repeat(piece, many)
        for i, x in zip(spelled.tolist(), own, strict=True):
            out[upto[i] - many[i] : upto[i]] = x
        return out, np.concatenate([[0], upto])[ends]


MASK = 0xFFFFFFFFFFFFFFFF


def _mix(x: int) -> int:
    """``mix64`` of one word."""
    x &= MASK
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def _unit(word: int) -> float:
    return ((word >> 12) + 0.5) * 2.0**-52


class Search:
    """The A* search over one text's segmentations: the drawn ones, and the sets that wait by value."""

    def __init__(self, starts: np.ndarray, seed: int):
        self.units, self.key = starts, _mix(_mix(seed) ^ 0x2545F4914F6CDD1D)
        #: (-value, tie, the path from which the set departs, at which place, barred edges there)
        self.queue: list[tuple] = [(math.log(-math.log(_unit(self.word(0)))), 0, None, 0, ())]
        self.pushed = 1
        self.done: list[tuple[np.ndarray, float, float]] = []  # edges, log probability, value

    def word(self, i: int) -> int:
        """Random words that no walk uses."""
        return _mix(self.key + i * 0x9E3779B97F4A7C15)

    def pop(self, a: Lattices) -> tuple[np.ndarray, int, np.ndarray]:
        """Takes the set with the largest value. Returns what has to be walked: states, a seed, and their places."""
        value, _, path, self.place, self.barred = heapq.heappop(self.queue)
        self.value, turn = -value, len(self.done)
        seed = self.word(4 * turn + 1)
        if path is None:
            self.head, self.unit = None, 0
            return self.units, seed, np.arange(len(self.units))
        options = _others(a, self.barred)
        shares = [math.exp(x) for x in a.logp[options].tolist()]
        draw, k = _unit(self.word(4 * turn + 2)) * sum(shares), 0
        while k < len(shares) - 1 and draw >= shares[k]:
            draw, k = draw - shares[k], k + 1
        u = path.unit_of(self.place)
        self.head, self.unit = np.append(path.edges[: self.place], options[k]), u
        after = int(a.next[options[k]])
        if after >= 0:
            return np.append(after, self.units[u + 1 :]), seed, np.arange(u, len(self.units))
        return self.units[u + 1 :], seed, np.arange(u + 1, len(self.units))


class Path:
    """A drawn segmentation: its edges, of which those behind the head were drawn for units from ``first`` on, ``taken``
    for each; the one before them, if any, belongs to unit ``unit``."""

    __slots__ = ("edges", "first", "head", "taken", "unit")

    def __init__(self, head: np.ndarray | None, unit: int, edges: np.ndarray, first: int, taken: np.ndarray):
        self.edges = edges if head is None else np.concatenate([head, edges])
        self.head, self.unit, self.first, self.taken = 0 if head is None else len(head), unit, first, taken

    def unit_of(self, place: int) -> int:
        """The unit of an edge that isn't before the last of the head."""
        at = place - self.head
        if at < 0:
            return self.unit
        return self.first + int(np.searchsorted(np.cumsum(self.taken[: at + 1]), at, side="right"))


def _others(a: Lattices, barred: tuple[int, ...]) -> list[int]:
    """The edges of the state of ``barred`` that aren't among them."""
    low = high = barred[0]
    share = a.share
    while low and share[low - 1] != FULL:
        low -= 1
    while share[high] != FULL:
        high += 1
    return [e for e in range(low, high + 1) if e not in barred]


#: Gumbel noise of 52-bit words isn't above this.
MOST_NOISE = 36.8
#: Of a path the sets at so many places are perturbed at first; the others if it turns out that one could be next.
NEAR = 384


def _split(a: Lattices, searches: list[Search], drawn: list[Path], k: int) -> None:
    """Takes over what each search has drawn, and queues the largest of the sets into which the rest of its set splits."""
    paths = [p.edges for p in drawn]
    sizes = np.array(list(map(len, paths)))
    logs, begin = a.logp[np.concatenate(paths)], np.cumsum(sizes) - sizes
    total, own = np.zeros(len(searches)), np.flatnonzero(sizes)
    if len(own):
        total[own] = np.add.reduceat(logs, begin[own])
    for s, path, lp in zip(searches, paths, total.tolist(), strict=True):
        s.done.append((path, lp, s.value))
    want = k - len(searches[0].done) + 1  # the sets that can still be drawn from, and one for the inclusion scores
    todo, near = [i for i in own.tolist() if paths[i][searches[i].place :].size], NEAR
    while todo:
        part = [paths[i][searches[i].place : searches[i].place + near] for i in todo]
        head = [0.0 if not searches[i].place else float(logs[begin[i] : begin[i] + searches[i].place].sum()) for i in todo]
        found = _perturbed(a, [searches[i] for i in todo], part, head, want)
        again = []
        for i, edges, (best, behind) in zip(todo, part, found, strict=True):
            s = searches[i]
            if s.place + len(edges) < len(paths[i]) and (len(best) < want or best[-1][0] < behind + MOST_NOISE):
                again.append(i)  # a set further on could be larger than the last of these
                continue
            for value, e in best:
                place = s.place + e
                barred = (*s.barred, int(edges[e])) if e == 0 and s.barred else (int(edges[e]),)
                # a Gumbel that stays below the value of the set that is split
                bounded = -float(np.logaddexp(-s.value, -value))
                heapq.heappush(s.queue, (-bounded, s.pushed, drawn[i], place, barred))
                s.pushed += 1
        todo, near = again, 1 << 62


def _perturbed(a: Lattices, searches: list[Search], paths: list[np.ndarray], heads: list[float], want: int) -> list[tuple[list[tuple[float, int]], float]]:
    """For each search the ``want`` largest perturbed masses by place of its path, largest first, and the mass of all
    that agrees with the whole path."""
    sizes = np.array(list(map(len, paths)))
    edges, ends = np.concatenate(paths), np.cumsum(sizes)
    begin = ends - sizes
    logs = a.logp[edges]
    upto = np.concatenate([[0.0], np.cumsum(logs)])
    before = upto[:-1] + np.repeat(np.array(heads) - upto[begin], sizes)
    with np.errstate(divide="ignore"):
        mass = before + np.log(-np.expm1(logs))  # the path up to the place, and any other edge there
    behind = upto[ends] - upto[begin] + np.array(heads)
    for i, s in enumerate(searches):
        if s.barred:
            left = _others(a, (*s.barred, int(paths[i][0])))
            mass[begin[i]] = heads[i] + math.log(sum(map(math.exp, a.logp[left].tolist()))) if left else -np.inf
    keys = np.array([s.word(4 * len(s.done) + 3) for s in searches], dtype=np.uint64)
    inside = np.arange(len(edges)) - np.repeat(begin, sizes)
    with np.errstate(over="ignore"):
        words = mix64(np.repeat(keys, sizes) + inside.astype(np.uint64) * GOLDEN)
    values = mass - np.log(-np.log(unit(words)))
    best: list[list[tuple[float, int]]] = [[] for _ in searches]
    for _ in range(want):
        most = np.maximum.reduceat(values, begin)
        hit = np.flatnonzero((values == np.repeat(most, sizes)) & (values > -np.inf))
        which, once = np.unique(np.searchsorted(ends, hit, side="right"), return_index=True)
        hit = hit[once]
        for i, e, v in zip(which.tolist(), inside[hit].tolist(), values[hit].tolist(), strict=True):
            best[i].append((v, e))
        values[hit] = -np.inf
    return list(zip(best, behind.tolist(), strict=True))


def sample(a: Lattices, texts: list[str], seeds: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Edges, log probability, value and log inclusion score of the ``k`` drawn segmentations of each text, in order.

    A text has fewer if it can be segmented in fewer ways. The score is the probability that the segmentation's value
    exceeds the largest that wasn't drawn, 1 where nothing was left; probability over score is its weight in an
    unbiased sum.
    """
    searches = [Search(s, seed) for s, seed in zip(a.starts(texts), seeds, strict=True)]
    collects = gc.isenabled()
    gc.disable()  # there are no cycles among the many small objects below
    try:
        _search(a, searches, k)
    finally:
        if collects:
            gc.enable()
    out = []
    for s in searches:
        bound = -s.queue[0][0] if s.queue else -np.inf
        out.append([(e, lp, g, _log_inclusion(lp - bound)) for e, lp, g in s.done])
    return out


def _search(a: Lattices, searches: list[Search], k: int) -> None:
    for _ in range(k):
        live = [s for s in searches if s.queue]
        if not live:
            break
        todo = [s.pop(a) for s in live]
        sizes = np.array([len(w[0]) for w in todo])
        places = np.concatenate([w[2] for w in todo])
        edges, taken = a.walk(np.concatenate([w[0] for w in todo]), np.repeat(np.array([w[1] for w in todo], dtype=np.uint64), sizes), places)
        limits = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(taken)])[limits].tolist()
        drawn = []
        for i, (s, (_, _, own)) in enumerate(zip(live, todo, strict=True)):
            drawn.append(Path(s.head, s.unit, edges[ends[i] : ends[i + 1]], int(own[0]) if len(own) else 0, taken[limits[i] : limits[i + 1]]))
        _split(a, live, drawn, k)


def _log_inclusion(x: float) -> float:
    """The logarithm of 1 - exp(-exp(x)), also where the probability is too small for a double."""
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(min(x, 700.0)))))


_loaded: dict[tuple, Lattices] = {}


def lattices(path: str, theta: float) -> Lattices:
    """The vocabulary's lattices, kept by each Python worker; ``path`` must be readable on every machine."""
    if (path, theta) not in _loaded:
        _loaded[path, theta] = Lattices(Vocabulary(path, theta))
    return _loaded[path, theta]


def segmented(a: Lattices, texts: list[str], seeds: list[int], k: int) -> tuple[list[int], np.ndarray, np.ndarray, list[tuple]]:
    """For each drawn segmentation the number of its text; all ids, and where each one's end; and rows of number of
    the draw, log probability, log inclusion score and whether decoding gives the text back."""
    drawn = sample(a, texts, seeds, k)
    who = [i for i, x in enumerate(drawn) for _ in x]
    paths = [e for x in drawn for e, *_ in x]
    ids, ends = a.ids(np.concatenate([np.zeros(0, dtype=np.int64), *paths]), np.cumsum(list(map(len, paths))).astype(np.int64))
    raw = [t.encode("utf-8") for t in texts]
    back = iter(a.vocabulary.decode_many(ids, ends))
    rows = [(r, round(lp, 9), round(q, 9), next(back) == raw[i]) for i, x in enumerate(drawn) for r, (_, lp, _, q) in enumerate(x, 1)]
    return who, ids, ends, rows


RESULTS = "sample int, n_pieces int, pieces binary, log_prob double, log_inclusion double, exact boolean"


def sampled_segmentations(docs: DataFrame, path: str, k: int | Column, seed: int, theta: float = 1.0, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per document and drawn segmentation: ``docs``, or its columns in ``keep``, with the columns of RESULTS.

    ``sample`` counts from 1 in the order in which they were drawn, ``pieces`` are ids as little-endian words of
    ``id_bytes`` bytes, the form in which training reads them, and ``exact`` says that decoding them gave
    the text back. Draws depend on ``seed`` and the row's id and text only, so equal rows draw equally. Null texts are segmented like empty ones: once, into no pieces. A text with fewer segmentations than
    ``k`` gives fewer rows; where ``k`` is a column, it gives ``k`` rows all the same, its segmentations in turn. Input columns named like a result are replaced; an empty table gives an empty one.
    """
    names = [x.split()[0] for x in RESULTS.split(", ")]
    rest = [c for c in (docs.columns if keep is None else keep) if c not in names]
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), whole(text))
    fixed = isinstance(k, int)
    each = F.lit(k) if fixed else k
    rows = docs.select(*rest, *(c.alias(n) for c, n in zip((whole(text), key, each.cast("int")), unused(docs, "_text", "_key", "_k"), strict=True)))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lattices(path, theta)
        for batch in batches:
            # by position, since a table's own columns may have any name
            bodies, keys, ks = batch.column(len(rest)), batch.column(len(rest) + 1).to_pylist(), batch.column(len(rest) + 2).to_pylist()
            kept, at = pa.RecordBatch.from_arrays(batch.columns[: len(rest)], names=rest) if rest else None, 0
            while at < batch.num_rows:
                texts, size, end = [], 0, at
                while end < batch.num_rows and (not texts or size < CHARS_AT_ONCE):
                    texts.append(bodies[end].as_py())
                    size, end = size + len(texts[-1]), end + 1
                for many in sorted(set(ks[at:end])):
                    these = [i for i in range(end - at) if ks[at + i] == many]
                    a.forget()
                    who, ids, ends, drawn = segmented(a, [texts[i] for i in these], [keys[at + i] for i in these], many)
                    width = a.vocabulary.id_bytes
                    offsets = (np.concatenate([[0], ends]) * width).astype(np.int64)
                    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(f"<u{width}"))]).cast(pa.binary())
                    cols = list(zip(*drawn, strict=True))
                    made = [pa.array(cols[0], pa.int32()), pa.array(np.diff(ends, prepend=0), pa.int32()), packed, pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())]
                    taken = kept.take(pa.array([at + these[i] for i in who], pa.int64())).columns if rest else []
                    out = pa.RecordBatch.from_arrays([*taken, *made], names=[*rest, *names])
                    if not fixed and len(who) < many * len(these):
                        own = np.bincount(who, minlength=len(these))
                        begin = np.cumsum(own) - own
                        out = out.take(pa.array(np.concatenate([b + np.arange(many) % n for b, n in zip(begin, own, strict=True)]), pa.int64()))
                    yield out
                at = end
        a.clear()
        give_back()

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema), RESULTS])
    return rows.mapInArrow(draw, fields)


def decoded(packed: Column, path: str) -> Column:
    """The texts of packed pieces; null for null."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        v = lattices(path, 1.0).vocabulary
        for rows in batches:
            ids = [np.frombuffer(b"" if x is None else x, dtype=f"<u{v.id_bytes}") for x in rows]
            flat = np.concatenate([np.zeros(0, dtype=np.int64), *ids]).astype(np.int64)
            texts = v.decode_many(flat, np.cumsum(list(map(len, ids))).astype(np.int64))
            yield pd.Series([None if x is None else t.decode("utf-8") for x, t in zip(rows, texts, strict=True)], dtype=object)

    return decode(packed)
