"""Near duplicates by SimHash fingerprints and multi-index hashing.

Equal fingerprints are one node. A fingerprint is cut into segments; if two differ in few bits, then in one of the
segments they differ in fewer still. So the small Hamming balls around each segment's value are enumerated on one
side, looked up among the values of the other, and what is found is verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.llm.common import cut, first_of, give_back, join_hot, unused, whole
from claimtrace.llm.graph import components

BITS = 64
SEED = 42
#: Hashes are counted in blocks of so many, so long texts take no more memory.
BLOCK = 1 << 14


def shingle_hashes(text: str, width: int) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles in blocks; a text of fewer words is one shingle."""
    words = text.encode("utf-8").lower().split()  # of bytes, both heed ASCII only
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    n = max(1, len(words) - width + 1)
    ends = [s - 1 for s in starts[width:]][: n - 1] + [len(joined)]
    starts = starts or [0]
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + BLOCK], ends[i : i + BLOCK], strict=False)], dtype="<u8")


def fingerprint_of(text: str, width: int) -> int:
    """The SimHash of a text's word shingles, unsigned; 0 for a text without words."""
    if not text.encode("utf-8").split():
        return 0
    return fingerprint_from(shingle_hashes(text, width))


def fingerprint_from(blocks: Iterable[np.ndarray]) -> int:
    """The SimHash of hashes in blocks."""
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for h in blocks:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(text: Column, width: int) -> Column:
    """The fingerprint of each text as the signed long of the same bits."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, width) for t in texts], dtype=np.uint64).view(np.int64))
        give_back()

    return hashed(text)


def layout(n: int, distance: int) -> tuple[list[int], list[int]]:
    """Widths of the segments and radii of the balls for ``n`` fingerprints.

    Radii r suffice if the r + 1 sum up to ``distance`` + 1. Any number of segments finds the same pairs; the least
    sum of probes sent and expected chance meetings is taken.
    """
    best = None
    for m in range(2, distance + 2):
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        radii = [(distance + 1) // m - 1 + (i < (distance + 1) % m) for i in range(m)]
        probes = sum(comb(w, k) for w, r in zip(widths, radii, strict=True) for k in range(r + 1))
        meet = sum(comb(w, k) * n / 2**w for w, r in zip(widths, radii, strict=True) for k in range(r + 1))
        if best is None or probes + m + meet < best[0]:
            best = probes + m + meet, widths, radii
    return best[1], best[2]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(width), r)]


def _segments(widths: list[int]) -> list[tuple[int, Column]]:
    """Each segment's number and its bits of ``fp``."""
    out, low = [], 0
    for k, w in enumerate(widths):
        out.append((k, F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << w) - 1))))
        low += w
    return out


def _probes(segment: int, value: Column, ball: list[int]) -> Column:
    masks = F.lit(ball).cast("array<long>")
    return F.transform(masks, lambda mask: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(mask).alias("val")))


def links(nodes: DataFrame, n: int, distance: int) -> DataFrame:
    """Pairs ``a < b`` of the fingerprints in ``nodes`` (``fp, part``) at ``distance`` bits or fewer, of unequal ``part``.

    Of each table entry the fingerprints of its commonest part are kept apart and are held against probes of other parts
    only. So a cloud of near copies that is one part already doesn't meet itself, however large it is.
    """
    widths, radii = layout(n, distance)
    values = F.array(*(F.struct(F.lit(k).alias("seg"), v.alias("val")) for k, v in _segments(widths)))
    stored = nodes.select("fp", "part", F.inline(values))
    of_part = stored.groupBy("seg", "val", "part").agg(F.count(F.lit(1)).alias("_n"))
    main = of_part.groupBy("seg", "val").agg(F.max(F.struct("_n", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("_parts"))
    others = stored.join(main.filter("_parts > 1"), ["seg", "val"]).filter("part != main").select("fp", "part", "seg", "val")
    near = F.concat(*(_probes(k, v, _ball(widths[k], radii[k])) for k, v in _segments(widths)))
    probes = nodes.select(F.col("fp").alias("a"), F.col("part").alias("part_a"), F.inline(near))
    close = (F.col("part_a") != F.col("part")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= distance)
    to_main = probes.join(main, ["seg", "val"]).filter("part_a != main").join(stored, ["seg", "val"]).filter(close & (F.col("part") == F.col("main")))
    to_others = probes.join(others, ["seg", "val"]).filter(close)
    # either end may have sent the probe that found the other
    pairs = [x.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b")) for x in (to_main, to_others)]
    return pairs[0].unionByName(pairs[1]).distinct()


def _stars(nodes: DataFrame, count: int, distance: int, bits: int = 16) -> DataFrame:
    """Links of each fingerprint to the commonest one with the same value of a segment, where they are near.

    They are a few per fingerprint, and join most of a dense cloud of near copies, whose pairs would be many.
    """
    widths = [bits] * (BITS // bits)
    values = F.array(*(F.struct(F.lit(k).alias("seg"), v.alias("val")) for k, v in _segments(widths)))
    stored = nodes.select("fp", "n", F.inline(values))
    stored = stored.select("n", "fp", F.struct("seg", "val").alias("key"))
    hub = cut(stored.groupBy("key").agg(F.max(F.struct("n", "fp"))["fp"].alias("hub"), F.count(F.lit(1)).alias("_many")).filter("_many > 1"))
    near = F.bit_count(F.col("hub").bitwiseXOR(F.col("fp"))) <= distance
    return join_hot(stored, hub, "key", "_many", len(widths) * count).filter(near & (F.col("hub") != F.col("fp"))).select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def spanning(nodes: DataFrame, count: int, distance: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``count`` fingerprints (``fp, n``) with the components of their stars as ``part``; the stars' links; and those of ``links``.

    The links of both kinds join what all links between fingerprints of ``distance`` bits or fewer would join.
    """
    stars = _stars(nodes, count, distance)
    near = cut(components(stars))
    parts = cut(nodes.join(near, nodes["fp"] == near["node"], "left").select(*nodes.columns, F.coalesce("root", "fp").alias("part")))
    return parts, stars, cut(links(parts, count, distance))


def with_components(docs: DataFrame, width: int = 4, distance: int = 4, text: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fp, fingerprint, component``.

    ``component`` is the smallest id that is reached over links between fingerprints of ``distance`` bits or fewer; ids
    may be of any type that has an order. Null and empty texts, and texts of white space, have fingerprint 0 and are
    linked like any other. Rows without an id come after all ids, so a component of such rows only has a null
    ``component``. Rows with equal ids stay as they are. Ties can't change a component. An empty table gives an empty
    one. Other columns are left out. ``_text`` is a hash of the text, ``_part`` names the component for joins.
    """
    rows = cut(docs.select("doc_id", F.xxhash64(whole(text)).alias("_text"), fingerprints(whole(text), width).alias("fp")))
    nodes = cut(rows.groupBy("fp").agg(first_of().alias("least"), F.count(F.lit(1)).alias("n")))
    n, n_rows = nodes.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts, _, far = spanning(nodes, n, distance)
    ends = parts.select("fp", "part")
    between = (
        far.join(ends.select(F.col("fp").alias("a"), F.col("part").alias("pa")), "a")
        .join(ends.select(F.col("fp").alias("b"), F.col("part").alias("pb")), "b")
        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        .distinct()
    )
    joined = components(cut(between))
    own = parts.groupBy("part").agg(F.count(F.lit(1)).alias("_many")).join(joined, F.col("part") == F.col("node"), "left")
    own = cut(own.select("part", "_many", F.coalesce("root", "part").alias("_part")))
    parts = cut(join_hot(parts.select("fp", "n", "least", "part"), own, "part", "_many", n).select("fp", "n", "least", "_part"))
    least = cut(parts.groupBy("_part").agg(F.min("least").alias("_first"), F.count(F.lit(1)).alias("_many")))
    of = cut(join_hot(parts.select("fp", "n", "_part"), least, "_part", "_many", n).select("fp", "n", "_part", F.col("_first.id").alias("component")))
    return join_hot(rows, of, "fp", "n", n_rows).drop("n", "_many").withColumn("fingerprint", F.lower(F.lpad(F.hex("fp"), 16, "0")))


def representatives(docs: DataFrame, width: int = 4, distance: int = 4, text: str = "text") -> DataFrame:
    """One document of each component, with the columns of ``docs``: the one with the smallest id, if any has one.

    Of several texts under that id in the component the one with the smallest hash stays, and of repeated rows one. An
    id with texts in several components stands for each of them.
    """
    return chosen(docs, with_components(docs, width, distance, text).groupBy("_part").agg(first_of().alias("first")), text)


def chosen(docs: DataFrame, firsts: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id and text hash are a ``first`` (see ``first_of``), repeated ones once."""
    same_id, hashed = unused(docs, "_id", "_hash")
    stay = cut(firsts.select(F.col("first.id").alias(same_id), F.col("first.hash").alias(hashed)))
    rows = docs.withColumn(hashed, F.xxhash64(whole(text)))
    rows = rows.join(stay, (rows[hashed] == stay[hashed]) & rows["doc_id"].eqNullSafe(stay[same_id]), "left_semi")
    if rows.groupBy("doc_id", hashed).count().filter("count > 1").isEmpty():
        return rows.select(*docs.columns)
    # partial aggregates keep one row per task before anything moves, however often a row is repeated
    return rows.dropDuplicates(["doc_id", hashed]).select(*docs.columns)
