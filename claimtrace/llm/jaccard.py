"""Near copies by the Jaccard similarity of word shingles: candidates are verified on whole sets.

Operator 5 finds the first candidates: fingerprints that differ in DISTANCE bits or fewer, by its multi-index search. Texts at
Jaccard 0.8 differ in up to 17 of 64 bits (measured), and balls of that radius hold too many probes for large tables. So
MinHash bands find what is linked beyond it: of BANDS bands of ROWS minima one or more agree with probability
1 - (1 - J ** ROWS) ** BANDS: 0.99993 at 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimtrace.llm.common import HOT, collect_executors, cut, first_of, give_back, join_hot, mix64, stream, whole
from claimtrace.llm.graph import components
from claimtrace.llm.simhash import chosen, fingerprint_from, shingle_hashes, spanning

DISTANCE = 4
BANDS, ROWS = 24, 5
FACTORS = stream(20240805, 0, BANDS * ROWS) | np.uint64(1)
#: Minima are taken over so many shingles at once.
STEP = 512
#: A shingle is rare if so many of the texts that are left have it, at most.
RARE = 16
#: Of texts by so many percent less similar to a hub than linked ones it is kept which of its shingles they lack, if these
#: are so many at most; that only spares pairs.
CLOSE, MOST = 25, 256
#: So many ids of candidates are broadcast at most; more are joined by a shuffle.
FEW = 1_000_000


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(np.concatenate(list(shingle_hashes(text, width))))


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A key of each band; bands of different numbers don't meet."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), STEP):
        least = np.minimum(least, (FACTORS[:, None] * hashes[None, i : i + STEP]).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return reduce(lambda key, k: mix64(key ^ rows[:, k]), range(ROWS), mix64(np.arange(1, BANDS + 1, dtype=np.uint64)))


def _sketch(text: Column, width: int) -> Column:
    @F.pandas_udf("many int, fp long, bands array<long>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            many, prints, bands = [], [], []
            for t in texts:
                blocks = list(shingle_hashes(t, width))
                s = np.unique(np.concatenate(blocks))
                many.append(len(s))
                prints.append(fingerprint_from(blocks) if t.encode("utf-8").split() else 0)
                bands.append(bands_of(s).view(np.int64))
            yield pd.DataFrame({"many": many, "fp": np.array(prints, dtype=np.uint64).view(np.int64), "bands": bands})
        give_back()

    return sketched(text)


def _compared(one: Column, other: Column, width: int, percent: int, near: int) -> Column:
    """``alike``: whether two texts are similar enough; ``lacks``: what the second lacks of the first's shingles, where
    they are similar by ``near`` percent at least and that is MOST at most; ``held`` of the first, ``more`` of the second."""

    @F.pandas_udf("alike boolean, lacks array<long>, held int, more int")
    def compared(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for ones, others in batches:
            alike, lacks, sizes, more = [], [], [], []
            for a, b in zip(ones, others, strict=True):
                if a != last:
                    last, held = a, shingle_set(a, width)
                s = shingle_set(b, width)
                both = len(np.intersect1d(held, s, assume_unique=True))
                either = len(held) + len(s) - both
                alike.append(100 * both >= percent * either)
                told = 100 * both >= near * either and len(held) - both <= MOST
                lacks.append(np.setdiff1d(held, s, assume_unique=True).view(np.int64) if told else None)
                sizes.append(len(held))
                more.append(len(s) - both)
            yield pd.DataFrame({"alike": alike, "lacks": pd.Series(lacks, dtype=object), "held": sizes, "more": more})
        give_back()

    return compared(one, other)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, near: int = 101) -> DataFrame:
    """``pairs`` (``a, b`` of ids) with ``alike`` and ``lacks`` of their texts (``node, text``), see ``_compared``; only
    those that are similar by ``percent`` or ``near``. Other texts aren't moved."""
    pairs = cut(pairs)
    many = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")))
    ends = many.select("node")
    wanted = F.broadcast(ends) if ends.count() <= FEW else ends
    held = cut(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    times = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    ones = cut(times.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"))
    twos = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")).join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    n = pairs.count()
    both = join_hot(join_hot(pairs, cut(twos), "b", "m", n), ones, "a", "n", n)
    judged = both.select("a", "b", _compared(F.col("text_a"), F.col("text_b"), width, percent, near).alias("c"))
    return judged.select("a", "b", "c.*").filter("alike or lacks is not null")


def _by_fingerprint(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a, b`` that operator 5 finds: of texts (``node, fp``) with equal fingerprints or ones that it links, those that are similar."""
    prints = cut(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")))
    count, total = prints.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    _, stars, far = spanning(prints.select("fp", "n"), count, DISTANCE)
    linked = cut(stars.unionByName(far))
    many = linked.count()
    for end, name in (("a", "x"), ("b", "y")):
        firsts = prints.select(F.col("fp").alias(end), F.col("first").alias(name))
        times = linked.groupBy(end).agg(F.count(F.lit(1)).alias("m")).join(firsts, end)
        linked = join_hot(linked, cut(times), end, "m", many).drop("m")
    same = join_hot(nodes.select("fp", "node"), prints.filter("n > 1"), "fp", "n", total).filter("node != first")
    pairs = linked.select(F.col("x").alias("a"), F.col("y").alias("b")).union(same.select("first", "node"))
    return _verified(pairs.distinct(), texts, width, percent).select("a", "b")


def _shingles(texts: DataFrame, width: int) -> DataFrame:
    """``node, h`` for each shingle of ``texts`` (``node, text``)."""

    @F.pandas_udf("array<long>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([shingle_set(t, width).view(np.int64) for t in rows], dtype=object)
        give_back()

    return texts.select("node", F.explode(hashes("text")).alias("h"))


def _rare(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of shingles (``node, h``) those that 2 to RARE texts have, as ``node, h, df``; and ``node, lone``: how many of a
    text's no other has. Shingles of very many texts are left out by a short list before anything meets by shingle."""
    counts = cut(each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("node").alias("node")))
    total = counts.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    common = counts.filter((F.col("df") * HOT > total) & (F.col("df") > RARE)).select("h")  # fewer than HOT
    rare = counts.filter(F.col("df").between(2, RARE)).select("h", "df")
    lone = counts.filter("df = 1").groupBy("node").agg(F.count(F.lit(1)).alias("lone"))
    return each.join(F.broadcast(common), "h", "left_anti").join(rare, "h"), lone


def with_roots(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """``node, root`` of each text: nodes are hashes of texts, and texts with links between them have one root.

    Texts are linked if the sets of their word shingles have a Jaccard similarity of ``percent`` or more. First come the
    links that operator 5 finds, and texts that they join are one part. Of bands' buckets those of one part are left out.
    In the others each text is held against the one that shares most buckets, its hub; texts that are linked to the same
    hub are one part too, as is most of a dense cloud. Texts that share a bucket with one of another part are left. Two of
    these that are linked share either a rare shingle, which RARE of them at most have, or so many frequent ones that
    both have nearly all of theirs in common with many. Pairs of the first kind meet by their rarest shingles, as few as
    must have one that both share; pairs of the second by buckets. Of two texts near the same hub, what each lacks of it
    and has besides bounds what they can share, and pairs below that bound aren't made. So the pairs that are made grow
    with the texts, and no link is lost.
    """
    every = docs.select(F.xxhash64(whole(text)).alias("node"), whole(text).alias("text"))
    nodes = cut(every.select("node", _sketch(F.col("text"), width).alias("s")).select("node", "s.*").dropDuplicates(["node"]))
    close = cut(_by_fingerprint(nodes, every, width, percent))
    collect_executors(docs.sparkSession)
    joined = cut(components(close)).withColumnRenamed("root", "part")
    keys = nodes.join(joined, "node", "left").select("node", "many", F.coalesce("part", "node").alias("part"), F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("part").alias("p"), F.max("part").alias("q"))
    sizes, keys = cut(sizes.filter("p != q").drop("p", "q")), keys.drop("part")
    shared = cut(join_hot(keys, sizes, "key", "size", BANDS * nodes.count()))
    collect_executors(docs.sparkSession)
    n = shared.count()
    central = cut(shared.groupBy("node").agg(F.sum("size").alias("score")))
    hubs = cut(shared.join(central, "node").groupBy("key").agg(F.max(F.struct("score", "node", "many")).alias("hub"), F.count(F.lit(1)).alias("n")))
    # sets of unlike sizes can't be similar; similar ones of x and y shingles share percent * (x + y) / (100 + percent)
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    share = lambda x, y: percent * (x + y) / (100 + percent)
    stars = join_hot(shared, hubs, "key", "n", n).filter((F.col("node") != F.col("hub.node")) & fits(F.col("many"), F.col("hub.many")))
    judged = cut(_verified(stars.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), every, width, percent, percent - CLOSE))
    near = cut(judged.filter("alike").select("a", "b"))
    collect_executors(docs.sparkSession)
    greatest = judged.filter("lacks is not null").join(central.withColumnRenamed("node", "a"), "a")
    greatest = greatest.groupBy(F.col("b").alias("node")).agg(F.max(F.struct("score", "a", "lacks", "held", "more")).alias("to"))
    tied = cut(components(close.unionByName(near)))
    parts = cut(shared.join(tied, "node", "left").select("key", "node", "many", F.coalesce("root", "node").alias("part")))
    mixed = cut(parts.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.min("many").alias("fewest"), F.count(F.lit(1)).alias("n")).filter("p != q").drop("p", "q"))
    apart = cut(join_hot(parts, mixed, "key", "n", n).select("key", "node", "many", "part", "fewest"))
    left = cut(apart.groupBy("node").agg(F.first("many").alias("many"), F.first("part").alias("part"), F.greatest(F.min("fewest"), F.ceil(F.first("many") * percent / 100)).alias("fewest")))
    wanted = F.broadcast(left.select("node")) if left.count() <= FEW else left.select("node")
    rare, lone = _rare(cut(_shingles(every.join(wanted, "node", "left_semi").dropDuplicates(["node"]), width)))
    rare = cut(rare)
    ours = left.join(rare.groupBy("node").agg(F.count(F.lit(1)).alias("rare")), "node", "left").join(lone, "node", "left").fillna(0, ["rare", "lone"])
    ours = ours.withColumn("frequent", F.col("many") - F.col("rare") - F.col("lone"))
    # so many rare ones at least are shared with any text that it is linked to; of so many fewer one is among those shared
    needed = F.greatest(F.ceil(share(F.col("many"), F.col("fewest")) - F.col("frequent")), F.lit(1))
    ours = cut(ours.withColumn("led", F.col("rare") - needed + 1).join(greatest, "node", "left"))
    order = Window.partitionBy("node").orderBy("df", "h")
    led = rare.withColumn("r", F.row_number().over(order)).join(ours.filter("led > 0"), "node").filter("r <= led").select("h", "node", "many", "part", "to", (F.col("rare") + F.col("frequent")).alias("most"))
    ends = [F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")]
    unlike = (F.col("x.part") != F.col("y.part")) & fits(F.col("x.many"), F.col("y.many"))
    both = F.col("x.to.held") - F.size(F.array_union("x.to.lacks", "y.to.lacks")) + F.least("x.to.more", "y.to.more")
    unlike = unlike & ~((F.col("x.to.a") == F.col("y.to.a")) & (both < share(F.col("x.many"), F.col("y.many")))).eqNullSafe(True)
    led = cut(led)
    by_rare = led.alias("x").join(led.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & unlike & (F.least("x.most", "y.most") >= share(F.col("x.many"), F.col("y.many")))).select(*ends)
    apart = apart.join(ours.filter(F.col("frequent") >= share(F.col("many"), F.col("fewest"))).select("node", "frequent", "to"), "node")
    of_part = cut(apart).groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    main = cut(of_part.groupBy("key").agg(F.max(F.struct("n", "part"))["part"].alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts"))
    crowd = cut(apart.join(main, "key").select("key", "node", "many", "frequent", "to", "part", "main"))
    collect_executors(docs.sparkSession)
    others, mains = crowd.filter("part != main").alias("x"), crowd.filter("part = main").alias("y")
    meet = (F.col("x.key") == F.col("y.key")) & unlike & (F.least("x.frequent", "y.frequent") >= share(F.col("x.many"), F.col("y.many")))
    by_bucket = others.join(mains, meet).select(*ends).unionByName(others.join(others.alias("y"), meet & (F.col("x.node") < F.col("y.node"))).select(*ends))
    far = _verified(by_rare.unionByName(by_bucket).distinct(), every, width, percent).select("a", "b")
    roots = components(tied.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(far))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """One document of each group of near copies, with the columns of ``docs``: the one with the smallest id, if any has one.

    Of several texts under that id in the group the one with the smallest hash stays, and of repeated rows one. An id
    with texts in several groups stands for each of them. Null and empty texts, and texts of white space, are one group.
    """
    ids = docs.select("doc_id", F.xxhash64(whole(text)).alias("_text")).groupBy("_text").agg(first_of().alias("f"))
    firsts = ids.join(with_roots(docs, width, percent, text), F.col("_text") == F.col("node")).groupBy("root").agg(F.min("f").alias("first"))
    return chosen(docs, firsts, text)
