"""What several operators share: reading tables, cutting lineage, seeded hashes."""

from __future__ import annotations

import ctypes
import itertools
import tempfile

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The setting in which a caller may ask for input tables to be dealt out over so many partitions (see ``table``).
DEAL = "spark.claimtrace.deal"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path may be of any file system that Spark reads.

    A caller who knows that tables have fewer row groups than the machine has cores can set DEAL, and rows are dealt out
    first. Unset, as it is by default, tables of any size are read as they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    deal = spark.conf.get(DEAL, None)
    return df.repartition(int(deal)) if deal else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a local session, as of tests, gets a temporary one; on a cluster that is an error, since a folder
    of one machine isn't shared.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="claimtrace-"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark writes; one that isn't there is left alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: After so many calls of ``cut`` the driver's garbage is collected.
TIDY = 2
#: Partitions of a checkpoint that are below so many bytes on average, and over FEWER times as many as needed, are read together.
PART, FEWER = 1 << 20, 4
_calls = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared folder, so that a lost executor costs no recomputation.

    Spark deletes shuffle files and checkpoints that nothing refers to any more only when the driver collects its garbage,
    which by itself it may not do for half an hour; so it is asked to, and its heap stays small besides.
    """
    shared_folder(df.sparkSession)
    stored = _unestimated(df.checkpoint(eager=True))
    if next(_calls) % TIDY == 0:
        tidy(df.sparkSession)
    return stored


def _unestimated(stored: DataFrame) -> DataFrame:
    """A checkpoint without the size that was estimated for it, with rows as they are.

    Spark estimates a join at the product of both sides and hands the number on to the checkpoint, so over rounds of joins its
    digits double and more, until such numbers alone fill the driver's heap. What is joined how is decided by measured sizes.
    Partitions and order are as they are too, unless most partitions are next to nothing: each task that reads one costs
    records, logs and shuffle files of its own, which over many rounds outgrow the rows. Then several are read by one task.
    """
    spark, plan = stored.sparkSession, stored._jdf.queryExecution().logical()
    none = spark._jvm.scala.Option.empty()
    jvm = spark._jvm.org.apache.spark.sql
    rdd, dealt, order = plan.rdd(), plan.outputPartitioning(), plan.outputOrdering()
    n = rdd.getNumPartitions()
    least = 4 * spark.sparkContext.defaultParallelism
    if n > FEWER * least and n > FEWER * (enough := max(least, -(-_bytes(spark, rdd.getCheckpointFile().get()) // PART))):
        rdd = rdd.coalesce(enough, False, none, None)
        dealt, order = jvm.catalyst.plans.physical.UnknownPartitioning(enough), order.take(0)
    bare = jvm.execution.LogicalRDD(plan.output(), rdd, dealt, order, False, none, spark._jsparkSession, none, none)
    return DataFrame(jvm.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)


def _bytes(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def tidy(spark: SparkSession) -> None:
    """Collects the driver's garbage and gives memory back to the machine that its compiler and threads have freed.

    Plans are many and short-lived: the driver's heap stays below 100 MB after each collection, but what their compilation
    frees outside the heap glibc keeps, more with every plan. A JVM that can't give it back goes on without.
    """
    spark._jvm.System.gc()
    _trim(spark)


def collect_executors(spark: SparkSession) -> None:
    """Collects the executors' garbage, so that their heaps shrink to what they hold; Python workers need memory beside them.

    A heap that a sort or a join once filled stays that large until a full collection, which by itself may never come. One
    task a core asks for it; requests at the same time are one collection. Tasks need not reach every executor, and one that
    is missed goes on as it was.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def _trim(spark: SparkSession) -> str:
    """What the driver's JVM says to ``System.trim_native_heap``; empty where it has no such command."""
    jvm, java = spark._jvm, spark._jvm.java.lang

    def array(kind: object, *items: object) -> object:
        out = spark.sparkContext._gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    server, none = java.management.ManagementFactory.getPlatformMBeanServer(), array(java.String)
    name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    # by the interface's method, since the server's own class isn't open to reflection
    kinds = [java.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    call = java.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(java.Class, *kinds))
    args = array(java.Object, name, "systemTrimNativeHeap", array(java.Object, none), array(java.String, "[Ljava.lang.String;"))
    try:
        return call.invoke(server, args)
    except Py4JError:
        return ""


def give_back() -> None:
    """Called at the end of a task by a Python worker: returns freed memory to the machine, since idle workers stay."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def whole(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns beside those of ``df``: ``names``, lengthened where the table has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def first_of(doc_id: str = "doc_id", hashed: str = "_text") -> Column:
    """The smallest row of a group as a struct: by id of any type, rows without an id last; ties by the text's hash."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("missing"), F.col(doc_id).alias("id"), F.col(hashed).alias("hash")))


#: In joins on a key, keys with more than one in HOT of all rows, and with more than LEAST rows, are handled apart.
HOT, LEAST = 1000, 1000


def join_hot(rows: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with ``one``, which has one row per ``key`` and in ``n`` how many of ``rows`` have that key.

    ``total`` is the number of ``rows``, or more. Keys with over a thousandth of them number fewer than HOT, so theirs are joined
    by a broadcast of that proven size and stay where they are; all others are joined by a shuffle of small groups.
    ``one`` should be cut, since it is read first to see whether there are such keys, if ``rows`` are enough for one.
    """
    if total <= LEAST:
        return rows.join(one, key)
    is_hot = (F.col(n) * HOT > total) & (F.col(n) > LEAST)
    hot = one.filter(is_hot)
    if hot.isEmpty():
        return rows.join(one, key)
    common = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.filter(~is_hot), key)
    return common.unionByName(rest)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit words (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, first: int, n: int) -> np.ndarray:
    """Words ``first`` to ``first + n`` of the random stream that ``seed`` names."""
    with np.errstate(over="ignore"):
        counter = np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(counter + mix64(np.array([seed & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64)))


def unit(words: np.ndarray) -> np.ndarray:
    """Unsigned words as doubles strictly between 0 and 1."""
    return ((words >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
