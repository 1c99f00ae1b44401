"""Queries of gates, joins and composites over the driver's tables, which stand in for a project's relations.

Orders are fragments or papers, parts are files or values, customers are authors, and so on; each query's SQL says which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtrace.functions import expressions as X
from claimtrace.operators import aggregates as A
from claimtrace.operators import joins as J
from claimtrace.operators import windows as W
from claimtrace.plans import gates as G
from claimtrace.plans import manuscript as M
from claimtrace.queries import query, t
from claimtrace.schemas import VALUES


def _found(findings: DataFrame) -> DataFrame:
    return findings.select("code", "severity", "message", "path")


def _values(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Rows of VALUES from the columns that ``df`` has; the rest are null."""
    schema = spark.createDataFrame([], VALUES).schema
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "lineitem")


# ---- G1: orders declare parts as inputs, customers are the scripts --------------------------------------------------


@query("""WITH i AS (SELECT 'o' || l_orderkey AS frag, 'p' || l_partkey AS path, sha256(l_returnflag) AS was FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
          f AS (SELECT 'p' || p_partkey AS path, sha256(CASE WHEN p_size > 25 THEN 'A' ELSE 'R' END) AS now FROM part WHERE p_type <> 'ECONOMY'),
          s AS (SELECT 'o' || o_orderkey AS frag, 'c' || o_custkey AS path, sha256(o_orderstatus) AS was FROM orders),
          g AS (SELECT 'c' || c_custkey AS path, sha256(CASE WHEN c_acctbal > 0 THEN 'F' ELSE 'O' END) AS now FROM customer WHERE c_mktsegment <> 'MACHINERY')
          SELECT 'input-missing' AS code, 'fail' AS severity, i.path AS message, frag AS path FROM i WHERE path NOT IN (SELECT path FROM f)
          UNION ALL SELECT 'input-changed', 'fail', i.path, frag FROM i JOIN f ON i.path = f.path WHERE was <> now
          UNION ALL SELECT 'script-missing', 'fail', s.path, frag FROM s WHERE path NOT IN (SELECT path FROM g)
          UNION ALL SELECT 'script-newer', 'fail', s.path, frag FROM s JOIN g ON s.path = g.path WHERE was <> now""")
def g1_freshness(spark, sf_dir):
    """Declared inputs and scripts that are missing or have other digests."""
    sha = lambda c: F.sha2(c, 256)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    inputs = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(name("p", "l_partkey").alias("path"), sha(F.col("l_returnflag")).alias("sha256"))).alias("inputs"))
    orders = t(spark, sf_dir, "orders").join(inputs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    provenance = F.struct("inputs", name("c", "o_custkey").alias("generated_by"), sha(F.col("o_orderstatus")).alias("generated_by_sha256"))
    fragments = orders.select(name("o", "o_orderkey").alias("path"), F.struct(provenance.alias("provenance")).alias("doc"))
    part = t(spark, sf_dir, "part").filter("p_type <> 'ECONOMY'").select(name("p", "p_partkey").alias("path"), sha(F.when(F.col("p_size") > 25, "A").otherwise("R")).alias("sha256"))
    scripts = t(spark, sf_dir, "customer").filter("c_mktsegment <> 'MACHINERY'").select(name("c", "c_custkey").alias("path"), sha(F.when(F.col("c_acctbal") > 0, "F").otherwise("O")).alias("sha256"))
    return _found(G.freshness(fragments, part.unionByName(scripts)))


@query("""SELECT doc_id, TRUE AS lf, text NOT LIKE '%' || chr(10) || '%' AS cr_only FROM documents""")
def d19_line_ends(spark, sf_dir):
    """A recorded digest fits a script with any line ends, and no other."""
    text = F.col("text")
    one = X.digest_matches(text, F.sha2(F.replace(text, F.lit("\n"), F.lit("\r\n")), 256))
    other = X.digest_matches(text, F.sha2(F.replace(text, F.lit("\n"), F.lit("")), 256))
    return t(spark, sf_dir, "documents").select("doc_id", one.alias("lf"), other.alias("cr_only"))


# ---- G2: values are parts, bindings are order lines -----------------------------------------------------------------


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An analysis in which each order is a paper whose lines are bindings: results by part, literature by supplier."""
    line = F.struct(
        F.when(F.col("l_linestatus") == "O", "results").otherwise("lit").alias("ns"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("key"),
        F.lit("x").alias("raw"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + 1).cast("int").alias("end"), F.col("l_linenumber").cast("int").alias("line"), (F.col("l_returnflag") != "A").alias("well_formed"),
    )
    atom = F.struct(F.col("l_quantity").cast("int").cast("string").alias("atom"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + 2).cast("int").alias("end"), F.col("l_linenumber").cast("int").alias("line"), F.when(F.col("l_discount") > 0.05, "unclassified").otherwise("term").alias("kind"), F.lit("").alias("rule"), F.array(F.lit("Results")).alias("chain"))
    cite = F.struct(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("citekey"), F.col("l_linenumber").cast("int").alias("start"), F.lit(False).alias("narrative"))
    fence = "array<struct<start:int,body_start:int,body_end:int,end:int,info:string>>"
    rows = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.collect_list(line).alias("bindings"), F.collect_list(atom).alias("atoms"), F.collect_list(cite).alias("citations"))
    return rows.select("path", F.struct("bindings", "atoms", "citations", F.array().cast(fence).alias("fences")).alias("parts"))


def _namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part").select(F.lit("results").alias("ns"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("many").alias("display"), (F.col("p_type") != "ECONOMY").alias("quoted"), F.col("p_brand").alias("source"))
    supplier = t(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.lit("lit").alias("ns"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("key"), F.lit("5").alias("display"), F.lit(True).alias("quoted"), F.col("s_name").alias("source"))
    return _values(spark, part.unionByName(supplier).withColumn("ref", F.concat_ws(".", "ns", "key")).withColumn("label", F.lit(False)))


NAMESPACE_SQL = """n AS (SELECT 'results.p' || p_partkey AS ref, 'results' AS ns, CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'many' END AS display, p_type <> 'ECONOMY' AS quoted, p_brand AS source FROM part
          UNION ALL SELECT 'lit.s' || s_suppkey, 'lit', '5', TRUE, s_name FROM supplier WHERE s_acctbal > 0),
          b AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, CASE WHEN l_linestatus = 'O' THEN 'results.p' || l_partkey ELSE 'lit.s' || l_suppkey END AS ref, l_returnflag <> 'A' AS good FROM lineitem)"""


@query(f"""WITH {NAMESPACE_SQL}, a AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, l_linenumber, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS atom, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS r FROM lineitem WHERE l_discount > 0.05)
          SELECT code, severity, count(*) AS n FROM (
          SELECT 'unclassified-number' AS code, 'fail' AS severity FROM a WHERE r <= 50
          UNION ALL SELECT 'unclassified-number', 'fail' FROM a GROUP BY path HAVING count(*) > 50
          UNION ALL SELECT 'malformed-placeholder', 'fail' FROM b WHERE NOT good
          UNION ALL SELECT 'unresolved-binding', 'fail' FROM b WHERE good AND ref NOT IN (SELECT ref FROM n)
          UNION ALL SELECT 'unquoted-result', 'fail' FROM n WHERE ns = 'results' AND quoted AND ref NOT IN (SELECT ref FROM b WHERE good)
          UNION ALL SELECT 'unused-literature', 'warn' FROM n WHERE ns = 'lit' AND ref NOT IN (SELECT ref FROM b WHERE good)
          UNION ALL SELECT 'prose-as-value', 'warn' FROM n WHERE ref IN (SELECT ref FROM b WHERE good) AND NOT regexp_matches(display, '[0-9]')) x GROUP BY code, severity""")
def g2_numbers(spark, sf_dir):
    """The numbers gate: loose numbers, bindings that name nothing, values that nothing quotes, prose as values."""
    return G.numbers(_bindings(spark, sf_dir), _namespace(spark, sf_dir)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT o_orderkey AS k, o_totalprice / 4 AS point FROM orders WHERE o_orderstatus <> 'P'),
          b AS (SELECT l_orderkey AS k, l_returnflag AS level, CASE WHEN l_linenumber % 2 = 1 THEN 'low' ELSE 'high' END AS bound, l_extendedprice AS v, 'results.b' || l_orderkey || '.' || l_linenumber || '.' || l_partkey || '.' || l_suppkey AS ref, l_linestatus AS source FROM lineitem),
          p AS (SELECT e.k, level, point, min(CASE WHEN bound = 'low' THEN v END) AS low, max(CASE WHEN bound = 'high' THEN v END) AS high, count(*) FILTER (WHERE bound = 'low') AS lows, count(*) FILTER (WHERE bound = 'high') AS highs FROM b JOIN e ON b.k = e.k GROUP BY e.k, level, point),
          s AS (SELECT *, 'results.o' || k || ' ' || level AS name FROM p)
          SELECT 'bound-dangling' AS code, 'fail' AS severity, ref AS message, source AS path FROM b WHERE k NOT IN (SELECT k FROM e)
          UNION ALL SELECT 'bound-duplicated', 'fail', name, NULL FROM s WHERE lows > 1 OR highs > 1
          UNION ALL SELECT 'interval-inverted', 'fail', name, NULL FROM s WHERE lows <= 1 AND highs <= 1 AND low > high
          UNION ALL SELECT 'estimate-outside-interval', 'fail', name, NULL FROM s WHERE lows <= 1 AND highs <= 1 AND (low <= high AND (point < low OR point > high) OR low IS NULL AND point > high OR high IS NULL AND point < low)""")
def g2_intervals(spark, sf_dir):
    """Bounds by estimate and level: dangling, twice, inverted, or not around their estimate."""
    o = t(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), (F.col("o_totalprice") / 4).alias("value_double"))
    key = F.concat(F.lit("b"), F.concat_ws(".", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))))
    low = F.when(F.col("l_linenumber") % 2 == 1, "low").otherwise("high")
    b = _lines(spark, sf_dir).select(key.alias("key"), F.col("l_extendedprice").alias("value_double"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("bounds"), low.alias("bound"), F.col("l_returnflag").alias("level"), F.col("l_linestatus").alias("source"))
    values = o.unionByName(b, allowMissingColumns=True).withColumn("ns", F.lit("results")).withColumn("ref", F.concat_ws(".", "ns", "key"))
    return _found(G.intervals(_values(spark, values)))


@query("""WITH m AS (SELECT l_orderkey AS path, l_linenumber AS pos, CASE WHEN l_returnflag = 'R' THEN 'low' ELSE 'high' END AS bound, l_linestatus AS level FROM lineitem)
          SELECT path, level, a > b AS reversed FROM (SELECT path, level, min(CASE WHEN bound = 'low' THEN pos END) AS a, min(CASE WHEN bound = 'high' THEN pos END) AS b FROM m GROUP BY path, level) x WHERE a IS NOT NULL AND b IS NOT NULL""")
def f7_interval_order(spark, sf_dir):
    """Whether the upper bound is mentioned before the lower, by first mentions."""
    bound = F.when(F.col("l_returnflag") == "R", "low").otherwise("high")
    first = W.first_mention(_lines(spark, sf_dir).select(F.col("l_orderkey").alias("path"), F.col("l_linestatus").alias("level"), bound.alias("bound"), "l_linenumber"), ["path", "level", "bound"], "l_linenumber")
    sides = first.groupBy("path", "level").pivot("bound", ["low", "high"]).agg(F.min("first_at")).dropna()
    return sides.select("path", "level", (F.col("low") > F.col("high")).alias("reversed"))


@query(r"""WITH c AS (SELECT p_brand AS tab, p_partkey AS row, p_size || CASE WHEN p_retailprice > 1200 THEN ' (' || p_partkey || ')' ELSE '' END AS text, p_size AS a, p_partkey AS b, p_retailprice > 1200 AS two FROM part),
           v AS (SELECT CAST(s_suppkey AS VARCHAR) AS form FROM supplier),
           atoms AS (SELECT tab, row, text, CAST(a AS VARCHAR) AS atom, CAST(a AS VARCHAR) AS form FROM c UNION ALL SELECT tab, row, text, '(' || b || ')', CAST(b AS VARCHAR) FROM c WHERE two)
           SELECT 'unemitted-table-number' AS code, 'fail' AS severity, tab || ':' || row || ':0' AS message, NULL AS path FROM atoms WHERE form NOT IN (SELECT form FROM v)
           UNION ALL SELECT 'typed-composite-cell', 'fail', tab || ':' || row || ':0', NULL FROM c WHERE two
           UNION ALL SELECT 'code-list-does-not-match', 'fail', n_nationkey || ':' || n_regionkey || ':1', NULL FROM nation WHERE n_name <> 'NATION_' || n_nationkey || CASE WHEN n_regionkey > 2 THEN ', more' ELSE '' END
           UNION ALL SELECT 'composition-does-not-match', 'fail', s_nationkey || ':' || s_suppkey || ':2', NULL FROM supplier WHERE s_acctbal < 0""")
def g2_tables(spark, sf_dir):
    """Cells: numbers that no value displays, two numbers typed in one, lists of codes, and compositions."""
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_retailprice") > 1200, F.concat(F.lit(" ("), F.col("p_partkey").cast("string"), F.lit(")"))).otherwise(""))
    null, strings = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    plain = t(spark, sf_dir, "part").select(F.col("p_brand").alias("table_key"), F.col("p_partkey").cast("int").alias("row"), F.lit(0).alias("col"), text.alias("text"), null.alias("template"), strings.alias("parts"), F.lit(False).alias("is_codes"))
    codes = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("table_key"), F.col("n_regionkey").cast("int").alias("row"), F.lit(1).alias("col"), F.col("n_name").alias("text"), F.lit("").alias("template"), strings.alias("parts"), F.lit(True).alias("is_codes"))
    shown = F.concat(F.col("s_suppkey").cast("string"), F.lit(" ("), F.col("s_nationkey").cast("string"), F.when(F.col("s_acctbal") < 0, "%)").otherwise(")"))
    made = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("table_key"), F.col("s_suppkey").cast("int").alias("row"), F.lit(2).alias("col"), shown.alias("text"), F.lit("{} ({})").alias("template"), F.array(F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")).alias("parts"), F.lit(False).alias("is_codes"))
    lists = t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("table_key"), F.col("n_regionkey").cast("int").alias("row_idx"), F.when(F.col("n_regionkey") > 2, F.array("n_name", F.lit("more"))).otherwise(F.array("n_name")).alias("codes"))
    values = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("display"))
    return _found(G.table_cells(plain.unionByName(codes).unionByName(made), values, lists))


@query("""SELECT CASE WHEN own * 1.0 / n >= 0.25 THEN 'warn' ELSE 'info' END AS severity, own || ' of ' || n || ': ' || listed AS message FROM (SELECT count(*) AS n, count(*) FILTER (WHERE event_type IN ('signup', 'error')) AS own FROM events) a,
          (SELECT string_agg('project:' || event_type || ' (' || c || ')', '; ' ORDER BY c DESC, event_type) AS listed FROM (SELECT event_type, count(*) AS c FROM events WHERE event_type IN ('signup', 'error') GROUP BY event_type) g) b""")
def c7_project_exemptions(spark, sf_dir):
    """How many atoms only the project's own rules accept."""
    own = F.col("event_type").isin("signup", "error")
    atoms = t(spark, sf_dir, "events").select(F.lit("convention").alias("kind"), F.when(own, F.concat(F.lit("project:"), F.col("event_type"))).otherwise(F.col("event_type")).alias("rule"))
    return M.project_exemptions(atoms).select("severity", "message")


# ---- G3, figures ----------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT l_orderkey, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS atom FROM lineitem WHERE l_discount > 0.05),
          v AS (SELECT CAST(p_size AS VARCHAR) AS atom FROM part WHERE p_type = 'ECONOMY' AND p_size < 30), s AS (SELECT o_orderkey, CAST(o_custkey % 50 AS VARCHAR) AS atom FROM orders WHERE o_orderstatus = 'F')
          SELECT CAST(l_orderkey AS VARCHAR) AS path, atom AS message FROM a WHERE atom NOT IN (SELECT atom FROM v) AND NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = a.l_orderkey AND s.atom = a.atom)""")
def g3_figure_numbers(spark, sf_dir):
    """Numbers in drawings that no value displays and that no sidecar declares with a reason."""
    values = t(spark, sf_dir, "part").filter("p_type = 'ECONOMY' and p_size < 30").select(F.col("p_size").cast("string").alias("display"))
    why = F.when(F.col("o_orderstatus") == "F", "a reason").otherwise(" ")
    allowed = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"), (F.col("o_custkey") % 50).cast("string").alias("atom"), why.alias("why"))
    layers = spark.createDataFrame([], "path string, text string, error string")
    return G.figures(layers, _bindings(spark, sf_dir), values, allowed).select("path", "message")


@query("""WITH f AS (SELECT 'r' || s_nationkey AS dir, 'f' || (s_suppkey // 2) AS stem, CASE WHEN s_suppkey % 2 = 0 THEN 'svg' ELSE 'png' END AS kind, sha256(s_name) AS h FROM supplier)
          SELECT dir, stem, sha256(string_agg(stem || '.' || kind || chr(0) || h, chr(10) ORDER BY kind)) AS sha256, count(*) AS n_formats, stem || '.' || max(kind) AS shown FROM f GROUP BY dir, stem""")
def e10_figure_digests(spark, sf_dir):
    """One digest for all formats of a figure, and the format that is read first."""
    from claimtrace.sources.records import figure_digests

    kind = F.when(F.col("s_suppkey") % 2 == 0, "svg").otherwise("png")
    path = F.concat(F.lit("r"), F.col("s_nationkey").cast("string"), F.lit("/f"), F.expr("s_suppkey div 2").cast("string"), F.lit("."), kind)
    return figure_digests(t(spark, sf_dir, "supplier").select(path.alias("path"), F.col("s_name").cast("binary").alias("content")))


@query("""SELECT 'd/f' || p_partkey || '.png' AS path, CASE WHEN p_size <= 10 THEN 'no vector' WHEN p_size <= 20 THEN 'no manifest' WHEN p_size <= 30 THEN 'differs' ELSE 'proven' END AS state FROM part""")
def d35_rendered_pairs(spark, sf_dir):
    """Pictures whose drawing and manifest prove that they show the same figure."""
    from claimtrace.sources.records import unproven_rasters

    part, stem = t(spark, sf_dir, "part"), F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    png = part.select(F.concat(F.lit("d/"), stem, F.lit(".png")).alias("path"), F.sha2("p_name", 256).alias("sha256"))
    svg = part.filter("p_size > 10").select(F.concat(F.lit("d/"), stem, F.lit(".svg")).alias("path"), F.sha2("p_brand", 256).alias("sha256"))
    then = F.sha2(F.when(F.col("p_size") > 30, F.col("p_name")).otherwise("another"), 256)
    manifests = part.filter("p_size > 20").select(F.lit("d").alias("dir"), stem.alias("stem"), F.create_map(F.concat(stem, F.lit(".png")), then, F.concat(stem, F.lit(".svg")), F.sha2("p_brand", 256)).alias("outputs"))
    return unproven_rasters(png.unionByName(svg), manifests)


# ---- G4, G5 ---------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT p_brand AS name, count(*) AS value FROM part GROUP BY p_brand), l AS (SELECT p_brand AS name, sum(p_size) / 26.0 AS most FROM part GROUP BY p_brand),
          s AS (SELECT c.name, value, most FROM c JOIN l ON c.name = l.name)
          SELECT 'over-journal-limit' AS code, name FROM s WHERE value > most UNION ALL SELECT 'near-journal-limit', name FROM s WHERE value <= most AND value > 0.95 * most
          UNION ALL SELECT 'journal-profile-stale', '1996-01-01'""")
def g4_journal(spark, sf_dir):
    """Counts over or near a journal's limits, and a profile of long ago."""
    part = t(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name"))
    found = G.journal(part.agg(F.count(F.lit(1)).alias("value")), part.agg((F.sum("p_size") / 26.0).alias("most")), "1996-01-01", "1998-08-02")
    return found.select("code", F.split("message", " ")[0].alias("name"))


@query("""WITH i AS (SELECT p_partkey AS id FROM part WHERE p_size > 5), x AS (SELECT l_partkey AS id, max(l_returnflag) AS r, max(l_linestatus) AS s, min(l_linenumber) AS m FROM lineitem GROUP BY l_partkey),
          a AS (SELECT id, CASE WHEN m = 1 THEN CASE WHEN s = 'O' THEN 'methods' ELSE 'elsewhere' END ELSE '' END AS place, CASE WHEN m = 2 THEN CASE WHEN r = 'R' THEN ' N/A ' ELSE 'a real reason' END ELSE '' END AS excuse FROM x)
          SELECT code, CAST(id AS VARCHAR) AS message FROM (SELECT 'checklist-item-missing' AS code, id FROM i WHERE id NOT IN (SELECT id FROM a)
          UNION ALL SELECT 'checklist-item-unanswered', id FROM a WHERE id IN (SELECT id FROM i) AND place = '' AND excuse = ''
          UNION ALL SELECT 'checklist-non-reason', id FROM a WHERE id IN (SELECT id FROM i) AND trim(excuse) = 'N/A'
          UNION ALL SELECT 'checklist-item-unknown', id FROM a WHERE id NOT IN (SELECT id FROM i) UNION ALL SELECT 'checklist-location-unknown', id FROM a WHERE place = 'elsewhere') y""")
def g5_checklist(spark, sf_dir):
    """Items without answers, answers that say nothing, unknown items, and places that no heading has."""
    items = t(spark, sf_dir, "part").filter("p_size > 5").select(F.col("p_partkey").cast("string").alias("id"))
    x = _lines(spark, sf_dir).groupBy(F.col("l_partkey").cast("string").alias("id")).agg(F.max("l_returnflag").alias("r"), F.max("l_linestatus").alias("s"), F.min("l_linenumber").alias("m"))
    where = F.when(F.col("m") == 1, F.when(F.col("s") == "O", "methods").otherwise("elsewhere")).otherwise("")
    excuse = F.when(F.col("m") == 2, F.when(F.col("r") == "R", " N/A ").otherwise("a real reason")).otherwise("")
    heads = spark.createDataFrame([("Materials and Methods",), ("Results",)], "title string")
    return G.checklist(items, x.select("id", where.alias("where"), excuse.alias("not_applicable")), heads).select("code", "message")


@query("""SELECT 'STROBE' AS message, 'd0' AS path WHERE FALSE UNION ALL SELECT 'CONSORT', min('d' || doc_id) FROM documents UNION ALL SELECT 'PRISMA', min('d' || doc_id) FROM documents WHERE lang = 'fr'""")
def d26_guideline_claims(spark, sf_dir):
    """Guidelines that a sentence claims and that aren't declared, by name or part of it, the whole texts beside."""
    more = F.concat(F.lit("\n\nWe followed STROBE. This study was reported in accordance with CONSORT."), F.when(F.col("lang") == "fr", " Adhering to PRISMA, we take care.").otherwise(""))
    texts = t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    return M.guideline_claims(texts, spark.createDataFrame([("STROBE-cohort",)], "guideline string")).select("message", "path")


# ---- G7 to G13 ------------------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, 's' || l_suppkey AS k FROM lineitem), n AS (SELECT 's' || s_suppkey AS k, s_acctbal > 5000 AS pinned FROM supplier WHERE s_nationkey < 20)
          SELECT code, severity, message, path FROM (SELECT 'citation-unresolved' AS code, 'fail' AS severity, k AS message, path FROM c WHERE k NOT IN (SELECT k FROM n)
          UNION ALL SELECT 'reference-uncited', 'warn', k, NULL FROM n WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT 'citation-key-unpinned', 'fail', k, NULL FROM n WHERE NOT pinned AND k IN (SELECT k FROM c)) x""")
def g7_citations(spark, sf_dir):
    """Cited keys that aren't known, known ones that aren't cited, and cited ones that aren't pinned."""
    known = t(spark, sf_dir, "supplier").filter("s_nationkey < 20").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("citekey"), (F.col("s_acctbal") > 5000).alias("pinned"))
    return _found(G.citations(_bindings(spark, sf_dir), known, known))


@query(r"""WITH d AS (SELECT doc_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS folded FROM documents), e AS (SELECT doc_id + 1 AS src, 'k' || doc_id AS key, upper(substr(text, 3, 60)) AS quote, lang FROM documents)
           SELECT 'literature-source-missing' AS code, key AS message FROM e WHERE src NOT IN (SELECT doc_id FROM d)
           UNION ALL SELECT 'quote-not-in-source', key FROM e JOIN d ON e.src = d.doc_id WHERE NOT contains(d.folded, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))))
           UNION ALL SELECT 'value-not-in-quote', key FROM e JOIN d ON e.src = d.doc_id WHERE NOT regexp_matches(quote, '(^|[^0-9.,])4([^0-9]|$)')
           UNION ALL SELECT 'value-from-abstract', key FROM e WHERE lang = 'es' UNION ALL SELECT 'attestation-thin', key FROM e WHERE lang = 'de' UNION ALL SELECT 'attestation-not-human', key FROM e WHERE lang = 'fr'""")
def g7_literature(spark, sf_dir):
    """Ledger entries against whole stored sources, and who attests to them."""
    d = t(spark, sf_dir, "documents")
    entries = d.select(
        F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), (F.col("doc_id") + 1).cast("string").alias("source_file"), X.upper_each(F.substring("text", 3, 60)).alias("quote"), F.lit("4").alias("display"),
        F.when(F.col("lang") == "es", "abstract-only").otherwise("full-text").alias("depth"), F.when(F.col("lang") == "de", "A Person").when(F.col("lang") == "fr", "ChatGPT").alias("attested_by"),
        F.when(F.col("lang") == "de", "read it").otherwise("I have read the whole of the report and this is its value").alias("statement"),
    )
    return G.literature(entries, d.select(F.col("doc_id").cast("string").alias("source_file"), "text")).select("code", "message")


@query("""WITH v AS (SELECT p_size AS q, count(*) AS n, count(DISTINCT p_brand) AS d FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_size)
          SELECT CASE WHEN d > 1 THEN 'divergent-display' ELSE 'duplicate-quantity' END AS code, CASE WHEN d > 1 THEN 'fail' ELSE 'warn' END AS severity, count(*) AS n FROM v WHERE n >= 2 GROUP BY 1, 2
          UNION ALL SELECT state, 'fail', count(*) FROM (SELECT CASE WHEN o.p_partkey IS NULL THEN 'same-as-unresolved' WHEN p.p_size <> o.p_size THEN 'declared-same-but-differs' WHEN p.p_brand <> o.p_brand THEN 'declared-same-but-displayed-differently' END AS state
          FROM part p LEFT JOIN part o ON o.p_partkey = p.p_partkey + 1 WHERE p.p_retailprice > 1000) s WHERE state IS NOT NULL GROUP BY state""")
def g8_consistency(spark, sf_dir):
    """One quantity under several keys, and keys declared the same that aren't."""
    key = lambda n: F.concat(F.lit("p"), (F.col("p_partkey") + n).cast("string"))
    values = t(spark, sf_dir, "part").select(
        F.lit("results").alias("ns"), key(0).alias("key"), F.concat(F.lit("results."), key(0)).alias("ref"), F.col("p_size").cast("double").alias("value_double"), F.lit("DOUBLE").alias("value_type"),
        F.col("p_brand").alias("display"), (F.col("p_type") != "ECONOMY").alias("quoted"), F.lit(False).alias("label"), F.when(F.col("p_retailprice") > 1000, key(1)).alias("same_as"),
    )
    return G.consistency(_values(spark, values)).groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'methods-drift' AS code, CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' ELSE 'changed' END AS message, coalesce(a.doc_id, b.doc_id) AS path
          FROM (SELECT doc_id, sha256(text) AS h FROM documents) a FULL OUTER JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN sha256('x') ELSE h END AS h FROM labels JOIN (SELECT doc_id, sha256(text) AS h FROM documents) s USING (doc_id)) b ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.doc_id IS NULL OR a.h <> b.h""")
def g9_methods(spark, sf_dir):
    """Analysis files that were added, removed or changed since they were recorded."""
    then = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    now = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("path"), "toxic").join(then, "path").select("path", F.when(F.col("toxic") == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return G.methods(then, now).select("code", "message", "path")


@query("""WITH d AS (SELECT CASE WHEN p_size > 40 THEN 'added' WHEN p_size > 20 THEN 'changed' ELSE 'removed' END AS status, p_name || p_partkey AS path FROM part),
          r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY path) AS r, count(*) OVER (PARTITION BY status) AS n FROM d), g AS (SELECT status, n, string_agg(path, ', ' ORDER BY path) AS names FROM r WHERE r <= 4 GROUP BY status, n)
          SELECT string_agg(status || ': ' || names || CASE WHEN n > 4 THEN ' (+' || (n - 4) || ' more)' ELSE '' END, '; ' ORDER BY CASE status WHEN 'changed' THEN 1 WHEN 'added' THEN 2 ELSE 3 END) AS text FROM g""")
def t5_drift_text(spark, sf_dir):
    """What changed, four names of each kind."""
    status = F.when(F.col("p_size") > 40, "added").when(F.col("p_size") > 20, "changed").otherwise("removed")
    return M.drift_text(t(spark, sf_dir, "part").select(status.alias("status"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("path")))


@query("""WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS figure, sha256(o_orderstatus) AS now FROM orders), r AS (SELECT f.*, o_orderpriority, o_custkey, sha256(CASE WHEN o_totalprice > 200000 THEN 'F' ELSE 'O' END) AS was FROM f JOIN orders ON figure = CAST(o_orderkey AS VARCHAR) WHERE o_orderpriority <> '5-LOW'),
          k AS (SELECT CAST(l_orderkey AS VARCHAR) AS figure, 'c' || l_linenumber AS id, l_returnflag <> 'A' AS ok FROM lineitem), w AS (SELECT unnest(['c1', 'c2', 'c3']) AS id)
          SELECT 'figure-unreviewed' AS code, figure AS message FROM f WHERE figure NOT IN (SELECT figure FROM r) UNION ALL SELECT 'figure-review-stale', figure FROM r WHERE was <> now
          UNION ALL SELECT 'figure-review-incomplete', r.figure || ' ' || w.id FROM r, w WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.figure = r.figure AND k.id = w.id)
          UNION ALL SELECT 'figure-review-check-failed', r.figure || ' ' || k.id FROM r JOIN k ON k.figure = r.figure WHERE NOT ok""")
def g10_figure_reviews(spark, sf_dir):
    """Figures without review, with an old one, or with checks that weren't made or failed."""
    o = t(spark, sf_dir, "orders").withColumn("figure", F.col("o_orderkey").cast("string"))
    checks = _lines(spark, sf_dir).groupBy(F.col("l_orderkey").cast("string").alias("figure")).agg(F.collect_list(F.struct(F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("id"), (F.col("l_returnflag") != "A").alias("ok"))).alias("checks"))
    reviews = o.filter("o_orderpriority <> '5-LOW'").join(checks, "figure", "left").select("figure", F.sha2(F.when(F.col("o_totalprice") > 200000, "F").otherwise("O"), 256).alias("content_sha256"), "checks")
    wanted = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "id string")
    return G.figure_reviews(o.select("figure", F.sha2("o_orderstatus", 256).alias("sha256")), reviews, wanted).select("code", "message")


@query("""WITH p AS (SELECT CAST(s_nationkey AS INTEGER) AS round, 'v' || (s_suppkey % 7) AS id FROM supplier), r AS (SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS round, 'v' || (c_custkey % 5) AS reviewer FROM customer WHERE c_nationkey < 15),
          x AS (SELECT DISTINCT CAST(c_nationkey AS INTEGER) AS round, 'v' || (c_custkey % 5) AS reviewer, c_mktsegment AS path FROM customer WHERE c_nationkey < 15), f AS (SELECT DISTINCT c_mktsegment AS path, sha256(c_mktsegment) AS now FROM customer)
          SELECT 'review-missing' AS code, p.round || ' ' || p.id AS message, NULL AS path FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.round = p.round AND r.reviewer = p.id)
          UNION ALL SELECT 'duplicate-reviewer', id, NULL FROM p GROUP BY round, id HAVING count(*) > 1 UNION ALL SELECT 'review-stale', x.round || ' ' || reviewer, x.path FROM x WHERE x.path = 'FURNITURE'
          UNION ALL SELECT 'review-uncovered', CAST(q.round AS VARCHAR), f.path FROM (SELECT DISTINCT round FROM r) q, f WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.round = q.round AND x.path = f.path)
          UNION ALL SELECT 'open-major-finding', round || ' ' || reviewer, NULL FROM r WHERE reviewer = 'v3'""")
def g11_reviews(spark, sf_dir):
    """Reviewers without record or twice, records of files that changed, files that nobody read, open major findings."""
    panel = t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("round"), F.concat(F.lit("v"), (F.col("s_suppkey") % 7).cast("string")).alias("id"))
    c = t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("int").alias("round"), F.concat(F.lit("v"), (F.col("c_custkey") % 5).cast("string")).alias("reviewer"), F.col("c_mktsegment").alias("path"))
    then = F.when(F.col("path") == "FURNITURE", F.sha2(F.lit("old"), 256)).otherwise(F.sha2("path", 256))
    of = c.filter("round < 15").withColumn("h", then).groupBy("round", "reviewer").agg(F.map_from_entries(F.collect_set(F.struct("path", "h"))).alias("file_sha256"))
    major = F.when(F.col("reviewer") == "v3", F.array(F.struct(F.lit("major").alias("severity"), F.lit(None).cast("string").alias("resolution")))).otherwise(F.array().cast("array<struct<severity:string,resolution:string>>"))
    files = c.select("path").distinct().withColumn("sha256", F.sha2("path", 256))
    return G.reviews(panel, of.withColumn("findings", major), files).select("code", "message", "path")


@query("""SELECT code, message FROM (SELECT 'plan-section-missing' AS code, unnest(['population', 'exposure', 'sensitivity']) AS message UNION ALL SELECT 'plan-section-empty', 'outcome') x""")
def g12_plan(spark, sf_dir):
    """Sections of the analysis plan that are missing or say nothing; the others hold whole documents."""
    d = t(spark, sf_dir, "documents").agg(F.max("text").alias("body"))
    titles = F.explode(F.array(*map(F.lit, ("1. Research question", "Study design", "Outcome", "Statistical analysis"))))
    rows = d.select(titles.alias("title"), "body")
    return G.plan(rows.select("title", F.when(F.col("title") == "Outcome", " TBD ").otherwise(F.col("body")).alias("body"))).select("code", "message")


@query("""WITH p AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderpriority END AS said, o_orderstatus = 'P' AS rebutted FROM orders),
          c AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, 'f' || l_suppkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
          f AS (SELECT 'f' || s_suppkey AS path, s_acctbal > 3000 AS moved, s_nationkey < 22 AS there FROM supplier)
          SELECT 'point-unanswered' AS code, id AS message, NULL AS path FROM p WHERE trim(said) = '' UNION ALL SELECT 'response-claims-nothing', id, NULL FROM p WHERE trim(said) <> '' AND NOT rebutted AND id NOT IN (SELECT id FROM c)
          UNION ALL SELECT 'claimed-change-did-not-happen', c.id, c.path FROM c LEFT JOIN f ON c.path = f.path WHERE f.path IS NULL OR NOT there OR NOT moved""")
def g13_revision(spark, sf_dir):
    """Points without answer, answers that claim nothing, and claimed changes of files that are as they were."""
    changed = _lines(spark, sf_dir).filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.lit("file").alias("kind"), F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("name"))).alias("changed"))
    said = F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority"))
    points = t(spark, sf_dir, "orders").join(changed, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").cast("string").alias("id"), said.alias("response"), (F.col("o_orderstatus") == "P").alias("rebutted"), "changed")
    s = t(spark, sf_dir, "supplier").withColumn("path", F.concat(F.lit("f"), F.col("s_suppkey").cast("string")))
    now = s.filter("s_nationkey < 22").select("path", F.sha2(F.when(F.col("s_acctbal") > 3000, "new").otherwise("old"), 256).alias("sha256"))
    return G.revision(points, s.select("path", F.sha2(F.lit("old"), 256).alias("sha256")), now).select("code", "message", "path")


@query("""SELECT 'o' || o_orderkey || ': p' || p_partkey || CASE WHEN p_size > 40 THEN ' is gone' ELSE ' is unchanged' END AS message FROM orders JOIN part ON o_custkey = p_partkey
          WHERE o_orderstatus = 'F' AND p_size > 20 AND (p_size > 40 OR p_type = 'ECONOMY')""")
def d31_anchored_points(spark, sf_dir):
    """Points attached to paragraphs that are as they were, or gone."""
    changed = F.array(F.struct(F.when(F.col("o_orderstatus") == "F", "file").otherwise("results").alias("kind"), F.lit("m").alias("name")))
    points = t(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("paragraph"), changed.alias("changed"))
    part = t(spark, sf_dir, "part").withColumn("paragraph", F.concat(F.lit("p"), F.col("p_partkey").cast("string")))
    then = part.filter("p_size > 20").select("paragraph", F.sha2("p_name", 256).alias("sha256"))
    now = part.filter("p_size <= 40").select("paragraph", F.sha2(F.when(F.col("p_type") == "ECONOMY", F.col("p_name")).otherwise("other"), 256).alias("sha256"))
    return G.anchored(points, then, now).select("message")


@query("""SELECT CASE WHEN b.p_partkey IS NULL THEN 'rerun-missing-value' WHEN a.p_partkey IS NULL THEN 'rerun-extra-value' ELSE 'rerun-differs' END AS code, CASE WHEN a.p_partkey IS NULL THEN 'warn' ELSE 'fail' END AS severity, coalesce(a.p_partkey, b.p_partkey) AS message
          FROM (SELECT * FROM part WHERE p_type <> 'ECONOMY') a FULL OUTER JOIN (SELECT * FROM part WHERE p_size > 5) b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_retailprice > 1500""")
def verify_rerun(spark, sf_dir):
    """A second run's values against the published ones; NaN equals NaN."""
    part = t(spark, sf_dir, "part")
    value = lambda c: F.when(F.col("p_size") > 25, F.lit(float("nan"))).otherwise(c)
    a = part.filter("p_type <> 'ECONOMY'").select(F.col("p_partkey").alias("ref"), value(F.col("p_retailprice")).alias("value_double"), F.col("p_brand").alias("display"))
    b = part.filter("p_size > 5").select(F.col("p_partkey").alias("ref"), value(F.col("p_retailprice")).alias("value_double"), F.when(F.col("p_retailprice") > 1500, "other").otherwise(F.col("p_brand")).alias("display"))
    return G.verify(a, b).select("code", "severity", "message")


@query("""SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(CASE WHEN len(m) >= i AND list_contains(k, m[i]) THEN '{{results.p' || m[i] || '}}' ELSE m[i] END, '')), '') AS rebound
          FROM (SELECT doc_id, string_split_regex(text, '[0-9]+') AS g, regexp_extract_all(text, '[0-9]+') AS m FROM documents) d, (SELECT list(CAST(p_partkey AS VARCHAR)) AS k FROM part) p""")
def bind_numbers(spark, sf_dir):
    """Whole texts with each number that exactly one value displays bound to it, put in from left to right."""
    docs = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")

    @F.pandas_udf("array<struct<atom:string,start:int,end:int>>")
    def found(texts):
        import re

        import pandas as pd

        return pd.Series([[{"atom": m[0], "start": m.start(), "end": m.end()} for m in re.finditer("[0-9]+", x or "")] for x in texts], dtype=object)

    atoms = docs.select("path", F.inline(found("text"))).withColumn("line", F.lit(1))
    values = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("display"), F.concat(F.lit("results.p"), F.col("p_partkey").cast("string")).alias("ref"))
    return M.bound(docs, J.matched_forms(atoms, values, "atom", "display", "ref")).select(F.col("path").alias("doc_id"), "rebound")


# ---- joins and aggregates -------------------------------------------------------------------------------------------


@query("""SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND epoch_ms(s.ts) <= epoch_ms(e.ts) AND epoch_ms(e.ts) < epoch_ms(s.ts) + 7200000)""")
def d8_outside_spans(spark, sf_dir):
    """Points that no span of their group holds."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_millis(cast(ts as timestamp))").alias("at"))
    spans = e.filter("event_type = 'signup'").select("user_id", F.col("at").alias("a"), (F.col("at") + 7_200_000).alias("b"))
    return J.outside(e.filter("event_type = 'error'"), spans, "user_id", "at", "a", "b", 7_200_000).select("event_id")


@query("""SELECT p_partkey AS ref, CASE WHEN n IS NULL THEN 'unplaced' ELSE 'placed' END AS state, coalesce(n, 0) AS n FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) l ON p_partkey = l_partkey""")
def d3_unplaced(spark, sf_dir):
    """Tables by how often they are placed."""
    n = _lines(spark, sf_dir).filter("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = t(spark, sf_dir, "part").join(n, "p_partkey", "left")
    return rows.select(F.col("p_partkey").alias("ref"), F.when(F.col("n").isNull(), "unplaced").otherwise("placed").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT c_custkey, string_agg(CAST(r AS VARCHAR), ',' ORDER BY r) AS marks FROM (SELECT DISTINCT c_custkey, dense_rank() OVER (ORDER BY n_name) AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) x GROUP BY c_custkey""")
def d39_superscripts(spark, sf_dir):
    """Authors with the numbers of their affiliations, counted by name."""
    from pyspark.sql import Window

    numbered = t(spark, sf_dir, "nation").withColumn("r", F.dense_rank().over(Window.orderBy("n_name")))  # a fixed few rows
    rows = t(spark, sf_dir, "customer").join(F.broadcast(numbered), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_set("r")), ",").alias("marks"))


@query("""SELECT l_shipmode AS role, names FROM (SELECT p_type AS l_shipmode, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS names FROM part GROUP BY p_type) x""")
def e14_by_role(spark, sf_dir):
    """Roles with all their authors in order."""
    return t(spark, sf_dir, "part").groupBy(F.col("p_type").alias("role")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ", ").alias("names"))


@query("""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN s_acctbal < 0 THEN 'defect' WHEN s_nationkey < 10 THEN 'traced' WHEN s_nationkey < 20 THEN 'attested' ELSE 'traced' END AS tier FROM supplier) x GROUP BY tier""")
def e15_tiers(spark, sf_dir):
    from claimtrace.plans.roundtrip import tier_totals

    n = F.col("s_nationkey")
    return tier_totals(t(spark, sf_dir, "supplier").select(X.tier(F.when(n < 10, "results").otherwise("lit"), F.col("s_acctbal") >= 0, F.lit(False), n < 20).alias("tier")))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE l_discount <= 0.05) AS reproduced FROM lineitem")
def e16_verify_totals(spark, sf_dir):
    return _lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_discount") <= 0.05).alias("reproduced"))


@query("""SELECT o_custkey, bool_and(o_orderstatus <> 'P') AS complete, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey""")
def e11_complete(spark, sf_dir):
    """Whether nothing is outstanding, and how much is done."""
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "P").alias("complete"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("""SELECT name, sum(value) AS value FROM (SELECT event_type AS name, 1 AS value FROM events UNION ALL SELECT 'signup', CAST(count(*) AS INTEGER) FROM orders UNION ALL SELECT lang, 1 FROM documents) x GROUP BY name""")
def e3_merged_counts(spark, sf_dir):
    """Counters of several reports summed by name."""
    from claimtrace.plans.project import merged_counts

    one = t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    two = t(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("value")).select(F.lit("signup").alias("name"), "value")
    return merged_counts(one, two, t(spark, sf_dir, "documents").groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("value")))


@query("SELECT s_nationkey, s_name || '#' || s_suppkey AS id FROM supplier WHERE FALSE UNION ALL SELECT c_nationkey, 'v' || (c_custkey % 40) FROM customer GROUP BY c_nationkey, c_custkey % 40 HAVING count(*) > 1")
def e19_twice(spark, sf_dir):
    """Reviewers that a panel has twice."""
    rows = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.concat(F.lit("v"), (F.col("c_custkey") % 40).cast("string")).alias("id"))
    return rows.groupBy("s_nationkey", "id").count().filter("count > 1").drop("count")


@query("SELECT p_type AS table_key, p_brand AS col, max(length(p_name)) AS width FROM part GROUP BY p_type, p_brand")
def e18_widths(spark, sf_dir):
    return t(spark, sf_dir, "part").groupBy(F.col("p_type").alias("table_key"), F.col("p_brand").alias("col")).agg(F.max(F.length("p_name")).alias("width"))


@query("""WITH c AS (SELECT CAST(s_nationkey AS VARCHAR) AS k, s_suppkey AS row, CAST(s_suppkey AS VARCHAR) AS a, s_name AS b FROM supplier),
          w AS (SELECT k, CAST(greatest(max(length(a)), 2) AS INTEGER) AS wa, CAST(greatest(max(length(b)), 4) AS INTEGER) AS wb FROM c GROUP BY k)
          SELECT w.k AS table_key, '| ' || rpad('id', wa, ' ') || ' | ' || rpad('name', wb, ' ') || ' |' || chr(10) || '| ' || repeat('-', greatest(wa, 3)) || ' | ' || repeat('-', wb - 1) || ':' || ' |' || chr(10) || body || chr(10) || chr(10) || ': Table ' || w.k AS text
          FROM w JOIN (SELECT c.k, string_agg('| ' || rpad(a, wa, ' ') || ' | ' || rpad(b, wb, ' ') || ' |', chr(10) ORDER BY row) AS body FROM c JOIN w ON c.k = w.k GROUP BY c.k) y ON w.k = y.k""")
def b11_tables_as_text(spark, sf_dir):
    """Tables as text: columns padded to their widest cell, a rule that aligns, a caption."""
    s = t(spark, sf_dir, "supplier").withColumn("table_key", F.col("s_nationkey").cast("string"))
    keys = s.select("table_key").distinct()
    cell = lambda df, row, col, text: df.select("table_key", row.cast("int").alias("row"), F.lit(col).alias("col"), text.alias("text"))
    cells = [cell(keys, F.lit(-2), 0, F.lit("id")), cell(keys, F.lit(-2), 1, F.lit("name")), cell(keys, F.lit(-1), 0, F.concat(F.lit("Table "), F.col("table_key")))]
    cells += [cell(s, F.col("s_suppkey"), 0, F.col("s_suppkey").cast("string")), cell(s, F.col("s_suppkey"), 1, F.col("s_name"))]
    aligned = keys.select("table_key", F.lit(1).alias("col"), F.lit("right").alias("align"))
    return M.tables_as_text(J.union_all(cells), aligned)


@query("""SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE text || chr(10) || 'References of others' END AS body FROM documents""")
def b22_without_bibliography(spark, sf_dir):
    """Whole texts up to the first line that is only a heading of references."""
    from claimtrace.text.manuscript import without_bibliography

    cut = F.pandas_udf(lambda texts: texts.map(without_bibliography), "string")
    more = F.when(F.col("lang") == "en", "\n## References\nAn Entry, A. 2001.").otherwise("\nReferences of others")
    return t(spark, sf_dir, "documents").select("doc_id", cut(F.concat("text", more)).alias("body"))


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'date' WHEN l_returnflag = 'R' THEN 'duration' ELSE 'value' END AS hint FROM lineitem""")
def b26_hints(spark, sf_dir):
    """Which advice an unbound number gets, by the words around it."""
    from claimtrace.text.manuscript import hint

    q = F.col("l_quantity").cast("int").cast("string")
    around = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("from "), (F.col("l_linenumber") + 1).cast("string"), F.lit(" January 2015"))).when(F.col("l_returnflag") == "R", F.concat(F.lit("for "), q, F.lit(" months"))).otherwise(F.concat(q, F.lit(" units")))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.pandas_udf(lambda x: x.map(hint), "string")(around).alias("hint"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, NULL AS more FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_suppkey) AS r FROM lineitem WHERE l_returnflag <> 'N') x WHERE r <= 40
          UNION ALL SELECT l_partkey, NULL, NULL, NULL, count(*) - 40 FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_partkey HAVING count(*) > 40""")
def f3_audit_listing(spark, sf_dir):
    """The first unmatched numbers of each file, and how many more there are."""
    state = F.when(F.col("l_returnflag") == "N", "matched").otherwise("unmatched")
    order = F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), "l_suppkey")
    judged = _lines(spark, sf_dir).select(F.col("l_partkey").alias("path"), F.col("l_linenumber").alias("line"), order.alias("start"), F.col("l_orderkey").alias("atom"), F.col("l_suppkey").alias("context"), state.alias("state"))
    rows = M.audit_listing(judged)
    return rows.select(F.col("path").alias("l_partkey"), F.col("atom").alias("l_orderkey"), F.col("line").alias("l_linenumber"), F.col("context").alias("l_suppkey"), "more")


@query("""SELECT count(*) AS examined, count(*) FILTER (WHERE event_type = 'click') AS matched, count(*) FILTER (WHERE event_type = 'error') AS unmatched, count(*) FILTER (WHERE event_type NOT IN ('click', 'error')) AS classified FROM events""")
def e20_audit_totals(spark, sf_dir):
    state = F.when(F.col("event_type") == "click", "matched").when(F.col("event_type") == "error", "unmatched").otherwise("classified")
    return M.audit_totals(t(spark, sf_dir, "events").select(state.alias("state")))


@query("""SELECT s_suppkey AS id, arg_max(c_mktsegment, struct_pack(a := c_acctbal, b := c_custkey)) AS remit FROM supplier JOIN customer ON c_nationkey = s_nationkey WHERE c_acctbal < s_acctbal GROUP BY s_suppkey""")
def f12_remit_carried(spark, sf_dir):
    """A reviewer's remit from the latest earlier round."""
    ours = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("at"))
    rounds = t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("at"), "c_custkey", "c_mktsegment")
    found = J.latest_before(ours, rounds, "nation", "at", "c_custkey", "c_mktsegment", 50.0)
    return found.groupBy("id").agg(F.max("before")["value"].alias("remit"))


@query("SELECT user_id, max(event_id) + 1 AS next FROM events GROUP BY user_id")
def f19_next_number(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy("user_id").agg((F.max("event_id") + 1).alias("next"))


@query("""SELECT lang, list_aggregate(list_slice(list_sort(list(DISTINCT w)), 1, 8), 'string_agg', ', ') AS sample FROM (SELECT lang, lower(unnest(regexp_extract_all(text, '[A-Za-z]+ly'))) AS w FROM documents) x GROUP BY lang""")
def t4_sample_of_hits(spark, sf_dir):
    """Up to eight distinct hits of each rule; ranks within a rule, so no list of all hits is built."""
    hits = t(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ly"), F.lit(0))).alias("w")).select("lang", F.lower("w").alias("w")).distinct()
    some = W.capped(hits, ["lang"], ["w"], 8)
    return some.groupBy("lang").agg(F.array_join(F.array_sort(F.collect_list("w")), ", ").alias("sample"))


@query("SELECT row_number() OVER (ORDER BY CASE WHEN p_name = 'cold widget' THEN 0 ELSE 1 END, p_name, p_partkey) AS n, p_partkey FROM part")
def t6_main_first(spark, sf_dir):
    """The main file first, then by name."""
    from claimtrace.plans.project import main_first

    name = F.when(F.col("p_name") == "cold widget", "main.md").otherwise(F.col("p_name"))
    rows = t(spark, sf_dir, "part").withColumn("path", name)
    keyed = rows.withColumn("_first", main_first(F.col("path"))[0])
    return W.ranked(keyed, ["_first", "path", "p_partkey"], "n").select("n", "p_partkey")


@query("""SELECT (SELECT count(*) FROM events WHERE event_type IN ('error', 'purchase')) || ' findings not due yet: ' || (SELECT count(*) FROM events WHERE event_type = 'error') || ' at internal-review; ' || (SELECT count(*) FROM events WHERE event_type = 'purchase') || ' at submission' AS text""")
def t8_deferral_text(spark, sf_dir):
    """How many findings aren't due yet, by stage in order."""
    from claimtrace.plans.project import deferral_text

    due = F.when(F.col("event_type") == "error", "internal-review").when(F.col("event_type") == "purchase", "submission")
    return deferral_text(t(spark, sf_dir, "events").select(due.alias("due")).filter("due is not null").groupBy("due").agg(F.count(F.lit(1)).alias("n")))


@query(r"""SELECT doc_id, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;') AS escaped, replace(replace(replace(text, '—', '--'), '–', '-'), '…', '...') AS folded FROM documents""")
def i30_escapes(spark, sf_dir):
    """Texts as they may stand in a tooltip, and on a console."""
    return t(spark, sf_dir, "documents").select("doc_id", X.xml_escaped(F.col("text")).alias("escaped"), X.console_folded(F.col("text")).alias("folded"))


@query(r"""SELECT o_orderkey, regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]', '_', 'g') AS filed, lower(trim(o_orderpriority)) IN ('n/a', 'na', 'none', 'no', 'not applicable', '-', 'tbd', 'todo') AS non_reason FROM orders""")
def i18_filed_names(spark, sf_dir):
    p = F.col("o_orderpriority")
    return t(spark, sf_dir, "orders").select("o_orderkey", X.filed_name(p).alias("filed"), X.is_non_reason(p).alias("non_reason"))


@query(r"SELECT doc_id, regexp_replace(text, '(?i)\b(?:[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}|[0-9a-f]{16,})\b', ' ', 'g') AS bare FROM documents")
def i11_without_opaque(spark, sf_dir):
    """Texts without long hex runs and UUIDs."""
    return t(spark, sf_dir, "documents").select("doc_id", X.without_opaque(F.col("text")).alias("bare"))


@query(rf"SELECT DISTINCT b.item_id, d.doc_id FROM (SELECT item_id, lower(text) AS q FROM benchmark) b JOIN (SELECT doc_id, lower(text) AS t FROM documents) d ON contains(d.t, b.q)")
def i13_contains(spark, sf_dir):
    """Passages that whole documents contain as they are, by any case."""
    quotes = t(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("q"))
    return J.quoted_in(t(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t")), quotes, "t", "q").select("item_id", "doc_id").distinct()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(round(l_extendedprice, 0) - l_extendedprice) <= 0.5 + l_extendedprice * 1e-9 AS nearest, TRUE AS below FROM lineitem")
def i2_display_check(spark, sf_dir):
    """Displays that agree with their value to half their last digit, or by the direction of their comparison."""
    from claimtrace.functions.display import checked

    v = F.col("l_extendedprice")
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", checked(v, F.round(v, 0).cast("bigint").cast("string")).alias("nearest"), checked(v, F.concat(F.lit("<"), (F.ceil(v) + 1).cast("string"))).alias("below"))


@query("SELECT p_partkey, translate('10' || CASE WHEN p_size > 9 THEN '¹²' ELSE '⁻³' END, '⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺', '0123456789-+') AS plain FROM part")
def i3_superscripts(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", X.superscript_exponent(F.concat(F.lit("10"), F.when(F.col("p_size") > 9, "¹²").otherwise("⁻³"))).alias("plain"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_linenumber AS VARCHAR) || ' ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS numbers FROM lineitem""")
def i10_compounds(spark, sf_dir):
    """The numbers of ranges, labelled or in brackets."""
    from claimtrace.text.manuscript import numbers_of

    a, b = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string")
    sign = F.when(F.col("l_returnflag") == "A", "–").when(F.col("l_returnflag") == "R", "/").otherwise("±")
    both = F.concat(F.lit("(n="), a, sign, b, F.lit(")"))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.pandas_udf(lambda x: x.map(lambda y: " ".join(numbers_of(y))), "string")(both).alias("numbers"))


@query("SELECT unnest(['design', 'analysis', 'drafting', 'internal-review', 'submission']) AS stage, unnest([1, 2, 3, 4, 5]) AS rank")
def i27_stage_rank(spark, sf_dir):
    stages = spark.createDataFrame([(s,) for s in ("design", "analysis", "drafting", "internal-review", "submission")], "stage string")
    return stages.select("stage", A.stage_rank(F.col("stage")).cast("int").alias("rank"))


@query("""SELECT severity, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'A' THEN 'fail' WHEN l_returnflag = 'R' THEN 'warn' ELSE 'info' END AS severity FROM lineitem) x GROUP BY severity""")
def h7_bag_union(spark, sf_dir):
    """Findings of all gates together: each counts, equal ones too."""
    rows = _lines(spark, sf_dir)
    one = lambda flag, s: G.finding(rows.filter(F.col("l_returnflag") == flag), "G", "c", s, F.lit("m"))
    return G.together(one("A", "fail"), one("R", "warn"), one("N", "info")).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
