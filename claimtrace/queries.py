"""Queries over the driver's tables, by name, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimtrace.functions import expressions as X
from claimtrace.operators import aggregates as A
from claimtrace.operators import joins as J
from claimtrace.operators import windows as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ATOMS_SQL = r"SELECT doc_id, unnest(regexp_extract_all(text, '[^\s]*[0-9][^\s]*')) AS atom FROM documents"


def _atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(X.atoms_text(F.col("text"))).alias("atom"))


@query(f"""SELECT doc_id, atom, count(*) AS n FROM ({ATOMS_SQL}) a
           WHERE atom NOT IN (SELECT CAST(p_size AS VARCHAR) FROM part) GROUP BY doc_id, atom""")
def audit_unbacked(spark, sf_dir):
    """Numbers in documents that no published value backs."""
    backing = t(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("atom"))
    return J.missing(_atoms(spark, sf_dir), backing, "atom").groupBy("doc_id", "atom").agg(F.count(F.lit(1)).alias("n"))


@query(ATOMS_SQL)
def b5_atoms_text(spark, sf_dir):
    return _atoms(spark, sf_dir)


HTML_SQL = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', ' ', 'g'), '(?is)<style\b.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g')"


@query(rf"SELECT page_id, unnest(regexp_extract_all({HTML_SQL}, '[^\s]*[0-9][^\s]*')) AS atom FROM pages")
def b5_atoms_html(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.explode(X.atoms_text(X.strip_html(F.col("html")))).alias("atom"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[A-Za-z0-9]'))) AS BIGINT) AS n_words FROM documents")
def b14_word_count(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.word_count(F.col("text")).alias("n_words"))


@query(r"""SELECT doc_id, length(p) - length(replace(p, chr(10), '')) + 1 AS line FROM
           (SELECT doc_id, regexp_extract(text, '^[^0-9]*') AS p FROM documents WHERE regexp_matches(text, '[0-9]')) d""")
def f18_line_number(spark, sf_dir):
    """The line of the first digit of each document."""
    docs = t(spark, sf_dir, "documents").filter(F.col("text").rlike("[0-9]"))
    offset = F.length(F.regexp_extract("text", "^[^0-9]*", 0)) + 1
    return docs.select("doc_id", X.line_number(F.col("text"), offset).cast("long").alias("line"))


@query(r"""SELECT CAST(p_partkey AS BIGINT) AS p_partkey, regexp_matches(replace(replace(lower(p_brand), 'brand#1', ' '), 'brand#2', ' '), '[0-9]') = FALSE
           AND replace(replace(lower(p_brand), 'brand#1', ' '), 'brand#2', ' ') <> lower(p_brand) AS covered FROM part""")
def c3_term_cover(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", X.term_cover(F.col("p_brand"), ["brand#1", "brand#2"]).alias("covered"))


@query(rf"""SELECT doc_id, atom, CASE WHEN regexp_matches(atom, '^[0-9]+$') THEN 'integer' WHEN regexp_matches(atom, '^[0-9.]+$') THEN 'dotted'
           WHEN regexp_matches(atom, '^[0-9a-f-]+$') THEN 'hex' ELSE 'unclassified' END AS verdict FROM ({ATOMS_SQL}) a""")
def c4_priority_verdict(spark, sf_dir):
    """Of the rules that match, the first in order decides."""
    rules = [("integer", "^[0-9]+$"), ("dotted", "^[0-9.]+$"), ("hex", "^[0-9a-f-]+$")]
    found = F.array_compact(F.array(*(F.when(F.col("atom").rlike(p), F.lit(name)) for name, p in rules)))
    return _atoms(spark, sf_dir).withColumn("verdict", F.coalesce(F.get(found, F.lit(0)), F.lit("unclassified")))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def d1_unresolved_ref(spark, sf_dir):
    published = t(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return J.missing(t(spark, sf_dir, "lineitem").select("l_partkey").distinct(), published, "l_partkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT')")
def d2_unquoted(spark, sf_dir):
    quoted = t(spark, sf_dir, "orders").filter("o_orderstatus = 'P' or o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return J.missing(t(spark, sf_dir, "customer").select("c_custkey"), quoted, "c_custkey")


@query("""SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id
          AND epoch(s.ts) <= epoch(e.ts) AND epoch(s.ts) + 86400 >= epoch(e.ts) + 60)""")
def d5_range_semi(spark, sf_dir):
    """Events whose minute lies whole in the day after a signup of the same user."""
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_micros(cast(ts as timestamp)) / 1e6").alias("a"))
    spans = e.filter("event_type = 'signup'").select("user_id", "a", (F.col("a") + 86400).alias("b"))
    return J.covered(e.withColumn("b", F.col("a") + 60), spans, "user_id", "a", "b", 86400).select("event_id")


@query("""SELECT event_id, (SELECT max(s.event_id) FROM events s WHERE s.event_type = 'signup' AND s.user_id = e.user_id AND s.ts =
          (SELECT max(m.ts) FROM events m WHERE m.event_type = 'signup' AND m.user_id = e.user_id AND m.ts <= e.ts)) AS heading FROM events e""")
def d6_asof_heading(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    heads = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("heading"))
    return J.as_of(e.select("event_id", "user_id", "ts"), heads, "user_id", "ts", "heading").select("event_id", "heading")


@query("""SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase'
          AND p.user_id = e.user_id AND abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 3600000000)""")
def d7_band_anti(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("unix_micros(cast(ts as timestamp))").alias("at"))
    return J.none_near(e.filter("event_type = 'error'"), e.filter("event_type = 'purchase'"), "user_id", "at", 3_600_000_000).select("event_id")


#: Quotes and dashes folded, white space collapsed, lower case.
FOLD_SQL = r"lower(trim(regexp_replace(translate(text, '‘’“”–—−', chr(39) || chr(39) || chr(34) || chr(34) || '---'), '\s+', ' ', 'g')))"


@query(f"SELECT DISTINCT b.item_id, d.doc_id FROM (SELECT item_id, {FOLD_SQL} AS q FROM benchmark) b JOIN (SELECT doc_id, {FOLD_SQL} AS t FROM documents) d ON contains(d.t, b.q)")
def d11_quote_in_source(spark, sf_dir):
    """Whole passages, both sides folded, in whole documents."""
    fold = lambda c: F.lower(X.normalise_text(F.col(c)))
    quotes = t(spark, sf_dir, "benchmark").select("item_id", fold("text").alias("q"))
    docs = t(spark, sf_dir, "documents").select("doc_id", fold("text").alias("t"))
    return J.quoted_in(docs, quotes, "t", "q").select("item_id", "doc_id").distinct()


@query("SELECT l_orderkey FROM lineitem LEFT JOIN (SELECT DISTINCT p_partkey FROM part WHERE p_size <= 40) p ON l_partkey = p_partkey GROUP BY l_orderkey HAVING bool_and(p_partkey IS NOT NULL)")
def d14_all_of_semi(spark, sf_dir):
    parts = t(spark, sf_dir, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return J.all_of(t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), parts, "l_orderkey", "l_partkey")


@query("""WITH a AS (SELECT doc_id, sha256(text) AS h FROM documents), b AS (SELECT doc_id + CASE WHEN doc_id % 10 = 0 THEN 1000000 ELSE 0 END AS doc_id,
          sha256(CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE text END) AS h FROM documents)
          SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status
          FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def d20_snapshot_diff(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    then = d.select("doc_id", F.sha2("text", 256).alias("h"))
    text = F.when(F.col("doc_id") % 7 == 0, F.upper("lang")).otherwise(F.col("text"))
    now = d.select((F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1000000).otherwise(0)).alias("doc_id"), F.sha2(text, 256).alias("h"))
    return J.snapshot_diff(then, now, "doc_id", "h")


@query("""SELECT p.p_partkey AS ref, p.p_partkey + 1 AS other, CASE WHEN o.p_partkey IS NULL THEN 'unresolved' WHEN p.p_size <> o.p_size THEN 'differs'
          WHEN p.p_brand <> o.p_brand THEN 'displayed differently' ELSE 'same' END AS state
          FROM part p LEFT JOIN part o ON o.p_partkey = p.p_partkey + 1""")
def d22_same_as(spark, sf_dir):
    values = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.col("p_size").alias("value"), F.col("p_brand").alias("display"), (F.col("p_partkey") + 1).alias("same_as"))
    return J.declared_pairs(values, "same_as")


@query("""SELECT l_partkey, CASE WHEN low > high THEN 'inverted' WHEN point < low OR point > high THEN 'outside' ELSE 'ok' END AS state
          FROM (SELECT l_partkey, min(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS point, min(CASE WHEN l_linenumber = 2 THEN l_quantity END) AS low,
          max(CASE WHEN l_linenumber = 3 THEN l_quantity END) AS high FROM lineitem GROUP BY l_partkey) b WHERE point IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL""")
def d23_bound_pivot(spark, sf_dir):
    """Bounds beside their estimate, and whether they enclose it."""
    q = F.col("l_quantity")
    of = lambda n: F.when(F.col("l_linenumber") == n, q)
    rows = t(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min(of(1)).alias("point"), F.min(of(2)).alias("low"), F.max(of(3)).alias("high")).dropna()
    state = F.when(F.col("low") > F.col("high"), "inverted").when((F.col("point") < F.col("low")) | (F.col("point") > F.col("high")), "outside").otherwise("ok")
    return rows.select("l_partkey", state.alias("state"))


@query("""SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(p_type) AS b FROM part WHERE p_size < 10) x
          WHERE contains(lower(p.p_name), b) OR contains(b, lower(p.p_name)))""")
def d25_bidirectional_contains(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    return J.either_contains(part, part.filter("p_size < 10"), "p_name", "p_type").select("p_partkey")


@query("""SELECT a.atom, CAST(list_sort(list_distinct(list(CAST(p_partkey AS VARCHAR)))) AS VARCHAR) AS candidates FROM
           (SELECT CAST(s_suppkey AS VARCHAR) || ',' AS atom, CAST(s_suppkey AS VARCHAR) AS form FROM supplier) a
           JOIN part ON CAST(p_size AS VARCHAR) = a.form GROUP BY a.atom""")
def d32_candidates(spark, sf_dir):
    """Atoms as written or without separators, with all values that are displayed so."""
    values = t(spark, sf_dir, "part").select(F.col("p_size").cast("string").alias("display"), F.col("p_partkey").cast("string").alias("ref"))
    atoms = t(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit(",")).alias("atom"))
    found = J.matched_forms(atoms, values, "atom", "display", "ref")
    return found.select("atom", F.concat(F.lit("["), F.array_join("candidates", ", "), F.lit("]")).alias("candidates"))


@query("""SELECT quantity, n_refs, n_displays, CASE WHEN n_displays > 1 THEN 'fail' ELSE 'warn' END AS severity FROM
          (SELECT round(p_retailprice, 2) AS quantity, count(DISTINCT p_partkey) AS n_refs, count(DISTINCT p_brand) AS n_displays FROM part GROUP BY 1) g WHERE n_refs >= 2""")
def e4_duplicate_quantity(spark, sf_dir):
    values = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("display"), "p_retailprice")
    return A.duplicate_quantity(values, F.round("p_retailprice", 2))


@query(r"""SELECT lang, hits, words, hits * 1000.0 / words > 6 AND words >= 200 AS fires FROM (SELECT lang,
           CAST(sum(len(list_filter(string_split_regex(lower(text), '\s+'), lambda w: w IN ('the', 'der', 'de', 'la')))) AS BIGINT) AS hits,
           CAST(sum(len(regexp_extract_all(text, '[^\s]+'))) AS BIGINT) AS words FROM documents GROUP BY lang) s""")
def e5_density(spark, sf_dir):
    hits = F.size(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w.isin("the", "der", "de", "la")))
    words = F.regexp_count("text", F.lit(r"[^\s]+"))
    return A.density(t(spark, sf_dir, "documents"), ["lang"], hits, words, 6.0).select("lang", "hits", "words", "fires")


STAGES_SQL = "CASE event_type WHEN 'signup' THEN 'analysis' WHEN 'purchase' THEN 'submission' WHEN 'error' THEN 'internal-review' END"


@query(f"""SELECT event_type AS code, severity, due, count(*) AS n FROM (SELECT event_type, CASE WHEN {STAGES_SQL} IN ('internal-review', 'submission') THEN 'info' ELSE 'fail' END AS severity,
           CASE WHEN {STAGES_SQL} IN ('internal-review', 'submission') THEN {STAGES_SQL} END AS due FROM events) e GROUP BY event_type, severity, due""")
def e7_stage_deferral(spark, sf_dir):
    binds = spark.createDataFrame([("signup", "analysis"), ("purchase", "submission"), ("error", "internal-review")], "code string, due string")
    findings = t(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.lit("fail").alias("severity"))
    return A.deferred(findings, binds, "drafting").groupBy("code", "severity", "due").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH u AS (SELECT '1-100' AS universe, CAST(i AS VARCHAR) AS atom FROM range(1, 101) r(i) UNION ALL SELECT '1-1000', CAST(i AS VARCHAR) FROM range(1, 1001) r(i)),
           k AS (SELECT DISTINCT unnest(regexp_extract_all(html, '[0-9]+')) AS atom FROM pages)
           SELECT universe, n, hits, CASE WHEN hits * 1.0 / n > 0.5 THEN 'worthless' WHEN hits * 1.0 / n > 0.2 THEN 'weak' ELSE 'informative' END AS verdict FROM
           (SELECT universe, count(*) AS n, count(k.atom) AS hits FROM u LEFT JOIN k ON u.atom = k.atom GROUP BY universe) s""")
def e8_discrimination(spark, sf_dir):
    tens = spark.range(1, 101).select(F.lit("1-100").alias("universe"), F.col("id").cast("string").alias("atom"))
    both = tens.union(spark.range(1, 1001).select(F.lit("1-1000"), F.col("id").cast("string")))
    backing = t(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("[0-9]+"), F.lit(0))).alias("atom"))
    return A.discrimination(both, backing, "atom")


@query("""SELECT a, b, c, d, round(ror, 6) AS ror, round(exp(ln(ror) - 1.96 * se), 6) AS low, round(exp(ln(ror) + 1.96 * se), 6) AS high FROM
          (SELECT *, (CAST(a AS DOUBLE) / b) / (CAST(c AS DOUBLE) / d) AS ror, sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) AS se FROM
          (SELECT count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'F') AS b,
          count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'F') AS d FROM lineitem) x) y""")
def e12_ror(spark, sf_dir):
    out = A.odds_ratio(t(spark, sf_dir, "lineitem"), F.col("l_returnflag") == "R", F.col("l_linestatus") == "F")
    return out.select("a", "b", "c", "d", *(F.round(x, 6).alias(x) for x in ("ror", "low", "high")))


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 6) AS pct FROM events GROUP BY event_type")
def e13_n_pct(spark, sf_dir):
    return A.n_pct(t(spark, sf_dir, "events").withColumn("_all", F.lit(1)), ["_all"], "event_type").select("event_type", "n", F.round("pct", 6).alias("pct"))


@query("SELECT verdict, count(*) AS n, CAST(sum(CASE WHEN v > 500 THEN 1 ELSE 0 END) AS BIGINT) AS above FROM (SELECT event_type AS verdict, value AS v FROM events) e GROUP BY verdict")
def e1_counters(spark, sf_dir):
    return t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 500).alias("above"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) AS rank FROM lineitem) x WHERE rank <= 5""")
def f1_cap(spark, sf_dir):
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]
    return W.capped(t(spark, sf_dir, "lineitem"), ["l_partkey"], order, 5).select("l_partkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("SELECT l_partkey, count(*) - 5 AS unlisted FROM lineitem GROUP BY l_partkey HAVING count(*) > 5")
def f1_overflow(spark, sf_dir):
    return W.overflow(t(spark, sf_dir, "lineitem"), ["l_partkey"], 5)


@query("SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS reach FROM events")
def f4_running_max(spark, sf_dir):
    return W.running_max(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", "reach").select("event_id", "reach")


@query("SELECT user_id, event_type, min(ts) AS first_at FROM events GROUP BY user_id, event_type")
def f5_first_mention(spark, sf_dir):
    return W.first_mention(t(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


@query("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_turn FROM conversations")
def f8_section_body(spark, sf_dir):
    return W.until_next(t(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], "turn", "next_turn").select("conv_id", "turn", "next_turn")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS topic FROM events""")
def f9_carry_forward(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return W.carry_forward(e, ["user_id"], ["ts", "event_id"], "v", "topic").select("event_id", "topic")


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rn FROM part) x WHERE rn = 1")
def f10_keep_first(spark, sf_dir):
    return J.first_of(t(spark, sf_dir, "part"), ["p_brand"], ["p_retailprice", "p_partkey"]).select("p_brand", "p_partkey")


@query("SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS rn FROM supplier) x WHERE rn = 1")
def f13_min_by(spark, sf_dir):
    return t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("s_suppkey"))


@query("""SELECT event_id FROM (SELECT *, lag(event_type) OVER w AS p, lead(event_type) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) x WHERE p = n AND event_type <> p""")
def f15_crossed(spark, sf_dir):
    return W.neighbours_differ(t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id")


@query("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def h1_union(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").union(t(spark, sf_dir, "labels").select("doc_id")).distinct()


@query("SELECT doc_id FROM documents WHERE lang <> 'en' INTERSECT SELECT doc_id FROM labels")
def h2_intersect(spark, sf_dir):
    return t(spark, sf_dir, "documents").filter("lang <> 'en'").select("doc_id").intersect(t(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def h3_except(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").subtract(t(spark, sf_dir, "labels").select("doc_id"))


@query(r"SELECT doc_id, trim(regexp_replace(translate(text, '‘’“”–—−', '''''\"\"---'), '\s+', ' ', 'g')) AS folded FROM documents".replace('\\"', '"'))
def i12_normalise_text(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.normalise_text(F.col("text")).alias("folded"))


@query("""SELECT doc_id, atom, CASE WHEN length(atom) > 24 THEN atom WHEN CAST(atom AS DOUBLE) < 1e15 THEN CAST(TRY_CAST(atom AS BIGINT) AS VARCHAR)
          ELSE rtrim(rtrim(CAST(CAST(atom AS DOUBLE) AS VARCHAR), '0'), '.') END AS number FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS atom FROM documents) a""")
def i9_normalise_number(spark, sf_dir):
    """All runs of digits, long ones too."""
    rows = t(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("atom"))
    return rows.withColumn("number", X.normalise_number(F.col("atom")))


@query(r"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.1f', l_extendedprice) AS display FROM lineitem")
def i1_derive_display(spark, sf_dir):
    from claimtrace.functions.display import rounded

    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rounded(F.col("l_extendedprice"), F.lit(1)).alias("display"))


@query(r"SELECT doc_id, regexp_matches(text, '(^|[^0-9.,])4([^0-9]|$)') AS states FROM documents")
def i14_states_value(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.states_value(F.col("text"), F.lit("4")).alias("states"))


@query("SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS digest FROM documents")
def i17_digest(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.source_digest(F.col("text")).alias("digest"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'over' WHEN o_totalprice > 0.95 * 300000 THEN 'near' ELSE 'within' END AS state FROM orders")
def i20_limit(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", X.limit_state(F.col("o_totalprice"), F.lit(300000)).alias("state"))


@query("SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-02') > 365 AS stale FROM orders")
def i21_stale(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", X.is_stale(F.col("o_orderdate"), F.lit("1998-08-02").cast("date")).alias("stale"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def i31_props(spark, sf_dir):
    return t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, conv_id, turn) AS position_rank FROM conversations")
def t1_findings_order(spark, sf_dir):
    """All by severity, then place."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn", rank.alias("r"))
    return W.ranked(rows, ["r", "conv_id", "turn"], "position_rank").select("conv_id", "turn", "position_rank")


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's whole text as a section of a paper, with markup before and behind it, so that every place that
    the analyser reports depends on the text."""
    d = t(spark, sf_dir, "documents")
    text = F.concat(
        F.lit("# "), "lang", F.lit("\n"), F.coalesce("text", F.lit("")),
        F.format_string("\n\nWe bound {{results.n_chars}} and {{ bad }} [@doc%d].\n\n## Methods\n\nSee Table %d.\n```python\nx = %d\n```\nplt.plot(1.5) <!-- 77 -->\n", "doc_id", (F.col("doc_id") % 9 + 1), "doc_id"),
    )
    return d.select("doc_id", "lang", text.alias("text"))


#: Of each paper the length and the line ends of what stands before its bindings.
BEFORE_SQL = """b AS (SELECT doc_id, lang, CAST(length(lang) + 3 + length(coalesce(text, '')) + 2 AS INTEGER) AS n,
           CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 4 AS INTEGER) AS line FROM documents)"""


def _analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from claimtrace.text.frames import analysed_documents

    return analysed_documents(_papers(spark, sf_dir))


def _rows(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    from claimtrace.text.frames import rows

    return rows(_analysis(spark, sf_dir), part, "doc_id")


@query(f"""WITH {BEFORE_SQL} SELECT doc_id, 'python' AS info, CAST(n + 49 + length(CAST(doc_id AS VARCHAR)) + 3 + 12 + 13 AS INTEGER) AS start, CAST(length('x = ' || doc_id) + 1 AS INTEGER) AS n_body FROM b""")
def b4_fences(spark, sf_dir):
    return _rows(spark, sf_dir, "fences").select("doc_id", "info", "start", (F.col("body_end") - F.col("body_start")).alias("n_body"))


@query(f"""WITH {BEFORE_SQL} SELECT doc_id, 'results' AS ns, 'n_chars' AS key, TRUE AS well_formed, line, n + 9 AS start FROM b
          UNION ALL SELECT doc_id, '', '', FALSE, line, n + 33 FROM b""")
def b7_bindings(spark, sf_dir):
    return _rows(spark, sf_dir, "bindings").select("doc_id", "ns", "key", "well_formed", "line", "start")


@query(f"""WITH {BEFORE_SQL} SELECT doc_id, 1 AS level, lang AS title, lang AS chain, 0 AS start FROM b
           UNION ALL SELECT doc_id, 2, 'Methods', lang || ' > Methods', CAST(n + 49 + length(CAST(doc_id AS VARCHAR)) + 3 AS INTEGER) FROM b""")
def b12_headings(spark, sf_dir):
    return _rows(spark, sf_dir, "headings").select("doc_id", "level", "title", F.array_join("chain", " > ").alias("chain"), "start")


@query(f"WITH {BEFORE_SQL} SELECT doc_id, 'doc' || doc_id AS citekey, FALSE AS narrative, n + 44 AS start FROM b")
def b16_citations(spark, sf_dir):
    return _rows(spark, sf_dir, "citations").select("doc_id", "citekey", "narrative", "start")


LEAD_SQL, TRAIL_SQL = r"""\(\[\{<"'“‘*_|~≈=,;:.!?/\\–—-""", r"""\)\]\}>"'”’*_|,;:.!?/\\–—-"""


@query(rf"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(coalesce(text, ''), '(?i)\bhttps?://[^\s)>\]]+', ' ', 'g'), '[^\s]*[0-9][^\s]*')) AS word FROM documents),
            x AS (SELECT doc_id, regexp_replace(regexp_extract(word, '^[{LEAD_SQL.replace("'", "''")}]*?([-–.−]?[0-9].*|[^{LEAD_SQL.replace("'", "''")}].*)$', 1), '[{TRAIL_SQL.replace("'", "''")}]+$', '') AS atom FROM w)
            SELECT doc_id, atom, count(*) AS n FROM x WHERE regexp_matches(atom, '[0-9]') GROUP BY doc_id, atom""")
def b5_atoms(spark, sf_dir):
    """Atoms of the documents' own texts: masked, cut at white space, trimmed of marks."""
    return _whole_rows(spark, sf_dir, "atoms").groupBy("doc_id", "atom").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, 'x' AS names, CAST(doc_id AS VARCHAR) AS number, FALSE AS in_string FROM documents")
def b17_code_numbers(spark, sf_dir):
    """Numbers in fenced code behind whole texts, with the names that they are given to."""
    from claimtrace.text.analyze import code_numbers

    @F.pandas_udf("array<struct<number:string,line:int,in_string:boolean,names:string>>")
    def lexed(sources):
        import pandas as pd

        keys = ("number", "line", "in_string", "names")
        return pd.Series([[dict(zip(keys, x, strict=True)) for x in code_numbers(s, "python")] for s in sources], dtype=object)

    blocks = _analysis(spark, sf_dir).select("doc_id", "text", F.inline("parts.fences")).filter("info = 'python'")
    source = F.substring(F.col("text"), F.col("body_start") + 1, F.col("body_end") - F.col("body_start"))
    return blocks.select("doc_id", F.inline(lexed(source))).select("doc_id", "names", "number", "in_string")


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'defect' WHEN s_nationkey < 10 THEN 'traced' WHEN s_nationkey < 20 THEN 'attested' ELSE 'traced' END AS tier FROM supplier""")
def i28_tier(spark, sf_dir):
    n = F.col("s_nationkey")
    tier = X.tier(F.when(n < 10, "results").otherwise("lit"), F.col("s_acctbal") >= 0, F.lit(False), n < 20)
    return t(spark, sf_dir, "supplier").select("s_suppkey", tier.alias("tier"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity || ' (' || l_returnflag || ')' AS cell FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS l_quantity, l_returnflag FROM lineitem) x")
def i8_rebuilt(spark, sf_dir):
    """Cells rebuilt from their template and parts."""
    parts = F.array(F.col("l_quantity").cast("bigint").cast("string"), "l_returnflag")
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", X.rebuilt(F.lit("{} ({})"), parts).alias("cell"))


@query()
def d33_suggestions(spark, sf_dir):
    """Brands that aren't published, with the published ones most like them; similarity of strings has no SQL form."""
    from claimtrace.operators.suggest import suggestions

    part = t(spark, sf_dir, "part").select(F.col("p_brand").alias("ref"))
    known = part.filter("ref < 'Brand#3'")
    return suggestions(J.missing(part, known, "ref"), known, "ref")


@query("SELECT s_nationkey, sha256(string_agg(s_name || ':' || CAST(s_suppkey AS VARCHAR), '|' ORDER BY s_name, s_suppkey)) AS digest FROM supplier GROUP BY s_nationkey")
def e9_ordered_digest(spark, sf_dir):
    """The hash of a group's files in an order that is made explicit."""
    ordered = F.array_sort(F.collect_list(F.struct("s_name", "s_suppkey")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["s_name"], x["s_suppkey"])), "|")
    return t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sha2(text, 256).alias("digest"))


@query("SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[+-]?[0-9][0-9, ]*(\\.[0-9]+)?%?$') THEN TRUE ELSE FALSE END AS numeric_text, lower(regexp_replace(o_orderpriority, '[^0-9A-Za-z]', '', 'g')) AS slug FROM orders")
def i5_slugs(spark, sf_dir):
    p = F.col("o_orderpriority")
    return t(spark, sf_dir, "orders").select("o_orderkey", X.is_numeric_text(p).alias("numeric_text"), X.level_slug(p).alias("slug"))


@query("SELECT 'any' AS scope, sum(CASE WHEN len(string_split_regex(trim(text), '\\s+')) < 8 THEN 1 ELSE 0 END) AS thin FROM conversations")
def i16_thin_statements(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").agg(F.count_if(X.is_thin(F.col("text"))).alias("thin"))
    return rows.select(F.lit("any").alias("scope"), "thin")


@query(r"""WITH d AS (SELECT doc_id, 'd' || doc_id || '.md' AS path, 'First ' || doc_id || '.' || chr(10) || chr(10) || '# ' || lang || chr(10) || chr(10) || '{{table.t1}}' || chr(10) || chr(10) || coalesce(text, '') AS body FROM documents),
           u AS (SELECT doc_id, path, unnest(string_split_regex(body, '\n\s*\n')) AS block, generate_subscripts(string_split_regex(body, '\n\s*\n'), 1) AS i FROM d)
           SELECT doc_id, 'ct-p-d' || doc_id || substr(sha256(path), 1, 6) || '-' || CAST((i - 1) * 2 AS VARCHAR) AS id, regexp_replace(regexp_replace(block, '^\s+', ''), '\s+$', '') AS source FROM u
           WHERE regexp_matches(block, '\S') AND NOT regexp_matches(block, '^\s*#') AND NOT regexp_matches(block, '^\s*\{\{[^}]*\}\}\s*$')""")
def b19_paragraphs(spark, sf_dir):
    """Identifiers of the paragraphs of whole texts; headings and lone placeholders count without having one."""
    from claimtrace.plans.roundtrip import paragraph_rows

    d = t(spark, sf_dir, "documents")
    text = F.concat(F.format_string("First %d.\n\n# %s\n\n{{table.t1}}\n\n", "doc_id", "lang"), F.coalesce("text", F.lit("")))
    papers = d.select(F.format_string("d%d.md", "doc_id").alias("path"), text.alias("text"))
    return paragraph_rows(papers).select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("doc_id"), "id", "source")


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[*_`]', '', 'g'), '\s+', ' ', 'g')) AS body FROM documents)
          SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'merged' WHEN 2 THEN 'refused' ELSE 'absent' END AS state,
          CASE doc_id % 4 WHEN 1 THEN 'In ' || body || ' we now saw {{results.n}} texts [@a].' END AS rebuilt FROM d""")
def d36_round_trip(spark, sf_dir):
    """New wording in whole texts goes into the source with the source's bindings; reworded stretches lose their
    emphasis, and a changed citation is refused."""
    from claimtrace.plans.roundtrip import merged

    body = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[*_`]", ""), r"\s+", " "))
    d = t(spark, sf_dir, "documents").select("doc_id", "n_chars", body.alias("body"), F.col("doc_id").cast("string").alias("id"))
    known = d.select("doc_id", "id", F.concat(F.lit("**In** "), "body", F.lit(" we saw {{results.n}} texts [@a].")).alias("source"))
    said = lambda words, cite: F.concat(F.lit("In "), "body", F.format_string(f" we {words} %d texts ({cite} 1).", "n_chars"))
    kind = F.col("doc_id") % 4
    back = d.filter(kind != 3).select("id", F.when(kind == 1, said("now saw", "A")).when(kind == 2, said("saw", "B")).otherwise(said("saw", "A")).alias("text"))
    return merged(known, d.select("id", said("saw", "A").alias("text")), back).select("doc_id", "state", "rebuilt")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS doc, CAST(o_orderkey AS VARCHAR) || '-1' AS id, 0 AS was, 3 AS now FROM orders WHERE o_orderkey % 2 = 0""")
def f14_moves(spark, sf_dir):
    """Paragraphs outside the backbone of both orders: of four the first, put last."""
    from claimtrace.plans.roundtrip import moves

    d = t(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc"), (F.col("o_orderkey") % 2 == 0).alias("turned"), F.explode(F.array(*map(F.lit, range(1, 5)))).alias("n"))
    d = d.withColumn("id", F.concat_ws("-", "doc", "n"))
    after = F.when(F.col("turned") & (F.col("n") == 1), 9).otherwise(F.col("n"))
    return moves(d.select("doc", "id", F.col("n").alias("position")), d.select("doc", "id", after.alias("position")))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS path, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS e,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey, l_suppkey) AS num FROM lineitem),
          r AS (SELECT DISTINCT path, CAST(0 AS BIGINT) AS num, 0 AS a, 0 AS e, 0 AS upto, FALSE AS kept FROM s
              UNION ALL SELECT s.path, s.num, s.a, s.e, CASE WHEN s.a >= r.upto THEN s.e ELSE r.upto END, s.a >= r.upto FROM r JOIN s ON s.path = r.path AND s.num = r.num + 1)
          SELECT path, a AS start, e AS stop, row_number() OVER (ORDER BY path, a) AS anchor FROM r WHERE kept""")
def f17_marks(spark, sf_dir):
    """Spans of each file, of which the first of those that overlap stays, numbered over all files."""
    from claimtrace.plans.roundtrip import disjoint, numbered

    start = (F.col("l_linenumber") * 10).cast("int")
    spans = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))
    return numbered(disjoint(spans)).select("path", "start", F.col("end").alias("stop"), "anchor")


@query("""WITH d AS (SELECT doc_id, n_chars, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) + 2 AS INTEGER) AS line FROM documents)
          SELECT doc_id, 'hardcoded' AS verdict, CAST(doc_id AS VARCHAR) AS atom, line FROM d UNION ALL SELECT doc_id, 'layout', CAST(n_chars AS VARCHAR), line + 1 FROM d
          UNION ALL SELECT doc_id, 'text', '3.84', line + 2 FROM d UNION ALL SELECT doc_id, 'ok', '1', line + 3 FROM d""")
def c9_script_numbers(spark, sf_dir):
    """Numbers of figure scripts by what they are there for; whole texts stand in comments, whose numbers don't count."""
    from claimtrace.plans.scripts import numbers

    comment = F.concat(F.lit("# "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n# ")))
    code = F.concat(comment, F.format_string('\nx = DataFrame([%d])\nplot(width=%d)\nax.set_title("Ratio 3.84 overall")\nsavefig("fig1.png")\n', "doc_id", "n_chars"))
    found = numbers(t(spark, sf_dir, "documents").select(F.format_string("%d.py", "doc_id").alias("path"), code.alias("text")))
    verdict = F.when(F.col("verdict") == "data", "hardcoded").otherwise(F.col("verdict"))
    return found.select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("doc_id"), verdict.alias("verdict"), "atom", "line")


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(?:load_results|read_results)\b') OR (regexp_matches(text, '[''"`]results[''"`]|\bresults[/\\]')
           AND regexp_matches(text, '(?i)\.json\b|from_?JSON|read_json|jsonlite')) AS reads FROM (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' results/a.json'
           WHEN 1 THEN ' load_results()' ELSE ' results/' END AS text FROM documents) d""")
def b23_reads_results(spark, sf_dir):
    from claimtrace.plans.scripts import reads_results

    more = F.when(F.col("doc_id") % 3 == 0, " results/a.json").when(F.col("doc_id") % 3 == 1, " load_results()").otherwise(" results/")
    return t(spark, sf_dir, "documents").select("doc_id", reads_results(F.concat(F.coalesce("text", F.lit("")), more)).alias("reads"))


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis of the documents' own texts."""
    from claimtrace.text.frames import analysed_documents

    return analysed_documents(t(spark, sf_dir, "documents").select("doc_id", "text"))


def _whole_rows(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    from claimtrace.text.frames import rows

    return rows(_whole(spark, sf_dir), part, "doc_id")


# What the analyser finds in whole texts has no SQL form; tests hold these to brute force.


@query()
def b4_fences_whole(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "fences").select("doc_id", "info", (F.col("body_end") - F.col("body_start")).alias("n_body"))


@query()
def b7_bindings_whole(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "bindings").select("doc_id", "ns", "key", "well_formed", "line")


@query()
def b12_headings_whole(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "headings").select("doc_id", "level", "title", F.array_join("chain", " > ").alias("chain"))


@query()
def b16_citations_whole(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "citations").select("doc_id", "citekey", "narrative")


@query()
def c8_classified_atoms(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "atoms").select("doc_id", "atom", "kind", "rule", F.array_join("chain", " > ").alias("chain"))


@query()
def e2_exemptions(spark, sf_dir):
    return _whole_rows(spark, sf_dir, "atoms").groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("n"))


@query()
def g2_numbers_gate(spark, sf_dir):
    """The numbers gate over the documents, against a namespace without values."""
    from claimtrace.plans import gates
    from claimtrace.schemas import VALUES
    from claimtrace.session import cut

    # the gate reads its parts of the analysis several times, so they are kept, without the texts
    parts = F.struct(*(f"parts.{x}" for x in ("atoms", "bindings", "fences"))).alias("parts")
    analysis = cut(_whole(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), parts))
    return gates.numbers(analysis, spark.createDataFrame([], VALUES)).groupBy("gate", "code", "severity").agg(F.count(F.lit(1)).alias("n"))
