import io
import json
import zipfile

import pytest
from claimtrace.plans import gates as G
from claimtrace.schemas import VALUES
from claimtrace.sources import files as S
from claimtrace.sources.emitter import Emitter
from claimtrace.streaming import hooks
from claimtrace.text.frames import analysed_documents
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("paper")
    (root / "results").mkdir()
    (root / "manuscript").mkdir()
    e = Emitter("analysis/01.py", {"data.csv": "0" * 64})
    e.value("n", 426)
    e.interval("ror", 3.8439, 2.8876, 5.117, "95%", 2)
    e.value("again", 426, same_as="n")
    e.value("unused", 1.25, 2)
    e.table("main", ["group", "n"], [["exposed", 426], ["other", ("{} ({})", [7, 12])]], "Counts")
    with pytest.raises(ValueError, match="typed as text"):
        e.table("bad", ["n"], [["42"]])
    e.write(str(root / "results" / "a.json"))
    (root / "results" / "b.json").write_text(json.dumps({"values": {"n": {"value": 1, "display": "1"}}}))
    (root / "results" / "broken.json").write_text("[1")
    (root / "manuscript" / "main.md").write_text(
        "# Results\nThere were {{results.n}} and {{results.gone}}: {{results.ror.ci95_high}} to {{results.ror.ci95_low}}, {{results.ror.point}}, {{results.again}}. "
        "Loose 77 here. {{table.main}} Studies have shown it. We delve. As an AI language model I agree. [@a]\n"
    )
    return root


def codes(df):
    return sorted((r["code"], r["message"]) for r in df.collect())


def test_gates_end_to_end(spark, project):
    found = S.fragments(spark, str(project / "results"))
    values, late = S.values_of(found)
    assert codes(G.fragments_gate(found, late)) == [("duplicate-key", "published before: n"), ("schema-violation", "not a results fragment")]
    docs = S.markdown(spark, str(project / "manuscript"))
    analysis = analysed_documents(docs).cache()
    cells = S.cells_of(found)
    got = {c for c, _ in codes(G.numbers(analysis, values, cells))}
    assert got == {"unclassified-number", "unresolved-binding", "unquoted-result"}
    assert ("unquoted-result", "results.unused") in codes(G.numbers(analysis, values, cells))
    assert codes(G.interval_order(analysis, values)) == [("interval-reversed", "ror.point")]
    assert codes(G.intervals(values)) == []
    assert codes(G.intervals(values.withColumn("value_double", F.when(F.col("bound") == "low", 9.0).otherwise(F.col("value_double"))))) == [("interval-inverted", "results.ror.point 95%")]
    assert codes(G.table_cells(cells, values)) == []
    lint = {c for c, _ in codes(G.lint(docs, analysis, spark))}
    assert lint == {"model-artefact", "ai-phrasing"}  # the vague claim has a citation near
    known = spark.createDataFrame([("b",)], "citekey string")
    assert codes(G.citations(analysis, known)) == [("citation-unresolved", "a"), ("reference-uncited", "b")]
    assert codes(G.citations(analysis, known.limit(0))) == []
    assert ("duplicate-quantity", "426.0") in codes(G.consistency(values))
    staged = G.staged(G.numbers(analysis, values), "design").collect()
    assert {r["severity"] for r in staged if r["code"] == "unquoted-result"} == {"info"}
    loose = hooks.loose_numbers(docs.select("path", "text")).first()
    assert loose["n"] == 1 and loose["first"] == ["77"]
    assert "unclassified-number" in S.findings_json(G.numbers(analysis, values))


def test_fifty_are_listed_and_the_rest_counted(spark):
    docs = spark.createDataFrame([("d.md", " ".join(f"{i}.5" for i in range(60)))], "path string, text string")
    values = spark.createDataFrame([], VALUES)
    got = codes(G.numbers(analysed_documents(docs), values))
    assert len(got) == 51 and ("unclassified-number", "10 more") in got


def test_literature_reviews_revision(spark):
    e = spark.createDataFrame(
        [("k1", "s1", "the rate was 12.5 per year", "12.5", None, None, "full-text"), ("k2", "s1", "no such words", "1", None, None, "full-text"),
         ("k3", "s2", "x", "1", None, None, "full-text"), ("k4", None, None, "2", "ChatGPT", "short", "x"), ("k5", "s1", "the rate was 12.5 per year", "2.5", None, None, "abstract-only")],
        "key string, source_file string, quote string, display string, attested_by string, statement string, depth string",
    )
    stored = spark.createDataFrame([("s1", "In all,  the rate was 12.5 per year.")], "source_file string, text string")
    assert codes(G.literature(e, stored)) == [
        ("attestation-not-human", "k4"), ("attestation-thin", "k4"), ("literature-source-missing", "k3"), ("quote-not-in-source", "k2"),
        ("value-from-abstract", "k5"), ("value-not-in-quote", "k2"), ("value-not-in-quote", "k5"),
    ]
    panel = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], "round int, id string")
    records = spark.createDataFrame([(1, "a", {"m.md": "old"}, [("major", None)])], "round int, reviewer string, file_sha256 map<string,string>, findings array<struct<severity:string,resolution:string>>")
    files = spark.createDataFrame([("m.md", "new"), ("s.md", "x")], "path string, sha256 string")
    assert [c for c, _ in codes(G.reviews(panel, records, files))] == ["duplicate-reviewer", "open-major-finding", "review-missing", "review-missing", "review-stale", "review-uncovered"]
    points = spark.createDataFrame([("p1", "", None, []), ("p2", "done", None, []), ("p3", "done", None, [("file", "m.md")])], "id string, response string, rebutted boolean, changed array<struct<kind:string,name:string>>")
    assert codes(G.revision(points, files, files)) == [("claimed-change-did-not-happen", "p3"), ("point-unanswered", "p1"), ("response-claims-nothing", "p2")]
    assert codes(G.methods(files, files.limit(1))) == [("methods-drift", "removed")]


def test_audit_needs_all_parts(spark):
    docs = spark.createDataFrame([("p.md", "We saw 12/30 and 12/31 and 99.")], "path string, text string")
    backing = S.backing_numbers(spark.createDataFrame([("n=12, m=30.0",)], "text string"))
    got = {r["atom"]: r["matched"] for r in G.audit(analysed_documents(docs), backing).collect()}
    assert got == {"12/30": True, "12/31": False, "99": False}


def test_office_and_drawings(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f"<w:document {w}><w:p><w:t>kept 5</w:t><w:del><w:t>gone</w:t></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc></w:tr></w:tbl></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    assert S.docx_text(data.getvalue()).startswith("kept 5\na") and S.docx_tables(data.getvalue()) == [[["a"]]]
    assert S.svg_text(b"<svg><title>9</title><text>n = 7</text></svg>") == "n = 7"
    with pytest.raises(S.UnsafeDocument):
        S.safe_xml(b"<!DOCTYPE x><x/>")
    (tmp_path / "f.svg").write_text("<svg><text>n = 7</text></svg>")
    (tmp_path / "g.svg").write_text("<svg>")
    got = {r["path"][-5:]: (r["text"], r["error"] is None) for r in S.binary_text(spark, str(tmp_path), "*.svg").collect()}
    assert got == {"f.svg": ("n = 7", True), "g.svg": (None, False)}


def test_hooks(spark):
    rows = spark.createDataFrame([("results/a.json",), ("notes.md",), ("reporting/x.recipe.yaml",)], "path string")
    assert [r["decision"] for r in hooks.guarded_writes(rows).collect()] == ["deny", "allow", "allow"]


def test_suggestions(spark):
    from claimtrace.operators.suggest import suggestions

    known = spark.createDataFrame([("results.ror.point",), ("results.n",), ("lit.rate",)], "ref string")
    got = suggestions(spark.createDataFrame([("results.ror.pont",), ("zzz",)], "ref string"), known, "ref").collect()
    assert {r["ref"]: r["candidates"] for r in got} == {"results.ror.pont": ["results.ror.point", "results.n"], "zzz": []}


def test_quotes_are_found_letter_by_letter(spark):
    """A capital of two letters, and a sigma at the end of a quote that is no word's end."""
    from claimtrace.functions import expressions as X

    rows = [("Die Straße und", "straße"), ("στόμασι", "ΣΤΌΜΑΣ"), ("Die Strasse", "straße")]
    df = spark.createDataFrame(rows, "text string, quote string")
    got = df.select(X.contains_quote(F.col("text"), X.upper_each(F.col("quote"))).alias("hit"), X.upper_each(F.col("quote")).alias("up")).collect()
    assert [r.hit for r in got] == [True, True, False] and got[0].up == "STRAẞE"
