from claimtrace.plans import gates as G
from claimtrace.rules.tables import BINDS
from claimtrace.text import analyze as T
from claimtrace.text.frames import analysed_documents


def codes(df):
    return sorted((r["code"], r["message"]) for r in df.collect())


def test_freshness(spark):
    inputs = [("a.csv", "h1", 1), ("b.csv", "h2", 1), ("c.csv", "h3", 1)]
    schema = "path string, doc struct<provenance:struct<generated_by:string,generated_by_sha256:string,inputs:array<struct<path:string,sha256:string,bytes:bigint>>>>"
    found = spark.createDataFrame([("r.json", (("s.py", "old", inputs),)), ("q.json", (("gone.py", "x", []),))], schema)
    files = spark.createDataFrame([("a.csv", "h1"), ("b.csv", "new"), ("s.py", "new")], "path string, sha256 string")
    assert codes(G.freshness(found, files)) == [("input-changed", "b.csv"), ("input-missing", "c.csv"), ("script-missing", "gone.py"), ("script-newer", "s.py")]


def test_journal_and_required(spark):
    counts = spark.createDataFrame([("words", 3100), ("tables", 4), ("figures", 1)], "name string, value int")
    limits = spark.createDataFrame([("words", 3000), ("tables", 4), ("figures", 5)], "name string, most int")
    got = [c for c, _ in codes(G.journal(counts, limits, "2020-01-01", "2024-01-01"))]
    assert got == ["journal-profile-stale", "near-journal-limit", "over-journal-limit"]
    texts = spark.createDataFrame([("The authors declare no competing interests.",)], "text string")
    wanted = spark.createDataFrame([("interests", "competing interests"), ("funding", "^funding")], "id string, pattern string")
    assert codes(G.required(texts, wanted, "G4", "missing-required-statement")) == [("missing-required-statement", "funding")]


def test_checklist(spark):
    items = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    answers = spark.createDataFrame([("a", "Methods", None), ("b", None, " N/A "), ("c", "", ""), ("x", "nowhere", None)], "id string, where string, not_applicable string")
    heads = spark.createDataFrame([("Statistical methods",)], "title string")
    assert codes(G.checklist(items, answers, heads)) == [
        ("checklist-item-missing", "d"), ("checklist-item-unanswered", "c"), ("checklist-item-unknown", "x"), ("checklist-location-unknown", "x"), ("checklist-non-reason", "b"),
    ]


def test_figures_and_reviews(spark):
    layers = spark.createDataFrame([("f.svg", "n = 77 and 12 and 5", None), ("g.svg", " ", None), ("h.svg", None, "broken")], "path string, text string, error string")
    values = spark.createDataFrame([("12",)], "display string")
    allowed = spark.createDataFrame([("f.svg", "5", "a scale"), ("f.svg", "77", " ")], "path string, atom string, why string")
    assert codes(G.figures(layers, analysed_documents(layers), values, allowed)) == [("figure-no-text-layer", "no text layer"), ("figure-number-unbound", "77"), ("figure-unreadable", "broken")]
    figures = spark.createDataFrame([("f", "new"), ("g", "x")], "figure string, sha256 string")
    reviews = spark.createDataFrame([("f", "old", [("axes", True), ("units", False)])], "figure string, content_sha256 string, checks array<struct<id:string,ok:boolean>>")
    checks = spark.createDataFrame([("axes",), ("units",), ("legend",)], "id string")
    assert codes(G.figure_reviews(figures, reviews, checks)) == [("figure-review-check-failed", "f units"), ("figure-review-incomplete", "f legend"), ("figure-review-stale", "f"), ("figure-unreviewed", "g")]


def test_plan_verify_and_order(spark):
    sections = spark.createDataFrame([("Study design", "cohort"), ("Outcome", "TBD")], "title string, body string")
    got = codes(G.plan(sections))
    assert ("plan-section-empty", "outcome") in got and ("plan-section-missing", "analysis") in got and ("plan-section-missing", "design") not in got
    schema = "ref string, value_double double, display string"
    before = spark.createDataFrame([("a", float("nan"), "x"), ("b", 1.0, "1"), ("c", 2.0, "2")], schema)
    after = spark.createDataFrame([("a", float("nan"), "x"), ("b", 1.5, "1"), ("d", 2.0, "2")], schema)
    checked = G.verify(before, after)
    assert codes(checked) == [("rerun-differs", "b"), ("rerun-extra-value", "d"), ("rerun-missing-value", "c")]
    assert [r["severity"] for r in G.report(checked).orderBy("n").collect()] == ["fail", "fail", "warn"]


def test_table_cells_that_differ(spark):
    schema = "table_key string, row int, col int, text string, template string, parts array<string>, is_codes boolean"
    cells = spark.createDataFrame([("t", 0, 0, "7 (13)", "{} ({})", ["7", "12"], False), ("t", 1, 0, "3 of 9", None, None, None), ("t", 2, 0, "A1", "{}", ["A1"], True)], schema)
    values = spark.createDataFrame([("3",)], "display string")
    lists = spark.createDataFrame([("t", 2, ["A1", "B2"])], "table_key string, row_idx int, codes array<string>")
    assert codes(G.table_cells(cells, values, lists)) == [("code-list-does-not-match", "t:2:0"), ("composition-does-not-match", "t:0:0"), ("typed-composite-cell", "t:1:0"), ("unemitted-table-number", "t:1:0")]


def test_stage_table_names_each_code_once():
    every = [c for codes in BINDS.values() for c in codes]
    assert len(every) == len(set(every))


def test_words_and_sections():
    assert T.count_words("# Title\nTwo words. ![a](b.png)\n\n| a | b |\n") == 3
    assert [(t, b.strip()) for t, _, b in T.sections("# A\nx\n## B\ny\n")] == [("A", "x"), ("B", "y")]
