"""A project folder end to end, and the parts that it is made of."""

import json
import time

import pandas as pd
import pytest
from claimtrace.operators import joins as J
from claimtrace.operators import suggest
from claimtrace.plans import gates as G
from claimtrace.plans import manuscript as M
from claimtrace.plans import project as P
from claimtrace.sources import files as S
from claimtrace.sources import records as R
from claimtrace.text import analyze as T
from claimtrace.text import manuscript as X
from claimtrace.text.frames import analysed_documents, parts_of
from pyspark.sql import functions as F

MAIN = """---
title: Of Birds
---
# Abstract
We saw {{results.n.birds}} birds, {{results.lost}}, and 417 more.

# Methods
Over 12 months we followed CONSORT closely. See {{table.t1}} and {{figure.f1}} [@smith2001].

# References
Smith, Anne. Birds.
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "paper.yaml").write_text("title: Of Birds\nreporting_guideline: STROBE\nodd: 1\nconventions:\n  - {id: months, pattern: '\\b12 months\\b', why: a horizon}\n")
    (tmp_path / "authors.yaml").write_text("affiliations: []\n")
    for name in ("manuscript", "results", "literature", "analysis", "review"):
        (tmp_path / name).mkdir()
    (tmp_path / "manuscript/main.md").write_text(MAIN)
    (tmp_path / "manuscript/_draft.md").write_text("999")
    value = {"value": 41, "display": "41"}
    (tmp_path / "results/a.json").write_text(json.dumps({"provenance": {"inputs": []}, "values": {"n.birds": value, "m": {"value": 2.5, "display": "2.5"}}, "tables": {}}))
    (tmp_path / "results/b.json").write_text(json.dumps({"provenance": {"inputs": []}, "values": {"n.birds": value}, "tables": {}}))
    (tmp_path / "literature/ledger.yaml").write_text("entries:\n  - {key: k, value: '7', display: '7', citekey: smith2001, depth: full-text, source_file: s.txt, quote: q}\n")
    (tmp_path / "references.bib").write_text("@article{smith2001,\n title={x}}\n@book{other,\n}\n")
    return tmp_path


def test_check_from_a_folder(spark, folder):
    found = P.check(spark, folder / "manuscript", stage="submission")
    rows = found.findings.orderBy("n").collect()
    codes = [r["code"] for r in rows]
    assert {"schema-violation", "authors-incomplete", "duplicate-key", "unresolved-binding", "unclassified-number", "unquoted-result", "unused-literature", "reference-uncited", "guideline-claimed-not-declared", "project-exemption"} <= set(codes)
    assert "gate-errored" not in codes and "citation-unresolved" not in codes
    assert [r["n"] for r in rows] == list(range(1, len(rows) + 1))
    ranks = [("fail", "warn", "info").index(r["severity"]) for r in rows]
    assert ranks == sorted(ranks)
    assert {r["message"] for r in rows if r["code"] == "unclassified-number"} == {"417"}
    counts = {r["name"]: r["value"] for r in found.counts.collect()}
    assert counts["files"] == 1 and counts["placeholders"] == 4
    early = P.check(spark, folder, stage="analysis")
    assert early.deferred.agg(F.sum("n")).first()[0] > 0 and "not due yet" in P.deferral_text(early.deferred).first()["text"]
    assert P.status_line(found.findings).first()["text"].endswith("notes")


def test_a_gate_that_fails_is_a_finding(spark):
    def broken():
        raise RuntimeError("no")

    assert [tuple(r)[:4] for r in P.guarded(spark, "G9", broken).collect()] == [("G9", "gate-errored", "fail", "RuntimeError: no")]


def test_finding_and_loading(folder, tmp_path):
    assert P.find_root(folder / "results") == folder.resolve()
    with pytest.raises(P.ProjectError):
        P.find_root("/")
    assert P.violations({"title": 3}, "paper") == ["title: not of the right type"] and P.violations([], "paper") == ["(root): not a mapping"]
    (folder / "bad.yaml").write_text("a: [")
    with pytest.raises(P.ProjectError):
        P.structured(folder / "bad.yaml")
    assert P.structured(folder / "none.yaml") is None
    for n in ("2", "10", "x"):
        (folder / f"review/panel-{n}.yaml").write_text("reviewers: []\n")
    assert [n for n, _ in P.numbered_files(folder / "review", "panel")] == [2, 10] and P.next_number(folder / "review", "panel") == 11
    (folder / "own").mkdir(), (folder / "shipped").mkdir()
    for d in ("own", "shipped"):
        (folder / d / "j.yaml").write_text("name: x\n")
    assert P.profile("j", [folder / "own", folder / "shipped"]) == folder / "own/j.yaml" and P.profile("k", [folder]) is None
    assert [p.name for p in P.expanded([folder / "results", folder / "paper.yaml"], (".json",))] == ["a.json", "b.json", "paper.yaml"]


def test_records_are_never_overwritten(spark, tmp_path):
    one = R.write_panel(tmp_path, ["ann", "bo"], {"ann": "methods"})
    two = R.write_panel(tmp_path, ["ann"])
    assert one.name == "panel-1.yaml" and P.structured(two)["reviewers"] == [{"id": "ann", "remit": "methods"}] and P.structured(two)["round"] == 2
    R.write_record(tmp_path, 1, "a b", {"x.md": "00"}, [])
    with pytest.raises(R.Exists):
        R.write_record(tmp_path, 1, "a b", {"x.md": "01"}, [])
    lock = R.write_lock(tmp_path / "methods.lock", spark.createDataFrame([("b.py", "2"), ("a.py", "1")], "path string, sha256 string"))
    assert list(json.loads(lock.read_text())["files"]) == ["a.py", "b.py"]
    script = tmp_path / "plot.py"
    script.write_bytes(b"x\r\n")
    for kind in ("svg", "png"):
        (tmp_path / f"f.{kind}").write_text(kind)
    shown = json.loads(R.write_manifest(script, [tmp_path / "f.svg", tmp_path / "f.png"]).read_text())
    assert set(shown["outputs"]) == {"f.svg", "f.png"}
    with pytest.raises(ValueError):
        R.write_manifest(script, [tmp_path / "f.svg", script])


def test_drawings_by_content():
    a = b'<svg xmlns="http://www.w3.org/2000/svg"><metadata>1</metadata><defs><path id="m1"/></defs><use href="#m1"/></svg>'
    b = a.replace(b"m1", b"zz9").replace(b">1<", b">2<")
    assert R.drawing_digest(a) == R.drawing_digest(b) != R.drawing_digest(a.replace(b"use", b"g")) and len(R.drawing_digest(b"not xml")) == 64


def test_manuscripts(spark):
    docs = spark.createDataFrame([("main.md", MAIN), ("two.md", "---\ntitle: Another\n---\nBody {{results.m}} 2.5 and 41")], "path string, text string")
    c = {r["path"]: r for r in M.measures(docs).collect()}["main.md"]
    assert (c["title"], c["tables"], c["figures"]) == ("Of Birds", 1, 1) and c["total_words"] == c["abstract_words"] + c["main_words"] and c["sections"] == ["Abstract", "Methods", "References"]
    assert c["abstract_words"] == 6  # bindings are masked: We saw birds, and 417 more
    values = spark.createDataFrame([("results.n.birds", "41"), ("results.m", "2.5")], "ref string, display string")
    tables = spark.createDataFrame([("t1", "| a |")], "table_key string, text string")
    analysis = analysed_documents(docs).cache()
    out, found = M.assembled(docs, analysis, values, tables, spark.createDataFrame([], "key string, file string"))
    text = {r["path"]: r["rendered"] for r in out.collect()}
    assert "We saw 41 birds, {{results.lost}}" in text["main.md"] and "See | a | and {{figure.f1}}" in text["main.md"] and text["main.md"].startswith("# Abstract") and text["two.md"].startswith("Body 2.5")
    assert {r["code"] for r in found.collect()} == {"figure-missing", "two-titles"}
    hints = M.unbound(analysis, docs, values)
    rows = {r["atom"]: (r["candidates"], r["hint"]) for r in hints.collect()}
    assert rows["2.5"][0] == ["results.m"] and rows["41"][0] == ["results.n.birds"] and rows["417"] == ([], "duration")
    bound = {r["path"]: r["rebound"] for r in M.bound(docs, hints).collect()}
    assert bound["two.md"].endswith("{{results.m}} {{results.m}} and {{results.n.birds}}")


def test_audit_detail(spark):
    text = "We saw 5 (n=3,000) and 0.72–0.82 of 9.\nSmith, Anne. Birds 77. 2001.\n## References\n1234 after"
    judged = M.audited(spark.createDataFrame([("a", text)], "path string, text string"), spark.createDataFrame([("5",), ("3000",), ("0.72",)], "number string")).cache()
    state = {r["atom"]: r["state"] for r in judged.collect()}
    assert "1234" not in state and state["n=3,000"] == "matched" and state["0.72–0.82"] == "unmatched" and state["2001"] == "classified"
    t = M.audit_totals(judged).first()
    assert t["examined"] == t["matched"] + t["unmatched"] + t["classified"] == len(state)
    assert X.hint("on 3 May 2015") == "date" and X.is_reference("Doe, Jo, a thing 1999") and not X.is_reference("we saw 1999")


def test_names_and_quotes_beyond_the_limit(spark, monkeypatch):
    left = spark.createDataFrame([("Materials and Methods",), ("xy",), ("no",), ("",), (None,)], "a string")
    right = spark.createDataFrame([("methods",), ("a longer XY here",), (None,)], "b string")
    docs = spark.createDataFrame([(1, "say tiny thing and one two three four five six seven eight end"), (2, "two three four five six seven only")], "i int, t string")
    quotes = spark.createDataFrame([("q", "e two three four five six seven eig"), ("s", "tiny thing"), ("n", "not there at all in any of them")], "k string, q string")
    run = lambda: (sorted(str(r[0]) for r in J.either_contains(left, right, "a", "b").collect()), sorted((r["i"], r["k"]) for r in J.quoted_in(docs, quotes, "t", "q").collect()))
    small = run()
    assert small == (["", "Materials and Methods", "xy"], [(1, "q"), (1, "s")])
    monkeypatch.setattr(J, "MOST_BROADCAST", 0)
    assert run() == small


def test_suggestions_over_blocks(spark, monkeypatch):
    import difflib

    known = [f"results.value{i}" for i in range(60)]
    missing = ["results.valu7", "results.valve12", "zzz", "result.value33"]
    frame = lambda x: spark.createDataFrame([(v,) for v in x], "ref string")
    want = {m: difflib.get_close_matches(m, sorted(known), 3, 0.6) for m in missing}
    assert {r["ref"]: r["candidates"] for r in suggest.suggestions(frame(missing), frame(known), "ref").collect()} == want
    monkeypatch.setattr(suggest, "NAMES_AT_ONCE", 7)
    monkeypatch.setattr(suggest, "MISSES_AT_ONCE", 2)
    assert {r["ref"]: r["candidates"] for r in suggest.suggestions(frame(missing), frame(known), "ref").collect()} == want


def test_oversize_files_are_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "a.svg").write_text("<svg><text>7</text></svg>")
    (tmp_path / "b.svg").write_text("<svg><text>" + "8" * 500 + "</text></svg>")
    monkeypatch.setattr(S, "MOST_ARCHIVE", 100)
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in S.binary_text(spark, str(tmp_path), "*.svg").collect()}
    assert got["a.svg"] == ("7", None) and got["b.svg"][0] is None and "bytes" in got["b.svg"][1]


def test_lint_reads_places(spark):
    text = "Studies have shown it [@a]. " + "x " * 200 + "Studies have shown it. We delve, delve, delve and delve. Robust standard errors — a — b — c."
    docs = spark.createDataFrame([("m", text)], "path string, text string")
    found = G.lint(docs, analysed_documents(docs), spark).collect()
    by = pd.DataFrame([r.asDict() for r in found])
    assert (by.code == "vague-attribution").sum() == 1 and (by.code == "ai-phrasing").sum() == 3
    dense = by[by.code == "ai-cadence"]
    assert "em-dash" in set(dense.message) and "ai-vocabulary" not in set(dense.message)


@pytest.mark.parametrize("unit", ["a [@k{i}] b ", "# H{i}\nx\n\n", "see {{{{results.v{i}}}}} and\n", "<!-- open {i} ", "![x {i} ", "n {i} of\n", "``` {i}\n"])
def test_the_analyser_grows_with_the_text(unit):
    """Four times the text takes less than twelve times the time."""
    took = []
    for n in (1_500, 6_000):
        text = "".join(unit.format(i=i) for i in range(n))
        began = time.perf_counter()
        parts_of(text, T.TERMS, T.RULES, False)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.3


def test_sources_and_scaffold(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.txt").write_text("one “two”\n three")
    (src / "b.html").write_text("<p>x<script>7</script> y</p>")
    (src / "c.pdf").write_bytes(b"%PDF")
    got = {r["source_file"]: (r["text"], r["error"]) for r in S.source_texts(spark, str(src)).collect()}
    assert got == {"a.txt": ('one "two" three', None), "b.html": ("x y", None), "c.pdf": (None, "source-unreadable")}
    (src / "t.csv").write_text('a,b\n1,"x, ""y"""\n')
    assert [tuple(r) for r in S.csv_rows(spark, str(src / "t.csv")).collect()] == [("1", 'x, "y"')]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/paper.yaml").write_text("title: mine\n")
    first = R.scaffold(tmp_path / "p")
    assert (tmp_path / "p/paper.yaml").read_text() == "title: mine\n" and len(first) == len(R.SCAFFOLD) - 1 and R.scaffold(tmp_path / "p") == []
    assert P.load(tmp_path / "p").paper["title"] == "mine"


def test_published_checklists():
    from claimtrace.rules.recipes import CHECKLISTS, checklist

    assert len({c.name for c in CHECKLISTS}) == 13 and checklist("strobe").recipe.carry_id and checklist("ARRIVE-2.0").split == 121
