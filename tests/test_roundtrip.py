"""Edited documents, annotated copies and figure scripts."""

from __future__ import annotations

from claimtrace.plans import roundtrip as R
from claimtrace.plans import scripts as S
from claimtrace.text import analyze as T
from claimtrace.text import paragraphs as P

SOURCE = "The ratio was **clearly** {{results.ror}} in adults [@smith], and *not* lower."
BUILT = "The ratio was clearly 3.84 in adults (Smith 2020), and not lower."


def test_realigned_keeps_bindings_and_untouched_emphasis():
    edited = "The ratio was clearly 3.84 in older adults (Smith 2020), and not lower."
    assert P.realigned(SOURCE, BUILT, edited) == "The ratio was **clearly** {{results.ror}} in older adults [@smith], and *not* lower."


def test_realigned_refuses_changed_or_swapped_tokens():
    assert P.realigned(SOURCE, BUILT, BUILT.replace("3.84", "3.85")) is None
    assert P.realigned(SOURCE, BUILT, "In (Smith 2020) the ratio was 3.84.") is None
    assert P.realigned("a {{results.x}}{{results.y}} b", "a 12 b", "a 12 c") is None
    assert P.realigned("No numbers.", "No numbers.", " None at all. ") == "None at all."
    assert P.realigned("No numbers.", "No numbers.", "  ") is None


def test_realigned_tells_what_is_bound_from_like_prose():
    source = "Of 7089 files and 89 more (89) we saw {{results.n}} texts [@a]."
    shown = "Of 7089 files and 89 more (89) we saw 89 texts (A 1)."
    assert P.realigned(source, shown, shown.replace("we saw", "we now saw")) == source.replace("we saw", "we now saw")
    assert P.realigned(source, shown, shown.replace("we saw", "they saw")[:-1] + "!") == source.replace("we saw", "they saw")[:-1] + "!"
    assert P.realigned("We saw {{results.n}} texts.", "We saw 89 texts.", "We saw 891 texts.") is None
    assert P.realigned("We saw {{results.n}} texts.", "We saw 89 texts.", "We saw 89.5 texts.") is None
    assert P.realigned("We saw {{results.n}}.", "We saw 89.", "They saw 89.") == "They saw {{results.n}}."
    assert P.realigned("A {{results.a}} and {{results.b}}.", "A 1 and 1.", "An 1 and also 1.") == "An {{results.a}} and also {{results.b}}."
    many = " ".join(f"w {{{{results.k{i}}}}}" for i in range(30)) + " [@a]."
    built = " ".join("w 1" for i in range(30)) + " (A)."
    assert P.realigned(many, built, built.replace("(A)", "(B)")) is None  # in time that grows with the text


def test_paragraph_ids_are_stable_and_unique():
    text = "# A\n\nFirst one.\n\n{{table.t1}}\n\nFirst one.\n"
    found = P.paragraphs("a/notes.md", text)
    assert [(i.rsplit("-", 1)[1], body) for i, body, _ in found] == [("2", "First one."), ("6", "First one.")]
    assert all(text[at:].startswith(body) for _, body, at in found)
    assert P.file_slug("a/notes.md") != P.file_slug("b/notes.md")
    assert P.paragraphs("x.md", "") == []


def test_moved_names_only_what_left_the_backbone():
    assert P.moved(list("abcdef"), list("abdefc")) == [("c", 2, 5)]
    assert P.moved(list("abc"), list("xabyc")) == [] == P.moved([], list("ab"))


def test_merged_states_and_moves(spark):
    docs = spark.createDataFrame([("m.md", f"---\ntitle: x\n---\n\n{SOURCE}\n\nPlain words.\n\nGone.\n"), ("n.md", None)], "path string, text string")
    known = R.paragraph_rows(docs)
    ids = [r["id"] for r in known.orderBy("start").collect()]
    out = spark.createDataFrame(list(zip(ids, [BUILT, "Plain words.", "Gone."])), "id string, text string")
    back = spark.createDataFrame([(ids[0], BUILT.replace("3.84", "4")), (ids[1], "Plainer words.")], "id string, text string")
    got = {r["source"][:5]: (r["state"], r["rebuilt"]) for r in R.merged(known, out, back).collect()}
    assert got == {"The r": ("refused", None), "Plain": ("merged", "Plainer words."), "Gone.": ("absent", None)}
    before = spark.createDataFrame([("d", x, i) for i, x in enumerate("abcd")], "doc string, id string, position int")
    after = spark.createDataFrame([("d", x, i) for i, x in enumerate("bcda")], "doc string, id string, position int")
    assert [tuple(r) for r in R.moves(before, after).collect()] == [("d", "a", 0, 3)]


def test_marks_first_wins_and_anchors_count_over_files(spark):
    spans = [("b.md", 0, 4), ("a.md", 0, 10), ("a.md", 5, 40), ("a.md", 12, 15), ("a.md", 15, 16)]
    rows = spark.createDataFrame([(*s, "1", "results", False, True) for s in spans], "path string, start int, end int, atom string, origin string, label boolean, attested boolean")
    got = sorted((r["anchor"], r["path"], r["start"]) for r in R.marks(rows).collect())
    assert got == [(1, "a.md", 0), (2, "a.md", 12), (3, "a.md", 15), (4, "b.md", 0)]
    assert [tuple(r) for r in R.tier_totals(R.marks(rows)).collect()] == [("traced", 4)]
    assert R.marks(rows.limit(0)).count() == 0


def test_code_numbers_names_and_lines():
    code = 'width = 5\nplot(3)\ns = """a 7\nb 8"""\nfig.set(size=2, data=[4])  # 99\n'
    got = [(n.text, n.line, n.in_string, n.names) for n in T.numbers_in_code(code, "python")]
    assert got == [("5", 1, False, ("width",)), ("3", 2, False, ("plot",)), ("7", 3, True, ("s",)), ("8", 4, True, ("s",)), ("2", 5, False, ("fig.set", "size")), ("4", 5, False, ("fig.set", "data"))]
    assert [n.line_text[n.column :][:1] for n in T.numbers_in_code(code, "python")] == list("537824")


def test_figure_scripts(spark):
    good = "import json\nd = json.load(open('results/a.json'))\nplt.figure(dpi=300)\n"
    bad = 'x = 7\ndf = DataFrame([1.5])\nax.set_title("Ratio 3.84 overall")\nax.text(0, 0, "%.2f")\nsavefig("fig1.png")\n'
    scripts = spark.createDataFrame([("g.py", good), ("b.py", bad), ("c.jl", "1"), ("e.R", None)], "path string, text string")
    allowed = spark.createDataFrame([("b.py", "7", "panel count"), ("b.py", "1.5", " ")], "path string, atom string, why string")
    judged = S.numbers(scripts)
    got = sorted((r["path"], r["code"], r["message"], r["line"]) for r in S.figure_scripts(scripts, judged, allowed).collect())
    assert got == [
        ("b.py", "figure-script-ignores-results", "the script never reads the results", None),
        ("b.py", "figure-source-hardcoded-data", "1.5", 2),
        ("b.py", "figure-source-text-number", "3.84", 3),
        ("c.jl", "figure-source-unread", "no reader for this language", None),
        ("e.R", "figure-script-ignores-results", "the script never reads the results", None),
    ]
