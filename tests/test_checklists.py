"""Checklists, returned documents and what a submission says of its authors."""

from __future__ import annotations

import io
import zipfile

from claimtrace.plans import checklists as C
from claimtrace.plans import submission as S
from claimtrace.sources import files

ROWS = "doc string, place int, cells array<string>"


def items(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_from_tables_carries_sections_topics_and_numbers(spark):
    rows = [["", "Item No", "Recommendation"], ["METHODS", "", ""], ["Design", "4*", "(a) Present key elements"], ["", "", "(b) Say why"], ["Setting", "5", "Describe it"], ["", "5", "Twice"], ["", "6", "—"]]
    df = spark.createDataFrame([("d", i, r) for i, r in enumerate(rows)] + [("e", 0, None)], ROWS)
    recipe = C.Recipe(text_column=2, topic_column=0, id_column=1, carry_id=True, subitem_letters=True)
    assert items(C.from_tables(df, recipe), "id", "topic", "section", "text") == [
        ("4a", "Design", "METHODS", "Present key elements"), ("4b", "Design", "METHODS", "Say why"), ("5", "Setting", "METHODS", "Describe it"),
    ]
    assert C.from_tables(df.limit(0), recipe).count() == 0


def test_from_tables_named_and_leading_numbers(spark):
    df = spark.createDataFrame([("d", 0, ["T", "RECORD 1.1: One thing. RECORD 1.2: Another."]), ("d", 1, ["T", "no number"])], ROWS)
    named = C.Recipe(text_column=1, topic_column=0, header_rows=0, named_id=True)
    assert items(C.from_tables(df, named), "id", "text") == [("1.1", "One thing."), ("1.2", "Another.")]
    df = spark.createDataFrame([("d", 0, ["1a. Title", "Name the design"]), ("d", 1, ["1b. Abstract", "Sum it up"])], ROWS)
    assert items(C.from_tables(df, C.Recipe(text_column=1, topic_column=0, header_rows=0, id_in_topic=True)), "id", "topic") == [("1a", "Title"), ("1b", "Abstract")]


def test_from_columns_folds_lines(spark):
    left = ["Title      1   Name the design in", "and more       the title itself", "", "Aims       2   State all the aims"]
    right = ["Bias       9   Describe any known efforts", "Short     10   Too short", "x", "y"]
    page = "\n".join(a.ljust(50) + b for a, b in zip(left, right, strict=True))
    got = C.from_columns(spark.createDataFrame([("p", 1, page)], "doc string, page int, text string"), 50)
    assert items(got, "id", "topic", "text") == [
        ("1", "Title and more", "Name the design in the title itself"), ("2", "Aims", "State all the aims"), ("9", "Bias", "Describe any known efforts"),
    ]


def test_unfounded(spark):
    found = spark.createDataFrame([("d", "1", "Say   it “so”"), ("d", "2", "Never said")], "doc string, id string, text string")
    whole = spark.createDataFrame([("d", 'You should say it "so" always')], "doc string, text string")
    assert items(C.unfounded(found, whole), "id") == [("2",)]


def test_returned_document():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:bookmarkStart w:name="ct-p-x-0"/><w:commentRangeStart w:id="7"/><w:r><w:t>A &amp; </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p><w:t>none</w:t></w:p>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/comments.xml", f'<w:comments {w}><w:comment w:id="7" w:author="R2" w:date="2024-05-06T01:02:03Z"><w:p><w:t>Why?</w:t></w:p></w:comment><w:comment w:id="8"/></w:comments>')
    assert files.docx_paragraphs(data.getvalue()) == [("ct-p-x-0", "A & b")]
    assert files.docx_comments(data.getvalue()) == [("R2", "2024-05-06", "Why?", "ct-p-x-0")]


def test_credits_and_superscripts(spark):
    rows = [(1, "Ann-Lee", "Poe", ["Software", "Tea"], ["b", "zz", "a"]), (2, "Bo", "Ray", ["Software", "Conceptualization"], [])]
    authors = spark.createDataFrame(rows, "place int, given string, family string, credit array<string>, affiliations array<string>")
    assert [tuple(r) for r in S.credits(authors).collect()] == [("Conceptualization", "B.R."), ("Software", "A.L.P., B.R."), ("Tea", "A.L.P.")]
    places = spark.createDataFrame([("a", 1, "Here"), ("b", 2, "There")], "id string, place int, text string")
    assert items(S.superscripts(authors, places), "place", "marks", "addresses") == [(1, "2,1", ["There", "Here"]), (2, "", [])]
