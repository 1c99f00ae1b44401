"""What the library is made of stays apart."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_pipeline_operators():
    """The subpackage may be deleted: no other module of the library and no other test names it."""
    rest = [*(ROOT / "claimtrace").rglob("*.py"), *(ROOT / "tests").glob("*.py")]
    named = [p for p in rest if "llm" not in p.relative_to(ROOT).parts and re.search(r"(?:from|import)\s+claimtrace\." + "llm", p.read_text())]
    assert not named


def test_text_values():
    from claimtrace.functions.display import loose_in_text

    assert loose_in_text("2015-2019") == loose_in_text("phase 3") == loose_in_text("x 417", label=True) == loose_in_text("none") == []
    assert loose_in_text("about 417 of them") == ["417"]


def test_submissions_are_held_back(spark, tmp_path):
    from claimtrace.streaming.hooks import before_submission

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"command": "git tag submission-1"}\n{"command": "ls"}\n')
    seen = []
    stream = spark.readStream.schema("command string").json(str(tmp_path / "in"))
    q = before_submission(stream, lambda: spark.createDataFrame([("fail",)], "severity string"), lambda df: seen.extend(df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert [(r["command"], r["decision"]) for r in seen] == [("git tag submission-1", "deny")]
