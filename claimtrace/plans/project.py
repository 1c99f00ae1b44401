"""A project folder as one check: found, loaded, validated, all gates run over it, findings staged and put in order."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimtrace.operators import aggregates as A
from claimtrace.plans import gates as G
from claimtrace.plans import manuscript as M
from claimtrace.rules.tables import RULES, Rule
from claimtrace.schemas import FINDINGS, VALUES
from claimtrace.sources import files as S
from claimtrace.text import analyze as T
from claimtrace.text.frames import analysed_documents, rows

PAPER, AUTHORS = "paper.yaml", "authors.yaml"
FOLDERS = ("manuscript", "results", "literature", "figures", "analysis", "review", "revision", "reporting")

#: Fields of the contracts: name, type, whether it must be there.
CONTRACTS: dict[str, tuple[tuple[str, type | tuple[type, ...], bool], ...]] = {
    "paper": (
        ("title", str, True), ("short_title", str, False), ("stage", str, False), ("journal", str, False), ("reporting_guideline", (str, list), False),
        ("conventions", list, False), ("terms", list, False), ("paths", dict, False), ("bibliography", str, False),
    ),
    "authors": (("authors", list, True), ("affiliations", list, False), ("corresponding", str, False)),
    "journal": (("name", str, True), ("retrieved_on", str, False), ("limits", dict, False), ("required_sections", list, False), ("required_statements", list, False)),
    "panel": (("round", int, False), ("reviewers", list, True)),
}


class ProjectError(ValueError):
    """No project, or a file of it that can't be parsed."""


@dataclass(frozen=True)
class Project:
    root: Path
    paper: dict
    authors: dict | None = None
    problems: tuple[tuple[str, str, str], ...] = field(default=())  # code, message, path

    def folder(self, name: str) -> Path:
        return self.root / self.paper.get("paths", {}).get(name, name)


def find_root(start: str | Path) -> Path:
    """The nearest folder from ``start`` upward that has a paper file."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / PAPER).is_file():
            return folder
    raise ProjectError(f"no {PAPER} in {start} or above it")


def structured(path: Path) -> object:
    """A JSON or YAML file; ``None`` if it isn't there. Dates stay text."""
    if not path.is_file():
        return None
    text = path.read_text(encoding="utf-8")
    try:
        if path.suffix.lower() == ".json":
            return json.loads(text)
        import yaml

        return json.loads(json.dumps(yaml.safe_load(text), default=str))
    except ValueError as e:
        raise ProjectError(f"{path}: {e}") from e
    except yaml.YAMLError as e:
        raise ProjectError(f"{path}: {e}") from e


def violations(document: object, contract: str) -> list[str]:
    """What a parsed document has that its contract doesn't allow, or lacks, in order of place."""
    if not isinstance(document, dict):
        return ["(root): not a mapping"]
    known = {name: (kind, needed) for name, kind, needed in CONTRACTS[contract]}
    out = [f"{k}: not a field of {contract}" for k in document if k not in known]
    for name, (kind, needed) in known.items():
        if name not in document:
            out += [f"{name}: missing"] if needed else []
        elif not isinstance(document[name], kind) or isinstance(document[name], bool):
            out.append(f"{name}: not of the right type")
    return sorted(out)


def load(start: str | Path) -> Project:
    """The project at or above ``start``, with what its files violate. Unfinished authors are a code of their own."""
    root = find_root(start)
    paper, authors = structured(root / PAPER) or {}, structured(root / AUTHORS)
    found = [("schema-violation", x, PAPER) for x in violations(paper, "paper")]
    if authors is not None:
        found += [("authors-incomplete", x, AUTHORS) for x in violations(authors, "authors")]
    return Project(root, paper if isinstance(paper, dict) else {}, authors if isinstance(authors, dict) else None, tuple(found))


def numbered_files(folder: Path, stem: str) -> list[tuple[int, Path]]:
    """``stem-N.yaml`` files by number; names without a number are skipped."""
    found = [(p.stem.removeprefix(f"{stem}-"), p) for p in folder.glob(f"{stem}-*.yaml")] if folder.is_dir() else []
    return sorted((int(n), p) for n, p in found if n.isdecimal())


def next_number(folder: Path, stem: str) -> int:
    return max((n for n, _ in numbered_files(folder, stem)), default=0) + 1


def profile(name: str, folders: list[Path]) -> Path | None:
    """The first file of a profile in folders in order of precedence, so a project's own hides a shipped one."""
    return next((f / f"{name}{s}" for f in folders for s in (".yaml", ".json") if (f / f"{name}{s}").is_file()), None)


def expanded(paths: list[str | Path], suffixes: tuple[str, ...]) -> list[Path]:
    """Folders as the files of those suffixes in them, files as they are; sorted, each once."""
    out: dict[Path, None] = {}
    for p in map(Path, paths):
        for x in sorted(q for q in p.rglob("*") if q.suffix.lower() in suffixes) if p.is_dir() else [p]:
            out[x] = None
    return list(out)


def own_rules(paper: dict) -> tuple[tuple[Rule, ...], tuple[str, ...]]:
    """The shipped rules and terms with the project's own behind them; its rules are named ``project:``."""
    more = tuple(
        Rule("convention", f"project:{c.get('id') or c['pattern'][:24]}", c["pattern"])
        for c in paper.get("conventions", []) if isinstance(c, dict) and "pattern" in c
    )
    return (*RULES, *more), (*T.TERMS, *paper.get("terms", []))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def namespace(spark: SparkSession, project: Project) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``values`` of results and literature under ``results.`` and ``lit.``, the results' table cells, and findings.

    Of fragments the first by name owns a key; of literature the ledger does before attested values.
    """
    found: list[DataFrame] = []
    folder = project.folder("results")
    null = F.lit(None).cast("string")
    if folder.is_dir() and any(folder.glob("*.json")):
        parsed = S.fragments(spark, str(folder)).cache()
        values, late = S.values_of(parsed)
        cells = S.cells_of(parsed)
        found.append(G.fragments_gate(parsed, late))
    else:
        code = "no-results" if folder.is_dir() else "no-results-dir"
        found.append(spark.createDataFrame([("G0", code, "fail", f"no fragments in {folder.name}", str(folder), None, None)], FINDINGS))
        values, cells = empty(spark, VALUES), empty(spark, "table_key string, row int, col int, text string, template string, parts array<string>, is_codes boolean")
    entries = []
    for priority, name in enumerate(("ledger.yaml", "attested.yaml")):
        if (project.folder("literature") / name).is_file():
            entries.append(S.ledger(spark, str(project.folder("literature")), name).withColumn("_p", F.lit(priority)).withColumn("source", F.lit(name)))
    if entries:
        every = reduce(DataFrame.unionByName, entries).withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy("_p")))
        lit = every.filter("_rn = 1").select(
            F.concat(F.lit("lit."), "key").alias("ref"), F.lit("lit").alias("ns"), "key", F.when(F.col("_p") == 0, "literature").otherwise("attested").alias("origin"),
            F.col("value").alias("value_text"), F.expr("try_cast(value as double)").alias("value_double"), F.lit("STRING").alias("value_type"), F.coalesce("display", "value").alias("display"),
            F.lit(None).cast("int").alias("digits"), null.alias("unit"), F.lit(True).alias("quoted"), F.lit(False).alias("label"),
            null.alias("same_as"), null.alias("bounds"), null.alias("bound"), null.alias("level"), "source",
        )
        values = values.unionByName(lit)
        found.append(G.finding(every.filter("_rn > 1"), "G0", "duplicate-key", "fail", F.concat(F.lit("lit."), "key"), "source"))
    return values, cells, G.together(*found)


def guarded(spark: SparkSession, gate: str, run: Callable[[], DataFrame]) -> DataFrame:
    """A gate's findings; a gate that can't run is a finding that no stage defers, and never silent."""
    try:
        found = run()
        found.schema  # noqa: B018  (analysis errors come here)
        return found
    except Exception as e:  # noqa: BLE001
        return spark.createDataFrame([(gate, "gate-errored", "fail", f"{type(e).__name__}: {str(e).splitlines()[0][:200]}", None, None, None)], FINDINGS)


@dataclass(frozen=True)
class Checked:
    findings: DataFrame
    counts: DataFrame
    deferred: DataFrame
    stage: str


def merged_counts(*counts: DataFrame) -> DataFrame:
    """Counters (``name, value``) of several reports, summed by name."""
    return reduce(DataFrame.unionByName, counts).groupBy("name").agg(F.sum("value").alias("value"))


def check(spark: SparkSession, start: str | Path, stage: str | None = None, today: str = "1970-01-01") -> Checked:
    """All gates over the project at ``start``: findings in reading order with ``n``, counters, and what is deferred."""
    project = load(start)
    here = stage or project.paper.get("stage") or "drafting"
    values, cells, loading = namespace(spark, project)
    folder = project.folder("manuscript")
    docs = S.markdown(spark, str(folder)) if folder.is_dir() else empty(spark, "path string, text string, is_supplementary boolean")
    rules, terms = own_rules(project.paper)
    analysis = analysed_documents(docs, rules=rules, terms=terms).cache()
    atoms = rows(analysis, "atoms", "path")
    masked = analysis.select("path", F.col("parts.masked").alias("text"))
    guidelines = project.paper.get("reporting_guideline") or []
    declared = spark.createDataFrame([(g,) for g in ([guidelines] if isinstance(guidelines, str) else guidelines)], "guideline string")
    journal = structured(profile(project.paper["journal"], [project.root / "journals"]) or Path("-")) if project.paper.get("journal") else None
    bib = project.root / project.paper.get("bibliography", "references.bib")
    plans: list[tuple[str, Callable[[], DataFrame]]] = [
        ("G2", lambda: G.numbers(analysis, values, cells if cells.columns else None)),
        ("G2", lambda: G.together(G.intervals(values), G.interval_order(analysis, values), M.project_exemptions(atoms))),
        ("G2", lambda: G.table_cells(cells, values)),
        ("G5", lambda: M.guideline_claims(masked, declared)),
        ("G6", lambda: G.lint(docs, analysis, spark)),
        ("G8", lambda: G.consistency(values)),
    ]
    if bib.is_file():
        keys = S.texts(spark, str(bib.parent), bib.name, recursive=False).select(F.explode(S.bib_keys(F.col("text"))).alias("citekey"))
        plans.append(("G7", lambda: G.citations(analysis, keys)))
    if journal:
        limits = spark.createDataFrame([(k, float(v)) for k, v in (journal.get("limits") or {}).items()], "name string, most double")
        plans.append(("G4", lambda: G.journal(M.journal_counts(docs), limits, journal.get("retrieved_on"), today)))
    lock = project.root / "methods.lock"
    if lock.is_file() and project.folder("analysis").is_dir():
        recorded = spark.createDataFrame(list((structured(lock.with_suffix(".json")) or json.loads(lock.read_text()))["files"].items()), "path string, sha256 string")
        current = relative(S.digests(spark, str(project.folder("analysis"))), project.folder("analysis"))
        plans.append(("G9", lambda: G.methods(recorded, current)))
    own = spark.createDataFrame([("G0", code, "fail", message, path, None, None) for code, message, path in project.problems], FINDINGS)
    found = G.together(own, loading, *(guarded(spark, name, run) for name, run in plans))
    staged = G.staged(found, here).cache()
    deferred = staged.filter("due is not null").groupBy("due").agg(F.count(F.lit(1)).alias("n"))
    kinds = atoms.groupBy(F.concat(F.lit("atoms_"), "kind").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    totals = docs.agg(F.count(F.lit(1)).alias("files")).unpivot([], ["files"], "name", "value")
    bound = rows(analysis, "bindings", "path").agg(F.count_if("well_formed").alias("placeholders")).unpivot([], ["placeholders"], "name", "value")
    return Checked(G.report(staged), merged_counts(kinds, totals, bound), deferred, here)


def relative(digests: DataFrame, folder: Path) -> DataFrame:
    """Digests with paths inside ``folder``."""
    return digests.withColumn("path", F.regexp_replace("path", rf"^.*?/{folder.name}/", ""))


def deferral_text(deferred: DataFrame) -> DataFrame:
    """``text``: how many findings aren't due yet, by the stages when they are, in order."""
    part = F.concat(F.col("n").cast("string"), F.lit(" at "), "due")
    listed = deferred.agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(A.stage_rank(F.col("due")).alias("k"), part.alias("t")))).alias("parts"))
    many = F.when(F.col("n") == 1, "1 finding").otherwise(F.concat(F.col("n").cast("string"), F.lit(" findings")))
    return listed.select(F.when(F.col("n") > 0, F.concat(many, F.lit(" not due yet: "), F.array_join(F.transform("parts", lambda x: x["t"]), "; "))).otherwise("").alias("text"))


def main_first(path: Column) -> list[Column]:
    """The order of a manuscript's files: the main one, then by name."""
    return [F.when(F.element_at(F.split(path, "/"), -1) == "main.md", 0).otherwise(1), path]


def status_line(found: DataFrame) -> DataFrame:
    """``text``: one line on how a project stands, for an editor's start."""
    n = lambda s: F.count_if(F.col("severity") == s)
    sums = found.agg(n("fail").alias("f"), n("warn").alias("w"), n("info").alias("i"))
    return sums.select(F.when(F.col("f") > 0, F.format_string("%d to mend, %d warnings, %d notes", "f", "w", "i")).otherwise(F.format_string("passes, %d warnings, %d notes", "w", "i")).alias("text"))
