"""Writers of what a project keeps: locks, panels, review records, revision rounds, manifests of rendered figures."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.plans.project import next_number, numbered_files, structured
from claimtrace.sources.files import UnsafeDocument, safe_xml

#: Formats of one figure, the one that is read first.
PREFERENCE = ("svg", "pdf", "png", "jpg", "jpeg", "tiff")
RASTER = ("png", "jpg", "jpeg", "tiff")


class Exists(FileExistsError):
    """A record that was written before; records are never overwritten."""


def _yaml(document: dict) -> str:
    import yaml

    return yaml.safe_dump(document, sort_keys=False, allow_unicode=True)


def write_new(path: Path, document: dict) -> Path:
    """A YAML file that must not be there yet."""
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        with open(path, "x", encoding="utf-8", newline="\n") as f:
            f.write(_yaml(document))
    except FileExistsError as e:
        raise Exists(str(path)) from e
    return path


def write_lock(path: Path, digests: DataFrame) -> Path:
    """Digests of the analysis (``path, sha256``), to which later ones are compared; a new lock takes the old one's place."""
    files = {r["path"]: r["sha256"] for r in digests.orderBy("path").toLocalIterator()}
    path.write_text(json.dumps({"files": files}, indent=2) + "\n", encoding="utf-8")
    return path


def write_panel(folder: Path, reviewers: list[str], remits: dict[str, str] | None = None) -> Path:
    """The next panel. A reviewer without a remit keeps the one of the latest panel that they were in."""
    number, given = next_number(folder, "panel"), remits or {}
    earlier: dict[str, str] = {}
    for _, p in numbered_files(folder, "panel"):
        for r in (structured(p) or {}).get("reviewers") or []:
            if r.get("remit"):
                earlier[r["id"]] = r["remit"]
    listed = [{"id": r, "remit": given.get(r) or earlier.get(r, "")} for r in reviewers]
    return write_new(folder / f"panel-{number}.yaml", {"round": number, "reviewers": listed})


def write_record(folder: Path, number: int, reviewer: str, read: dict[str, str], findings: list[dict]) -> Path:
    """One reviewer's record of a round: what they read, by digest, and what they found."""
    name = re.sub(r"[^A-Za-z0-9_.-]", "_", reviewer)
    return write_new(folder / f"round-{number}-{name}.yaml", {"round": number, "reviewer": reviewer, "file_sha256": dict(sorted(read.items())), "findings": findings})


def write_round(folder: Path, points: list[dict]) -> Path:
    """The next revision round with its points."""
    number = next_number(folder, "round")
    return write_new(folder / f"round-{number}.yaml", {"round": number, "points": points})


def write_manifest(script: Path, outputs: list[Path]) -> Path:
    """What a script rendered: digests of all formats of one figure, beside them."""
    stems = {p.stem for p in outputs}
    if len(stems) != 1:
        raise ValueError("a manifest is of one figure in several formats")
    lost = [p.name for p in outputs if not p.is_file()]
    if lost:
        raise FileNotFoundError(", ".join(lost))
    text = script.read_bytes().replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    shown = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(outputs)}
    path = outputs[0].with_name(f"{outputs[0].stem}.render.json")
    path.write_text(json.dumps({"rendered_by": script.name, "rendered_by_sha256": hashlib.sha256(text).hexdigest(), "outputs": shown}, indent=2) + "\n", encoding="utf-8")
    return path


def drawing_digest(data: bytes) -> str:
    """The digest of a drawing's content: without metadata, and with ids numbered in the order of the document, since
    renderers name them at random. Data that isn't a drawing is hashed as it is."""
    try:
        root = safe_xml(data)
    except (ElementTree.ParseError, UnsafeDocument):
        return hashlib.sha256(data).hexdigest()
    for parent in list(root.iter()):
        for child in [c for c in parent if c.tag.rsplit("}", 1)[-1] == "metadata"]:
            parent.remove(child)
    names: dict[str, str] = {}
    for e in root.iter():
        if "id" in e.attrib:
            e.set("id", names.setdefault(e.attrib["id"], f"n{len(names)}"))
    for e in root.iter():
        for k, v in e.attrib.items():
            if k != "id" and "#" in v:
                e.set(k, re.sub(r"#([\w.:-]+)", lambda m: "#" + names.get(m[1], m[1]), v))
    return hashlib.sha256(ElementTree.tostring(root)).hexdigest()


def _digest(path: Column, content: Column) -> Column:
    @F.pandas_udf("string")
    def one(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([drawing_digest(c) if p.lower().endswith(".svg") else hashlib.sha256(c).hexdigest() for p, c in zip(paths, contents, strict=True)], dtype=object)

    return one(path, content)


def figure_digests(binaries: DataFrame) -> DataFrame:
    """``dir, stem, sha256, n_formats, shown``: of all formats of a figure (``path, content``) the content as one digest,
    in order of file names; and the format that is read first."""
    name = F.element_at(F.split("path", "/"), -1)
    stem, kind = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rank = F.array_position(F.array(*map(F.lit, PREFERENCE)), kind)
    known = binaries.select(F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), stem.alias("stem"), name.alias("name"), rank.alias("rank"), _digest(F.col("path"), F.col("content")).alias("h")).filter("rank > 0")
    ordered = F.array_sort(F.collect_list(F.struct("name", "h")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat(x["name"], F.lit("\0"), x["h"])), "\n")
    return known.groupBy("dir", "stem").agg(F.sha2(text, 256).alias("sha256"), F.count(F.lit(1)).alias("n_formats"), F.min_by("name", F.struct("rank", "name")).alias("shown"))


def unproven_rasters(digests: DataFrame, manifests: DataFrame) -> DataFrame:
    """Pictures without text layer (``path, sha256``) of which no manifest (``dir, stem, outputs`` map of names to
    digests) proves that they were rendered with a drawing beside them: ``path, state``."""
    name = F.element_at(F.split("path", "/"), -1)
    files = digests.select("path", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("kind"), "sha256")
    raster, vector = files.filter(F.col("kind").isin(*RASTER)), files.filter("kind = 'svg'")
    proven = files.join(manifests, ["dir", "stem"]).withColumn("_same", F.try_element_at("outputs", F.col("name")).eqNullSafe(F.col("sha256")))
    proven = proven.filter(F.col("kind").isin("svg", *RASTER)).groupBy("dir", "stem").agg(F.bool_and("_same").alias("_all"))
    state = F.when(F.col("_v").isNull(), "no vector").when(F.col("_all").isNull(), "no manifest").when(~F.col("_all"), "differs").otherwise("proven")
    both = raster.join(vector.select("dir", "stem", F.lit(True).alias("_v")).distinct(), ["dir", "stem"], "left").join(proven, ["dir", "stem"], "left")
    return both.select("path", state.alias("state"))


def cited_keys(cited: DataFrame) -> DataFrame:
    """The keys that a bibliography has to hold: each cited one once, in order."""
    return cited.select("citekey").distinct().orderBy("citekey")


#: What a new project starts with.
SCAFFOLD = {
    "paper.yaml": "title: ''\nstage: design\n",
    "authors.yaml": "authors: []\naffiliations: []\n",
    "manuscript/main.md": "# Introduction\n\n# Methods\n\n# Results\n",
    "literature/ledger.yaml": "entries: []\n",
    "results/.keep": "",
    "analysis/.keep": "",
    "figures/.keep": "",
}


def scaffold(folder: Path) -> list[Path]:
    """A new project's files; those that are there already stay as they are. Returns what was written."""
    written = []
    for name, text in SCAFFOLD.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        if not path.exists():
            path.write_text(text, encoding="utf-8")
            written.append(path)
    return written
