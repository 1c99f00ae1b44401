"""Readers of project files as DataFrames, and writers. Paths may be of any file system that Spark reads."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimtrace.functions.display import repr_number
from claimtrace.functions.expressions import normalise_text, strip_html, without_opaque
from claimtrace.schemas import FRAGMENT

#: Archives and parts that are larger, or that unpack by more, aren't read.
MOST_ARCHIVE, MOST_PART, MOST_RATIO = 80 << 20, 120 << 20, 200
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class UnsafeDocument(ValueError):
    """A file that could exhaust its reader, or that defines entities."""


def texts(spark: SparkSession, folder: str, glob: str, recursive: bool = True) -> DataFrame:
    """``path, text`` of whole files; parts of paths that begin with a point or an underscore are left out."""
    reader = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    rows = reader.load(folder).select(F.col("_metadata.file_path").alias("full"), F.col("value").alias("text"))
    inside = F.regexp_replace("full", f"^.*?{re.escape(folder.rstrip('/').split('://')[-1].split('/')[-1])}/", "")
    rows = rows.select(inside.alias("path"), "text")
    return rows.filter(~F.exists(F.split("path", "/"), lambda p: p.rlike("^[._]")))


def is_supplementary(path: Column) -> Column:
    """In the folder of supplements; a file of that name isn't."""
    parts = F.split(path, "/")
    return (F.get(parts, F.lit(0)) == "supplementary") & (F.size(parts) > 1)


def markdown(spark: SparkSession, folder: str, main_only: bool = False) -> DataFrame:
    docs = texts(spark, folder, "*.md").withColumn("is_supplementary", is_supplementary(F.col("path")))
    return docs.filter("not is_supplementary") if main_only else docs


def fragments(spark: SparkSession, folder: str) -> DataFrame:
    """Result fragments, parsed; ``ok`` is false for files that aren't JSON objects of that form."""
    rows = texts(spark, folder, "*.json", recursive=False)
    return rows.withColumn("doc", F.from_json("text", FRAGMENT)).withColumn("ok", F.col("doc.values").isNotNull() | F.col("doc.tables").isNotNull())


def values_of(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Values of all fragments by key, the first file by name owning each; and the rows of files that come too late."""
    every = found.filter("ok").select("path", F.explode("doc.values").alias("key", "v"))
    every = every.withColumn("_rn", F.row_number().over(Window.partitionBy("key").orderBy("path")))
    text = F.to_json("v.value")
    kind = F.schema_of_variant("v.value")
    rows = every.filter("_rn = 1").select(
        F.concat(F.lit("results."), F.col("key")).alias("ref"), F.lit("results").alias("ns"), "key", F.lit("results").alias("origin"),
        text.alias("value_text"), F.expr("try_variant_get(v.value, '$', 'double')").alias("value_double"), kind.alias("value_type"),
        "v.display", "v.digits", "v.unit", F.coalesce("v.quoted", F.lit(True)).alias("quoted"), F.coalesce("v.label", F.lit(False)).alias("label"),
        "v.same_as", "v.bounds", "v.bound", "v.level", F.col("path").alias("source"),
    )
    return rows, every.filter("_rn > 1").select("key", "path")


def cells_of(found: DataFrame) -> DataFrame:
    """Emitted tables cell by cell: row -2 is the header, -1 the caption; the last composition of a cell counts."""
    tables = found.filter("ok").select("path", F.explode("doc.tables").alias("table_key", "t"))
    tables = tables.withColumn("_rn", F.row_number().over(Window.partitionBy("table_key").orderBy("path"))).filter("_rn = 1")
    head = tables.select("table_key", F.lit(-2).alias("row"), F.posexplode("t.columns").alias("col", "text"))
    note = tables.filter("t.caption is not null").select("table_key", F.lit(-1).alias("row"), F.lit(0).alias("col"), F.col("t.caption").alias("text"))
    body = tables.select("table_key", F.posexplode("t.rows").alias("row", "_cells")).select("table_key", "row", F.posexplode("_cells").alias("col", "text"))
    made = tables.select("table_key", F.posexplode("t.composed").alias("_i", "c")).select("table_key", F.col("c.row").alias("row"), F.col("c.column").alias("col"), "c.template", "c.parts", F.coalesce("c.codes", F.lit(False)).alias("is_codes"), "_i")
    made = made.withColumn("_rn", F.row_number().over(Window.partitionBy("table_key", "row", "col").orderBy(F.desc("_i")))).filter("_rn = 1").drop("_rn", "_i")
    return head.unionByName(note).unionByName(body).join(made, ["table_key", "row", "col"], "left")


def yaml_json(text: Column) -> Column:
    """YAML as JSON text, dates as their ISO strings; null where it can't be read."""

    @F.pandas_udf("string")
    def convert(rows: pd.Series) -> pd.Series:
        import yaml

        def one(x: str | None) -> str | None:
            try:
                return None if x is None else json.dumps(yaml.safe_load(x), default=str, ensure_ascii=False)
            except yaml.YAMLError:
                return None

        return pd.Series([one(x) for x in rows], dtype=object)

    return convert(text)


LEDGER = "entries array<struct<key:string,value:string,display:string,citekey:string,depth:string,source_file:string,quote:string,statement:string,attested_by:string>>"


def ledger(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = texts(spark, folder, name)
    return rows.select(F.inline(F.from_json(yaml_json(F.col("text")), LEDGER)["entries"]))


def bib_keys(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^@\w+\s*\{\s*([^,\s]+)"), F.lit(1))


def safe_xml(data: bytes) -> ElementTree.Element:
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", data[:8192], re.I):
        raise UnsafeDocument("a document type or entity")
    return ElementTree.fromstring(data)


def zip_part(data: bytes, name: str) -> bytes | None:
    if len(data) > MOST_ARCHIVE:
        raise UnsafeDocument("too large an archive")
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if name not in z.namelist():
            return None
        info = z.getinfo(name)
        if info.file_size > MOST_PART or info.file_size > MOST_RATIO * max(1, info.compress_size):
            raise UnsafeDocument("a part that unpacks too far")
        return z.read(name)


def docx_text(data: bytes) -> str:
    """Paragraphs as lines, cells behind bars; what is marked as deleted is left out."""
    out = []

    def walk(node: ElementTree.Element) -> None:
        if node.tag == W + "del":
            return
        if node.tag == W + "t":
            out.append(node.text or "")
        elif node.tag == W + "tab":
            out.append("\t")
        for x in node:
            walk(x)
        if node.tag == W + "tc":
            out.append(" | ")
        elif node.tag in (W + "p", W + "tr"):
            out.append("\n")

    for part in ("document", "footnotes", "endnotes"):
        if raw := zip_part(data, f"word/{part}.xml"):
            walk(safe_xml(raw))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(out)))


def docx_tables(data: bytes) -> list[list[list[str]]]:
    """Tables as rows of cell texts, without empty rows."""
    root = safe_xml(zip_part(data, "word/document.xml") or b"<x/>")
    cell = lambda c: " ".join("".join(t.text or "" for t in p.iter(W + "t")) for p in c.iter(W + "p")).strip()
    tables = [[[cell(c) for c in r.iter(W + "tc")] for r in t.iter(W + "tr")] for t in root.iter(W + "tbl")]
    return [[r for r in t if any(r)] for t in tables]


def docx_paragraphs(data: bytes, prefix: str = "ct-p-") -> list[tuple[str, str]]:
    """Identifier and text of each paragraph with a bookmark of that prefix, in the order of the document."""
    out = []
    for p in safe_xml(zip_part(data, "word/document.xml") or b"<x/>").iter(W + "p"):
        names = [n for b in p.iter(W + "bookmarkStart") if (n := b.get(W + "name", "")).startswith(prefix)]
        if names:
            out.append((names[0], " ".join("".join(t.text or "" for t in p.iter(W + "t")).split())))
    return out


def docx_comments(data: bytes, prefix: str = "ct-p-") -> list[tuple[str, str, str, str]]:
    """Author, day, text and paragraph of each comment that says something."""
    raw, where = zip_part(data, "word/comments.xml"), {}
    if raw is None:
        return []
    for p in safe_xml(zip_part(data, "word/document.xml") or b"<x/>").iter(W + "p"):
        for name in [n for b in p.iter(W + "bookmarkStart") if (n := b.get(W + "name", "")).startswith(prefix)][:1]:
            where |= {c.get(W + "id"): name for c in p.iter(W + "commentRangeStart")}
    said = ((c, " ".join(" ".join(t.text or "" for t in c.iter(W + "t")).split())) for c in safe_xml(raw).iter(W + "comment"))
    return [(c.get(W + "author") or "an unnamed reviewer", c.get(W + "date", "")[:10], text, where.get(c.get(W + "id"), "")) for c, text in said if text]


def svg_text(data: bytes) -> str:
    """The text layer of a drawing, without titles, descriptions and metadata."""
    out = []

    def walk(node: ElementTree.Element) -> None:
        if node.tag.rsplit("}", 1)[-1] in ("metadata", "desc", "title"):
            return
        if (node.text or "").strip():
            out.append(node.text.strip())
        for x in node:
            walk(x)

    walk(safe_xml(data))
    return "\n".join(out)


def binary_text(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``path, text, error`` of office documents and drawings. Files over the limit are rows with an error, unread."""
    every = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    rows = every.filter(F.col("length") <= MOST_ARCHIVE)
    large = every.filter(F.col("length") > MOST_ARCHIVE).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("UnsafeDocument: of "), F.col("length").cast("string"), F.lit(" bytes")).alias("error"))

    @F.pandas_udf("text string, error string")
    def read(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
        def one(path: str, data: bytes) -> tuple[str | None, str | None]:
            try:
                return (svg_text(data) if path.lower().endswith(".svg") else docx_text(data)), None
            except (UnsafeDocument, ElementTree.ParseError, zipfile.BadZipFile) as e:
                return None, f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(p, c) for p, c in zip(paths, contents, strict=True)], columns=["text", "error"])

    return rows.select("path", read("path", "content").alias("r")).select("path", "r.*").unionByName(large)


def digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, sha256, bytes``: the state of files now, or a manifest."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def page_text(html: Column) -> Column:
    return strip_html(html)


def backing_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct canonical numbers of output files: what a claim can be backed by."""

    @F.pandas_udf("array<string>")
    def canonical(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in rows:
            yield pd.Series([sorted({repr_number(x) for x in found}) for found in batch], dtype=object)

    found = F.regexp_extract_all(without_opaque(F.col(text)), F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+"), F.lit(0))
    return docs.select(F.explode(canonical(found)).alias("number")).distinct()


def csv_text(text: str, delimiter: str = ",") -> str:
    return "\n".join(" ".join(r) for r in csv.reader(io.StringIO(text), delimiter=delimiter))


def findings_json(findings: DataFrame) -> str:
    """Findings as JSON, failures first, then by place. A report is small; it is made on the driver."""
    rank = F.expr("array_position(array('fail','warn','info'), severity)")
    rows = findings.orderBy(rank, "path", F.coalesce("line", F.lit(0)), "code", "message").collect()
    return json.dumps([r.asDict() for r in rows], indent=2)


def csv_rows(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A table with a header line; all columns are text, since what looks like a number may be a code."""
    return spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def source_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``source_file, text, error`` of stored sources: text as it is, pages without their markup, both folded; of PDF files
    an error, since no reader of theirs is at hand."""
    plain = texts(spark, folder, "*.{txt,md,csv,tsv,json,yaml,yml}").select(F.col("path").alias("source_file"), normalise_text(F.col("text")).alias("text"))
    pages = texts(spark, folder, "*.{html,htm}").select(F.col("path").alias("source_file"), normalise_text(strip_html(F.col("text"))).alias("text"))
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder)
    unread = names.select(F.element_at(F.split("path", "/"), -1).alias("source_file"), F.lit(None).cast("string").alias("text"), F.lit("source-unreadable").alias("error"))
    return plain.unionByName(pages).withColumn("error", F.lit(None).cast("string")).unionByName(unread)
