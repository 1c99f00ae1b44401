"""What a submission says of its authors, and the manifest of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The CRediT roles, in the order of the taxonomy.
ROLES = [
    "Conceptualization", "Data curation", "Formal analysis", "Funding acquisition", "Investigation", "Methodology", "Project administration",
    "Resources", "Software", "Supervision", "Validation", "Visualization", "Writing – original draft", "Writing – review & editing",
]


def initials(given: str = "given", family: str = "family"):
    parts = F.filter(F.split(F.regexp_replace(given, "-", " "), r"\s+"), lambda p: p != "")
    return F.concat(F.array_join(F.transform(parts, lambda p: F.concat(F.substring(p, 1, 1), F.lit("."))), ""), F.substring(family, 1, 1), F.lit("."))


def credits(authors: DataFrame, roles: list[str] | None = None) -> DataFrame:
    """``role, authors`` in the order of ``roles``, others after them by name; ``authors``: place, given, family, credit."""
    known = F.array(*map(F.lit, ROLES if roles is None else roles))
    each = authors.select("place", initials().alias("who"), F.explode("credit").alias("role"))
    of = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "who"))), lambda x: x["who"]), ", ")
    at = F.array_position(known, F.col("role"))
    return each.groupBy("role").agg(of.alias("authors")).orderBy(F.when(at == 0, 1 << 30).otherwise(at), "role")


def superscripts(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """``place, marks, addresses`` of each author: numbers and texts of affiliations (``id, place, text``), in the order
    in which the author names them; unknown ones are left out."""
    numbered = affiliations.select(F.col("id").alias("affiliation"), F.row_number().over(Window.orderBy("place")).alias("n"), "text")
    named = authors.select("place", F.posexplode_outer("affiliations").alias("k", "affiliation")).join(F.broadcast(numbered), "affiliation", "left")
    found = F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("k", "n", "text"))))
    return named.groupBy("place").agg(F.array_join(F.transform(found, lambda x: x["n"].cast("string")), ",").alias("marks"), F.transform(found, lambda x: x["text"]).alias("addresses"))


def manifest(files: DataFrame) -> DataFrame:
    """``file, bytes, sha256`` of ``files`` as ``binaryFile`` reads them, by name."""
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("file")
