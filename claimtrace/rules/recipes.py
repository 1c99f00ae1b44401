"""Where the checklists of reporting guidelines have what: fixed values, since the documents are as their authors publish them."""

from __future__ import annotations

from dataclasses import dataclass

from claimtrace.plans.checklists import Recipe


@dataclass(frozen=True)
class Checklist:
    """A published checklist: the file it is read from, that file's digest, and its columns. ``tables`` are the numbers of
    the tables that hold items (all if empty); ``split`` is the character at which the pages of a PDF are cut."""

    name: str
    long_name: str
    version: str
    document: str
    sha256: str
    recipe: Recipe
    tables: tuple[int, ...] = ()
    pages: tuple[int, ...] = ()
    split: int | None = None


# Fixed values.
CHECKLISTS: tuple[Checklist, ...] = (
    Checklist(
        "ARRIVE-2.0",
        "Animal Research: Reporting of In Vivo Experiments",
        "2.0",
        "ARRIVE guidelines 2.0 - English.pdf",
        "64a8f03f02496eac7eed4ba2b587ad8b9365670b946eb167bc68da5703d6c604",
        Recipe(text_column=0, min_text_words=3),
        pages=(2,),
        split=121,
    ),
    Checklist(
        "CONSORT",
        "Consolidated Standards of Reporting Trials",
        "2025",
        "consort-checklist.docx",
        "b2cd676aa96bdf4e7e4bfeace5265587ea6c834da71abe9954abab591b1d1fb0",
        Recipe(text_column=2, topic_column=0, id_column=1, min_text_words=3),
    ),
    Checklist(
        "PRISMA-2020-abstracts",
        "PRISMA 2020 for Abstracts",
        "2020",
        "PRISMA_2020_abstract_checklist.docx",
        "4ec17f0b1fba60abba353c86b568fc3c31c9146ab32e46c45a8dec329ff2f7d3",
        Recipe(text_column=2, topic_column=0, id_column=1, min_text_words=3),
    ),
    Checklist(
        "PRISMA-2020",
        "Preferred Reporting Items for Systematic reviews and Meta-Analyses",
        "2020",
        "PRISMA_2020_checklist.docx",
        "fba382ec9fa4b5594697444c3ee555f805c86a3d1093d4633f25a7653ad60e5e",
        Recipe(text_column=2, topic_column=0, id_column=1, min_text_words=3),
    ),
    Checklist(
        "READUS-PV-abstracts",
        "READUS-PV for Abstracts",
        "",
        "readus-checklist-for-abstract.docx",
        "2207702fd16f22a178785d055ead92733b321ad9e7ed2570e5e66781ac191e71",
        Recipe(text_column=2, topic_column=0, id_column=1, min_text_words=3),
    ),
    Checklist(
        "READUS-PV",
        "REporting of A Disproportionality analysis for drUg Safety signal detection using individual case safety reports in PharmacoVigilance",
        "",
        "readus-checklist.docx",
        "c244f2aab6eef37ceeb66f4002cc3bcbf881784f51e66210b07ad63b27d13b7f",
        Recipe(text_column=2, topic_column=0, id_column=1, min_text_words=3),
    ),
    Checklist(
        "RECORD-PE",
        "RECORD for PharmacoEpidemiological research",
        "",
        "RECORD-PE Checklist.docx",
        "17d4655f266591a3ad31c6c9ac6f9607c14c890fca8235389d6913c409acebcb",
        Recipe(text_column=3, named_id=True, min_text_words=3),
    ),
    Checklist(
        "RECORD",
        "REporting of studies Conducted using Observational Routinely-collected health Data",
        "",
        "RECORD Checklist.docx",
        "451fb94f87f4e266abf6018bf1ca7204730ecf30d257fd7edbd2e1a0d711a53c",
        Recipe(text_column=4, topic_column=0, named_id=True, min_text_words=3),
    ),
    Checklist(
        "SPIRIT-2025",
        "Standard Protocol Items: Recommendations for Interventional Trials",
        "2025",
        "SPIRIT 2025 editable checklist.docx",
        "9159179d53b65f2615135c554e661d40259eedb2d61318c890617f4a49bd1f2d",
        Recipe(text_column=2, topic_column=0, id_column=1, min_text_words=3),
    ),
    Checklist(
        "STROBE",
        "Strengthening the Reporting of Observational Studies in Epidemiology",
        "v4 (combined, as published in PLoS Medicine)",
        "STROBE-checklist-v4-combined-PlosMedicine.docx",
        "e1ceb763627c1a162eece448db6f0df8a4446ff03990e44e0514a14545cb5801",
        Recipe(text_column=2, topic_column=0, id_column=1, carry_id=True, subitem_letters=True, min_text_words=3),
    ),
    Checklist(
        "TRIPOD-development-validation",
        "TRIPOD checklist for prediction model development and validation",
        "2015",
        "Tripod-Checklist-Prediction-Model-Development-and-Validation-Word.docx",
        "1a775fa0e42eac38f91471add2b553c405d8c3d287fb87b99bb0ed1cd2415b97",
        Recipe(text_column=3, topic_column=0, id_column=1, min_text_words=3),
    ),
    Checklist(
        "TRIPOD-development",
        "Transparent Reporting of a multivariable prediction model for Individual Prognosis Or Diagnosis",
        "2015",
        "Tripod-Checlist-Prediction-Model-Development-Word.docx",
        "1a4bfae2260ffab0d229ea9a1354ca3f00d426d5d296800a734b0393b863db8b",
        Recipe(text_column=2, topic_column=0, id_column=1, min_text_words=3),
    ),
    Checklist(
        "TRIPOD-validation",
        "TRIPOD checklist for prediction model validation",
        "2015",
        "Tripod-Checklist-Prediction-Model-Validation-Word.docx",
        "e24213e230e2aabf21be8e56f3d39e5ab0befc65ce88bc0a58500fead2413784",
        Recipe(text_column=2, topic_column=0, id_column=1, min_text_words=3),
    ),
)


def checklist(name: str) -> Checklist:
    """The checklist of a guideline, by any case."""
    return next(c for c in CHECKLISTS if c.name.lower() == name.lower())
