"""Column expressions for accession identifiers and cell texts of result files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifier patterns, anchored at the start only.
UNIPROT = r"^[A-Z][A-Z0-9]{5}(?:[A-Z0-9]{4})?(?:[-_][-0-9]+)?"
ENSEMBL_PEPTIDE = r"^ENSP\d{11}"
REFSEQ_PEPTIDE = r"^NP_\d{6,}"
REFSEQ_PREDICTED = r"^XP_\d{9}"

# Words that mean "missing" in a text cell of a result file.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]

CONTAMINANT_PREFIX = "CON__"


def _found(identifier: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(identifier, pattern, 0), F.lit(""))


def recognised(identifier: Column) -> Column:
    """The valid part of one identifier, or null."""
    uniprot = F.when(~F.startswith(identifier, F.lit("ENSP")), _found(identifier, UNIPROT))
    others = [_found(identifier, p) for p in (ENSEMBL_PEPTIDE, REFSEQ_PEPTIDE, REFSEQ_PREDICTED)]
    return F.coalesce(uniprot, *others)


def valid_members(group: Column) -> Column:
    """The valid parts of a ``;`` group, in order."""
    return F.filter(F.transform(F.split(group, ";"), recognised), lambda i: i.isNotNull())


def rejected_members(group: Column) -> Column:
    """The members of a ``;`` group that hold no valid identifier."""
    return F.filter(F.split(group, ";"), lambda i: recognised(i).isNull())


def first_member(group: Column) -> Column:
    """The first valid identifier of a group, or an empty text."""
    return F.coalesce(F.get(valid_members(group), F.lit(0)), F.lit(""))


def is_contaminant(group: Column) -> Column:
    """True when any member carries the contaminant prefix."""
    return F.exists(F.split(group, ";"), lambda i: F.startswith(i, F.lit(CONTAMINANT_PREFIX)))


def number_cell(cell: Column) -> Column:
    """A number read from a result file: text that is no number, NaN and zero are missing."""
    x = cell.try_cast("double")
    return F.nullif(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))


def text_cell(cell: Column, *more: str) -> Column:
    """A text read from a file, null when it is one of the missing words."""
    return F.when(~cell.isin(*MISSING_WORDS, *more), cell)
