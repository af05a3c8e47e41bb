"""Identifiers in sequence headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An accession, with or without a version. A fixed value, by the format of accessions.
ACCESSION = r"(^|[^0-9A-Za-z])(([A-Z][_A-Z]{1,9}[0-9]{5,})(\.[0-9]+)?)"


def accession(text: Column) -> Column:
    """The first accession, with its version if it has one; else an empty string."""
    return F.regexp_extract(text, ACCESSION, 2)


def accession_bare(text: Column) -> Column:
    """The first accession without version."""
    return F.regexp_extract(text, ACCESSION, 3)


def accession_version(text: Column) -> Column:
    """The first accession, only if it has a version."""
    return F.when(F.regexp_extract(text, ACCESSION, 4) != "", accession(text)).otherwise("")


def gi(text: Column) -> Column:
    """What follows `gi|`, `gi:` or `gi=`, up to a bar, else a space, else the end."""
    rest = F.regexp_extract(text, r"gi[|:=](.*)$", 1)
    return F.trim(F.when(F.contains(rest, F.lit("|")), F.substring_index(rest, "|", 1)).otherwise(F.substring_index(rest, " ", 1)))


def leading_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\S*)", 1)


def filename(path: Column) -> Column:
    """After the last slash, up to the first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def display_header(header: Column) -> Column:
    """Text before the first space."""
    return F.substring_index(header, " ", 1)


def taxon_id(text: Column) -> Column:
    """The number after the first `taxid` and one more character, up to a bar, space or end; 0 if there is none."""
    return F.coalesce(F.try_to_number(F.regexp_extract(text, r"taxid.([0-9]{1,18})(?:[| ]|$)", 1), F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint"))


def sequence_id(text: Column, kind: str = "smart") -> Column:
    """The identifier of a header by kind: smart, ncbi, acc, acc_ver, gi, word, filename, or the whole text.

    smart takes an accession, else a gi number, else a file name, else all.
    """
    filled = lambda c: F.when(c != "", c)
    kinds = {
        "ncbi": accession(text), "acc": accession_bare(text), "acc_ver": accession_version(text), "gi": gi(text), "word": leading_word(text), "filename": filename(text), "all": text,
        "smart": F.coalesce(filled(accession(text)), filled(gi(text)), filled(filename(text)), text),
    }
    return kinds[kind]
