"""Scalar functions over sequences and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC nucleotide codes and their complements; letters outside the table become N, case is kept.
CODES = "ACGTUMRWSYKVHDBN"
COMPLEMENTS = "TGCAAKYWSRMBDHVN"


def reverse_complement(seq: Column) -> Column:
    other = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c not in CODES)
    source = CODES + CODES.lower() + other + other.lower()
    target = COMPLEMENTS + COMPLEMENTS.lower() + "N" * len(other) + "n" * len(other)
    return F.translate(F.reverse(seq), source, target)


def oriented(seq: Column, is_rev: Column) -> Column:
    return F.when(is_rev, reverse_complement(seq)).otherwise(seq)


def uncalled(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "Nn", ""))).cast("long")


def name_prefix(name: Column, delimiter: str = "#", fields: int = 1) -> Column:
    """The first ``fields`` fields of a structured path name."""
    return F.substring_index(name, delimiter, fields)


def colour(name: Column) -> Column:
    """``#RRGGBB`` of a name: bytes 24, 8 and 16 of its SHA-256."""
    h = F.sha2(name, 256)
    return F.concat(F.lit("#"), *[F.upper(F.substring(h, 2 * b + 1, 2)) for b in (24, 8, 16)])


def trimmed(x: Column) -> Column:
    """A number with up to five decimals, trailing zeros cut."""
    return F.regexp_replace(F.format_string("%.5f", x.cast("double")), r"\.?0+$", "")
