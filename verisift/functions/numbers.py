"""Numbers in texts and their canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The form of a number.
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)?"
# Numbers that are structure, not claims.
STRUCTURE = r"(?im)^#{1,6}\s*[0-9]+\.?\s|^\s*[0-9]+\.\s|(?=[pcs])\b(?:p\.\s*|page\s+|pp\.\s*|CR-|section\s+)[0-9]+|\[[0-9]+\]"
#: Whole numbers up to this need no source.
SMALL = 100


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, without headings, list marks, page and section references and codes."""
    claims = F.regexp_replace(F.coalesce(text, F.lit("")), STRUCTURE, " ")
    return F.array_distinct(F.regexp_extract_all(claims, F.lit(NUMBER), F.lit(0)))


def all_numbers(text: Column) -> Column:
    """Distinct numbers of a text that may be a source: those in references and codes too."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0)))


def canonical_number(number: Column) -> Column:
    """One string per value: no commas, leading zeros or closing zeros of a fraction."""
    bare = F.regexp_replace(F.replace(number, F.lit(","), F.lit("")), r"^0+(?=[0-9])", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def is_small_integer(canonical: Column) -> Column:
    return canonical.rlike("^[0-9]{1,3}$") & (canonical.try_cast("int") <= SMALL)
