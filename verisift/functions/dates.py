"""Dates as documents state them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted formats in order; a missing day or month is the first.
FORMATS = ("MMMM yyyy", "MMM yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "d/M/yyyy", "M/yyyy", "yyyy")


def stated_date(text: Column) -> Column:
    """The first format that fits, else null; commas are ignored."""
    clean = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.coalesce(*[F.try_to_timestamp(clean, F.lit(f)) for f in FORMATS]).cast("date")


def elapsed_months(later: Column, earlier: Column) -> Column:
    """Calendar months between, the day of the month ignored."""
    return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
