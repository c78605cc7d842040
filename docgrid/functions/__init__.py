"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_space(text: Column) -> Column:
    """Characters that are not white space."""
    return F.char_length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def sampled_page(number: Column, pages: Column, most: int = 7) -> Column:
    """Whether a page is among at most ``most`` evenly spaced ones, both ends included."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: (1 + F.floor(i * (pages - 1) / (most - 1))).cast("int"))
    return (pages <= most) | F.array_contains(picks, number)


def area_fraction(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Share of the page that a box covers; null where geometry is missing or empty."""
    return F.when((width > 0) & (height > 0), F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0) / (width * height))
