"""Boxes on pages: shares of the page, frames of turned pages, percentages for drawing.

A box is a struct (x0, y0, x1, y1) of doubles. What cannot be placed is null, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Turns of a page that are known, the least extent of a box in pixels.
ANGLES, EXTENT = (0, 90, 180, 270), 1.0


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def finite(value: Column) -> Column:
    """Whether a number is there and neither infinite nor NaN."""
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def page_is_valid(width: Column, height: Column) -> Column:
    return finite(width) & finite(height) & (width > 0) & (height > 0)


def share_of_page(b: Column, width: Column, height: Column) -> Column:
    """The share of its page that a box covers; null where either is missing."""
    return F.when(b.isNotNull() & page_is_valid(width, height), (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) / (width * height))


def upright_size(width: Column, height: Column, angle: Column) -> tuple[Column, Column]:
    """Width and height of a page after its turn."""
    turned = angle.isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def placed_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, angle: Column) -> Column:
    """A box given on the turned page, cut to it and carried back to the page as it lies in the source.

    Null where a number is not finite, the angle is unknown, or a pixel or less is left in either direction.
    """
    wide, high = upright_size(width, height, angle)
    cut = lambda v, most: F.least(most, F.greatest(F.lit(0.0), v))
    left, right = F.least(cut(x0, wide), cut(x1, wide)), F.greatest(cut(x0, wide), cut(x1, wide))
    top, bottom = F.least(cut(y0, high), cut(y1, high)), F.greatest(cut(y0, high), cut(y1, high))
    good = finite(x0) & finite(y0) & finite(x1) & finite(y1) & page_is_valid(width, height) & (right - left > EXTENT) & (bottom - top > EXTENT)
    back = (
        F.when(angle == 0, box(left, top, right, bottom))
        .when(angle == 90, box(width - bottom, left, width - top, right))
        .when(angle == 180, box(width - right, height - bottom, width - left, height - top))
        .when(angle == 270, box(top, height - right, bottom, height - left))
    )
    return F.when(good, back)


def percentages(b: Column, width: Column, height: Column) -> Column:
    """(left, top, width, height) of a box in hundredths of its page, null where nothing of it is on the page."""
    cut = lambda v: F.least(F.lit(100.0), F.greatest(F.lit(0.0), v))
    left, right = cut(b["x0"] / width * 100), cut(b["x1"] / width * 100)
    top, bottom = cut(b["y0"] / height * 100), cut(b["y1"] / height * 100)
    shown = b.isNotNull() & (width > 0) & (height > 0) & (right > left) & (bottom > top)
    return F.when(shown, F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height")))


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width over height, that of an upright sheet where the page has no size."""
    return F.coalesce(width / height, F.lit(1.0) / F.sqrt(F.lit(2.0)))


def raster_scale(width: Column, height: Column, dpi: float = 200.0, most: float = 2600.0) -> Column:
    """The scale at which a page in points is drawn: ``dpi``, or less so that no edge is longer than ``most`` pixels."""
    return F.least(F.lit(dpi / 72), F.lit(float(most)) / F.greatest(width, height))


def worker_seconds(pages: Column, each: float = 600.0, most: float = 7200.0) -> Column:
    """The time that a worker gets for a batch of pages."""
    return F.least(pages * F.lit(each), F.lit(most))
