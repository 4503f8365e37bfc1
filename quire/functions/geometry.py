"""Boxes as columns: x, y, width, height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right(p: str = "") -> Column:
    return F.col(f"{p}x") + F.col(f"{p}width")


def bottom(p: str = "") -> Column:
    return F.col(f"{p}y") + F.col(f"{p}height")


def centre_x(p: str = "") -> Column:
    return F.col(f"{p}x") + F.col(f"{p}width") / 2


def centre_y(p: str = "") -> Column:
    return F.col(f"{p}y") + F.col(f"{p}height") / 2


def overlap_x(a: str, b: str) -> Column:
    """Length of the common stretch of two boxes, at least 0."""
    return F.greatest(F.lit(0.0), F.least(right(a), right(b)) - F.greatest(F.col(f"{a}x"), F.col(f"{b}x")))


def overlap_y(a: str, b: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(bottom(a), bottom(b)) - F.greatest(F.col(f"{a}y"), F.col(f"{b}y")))


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 for an empty union."""
    common = overlap_x(a, b) * overlap_y(a, b)
    union = F.col(f"{a}width") * F.col(f"{a}height") + F.col(f"{b}width") * F.col(f"{b}height") - common
    return F.when(union > 0, common / union).otherwise(0.0)


def contains_centre(box: str, inner: str) -> Column:
    """Whether the centre of one box lies in the other, edges included."""
    return centre_x(inner).between(F.col(f"{box}x"), right(box)) & centre_y(inner).between(F.col(f"{box}y"), bottom(box))


def figure_inches(width: Column, height: Column, page_width: Column) -> tuple[Column, Column]:
    """Printed size of a figure: its share of 6.87 inches, from 0.6 to 5.8 wide and at most 7 high."""
    inches = F.greatest(F.lit(0.6), F.least(F.lit(5.8), F.lit(6.87) * width / page_width))
    high = inches * height / F.greatest(width, F.lit(1))
    return F.when(high > 7.0, inches * 7.0 / high).otherwise(inches), F.least(high, F.lit(7.0))


def crop_box(x: Column, y: Column, width: Column, height: Column, space: Column, page_width: Column, page_height: Column) -> Column:
    """Integer crop rectangle within the page, at least a pixel wide and high; normalized boxes are scaled first."""
    sx, sy = F.when(space == "normalized", page_width).otherwise(1), F.when(space == "normalized", page_height).otherwise(1)
    left = F.greatest(F.lit(0), F.floor(x * sx))
    top = F.greatest(F.lit(0), F.floor(y * sy))
    return F.struct(
        left.alias("left"),
        top.alias("top"),
        F.greatest(left + 1, F.least(page_width, F.ceil((x + width) * sx))).alias("right"),
        F.greatest(top + 1, F.least(page_height, F.ceil((y + height) * sy))).alias("bottom"),
    )
