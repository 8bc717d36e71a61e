"""Rectangles as four Columns: points, origin top left, y downwards."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column | str
    y0: Column | str
    x1: Column | str
    y1: Column | str

    @classmethod
    def of(cls, *names: str) -> Box:
        """A box of named columns; names are resolved on use, so this needs no session."""
        return cls(*names)

    @property
    def columns(self) -> Box:
        return Box(*(F.col(c) if isinstance(c, str) else c for c in self))

    @property
    def area(self) -> Column:
        x0, y0, x1, y1 = self.columns
        return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))

    def intersection_area(self, other: Box) -> Column:
        a, b = self.columns, other.columns
        return Box(F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1)).area

    def contained_fraction(self, other: Box) -> Column:
        """How much of this box lies in the other; 0 for a box without area."""
        return F.when(self.area > 0, self.intersection_area(other) / self.area).otherwise(F.lit(0.0))

    def union(self, other: Box) -> Box:
        a, b = self.columns, other.columns
        return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))

    def scaled(self, factor: float) -> Box:
        """Pixels to points with 72 / dpi; points to pixels with the render scale."""
        return Box(*(c * F.lit(factor) for c in self.columns))

    def display(self, factor: float) -> tuple[Column, Column, Column, Column]:
        """Left, top, width and height on screen; nothing is drawn smaller than one unit."""
        x0, y0, x1, y1 = self.columns
        return x0 * factor, y0 * factor, F.greatest((x1 - x0) * factor, F.lit(1.0)), F.greatest((y1 - y0) * factor, F.lit(1.0))


def rgb(space: Column, c0: Column, c1: Column, c2: Column, c3: Column) -> tuple[Column, Column, Column]:
    """Grey, CMYK or RGB components as red, green, blue in 0 to 1."""
    ink = lambda c: (1 - c) * (1 - c3)
    pick = lambda own, cmyk: F.when(space == "grey", c0).when(space == "cmyk", cmyk).otherwise(own)
    return pick(c0, ink(c0)), pick(c1, ink(c1)), pick(c2, ink(c2))


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.lower(F.lpad(F.hex(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255).cast("int")), 2, "0"))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def luminance(r: Column, g: Column, b: Column) -> Column:
    def channel(c: Column) -> Column:
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * channel(r) + 0.7152 * channel(g) + 0.0722 * channel(b)


def contrast_with_white(r: Column, g: Column, b: Column, opacity: Column) -> Column:
    """WCAG contrast of a fill, blended by its opacity, against a white page: 1 to 21."""
    a = F.greatest(F.lit(0.0), F.least(F.lit(1.0), opacity))
    return F.lit(1.05) / (luminance(*(c * a + (1.0 - a) for c in (r, g, b))) + 0.05)
