"""Rectangles as Columns: corner (x, y) and size (w, h); right and bottom edges are exclusive."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "box") -> Rect:
        return cls(*(F.col(f"{prefix}_{c}") for c in "xywh"))

    def area(self) -> Column:
        return self.w * self.h

    def overlap_area(self, other: Rect) -> Column:
        width = F.least(self.x + self.w, other.x + other.w) - F.greatest(self.x, other.x)
        height = F.least(self.y + self.h, other.y + other.h) - F.greatest(self.y, other.y)
        return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))

    def union(self, other: Rect, extra: int = 0) -> Rect:
        """The box of both. extra=1 gives the box after one feature consumes another, which is a pixel wider and taller."""
        x, y = F.least(self.x, other.x), F.least(self.y, other.y)
        return Rect(x, y, F.greatest(self.x + self.w, other.x + other.w) - x + extra, F.greatest(self.y + self.h, other.y + other.h) - y + extra)

    def inflate(self, by: int) -> Rect:
        return Rect(self.x - by, self.y - by, self.w + 2 * by, self.h + 2 * by)

    def contains(self, other: Rect) -> Column:
        return (self.x <= other.x) & (self.y <= other.y) & (self.x + self.w >= other.x + other.w) & (self.y + self.h >= other.y + other.h)

    def inside(self, width: int, height: int) -> Rect:
        """Moved so that it lies in the image as far as it can."""
        return Rect(F.greatest(F.least(self.x, F.lit(width) - self.w), F.lit(0)), F.greatest(F.least(self.y, F.lit(height) - self.h), F.lit(0)), self.w, self.h)

    def matches(self, other: Rect, perc: int) -> Column:
        """Overlap of at least perc % of either area."""
        both = self.overlap_area(other) * 100
        return (both >= self.area() * perc) | (both >= other.area() * perc)

    def spine(self) -> Column:
        return F.sqrt((self.w * self.w + self.h * self.h).cast("double"))


def girth(pixels: Column, box: Rect) -> Column:
    """The lesser, over both diagonals of the box, of the largest distance of a pixel from it, doubled on neither side."""
    length = box.spine()

    def largest(flip: bool) -> Column:
        along = lambda p: (p["x"] - box.x) * box.h - ((box.h - (p["y"] - box.y)) if flip else (p["y"] - box.y)) * box.w
        return F.array_max(F.transform(pixels, lambda p: F.abs(along(p)) / length))

    return F.least(largest(False), largest(True))
