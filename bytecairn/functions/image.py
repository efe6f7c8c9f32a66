"""Dimensions that an image style gives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fitted(width: Column, height: Column, style: Column) -> Column:
    """Width and height under a style name: ``<n>p`` bounds the width, ``<n>i`` the height, ``<n>x`` both; the aspect stays and nothing is enlarged."""
    bound = F.regexp_extract(style, r"(?:^|\.)(\d+)([pix])(?:\.|$)", 1)
    axis = F.regexp_extract(style, r"(?:^|\.)(\d+)([pix])(?:\.|$)", 2)
    most = F.when(bound != "", bound.cast("int"))
    by_width = F.when(axis.isin("p", "x"), most / width)
    by_height = F.when(axis.isin("i", "x"), most / height)
    scale = F.least(F.lit(1.0), by_width, by_height)  # nulls are passed over
    side = lambda n: F.greatest(F.lit(1), F.round(n * scale)).cast("int")
    return F.struct(side(width).alias("width"), side(height).alias("height"))
