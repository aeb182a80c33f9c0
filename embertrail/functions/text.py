"""Text built for names, reports and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of video inputs.
VIDEO = ("mp4", "avi", "ts", "srt")


def id_letters(n: Column) -> Column:
    """1 -> A, 26 -> Z, 27 -> AA."""
    letter = lambda k: F.chr(F.lit(65) + k)
    i = (n - 1).cast("int")
    return F.when(n <= 26, letter(i)).otherwise(F.concat(letter((i / 26).cast("int") - 1), letter(i % 26)))


def input_kind(path: Column) -> Column:
    trimmed = F.rtrim(path, F.lit("\\"))
    ext = F.lower(F.regexp_extract(trimmed, r"\.([^.\\/]+)$", 1))
    return F.when(ext.isin(*VIDEO), "video").when(ext == "", "images").otherwise("unknown")


def duration(seconds: Column) -> Column:
    """75 -> `1m15s`."""
    whole = seconds.cast("int")
    return F.concat((whole / 60).cast("int").cast("string"), F.lit("m"), F.lpad((whole % 60).cast("string"), 2, "0"), F.lit("s"))


def location(n: Column, e: Column) -> Column:
    return F.format_string("%.0f,%.0f", n, e)


def name_key(name: Column) -> Column:
    return F.upper(F.trim(name))


def describe_objects(n: Column) -> Column:
    """`7 Objects`; empty for none."""
    return F.when(n > 0, F.format_string("%d Objects", n)).otherwise("")
