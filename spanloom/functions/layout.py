"""Small expressions over arrays, maps and paths: sheet layouts, merged counters, contained paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sheet_layout(panels: Column) -> Column:
    """struct(area, width, height, breaks): panels (structs with width and height, in order) laid out in columns, none
    resized or reordered, with the smallest area, then the smallest width and height.

    Bit i of ``breaks`` starts a new column after panel i; of equal layouts the smallest number is taken.  All 2^(n-1)
    layouts are tried, so it is for a few panels.  Without panels it is null.
    """
    last = F.size(panels) - 1
    empty = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("at", "done", "wide", "high", "tallest")))

    def laid(breaks: Column) -> Column:
        def add(s: Column, p: Column) -> Column:
            new = (s["at"] > 0) & (F.getbit(breaks, F.greatest(s["at"] - 1, F.lit(0)).cast("int")) == 1)
            wide = F.when(new, p["width"]).otherwise(F.greatest(s["wide"], p["width"])).cast("long")
            high = (F.when(new, 0).otherwise(s["high"]) + p["height"]).cast("long")
            done = s["done"] + F.when(new, s["wide"]).otherwise(0)
            return F.struct((s["at"] + 1).alias("at"), done.alias("done"), wide.alias("wide"), high.alias("high"), F.greatest(s["tallest"], high).alias("tallest"))

        def close(s: Column) -> Column:
            width = s["done"] + s["wide"]
            return F.struct((width * s["tallest"]).alias("area"), width.alias("width"), s["tallest"].alias("height"), breaks.alias("breaks"))

        return F.aggregate(panels, empty, add, close)

    layouts = F.transform(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.greatest(last, F.lit(0))).cast("long") - 1), laid)
    return F.when(last >= 0, F.array_min(layouts))


def merged_counts(left: Column, right: Column) -> Column:
    """The sum of two counters (maps of whole numbers); a key that one lacks counts 0 there, a null map is empty."""
    nothing = F.create_map().cast("map<string,bigint>")
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return F.map_zip_with(F.coalesce(left, nothing), F.coalesce(right, nothing), lambda _, x, y: zero(x) + zero(y))


def inside_root(path: Column) -> Column:
    """Whether a relative path stays below its root at every step.  An absolute path doesn't, nor does one that
    leaves the root and comes back; links aren't followed.  Null stays null."""
    step = lambda p: F.when(p.isin("", "."), 0).when(p == "..", -1).otherwise(1)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def walk(s: Column, p: Column) -> Column:
        depth = s["depth"] + step(p)
        return F.struct(depth.alias("depth"), F.least(s["least"], depth).alias("least"))

    lowest = F.aggregate(F.split(path, "/"), start, walk, lambda s: s["least"])
    return ~path.startswith("/") & (lowest >= 0)
