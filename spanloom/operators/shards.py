"""Next-fit shards of long groups, dealt block by block.

A shard's end depends on where it began, so on all rows before.  But what a block of rows does
depends on what came before only until its first cut.  So each block tells, for every row at
which its first cut may be (the rows that fit into one shard), where the cuts after it lead; one row of
state walks over these short lists; and the blocks are dealt again, each from its own state.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_cut(sizes: list, start: int, state: tuple, most: Sequence[float], most_rows: int) -> tuple[int, tuple]:
    """The first row from ``start`` on that opens a shard (the number of rows if none does), and the
    open shard's sizes and rows (the last number) before it."""
    *used, n = state
    for i in range(start, len(sizes)):
        after = [u + s for u, s in zip(used, sizes[i], strict=True)]
        if n and (n + 1 > most_rows or any(u > m for u, m in zip(after, most, strict=True))):
            return i, (*used, n)
        used, n = after, n + 1
    return len(sizes), (*used, n)


def _rows(pdf: pd.DataFrame, order: Sequence[str], size: Sequence[str]) -> tuple[pd.DataFrame, list]:
    pdf = pdf.sort_values(list(order), kind="stable")
    return pdf, list(zip(*(pdf[c].fillna(0).tolist() for c in size), strict=True))


def next_fit_shards(
    rows: DataFrame, group: str, order: Sequence[str], size: str | Sequence[str], most: float | Sequence[float],
    most_rows: int, block: Column | None = None,
) -> DataFrame:
    """Pack each group's rows, in order, into shards numbered from 0; a shard closes when the next row would
    overflow one of its sizes (bytes, tokens) or its count.

    A row that is too large by itself has a shard of its own.  Sizes are 0 or more; null is 0, a null group is a
    group.  ``order`` has no ties and no nulls.  ``block`` is a column that never falls along the order;
    a task holds one block of a group, or the rows of each of its blocks that fit into one shard.  Without
    ``block``, a group is one block.
    """
    size, most = ([size], [most]) if isinstance(size, str) else (list(size), list(most))
    placed = rows.select(group, *order, *size).withColumn("_block", (F.lit(0) if block is None else block).cast("long"))
    kind = placed.schema[group].dataType.simpleString()
    ends = [f"_end{i}" for i in range(len(size))]
    sums = ", ".join(f"{c} double" for c in ends)
    empty = (*(0 for _ in size), 0)

    def tell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One row for each row that may be the first cut, and one for none (place -1)."""
        _, sizes = _rows(pdf, order, size)
        limit, whole = _first_cut(sizes, 0, empty, most, most_rows)
        leads: dict[int, tuple] = {}  # cut -> (cuts from it on, state at the end)
        for first in range(min(limit, len(sizes) - 1) + 1):
            chain, at = [], first
            while at < len(sizes) and at not in leads:
                following, state = _first_cut(sizes, at, empty, most, most_rows)
                chain.append(at)
                at = following
            known = leads[at] if at < len(sizes) else (0, state)
            for back, cut in enumerate(reversed(chain), 1):
                leads[cut] = (known[0] + back, known[1])
        told = [(*key, i, *sizes[i], *map(float, leads[i][1][:-1]), leads[i][1][-1], leads[i][0]) for i in range(min(limit, len(sizes) - 1) + 1)]
        return pd.DataFrame(told, columns=[group, "_block", "_place", *size, *ends, "_rows", "_cuts"])

    def walk(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The state and the shard's number at the start of each block of a group."""
        state, shard, found = empty, 0, []
        for at, part in pdf.sort_values(["_block", "_place"]).groupby("_block", sort=False):
            found.append((*key, at, *map(float, state[:-1]), state[-1], shard))
            sizes = list(zip(*(part[c].fillna(0).tolist() for c in size), strict=True))
            cut, state = _first_cut(sizes, 0, state, most, most_rows)
            if cut < len(sizes):
                row = part.iloc[cut]
                state, shard = (*(row[c] for c in ends), int(row["_rows"])), shard + int(row["_cuts"])
        return pd.DataFrame(found, columns=[group, "_block", *ends, "_rows", "_shard"])

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, sizes = _rows(pdf, order, size)
        first = pdf.iloc[0]
        state, shard, at, shards = (*(first[c] for c in ends), int(first["_rows"])), int(first["_shard"]), 0, []
        while at < len(sizes):
            cut, _ = _first_cut(sizes, at, state, most, most_rows)
            shards += [shard] * (cut - at)
            state, shard, at = empty, shard + 1, cut
        return pdf.assign(shard=shards)[[group, *order, *size, "shard"]]

    types = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in size)
    told = placed.groupBy(group, "_block").applyInPandas(tell, f"`{group}` {kind}, _block long, _place long, {types}, {sums}, _rows long, _cuts long")
    states = told.groupBy(group).applyInPandas(walk, f"`{group}` {kind}, _block long, {sums}, _rows long, _shard long")
    other = states.withColumnsRenamed({group: "_g", "_block": "_b"})
    joined = placed.join(other, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b"))).drop("_g", "_b")
    return joined.groupBy(group, "_block").applyInPandas(deal, rows.select(group, *order, *size).schema.add("shard", "long"))
