"""One-to-one matchings of segments or boundaries inside an episode.

Candidate pairs come from a range join in bins of frames.  Each pair spans the frames of both
its sides; where no pair spans a frame, the episode is cut, and the pairs between two cuts (a
cluster) don't affect any others.  Cuts are found bin by bin, so that no window holds an
episode.  Clusters are dealt to tasks and settled one after the other from a sorted stream of
Arrow batches by programs over their pairs, none of which builds a table of all left and right
elements.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import BIN, binned, overlaps

Scored = dict[tuple, float]


def ordered(scored: Scored, *, count_first: bool = True) -> list[tuple]:
    """Order-preserving pairs (a, b) with the most pairs, then the largest total score; or with
    the largest total, then the most pairs.

    Of equal optima, right elements that come earlier are taken.  The best chain of pairs that ends
    at or before each right element is kept in a tree of prefixes, so that p pairs take p log p steps.
    """
    rights = sorted({b for _, b in scored})
    size = len(rights)
    best: list[tuple] = [((0, 0, 0), None)] * (size + 1)
    before: dict[tuple, tuple | None] = {}
    for _, group in groupby(sorted(scored), key=lambda pair: pair[0]):
        found = []
        for pair in group:  # all look before any of the group is put in: each left once
            at = bisect_left(rights, pair[1])
            value, last, i = (0, 0, 0), None, at
            while i > 0:
                if best[i][0] > value:
                    value, last = best[i]
                i -= i & -i
            s = scored[pair]
            one = (1, s) if count_first else (s, 1)
            value = (value[0] + one[0], value[1] + one[1], value[2] - at)
            before[pair] = last
            found.append((at + 1, value, pair))
        for i, value, pair in found:
            while i <= size:
                if value > best[i][0]:
                    best[i] = (value, pair)
                i += i & -i
    top, i = ((0, 0, 0), None), size
    while i > 0:
        top = max(top, best[i], key=lambda x: x[0])
        i -= i & -i
    pairs, pair = [], top[1]
    while pair is not None:
        pairs.append(pair)
        pair = before[pair]
    return pairs[::-1]


def most_pairs(edges: dict[int, list[int]], n_left: int) -> list[tuple[int, int]]:
    """A largest bipartite matching, also for overlapping segments: shortest augmenting paths, all
    those of one length in a round, followed with an explicit stack."""
    of_left: dict[int, int] = {}
    of_right: dict[int, int] = {}
    while True:
        layer = {i: 0 for i in range(n_left) if i not in of_left and edges.get(i)}
        queue, free = deque(layer), False
        while queue:
            i = queue.popleft()
            for j in edges.get(i, ()):
                owner = of_right.get(j)
                if owner is None:
                    free = True
                elif owner not in layer:
                    layer[owner] = layer[i] + 1
                    queue.append(owner)
        if not free:
            return sorted(of_left.items())
        options = {i: iter(edges[i]) for i in layer}
        for root in [i for i, depth in layer.items() if depth == 0]:
            path = [(root, None)]  # left elements, with the right one that led to each
            while path:
                i = path[-1][0]
                for j in options[i]:
                    owner = of_right.get(j)
                    if owner is None:
                        for k in range(len(path) - 1, -1, -1):
                            left, via = path[k]
                            of_left[left], of_right[j] = j, left
                            j = via
                        path = []
                        break
                    if layer.get(owner) == layer[i] + 1:
                        path.append((owner, j))
                        break
                else:
                    path.pop()


def greedy(scored: Scored) -> list[tuple]:
    """Pairs by descending score, each side once; of equal scores the later ones first."""
    used_left, used_right, pairs = set(), set(), []
    for (a, b), _ in sorted(scored.items(), key=lambda x: (x[1], x[0]), reverse=True):
        if a not in used_left and b not in used_right:
            used_left.add(a)
            used_right.add(b)
            pairs.append((a, b))
    return pairs


def greedy_nearest(scored: Scored) -> list[tuple]:
    """Each left point, in order, takes the free right point of the best score, the lower of equal ones."""
    taken, pairs = set(), []
    for a, group in groupby(sorted(scored), key=lambda pair: pair[0]):
        b = min(((-scored[pair], pair[1]) for pair in group if pair[1] not in taken), default=(0, None))[1]
        if b is not None:
            taken.add(b)
            pairs.append((a, b))
    return pairs


def _most(scored: Scored) -> list[tuple]:
    left, right = (sorted({pair[k] for pair in scored}) for k in (0, 1))
    place = {b: j for j, b in enumerate(right)}
    edges = {i: [place[b] for _, b in group] for i, (_, group) in enumerate(groupby(sorted(scored), key=lambda pair: pair[0]))}
    return [(left[i], right[j]) for i, j in most_pairs(edges, len(left))]


#: Programs over the scores of a cluster's candidates.
METHODS: dict[str, Callable[[Scored], list[tuple]]] = {
    "ordered": ordered,
    "alignment": lambda s: ordered(s, count_first=False),
    "greedy": greedy,
    "nearest": greedy_nearest,
    "most": _most,
}

#: Frames of a bin in which cuts are looked for.
REACH = 1024


def clustered(candidates: DataFrame, keys: Sequence[str], start: Column, end: Column) -> DataFrame:
    """Adds ``_cluster``: the start of the island of overlapping spans [start, end) that a row is in.

    A span is put into each bin of frames that it reaches; there, sorted by start, it opens an
    island if none before it reaches its start.  Islands that go on from an earlier bin are the
    last one opened there, found from one row a bin.
    """
    spans = candidates.withColumns({"_lo": start, "_hi": end})
    spans = spans.withColumn("_at", F.explode(F.sequence(F.floor(F.col("_lo") / REACH), F.floor((F.col("_hi") - 1) / REACH))))
    inside = Window.partitionBy(*keys, "_at").orderBy("_lo")
    reached = F.max("_hi").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    home = F.floor(F.col("_lo") / REACH) == F.col("_at")
    opened = F.when(home & (F.coalesce(reached, F.col("_lo")) <= F.col("_lo")), F.col("_lo"))
    spans = spans.withColumn("_opened", opened).withColumn("_here", F.max("_opened").over(inside))
    bins = spans.groupBy(*keys, "_at").agg(F.max("_opened").alias("_opened"))
    earlier = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_at", F.max("_opened").over(earlier).alias("_before"))
    placed = spans.where(home).join(bins, [*keys, "_at"])
    return placed.select(*candidates.columns, F.coalesce("_here", "_before").alias("_cluster"))


class _Settle:
    """Keeps the matched ones of the candidates in a stream sorted by cluster."""

    def __init__(self, method: str, by: Sequence[str]):
        self.method, self.by = method, [*by]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        program, rest = METHODS[self.method], None
        for batch in chain(batches, [None]):
            table = pa.Table.from_batches([b for b in (rest, batch) if b is not None]) if rest is not None or batch is not None else None
            if table is None or not table.num_rows:
                continue
            table = table.combine_chunks()
            places = list(zip(*(table.column(c).to_pylist() for c in self.by), strict=True))
            pairs = list(zip(table.column("left").to_pylist(), table.column("right").to_pylist(), strict=True))
            scores = table.column("score").to_pylist()
            keep, at = [False] * len(pairs), 0
            for place, group in groupby(places):
                end = at + sum(1 for _ in group)
                if batch is not None and end == len(places):
                    break  # the cluster may go on in the next batch
                if end - at == 1:
                    keep[at] = True
                else:
                    stay = set(program(dict(zip(pairs[at:end], scores[at:end], strict=True))))
                    keep[at:end] = [pair in stay for pair in pairs[at:end]]
                at = end
            done = table.slice(0, at).filter(pa.array(keep[:at], pa.bool_()))
            left_over = table.slice(at).to_batches()
            rest = left_over[0] if left_over else None
            yield from done.to_batches()


def matched(candidates: DataFrame, keys: Sequence[str], method: str, span: tuple[Column, Column] | None = None) -> DataFrame:
    """The matched ones of candidate pairs (keys..., left, right, score), one candidate a pair.

    ``span``: the frames [start, end) that a pair takes up, such that pairs with a side in common
    overlap; without it the pairs of a key are one cluster.
    """
    if span is None:
        placed = candidates.withColumn("_cluster", F.lit(0).cast("long"))
    else:
        placed = clustered(candidates, keys, *span)
    by = [*keys, "_cluster"]
    dealt = placed.repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(_Settle(method, by), dealt.schema).drop("_cluster")


def match_segments(left: DataFrame, right: DataFrame, least: float, method: str = "ordered", keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Matched pairs (keys..., left_start, left_end, right_start, right_end, iou) of two tracks."""
    columns = [*keys, "start", "end"]
    pairs = overlaps(left.select(columns), right.select(columns), keys).where(F.col("iou") >= least)
    return settled_segments(pairs.select(*keys, "left_start", "left_end", "right_start", "right_end", "iou"), "iou", method, keys)


def settled_segments(pairs: DataFrame, score: str | Column, method: str, keys: Sequence[str]) -> DataFrame:
    """The matched ones of overlapping pairs of segments, as ``overlaps`` gives them, by a score of one's own."""
    score = F.col(score) if isinstance(score, str) else score
    span = F.least("left", "right"), F.greatest("left_end", "right_end")
    places = pairs.withColumn("score", score).withColumnsRenamed({"left_start": "left", "right_start": "right"})
    return matched(places, keys, method, span).drop("score").withColumnsRenamed({"left": "left_start", "right": "right_start"})


def match_points(
    left: DataFrame, right: DataFrame, tolerance: float | Column, method: str = "ordered", keys: Sequence[str] = ("episode", "direction")
) -> DataFrame:
    """Matched boundaries (keys..., left_frame, right_frame, distance) within ``tolerance`` frames,
    a number or a column of ``left``; it is inclusive, with slack for rounding."""
    reach = (F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance) + 1e-9
    a = left.select(*keys, F.col("frame").alias("left"), reach.alias("_reach"))
    a = binned(a, F.floor(F.col("left") - F.col("_reach")), F.floor(F.col("left") + F.col("_reach")) + 1)
    b = right.select(*keys, F.col("frame").alias("right"), F.floor(F.col("frame") / BIN).alias("_bin"))
    distance = F.abs(F.col("left") - F.col("right")).cast("double")
    pairs = a.join(b, [*keys, "_bin"]).where(distance <= F.col("_reach"))
    pairs = pairs.select(*keys, "left", "right", (F.ceil("_reach") - distance).alias("score"), distance.alias("distance"))
    span = F.least("left", "right"), F.greatest("left", "right") + 1
    return matched(pairs, keys, method, span).select(*keys, F.col("left").alias("left_frame"), F.col("right").alias("right_frame"), "distance")
