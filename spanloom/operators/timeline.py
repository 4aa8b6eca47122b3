"""Half-open interval tables over per-episode frame sequences.

Segments are rows (keys..., start, end, state); frames are rows (keys..., frame,
state).  Everything here is declared with windows, joins on the episode key plus a
range condition, and generated sequences, so that Catalyst plans it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans

KEYS = ("episode",)


def to_frames(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per covered frame; ``covered`` counts the segments there, over 1 is an overlap."""
    rows = segments.where("end > start").withColumn(
        "frame", F.explode(F.sequence("start", F.col("end") - 1))
    )
    covered = F.count(F.lit(1)).over(Window.partitionBy(*keys, "frame"))
    return rows.drop("start", "end").withColumn("covered", covered)


def to_runs(frames: DataFrame, state: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Maximal runs of equal state; a null (unknown) or missing frame ends a run."""
    return scans.runs(frames, state, keys)


def coalesce_segments(
    segments: DataFrame, keys: Sequence[str] = KEYS, *, contiguous: bool = True, any_state: bool = False
) -> DataFrame:
    """Merge neighbouring segments of equal state.

    contiguous: only those that touch; without it, gaps are bridged as well.
    any_state: merge whatever touches (bouts).
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    new = F.lit(False) if any_state else ~F.col("state").eqNullSafe(F.lag("state").over(order))
    if contiguous:
        new = new | (F.col("start") != F.lag("end").over(order))
    first = F.row_number().over(order) == 1
    island = F.sum((new | first).cast("int")).over(order)
    state = F.min("state") if any_state else F.first("state")
    return (
        segments.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), state.alias("state"), F.count(F.lit(1)).alias("parts"))
        .drop("_island")
    )


def clip(segments: DataFrame, windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The parts of segments inside windows (keys..., window, core_start, core_end)."""
    inside = (F.col("start") < F.col("core_end")) & (F.col("core_start") < F.col("end"))
    windows = binned(windows.where("core_end > core_start"), "core_start", "core_end")
    both = binned(segments.where("end > start"), "start", "end").join(windows, [*keys, "_bin"]).where(inside)
    return both.where(F.floor(F.greatest("start", "core_start") / BIN) == F.col("_bin")).select(
        *keys, "window",
        F.greatest("start", "core_start").alias("start"),
        F.least("end", "core_end").alias("end"), "state",
    )


def shift(segments: DataFrame, delta: int | Column, n_frames: str = "n_frames") -> DataFrame:
    """Segments moved by delta and clamped to the episode; emptied ones go."""
    delta = F.lit(delta) if isinstance(delta, int) else delta
    moved = lambda c: F.least(F.greatest(F.col(c) + delta, F.lit(0)), F.col(n_frames))
    return segments.withColumns({"start": moved("start"), "end": moved("end")}).where("end > start")


def split_in_half(segments: DataFrame) -> DataFrame:
    """Each segment of two frames or more as two halves."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    halves = F.array(
        F.struct(F.col("start").alias("s"), middle.alias("e")), F.struct(middle.alias("s"), F.col("end").alias("e"))
    )
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))
    parts = F.explode(F.when(F.col("end") - F.col("start") > 1, halves).otherwise(whole))
    return segments.withColumn("_p", parts).withColumns({"start": F.col("_p.s"), "end": F.col("_p.e")}).drop("_p")


def boundaries(frames: DataFrame, state: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Interior boundaries: +1 where the state turns on at this frame, -1 where it turns off."""
    order = Window.partitionBy(*keys).orderBy("frame")
    step = F.col(state).cast("int") - F.lag(F.col(state).cast("int")).over(order)
    return frames.withColumn("direction", step).where("direction <> 0").select(*keys, "frame", "direction")


#: Frames of a bin in range joins.
BIN = 64


def binned(rows: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """Rows with each bin (_bin) of frames that [start, end) reaches into."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return rows.withColumn("_bin", F.explode(F.sequence(F.floor(start / BIN), F.floor((end - 1) / BIN))))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of segments of one episode that share frames, with overlap and IoU.

    Segments meet in bins of frames, not in whole episodes; a pair counts in the bin
    in which its overlap starts.
    """
    a = left.select(*keys, *(F.col(c).alias(f"left_{c}") for c in left.columns if c not in keys))
    b = right.select(*keys, *(F.col(c).alias(f"right_{c}") for c in right.columns if c not in keys))
    shared = F.least("left_end", "right_end") - F.greatest("left_start", "right_start")
    union = F.greatest("left_end", "right_end") - F.least("left_start", "right_start")
    a, b = binned(a.where("left_end > left_start"), "left_start", "left_end"), binned(b.where("right_end > right_start"), "right_start", "right_end")
    return (
        a.join(b, [*keys, "_bin"])
        .where((F.col("left_start") < F.col("right_end")) & (F.col("right_start") < F.col("left_end")))
        .where(F.floor(F.greatest("left_start", "right_start") / BIN) == F.col("_bin"))
        .withColumns({"overlap": shared, "iou": shared / union})
        .drop("_bin")
    )


def step_labels(segments: DataFrame, episodes: DataFrame) -> DataFrame:
    """One-second steps (the last one may be partial), positive where a segment reaches in."""
    steps = episodes.withColumn(
        "step", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_frames") / F.col("fps")) - 1))
    ).select("episode", "step", (F.col("step") * F.col("fps")).alias("lo"), ((F.col("step") + 1) * F.col("fps")).alias("hi"))
    s = segments.select("episode", "start", "end")
    steps_in, s = binned(steps, F.floor("lo"), F.ceil("hi")), binned(s.where("end > start"), "start", "end")
    hit = steps_in.join(s, ["episode", "_bin"]).where("start < hi and end > lo").select("episode", "step").distinct()
    return (
        steps.join(hit.withColumn("positive", F.lit(True)), ["episode", "step"], "left")
        .select("episode", "step", F.coalesce("positive", F.lit(False)).alias("positive"))
    )


def disagreements(frames: DataFrame, raters: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Maximal intervals in which the raters don't all agree."""
    votes = F.array(*(F.col(r).cast("int") for r in raters))
    split = F.array_min(votes) != F.array_max(votes)
    return to_runs(frames.withColumn("_split", split), "_split", keys).where("state").drop("state")


def core_windows(episodes: DataFrame, core: int, context: int) -> DataFrame:
    """Tumbling cores with a context on both sides, clamped to the episode."""
    n = F.col("n_frames")
    return (
        episodes.withColumn("core_start", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(core).cast("long"))))
        .withColumn("core_end", F.least(F.col("core_start") + core, n))
        .withColumn("context_start", F.greatest(F.col("core_start") - context, F.lit(0)))
        .withColumn("context_end", F.least(F.col("core_end") + context, n))
        .withColumn("window", (F.col("core_start") / core).cast("long"))
    )


def sliding_windows(episodes: DataFrame, seconds: float, overlap: float) -> DataFrame:
    """Windows of so many seconds that overlap, until one ends with the episode."""
    size = F.greatest(F.lit(1), F.floor(F.col("fps") * seconds))
    step = F.greatest(F.lit(1), F.floor(F.col("fps") * (seconds - overlap)))
    last = F.greatest(F.lit(0), F.ceil((F.col("n_frames") - F.col("_size")) / F.col("_step")))
    return (
        episodes.withColumns({"_size": size, "_step": step})
        .withColumn("window", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .withColumn("start", F.col("window") * F.col("_step"))
        .withColumn("end", F.least(F.col("start") + F.col("_size"), F.col("n_frames")))
        .drop("_size", "_step")
    )


def chained_parts(episodes: DataFrame, size: int, carried: int) -> DataFrame:
    """Disjoint parts, each with some frames carried over and the number of the part before."""
    order = Window.partitionBy("episode").orderBy("start")
    return (
        episodes.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1, F.lit(size).cast("long"))))
        .withColumn("end", F.least(F.col("start") + size, F.col("n_frames")))
        .withColumn("context_start", F.greatest(F.lit(0), F.col("start") - carried))
        .withColumn("part", (F.col("start") / size).cast("long"))
        .withColumn("previous_part", F.lag("part").over(order))
    )


def centred_windows(segments: DataFrame, episodes: DataFrame, count: int) -> DataFrame:
    """A window of ``count`` frames around each episode's shortest positive segment, clamped."""
    size = F.col("end") - F.col("start")
    shortest = segments.where("state").groupBy("episode").agg(
        F.min(F.struct(size.alias("size"), F.col("start"), F.col("end"))).alias("s")
    )
    start = F.floor((F.col("s.start") + F.col("s.end")) / 2) - F.lit(count // 2)
    limit = F.greatest(F.col("n_frames") - count, F.lit(0))
    return (
        shortest.join(episodes, "episode")
        .withColumn("window_start", F.greatest(F.lit(0), F.least(start, limit)))
        .select("episode", "window_start", F.least(F.col("window_start") + count, F.col("n_frames")).alias("window_end"))
    )


def jitter_cells(segments: DataFrame, n_frames: str = "n_frames") -> DataFrame:
    """For each interior boundary the frames between which it may move without meeting another."""
    order = Window.partitionBy("episode").orderBy("start")
    mid = lambda a, b: F.floor((a + b) / 2)
    low = F.coalesce(mid(F.lag("start").over(order), F.col("start")), F.lit(0))
    high = mid(F.col("start"), F.coalesce(F.lead("start").over(order), F.col(n_frames)))
    return segments.withColumns({"low": low, "high": high}).where("start > 0")


def busiest_excerpt(frames: DataFrame, value: str, width: int, every: int) -> DataFrame:
    """The window of ``width`` frames, starting at multiples of ``every``, with the largest sum;
    ties go to the later start."""
    ahead = Window.partitionBy("episode").orderBy("frame").rowsBetween(0, width - 1)
    sums = frames.withColumn("activity", F.sum(value).over(ahead)).where(
        (F.col("frame") % every == 0)
        & ((F.col("frame") + width <= F.col("n_frames")) | (F.col("frame") == 0))
    )
    best = Window.partitionBy("episode").orderBy(F.col("activity").desc(), F.col("frame").desc())
    return sums.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(
        "episode", F.col("frame").alias("start"), "activity"
    )


def majority(observations: DataFrame, keys: Sequence[str], state: str) -> DataFrame:
    """The commonest state of several observations; of a tie, the smaller one."""
    counts = observations.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(state))
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(*keys, state)


def forward_fill(rows: DataFrame, column: str, keys: Sequence[str], order: str) -> DataFrame:
    """Nulls replaced by the last known value before them; ``order`` is a number, as of frames."""
    return scans.last_known(rows, column, keys, [order], scans.frames_block(order))


def nearest(points: DataFrame, targets: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each different target the closest point of its episode; of equal ones the lower.  A target
    of an episode without points has no row.

    Points and targets are one sequence, in which the last point before and the first one after are
    carried along in blocks.
    """
    here = points.select(*keys, F.col("frame").alias("at"), F.lit(0).alias("_side"), F.col("frame").alias("below"))
    asked = targets.select(*keys, F.col("target").alias("at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("below")).distinct()
    both = here.unionByName(asked).withColumns({"above": F.col("below"), "_back": -F.col("at")})
    both = scans.last_known(both, "below", keys, ["at", "_side"], scans.frames_block("at"))
    both = scans.last_known(both, "above", keys, ["_back", "_side"], scans.frames_block("_back"))
    lower = F.col("at") - F.col("below") <= F.col("above") - F.col("at")
    closest = F.coalesce(F.when(lower, F.col("below")).otherwise(F.col("above")), F.col("below"))
    return both.where("_side = 1").select(*keys, F.col("at").alias("target"), closest.alias("nearest")).where("nearest is not null")


def containing(points: DataFrame, segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Points (keys..., frame, ...) with each segment of their episode that holds their frame; they meet in bins."""
    placed = points.withColumn("_bin", F.floor(F.col("frame") / BIN))
    held = binned(segments.where("end > start"), "start", "end")
    return placed.join(held, [*keys, "_bin"]).where("frame >= start and frame < end").drop("_bin")


def within(left: DataFrame, right: DataFrame, gap: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of segments, as ``overlaps`` names them, with at most ``gap`` frames between them."""
    widened = left.withColumns({"start": F.col("start") - gap - 1, "end": F.col("end") + gap + 1})
    pairs = overlaps(widened, right, keys).drop("overlap", "iou")
    return pairs.withColumns({"left_start": F.col("left_start") + gap + 1, "left_end": F.col("left_end") - gap - 1})


def supported_details(segments: DataFrame, windows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(segment, window) where the segment reaches into the core, lies inside the context, and every frame that
    it cites (``citations``) is in the context.  Without citations it is unsupported."""
    cores = windows.withColumns({"start": F.col("core_start"), "end": F.col("core_end")})
    pairs = overlaps(segments, cores, keys)
    inside = (F.col("left_start") >= F.col("right_context_start")) & (F.col("left_end") <= F.col("right_context_end"))
    seen = F.forall("left_citations", lambda f: (f >= F.col("right_context_start")) & (f < F.col("right_context_end")))
    found = pairs.where(inside & seen & (F.size("left_citations") > 0))
    return found.select(*keys, F.col("right_window").alias("window"), F.col("left_start").alias("start"), F.col("left_end").alias("end"))


def nearest_clean(negatives: DataFrame, centres: DataFrame, count: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each episode's ``centre`` the window of ``count`` frames inside one negative segment whose middle is
    closest to it; of equal ones the earliest.  An episode without a segment that long has no row."""
    half = count // 2
    long_enough = negatives.where(F.col("end") - F.col("start") >= count).join(centres, list(keys))
    start = F.least(F.greatest(F.col("centre") - half, F.col("start")), F.col("end") - count)
    placed = long_enough.withColumn("window_start", start)
    away = F.abs(F.col("window_start") + half - F.col("centre"))
    best = placed.groupBy(*keys).agg(F.min(F.struct(away.alias("away"), F.col("window_start"))).alias("b"))
    return best.select(*keys, F.col("b.window_start").alias("window_start"), (F.col("b.window_start") + count).alias("window_end"), F.col("b.away").alias("away"))


def coverage_faults(segments: DataFrame, episodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Maximal stretches (keys..., start, end, times) of an episode that segments cover not exactly once.

    Only edges are counted: +1 where a segment starts, -1 where it ends, summed in blocks.  Segments are clamped
    to their episode; frames outside it aren't reported.
    """
    n = F.col("n_frames")
    clamped = segments.select(*keys, "start", "end").join(episodes.select(*keys, "n_frames"), list(keys))
    clamped = clamped.select(*keys, F.greatest("start", F.lit(0)).alias("start"), F.least(F.col("end"), n).alias("end")).where("end > start")
    edges = clamped.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("step")))).alias("e"))
    edges = edges.select(*keys, "e.at", "e.step", F.lit(False).alias("end_of"))
    ends = episodes.where(n > 0).select(*keys, F.explode(F.array(F.lit(0).cast("long"), n)).alias("at"), F.lit(0).alias("step"), F.lit(True).alias("end_of"))
    steps = edges.unionByName(ends).groupBy(*keys, "at").agg(F.sum("step").alias("step"), F.max("end_of").alias("end_of"))
    steps = steps.where("step <> 0 or end_of").withColumn("_back", -F.col("at"))
    times = scans.sums_before(steps, ["at"], ["step"], keys, scans.frames_block("at")).withColumn("times", F.col("before_step") + F.col("step"))
    until = scans.previous(times, "at", keys, ["_back"], scans.frames_block("_back"), "end")
    return until.where("end is not null and times <> 1").select(*keys, F.col("at").alias("start"), "end", "times")


def as_of(events: DataFrame, states: DataFrame, keys: Sequence[str] = KEYS, block: Column | None = None) -> DataFrame:
    """For each event (keys..., at) the value of the last state (keys..., at, value) not after it.

    Both sides are put in one sequence and the value is carried forward, inside blocks first:
    ``block`` is a column of ``at`` that never falls, such as its day; without it, a key is one block.
    """
    both = states.select(*keys, "at", "value", F.lit(0).alias("_side"), F.lit(None).cast("long").alias("id")).unionByName(
        events.select(*keys, "at", F.lit(None).cast(states.schema["value"].dataType).alias("value"), F.lit(1).alias("_side"), "id")
    )
    filled = scans.last_known(both, "value", keys, ["at", "_side"], F.lit(0) if block is None else block)
    return filled.where("_side = 1").select(*keys, "id", "at", "value")
