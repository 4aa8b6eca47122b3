"""The rules of an atomic-action annotation, as a table of violations.

A segment is one piece of one action: (episode, start, end, action_id, action, object_id, destination_id,
failure, categories, recovery, severity, resetability, review_required, uncertainty, observed_result,
boundary_reason, what_happened, evidence).  Pieces of an action follow each other and share its
``action_id``; ids count the actions of an episode, a1, a2, ... in order.  Every rule that a segment breaks
is a row of its own, so an annotation is valid if it has none.

What the segments before decide (the cursor, the number of actions so far, the participants known of
this action) is scanned in blocks, so no window holds an episode.  A row for each block tells what the
blocks before hand on; segments are shuffled once to meet it, with no more than the scan reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import saved
from . import scans
from .validate import broken

#: Fixed values of the format.
SEVERITIES = ("low", "medium", "catastrophic")
RESETS = ("immediate", "minor_reset", "hard_reset", "unresettable")
UNKNOWN = "unknown"
TEXTS = ("action_id", "action", "observed_result", "boundary_reason", "what_happened")
REFERENTS = ("object_id", "destination_id")


def _filled(column: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(column))) > 0, F.lit(False))


def _nothing(column: str) -> Column:
    return F.col(column).isNull()


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _scanned(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a segment's own block tells of the segments before it, of those to it, and whether it is the block's last.

    ``_opened`` counts the actions that begin in the block, without one that begins with its first segment.
    """
    inside = Window.partitionBy(*keys).orderBy("start", "_this", "_who")
    earlier, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_lag": F.lag("_this").over(inside), "_last": F.lead(F.lit(True)).over(inside).isNull(), "_head": F.first("_this.action_id").over(upto)})
    opens = F.col("_lag").isNotNull() & ~F.col("_this.action_id").eqNullSafe(F.col("_lag.action_id"))
    rows = rows.withColumn("_opened", F.sum(opens.cast("long")).over(upto))
    named = {c: F.when(F.col(f"_who.{c}").isNotNull(), F.struct("_opened", F.col(f"_who.{c}").alias("name"))) for c in REFERENTS}
    rows = rows.withColumns({f"_{c}": F.last(of, ignorenulls=True).over(earlier) for c, of in named.items()})
    return rows.withColumns({f"_to_{c}": F.coalesce(of, f"_{c}") for c, of in named.items()})


def _blocks(rows: DataFrame, episodes: DataFrame) -> DataFrame:
    """A row for each block of an episode: what the blocks before hand on, and the facts of the episode.

    Of the sampled frames, a block gets those between the first and the last that its segments cite.
    """
    block = Window.partitionBy("episode", "_block")
    rows = rows.withColumns({"_low": F.min(F.array_min("_cited")).over(block), "_high": F.max(F.array_max("_cited")).over(block), "_end": F.max("_this.end").over(block)})
    ends = _scanned(rows, ["episode", "_block"]).where("_last")
    order = Window.partitionBy("episode").orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_carry", F.lag("_this").over(order))
    opens = F.col("_carry").isNull() | ~F.col("_head").eqNullSafe(F.col("_carry.action_id"))
    ends = ends.withColumn("_opens", opens.cast("long"))
    ends = ends.withColumn("_from", F.coalesce(F.sum(F.col("_opens") + F.col("_opened")).over(earlier), F.lit(0)) + F.col("_opens"))
    for c in REFERENTS:  # of the action that goes on from the block before
        named = F.when(F.col(f"_to_{c}").isNotNull(), F.struct((F.col("_from") + F.col(f"_to_{c}._opened")).alias("ordinal"), f"_to_{c}.name"))
        ends = ends.withColumn("_named", F.last(named, ignorenulls=True).over(earlier))
        ends = ends.withColumn(f"_carry_{c}", F.when(F.col("_named.ordinal") == F.col("_from"), F.col("_named.name")))
    sampled = F.filter("sampled", lambda x: x.between(F.col("_low"), F.col("_high"))).alias("sampled")
    ends = ends.join(episodes, "episode", "left")
    return ends.select("episode", "_block", "_end", "_carry", "_from", *(f"_carry_{c}" for c in REFERENTS), "n_frames", sampled, "listed")


def with_history(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``before`` (the segment before: end, action_id, action and state), ``ordinal`` (the number of this
    segment's action in its episode) and ``known`` (the action's participants named before), and the episode's facts.

    Null doesn't name a participant: A, null, B is a change from A to B.  Rows are dealt once, by block: a struct
    is never null, so that the scan and the join can share it as their key.
    """
    at = F.struct("episode", "_block").alias("_at")
    handed = blocks.select(at, *(c for c in blocks.columns if c not in ("episode", "_block", "_end")))
    rows = _scanned(rows.select(at, *(c for c in rows.columns if c not in ("episode", "_block"))), ["_at"]).join(handed, "_at")
    known = (
        F.when(F.col(f"_{c}._opened") == F.col("_opened"), F.col(f"_{c}.name")).when(F.col("_opened") == 0, F.col(f"_carry_{c}")).alias(c)
        for c in REFERENTS
    )
    return rows.select(
        "_at.episode", "start", "_this.*", *(f"_who.{c}" for c in REFERENTS), "_broken", "_proven", "_cited", "n_frames", "sampled", "listed",
        F.coalesce("_lag", "_carry").alias("before"), (F.col("_from") + F.col("_opened")).alias("ordinal"), F.struct(*known).alias("known"),
    )


def atomic_violations(segments: DataFrame, episodes: DataFrame, categories: Sequence[str], cameras: Sequence[str]) -> DataFrame:
    """(rule, episode, place): the rules that segments break, at the segment's start, and those of whole
    episodes (``episodes``: episode, n_frames, sampled frames).

    Segments of an unknown episode break ``unknown_episode``; an episode without segments breaks
    ``no_segments`` at 0.  Repeated segments break ``boundary``, as the second doesn't start where the first ends.
    """
    vocabulary, places = F.array(*map(F.lit, categories)), F.array(*map(F.lit, cameras))
    kinds, failure = F.col("categories"), F.col("failure")
    consequence = [_filled("recovery"), F.col("severity").isin(*SEVERITIES), F.col("resetability").isin(*RESETS), F.size(kinds) > 0]
    alone = {
        "text": _all([_filled(c) for c in TEXTS]),
        "operation": F.col("action").rlike("^[a-z][a-z_]*$"),
        "referent": _all([_nothing(c) | _filled(c) for c in REFERENTS]),
        "label": failure.isNotNull() & F.col("review_required").isNotNull(),
        "categories": (F.size(F.array_except(kinds, vocabulary)) == 0) & (F.size(F.array_distinct(kinds)) == F.size(kinds)),
        "consequence": F.when(failure, F.coalesce(_all(consequence), F.lit(False))).otherwise(
            (F.size(kinds) == 0) & _all([_nothing(c) for c in ("recovery", "severity", "resetability")])
        ),
        "review": F.when(F.col("review_required"), _filled("uncertainty")).otherwise(F.col("uncertainty") == ""),
        "unknown_operation": ~F.col("action").eqNullSafe(F.lit(UNKNOWN)) | F.col("review_required"),
    }
    seen = lambda e: F.array_contains(places, e["camera"]) & (F.length(F.trim(e["observation"])) > 0)
    # what a segment tells alone is judged where it is read: texts and evidence aren't shuffled
    state = F.struct("failure", F.array_sort(F.array_distinct("categories")).alias("categories"))
    rows = segments.select(
        "episode", scans.frames_block("start").alias("_block"), "start", F.struct("end", "action_id", "action", state.alias("state")).alias("_this"),
        F.struct(*REFERENTS).alias("_who"), broken(alone).alias("_broken"), F.col("evidence.frame").alias("_cited"),
        ((F.size("evidence") > 0) & F.forall("evidence", lambda e: F.coalesce(seen(e), F.lit(False)))).alias("_proven"),
    )
    known = episodes.select("episode", "n_frames", "sampled", F.lit(True).alias("listed"))
    blocks = saved(_blocks(rows, known), "atomic")
    same = F.col("before.action_id").eqNullSafe(F.col("action_id")) & F.col("before").isNotNull()
    rules = {
        "unknown_episode": F.col("listed"),
        "boundary": (F.col("start") == F.coalesce("before.end", F.lit(0))) & (F.col("start") < F.col("end")) & (F.col("end") <= F.coalesce("n_frames", "end")),
        "evidence": F.col("_proven") & F.forall("_cited", lambda frame: F.coalesce(F.array_contains("sampled", frame), F.lit(False))),
        "chronology": same | F.col("action_id").eqNullSafe(F.concat(F.lit("a"), F.col("ordinal").cast("string"))),
        "operation_changed": ~same | F.col("action").eqNullSafe(F.col("before.action")),
        "split_action": ~same | ~F.col("state").eqNullSafe(F.col("before.state")),
        "referent_changed": _all([_nothing(c) | F.col(f"known.{c}").isNull() | (F.col(c) == F.col(f"known.{c}")) for c in REFERENTS]),
    }
    found = with_history(rows, blocks).withColumn("rule", F.explode(F.concat("_broken", broken(rules)))).select("rule", "episode", F.col("start").alias("place"))
    ends = blocks.groupBy("episode").agg(F.max("_end").alias("place"))
    tails = known.join(ends, "episode", "left").where("place is null or place <> n_frames")
    whole = F.when(F.col("place").isNull(), "no_segments").otherwise("not_at_end")
    return found.unionByName(tails.select(whole.alias("rule"), "episode", F.coalesce("place", F.lit(0)).cast("long").alias("place")))
