"""What a viewer shows at any list of times: the last value of several event streams at once, and joins by track."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.operators.sequences import first_seen_mode


@dataclass(frozen=True)
class Carried:
    """A stream of events of which a time sees the last: its rows, their time and the columns to carry.

    ``linger``: an event is seen for so long, both ends included; always without it. ``until``: the column in which an event
    says how long it is seen. ``clamp``: a time before all events sees the first.
    """

    rows: DataFrame
    time: str
    values: list[str]
    linger: float | None = None
    until: str | None = None
    clamp: bool = False


def carried_at(times: DataFrame, keys: list[str], at: str, streams: dict[str, Carried]) -> DataFrame:
    """``times`` with a struct (time and values) for each of ``streams``: its last event at or before ``at``, null without one.

    One union of all rows and one sort a key serve all streams, so no pairs of times and events are formed. Of events at
    one time the last in the order of their values counts. The first event of a clamped stream is one row a key.
    """
    names = [f"__{k}" for k in keys]
    keyed = lambda df: [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    both = times.select(*keyed(times), F.col(at).cast("double").alias("__t"), F.lit(1).alias("__side"), F.struct(*times.columns).alias("__row"))
    for name, s in streams.items():
        kept = [s.time, *s.values, *([s.until] if s.until and s.until not in s.values else [])]
        mark = F.struct(*(F.col(c) for c in dict.fromkeys(kept)))
        both = both.unionByName(s.rows.where(F.col(s.time).isNotNull()).select(*keyed(s.rows), F.col(s.time).cast("double").alias("__t"), F.lit(0).alias("__side"), mark.alias(f"__{name}_last")), allowMissingColumns=True)
    order = [F.asc_nulls_first("__t"), "__side", *(F.asc_nulls_first(f"__{n}_last") for n in streams)]
    w = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumns({f"__{n}_seen": F.last(f"__{n}_last", ignorenulls=True).over(w) for n in streams}).where("__side = 1")
    for name, s in streams.items():
        seen = F.when(F.col("__t").isNotNull(), F.col(f"__{name}_seen"))
        if s.clamp:
            first = s.rows.where(F.col(s.time).isNotNull()).groupBy(*keyed(s.rows)).agg(F.min(F.struct(*dict.fromkeys([s.time, *s.values]))).alias(f"__{name}_first"))
            out = out.join(first, names, "left")
            seen = F.coalesce(seen, F.col(f"__{name}_first"))
        fresh = F.lit(True)
        if s.linger is not None:
            fresh = fresh & (F.col("__t") <= seen[s.time].cast("double") + s.linger)
        if s.until is not None:
            fresh = fresh & (F.col("__t") <= seen[s.until].cast("double"))
        shown = F.when(seen.isNotNull() & fresh, F.struct(*(seen[c].alias(c) for c in dict.fromkeys([s.time, *s.values]))))
        out = out.withColumn(name, shown)
    return out.select("__row.*", *streams)


def possessor_boxes(frames: DataFrame, players: DataFrame, keys: list[str]) -> DataFrame:
    """``frames`` (keys, possessor_track_id) with the box (x1 to y2) of the player who has the ball, null without one."""
    held = players.select(*keys, F.col("track_id").alias("possessor_track_id"), *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    return frames.join(held.dropDuplicates([*keys, "possessor_track_id"]), [*keys, "possessor_track_id"], "left")


def track_names(players: DataFrame, roster: DataFrame, sides: DataFrame) -> DataFrame:
    """track_id, number, side and name: each track's commonest number and side over its frames (of equally common ones the first
    seen), named by the roster (team, number, name) of the team that plays on that side (``sides``: side, team)."""
    number = first_seen_mode(players, ["track_id"], "number", "frame_index").select("track_id", "number")
    side = first_seen_mode(players, ["track_id"], "side", "frame_index").select("track_id", "side")
    rows = number.join(side, "track_id", "left").join(sides, "side", "left")
    return rows.join(roster.select("team", "number", "name"), ["team", "number"], "left").select("track_id", "number", "side", "name")


def selected(players: DataFrame, chosen: DataFrame) -> DataFrame:
    """``players`` with ``dimmed``: whether others are selected (``chosen``: track_id) but not this one."""
    marks = chosen.select("track_id").distinct()
    some = marks.agg((F.count("*") > 0).alias("__some"), F.lit(1).alias("__one"))
    met = players.join(marks.withColumn("__chosen", F.lit(True)), "track_id", "left").withColumn("__one", F.lit(1)).join(F.broadcast(some), "__one", "left")
    return met.select(*players.columns, (F.coalesce("__some", F.lit(False)) & F.col("__chosen").isNull()).alias("dimmed"))
