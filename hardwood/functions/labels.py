"""Texts, colours, labels and scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hardwood.functions.geometry import hex_channel


def colour_distance(a: Column, b: Column) -> Column:
    """Sum of the squared differences of two colours' channels; null if either is no colour."""
    parts = [hex_channel(a, i) - hex_channel(b, i) for i in range(3)]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def is_colour(c: Column) -> Column:
    return c.rlike("^#[0-9a-fA-F]{6}$")


def parse_pair(c: Column) -> Column:
    """The two trimmed parts around the first comma; null without one."""
    parts = F.split(c, ",", 2)
    return F.when(F.size(parts) == 2, F.transform(parts, lambda x: F.trim(x)))


def sibling_path(path: Column, ending: str) -> Column:
    """The path beside a metadata document: its name without extension and ``_metadata``, and ``ending``."""
    return F.concat(F.regexp_replace(path, r"(_metadata)?\.[^./]*$", ""), F.lit(ending))


def player_label(number: Column, name: Column, track_id: Column) -> Column:
    numbered = F.when(number.isNotNull(), F.concat(F.lit("#"), number.cast("string")))
    return F.coalesce(F.when(name.isNotNull(), F.concat_ws(" ", numbered, name)), numbered, F.concat(F.lit("ID:"), track_id.cast("string")))


def decayed_confidence(last: Column, held: Column, most: int = 30) -> Column:
    return last * (1 - held / most)


def fit_confidence(inliers: Column, residual: Column) -> Column:
    return 0.6 * F.least(inliers / 33, F.lit(1.0)) + 0.4 * F.greatest(1 - residual / 15, F.lit(0.0))


def corners_of(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
    return x, y, x + w, y + h


def on_canvas(x: Column, y: Column, scale: float, pad: float) -> tuple[Column, Column]:
    return F.rint(pad + x * scale).cast("int"), F.rint(pad + y * scale).cast("int")


def byte_text(n: Column) -> Column:
    """A size in MB from one mebibyte on, else in KB, with one decimal."""
    return F.when(n >= 1 << 20, F.concat(F.format_string("%.1f", n / (1 << 20)), F.lit(" MB"))).otherwise(F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB")))


def clock_text(seconds: Column) -> Column:
    s = F.floor(seconds).cast("int")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def file_label(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^.]+$", ""), "[_-]+", " "))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clamped(c: Column, least: float, most: float) -> Column:
    return F.least(F.greatest(c, F.lit(least)), F.lit(most))


def one_of(c: Column, allowed: list[str], default: str) -> Column:
    return F.when(c.isin(allowed), c).otherwise(F.lit(default))


def tokens_of(c: Column, available: Column, default: str) -> Column:
    """The comma-separated tokens, each once and in order, that are available (all, if that is empty); ``default`` alone without any."""
    tokens = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))
    kept = F.filter(tokens, lambda t: (F.size(available) == 0) | F.array_contains(available, t))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(default)))


def bottleneck(ms: Column, least: float = 400.0) -> Column:
    return F.when(ms >= least, "bottleneck").otherwise("fine")


def recency(age_days: Column) -> Column:
    return F.when(age_days < 1, "today").when(age_days < 7, "7d").when(age_days < 30, "30d").otherwise("older")


def frame_rate(fps: Column, default: float = 30.0) -> Column:
    """A video's frames a second; ``default`` where the file says none."""
    return F.when(fps > 0, fps).otherwise(F.lit(default))


def frame_time(frame_index: Column, fps: Column) -> Column:
    return F.round(frame_index / frame_rate(fps), 4)
