"""Masks as runs of a row's pixels (y, x1 to x2, both included): areas, overlaps, boxes and feet without a row per pixel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.operators.joins import first_by
from hardwood.operators.scene import BAND

# Fixed value: share of the smaller of a number's box and a player's mask by which the number is that player's.
NUMBER_ON_MASK = 0.9

RUNS = "array<struct<y:int,x1:int,x2:int>>"


def runs_of_pixels(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and runs (RUNS, in the order of rows and columns) of each mask's pixels (keys, x, y); repeated pixels count once."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    rows = pixels.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).distinct()
    rows = rows.withColumn("__island", F.col("x") - F.row_number().over(w))
    each = rows.groupBy(*keys, "y", "__island").agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("y", "x1", "x2"))).alias("runs"))


def bit_runs(bits: np.ndarray) -> np.ndarray:
    """(n, 3): y, x1, x2 of the runs of a mask (height, width)."""
    edges = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (y, x1), (_, x2) = np.nonzero(edges == 1), np.nonzero(edges == -1)
    return np.stack([y, x1, x2 - 1], 1).astype(np.int32)


def runs_of_bits(masks: DataFrame, keys: list[str], bits: str = "bits") -> DataFrame:
    """keys and runs of masks whose ``bits`` are packed row by row, ``width`` and ``height`` pixels, first pixel in the highest
    bit. A mask whose bits are too few for its size is an error; null bits give null runs."""
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in masks.select(*keys).schema), f"runs {RUNS}"])
    kind = pa.list_(pa.struct([("y", pa.int32()), ("x1", pa.int32()), ("x2", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw, w, h in zip(*(b.column(c).to_pylist() for c in (bits, "width", "height")), strict=True):
                if raw is None:
                    out.append(None)
                    continue
                if 8 * len(raw) < w * h:
                    raise ValueError(f"{len(raw)} bytes are too few for {w} x {h} pixels")
                found = bit_runs(np.unpackbits(np.frombuffer(raw, np.uint8), count=w * h).reshape(h, w))
                out.append([dict(zip(("y", "x1", "x2"), r, strict=True)) for r in found.tolist()])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(out, kind)], [*keys, "runs"])

    return masks.select(*keys, bits, "width", "height").mapInArrow(run, ddl)


def _total(runs: Column, of) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda s, r: s + of(r).cast("long"))


def mask_area(runs: Column) -> Column:
    return _total(runs, lambda r: r["x2"] - r["x1"] + 1)


def overlap_with_box(runs: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Pixels that a mask shares with a box of whole pixels, its edges included."""
    inside = lambda r: F.when(r["y"].between(y1, y2), F.greatest(F.lit(0), F.least(r["x2"], x2) - F.greatest(r["x1"], x1) + 1)).otherwise(0)
    return _total(runs, inside)


def overlap_of_masks(a: DataFrame, b: DataFrame, keys: list[str], ids: tuple[str, str]) -> DataFrame:
    """keys, both ids and shared pixels of the masks (keys, id, runs) of one frame that share any: runs meet by row."""
    left = a.select(*keys, ids[0], F.explode("runs").alias("r")).select(*keys, ids[0], F.col("r.y").alias("__y"), F.col("r.x1").alias("__a1"), F.col("r.x2").alias("__a2"))
    right = b.select(*keys, ids[1], F.explode("runs").alias("r")).select(*keys, ids[1], F.col("r.y").alias("__y"), F.col("r.x1").alias("__b1"), F.col("r.x2").alias("__b2"))
    shared = F.least("__a2", "__b2") - F.greatest("__a1", "__b1") + 1
    return left.join(right, [*keys, "__y"]).where(shared > 0).groupBy(*keys, *ids).agg(F.sum(shared.cast("long")).alias("shared"))


def numbers_on_masks(numbers: DataFrame, masks: DataFrame, keys: list[str], least: float = NUMBER_ON_MASK) -> DataFrame:
    """keys, number_idx, track_id and ios: the player whose mask each number lies on, of equal ones the first (``pos``).

    ``numbers``: keys, number_idx, x1 to y2 (whole pixels, edges included); ``masks``: keys, pos, track_id, runs. The overlap
    is divided by the smaller area. A frame in which a player has no mask (null or empty runs) is left out, as boxes decide there.
    """
    lacking = F.max((F.coalesce(F.size("runs"), F.lit(0)) <= 0).cast("int"))
    whole = masks.join(masks.groupBy(*keys).agg(lacking.alias("__lacking")).where("__lacking = 0").select(*keys), keys, "left_semi")
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    met = numbers.join(whole.select(*keys, "pos", "track_id", "runs"), keys)
    small = F.least(mask_area(F.col("runs")), (box[2] - box[0] + 1) * (box[3] - box[1] + 1))
    met = met.withColumn("ios", F.when(small > 0, overlap_with_box(F.col("runs"), *box) / small).otherwise(0.0)).drop("runs")
    best = first_by(met, [*keys, "number_idx"], F.desc("ios"), "pos")
    return best.where(F.col("ios") >= least).select(*keys, "number_idx", "track_id", "ios")


def foot_of_runs(y: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> tuple[int, ...]:
    """Box and foot of a mask: the lower medians of the columns in the middle BAND and of their lowest pixels; of all columns
    where the middle has none."""
    left, right = int(x1.min()), int(x2.max())
    low = np.full(right - left + 1, -1, np.int64)
    for i in np.argsort(y, kind="stable"):
        low[x1[i] - left : x2[i] - left + 1] = y[i]
    columns = np.flatnonzero(low >= 0)
    side = int((right - left) * (1.0 - BAND) / 2.0)
    middle = columns[(columns >= side) & (columns <= right - left - side)]
    use = middle if len(middle) else columns
    return left, int(y.min()), right, int(y.max()), left + int(use[(len(use) - 1) // 2]), int(np.sort(low[use])[(len(use) - 1) // 2])


def mask_feet(masks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, x1, y1, x2, y2, foot_x and foot_y of each mask (keys, runs); empty ones are left out. A mask takes as much memory as
    it has runs and columns."""
    names = ("x1", "y1", "x2", "y2", "foot_x", "foot_y")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in masks.select(*keys).schema), *(f"{n} long" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = b.column("runs")
            y, x1, x2 = (runs.values.field(c).to_numpy() for c in ("y", "x1", "x2"))
            at = runs.offsets.to_numpy()
            rows = [foot_of_runs(y[i:j], x1[i:j], x2[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            cells = np.array(rows, np.int64).reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *map(pa.array, cells)], [*keys, *names])

    return masks.where("size(runs) > 0").select(*keys, "runs").mapInArrow(run, ddl)
