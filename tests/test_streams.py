"""Streams of shuffled micro-batches give what the batch gives."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hardwood.operators import smoothing, state, trackers
from hardwood.streaming import machines

R = random.Random(3)
N = 120
BALLS = "array<struct<x:double,y:double,confidence:double>>"
BOXES = "array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double>>"
POINTS = "array<struct<kp_idx:int,x:double,y:double,valid:boolean>>"


def candidates(f):
    near = sorted((R.random() * 0.3, R.randint(1, 3)) for _ in range(R.randint(0, 3)))
    return [(s, t, R.choice([None, 1.0, -1.0])) for s, t in near] if f // 12 % 3 else [(0.1, f // 36, None)]


def spot(f):
    return 100.0 + 8 * f + R.uniform(-2, 2), 300 - 6.0 * (f % 40) + 0.2 * (f % 40) ** 2


def hand(f):
    k = f % 30
    up = max(k - 12, 0) * 28
    return None if f % 37 == 5 else (500.0 + k, 400.0 - up)


CASES = {
    "possession": ("candidates array<struct<score:double,track_id:int,align:double>>, possessor int, predicted boolean", lambda f: (candidates(f), R.choice([None] * 5 + [2]), R.random() < 0.1), state.possession, machines.possession_stream),
    "shots": ("at_rim boolean, in_basket boolean, action boolean, release boolean, team string, side string, weak_side string", lambda f: (f % 41 in (10, 11), f % 41 in (11, 12) and f % 2 == 0, f % 41 == 7, R.random() < 0.05, R.choice([None, "white", "dark"]), R.choice([None, "left"]), "right"), state.shots, machines.shot_stream),
    "ball": (f"candidates {BALLS}", lambda f: ([(*spot(f), R.random()) for _ in range(R.randint(0, 2))],), state.track_ball, machines.ball_stream),
    "filtered": (f"candidates {BOXES}", lambda f: ([(x - 6, y - 6, x + 6, y + 6, R.random()) for x, y in [spot(f)] * (R.random() < 0.8)],), trackers.filter_ball, machines.filtered_ball_stream),
    "segments": (f"points {POINTS}", lambda f: ([(k, k * 60.0 + 100 * (f // 25), k * 25.0 + R.random(), R.random() < 0.9) for k in range(6)],), trackers.camera_segments, machines.segment_stream),
    "releases": ("wrists array<struct<x:double,y:double>>, ball struct<x:double,y:double>", lambda f: ([(500.0, 400.0), (900.0, 100.0)], hand(f)), smoothing.releases, machines.release_stream),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_batch(spark, tmp_path, name):
    columns, make, batch, stream = CASES[name]
    schema = f"video_id string, frame_index long, {columns}"
    rows = [(v, f, *make(f)) for v in ("a", "b") for f in range(N)]
    frames = spark.createDataFrame(rows, schema)
    want = sorted(map(str, batch(frames).collect()))
    # Frames of both videos in one stream, each up to 20 frames out of place, in four micro-batches; then a frame far later, of another video.
    late = sorted(rows, key=lambda r: r[1] + R.uniform(0, 20))
    parts = [late[i : i + 60] for i in range(0, len(late), 60)] + [[("z", 10_000, *make(0))]]
    source = str(tmp_path / "in")
    for i, part in enumerate(parts):
        one = str(tmp_path / f"part{i}")
        spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds(F.col("frame_index") + 1_700_000_000)).coalesce(1).write.parquet(one)
        os.makedirs(source, exist_ok=True)
        (file,) = (n for n in os.listdir(one) if n.endswith(".parquet"))
        os.rename(f"{one}/{file}", f"{source}/{i}.parquet")
        os.utime(f"{source}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        read = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        run = stream(read, "60 seconds").writeStream.format("memory").queryName(f"out_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert run.awaitTermination(180)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(run.recentProgress) >= len(parts)
    got = spark.table(f"out_{name}").where("video_id != 'z'").collect()
    assert sorted(map(str, got)) == want and len(want) > 1
