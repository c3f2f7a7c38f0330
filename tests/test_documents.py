"""Frame documents of any length written and read by streaming, and small operators on odd rows."""

import glob
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hardwood.functions import geometry as G
from hardwood.functions import labels as L
from hardwood.operators import state as K
from hardwood.operators import summaries as S
from hardwood.sources import documents as D


def frames(spark, n, videos=("a", "b c", "100")):
    rows = spark.range(n).select(F.col("id").cast("int").alias("frame_index"), F.explode(F.array(*map(F.lit, videos))).alias("video_id"))
    player = F.struct(F.lit(1).cast("long").alias("track_id"), F.lit('wh"ite,{').alias("team"), (F.col("frame_index") / 3).alias("x_ft"), F.lit(2.0).alias("y_ft"), F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("bbox"), F.lit(7).alias("number"), F.lit("Ann").alias("name"))
    made = {"timestamp": F.col("frame_index") / 30, "players": F.array(player), "ball": F.struct(F.array(F.lit(1), F.lit(1), F.lit(9), F.lit(9)).alias("bbox")), "referees": F.array().cast(D.FRAME["referees"]), "rims": F.lit(None).cast(D.FRAME["rims"]), "possessor_track_id": F.when(F.col("frame_index") % 2 == 0, F.lit(1).cast("long")), "shot_side": F.lit(None).cast("string"), "shot_made": F.lit(True), "homography_confidence": F.lit(0.5)}
    return rows.withColumns(made).select("video_id", *D.FRAME)


def test_documents_go_there_and_back(spark, tmp_path):
    df = frames(spark, 40).repartition(7)
    teams = spark.createDataFrame([("a", ["X", "Y"]), ("100", None), ("empty", ["P", "Q"])], "video_id string, team_names array<string>")
    path = str(tmp_path / "docs")
    D.write_frames(df, path, teams)
    docs = {}
    for f in glob.glob(f"{path}/video_id=*/part-*"):
        name = f.split("video_id=")[1].split("/")[0].replace("%20", " ")
        assert name not in docs  # one document a video
        docs[name] = json.load(open(f))
    assert {v: d["team_names"] for v, d in docs.items()} == {"a": ["X", "Y"], "b c": None, "100": None, "empty": ["P", "Q"]}
    assert [[f["frame_index"] for f in docs[v]["frames"]] for v in ("a", "b c", "100", "empty")] == [list(range(40))] * 3 + [[]]
    key = lambda d: sorted(map(str, d.select("video_id", *D.FRAME).collect()))
    assert key(D.read_frame_lines(spark, path)) == key(df)
    assert {r.video_id: r.team_names for r in D.read_team_names(spark, path).collect()} == {v: d["team_names"] for v, d in docs.items()}
    # The reader of any layout takes them as well.
    assert D.read_frames(spark, f"{path}/video_id=a").count() == 40


def test_a_long_document_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "long")
    D.write_frames(frames(spark, 30_000, ("one",)), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        back = D.read_frame_lines(spark, path)
        sizes = [r["count"] for r in back.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(sizes) > 4 and max(sizes) < 10_000 and sum(sizes) == 30_000
        assert back.agg(F.sum("frame_index")).first()[0] == sum(range(30_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_damaged_line_is_an_error(spark, tmp_path):
    path = tmp_path / "docs"
    D.write_frames(frames(spark, 3, ("a",)), str(path))
    (f,) = glob.glob(f"{path}/video_id=a/part-*")
    text = open(f).read().replace('"shot_made":true', '"shot_made":tr', 1)
    other = tmp_path / "bad" / "video_id=a"
    other.mkdir(parents=True)
    (other / "part-0").write_text(text)
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        D.read_frame_lines(spark, str(tmp_path / "bad")).collect()


def test_results_are_shown_for_a_while(spark):
    rows = spark.createDataFrame([("a", 2 * f) for f in range(60)] + [("b", 0)], "video_id string, frame_index long")
    ends = spark.createDataFrame([("a", 20, True, "left"), ("a", 80, False, None)], "video_id string, end_frame long, made boolean, side string")
    got = {(r.video_id, r.frame_index): r.made for r in K.shown_results(rows, ends).collect()}
    assert got == {("a", 2 * f): True if 10 <= f < 35 else False if f >= 40 else None for f in range(60)} | {("b", 0): None}


def test_tokens_bounds_and_labels(spark):
    rows = spark.createDataFrame([("1, 0,1,,7", ["0", "1"]), (None, ["0"]), ("5", []), ("", [])], "t string, a array<string>")
    assert [r[0] for r in rows.select(L.tokens_of(F.col("t"), F.col("a"), "0")).collect()] == [["1", "0"], ["0"], ["5"], ["0"]]
    one = spark.range(1)
    assert one.select(L.clamped(F.lit(3.0), 0.05, 1.0), L.one_of(F.lit("x"), ["a"], "a"), L.clock_text(F.lit(65.9)), L.byte_text(F.lit(1536))).first()[:] == (1.0, "a", "1:05", "1.5 KB")
    u, v = G.letterboxed(F.lit(640.0), F.lit(360.0), (F.lit(1280.0), F.lit(720.0)), (F.lit(1000.0), F.lit(1000.0)))
    assert one.select(u, v).first()[:] == (500.0, 500.0)
    h = F.array(*map(F.lit, (2.0, 0.0, 10.0, 0.0, 4.0, -8.0, 0.0, 0.0, 1.0)))
    assert one.select(*G.project_back(h, F.lit(14.0), F.lit(0.0))).first()[:] == (2.0, 2.0)
    assert one.select(*G.project_back(F.array_repeat(F.lit(0.0), 9), F.lit(1.0), F.lit(1.0))).first()[:] == (None, None)


def test_stage_times_and_speed_up(spark):
    laps = spark.createDataFrame([(1, "b", 5, 2.0, 10), (1, "a", 9, 1.0, 10), (1, "b", 7, 1.0, 10), (2, "a", 0, 0.0, 10), (3, "a", 0, 1.0, 0)], "run int, stage string, at int, seconds double, frames int")
    assert sorted((r.stage, r.seconds, r.share, r.ms_a_frame, r.place) for r in S.stage_times(laps, ["run"]).collect()) == [("a", 1.0, 25.0, 100.0, 2), ("b", 3.0, 75.0, 300.0, 1)]
    runs = spark.createDataFrame([("x", 1, 187.0, 7.0), ("x", 2, 126.7, 6.0), ("y", 1, 5.0, 1.0)], "clip string, workers int, wall double, memory double")
    assert sorted(map(tuple, S.speed_up(runs, ["clip"]).collect())) == [("x", 1.48, 0.738, 7.0), ("y", None, None, 1.0)]


BOXES = "array<struct<x1:double,y1:double,x2:double,y2:double,confidence:double>>"


def test_ball_boxes_keep_the_size_they_were_seen_with(spark):
    seen = [[(0.0, 0.0, 10.0, 20.0, 0.9)], [(10.0, 0.0, 30.0, 10.0, None)], None, [(500.0, 500.0, 510.0, 510.0, 0.8)], [(0.0, 0.0, 1.0, 1.0, 0.1)], []]
    df = spark.createDataFrame([("v", f, c) for f, c in enumerate(seen)], f"video_id string, frame_index long, candidates {BOXES}")
    got = [tuple(r)[2:] for r in K.track_ball_boxes(df).orderBy("frame_index").collect()]
    x, y = 0.55 * 20 + 0.45 * 5, 0.55 * 5 + 0.45 * 10
    held = (x - 10, y - 5, x + 10, y + 5, 1.0, x - 5, y - 10)
    assert got[0] == (0.0, 0.0, 10.0, 20.0, 0.9, 0.0, 0.0, False)
    assert all(np.allclose(g[:7], held) for g in got[1:]) and [g[7] for g in got[1:]] == [False, True, True, True, True]


def test_the_simple_ball_has_no_memory(spark):
    seen = [[(0.0, 0.0, 10.0, 10.0, 0.5), (4.0, 0.0, 14.0, 10.0, 0.5)], [(10.0, 2.0, 20.0, 12.0, None), (0.0, 0.0, 1.0, 1.0, 0.9)], [(0.0, 0.0, 1.0, 1.0, 0.2)], [(50.0, 0.0, 60.0, 10.0, 0.3)], None]
    df = spark.createDataFrame([("v", f, c) for f, c in enumerate(seen)], f"video_id string, frame_index long, candidates {BOXES}")
    got = [tuple(r)[1:] for r in K.surest_ball(df).orderBy("frame_index").collect()]
    assert got == [(0, 0.0, 0.0, 10.0, 10.0, 0.5, 0.0, 0.0, False), (1, 10.0, 2.0, 20.0, 12.0, 1.0, 10.0, 2.0, False), (3, 50.0, 0.0, 60.0, 10.0, 0.3, 0.0, 0.0, False)]
