"""Sources and sinks by round trip."""

import json

from hardwood.plans import screens as S
from hardwood.sources import reports as R


def test_annotations_and_numeric_answers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"image":"1.jpg","prefix":"q","suffix":"23"}\n\n{"image":"2.jpg","prefix":"q","suffix":"none"}\n{"image":"3.jpg","prefix":"p","suffix":"7"}\n')
    got = R.read_annotations(spark, str(tmp_path / "a.jsonl"))
    assert got.count() == 3 and [r.image for r in R.numeric_answers(got, "q").collect()] == ["1.jpg"]


def test_coco(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "width": 9, "height": 8}], "categories": [{"id": 4, "name": "rim"}], "annotations": [{"id": 7, "image_id": 1, "category_id": 4, "bbox": [1.0, 2.0, 3.0, 4.0]}, {"id": 8, "image_id": 1, "category_id": 5, "bbox": [0, 0, 1, 1]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    got = {r.annotation_id: r for r in R.read_coco(spark, str(tmp_path / "c.json")).collect()}
    assert (got[7].x1, got[7].y1, got[7].x2, got[7].y2, got[7].category, got[7].file_name) == (1.0, 2.0, 4.0, 6.0, "rim", "a.jpg") and got[8].category is None


def test_log(spark, tmp_path):
    (tmp_path / "t.log").write_text("epoch 0 step 10 loss 1.5\nnoise\n[EPOCH 0] loss medio 1.25\nepoch 1 step 20 loss 0.5\n")
    steps, means = R.read_log(spark, str(tmp_path / "t.log"))
    assert sorted(map(tuple, steps.collect())) == [(0, 10, 1.5), (1, 20, 0.5)] and list(map(tuple, means.collect())) == [(0, 1.25)]


def test_listing_and_metadata(spark, tmp_path):
    for n in ("b.mp4", "a_pipeline_metadata.json"):
        (tmp_path / n).write_text("xy")
    assert [tuple(r) for r in R.list_files(spark, str(tmp_path)).collect()] == [("a_pipeline_metadata.json", 2), ("b.mp4", 2)]
    video = f"{tmp_path}/a.mp4"
    assert R.find_metadata(spark, video, "auto") == f"{tmp_path}/a_pipeline_metadata.json"
    assert R.find_metadata(spark, video, None) is None and R.find_metadata(spark, video, f"{tmp_path}/no.json") is None
    assert R.find_metadata(spark, f"{tmp_path}/c.mp4", "auto") is None


def test_rows_and_notes(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    R.write_rows(df.coalesce(1), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["a", "b"]
    assert R.put_annotations(df, f"{tmp_path}/notes", "j1") == 2 and R.put_annotations(df.limit(1), f"{tmp_path}/notes", "j1") == 1
    R.put_annotations(df, f"{tmp_path}/notes", "j2")
    assert R.get_annotations(spark, f"{tmp_path}/notes", "j1").count() == 1


def test_tactics_documents(spark, tmp_path):
    rows = []
    for f in range(30):
        rows += [("v", f, 1, "white", 20.0, 25.0), ("v", f, 2, "white", 26.0, 25.0), ("v", f, 3, "dark", 22.0, 26.0), ("v", f, 4, "dark", 80.0, 25.0)]
    p = spark.createDataFrame(rows, "video_id string, frame_index long, track_id long, team string, x_ft double, y_ft double")
    holds = p.select("video_id", "frame_index").distinct().selectExpr("*", "1L possessor_track_id")
    videos = spark.createDataFrame([("v", ["A", "B"], 30), ("w", ["C", "D"], 5)], "video_id string, team_names array<string>, n_frames int")
    docs = {r.video_id: json.loads(r.value) for r in R.tactics_documents(S.screens(p, holds), videos).collect()}
    assert docs["w"] == {"team_names": ["C", "D"], "n_frames": 5, "screen_counts": {}, "screens": []}
    only = docs["v"]["screens"][0]
    assert len(docs["v"]["screens"]) == 1 == sum(docs["v"]["screen_counts"].values())
    assert (only["screener_track"], only["start_frame"], only["end_frame"], only["screener_trajectory"]["init"]) == (1, 0, 29, [20.0, 25.0])
    R.write_documents(R.tactics_documents(S.screens(p, holds), videos), f"{tmp_path}/docs", "video_id")
    assert spark.read.text(f"{tmp_path}/docs").count() == 2


def test_shot_documents(spark):
    df = spark.createDataFrame([("c", 30.0, [1, 2], *[1.0] * 6, [[10.0, 0.0, 7.0]], 2.5, 15.0, 30.0, 45.0, True)], "clip string, fps double, frames array<int>, x0 double, vx double, y0 double, vy double, z0 double, vz double, points array<array<double>>, rmse double, apex double, speed double, angle double, plausible boolean")
    doc = json.loads(R.shot_documents(df).first().value)
    assert doc["units"] == "meters" and abs(doc["apex_height_m"] - 4.572) < 1e-9 and abs(doc["release_xyz_m"][2] - 2.1336) < 1e-9 and doc["plausible"]
