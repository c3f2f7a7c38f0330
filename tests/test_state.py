"""State machines and the batch and streaming forms of possession."""

from hardwood.operators import state as K
from hardwood.sources.documents import chunk_ranges


def play(start, step, rows, **kw):
    s, out = start(), []
    for i, r in enumerate(rows):
        out += step(s, {"frame_index": i} | r, **kw)
    return out


def near(*tracks):
    return {"candidates": [{"track_id": t, "edge": e} for t, e in tracks]}


def test_possession_needs_three_frames_and_comes_loose():
    got = [r["possessor_track_id"] for r in play(K.possession_start, K.possession_step, [near((1, 0.0))] * 3 + [near()] * 5)]
    assert got == [None, None, 1, 1, 1, 1, 1, None]


def test_possession_keeps_the_holder_on_ties():
    rows = [near((1, 0.0), (2, 0.3))] + [near((1, 0.05), (2, 0.0))] * 3
    assert [r["possessor_track_id"] for r in play(K.possession_start, K.possession_step, rows, switch=1, tie=0.1)] == [1] * 4


def shot(rim=False, bib=False, action=False, **more):
    return {"at_rim": rim, "in_basket": bib, "action": action} | more


def test_shots():
    made = play(K.shot_start, K.shot_step, [shot(action=True, team="white", side="left"), shot(rim=True), shot(bib=True), shot(bib=True)])
    assert [(r["made"], r["team"], r["side"]) for r in made] == [(True, "white", "left")]
    missed = play(K.shot_start, K.shot_step, [shot(rim=True)] + [shot()] * 4)
    assert [r["made"] for r in missed] == [False]
    assert play(K.shot_start, K.shot_step, [shot(action=True)] + [shot()] * 60) == []
    assert len(play(K.shot_start, K.shot_step, [shot(bib=True)] * 20)) == 1


def test_ball_holds_over_and_smooths():
    rows = [{"candidates": [{"x": 10.0 * i, "y": 0.0, "confidence": 0.9}]} for i in range(3)] + [{"candidates": None}] * 3
    got = play(K.ball_start, K.ball_step, rows, holdover=2)
    assert [r["predicted"] for r in got] == [False] * 3 + [True] * 2 and got[1]["x"] == 5.5


def test_chunks():
    assert [s for _, s in chunk_ranges(100, 3)] == [34, 33, 33] and chunk_ranges(0, 4) == [] and len(chunk_ranges(2, 8)) == 2


def test_frames_of_both_shapes(spark, tmp_path):
    import json

    from hardwood.sources.documents import players_ft, read_frames

    frame = {"frame_index": 1, "players": [{"track_id": 7, "x_ft": 1.0, "y_ft": 2.0}, {"track_id": 8}], "ball": {"bbox": [1, 2, 3, 4]}}
    (tmp_path / "a.json").write_text(json.dumps({"team_names": ["x"], "frames": [{"frame_index": 1}, frame]}))
    (tmp_path / "b.json").write_text(json.dumps([frame, {"frame_index": 2}]))
    frames = read_frames(spark, f"{tmp_path}/*.json")
    assert frames.count() == 3
    assert [r.track_id for r in players_ft(frames).collect()] == [7, 7]
