"""The order-dependent operators as streams: the batch step functions over keyed state, late frames put in order."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hardwood.operators import smoothing, state, trackers

Start, Step = Callable[[], dict], Callable[[dict, dict], list[dict]]


def stepped(frames: DataFrame, start: Start, step: Step, schema: str, delay: str = "10 seconds") -> DataFrame:
    """``step`` over the frames of each video of a stream (video_id, frame_index, at: a timestamp, what the step reads), in order.

    A frame waits until the watermark, ``delay`` behind the latest ``at`` of the stream, has passed it; frames that
    come in any order within the delay give what ``run_per_video`` gives. What comes later than the watermark is dropped. A
    video's last frames go out by a timer once the watermark has passed them. Frames of equal index keep the order they
    came in. The state holds the machine's and the waiting frames.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        machine, waiting = pickle.loads(held.get[0]) if held.exists else (start(), [])
        if not held.hasTimedOut:
            for pdf in batches:
                rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
                waiting += [(r.pop("__ms"), r) for r in rows]
        mark = held.getCurrentWatermarkMs()
        due = sorted((w for w in waiting if w[0] <= mark), key=lambda w: w[1]["frame_index"])
        waiting = [w for w in waiting if w[0] > mark]
        out = [{"video_id": key[0]} | r for _, row in due for r in step(machine, row)]
        held.update((pickle.dumps((machine, waiting)),))
        if waiting:
            held.setTimeoutTimestamp(min(w[0] for w in waiting))
        yield pd.DataFrame(out, columns=names)

    marked = frames.withWatermark("at", delay).withColumn("__ms", F.unix_millis("at"))
    return marked.groupBy("video_id").applyInPandasWithState(update, schema, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def possession_stream(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """``state.possession`` of a stream: candidates, possessor and predicted as there."""
    return stepped(frames, state.possession_start, state.possession_step, state.POSSESSION, delay)


def shot_stream(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return stepped(frames, state.shot_start, state.shot_step, state.SHOTS, delay)


def ball_stream(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return stepped(frames, state.ball_start, state.ball_step, state.BALL, delay)


def filtered_ball_stream(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return stepped(frames, trackers.filter_start, trackers.filter_step, trackers.FILTERED, delay)


def segment_stream(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return stepped(frames, trackers.segment_start, trackers.segment_step, trackers.SEGMENTS, delay)


def release_stream(frames: DataFrame, delay: str = "10 seconds") -> DataFrame:
    return stepped(frames, smoothing.release_start, smoothing.release_step, smoothing.RELEASES, delay)
