"""Frame metadata and rosters as JSON, read and written with their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: a frame's fields.
FRAME = {
    "frame_index": "int",
    "timestamp": "double",
    "players": "array<struct<track_id:bigint,team:string,x_ft:double,y_ft:double,bbox:array<int>,number:int,name:string>>",
    "ball": "struct<bbox:array<int>>",
    "referees": "array<struct<bbox:array<int>>>",
    "rims": "array<struct<bbox:array<int>>>",
    "possessor_track_id": "bigint",
    "shot_side": "string",
    "shot_made": "boolean",
    "homography_confidence": "double",
}


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame of documents in either shape: an object with ``frames``, or a bare array.

    ``video_id`` is the file's path. Of frames with one index the last in the document counts. A
    document of neither shape is an error.
    """
    fields = ",".join(f"{k}:{v}" for k, v in FRAME.items())
    schema = f"team_names array<string>, frames array<struct<{fields}>>, " + ", ".join(f"{k} {v}" for k, v in FRAME.items())
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("video_id", F.input_file_name())
    neither = F.raise_error(F.concat(F.lit("no frames in "), F.col("video_id")))
    bare = F.when(F.col("frame_index").isNotNull(), F.array(F.struct(*FRAME))).otherwise(neither)
    rows = raw.select("video_id", F.monotonically_increasing_id().alias("__at"), F.posexplode_outer(F.coalesce("frames", bare)).alias("__pos", "f"))
    rows = rows.where("f.frame_index is not null")
    last = rows.groupBy("video_id", "f.frame_index").agg(F.max_by("f", F.struct("__at", "__pos")).alias("f"))
    return last.select("video_id", "f.*")


def players_ft(frames: DataFrame) -> DataFrame:
    """One row per player and frame that has a position, in document order (pos)."""
    return frames.select("video_id", "frame_index", F.posexplode("players").alias("pos", "p")).select("video_id", "frame_index", "pos", "p.*").dropna(subset=["x_ft", "y_ft"])


def write_frames(frames: DataFrame, path: str, teams: DataFrame | None = None) -> None:
    """One JSON document per video (of ``frames``, or of ``teams``: video_id, team_names), in a folder of its own; frames in order.

    A document is an object of a line each: the beginning with the team names, a frame, the end. Its lines are sorted by
    Spark and stream into the file, so a video of any length takes no more memory than a frame. Of frames with one
    index all are written. The native form is the table itself.
    """
    fields = [c for c in FRAME if c in frames.columns]
    lines = frames.select("video_id", F.lit(1).alias("__part"), F.col("frame_index").alias("__at"), F.to_json(F.struct(*fields)).alias("value"))
    names = frames.select("video_id").distinct().withColumn("team_names", F.lit(None).cast("array<string>"))
    if teams is not None:
        names = names.select("video_id").union(teams.select("video_id")).distinct().join(teams.select("video_id", "team_names"), "video_id", "left")
    begin = F.concat(F.lit('{"team_names":'), F.coalesce(F.to_json("team_names"), F.lit("null")), F.lit(',"frames":['))
    edge = lambda part, value: names.select("video_id", F.lit(part).alias("__part"), F.lit(None).cast("int").alias("__at"), value.alias("value"))
    rows = lines.unionByName(edge(0, begin)).unionByName(edge(2, F.lit("]}")))
    first = F.row_number().over(Window.partitionBy("video_id").orderBy("__part", "__at", "value")) == 2
    rows = rows.withColumn("value", F.when((F.col("__part") == 1) & ~first, F.concat(F.lit(","), "value")).otherwise(F.col("value")))
    ordered = rows.repartition("video_id").sortWithinPartitions("video_id", "__part", "__at", F.ltrim("value", F.lit(",")))
    ordered.select("video_id", "value").write.partitionBy("video_id").text(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).text(path).withColumn("video_id", F.col("video_id").cast("string"))


def read_frame_lines(spark: SparkSession, path: str) -> DataFrame:
    """The frames of what ``write_frames`` wrote, read by ranges of bytes: a document of any size is many tasks' work.

    A line that is neither a beginning, a frame nor an end is an error. Of frames with one index all are kept.
    """
    lines = _lines(spark, path).where(~F.startswith("value", F.lit('{"team_names":')) & (F.col("value") != "]}"))
    ddl = ",".join(f"{k} {v}" for k, v in FRAME.items())
    return lines.select("video_id", F.from_json(F.ltrim("value", F.lit(",")), ddl, {"mode": "FAILFAST"}).alias("f")).select("video_id", "f.*")


def read_team_names(spark: SparkSession, path: str) -> DataFrame:
    """video_id and team_names of the same documents."""
    begin = _lines(spark, path).where(F.startswith("value", F.lit('{"team_names":')))
    return begin.select("video_id", F.from_json(F.regexp_extract("value", r'^\{"team_names":(.*),"frames":\[$', 1), "array<string>").alias("team_names"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """team, color, number, name of a roster document: team to colour and number-to-name map."""
    raw = spark.read.text(path, wholetext=True)
    teams = raw.select(F.explode(F.from_json("value", "map<string,struct<color:string,players:map<string,string>>>")).alias("team", "t"))
    return teams.select("team", "t.color", F.explode_outer("t.players").alias("number", "name"))


def merge_chunks(chunks: DataFrame, fps: float) -> DataFrame:
    """Frames of chunks (with ``offset``) as one video: shifted indices and new times; fps of 0 or less is 30."""
    rate = fps if fps > 0 else 30.0
    at = F.col("frame_index") + F.col("offset")
    return chunks.withColumn("frame_index", at).withColumn("timestamp", F.round(at / rate, 4)).drop("offset")


def chunk_ranges(total: int, n: int) -> list[tuple[int, int]]:
    """(start, size) of ``n`` contiguous chunks; the first ``total % n`` have one frame more."""
    n = min(n, total)
    sizes = [total // n + (i < total % n) for i in range(n)] if n > 0 else []
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]
