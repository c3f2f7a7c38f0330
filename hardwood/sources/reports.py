"""Annotations, logs and listings read; tactics, shots and reports written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hardwood.functions.geometry import M_PER_FT

# The lines of a training log.
STEP_LINE, MEAN_LINE = r"epoch (\d+) step (\d+) loss ([\d.]+)", r"\[EPOCH (\d+)\] loss medio ([\d.]+)"
# Endings of a video's metadata document, the first that exists counts.
METADATA_NAMES = ("_metadata.json", "_pipeline_metadata.json")
# Fixed value: the question of an annotation that names none.
QUESTION = "Read the number."


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """image, prefix, suffix of each line of JSON; blank lines are skipped, a malformed one is an error. Without a prefix it is QUESTION."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = F.from_json("value", "image string, prefix string, suffix string", {"mode": "FAILFAST"})
    return lines.select(read.alias("a")).select("a.image", F.coalesce("a.prefix", F.lit(QUESTION)).alias("prefix"), "a.suffix")


def numeric_answers(annotations: DataFrame, prefix: str = QUESTION) -> DataFrame:
    """Lines of one question whose answer is digits only."""
    return annotations.where((F.col("prefix") == prefix) & F.col("suffix").rlike("^[0-9]+$"))


def read_coco(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotated box: image_id, file_name, width, height, category, and its corners."""
    schema = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>>>, categories array<struct<id:bigint,name:string>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("__file", F.input_file_name())
    images = raw.select("__file", F.explode("images").alias("i")).select("__file", F.col("i.id").alias("image_id"), "i.file_name", "i.width", "i.height")
    kinds = raw.select("__file", F.explode("categories").alias("c")).select("__file", F.col("c.id").alias("category_id"), F.col("c.name").alias("category"))
    marks = raw.select("__file", F.explode("annotations").alias("a")).select("__file", F.col("a.id").alias("annotation_id"), "a.image_id", "a.category_id", F.col("a.bbox").alias("b"))
    x, y, w, h = (F.col("b")[i] for i in range(4))
    boxes = marks.join(images, ["__file", "image_id"]).join(kinds, ["__file", "category_id"], "left")
    return boxes.select("image_id", "file_name", "width", "height", "annotation_id", "category", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(epoch, step, loss) and (epoch, mean) of a training log; of means of one epoch any counts, as they are equal."""
    lines = spark.read.text(path)
    part = lambda pattern, i, kind: F.regexp_extract("value", pattern, i).cast(kind)
    steps = lines.where(F.col("value").rlike(STEP_LINE)).select(part(STEP_LINE, 1, "int").alias("epoch"), part(STEP_LINE, 2, "int").alias("step"), part(STEP_LINE, 3, "double").alias("loss"))
    means = lines.where(F.col("value").rlike(MEAN_LINE)).groupBy(part(MEAN_LINE, 1, "int").alias("epoch")).agg(F.max(part(MEAN_LINE, 2, "double")).alias("mean"))
    return steps, means


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """name and size of a folder's files, by name; no file is opened."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size")).orderBy("name")


def find_metadata(spark: SparkSession, video: str, explicit: str | None, more: tuple[str, ...] = ()) -> str | None:
    """Path of a video's metadata: ``explicit`` if it exists; for "auto" the first of METADATA_NAMES beside the
    video or in the folders of ``more``. Any file system that Spark reads will do."""
    if explicit is None:
        return None
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def is_file(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    folder, _, name = video.rpartition("/")
    stem = name.rpartition(".")[0] or name
    wanted = [explicit] if explicit.strip().lower() != "auto" else [f"{d}/{stem}{e}" if d else f"{stem}{e}" for d in (folder, *more) for e in METADATA_NAMES]
    return next((p for p in wanted if is_file(p)), None)


def write_rows(rows: DataFrame, path: str) -> None:
    """Comma-separated lines with a header, in the order of the columns."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def tactics_documents(screens: DataFrame, videos: DataFrame) -> DataFrame:
    """video_id and one JSON document a video (of ``videos``: video_id, team_names, n_frames): the count of each type and
    the screens in order, places rounded to three digits. Videos without screens have an empty list."""
    spot = lambda c: F.transform(F.array(F.col(f"{c}.x_ft"), F.col(f"{c}.y_ft")), lambda v: F.round(v, 3))
    way = lambda who: F.struct(*(spot(f"{who}_{p}").alias(p) for p in ("init", "screen", "last"))).alias(f"{who}_trajectory")
    order = F.struct("start_frame", "screener", "screenee")
    event = F.struct(F.col("screener").alias("screener_track"), F.col("screenee").alias("screenee_track"), "team", "screen_type", "basket", "start_frame", "screen_frame", "end_frame", way("screener"), way("screenee"))
    each = screens.select("video_id", "screen_type", F.struct(order.alias("o"), event.alias("e")).alias("s"))
    lists = each.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["e"]).alias("screens"))
    counts = each.groupBy("video_id", "screen_type").agg(F.count("*").alias("n")).groupBy("video_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("screen_type", "n")))).alias("screen_counts"))
    kinds = lists.join(counts, "video_id")
    doc = videos.join(kinds, "video_id", "left")
    empty = {c: F.coalesce(c, F.from_json(F.lit(e), kinds.schema[c].dataType)) for c, e in (("screen_counts", "{}"), ("screens", "[]"))}
    return doc.withColumns(empty).select("video_id", F.to_json(F.struct("team_names", "n_frames", "screen_counts", "screens")).alias("value"))


def shot_documents(shots: DataFrame) -> DataFrame:
    """clip and one JSON document in metres for each fitted shot (clip, fps, frames, x0 to vz, points: array of x, y, z,
    rmse, apex, speed, angle, plausible; all in feet), with ``overlay`` where there is one."""
    metres = lambda *cs: F.array(*(F.col(c) * M_PER_FT for c in cs))
    points = F.transform("points", lambda p: F.transform(p, lambda v: v * M_PER_FT))
    fields = [
        "clip", F.lit("meters").alias("units"), "fps", "frames", metres("x0", "vx", "y0", "vy", "z0", "vz").alias("params_X0_Vx_Y0_Vy_Z0_Vz_m"), points.alias("points_3d_m"), F.col("rmse").alias("reproj_rmse_px"),
        (F.col("apex") * M_PER_FT).alias("apex_height_m"), F.element_at(points, 1).alias("release_xyz_m"), (F.col("speed") * M_PER_FT).alias("launch_speed_mps"), F.col("angle").alias("launch_angle_deg"), "plausible",
    ] + (["overlay"] if "overlay" in shots.columns else [])
    return shots.select("clip", F.to_json(F.struct(*fields)).alias("value"))


def write_documents(documents: DataFrame, path: str, key: str) -> None:
    """One text per document, in a folder for each ``key``."""
    documents.select(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def put_annotations(notes: DataFrame, path: str, job_id: str) -> int:
    """Replace what is stored for a job; returns how many notes were saved."""
    notes.write.mode("overwrite").parquet(f"{path}/job_id={job_id}")
    return notes.sparkSession.read.schema(notes.schema).parquet(f"{path}/job_id={job_id}").count()


def get_annotations(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).where(F.col("job_id") == job_id).drop("job_id")
