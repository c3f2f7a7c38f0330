"""Registered queries over cameras and shots in space. Scenes are made of table values: which focal length a video has, where
its camera looks and which frames are empty, and how a ball is thrown, all come from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.operators import cameras as C
from hardwood.operators import shots3d as S
from hardwood.plans.queries import WITH, players, query, table
from hardwood.sources.reports import shot_documents

# Image size, the place of the camera and what it looks at, in feet, beside what the tables add.
WIDTH, HEIGHT, EYE, LOOK_Y = 1280, 720, (47.0, -45.0, 32.0), 25.0
VIEW_SQL = f"""{WITH}, fo as (select event_id//1000 clip, 900.0e0+user_id%400 f from events where event_id%1000=0),
 vi as (select p.frame_index, f, case when frame_index%100<40 then 47.0e0 else 47.0e0+(x_ft-15)/2 end - 47.0e0 dx, 70.0e0 dy, -32.0e0 dz from p join fo on fo.clip=frame_index//100 where track_id=0),
 ax as (select frame_index, f, dx/sqrt(dx*dx+dy*dy+dz*dz) zx, dy/sqrt(dx*dx+dy*dy+dz*dz) zy, dz/sqrt(dx*dx+dy*dy+dz*dz) zz, dy/sqrt(dx*dx+dy*dy) xx, -dx/sqrt(dx*dx+dy*dy) xy from vi),
 em as (select event_id//10 frame_index from events where event_id%10=3 and user_id%13=0 and (event_id//10)%100>=40)"""


def _view(spark, sf_dir):
    """Per frame the focal length and the camera's three axes."""
    p, e = players(spark, sf_dir), table(spark, sf_dir, "events")
    focal = e.where("event_id % 1000 = 0").select(F.floor(F.col("event_id") / 1000).alias("clip"), (900.0 + F.col("user_id") % 400).alias("f"))
    f = F.col("frame_index")
    rows = p.where("track_id = 0").select(F.floor(f / 100).alias("clip"), "frame_index", F.when(f % 100 < 40, 0.0).otherwise((F.col("x_ft") - 15) / 2).alias("dx")).join(focal, "clip")
    dx, dy, dz = F.col("dx"), F.lit(70.0), F.lit(-32.0)
    size, flat = F.sqrt(dx * dx + dy * dy + dz * dz), F.sqrt(dx * dx + dy * dy)
    z, x = (dx / size, dy / size, dz / size), (dy / flat, -dx / flat, F.lit(0.0))
    y = (z[1] * x[2] - z[2] * x[1], z[2] * x[0] - z[0] * x[2], z[0] * x[1] - z[1] * x[0])
    return rows.select("clip", "frame_index", "f", F.array(*x, *y, *z).alias("axes"))


def _seen(axes, f, x, y, z):
    at = (x - EYE[0], y - EYE[1], z - EYE[2])
    dot = lambda i: axes[3 * i] * at[0] + axes[3 * i + 1] * at[1] + axes[3 * i + 2] * at[2]
    return f * dot(0) / dot(2) + WIDTH / 2, f * dot(1) / dot(2) + HEIGHT / 2


def _court_frames(spark, sf_dir):
    """Videos of 100 frames with ten court points each; a frame is empty where the tables say so, and the camera stands still
    for 40 frames, then looks along."""
    k = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("kp_idx")
    e = table(spark, sf_dir, "events")
    empty = e.where("event_id % 10 = 3 and user_id % 13 = 0 and floor(event_id / 10) % 100 >= 40").select(F.floor(F.col("event_id") / 10).alias("frame_index"), F.lit(True).alias("empty"))
    rows = _view(spark, sf_dir).join(empty, "frame_index", "left").select("clip", "frame_index", "f", "axes", "empty", k)
    wx, wy = 4.0 + F.col("kp_idx") * 9.0, 5.0 + (F.col("kp_idx") * 7) % 41
    u, v = _seen(F.col("axes"), F.col("f"), wx, wy, F.lit(0.0))
    at = F.struct(F.col("kp_idx"), u.alias("x"), v.alias("y"), F.col("empty").isNull().alias("valid"), wx.alias("wx"), wy.cast("double").alias("wy"))
    frames = rows.groupBy("clip", "frame_index").agg(F.sort_array(F.collect_list(at)).alias("points"))
    return frames.select(F.concat(F.lit("v"), F.col("clip").cast("string")).alias("video_id"), "frame_index", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), "points")


@query(f"""{VIEW_SQL}, d as (select frame_index, f, -7.0e0*xx+65.0e0*xy a, -7.0e0*(-zz*xy)+65.0e0*(zz*xx)-22.0e0*(zx*xy-zy*xx) b, -7.0e0*zx+65.0e0*zy-22.0e0*zz c from ax where frame_index%100>=29 and frame_index not in (select frame_index from em))
 select frame_index, round(f*a/c+640,3) u, round(f*b/c+360,3) v from d""")
def frame_cameras(spark, sf_dir):
    """Where the camera solved for each frame sees a place ten feet above the court."""
    got = C.frame_cameras(_court_frames(spark, sf_dir))
    u, v = S.W.camera_projection(F.col("camera"), F.lit(40.0), F.lit(20.0), F.lit(10.0))
    return got.select("frame_index", F.round(u, 3).alias("u"), F.round(v, 3).alias("v"))


@query(f"{WITH}, fo as (select event_id//1000 clip, 900.0e0+user_id%400 f from events where event_id%1000=0) select 'v'||cast(clip as varchar) video_id, round(f,6) focal, clip*100+29 calibrated_at from fo")
def focal_lengths(spark, sf_dir):
    return C.focal_lengths(C.calibration_planes(_court_frames(spark, sf_dir))).select("video_id", F.round("focal", 6).alias("focal"), "calibrated_at")


@query(f"""{VIEW_SQL} select frame_index, frame_index%100>=30 has_camera, coalesce(e, false) cached from ax left join (select distinct frame_index, true e from em) using (frame_index)""")
def court_cameras(spark, sf_dir):
    """Planes until the focal length is known, then filtered cameras; predicted ones in empty frames."""
    got = C.court_cameras(_court_frames(spark, sf_dir))
    return got.select("frame_index", F.col("camera").isNotNull().alias("has_camera"), "cached")


# Fixed value: a camera with focal length 2000 that looks along y from 60 feet away.
STILL = (2000.0, 640.0, 0.0, 38400.0, 0.0, 360.0, -2000.0, 36600.0, 0.0, 1.0, 0.0, 60.0)
FPS = 30.0


def _throws(spark, sf_dir):
    """clip and the throw of its tenth frame, from where and how a player stands in its first."""
    a, b = F.col("x_ft"), F.col("y_ft")
    p = players(spark, sf_dir).where("track_id = 0 and frame_index % 50 = 0")
    return p.select(F.floor(F.col("frame_index") / 50).alias("clip"), (a + 10).alias("x0"), (8.01371 + b / 10).alias("vx"), (5 + a / 10).alias("y0"), F.lit(2.0).alias("vy"), (6.5 + (b - 25) / 5).alias("z0"), (22.00713 + a - 15).alias("vz"), (a > 17).alias("rim"))


def _shot_scene(spark, sf_dir):
    """Sightings, cameras, rims and releases of the throws; frames count from the clip's own start."""
    throws = _throws(spark, sf_dir)
    frames = players(spark, sf_dir).where("track_id = 0").select(F.floor(F.col("frame_index") / 50).alias("clip"), (F.col("frame_index") % 50).alias("frame_index"))
    camera = F.array(*map(F.lit, STILL))
    cameras = frames.join(throws.select("clip"), "clip").select("clip", "frame_index", camera.alias("camera"))
    u, v = S.W.camera_projection(camera, *S.place_at((F.col("frame_index") - 10) / FPS))
    balls = frames.where("frame_index between 10 and 40").join(throws, "clip").select("clip", "frame_index", u.alias("u"), v.alias("v"))
    ru, rv = S.W.camera_projection(camera, *S.place_at(F.lit(1.15)))
    rims = frames.where("frame_index between 20 and 22").join(throws.where("rim"), "clip").select("clip", "frame_index", ru.alias("rim_x"), rv.alias("rim_y"), F.lit(10.0).alias("rim_r"))
    releases = throws.where("clip % 3 < 2").select("clip", F.when(F.col("clip") % 3 == 0, 12).otherwise(3).cast("long").alias("frame_index"))
    return balls, cameras, rims, releases


def _shots(spark, sf_dir):
    balls, cameras, rims, releases = _shot_scene(spark, sf_dir)
    samples = S.shot_samples(balls, cameras, ["clip"])
    windows = S.shot_windows(samples, ["clip"], FPS, 8, releases)
    return S.reconstruct(samples, windows, rims, cameras, ["clip"], FPS), cameras, balls, rims


THROWS_SQL = f"""{WITH}, th as (select frame_index//50 clip, x_ft+10 x, 8.01371e0+y_ft/10 vx, 5+x_ft/10 y, 2.0e0 vy, 6.5e0+(y_ft-25)/5 z, 22.00713e0+x_ft-15 w, x_ft>17 rim from p where track_id=0 and frame_index%50=0),
 fr as (select *, case when clip%3=0 then 12 else 10 end lo, case when clip%3=0 then 2/30.0e0 else 0.0e0 end s from th),
 ar as (select clip, lo, 40 hi, x+vx*s x0, vx, y+vy*s y0, vy, z+w*s-0.5e0*32.174e0*s*s z0, w-32.174e0*s vz, (40-lo)/30.0e0 t_seen, rim,
   2000*(x+vx*1.15e0)/(y+vy*1.15e0+60)+(640*(y+vy*1.15e0)+38400)/(y+vy*1.15e0+60) rx, (360*(y+vy*1.15e0)-2000*(z+w*1.15e0-0.5e0*32.174e0*1.15e0*1.15e0)+36600)/(y+vy*1.15e0+60) ry from fr),
 an as (select *, (vz+sqrt(vz*vz+2*32.174e0*(z0-10)))/32.174e0 t_high, greatest(t_seen, vz/32.174e0)+1e-6 t_low from ar),
 st as (select an.*, t_low+k.range*(t_high-t_low)/399 t from an, range(400) k where rim),
 pt as (select clip, t, rx, ry, round((2000*(x0+vx*t)+640*(y0+vy*t)+38400)/(y0+vy*t+60)) u, round((360*(y0+vy*t)-2000*(z0+vz*t-0.5e0*32.174e0*t*t)+36600)/(y0+vy*t+60)) v from st),
 hi as (select clip, min(t) filter (where sqrt((u-rx)*(u-rx)+(v-ry)*(v-ry))<=12.5e0) t_hit from pt group by clip),
 sh as (select an.*, greatest(coalesce(t_hit, t_high), t_seen) t_end from an left join hi using (clip))"""


@query(THROWS_SQL + """ select clip, lo, hi, round(x0,4) x0, round(vx,4) vx, round(y0,4) y0, round(vy,4) vy, round(z0,4) z0, round(vz,4) vz, cast(hi-lo+1 as int) n, round(z0+vz*vz/(2*32.174e0),4) apex, round(sqrt(vx*vx+vy*vy+vz*vz),4) speed,
 round(degrees(atan2(vz,sqrt(vx*vx+vy*vy))),4) angle, z0+vz*vz/(2*32.174e0)<30 and degrees(atan2(vz,sqrt(vx*vx+vy*vy)))<75 plausible, round(t_end,4) t_end, 'rim' how from sh""")
def shots_in_space(spark, sf_dir):
    """From sightings and cameras to windows, releases, arcs, metrics and ends."""
    out = _shots(spark, sf_dir)[0]
    return out.select("clip", "lo", "hi", *(F.round(c, 4).alias(c) for c in ("x0", "vx", "y0", "vy", "z0", "vz")), "n", *(F.round(c, 4).alias(c) for c in ("apex", "speed", "angle")), "plausible", F.round("t_end", 4).alias("t_end"), "how")


@query(THROWS_SQL + """, fs as (select sh.*, lo+k.range f, (k.range)/30.0e0 t from sh, range(100) k where lo+k.range<=hi+greatest(12, round((t_end-t_seen)*30)+2) and lo+k.range<50)
 select clip, f frame_index, case when f<=hi then cast(round((2000*(x0+vx*t)+640*(y0+vy*t)+38400)/(y0+vy*t+60)) as int) end u, case when f<=hi then cast(round((360*(y0+vy*t)-2000*(z0+vz*t-0.5e0*32.174e0*t*t)+36600)/(y0+vy*t+60)) as int) end v,
 rim and f between 20 and 22 has_rim, cast(greatest(90, round(t_end*60)) as int) places from fs""")
def shot_overlays(spark, sf_dir):
    """What is drawn over each frame of a shot: the ball's place, the seen rim and the length of the drawn arc (before it is led to the rim)."""
    shots, cameras, balls, rims = _shots(spark, sf_dir)
    e = F.col("entry")
    led = F.coalesce(F.element_at(e["arc"], -1) == F.array(F.rint(e["rim"][0]).cast("int"), F.rint(e["rim"][1]).cast("int")), F.lit(False))
    rows = S.overlay_frames(shots, cameras, balls, rims, ["clip"], FPS)
    return rows.select("clip", "frame_index", e["ball_proj"][0].alias("u"), e["ball_proj"][1].alias("v"), e["rim"].isNotNull().alias("has_rim"), (F.size(e["arc"]) - led.cast("int")).alias("places"))


@query()
def shot_documents_in_space(spark, sf_dir):
    """One document a shot, with its overlay."""
    shots, cameras, balls, rims = _shots(spark, sf_dir)
    return shot_documents(S.with_overlay(shots, cameras, balls, rims, ["clip"], FPS).withColumn("fps", F.lit(FPS)))
