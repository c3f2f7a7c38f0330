"""Registered queries over rims, masks, identities, series, and the trackers."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.operators import homography as H
from hardwood.operators import scene as N
from hardwood.operators import trackers as T
from hardwood.operators import windows as W
from hardwood.operators.summaries import jersey_overlap
from hardwood.plans.more import QUERIES, SQL
from hardwood.plans.queries import WITH, boxes, players, query, table

__all__ = ["QUERIES", "SQL"]

# Fixed value: a frame's ball follows a player, its two rims stand at the ends; both engines use the same rows.
RIMS_SQL = "rims as (select distinct frame_index, k rim_idx, case when k=0 then 100.0e0 else 700.0e0 end + frame_index%5 rx, 250.0e0 ry, 20.0e0+frame_index%7 rh, case when (frame_index+k)%4=0 then 0.1e0 when (frame_index+k)%4<>1 then 0.5e0 end confidence from p, (select unnest([0,1]) k))"
BALLS_SQL = "balls as (select frame_index, x_ft*10-frame_index%120 bx, y_ft*10-frame_index%50 bq from p where track_id=frame_index%10)"
SIDE = "case when rx is not null and rx<400 then 'left' when rx is not null then 'right' end side"


def _rims(p):
    k, f = F.explode(F.array(F.lit(0), F.lit(1))).alias("rim_idx"), F.col("frame_index")
    rows = p.select("frame_index").distinct().select("frame_index", k)
    turn = (f + F.col("rim_idx")) % 4
    return rows.select("frame_index", "rim_idx", (F.when(F.col("rim_idx") == 0, 100.0).otherwise(700.0) + f % 5).alias("rx"), F.lit(250.0).alias("ry"), (20.0 + f % 7).alias("rh"), F.when(turn == 0, 0.1).when(turn != 1, 0.5).alias("confidence"))


def _balls(p):
    f = F.col("frame_index")
    return p.where(F.col("track_id") == f % 10).select("frame_index", (F.col("x_ft") * 10 - f % 120).alias("bx"), (F.col("y_ft") * 10 - f % 50).alias("by"))


@query(f"""{WITH}, {RIMS_SQL}, {BALLS_SQL}, x as (select b.frame_index, rx, rim_idx, sqrt((bx-rx)*(bx-rx)+(bq-ry)*(bq-ry))/greatest(rh,1) gap from balls b left join rims r on b.frame_index=r.frame_index and coalesce(r.confidence,1)>=0.3),
 y as (select *, row_number() over (partition by frame_index order by gap nulls last, rim_idx) r from x), z as (select frame_index, coalesce(gap<=1.8,false) at_rim, case when gap<=1.8 then rx end rx from y where r=1) select frame_index, at_rim, {SIDE} from z""")
def ball_at_rim(spark, sf_dir):
    p = players(spark, sf_dir)
    got = N.balls_at_rims(_balls(p), _rims(p), ["frame_index"])
    side = F.when(F.col("rx").isNotNull(), N.court_side(F.lit(None).cast("double"), F.col("rx"), F.lit(800)))
    return got.select("frame_index", "at_rim", side.alias("side"))


@query(f"""{WITH}, {RIMS_SQL}, {BALLS_SQL}, c as (select frame_index, 400.0e0+frame_index%9-4 cx, 260.0e0 cy from balls), x as (select c.*, rx, ry, rh, rim_idx, sqrt((cx-rx)*(cx-rx)+(cy-ry)*(cy-ry)) g from c left join rims r on c.frame_index=r.frame_index and coalesce(r.confidence,1)>=0.3),
 y as (select * from (select *, row_number() over (partition by frame_index order by g nulls last, rim_idx) r from x) where r=1)
 select y.frame_index, rx is null or coalesce(sqrt((bx-rx)*(bx-rx)+(bq-ry)*(bq-ry))/greatest(rh,1)<=2.5, false) credible from y left join balls b on y.frame_index=b.frame_index and b.frame_index%3<>0""")
def credible_basket(spark, sf_dir):
    p = players(spark, sf_dir)
    balls, f = _balls(p), F.col("frame_index")
    baskets = balls.select("frame_index", (400.0 + f % 9 - 4).alias("cx"), F.lit(260.0).alias("cy"))
    return N.credible_baskets(baskets, balls.where(f % 3 != 0), _rims(p), ["frame_index"]).select("frame_index", "credible")


@query("""with c as (select event_id//50 mask, (user_id*7)%41 x, min(event_id%29) t, max(event_id%29) low from events group by all),
 w as (select *, cast(trunc((max(x) over (partition by mask) - min(x) over (partition by mask))*(1.0e0-0.6e0)/2.0e0) as bigint) side, min(x) over (partition by mask) a, max(x) over (partition by mask) b from c),
 u as (select *, x between a+side and b-side inn, bool_or(x between a+side and b-side) over (partition by mask) any_in from w), v as (select *, inn or not any_in as use from u)
 select mask, min(x) x1, min(t) y1, max(x) x2, max(low) y2, quantile_disc(x,0.5) filter (where use) foot_x, quantile_disc(low,0.5) filter (where use) foot_y from v group by mask""")
def mask_feet(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return N.mask_feet(e.select(F.floor(F.col("event_id") / 50).alias("mask"), (F.col("user_id") * 7 % 41).alias("x"), (F.col("event_id") % 29).alias("y")), ["mask"]).withColumns({c: F.col(c).cast("long") for c in ("foot_x", "foot_y")})


@query(f"""{WITH}, f as (select track_id, frame_index//200 clip, frame_index, case when frame_index%11<9 then x_ft end x, case when frame_index%11<9 then y_ft end y, frame_index%4<>0 raw from p),
 s as (select *, sqrt((x-lag(x) over w)*(x-lag(x) over w)+(y-lag(y) over w)*(y-lag(y) over w)) step from f window w as (partition by track_id, clip order by frame_index)),
 j as (select track_id, clip, abs(step-lag(step) over (partition by track_id, clip order by frame_index)) jerk from s where step is not null)
 select track_id, clip, count(*) frames, count(x) output_frames, count(*) filter (where x is not null and not raw) holdover_frames, round(100.0e0*count(x)/count(*),1) coverage, round(coalesce(avg(step),0),6) mean_step, round(coalesce(max(step),0),6) max_step,
 round(coalesce((select avg(jerk) from j where j.clip=s.clip and j.track_id=s.track_id),0),6) mean_jerk from s group by track_id, clip""")
def step_quality(spark, sf_dir):
    f = F.col("frame_index")
    p = players(spark, sf_dir).select("track_id", F.floor(f / 200).alias("clip"), "frame_index", F.when(f % 11 < 9, F.col("x_ft")).alias("x"), F.when(f % 11 < 9, F.col("y_ft")).alias("y"), (f % 4 != 0).alias("raw"))
    return N.step_quality(p, ["track_id", "clip"]).withColumns({c: F.round(c, 6) for c in ("mean_step", "max_step", "mean_jerk")})


@query("""with s as (select distinct case when l_returnflag='N' then 'white' else 'dark' end side, l_suppkey number from lineitem where l_suppkey%3<>0 or l_returnflag<>'N'), r as (select distinct case when s_nationkey%2=0 then 'A' else 'B' end team, s_suppkey number from supplier),
 o as (select team, side, count(*) n from s join r using (number) group by all) select coalesce(sum(n) filter (where (team='A' and side='dark') or (team='B' and side='white')),0) > coalesce(sum(n) filter (where (team='A' and side='white') or (team='B' and side='dark')),0) swapped from o""")
def teams_by_numbers(spark, sf_dir):
    side = F.when(F.col("l_returnflag") == "N", "white").otherwise("dark")
    seen = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 != 0 or l_returnflag != 'N'").select(side.alias("side"), F.col("l_suppkey").alias("number"))
    roster = table(spark, sf_dir, "supplier").select(F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("B").alias("team"), F.col("s_suppkey").alias("number"))
    return N.swapped_by_numbers(jersey_overlap(seen, roster), [], "A", "B")


@query("""with v as (select user_id, event_type, count(*) n, min(event_id) f from events where event_type<>'error' group by all), m as (select * from (select *, row_number() over (partition by user_id order by n desc, f) r from v) where r=1)
 select e.event_id, coalesce(m.event_type, case when e.event_type<>'error' then e.event_type end) said from events e left join m using (user_id)""")
def identity_filled_back(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("said"))
    return N.filled_back(e, ["user_id"], "said", "event_id").select("event_id", "said")


@query("with l as (select user_id, event_type, max(event_id) event_id from events group by all) select * from (select user_id, event_type, event_id, row_number() over (partition by user_id order by event_id desc, event_type) place from l) where place<=20")
def most_recent_items(spark, sf_dir):
    return N.most_recent(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id").withColumn("place", F.col("place").cast("long"))


@query("""with l as (select l_suppkey, l_orderkey, list_sort(list(l_linenumber)) a from lineitem group by all), p as (select *, max(len(a)) over (partition by l_suppkey) m from l)
 select l_suppkey, l_orderkey, array_to_string(list_concat(a, [0 for i in range(m-len(a))]), ',') padded from p""")
def padded_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("long"))).alias("a"))
    return N.padded_lists(rows, ["l_suppkey"], "a", 0).select("l_suppkey", "l_orderkey", F.array_join("a", ",").alias("padded"))


@query("""with a as (select o_orderdate d, count(*) n from orders group by all), b as (select l_shipdate d, count(*) n from lineitem where l_linenumber=1 group by all), c as (select o_orderdate d, count(*) n from orders where o_orderstatus='O' group by all),
 days as (select d from a union select d from b union select d from c), x as (select days.d, sum(coalesce(a.n,0)) over (order by days.d) scope, sum(coalesce(b.n,0)) over (order by days.d) done, coalesce(c.n,0) going from days left join a using (d) left join b using (d) left join c using (d))
 select cast(d as varchar)[:10] as day, cast(scope as bigint) as scope, cast(done as bigint) as done, cast(least(going, greatest(scope-done,0)) as bigint) as going from x""")
def bounded_progress(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    per = lambda df, c: df.groupBy(F.col(c).alias("day")).agg(F.count("*").alias("n"))
    got = N.bounded_progress(per(o, "o_orderdate"), per(li.where("l_linenumber = 1"), "l_shipdate"), per(o.where("o_orderstatus = 'O'"), "o_orderdate"))
    return got.withColumn("day", F.col("day").cast("date").cast("string"))


@query(f"{WITH} select track_id, round(avg(x_ft),6) mean_x, round(avg(y_ft),6) mean_y, round(min(x_ft)-2.5,6) x1, round(max(x_ft)+2.5,6) x2, round(min(y_ft)-2.5,6) y1, round(max(y_ft)+2.5,6) y2 from p group by track_id")
def padded_bounds(spark, sf_dir):
    got = N.padded_bounds(players(spark, sf_dir), ["track_id"], "x_ft", "y_ft", 2.5)
    return got.select("track_id", *(F.round(c, 6).alias(c) for c in ("mean_x", "mean_y", "x1", "x2", "y1", "y2")))


@query(f"{WITH} select frame_index, track_id from p where case when track_id%4=1 then true when team='white' then true else false end")
def viewer_layers(spark, sf_dir):
    p = players(spark, sf_dir).withColumn("team", F.when(F.col("track_id") % 4 != 1, F.col("team"))).withColumn("possessor_track_id", F.lit(0))
    return N.shown(p, True, False, False).select("frame_index", "track_id")


# Fixed value: one camera in these queries, from feet on the court to pixels.
TO_IMAGE = ((18.0, 4.0, 120.0), (0.5, 9.0, 200.0), (0.0004, 0.002, 1.0))


def _clips(p):
    """Videos of 500 frames, so that these run side by side."""
    return p.withColumn("video_id", F.concat("video_id", F.floor(F.col("frame_index") / 500).cast("string")))


@query()
def filtered_ball(spark, sf_dir):
    """The filtered ball near one player after the other, unseen in every seventh frame."""
    p = boxes(_clips(players(spark, sf_dir))).where(F.col("track_id") == F.floor(F.col("frame_index") / 50) % 10)
    box = F.struct("x1", "y1", "x2", "y2", F.lit(0.6).alias("confidence"))
    seen = p.select("video_id", "frame_index", F.when(F.col("frame_index") % 7 != 3, F.array(box)).alias("candidates"))
    return T.filter_ball(seen).groupBy("predicted").agg(F.count("*").alias("frames"))


@query(f"{WITH}, f as (select distinct frame_index from p) select frame_index, cast(sum(case when frame_index%500<>0 and frame_index%50=0 then 1 else 0 end) over (partition by frame_index//500 order by frame_index) as bigint) segment from f")
def camera_segments(spark, sf_dir):
    """The camera jumps by 100 pixels every 50 frames."""
    p = _clips(players(spark, sf_dir))
    jump = 100.0 * F.floor(F.col("frame_index") / 50)
    at = F.struct(F.col("track_id").cast("int").alias("kp_idx"), (F.col("track_id") * 60.0 + jump).alias("x"), (F.col("track_id") * 25.0).alias("y"), F.lit(True).alias("valid"))
    frames = p.groupBy("video_id", "frame_index").agg(F.sort_array(F.collect_list(at)).alias("points"))
    return T.camera_segments(frames).select("frame_index", F.col("segment").cast("long").alias("segment"))


@query()
def followed_boxes(spark, sf_dir):
    """Tracks given to the boxes of each frame, in order."""
    p = boxes(_clips(players(spark, sf_dir)))
    frames = p.groupBy("video_id", "frame_index").agg(F.array_sort(F.collect_list(F.struct("track_id", "x1", "y1", "x2", "y2"))).alias("boxes"))
    return T.follow_boxes(frames)


@query(f"{WITH} select distinct frame_index, true good from p")
def court_planes(spark, sf_dir):
    """Court points seen by one camera, two of ten wrong; good: a point of the court comes back within half a foot."""
    p, k = _clips(players(spark, sf_dir)), F.col("track_id")
    wx, wy = 4.0 + k * 9.0, 5.0 + (k * 7) % 41
    scale = TO_IMAGE[2][0] * wx + TO_IMAGE[2][1] * wy + TO_IMAGE[2][2]
    u, v = ((TO_IMAGE[i][0] * wx + TO_IMAGE[i][1] * wy + TO_IMAGE[i][2]) / scale for i in (0, 1))
    wrong = F.when((k == 3) | (k == 8), 300.0).otherwise(0.0)
    at = F.struct(k.cast("int").alias("kp_idx"), (u + wrong).alias("x"), v.alias("y"), F.lit(True).alias("valid"), wx.alias("wx"), wy.cast("double").alias("wy"))
    frames = p.groupBy("video_id", "frame_index").agg(F.sort_array(F.collect_list(at)).alias("points"))
    h, (x, y) = F.col("h"), (F.lit((18.0 * 40 + 4.0 * 20 + 120) / 1.056), F.lit((0.5 * 40 + 9.0 * 20 + 200) / 1.056))
    w = h[6] * x + h[7] * y + h[8]
    back = F.hypot((h[0] * x + h[1] * y + h[2]) / w - 40, (h[3] * x + h[4] * y + h[5]) / w - 20)
    return H.court_planes(frames).select("frame_index", F.coalesce(back < 0.5, F.lit(False)).alias("good"))


@query(f"{WITH}, c as (select distinct frame_index//60 clip from p where frame_index%60=59) select clip, clip*60+5 lo, clip*60+35 hi from c")
def arc_windows(spark, sf_dir):
    """A throw in every 60 frames, at its highest in the 20th."""
    f = F.col("frame_index")
    rows = players(spark, sf_dir).select("frame_index").distinct().select(F.floor(f / 60).alias("clip"), "frame_index", (300.0 + (f % 60 - 20) * (f % 60 - 20)).alias("v"))
    return W.arc_windows(rows.join(rows.where(f % 60 == 59).select("clip"), "clip"), ["clip"], 30, 8).select("clip", "lo", "hi")
