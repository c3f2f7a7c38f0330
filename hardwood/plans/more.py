"""More registered queries: filters, nearest rows in time, summaries, labels and arcs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.functions import labels as L
from hardwood.operators import arcs as A
from hardwood.operators import joins as J
from hardwood.operators import ranges as R
from hardwood.operators import sequences as Q
from hardwood.operators import state as K
from hardwood.operators import summaries as S
from hardwood.plans import screens as C
from hardwood.plans.queries import HITS_SQL, QUERIES, SQL, WITH, _offence, boxes, players, query, table

__all__ = ["QUERIES", "SQL"]

TIGHT = HITS_SQL.replace("hit as (select frame_index,i,j,", "hit as (select frame_index,i,j,sqrt((ix-jx)*(ix-jx)+(iy-jy)*(iy-jy)) pd,") + ", one as (select * from (select *, row_number() over (partition by frame_index order by pd,i,j) tr from hit) where tr=1)"


@query(TIGHT + " select frame_index,i,j,screener,screenee from one")
def screen_tightest_hits(spark, sf_dir):
    p = players(spark, sf_dir)
    return C.tightest(C.frame_hits(p, _offence(p))).select("frame_index", "i", "j", "screener", "screenee")


@query(TIGHT + """, n as (select *, case when frame_index - lag(frame_index) over (partition by i,j order by frame_index) > 5 then 1 else 0 end nw from one),
 r as (select *, sum(nw) over (partition by i,j order by frame_index) run_id from n),
 v as (select i,j,run_id,screener,screenee,count(*) v,min(frame_index) f from r group by all), best as (select *, row_number() over (partition by i,j,run_id order by v desc,f) o from v),
 whole as (select i,j,run_id,min(frame_index) start_frame,max(frame_index) end_frame,count(*) frames,arg_min(frame_index,(pd,frame_index)) screen_frame from r group by i,j,run_id having count(*)>=3)
 select i,j,start_frame,end_frame,frames,screen_frame,screener,screenee from whole join best using (i,j,run_id) where o=1""")
def screen_contact_runs(spark, sf_dir):
    p = players(spark, sf_dir)
    return C.screen_runs(C.tightest(C.frame_hits(p, _offence(p)))).select("i", "j", "start_frame", "end_frame", "frames", "screen_frame", "screener", "screenee")


def _detections(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("user_id") % 11).alias("class_id"), F.when(F.col("event_type") != "error", F.col("value") / 100).alias("confidence"), F.floor(F.col("event_id") / 10).alias("frame_index"), (F.col("event_id") % 10).alias("det_idx"), F.when(F.col("event_type") != "click", F.col("user_id")).alias("track_id"))


DET = "d as (select event_id, user_id%11 class_id, case when event_type<>'error' then value/100 end confidence, event_id//10 frame_index, event_id%10 det_idx, case when event_type<>'click' then user_id end track_id from events)"


@query(f"with {DET} select event_id, class_id from d where class_id in (0,3,5) and (confidence is null or confidence>=0.3)")
def class_confidence_filter(spark, sf_dir):
    return S.of_classes(_detections(spark, sf_dir), [0, 3, 5], 0.3).select("event_id", "class_id")


@query("select event_id from events where event_id%30=0 order by event_id limit 40")
def stride_sample(spark, sf_dir):
    return S.every_nth(table(spark, sf_dir, "events").select("event_id"), "event_id", 30, 40)


@query(f"with {DET} select event_id, track_id, coalesce(confidence,0) confidence, coalesce(class_id,-1) class_id from d where track_id is not null")
def drop_untracked(spark, sf_dir):
    return S.tracked(_detections(spark, sf_dir)).select("event_id", "track_id", "confidence", "class_id")


@query(f"with {DET}, r as (select *, row_number() over (partition by frame_index order by coalesce(confidence,2.0) desc, det_idx) r from d where coalesce(confidence,2.0)>=0.25) select frame_index, det_idx from r where r=1")
def best_box_per_frame(spark, sf_dir):
    return S.best_box(_detections(spark, sf_dir), ["frame_index"], 0.25).select("frame_index", "det_idx")


@query("with v as (select user_id, event_id t from events where event_type='view'), e as (select event_id, user_id from events where event_type='purchase'), x as (select e.event_id, v.t, row_number() over (partition by e.event_id order by abs(v.t-e.event_id), v.t) r from e left join v using (user_id)) select event_id, t nearest from x where r=1")
def nearest_view_in_time(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    views = e.where("event_type='view'").select("user_id", "event_id", F.col("event_id").alias("nearest"))
    return J.nearest_in_time(e.where("event_type='purchase'").select("event_id", "user_id"), views, ["user_id"], "event_id", "nearest").select("event_id", "nearest")


@query("select e.event_id, s.event_id start_at from events e join events s on s.event_type='signup' and s.user_id%7=e.user_id%7 and e.event_id between s.event_id and s.event_id+36")
def linger_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("k"), "event_type")
    s = e.where("event_type='signup'").select("k", F.col("event_id").alias("start_at"))
    return J.within_linger(e.select("event_id", "k"), s, "k", "event_id", "start_at", 36).select("event_id", "start_at")


@query(f"{WITH} select a.frame_index, a.track_id point, b.track_id box from p a join bx b on a.frame_index=b.frame_index and a.x_ft*10 between b.x1 and b.x2 and a.y_ft*10 between b.y1 and b.y2")
def point_in_box(spark, sf_dir):
    p = players(spark, sf_dir)
    points = p.select("frame_index", F.col("track_id").alias("point"), (F.col("x_ft") * 10).alias("px"), (F.col("y_ft") * 10).alias("py"))
    return J.points_in_boxes(points, boxes(p).select("frame_index", F.col("track_id").alias("box"), "x1", "y1", "x2", "y2"), ["frame_index"], "px", "py").select("frame_index", "point", "box")


@query("select user_id, round(sqrt(sum(value*value)/count(*)),6) e, list_sort(list(value))[count(*)//2+1] median from events group by user_id")
def error_and_upper_median(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "value")
    errors = e.groupBy("user_id").agg(F.round(S.rmse(F.col("value")), 6).alias("e"))
    return errors.join(R.upper_medians(e, ["user_id"], "value").drop("n"), "user_id")


@query("select lang, count(*) n, count(*) filter (where coalesce(cast(s as varchar),'')=cast(quality as varchar)) correct, count(*) filter (where s is null) nulls, 100.0*count(*) filter (where coalesce(cast(s as varchar),'')=cast(quality as varchar))/count(*) accuracy, 100.0*count(*) filter (where s is null)/count(*) null_share from (select lang, quality, case when n_chars>2000 then null when n_chars<400 then 0 else 1 end s from labels join documents using (doc_id)) group by lang")
def exact_match(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    said = F.when(F.col("n_chars") > 2000, F.lit(None)).when(F.col("n_chars") < 400, 0).otherwise(1)
    return S.accuracy(d.withColumn("said", said), ["lang"], "quality", "said")


@query("select o_orderpriority p, count(a) held_a, count(b) held_b, count(distinct a) holders_a, count(distinct b) holders_b, 100.0*(count(b)-count(a))/nullif(count(a),0) change from (select o_orderpriority, case when o_orderstatus<>'P' then o_custkey end a, case when o_totalprice>50000 then o_custkey end b from orders) group by 1")
def possession_two_way(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("a"), F.when(F.col("o_totalprice") > 50000, F.col("o_custkey")).alias("b"))
    return S.two_way_change(o, ["p"], "a", "b")


@query("with s as (select distinct l_returnflag side, l_suppkey number from lineitem), r as (select distinct s_nationkey team, s_suppkey number from supplier) select team, side, count(*) overlap from s join r using (number) group by team, side")
def jersey_overlap(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_suppkey").alias("number"))
    return S.jersey_overlap(seen, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("team"), F.col("s_suppkey").alias("number")))


@query("select conv_id, turn, list_aggregate(list(role) over (partition by conv_id order by turn rows between 19 preceding and current row), 'string_agg', '>') history from conversations")
def last_twenty(spark, sf_dir):
    rows = S.recent(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", "role", 20)
    return rows.select("conv_id", "turn", F.concat_ws(">", "history").alias("history"))


@query("select event_id, round(value/greatest(max(value) over (partition by user_id),1),9) share from events")
def max_normalised(spark, sf_dir):
    return S.max_normalised(table(spark, sf_dir, "events"), ["user_id"], "value").select("event_id", F.round("share", 9).alias("share"))


@query("with c as (select user_id, '#'||printf('%06x', cast(user_id*7919%16777216 as bigint)) a, case when user_id%5=0 then 'red' else '#'||printf('%06X', cast(user_id*104729%16777216 as bigint)) end b, cast(user_id*7919%16777216 as bigint) x, cast(user_id*104729%16777216 as bigint) y from (select distinct user_id from events)) select user_id, case when user_id%5<>0 then (x//65536-y//65536)*(x//65536-y//65536)+(x//256%256-y//256%256)*(x//256%256-y//256%256)+(x%256-y%256)*(x%256-y%256) end d, user_id%5<>0 ok from c")
def colour_distance(spark, sf_dir):
    hexed = lambda k, f: F.concat(F.lit("#"), F.format_string(f, (F.col("user_id") * k % 16777216).cast("long")))
    u = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", hexed(7919, "%06x").alias("a"), F.when(F.col("user_id") % 5 == 0, "red").otherwise(hexed(104729, "%06X")).alias("b"))
    return u.select("user_id", L.colour_distance(F.col("a"), F.col("b")).cast("long").alias("d"), L.is_colour(F.col("b")).alias("ok"))


@query("select event_id, case when event_type='click' then 'ID:'||user_id when event_type='view' then '#'||(event_id%100) else '#'||(event_id%100)||' '||event_type end label from events")
def player_labels(spark, sf_dir):
    t, n = F.col("event_type"), F.col("event_id") % 100
    return table(spark, sf_dir, "events").select("event_id", L.player_label(F.when(t != "click", n), F.when(~t.isin("click", "view"), t), F.col("user_id")).alias("label"))


@query("select p_partkey, replace(replace(replace(p_name||' <&>','&','&amp;'),'<','&lt;'),'>','&gt;') markup, trim(regexp_replace(regexp_replace(replace(p_name,' ','_-')||'.mp4','\\.[^.]+$',''),'[_-]+',' ','g')) label, case when p_partkey%7=0 then null else trim(substr(p_name||' , x,y', length(p_name)+3)) end rest from part")
def text_helpers(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    pair = L.parse_pair(F.when(F.col("p_partkey") % 7 == 0, F.replace("p_name", F.lit(","), F.lit(" "))).otherwise(F.concat(F.replace("p_name", F.lit(","), F.lit(" ")), F.lit(" , x,y"))))
    return p.select("p_partkey", L.escaped(F.concat("p_name", F.lit(" <&>"))).alias("markup"), L.file_label(F.concat(F.replace("p_name", F.lit(" "), F.lit("_-")), F.lit(".mp4"))).alias("label"), pair[1].alias("rest"))


@query("select event_id, round(0.6*least((event_id%40)/33.0e0,1.0)+0.4*greatest(1-value/15,0.0),9) fit, round((value/100)*(1-(event_id%31)/30.0e0),9) held from events")
def confidences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(L.fit_confidence(F.col("event_id") % 40, F.col("value")), 9).alias("fit"), F.round(L.decayed_confidence(F.col("value") / 100, F.col("event_id") % 31), 9).alias("held"))


ARC_SQL = """with a as (select event_id, 4.0e0+event_id%6 z0, (user_id%30)-4.0e0 vz, 3.0e0+event_id%20 vx, (event_id%9)-4.0e0 vy, 0.2e0+(event_id%5)/10.0e0 after from events),
 d as (select *, vz*vz+2*32.174e0*(z0-10) dr, vz*vz+2*32.174e0*z0 df from a),
 r as (select *, case when dr>=-1e-9 then (vz+sqrt(greatest(dr,0)))/32.174e0 end rim, (vz+sqrt(greatest(df,0)))/32.174e0 floor, greatest(after,vz/32.174e0)+1e-9 late from d)
 select event_id, round(sqrt(vx*vx+vy*vy+vz*vz),6) speed, round(degrees(atan2(vz,sqrt(vx*vx+vy*vy))),6) angle, round(case when vz>0 then z0+vz*vz/(2*32.174e0) else z0 end,6) apex,
  round(case when rim>late and (not floor>late or rim<=floor) then rim when floor>late then floor when floor>after+1e-9 then floor else after end,6) t_end,
  case when rim>late and (not floor>late or rim<=floor) then 'rim' when floor>after+1e-9 then 'floor' else 'observed' end how,
  (case when vz>0 then z0+vz*vz/(2*32.174e0) else z0 end) > 10 and (case when vz>0 then z0+vz*vz/(2*32.174e0) else z0 end) < 30 and degrees(atan2(vz,sqrt(vx*vx+vy*vy)))>20 and degrees(atan2(vz,sqrt(vx*vx+vy*vy)))<75 plausible from r"""


@query(ARC_SQL)
def arc_metrics(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    z0, vz, vx, vy, after = 4.0 + i % 6, F.col("user_id") % 30 - 4.0, 3.0 + i % 20, i % 9 - 4.0, 0.2 + i % 5 / 10.0
    angle, apex, end = A.launch_angle(vx, vy, vz), A.apex_height(z0, vz, z0), A.arc_end(z0, vz, after)
    return e.select("event_id", F.round(A.launch_speed(vx, vy, vz), 6).alias("speed"), F.round(angle, 6).alias("angle"), F.round(apex, 6).alias("apex"), F.round(end["t"], 6).alias("t_end"), end["how"].alias("how"), A.is_plausible(F.lit(0.0), apex, angle).alias("plausible"))


@query()
def arc_fits(spark, sf_dir):
    """Throws that start at the players, seen by one camera 20 times in a second."""
    # A camera with focal length 1000 that looks along y from 60 feet away, 15 feet high.
    camera = F.array(*map(F.lit, [1000.0, 640.0, 0.0, 38400.0, 0.0, 360.0, -1000.0, 36600.0, 0.0, 1.0, 0.0, 60.0]))
    p = players(spark, sf_dir).select("frame_index", "track_id", "x_ft", "y_ft", (8.0 + F.col("track_id")).alias("vx"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k"))
    t = F.col("k") / 20.0
    x, y, z = F.col("x_ft") + F.col("vx") * t, F.col("y_ft") + 2.0 * t, 7.0 + 22.0 * t - 0.5 * A.GRAVITY * t * t
    w = y + 60.0
    seen = p.select("frame_index", "track_id", t.alias("t"), ((1000.0 * x + 640.0 * y + 38400.0) / w).alias("u"), ((360.0 * y - 1000.0 * z + 36600.0) / w).alias("v"), camera.alias("camera"))
    fits = A.fit_arcs(seen, ["frame_index", "track_id"])
    return fits.select("frame_index", "track_id", F.round("vz", 3).alias("vz"), F.round("vx", 3).alias("vx"), A.is_physical(F.col("n"), F.col("z0"), F.col("min_z")).alias("physical"))


SQL["arc_fits"] = f"{WITH} select frame_index, track_id, 22.0e0 vz, 8.0e0+track_id vx, true physical from p"


@query()
def duplicate_boxes(spark, sf_dir):
    p = boxes(players(spark, sf_dir)).withColumn("det_idx", F.col("track_id").cast("int")).withColumn("confidence", (F.col("track_id") * 37 % 100) / 100)
    return K.drop_duplicates(p.select("video_id", "frame_index", "det_idx", "confidence", "x1", "y1", "x2", "y2"), 0.45).select("frame_index", "det_idx")


@query()
def ball_track(spark, sf_dir):
    """The player of each 50 frames that holds the ball, now and then unseen, with a false one beside."""
    p = players(spark, sf_dir).where(F.col("track_id") == F.floor(F.col("frame_index") / 50) % 10)
    one = lambda x, y, c: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), c.cast("double").alias("confidence"))
    x, y = F.col("x_ft") * 10, F.col("y_ft") * 10
    seen = F.when(F.col("frame_index") % 7 != 3, F.array(one(x, y, F.lit(0.6)), one(x + 400, y, F.lit(0.8))))
    video = F.concat("video_id", F.floor(F.col("frame_index") / 500).cast("string"))
    return K.track_ball(p.select(video.alias("video_id"), "frame_index", seen.alias("candidates"))).groupBy("predicted").agg(F.count("*").alias("frames"))


@query()
def possession_by_boxes(spark, sf_dir):
    """Possession from boxes and a ball that wanders from player to player."""
    p = boxes(players(spark, sf_dir)).withColumn("video_id", F.concat("video_id", F.floor(F.col("frame_index") / 500).cast("string")))
    p = p.select("video_id", "frame_index", F.col("track_id").alias("pos"), "track_id", "x1", "y1", "x2", "y2")
    holder = F.floor(F.col("frame_index") / 20) % 10
    held = p.where(F.col("track_id") == holder)
    ball = held.select("video_id", "frame_index", ((F.col("x1") + F.col("x2")) / 2).alias("bx"), F.col("y2").alias("by"), F.lit(1.0).alias("vx"), F.lit(0.0).alias("vy"), (F.col("frame_index") % 9 == 4).alias("predicted"), F.lit(False).alias("near_rim"))
    return K.possession(K.possession_candidates(p, ball)).groupBy("possessor_track_id").agg(F.count("*").alias("frames"))


@query()
def mean_average_precision(spark, sf_dir):
    """Average precision of shifted boxes at ten thresholds, by team."""
    p = boxes(players(spark, sf_dir))
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    truths = p.select("frame_index", "team", F.col("track_id").alias("gt_idx"), *corners)
    off = (F.col("track_id") * 7 + F.col("frame_index")) % 13
    said = p.where("(track_id + frame_index) % 5 != 0").select("frame_index", "team", F.col("track_id").cast("long").alias("det_idx"), ((F.col("frame_index") * 31 + F.col("track_id") * 17) % 101 / 101).alias("confidence"), *((c + off).alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)))
    thresholds = [0.5 + 0.05 * k for k in range(10)]
    hits = A.matched_lists(said, truths, ["frame_index", "team"], thresholds)
    n = truths.groupBy("team").agg(F.count("*").alias("n"))
    ap = Q.average_precisions(hits.join(F.broadcast(n), "team"), ["team"], "hits", thresholds, "n", F.desc("confidence"), "frame_index", "det_idx")
    return ap.groupBy("team").agg(F.round(F.avg("ap"), 9).alias("map"), F.round(F.max(F.when(F.col("threshold") == 0.5, F.col("ap"))), 9).alias("ap50"))
