"""Registered queries over single expressions and short summaries, each on a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.functions import geometry as G
from hardwood.functions import labels as L
from hardwood.operators import scene as N
from hardwood.operators import state as K
from hardwood.operators import summaries as S
from hardwood.plans.queries import WITH, boxes, players, query, table

# Fixed value: an image-to-court matrix, the same in both engines.
H = (0.05, 0.01, -4.0, 0.002, 0.08, -6.0, 0.0001, 0.0005, 1.0)


@query(f"{WITH} select frame_index, track_id from bx where x2-x1>=16 and y2-y1-frame_index%90>=16")
def large_crops(spark, sf_dir):
    p = boxes(players(spark, sf_dir)).withColumn("y2", F.col("y2") - F.col("frame_index") % 90)
    return p.where(G.large_enough(G.box())).select("frame_index", "track_id")


@query(f"{WITH}, e as (select event_id//10 frame_index, event_id%10 track_id, value/100 c from events) select frame_index, count(*) filter (where c>=0.3e0) wrists, round(coalesce(sum(x_ft) filter (where c>=0.3e0),0),6) x from p join e using (frame_index, track_id) group by 1")
def sure_wrists(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("frame_index"), (F.col("event_id") % 10).alias("track_id"), (F.col("value") / 100).alias("confidence"))
    rows = players(spark, sf_dir).join(e, ["frame_index", "track_id"]).groupBy("frame_index").agg(F.collect_list(F.struct("confidence", F.col("x_ft").alias("x"))).alias("w"))
    sure = G.sure_wrists(F.col("w"))
    return rows.select("frame_index", F.size(sure).cast("long").alias("wrists"), F.round(F.aggregate(sure, F.lit(0.0), lambda s, w: s + w["x"]), 6).alias("x"))


@query(f"{WITH} select frame_index, track_id, round((800.0e0-1280*least(800.0e0/1280,600.0e0/(700+frame_index%99)))/2+x_ft*10*least(800.0e0/1280,600.0e0/(700+frame_index%99)),6) u, round((600.0e0-(700+frame_index%99)*least(800.0e0/1280,600.0e0/(700+frame_index%99)))/2+y_ft*10*least(800.0e0/1280,600.0e0/(700+frame_index%99)),6) v, cast(round(20+x_ft*4.13e0) as int) cx, cast(round(20+y_ft*4.13e0) as int) cy from p")
def on_screen(spark, sf_dir):
    """Places in the video on a letterboxed screen, and on the map."""
    size = (F.lit(1280.0), (700 + F.col("frame_index") % 99).cast("double"))
    u, v = G.letterboxed(F.col("x_ft") * 10, F.col("y_ft") * 10, size, (F.lit(800.0), F.lit(600.0)))
    cx, cy = L.on_canvas(F.col("x_ft"), F.col("y_ft"), 4.13, 20.0)
    return players(spark, sf_dir).select("frame_index", "track_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), cx.alias("cx"), cy.alias("cy"))


BACK_SQL = f"""i as (select {H[4]}e0*{H[8]}e0-({H[5]}e0)*{H[7]}e0 a, ({H[2]}e0)*{H[7]}e0-{H[1]}e0*{H[8]}e0 b, {H[1]}e0*({H[5]}e0)-({H[2]}e0)*{H[4]}e0 c, ({H[5]}e0)*{H[6]}e0-{H[3]}e0*{H[8]}e0 d, {H[0]}e0*{H[8]}e0-({H[2]}e0)*{H[6]}e0 e, ({H[2]}e0)*{H[3]}e0-{H[0]}e0*({H[5]}e0) f, {H[3]}e0*{H[7]}e0-{H[4]}e0*{H[6]}e0 g, {H[1]}e0*{H[6]}e0-{H[0]}e0*{H[7]}e0 h, {H[0]}e0*{H[4]}e0-{H[1]}e0*{H[3]}e0 k),
 q as (select frame_index, track_id, (a*x_ft+b*y_ft+c)/(g*x_ft+h*y_ft+k) u, (d*x_ft+e*y_ft+f)/(g*x_ft+h*y_ft+k) v from p, i)""".replace("-4.0e0", "-4.0e0")


@query(f"{WITH}, {BACK_SQL} select frame_index, track_id, round(u,6) u, round(v,6) v, case when track_id%5<>4 then sqrt(power(frame_index%31,2)+power(track_id,2))<15 end inlier from q")
def places_in_the_image(spark, sf_dir):
    """Court places back in the image by the inverse matrix, and whether a seen point lies there."""
    u, v = G.project_back(F.array(*map(F.lit, H)), F.col("x_ft"), F.col("y_ft"))
    p = players(spark, sf_dir).withColumns({"u": u, "v": v})
    seen = F.col("track_id") % 5 != 4
    su, sv = F.when(seen, F.col("u") + F.col("frame_index") % 31).otherwise(0.0), F.when(seen, F.col("v") + F.col("track_id")).otherwise(0.0)
    return p.select("frame_index", "track_id", F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), G.is_inlier(F.col("u"), F.col("v"), su, sv).alias("inlier"))


@query(f"{WITH}, g as (select range i, (range%13)*2800.0e0/12/30.48e0 gx, (1500.0e0-((range//13)*175.0e0+(range//13)*((range//13)-1)/2*30.0e0))/30.48e0 gy from range(91)), n as (select frame_index, track_id, i, gx, gy, row_number() over (partition by frame_index, track_id order by (gx-x_ft)*(gx-x_ft)+(gy-y_ft)*(gy-y_ft), i) r from p, g) select frame_index, track_id, i grid, round(gx,6) gx, round(gy,6) gy from n where r=1")
def nearest_grid_point(spark, sf_dir):
    """The point of the court grid nearest to each player: 91 points inside each row, no join."""
    def gap(i):
        x, y = G.grid_point(i)
        return (x - F.col("x_ft")) * (x - F.col("x_ft")) + (y - F.col("y_ft")) * (y - F.col("y_ft"))

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(90)), lambda i: F.struct(gap(i).alias("d"), i.alias("i"))))["i"]
    rows = players(spark, sf_dir).select("frame_index", "track_id", best.cast("long").alias("grid"))
    x, y = G.grid_point(F.col("grid"))
    return rows.select("frame_index", "track_id", "grid", F.round(x, 6).alias("gx"), F.round(y, 6).alias("gy"))


@query(f"{WITH}, c as (select frame_index, track_id, 61 n, max(x_ft+6*cos(2*pi()*k.range/60)) x2, min(y_ft+6*sin(2*pi()*k.range/60)) y1 from p, range(61) k group by all) select frame_index, track_id, n, round(x2,6) x2, round(y1,6) y1 from c")
def circles(spark, sf_dir):
    """The points of a circle around each player: how many, and how far they reach."""
    c = G.circle_points(F.col("x_ft"), F.col("y_ft"), F.lit(6.0))
    far = lambda f, k: F.round(f(F.transform(c, lambda p: p[k])), 6)
    return players(spark, sf_dir).select("frame_index", "track_id", F.size(c).alias("n"), far(F.array_max, "x").alias("x2"), far(F.array_min, "y").alias("y1"))


@query("""select event_id, least(greatest(value/60,0.05),1.0) share, case when event_type in ('view','click') then event_type else 'view' end kind, case when value>=40 then 'bottleneck' else 'fine' end speed,
 case when value*20011.7>=1048576 then printf('%.1f', value*20011.7/1048576)||' MB' else printf('%.1f', value*20011.7/1024)||' KB' end size, (event_id//60)||':'||lpad(cast(event_id%60 as varchar),2,'0') clock,
 case when event_id%40<1 then 'today' when event_id%40<7 then '7d' when event_id%40<30 then '30d' else 'older' end age, 'a/b-'||event_id||case when event_id%2=0 then '_tactics.json' else '_map.mp4' end path from events""")
def labels_and_bounds(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    path = F.when(i % 2 == 0, L.sibling_path(F.concat(F.lit("a/b-"), i.cast("string"), F.lit("_metadata.json")), "_tactics.json")).otherwise(L.sibling_path(F.concat(F.lit("a/b-"), i.cast("string"), F.lit(".mp4")), "_map.mp4"))
    return table(spark, sf_dir, "events").select("event_id", L.clamped(v / 60, 0.05, 1.0).alias("share"), L.one_of(F.col("event_type"), ["view", "click"], "view").alias("kind"), L.bottleneck(v, 40).alias("speed"), L.byte_text(v * 20011.7).alias("size"), L.clock_text(i).alias("clock"), L.recency(i % 40).alias("age"), path.alias("path"))


@query("""with t as (select user_id, event_id, event_type from events), s as (select user_id, event_type, min(event_id) f from t group by all), k as (select user_id, string_agg(event_type, '>' order by f) tokens from s where event_type<>'error' group by 1) select u.user_id, coalesce(tokens, 'none') tokens from (select distinct user_id from events) u left join k using (user_id)""")
def distinct_tokens(spark, sf_dir):
    """Each user's kinds of events once, in order, errors not available."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]), " , ").alias("t"))
    kinds = F.array(*map(F.lit, ("view", "signup", "purchase", "click")))
    return rows.select("user_id", F.array_join(L.tokens_of(F.col("t"), kinds, "none"), ">").alias("tokens"))


@query("select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) r from events) where r<=24")
def first_prompts(spark, sf_dir):
    return S.first_of_each(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], 24, F.desc("value"), "event_id").select("user_id", "event_id")


@query("""with p as (select user_id%20 run, event_type stage, sum(value) as "seconds", min(event_id) f, max(100+user_id%20) frames from events group by all), a as (select *, sum("seconds") over (partition by run) total, row_number() over (partition by run order by f, stage) place from p)
 select run, stage, round("seconds",6) as "seconds", round(100.0*"seconds"/total,6) share, round(1000.0*"seconds"/frames,6) ms_a_frame, cast(place as int) place from a""")
def stage_times(spark, sf_dir):
    run = F.col("user_id") % 20
    laps = table(spark, sf_dir, "events").select(run.alias("run"), F.col("event_type").alias("stage"), F.col("event_id").alias("at"), F.col("value").alias("seconds"), (100 + run).alias("frames"))
    return S.stage_times(laps, ["run"]).withColumns({c: F.round(c, 6) for c in ("seconds", "share", "ms_a_frame")})


@query("""with r as (select o_custkey, o_orderkey%4+1 workers, o_totalprice wall, o_orderkey%97 memory from orders), m as (select o_custkey, min(wall) filter (where workers=1) one, arg_max(wall, (workers, -wall)) filter (where workers>1) many, max(workers) n, max(memory) peak from r group by 1)
 select o_custkey, round(one/many,2) speed_up, round(one/many/n,3) efficiency, peak from m""")
def speed_up(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 4 + 1).alias("workers"), F.col("o_totalprice").alias("wall"), (F.col("o_orderkey") % 97).alias("memory"))
    return S.speed_up(o, ["o_custkey"])


@query("select cast(count(*) as bigint) as scope, cast(count(*) filter (where o_orderstatus='F') as bigint) as done, round(100.0*count(*) filter (where o_orderstatus='F')/count(*)) as percent, cast(count(*) filter (where o_orderstatus<>'F') as bigint) as \"left\", cast(greatest(0, date '1999-01-01' - cast(max(o_orderdate) as date)) as int) as days_left from orders")
def progress_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.lit(1).alias("one"), (F.col("o_orderstatus") == "F").cast("int").alias("done"), F.to_date("o_orderdate").alias("d"))
    return S.totals(o, "one", "done", F.max("d"), F.lit("1999-01-01").cast("date"))


@query("with m as (select o_orderpriority p, max(o_custkey) m from orders group by 1), s as (select p, coalesce(sum(m+20) over (order by p rows between unbounded preceding and 1 preceding),0) start_at from m) select o_orderkey, cast(start_at+o_custkey as bigint) as \"at\" from orders join s on p=o_orderpriority")
def steps_from_the_start(spark, sf_dir):
    from hardwood.plans.queries import running_offsets

    offsets = running_offsets(spark, sf_dir).select(F.col("p").alias("o_orderpriority"), "start_at")
    return S.with_offsets(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), offsets, ["o_orderpriority"], "o_custkey").select("o_orderkey", "at")


@query("""with c as (select user_id, '#'||printf('%06x', cast(user_id*7919%16777216 as bigint)) a, user_id*7919%16777216 x, user_id*104729%16777216 y, user_id*15485863%16777216 w, user_id*32452843%16777216 d from (select distinct user_id from events)),
 g as (select user_id, power(y//65536-w//65536,2)+power(y//256%256-w//256%256,2)+power(y%256-w%256,2)+power(x//65536-d//65536,2)+power(x//256%256-d//256%256,2)+power(x%256-d%256,2) crossed, power(x//65536-w//65536,2)+power(x//256%256-w//256%256,2)+power(x%256-w%256,2)+power(y//65536-d//65536,2)+power(y//256%256-d//256%256,2)+power(y%256-d%256,2) direct from c)
 select user_id, crossed<direct swapped from g""")
def teams_by_colour(spark, sf_dir):
    hexed = lambda k: F.format_string("#%06x", (F.col("user_id") * k % 16777216).cast("long"))
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select("user_id", N.swapped_by_colour(*(hexed(k) for k in (7919, 104729, 15485863, 32452843))).alias("swapped"))


@query(f"""{WITH}, c as (select frame_index, track_id, x_ft*10 x, y_ft*10 y, case when event_type<>'error' then value/100 end c from p join events on event_id=frame_index*10+track_id),
 b as (select *, row_number() over (partition by frame_index order by coalesce(c,1) desc, track_id) r from c where coalesce(c,1)>=0.9e0), f as (select d.frame_index, x, y, c from (select distinct frame_index from p) d left join b on b.frame_index=d.frame_index and r=1),
 v as (select *, coalesce(x-lag(x) over (order by frame_index),0) vx, coalesce(y-lag(y) over (order by frame_index),0) vy from f) select frame_index, round(x,6) x, round(y,6) y, coalesce(c,1) confidence, round(vx,6)+0.0 vx, round(vy,6)+0.0 vy from v where x is not null""")
def surest_ball(spark, sf_dir):
    """The surest of ten boxes a frame, and the way since the frame before."""
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("frame_index"), (F.col("event_id") % 10).alias("track_id"), F.when(F.col("event_type") != "error", F.col("value") / 100).alias("confidence"))
    p = boxes(players(spark, sf_dir)).join(e, ["frame_index", "track_id"])
    each = F.sort_array(F.collect_list(F.struct("track_id", F.struct("x1", "y1", "x2", "y2", "confidence").alias("b"))))
    rows = p.groupBy("video_id", "frame_index").agg(F.transform(each, lambda c: c["b"]).alias("candidates"))
    mid = lambda a, b: F.round((F.col(a) + F.col(b)) / 2, 6)
    return K.surest_ball(rows, 0.9).select("frame_index", mid("x1", "x2").alias("x"), mid("y1", "y2").alias("y"), "confidence", (F.round("vx", 6) + 0.0).alias("vx"), (F.round("vy", 6) + 0.0).alias("vy"))


@query("""with f as (select user_id, event_id, row_number() over (partition by user_id order by event_id) n, event_type='purchase' e, value>50 made from events), l as (select *, max(case when e then n end) over (partition by user_id order by n) last from f)
 select a.user_id, a.event_id, b.made from l a left join f b on a.user_id=b.user_id and a.last=b.n and a.n-a.last<25""")
def shown_results(spark, sf_dir):
    """The result of the last shot of each video, for 25 frames from its end on."""
    e = table(spark, sf_dir, "events")
    frames = e.select(F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_index"))
    ends = e.where("event_type = 'purchase'").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("end_frame"), (F.col("value") > 50).alias("made"), F.lit("left").alias("side"))
    return K.shown_results(frames, ends).select(F.col("video_id").alias("user_id"), F.col("frame_index").alias("event_id"), "made")


@query("select event_id, k.kind from events, (select unnest(['ball','referee','rim','other']) kind) k where k.kind in ('ball','rim') and (event_id%4=0 and k.kind='ball' or event_id%4=1 and k.kind='rim')")
def viewer_marks(spark, sf_dir):
    i = F.col("event_id")
    kind = F.when(i % 4 == 0, "ball").when(i % 4 == 1, "rim").when(i % 4 == 2, "referee").otherwise("other")
    return N.shown_marks(table(spark, sf_dir, "events").select("event_id", kind.alias("kind")), True, False, True, False)


@query("select event_id, case when user_id%7>0 then (user_id%7)*10.0e0 else 30.0e0 end fps, round(event_id/case when user_id%7>0 then (user_id%7)*10.0e0 else 30.0e0 end,4) \"at\" from events")
def frame_times(spark, sf_dir):
    fps = F.when(F.col("user_id") % 7 > 0, F.col("user_id") % 7 * 10.0).otherwise(F.when(F.col("user_id") % 2 == 0, 0.0))
    return table(spark, sf_dir, "events").select("event_id", L.frame_rate(fps).alias("fps"), L.frame_time(F.col("event_id"), fps).alias("at"))
