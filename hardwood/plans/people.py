"""Registered queries over teams, masks, identities, possession from boxes and the viewer's state."""

from __future__ import annotations

from pyspark.sql import functions as F

from hardwood.operators import identity as I
from hardwood.operators import masks as K
from hardwood.operators import possession as P
from hardwood.operators import teams as T
from hardwood.operators import viewer as V
from hardwood.plans.queries import WITH, boxes, players, query, table

# --- Teams ----------------------------------------------------------------------------------

ROUND_SQL = """with e as (select vec_id, cast(embedding as double[]) e from embeddings), a as (select arg_min(e, vec_id) c from e),
 f as (select arg_max(e, (list_distance(e, c), -vec_id)) c from e, a), r as (select vec_id, e.e, cast(list_distance(e.e, a.c) > list_distance(e.e, f.c) as int) cluster from e, a, f)"""


def _first_round(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return T.assigned(e, T.first_centres(e, 2, "vec_id", "embedding"), "embedding")


@query(f"{ROUND_SQL} select vec_id, cluster from r")
def team_assignment_round(spark, sf_dir):
    """One round: every vector with the nearer of the two first centres."""
    return _first_round(spark, sf_dir).select("vec_id", "cluster")


@query(f"{ROUND_SQL}, u as (select cluster, unnest(e) x, generate_subscripts(e, 1) i from r) select cluster, cast(i-1 as int) i, round(avg(x), 9) + 0.0 x from u group by cluster, i")
def team_mean_vectors(spark, sf_dir):
    """The centres that follow from one round, component by component."""
    means = T.mean_vectors(_first_round(spark, sf_dir), "embedding").select("cluster", F.posexplode("centre").alias("i", "x"))
    return means.select("cluster", "i", (F.col("x") + 0.0).alias("x"))


@query(f"{ROUND_SQL}, m as (select cluster, count(*) n, avg(100+e[1]*50) bright, avg(100+e[2]*50) red from r group by cluster) select cluster, n, round(bright,6) bright, round(red,6) red, case when bright=max(bright) over () then 'white' else 'dark' end team from m")
def shirt_brightness(spark, sf_dir):
    """Which of two clusters is the bright one, by a stand-in for the crops' brightness."""
    shade = lambda i: 100 + F.col("embedding")[i].cast("double") * 50
    rows = _first_round(spark, sf_dir).withColumns({"bright": shade(0), "red": shade(1)})
    return T.brightness_of_clusters(rows, "bright", ["red"]).select("cluster", "n", F.round("bright", 6).alias("bright"), F.round("red", 6).alias("red"), "team")


@query()
def team_clusters(spark, sf_dir):
    """All rounds with as many clusters as there are labels, and how far they agree with these."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return T.agreement(T.cluster_teams(e, 10)[0], "label")


# --- Masks ----------------------------------------------------------------------------------

PIXELS_SQL = "px as (select distinct event_id//50 mask, (user_id*7)%41 x, event_id%29 y from events)"


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pixels = e.select(F.floor(F.col("event_id") / 50).alias("mask"), (F.col("user_id") * 7 % 41).alias("x"), (F.col("event_id") % 29).alias("y"))
    return K.runs_of_pixels(pixels, ["mask"])


@query(f"with {PIXELS_SQL} select mask, count(*) pixels, count(*) filter (where x between 5 and 25 and y between 3 and 20) in_box from px group by mask")
def mask_areas(spark, sf_dir):
    r = F.col("runs")
    return _runs(spark, sf_dir).select("mask", K.mask_area(r).alias("pixels"), K.overlap_with_box(r, *map(F.lit, (5, 3, 25, 20))).alias("in_box"))


@query(f"with {PIXELS_SQL} select a.mask, b.mask as after, count(*) shared from px a join px b on b.mask=a.mask+1 and a.x=b.x and a.y=b.y group by all")
def mask_overlaps(spark, sf_dir):
    """Pixels that each mask shares with the next."""
    r = _runs(spark, sf_dir)
    a, b = r.select(F.col("mask").alias("pair"), "mask", "runs"), r.select((F.col("mask") - 1).alias("pair"), F.col("mask").alias("after"), "runs")
    return K.overlap_of_masks(a, b, ["pair"], ("mask", "after")).select("mask", "after", "shared")


@query("""with c as (select event_id//50 mask, (user_id*7)%41 x, min(event_id%29) t, max(event_id%29) low from events group by all),
 w as (select *, cast(trunc((max(x) over (partition by mask) - min(x) over (partition by mask))*(1.0e0-0.6e0)/2.0e0) as bigint) side, min(x) over (partition by mask) a, max(x) over (partition by mask) b from c),
 u as (select *, x between a+side and b-side inn, bool_or(x between a+side and b-side) over (partition by mask) any_in from w), v as (select *, inn or not any_in as use from u)
 select mask, min(x) x1, min(t) y1, max(x) x2, max(low) y2, quantile_disc(x,0.5) filter (where use) foot_x, quantile_disc(low,0.5) filter (where use) foot_y from v group by mask""")
def mask_run_feet(spark, sf_dir):
    return K.mask_feet(_runs(spark, sf_dir), ["mask"])


NUMBERS_SQL = f"""{PIXELS_SQL}, nu as (select event_id//250 frame, event_id%50 number_idx, user_id%30 x1, cast(floor(value%20) as bigint) y1, user_id%30+6 x2, cast(floor(value%20) as bigint)+8 y2 from events where event_id%50<3 and (event_id//50)%5=0),
 ar as (select mask, count(*) a from px group by mask), sh as (select frame, number_idx, mask, (select count(*) from px where px.mask=ar.mask and x between x1 and x2 and y between y1 and y2)/cast(least(a, (x2-x1+1)*(y2-y1+1)) as double) ios from nu join ar on ar.mask//5=nu.frame)"""


@query(f"with {NUMBERS_SQL}, b as (select *, row_number() over (partition by frame, number_idx order by ios desc, mask) r from sh) select frame, number_idx, mask track_id, round(ios,9) ios from b where r=1 and ios>=0.1")
def numbers_on_masks(spark, sf_dir):
    """Three number boxes a frame of five masks, and the mask that each lies on."""
    masks = _runs(spark, sf_dir).select(F.floor(F.col("mask") / 5).alias("frame"), (F.col("mask") % 5).alias("pos"), F.col("mask").alias("track_id"), "runs")
    i, x, y = F.col("event_id"), F.col("user_id") % 30, F.floor(F.col("value") % 20)
    e = table(spark, sf_dir, "events").where("event_id % 50 < 3 and floor(event_id / 50) % 5 = 0")
    numbers = e.select(F.floor(i / 250).alias("frame"), (i % 50).alias("number_idx"), x.alias("x1"), y.alias("y1"), (x + 6).alias("x2"), (y + 8).alias("y2"))
    return K.numbers_on_masks(numbers, masks, ["frame"], 0.1).select("frame", "number_idx", "track_id", F.round("ios", 9).alias("ios"))


# --- Viewer ---------------------------------------------------------------------------------


@query("""with t as (select event_id, user_id, event_id+user_id%50 t from events where event_type='purchase'), v as (select user_id, event_id f, value from events where event_type='view'),
 s as (select user_id, event_id f from events where event_type='signup'), c as (select user_id, event_id f, event_id+value*10 till from events where event_type='click'),
 a as (select t.*, v.f vf, v.value from t asof left join v on t.user_id=v.user_id and t.t>=v.f), b as (select a.*, s.f sf from a asof left join s on a.user_id=s.user_id and a.t>=s.f), d as (select b.*, c.f cf, c.till from b asof left join c on b.user_id=c.user_id and b.t>=c.f),
 z as (select user_id, min(f) f0 from v group by user_id)
 select event_id, coalesce(vf, f0) frame, case when t<=sf+400 then sf end screen, case when t<=till then cf end shot from d left join z using (user_id)""")
def viewer_state(spark, sf_dir):
    """At each time the frame shown (before all: the first), the screen that lingers and the shot that still runs."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    times = e.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("event_id") + F.col("user_id") % 50).alias("t"))
    of = lambda kind, *more: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias("f"), *more)
    streams = {
        "frame": V.Carried(of("view", "value"), "f", ["value"], clamp=True),
        "screen": V.Carried(of("signup"), "f", [], linger=400),
        "shot": V.Carried(of("click", (F.col("event_id") + F.col("value") * 10).alias("till")), "f", [], until="till"),
    }
    out = V.carried_at(times, ["user_id"], "t", streams)
    return out.select("event_id", *(F.col(f"{n}.f").alias(n) for n in streams))


@query(f"{WITH} select f.frame_index, f.h possessor_track_id, x1, y1, x2, y2 from (select distinct frame_index, frame_index%12 h from p) f left join bx on bx.frame_index=f.frame_index and bx.track_id=f.h")
def possessor_boxes(spark, sf_dir):
    p = boxes(players(spark, sf_dir))
    frames = p.select("frame_index").distinct().withColumn("possessor_track_id", F.col("frame_index") % 12)
    return V.possessor_boxes(frames, p, ["frame_index"]).select("frame_index", "possessor_track_id", "x1", "y1", "x2", "y2")


ROSTER_SQL = "ro as (select case when s_nationkey%2=0 then 'A' else 'B' end team, s_suppkey%23 number, min(s_name) name from supplier group by all)"


def _roster(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.groupBy(F.when(F.col("s_nationkey") % 2 == 0, "A").otherwise("B").alias("team"), (F.col("s_suppkey") % 23).alias("number")).agg(F.min("s_name").alias("name"))


def _sides(spark):
    return spark.createDataFrame([("white", "B"), ("dark", "A")], "side string, team string")


READINGS_SQL = f"re as (select user_id track_id, event_id frame_index, case when event_type<>'error' then cast(floor(value) as bigint)//8%23 end number, case when (user_id+event_id%3)%4<2 then 'white' else 'dark' end side from events), {ROSTER_SQL}, si as (select 'white' side, 'B' team union all select 'dark', 'A')"


def _readings(spark, sf_dir):
    u, i = F.col("user_id"), F.col("event_id")
    number = F.when(F.col("event_type") != "error", F.floor(F.floor("value") / 8) % 23)
    return table(spark, sf_dir, "events").select(u.alias("track_id"), i.alias("frame_index"), number.alias("number"), F.when((u + i % 3) % 4 < 2, "white").otherwise("dark").alias("side"))


@query(f"""with {READINGS_SQL}, n as (select *, row_number() over (partition by track_id order by c desc, f) r from (select track_id, number, count(*) c, min(frame_index) f from re where number is not null group by all)), s as (select *, row_number() over (partition by track_id order by c desc, f) r from (select track_id, side, count(*) c, min(frame_index) f from re group by all))
 select n.track_id, n.number, s.side, ro.name from n left join s on s.track_id=n.track_id and s.r=1 left join si on si.side=s.side left join ro on ro.team=si.team and ro.number=n.number where n.r=1""")
def viewer_track_names(spark, sf_dir):
    return V.track_names(_readings(spark, sf_dir), _roster(spark, sf_dir), _sides(spark))


# --- Identity -------------------------------------------------------------------------------

LOCK_SQL = f"{READINGS_SQL}, g as (select *, row_number() over (partition by track_id order by frame_index)-row_number() over (partition by track_id, number order by frame_index) g from re where number is not null), h as (select *, row_number() over (partition by track_id, number, g order by frame_index) nth from g), lk as (select track_id, min(frame_index) valid_from, arg_min(number, frame_index) number from h where nth=2 group by track_id)"


def _locks(spark, sf_dir):
    return I.number_intervals(_readings(spark, sf_dir).select("track_id", "frame_index", "number"), ["track_id"], 2)


@query(f"with {LOCK_SQL} select track_id, number, valid_from from lk")
def number_intervals(spark, sf_dir):
    return _locks(spark, sf_dir).select("track_id", "number", "valid_from")


@query(f"with {LOCK_SQL}, x as (select re.track_id, re.frame_index, re.side, case when re.frame_index>=lk.valid_from then lk.number end number from re left join lk using (track_id)) select x.track_id, x.frame_index, x.number, si.team, ro.name from x left join si using (side) left join ro on ro.team=si.team and ro.number=x.number")
def identified_players(spark, sf_dir):
    rows = _readings(spark, sf_dir).select("track_id", "frame_index", "side")
    return I.identified(rows, _locks(spark, sf_dir), _sides(spark), _roster(spark, sf_dir), ["track_id"]).drop("side")


@query(f"with {LOCK_SQL} select lk.track_id, lk.number, si.team, ro.name from lk left join (select track_id, max(side) side from re group by track_id) s using (track_id) left join si using (side) left join ro on ro.team=si.team and ro.number=lk.number")
def number_summary(spark, sf_dir):
    sides = _readings(spark, sf_dir).groupBy("track_id").agg(F.max("side").alias("side"))
    return I.lock_summary(_locks(spark, sf_dir), sides, _sides(spark), _roster(spark, sf_dir), ["track_id"])


@query("""with c as (select l_suppkey, l_returnflag in ('A','R') a, l_linestatus='O' o, cast(sum(l_quantity) as double) q from lineitem group by all), t as (select l_suppkey, sum(q) filter (where a and not o) w0, sum(q) filter (where not a and o) w1, sum(q) filter (where a and o) d0, sum(q) filter (where not a and not o) d1 from c group by 1)
 select l_suppkey, case when w1+d0<w0+d1 then '1' else '0' end white from t""")
def teams_by_cost(spark, sf_dir):
    """Of two teams the sides at the least total cost."""
    place, side = F.when(F.col("l_returnflag").isin("A", "R"), 0).otherwise(1), F.when(F.col("l_linestatus") == "O", "dark").otherwise("white")
    side = F.when(place == 0, side).otherwise(F.when(F.col("l_linestatus") == "O", "white").otherwise("dark"))
    costs = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", place.alias("place"), side.alias("side")).agg(F.sum(F.col("l_quantity").cast("double")).alias("cost")).withColumn("team", F.col("place").cast("string"))
    known = costs.select("l_suppkey").distinct().join(I.assign_two(costs, ["l_suppkey"]), "l_suppkey", "left")
    return known.select("l_suppkey", F.coalesce("white", F.lit("0")).alias("white"))


# --- Possession from detections -------------------------------------------------------------

SCENE_SQL = f"""{WITH}, gone as (select event_id//10 frame_index from events where event_id%10=0 and user_id%17=0),
 pl as (select frame_index, track_id, x1, y1, x2, y2, (x1+x2)/2 cx, (y1+y2)/2 cy from bx where frame_index not in (select frame_index from gone)),
 ba as (select frame_index, (x1+x2)/2+greatest(frame_index%20-11,0)*60 bx, y2+0.0e0 bq, case when frame_index%20>11 then 60.0e0 else 1.0e0 end vx, 0.0e0 vy, frame_index%9=4 predicted from bx where track_id=(frame_index//20)%10 and frame_index%31<>7),
 rm as (select distinct frame_index, 150.0e0+frame_index%200 rx, 300.0e0 ry, 20.0e0+frame_index%9 rh from p),
 bl as (select ba.*, sqrt((bx-rx)*(bx-rx)+(bq-ry)*(bq-ry))<=2.5e0*rh near_rim from ba join rm using (frame_index)),
 mk as (select frame_index, x1+frame_index%6 x1, y1 y1, x2+frame_index%6 x2, y2 y2 from bx join events on event_id=frame_index*10 where track_id=(frame_index//20+cast(frame_index%7=3 as int))%10 and frame_index%4<>0 and value/100>=0.3e0)"""


def _detections(spark, sf_dir):
    """Frames, players, balls, marks and rims; some frames lack players, balls or marks."""
    p = boxes(players(spark, sf_dir))
    f, e = F.col("frame_index"), table(spark, sf_dir, "events")
    gone = e.where("event_id % 10 = 0 and user_id % 17 = 0").select(F.floor(F.col("event_id") / 10).alias("frame_index"))
    here = p.join(gone, "frame_index", "left_anti").select("video_id", "frame_index", F.col("track_id").alias("pos"), "track_id", "x1", "y1", "x2", "y2")
    held = p.where(F.col("track_id") == F.floor(f / 20) % 10)
    off = F.greatest(f % 20 - 11, F.lit(0)) * 60
    bx, by = (F.col("x1") + F.col("x2")) / 2 + off, F.col("y2")
    balls = held.where(f % 31 != 7).select("video_id", "frame_index", F.lit(0).alias("det_idx"), (bx - 5).alias("x1"), (by - 5).alias("y1"), (bx + 5).alias("x2"), (by + 5).alias("y2"), F.when(f % 20 > 11, 60.0).otherwise(1.0).alias("vx"), F.lit(0.0).alias("vy"), (f % 9 == 4).alias("predicted"))
    marked = p.where(F.col("track_id") == (F.floor(f / 20) + (f % 7 == 3).cast("int")) % 10).where(f % 4 != 0)
    sure = e.where("event_id % 10 = 0").select(F.floor(F.col("event_id") / 10).alias("frame_index"), (F.col("value") / 100 + 0.25).alias("confidence"))
    marks = marked.join(sure, "frame_index").select("video_id", "frame_index", F.lit(0).alias("det_idx"), "confidence", (F.col("x1") + f % 6).alias("x1"), "y1", (F.col("x2") + f % 6).alias("x2"), "y2")
    frames = p.select("video_id", "frame_index").distinct()
    rx, rh = 150.0 + f % 200, 20.0 + f % 9
    rims = frames.select("video_id", "frame_index", (rx - 10).alias("x1"), (300 - rh / 2).alias("y1"), (rx + 10).alias("x2"), (300 + rh / 2).alias("y2"))
    return frames, here, balls, marks, rims


EDGE = "sqrt(power(greatest(x1-15-bx,bx-x2-15,0),2)+power(greatest(y1-15-bq,bq-y2-15,0),2))/100"


@query(f"""{SCENE_SQL}, mo as (select pl.*, cx-lag(cx) over w mx, frame_index-lag(frame_index) over w=1 follows from pl window w as (partition by track_id order by frame_index)),
 ca as (select mo.frame_index, track_id, {EDGE} edge, {EDGE}+1e-3*sqrt((bx-cx)*(bx-cx)+(bq-cy)*(bq-cy))/100 score, vx, near_rim, case when follows then mx*vx end align from mo join bl using (frame_index)),
 ok as (select frame_index, count(*) n, arg_min(track_id, (score, track_id)) nearest, round(min(score),9) score, count(align) moving from ca where edge<=0.35 and vx/100<=0.5 and not near_rim group by 1),
 ov as (select mk.frame_index, pl.track_id, pl.x1, pl.y1, pl.x2, pl.y2, greatest(least(pl.x2,mk.x2)-greatest(pl.x1,mk.x1),0)*greatest(least(pl.y2,mk.y2)-greatest(pl.y1,mk.y1),0) i from mk join pl using (frame_index)),
 be as (select * from (select *, row_number() over (partition by frame_index order by i desc, track_id) r from ov where i/(8000-i)>=0.45) where r=1),
 ps as (select be.frame_index, be.track_id possessor from be left join bl using (frame_index) where bl.bx is null or predicted or {EDGE}<=0.25),
 fr as (select distinct frame_index from p), en as (select frame_index, count(*) n from pl group by 1)
 select fr.frame_index, coalesce(en.n,0) entities, coalesce(ok.n,0) candidates, nearest, score, coalesce(moving,0) moving, possessor, case when en.n is null then false else coalesce(predicted,false) end predicted from fr left join en using (frame_index) left join ok using (frame_index) left join ps using (frame_index) left join bl using (frame_index)""")
def possession_inputs(spark, sf_dir):
    """What the possession machine is told of each frame: candidates by nearness, the marked player, frames without players."""
    rows = P.possession_inputs(*_detections(spark, sf_dir))
    c = F.col("candidates")
    first, moving = F.get(c, F.lit(0)), F.size(F.filter(c, lambda x: x["align"].isNotNull()))
    zero = lambda x: F.coalesce(F.greatest(x, F.lit(0)), F.lit(0)).cast("long")
    return rows.select("frame_index", "entities", zero(F.size(c)).alias("candidates"), first["track_id"].alias("nearest"), F.round(first["score"], 9).alias("score"), zero(moving).alias("moving"), "possessor", "predicted")


@query()
def possession_from_detections(spark, sf_dir):
    """Frames held by each player, those without players not counted."""
    return P.possession_time(P.possession_from_detections(*_detections(spark, sf_dir))).select("possessor_track_id", "frames")


@query(f"{SCENE_SQL}, o as (select bl.frame_index, track_id possessor_track_id, round({EDGE},3) edge, near_rim, {EDGE} e from bl join pl using (frame_index) where track_id=(frame_index//20)%10) select frame_index, possessor_track_id, edge, near_rim from o where e>0.35 or (near_rim and e>0.25)")
def odd_possessions(spark, sf_dir):
    """Frames whose holder, here always the one whom the ball leaves, is too far from it."""
    frames, here, balls, _, rims = _detections(spark, sf_dir)
    held = frames.withColumn("possessor_track_id", F.floor(F.col("frame_index") / 20) % 10)
    return P.odd_possessions(held, here, balls, rims).drop("video_id")


@query()
def possession_run_counts(spark, sf_dir):
    """The counters of one run and its quality, as two runs are compared by them."""
    frames, here, balls, marks, rims = _detections(spark, sf_dir)
    rows = P.possession_inputs(frames, here, balls, marks, rims)
    held = P.possession(rows)
    counts = P.possession_counts(rows, held, marks)
    return counts.join(P.possession_quality(held, P.odd_possessions(held, here, balls, rims)).select("video_id", "coverage", "odd"), "video_id")
