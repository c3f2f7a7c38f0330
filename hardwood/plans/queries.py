"""Registered queries. The driver's tables hold no boxes, so positions come from a fixed view of
``events``: each query says in its name which operator it exercises."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hardwood.functions import geometry as G
from hardwood.operators import joins as J
from hardwood.operators import ranges as R
from hardwood.operators import sequences as Q
from hardwood.operators import smoothing as M
from hardwood.operators import state as K
from hardwood.plans import screens as S

# Fixed value: positions made of events, the same rows in both engines.
PLAYERS_SQL = """select 'v' video_id, cast(floor(event_id/10) as bigint) frame_index, event_id % 10 track_id,
  case when event_id % 10 < 5 then 'white' else 'dark' end team,
  15.0e0 + ((event_id%10)%5)*5.0e0 + ((cast(floor(event_id/50) as bigint)*13 + (event_id%10)*7) % 40)/10.0e0 x_ft,
  25.0e0 + ((cast(floor(event_id/50) as bigint)*7 + (event_id%10)*11) % 50)/10.0e0 y_ft from events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PLAYERS_SQL.replace("from events", "from {events}"), events=table(spark, sf_dir, "events"))


def boxes(df: DataFrame) -> DataFrame:
    """Boxes in pixels around the positions."""
    x, y = F.col("x_ft") * 10, F.col("y_ft") * 10
    return df.withColumns({"x1": x - 20, "y1": y - 50, "x2": x + 20, "y2": y + 50})


BOXES = "x_ft*10-20 x1, y_ft*10-50 y1, x_ft*10+20 x2, y_ft*10+50 y2"
IOU_SQL = """case when least(a.x2,b.x2)>greatest(a.x1,b.x1) and least(a.y2,b.y2)>greatest(a.y1,b.y1) then
  ((least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1)))
  / ((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1)-(least(a.x2,b.x2)-greatest(a.x1,b.x1))*(least(a.y2,b.y2)-greatest(a.y1,b.y1))) else 0.0 end"""
WITH = f"with p as ({PLAYERS_SQL}), bx as (select *, {BOXES} from p)"
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


HITS_SQL = f"""{WITH},
w as (select * from p where team='white'), b as (select * from p where team='dark'),
pr as (select i.frame_index, i.track_id i, j.track_id j, i.x_ft ix, i.y_ft iy, j.x_ft jx, j.y_ft jy from w i join w j using (frame_index)
  where i.track_id<j.track_id and sqrt((i.x_ft-j.x_ft)*(i.x_ft-j.x_ft)+(i.y_ft-j.y_ft)*(i.y_ft-j.y_ft))>4 and sqrt((i.x_ft-j.x_ft)*(i.x_ft-j.x_ft)+(i.y_ft-j.y_ft)*(i.y_ft-j.y_ft))<8),
c as (select pr.*, b.track_id d, b.x_ft dx, b.y_ft dy, ((b.x_ft-ix)*(jx-ix)+(b.y_ft-iy)*(jy-iy))/((jx-ix)*(jx-ix)+(jy-iy)*(jy-iy)) t from pr join b using (frame_index)),
h as (select *, sqrt((dx-(ix+t*(jx-ix)))*(dx-(ix+t*(jx-ix)))+(dy-(iy+t*(jy-iy)))*(dy-(iy+t*(jy-iy)))) perp,
  sqrt((dx-ix)*(dx-ix)+(dy-iy)*(dy-iy)) di, sqrt((dx-jx)*(dx-jx)+(dy-jy)*(dy-jy)) dj from c),
g as (select *, row_number() over (partition by frame_index,i,j order by perp,d) r from h where least(di,dj)<4 and t>0.15 and t<0.85 and perp<4),
hit as (select frame_index,i,j,case when di<=dj then i else j end screener, case when di<=dj then j else i end screenee from g where r=1)"""


def _offence(p: DataFrame) -> DataFrame:
    return p.select("video_id", "frame_index", F.lit("white").alias("offence")).distinct()


@query(HITS_SQL + " select frame_index,i,j,screener,screenee from hit")
def screen_frame_hits(spark, sf_dir):
    p = players(spark, sf_dir)
    return S.frame_hits(p, _offence(p)).select("frame_index", "i", "j", "screener", "screenee")


@query(HITS_SQL + """, n as (select *, case when frame_index - lag(frame_index) over (partition by i,j order by frame_index) > 5 then 1 else 0 end nw from hit),
 r as (select *, sum(nw) over (partition by i,j order by frame_index) run_id from n)
 select i,j,min(frame_index) start_frame,max(frame_index) end_frame,count(*) frames from r group by i,j,run_id having count(*)>=3""")
def screen_pair_runs(spark, sf_dir):
    p = players(spark, sf_dir)
    return S.screen_runs(S.frame_hits(p, _offence(p))).select("i", "j", "start_frame", "end_frame", "frames")


@query()
def screens_by_type(spark, sf_dir):
    return S.screens(players(spark, sf_dir)).groupBy("screen_type").agg(F.count("*").alias("n"))


@query(f"{WITH} select frame_index, min(track_id) filter (where team='white') w, count(*) n from p where (x_ft between -6 and 100) and (y_ft between -6 and 56) group by frame_index")
def in_bounds_players(spark, sf_dir):
    p = players(spark, sf_dir).where(G.in_bounds(F.col("x_ft"), F.col("y_ft")))
    return p.groupBy("frame_index").agg(F.min(F.when(F.col("team") == "white", F.col("track_id"))).alias("w"), F.count("*").alias("n"))


@query(f"{WITH}, x as (select a.frame_index, a.track_id a, b.track_id b, {IOU_SQL} iou from bx a join bx b on a.frame_index=b.frame_index and a.team='white' and b.team='dark'), y as (select *, row_number() over (partition by frame_index order by iou desc,a,b) r from x where iou>=0.15) select frame_index,a,b,round(iou,9) iou from y where r=1")
def best_overlap_join(spark, sf_dir):
    p = boxes(players(spark, sf_dir))
    a = p.where("team='white'").select("frame_index", F.col("track_id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ("x1", "y1", "x2", "y2")))
    b = p.where("team='dark'").select("frame_index", F.col("track_id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")))
    return J.best_overlap(a, b, ["frame_index"], G.box("a_"), G.box("b_"), ("a", "b"), 0.15).select("frame_index", "a", "b", F.round("iou", 9).alias("iou"))


@query(f"{WITH}, n as (select a.frame_index, a.track_id a, b.track_id b, row_number() over (partition by a.frame_index,a.track_id order by (a.x_ft-b.x_ft)*(a.x_ft-b.x_ft)+(a.y_ft-b.y_ft)*(a.y_ft-b.y_ft), b.track_id) r from p a join p b on a.frame_index=b.frame_index and a.team<>b.team) select frame_index,a,b from n where r=1")
def nearest_opponent(spark, sf_dir):
    p = players(spark, sf_dir)
    a = p.select("frame_index", F.col("track_id").alias("a"), F.col("team").alias("at"), F.col("x_ft").alias("ax"), F.col("y_ft").alias("ay"))
    b = p.select("frame_index", F.col("track_id").alias("b"), F.col("team").alias("bt"), F.col("x_ft").alias("bx"), F.col("y_ft").alias("by"))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return J.first_by(a.join(b, "frame_index").where("at != bt"), ["frame_index", "a"], dx * dx + dy * dy, "b").select("frame_index", "a", "b")


@query("select c_custkey, n_name, r_name from customer left join nation on c_nationkey=n_nationkey left join region on n_regionkey=r_regionkey")
def roster_lookup_all(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    roster = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.lit("all").alias("team"), F.col("n_nationkey").alias("number"), "n_name", "r_name")
    return J.roster_names(c.select("c_custkey", F.lit("all").alias("team"), F.col("c_nationkey").alias("number")), roster).select("c_custkey", "n_name", "r_name")


@query("select e.event_id, max(v.event_id) last_view from events e left join events v on v.user_id=e.user_id and v.event_type='view' and v.event_id<=e.event_id where e.event_type='purchase' group by e.event_id")
def asof_last_view(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    views = e.where("event_type='view'").select("user_id", "event_id", F.col("event_id").alias("last_view"))
    return J.asof_backward(e.where("event_type='purchase'").select("event_id", "user_id"), views, ["user_id"], "event_id", ["last_view"]).select("event_id", "last_view")


@query("with s as (select event_id start_at, event_id+40 end_at, user_id%7 k from events where event_type='signup'), x as (select e.event_id, e.user_id%7 k, s.start_at, row_number() over (partition by e.event_id order by s.start_at) r from events e join s on s.k=e.user_id%7 and e.event_id between s.start_at and s.end_at) select event_id,k,start_at from x where r=1")
def interval_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("k"), "event_type")
    s = e.where("event_type='signup'").select("k", F.col("event_id").alias("start_at"), (F.col("event_id") + 40).alias("end_at"))
    return J.interval_first(e.select("event_id", "k"), s, "k", "event_id", "start_at", "end_at", ["start_at"], 64).select("event_id", "k", "start_at")


@query("with x as (select user_id, event_type, count(*) votes, min(event_id) f from events group by all), r as (select *, row_number() over (partition by user_id order by votes desc, f, event_type) r from x) select user_id,event_type,votes from r where r=1")
def first_seen_mode(spark, sf_dir):
    return Q.first_seen_mode(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("with x as (select user_id,event_id,case when event_id-lag(event_id) over (partition by user_id order by event_id)>50 then 1 else 0 end n from events), y as (select *, sum(n) over (partition by user_id order by event_id) run_id from x) select user_id, cast(run_id as bigint) run_id, min(event_id) first_id, max(event_id) last_id, count(*) n from y group by user_id,run_id")
def gap_runs(spark, sf_dir):
    r = Q.with_runs(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 50)
    return r.groupBy("user_id", "run_id").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n"))


@query("with x as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id)-row_number() over (partition by user_id,event_type order by event_id) g from events), y as (select *, row_number() over (partition by user_id,event_type,g order by event_id) nth from x), z as (select *, row_number() over (partition by user_id order by event_id) r from y where nth=2) select user_id,event_type,event_id locked_at from z where r=1")
def consecutive_lock(spark, sf_dir):
    return Q.consecutive_lock(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", 2)


@query("with x as (select user_id, event_type t, lag(event_type) over (partition by user_id order by event_id) b from events) select user_id, count(*) filter (where t<>b) changes from x group by user_id")
def possession_switches(spark, sf_dir):
    return Q.changes(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("select event_type, count(*) frames, round(100.0*count(*)/sum(count(*)) over (),6) share from events group by event_type")
def possession_share(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("frames"))
    return n.withColumn("share", F.round(100.0 * F.col("frames") / F.sum("frames").over(Window.partitionBy()), 6))


@query("select o_orderpriority team, o_orderstatus side, count(*) attempts, count(*) filter (where o_totalprice>150000) makes, round(coalesce(100.0*count(*) filter (where o_totalprice>150000)/nullif(count(*),0),0),6) pct from orders group by grouping sets ((o_orderpriority),(o_orderstatus),())")
def shot_totals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("team"), F.col("o_orderstatus").alias("side"), (F.col("o_totalprice") > 150000).alias("made"))
    out = o.groupingSets([["team"], ["side"], []], "team", "side").agg(F.count("*").alias("attempts"), F.count_if("made").alias("makes"))
    return out.withColumn("pct", F.round(F.coalesce(100.0 * F.col("makes") / F.nullif(F.col("attempts"), F.lit(0)), F.lit(0.0)), 6))


@query("select l_returnflag, count(*) n, round(quantile_cont(l_extendedprice,0.25),4) p25, round(quantile_cont(l_extendedprice,0.5),4) median, round(quantile_cont(l_extendedprice,0.75),4) p75, round(100.0*count(*) filter (where l_extendedprice<10000)/count(*),6) below from lineitem group by l_returnflag")
def residual_percentiles(spark, sf_dir):
    x = F.col("l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", x)
    below = rows.groupBy("l_returnflag").agg(F.round(100.0 * F.count_if(x < 10000) / F.count("*"), 6).alias("below"))
    p = R.quantiles(rows, ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    return p.join(below, "l_returnflag").select("l_returnflag", "n", *(F.round(c, 4).alias(c) for c in ("p25", "median", "p75")), "below")


@query("with x as (select quality=0 t, d.n_chars<400 s from labels l join documents d using (doc_id)), c as (select count(*) filter (where t and s) tp, count(*) filter (where not t and s) fp, count(*) filter (where t and not s) fn from x) select tp,fp,fn,coalesce(cast(tp as double)/nullif(tp+fp,0),0) \"precision\", coalesce(cast(tp as double)/nullif(tp+fn,0),0) recall, coalesce(cast(2*tp as double)/nullif(2*tp+fp+fn,0),0) f1 from c")
def detector_precision_recall(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return Q.precision_recall(d, F.col("quality") == 0, F.col("n_chars") < 400)


@query("with d as (select datediff('day', date '1992-01-01', cast(o_orderdate as date)) d, count(*) n from orders group by 1) select d, n, cast(sum(n) over (order by d) as bigint) total from d")
def cumulative_per_day(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date")).alias("d")).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)))


@query("with m as (select o_orderpriority p, cast(max(o_custkey) as bigint) m from orders group by 1) select p, m, cast(coalesce(sum(m+20) over (order by p rows between unbounded preceding and 1 preceding),0) as bigint) start_at from m")
def running_offsets(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p")).agg(F.max("o_custkey").cast("long").alias("m"))
    return m.withColumn("start_at", F.coalesce(F.sum(F.col("m") + 20).over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))


@query("select conv_id, turn, list_aggregate(list(role) over (partition by conv_id order by turn rows between 2 preceding and current row), 'string_agg', '>') trail from conversations")
def trail_of_rows(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(">", F.collect_list("role").over(w)).alias("trail"))


@query(f"{WITH} select frame_index, track_id, round((2.0*x_ft+0.5*y_ft+10)/(0.01*x_ft+0.002*y_ft+1),9) u, round((0.1*x_ft+3.0*y_ft-5)/(0.01*x_ft+0.002*y_ft+1),9) v from p")
def perspective_projection(spark, sf_dir):
    u, v = G.project([2.0, 0.5, 10.0, 0.1, 3.0, -5.0, 0.01, 0.002, 1.0], F.col("x_ft"), F.col("y_ft"))
    return players(spark, sf_dir).select("frame_index", "track_id", F.round(u, 9).alias("u"), F.round(v, 9).alias("v"))


@query(f"{WITH} select track_id, round(sum(d),6) path, round(max(d),6) longest from (select track_id, sqrt(power(x_ft-lag(x_ft) over w,2)+power(y_ft-lag(y_ft) over w,2)) d from p window w as (partition by track_id order by frame_index)) group by track_id")
def path_lengths(spark, sf_dir):
    w = Window.partitionBy("track_id").orderBy("frame_index")
    d = G.distance(F.col("x_ft"), F.col("y_ft"), F.lag("x_ft").over(w), F.lag("y_ft").over(w))
    return players(spark, sf_dir).select("track_id", d.alias("d")).groupBy("track_id").agg(F.round(F.sum("d"), 6).alias("path"), F.round(F.max("d"), 6).alias("longest"))


@query("select o_custkey, round(regr_slope(o_totalprice, o_orderkey), 3) slope, count(*) n from orders group by o_custkey having count(distinct o_orderkey) > 1")
def line_fits(spark, sf_dir):
    fits = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.regr_slope("o_totalprice", "o_orderkey"), 3).alias("slope"), F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))
    return fits.where("keys > 1").drop("keys")


@query("with x as (select o_orderkey, row_number() over (order by o_orderkey)-1 r, count(*) over () n from orders) select cast(c as bigint) chunk, count(*) size from (select ntile(7) over (order by o_orderkey)-1 c from orders) group by c")
def chunk_sizes(spark, sf_dir):
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    chunks = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(7).cast("long"), F.col("n")) - 1)).alias("chunk"))
    return chunks.select("chunk", (F.floor(F.col("n") / 7) + (F.col("chunk") < F.col("n") % 7).cast("long")).alias("size"))


@query(f"""{WITH}, s as (select track_id, frame_index//15 arc, sum((frame_index%15)**4) s4, sum((frame_index%15)**3) s3, sum((frame_index%15)**2) s2, sum(frame_index%15) s1, count(*) s0,
  sum((frame_index%15)**2*y_ft) m2, sum((frame_index%15)*y_ft) m1, sum(y_ft) m0 from p group by all),
  d as (select *, nullif(s4*(s2*s0-s1*s1) - s3*(s3*s0-s1*s2) + s2*(s3*s1-s2*s2), 0) d from s)
  select track_id, arc, round((m2*(s2*s0-s1*s1) - s3*(m1*s0-s1*m0) + s2*(m1*s1-s2*m0))/d, 6)+0.0e0 a, round((s4*(m1*s0-s1*m0) - m2*(s3*s0-s1*s2) + s2*(s3*m0-m1*s2))/d, 6)+0.0e0 b,
  round((s4*(s2*m0-m1*s1) - s3*(s3*m0-m1*s2) + m2*(s3*s1-s2*s2))/d, 6)+0.0e0 c from d""")
def parabola_fit(spark, sf_dir):
    p = players(spark, sf_dir).withColumn("t", F.col("frame_index") % 15).withColumn("arc", F.floor(F.col("frame_index") / 15))
    return Q.quadratic_fit(p, ["track_id", "arc"], "t", "y_ft").select("track_id", "arc", *((F.round(c, 6) + 0.0).alias(c) for c in "abc"))


@query()
def possession_frames(spark, sf_dir):
    p = players(spark, sf_dir).withColumn("edge", F.abs(F.col("x_ft") - 30) / 10)
    near = p.where("edge <= 0.35").groupBy("video_id", "frame_index").agg(F.sort_array(F.collect_list(F.struct("track_id", "edge"))).alias("candidates"))
    frames = p.select("video_id", "frame_index").distinct().join(near, ["video_id", "frame_index"], "left").withColumn("video_id", F.concat("video_id", F.floor(F.col("frame_index") / 500).cast("string")))
    return K.possession(frames).groupBy("possessor_track_id").agg(F.count("*").alias("frames"))


def _one_row_per_frame(df: DataFrame, holder, **columns) -> DataFrame:
    """Every frame once, with ``columns`` of the player whose track is ``holder``, null without one."""
    return df.groupBy("video_id", "frame_index").agg(*(F.max(F.when(F.col("track_id") == holder, c)).alias(n) for n, c in columns.items()))


@query()
def shot_outcomes(spark, sf_dir):
    p = _one_row_per_frame(players(spark, sf_dir), F.floor(F.col("frame_index") / 97) % 10, team=F.col("team")).withColumn("k", F.col("frame_index") % 97)
    rows = p.select(F.concat("video_id", F.floor(F.col("frame_index") / 500).cast("string")).alias("video_id"), "frame_index", F.col("k").between(10, 13).alias("at_rim"), ((F.col("k") == 12) | ((F.col("k") == 13) & (F.col("frame_index") % 2 == 0))).alias("in_basket"), (F.col("k") == 8).alias("action"), "team", F.lit("left").alias("side"))
    return K.shots(rows).groupBy("made").agg(F.count("*").alias("n"))


@query()
def overlap_suppression(spark, sf_dir):
    p = boxes(players(spark, sf_dir)).withColumn("det_idx", F.col("track_id").cast("int")).withColumn("confidence", (F.col("track_id") * 37 % 100) / 100)
    return K.suppress_overlaps(p.select("video_id", "frame_index", "det_idx", "confidence", "x1", "y1", "x2", "y2"), 0.35).select("frame_index", "det_idx")


def _all_hand_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All players' wrists of each frame, in videos of 500 frames, and a ball: every 12 frames it
    leaves another player's hand, by turns upward and into the next player's hand."""
    p = players(spark, sf_dir).withColumn("wrist", F.struct((F.col("x_ft") * 10).alias("x"), (F.col("y_ft") * 10).alias("y")))
    turn, k = F.floor(F.col("frame_index") / 12), F.col("frame_index") % 12
    of = lambda track: F.max(F.when(F.col("track_id") == track % 10, F.col("wrist")))
    wrists = F.transform(F.sort_array(F.collect_list(F.struct("track_id", "wrist"))), lambda w: w["wrist"])
    frames = p.groupBy("video_id", "frame_index").agg(wrists.alias("wrists"), of(turn).alias("a"), of(turn + 1).alias("b"))
    a, b, s = F.col("a"), F.col("b"), F.greatest(k - 6, F.lit(0))
    up = F.struct((a["x"] + 10).alias("x"), (a["y"] - s * 30).alias("y"))
    over = F.struct((a["x"] + (b["x"] - a["x"]) * (s / 4)).alias("x"), (a["y"] + (b["y"] - a["y"]) * (s / 4)).alias("y"))
    ball = F.when((k != 11) & a.isNotNull() & b.isNotNull(), F.when(turn % 2 == 0, up).otherwise(over))
    video = F.concat("video_id", F.floor(F.col("frame_index") / 500).cast("string"))
    return frames.select(video.alias("video_id"), "frame_index", "wrists", ball.alias("ball"))


ALL_HANDS_SQL = f"""{WITH}, f as (select *, x_ft*10 wx, y_ft*10 wy, frame_index//12 turn, greatest(frame_index%12-6,0) s from p),
 h as (select frame_index, any_value(turn) turn, any_value(s) s, max(wx) filter (where track_id=turn%10) ax, max(wy) filter (where track_id=turn%10) ay,
  max(wx) filter (where track_id=(turn+1)%10) nx, max(wy) filter (where track_id=(turn+1)%10) ny from f where frame_index%12<>11 group by frame_index),
 b as (select frame_index, case when turn%2=0 then ax+10 else ax+(nx-ax)*(s/4) end bx, case when turn%2=0 then ay-s*30 else ay+(ny-ay)*(s/4) end yy from h where ax is not null and nx is not null),
 d as (select 'v'||cast(frame_index//500 as varchar) video_id, frame_index, any_value(yy) yy, min(sqrt((x_ft*10-bx)*(x_ft*10-bx)+(y_ft*10-yy)*(y_ft*10-yy))) d from p left join b using (frame_index) group by frame_index),
 m as (select *, d>lag(d,1) over w and lag(d,1) over w>lag(d,2) over w and lag(d,2) over w>lag(d,3) over w grew, lag(yy,3) over w-yy up,
  min(d) over (partition by video_id order by frame_index rows between 9 preceding and current row) near, row_number() over w nth from d window w as (partition by video_id order by frame_index))
 select video_id, frame_index, cast(nth as integer) nth, round(least(1.0,0.5*d/45+0.25*up/18),6) confidence from m where grew and d>=45 and up>=18 and near<=70"""


@query(ALL_HANDS_SQL)
def release_candidates_all_hands(spark, sf_dir):
    return M.release_candidates(_all_hand_frames(spark, sf_dir)).select("video_id", "frame_index", "nth", F.round("confidence", 6).alias("confidence"))


@query()
def release_events(spark, sf_dir):
    return M.releases(_all_hand_frames(spark, sf_dir)).select("video_id", "frame_index", F.round("confidence", 6).alias("confidence"))


@query()
def steady_keypoints(spark, sf_dir):
    p = players(spark, sf_dir)
    points = p.select("video_id", F.col("track_id").cast("int").alias("kp_idx"), "frame_index", (F.col("x_ft") * 10).alias("x"), (F.col("y_ft") * 10).alias("y"), ((F.col("frame_index") + F.col("track_id")) % 5 / 5).alias("confidence"))
    return M.steady_keypoints(points).groupBy("kp_idx", "valid").agg(F.count("*").alias("n"))


@query()
def smoothed_positions(spark, sf_dir):
    p = players(spark, sf_dir).withColumn("video_id", F.concat("video_id", F.floor(F.col("frame_index") / 500).cast("string")))
    frames = p.groupBy("video_id", "frame_index").agg(F.sort_array(F.collect_list(F.struct("track_id", "team", "x_ft", "y_ft"))).alias("players"))
    return M.smooth_positions(frames).groupBy("track_id").agg(F.count("*").alias("frames"), F.count_if(F.col("missing") > 0).alias("held"))


@query("""with x as (select d.lang, d.doc_id, d.n_chars, l.quality=1 hit from labels l join documents d using (doc_id)),
 y as (select lang, count(*) filter (where hit) over (partition by lang) n, sum(cast(hit as int)) over w tp, count(*) over w k from x window w as (partition by lang order by n_chars desc, doc_id rows between unbounded preceding and current row)),
 g as (select y.lang, r.range s, max(case when 100*tp >= r.range*n then cast(tp as double)/k end) p from y, range(101) r where n > 0 group by 1, 2)
 select lang, round(avg(coalesce(p,0)),9) ap from g group by lang""")
def average_precision_by_class(spark, sf_dir):
    d = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("hit")).join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    n = d.groupBy("lang").agg(F.count_if("hit").alias("n"))
    ap = Q.average_precision(d.join(n.where("n > 0"), "lang"), ["lang"], "hit", "n", F.desc("n_chars"), "doc_id")
    return ap.select("lang", F.round("ap", 9).alias("ap"))
