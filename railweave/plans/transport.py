"""Queries of the transport operators on the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

import datetime as dt
import functools
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.functions import geo, tags, text
from railweave.functions.calendar import WEEK
from railweave.functions.clock import PERIODS, REST, clock_seconds, clock_text, hour_band, period
from railweave.operators import areas, network, report, streets, timetable
from railweave.operators.near import regions_holding
from railweave.scale import checkpoint_dir, cut
from railweave.sources.streets import read_matrix, write_matrix
from railweave.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

SERVICE_DATE = dt.date(2018, 1, 6)
HOURS = (6, 22)
EDGE = ("from_node", "to_node", "route_id")
LIMIT_S, LIMIT_M = 600.0, 2500.0


def query(sql: str | None = None):
    """Registers a query and its SQL under the function's name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ---- timetable: trips of the events table -------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _event_trips(spark: SparkSession, d: str) -> DataFrame:
    """Stop times of events: a trip is a user's day, a stop an event type, its clock the time of day."""
    e = _events(spark, d)
    clock = F.date_format("ts", "HH:mm:ss")
    trip = F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
    return e.select(trip.alias("trip_id"), F.col("event_type").alias("stop_id"), F.unix_micros("ts").cast("double").alias("stop_sequence"), clock.alias("departure_time"), clock.alias("arrival_time"), F.col("event_id").alias("_ordinal"))


_SEGMENTS = """
    with t as (select user_id || '@' || strftime(ts, '%Y-%m-%d') as trip_id, event_type, epoch_us(ts)::double as s, event_id,
                      extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)) as sec from events),
         n as (select trip_id, event_type as from_node, lead(event_type) over w as to_node, sec, lead(sec) over w as nxt from t
               window w as (partition by trip_id order by s, event_id))
    select trip_id, from_node, to_node, sec::double as departure_seconds,
           case when nxt - sec between 0 and 10800 then (nxt - sec)::double end as travel_time_seconds,
           coalesce(nxt - sec > 10800, false) as implausible_time,
           lpad((floor(sec / 3600)::int % 24)::varchar, 2, '0') || '-' || lpad((floor(sec / 3600)::int % 24 + 1)::varchar, 2, '0') as hour_band,
           case when floor(sec / 3600)::int % 24 in (7, 8) then 'peak_am' when floor(sec / 3600)::int % 24 in (17, 18, 19) then 'peak_pm' else 'rest_of_day' end as period
    from n where to_node is not null"""


@query(_SEGMENTS)
def segment_records(spark, d):
    rows = timetable.labelled(timetable.segments(_event_trips(spark, d)))
    return rows.select("trip_id", "from_node", "to_node", "departure_seconds", "travel_time_seconds", "implausible_time", "hour_band", "period")


@query(f"select count(*) filter (where implausible_time)::bigint as flagged, count(*)::bigint as n from ({_SEGMENTS})")
def implausible_segments(spark, d):
    return timetable.segments(_event_trips(spark, d)).agg(F.count_if("implausible_time").alias("flagged"), F.count("*").alias("n"))


def _calendar(spark, d):
    """A calendar of events: a service is a user; it runs on weekdays of its clicks."""
    e = _events(spark, d).where("event_type = 'click'")
    day = F.lower(F.date_format("ts", "EEEE"))
    flags = [F.max((day == w).cast("int")).cast("string").alias(w) for w in WEEK]
    return e.groupBy(F.col("user_id").cast("string").alias("service_id")).agg(*flags, F.date_format(F.min("ts"), "yyyyMMdd").alias("start_date"), F.date_format(F.max("ts"), "yyyyMMdd").alias("end_date"))


def _exceptions(spark, d):
    """Calendar dates of events: views add a date, errors remove one."""
    e = _events(spark, d).where("event_type in ('view', 'error')")
    return e.select((F.col("user_id") + 20).cast("string").alias("service_id"), F.date_format("ts", "yyyyMMdd").alias("date"), F.when(F.col("event_type") == "view", "1").otherwise("2").alias("exception_type")).distinct()


_DAYNAMES = ", ".join(f"max((lower(dayname(ts)) = '{w}')::int) as {w}" for w in WEEK)
_CAL = f"cal as (select user_id::varchar as service_id, {_DAYNAMES}, min(ts)::date as s, max(ts)::date as e from events where event_type = 'click' group by 1)"
_EXC = "exc as (select distinct (user_id + 20)::varchar as service_id, ts::date as day, case when event_type = 'view' then 1 else 2 end as kind from events where event_type in ('view', 'error'))"
_ON = dt.date(2024, 1, 17)


@query(f"""with {_CAL}, {_EXC}
    select service_id from (select service_id from cal where {WEEK[_ON.weekday()]} = 1 and date '{_ON}' between s and e
                            union select service_id from exc where day = date '{_ON}' and kind = 1)
    where service_id not in (select service_id from exc where day = date '{_ON}' and kind = 2)""")
def active_services(spark, d):
    return timetable.active_services(_calendar(spark, d), _exceptions(spark, d), _ON)


_FLAGS = " + ".join(WEEK)
_XDAYS = ", ".join(f"max((kind = 1 and lower(dayname(day)) = '{w}')::int) as x_{w}" for w in WEEK)


@query(f"""with {_CAL}, {_EXC},
    x as (select service_id, count(*) filter (where kind = 1) as added, count(*) filter (where kind = 2) as removed, {_XDAYS} from exc group by 1),
    b as (select coalesce(cal.service_id, x.service_id) as service_id, coalesce({_FLAGS}, 0) as wsum, coalesce(added, 0) as added, coalesce(removed, 0) as removed,
          {', '.join(f"case when coalesce({_FLAGS}, 0) = 0 and coalesce({' + '.join('x_' + w for w in WEEK)}, 0) > 0 then x_{v} else coalesce({v}, 0) end as f_{v}" for v in WEEK)}
          from cal full join x using (service_id))
    select service_id, nullif(concat_ws('|', {', '.join(f"case when f_{w} = 1 then '{w}' end" for w in WEEK)}), '') as active_days_of_week,
           {' + '.join('f_' + w for w in WEEK[:5])} > 0 as runs_weekday, f_saturday + f_sunday > 0 as runs_weekend,
           greatest(wsum + added - removed, 0)::bigint as days_active,
           case when {' + '.join('f_' + w for w in WEEK[:5])} > 0 and f_saturday + f_sunday > 0 then 'weekday_and_weekend'
                when {' + '.join('f_' + w for w in WEEK[:5])} > 0 then 'weekday' when f_saturday + f_sunday > 0 then 'weekend' end as day_type
    from b""")
def service_days(spark, d):
    return timetable.service_days(_calendar(spark, d), _exceptions(spark, d))


@query(f"""with {_CAL}, {_EXC}
    select strftime(least((select min(s) from cal), (select min(day) from exc)), '%Y-%m-%d') as first_day, strftime(greatest((select max(e) from cal), (select max(day) from exc)), '%Y-%m-%d') as last_day""")
def service_period(spark, d):
    return timetable.service_period(_calendar(spark, d), _exceptions(spark, d)).select(F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"))


def _templates(spark, d):
    """Frequency rows: purchases give a template trip three departures or fewer."""
    e = _events(spark, d).where("event_type = 'purchase'")
    trip = F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))
    hour = F.hour("ts")
    return e.select(trip.alias("trip_id"), F.format_string("%02d:00:00", hour).alias("start_time"), F.format_string("%02d:30:00", hour).alias("end_time"), (F.col("event_id") % 4 * 600).cast("string").alias("headway_secs"))


@query("""
    with t as (select user_id || '@' || strftime(ts, '%Y-%m-%d') as trip_id, event_type as stop_id, ts, event_id,
                      (extract(hour from ts) * 3600 + extract(minute from ts) * 60 + floor(extract(second from ts)))::bigint as sec from events),
         base as (select trip_id, arg_min(sec, epoch_us(ts)) as base from t group by 1),
         f as (select trip_id, extract(hour from ts)::bigint * 3600 as s, extract(hour from ts)::bigint * 3600 + 1800 as e, event_id % 4 * 600 as h
               from (select *, user_id || '@' || strftime(ts, '%Y-%m-%d') as trip_id from events where event_type = 'purchase') where event_id % 4 > 0),
         d as (select distinct trip_id, unnest(generate_series(s, e - 1, h)) as t0 from f),
         x as (select t.trip_id || '@' || lpad((t0 // 3600)::varchar, 2, '0') || ':' || lpad((t0 // 60 % 60)::varchar, 2, '0') || ':' || lpad((t0 % 60)::varchar, 2, '0') as trip_id, stop_id, sec + t0 - base as sec
               from t join d using (trip_id) join base using (trip_id)),
         u as (select * from x union all select trip_id, stop_id, sec from t where trip_id not in (select trip_id from d))
    select trip_id, stop_id, count(*)::bigint as n, min(sec)::double as first_seconds, max(sec)::double as last_seconds from u group by 1, 2""")
def frequency_expansion(spark, d):
    times = _event_trips(spark, d)
    trips = times.select("trip_id").distinct()
    _, moved = timetable.expand_frequencies(trips, times, _templates(spark, d))
    seconds = clock_seconds(F.col("departure_time"))
    return moved.groupBy("trip_id", "stop_id").agg(F.count("*").alias("n"), F.min(seconds).alias("first_seconds"), F.max(seconds).alias("last_seconds"))


# ---- timetable: the schedule table ---------------------------------------------------------------


def _records(spark, d) -> DataFrame:
    """The schedule's rows as segment records; impossible durations are no travel time."""
    s = table(spark, d, "schedule")
    t = F.col("travel_time_seconds")
    return s.withColumn("travel_time_seconds", F.when((t >= 0) & (t <= timetable.LONGEST_SEGMENT), t)).withColumn("departure_seconds", clock_seconds(F.col("departure_time")))


_REC = "rec as (select * replace (case when travel_time_seconds between 0 and 10800 then travel_time_seconds end as travel_time_seconds) from schedule)"
_KEYS = ", ".join(EDGE)
_PERIODS = (*PERIODS, REST)
_DAYS = {"weekday": "runs_weekday", "weekend": "runs_weekend"}


def _cond_sql(days: dict[str, str]) -> dict[str, str]:
    out = {"": "true"} | {f"_{p}": f"period = '{p}'" for p in _PERIODS} | {f"_{t}": c for t, c in days.items()}
    return out | {f"_{p}_{t}": f"period = '{p}' and {c}" for p in _PERIODS for t, c in days.items()}


def _edges_sql(suffixes, medians=(), where: str = "true", days: dict[str, str] | None = None) -> str:
    cond = _cond_sql(days or _DAYS)
    cols = [f"round(avg(travel_time_seconds) filter (where {cond[s]}), 6) as travel_time_seconds_mean{s}" for s in suffixes]
    cols += [f"median(travel_time_seconds) filter (where {cond[s]}) as travel_time_seconds_median{s}" for s in medians]
    cols += [(f"count(distinct trip_id) filter (where {cond[s]})::bigint as trip_count" if s == "" else f"nullif(count(distinct trip_id) filter (where {cond[s]}), 0)::bigint as trip_count{s}") for s in suffixes]
    if "" in suffixes:
        cols += ["min(travel_time_seconds) as travel_time_seconds_min", "max(travel_time_seconds) as travel_time_seconds_max"]
    return f"with {_REC} select {_KEYS}, {', '.join(cols)} from rec where {where} group by {_KEYS}"


def _stop_edges(rows: DataFrame, suffixes, medians=(), **options) -> DataFrame:
    made = timetable.stop_edges(rows, keys=EDGE, hourly=False, **options)
    mean = [F.round(f"travel_time_seconds_mean{s}", 6).alias(f"travel_time_seconds_mean{s}") for s in suffixes]
    more = ["travel_time_seconds_min", "travel_time_seconds_max"] if "" in suffixes else []
    return made.select(*EDGE, *mean, *[f"travel_time_seconds_median{s}" for s in medians], *[f"trip_count{s}" for s in suffixes], *more)


_BY_PERIOD = [f"_{p}" for p in _PERIODS]
_BY_DAY = [f"_{t}" for t in _DAYS]
_BY_BOTH = [f"_{p}_{t}" for p in _PERIODS for t in _DAYS]


@query(_edges_sql([""], [""]))
def edge_overall(spark, d):
    return _stop_edges(_records(spark, d), [""], [""])


@query(_edges_sql(_BY_PERIOD, _BY_PERIOD))
def edge_periods(spark, d):
    return _stop_edges(_records(spark, d), _BY_PERIOD, _BY_PERIOD)


@query(_edges_sql(_BY_DAY))
def edge_daytypes(spark, d):
    return _stop_edges(_records(spark, d), _BY_DAY)


@query(_edges_sql(_BY_BOTH))
def edge_period_daytype(spark, d):
    return _stop_edges(_records(spark, d), _BY_BOTH)


@query(_edges_sql(["", *_BY_PERIOD, *_BY_DAY, *_BY_BOTH], ["", *_BY_PERIOD]))
def edges_full(spark, d):
    return _stop_edges(_records(spark, d), ["", *_BY_PERIOD, *_BY_DAY, *_BY_BOTH], ["", *_BY_PERIOD])


_CLOCK = "(try_cast(split_part(trim(departure_time), ':', 1) as int) * 3600 + try_cast(split_part(trim(departure_time), ':', 2) as int) * 60 + try_cast(split_part(trim(departure_time), ':', 3) as int))"
_HOUR = f"((floor({_CLOCK} / 3600)::int % 24 + 24) % 24)"


@query(_edges_sql([""], [""], f"{_HOUR} >= {HOURS[0]} and {_HOUR} < {HOURS[1]}"))
def edges_hour_range(spark, d):
    return _stop_edges(timetable.in_hours(_records(spark, d), HOURS), [""], [""])


@query(_edges_sql(["", *_BY_DAY], [""], f"service_date = date '{SERVICE_DATE}'", {"weekday": "false", "weekend": "true"}))
def edges_service_date(spark, d):
    return _stop_edges(_records(spark, d).where(F.col("service_date") == F.lit(SERVICE_DATE)), ["", *_BY_DAY], [""], date=SERVICE_DATE)


@query(f"""with {_REC}, b as (select {_KEYS}, hour_band, avg(travel_time_seconds) as m, count(distinct trip_id) as n from rec where hour_band is not null group by {_KEYS}, hour_band)
    select {_KEYS}, string_agg(hour_band || ':' || round_even(m, 0)::bigint, '|' order by hour_band) filter (where m is not null) as hourly_travel_times,
           string_agg(hour_band || ':' || n, '|' order by hour_band) as hourly_trip_counts from b group by {_KEYS}""")
def edge_hourly_packed(spark, d):
    return timetable.hourly_packs(_records(spark, d), EDGE)


@query(f"""with d as (select distinct {_KEYS}, unnest(string_split(active_days_of_week, '|')) as day from schedule where active_days_of_week is not null),
         o as (select {_KEYS}, day, list_position({list(WEEK)}, day) as k from d)
    select {_KEYS}, s as days_of_week_summary from (select distinct {_KEYS} from schedule) e left join (select {_KEYS}, string_agg(day, '|' order by k) as s from o where k is not null group by {_KEYS}) g
    on e.from_node is not distinct from g.from_node and e.to_node is not distinct from g.to_node and e.route_id is not distinct from g.route_id""".replace(f"select {_KEYS}, s as", "select e.from_node, e.to_node, e.route_id, s as"))
def edge_days_summary(spark, d):
    return timetable.stop_edges(_records(spark, d), keys=EDGE, hourly=False).select(*EDGE, "days_of_week_summary")


@query(f"""with {_REC} select edge_id, trip_id, route_id, trip_headsign, from_node, to_node, departure_time, arrival_time, travel_time_seconds, hour_band, period, service_id, active_days_of_week, runs_weekday, runs_weekend, day_type from rec""")
def schedule(spark, d):
    return timetable.schedule_table(_records(spark, d))


@query("""select edge_id, count(*)::bigint as n from schedule where edge_id not in (select edge_id from transit_edges) group by 1""")
def schedule_without_edge(spark, d):
    """The contract that each row of the schedule has its edge."""
    return table(spark, d, "schedule").join(table(spark, d, "transit_edges").select("edge_id"), "edge_id", "left_anti").where("edge_id is not null").groupBy("edge_id").agg(F.count("*").alias("n"))


@query("select edge_id, dataset || '_' || coalesce(route_id, '') || '_' || from_node || '_' || to_node as made_id from transit_edges")
def edge_ids(spark, d):
    return table(spark, d, "transit_edges").select("edge_id", timetable.edge_id(F.col("dataset"), F.col("route_id"), F.col("from_node"), F.col("to_node")).alias("made_id"))


@query(f"""with s as (select sched_row, {_CLOCK} as sec from schedule where regexp_full_match(trim(departure_time), '-?\\d+:\\d+:\\d+'))
    select s.sched_row, sec::double as seconds, case when sec >= 0 then lpad((sec // 3600)::varchar, greatest(2, length((sec // 3600)::varchar))::int, '0') || ':' || lpad((sec // 60 % 60)::varchar, 2, '0') || ':' || lpad((sec % 60)::varchar, 2, '0') end as clock,
           lpad((((floor(sec / 3600)::int) % 24 + 24) % 24)::varchar, 2, '0') || '-' || lpad(((((floor(sec / 3600)::int) % 24 + 24) % 24) + 1)::varchar, 2, '0') as band from s""")
def clock_roundtrip(spark, d):
    s = table(spark, d, "schedule").select("sched_row", clock_seconds(F.col("departure_time")).alias("seconds")).where("seconds is not null")
    return s.select("sched_row", "seconds", clock_text(F.col("seconds")).alias("clock"), hour_band(F.col("seconds")).alias("band"))


@query(f"""with s as (select sched_row, {_HOUR} as h from schedule where {_CLOCK} is not null)
    select sched_row, case when h >= 7 and h < 9 then 'peak_am' when h >= 17 and h < 20 then 'peak_pm' else 'rest_of_day' end as period from s""")
def period_labels(spark, d):
    s = table(spark, d, "schedule").select("sched_row", clock_seconds(F.col("departure_time")).alias("s")).where("s is not null")
    return s.select("sched_row", period(F.col("s")).alias("period"))


@query("select from_node as node_id from transit_edges union select to_node from transit_edges")
def endpoint_union(spark, d):
    t = table(spark, d, "transit_edges")
    return t.select(F.col("from_node").alias("node_id")).union(t.select("to_node")).distinct()


@query("select edge_id, max(sched_row)::bigint as last_row, min(sched_row)::bigint as first_row from schedule where edge_id is not null group by 1")
def dedupe_first(spark, d):
    s = table(spark, d, "schedule").where("edge_id is not null").select("edge_id", "sched_row")
    first = timetable.first_by(s.withColumn("_ordinal", F.col("sched_row")), "edge_id").select("edge_id", F.col("sched_row").alias("first_row"))
    last = timetable.first_by(s.withColumn("_ordinal", -F.col("sched_row")), "edge_id").select("edge_id", F.col("sched_row").alias("last_row"))
    return first.join(last, "edge_id")


# ---- geometry ------------------------------------------------------------------------------------


def _nodes(spark, d) -> DataFrame:
    """Each node once, with its place."""
    n = table(spark, d, "nodes")
    placed = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    return n.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min(F.when(placed, F.struct("x", "y"))).alias("p"), F.max("in_area").alias("in_area"), F.min("layer").alias("layer")).select("node_id", "p.x", "p.y", "in_area", "layer")


_NODES = "nd as (select node_id, p.x as x, p.y as y, in_area, layer from (select node_id, min(case when not isnan(x) and not isnan(y) then {'x': x, 'y': y} end) as p, bool_or(in_area) as in_area, min(layer) as layer from nodes where node_id is not null group by 1))"
BOX = (-20000.0, 4040000.0, 150000.0, 4210000.0)


def _lines(spark, d) -> DataFrame:
    n = _nodes(spark, d)
    end = lambda k: n.select(F.col("node_id").alias(f"{k}_node"), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
    return table(spark, d, "edges").join(end("from"), "from_node").join(end("to"), "to_node").where("from_x is not null and to_x is not null")


_LINES = f"{_NODES}, ln as (select e.*, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from edges e join nd a on e.from_node = a.node_id join nd b on e.to_node = b.node_id where a.x is not null and b.x is not null)"


def _meets(x1: str, y1: str, x2: str, y2: str, area) -> str:
    """Whether a line meets a box, in SQL."""
    a, b, c, e = area
    lo = lambda p, q, u, v: f"case when {q} <> {p} then least(({u} - {p}) / ({q} - {p}), ({v} - {p}) / ({q} - {p})) when {p} between {u} and {v} then -1e300 else 1e300 end"
    hi = lambda p, q, u, v: f"case when {q} <> {p} then greatest(({u} - {p}) / ({q} - {p}), ({v} - {p}) / ({q} - {p})) when {p} between {u} and {v} then 1e300 else -1e300 end"
    return f"greatest(0, {lo(x1, x2, a, c)}, {lo(y1, y2, b, e)}) <= least(1, {hi(x1, x2, a, c)}, {hi(y1, y2, b, e)})"


@query(f"with {_LINES} select edge_row from ln where {_meets('x1', 'y1', 'x2', 'y2', BOX)}")
def clip_segments(spark, d):
    """Edges whose straight line meets a box; the test is made once per distinct line."""
    rows = _lines(spark, d).withColumnsRenamed({"from_x": "from_stop_lon", "from_y": "from_stop_lat", "to_x": "to_stop_lon", "to_y": "to_stop_lat"})
    return timetable.clip_records(rows, geo.box(*BOX)).select("edge_row")


_RAY = """seg as (select part_no, unnest(list_transform(range(1, len(ring)), lambda i: {'a': ring[i].x, 'b': ring[i].y, 'c': ring[i + 1].x, 'd': ring[i + 1].y})) as s from area_parts)"""


@query(f"""with {_NODES}, {_RAY}
    select node_id, part_no from nd, seg where x is not null and (s.b > y) <> (s.d > y) and x < (s.c - s.a) * (y - s.b) / (s.d - s.b) + s.a group by 1, 2 having count(*) % 2 = 1""")
def nodes_in_parts(spark, d):
    """The part of the study area that holds each node."""
    held = regions_holding(_nodes(spark, d), "node_id", "x", "y", table(spark, d, "area_parts"), "part_no", "ring")
    return held.select(F.col("id").alias("node_id"), F.col("region").alias("part_no"))


@query(f"with {_NODES} select node_id, x between {BOX[0]} and {BOX[2]} and y between {BOX[1]} and {BOX[3]} as in_area from nd where x is not null and node_id in (select from_node from edges union select to_node from edges)")
def stops_in_area(spark, d):
    """The nodes that edges use, with whether they lie in a box."""
    stops = _nodes(spark, d).select(F.col("node_id").alias("stop_id"), F.col("x").cast("string").alias("stop_lon"), F.col("y").cast("string").alias("stop_lat"), F.col("node_id").alias("_ordinal"))
    return timetable.used_stops(stops, table(spark, d, "edges"), geo.box(*BOX)).select("node_id", "in_area")


# ---- network ---------------------------------------------------------------------------------------


def _network(spark, d, only_inside: bool = False) -> network.Network:
    nodes = _nodes(spark, d).withColumn("_ordinal", F.col("node_id"))
    if only_inside:
        nodes = nodes.where("in_area")
    ends = _lines(spark, d).withColumn("_ordinal", F.col("edge_row"))
    return network.build_matrix(nodes, ends, ("tts", "length"), meta={"default_weight": "tts"})


_MATRIX = "mx as (select from_node as src, to_node as dst, min(coalesce(tts, 'infinity'::double)) as tts, min(coalesce(length, 'infinity'::double)) as length from ln where from_node <> to_node group by 1, 2)"


@query(f"with {_LINES}, {_MATRIX} select * from mx")
def matrix_edges(spark, d):
    return network.matrix_edges(_network(spark, d))


@query(f"""with {_LINES}, {_MATRIX}, r as (select node_id, row_number() over (order by node_id) - 1 as row from nd),
    c as (select row, count(src) as size from r left join mx on r.node_id = mx.src group by 1)
    select row::bigint as row, coalesce(sum(size) over (order by row rows between unbounded preceding and 1 preceding), 0)::bigint as start, size::bigint as size from c""")
def matrix_indptr(spark, d):
    return network.row_offsets(_network(spark, d))


@query(f"""with {_LINES}, k as (select node_id from nd where in_area),
    m as (select node_id, min(side) as side, arg_min(o, side) as o from (select from_node as node_id, 0 as side, min(edge_row) as o from ln group by 1 union all select to_node, 1, min(edge_row) from ln group by 1) where node_id not in (select node_id from k) group by 1)
    select node_id, ((select count(*) from k) + row_number() over (order by side, o) - 1)::bigint as row from m""")
def matrix_missing_nodes(spark, d):
    """Rows of the ends that the node table (the nodes in the area) lacks."""
    made = _network(spark, d, only_inside=True)
    known = _nodes(spark, d).where("in_area").select("node_id")
    return made.nodes.join(known, "node_id", "left_anti").select("node_id", "row")


def _query_set(spark, d, name: str = "origin") -> DataFrame:
    """The query set of the searches: all nodes divisible by 100 that edges start from."""
    return _lines(spark, d).where(F.col("from_node") % 100 == 0).select(F.col("from_node").alias(name)).distinct()


_FROM = "o as (select distinct from_node as origin from ln where from_node % 100 = 0)"


def _costs_sql(merged: bool, weight: str, limit: float) -> str:
    start = "select origin as node, origin, 0.0::double as cost from o"
    key = "node" if merged else "origin, node"
    join = "recurring.co r on r.node = e.dst" if merged else "recurring.co r on r.origin = f.origin and r.node = e.dst"
    pick = "e.dst, min(f.origin), " if merged else "e.dst, f.origin, "
    group = "e.dst" if merged else "e.dst, f.origin"
    return f"""co(node, origin, cost) using key ({key}) as ({'select origin as node, origin, 0.0::double as cost from o' if not merged else start}
        union select {pick}min(f.cost + e.{weight}) from co f join mx e on e.src = f.node left join {join}
        where f.cost + e.{weight} <= {limit} group by {group} having min(f.cost + e.{weight}) < coalesce(min(r.cost), 1e300))"""


_COSTS = f"with recursive {_LINES}, {_MATRIX}, {_FROM}, {_costs_sql(False, 'tts', LIMIT_S)}"


def _costs(spark, d, kernel_edges: int = network.KERNEL_EDGES) -> DataFrame:
    return network.travel_costs(network.matrix_edges(_network(spark, d)), _query_set(spark, d), "tts", LIMIT_S, kernel_edges=kernel_edges)


@query(f"{_COSTS} select origin, node, round(cost, 6) as cost from co")
def costs_limited(spark, d):
    """Costs from the query set, searched in the tasks: the network is stated to fit them."""
    return _costs(spark, d).select("origin", "node", F.round("cost", 6).alias("cost"))


@query(f"{_COSTS} select origin, node, round(cost, 6) as cost from co")
def costs_relaxed(spark, d):
    """The same by relaxation, for networks of any size."""
    return _costs(spark, d, 0).select("origin", "node", F.round("cost", 6).alias("cost"))


@query(f"with recursive {_LINES}, {_MATRIX}, {_FROM}, {_costs_sql(True, 'length', LIMIT_M)} select node, round(cost, 6) as cost from co")
def costs_merged_origins(spark, d):
    found = network.travel_costs(network.matrix_edges(_network(spark, d)), _query_set(spark, d), "length", LIMIT_M, merged=True)
    return found.select("node", F.round("cost", 6).alias("cost"))


@query(f"""{_COSTS}, e as (select origin as destination from o union select dst from mx where src in (select origin from o))
    select co.origin, co.node as destination, round(co.cost / 60, 6) as time_min from co join e on co.node = e.destination""")
def shortest_pairs(spark, d):
    """Paths from the query set to the query set and to its neighbours."""
    made = _network(spark, d)
    start = cut(_query_set(spark, d))
    near = network.matrix_edges(made).join(start.withColumnRenamed("origin", "src"), "src", "left_semi").select(F.col("dst").alias("node_id"))
    ends = start.select(F.col("origin").alias("node_id")).union(near).distinct()
    at = made.nodes.select("row", "node_id")
    origins = at.join(start, F.col("node_id") == F.col("origin")).select(F.col("row").alias("origin_pos"), "origin")
    destinations = at.join(ends, "node_id").select(F.col("row").alias("destination_pos"), F.col("node_id").alias("destination"))
    found = network.shortest_paths(made, origins, destinations, LIMIT_S / 60, "tts", kernel_edges=network.KERNEL_EDGES)
    return found.select("origin", "destination", F.round("time_min", 6).alias("time_min"))


@query(f"{_COSTS} select origin, c as cutoff, count(*)::bigint as n_nodes from co, (select unnest([2.0::double, 5.0, 10.0]) as c) where cost <= c * 60 group by 1, 2")
def reach_counts(spark, d):
    return network.reach(_costs(spark, d), network.cutoffs_of([10.0, 2.0, 5.0], "tts"))


@query(f"""{_COSTS}
    select origin, src, dst, round(case when tts > 0 then least(({LIMIT_S} - cost) / tts, 1.0) else 1.0 end, 6) as fraction from co join mx on co.node = mx.src where isfinite(tts) and (tts = 0 or {LIMIT_S} - cost > 0)""")
def reach_segments(spark, d):
    made = _network(spark, d)
    edges = network.matrix_edges(made)
    costs = network.travel_costs(edges, _query_set(spark, d), "tts", LIMIT_S, kernel_edges=network.KERNEL_EDGES)
    return network.reach_segments(costs, edges, made.nodes, "tts", LIMIT_S).select("origin", "src", "dst", F.round("fraction", 6).alias("fraction"))


@query(f"""with {_NODES}, p as (select * from nd where layer = 'walking' and x is not null), q as (select * from nd where layer = 'driving' and x is not null)
    select p.node_id as point_id, arg_min(q.node_id, {{'d': sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 'i': q.node_id}}) as node_id, round(min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)), 6) as distance
    from p, q where abs(p.x - q.x) <= 250 and abs(p.y - q.y) <= 250 and sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 250 group by 1""")
def snap_nearest(spark, d):
    """The nearest driving node of each walking node within 250 m."""
    n = _nodes(spark, d)
    points = n.where("layer = 'walking' and x is not null").select(F.col("node_id").alias("point_id"), "x", "y")
    return network.snap(points, n.where("layer = 'driving'"), 250.0, strict=False).select("point_id", "node_id", F.round("distance", 6).alias("distance"))


@query(f"""with recursive {_LINES}, nb as (select from_node as u, to_node as v from ln union select to_node, from_node from ln),
    lb(node, component) using key (node) as (select u, u from nb union select nb.v, min(lb.component) from lb join nb on nb.u = lb.node left join recurring.lb r on r.node = nb.v group by nb.v having min(lb.component) < min(r.component))
    select node, component from lb""")
def network_components(spark, d):
    """Weakly connected components of the street edges."""
    e = _lines(spark, d).select(F.col("from_node").alias("src"), F.col("to_node").alias("dst"))
    return network.components(e)


# ---- streets ---------------------------------------------------------------------------------------


def _shapes(spark, d) -> DataFrame:
    """Street lines of three vertices: the ends and a bend beside the middle."""
    e = _lines(spark, d)
    bend = F.struct(((F.col("from_x") + F.col("to_x")) / 2 + 7.0002).alias("x"), ((F.col("from_y") + F.col("to_y")) / 2 + 0.0002).alias("y"))
    line = F.array(F.struct(F.col("from_x").alias("x"), F.col("from_y").alias("y")), bend, F.struct(F.col("to_x").alias("x"), F.col("to_y").alias("y")))
    return e.select(F.col("edge_row").alias("edge"), "length", line.alias("geometry"))


_VERTICES = f"""{_LINES}, v as (select edge_row as edge, unnest([0, 1, 2]) as pos, round_even(unnest([x1, (x1 + x2) / 2 + 7.0002, x2]), 3) as kx, round_even(unnest([y1, (y1 + y2) / 2 + 0.0002, y2]), 3) as ky from ln),
    s as (select *, lag(kx) over w as bx, lag(ky) over w as by_, lead(kx) over w as ax, lead(ky) over w as ay, first_value(kx) over w as fx, first_value(ky) over w as fy,
                 last_value(kx) over (partition by edge order by pos rows between unbounded preceding and unbounded following) as lx, last_value(ky) over (partition by edge order by pos rows between unbounded preceding and unbounded following) as ly
          from v window w as (partition by edge order by pos)),
    t as (select kx, ky, count(*)::bigint as vertex_occurrences, sum(((kx = fx and ky = fy) or (kx = lx and ky = ly))::int)::bigint as endpoint_occurrences,
                 sum((bx is not null and (bx <> kx or by_ <> ky))::int + (ax is not null and (ax <> kx or ay <> ky))::int)::bigint as incident_segments, count(distinct edge)::bigint as incident_features from s group by 1, 2),
    topo as (select *, case when incident_segments = 0 then 'isolated_vertex' when incident_segments = 1 then 'endpoint' when incident_segments = 2 and endpoint_occurrences > 0 then 'through_endpoint' when incident_segments = 2 then 'linear_vertex' else 'intersection' end as node_role from t)"""


@query(f"with {_VERTICES} select * from topo")
def node_topology(spark, d):
    return streets.topology_nodes(_shapes(spark, d)).drop("x", "y")


@query(f"with {_VERTICES} select node_role, count(*)::bigint as n from topo group by 1")
def node_roles(spark, d):
    return streets.role_counts(streets.topology_nodes(_shapes(spark, d)))


def _made(x: str, y: str) -> str:
    """The name of a node that is made from its place, in SQL."""
    part = lambda c: f"round_even(round_even({c}, 3) * 1000, 0)::bigint"
    return f"'street_topology_node_' || {part(x)} || '_' || {part(y)}"


@query(f"""with {_LINES}, h as (select edge_row, length, (x1 + x2) / 2 + 7.0002 as mx, (y1 + y2) / 2 + 0.0002 as my, x1, y1, x2, y2 from ln),
    q as (select *, sqrt((mx - x1) ** 2 + (my - y1) ** 2) as a, sqrt((x2 - mx) ** 2 + (y2 - my) ** 2) as b from h)
    select edge_row as edge, 1::bigint as part, {_made('x1', 'y1')} as from_node, {_made('mx', 'my')} as to_node, round(length * a / (a + b), 6) as length from q
    union all select edge_row, 2, {_made('mx', 'my')}, {_made('x2', 'y2')}, round(length * b / (a + b), 6) from q""")
def split_edges(spark, d):
    """Lines cut at every vertex that is a node, with their share of the length."""
    shapes = cut(_shapes(spark, d))
    nodes = streets.name_nodes(streets.topology_nodes(shapes), "street")
    return streets.split_edges(shapes, nodes).select("edge", "part", "from_node", "to_node", F.round("length", 6).alias("length"))


_PARTS = "list_filter(list_transform(string_split(coalesce(hwy_raw, ''), ';'), lambda t: trim(t, ' ')), lambda t: t <> '')"
_CLASS = f"case when list_has_any({_PARTS}, {list(tags.WALKABLE)}) then 'footway' when len({_PARTS}) > 0 then {_PARTS}[1] end"
_FREE = "case " + " ".join(f"when rc = '{k}' then {v}.0::double" for k, v in tags.FREE_FLOW.items()) + f" else {tags.FALLBACK_SPEED}.0::double end"
_TAG = {0: "traffic_signals", 1: "stop", 2: "crossing", 3: None}


def _arrivals(spark, d) -> DataFrame:
    """Edges with a made tag and role of their arrival node."""
    kind = F.col("to_node") % 4
    e = table(spark, d, "edges")
    return e.withColumn("tag", F.when(kind == 0, "traffic_signals").when(kind == 1, "stop").when(kind == 2, "crossing")).withColumn("role", F.when(F.col("to_node") % 3 == 0, "intersection").otherwise("linear_vertex"))


def _time_sql(mode: str) -> str:
    lost = "case " + " ".join(f"when to_node % 4 = {k} then {tags.PENALTIES[mode][t]}" for k, t in _TAG.items() if t in tags.PENALTIES[mode]) + f" when to_node % 3 = 0 then {tags.CROSSROADS[mode]} else 0 end" if tags.PENALTIES[mode] else "0"
    speed = f"coalesce(case when maxspeed > 0 and not isnan(maxspeed) then maxspeed end, {_FREE})" if mode == "driving" else f"{tags.MODE_SPEED[mode]}::double"
    return f"with c as (select *, {_CLASS} as rc from edges) select edge_row, round(length / ({speed} / 3.6) + {lost}, 6) as tts from c"


def _time(mode: str):
    def run(spark, d):
        t = tags.travel_seconds(mode, F.col("length"), F.col("hwy_raw"), F.col("maxspeed"), F.col("tag"), F.col("role"))
        return _arrivals(spark, d).select("edge_row", F.round(t, 6).alias("tts"))

    return run


for _mode in ("driving", "bike", "walking"):
    QUERIES[f"travel_time_{_mode}"], SQL[f"travel_time_{_mode}"] = _time(_mode), _time_sql(_mode)


@query(f"select edge_row, {_CLASS} as road_class from edges")
def road_classes(spark, d):
    return table(spark, d, "edges").select("edge_row", tags.road_class(F.coalesce("hwy_raw", F.lit(""))).alias("road_class"))


@query("""with p as (select edge_row, unnest(list_filter(list_transform(string_split(spd_raw, ';'), lambda t: trim(t, ' ')), lambda t: regexp_matches(t, '\\d'))) as t from edges where spd_raw is not null)
    select e.edge_row, round(max(regexp_extract(t, '(\\d+(?:\\.\\d+)?)', 1)::double * case when contains(lower(t), 'mph') then 1.60934::double else 1 end), 6) as kmh from edges e left join p using (edge_row) group by 1""")
def speed_texts(spark, d):
    return table(spark, d, "edges").select("edge_row", F.round(tags.speed_kmh(F.col("spd_raw")), 6).alias("kmh"))


_WAY_FILTER = '["highway"]["highway"!~"footway|steps|path"]["lanes"!="2"]'


@query("select edge_row from edges where highway is not null and not regexp_matches(highway, 'footway|steps|path') and coalesce(lanes <> '2', true)")
def tag_filter(spark, d):
    e = table(spark, d, "edges").select("edge_row", F.map_from_arrays(F.array(F.lit("highway"), F.lit("lanes")), F.array("highway", "lanes")).alias("tags"))
    return e.where(tags.tags_match(F.col("tags"), tags.parse_filter(_WAY_FILTER))).select("edge_row")


@query("select from_node as id from edges where highway = 'motorway' union select to_node from edges where highway = 'motorway'")
def keep_ways_nodes(spark, d):
    """The nodes that motorways use, from one answer of nodes and ways."""
    e = table(spark, d, "edges")
    ways = e.select(F.lit("way").alias("type"), F.col("edge_row").alias("id"), F.array("from_node", "to_node").alias("nodes"), F.create_map(F.lit("highway"), F.coalesce("highway", F.lit(""))).alias("tags"))
    points = e.select(F.explode(F.array("from_node", "to_node")).alias("id")).distinct().select(F.lit("node").alias("type"), "id", F.lit(None).cast("array<bigint>").alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"))
    _, kept = tags.keep_ways(ways.unionByName(points), tags.parse_filter('["highway"="motorway"]'))
    return kept.select("id")


# ---- names, codes and areas ------------------------------------------------------------------------

_NORMAL = "lower(trim(regexp_replace(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))"


@query(f"select distinct nameunit, {_NORMAL.format('nameunit')} as normal, replace({_NORMAL.format('nameunit')}, ' ', '_') as slug from boundaries")
def name_normalize(spark, d):
    return table(spark, d, "boundaries").select("nameunit", text.normal_name(F.col("nameunit")).alias("normal"), text.slug(F.col("nameunit")).alias("slug")).distinct()


@query(f"""with b as (select distinct {_NORMAL.format('nameunit')} as n from boundaries), q as (select distinct {_NORMAL.format('nameunit')} as n from boundaries where right(natcode, 2) = '00')
    select x.n as a, y.n as b, levenshtein(x.n, y.n)::int as distance, round(1 - levenshtein(x.n, y.n) / greatest(length(x.n), length(y.n)), 6) as similarity from q x, b y where x.n <> y.n""")
def edit_similarity(spark, d):
    """Edit similarity of the query set's names (codes divisible by 100) with all names of the list."""
    listed = table(spark, d, "boundaries").select(text.normal_name(F.col("nameunit")).alias("b"), "natcode")
    asked = listed.where(F.right("natcode", F.lit(2)) == "00").select(F.col("b").alias("a")).distinct()
    pairs = listed.select("b").distinct().join(F.broadcast(asked), F.col("a") != F.col("b"))
    return pairs.select("a", "b", F.levenshtein("a", "b").alias("distance"), F.round(text.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""with c as (select distinct natcode, regexp_replace(natcode, '\\D', '', 'g') as g from boundaries)
    select natcode, case when length(g) >= 8 then coalesce(case when substr(g, 5, 2)::int between 1 and 52 then substr(g, 5, 2)::int end, case when substr(g, 7, 2)::int between 1 and 52 then substr(g, 7, 2)::int end)
           when length(g) = 5 and substr(g, 1, 2)::int between 1 and 52 then substr(g, 1, 2)::int end as province, case when length(g) >= 5 then right(g, 5) end as code from c""")
def province_codes(spark, d):
    c = F.col("natcode")
    return table(spark, d, "boundaries").select("natcode", text.province_of(c).alias("province"), text.municipality_code(c).alias("code")).distinct()


_STEP = """case when t = w or t = p[1] then 1 when list_contains(p, t) then 2 when contains(' ' || w || ' ', ' ' || t || ' ') then 3 when contains(w, t) then 4 end"""


def _municipalities(spark, d) -> DataFrame:
    return table(spark, d, "boundaries").where("natlevname = 'Municipio'")


_PLAIN_SQL = f"""translate(translate(%s, '{text.MARKED}', '{text.PLAIN}'), 'ªº', 'ao')"""
_NAME_SQL = "lower(trim(regexp_replace(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g'), '[^A-Za-z0-9]+', ' ', 'g')))".replace("{0}", _PLAIN_SQL)
_CASCADE = f"""q as (select distinct area_name, {_NAME_SQL % 'area_name'} as t from study_area_boundary where area_name is not null),
    r as (select distinct natcode, {_NAME_SQL % 'nameunit'} as w, list_filter(list_transform(string_split(nameunit, '/'), lambda s: {_NAME_SQL % 's'}), lambda s: s <> {_NAME_SQL % 'nameunit'} and s <> '') as p from boundaries where natlevname = 'Municipio'),
    m as (select area_name, t, natcode, {_STEP} as step from q, r where t <> ''),
    h as (select area_name, step, count(distinct natcode) as n, min(natcode) as c from m where step is not null group by 1, 2),
    g as (select area_name, min(step)::int as step, arg_min(n, step)::bigint as n_codes, arg_min(case when n = 1 then c else '' end, step) as code from h group by 1)"""


@query(f"with {_CASCADE} select * from g")
def match_cascade(spark, d):
    """The cascade's first four steps, for all names."""
    found = areas.match_cascade(table(spark, d, "study_area_boundary"), _municipalities(spark, d), fuzzy=2.0)
    return found.select("area_name", "step", "n_codes", F.coalesce("code", F.lit("")).alias("code"))


@query(f"""with {_CASCADE}, e as (select natcode, unnest(list_prepend(w, p)) as part from r),
    f as (select area_name, natcode, damerau_levenshtein(t, part) as d, greatest(length(t), length(part)) as l from q, e where t <> '' and area_name not in (select area_name from g)),
    s as (select area_name, natcode, 1 - d / l as s from f where d <= greatest(2, round_even(0.3 * l, 0)) and 1 - d / l >= 0.8),
    b as (select *, max(s) over (partition by area_name) as top from s),
    k as (select area_name, 5 as step, count(distinct natcode)::bigint as n_codes, case when count(distinct natcode) = 1 then min(natcode) else '' end as code from b where s > top - 1e-9 group by 1)
    select * from g union all select * from k""")
def match_fuzzy(spark, d):
    """The whole cascade, with swap-aware similarity, for all names."""
    found = areas.match_cascade(table(spark, d, "study_area_boundary"), _municipalities(spark, d))
    return found.select("area_name", "step", "n_codes", F.coalesce("code", F.lit("")).alias("code"))


def _rectangles(spark, d, side: float, modulo: int) -> DataFrame:
    """Rectangles around nodes."""
    n = _nodes(spark, d).where((F.col("node_id") % modulo == 0) & F.col("x").isNotNull())
    corner = lambda i, j: F.struct((F.col("x") + i * side).alias("x"), (F.col("y") + j * side / 2).alias("y"))
    return n.select(F.col("node_id").alias("id"), F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))).alias("rings"))


@query(f"""with {_NODES}, a as (select * from nd where node_id % 100 = 0 and x is not null), b as (select * from nd where x is not null),
    o as (select a.node_id as area_id, b.node_id as region_id, least(a.x + 9000, b.x + 5000) - greatest(a.x, b.x) as w, least(a.y + 4500, b.y + 2500) - greatest(a.y, b.y) as h from a, b)
    select area_id, region_id, round(w * h / (9000 * 4500), 6) as of_area, round(w * h / (5000 * 2500), 6) as of_region from o where w > 0 and h > 0""")
def area_shares(spark, d):
    """Shares that the rectangles of the query set (nodes divisible by 100) have in those of all nodes, and the reverse."""
    found = areas.overlaps(_rectangles(spark, d, 9000.0, 100), _rectangles(spark, d, 5000.0, 1), 10000.0)
    return found.select("area_id", "region_id", F.round(F.col("shared") / F.col("area_size"), 6).alias("of_area"), F.round(F.col("shared") / F.col("region_size"), 6).alias("of_region"))


# ---- reports ---------------------------------------------------------------------------------------


@query("""select dataset_id, count(distinct file_id)::bigint as n_files, count(distinct case when status in ('failed', 'failed_processing') then file_id end)::bigint as n_failed,
    count(distinct case when status in ('failed', 'failed_processing') then file_id end) > 0 and not coalesce(bool_or(status in ('written', 'nothing_in_area', 'skipped_mode', 'no_service_on_date', 'not_requested_type')), false) as unusable from gtfs_report group by 1""")
def report_rollup(spark, d):
    return report.dataset_outcomes(table(spark, d, "gtfs_report"))


@query("select file_id, min(strftime(reported_at, '%Y-%m-%d %H:%M:%S')) as reported from gtfs_report where file_id is not null group by 1")
def report_files(spark, d):
    """One row per file, however many provinces list it."""
    return report.first_of_file(table(spark, d, "gtfs_report")).select("file_id", F.date_format("reported_at", "yyyy-MM-dd HH:mm:ss").alias("reported"))


@query("select distinct file_name, lower(regexp_replace(trim(regexp_replace(regexp_replace(file_name, '^\\d{8}_\\d{6}_', ''), '(?i)\\.zip$', '')), '[^0-9A-Za-z]+', '_', 'g')) as dataset from gtfs_report where file_name is not null")
def dataset_names(spark, d):
    return table(spark, d, "gtfs_report").where("file_name is not null").select("file_name", report.dataset_name(F.col("file_name")).alias("dataset")).distinct()


# ---- a timetable feed made of the transit edges -----------------------------------------------------

FEED_DAY = dt.date(2018, 1, 3)
FEED_BOX = (10.0, 10.0, 90.0, 80.0)


def _feed(spark, d) -> dict[str, DataFrame]:
    """Tables of a feed: four trips a route over the stops of its edges, one of them a template of frequencies."""
    t = table(spark, d, "transit_edges").where("from_node is not null and to_node is not null")
    number = lambda c: F.substring(c, 2, 9).cast("bigint")
    chain = t.select("route_id", F.explode(F.array("from_node", "to_node")).alias("stop_id")).where("route_id is not null").distinct().withColumn("n", number("stop_id"))
    place = lambda k: F.when(F.col("n") % 50 != 49, (F.col("n") * k % 1000 / 10.0).cast("string"))
    stops = t.select(F.explode(F.array("from_node", "to_node")).alias("stop_id")).distinct().withColumn("n", number("stop_id")).select("stop_id", F.concat(F.lit("Stop "), F.col("n")).alias("stop_name"), place(37).alias("stop_lon"), place(91).alias("stop_lat"), F.col("n").alias("_ordinal"))
    routes = t.where("route_id is not null").groupBy("route_id").agg(F.min("route_short_name").alias("route_short_name"), F.min("mode").alias("mode")).select("route_id", "route_short_name", F.concat(F.lit("Line "), F.col("route_id")).alias("route_long_name"), F.when(F.col("mode") == "train", "2").otherwise("3").alias("route_type"))
    trips = routes.select("route_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")).select("route_id", F.concat("route_id", F.lit("#"), "k").alias("trip_id"), F.concat(F.lit("S"), F.col("k") % 2).alias("service_id"), F.concat(F.lit("to "), F.col("k")).alias("trip_headsign"), "k", F.col("k").alias("_ordinal"))
    n, k = F.col("n"), F.col("k")
    seconds = 21600 + k * 5400 + n % 100 * 95 + n * n % 7 * 10 + F.when((k == 3) & (n % 5 == 0), 14400).otherwise(0)
    times = trips.select("route_id", "trip_id", "k").join(chain, "route_id").select("trip_id", "stop_id", n.cast("string").alias("stop_sequence"), clock_text(seconds.cast("double")).alias("departure_time"), clock_text(seconds.cast("double")).alias("arrival_time"), n.alias("_ordinal"))
    calendar = spark.createDataFrame([("S0", *"1111100", "20180101", "20181231"), ("S1", *"0000011", "20180101", "20181231")], ["service_id", *WEEK, "start_date", "end_date"])
    exceptions = spark.createDataFrame([("S1", "20180103", "1"), ("S0", "20180103", "2")], ["service_id", "date", "exception_type"])
    frequencies = trips.where("k = 2").select("trip_id", F.lit("10:00:00").alias("start_time"), F.lit("11:00:00").alias("end_time"), F.lit("1500").alias("headway_secs"))
    return {"stops": stops, "routes": routes, "trips": trips.drop("k"), "stop_times": times, "calendar": calendar, "calendar_dates": exceptions, "frequencies": frequencies}


_CLOCK_OF = "lpad((({0}) // 3600)::varchar, 2, '0') || ':' || lpad((({0}) // 60 % 60)::varchar, 2, '0') || ':' || lpad((({0}) % 60)::varchar, 2, '0')"
_FEED_SQL = f"""te as (select * from transit_edges where from_node is not null and to_node is not null),
    ch as (select distinct route_id, unnest([from_node, to_node]) as stop_id from te where route_id is not null),
    st as (select stop_id, substr(stop_id, 2)::bigint as n, 'Stop ' || substr(stop_id, 2)::bigint as stop_name, case when substr(stop_id, 2)::bigint % 50 <> 49 then substr(stop_id, 2)::bigint * 37 % 1000 / 10.0 end::double as x, case when substr(stop_id, 2)::bigint % 50 <> 49 then substr(stop_id, 2)::bigint * 91 % 1000 / 10.0 end::double as y from (select distinct unnest([from_node, to_node]) as stop_id from te)),
    ro as (select route_id, min(route_short_name) as route_short_name, 'Line ' || route_id as route_long_name, case when min(mode) = 'train' then '2' else '3' end as route_type from te where route_id is not null group by 1),
    s0 as (select ch.route_id, k, ch.stop_id, st.n, 21600 + k * 5400 + n % 100 * 95 + n * n % 7 * 10 + case when k = 3 and n % 5 = 0 then 14400 else 0 end as sec from ch join st using (stop_id), (select unnest([0, 1, 2, 3]) as k)),
    s1 as (select *, first_value(sec) over (partition by route_id, k order by n) as base from s0),
    s2 as (select route_id, k, stop_id, n, sec, route_id || '#' || k as trip_id from s1 where k <> 2
           union all select route_id, k, stop_id, n, sec + t0 - base, route_id || '#2@' || {_CLOCK_OF.format('t0')} from s1, (select unnest([36000, 37500, 39000]) as t0) where k = 2),
    s3 as (select *, lead(stop_id) over w as to_node, lead(sec) over w as nxt from s2 window w as (partition by trip_id order by n)),
    sv as (select 'S0' as service_id, 'monday|tuesday|wednesday|thursday|friday' as active_days_of_week, true as runs_weekday, false as runs_weekend, 4::bigint as days_active, 'weekday' as day_type
           union all select 'S1', 'saturday|sunday', false, true, 3, 'weekend'),
    rec as (select trip_id, s3.stop_id as from_node, s3.to_node, s3.route_id, 'S' || k % 2 as service_id, 'to ' || k as trip_headsign, route_short_name, route_long_name, route_type, active_days_of_week, runs_weekday, runs_weekend, days_active, day_type,
                   sec::double as departure_seconds, {_CLOCK_OF.format('sec')} as departure_time, {_CLOCK_OF.format('nxt')} as arrival_time, case when nxt - sec between 0 and 10800 then (nxt - sec)::double end as travel_time_seconds, nxt - sec > 10800 as implausible_time,
                   lpad((sec // 3600 % 24)::varchar, 2, '0') || '-' || lpad((sec // 3600 % 24 + 1)::varchar, 2, '0') as hour_band,
                   case when sec // 3600 % 24 in (7, 8) then 'peak_am' when sec // 3600 % 24 in (17, 18, 19) then 'peak_pm' else 'rest_of_day' end as period,
                   a.stop_name as from_stop_name, b.stop_name as to_stop_name, a.x as from_stop_lon, a.y as from_stop_lat, b.x as to_stop_lon, b.y as to_stop_lat, 'feed_' || s3.route_id || '_' || s3.stop_id || '_' || s3.to_node as edge_id
            from s3 join ro using (route_id) join sv on sv.service_id = 'S' || k % 2 join st a on a.stop_id = s3.stop_id join st b on b.stop_id = s3.to_node where s3.to_node is not null and a.x is not null and b.x is not null)"""
_RECORD = ["trip_id", "from_node", "to_node", "route_id", "service_id", "trip_headsign", "route_short_name", "route_long_name", "route_type", "active_days_of_week", "runs_weekday", "runs_weekend", "days_active", "day_type", "departure_seconds", "departure_time", "arrival_time", "travel_time_seconds", "implausible_time", "hour_band", "period", "from_stop_name", "to_stop_name", "from_stop_lon", "from_stop_lat", "to_stop_lon", "to_stop_lat", "edge_id"]


@query(f"with {_FEED_SQL} select * from rec")
def feed_records(spark, d):
    """The segments of all trips, frequencies written out, with trip, service days, route and both stops."""
    return timetable.trip_records(_feed(spark, d), dataset="feed").select(*_RECORD)


@query(f"with {_FEED_SQL} select trip_id, from_node, to_node, departure_time, arrival_time, day_type from rec where service_id = 'S1'")
def feed_records_on_date(spark, d):
    """Those of the trips that run on a date on which one service is added and the other removed."""
    return timetable.trip_records(_feed(spark, d), dataset="feed", date=FEED_DAY).select("trip_id", "from_node", "to_node", "departure_time", "arrival_time", "day_type")


@query(f"with {_FEED_SQL} select distinct trip_id, route_id, 'S' || k % 2 as service_id, 'to ' || k as trip_headsign from s2")
def feed_expanded_trips(spark, d):
    """The trips of a feed with each template replaced by its departures."""
    feed = _feed(spark, d)
    trips, _ = timetable.expand_frequencies(feed["trips"], feed["stop_times"], feed["frequencies"])
    return trips.select("trip_id", "route_id", "service_id", "trip_headsign")


_IN_BOX = f"select * from rec where {_meets('from_stop_lon', 'from_stop_lat', 'to_stop_lon', 'to_stop_lat', FEED_BOX)}"
_FEED_KEYS = ", ".join(timetable.EDGE_KEYS)
_FEED_COND = {"": "true"} | {f"_{c}": f"period = '{p}'" for p, c in (("peak_am", "pam"), ("peak_pm", "ppm"), ("rest_of_day", "rod"))}
_DAY_COND = {"wd": "runs_weekday", "we": "runs_weekend"}


def _output_sql() -> str:
    cols = ["edge_id", "from_node", "to_node", "route_id", "any_value(route_short_name) as route_sh", "any_value(route_long_name) as route_ln", "min(travel_time_seconds) as tts_mn", "max(travel_time_seconds) as tts_mx"]
    for s, c in _FEED_COND.items():
        trips = f"count(distinct trip_id) filter (where {c})"
        cols += [f"round(avg(travel_time_seconds) filter (where {c}), 6) as tts_m{s}", f"median(travel_time_seconds) filter (where {c}) as tts_md{s}", f"{trips if not s else f'nullif({trips}, 0)'}::bigint as trips{s}"]
        cols += [f"round(avg(travel_time_seconds) filter (where {c} and {dc}), 6) as {'tm' if s else 'tts_m'}{s}_{n}" for n, dc in _DAY_COND.items()] + [f"nullif(count(distinct trip_id) filter (where {c} and {dc}), 0)::bigint as {'trp' if s else 'trips'}{s}_{n}" for n, dc in _DAY_COND.items()]
    days = "case when bool_or(runs_weekday) and bool_or(runs_weekend) then 'monday|tuesday|wednesday|thursday|friday|saturday|sunday' when bool_or(runs_weekday) then 'monday|tuesday|wednesday|thursday|friday' else 'saturday|sunday' end as days_week"
    bands = "bd as (select edge_id, hour_band, avg(travel_time_seconds) as m, count(distinct trip_id) as c from bx group by 1, 2), pk as (select edge_id, string_agg(hour_band || ':' || round_even(m, 0)::bigint, '|' order by hour_band) filter (where m is not null) as h_tts, string_agg(hour_band || ':' || c, '|' order by hour_band) as h_trips from bd group by 1)"
    return f"with {_FEED_SQL}, bx as ({_IN_BOX}), {bands}, ag as (select {', '.join(cols)}, {days} from bx group by edge_id, from_node, to_node, route_id) select ag.*, h_tts, h_trips from ag join pk using (edge_id)"


def _normal_feed(spark, d) -> dict[str, DataFrame]:
    return timetable.normalize_feed(_feed(spark, d), dataset="feed", area=geo.box(*FEED_BOX))


@query(_output_sql())
def feed_edges(spark, d):
    """The edge layer of a feed clipped to an area, grouped by all twelve keys, under the names of the output."""
    made = timetable.output_edges(_normal_feed(spark, d)["edges"])
    means = [c for c in made.columns if c.startswith("tts_m") and not c.startswith(("tts_md", "tts_mn", "tts_mx")) or c.startswith("tm_")]
    return made.withColumns({c: F.round(c, 6) for c in means})


@query(f"""with {_FEED_SQL}, bx as ({_IN_BOX}) select stop_id as node_id, stop_name, x between {FEED_BOX[0]} and {FEED_BOX[2]} and y between {FEED_BOX[1]} and {FEED_BOX[3]} as in_area, x, y
    from st where x is not null and stop_id in (select from_node from bx union select to_node from bx)""")
def feed_stops(spark, d):
    """The stop layer: the stops that edges use, with those just outside the area."""
    return timetable.output_stops(_normal_feed(spark, d)["nodes"])


@query(f"with {_FEED_SQL}, bx as ({_IN_BOX}) select edge_id, trip_id, from_node, to_node, departure_time, arrival_time, travel_time_seconds, hour_band, service_id, days_active from bx")
def feed_schedule(spark, d):
    return _normal_feed(spark, d)["schedule"].select("edge_id", "trip_id", "from_node", "to_node", "departure_time", "arrival_time", "travel_time_seconds", "hour_band", "service_id", "days_active")


@query(f"""with {_FEED_SQL}, bx as ({_IN_BOX}), e as (select edge_id, from_node as src, to_node as dst, avg(travel_time_seconds) as m, median(travel_time_seconds) as md from bx group by 1, 2, 3)
    select src, dst, round(min(coalesce(m, 'infinity'::double)), 6) as tts_m, min(coalesce(md, 'infinity'::double)) as tts_md from e where src <> dst group by 1, 2""")
def feed_matrix(spark, d):
    """The network matrix of a feed's final layers: of the routes between two stops the least travel times."""
    done = _normal_feed(spark, d)
    made = network.transit_network(done["nodes"], timetable.output_edges(done["edges"]), mode="bus", dataset="feed")
    return network.matrix_edges(made).select("src", "dst", F.round("tts_m", 6).alias("tts_m"), "tts_md")


@query("select dataset, case when 2 * count(*) filter (where mode = 'train') > count(*) then 'train' else 'bus' end as mode from (select distinct dataset, route_id, mode from transit_edges) group by 1")
def feed_modes(spark, d):
    """The mode of each dataset's routes; the datasets are the feeds that one run takes in."""
    t = table(spark, d, "transit_edges")
    routes = t.select("dataset", "route_id", F.when(F.col("mode") == "train", "101").otherwise("3").alias("route_type")).distinct()
    names = [r[0] for r in routes.select("dataset").distinct().collect()]
    made = [timetable.feed_mode(routes.where(F.col("dataset") == n)).select(F.lit(n).alias("dataset"), "mode") for n in names]
    return functools.reduce(DataFrame.unionByName, made)


# ---- street layers and files --------------------------------------------------------------------------


@query(f"""with {_LINES}, v as (select edge_row, unnest([0, 1]) as pos, round_even(unnest([x1, x2]), 3) as kx, round_even(unnest([y1, y2]), 3) as ky, x1 = x2 and y1 = y2 as point from ln),
    o as (select edge_row, round_even(x1, 3) <> round_even(x2, 3) or round_even(y1, 3) <> round_even(y2, 3) as long from ln),
    tp as (select kx, ky, sum(case when o.long then 1 else 0 end) as deg, count(*) as ends from v join o using (edge_row) group by 1, 2),
    rl as (select *, case when deg = 0 then 'isolated_vertex' when deg = 1 then 'endpoint' when deg = 2 then 'through_endpoint' else 'intersection' end as node_role from tp),
    id as (select round_even(x, 3) as kx, round_even(y, 3) as ky, min(node_id::varchar) as node_id from nd where x is not null group by 1, 2),
    nm as (select rl.*, id.node_id from rl join id using (kx, ky)),
    w as (select ln.* replace (case when x1 = x2 and y1 = y2 then 0 else length end as length), {_CLASS} as rc from ln)
    select w.edge_row, w.edge_id, f.node_id as from_node, t.node_id as to_node, t.node_role as to_role, w.rc as highway, round(w.length, 6) as length,
           round(w.length / ({_FREE} / 3.6) + case when t.node_role = 'intersection' then {tags.CROSSROADS['driving']} else 0 end, 6) as tts
    from w join nm f on f.kx = round_even(w.x1, 3) and f.ky = round_even(w.y1, 3) join nm t on t.kx = round_even(w.x2, 3) and t.ky = round_even(w.y2, 3)""")
def street_edge_layer(spark, d):
    """The layers of a street graph: nodes named, tags made flat, road classes and travel times; a row per way."""
    e = _lines(spark, d)
    graph = e.select(F.col("from_node").alias("u"), F.col("to_node").alias("v"), F.col("edge_row").alias("key"), F.array("edge_id").alias("osmid"), F.col("hwy_raw").alias("highway"), F.lit(None).cast("string").alias("maxspeed"), "lanes", F.col("edge_row").cast("string").alias("name"), "oneway", "reversed", "length", F.lit(None).cast("array<struct<x:double,y:double>>").alias("geometry"))
    vertices = _nodes(spark, d).where("x is not null").select("node_id", "x", "y", F.lit(None).cast("string").alias("highway"))
    nodes, edges = streets.street_layers(graph, vertices, "driving")
    roles = nodes.select(F.col("node_id").alias("to_node"), F.col("node_role").alias("to_role"))
    return edges.join(roles, "to_node").select(F.col("name").cast("bigint").alias("edge_row"), "edge_id", "from_node", "to_node", "to_role", "highway", F.round("length", 6).alias("length"), F.round("tts", 6).alias("tts"))


@query(f"with {_LINES}, {_MATRIX} select * from mx")
def matrix_file(spark, d):
    """A matrix written to a file in compressed sparse row form and read again: the same entries."""
    path = Path(checkpoint_dir(spark).removeprefix("file://")) / f"matrix-{uuid.uuid4().hex}.npz"
    made = read_matrix(spark, write_matrix(_network(spark, d), path))
    path.unlink()
    return network.matrix_edges(made)


@query(f"""with {_NODES}, a as (select * from nd where node_id % 100 = 0 and x is not null), b as (select * from nd where x is not null),
    o as (select a.node_id as area_id, b.node_id % 7 as province, least(a.x + 9000, b.x + 5000) - greatest(a.x, b.x) as w, least(a.y + 4500, b.y + 2500) - greatest(a.y, b.y) as h from a, b)
    select area_id, province, round(sum(w * h) / (9000 * 4500), 6) as share from o where w > 0 and h > 0 group by 1, 2 having sum(w * h) / (9000 * 4500) >= 0.05""")
def province_roll_up(spark, d):
    """Shares of areas (the query set) by the province of the regions in them (all nodes' rectangles)."""
    found = areas.overlaps(_rectangles(spark, d, 9000.0, 100), _rectangles(spark, d, 5000.0, 1), 10000.0)
    return areas.province_shares(found, F.col("region_id") % 7).select("area_id", "province", F.round("share", 6).alias("share"))


@query("select edge_row, round(length / (4.5 * 1000 / 60), 9) as minutes from edges")
def plain_minutes(spark, d):
    return table(spark, d, "edges").select("edge_row", F.round(tags.travel_minutes(F.col("length"), 4.5), 9).alias("minutes"))


_BY_NAME = ", ".join(f"({k}, '{n}')" for k, n in sorted({(k, text.plain_name(n)) for k, names in enumerate(text.PROVINCES, 1) for n in names}))


@query(f"""with p(code, name) as (values {_BY_NAME}), q as (select distinct nameunit from boundaries union select unnest(['08', 'Gerona', 'VALÈNCIA', 'las palmas', '53', 'Nowhere', ' 7 ']))
    select nameunit as name, coalesce(case when try_cast(trim(nameunit) as int) between 1 and 52 then try_cast(trim(nameunit) as int) end, p.code)::int as code from q left join p on p.name = {_NORMAL.format('nameunit')}""")
def province_by_name(spark, d):
    """The province code of a code or name, for all names of the list and some of provinces."""
    more = spark.createDataFrame([(n,) for n in ("08", "Gerona", "VALÈNCIA", "las palmas", "53", "Nowhere", " 7 ")], "name string")
    names = table(spark, d, "boundaries").select(F.col("nameunit").alias("name")).unionByName(more).distinct()
    return names.select("name", text.province_named(F.col("name")).alias("code"))


@query("""with s as (select part_no, unnest(list_transform(range(1, len(ring)), lambda i: ring[i].x * ring[i + 1].y - ring[i + 1].x * ring[i].y)) as c from area_parts)
    select 0 as piece, round(abs(sum(a)) / 1e6, 6) as km2 from (select abs(sum(c)) / 2 as a from s group by part_no)""")
def dissolved_area(spark, d):
    """The area of the union of all parts, which don't overlap."""
    shapes = table(spark, d, "area_parts").select(F.lit(0).alias("piece"), F.array(F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))).alias("rings"))
    return areas.dissolved(shapes, "piece").select("piece", F.round(F.col("area") / 1e6, 6).alias("km2"))


@query()
def isochrone_pieces(spark, d):
    """The places within 25 m of what the query set reaches in ten minutes, in pieces that don't overlap; compared with a raster in ``tests``."""
    made = _network(spark, d)
    edges = network.matrix_edges(made)
    costs = network.travel_costs(edges, _query_set(spark, d), "tts", LIMIT_S, kernel_edges=network.KERNEL_EDGES)
    drawn = network.distinct_segments(network.reach_segments(costs, edges, made.nodes, "tts", LIMIT_S))
    return areas.tiled_union(drawn, ["origin"], 25.0, 2000.0)
