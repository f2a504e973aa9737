"""From timetable tables to stop-to-stop segments, edges, schedules and stops.

Inputs are text tables as scanned.  A trip's rows are put in order by its sequence numbers; ties keep the
scan's order, told by a column ``_ordinal`` that the scans of ``railweave.sources`` add.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.functions import geo
from railweave.functions.calendar import WEEK, day_type, feed_date, ordered_days
from railweave.functions.clock import PERIODS, REST, clock_seconds, clock_text, hour_band, period
from railweave.scale import cut

#: The longest believable segment in seconds; just as long is kept.
LONGEST_SEGMENT = 3 * 3600

#: Basic and extended route types that run on rails.
RAIL_BASIC = (0, 1, 2, 5, 7, 12)
RAIL_EXTENDED = ((100, 199), (300, 699), (900, 999), (1400, 1499))

#: The columns that make an edge, in order.
EDGE_KEYS = ("from_node", "to_node", "route_id", "route_short_name", "route_long_name", "route_type", "from_stop_name", "to_stop_name", "from_stop_lon", "from_stop_lat", "to_stop_lon", "to_stop_lat")
SCHEDULE_COLUMNS = ("edge_id", "trip_id", "route_id", "route_short_name", "trip_headsign", "from_node", "to_node", "departure_time", "arrival_time", "travel_time_seconds", "hour_band", "period", "service_id", "days_active", "active_days_of_week", "runs_weekday", "runs_weekend", "day_type")
#: The output layer's columns in order, long and short; ``{p}`` is a period (short: its code), ``{d}`` a day type.
EDGE_OUTPUT = (
    ("edge_id", "edge_id"), ("from_node", "from_node"), ("to_node", "to_node"), ("route_id", "route_id"), ("route_short_name", "route_sh"), ("route_long_name", "route_ln"), ("trip_count", "trips"),
    ("travel_time_seconds_mean", "tts_m"), ("travel_time_seconds_median", "tts_md"), ("travel_time_seconds_min", "tts_mn"), ("travel_time_seconds_max", "tts_mx"),
    ("travel_time_seconds_mean_{p}", "tts_m_{p}"), ("travel_time_seconds_median_{p}", "tts_md_{p}"), ("trip_count_{p}", "trips_{p}"),
    (("travel_time_seconds_mean_{d}", "tts_m_{d}"), ("trip_count_{d}", "trips_{d}")),
    ("days_of_week_summary", "days_week"), ("hourly_travel_times", "h_tts"), ("hourly_trip_counts", "h_trips"), ("geometry", "geometry"),
    (("travel_time_seconds_mean_{p}_{d}", "tm_{p}_{d}"), ("trip_count_{p}_{d}", "trp_{p}_{d}")),
)
#: The day types' codes.
DAY_CODES = {"weekday": "wd", "weekend": "we"}
DAY_TYPES = {"weekday": "runs_weekday", "weekend": "runs_weekend"}


def number(text: Column) -> Column:
    """A text as a double; null if it isn't a number."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def with_ordinal(df: DataFrame) -> DataFrame:
    """``df`` with ``_ordinal``: its scan's, or else the order of a single ordered partition read."""
    return df if "_ordinal" in df.columns else df.withColumn("_ordinal", F.monotonically_increasing_id())


def first_by(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key in scan order.  Null keys are one key."""
    first = Window.partitionBy(key).orderBy("_ordinal")
    return with_ordinal(df).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def is_rail(route_type: Column) -> Column:
    """Whether a route type runs on rails; null and unreadable types don't."""
    kind = number(route_type)
    inside = kind.isin(*map(float, RAIL_BASIC))
    for a, b in RAIL_EXTENDED:
        inside = inside | kind.between(a, b)
    return F.coalesce(inside, F.lit(False))


def feed_mode(routes: DataFrame) -> DataFrame:
    """One row ``mode``: ``train`` if more than half of the routes run on rails, else ``bus`` (also for an empty table)."""
    return routes.agg(F.count("*").alias("n"), F.count_if(is_rail(F.col("route_type"))).alias("rail")).select(F.when(2 * F.col("rail") > F.col("n"), "train").otherwise("bus").alias("mode"))


def segments(stop_times: DataFrame) -> DataFrame:
    """One row per trip and pair of successive stops, with times and the plausibility flag.

    Rows lacking trip, stop or a numeric sequence are dropped first.  Without arrival times the departures
    stand in.  ``travel_time_seconds`` is null if negative, or over three hours (then ``implausible_time``).
    """
    df = with_ordinal(stop_times)
    departure = F.col("departure_time") if "departure_time" in df.columns else F.lit(None).cast("string")
    arrival = F.col("arrival_time") if "arrival_time" in df.columns else departure
    df = df.withColumn("departure_time", departure).withColumn("arrival_time", arrival).withColumn("stop_sequence", number(F.col("stop_sequence")))
    df = df.dropna(subset=["trip_id", "stop_id", "stop_sequence"])
    df = df.withColumn("departure_seconds", clock_seconds(F.col("departure_time"))).withColumn("arrival_seconds", clock_seconds(F.col("arrival_time")))
    order = Window.partitionBy("trip_id").orderBy("stop_sequence", "_ordinal")
    ahead = {"to_node": "stop_id", "next_arrival_seconds": "arrival_seconds", "next_arrival_time": "arrival_time"}
    for name, of in ahead.items():
        df = df.withColumn(name, F.lead(of).over(order))
    df = df.where(F.col("to_node").isNotNull()).withColumnRenamed("stop_id", "from_node")
    took = F.col("next_arrival_seconds") - F.col("departure_seconds")
    return (
        df.withColumn("implausible_time", F.coalesce(took > LONGEST_SEGMENT, F.lit(False)))
        .withColumn("travel_time_seconds", F.when((took >= 0) & (took <= LONGEST_SEGMENT), took))
        .withColumn("arrival_time", F.col("next_arrival_time"))
        .drop("next_arrival_time")
    )


def labelled(rows: DataFrame, band: int = 1, periods: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """``rows`` with ``hour_band`` and ``period`` of the departure."""
    return rows.withColumn("hour_band", hour_band(F.col("departure_seconds"), band)).withColumn("period", period(F.col("departure_seconds"), None if periods is None else dict(periods)))


def in_hours(rows: DataFrame, hours: tuple[int, int] | None) -> DataFrame:
    """The rows that depart at an hour of the day in [from, to); null departures go."""
    if hours is None:
        return rows
    hour = F.pmod(F.floor(F.col("departure_seconds") / 3600), F.lit(24))
    return rows.where((hour >= hours[0]) & (hour < hours[1]))


def _weekly(calendar: DataFrame) -> DataFrame:
    flag = lambda d: F.coalesce(number(F.col(d)), F.lit(0.0)) if d in calendar.columns else F.lit(0.0)
    return first_by(calendar.where(F.col("service_id").isNotNull()), "service_id").select("service_id", *[flag(d).alias(d) for d in WEEK])


def service_days(calendar: DataFrame | None, exceptions: DataFrame | None) -> DataFrame | None:
    """``(service_id, active_days_of_week, runs_weekday, runs_weekend, days_active, day_type)``.

    A service with any weekly flag has its calendar's days; another has those of the dates added to it, or
    else its calendar's.  ``days_active`` = weekly flags + dates added - dates removed, at least 0.
    None if there is neither table.
    """
    if calendar is None and exceptions is None:
        return None
    parts = []
    if calendar is not None:
        weekly = _weekly(calendar)
        days = F.filter(F.array(*[F.when(F.col(d) > 0, F.lit(d)) for d in WEEK]), lambda d: d.isNotNull())
        flagged = lambda of: F.greatest(*[F.col(d) for d in of]) > 0
        weekly = weekly.select("service_id", days.alias("c_days"), flagged(WEEK[:5]).alias("c_weekday"), flagged(WEEK[5:]).alias("c_weekend"), sum((F.col(d) for d in WEEK), F.lit(0.0)).alias("c_sum"))
        parts.append(weekly)
    if exceptions is not None:
        kind, date = number(F.col("exception_type")), feed_date(F.col("date"))
        each = exceptions.where(F.col("service_id").isNotNull()).select("service_id", kind.alias("kind"), F.when(kind == 1, F.date_format(date, "EEEE")).alias("day"))
        name = F.lower(F.col("day"))
        added = each.groupBy("service_id").agg(
            F.filter(F.array(*[F.when(F.max(F.coalesce(name == d, F.lit(False))), F.lit(d)) for d in WEEK]), lambda d: d.isNotNull()).alias("x_days"),
            F.count_if(F.col("kind") == 1).alias("added"),
            F.count_if(F.col("kind") == 2).alias("removed"),
        )
        parts.append(added)
    both = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "service_id", "full_outer")
    empty = F.array().cast("array<string>")
    col = lambda n, default: F.coalesce(F.col(n), default) if n in both.columns else default
    c_days, x_days = col("c_days", empty), col("x_days", empty)
    strong = F.size(c_days) > 0
    days = F.when(~strong & (F.size(x_days) > 0), x_days).otherwise(c_days)
    has = lambda of: F.arrays_overlap(days, F.array(*map(F.lit, of)))
    active = F.greatest(col("c_sum", F.lit(0.0)) + col("added", F.lit(0)) - col("removed", F.lit(0)), F.lit(0.0)).cast("bigint")
    out = both.select("service_id", days.alias("d"), active.alias("days_active"), has(WEEK[:5]).alias("runs_weekday"), has(WEEK[5:]).alias("runs_weekend"))
    return out.select("service_id", ordered_days(F.col("d")).alias("active_days_of_week"), "runs_weekday", "runs_weekend", "days_active", day_type(F.col("runs_weekday"), F.col("runs_weekend")).alias("day_type"))


def active_services(calendar: DataFrame | None, exceptions: DataFrame | None, date: dt.date) -> DataFrame:
    """``(service_id)`` of the services running on ``date``: the calendar's, and those added, less those removed that day."""
    found = None
    day = F.lit(date).cast("date")
    if calendar is not None:
        first = first_by(calendar, "service_id")
        runs = (number(F.col(WEEK[date.weekday()])) == 1) & (feed_date(F.col("start_date")) <= day) & (feed_date(F.col("end_date")) >= day)
        found = first.where(runs & F.col("service_id").isNotNull()).select("service_id")
    if exceptions is not None:
        that = exceptions.where((feed_date(F.col("date")) == day) & F.col("service_id").isNotNull()).select("service_id", number(F.col("exception_type")).alias("kind"))
        added = that.where("kind = 1").select("service_id")
        found = added if found is None else found.union(added)
        found = found.join(that.where("kind = 2").select("service_id"), "service_id", "left_anti")
    if found is None:
        raise ValueError("a feed needs a calendar or calendar dates")
    return found.distinct()


def service_period(calendar: DataFrame | None, exceptions: DataFrame | None) -> DataFrame:
    """One row ``(first_day, last_day)`` of all dates of both tables."""
    dates = []
    if calendar is not None:
        dates += [calendar.select(feed_date(F.col(c)).alias("day")) for c in ("start_date", "end_date") if c in calendar.columns]
    if exceptions is not None:
        dates.append(exceptions.select(feed_date(F.col("date")).alias("day")))
    all_dates = dates[0]
    for more in dates[1:]:
        all_dates = all_dates.union(more)
    return all_dates.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def expand_frequencies(trips: DataFrame, stop_times: DataFrame, frequencies: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``(trips, stop_times)`` where each template trip is replaced by its departures.

    A departure every headway from start until before end, once per trip however many rows give it; the
    new trip is ``trip@HH:MM:SS`` and its times are shifted from the template's first known departure.
    Rows without readable times, a positive headway or a known template are passed over.
    """
    if frequencies is None:
        return trips, stop_times
    stop_times = with_ordinal(stop_times)
    seq = F.struct(number(F.col("stop_sequence")).alias("s"), F.col("_ordinal").alias("o"))
    timed = stop_times.withColumn("_d", clock_seconds(F.col("departure_time")))
    base = timed.where(F.col("_d").isNotNull()).groupBy("trip_id").agg(F.min_by("_d", seq).alias("_base"))
    start, end, head = clock_seconds(F.col("start_time")), clock_seconds(F.col("end_time")), number(F.col("headway_secs"))
    rows = frequencies.select("trip_id", start.alias("s"), end.alias("e"), head.alias("h")).where("h > 0 and e > s")
    count = F.ceil((F.col("e") - F.col("s")) / F.col("h")).cast("int")
    at = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.col("s") + k * F.col("h"))
    departures = rows.join(base, "trip_id").select("trip_id", "_base", F.explode(at).alias("_at")).distinct()
    departures = departures.withColumn("_new", F.concat("trip_id", F.lit("@"), clock_text(F.col("_at"))))
    shift = F.col("_at") - F.col("_base")
    # rows of templates come out once per departure, the others as they are: one join each
    moved = stop_times.join(departures, "trip_id", "left")
    for c in ("arrival_time", "departure_time"):
        if c in stop_times.columns:
            moved = moved.withColumn(c, F.when(F.col("_new").isNull(), F.col(c)).otherwise(clock_text(clock_seconds(F.col(c)) + shift)))
    own = F.coalesce("_new", "trip_id")
    copies = trips.join(departures.select("trip_id", "_new"), "trip_id", "left").withColumn("trip_id", own).select(*trips.columns)
    return copies, moved.withColumn("trip_id", own).select(*stop_times.columns)


def edge_id(dataset: str | Column, route: Column, from_node: Column, to_node: Column) -> Column:
    """``dataset_route_from_to``; a null route is empty."""
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    return F.concat(name, F.lit("_"), F.coalesce(route, F.lit("")), F.lit("_"), from_node, F.lit("_"), to_node)


def _ends(stops: DataFrame, side: str) -> DataFrame:
    located = with_ordinal(stops).withColumn("_x", number(F.col("stop_lon"))).withColumn("_y", number(F.col("stop_lat"))).dropna(subset=["_x", "_y", "stop_id"])
    name = F.col("stop_name") if "stop_name" in stops.columns else F.lit(None).cast("string")
    return first_by(located, "stop_id").select(F.col("stop_id").alias(f"{side}_node"), name.alias(f"{side}_stop_name"), F.col("_x").alias(f"{side}_stop_lon"), F.col("_y").alias(f"{side}_stop_lat"))


def trip_records(
    feed: Mapping[str, DataFrame | None],
    *,
    dataset: str = "ds",
    date: dt.date | None = None,
    hours: tuple[int, int] | None = None,
    band: int = 1,
    periods: Mapping[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """The segments of all trips with their labels, service days, route and the places of both stops.

    ``feed``: tables ``stops, routes, trips, stop_times`` and, where there are any, ``calendar,
    calendar_dates, frequencies``.  With ``date`` only trips that run that day.  Rows whose stops have no
    place are left out; a route listed twice with different names gives a row each.
    """
    trips, times = feed["trips"], with_ordinal(feed["stop_times"])
    calendar, exceptions = feed.get("calendar"), feed.get("calendar_dates")
    if date is not None:
        trips = trips.join(active_services(calendar, exceptions, date), "service_id", "left_semi")
        times = times.join(trips.select("trip_id").distinct(), "trip_id", "left_semi")
    trips, times = expand_frequencies(trips, times, feed.get("frequencies"))
    rows = in_hours(labelled(segments(times), band, periods), hours)
    keep = [c for c in ("trip_id", "route_id", "service_id", "trip_headsign") if c in trips.columns]
    about = first_by(trips.where(F.col("trip_id").isNotNull()), "trip_id").select(*keep)
    days = service_days(calendar, exceptions)
    if days is not None and "service_id" in keep:
        about = about.join(days, "service_id", "left")
    rows = rows.drop("route_id", "service_id", "trip_headsign").join(about, "trip_id", "left")
    routes = feed["routes"].select(*[c for c in ("route_id", "route_short_name", "route_long_name", "route_type") if c in feed["routes"].columns]).distinct()
    rows = rows.join(routes, "route_id", "left")
    for side in ("from", "to"):
        rows = rows.join(_ends(feed["stops"], side), f"{side}_node", "inner")
    return rows.withColumn("edge_id", edge_id(dataset, F.col("route_id"), F.col("from_node"), F.col("to_node")))


def clip_records(rows: DataFrame, area) -> DataFrame:
    """The records whose straight line meets ``area`` (rings); the test is made once per distinct line."""
    if area is None:
        return rows
    ends = ["from_stop_lon", "from_stop_lat", "to_stop_lon", "to_stop_lat"]
    lines = rows.select(*ends).distinct().where(geo.segment_meets(*map(F.col, ends), area))
    return rows.join(lines, ends, "left_semi")


def _where(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


def _medians(rows: DataFrame, keys: Sequence[str], conditions: Mapping[str, Column | None]) -> DataFrame:
    """``(keys..., travel_time_seconds_median...)`` under each condition.

    Equal times are counted before the shuffle, and ranks are running sums of these counts in the order of the
    times: a window that spills, where an exact aggregate would hold all different times of an edge in memory.
    """
    flags = {f"f{i}": F.lit(True) if c is None else c for i, c in enumerate(conditions.values())}
    counted = rows.where(F.col("travel_time_seconds").isNotNull()).groupBy(*keys, F.col("travel_time_seconds").alias("_v"), *[c.alias(n) for n, c in flags.items()]).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys).orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    own = {n: F.when(F.col(n), F.col("_c")).otherwise(0) for n in flags}
    ranked = counted.select(*keys, "_v", *[F.sum(own[n]).over(upto).alias(f"u_{n}") for n in flags], *[F.sum(own[n]).over(whole).alias(f"n_{n}") for n in flags])
    at = lambda n, rank: F.min(F.when((F.col(f"n_{n}") > 0) & (F.col(f"u_{n}") >= rank), F.col("_v")))
    middle = lambda n: (at(n, F.floor((F.col(f"n_{n}") + 1) / 2)) + at(n, F.floor(F.col(f"n_{n}") / 2) + 1)) / 2
    return ranked.groupBy(*keys).agg(*[middle(n).alias(f"travel_time_seconds_median{s}") for n, s in zip(flags, conditions)])


def stop_edges(
    rows: DataFrame,
    *,
    dataset: str = "ds",
    periods: Sequence[str] | None = None,
    date: dt.date | None = None,
    hourly: bool = True,
    keys: Sequence[str] = EDGE_KEYS,
) -> DataFrame:
    """Edges: per key (nulls are a key) the trips and travel times overall, per period, per day type and both.

    Trips are counted once each.  A mean or count over no row is null.  With ``date`` all rows have that
    date's day type.  ``days_of_week_summary`` is the union of the days; ``hourly_travel_times`` and
    ``hourly_trip_counts`` pack ``band:value`` by band.  One pass for times, one for trips, one for bands.
    """
    keys = [k for k in keys if k in rows.columns]
    names = [*(PERIODS if periods is None else periods), *([] if REST in (periods or ()) else [REST])]
    true = F.lit(True)
    if date is not None:
        of_day = {"weekday": true if date.weekday() < 5 else ~true, "weekend": ~true if date.weekday() < 5 else true}
    else:
        of_day = {t: F.coalesce(F.col(c), F.lit(False)) if c in rows.columns else ~true for t, c in DAY_TYPES.items()}
    in_period = {p: F.coalesce(F.col("period") == p, F.lit(False)) for p in names}
    conditions: dict[str, Column | None] = {"": None, **{f"_{p}": c for p, c in in_period.items()}, **{f"_{t}": c for t, c in of_day.items()}}
    conditions |= {f"_{p}_{t}": c & d for p, c in in_period.items() for t, d in of_day.items()}
    value = F.col("travel_time_seconds")
    times = [F.avg(_where(c, value)).alias(f"travel_time_seconds_mean{s}") for s, c in conditions.items()]
    times += [F.min(value).alias("travel_time_seconds_min"), F.max(value).alias("travel_time_seconds_max")]
    if "active_days_of_week" in rows.columns:
        days = F.split(F.coalesce("active_days_of_week", F.lit("")), r"\|")
        seen = F.array_compact(F.array(*[F.when(F.max(F.array_contains(days, d)), F.lit(d)) for d in WEEK]))
        times.append(F.when(F.size(seen) > 0, F.array_join(seen, "|")).alias("days_of_week_summary"))
    else:
        times.append(F.lit(None).cast("string").alias("days_of_week_summary"))
    overall = rows.groupBy(*keys).agg(*times)
    medians = _medians(rows, keys, {s: conditions[s] for s in ["", *(f"_{p}" for p in names)]})
    # distinct trips without expanding the rows once per condition: first each trip, then its flags
    flags = {f"t{i}": c for i, (_, c) in enumerate(conditions.items())}
    per_trip = rows.groupBy(*keys, "trip_id").agg(*[F.max(true if c is None else c).alias(n) for n, c in flags.items()])
    counts = per_trip.where(F.col("trip_id").isNotNull()).groupBy(*keys).agg(*[F.nullif(F.count_if(F.col(n)), F.lit(0)).alias(f"trip_count{s}") for n, s in zip(flags, conditions)])

    def with_(left: DataFrame, right: DataFrame) -> DataFrame:
        other = {k: f"_right_{k}" for k in keys}
        on = [F.col(k).eqNullSafe(F.col(o)) for k, o in other.items()]
        return left.join(right.withColumnsRenamed(other), on, "left").drop(*other.values())

    edges = with_(with_(overall, medians), counts).fillna({"trip_count": 0})
    if hourly:
        edges = with_(edges, hourly_packs(rows, keys))
    else:
        edges = edges.withColumn("hourly_travel_times", F.lit(None).cast("string")).withColumn("hourly_trip_counts", F.lit(None).cast("string"))
    if "route_id" in keys:
        edges = edges.withColumn("edge_id", edge_id(dataset, F.col("route_id"), F.col("from_node"), F.col("to_node")))
    return edges


def hourly_packs(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., hourly_travel_times, hourly_trip_counts)``: ``band:value`` joined by ``|`` in the order of the bands.

    Means are rounded half to even; a band without any travel time is left out of the times only.  An edge
    has at most 24 bands, so what is gathered per edge is bounded.
    """
    bands = rows.where(F.col("hour_band").isNotNull()).groupBy(*keys, "hour_band").agg(F.avg("travel_time_seconds").alias("m"), F.count_distinct("trip_id").alias("n"))
    gathered = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hour_band", "m", "n"))).alias("b"))
    pair = lambda c: lambda x: F.concat(x["hour_band"], F.lit(":"), F.bround(x[c]).cast("bigint").cast("string"))
    known = F.filter("b", lambda x: x["m"].isNotNull())
    joined = lambda items, c: F.array_join(F.transform(items, pair(c)), "|")
    return gathered.select(*keys, F.when(F.size(known) > 0, joined(known, "m")).alias("hourly_travel_times"), joined(F.col("b"), "n").alias("hourly_trip_counts"))


def schedule_table(rows: DataFrame) -> DataFrame:
    """The schedule: one row per trip and segment, with the columns that there are."""
    return rows.select(*[c for c in SCHEDULE_COLUMNS if c in rows.columns])


def used_stops(stops: DataFrame, edges: DataFrame | None, area=None, *, dataset: str = "ds") -> DataFrame:
    """The stops that edges use, with ``in_area``; without edges the stops inside ``area``, all marked so."""
    located = with_ordinal(stops).withColumn("x", number(F.col("stop_lon"))).withColumn("y", number(F.col("stop_lat"))).dropna(subset=["x", "y"])
    located = first_by(located, "stop_id")
    inside = F.lit(True) if area is None else geo.point_inside(F.col("x"), F.col("y"), area)
    if edges is None:
        located = located.where(inside).withColumn("in_area", F.lit(True))
    else:
        ends = edges.select(F.col("from_node").alias("stop_id")).union(edges.select(F.col("to_node"))).distinct()
        located = located.join(ends, "stop_id", "left_semi").withColumn("in_area", inside)
    name = F.col("stop_name") if "stop_name" in stops.columns else F.lit(None).cast("string")
    return located.select(F.col("stop_id").alias("node_id"), name.alias("stop_name"), "in_area", "x", "y", F.lit(dataset).alias("dataset_name"), F.lit("stop").alias("node_type"))


def normalize_feed(feed: Mapping[str, DataFrame | None], *, dataset: str = "ds", area=None, date: dt.date | None = None, hours: tuple[int, int] | None = None, band: int = 1, periods: Mapping[str, tuple[int, int]] | None = None) -> dict[str, DataFrame]:
    """``nodes``, ``edges`` and ``schedule`` of a feed; the records are made once and clipped before they are aggregated.

    The records lie in the checkpoint folder, so nothing is left to be released.
    """
    rows = cut(clip_records(trip_records(feed, dataset=dataset, date=date, hours=hours, band=band, periods=periods), area))
    edges = stop_edges(rows, dataset=dataset, periods=None if periods is None else list(periods), date=date)
    return {"nodes": used_stops(feed["stops"], edges, area, dataset=dataset), "edges": edges, "schedule": schedule_table(rows), "records": rows}


def output_names(periods: Sequence[str] | None = None) -> dict[str, str]:
    """The edge layer's long names with their short ones, in the order of the output."""
    codes, out = period_codes(periods), {}
    for item in EDGE_OUTPUT:
        pairs = (item,) if isinstance(item[0], str) else item  # what stands together is written side by side
        over_p = codes if "{p}" in pairs[0][0] else {"": ""}
        over_d = DAY_CODES if "{d}" in pairs[0][0] else {"": ""}
        out |= {long.format(p=p, d=d): short.format(p=over_p[p], d=over_d[d]) for p in over_p for d in over_d for long, short in pairs}
    return out


def output_edges(edges: DataFrame, periods: Sequence[str] | None = None) -> DataFrame:
    """The edge layer as it is written: the columns there are, in order, under their short names."""
    return edges.select(*[F.col(long).alias(short) for long, short in output_names(periods).items() if long in edges.columns])


def output_stops(stops: DataFrame) -> DataFrame:
    """The stop layer as it is written."""
    return stops.select(*[c for c in ("node_id", "stop_name", "in_area", "x", "y") if c in stops.columns])


def transit_weights(periods: Sequence[str] | None = None) -> list[str]:
    """The travel times of the output layer, all in seconds; the overall mean is the first."""
    return [short for long, short in output_names(periods).items() if long.startswith("travel_time")]


def no_service(feed: Mapping[str, DataFrame | None], date: dt.date) -> str:
    """Why a feed has no trip on ``date``, or ``''`` if it has one."""
    trips = feed["trips"]
    if "service_id" not in trips.columns:
        return ""
    calendar, exceptions = feed.get("calendar"), feed.get("calendar_dates")
    if not trips.join(active_services(calendar, exceptions, date), "service_id", "left_semi").isEmpty():
        return ""
    span = service_period(calendar, exceptions).first()
    return f"no trips on {date.isoformat()}" + (f"; its calendar runs from {span['first_day']} to {span['last_day']}" if span["first_day"] else "")


def period_codes(periods: Sequence[str] | None = None) -> dict[str, str]:
    """Short codes of period names: three letters each, or ``p1, p2...`` if these clash or equal a day type's."""
    names = [*(PERIODS if periods is None else periods)]
    if REST not in names:
        names.append(REST)
    fixed = {"peak_am": "pam", "peak_pm": "ppm", REST: "rod"}
    def stem(name: str) -> str:
        return fixed.get(name) or "".join(c for c in name.lower() if c.isalnum())[:3]

    codes = {n: stem(n) for n in names}
    own = [codes[n] for n in names]
    if len(set(own)) < len(own) or any(not c or c in ("wd", "we") for c in own):
        codes = {n: fixed.get(n) if n == REST else f"p{i}" for i, n in enumerate(names, 1)}
    return codes
