"""Implausible readings per source: a Hampel filter, stuck runs and physical bounds.

Readings of one source are put in time order.  A reading is a spike if it is further from the rolling
median than ``k`` rolling median absolute deviations *and* than a least ratio; both on logarithms, since
durations scatter in proportion.  A run of successive readings of one value is stuck if it is long and
the source otherwise varies.  Sources of any size are cut into chunks of successive readings which
overlap by half a window, so that the busiest source is many tasks and the rolling window is still whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.functions.clock import clock_seconds, valid_clock
from railweave.scale import cut, lookup_join, numbered

#: Readings in the rolling window, deviations and least ratio of a spike, readings of a stuck run.
WINDOW, DEVIATIONS, LEAST_RATIO, STUCK_RUN = 31, 3.5, 1.8, 8
#: Successive readings in a task's unit of work.
CHUNK = 4096
#: Readings of small sources that are judged together, on average.
BATCH = 8_192
#: A source's scatter (as a ratio) below which it follows a timetable, so that equal readings say nothing.
LEAST_SCATTER = 0.004

_SIGMA = 1.4826


def rolling_median(values: np.ndarray, half: int) -> np.ndarray:
    """The median of the up to ``2 * half + 1`` values around each place, without NaN; NaN where there is none."""
    padded = np.concatenate([np.full(half, np.nan), values, np.full(half, np.nan)])
    windows = np.sort(np.lib.stride_tricks.sliding_window_view(padded, 2 * half + 1), axis=1)  # NaN sort last
    n = (~np.isnan(windows)).sum(axis=1)
    at = np.arange(len(values))
    low, high = np.maximum((n - 1) // 2, 0), n // 2
    return np.where(n > 0, (windows[at, low] + windows[at, np.minimum(high, 2 * half)]) / 2, np.nan)


def hampel(logs: np.ndarray, scatter: np.ndarray, half: int, k: float, least: float) -> np.ndarray:
    """How far (in logs) each reading may lie from the rolling median, and the median: two rows."""
    middle = rolling_median(logs, half)
    rolled = rolling_median(np.abs(logs - middle), half)
    width = np.maximum(k * _SIGMA * np.fmax(rolled, scatter), least)
    return np.stack([middle, width])


def run_lengths(values: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
    """For each place the length of the run of equal values it is in; NaN are passed over and get 0; runs end where ``part`` changes."""
    out = np.zeros(len(values), int)
    known = np.flatnonzero(~np.isnan(values))
    if len(known):
        v = values[known]
        new = v[1:] != v[:-1]
        if part is not None:
            new |= part[known][1:] != part[known][:-1]
        starts = np.flatnonzero(np.r_[True, new])
        sizes = np.diff(np.r_[starts, len(v)])
        out[known] = np.repeat(sizes, sizes)
    return out


def _chunked(rows: DataFrame, chunk: int, halo: int) -> DataFrame:
    """``rows`` with ``chunk_no`` and ``before`` (readings of the source before the row's time slot).

    A source of at most ``chunk`` readings is one chunk.  Of a larger one, the readings per minute are
    counted; a minute goes to each chunk that it or the halo around it meets.  The readings of a minute that
    has more than ``chunk`` of them are ranked (their order is spread over tasks) and go to chunks one by one.
    """
    zero = F.lit(0).cast("long")
    small = rows.where(F.col("n") <= chunk).withColumn("chunk_no", zero).withColumn("before", zero)
    large = rows.where(F.col("n") > chunk).withColumn("slot", F.floor(F.col("at") / 60))
    slots = large.groupBy("source", "slot").agg(F.count("*").alias("c"))
    # the slots of a source are bounded by its calendar, not by its readings
    upto = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = cut(slots.withColumn("before", F.sum("c").over(upto) - F.col("c")))
    met = lambda first, last: F.sequence(F.floor(F.greatest(first - halo, zero) / chunk), F.floor((last + halo) / chunk))
    calm = slots.where(F.col("c") <= chunk).select("source", "slot", "before", met(F.col("before"), F.col("before") + F.col("c") - 1).alias("chunks"))
    timed = lookup_join(large, calm, ["source", "slot"], "inner")
    busy = slots.where(F.col("c") > chunk).select("source", "slot", "before")
    if not busy.isEmpty():
        ranked = numbered(lookup_join(large, busy, ["source", "slot"], "inner"), ["source", "slot", "at", "tie", "id"], "place")
        first = ranked.groupBy("source", "slot").agg(F.min("place").alias("first"))
        own = lookup_join(ranked, first, ["source", "slot"], "inner").withColumn("before", F.col("before") + F.col("place") - F.col("first")).drop("place", "first")
        timed = timed.unionByName(own.withColumn("chunks", met(F.col("before"), F.col("before"))))
    return small.unionByName(timed.withColumn("chunk_no", F.explode("chunks")).drop("slot", "chunks"))


def judge_readings(
    df: DataFrame,
    *,
    window: int = WINDOW,
    deviations: float = DEVIATIONS,
    least_ratio: float = LEAST_RATIO,
    stuck_run: int = STUCK_RUN,
    chunk: int = CHUNK,
) -> DataFrame:
    """The wrong readings of ``df(id, source, at, reading, second, tie)``.

    ``at`` is the time in seconds (rows without it are judged against the source as a whole and are in no
    run), ``reading`` the positive reading, ``second`` another reading of the same quantity, ``tie`` orders
    rows of one time.  Gives ``(id, spike, second_spike, stuck)`` for rows where one of these holds.
    A source of a single reading has no spike.  Null readings are no case.  A source's level and scatter come
    from approximate quartiles, off by at most 1/2000 of its readings in rank; the rolling windows are exact.
    """
    half = window // 2
    halo = max(2 * half, stuck_run)
    logged = F.when(F.col("reading") > 0, F.log("reading"))
    rows = df.select("id", "source", F.col("at").cast("double").alias("at"), "reading", "second", "tie")
    stats = cut(
        rows.groupBy("source").agg(
            F.count("*").alias("n"),
            F.percentile_approx(logged, [0.25, 0.5, 0.75], 2000).alias("q"),
        ).select("source", "n", F.col("q")[1].alias("level"), ((F.col("q")[2] - F.col("q")[0]) / 2).alias("scatter"))
    )
    rows = lookup_join(rows.where(F.col("source").isNotNull()), stats, ["source"], "inner")
    least = float(np.log(least_ratio))

    def judged(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["source", "chunk_no", "at", "tie", "id"], kind="stable").reset_index(drop=True)
        number, before, place = g["chunk_no"].to_numpy(), g["before"].to_numpy(), np.arange(len(g))
        source = g["source"].to_numpy()
        begins = np.r_[True, (source[1:] != source[:-1]) | (number[1:] != number[:-1])]
        part = np.cumsum(begins) - 1
        reading, second = g["reading"].to_numpy(float), g["second"].to_numpy(float)
        with np.errstate(all="ignore"):
            logs, second_logs = np.log(np.where(reading > 0, reading, np.nan)), np.log(np.where(second > 0, second, np.nan))
        # all parts in one array, half a window of nothing between them, so that no window reaches the next part
        spaced = np.full(len(g) + half * (part[-1] + 1), np.nan)
        wide = np.full(len(spaced), np.nan)
        at = place + half * part
        spaced[at], wide[at] = logs, g["scatter"].to_numpy(float)
        middle, width = (x[at] for x in hampel(spaced, wide, half, deviations, least))
        # a row whose neighbours have no readings is judged by its source's level
        middle = np.where(np.isnan(middle), g["level"].to_numpy(float), middle)
        with np.errstate(invalid="ignore"):
            far, second_far = np.abs(logs - middle) > width, np.abs(second_logs - middle) > width
        # rows with a wrong second reading may stand at a wrong time, so they don't part a run
        value = np.where(~np.isnan(reading), reading, second)
        run = run_lengths(np.where(second_far & ~far, np.nan, value), part)
        stuck = (run >= stuck_run) & (g["scatter"].to_numpy(float) > LEAST_SCATTER)
        # a time slot is here as a whole (or each of its readings is told its own rank), so a reading's rank in its
        # source is that of the slot plus its place in it
        first = np.maximum.accumulate(np.where(begins | np.r_[True, before[1:] != before[:-1]], place, 0))
        core = (g["n"].to_numpy() <= chunk) | ((before + place - first) // chunk == number)
        keep = core & (far | second_far | stuck)
        return pd.DataFrame({"id": g["id"][keep], "spike": far[keep], "second_spike": second_far[keep], "stuck": stuck[keep]})

    timed = _chunked(rows.where(F.col("at").isNotNull()), chunk, halo)
    # small sources share a unit of work of about BATCH readings; a chunk of a large one is a unit of its own
    total = stats.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    work = F.when(F.col("n") <= chunk, F.pmod(F.xxhash64("source"), F.lit(max(1, total // BATCH)))).otherwise(F.xxhash64("source", "chunk_no"))
    kind = df.schema["id"].dataType.simpleString()
    found = timed.withColumn("work", work).groupBy("work").applyInPandas(judged, f"id {kind}, spike boolean, second_spike boolean, stuck boolean")
    width = F.greatest(F.lit(deviations * _SIGMA) * F.col("scatter"), F.lit(least))
    far = [F.coalesce(F.abs(F.log(F.when(F.col(c) > 0, F.col(c))) - F.col("level")) > width, F.lit(False)) for c in ("reading", "second")]
    untimed = rows.where(F.col("at").isNull()).select("id", far[0].alias("spike"), far[1].alias("second_spike"), F.lit(False).alias("stuck")).where("spike or second_spike")
    return found.unionByName(untimed)


def _day_seconds(day: Column) -> Column:
    return F.datediff(day, F.lit("2000-01-01").cast("date")).cast("double") * 86400


def wrong_passages(df: DataFrame, *, last_hour: int = 47, **limits) -> DataFrame:
    """The wrong rows of a table of measured passages: ``(sched_row, reasons array<string>)``.

    Reasons: ``no_such_clock``, ``no_duration`` (a measured or clocked duration of zero or less), ``spike``,
    ``clock_spike`` (the time between the clocks is a spike), ``stuck``.  Nulls, blank and loosely written
    clocks (blanks around, one-digit hours, hours from 24 on) are no case.  Rows sent again are judged once
    and reported each.  Other columns are ignored; an empty table gives no row.
    """
    content = ["edge_id", "trip_id", "departure_time", "arrival_time", "travel_time_seconds", "service_date"]
    text = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in content])
    clocks = {}
    for c in ("departure_time", "arrival_time"):
        given = F.col(c).isNotNull() & (F.trim(c) != "")
        good = F.coalesce(valid_clock(F.col(c), last_hour), F.lit(False))
        clocks[c] = (given & ~good, F.when(given & good, clock_seconds(F.col(c))))
    reading = F.when(~F.isnan("travel_time_seconds"), F.col("travel_time_seconds"))
    took = clocks["arrival_time"][1] - clocks["departure_time"][1]
    left = F.coalesce(clocks["departure_time"][1], clocks["arrival_time"][1] - F.greatest(F.coalesce(reading, F.lit(0.0)), F.lit(0.0)))
    keyed = df.select(F.col("sched_row"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), F.reverse(text)).alias("h2"))
    # rows of the same content are one; only what is judged goes through the shuffle, not the texts
    told = {
        "source": F.col("edge_id"),
        "at": _day_seconds(F.col("service_date")) + left,
        "reading": reading,
        "second": took,
        "no_such_clock": clocks["departure_time"][0] | clocks["arrival_time"][0],
        "no_duration": F.coalesce((reading <= 0) | (took <= 0), F.lit(False)),
    }
    every = df.select("sched_row", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), F.reverse(text)).alias("h2"), *[v.alias(k) for k, v in told.items()])
    rows = every.groupBy("h1", "h2", *told).agg(F.min("sched_row").alias("id"))
    rows = cut(rows)
    judged = judge_readings(rows.select("id", "source", "at", "reading", "second", F.col("h1").alias("tie")), **limits)
    impossible = rows.where(F.col("no_such_clock") | F.col("no_duration")).select("id", F.lit(False).alias("spike"), F.lit(False).alias("second_spike"), F.lit(False).alias("stuck"), "no_such_clock", "no_duration")
    flags = ["no_such_clock", "no_duration", "spike", "second_spike", "stuck"]
    all_found = judged.withColumn("no_such_clock", F.lit(False)).withColumn("no_duration", F.lit(False)).select("id", *flags).unionByName(impossible.select("id", *flags))
    names = {"second_spike": "clock_spike"}
    per = all_found.groupBy("id").agg(*[F.max(f).alias(f) for f in flags])
    reasons = F.array_compact(F.array(*[F.when(F.col(f), names.get(f, f)) for f in flags]))
    wrong = per.select("id", reasons.alias("reasons"))
    # back to all rows of the same content; the wrong are few
    wrong = cut(rows.select("h1", "h2", "id").join(wrong, "id").drop("id"))
    return lookup_join(keyed.select("sched_row", "h1", "h2"), wrong, ["h1", "h2"], "inner").select("sched_row", "reasons")
