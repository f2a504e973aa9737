import datetime as dt

import numpy as np
import pandas as pd
import pytest

from railweave.operators.spikes import judge_readings, rolling_median, run_lengths, wrong_passages

SCHEMA = "sched_row long, edge_id string, trip_id string, departure_time string, arrival_time string, travel_time_seconds double, service_date date, id int, at double, n int"


def clock(s):
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def passages(n=400, edge="e", level=300, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        took, start = int(level * np.exp(rng.normal(0, 0.08))), 20_000 + (i % 40) * 1200
        out.append([i, edge, f"t{i}", clock(start), clock(start + took), float(took), dt.date(2018, 1, 1 + i // 40), 0, 0.0, 0])
    return out


def reasons(rows, data, **limits):
    found = wrong_passages(rows(SCHEMA, *map(tuple, data)), **limits).collect()
    assert len({r["sched_row"] for r in found}) == len(found)
    return {r["sched_row"]: list(r["reasons"]) for r in found}


@pytest.mark.parametrize("limits", [dict(), dict(chunk=50)])
def test_each_kind_of_wrong_reading(rows, limits):
    data = passages()
    data[10][5] = 3000.0
    data[20][5] = -60.0
    data[30][4] = clock(20_000 + 30 * 1200 + 4000)
    data[40][3] = "12:61:00"
    data[50][3] = "99:99:99"
    data[60][4] = data[60][3]
    data[70][5] = None
    data[71][3] = None
    data[72][3] = f" {data[72][3]} "
    data[73][4] = ""
    for i in range(100, 112):
        start = 20_000 + (i % 40) * 1200
        data[i][4], data[i][5] = clock(start + 290), 290.0
    data.append([900, *data[10][1:]])
    found = reasons(rows, data, **limits)
    assert found[10] == ["spike"] and found[900] == ["spike"]
    assert found[20] == ["no_duration"] and found[60] == ["no_duration"]
    assert found[30] == ["clock_spike"] and found[40] == ["no_such_clock"] and found[50] == ["no_such_clock"]
    assert {i for i, r in found.items() if "stuck" in r} == set(range(100, 112))
    assert set(found) == {10, 20, 30, 40, 50, 60, 900, *range(100, 112)}


def test_timetable_edges_are_not_stuck_and_slow_days_are_usual(rows):
    fixed = [[i, "f", f"t{i}", clock(30_000 + i * 60), clock(30_060 + i * 60), 60.0, dt.date(2018, 1, 1), 0, 0.0, 0] for i in range(200)]
    assert reasons(rows, fixed) == {}
    slow = passages(seed=3)
    for i in range(200, 280):
        start = 20_000 + (i % 40) * 1200
        slow[i][5] *= 1.3
        slow[i][4] = clock(start + int(slow[i][5]))
    assert reasons(rows, slow) == {}


def test_chunks_give_what_one_chunk_gives(rows):
    data = passages(n=1000, seed=9)
    for i in range(0, 1000, 37):
        data[i][5] *= 5
    whole = reasons(rows, data, chunk=100_000)
    assert len(whole) >= 27 and whole == reasons(rows, data, chunk=64) == reasons(rows, data, chunk=333)


def test_empty_tables_and_nulls(rows):
    assert wrong_passages(rows(SCHEMA)).count() == 0
    assert reasons(rows, [[1, None, None, None, None, None, None, 0, 0.0, 0], [2, "e", None, "x", None, None, None, 0, 0.0, 0]]) == {2: ["no_such_clock"]}


def test_pieces():
    v = np.array([1.0, np.nan, 3.0, 100.0, 5.0])
    expected = pd.Series(v).rolling(3, center=True, min_periods=1).median().to_numpy()
    assert np.allclose(rolling_median(v, 1), expected)
    assert list(run_lengths(np.array([1, 1, np.nan, 1, 2]))) == [3, 3, 0, 3, 1]
    assert judge_readings.__doc__


def test_a_minute_of_a_million_readings_is_many_groups_and_judged_alike(spark):
    from pyspark.sql import functions as F

    from railweave.operators import spikes

    made = spark.range(1_000_000).select(F.col("id"), F.lit("s").alias("source"), F.lit(30.0).alias("at"), F.when(F.col("id") % 50_000 == 7, 9_000.0).otherwise(300.0 + F.col("id") % 61).alias("reading"), F.lit(None).cast("double").alias("second"), F.col("id").alias("tie"))
    few = spark.range(100).select((F.col("id") + 2_000_000).alias("id"), F.lit("s").alias("source"), (F.col("id") * 70.0).alias("at"), F.lit(320.0).alias("reading"), F.lit(None).cast("double").alias("second"), F.col("id").alias("tie"))
    rows = made.unionByName(few)
    stated = rows.withColumn("n", F.lit(1_000_100)).withColumn("level", F.lit(0.0)).withColumn("scatter", F.lit(0.0))
    groups = spikes._chunked(stated, spikes.CHUNK, 30).groupBy("chunk_no").count().agg(F.max("count"), F.sum("count")).first()
    assert groups[0] <= 2 * spikes.CHUNK and groups[1] < 1.05 * 1_000_100
    found = {r["id"] for r in judge_readings(rows).where("spike").collect()}
    assert found == {7 + 50_000 * k for k in range(20)}
