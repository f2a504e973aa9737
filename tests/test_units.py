import pytest
from pyspark.sql import functions as F

from railweave.operators.units import AliasIndex, SPEED_UNITS, common_units, quantities, weighted_distance

SCHEMA = "edge_row long, maxspeed double, spd_raw string, source string, unit string, spelling string"


def speeds(rows, *data):
    out = common_units(rows(SCHEMA, *[(*d, "clash", "clash") for d in data]), "edge_row", "maxspeed", "spd_raw", "source").collect()
    return {r["edge_row"]: (r["unit"], None if r["converted"] is None else round(r["converted"], 3)) for r in out}


def test_units_of_texts_and_sources(rows):
    known = [(100 + i, None, "30 mph", "miles") for i in range(5)] + [(200 + i, None, "30 km/h", "metric") for i in range(5)]
    out = speeds(rows, *known, (1, 30.0, None, "miles"), (2, 30.0, None, "metric"), (3, 30.0, "30 kn", "metric"), (4, None, "20", "miles"), (5, None, "11,1 m/s", None), (6, None, "200 × 0.1 km/h", None), (7, None, "10 mph; 30 km/h", None), (8, None, "walk", "miles"), (9, float("nan"), "", "miles"), (10, 50.0, "signals", "other"), (11, 40.0, "", "miles"))
    assert out[1] == ("mph", 48.28) and out[2] == ("km/h", 30.0) and out[3] == ("knot", 55.56) and out[4] == ("mph", 32.187)
    assert out[5] == ("m/s", 39.96) and out[6] == ("0.1 km/h", 20.0) and out[7] == ("km/h", 30.0)
    assert out[8] == (None, None) and out[9] == (None, None) and out[10] == ("km/h", 50.0) and out[11] == ("mph", 64.374)


def test_spellings_are_fuzzy_but_digits_are_not():
    index = AliasIndex(SPEED_UNITS)
    for text, unit in {"km / h": "km/h", "Kmh.": "km/h", "m.p.h": "mph", "mile per hour": "mph", "knotts": "knot", "metre per second": "m/s", "(0.1 km/h)": "0.1 km/h", "x0.1 km/h": "0.1 km/h"}.items():
        assert index.find(text)[0] == unit, text
    assert index.find("0.7 km/h")[0] is None and index.find("furlongs")[0] is None
    assert weighted_distance("km/h", "km h") < weighted_distance("km/h", "kn/h") < weighted_distance("1km", "2km")


def test_quantities(rows):
    out = rows("t string", ("max 50 km/h; 30 mph|x",)).select(quantities(F.col("t")).alias("q")).first()["q"]
    assert [(q["value"], q["spelling"]) for q in out] == [(50.0, "km/h"), (30.0, "mph")]


def test_unknown_unit_is_reported_and_empty_table(rows):
    df = rows("edge_row long, maxspeed double, spd_raw string, source string", (1, None, "7 furlongs", "s"))
    assert common_units(df, "edge_row", "maxspeed", "spd_raw", "source").first()["unknown_unit"] == "furlongs"
    assert common_units(df.limit(0), "edge_row", "maxspeed", "spd_raw", "source").count() == 0


def test_mixed_spellings_repeated_keys_and_no_shuffle_of_rows(rows):
    df = rows(SCHEMA, (1, None, "30 mph; 40 km/h; 9", "s", "", ""), (1, None, "20 kn", "s", "", ""), (2, 50.0, None, "m", "", ""))
    out = common_units(df, "edge_row", "maxspeed", "spd_raw", "source")
    assert sorted((r["edge_row"], r["unit"], round(r["converted"], 2), r["n_given"]) for r in out.collect()) == [(1, "knot", 37.04, 1), (1, "mph", 48.28, 3), (2, "km/h", 50.0, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
