"""Timetables: feeds drawn at random, with what is expected computed from them in plain Python."""

import collections
import csv
import datetime as dt
import random
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from railweave.functions import geo
from railweave.functions.calendar import WEEK, service_date
from railweave.functions.clock import clock_seconds, clock_text, hour_band, period
from railweave.operators import timetable as tt
from railweave.sources.timetables import feed_name, listed_datasets, named_feeds, province_like, read_feed, read_table, unique_name

ROUTES = {"q7": ("Q", "Quarry line", "702"), "v2": (None, "Valley line", "714"), "z": ("Zz", "Zigzag", "3")}
PLACES = {f"p{k}": (11.0 + 0.013 * (k * 5 % 17), 61.0 + 0.009 * (k * 7 % 19)) for k in range(14)}
BOX = (11.02, 61.03, 11.13, 61.12)
SERVICES = {"daily": "1111111", "market": "0010010", "school": "1101100", "none": "0000000"}
SPAN = (dt.date(2031, 2, 3), dt.date(2031, 9, 28))
EXTRA = [("none", dt.date(2031, 3, 11), 1), ("none", dt.date(2031, 3, 14), 1), ("daily", dt.date(2031, 3, 12), 2), ("school", dt.date(2031, 3, 11), 2), ("market", dt.date(2031, 3, 11), 1)]


def clock(s):
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def drawn(seed=5, n=40):
    """``{trip: (route, service, [(stop, second)])}``; some trips pass midnight, some stand for hours."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        at, stops = rng.randint(5 * 3600, 23 * 3600), rng.sample(sorted(PLACES), rng.randint(2, 5))
        rows = []
        for s in stops:
            rows.append((s, at))
            at += rng.choice([0, 75, 240, 610, 1805, 12_000])
        out[f"run{i}"] = (rng.choice(sorted(ROUTES)), rng.choice(sorted(SERVICES)), rows)
    return out


def put(folder, table, header, rows):
    folder.mkdir(parents=True, exist_ok=True)
    with (folder / f"{table}.txt").open("w", encoding="utf-8-sig" if table == "trips" else "utf-8", newline="") as out:
        w = csv.writer(out)
        w.writerow([f" {header[0]} ", *header[1:]])
        w.writerows(rows)


@pytest.fixture(scope="module")
def trips():
    return drawn()


@pytest.fixture(scope="module")
def folder(tmp_path_factory, trips):
    f = tmp_path_factory.mktemp("feeds") / "drawn"
    put(f, "stops", ["stop_id", "stop_name", "stop_lon", "stop_lat"], [(k, f"Place {k} ", x, y) for k, (x, y) in PLACES.items()])
    put(f, "routes", ["route_id", "route_short_name", "route_long_name", "route_type"], [(k, *v) for k, v in ROUTES.items()])
    put(f, "trips", ["trip_id", "route_id", "service_id"], [(t, r, s) for t, (r, s, _) in trips.items()])
    put(f, "stop_times", ["trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"], [(t, 10 * k, s, clock(at), clock(at)) for t, (_, _, rows) in trips.items() for k, (s, at) in reversed(list(enumerate(rows)))])
    put(f, "calendar", ["service_id", *WEEK, "start_date", "end_date"], [(k, *flags, SPAN[0].strftime("%Y%m%d"), SPAN[1].strftime("%Y%m%d")) for k, flags in SERVICES.items()])
    put(f, "calendar_dates", ["service_id", "date", "exception_type"], [*((s, d.strftime("%Y%m%d"), k) for s, d, k in EXTRA), ("none", "soon", 1)])
    return f


def runs_on(service, day):
    on = SPAN[0] <= day <= SPAN[1] and SERVICES[service][day.weekday()] == "1"
    for s, d, k in EXTRA:
        if (s, d) == (service, day):
            on = k == 1
    return on


def hops(trips, area=None, day=None):
    """``(from, to, route, trip, second, travel or None)`` of each segment whose line meets the box."""
    for t, (route, service, rows) in trips.items():
        if day is None or runs_on(service, day):
            for (a, s), (b, e) in zip(rows, rows[1:]):
                if area is None or crosses(PLACES[a], PLACES[b], area):
                    yield a, b, route, t, s, e - s if e - s <= tt.LONGEST_SEGMENT else None


def crosses(p, q, area, steps=4000):
    """Whether some of very many points of the line lie in the box."""
    return any(area[0] <= p[0] + (q[0] - p[0]) * k / steps <= area[2] and area[1] <= p[1] + (q[1] - p[1]) * k / steps <= area[3] for k in range(steps + 1))


def expected(trips, area=None, day=None):
    made = collections.defaultdict(list)
    for a, b, route, t, s, took in hops(trips, area, day):
        made[a, b, route].append((t, s, took))
    out = {}
    for key, rows in made.items():
        took = [x for _, _, x in rows if x is not None]
        band = collections.defaultdict(list)
        for t, s, x in rows:
            h = s // 3600 % 24
            band[f"{h:02d}-{h + 1:02d}"].append((t, x))
        known = {b: [x for _, x in v if x is not None] for b, v in band.items()}
        out[key] = {
            "trip_count": len({t for t, _, _ in rows}), "travel_time_seconds_mean": pytest.approx(statistics.mean(took)) if took else None, "travel_time_seconds_median": statistics.median(took) if took else None,
            "travel_time_seconds_min": min(took, default=None), "travel_time_seconds_max": max(took, default=None),
            "hourly_trip_counts": "|".join(f"{b}:{len({t for t, _ in v})}" for b, v in sorted(band.items())),
            "hourly_travel_times": "|".join(f"{b}:{round(statistics.mean(v))}" for b, v in sorted(known.items()) if v) or None,
        }
    return out


@pytest.mark.parametrize("area,day", [(None, None), (BOX, None), (BOX, dt.date(2031, 3, 11))])
def test_edges_stops_and_schedule(spark, folder, trips, area, day):
    made = tt.normalize_feed(read_feed(spark, folder), dataset="dr", area=None if area is None else geo.box(*area), date=day)
    want = expected(trips, area, day)
    edges = {(r["from_node"], r["to_node"], r["route_id"]): r.asDict() for r in made["edges"].collect()}
    assert set(edges) == set(want) and len(want) > 5
    for key, w in want.items():
        assert {c: edges[key][c] for c in w} == w, key
        assert edges[key]["edge_id"] == f"dr_{key[2]}_{key[0]}_{key[1]}"
        if day is not None:
            assert edges[key]["trip_count_weekday"] == w["trip_count"] and edges[key]["trip_count_weekend"] is None
    used = {v for a, b, _ in want for v in (a, b)}
    inside = lambda p: area is None or (area[0] <= p[0] <= area[2] and area[1] <= p[1] <= area[3])
    assert {r["node_id"]: r["in_area"] for r in made["nodes"].collect()} == {v: inside(PLACES[v]) for v in used}
    assert made["schedule"].count() == sum(1 for _ in hops(trips, area, day))
    assert made["records"].where("implausible_time").count() == sum(took is None for *_, took in hops(trips, area, day))


def test_an_area_without_service(spark, folder):
    made = tt.normalize_feed(read_feed(spark, folder), area=geo.box(-5, -5, -4, -4))
    assert made["edges"].count() == 0 and made["nodes"].count() == 0 and "trip_count_peak_pm_weekend" in made["edges"].columns


def test_services(spark, folder):
    feed = read_feed(spark, folder)
    for k in range(0, 60, 3):
        day = dt.date(2031, 1, 30) + dt.timedelta(k)
        on = {r[0] for r in tt.active_services(feed["calendar"], feed["calendar_dates"], day).collect()}
        assert on == {s for s in SERVICES if runs_on(s, day)}, day
    days = {r["service_id"]: r for r in tt.service_days(feed["calendar"], feed["calendar_dates"]).collect()}
    for s, flags in SERVICES.items():
        added, gone = ([d for x, d, k in EXTRA if x == s and k == kind] for kind in (1, 2))
        own = [w for w, f in zip(WEEK, flags) if f == "1"] or [w for w in WEEK if w in {WEEK[d.weekday()] for d in added}]
        # the date that can't be read counts as added, but names no day
        assert days[s]["active_days_of_week"] == ("|".join(own) or None) and days[s]["days_active"] == flags.count("1") + len(added) - len(gone) + (s == "none")
        assert days[s]["runs_weekend"] == bool(set(own) & set(WEEK[5:]))
    assert tuple(tt.service_period(feed["calendar"], feed["calendar_dates"]).first()) == SPAN
    assert tt.no_service(feed, dt.date(2031, 3, 11)) == ""
    assert tt.no_service(feed, dt.date(2030, 6, 1)) == "no trips on 2030-06-01; its calendar runs from 2031-02-03 to 2031-09-28"


def test_frequencies(spark, folder, trips, tmp_path):
    feed = read_feed(spark, folder)
    asked = [("run3", 25_000, 27_500, 800), ("run3", 25_800, 25_801, 50), ("run8", 90_000, 90_500, 450), ("run9", 100, 50, 10), ("run9", 100, 500, 0), ("nobody", 0, 100, 10)]
    rows = spark.createDataFrame([(t, clock(a), clock(b), str(h)) for t, a, b, h in asked], "trip_id string, start_time string, end_time string, headway_secs string")
    new, times = tt.expand_frequencies(feed["trips"], feed["stop_times"], rows)
    starts = collections.defaultdict(set)
    for t, a, b, h in asked:
        if t in trips and h > 0 and b > a:
            starts[t] |= set(range(a, b, h))
    want = {}
    for t, (_, _, stops) in trips.items():
        for s in starts.get(t, [None]):
            want[t if s is None else f"{t}@{clock(s)}"] = [(p, at if s is None else s + at - stops[0][1]) for p, at in stops]
    assert {r["trip_id"] for r in new.collect()} == set(want) and len(want) > len(trips)
    found = collections.defaultdict(list)
    for r in times.withColumn("n", F.col("stop_sequence").cast("int")).orderBy("n").withColumn("s", clock_seconds(F.col("departure_time"))).collect():
        found[r["trip_id"]].append((r["stop_id"], int(r["s"])))
    assert found == want


def test_scans(spark, folder, trips, tmp_path):
    packed = tmp_path / "20290417_235959_Night - Owls.zip"
    with zipfile.ZipFile(packed, "w") as z:
        for p in folder.iterdir():
            z.write(p, f"deep/{p.name.upper() if p.stem == 'routes' else p.name}")
    rows = read_table(spark, packed, "trips").orderBy("_ordinal").collect()
    assert [r["trip_id"] for r in rows] == list(trips)
    assert read_table(spark, packed, "stops").first()["stop_name"] == "Place p0" and read_feed(spark, packed)["frequencies"] is None
    with pytest.raises(FileNotFoundError):
        read_table(spark, packed, "frequencies")
    assert feed_name(packed.name) == "night_owls" and unique_name("x", ["x", "x_2", "x_4"]) == "x_3"
    assert named_feeds({"owls": str(packed)}) == [("owls", str(packed))] and named_feeds(None) == []
    for bad in (["gopher://a/b"], ["  "], [(b"n", "x")]):
        with pytest.raises(ValueError):
            named_feeds(bad)
    with pytest.raises(FileNotFoundError):
        named_feeds(str(tmp_path / "absent.zip"))


def test_clocks(rows):
    texts = ["09:41:07", "26:00:59", " 3:8:2 ", "noon", "12:30", None, "123:45:00"]
    df = rows("t string", *[(t,) for t in texts])
    s = clock_seconds(F.col("t"))
    out = [tuple(r) for r in df.select(s, clock_text(s), hour_band(s), hour_band(s, 4), period(s)).collect()]
    for t, r in zip(texts, out):
        parts = (t or "").split(":")
        if len(parts) != 3:
            assert r == (None,) * 5
            continue
        h, m, sec = map(int, parts)
        of_day = h % 24
        assert r[:2] == (h * 3600 + m * 60 + sec, f"{h:02d}:{m:02d}:{sec:02d}") and r[2] == f"{of_day:02d}-{of_day + 1:02d}" and r[3] == f"{of_day // 4 * 4:02d}-{of_day // 4 * 4 + 4:02d}"
        assert r[4] == next((p for p, (a, b) in {"peak_am": (7, 9), "peak_pm": (17, 20)}.items() if a <= of_day < b), "rest_of_day")
    with pytest.raises(ValueError):
        service_date("31st of May")


def test_modes_names_and_codes(rows):
    rng = random.Random(2)
    rails = {0, 1, 2, 5, 7, 12, *range(100, 200), *range(300, 700), *range(900, 1000), *range(1400, 1500)}
    for _ in range(12):
        kinds = [rng.choice([0, 3, 4, 6, 7, 11, 12, 117, 205, 640, 715, 930, 1100, 1450, 1501]) for _ in range(rng.randint(1, 5))]
        want = "train" if 2 * sum(k in rails for k in kinds) > len(kinds) else "bus"
        assert tt.feed_mode(rows("route_type string", *[(str(k),) for k in kinds])).first()["mode"] == want, kinds
    assert tt.feed_mode(rows("route_type string", (None,))).first()["mode"] == "bus"
    names = tt.output_names(["dawn", "dusk"])
    assert tt.period_codes(["dawn", "dusk"]) == {"dawn": "daw", "dusk": "dus", "rest_of_day": "rod"} and list(tt.period_codes(["wide", "wider"]).values())[:2] == ["p1", "p2"]
    assert names["trip_count_dusk_weekend"] == "trp_dus_we" and names["travel_time_seconds_mean_dawn"] == "tts_m_daw" and len(set(names.values())) == len(names)
    assert all(len(v) <= 10 for k, v in names.items() if k != "geometry") and tt.transit_weights()[0] == "tts_m" and len(tt.transit_weights()) == 18


def test_a_catalogue_is_listed_and_a_province_guessed(spark):
    regions = [{"id": 4, "tipo": "0", "nombre": "Brumália"}, {"id": 9, "tipo": "0", "nombre": "Costa Gris"}, {"id": 5, "tipo": "2", "nombre": "Brumalia del Mar"}]
    assert province_like("brumalia d. m.", regions) == 4
    with pytest.raises(ValueError):
        province_like("x", regions[2:])
    given = {4: [{"id": 70, "name": "Fog lines", "types": [{"id": 2, "name": "Coach"}], "files": [{"id": 700, "name": "fog.zip"}]}], 9: None}
    assert [tuple(r)[:3] for r in listed_datasets(spark, [4, 9, 4], given.get).collect()] == [(4, 70, "Fog lines")]
