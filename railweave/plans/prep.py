"""Queries of the general data-preparation operators, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.operators.drift import chained_names, migration_rules, migration_steps, one_table, versions
from railweave.operators.near import near_pairs, regions_holding
from railweave.operators.packed import PLACEHOLDERS, split_packed
from railweave.operators.spikes import wrong_passages
from railweave.operators.units import common_units
from railweave.tables import table

PACKED_FIELDS = ("highway", "hwy_raw", "lanes")
NEAR_METRES = 25.0


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each value of the fields that hold several."""
    return split_packed(table(spark, d, "edges"), "edge_row", PACKED_FIELDS, least=2).select("edge_row", "field_name", "pos", "item")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Each value of all fields, with the flag of malformed items."""
    return split_packed(table(spark, d, "edges"), "edge_row", PACKED_FIELDS)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return wrong_passages(table(spark, d, "schedule")).select("sched_row")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return wrong_passages(table(spark, d, "schedule")).select("sched_row", F.array_join("reasons", "|").alias("reasons"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "nodes")
    near = near_pairs(nodes, "node_id", "x", "y", NEAR_METRES)
    held = regions_holding(nodes.where(F.col("in_area").isNull()), "node_id", "x", "y", table(spark, d, "area_parts"), "part_no", "ring")
    return near.select(F.lit("near").alias("kind"), "id_a", "id_b").unionByName(held.select(F.lit("inside").alias("kind"), F.col("region").cast("long").alias("id_a"), F.col("id").alias("id_b")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    files, rows = versions(table(spark, d, "feed_lines"), table(spark, d, "gtfs_report"))
    return migration_steps(files, rows)


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All stop times of all files in one table."""
    files, rows = versions(table(spark, d, "feed_lines"), table(spark, d, "gtfs_report"))
    return one_table(files, rows, chained_names(files, migration_steps(files, rows)))


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each rename, cast and default that a file passes on its way into the table of ``p6_table``."""
    files, rows = versions(table(spark, d, "feed_lines"), table(spark, d, "gtfs_report"))
    return migration_rules(files, chained_names(files, migration_steps(files, rows)))


def p6_versions(spark: SparkSession, d: str) -> DataFrame:
    """Each file's place in its dataset's chain of schema versions."""
    files, _ = versions(table(spark, d, "feed_lines"), table(spark, d, "gtfs_report"))
    return files.select("file_id", "dataset_id", F.col("before").alias("file_before"), "version", "fingerprint", F.size("names").alias("n_fields"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    speeds = common_units(table(spark, d, "edges"), "edge_row", "maxspeed", "spd_raw", "source")
    return speeds.where((F.col("unit") != "km/h") & F.col("converted").isNotNull()).select("edge_row", F.round("converted").cast("long").alias("kmh"))


def p7_speeds(spark: SparkSession, d: str) -> DataFrame:
    """The speed in km/h of each row, with the unit it was given in."""
    speeds = common_units(table(spark, d, "edges"), "edge_row", "maxspeed", "spd_raw", "source")
    return speeds.select("edge_row", "unit", F.round("converted", 3).alias("kmh"), "n_given", "unknown_unit")


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_values, p3_found, p3_reasons, p4_found, p6_found, p6_table, p6_rules, p6_versions, p7_found, p7_speeds)}


_MARKS = r"[\s\x{FEFF}\x{200B}\x{00A0}\x22\x27]"


def _bare_sql(text: str) -> str:
    return f"regexp_replace({text}, '^{_MARKS}+|{_MARKS}+$', '', 'g')"


def _cells_sql(line: str) -> str:
    """The bare cells of a line, in SQL, by the separator ``sep``."""
    quoted = " ".join(f"when sep = {s} then regexp_extract_all(sep || {line}, '{e}([ ]*\"(?:[^\"]|\"\")*\"[ ]*|[^{e}]*)', 1)" for s, e in (("','", ","), ("';'", ";"), ("chr(9)", "\\t"), ("'|'", "\\|")))
    return f"list_transform(case when contains({line}, '\"') then case {quoted} end else string_split({line}, sep) end, lambda c: {_bare_sql('c')})"


_COUNT = "length(line) - length(replace(line, {0}, ''))"
_VERSIONS_SQL = rf"""
    with l as (select * from feed_lines where file_id is not null and line_no is not null and line is not null and {_bare_sql('line')} <> ''),
    h0 as (select file_id, min(line) as line from l where line_no = 1 group by 1),
    h1 as (select file_id, line, greatest({_COUNT.format("','")}, {_COUNT.format("';'")}, {_COUNT.format("chr(9)")}, {_COUNT.format("'|'")}) as most from h0),
    h2 as (select file_id, lower(line) as line, case most when {_COUNT.format("','")} then ',' when {_COUNT.format("';'")} then ';' when {_COUNT.format("chr(9)")} then chr(9) else '|' end as sep from h1),
    h as (select file_id, sep, {_cells_sql('line')} as names from h2),
    f0 as (select file_id, arg_min(dataset_id, {{'p': published_at, 'd': dataset_id}}) as dataset_id, min({{'p': published_at, 'd': dataset_id}}).p as published_at from gtfs_report where file_id is not null and dataset_id is not null group by 1),
    f as (select h.*, dataset_id, published_at from h join f0 using (file_id)),
    c as (select file_id, unnest(names) as name, unnest(list_slice({_cells_sql('line')}, 1, len(names))) as cell from l join h using (file_id) where line_no > 1),
    k as (select file_id, name, case when cell = '' or cell is null then null when regexp_full_match(cell, '[+-]?\d+') then 1 when regexp_full_match(cell, '[+-]?\d*\.\d+(?:[eE][+-]?\d+)?') then 2 when regexp_full_match(cell, '\d{{1,3}}:\d{{2}}(?::\d{{2}})?') then 4 when lower(cell) in ('true', 'false', 'yes', 'no', 'si', 'sí', 'verdadero', 'falso') then 8 else 16 end as bit from c where name is not null),
    b as (select file_id, name, bit_or(bit) as bits from k where bit is not null group by 1, 2),
    d as (select file_id, string_agg(x, ',' order by x) as described, count(*) as n from (select f.file_id, u.name || ':' || coalesce(case bits when 1 then 'whole' when 2 then 'decimal' when 3 then 'decimal' when 4 then 'clock' when 8 then 'truth' else case when bits is not null then 'text' end end, '?') as x
          from f join (select file_id, unnest(names) as name from h) u using (file_id) left join b on b.file_id = f.file_id and b.name = u.name) group by 1),
    p as (select f.file_id, dataset_id, published_at, sha256(described) as fingerprint, n::int as n_fields from f join d using (file_id)),
    o as (select *, lag(file_id) over w as file_before, coalesce((lag(fingerprint) over w <> fingerprint)::int, 1) as changed from p window w as (partition by dataset_id order by published_at, file_id))
    select file_id, dataset_id, file_before, sum(changed) over (partition by dataset_id order by published_at, file_id rows unbounded preceding)::int as version, fingerprint, n_fields from o"""


#: The spellings of units in the driver's table, by unit, and what a unit is in km/h.
_SPELLINGS = {"km/h": ("km/h", "kph", "kmh", "km / h", "km/hora"), "mph": ("mph", "m.p.h.", "mi/h", "miles per hour"), "knot": ("knots", "kn", "kt"), "m/s": ("m/s", "mps", "m s-1", "metres per second"), "0.1 km/h": ("hm/h", "× 0.1 km/h", "x0.1 km/h", "(0.1 km/h)")}
_IN_KMH = {"km/h": "1.0", "mph": "1.609344", "knot": "1.852", "m/s": "3.6", "0.1 km/h": "0.1"}
_NUMBER = r"\d+(?:[.,]\d+)?"
_SPEEDS_SQL = rf"""
    with d(sp, unit) as (values {", ".join(f"('{x}', '{u}')" for u, xs in _SPELLINGS.items() for x in xs)}), f(unit, factor) as (values {", ".join(f"('{u}', {v}::double)" for u, v in _IN_KMH.items())}),
    q as (select edge_row, source, unnest(list_filter(string_split_regex(coalesce(spd_raw, ''), '[;|]'), lambda p: regexp_matches(p, '\d'))) as t from edges),
    g0 as (select edge_row, source, replace(regexp_extract(t, '{_NUMBER}'), ',', '.')::double as v, trim(regexp_extract(t, '(?s){_NUMBER}(.*)$', 1), ' ') as after,
           trim(regexp_replace(regexp_extract(t, '(?s)^([^\d]*)\d', 1), '(?i)\b(?:max|min|limit|approx|ca|about|aprox|speed|maxspeed|lim)\b\.?|[~<>=:≈]', ' ', 'g'), ' ') as before from q),
    g as (select edge_row, source, v, lower(case when after <> '' then after else before end) as sp from g0),
    n as (select g.*, d.unit from g left join d using (sp)),
    hb as (select source, arg_max(unit, {{'n': n, 'u': unit}}) as habit from (select source, unit, count(*) as n from n where unit is not null and source is not null group by 1, 2) group by 1),
    own as (select edge_row, coalesce(habit, 'km/h') as own, case when maxspeed >= 0 and not isnan(maxspeed) then maxspeed end as reading from edges left join hb using (source)),
    m as (select n.edge_row, n.sp, n.unit, case when n.unit is not null then n.unit when n.sp = '' then own.own end as meant, v from n join own using (edge_row)),
    x as (select m.*, round(v * factor, 9) as x from m left join f on f.unit = m.meant),
    b as (select edge_row, max(case when x is not null then {{'x': x, 'u': meant}} end) as best, count(x) as n, max(case when sp <> '' and unit is null then sp end) as unknown_unit, bool_or(unit is not null) as named from x group by 1),
    r as (select own.edge_row, best, coalesce(n, 0) as n, unknown_unit, case when not coalesce(named, false) and reading is not null then {{'x': round(reading * factor, 9), 'u': own.own}} end as plain from own left join b using (edge_row) join f on f.unit = own.own),
    t as (select edge_row, case when best is null or (plain is not null and plain.x > best.x) then coalesce(plain, best) else best end as top, (n + (plain is not null)::int)::int as n_given, unknown_unit from r)"""


_PASSAGE = ("edge_id", "trip_id", "departure_time", "arrival_time", "travel_time_seconds", "service_date")


def _clock_sql(name: str) -> str:
    """The seconds of a clock that can be, in SQL; null for others."""
    good = f"regexp_full_match(trim({name}), '\\s*\\d{{1,2}}\\s*:\\s*[0-5]?\\d\\s*:\\s*[0-5]?\\d\\s*') and regexp_extract({name}, '\\d+')::int <= 47"
    part = lambda i: f"trim(split_part(trim({name}), ':', {i}))::int"
    return f"case when {good} then {part(1)} * 3600 + {part(2)} * 60 + {part(3)} end"


_REASONS_SQL = f"""
    with c as (select {", ".join(_PASSAGE)}, min(sched_row) as id, list(sched_row) as ids from schedule group by {", ".join(_PASSAGE)}),
    k as (select id, ids, edge_id, {_clock_sql('departure_time')} as dep, {_clock_sql('arrival_time')} as arr, coalesce(trim(departure_time), '') <> '' as gd, coalesce(trim(arrival_time), '') <> '' as ga, case when not isnan(travel_time_seconds) then travel_time_seconds end as reading, service_date from c),
    r as (select id, ids, edge_id, reading, (arr - dep)::double as took, (gd and dep is null) or (ga and arr is null) as no_such_clock, datediff('day', date '2000-01-01', service_date) * 86400.0 + coalesce(dep, arr - greatest(coalesce(reading, 0), 0)) as at_ from k),
    l as (select *, case when reading > 0 then ln(reading) end as lg, case when took > 0 then ln(took) end as lt from r),
    s as (select edge_id, quantile_disc(lg, 0.5) as level, (quantile_disc(lg, 0.75) - quantile_disc(lg, 0.25)) / 2 as scatter from l where edge_id is not null group by 1),
    t as (select l.*, level, scatter from l join s using (edge_id)),
    w1 as (select *, median(lg) over (partition by edge_id order by at_, id rows between 15 preceding and 15 following) as middle from t where at_ is not null),
    w2 as (select *, median(abs(lg - middle)) over (partition by edge_id order by at_, id rows between 15 preceding and 15 following) as rolled from w1),
    w3 as (select *, greatest(3.5 * 1.4826 * greatest(rolled, scatter), ln(1.8)) as width, coalesce(middle, level) as m from w2),
    w4 as (select *, coalesce(abs(lg - m) > width, false) as far, coalesce(abs(lt - m) > width, false) as tfar from w3),
    v as (select *, case when not (tfar and not far) then coalesce(reading, took) end as value from w4),
    i as (select *, sum((value <> b)::int) over (partition by edge_id order by at_, id) as island from (select *, lag(value) over (partition by edge_id order by at_, id) as b from v where value is not null)),
    z as (select id from (select id, scatter, count(*) over (partition by edge_id, coalesce(island, 0)) as size from i) where size >= 8 and scatter > 0.004),
    u as (select id, coalesce(abs(lg - level) > greatest(3.5 * 1.4826 * scatter, ln(1.8)), false) as far, coalesce(abs(lt - level) > greatest(3.5 * 1.4826 * scatter, ln(1.8)), false) as tfar from t where at_ is null),
    j as (select id, far, tfar from w4 union all select * from u),
    o as (select r.ids, concat_ws('|', case when no_such_clock then 'no_such_clock' end, case when reading <= 0 or took <= 0 then 'no_duration' end, case when far then 'spike' end, case when tfar then 'clock_spike' end, case when z.id is not null then 'stuck' end) as reasons from r left join j using (id) left join z using (id))"""

_NEAR_SQL = f"""
    with p as (select distinct node_id, x, y from nodes where node_id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)),
    seg as (select part_no, unnest(list_transform(range(1, len(ring)), lambda i: {{'a': ring[i].x, 'b': ring[i].y, 'c': ring[i + 1].x, 'd': ring[i + 1].y}})) as s from area_parts),
    q as (select distinct node_id, x, y from nodes where in_area is null and node_id is not null and x is not null and y is not null and not isnan(x) and not isnan(y))
    select distinct 'near' as kind, a.node_id as id_a, b.node_id as id_b from p a join p b on a.node_id < b.node_id and abs(a.x - b.x) <= {NEAR_METRES} and abs(a.y - b.y) <= {NEAR_METRES} where sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {NEAR_METRES}
    union all select distinct 'inside', part_no, node_id from (select node_id, x, y, part_no from q, seg where (s.b > y) <> (s.d > y) and x < (s.c - s.a) * (y - s.b) / (s.d - s.b) + s.a group by all having count(*) % 2 = 1)"""


_BLANKS = r"[\s\x{00A0}\x{200B}\x{FEFF}]"
_QUOTED = r"""\x22(?:[^\x22]|\x22\x22)*\x22|\x27[^\x27]*\x27"""
_TOKENS = rf"{_QUOTED}|(?i:n/a)|[^;,|/+\t\n\r\x22\x27]+|[\x22\x27]"


def _values_sql(least: int) -> str:
    """The values of packed fields, in SQL: quoted or bare tokens, a list opened by taking its brackets off."""
    strip = lambda t: f"regexp_replace({t}, '^{_BLANKS}+|{_BLANKS}+$', '', 'g')"
    words = ", ".join(f"'{w}'" for w in PLACEHOLDERS)
    return rf"""
        with f as (select edge_row, field_name, {strip("v")} as v from (unpivot (select edge_row, highway, hwy_raw, lanes from edges) on highway, hwy_raw, lanes into name field_name value v)),
        o as (select edge_row, field_name, case when regexp_full_match(v, '(?s)[\[{{(<].*[\]}})>]') then v[2:-2] else v end as v from f),
        t as (select edge_row, field_name, list_transform(regexp_extract_all(v, '{_TOKENS}'), lambda x: {strip("x")}) as ts from o),
        i as (select edge_row, field_name, list_filter(list_transform(ts, lambda x: case when regexp_full_match(x, '(?s){_QUOTED}') then {strip("x[2:-2]")} else x end), lambda x: x <> '' and not list_contains([{words}], lower(x)) and not regexp_full_match(x, '[\x22\x27]')) as items from t)
        select edge_row, field_name, unnest(generate_series(1, len(items)))::int as pos, unnest(items) as item from i where len(items) >= {least}"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _values_sql(2),
        "p3_found": f"{_REASONS_SQL} select unnest(ids) as sched_row from o where reasons <> ''",
        "p3_reasons": f"{_REASONS_SQL} select unnest(ids) as sched_row, reasons from o where reasons <> ''",
        "p4_found": _NEAR_SQL,
        "p6_versions": _VERSIONS_SQL,
        "p7_speeds": f"{_SPEEDS_SQL} select edge_row, top.u as unit, round(top.x, 3) as kmh, n_given, unknown_unit from t",
        "p7_found": f"{_SPEEDS_SQL} select edge_row, round(top.x)::bigint as kmh from t where top.u <> 'km/h'",
    }
