import datetime as dt

from pyspark.sql import functions as F

from railweave.operators.drift import cell_kind, cells, chained_names, migration_rules, migration_steps, one_table, versions


def feed(rows, *files):
    lines, about = [], []
    for k, (dataset, text) in enumerate(files):
        lines += [(k, f"f{k}", i, line, "clash") for i, line in enumerate(text.split("\n"), 1)]
        about += [(k, dataset, dt.datetime(2018, 1, 1 + k), f"f{k}")] * 2
    return rows("file_id long, file_name string, line_no int, line string, names string", *lines[::-1]), rows("file_id long, dataset_id long, published_at timestamp, file_name string", *about)


def steps(rows, *files):
    f, r = versions(*feed(rows, *files))
    return {tuple(x) for x in migration_steps(f, r).collect()}


A = "trip_id,stop_sequence,arrival_time,code\nt1,1,07:00:00,3\nt1,2,07:05:00,1\nt2,1,08:00:00,0\nt2,2,08:09:00,2"


def test_each_kind_of_change(rows):
    renamed = A.replace("stop_sequence", "seq_no")
    retyped = A.replace(",1,", ",s1,").replace(",2,", ",s2,").replace(",code", ",code")
    assert steps(rows, (1, A), (1, renamed)) == {(1, "renamed", "stop_sequence", "seq_no")}
    assert steps(rows, (1, A), (1, retyped)) == {(1, "retyped", "stop_sequence", "stop_sequence")}
    without = "\n".join(",".join(x.split(",")[:3]) for x in A.split("\n"))
    assert steps(rows, (1, A), (1, without)) == {(1, "removed", "code", "")}
    assert steps(rows, (1, without), (1, A)) == {(1, "added", "", "code")}


def test_rename_with_another_writing_and_other_field_in_its_place(rows):
    assert steps(rows, (1, A), (1, A.replace("stop_sequence", "orden").replace(",1,", ",001,").replace(",2,", ",002,"))) == {(1, "renamed", "stop_sequence", "orden")}
    other = A.replace("code", "flag").replace(",3\n", ",0\n").replace(",1\nt2", ",9\nt2").replace(",0\nt2,2", ",8\nt2,2").replace(":00,2", ":00,7")
    assert steps(rows, (1, A), (1, other)) == {(1, "removed", "code", ""), (1, "added", "", "flag")}


def test_writing_order_and_separators_are_no_change(rows):
    swapped = "\n".join(";".join(f'" {c} "' for c in x.split(",")[::-1]) for x in A.split("\n")).upper().replace("T1", "t1").replace("T2", "t2")
    assert steps(rows, (1, A), (1, "﻿" + A), (1, swapped), (1, A.replace(",", "\t"))) == set()


def test_datasets_are_apart_and_unknown_files_left_out(rows):
    lines, about = feed(rows, (1, A), (2, A.replace("code", "zone")))
    f, r = versions(lines.unionByName(lines.where("file_id = 0").withColumn("file_id", F.lit(77).cast("long"))), about)
    assert migration_steps(f, r).count() == 0 and f.count() == 2
    assert {x["version"] for x in f.collect()} == {1}


def test_one_table_through_the_chain(rows):
    f, r = versions(*feed(rows, (1, A), (1, A.replace("stop_sequence", "seq_no").replace(",1,", ",s1,")), (1, A.replace("stop_sequence", "orden").replace("code", "extra"))))
    routes = chained_names(f, migration_steps(f, r))
    table = one_table(f, r, routes)
    assert table.count() == 12
    named = {(x["file_id"], x["name"]): x["canonical"] for x in routes.collect()}
    canon = named[0, "stop_sequence"]
    assert named[1, "seq_no"] == named[2, "orden"] == canon
    assert {x[0] for x in table.select(canon).distinct().collect()} == {1, 2}


def test_casts_defaults_and_rules(rows):
    whole = "trip_id,dist,at,ok,zone\nt1,5,07:00:00,true,a\nt1,6,07:05:00,false,b"
    other = "trip_id,dist,at,ok\nt1,5.5,25260,1\nt1,x,oops,0"
    f, r = versions(*feed(rows, (1, whole), (1, whole), (1, other)))
    routes = chained_names(f, migration_steps(f, r))
    table = one_table(f, r, routes, {"zone": "none"})
    kinds = dict(table.dtypes)
    assert (kinds["dist"], kinds["at"], kinds["ok"], kinds["zone"]) == ("bigint", "string", "boolean", "string")
    out = {(x["file_id"], x["line_no"]): x for x in table.collect()}
    assert (out[0, 2]["dist"], out[0, 2]["at"], out[0, 2]["ok"], out[0, 2]["zone"]) == (5, "07:00:00", True, "a")
    assert (out[2, 2]["dist"], out[2, 2]["at"], out[2, 2]["ok"], out[2, 2]["zone"]) == (None, "07:01:00", True, "none")
    assert out[2, 2]["misfit_cells"] == {"dist": "5.5"} and out[2, 3]["misfit_cells"] == {"dist": "x", "at": "oops"} and out[2, 3]["misfits"] == ["at", "dist"]
    rules = {tuple(x) for x in migration_rules(f, routes, {"zone": "none"}).drop("schema_version").collect()}
    assert rules == {(2, "cast", "dist", "text", "whole"), (2, "cast", "at", "text", "clock"), (2, "cast", "ok", "whole", "truth"), (2, "default", "zone", "", "none")}


def test_a_rename_is_seen_through_lines_put_in_or_taken_out(rows):
    body = [f"t{i // 4},{i % 4},{7 + i % 9:02d}:{i % 60:02d}:00,{i * i % 37}" for i in range(40)]
    head = "trip_id,stop_sequence,arrival_time,code"
    longer = ["t99,0,05:00:00,7", *body[:12], *body[13:]]
    new = "\n".join(["trip_id,stop_sequence,arrival_time,zone", *longer])
    assert steps(rows, (1, "\n".join([head, *body])), (1, new)) == {(1, "renamed", "code", "zone")}


def test_fields_of_few_values_that_agree_by_chance_are_no_rename(rows):
    old, new = "aaabaabaaaabaa", "abaaaabaaabaaa"
    line = lambda i, c: f"t{i},{i},{c}"
    first = "\n".join(["trip_id,stop_sequence,pickup", *[line(i, c) for i, c in enumerate(old)]])
    after = "\n".join(["trip_id,stop_sequence,zone", *[line(i, c) for i, c in enumerate(new)]])
    same = sum(a == b for a, b in zip(old, new))
    assert 0.6 <= same / len(old) < 0.75
    assert steps(rows, (1, first), (1, after)) == {(1, "removed", "pickup", ""), (1, "added", "", "zone")}


def test_very_long_cells(rows):
    quoted = 'a,"' + 'x, ""y"" ' * 110_000 + '",c'
    spaced = '"a"' + " " * 200_000 + ',"b;c"'
    open_ = '"' + "a,b" * 30_000
    out = rows("l string", (quoted,), (spaced,), (open_,)).select(cells(F.col("l"), F.lit(",")).alias("c")).collect()
    assert len(out[0]["c"]) == 3 and len(out[0]["c"][1]) > 700_000 and out[0]["c"][1].startswith('x, "y" x')
    assert out[1]["c"] == ["a", "b;c"] and len(out[2]["c"]) == 30_001


def test_empty_tables_blank_lines_and_kinds(rows):
    lines, about = feed(rows, (1, A + "\n\n  "))
    f, r = versions(lines, about)
    assert r.count() == 4
    f, r = versions(lines.limit(0), about.limit(0))
    assert migration_steps(f, r).count() == 0
    kinds = rows("c string", ("12",), ("-3",), ("1.5",), ("25:00:10",), ("True",), ("x",), ("",)).select(cell_kind(F.col("c")).alias("k")).collect()
    assert [k["k"] for k in kinds] == ["whole", "whole", "decimal", "clock", "truth", "text", None]


def test_cells_with_quotes(rows):
    lines = {'a,b,c': ["a", "b", "c"], ' "a, b" ,c': ["a, b", "c"], ',"x,y",': ["", "x,y", ""], '"a","b"': ["a", "b"], 'un"closed, b,"c,d"': ['un"closed', "b", "c,d"], "": [""]}
    out = rows("l string", *[(k,) for k in lines]).select(cells(F.col("l"), F.lit(","))).collect()
    assert [r[0] for r in out] == list(lines.values())
    tabs = rows("l string", ('"a"\t \t"b"',), ('"a"\t\t"b, c"\t',)).select(cells(F.col("l"), F.lit("\t"))).collect()
    assert [r[0] for r in tabs] == [["a", "", "b"], ["a", "", "b, c", ""]]
