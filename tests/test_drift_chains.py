from test_drift import A, feed

from railweave.operators.drift import chained_names, migration_steps, one_table, versions


def test_a_rename_of_one_dataset_merges_no_fields_of_another(rows):
    both = "trip_id,stop_sequence,arrival_time,code,kind\nt7,1,07:00:00,5,9\nt7,x,07:05:00,6,8"
    f, r = versions(*feed(rows, (1, A), (1, A.replace("code", "kind").replace("stop_sequence", "orden")), (2, both)))
    steps = migration_steps(f, r)
    assert {(x["old_field"], x["new_field"]) for x in steps.collect()} == {("code", "kind"), ("stop_sequence", "orden")}
    names = chained_names(f, steps)
    routes = {(x["file_id"], x["name"]): x["canonical"] for x in names.collect()}
    assert routes[0, "code"] == routes[1, "kind"] and routes[1, "orden"] == "stop_sequence"
    assert routes[2, "code"] == "code" and routes[2, "kind"] == "kind"
    out = {(x["file_id"], x["line_no"]): x for x in one_table(f, r, names).collect()}
    assert len(out) == 10 and (out[2, 2]["code"], out[2, 2]["kind"]) == (5, 9)
    assert out[2, 3]["stop_sequence"] is None and out[2, 3]["misfits"] == ["stop_sequence"] and out[2, 2]["misfits"] == []
    assert out[1, 2]["stop_sequence"] == 1 and out[1, 2][routes[0, "code"]] == 3
