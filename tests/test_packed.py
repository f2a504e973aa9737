from pyspark.sql import functions as F

from railweave.operators.packed import parse_packed, split_packed


def parsed(rows, *texts):
    out = rows("id int, t string", *enumerate(texts)).select("id", parse_packed(F.col("t")).alias("v")).orderBy("id").collect()
    return [[(v["pos"], v["item"]) for v in r["v"]] for r in out]


def items(rows, text):
    return [v for _, v in parsed(rows, text)[0]]


def test_delimiters_brackets_and_quotes(rows):
    cases = {
        "a;b": ["a", "b"],
        "a; b , c|d / e + f": ["a", "b", "c", "d", "e", "f"],
        '["a", "b"]': ["a", "b"],
        "{a,b}": ["a", "b"],
        "['x, y', 'z']": ["x, y", "z"],
        'k / "p | q" / l': ["k", "p | q", "l"],
        "a\tb\nc": ["a", "b", "c"],
        "two words;b": ["two words", "b"],
        '"all; of it"': ["all; of it"],
    }
    found = parsed(rows, *cases)
    assert [[v for _, v in f] for f in found] == list(cases.values())
    assert found[0] == [(1, "a"), (2, "b")]


def test_empty_values_are_not_counted_and_placeholders_are_none(rows):
    assert parsed(rows, ";;a;;b;") == [[(1, "a"), (2, "b")]]
    assert items(rows, "a;n/a;b") == ["a", "b"]
    assert items(rows, "N/A") == [] and items(rows, "none") == []
    assert parsed(rows, None, "", "  ", ";;") == [[], [], [], []]


def test_malformed_quotes_backtrack_and_are_flagged(rows):
    out = rows("t string", ('"a;b',), ("a;b",)).select(parse_packed(F.col("t")).alias("v")).collect()
    assert [v["item"] for v in out[0]["v"]] == ["a", "b"]
    assert [v["malformed"] for v in out[0]["v"]] == [True, False]
    assert not any(v["malformed"] for v in out[1]["v"])


def test_lists_in_lists_asides_and_doubled_quotes(rows):
    cases = {
        "[a;b];[c;d]": ["a", "b", "c", "d"],
        "a;[b,c];d": ["a", "b", "c", "d"],
        "(a;b);c": ["a", "b", "c"],
        "[[a,b],{c,(d)}]": ["a", "b", "c", "d"],
        "a,b (c;d)": ["a", "b (c;d)"],
        'a "x; y";"b; ""c; d"" e";f': ['a "x', "y", 'b; "c; d" e', "f"],
        '["p] q";r];s': ["p] q", "r", "s"],
        "grade (2);k": ["grade (2)", "k"],
    }
    out = rows("id int, t string", *enumerate(cases)).select("id", parse_packed(F.col("t")).alias("v")).orderBy("id").collect()
    assert [[v["item"] for v in r["v"]] for r in out] == list(cases.values())
    assert [any(v["malformed"] for v in r["v"]) for r in out] == [False] * 5 + [True, False, False]


def test_brackets_that_arent_closed_backtrack_and_are_flagged(rows):
    out = rows("t string", ("[a;b",), ("a;b]",), ("[a;(b];c)",)).select(parse_packed(F.col("t")).alias("v")).collect()
    assert [[(v["item"], v["malformed"]) for v in r["v"]] for r in out[:2]] == [[("a", True), ("b", False)], [("a", False), ("b", True)]]
    assert [v["item"] for v in out[2]["v"]] == ["a", "b", "c"]


def test_table_with_nulls_repeats_and_clashing_names(rows):
    df = rows("k long, a string, pos int, item string", (1, "x;y", 9, "z"), (1, "x;y", 9, "z"), (2, None, 0, ""), (None, "p;q", 0, ""), (3, "one", 0, ""))
    out = [tuple(r) for r in split_packed(df, "k", ["a"], least=2).drop("malformed").collect()]
    assert sorted(out, key=str) == sorted([(1, "a", 1, "x"), (1, "a", 2, "y")] * 2 + [(None, "a", 1, "p"), (None, "a", 2, "q")], key=str)
    assert split_packed(df.limit(0), "k", ["a"]).count() == 0


def test_very_long_text(rows):
    text = ";".join(f"v{i}" for i in range(20_000))
    assert split_packed(rows("k long, a string", (1, text)), "k", ["a"]).count() == 20_000
    quoted, open_, listed = '"' + 'x;""y"" ' * 100_000 + '";b', '"' + "a;" * 50_000, "[" + "(p;q)," * 30_000 + "]"
    out = split_packed(rows("k long, a string", (1, quoted), (2, open_), (3, listed), (4, "(" * 5_000)), "k", ["a"]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in out} == {1: 2, 2: 50_000, 3: 60_000}


def test_no_shuffle(rows):
    plan = split_packed(rows("k long, a string", (1, "a;b")), "k", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
