from railweave.operators.packed import split_packed
from railweave.streaming.incremental import append_new_files


def test_new_files_are_read_once(spark, rows, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    split = lambda df: split_packed(df, "k", ["a"])
    rows("k long, a string", (1, "x1;y1")).coalesce(1).write.parquet(source)
    assert append_new_files(spark, source, "k long, a string", split, target, mark) == 1
    rows("k long, a string", (2, "p;q;r")).coalesce(1).write.mode("append").parquet(source)
    assert append_new_files(spark, source, "k long, a string", split, target, mark) == 1
    assert append_new_files(spark, source, "k long, a string", split, target, mark) == 0
    assert sorted((r["k"], r["item"]) for r in spark.read.parquet(target).collect()) == [(1, "x1"), (1, "y1"), (2, "p"), (2, "q"), (2, "r")]
