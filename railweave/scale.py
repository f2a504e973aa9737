"""Helpers that keep plans safe at scale: lineage cuts and size-checked lookups."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows and bytes (as written out in text) up to which a lookup table is broadcast; larger ones are joined by shuffle.
LOOKUP_ROWS, LOOKUP_BYTES = 200_000, 16 << 20

#: A key is hot if it has more than one in so many of all rows; there can't be more hot keys than that.
HOT_SHARE = 1_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset and the session runs on one
    machine, as in tests, a temporary folder is made; on a cluster each executor would write to its own disk,
    so there an unset folder raises ``ValueError``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.getCheckpointDir() and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = spark.sparkContext.getCheckpointDir() or os.path.join(tempfile.gettempdir(), "railweave-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def put_shared(spark: SparkSession, local: str, *place: str) -> str:
    """The address of a copy of the driver's file ``local`` in the shared folder, whatever file system that is on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path("/".join([checkpoint_dir(spark).rstrip("/"), *place]))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(target):
        partial = hadoop.Path(f"{target.toString()}.{os.getpid()}")
        files.copyFromLocalFile(False, True, hadoop.Path(f"file://{os.path.abspath(local)}"), partial)
        files.rename(partial, target)
    return target.toString()


def drop_shared(spark: SparkSession, address: str) -> None:
    """Removes a copy that ``put_shared`` made."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(address)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read from there: its lineage ends here.

    The files are shared by all executors, so that the loss of one loses nothing.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, max_rows: int = LOOKUP_ROWS, max_bytes: int = LOOKUP_BYTES) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows and ``max_bytes`` bytes; no more than that is looked at."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    seen = df.limit(max_rows + 1).agg(F.count("*").alias("n"), F.coalesce(size, F.lit(0)).alias("b")).first()
    return seen["n"] <= max_rows and seen["b"] <= max_bytes


def lookup_join(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", *, max_rows: int = LOOKUP_ROWS, max_bytes: int = LOOKUP_BYTES, n_rows: int | None = None) -> DataFrame:
    """Join each row of ``df`` with at most one row of ``small``, whatever the skew of the keys.

    If ``small`` is small by rows and bytes (measured, or ``n_rows`` narrow ones as given) it is broadcast and
    ``df`` isn't shuffled.  Beyond, the rows of each key of ``df`` are counted; a hot key's are spread over as
    many copies of its row of ``small`` as it has thousandths of all rows, so that no task gets much more than
    that (rows that are the same in every column stay together).
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"how must be left, inner, left_semi or left_anti, not {how!r}")
    on = list(on)
    if is_small(small, max_rows, max_bytes) if n_rows is None else n_rows <= max_rows:
        return df.join(F.broadcast(small), on, how)
    total = df.count()
    known = ~reduce(or_, [F.col(c).isNull() for c in on])
    counts = df.where(known).groupBy(*on).agg(F.count("*").alias("_c"))
    # only the hot keys are kept, not the counts of all
    hot = cut(counts.where(F.col("_c") * HOT_SHARE > total).select(*on, F.ceil(F.col("_c") * HOT_SHARE / F.lit(max(total, 1))).alias("_copies")))
    copies = F.coalesce("_copies", F.lit(1).cast("long"))
    # at most HOT_SHARE keys are hot, which bounds both broadcasts
    # a row's copy is told by what it holds, so that a task that runs again after a loss makes the same choice
    told = [c for c, t in df.dtypes if c not in on and "map<" not in t] or on
    spread_ = df.where(known).join(F.broadcast(hot), on, "left").withColumn("_salt", F.pmod(F.xxhash64(*told), copies)).drop("_copies")
    copied = small.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("_copies")
    joined = spread_.join(copied, [*on, "_salt"], how).drop("_salt")
    if how in ("inner", "left_semi"):
        return joined
    # keys with a null match nothing and would all be one task's
    return joined.unionByName(df.where(~known), allowMissingColumns=True)


def numbered(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place in the given order, from 0, without one task sorting all.

    Rows are range-partitioned; a partition's offset is the number of rows before it.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_c"))  # as many rows as partitions
    offset = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    return placed.join(F.broadcast(offset), "_p").withColumn(name, F.col("_o") + F.col("_k")).drop("_p", "_k", "_o")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name beginning with ``stem`` that ``df`` doesn't have."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """``df`` in at least as many partitions as the cluster has cores, for steps heavy on CPU.

    Already wide inputs are left alone: no shuffle is added at scale.
    """
    least = least or df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)
