"""Percentiles of very large numeric columns by radix selection.

A double becomes an integer whose unsigned order is the number's order.  A histogram of the top digit per
group, counted before the shuffle, shows which digit holds each wanted rank; the column is read again and
only values under that digit are counted by the next digit, and so on, until a digit holds one number only.
What is shuffled are histograms: it doesn't matter how many different numbers there are.  Histograms add
up, so results of separate partitions or days can be combined: the digests of ``day_digests`` are such
histograms at a fixed precision, and the selection itself is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.scale import cut, lookup_join

#: Bits of the digits that are followed, highest first: sign, exponent and the top of the fraction; then the rest.
DIGITS = (16, 16, 16, 16)
#: Bits that a digest keeps: sign, exponent and 13 bits of fraction, so a percentile's relative error is at most 2**-13.
DIGEST_BITS = 25


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Order-preserving integers (as signed 64 bit) of doubles; -0.0 counts as 0.0."""
    bits = (np.asarray(values, float) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_ordered_bits(keys: np.ndarray) -> np.ndarray:
    keys = np.asarray(keys, np.int64)
    return np.where(keys < 0, keys ^ np.int64(0x7FFFFFFFFFFFFFFF), keys).view(np.float64)


def _to_key(number: str) -> Column:
    return F.pandas_udf(lambda v: pd.Series(ordered_bits(v.to_numpy(float))), "long")(number)


def _to_value(key: Column | str) -> Column:
    return F.pandas_udf(lambda k: pd.Series(from_ordered_bits(k.to_numpy(np.int64))), "double")(key)


def _numbers(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``(groups..., _v, n)``: the numbers of ``df``, each counting once; nulls and NaN are left out and -0.0 is 0.0."""
    number = F.col(value).cast("double")
    return df.where(number.isNotNull() & ~F.isnan(number)).select(*groups, (number + 0.0).alias("_v"), F.lit(1).cast("long").alias("n"))


def _hashes(groups: Sequence[str]) -> list[Column]:
    """One hidden number of 128 bits for a group, so that null group values are matched like others."""
    same = [F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups]
    return [F.xxhash64(*same, F.lit(1)).alias("_g"), F.xxhash64(F.lit(2), *same).alias("_h")]


def _ends(column: Column, number: bool) -> Column:
    """``column`` (a key) in the rows' own domain; keys beyond those of the infinities are no numbers."""
    if not number:
        return column
    least, most = (F.lit(int(k)).cast("long") for k in ordered_bits(np.array([-np.inf, np.inf])))
    return _to_value(F.least(F.greatest(column, least), most))


def select_ranks(rows: DataFrame, groups: Sequence[str], percents: Sequence[float], digits: Sequence[int] = DIGITS) -> DataFrame:
    """``(groups..., percent, key, n)``: the key at each percentile of each group, ``n`` the group's size.

    ``rows`` holds ``(groups..., _v double, n)``, numbers, or ``(groups..., key long, n)``, from any number of
    partitions or days together, ``n`` being how often each counts.  It is read once for each digit that must
    be followed, so it should be cheap to read.  The percentile p is the value at rank ceil(p * n), at least 1
    (the discrete inverse of the distribution).  Null group values are groups of their own.
    """
    if sum(digits) != 64:
        raise ValueError("the digits must make 64 bits")
    groups, own = list(groups), "_v" if "_v" in rows.columns else "key"
    turned = F.lit(-(1 << 63)).cast("long")
    key = _to_key("_v") if own == "_v" else F.col("key")
    follow: DataFrame | None = None
    done: list[DataFrame] = []
    shift = 64
    for digit in digits:
        shift -= digit
        base = rows.select(*groups, *_hashes(groups), own, "n")
        if follow is not None:
            # only what lies under a followed digit is turned into keys and counted
            under = follow.groupBy("_g", "_h").agg(F.collect_set(F.struct("lo", "hi")).alias("under"))
            base = lookup_join(base, cut(under), ["_g", "_h"], "inner").where(F.exists("under", lambda r: (F.col(own) >= r["lo"]) & (F.col(own) <= r["hi"]))).drop("under")
        base = base.withColumn("_k", key.bitwiseXOR(turned))
        above = F.shiftrightunsigned("_k", shift + digit) if shift + digit < 64 else F.lit(0).cast("long")
        held = base.groupBy(*groups, "_g", "_h", above.alias("prefix"), F.shiftrightunsigned("_k", shift).bitwiseAND(F.lit((1 << digit) - 1)).alias("digit"))
        histogram = held.agg(F.sum("n").alias("n"), F.min(own).alias("least"), F.max(own).alias("most"))
        if follow is None:
            histogram = cut(histogram)
            sizes = histogram.groupBy(*groups, "_g", "_h").agg(F.sum("n").alias("size"))
            wanted = sizes.select("*", F.explode(F.array(*[F.lit(float(p)) for p in percents])).alias("percent"), F.lit(0).cast("long").alias("prefix"))
            wanted = wanted.withColumn("rank", F.greatest(F.ceil(F.round(F.col("percent") * F.col("size"), 9)), F.lit(1)))
        else:
            wanted = follow.drop("lo", "hi")
        # a histogram's digits are at most 2**16, however many rows the group has
        upto = Window.partitionBy("_g", "_h", "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = histogram.drop(*groups).withColumn("high", F.sum("n").over(upto)).withColumn("low", F.col("high") - F.col("n")).drop("n")
        hit = wanted.join(counted, ["_g", "_h", "prefix"]).where((F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")))
        hit = cut(hit.withColumn("rank", F.col("rank") - F.col("low")).withColumn("prefix", F.shiftleft("prefix", digit).bitwiseOR(F.col("digit"))).drop("low", "high", "digit"))
        # a digit that holds one number is followed no further
        done.append(hit.where(F.col("least") == F.col("most")).select(*groups, "percent", F.col("least").alias("_found"), F.col("size").alias("n")))
        first = F.shiftleft("prefix", shift) if shift else F.col("prefix")
        last = first.bitwiseOR(F.lit((1 << shift) - 1))
        open_ = hit.where(F.col("least") != F.col("most")).drop("least", "most")
        if not shift or open_.isEmpty():
            break
        follow = cut(open_.withColumn("lo", _ends(first.bitwiseXOR(turned), own == "_v")).withColumn("hi", _ends(last.bitwiseXOR(turned), own == "_v")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.select(*groups, "percent", (_to_key("_found") if own == "_v" else F.col("_found")).alias("key"), "n")


def percentiles(df: DataFrame, groups: Sequence[str], value: str, percents: Sequence[float]) -> DataFrame:
    """``(groups..., percent, value, n)``: exact percentiles of ``value`` per group.

    Nulls and NaN aren't counted, so a group of nothing else has no row; infinities are the ends of the
    order; ties and repeated rows count each; groups of any size are counted in parts.  Extra columns are
    ignored; an empty table gives no row.
    """
    found = select_ranks(_numbers(df, groups, value), groups, percents)
    return found.select(*groups, "percent", _to_value("key").alias("value"), "n")


def day_digests(df: DataFrame, day: str, groups: Sequence[str], value: str, bits: int = DIGEST_BITS) -> DataFrame:
    """``(day, groups..., bucket, n)``: a histogram of the top ``bits`` bits per day and group.

    Digests of separate days (or partitions) are combined by ``union`` alone; ``digest_percentiles``
    reads percentiles from any union of them with a relative error of at most ``2 ** -(bits - 12)``.
    """
    rows = _numbers(df, [day, *groups], value)
    return rows.withColumn("bucket", F.shiftright(_to_key("_v"), 64 - bits)).groupBy(day, *groups, "bucket").agg(F.count("*").alias("n"))


def digest_percentiles(digests: DataFrame, groups: Sequence[str], percents: Sequence[float], bits: int = DIGEST_BITS) -> DataFrame:
    """``(groups..., percent, low, value, high, n)``: percentiles from digests; the exact one lies in [low, high]."""
    groups = list(groups)
    keys = cut(digests.select(*groups, F.shiftleft("bucket", 64 - bits).alias("key"), "n").groupBy(*groups, "key").agg(F.sum("n").alias("n")))
    found = select_ranks(keys, groups, percents)
    # keys beyond those of the infinities are no numbers
    ends = [F.lit(int(k)).cast("long") for k in ordered_bits(np.array([-np.inf, np.inf]))]
    number = lambda key: _to_value(F.least(F.greatest(key, ends[0]), ends[1]))
    last, middle = F.col("key").bitwiseOR(F.lit((1 << (64 - bits)) - 1)), F.col("key").bitwiseOR(F.lit(1 << (63 - bits)))
    return found.select(*groups, "percent", number(F.col("key")).alias("low"), number(middle).alias("value"), number(last).alias("high"), "n")
