"""Long exact spans that several records share.

Texts are cut into units, the units' digests are grouped globally, the earliest ranked occurrence is kept
and the rest can be removed at their original offsets.  Lines or paragraphs as units would only find
spans that fill whole lines, while a shared passage may begin and end anywhere.  The units here are
therefore set by content: windows of ``UNIT`` characters that win (have the least digest) among all that
start within ``least - UNIT + 1`` neighbouring places.  Any run of ``least`` characters holds a winning
unit, and the same run holds the same one in every text, so no shared run escapes.

Units that occur in one record only are dropped.  The others are anchors: a unit's surroundings, as far as
a run of ``least`` characters around it can reach, are compared.  Records whose surroundings are equal make
one class; the few classes of a unit are extended pairwise to the left and right of it; a unit with many
classes has every window of ``least`` characters in its surroundings grouped.  Texts are read twice, in the
second pass only those that hold an anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.scale import cut, lookup_join, spread

#: Characters of a shared span, and of a unit.
LEAST, UNIT = 200, 100
#: The classes of a unit that are compared pairwise; with more, their windows are grouped.  Both ways give the same.
CLASSES = 48
#: Characters that are digested at once; a longer text is read in overlapping pieces.
PIECE = 1 << 18
#: Classes in a task's unit of work, and records in a block of a set's members.
WORK, BLOCK = 20_000, 512
#: Rows that a task makes at once.
ROWS = 20_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of the public SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Digests of all windows of a text in a few vector operations: a polynomial in an odd base, modulo 2**64.

    With an odd base the powers have inverses, so a window's digest is a difference of prefix sums times
    the inverse power of its place.
    """

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def windows(self, codes: np.ndarray, size: int) -> np.ndarray:
        """The digest of each window of ``size`` characters."""
        if len(self.powers) < len(codes):
            for name, base in (("powers", _BASE), ("inverse", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
                steps = np.full(len(codes), base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        letters = _mix(codes.astype(np.uint64) + _BASE) * self.powers[: len(codes)]
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum(letters, dtype=np.uint64)]
        return _mix((sums[size:] - sums[:-size]) * self.inverse[: len(codes) - size + 1])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) over each ``width`` neighbours, in log(width) steps."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def winning_units(digests: np.ndarray, neighbours: int, whole: np.ndarray | None = None) -> np.ndarray:
    """The places of ``digests`` that are the least of some ``neighbours`` successive ones (all that tie).

    ``whole``: which of the runs of neighbours count.
    """
    if len(digests) < neighbours:
        return np.zeros(0, int)
    least = _sliding(digests, neighbours, np.minimum)
    if whole is not None:
        least = np.where(whole, least, np.uint64(0))
    around = np.r_[np.zeros(neighbours - 1, digests.dtype), least, np.zeros(neighbours - 1, digests.dtype)]
    return np.flatnonzero((_sliding(around, neighbours, np.maximum) == digests) & (digests > 0))


def _pieces(docs, texts, least: int) -> Iterator[tuple[list, list[int], list[str]]]:
    """``(docs, offsets, pieces)`` of about ``PIECE`` characters: short texts together, long ones in parts that overlap."""
    held: tuple[list, list[int], list[str]] = ([], [], [])
    size = 0
    for doc, text in zip(docs, texts):
        for at in range(0, max(len(text) - least, 0) + 1, PIECE):
            piece = text[at : at + PIECE + least - 1]
            if size and size + len(piece) > PIECE:
                yield held
                held, size = ([], [], []), 0
            for column, value in zip(held, (doc, at, piece)):
                column.append(value)
            size += len(piece)
    if size:
        yield held


def unit_places(texts: DataFrame, least: int = LEAST, unit: int = UNIT) -> DataFrame:
    """``(doc, u, at)``: the winning units of ``texts(doc, text)`` and where they start (in code points, from 0)."""
    kind = texts.schema["doc"].dataType.simpleString()

    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rolling = Rolling()
        for batch in batches:
            for docs, offsets, pieces in _pieces(batch["doc"], batch["text"], least):
                sizes = np.array([len(p) for p in pieces])
                ends = np.cumsum(sizes)
                digests = rolling.windows(code_points("".join(pieces)), unit)
                # only runs inside one piece count
                whole = np.ones(ends[-1] - least + 1, bool)
                for e in ends[:-1]:
                    whole[max(e - least + 1, 0) : e] = False
                places = winning_units(digests, least - unit + 1, whole)
                own = np.searchsorted(ends, places, side="right")
                at = places - (ends - sizes)[own] + np.asarray(offsets)[own]
                found = pd.DataFrame({"doc": np.asarray(docs)[own], "u": digests[places].view(np.int64), "at": at.astype(np.int64)})
                yield found.drop_duplicates() if any(offsets) else found

    return texts.mapInPandas(units, f"doc {kind}, u long, at long")


def _common(a: str, b: str) -> int:
    """How many characters both begin with."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] isn't
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


_CLASS = ["u", "c1", "c2"]


class Shared:
    """What records share, up to the expansion into pairs or stretches.

    ``members(u, c1, c2, doc, at, left, once)``: each anchor with its class; ``classes(u, c1, c2, left, context,
    first, last, n, s1, s2)``: least, greatest and number of a class's records and two sums that tell the set;
    ``links``: two classes of a unit with the characters they share to its left and right;
    ``windows(u, w1, w2, c1, c2, off)``: shared windows of units with many classes.
    """

    def __init__(self, df: DataFrame, key: str, text: str, least: int, unit: int, most_classes: int) -> None:
        if not 0 < unit <= least:
            raise ValueError("a unit must not be longer than the span")
        self.least, self.unit, reach = least, unit, least - unit
        kind = df.schema[key].dataType.simpleString()
        texts = spread(df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.length("text") >= least))
        found = cut(unit_places(texts, least, unit))
        # the count is combined before the shuffle
        common = cut(found.groupBy("u").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("u"))
        anchors = lookup_join(found, common, ["u"], "left_semi").groupBy("doc").agg(F.collect_list(F.struct("at", "u")).alias("anchors"))

        columns = ["u", "left", "context", "doc", "at", "once"]

        def surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out: list[tuple] = []
                for doc, t, places in zip(batch["doc"], batch["text"], batch["anchors"]):
                    seen = set()
                    for p in places:
                        at, u = p["at"], p["u"]
                        start = max(at - reach, 0)
                        context = t[start : at + least]
                        out.append((u, at - start, context, doc, at, (u, at - start, context) not in seen))
                        seen.add((u, at - start, context))
                        if len(out) >= ROWS:
                            yield pd.DataFrame(out, columns=columns)
                            out = []
                yield pd.DataFrame(out, columns=columns)

        held = texts.join(anchors, "doc").mapInPandas(surroundings, f"u long, left int, context string, doc {kind}, at long, once boolean")
        digest = [F.xxhash64(F.lit(seed), "left", "context").alias(f"c{seed}") for seed in (1, 2)]
        held = cut(held.select("u", *digest, "left", "context", "doc", "at", "once"))
        self.members = held.drop("context")
        told = [F.sum(F.when(F.col("once"), F.shiftright(F.xxhash64(F.lit(seed), "doc"), 20)).otherwise(0)).alias(f"s{seed}") for seed in (1, 2)]
        classes = held.groupBy(*_CLASS).agg(F.min("left").alias("left"), F.min("context").alias("context"), F.min("doc").alias("first"), F.max("doc").alias("last"), F.count_if("once").alias("n"), *told)
        self.classes = cut(classes)
        sizes = self.classes.groupBy("u").agg(F.count("*").alias("k")).where("k > 1")
        several = cut(lookup_join(self.classes, sizes, ["u"], "inner").select(*_CLASS, "left", "context", "first", "last", "k"))
        self.links = cut(self._extended(several.where(F.col("k") <= most_classes), kind))
        self.windows = self._windows(several.where(F.col("k") > most_classes))

    def _extended(self, few: DataFrame, kind: str) -> DataFrame:
        """``(u, a1, a2, b1, b2, a_lo, b_lo, size, ...)``: pairs of classes of a unit that share ``least`` characters around it."""
        least, unit = self.least, self.unit

        def linked(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values("u").reset_index(drop=True)
            u = g["u"].to_numpy()
            cuts = np.flatnonzero(np.r_[True, u[1:] != u[:-1], True])
            before = [c[:n][::-1] for c, n in zip(g["context"], g["left"])]
            after = [c[n + unit :] for c, n in zip(g["context"], g["left"])]
            one, two, lefts, rights = [], [], [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                for i in range(a, b):
                    for j in range(i + 1, b):
                        r = _common(after[i], after[j])
                        left = _common(before[i], before[j])
                        if left + unit + r >= least:
                            one.append(i)
                            two.append(j)
                            lefts.append(left)
                            rights.append(r)
            x, y, left = g.iloc[one].reset_index(drop=True), g.iloc[two].reset_index(drop=True), np.array(lefts, "int64")
            return pd.DataFrame({
                "u": x["u"], "a1": x["c1"], "a2": x["c2"], "b1": y["c1"], "b2": y["c2"], "a_lo": x["left"] - left, "b_lo": y["left"] - left, "size": left + unit + np.array(rights, "int64"),
                "a_first": x["first"], "a_last": x["last"], "b_first": y["first"], "b_last": y["last"],
            })

        n = few.count()
        work = few.withColumn("work", F.pmod(F.xxhash64("u"), F.lit(max(1, n // WORK))))
        return work.groupBy("work").applyInPandas(linked, f"u long, a1 long, a2 long, b1 long, b2 long, a_lo long, b_lo long, size long, a_first {kind}, a_last {kind}, b_first {kind}, b_last {kind}")

    def _windows(self, many: DataFrame) -> DataFrame:
        starts = F.sequence(F.lit(0), F.length("context") - self.least)
        each = many.select(*_CLASS, "first", "last", "context", F.explode(starts).alias("off"))
        window = F.substring("context", F.col("off") + 1, F.lit(self.least))
        each = cut(each.select(*_CLASS, "first", "last", "off", F.xxhash64(F.lit(1), window).alias("w1"), F.xxhash64(F.lit(2), window).alias("w2")))
        groups = each.groupBy("u", "w1", "w2").agg(F.min("first").alias("f"), F.max("last").alias("l"), F.count_distinct("c1", "c2").alias("k")).where("k > 1").drop("k")
        return lookup_join(each.drop("first", "last"), cut(groups), ["u", "w1", "w2"], "inner")

    def stretches(self) -> DataFrame:
        """``(doc, start, end, later)``: stretches that stand in another record too; ``later``: in one of smaller key."""
        part = lambda lo, hi, first, last: F.struct(F.col(lo).cast("long").alias("lo") if isinstance(lo, str) else lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), F.col(first).alias("first"), F.col(last).alias("last")).alias("i")
        own = self.classes.where("n > 1").select(*_CLASS, part(F.lit(0), F.length("context"), "first", "last"))
        links = self.links
        one = links.select("u", F.col("a1").alias("c1"), F.col("a2").alias("c2"), part("a_lo", F.col("a_lo") + F.col("size"), "b_first", "b_last"))
        two = links.select("u", F.col("b1").alias("c1"), F.col("b2").alias("c2"), part("b_lo", F.col("b_lo") + F.col("size"), "a_first", "a_last"))
        wide = self.windows.select(*_CLASS, part("off", F.col("off") + self.least, "f", "l"))
        # a class has at most as many parts as it has links or windows, both bounded
        parts = own.unionByName(one).unionByName(two).unionByName(wide).groupBy(*_CLASS).agg(F.collect_list("i").alias("parts"))
        each = lookup_join(self.members.drop("once"), cut(parts), _CLASS, "inner").select("doc", (F.col("at") - F.col("left")).alias("from"), F.explode("parts").alias("i"))
        other = (F.col("i.first") != F.col("doc")) | (F.col("i.last") != F.col("doc"))
        each = each.where(other).select("doc", (F.col("from") + F.col("i.lo")).alias("start"), (F.col("from") + F.col("i.hi")).alias("end"), (F.col("i.first") < F.col("doc")).alias("later"))
        return each.groupBy("doc", "start", "later").agg(F.max("end").alias("end"))

    def sets(self) -> DataFrame:
        """``(k1, k2, n, doc)``: sets of records that share a span, each set once."""
        name = lambda *c: [F.xxhash64(F.lit(seed), *c).alias(f"k{seed}") for seed in (1, 2)]
        own = self.classes.where("n > 1").select(*name("u", "c1", "c2"), *_CLASS)
        key = name("u", "a1", "a2", "b1", "b2")
        links = self.links.select(*key, "u", F.col("a1").alias("c1"), F.col("a2").alias("c2")).unionByName(self.links.select(*key, "u", F.col("b1").alias("c1"), F.col("b2").alias("c2")))
        wide = self.windows.select(*name("u", "w1", "w2"), *_CLASS).distinct()
        parts = cut(own.unionByName(links).unionByName(wide))
        sized = lookup_join(parts, self.classes.select(*_CLASS, "n", "s1", "s2"), _CLASS, "inner").groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in ("n", "s1", "s2")])
        # a long passage has many units with the same records: one of them stands for all
        chosen = sized.groupBy("n", "s1", "s2").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.*", "n")
        held = parts.join(chosen, ["k1", "k2"]).groupBy(*_CLASS).agg(F.collect_list(F.struct("k1", "k2", "n")).alias("sets"))
        return lookup_join(self.members.where("once").select(*_CLASS, "doc"), cut(held), _CLASS, "inner").select(F.explode("sets").alias("s"), "doc").select("s.*", "doc")


def _islands(places: DataFrame) -> DataFrame:
    """``places(doc, start, end)`` as stretches that don't touch."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reached.isNull() | (F.col("start") > reached), 1).otherwise(0)
    named = places.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return named.groupBy("doc", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def sharing_pairs(df: DataFrame, key: str, text: str, least: int = LEAST, unit: int = UNIT, most_classes: int = CLASSES) -> DataFrame:
    """``(doc_a, doc_b)``, smaller first: records whose texts have a run of at least ``least`` characters in common.

    Sets of records that share a span are expanded once each, in blocks of ``BLOCK`` records, so that a
    formula of very many records is as many tasks as it has pairs of blocks.  Null, empty and short texts are
    in no pair; equal texts are a pair if long enough; other columns are ignored.  ``key`` must be unique.
    """
    members = Shared(df, key, text, least, unit, most_classes).sets()
    blocks = F.ceil(F.col("n") / BLOCK)
    lists = cut(members.withColumn("blocks", blocks).withColumn("b", F.pmod(F.xxhash64("doc"), F.col("blocks"))).groupBy("k1", "k2", "blocks", "b").agg(F.collect_set("doc").alias("docs")))
    pair = lambda rows: rows.select(F.explode("one").alias("x"), "two").select("x", F.explode("two").alias("y")).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    found = pair(lists.select(F.col("docs").alias("one"), F.col("docs").alias("two")))
    # pairs of blocks of a large set are rows of their own
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    apart = lists.where("blocks > 1").select("k1", "k2", "b", "docs", other.alias("o")).where("b <> o")
    met = apart.groupBy("k1", "k2", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2")).agg(F.min_by("docs", "b").alias("one"), F.max_by("docs", "b").alias("two"), F.count("*").alias("m")).where("m = 2")
    return found.unionByName(pair(met.select("one", "two"))).distinct()


def shared_share(df: DataFrame, key: str, text: str, least: int = LEAST, unit: int = UNIT, most_classes: int = CLASSES) -> DataFrame:
    """``(key, n_chars, shared_chars, n_spans, repeated_chars)`` for each record.

    ``shared_chars``: characters in a run of at least ``least`` that stands in another record too;
    ``n_spans``: how many separate stretches these make; ``repeated_chars``: those of them that stand in a
    record of smaller key, so that removing them keeps the earliest occurrence.  Null texts count 0.
    """
    stretches = cut(Shared(df, key, text, least, unit, most_classes).stretches())
    counted = lambda places, name: _islands(places).groupBy("doc").agg(F.sum(F.col("end") - F.col("start")).alias(name), F.count("*").alias(f"{name}_n"))
    shared, repeated = counted(stretches.select("doc", "start", "end"), "shared_chars"), counted(stretches.where("later").select("doc", "start", "end"), "repeated_chars")
    sizes = df.select(F.col(key).alias("doc"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    joined = sizes.join(shared, "doc", "left").join(repeated, "doc", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(F.col("doc").alias(key), "n_chars", *[zero(F.col(c)).alias(n) for c, n in (("shared_chars", "shared_chars"), ("shared_chars_n", "n_spans"), ("repeated_chars", "repeated_chars"))])


def repeated_spans(df: DataFrame, key: str, text: str, least: int = LEAST, unit: int = UNIT, most_classes: int = CLASSES) -> DataFrame:
    """``(key, start, end)``: the stretches (code points, end exclusive) that stand in a record of smaller key.

    Removing them leaves each shared span where it ranks first, with the offsets of the original text.
    """
    later = Shared(df, key, text, least, unit, most_classes).stretches().where("later").select("doc", "start", "end")
    return _islands(later).withColumnRenamed("doc", key)
