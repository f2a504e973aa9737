"""Quantities recorded in different units, brought to one unit.

Numbers and unit spellings are cut from the texts inside the JVM.  Only the *distinct* spellings are
mapped to units: an inverted index from character n-grams to known aliases gives candidates, a weighted
edit distance verifies them.  The resulting alias dictionary is joined to all rows.  A bare number has
the unit its source uses, which is learnt from the texts of that source that name a unit.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railweave.scale import cut, lookup_join


@dataclass(frozen=True)
class Unit:
    """``factor``: what one of the unit is in the common unit; ``aliases``: known spellings."""

    factor: float
    aliases: tuple[str, ...]


#: Speed units in km/h, with the spellings from which others are recognised.
SPEED_UNITS: Mapping[str, Unit] = {
    "km/h": Unit(1.0, ("km/h", "kmh", "kph", "kmph", "km/hora", "km/hr", "km per hour", "kilometres per hour", "kilometers per hour", "km h-1", "kms/h", "kilometros por hora", "k/h")),
    "mph": Unit(1.609344, ("mph", "m.p.h.", "mi/h", "mi/hr", "miles/h", "miles per hour", "miles/hour", "millas por hora", "mi per hour", "mi h-1")),
    "knot": Unit(1.852, ("knots", "knot", "kn", "kt", "kts", "nudos", "nm/h", "nautical miles per hour", "nmi/h")),
    "m/s": Unit(3.6, ("m/s", "mps", "m s-1", "m/sec", "metres per second", "meters per second", "metros por segundo", "m s^-1", "ms-1", "m.s-1", "m/seg")),
    "0.1 km/h": Unit(0.1, ("hm/h", "0.1 km/h", "0.1 kmh", "0.1 kph", "hectometres per hour", "hectometers per hour", "1/10 km/h", "dkm/h*", "tenths of km/h")),
    "cm/s": Unit(0.036, ("cm/s", "cm s-1", "centimetres per second")),
    "ft/s": Unit(1.09728, ("ft/s", "fps", "feet per second")),
    "m/min": Unit(0.06, ("m/min", "metres per minute", "meters per minute")),
}

#: What an edit costs by the kind of character; digits may hardly be changed.
_CHEAP, _LETTER, _DIGIT = 0.15, 1.0, 3.0

NUMBER = r"\d+(?:[.,]\d+)?"


def squeezed(spelling: str) -> str:
    """Lower case, signs of multiplication and brackets as blanks, single blanks."""
    text = "".join(" " if c in "()[]×*" else c for c in spelling.lower().replace(",", "."))
    text = " ".join(text.split())
    return text[1:].strip() if text[:1] == "x" and text[1:].strip()[:1].isdigit() else text


def weight(c: str) -> float:
    return _DIGIT if c.isdigit() else _LETTER if c.isalpha() else _CHEAP


def weighted_distance(a: str, b: str) -> float:
    """Edit distance where blanks and marks are cheap, letters cost 1 and digits 3; a doubled letter and a swap of neighbours cost half."""
    before, row = [], [0.0]
    for c in b:
        row.append(row[-1] + weight(c))
    for i, x in enumerate(a, 1):
        now = [row[0] + weight(x)]
        for j, y in enumerate(b, 1):
            w = max(weight(x), weight(y))
            drop = weight(x) * (0.5 if i > 1 and x == a[i - 2] and x.isalpha() else 1)
            add = weight(y) * (0.5 if j > 1 and y == b[j - 2] and y.isalpha() else 1)
            best = min(row[j] + drop, now[-1] + add, row[j - 1] + (0 if x == y else w))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, before[j - 2] + w / 2)
            now.append(best)
        before, row = row, now
    return row[-1]


class AliasIndex:
    """Inverted index from padded character bigrams to the aliases that hold them."""

    def __init__(self, units: Mapping[str, Unit], n: int = 2) -> None:
        self.n = n
        self.aliases = [(squeezed(a), name) for name, u in units.items() for a in u.aliases]
        self.exact = dict(self.aliases)
        self.postings: dict[str, list[int]] = defaultdict(list)
        for i, (alias, _) in enumerate(self.aliases):
            for gram in set(self.grams(alias)):
                self.postings[gram].append(i)

    def grams(self, text: str) -> list[str]:
        padded = f"^{text.replace(' ', '')}$"
        return [padded[i : i + self.n] for i in range(len(padded) - self.n + 1)]

    def find(self, spelling: str, most: float = 0.34) -> tuple[str | None, float]:
        """The unit meant and the relative distance, or None if no alias is near enough or two units are as near."""
        text = squeezed(spelling)
        if text in self.exact:
            return self.exact[text], 0.0
        shared = Counter(i for gram in set(self.grams(text)) for i in self.postings.get(gram, ()))
        best: dict[str, float] = {}
        for i in shared:
            alias, name = self.aliases[i]
            size = sum(min(weight(c), 1.0) for c in alias) or 1.0
            d = weighted_distance(text, alias) / size
            if d < best.get(name, 9e9):
                best[name] = d
        ranked = sorted((d, name) for name, d in best.items())
        if not ranked or ranked[0][0] > most or (len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 1e-9):
            return None, ranked[0][0] if ranked else 1.0
        return ranked[0][1], ranked[0][0]


def unit_dictionary(spellings: DataFrame, column: str, units: Mapping[str, Unit] = SPEED_UNITS, most: float = 0.34) -> DataFrame:
    """``(spelling, unit, factor, distance)`` for each distinct spelling; unit and factor are null for unknown ones."""

    def mapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = AliasIndex(units)
        for batch in batches:
            found = [index.find(s, most) for s in batch[column]]
            yield pd.DataFrame({
                "spelling": batch[column],
                "unit": [u for u, _ in found],
                "factor": pd.array([units[u].factor if u else None for u, _ in found], "Float64"),
                "distance": [float(d) for _, d in found],
            })

    return spellings.select(column).where(F.col(column).isNotNull()).distinct().mapInPandas(mapped, "spelling string, unit string, factor double, distance double")


def quantities(text: Column) -> Column:
    """``array<struct<value double, spelling string>>`` of the quantities in ``text``, parted by ``;`` or ``|``.

    The spelling is what follows the number, or what goes before it if nothing follows; ``''`` for a bare
    number.  Parts without a number are no quantity.
    """
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[;|]"), lambda p: p.rlike(r"\d"))

    def one(part: Column) -> Column:
        number = F.regexp_extract(part, NUMBER, 0)
        after = F.trim(F.regexp_extract(part, rf"(?s){NUMBER}(.*)$", 1))
        before = F.trim(F.regexp_replace(F.regexp_extract(part, r"(?s)^([^\d]*)\d", 1), r"(?i)\b(max|min|limit|approx|ca|about|aprox|speed|maxspeed|lim)\b\.?|[~<>=:≈]", " "))
        return F.struct(
            F.regexp_replace(number, ",", ".").cast("double").alias("value"),
            F.lower(F.when(after != "", after).otherwise(before)).alias("spelling"),
        )

    return F.transform(parts, one)


def common_units(df: DataFrame, key: str, value: str, text: str, source: str, units: Mapping[str, Unit] = SPEED_UNITS, base: str = "km/h", most: float = 0.34) -> DataFrame:
    """Each row's quantity in the common unit ``base``.

    Gives ``(key, unit, converted, n_given, unknown_unit)``: ``converted`` is the highest of the values the
    row gives and ``unit`` that value's unit; ``unknown_unit`` is the spelling of a unit in the text that is
    not known.  A unit in the text holds for the text, and the number in ``value`` is then the same reading,
    so the text governs; without one, the text's bare numbers and ``value`` have the source's unit (``base``
    where the source never names one).  Rows without any number (nulls, blanks, NaN, words) give nulls and
    ``n_given`` 0.  Each row has a row of its own, repeated keys too; other columns are ignored.  Rows aren't
    shuffled: only the distinct lists of spellings are.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value"), F.col(source).cast("string").alias("_source"), quantities(F.col(text).cast("string")).alias("_given"))
    rows = rows.withColumn("_spelt", F.col("_given.spelling"))
    # the lists of spellings that rows have, each once: rows are only looked up by them, never taken apart and grouped again
    lists = cut(rows.where(F.exists("_spelt", lambda s: s != "")).groupBy("_source", "_spelt").agg(F.count("*").alias("_n")))
    counted = lists.select("_source", "_n", F.explode("_spelt").alias("_spelling")).where(F.col("_spelling") != "").groupBy("_source", "_spelling").agg(F.sum("_n").alias("_n"))
    names = cut(unit_dictionary(counted, "_spelling", units, most))
    habit = (
        lookup_join(counted.withColumnRenamed("_spelling", "spelling"), names, ["spelling"], "inner")
        .where(F.col("unit").isNotNull())
        .groupBy("_source", "unit")
        .agg(F.sum("_n").alias("_n"))
        .groupBy("_source")
        .agg(F.max(F.struct("_n", "unit"))["unit"].alias("_habit"))
        .where(F.col("_source").isNotNull())
    )
    factors = F.create_map(*[x for n, u in units.items() for x in (F.lit(n), F.lit(u.factor))])
    spelled = lists.select("_spelt").distinct().select("_spelt", F.posexplode("_spelt").alias("_pos", "spelling"))
    units_of = lookup_join(spelled, names.select("spelling", "unit"), ["spelling"]).groupBy("_spelt").agg(F.array_sort(F.collect_list(F.struct("_pos", "unit"))).alias("_units"))
    joined = lookup_join(lookup_join(rows, cut(units_of), ["_spelt"]), habit, ["_source"])
    own = F.coalesce("_habit", F.lit(base))

    def converted(q: Column, i: Column) -> Column:
        known = F.try_element_at("_units", i + 1)["unit"]
        meant = F.coalesce(known, F.when(q["spelling"] == "", own))
        return F.struct(F.round(q["value"] * F.try_element_at(factors, meant), 9).alias("_x"), meant.alias("_u"), F.when((q["spelling"] != "") & known.isNull(), q["spelling"]).alias("_odd"))

    reading = F.when((F.col("_value") >= 0) & ~F.isnan("_value"), F.col("_value"))
    per = joined.withColumn("_all", F.transform("_given", converted)).withColumn("_own", own)
    best = per.select(
        "_key",
        "_own",
        F.array_max(F.transform(F.filter("_all", lambda a: a["_x"].isNotNull()), lambda a: F.struct(a["_x"], a["_u"]))).alias("_best"),
        F.size(F.filter("_all", lambda a: a["_x"].isNotNull())).alias("_n"),
        F.array_max(F.transform("_all", lambda a: a["_odd"])).alias("unknown_unit"),
        F.coalesce(F.exists("_units", lambda u: u["unit"].isNotNull()), F.lit(False)).alias("_named"),
        reading.alias("_reading"),
    )
    plain = F.when(~F.col("_named"), F.struct(F.round(F.col("_reading") * F.element_at(factors, F.col("_own")), 9).alias("_x"), F.col("_own").alias("_u")))
    plain = F.when(plain["_x"].isNotNull(), plain)
    top = F.when(F.col("_best").isNull() | (plain["_x"] > F.col("_best._x")), F.coalesce(plain, F.col("_best"))).otherwise(F.col("_best"))
    return best.select(
        F.col("_key").alias(key),
        top["_u"].alias("unit"),
        top["_x"].alias("converted"),
        (F.col("_n") + F.when(plain.isNotNull(), 1).otherwise(0)).cast("int").alias("n_given"),
        "unknown_unit",
    )
