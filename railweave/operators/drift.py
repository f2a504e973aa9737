"""Schemas that drift between files: versioned fingerprints, migration steps, one consistent table.

Each file's header and the kinds of its filled cells make its schema version.  Consecutive versions of a
dataset are compared; what differs becomes explicit migration steps (add, remove, rename, retype).
The steps are chained: every file is routed through the renames from its version to the canonical names,
fields it lacks get nulls, and cells are cast to the field's common kind.

Files are never gathered: lines are parsed where they lie, and per-field profiles are counted with
partial aggregation, so that one file may hold any share of all rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railweave.functions.clock import clock_text
from railweave.scale import cut, lookup_join

#: Separators a header may use, and words that are true or false.
SEPARATORS = (",", ";", "\t", "|")
TRUTH_WORDS = ("true", "false", "yes", "no", "si", "sí", "verdadero", "falso")

#: Share of equal cells (of those filled in both files) from which a field goes on under another name; up to
#: ``SURELY`` the cells must also agree by ``BEYOND_CHANCE`` (Cohen's kappa): few values are often equal by chance.
SAME_CONTENT, SURELY, BEYOND_CHANCE = 0.6, 0.75, 0.5
#: Share of lines on which the fields in both files say the same, from which their lines count as aligned.
ALIGNED = 0.2
#: Most distinct field names that the canonical naming may handle on the driver.
MAX_NAMES = 20_000

#: What a field's filled cells may be.
KINDS = ("whole", "decimal", "clock", "truth", "text")

_MARKS = r"[\s\uFEFF\u200B\u00A0\"']"
_CELL = "\u0001"


def bare(text: Column) -> Column:
    """``text`` without blanks, quotes and byte-order marks around it."""
    return F.regexp_replace(text, rf"^{_MARKS}+|{_MARKS}+$", "")


def separator(header: Column) -> Column:
    """The separator that occurs most often in ``header``, the first of ``SEPARATORS`` among equals."""
    counted = [F.struct((F.length(header) - F.length(F.translate(header, s, ""))).alias("n"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)]
    return F.greatest(*counted)["s"]


def cells(line: Column, sep: Column) -> Column:
    """The cells of ``line``, bare; separators inside double quotes part nothing, a doubled quote inside is one quote."""
    plain = F.split(F.replace(line, sep, F.lit(_CELL)), _CELL)
    quoted = None
    for s in SEPARATORS:
        mark = re.escape(s)
        # possessive: nothing is tried again, so that the stack doesn't grow with the cell
        blank = rf"[\s&&[^{mark}]]*+"  # a tab may be the separator
        # a separator is put before the line, so that each cell, empty ones too, begins with one
        one = F.regexp_extract_all(F.concat(F.lit(s), line), F.lit(rf'{mark}({blank}"(?:[^"]++|"")*+"(?={blank}(?:{mark}|$))|[^{mark}]*+)'), F.lit(1))
        quoted = F.when(sep == s, one) if quoted is None else quoted.when(sep == s, one)
    cell = lambda c: F.replace(bare(c), F.lit('""'), F.lit('"'))
    # only lines with a separator between two quotes take the longer way; every second piece between quotes is inside
    inside = F.exists(F.transform(F.split(line, '"'), lambda p, i: (i % 2 == 1) & F.contains(p, sep)), lambda x: x)
    return F.when(F.contains(line, F.lit('"')) & inside, F.transform(quoted, cell)).otherwise(F.transform(plain, cell))


def cell_kind(cell: Column) -> Column:
    """``whole``, ``decimal``, ``clock``, ``truth`` or ``text``; null for an empty cell."""
    return (
        F.when(cell == "", None)
        .when(cell.rlike(r"^[+-]?\d+$"), "whole")
        .when(cell.rlike(r"^[+-]?\d*\.\d+(?:[eE][+-]?\d+)?$"), "decimal")
        .when(cell.rlike(r"^\d{1,3}:\d{2}(?::\d{2})?$"), "clock")
        .when(F.lower(cell).isin(*TRUTH_WORDS), "truth")
        .otherwise("text")
    )


def content(cell: Column) -> Column:
    """What ``cell`` says whatever its writing: clocks as seconds, truth words as 1 and 0, numbers without
    leading zeros, zero fractions and a letter before them."""
    clock = F.split(cell, ":")
    number = lambda i: F.try_element_at(clock, F.lit(i)).try_cast("bigint")
    seconds = (number(1) * 3600 + number(2) * 60 + F.coalesce(number(3), F.lit(0))).cast("string")
    return (
        F.when(cell.rlike(r"^\d{1,3}:\d{2}(?::\d{2})?$"), seconds)
        .when(F.lower(cell).isin("true", "yes", "si", "sí", "verdadero"), "1")
        .when(F.lower(cell).isin("false", "no", "falso"), "0")
        .otherwise(F.regexp_replace(cell, r"^[A-Za-z]?0*(\d+?)(?:\.0+)?$", "$1"))
    )


def read_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(headers, rows)``: ``(file_id, sep, names array)`` and ``(file_id, line_no, names, values array)``.

    Line 1 is the header; files without one have no rows; null and blank lines are passed over; cells
    beyond the header's fields are dropped, missing ones are null.  A field name that repeats in a header
    gets ``#2``, ``#3`` after it; an empty one becomes ``field<k>``.
    """
    raw = lines.where(F.col("file_id").isNotNull() & F.col("line_no").isNotNull() & F.col("line").isNotNull() & (bare(F.col("line")) != ""))
    head = raw.where("line_no = 1").groupBy("file_id").agg(F.min("line").alias("line"))
    head = head.withColumn("sep", separator(F.col("line"))).withColumn("given", cells(F.lower("line"), F.col("sep")))
    filled = F.transform("given", lambda x, i: F.when(x == "", F.concat(F.lit("field"), (i + 1).cast("string"))).otherwise(x))
    head = head.withColumn("given", filled)
    repeat = lambda x, i: F.size(F.filter(F.slice("given", 1, i + 1), lambda y: y == x))
    names = F.transform("given", lambda x, i: F.when(repeat(x, i) > 1, F.concat(x, F.lit("#"), repeat(x, i).cast("string"))).otherwise(x))
    head = cut(head.select("file_id", "sep", names.alias("names")))
    rows = lookup_join(raw.where("line_no > 1").select("file_id", "line_no", "line"), head, ["file_id"], "inner")
    return head, rows.select("file_id", "line_no", "names", cells(F.col("line"), F.col("sep")).alias("values"))


def versions(lines: DataFrame, report: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(files, rows)``: ``files(file_id, dataset_id, published_at, version, before, names, kinds map, fingerprint)``.

    ``before`` is the file published before it in its dataset that has lines; ``version`` counts the
    fingerprints' changes within the dataset from 1.  Files that the report doesn't name are left out.
    """
    head, rows = read_files(lines)
    about = report.where(F.col("file_id").isNotNull() & F.col("dataset_id").isNotNull()).groupBy("file_id").agg(F.min(F.struct("published_at", "dataset_id")).alias("p")).select("file_id", "p.published_at", "p.dataset_id")
    files = lookup_join(head, about, ["file_id"], "inner")
    # one bit per kind: what the filled cells of a field are comes out of one aggregate, combined before the shuffle
    bit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(1 << i)) for i, k in enumerate(KINDS)], F.lit(0))
    field = rows.select("file_id", F.explode(F.arrays_zip("names", F.slice("values", F.lit(1), F.size("names")).alias("values"))).alias("c")).select("file_id", F.col("c.names").alias("name"), cell_kind(F.col("c.values")).alias("kind"))
    counted = field.where(F.col("name").isNotNull()).groupBy("file_id", "name").agg(F.bit_or(bit).alias("bits")).where("bits > 0")
    kind = F.when(F.col("bits") == 3, "decimal").otherwise("text")
    for i, k in reversed(list(enumerate(KINDS))):
        kind = F.when(F.col("bits") == 1 << i, k).otherwise(kind)
    kinds = counted.select("file_id", F.struct("name", kind.alias("kind")).alias("k")).groupBy("file_id").agg(F.map_from_entries(F.collect_list("k")).alias("kinds"))
    files = files.join(kinds, "file_id", "left").withColumn("kinds", F.coalesce("kinds", F.create_map().cast("map<string,string>")))
    described = F.array_join(F.array_sort(F.transform("names", lambda n: F.concat(n, F.lit(":"), F.coalesce(F.element_at("kinds", n), F.lit("?"))))), ",")
    order = Window.partitionBy("dataset_id").orderBy("published_at", "file_id")
    files = files.withColumn("fingerprint", F.sha2(described, 256))
    files = files.withColumn("before", F.lag("file_id").over(order)).withColumn("changed", F.coalesce((F.lag("fingerprint").over(order) != F.col("fingerprint")).cast("int"), F.lit(1)))
    files = files.withColumn("version", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("changed", "sep")
    return cut(files), rows


def _met(rows: DataFrame, pairs: DataFrame, by_line: bool) -> DataFrame:
    """``(pair, old_field, new_field, old_cell, new_cell)``: what gone and come fields say on the same line of both files.

    Lines are the same by number, or by what their ``kept`` cells say if they are alone with that in their file.
    By number there is also a pair of fields ``''``, whose cells are what the kept cells say together.
    All files are parsed once, and each line meets its partner in one shuffle.
    """
    side = lambda own, k, wanted: pairs.select(F.col(own).alias("own"), F.struct(F.lit(k).alias("side"), F.col("file_id").alias("pair"), F.col(wanted).alias("wanted"), "kept").alias("s"))
    # a file is the new one of at most one pair and the old one of at most one
    sides = side("before", 0, "gone").unionByName(side("file_id", 1, "come")).groupBy("own").agg(F.collect_list("s").alias("sides"))
    joined = lookup_join(rows.select(F.col("file_id").alias("own"), "line_no", "names", "values"), cut(sides), ["own"], "inner")
    each = joined.select("line_no", F.explode("sides").alias("s"), F.transform("values", content).alias("values"), "names").select("line_no", "s.*", "names", "values")
    cell = lambda n: F.try_element_at("values", F.array_position("names", n).cast("int"))
    kept = F.xxhash64(F.transform("kept", lambda n: F.coalesce(cell(n), F.lit(""))))
    told = F.filter(F.transform("wanted", lambda n: F.struct(n.alias("f"), cell(n).alias("c"))), lambda x: x["c"] != "")
    if by_line:
        line = F.col("line_no").cast("long")
        told = F.when(F.size("kept") > 0, F.concat(told, F.array(F.struct(F.lit("").alias("f"), kept.cast("string").alias("c"))))).otherwise(told)
    else:
        line = kept
    of = lambda k: F.max(F.when(F.col("side") == k, F.col("told")))
    met = each.select("pair", "side", line.alias("line"), told.alias("told")).groupBy("pair", "line").agg(of(0).alias("old"), of(1).alias("new"), F.count_if(F.col("side") == 0).alias("n_old"), F.count_if(F.col("side") == 1).alias("n_new"))
    met = met.where("old is not null and new is not null" + ("" if by_line else " and n_old = 1 and n_new = 1"))
    met = met.select("pair", F.explode("old").alias("o"), "new").select("pair", "o", F.explode("new").alias("n")).where((F.col("o.f") == "") == (F.col("n.f") == ""))
    return met.select("pair", F.col("o.f").alias("old_field"), F.col("n.f").alias("new_field"), F.col("o.c").alias("old_cell"), F.col("n.c").alias("new_cell"))


def _same_fields(rows: DataFrame, pairs: DataFrame, same_content: float, by_line: bool) -> tuple[DataFrame, DataFrame]:
    """``(renamed(file_id, old_field, new_field), agreed(file_id, agreed))``: fields that go on under another name, and
    the share of lines on which the kept fields say the same."""
    key = ["pair", "old_field", "new_field"]
    met = _met(rows, pairs, by_line)
    counted = cut(met.groupBy(*key).agg(F.count("*").alias("both"), F.count_if(F.col("old_cell") == F.col("new_cell")).alias("equal")).withColumn("share", F.col("equal") / F.col("both")))
    agreed = counted.where("old_field = ''").select(F.col("pair").alias("file_id"), F.col("share").alias("agreed"))
    alike = counted.where((F.col("old_field") != "") & (F.col("share") >= same_content))
    # the few that might be equal by chance: how often two fields with these values would be
    doubted = cut(alike.where(F.col("share") < SURELY).select(*key, "both"))
    if not doubted.isEmpty():
        told = lookup_join(met, doubted, key, "inner")
        often = lambda c, n: told.groupBy(*key, F.col(c).alias("v"), "both").agg(F.count("*").alias(n))
        chance = often("old_cell", "p").join(often("new_cell", "q").drop("both"), [*key, "v"]).groupBy(*key).agg(F.sum(F.col("p") * F.col("q") / F.col("both") / F.col("both")).alias("chance"))
        alike = alike.join(chance, key, "left").withColumn("chance", F.coalesce("chance", F.lit(0.0)))
        alike = alike.where((F.col("share") >= SURELY) | (F.col("share") - F.col("chance") >= BEYOND_CHANCE * (1 - F.col("chance"))))
    rank = [F.desc("share"), F.desc("equal"), F.desc("near"), "old_field", "new_field"]
    alike = alike.withColumn("near", -F.levenshtein("old_field", "new_field")).withColumn("a", F.row_number().over(Window.partitionBy("pair", "old_field").orderBy(*rank))).withColumn("b", F.row_number().over(Window.partitionBy("pair", "new_field").orderBy(*rank)))
    return cut(alike.where("a = 1 and b = 1").select(F.col("pair").alias("file_id"), "old_field", "new_field")), agreed


def migration_steps(files: DataFrame, rows: DataFrame, same_content: float = SAME_CONTENT) -> DataFrame:
    """``(file_id, change_kind, old_field, new_field)``: what changed from the file before to this one.

    A field that went and one that came are one *renamed* field if at least ``same_content`` of their cells,
    where both are filled, say the same - more than their values would by chance - and neither fits another
    better.  Lines are compared by number; where fields stay unexplained and the fields in both files don't
    agree line by line either, as after lines put in or taken out, lines are matched by what these say.  The rest are *added* and *removed*.
    *retyped*: the same name, another kind of filled cells.
    """
    earlier = files.select(F.col("file_id").alias("before"), F.col("names").alias("old_names"), F.col("kinds").alias("old_kinds"))
    pairs = files.where(F.col("before").isNotNull()).join(earlier, "before")
    pairs = pairs.withColumn("gone", F.array_except("old_names", "names")).withColumn("come", F.array_except("names", "old_names")).withColumn("kept", F.array_sort(F.array_intersect("old_names", "names")))
    pairs = cut(pairs.select("file_id", "before", "gone", "come", "kept", "kinds", "old_kinds"))
    none = F.array().cast("array<string>")

    def left(renamed: DataFrame) -> DataFrame:
        by_pair = renamed.groupBy("file_id").agg(F.collect_list("old_field").alias("r_old"), F.collect_list("new_field").alias("r_new"))
        rest = pairs.join(by_pair, "file_id", "left")
        return rest.withColumn("gone", F.array_except("gone", F.coalesce("r_old", none))).withColumn("come", F.array_except("come", F.coalesce("r_new", none))).drop("r_old", "r_new")

    unclear = lambda df: df.where((F.size("gone") > 0) & (F.size("come") > 0))
    renamed, agreed = _same_fields(rows, unclear(pairs), same_content, True)
    again = unclear(left(renamed)).where(F.size("kept") > 0).join(agreed, "file_id", "left")
    again = cut(again.where(F.coalesce("agreed", F.lit(0.0)) < ALIGNED).drop("agreed"))
    if not again.isEmpty():
        renamed = cut(renamed.unionByName(_same_fields(rows, again, same_content, False)[0]))
    other_kind = F.filter("kept", lambda n: F.element_at("old_kinds", n) != F.element_at("kinds", n))
    change = lambda kind, fields, old_, new_: F.transform(fields, lambda n: F.struct(F.lit(kind).alias("change_kind"), (n if old_ else F.lit("")).alias("old_field"), (n if new_ else F.lit("")).alias("new_field")))
    listed = F.concat(change("removed", "gone", True, False), change("added", "come", False, True), change("retyped", other_kind, True, True))
    steps = left(renamed).select("file_id", F.explode(listed).alias("c")).select("file_id", "c.*")
    return steps.unionByName(renamed.select("file_id", F.lit("renamed").alias("change_kind"), "old_field", "new_field"))


def chained_names(files: DataFrame, steps: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """``(file_id, name, canonical)``: each file's fields, routed along its dataset's own chain of versions.

    A field goes on from the file before under its own name or through a rename found there; what goes on
    is one field.  It is called like the name that most files of all datasets use among its own names and those
    that renames of any dataset link to them, the links of most datasets first; a link that would join names
    that stand together in any file is passed over.  Where two fields of a dataset would be called the same though a file holds both, the one in more
    files keeps the name and the other gets one of its own, or ``#2`` behind it.
    """
    renamed = steps.where("change_kind = 'renamed'")
    used = {r["name"]: r["count"] for r in files.select(F.explode("names").alias("name")).groupBy("name").count().limit(max_names + 1).collect()}
    links = lookup_join(renamed, files.select("file_id", "dataset_id"), ["file_id"], "inner").groupBy("old_field", "new_field").agg(F.count_distinct("dataset_id").alias("n")).limit(max_names + 1).collect()
    headers = [set(r["names"]) for r in files.select(F.array_sort("names").alias("names")).distinct().limit(max_names + 1).collect()] if links else []
    if max(len(used), len(links), len(headers)) > max_names:
        raise ValueError(f"more than {max_names} field names or headers; raise max_names if that is meant")
    groups = {n: {n} for n in used}
    for link in sorted(links, key=lambda r: (-r["n"], r["old_field"], r["new_field"])):
        both = groups[link["old_field"]] | groups[link["new_field"]]
        if all(len(both & h) < 2 for h in headers):
            groups |= dict.fromkeys(both, both)
    best = {n: min(g, key=lambda m: (-used[m], m)) for n, g in groups.items()}

    def route(g):
        import pandas as pd

        g = g.sort_values("version")
        chains, held, now = [], [], {}  # per field its names and versions; per version the field of each name
        files_of = g["n_files"].to_numpy()
        for k, (own, pairs) in enumerate(zip(g["names"], g["renames"])):
            came = {p["new_field"]: p["old_field"] for p in (pairs if pairs is not None else ())}
            here = {}
            for n in own:
                t = now.get(came.get(n, n))
                if t is None:
                    chains.append([])
                    t = len(chains) - 1
                chains[t].append((k, n))
                here[n] = t
            held.append(here)
            now = here
        given, taken = {}, [set() for _ in held]
        for t in sorted(range(len(chains)), key=lambda t: (-sum(files_of[k] for k, _ in chains[t]), chains[t][0])):
            names = sorted({n for _, n in chains[t]}, key=lambda n: (-used[n], n))
            first = min((best[n] for n in names), key=lambda n: (-used[n], n))
            free = lambda n: all(n not in taken[k] for k, _ in chains[t])  # noqa: B023, E731
            name = next((n for n in (first, *names) if free(n)), None)
            k = 2
            while name is None:
                name = f"{first}#{k}" if free(f"{first}#{k}") else None
                k += 1
            given[t] = name
            for k, _ in chains[t]:
                taken[k].add(name)
        return pd.DataFrame([(d, v, n, given[t]) for d, v, here in zip(g["dataset_id"], g["version"], held) for n, t in here.items()], columns=["dataset_id", "version", "name", "canonical"])

    # a version's files have the same fields, so a dataset's chain is as long as its schema changed, however many files it has
    at = F.struct("published_at", "file_id")
    chain = files.groupBy("dataset_id", "version").agg(F.min_by("file_id", at).alias("file_id"), F.min_by("names", at).alias("names"), F.count("*").alias("n_files"))
    by_file = renamed.groupBy("file_id").agg(F.collect_list(F.struct("old_field", "new_field")).alias("renames"))
    kind = files.schema["dataset_id"].dataType.simpleString()
    routed = chain.join(by_file, "file_id", "left").groupBy("dataset_id").applyInPandas(route, f"dataset_id {kind}, version int, name string, canonical string")
    return cut(lookup_join(files.select("dataset_id", "version", "file_id"), routed.groupBy("dataset_id", "version").agg(F.collect_list(F.struct("name", "canonical")).alias("r")), ["dataset_id", "version"], "inner").select("file_id", F.explode("r").alias("r")).select("file_id", "r.*"))


_WHOLE = r"^[A-Za-z]+(?=[+-]?\d)|\.0+$"

#: Types of the kinds, and the casts to them from a cell and what it says (``content``); what a cast can't read is null.
CASTS = {
    "whole": ("bigint", lambda cell, said: F.regexp_replace(said, _WHOLE, "").try_cast("bigint")),
    "decimal": ("double", lambda cell, said: F.regexp_replace(said, r"^[A-Za-z]+(?=[+-]?\d)", "").try_cast("double")),
    "clock": ("string", lambda cell, said: clock_text(F.when(said.rlike(r"^\d{1,7}$"), said.try_cast("double")))),
    "truth": ("boolean", lambda cell, said: F.when(said == "1", True).when(said == "0", False)),
    "text": ("string", lambda cell, said: cell),
}


def _placed(files: DataFrame, routes: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Where each file has each canonical field and of what kind, and the fields' common kinds."""
    placed = routes.join(files.select("file_id", "dataset_id", "names", "kinds", F.col("version").alias("schema_version")), "file_id")
    placed = cut(placed.select("file_id", "dataset_id", "schema_version", "name", "canonical", F.array_position("names", F.col("name")).cast("int").alias("at"), F.try_element_at("kinds", F.col("name")).alias("kind")))
    common: dict[str, str] = {}  # a row per canonical name and kind, whose number chained_names has checked
    for r in sorted(placed.groupBy("canonical", "kind").count().collect(), key=lambda r: (r["kind"] is None, -r["count"], r["kind"] or "")):
        common.setdefault(r["canonical"], r["kind"] or "text")
    return placed, common


def migration_rules(files: DataFrame, routes: DataFrame, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """``(file_id, schema_version, rule, field, of, to)``: each rule a file passes on its way into the one table.

    ``rename``: the field's own name ``of`` becomes ``to``.  ``cast``: its cells of kind ``of`` become the common
    kind ``to``.  ``default``: the file lacks the field, which gets the value ``to`` (``''``: null).
    """
    placed, common = _placed(files, routes)
    kinds = F.create_map(*[F.lit(x) for pair in sorted(common.items()) for x in pair]) if common else F.create_map().cast("map<string,string>")
    rename = placed.where("name <> canonical").select("file_id", "schema_version", F.lit("rename").alias("rule"), F.col("canonical").alias("field"), F.col("name").alias("of"), F.col("canonical").alias("to"))
    to = F.try_element_at(kinds, F.col("canonical"))
    cast = placed.where(F.col("kind").isNotNull() & (F.col("kind") != to)).select("file_id", "schema_version", F.lit("cast").alias("rule"), F.col("canonical").alias("field"), F.col("kind").alias("of"), to.alias("to"))
    every = F.array(*[F.lit(c) for c in sorted(common)]).cast("array<string>")
    given = F.create_map(*[F.lit(x) for pair in sorted((defaults or {}).items()) for x in pair]) if defaults else F.create_map().cast("map<string,string>")
    lacking = placed.groupBy("file_id", "schema_version").agg(F.collect_set("canonical").alias("has")).select("file_id", "schema_version", F.explode(F.array_except(every, F.col("has"))).alias("field"))
    default = lacking.select("file_id", "schema_version", F.lit("default").alias("rule"), "field", F.lit("").alias("of"), F.coalesce(F.try_element_at(given, F.col("field")), F.lit("")).alias("to"))
    return rename.unionByName(cast).unionByName(default)


def one_table(files: DataFrame, rows: DataFrame, routes: DataFrame, defaults: Mapping[str, str] | None = None) -> DataFrame:
    """All rows of all files under the canonical names of ``routes`` (``chained_names``), cells cast to their field's common kind.

    The common kind is that of most files: whole numbers are ``bigint``, decimal numbers ``double``, truth words
    ``boolean``, clocks ``HH:MM:SS``, the rest text.  Casts read clocks as seconds and the reverse, zero
    fractions, and a letter before a number.  ``defaults`` (as text, by canonical name) fill fields that a file
    lacks as a whole; without one they are null, and an empty cell is null too.  ``schema_version`` is the
    file's version.  ``misfits`` lists the fields whose filled cell no cast can read; ``misfit_cells`` holds
    those cells as they stand, so that nothing is lost.
    """
    placed, common = _placed(files, routes)
    by_file = placed.groupBy("file_id").agg(F.first("dataset_id").alias("dataset_id"), F.first("schema_version").alias("schema_version"), F.map_from_entries(F.collect_list(F.struct("canonical", "at"))).alias("_at"))
    routed = lookup_join(rows, by_file, ["file_id"], "inner")
    fixed = {"file_id", "dataset_id", "schema_version", "line_no", "misfits", "misfit_cells"}
    names = sorted(common.items())
    # cell, what it says, its cast: in steps, so that none is computed again where the next uses it twice
    own = ["file_id", "dataset_id", "schema_version", "line_no"]
    at = [F.try_element_at("_at", F.lit(c)) for c, _ in names]
    told = routed.select(*own, *[F.nullif(F.try_element_at("values", a), F.lit("")).alias(f"_t{i}") for i, a in enumerate(at)], *[at[i].isNull().alias(f"_n{i}") for i, (c, _) in enumerate(names) if c in (defaults or {})])
    told = told.select("*", *[content(F.col(f"_t{i}")).alias(f"_s{i}") for i, (_, k) in enumerate(names) if k != "text"])
    told = told.select("*", *[CASTS[k][1](F.col(f"_t{i}"), F.col(f"_s{i}") if k != "text" else None).cast(CASTS[k][0]).alias(f"_v{i}") for i, (_, k) in enumerate(names)])
    columns, odd = [], []
    for i, (canon, kind) in enumerate(names):
        value = F.col(f"_v{i}")
        if kind != "text":
            odd.append(F.when(F.col(f"_t{i}").isNotNull() & value.isNull(), F.struct(F.lit(canon).alias("f"), F.col(f"_t{i}").alias("c"))))
        if canon in (defaults or {}):
            given = F.lit(defaults[canon])
            value = F.when(F.col(f"_n{i}"), CASTS[kind][1](given, content(given)).cast(CASTS[kind][0])).otherwise(value)
        columns.append(value.alias(f"{canon}_" if canon in fixed else canon))
    unfit = F.array_compact(F.array(*odd)) if odd else F.array().cast("array<struct<f:string,c:string>>")
    return told.select(*own, *columns, unfit.alias("_unfit")).select(*own, *[F.col(f"`{c}_`" if c in fixed else f"`{c}`") for c, _ in names], F.transform("_unfit", lambda u: u["f"]).alias("misfits"), F.map_from_entries("_unfit").alias("misfit_cells"))
