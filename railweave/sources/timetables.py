"""Timetable feeds: tables in folders and zip files, feeds named by users, and a catalogue of published feeds."""

from __future__ import annotations

import difflib
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.functions.text import plain_name
from railweave.operators.report import REPORT_COLUMNS
from railweave.scale import put_shared

#: The tables of a feed, those that must be there and those that may be.
REQUIRED = ("stops", "routes", "trips", "stop_times")
OPTIONAL = ("calendar", "calendar_dates", "frequencies")


def _member(path: Path, table: str) -> str | None:
    with zipfile.ZipFile(path) as archive:
        names = [n for n in archive.namelist() if n.rsplit("/", 1)[-1].lower() == f"{table}.txt" and "__MACOSX" not in n]
    return min(names, key=lambda n: (n.count("/"), n)) if names else None


def _unpacked(spark: SparkSession, path: Path, table: str) -> str | None:
    """Where a table lies as a plain file that all executors can read; zip members are copied to the shared folder."""
    if path.is_dir():
        found = [p for p in path.iterdir() if p.name.lower() == f"{table}.txt"]
        return str(found[0]) if found else None
    member = _member(path, table)
    if member is None:
        return None
    stamp = path.stat()
    with tempfile.TemporaryDirectory() as own, zipfile.ZipFile(path) as archive:  # on the driver; executors read the shared copy
        place = Path(own) / f"{table}.txt"
        with archive.open(member) as source, place.open("wb") as target:
            shutil.copyfileobj(source, target)
        return put_shared(spark, str(place), "feeds", f"{path.stem}-{stamp.st_size}-{stamp.st_mtime_ns}", f"{table}.txt")


def read_table(spark: SparkSession, feed: str | Path, table: str) -> DataFrame:
    """A table of a feed (folder or zip), all columns text, names and values without blanks around, in file order.

    Empty and blank cells are null, ``NA`` stays text; ``_ordinal`` tells the file's order.  Raises
    ``FileNotFoundError`` if the feed lacks the table.
    """
    path = Path(feed)
    if not path.exists():
        raise FileNotFoundError(f"no such feed: {feed}")
    place = _unpacked(spark, path, table)
    if place is None:
        raise FileNotFoundError(f"{feed} has no {table}.txt")
    address = place if ":/" in place else f"file://{place}"
    # a cell with a line break in it has an odd number of quotes on its first line; without one the file is read in parts
    broken = not spark.read.text(address).where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()
    raw = spark.read.csv(address, header=True, multiLine=broken, quote='"', escape='"', encoding="UTF-8", nullValue="", mode="PERMISSIVE")
    names: list[str] = []
    for c in raw.columns:
        bare = c.strip().strip("﻿").strip('"').strip()
        names.append(bare if bare not in names else f"{bare}_{len(names)}")
    quoted = lambda c: f"`{c.replace('`', '``')}`"
    clean = lambda c: F.nullif(F.trim(F.col(quoted(c)).cast("string")), F.lit(""))
    return raw.withColumn("_ordinal", F.monotonically_increasing_id()).select(*[clean(c).alias(n) for c, n in zip(raw.columns, names)], "_ordinal")


def read_feed(spark: SparkSession, feed: str | Path) -> dict[str, DataFrame | None]:
    """All tables of a feed; optional ones that aren't there are None."""
    tables: dict[str, DataFrame | None] = {t: read_table(spark, feed, t) for t in REQUIRED}
    for t in OPTIONAL:
        try:
            tables[t] = read_table(spark, feed, t)
        except FileNotFoundError:
            tables[t] = None
    return tables


def named_feeds(feeds) -> list[tuple[str | None, str]]:
    """Feeds as users give them - one source, a list of sources or (name, source), a mapping - checked before any work.

    Raises ``ValueError`` for blank sources, names that aren't text and addresses other than http(s),
    ``FileNotFoundError`` for local sources that aren't there.
    """
    if feeds is None:
        return []
    if isinstance(feeds, (str, Path)):
        pairs = [(None, feeds)]
    elif isinstance(feeds, Mapping):
        pairs = list(feeds.items())
    else:
        pairs = [f if isinstance(f, tuple) and len(f) == 2 else (None, f) for f in feeds]
    out: list[tuple[str | None, str]] = []
    for name, source in pairs:
        if name is not None and not (isinstance(name, str) and name.strip()):
            raise ValueError(f"a feed's name must be text, not {name!r}")
        text = "" if source is None else str(source).strip()
        if not text:
            raise ValueError(f"the source of feed {name!r} is empty")
        scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", text)
        if scheme and scheme[1].lower() not in ("http", "https"):
            raise ValueError(f"only http and https addresses can be fetched, not {text!r}")
        if not scheme:
            text = str(Path(text).expanduser())
            if not Path(text).exists():
                raise FileNotFoundError(f"no such feed: {text}")
        out.append((name, text))
    return out


def feed_name(file_name: str) -> str:
    """A dataset's name from a file's: no time stamp before it, no ending, lower case words joined by ``_``."""
    base = re.sub(r"^\d{8}_\d{6}_", "", file_name)
    base = re.sub(r"\.(zip|txt)$", "", base, flags=re.I)
    return re.sub(r"[^0-9a-z]+", "_", base.lower()).strip("_") or "gtfs"


def unique_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or ``name_2``, ``name_3``... if it is taken."""
    taken, k, out = set(taken), 1, name
    while out in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def catalogue_files(catalogue: DataFrame, provinces: Iterable[int], types: Iterable[int]) -> tuple[DataFrame, DataFrame]:
    """``(files, left_out)`` of a catalogue answer for the wanted provinces and transport types.

    ``catalogue(province_code, dataset_id, dataset_name, types array<struct<id int, name string>>, files
    array<struct<id bigint, name string>>)``.  A file that several provinces list is taken once, from the
    first province given; ``left_out`` are datasets of other types.
    """
    order = list(dict.fromkeys(int(p) for p in provinces))
    if any(not 1 <= p <= 52 for p in order):
        raise ValueError("province codes are 1 to 52")
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("province_code"))
    asked = catalogue.where(F.col("province_code").isin(order)).withColumn("_rank", rank)
    names = F.array_join(F.transform("types", lambda t: F.coalesce(t["name"], t["id"].cast("string"))), " / ").alias("transport_types")
    wanted = F.exists("types", lambda t: t["id"].isin(*map(int, types)))
    base = ["province_code", "dataset_id", "dataset_name"]
    out = asked.where(~wanted | F.col("types").isNull()).select(*base, names, F.lit("not_requested_type").alias("status"))
    each = asked.where(wanted).select(*base, names, "_rank", F.explode("files").alias("f")).where(F.col("f.id").isNotNull())
    first = each.groupBy(F.col("f.id").alias("file_id")).agg(F.min_by(F.struct(*base, "transport_types", F.col("f.name").alias("file_name")), F.struct("_rank", "dataset_id")).alias("r"))
    return first.select("r.province_code", "r.dataset_id", "r.dataset_name", "r.transport_types", "file_id", "r.file_name"), out


def province_like(name: str, regions: Iterable[Mapping]) -> int:
    """The id of the province (``tipo`` 0) whose name is most like ``name``: a guess where no code is known."""
    provinces = [r for r in regions if str(r.get("tipo")) == "0"]
    if not provinces:
        raise ValueError("the catalogue lists no province")
    like = lambda r: difflib.SequenceMatcher(None, plain_name(name), plain_name(r.get("nombre") or "")).ratio()
    return int(max(provinces, key=like)["id"])


def listed_datasets(spark: SparkSession, provinces: Iterable[int], datasets: Callable[[int], Iterable[Mapping] | None]) -> DataFrame:
    """A catalogue for ``catalogue_files`` from ``datasets(province)``, which the caller provides; None: it publishes nothing."""
    rows = []
    for p in dict.fromkeys(int(p) for p in provinces):
        for d in datasets(p) or ():
            types = [(int(t["id"]), t.get("name")) for t in d.get("types") or ()]
            files = [(int(f["id"]), f.get("name")) for f in d.get("files") or ()]
            rows.append((p, int(d["id"]), d.get("name"), types, files))
    return spark.createDataFrame(rows, "province_code int, dataset_id bigint, dataset_name string, types array<struct<id: int, name: string>>, files array<struct<id: bigint, name: string>>")


def fetch_files(files: Iterable[Mapping], folder: str | Path, fetch: Callable[[Mapping], bytes], *, fail_fast: bool = False, fatal: type[BaseException] | tuple = ()) -> list[dict]:
    """Report rows of the files fetched into ``folder`` by ``fetch``, which the caller provides; a failure is a row, not an end.

    ``fatal`` errors (a rejected key, say) and, with ``fail_fast``, all errors are raised.
    """
    target = Path(folder)
    target.mkdir(parents=True, exist_ok=True)
    report = []
    for f in files:
        row = {c: f.get(c) for c in REPORT_COLUMNS}
        try:
            (target / (f.get("file_name") or f"{f['file_id']}.zip")).write_bytes(fetch(f))
            row |= {"status": "downloaded", "error": None}
        except Exception as e:
            row |= {"status": "failed", "error": str(e)}
            if fail_fast or isinstance(e, fatal):
                raise
        report.append(row)
    return report


def settings(name: str, given: str | None = None, start: str | Path | None = None) -> str | None:
    """A setting: as given, else from the environment, else from the nearest ``.env`` file of the folder or its parents."""
    if given:
        return given
    if os.environ.get(name):
        return os.environ[name]
    folder = Path(start or Path.cwd()).resolve()
    for place in (folder, *folder.parents):
        if (place / ".env").is_file():
            for line in (place / ".env").read_text(encoding="utf-8").splitlines():
                key, eq, value = line.strip().partition("=")
                if eq and not line.lstrip().startswith("#") and key.strip().removeprefix("export ").strip() == name:
                    return value.strip().strip("'\"") or None
            return None
    return None
