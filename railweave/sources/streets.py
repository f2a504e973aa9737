"""Street answers (JSON with nodes and ways), boundaries (GeoJSON), node-link graphs and matrix files."""

from __future__ import annotations

import json
import shutil
import sqlite3
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import ExitStack
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.functions.tags import keep_ways, parse_filter
from railweave.operators.network import Network, build_matrix
from railweave.scale import cut, drop_shared, put_shared

#: The version of the matrix file, its keys, and node columns by key.
MATRIX_VERSION = 1
NODE_KEYS = {"layer": "node_layer", "node_id": "node_id", "x": "node_x", "y": "node_y", "in_area": "node_in_area"}
WEIGHT_PREFIX = "w_"
#: Bytes of a matrix that the driver is sent at once, and rows that it reads from a file at once.
PART_BYTES, PIECE_ROWS = 8 << 20, 1 << 16

ANSWER = "elements array<struct<type: string, id: bigint, lat: double, lon: double, nodes: array<bigint>, tags: map<string, string>>>"


class TemporaryFailure(RuntimeError):
    """A failure that may pass: the server is busy or cut its answer."""


def with_retries(action: Callable, waits: Sequence[float] = (10, 20, 40, 80), sleep: Callable[[float], None] = time.sleep):
    """``action()``, again after each wait while it raises ``TemporaryFailure``; other errors are raised at once."""
    for wait in waits:
        try:
            return action()
        except TemporaryFailure:
            sleep(wait)
    return action()


def temporary(status: int | None, text: str = "") -> bool:
    """Whether an answer's status (or its remark) says that trying again may help."""
    return status in (429,) or (status or 0) >= 500 or "runtime error" in text.lower()


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a street answer: ``(type, id, lat, lon, nodes, tags)``."""
    return spark.read.schema(ANSWER).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*")


def street_networks(elements: DataFrame, filters: dict[str, str]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """``{mode: (ways, nodes)}``: each mode's part of one shared answer, scanned once."""
    parsed = {mode: parse_filter(text) for mode, text in filters.items()}
    bad = [m for m, p in parsed.items() if p is None]
    if bad:
        raise ValueError(f"filters that can't be read: {', '.join(bad)}")
    shared = cut(elements)
    return {mode: keep_ways(shared, clauses) for mode, clauses in parsed.items()}


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``(properties map<string,string>, kind, rings array<array<struct<x, y>>>)`` of a collection of (multi)polygons."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("text"))
    rings = F.when(F.col("kind") == "MultiPolygon", F.flatten(F.from_json("text", "array<array<array<array<double>>>>"))).otherwise(F.from_json("text", "array<array<array<double>>>"))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return raw.select("properties", "kind", F.transform(rings, lambda r: F.transform(r, point)).alias("rings"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a node-link graph file, whose edges are under ``edges`` or, in old files, ``links``."""
    raw = spark.read.json(path, multiLine=True)
    key = "edges" if "edges" in raw.columns else "links"
    if key not in raw.columns or "nodes" not in raw.columns:
        raise ValueError(f"{path} is no node-link graph")
    nodes = raw.select(F.posexplode("nodes").alias("_ordinal", "n")).select("_ordinal", "n.*").withColumnRenamed("id", "node_id")
    edges = raw.select(F.posexplode(key).alias("_ordinal", "e")).select("_ordinal", "e.*")
    return nodes, edges.withColumnRenamed("source", "from_node").withColumnRenamed("target", "to_node")


def graph_matrix(spark: SparkSession, path: str, weights: Sequence[str] = ("tts", "length")) -> Network:
    """The network of a node-link graph file; raises ``ValueError`` if it lacks places or travel times."""
    nodes, edges = read_graph(spark, path)
    if not {"x", "y"} <= set(nodes.columns) or "tts" not in edges.columns:
        raise ValueError(f"{path}: the graph needs x, y and tts")
    return build_matrix(nodes, edges, weights)


def _packed(kinds: Sequence[tuple[str, str]]) -> Callable:
    """For ``mapInArrow``: of each batch one row, which holds each column's values as the bytes of the kind given."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = (np.array(c.to_pylist(), kind) if kind.startswith("<U") else c.to_numpy(zero_copy_only=False).astype(kind) for c, (_, kind) in zip(batch.columns, kinds))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], names=[name for name, _ in kinds])

    return pack


def _to_files(df: DataFrame, order: Sequence[str], kinds: Sequence[tuple[str, str]], rows: int, folder: Path) -> dict[str, Path]:
    """The columns of ``df`` in the given order, each as the bytes of a file in ``folder``; the driver has one part of the rows at a time."""
    folder.mkdir()
    parts = -(-rows * sum(np.dtype(kind).itemsize for _, kind in kinds) // PART_BYTES) or 1
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*[name for name, _ in kinds])
    packed = placed.mapInArrow(_packed(kinds), ", ".join(f"`{name}` binary" for name, _ in kinds))
    places = {name: folder / str(i) for i, (name, _) in enumerate(kinds)}
    with ExitStack() as stack:
        files = [stack.enter_context(place.open("wb")) for place in places.values()]
        for row in packed.toLocalIterator():
            for file, values in zip(files, row):
                file.write(values)
    return places


def _begins(rows: Path, kind: str, n: int) -> Path:
    """A file beside ``rows``, the sorted row numbers of all entries: where the entries of each of ``n`` rows begin, and the number of entries."""
    place = rows.with_name("indptr")
    told = seen = 0
    with rows.open("rb") as source, place.open("wb") as out:

        def tell(upto: int, piece: np.ndarray) -> None:
            for a in range(told, upto, PIECE_ROWS):
                out.write((seen + np.searchsorted(piece, np.arange(a, min(a + PIECE_ROWS, upto)))).astype(kind).tobytes())

        while len(piece := np.frombuffer(source.read(PIECE_ROWS * np.dtype(kind).itemsize), kind)):
            tell(int(piece[-1]) + 1, piece)
            told, seen = max(told, int(piece[-1]) + 1), seen + len(piece)
        tell(n + 1, np.array([], kind))
    return place


def write_matrix(network: Network, path: str | Path) -> Path:
    """The network as one compressed file of arrays in compressed sparse row form, nothing pickled; the default weight is ``data``.

    Entries and nodes are sorted by the executors and pass the driver in parts, by way of files beside ``path``, as
    large as the arrays.  Ids that are neither numbers nor text are written as text; raises ``ValueError`` for nodes without an id.
    """
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    n, m = network.n_nodes(), network.n_edges()
    small = "<i4" if max(n, m) < 2**31 else "<i8"
    nodes, id_type = network.nodes, dict(network.nodes.dtypes)["node_id"]
    layer = F.coalesce(F.col("layer").cast("string"), F.lit("None")) if "layer" in nodes.columns else F.lit(str(network.meta.get("layer", "")))
    kind = "<i8" if id_type in ("tinyint", "smallint", "int", "bigint") else "<f8" if id_type in ("float", "double") else ""
    number = lambda c: F.col(c).cast("double")
    nodes = nodes.select(
        "row", layer.alias(NODE_KEYS["layer"]), F.col("node_id").cast({"<i8": "bigint", "<f8": "double", "": "string"}[kind]).alias(NODE_KEYS["node_id"]),
        number("x").alias(NODE_KEYS["x"]), number("y").alias(NODE_KEYS["y"]), F.coalesce("in_area", F.lit(False)).alias(NODE_KEYS["in_area"]),
    )
    width = lambda k: F.coalesce(F.max(F.char_length(F.col(NODE_KEYS[k]).cast("string"))), F.lit(0))
    told = nodes.agg(width("layer").alias("layer"), width("node_id").alias("node_id"), F.count_if(F.col(NODE_KEYS["node_id"]).isNull()).alias("lost")).first()
    if told["lost"]:
        raise ValueError(f"{told['lost']} nodes have no id")
    text = lambda k: f"<U{max(told[k], 1)}"
    of_nodes = [(NODE_KEYS["layer"], text("layer")), (NODE_KEYS["node_id"], kind or text("node_id")), (NODE_KEYS["x"], "<f8"), (NODE_KEYS["y"], "<f8"), (NODE_KEYS["in_area"], "|b1")]
    weights = [f"{WEIGHT_PREFIX}{w}" for w in network.weights]
    edges = network.edges.select("row", "col", F.col("row").alias("rows"), F.col("col").alias("indices"), *[number(w).alias(k) for w, k in zip(network.weights, weights)])
    of_edges = [("rows", small), ("indices", small), *[(k, "<f8") for k in weights]]
    meta = {**network.meta, "format_version": MATRIX_VERSION, "default_weight": network.default_weight}
    with tempfile.TemporaryDirectory(dir=target.parent) as own:
        places = _to_files(nodes, ["row"], of_nodes, n, Path(own, "nodes")) | _to_files(edges, ["row", "col"], of_edges, m, Path(own, "edges"))
        places["indptr"] = _begins(places.pop("rows"), small, n)
        arrays = [("indptr", n + 1, small, places["indptr"]), *((k, n, stored, places[k]) for k, stored in of_nodes), *((k, m, stored, places[k]) for k, stored in of_edges[1:]), ("data", m, "<f8", places[f"{WEIGHT_PREFIX}{network.default_weight}"])]
        if any(place.stat().st_size != size * np.dtype(stored).itemsize for _, size, stored, place in arrays):
            raise ValueError("the network's rows changed while they were written")
        # the higher levels take four times as long for a tenth less
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
            for name, values in (("format", np.array("csr")), ("shape", np.array([n, n], np.int64)), ("meta", np.array(json.dumps(meta, ensure_ascii=False)))):
                with archive.open(f"{name}.npy", "w") as out:
                    np.lib.format.write_array(out, values, allow_pickle=False)
            for name, size, stored, place in arrays:
                with archive.open(f"{name}.npy", "w", force_zip64=True) as out, place.open("rb") as values:
                    np.lib.format.write_array_header_1_0(out, {"descr": stored, "fortran_order": False, "shape": (size,)})
                    shutil.copyfileobj(values, out, 1 << 20)
    return target


class _Stored:
    """An array of a matrix file, read from its begin on in pieces; raises ``ValueError`` if it has several dimensions, holds objects or ends early."""

    def __init__(self, archive: zipfile.ZipFile, name: str):
        self.name, self.file = f"{archive.filename}: {name}", archive.open(f"{name}.npy")
        header = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(np.lib.format.read_magic(self.file))
        if header is None:
            raise ValueError(f"{self.name} is of an unknown version")
        shape, _, self.stored = header(self.file)
        if len(shape) != 1 or self.stored.hasobject:
            raise ValueError(f"{self.name} isn't a plain array")
        self.size = shape[0]
        # kinds that Spark knows: no unsigned and no half numbers
        self.kind = {"u": np.dtype("i8"), "f": np.dtype("f8")}.get(self.stored.kind, self.stored.newbyteorder("="))

    def take(self, n: int) -> np.ndarray:
        piece = self.file.read(n * self.stored.itemsize)
        if len(piece) != n * self.stored.itemsize:
            raise ValueError(f"{self.name} ends early")
        return np.frombuffer(piece, self.stored).astype(self.kind)

    @property
    def arrow(self) -> pa.DataType:
        return pa.string() if self.kind.kind == "U" else pa.from_numpy_dtype(self.kind)


def _placed(spark: SparkSession, pieces: Iterable[dict], schema: pa.Schema) -> DataFrame:
    """The rows of all pieces, written one by one to a file that the executors read from the shared folder."""
    with tempfile.TemporaryDirectory() as own:
        local = f"{own}/rows.parquet"
        with pq.ParquetWriter(local, schema) as out:
            for piece in pieces:
                out.write_table(pa.table({k: v.tolist() if v.dtype.kind == "U" else v for k, v in piece.items()}, schema))
        shared = put_shared(spark, local, f"matrix-{uuid.uuid4().hex}.parquet")
    rows = cut(spark.read.parquet(shared))
    drop_shared(spark, shared)
    return rows


def read_matrix(spark: SparkSession, path: str | Path) -> Network:
    """The network of a matrix file; raises ``ValueError`` for missing arrays, lengths that don't fit and newer versions.

    The arrays are read side by side in pieces, so that the driver never has a whole one.
    """
    with Path(path).open("rb") as file, ExitStack() as stack:
        if not zipfile.is_zipfile(file):
            raise ValueError(f"{path} is no matrix file")
        archive = stack.enter_context(zipfile.ZipFile(file))
        names = [k.removesuffix(".npy") for k in archive.namelist()]
        missing = [k for k in ("indptr", "indices", "data", "meta", *NODE_KEYS.values()) if k not in names]
        if missing:
            raise ValueError(f"{path} is no matrix file: it lacks {', '.join(missing)}")
        with archive.open("meta.npy") as text:
            meta = json.loads(str(np.lib.format.read_array(text, allow_pickle=False)))
        if int(meta.get("format_version", 0)) > MATRIX_VERSION:
            raise ValueError(f"{path} has version {meta['format_version']}; up to {MATRIX_VERSION} can be read")

        def stored(name: str) -> _Stored:
            array = _Stored(archive, name)
            stack.callback(array.file.close)
            return array

        weights = {k.removeprefix(WEIGHT_PREFIX): stored(k) for k in names if k.startswith(WEIGHT_PREFIX)} or {"weight": stored("data")}
        indptr, indices, columns = stored("indptr"), stored("indices"), {c: stored(k) for c, k in NODE_KEYS.items()}
        n = indptr.size - 1
        misfit = ValueError(f"{path}: its arrays don't fit together")
        if any(v.size != n for v in columns.values()) or any(v.size != indices.size for v in weights.values()):
            raise misfit

        def node_pieces() -> Iterator[dict]:
            # texts may be wide
            step = max(1, min(PIECE_ROWS, PART_BYTES // sum(v.stored.itemsize for v in columns.values())))
            for a in range(0, n, step):
                b = min(a + step, n)
                yield {**{c: v.take(b - a) for c, v in columns.items()}, "row": np.arange(a, b)}

        def edge_pieces() -> Iterator[dict]:
            last = indptr.take(1)
            if last[0] != 0:
                raise misfit
            for a in range(0, n, PIECE_ROWS):
                # where the entries of these rows begin, and where the last one's end
                begins = last = np.r_[last[-1:], indptr.take(min(PIECE_ROWS, n - a))]
                if (np.diff(begins) < 0).any() or begins[-1] > indices.size:
                    raise misfit
                # a row may have any number of entries
                for p in range(int(begins[0]), int(begins[-1]), PIECE_ROWS):
                    q = min(p + PIECE_ROWS, int(begins[-1]))
                    yield {"row": a + np.searchsorted(begins, np.arange(p, q), "right") - 1, "col": indices.take(q - p).astype(np.int64), **{w: v.take(q - p) for w, v in weights.items()}}
            if last[-1] != indices.size:
                raise misfit

        edges = _placed(spark, edge_pieces(), pa.schema([("row", pa.int64()), ("col", pa.int64()), *((w, v.arrow) for w, v in weights.items())]))
        nodes = _placed(spark, node_pieces(), pa.schema([*((c, v.arrow) for c, v in columns.items()), ("row", pa.int64())]))
    return Network(nodes, edges, tuple(weights), meta)


def load_network(spark: SparkSession, source, mode: str | None = None) -> Network:
    """The network of whatever is given: a ``Network``, a file, or a folder (of one mode, or with a folder per mode).

    In a folder the first of a matrix file, a node-link graph and Parquet layers is read.
    """
    if isinstance(source, Network):
        return source
    path = Path(source)
    if path.is_file():
        return read_matrix(spark, path) if path.suffix == ".npz" else graph_matrix(spark, f"file://{path.resolve()}")
    if not path.is_dir():
        raise FileNotFoundError(f"no such network: {source}")
    folder = path / mode if mode and (path / mode).is_dir() else path
    for name in ("matrix.npz", "graph.json"):
        if (folder / name).is_file():
            return load_network(spark, folder / name)
    if (folder / "edges.parquet").exists():
        return build_matrix(spark.read.parquet(f"file://{(folder / 'nodes.parquet').resolve()}"), spark.read.parquet(f"file://{(folder / 'edges.parquet').resolve()}"), ("tts", "length", "tts_m"))
    modes = sorted(p.name for p in path.iterdir() if (p / "matrix.npz").is_file() or (p / "graph.json").is_file())
    raise ValueError(f"{source} holds no network" if not modes else f"{source} holds several networks; give mode as one of {', '.join(modes)}")


def polygon_layer(path: str | Path) -> str:
    """The layer of a GeoPackage to read: its only layer, else its only polygon layer; raises ``ValueError`` otherwise."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        layers = db.execute("select c.table_name, g.geometry_type_name from gpkg_contents c left join gpkg_geometry_columns g using (table_name) where c.data_type = 'features'").fetchall()
    polygons = [n for n, kind in layers if str(kind).upper() in ("POLYGON", "MULTIPOLYGON")]
    if len(layers) == 1:
        return layers[0][0]
    if len(polygons) == 1:
        return polygons[0]
    raise ValueError(f"{path} has {len(layers)} layers, {len(polygons)} of polygons; there must be one")
