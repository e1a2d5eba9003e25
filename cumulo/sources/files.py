"""Files of point clouds as Spark data sources, and sinks.

Files are opened through pyarrow's file systems, so that any store with a URI will do, and only columns
that the schema asks for are taken apart. A partition is a file, or of ply and LAS files, whose records
have one size, a range of SPLIT_BYTES at most, read in batches of BATCH records. Readers give rows of (shape_id, role, point_id, x, y, z, nx, ny, nz, sx, sy, sz, r, g, b); a
file's missing columns are null.
"""

from __future__ import annotations

import io
import re
import struct
import tempfile
import uuid
import zipfile
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.mixing import substitute_missing, unpack_bits
from ..operators.ranks import with_group
from .storage import arrow_uri, checkpointed, opened

POINT_SCHEMA = "shape_id string, role string, point_id long, " + ", ".join(f"{p}{a} double" for p in ("", "n", "s") for a in "xyz") + ", r double, g double, b double"
#: Arrays of an npz file, and the columns that they become. Fixed names.
ARRAYS = {"points": "xyz", "xyz": "xyz", "normals": ("nx", "ny", "nz"), "normal": ("nx", "ny", "nz"), "sensor": ("sx", "sy", "sz"), "rgb": "rgb"}
#: Arrays of an npz file that is written. Fixed names.
WRITTEN = {"xyz": ("x", "y", "z"), "normal": ("nx", "ny", "nz"), "sensor": ("sx", "sy", "sz"), "rgb": ("r", "g", "b")}
#: Properties of a ply file under other names than the columns'. Fixed names.
PROPERTIES = {"sensor_x": "sx", "sensor_y": "sy", "sensor_z": "sz", "red": "r", "green": "g", "blue": "b"}
#: Types of ply properties. Fixed names.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


#: Bytes of records in a partition of a file that can be split, and records in a batch.
SPLIT_BYTES = 64 << 20
BATCH = 1 << 16
#: Ranges of all files together that are read by a task each, as long as they have SPLIT_BYTES at most: smaller ones are joined.
RANGES = 256
#: Bytes of a header that are read at a time, and at most.
HEAD_BYTES, MOST_HEAD_BYTES = 1 << 16, 1 << 24


def read_bytes(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_file(path) as file:
        return file.read()


def write_bytes(uri: str, data: bytes) -> None:
    fs, path = opened(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as file:
        file.write(data)


def file_name(shape: str) -> str:
    """A name without slashes or percent signs, different for different shapes."""
    return quote(shape, safe="").replace("~", "%7E").replace("%", "~")


def stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rpartition("/")[2])


def npz_columns(data: bytes, wanted: set[str]) -> dict[str, np.ndarray]:
    """Columns of an npz file; arrays that hold no wanted column are not decompressed."""
    out: dict[str, np.ndarray] = {}
    with np.load(io.BytesIO(data), allow_pickle=False) as file:
        for name, columns in ARRAYS.items():
            if name in file.files and wanted & set(columns):
                values = file[name].astype(np.float64)
                out |= {c: values[:, i] for i, c in enumerate(columns)}
    return out


@dataclass(frozen=True)
class Layout:
    """Records of one size: where they start, how many there are, their type, and what makes columns of them."""

    start: int
    count: int
    kind: np.dtype
    columns: Callable[[np.ndarray, set[str]], dict[str, np.ndarray]]


def _ply_head(head: bytes) -> tuple[str, int, list[tuple[str, str]], int]:
    """The order of a ply file, the number of its vertices, their properties and types, and where they start."""
    text, mark, rest = head.partition(b"end_header")
    if not mark or b"\n" not in rest:
        raise ValueError("a ply file without the end of its header")
    lines = [line.split() for line in text.decode().splitlines()]
    order = next(line[1] for line in lines if line[:1] == ["format"])
    first = next(i for i, line in enumerate(lines) if line[:2] == ["element", "vertex"])
    if any(line[:1] == ["element"] for line in lines[:first]):
        raise ValueError("vertices must come first")
    fields = []
    for line in lines[first + 1 :]:
        if line[:1] == ["element"]:
            break
        if line[:1] == ["property"]:
            fields.append((line[-1], PLY_TYPES[line[1]]))
    return order, int(lines[first][2]), fields, len(text) + len(mark) + rest.index(b"\n") + 1


def _ply_named(values: dict[str, np.ndarray], fields: list[tuple[str, str]], wanted: set[str]) -> dict[str, np.ndarray]:
    """Vertices under the names of columns; colours of whole bytes become 0 to 1."""
    whole = {name for name, kind in fields if kind == "u1" and name in ("red", "green", "blue")}
    out = {PROPERTIES.get(name, name): v / 255.0 if name in whole else v for name, v in values.items()}
    return {c: v for c, v in out.items() if c in wanted}


def ply_layout(head: bytes) -> Layout | None:
    """The vertices of a binary ply file; an ASCII one, whose lines have any length, has none."""
    order, n, fields, start = _ply_head(head)
    if order == "ascii":
        return None
    mark = "<" if order == "binary_little_endian" else ">"
    kind = np.dtype([(name, mark + t) for name, t in fields])
    return Layout(start, n, kind, lambda rows, wanted: _ply_named({name: rows[name].astype(np.float64) for name, _ in fields if PROPERTIES.get(name, name) in wanted}, fields, wanted))


def _all_columns(data: bytes, layout: Layout, wanted: set[str]) -> dict[str, np.ndarray]:
    if len(data) < layout.start + layout.count * layout.kind.itemsize:
        raise ValueError(f"a file of {layout.count} records ends early")
    return layout.columns(np.frombuffer(data, layout.kind, layout.count, layout.start), wanted)


def ply_columns(data: bytes, wanted: set[str]) -> dict[str, np.ndarray]:
    """Columns of a ply file's vertices, ASCII or binary of either order."""
    layout = ply_layout(data)
    if layout is not None:
        return _all_columns(data, layout, wanted)
    _, n, fields, start = _ply_head(data)
    table = np.array([row.split()[: len(fields)] for row in data[start:].decode().splitlines()[:n]], np.float64).reshape(n, len(fields))
    return _ply_named({name: table[:, i] for i, (name, _) in enumerate(fields)}, fields, wanted)


def ply_bytes(columns: dict[str, np.ndarray], faces: np.ndarray | None = None) -> bytes:
    """A binary ply file of doubles, with triangles if given."""
    n = len(next(iter(columns.values()))) if columns else 0
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *(f"property double {c}" for c in columns)]
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    body = np.rec.fromarrays(list(columns.values()), dtype=[(c, "<f8") for c in columns]).tobytes() if n else b""
    if faces is not None and len(faces):
        body += np.rec.fromarrays([np.full(len(faces), 3), faces.astype("<i4")], dtype=[("n", "u1"), ("v", "<i4", (3,))]).tobytes()
    return ("\n".join([*head, "end_header"]) + "\n").encode() + body


def las_layout(head: bytes) -> Layout:
    """The records of a LAS file, which start with scaled and shifted integers.

    Their number has 64 bits from version 1.4 on, whose files may leave the older field at 0. Compressed records are an error.
    """
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    if head[104] & 0xC0:
        raise ValueError("compressed LAS records can't be read")
    start, = struct.unpack_from("<I", head, 96)
    size, n = struct.unpack_from("<HI", head, 105)
    if (head[24], head[25]) >= (1, 4):
        n, = struct.unpack_from("<Q", head, 247)
    scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    kind = np.dtype({"names": list("xyz"), "formats": ["<i4"] * 3, "offsets": [0, 4, 8], "itemsize": size})
    return Layout(start, n, kind, lambda rows, wanted: {a: rows[a] * scale[i] + shift[i] for i, a in enumerate("xyz") if a in wanted})


def las_columns(data: bytes, wanted: set[str]) -> dict[str, np.ndarray]:
    """Coordinates of a LAS file; one that ends before its records do is an error."""
    return _all_columns(data, las_layout(data), wanted)


def _lattice(shape, low, high) -> dict[str, float]:
    """The columns that a lattice has: its bounds, and its cells on each axis."""
    out = {f"{side}_{a}": float(v) for side, corner in (("min", low), ("max", high)) for a, v in zip("xyz", corner, strict=True)}
    return out | {f"cells_{a}": int(n) for a, n in zip("xyz", shape, strict=True)}


def _seekable(data):
    return io.BytesIO(data) if isinstance(data, bytes) else data


def volume_columns(data, wanted: set[str]) -> dict[str, np.ndarray]:
    """Cells of the volume of a geometry file (bytes, or opened), with its lattice; cells that hold no number are unknown and left out."""
    with np.load(_seekable(data), allow_pickle=False) as file:
        if "volume" not in file:
            return {c: np.zeros(0) for c in wanted & {"val", *"ijk", *_LATTICE}}
        cells, low, high = file["volume"].astype(np.float64), file["volume_min"], file["volume_max"]
    at = np.nonzero(~np.isnan(cells))
    out = {"val": cells[at]} | {name: index.astype(np.int32) for name, index in zip("ijk", at, strict=True)}
    out |= {c: np.full(len(at[0]), v, np.int32 if isinstance(v, int) else np.float64) for c, v in _lattice(cells.shape, low, high).items()}
    return {c: v for c, v in out.items() if c in wanted}


def lattice_columns(data, wanted: set[str]) -> dict[str, np.ndarray]:
    """The lattice of a geometry file's volume, without its cells; a file without a volume gives no row."""
    with zipfile.ZipFile(_seekable(data)) as archive:
        if "volume.npy" not in archive.namelist():
            return {c: np.zeros(0) for c in wanted & set(_LATTICE)}
        with archive.open("volume.npy") as file:
            version = np.lib.format.read_magic(file)
            shape = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)[0]
        low, high = (np.lib.format.read_array(archive.open(f"volume_{side}.npy"), allow_pickle=False) for side in ("min", "max"))
    return {c: np.array([v], np.int32 if isinstance(v, int) else np.float64) for c, v in _lattice(shape, low, high).items() if c in wanted}


def _volume_arrays(columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The volume of rows that have a lattice, and i, j, k and val. Cells that no row names are unknown.

    Rows with a lattice must agree on it; the grid has its size, or ends with the last cell where rows have bounds only.
    """
    none = np.zeros(len(next(iter(columns.values()), [])), bool)
    volume = ~np.isnan(columns["min_x"]) if "min_x" in columns else none
    if not volume.any():
        return {}
    cell = ~np.isnan(columns["i"]) if "i" in columns else none
    at = [columns[c][cell].astype(np.int64) for c in "ijk"] if cell.any() else [np.zeros(0, np.int64)] * 3
    shape = [int(a.max(initial=0)) + 1 for a in at]
    told = volume & ~np.isnan(columns["cells_x"]) if "cells_x" in columns else none
    if told.any():
        sizes = np.unique(np.stack([columns[f"cells_{a}"][told] for a in "xyz"], axis=1), axis=0).astype(int)
        if len(sizes) > 1 or (sizes[0] < shape).any() and cell.any():
            raise ValueError(f"cells {shape} and lattices {sizes.tolist()} don't agree")
        shape = sizes[0].tolist()
    grid = np.full(shape, np.nan)
    if cell.any():
        grid[tuple(at)] = columns["val"][cell]
    return {"volume": grid, **{f"volume_{side}": np.array([columns[f"{side}_{a}"][volume][0] for a in "xyz"]) for side in ("min", "max")}}


class NpzFile:
    """A compressed npz file of columns that are added bit by bit: points by name, and the volume of rows that have one.

    Points wait in temporary files, so that memory holds a batch of them, and the volume.
    """

    def __init__(self, names: list[str]):
        self.parts = {name: parts for name, parts in WRITTEN.items() if set(parts) <= set(names)}
        self.waiting = {name: tempfile.TemporaryFile() for name in self.parts}
        self.n, self.rest = 0, []

    def add(self, columns: dict[str, np.ndarray]) -> None:
        none = np.zeros(len(next(iter(columns.values()))), bool)
        here = ~np.isnan(columns["x"]) if "x" in columns else none
        for name, parts in self.parts.items():
            self.waiting[name].write(np.stack([columns[c][here] for c in parts], axis=1).astype("<f8").tobytes())
        self.n += int(here.sum())
        told = [~np.isnan(columns[c]) for c in ("min_x", "i") if c in columns]
        kept = np.logical_or.reduce(told) if told else none
        if kept.any():
            self.rest.append({c: v[kept] for c, v in columns.items() if c in ("val", *"ijk", *_LATTICE)})

    def save(self, out) -> None:
        volume = _volume_arrays({c: np.concatenate([r[c] for r in self.rest]) for c in self.rest[0]}) if self.rest else {}
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, file in self.waiting.items():
                with archive.open(f"{name}.npy", "w", force_zip64=True) as member:
                    np.lib.format.write_array_header_1_0(member, {"descr": "<f8", "fortran_order": False, "shape": (self.n, len(self.parts[name]))})
                    file.seek(0)
                    while data := file.read(1 << 22):
                        member.write(data)
            for name, array in volume.items():
                with archive.open(f"{name}.npy", "w", force_zip64=True) as member:
                    np.lib.format.write_array(member, array, allow_pickle=False)

    def close(self) -> None:
        for file in self.waiting.values():
            file.close()


def npz_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """The bytes of an NpzFile of these columns."""
    out, file = io.BytesIO(), NpzFile(list(columns))
    file.add(columns)
    file.save(out)
    file.close()
    return out.getvalue()


def npy_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """An npy file of one array, with a column for each in their order."""
    out = io.BytesIO()
    np.save(out, np.stack(list(columns.values()), axis=1), allow_pickle=False)
    return out.getvalue()


def mesh_bytes(columns: dict[str, np.ndarray]) -> bytes:
    """A binary ply file of triangles with their corners ax..cz; corners in one place are one vertex."""
    corners = np.stack([columns[f"{c}{a}"] for c in "abc" for a in "xyz"], axis=1).reshape(-1, 3)
    vertices, at = np.unique(corners, axis=0, return_inverse=True)
    return ply_bytes({a: vertices[:, i] for i, a in enumerate("xyz")}, at.reshape(-1, 3))


def ply_mesh_columns(data: bytes, wanted: set[str]) -> dict[str, np.ndarray]:
    """Corners of the faces of a binary ply file whose faces come next to its vertices; faces of more corners become fans."""
    layout = ply_layout(data)
    if layout is None:
        raise ValueError("faces of ASCII ply files can't be read")
    lines = [line.split() for line in data.partition(b"end_header")[0].decode().splitlines()]
    at = next((i for i, line in enumerate(lines) if line[:2] == ["element", "face"]), None)
    if at is None:
        return {f"{c}{a}": np.zeros(0) for c in "abc" for a in "xyz" if f"{c}{a}" in wanted}
    if len(lines) > at + 2 and lines[at + 2][:1] == ["property"] or lines[at + 1][:2] != ["property", "list"]:
        raise ValueError("faces must have a list of vertices, and nothing else")
    mark = ">" if layout.kind[0].str.startswith(">") else "<"
    size, index = (np.dtype(mark + PLY_TYPES[t]) for t in lines[at + 1][2:4])
    start, n = layout.start + layout.count * layout.kind.itemsize, int(lines[at][2])
    three = np.dtype([("n", size), ("v", index, (3,))])
    faces = np.zeros((0, 3), np.int64)
    if n and len(data) >= start + n * three.itemsize and (rows := np.frombuffer(data, three, n, start))["n"].max() == 3 == rows["n"].min():
        faces = rows["v"].astype(np.int64)
    elif n:
        fans = []
        for _ in range(n):
            corners = int(np.frombuffer(data, size, 1, start)[0])
            face = np.frombuffer(data, index, corners, start + size.itemsize)
            fans += [(face[0], b, c) for b, c in zip(face[1:], face[2:], strict=False)]
            start += size.itemsize + corners * index.itemsize
        faces = np.array(fans, np.int64).reshape(-1, 3)
    places = _all_columns(data, layout, set("xyz"))
    return {f"{c}{a}": places[a][faces[:, i]] for i, c in enumerate("abc") for a in "xyz" if f"{c}{a}" in wanted}


def obj_columns(data: bytes, wanted: set[str]) -> dict[str, np.ndarray]:
    """Corners of the faces of an OBJ file; faces of more corners become fans, and corners count back from the end if negative."""
    vertices, faces = [], []
    for line in data.decode(errors="replace").splitlines():
        word = line.split()
        if word[:1] == ["v"]:
            vertices.append([float(v) for v in word[1:4]])
        elif word[:1] == ["f"]:
            corner = [int(c.split("/")[0]) for c in word[1:]]
            corner = [c - 1 if c > 0 else len(vertices) + c for c in corner]
            faces += [(corner[0], b, c) for b, c in zip(corner[1:], corner[2:], strict=False)]
    at = np.array(vertices, np.float64).reshape(-1, 3)[np.array(faces, np.int64).reshape(-1, 3)]
    return {f"{c}{a}": at[:, i, k] for i, c in enumerate("abc") for k, a in enumerate("xyz") if f"{c}{a}" in wanted}


#: Formats whose records can be read from any one on.
LAYOUTS = {"ply": ply_layout, "las": las_layout}
DECODERS = {"npz": npz_columns, "ply": ply_columns, "las": las_columns}
#: Sources that aren't points: their reader and schema. Rows are numbered by point_id and face_id.
_LATTICE = [*(f"{side}_{a}" for side in ("min", "max") for a in "xyz"), *(f"cells_{a}" for a in "xyz")]
LATTICE_SCHEMA = "shape_id string, " + ", ".join(f"{c} {'int' if c.startswith('cells') else 'double'}" for c in _LATTICE)
VOLUME_SCHEMA = "shape_id string, i int, j int, k int, val double, " + LATTICE_SCHEMA.removeprefix("shape_id string, ")
MESH_SCHEMA = "shape_id string, face_id long, " + ", ".join(f"{c}{a} double" for c in "abc" for a in "xyz")
OTHERS = {"volume_npz": (volume_columns, VOLUME_SCHEMA), "lattice_npz": (lattice_columns, LATTICE_SCHEMA), "mesh_obj": (obj_columns, MESH_SCHEMA), "mesh_ply": (ply_mesh_columns, MESH_SCHEMA)}
ENCODERS = {"ply": ply_bytes, "npz": npz_bytes, "npy": npy_bytes, "mesh": mesh_bytes}
#: File name endings of kinds whose names are others.
SUFFIXES = {"mesh": "ply"}
#: Files that the driver moves at once.
MOVERS = 16


def _head(file, size: int) -> bytes:
    """The start of a file: HEAD_BYTES, or of a ply file to the end of its header."""
    data = file.read(HEAD_BYTES)
    while data[:3] == b"ply" and b"\n" not in data.partition(b"end_header")[2] and len(data) < min(size, MOST_HEAD_BYTES):
        data += file.read(HEAD_BYTES)
    return data


def _sizes(paths: list[str]) -> list[int]:
    """Bytes of each file, asked for together where they are in one store; -1 where there is none."""
    stores: dict[str, list[tuple[int, str]]] = defaultdict(list)
    systems = {}
    for i, uri in enumerate(paths):
        fs, at = opened(uri)
        store = re.match(r"(?:\w+://[^/]*)?", arrow_uri(uri))[0]
        systems.setdefault(store, fs)
        stores[store].append((i, at))
    out = [-1] * len(paths)
    for store, files in stores.items():
        for (i, _), info in zip(files, systems[store].get_file_info([at for _, at in files]), strict=True):
            out[i] = info.size if info.is_file else -1
    return out


def _ranges(path: str, size: int, layout_of: Callable[[bytes], Layout | None], most: int) -> list[tuple[int, int | None]]:
    """(first, count) of records, for partitions of `most` bytes of records; one of the whole where there is no layout.

    A file whose header can't be read is left to its task, which says so.
    """
    try:
        fs, at = opened(path)
        with fs.open_input_file(at) as file:
            layout = layout_of(_head(file, size))
    except (OSError, ValueError, LookupError, StopIteration, struct.error):
        layout = None
    if layout is None or layout.count == 0:
        return [(0, None)]
    step = max(1, most // max(layout.kind.itemsize, 1))
    return [(first, min(step, layout.count - first)) for first in range(0, layout.count, step)]


class _Reader(DataSourceReader):
    """Options: paths and names by line, role, shape, splitbytes, and onerror: `fail`, `missing` or `any`.

    With the last two, a file that is missing or (`any`) can't be read gives a row of its shape_id and `error`, beside what
    was read of it before. Files are opened when a job is planned only if they are larger than splitbytes.
    """

    def __init__(self, schema: StructType, options, decode, layout=None):
        self.schema, self.options, self.decode, self.layout = schema, options, decode, layout

    def partitions(self):
        paths = [p.strip() for p in self.options.get("paths", self.options.get("path", "")).split("\n") if p.strip()]
        names = self.options.get("names", "").split("\n") if self.options.get("names") else map(stem, paths)
        files = sorted(zip(paths, names, strict=True))
        if self.layout is None:
            return [InputPartition((*f, 0, None)) for f in files] or [InputPartition(None)]
        most = int(self.options.get("splitbytes", SPLIT_BYTES))
        parts, sizes = [], _sizes([f[0] for f in files])
        # A task costs more than reading a small range does.
        most = max(most, min(SPLIT_BYTES, sum(sizes) // RANGES))
        for (path, name), size in zip(files, sizes, strict=True):
            parts += [InputPartition((path, name, *r)) for r in (_ranges(path, size, self.layout, most) if size > most else [(0, None)])]
        return parts or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, shape, first, count = partition.value
        try:
            for at, columns in self._pieces(path, first, count):
                yield self._batch(shape, columns, at)
        except Exception as error:
            told = self.options.get("onerror", "fail")
            if told != "any" and not (told == "missing" and isinstance(error, FileNotFoundError)):
                raise
            yield self._batch(shape, {}, 0, f"{type(error).__name__}: {error}")

    def _pieces(self, path: str, first: int, count: int | None) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
        """Columns with the number of their first row."""
        wanted = set(self.schema.fieldNames())
        fs, at = opened(path)
        with fs.open_input_file(at) as file:
            head = b"" if self.layout is None else _head(file, file.size())
            layout = None if self.layout is None else self.layout(head)
            if layout is None:
                file.seek(0)
                # Of these a small part is taken, which the file may have among very many points.
                yield 0, self.decode(file if self.decode in (volume_columns, lattice_columns) else file.read(), wanted)
                return
            size, end = layout.kind.itemsize, layout.count if count is None else first + count
            file.seek(layout.start + first * size)
            while first < end:
                n = min(BATCH, end - first)
                data = file.read(n * size)
                if len(data) < n * size:
                    raise ValueError(f"a file of {layout.count} records ends early")
                yield first, layout.columns(np.frombuffer(data, layout.kind, n), wanted)
                first += n

    def _batch(self, shape: str, columns: dict[str, np.ndarray], first: int, error: str | None = None) -> pa.RecordBatch:
        names = self.schema.fieldNames()
        n = 1 if error else len(next(iter(columns.values()), []))
        number = pa.nulls(1, pa.int64()) if error else pa.array(np.arange(first, first + n, dtype=np.int64))
        text = lambda value: pa.array([value] * n, pa.string())
        fixed = {"shape_id": text(self.options.get("shape") or shape), "role": text(self.options.get("role", "input")), "error": text(error), "point_id": number, "face_id": number}
        arrays = [fixed[c] if c in fixed else pa.array(columns[c]) if c in columns else pa.nulls(n, pa.float64()) for c in names]
        return pa.RecordBatch.from_arrays(arrays, names=names)


class _Checker(_Reader):
    """A row for each file: shape_id, n and error, which is null where all its records can be read.

    Of a file with a layout, its header and size are read; others are decoded, but no row of them leaves its task.
    """

    def partitions(self):
        layout, self.layout = self.layout, None
        parts = super().partitions()
        self.layout = layout
        return parts

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        path, shape = partition.value[:2]
        told, n, error = self.options.get("onerror", "fail"), None, None
        try:
            n = self._count(path)
        except Exception as e:
            if told != "any" and not (told == "missing" and isinstance(e, FileNotFoundError)):
                raise
            error = f"{type(e).__name__}: {e}"
        made = {"shape_id": pa.array([shape], pa.string()), "n": pa.array([n], pa.int64()), "error": pa.array([error], pa.string())}
        yield pa.RecordBatch.from_arrays([made[c] for c in self.schema.fieldNames()], names=self.schema.fieldNames())

    def _count(self, path: str) -> int:
        fs, at = opened(path)
        with fs.open_input_file(at) as file:
            layout = None if self.layout is None else self.layout(_head(file, file.size()))
            if layout is not None:
                if file.size() < layout.start + layout.count * layout.kind.itemsize:
                    raise ValueError(f"a file of {layout.count} records ends early")
                return layout.count
            file.seek(0)
            columns = self.decode(file.read(), {c.split()[0] for c in POINT_SCHEMA.split(", ")})
        return len(next(iter(columns.values()), []))


@dataclass
class _Attempt(WriterCommitMessage):
    """Files that a task has written, as (where they are, where they belong)."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """A file for the rows of each shape, which must be partitioned and sorted by shape_id.

    A task writes under a folder of its own attempt. Once all tasks are done, the driver moves the files of those that count
    to their names, and drops the rest: a task that is killed or run twice leaves no file, cut off or whole. A shape that
    two tasks wrote is an error, and then none of the job's files appears. With the option `folders`, slashes in a
    shape's name are folders.
    """

    def __init__(self, schema: StructType, options, kind: str):
        self.kind = kind
        self.folder, self.names = options["path"].rstrip("/"), [f.name for f in schema if f.name not in ("shape_id", "role", "point_id", "face_id")]
        self.nested = options.get("folders", "false") == "true"
        self.attempts = f"{self.folder}/_attempts/{uuid.uuid4().hex}"

    def _name(self, shape: str) -> str:
        return "/".join(map(file_name, shape.split("/") if self.nested else [shape])) + f".{SUFFIXES.get(self.kind, self.kind)}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        held, shape, written = [], None, []
        folder = f"{self.attempts}/{uuid.uuid4().hex}"

        def put():
            if held and self.kind == "npz":
                name = self._name(str(shape))
                fs, path = opened(f"{folder}/{name}")
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                with fs.open_output_stream(path) as out:
                    held[0].save(out)
                held[0].close()
                written.append((f"{folder}/{name}", f"{self.folder}/{name}"))
            elif held:
                table = pa.Table.from_batches(held)
                columns = {c: table.column(c).to_numpy().astype(np.float64) for c in self.names}
                name = self._name(str(shape))
                write_bytes(f"{folder}/{name}", ENCODERS[self.kind](columns))
                written.append((f"{folder}/{name}", f"{self.folder}/{name}"))

        for batch in batches:
            ids = batch.column("shape_id").to_pylist()
            start = 0
            for end in range(1, len(ids) + 1):
                if end == len(ids) or ids[end] != ids[start]:
                    if held and shape != ids[start]:
                        put()
                        held = []
                    shape = ids[start]
                    if self.kind == "npz":
                        held = held or [NpzFile(self.names)]
                        part = batch.slice(start, end - start)
                        held[0].add({c: part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in self.names})
                    else:
                        held.append(batch.slice(start, end - start))
                    start = end
        put()
        return _Attempt(written)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        targets = [target for _, target in files]
        if len(set(targets)) < len(targets):
            twice = sorted({t for t in targets if targets.count(t) > 1})[:3]
            self.abort(messages)
            raise ValueError(f"written by several tasks: {twice}")

        def move(file: tuple[str, str]) -> None:
            (fs, source), (_, target) = map(opened, file)
            fs.create_dir(target.rpartition("/")[0], recursive=True)
            fs.move(source, target)

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(move, files))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Drops what attempts have left. Another job's attempts, which may be running, stay."""
        fs, at = opened(self.attempts)
        if fs.get_file_info(at).type == filesystems.FileType.Directory:
            fs.delete_dir(at)


def _source(kind: str) -> type[DataSource]:
    class Points(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"points_{kind}"

        def schema(self) -> str:
            return POINT_SCHEMA

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(schema, self.options, DECODERS[kind], LAYOUTS.get(kind))

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            if kind not in ENCODERS:
                raise ValueError(f"{kind} can't be written")
            return _Writer(schema, self.options, kind)

    return Points


class Arrays(DataSource):
    """A sink only."""

    @classmethod
    def name(cls) -> str:
        return "points_npy"

    def schema(self) -> str:
        return POINT_SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(schema, self.options, "npy")


def _other(name_: str) -> type[DataSource]:
    class Rows(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> str:
            return OTHERS[name_][1]

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Reader(schema, self.options, OTHERS[name_][0])

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            if name_ != "mesh_ply":
                raise ValueError(f"{name_} can't be written")
            return _Writer(schema, self.options, "mesh")

    return Rows


def _check(kind: str) -> type[DataSource]:
    class Status(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"status_{kind}"

        def schema(self) -> str:
            return "shape_id string, n long, error string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Checker(schema, self.options, DECODERS[kind], LAYOUTS.get(kind))

    return Status


def register(spark: SparkSession) -> None:
    for kind in DECODERS:
        spark.dataSource.register(_source(kind))
        spark.dataSource.register(_check(kind))
    for name in OTHERS:
        spark.dataSource.register(_other(name))
    spark.dataSource.register(Arrays)


def _load(spark: SparkSession, source: str, schema: str, paths: list[str], names: list[str] | None, role: str = "input", **options) -> DataFrame:
    register(spark)
    reader = spark.read.format(source).schema(schema).option("paths", "\n".join(paths)).option("role", role).options(**options)
    return (reader.option("names", "\n".join(names)) if names else reader).load()


def read_volumes(spark: SparkSession, paths: list[str], names: list[str] | None = None) -> DataFrame:
    """Cells of the volumes of geometry files, with the volume's lattice in each row: min_*, max_*, and cells_* of an axis."""
    return _load(spark, "volume_npz", VOLUME_SCHEMA, paths, names)


def read_lattices(spark: SparkSession, paths: list[str], names: list[str] | None = None) -> DataFrame:
    """shape_id, min_*, max_*, cells_* of each geometry file with a volume, as volume.classify() takes them. No cell is read."""
    return _load(spark, "lattice_npz", LATTICE_SCHEMA, paths, names)


def read_meshes(spark: SparkSession, paths: list[str], names: list[str] | None = None, kind: str = "obj") -> DataFrame:
    """Triangles of OBJ or binary ply files, as mesh.sample() takes them."""
    return _load(spark, f"mesh_{kind}", MESH_SCHEMA, paths, names)


def read_points(spark: SparkSession, kind: str, paths: list[str], role: str = "input", columns: list[str] | None = None, names: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Points of the files at `paths`; shapes are called `names`, or as the files are. Only `columns`, all by default, are taken.

    A task reads a file, or of a ply or LAS file of more than split_bytes a range of as many bytes of records, numbered from
    the range's start; ranges are longer where that makes more than RANGES of all files. A file that is missing, ends early or can't be read is an error; fetch() goes on without it.
    """
    schema = POINT_SCHEMA if columns is None else ", ".join(c for c in POINT_SCHEMA.split(", ") if c.split()[0] in columns)
    return _load(spark, f"points_{kind}", schema, paths, names, role, splitbytes=split_bytes)


def statuses(spark: SparkSession, kind: str, paths: list[str], names: list[str] | None = None, skip_on_error: bool = False) -> DataFrame:
    """shape_id, n, error of each file: error is null where all n points can be read, and n where it isn't.

    Missing files always get an error's row; others that can't be read get one with skip_on_error, and fail the job without.
    """
    return _load(spark, f"status_{kind}", "shape_id string, n long, error string", paths, names, onerror="any" if skip_on_error else "missing")


def fetch(spark: SparkSession, kind: str, paths: list[str], names: list[str] | None = None, skip_on_error: bool = False, seed: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Points of each file with `read`, the name of the file that they come from: another one where it is lost.

    Lost are missing files, and with skip_on_error all that can't be read, which fail the job otherwise. Another file is drawn
    by a hash of the name from all that can be read, of which one that has become unreadable since is an error. Where none can
    be read, there are no points. Names must differ. Files are checked in a first pass; points are read once.
    """
    told = checkpointed(statuses(spark, kind, paths, names, skip_on_error))
    items = told.select(F.lit("all").alias("grp"), F.col("shape_id").alias("item"), "error")
    drawn = substitute_missing(items.select("grp", "item"), items.where("error is not null"), seed).select("item", F.col("read").alias("shape_id"))
    rows = _load(spark, f"points_{kind}", POINT_SCHEMA + ", error string", paths, names, onerror="any" if skip_on_error else "missing", splitbytes=split_bytes)
    # What is raised names the item, so that it is worked out after the join, for files that were drawn.
    told = F.raise_error(F.concat_ws(": ", "item", "shape_id", "error")).cast("boolean")
    kept = with_group(rows, drawn, "shape_id").where(F.when(F.col("error").isNull(), True).otherwise(told))
    return kept.select(F.col("item").alias("shape_id"), F.col("shape_id").alias("read"), *(c.split()[0] for c in POINT_SCHEMA.split(", ")[1:]))


def with_colours(points: DataFrame, colours: DataFrame) -> DataFrame:
    """points with the colours of a side table (shape_id, point_id, r, g, b), such as read from files that hold nothing else."""
    return points.drop("r", "g", "b").join(colours.select("shape_id", "point_id", "r", "g", "b"), ["shape_id", "point_id"], "left").select(*points.columns)


def write_npz(points: DataFrame, folder: str, volume: DataFrame | None = None, lattices: DataFrame | None = None) -> None:
    """An npz file for each shape: its points and, of `volume` (as from read_volumes()), its cells.

    `lattices` (as from read_lattices()) are written where given: cells then need i, j, k and val only, and a volume keeps
    its size whatever cells are unknown, all of them too.
    """
    register(points.sparkSession)
    rows = points
    if volume is not None:
        rows = rows.unionByName(volume if lattices is None else volume.select("shape_id", "i", "j", "k", "val"), allowMissingColumns=True)
    if lattices is not None:
        rows = rows.unionByName(lattices, allowMissingColumns=True)
    _write(rows, "points_npz", folder, "point_id")


def _write(rows: DataFrame, source: str, folder: str, order: str, **options) -> None:
    """A shape's rows meet in one task, as its file needs them together."""
    register(rows.sparkSession)
    rows.repartition("shape_id").sortWithinPartitions("shape_id", order).write.format(source).mode("append").options(**options).save(folder)


def write_ply(points: DataFrame, folder: str) -> None:
    """A ply file for each shape."""
    _write(points, "points_ply", folder, "point_id")


def write_meshes(triangles: DataFrame, folder: str) -> None:
    """A ply file of vertices and faces for each shape's triangles (shape_id, face_id, ax..cz)."""
    _write(triangles, "mesh_ply", folder, "face_id")


#: What is written of each type of artifact, and the column that orders its rows. Fixed names.
ARTIFACTS = {"points": ("points_ply", "point_id"), "mesh": ("mesh_ply", "face_id"), "array": ("points_npy", "point_id")}


def write_artifacts(rows: DataFrame, folder: str, type_: str) -> None:
    """A file <folder>/<key>/<batch_idx, six digits> for the rows of each key and batch_idx: ply of points or of a mesh, or npy of an array."""
    source, order = ARTIFACTS[type_]
    named = rows.withColumn("shape_id", F.format_string("%s/%06d", F.col("key"), F.col("batch_idx").cast("long"))).drop("key", "batch_idx")
    _write(named, source, folder, order, folders="true")


def read_manifest(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """grp, item of the <folder>/<group>/<split>.lst files; blank lines are dropped."""
    lines = spark.read.text(f"{folder}/*/{split}.lst").withColumn("_file", F.input_file_name())
    return lines.select(F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1).alias("grp"), F.trim("value").alias("item")).where(F.length("item") > 0)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """name, input, gt of a list of white-space separated pairs; the name is the input's stem."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(parts[0].alias("input"), F.get(parts, F.lit(1)).alias("gt"))
    return rows.select(F.regexp_extract("input", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), "input", "gt")


def occupancy_samples(spark: SparkSession, points: DataFrame, packed: bytes) -> DataFrame:
    """points (point_id, ...) with occ, the bit of their place in `packed`, the high bit of each byte first."""
    one = spark.createDataFrame([(bytearray(packed),)], "packed binary")
    bits = one.select(F.posexplode(unpack_bits(F.col("packed"), 8 * len(packed))).alias("point_id", "occ"))
    return points.join(bits.withColumn("point_id", F.col("point_id").cast("long")), "point_id")


def dummy_occupancy(spark: SparkSession, n: int = 32) -> DataFrame:
    """n points at the origin, none of them inside."""
    return spark.range(n).select(F.col("id").alias("point_id"), *(F.lit(0.0).alias(a) for a in "xyz"), F.lit(False).alias("occ"))


def empty_geometry(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """No points, and a volume of one cell of value 1 over the unit cube."""
    cell = spark.createDataFrame([("empty", 0, 0, 0, 1.0)], "shape_id string, i int, j int, k int, val double")
    return spark.createDataFrame([], POINT_SCHEMA), cell


#: Sources by the name that configurations use; never evaluated from text.
SOURCES = {kind: (lambda spark, paths, kind=kind, **more: read_points(spark, kind, paths, **more)) for kind in DECODERS}


def list_regions(folder: str, scenes: list[str]) -> list[tuple[str, str]]:
    """(scene, region) for the folders in each scene's folder, by name within the scenes' order."""
    fs, path = opened(folder)
    out = []
    for scene in scenes:
        found = fs.get_file_info(filesystems.FileSelector(f"{path.rstrip('/')}/{scene}", allow_not_found=True))
        out += [(scene, f.base_name) for f in sorted(found, key=lambda f: f.base_name)]
    return out


def record_folder(base: str, dataset: str, name: str) -> str:
    """Where a run's results go: a folder for the data set, in it one for the run."""
    return f"{base.rstrip('/')}/{dataset}/{name}"


def list_files(folder: str, suffix: str, nested: bool = False) -> list[str]:
    """URIs of the files in a folder, and if `nested` in those within it, by name. What unfinished jobs have written is left out."""
    folder = arrow_uri(folder)
    fs, path = opened(folder)
    scheme = folder[: folder.index(path)] if path in folder else ""
    found = fs.get_file_info(filesystems.FileSelector(path, allow_not_found=True, recursive=nested))
    return sorted(f"{scheme}{f.path}" for f in found if f.path.endswith(suffix) and "/_attempts/" not in f.path[len(path.rstrip("/")) :])
