"""NetCDF files of the classic formats (CDF-1, CDF-2, CDF-5) as a data source: one row for each value of each variable.

``spark.read.format("netcdf_classic").load(path)`` has the columns variable, one for each dimension (its coordinate, or its index where it has
none) and value (double; null where the file marks it as missing; scale and offset applied). The driver reads headers only. A task reads a range
of the outermost dimension of one variable, by its byte ranges: a run of bytes of a fixed variable, and one for each record of a record variable.
Filters on variable choose the tasks, and filters on the outermost dimension narrow what they read. Files are opened with Arrow's file
systems (local paths and the stores that it knows). NetCDF-4 files are HDF5 and give an error that says so. Times stay the numbers that they are.

Options: ``variables`` (names by comma; all with the most dimensions by default), ``rows`` (values of a task, about).
"""

from __future__ import annotations

import fnmatch
import math
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "netcdf_classic"
# Fixed values of the format: tags of the header's lists, and the external types.
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
_DEFAULT_FILL = {">i1": -127, ">i2": -32767, ">i4": -2147483647, ">f4": 9.969209968386869e36, ">f8": 9.969209968386869e36, ">i8": -9223372036854775806}
_HDF5 = b"\x89HDF\r\n\x1a\n"
ROWS = 1 << 20


@dataclass(frozen=True)
class Variable:
    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: str
    begin: int
    record: bool
    attributes: dict

    @property
    def inner(self) -> int:
        """Values for each index of the outermost dimension."""
        return math.prod(self.shape[1:])

    @property
    def size(self) -> int:
        return np.dtype(self.kind).itemsize


@dataclass(frozen=True)
class Header:
    variables: dict[str, Variable]
    record_size: int

    def coordinate(self, dim: str) -> Variable | None:
        """The variable that gives a dimension's values: numbers along it, or characters along it and a second one."""
        v = self.variables.get(dim)
        return v if v is not None and v.dims[:1] == (dim,) and len(v.dims) == (2 if v.kind == "S1" else 1) else None

    def data(self) -> list[str]:
        """The variables with the most dimensions, coordinates aside."""
        own = [v for v in self.variables.values() if v.kind != "S1" and v.dims and self.coordinate(v.name) is None]
        return [v.name for v in own if len(v.dims) == max(len(x.dims) for x in own)]


class _Cursor:
    """Numbers and names from the start of a file."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.have = file, size, 0, b""

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.have):
            if len(self.have) >= self.size:
                raise ValueError("the header ends before it should")
            self.have = self.file.read_at(min(self.size, max(1 << 16, 2 * (self.at + n))), 0)
        self.at += n
        return self.have[self.at - n : self.at]

    def number(self, width: int = 4) -> int:
        return int.from_bytes(self.take(width), "big")

    def padded(self, n: int) -> bytes:
        return self.take(-(-n // 4) * 4)[:n]


def header(file, size: int, path: str = "") -> Header:
    """The dimensions and variables of an open file."""
    c = _Cursor(file, size)
    magic = c.take(min(8, size))
    if magic == _HDF5:
        raise ValueError(f"{path} is a NetCDF-4 file, which is HDF5; the classic formats are read (nccopy -k classic makes one)")
    if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError(f"{path} is no NetCDF file of a classic format")
    version, c.at = magic[3], 4
    count = 8 if version == 5 else 4
    records = c.number(count)
    name = lambda: c.padded(c.number(count)).decode()

    def entries(tag: int) -> range:
        found, n = c.number(), c.number(count)
        if n and found != tag:
            raise ValueError(f"{path} has a header that is not understood")
        return range(n)

    def attributes() -> dict:
        out = {}
        for _ in entries(_ATTRIBUTES):
            key, kind = name(), _TYPES[c.number()]
            n = c.number(count)
            raw = c.padded(n * np.dtype(kind).itemsize)
            out[key] = raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, kind).tolist()
        return out

    dims = [(name(), c.number(count)) for _ in entries(_DIMENSIONS)]
    attributes()
    raw = []
    for _ in entries(_VARIABLES):
        own = name()
        at = [c.number(count) for _ in range(c.number(count))]
        of = attributes()
        kind = _TYPES[c.number()]
        c.number(count)
        raw.append((own, at, of, kind, c.number(4 if version == 1 else 8)))
    is_record = lambda at: bool(at) and dims[at[0]][1] == 0
    bytes_of = lambda at, kind: math.prod(dims[i][1] for i in at[1:]) * np.dtype(kind).itemsize
    slabs = [bytes_of(at, kind) for _, at, _, kind, _ in raw if is_record(at)]
    record_size = slabs[0] if len(slabs) == 1 else sum(-(-s // 4) * 4 for s in slabs)
    if records == (1 << 8 * count) - 1:  # written as a stream: the file's size tells
        records = (size - min(b for *_, at, _, _, b in ((x[0], x[1], x[2], x[3], x[4]) for x in raw) if is_record(at))) // record_size
    shape = lambda at: tuple(records if i == at[0] and dims[i][1] == 0 else dims[i][1] for i in at)
    return Header({own: Variable(own, tuple(dims[i][0] for i in at), shape(at), kind, begin, is_record(at), of) for own, at, of, kind, begin in raw}, record_size)


def _values(file, head: Header, v: Variable, start: int, stop: int) -> np.ndarray:
    """The values of a range of the outermost dimension, flat; nothing else is read."""
    n, width = v.inner, v.inner * v.size
    if not v.record:
        return np.frombuffer(file.read_at((stop - start) * width, v.begin + start * width), v.kind)
    return np.concatenate([np.frombuffer(file.read_at(width, v.begin + i * head.record_size), v.kind) for i in range(start, stop)] or [np.zeros(0, v.kind)]).reshape(-1)[: (stop - start) * n]


def _decoded(raw: np.ndarray, v: Variable) -> pa.Array:
    fills = [x for key in ("_FillValue", "missing_value") for x in (v.attributes[key] if isinstance(v.attributes.get(key), list) else [])] or [_DEFAULT_FILL.get(v.kind)]
    missing = np.isin(raw, np.array([x for x in fills if x is not None], v.kind))
    if v.kind in (">f4", ">f8"):
        missing |= np.isnan(raw)
    one = lambda key, default: v.attributes.get(key, [default])[0]
    return pa.array(raw.astype(np.float64) * one("scale_factor", 1.0) + one("add_offset", 0.0), mask=missing)


def _coordinates(file, head: Header, dim: str, start: int, stop: int) -> pa.Array:
    v = head.coordinate(dim)
    if v is None:
        return pa.array(np.arange(start, stop, dtype=np.int64))
    raw = _values(file, head, v, start, stop)
    if v.kind == "S1":
        rows = raw.reshape(stop - start, -1)
        return pa.array([b"".join(r.tolist()).rstrip(b"\0 ").decode() for r in rows], pa.string())
    whole = np.dtype(v.kind).kind in "iu"
    return pa.array(raw.astype(np.int64 if whole else np.float64))


def _column(head: Header, dim: str) -> str:
    v = head.coordinate(dim)
    return "bigint" if v is None or np.dtype(v.kind).kind in "iu" else "string" if v.kind == "S1" else "double"


def _listed(path: str) -> tuple[fs.FileSystem, list[str]]:
    """A file system and the files of a path, whose last part may be a pattern."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if not any(x in os.path.basename(at) for x in "*?["):
        return store, [at]
    found = store.get_file_info(fs.FileSelector(os.path.dirname(at)))
    names = sorted(x.path for x in found if x.is_file and fnmatch.fnmatch(os.path.basename(x.path), os.path.basename(at)))
    if not names:
        raise FileNotFoundError(path)
    return store, names


def _opened(store: fs.FileSystem, name: str):
    file = store.open_input_file(name)
    return file, header(file, file.size(), name)


@dataclass
class Range(InputPartition):
    file: str
    variable: str
    start: int
    stop: int


_COMPARED = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal}


class NetcdfReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], dims: tuple[str, ...], rows: int):
        self.path, self.names, self.dims, self.rows, self.kept = path, names, dims, rows, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("variable",) and isinstance(f, (EqualTo, In)):
                asked = f.value if isinstance(f, In) else (f.value,)
                self.names = [n for n in self.names if n in asked]
                continue
            if getattr(f, "attribute", None) == (self.dims[0],) and isinstance(f, (*_COMPARED, In)):
                self.kept.append(f)
            yield f  # the range that a task reads is narrowed, and Spark filters its rows

    def partitions(self) -> list[InputPartition]:
        store, files = _listed(self.path)
        out = []
        for name in files:
            file, head = _opened(store, name)
            with file:
                for v in (head.variables[n] for n in self.names):
                    step = max(1, self.rows // max(1, v.inner))
                    out += [Range(name, v.name, i, min(i + step, v.shape[0])) for i in range(0, v.shape[0], step)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no variable is asked for
            return
        file, head = _opened(_listed(self.path)[0], part.file)
        with file:
            v, start, stop = head.variables[part.variable], part.start, part.stop
            if self.kept:
                at = _coordinates(file, head, v.dims[0], start, stop).to_numpy(zero_copy_only=False)
                inside = np.ones(len(at), bool)
                for f in self.kept:
                    inside &= np.isin(at, list(f.value)) if isinstance(f, In) else _COMPARED[type(f)](at, f.value)
                if not inside.any():
                    return
                start, stop = start + int(inside.argmax()), stop - int(inside[::-1].argmax())
            shape = (stop - start, *v.shape[1:])
            columns, n = [], math.prod(shape)
            for k, dim in enumerate(v.dims):
                own = _coordinates(file, head, dim, start, stop) if k == 0 else _coordinates(file, head, dim, 0, shape[k])
                inner = math.prod(shape[k + 1 :])
                columns.append(own.take(pa.array(np.arange(n) // max(1, inner) % shape[k])))
            yield pa.RecordBatch.from_arrays([pa.array([part.variable] * n, pa.string()), *columns, _decoded(_values(file, head, v, start, stop), v)], ["variable", *v.dims, "value"])


class NetcdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def _plan(self) -> tuple[str, list[str], tuple[str, ...], Header]:
        path = self.options.get("path")
        if not path:
            raise ValueError("a path is needed")
        store, files = _listed(path)
        file, head = _opened(store, files[0])
        file.close()
        names = [n.strip() for n in self.options["variables"].split(",")] if "variables" in self.options else head.data()
        unknown = [n for n in names if n not in head.variables]
        if unknown or not names:
            raise ValueError(f"{path} has no variables {unknown}: it has {sorted(head.variables)}")
        dims = head.variables[names[0]].dims
        if any(head.variables[n].dims != dims for n in names):
            raise ValueError(f"variables of different dimensions are read one by one: {names}")
        return path, names, dims, head

    def schema(self) -> str:
        _, _, dims, head = self._plan()
        return ", ".join(["variable string", *(f"`{d}` {_column(head, d)}" for d in dims), "value double"])

    def reader(self, schema) -> NetcdfReader:
        path, names, dims, _ = self._plan()
        return NetcdfReader(path, names, dims, int(self.options.get("rows", ROWS)))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NetcdfSource)
