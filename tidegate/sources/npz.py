"""NumPy archives as a data source: executors read ranges of rows of each member, the driver only headers.

`spark.read.format("npz").option("kind", "panel").load(path)` after `register(spark)`. A filter on `t` prunes ranges.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO, Any

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tidegate.errors import LimitError, SourceError
from tidegate.sources.files import Limits

#: Of each kind: the member that names the columns, what its index and label are called, and the matrices' new names.
KINDS = {
    "panel": ("asset_ids", "asset_idx", "asset", {"signal_prices": "price", "tradable_returns": "ret"}),
    "returns": ("candidate_ids", "cand_idx", "candidate_id", {"gross_returns": "gross", "net_returns": "net", "turnover": "turnover"}),
}
#: Values that a task reads at about most, and that a batch holds.
TASK_CELLS, BATCH_CELLS = 4_000_000, 250_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def members(kind: str) -> tuple[str, ...]:
    ids, _, _, names = KINDS[kind]
    return ("sessions", ids, *names)


def _open(path: str) -> IO[bytes]:
    """A path of this machine or a mount, or of a file system that Arrow knows by its scheme."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        return system.open_input_file(place)
    return open(path.removeprefix("file://"), "rb")


class Archive:
    """An open archive; headers are read at once, values by ranges of rows."""

    def __init__(self, path: str) -> None:
        self.file = _open(path)
        self.file.seek(0, 2)
        self.bytes = self.file.tell()
        self.file.seek(0)
        try:
            self.zip = zipfile.ZipFile(self.file)
        except zipfile.BadZipFile as error:
            raise SourceError("an .npz file is needed") from error
        self.headers = {n.removesuffix(".npy"): self._header(n) for n in self.zip.namelist()}

    def _header(self, name: str) -> tuple[tuple[int, ...], bool, np.dtype, int]:
        with self.zip.open(name) as member:
            version = np.lib.format.read_magic(member)
            shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
            return shape, fortran, kind, member.tell()

    def rows(self, name: str, first: int, last: int) -> np.ndarray:
        """Rows of a member; one that is stored by columns is read as often as it has columns."""
        shape, fortran, kind, start = self.headers[name]
        if kind.hasobject:
            raise SourceError("arrays of objects are not read")
        with self.zip.open(f"{name}.npy") as member:
            if not fortran or len(shape) == 1:
                width = int(np.prod(shape[1:], dtype=np.int64))
                member.seek(start + first * width * kind.itemsize)
                return np.frombuffer(member.read((last - first) * width * kind.itemsize), kind).reshape(last - first, *shape[1:])
            columns = []
            for k in range(shape[1]):
                member.seek(start + (k * shape[0] + first) * kind.itemsize)
                columns.append(np.frombuffer(member.read((last - first) * kind.itemsize), kind))
            return np.stack(columns, axis=1)

    def close(self) -> None:
        self.zip.close()
        self.file.close()


def check(path: str, kind: str, limits: Limits = Limits()) -> tuple[int, list[str]]:
    """The number of sessions and the ids of an archive that is of its kind, by its headers and ids alone."""
    if kind not in KINDS:
        raise SourceError("no such kind of archive")
    if not path.endswith(".npz"):
        raise SourceError("an .npz file is needed")
    try:
        archive = Archive(path)
    except OSError as error:
        raise SourceError("an .npz file is needed") from error
    try:
        if archive.bytes > limits.file_bytes:
            raise LimitError("the archive is too large")
        if set(archive.headers) != set(members(kind)):
            raise SourceError("the archive's members are not the declared ones")
        shapes = {n: h[0] for n, h in archive.headers.items()}
        name = KINDS[kind][0]
        if any(len(shapes[n]) != 1 for n in ("sessions", name)) or archive.headers[name][2].kind != "U":
            raise SourceError("ids must be distinct strings")
        ids = archive.rows(name, 0, shapes[name][0]).tolist()
        if len(set(ids)) != len(ids):
            raise SourceError("ids must be distinct strings")
        shape = (shapes["sessions"][0], len(ids))
        if any(shapes[n] != shape or archive.headers[n][2].kind not in "fiu" for n in KINDS[kind][3]):
            raise SourceError("arrays must be finite and of sessions by ids")
        return shape[0], ids
    finally:
        archive.close()


@dataclass
class Rows(InputPartition):
    """Sessions from `first` to before `last`."""

    first: int
    last: int


class NpzReader(DataSourceReader):
    def __init__(self, path: str, kind: str, limits: Limits) -> None:
        self.path, self.kind = path, kind
        self.sessions, self.ids = check(path, kind, limits)
        self.first, self.last = 0, self.sessions

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on t narrow the range; every other filter is Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != ("t",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value + 1)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.last = min(self.last, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        step = max(1, TASK_CELLS // max(1, len(self.ids)))
        return [Rows(k, min(k + step, self.last)) for k in range(self.first, self.last, step)] or [Rows(0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        archive, step = Archive(self.path), max(1, BATCH_CELLS // max(1, len(self.ids)))
        try:
            for first in range(partition.first, partition.last, step):
                yield self._batch(archive, first, min(first + step, partition.last))
        finally:
            archive.close()

    def _batch(self, archive: Archive, first: int, last: int) -> pa.RecordBatch:
        _, index, label, names = KINDS[self.kind]
        t = np.repeat(np.arange(first, last), len(self.ids))
        i = np.tile(np.arange(len(self.ids)), last - first)
        session = archive.rows("sessions", first, last).astype("datetime64[us]")[t - first]
        columns: dict[str, Any] = {"t": pa.array(t, pa.int64()), "session": pa.array(session, pa.timestamp("us")), index: pa.array(i, pa.int64()), label: pa.array(self.ids, pa.string()).take(pa.array(i))}
        for old, new in names.items():
            values = archive.rows(old, first, last).astype(float)
            if not np.isfinite(values).all():
                raise SourceError("arrays must be finite and of sessions by ids")
            columns[new] = pa.array(values.ravel())
        return pa.RecordBatch.from_pydict(columns)


class NpzSource(DataSource):
    """Options: path and kind (panel or returns), and file_bytes, the most that an archive may have."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        _, index, label, names = KINDS[self.options["kind"]]
        return f"t long, session timestamp_ntz, {index} long, {label} string, " + ", ".join(f"{n} double" for n in names.values())

    def reader(self, schema: Any) -> DataSourceReader:
        return NpzReader(self.options["path"], self.options["kind"], Limits(file_bytes=int(self.options.get("file_bytes", Limits().file_bytes))))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it push filters to Python sources, which this one relies on."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(NpzSource)
