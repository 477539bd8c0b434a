"""Tracks as NumPy archives: a Spark data source, ``tracks_npz``, of one compressed archive a chamber.

Fixed values: the arrays' names. ``fps`` holds one number, ``fly_<n>_<field>`` a field of a fly
frame by frame (NaN for unknown), ``overlap_0`` whether the flies overlap; the file of chamber n
is ``chamber_<n>_tracks.npz``, in the folder of its results.
"""

from __future__ import annotations

import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FIELDS = ("x", "y", "theta", "a", "b", "area", "wing_angle")
_NAME = re.compile(r"chamber_(\d+)_tracks\.npz")
SCHEMA = "run string, chamber int, fps double, fly int, frame long, " + ", ".join(f"{f} double" for f in FIELDS) + ", overlap boolean"
_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
#: Frames of one Arrow batch.
_BATCH = 1 << 16


@dataclass
class _Archive(InputPartition):
    path: str
    run: str
    chamber: int


@dataclass
class _Written(WriterCommitMessage):
    #: (name while written, final name) of each archive.
    files: list[tuple[str, str]]


class Tracks(DataSource):
    """Rows (run, chamber, fps, fly, frame, fields, overlap); ``columns`` names those that are read."""

    @classmethod
    def name(cls) -> str:
        return "tracks_npz"

    def schema(self) -> str:
        wanted = self.options.get("columns")
        return SCHEMA if not wanted else ", ".join(c for c in SCHEMA.split(", ") if c.split()[0] in wanted.split(","))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if missing := {"run", "chamber", "fly", "frame"} - set(schema.names):
            raise ValueError(f"tracks_npz needs the columns {sorted(missing)}")
        return _Writer(self.options["path"], overwrite)


class _Reader(DataSourceReader):
    """A partition for each archive; of an archive only the wanted arrays are unpacked."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        system, base = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(base, recursive=True)) if system.get_file_info(base).type == fs.FileType.Directory else [system.get_file_info(base)]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and (m := _NAME.fullmatch(f.base_name)):
                folder = f.path[: -len(f.base_name)].rstrip("/")
                out.append(_Archive(f.path, folder[len(base) :].strip("/"), int(m[1])))
        return out or [_Archive("", "", 0)]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        try:
            with system.open_input_file(partition.path) as f, np.load(f) as data:
                yield from self._rows(partition, data)
        except (OSError, ValueError, EOFError):  # no archive: nothing is known of its tracks
            return

    def _rows(self, partition: _Archive, data: np.lib.npyio.NpzFile) -> Iterator[pa.RecordBatch]:
        fps = float(data["fps"][0]) if "fps" in data.files else 30.0
        overlap = data["overlap_0"] if "overlap" in self.names and "overlap_0" in data.files else None
        flies = sorted({int(m[1]) for n in data.files if (m := re.fullmatch(r"fly_(\d+)_\w+", n))})
        for fly in flies:
            held = [n for n in data.files if n.startswith(f"fly_{fly}_")]
            arrays = {f: data[f"fly_{fly}_{f}"] for f in FIELDS if f in self.names and f"fly_{fly}_{f}" in held}
            n = len(next(iter(arrays.values()))) if arrays else len(data[held[0]])
            for at in range(0, n, _BATCH):
                size = min(_BATCH, n - at)
                made = {
                    "run": lambda: pa.array([partition.run] * size), "chamber": lambda: pa.array([partition.chamber] * size, pa.int32()),
                    "fps": lambda: pa.array([fps] * size), "fly": lambda: pa.array([fly] * size, pa.int32()), "frame": lambda: pa.array(np.arange(at, at + size)),
                    "overlap": lambda: pa.nulls(size, pa.bool_()) if overlap is None else pa.array(overlap[at : at + size].tolist() + [None] * (size - len(overlap[at : at + size])), pa.bool_()),
                }
                columns = [
                    made[c]() if c in made else pa.array(np.asarray(arrays[c][at : at + size], float), from_pandas=True) if c in arrays else pa.nulls(size, pa.float64())
                    for c in self.names
                ]
                yield pa.RecordBatch.from_arrays(columns, self.names)


class _Writer(DataSourceArrowWriter):
    """Partitions hold whole chambers, sorted by run and chamber; archives take their names once all tasks are done."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, base = fs.FileSystem.from_uri(self.path)
        done: list[tuple[str, str]] = []
        part = TaskContext.get().partitionId()
        try:
            for (run, chamber), rows in _chambers(iterator):
                folder = "/".join(filter(None, (base, run)))
                system.create_dir(folder, recursive=True)
                temporary = f"{folder}/_{part}-{uuid.uuid4().hex}"
                done.append((temporary, f"{folder}/chamber_{chamber}_tracks.npz"))
                packed = io.BytesIO()
                np.savez_compressed(packed, **_arrays(rows))
                with system.open_output_stream(temporary) as out:
                    out.write(packed.getbuffer())
        except BaseException:
            _drop(system, [f for f, _ in done])
            raise
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        files = [f for m in messages if m for f in m.files]
        taken = [name for _, name in files if system.get_file_info(name).type != fs.FileType.NotFound]
        if taken and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{taken[0]} exists already")
        for temporary, name in files:
            system.move(temporary, name)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _ = fs.FileSystem.from_uri(self.path)
        _drop(system, [f for m in messages if m for f, _ in m.files])


def _drop(system: fs.FileSystem, files: list[str]) -> None:
    for f in files:
        if system.get_file_info(f).type != fs.FileType.NotFound:
            system.delete_file(f)


def _chambers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Table]]:
    """The rows of each chamber, which come one after the other."""
    key, held = None, []
    for batch in batches:
        runs, chambers = batch.column("run").to_pylist(), batch.column("chamber").to_pylist()
        starts = [i for i in range(len(runs)) if i == 0 or (runs[i], chambers[i]) != (runs[i - 1], chambers[i - 1])]
        for i, j in zip(starts, [*starts[1:], len(runs)], strict=True):
            if key is not None and key != (runs[i], chambers[i]):
                yield key, pa.Table.from_batches(held)
                held = []
            key = runs[i], chambers[i]
            held.append(batch.slice(i, j - i))
    if key is not None:
        yield key, pa.Table.from_batches(held)


def _arrays(rows: pa.Table) -> dict[str, np.ndarray]:
    """The archive's arrays; frames without a row are NaN, and not overlapping."""
    n = pc.max(rows.column("frame")).as_py() + 1
    fps = rows.column("fps")[0].as_py() if "fps" in rows.column_names else None
    out = {"fps": np.array([30.0 if fps is None else fps])}
    fly = rows.column("fly").to_numpy()
    for k in sorted(set(fly.tolist())):
        some = rows.filter(pa.array(fly == k))
        at = some.column("frame").to_numpy()
        for f in FIELDS:
            if f in rows.column_names:
                out[f"fly_{k}_{f}"] = np.full(n, np.nan)
                out[f"fly_{k}_{f}"][at] = some.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False)
    if "overlap" in rows.column_names:
        out["overlap_0"] = np.zeros(n, bool)
        out["overlap_0"][rows.filter(pc.fill_null(rows.column("overlap"), False)).column("frame").to_numpy()] = True
    return out


def write_archives(tracks: DataFrame, path: str, overwrite: bool = False) -> None:
    """``tracks`` (run, chamber, fly, frame, and any of fps, fields, overlap) as one archive a chamber.

    A chamber is one file, so its rows meet in one task. A run is a folder below ``path``. NULL
    becomes NaN. No archive appears before all are written, and those of failed tasks are removed.
    """
    spark = tracks.sparkSession
    spark.dataSource.register(Tracks)
    kept = [c for c in _COLUMNS if c in tracks.columns]
    rows = tracks.select(*kept).where("run is not null and chamber is not null and fly is not null and frame >= 0")
    rows = rows.repartition("run", "chamber").sortWithinPartitions("run", "chamber", "frame", "fly")
    rows.write.format("tracks_npz").mode("overwrite" if overwrite else "append").save(path)


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Tracks of all archives below ``path`` (or of one), NULL for NaN; with ``columns`` only those arrays are unpacked.

    A file that is no archive gives no rows; a fly without a field has NULLs there.
    """
    spark.dataSource.register(Tracks)
    reader = spark.read.format("tracks_npz")
    if columns is not None:
        reader = reader.option("columns", ",".join(columns))
    out = reader.load(path)
    return out.select(*columns) if columns is not None else out
